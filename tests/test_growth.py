"""What must not grow on the driver or be tested twice: plans over small tables."""

import re

import pytest

from terrakiln.operators import crop as C
from terrakiln.plans import queries as Q
from terrakiln.plans import views as V

DATA = "/root/testdata/sf0.001"
#: Queries whose footprints, cells or windows of footprints were broadcast.
BROADCAST = ["building_stats", "nodata_filled", "block_models", "reconstruction", "routing", "status_counts", "ground_height", "attributes", "mutations", "ground_user", "roof_planes", "selection", "year_override"]


def broadcast_of_exploded(plan: str) -> list[str]:
    """Lines of a plan that explode ranges of numbers under a broadcast, with no aggregate or kept table between."""
    found, at, stop = [], None, None
    for line in plan.splitlines():
        depth = len(re.match(r"[\s:|+-]*", line).group())
        if at is not None and depth <= at:
            at = None
        if stop is not None and depth <= stop:
            stop = None
        if at is None and "BroadcastExchange" in line:
            at, stop = depth, None
        elif at is not None and stop is None and "Aggregate(" in line:
            stop = depth
        elif at is not None and stop is None and "explode(sequence" in line:
            found.append(line)
    return found


@pytest.mark.parametrize("name", BROADCAST)
def test_no_exploded_rows_are_broadcast(spark, name):
    plan = Q.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not broadcast_of_exploded(plan)


def test_crop_tests_each_point_once(spark):
    cropped = C.crop(V.points(spark, DATA), V.footprint(spark, DATA))
    plan = cropped.where("inside AND cls = 6")._jdf.queryExecution().executedPlan().toString()
    assert not broadcast_of_exploded(plan)
    assert plan.count("aggregate(edges") == 1 and not any("aggregate(" in line for line in plan.splitlines() if "Join" in line or "Filter" in line)
    points = plan[: plan.index("lineitem.parquet")].splitlines()[-3:]
    assert not any("CASE WHEN" in line for line in points if "Filter" in line or "FileScan" in line)


#: Queries over the crop whose time was that of the test of points.
ONCE = ["z98", "cell_bands", "crop_counts", "thinned", "roof_rmse"]


@pytest.mark.parametrize("name", ONCE)
def test_query_tests_each_point_once(spark, name):
    plan = Q.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("aggregate(edges") == 1 and "BroadcastExchange" not in plan
