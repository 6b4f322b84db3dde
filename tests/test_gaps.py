"""The largest gaps: a search that ends, in the footprint only, over every point."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrakiln.plans import queries as Q
from terrakiln.plans import views as V
from terrakiln.recon import shapes as H

DATA = "/root/testdata/sf0.001"
COURT = [np.array(r, float) * 1.6 for r in V.SHAPES[2]]


def test_empty_circle_stays_in_the_footprint(monkeypatch):
    """The courtyard, emptier than the roof, is not searched to the last millimetre."""
    tried, reach = [0], H._reach

    def counted(centres, sites):
        tried[0] += len(centres)
        assert tried[0] < 50_000
        return reach(centres, sites)

    monkeypatch.setattr(H, "_reach", counted)
    at, radius = H.empty_circle(np.random.default_rng(0).uniform(0, 16, (150, 2)), COURT)
    assert H.A.inside(COURT, *at[:, None])[0] and 1 < radius < 2.9


def test_empty_circle_in_parts(monkeypatch):
    points = np.random.default_rng(3).uniform(0, 16, (2000, 2))
    whole = H.empty_circle(points, COURT)[1]
    monkeypatch.setattr(H, "MOST_DISTANCES", 1 << 12)
    assert H.empty_circle(points, COURT)[1] == pytest.approx(whole, abs=0.001)


def test_gaps_end_and_count_every_point(spark, monkeypatch):
    ring = [[(x, y) for x, y in ((0, 0), (100, 0), (100, 100), (0, 100))]]
    own = lambda: spark.createDataFrame([(1, ring)], "fid long, rings array<array<struct<x: long, y: long>>>")
    rows = [("A", x, y, 500, 6, 2020) for x in range(2, 100, 5) for y in range(2, 100, 5)]
    points = spark.createDataFrame(rows, "pc string, x long, y long, z long, cls int, yr int")
    monkeypatch.setattr(V, "footprint", lambda *_: own().withColumn("ring", F.get("rings", F.lit(0))))
    monkeypatch.setattr(V, "points", lambda *_: points)
    radius = {r.pc: r.radius for r in Q.empty_circles(spark, DATA).collect()}
    assert 0.03 < radius["A"] < 0.05 and radius["N"] > 0.4


def test_selection_by_gaps_ends(spark):
    rows = Q.selection_by_gaps(spark, DATA).collect()
    assert len(rows) == Q.selection(spark, DATA).count()
