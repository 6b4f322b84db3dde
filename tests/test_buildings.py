"""The building queries against their SQL on DuckDB, and their parts against brute force and known shapes."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from terrakiln.functions import geometry as G
from terrakiln.operators import crop as C
from terrakiln.operators import models as M
from terrakiln.operators import selection as S
from terrakiln.plans import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, duck, name):
    got, expected = Q.QUERIES[name](spark, DATA).toPandas(), duck.execute(Q.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    got, expected = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, expected))
    assert len(got) == len(expected)
    for c in columns:
        assert ((got[c] == expected[c]) | (got[c].isna() & expected[c].isna())).all(), c


def shape(spark, rings):
    rows = [(i, [(int(x), int(y)) for x, y in ring]) for i, ring in enumerate(rings)]
    return spark.createDataFrame(rows, "fid long, ring array<struct<x: long, y: long>>")


ELL = [(0, 0), (10, 0), (10, 5), (5, 5), (5, 10), (0, 10)]
SKEW = [(0, 0), (9, 2), (12, 9), (4, 11), (5, 5)]


def parity(ring, x, y):
    n = 0
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            n += 1
    return n % 2 == 1


def edge_distance(ring, x, y):
    best = math.inf
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        t = max(0, min(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        best = min(best, (x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2)
    return best


@pytest.mark.parametrize("ring", [ELL, SKEW, SKEW[::-1]])
def test_inside_and_within(spark, ring):
    spots = spark.createDataFrame([(x, y) for x in range(-3, 16) for y in range(-3, 16)], "x long, y long")
    both = spots.crossJoin(shape(spark, [ring])).select("x", "y", G.inside(F.col("ring"), F.col("x"), F.col("y")).alias("i"), G.within(F.col("ring"), F.col("x"), F.col("y"), 2).alias("w"))
    for r in both.collect():
        assert r.w == (edge_distance(ring, r.x, r.y) <= 4 + 1e-9)
        if edge_distance(ring, r.x, r.y) > 1e-9:
            assert r.i == parity(ring, r.x, r.y)


def test_rings(spark):
    closed = [*ELL, ELL[0]]
    assert shape(spark, [SKEW]).select(G.centroid(F.col("ring"), "x")).first()[0] == pytest.approx(6.3829787, abs=1) and shape(spark, [ELL]).select(G.centroid(F.col("ring"), "y")).first()[0] == pytest.approx(25 / 6)
    r = shape(spark, [closed[::-1]]).select(G.area2("ring").alias("a"), G.area2(G.counter_clockwise(G.open_ring(F.col("ring")))).alias("b"), F.size(G.open_ring(F.col("ring"))).alias("n")).first()
    assert (r.a, r.b, r.n) == (-150, 150, 6)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 11])
@pytest.mark.parametrize("p", [0.05, 0.5, 0.7, 0.98])
def test_percentiles(spark, n, p):
    values = F.array(*[F.lit(v) for v in reversed(range(n))])
    r = spark.range(1).select(G.rank_n(values, p), G.rank_n1(values, p), G.rank_round(values, p)).first()
    assert tuple(r) == (min(math.trunc(n * p), n - 1), math.floor((n - 1) * p), min(math.floor(n * p + 0.5), n - 1))


def test_prism_is_closed(spark):
    faces = M.prism(shape(spark, [ELL, SKEW]).withColumn("base", F.lit(1).cast("long")).withColumn("top", F.lit(6).cast("long")))
    edges = {r.fid: r for r in M.edge_use(faces).collect()}
    assert {(r.n_edges, r.n_bad) for r in edges.values()} == {(18, 0), (15, 0)}
    hole = spark.createDataFrame([(0, [[(x, y) for x, y in r] for r in ([(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (7, 3), (7, 7), (3, 7)])], 0, 5)], "fid long, rings array<array<struct<x: long, y: long>>>, base long, top long")
    assert M.volume6(M.prism(hole)).first().volume6 == 6 * 420
    assert M.edge_use(M.prism(hole)).first()[1:] == (24, 0)
    assert M.prism(hole).where("label = 2").count() == 8
    square = M.prism(shape(spark, [[(0, 0), (10, 0), (10, 10), (0, 10)]]).withColumn("base", F.lit(0).cast("long")).withColumn("top", F.lit(5).cast("long")))
    assert M.volume6(square).first().volume6 == 6 * 500


def test_slopes(spark):
    r = spark.range(1).select(G.slope(F.lit(-3.0), F.lit(0.0), F.lit(5.0)), G.azimuth(F.lit(-3.0), F.lit(0.0)), G.azimuth(F.lit(3.0), F.lit(0.0)), G.azimuth(F.lit(0.0), F.lit(0.0))).first()
    assert r[0] == pytest.approx(math.degrees(math.atan(3 / 5)))
    assert (r[1], r[2], r[3]) == (270, 90, None)


def test_terrain_diagonals_and_gaps(spark):
    grid = lambda *cells: spark.createDataFrame(list(cells), "col long, row long, z long")
    flat = M.terrain_triangles(grid((0, 0, 1), (1, 0, 1), (0, 1, 1), (1, 1, 1)))
    assert flat.count() == 2
    other = M.terrain_triangles(grid((0, 0, 0), (1, 0, 2), (0, 1, 2), (1, 1, 10))).collect()
    assert sorted((r.z1, r.z2, r.z3) for r in other) == [(0, 2, 2), (2, 10, 2)]
    assert M.terrain_triangles(grid((0, 0, 1), (1, 0, 1), (0, 1, 1))).count() == 0


def test_terrain_modes(spark):
    grid = lambda *cells: spark.createDataFrame(list(cells), "col long, row long, z long")
    assert M.terrain_triangles(grid((0, 0, 1), (1, 0, 1), (0, 1, 1)), local=True).count() == 1
    nine = [(c, r, c + 2 * r) for c in range(3) for r in range(3) if (c, r) != (1, 1)]
    filled = M.fill_terrain(grid(*nine))
    assert filled.where("col = 1 AND row = 1").first().z == 3
    assert filled.count() == 9
    assert M.terrain_triangles(filled).count() == 8
    assert M.fill_terrain(grid()).count() == 0


@pytest.mark.parametrize("name,column,values", [
    ("selection", "reason", {"PREFERRED_AND_LATEST", "PREFERRED_NOT_LATEST", "LATEST_WITH_MUTATION", "BEST_COVERAGE"}), ("mutations", "mutated", {True, False}),
    ("routing", "mode", {"SKIP", "LOD11", "STANDARD"}), ("ground_height", "origin", {"buffer", "grid", "tile"}), ("building_stats", "glass_roof", {True, False}),
    ("building_stats", "insufficient", {True, False}),
])
def test_every_branch_occurs(spark, name, column, values):
    rows = Q.QUERIES[name](spark, DATA.replace("0.001", "0.01")).select(column).distinct().collect()
    assert {r[0] for r in rows} == values


def test_overlaps_occur(spark):
    rows = Q.QUERIES["overlap"](spark, DATA.replace("0.001", "0.01")).collect()
    assert sum(r.n_shared for r in rows) > 100
    assert 0 < sum(r.n_taken for r in rows) < sum(r.n_shared for r in rows)


def test_mask_covers_the_box(spark):
    square = shape(spark, [[(0, 0), (3000, 0), (3000, 3000), (0, 3000)]])
    assert C.mask(square).count() == 3600


def test_volume_far_from_the_origin(spark):
    far = shape(spark, [[(15_000_000 + x, 45_000_000 + y) for x, y in ((0, 0), (1000, 0), (1000, 1000), (0, 1000))]])
    faces = M.prism(far.withColumn("base", F.lit(0).cast("long")).withColumn("top", F.lit(500).cast("long")))
    assert M.volume6(faces).first().volume6 == 6 * 500_000_000


def test_merged_steps(spark):
    region = lambda fid, r, n, h: (fid, r, n, h)
    rows = [region(1, 0, 10, 400), region(1, 1, 30, 800), region(2, 0, 10, 400), region(2, 1, 30, 600), region(3, 0, 1, 0), region(3, 1, 1, 250), region(3, 2, 1, 500), region(3, 3, 2, 900), region(4, 0, 5, 7)]
    got = {r.fid: (r.n_regions, r.n_merged, r.h_50p) for r in M.merge_steps(spark.createDataFrame(rows, "fid long, region long, n long, h_50p long")).collect()}
    assert got == {1: (2, 2, [400, 800]), 2: (2, 1, [550]), 3: (4, 3, [125, 500, 900]), 4: (1, 1, [7])}


def test_odd_rows(spark):
    """Nulls, repeated rows, empty tables and columns of other names."""
    square = [(0, 0), (1000, 0), (1000, 1000), (0, 1000)]
    rows = [(1, [(x, y) for x, y in square], "a"), (1, [(x, y) for x, y in square], "a"), (2, None, "b"), (3, [], None)]
    own = spark.createDataFrame(rows, "fid long, ring array<struct<x: long, y: long>>, edges string")
    points = [("A", 10, 10, 5, 6, 2000, "q"), ("A", 10, 10, 5, 6, 2000, "q"), ("A", None, 10, 5, 6, 2000, "q"), ("A", 10, 10, None, 6, 2000, "q"), (None, 10, 10, 5, None, None, None)]
    schema = "pc string, x long, y long, z long, cls int, yr int, inside string"
    cropped = C.crop(spark.createDataFrame(points, schema), own)
    assert cropped.count() == 8
    assert C.crop(spark.createDataFrame([], schema), own).count() == 0
    empty = own.limit(0)
    assert C.crop(spark.createDataFrame(points, schema), empty).count() == 0
    stats = {(r.fid, r.pc): r for r in C.building_stats(cropped, own.dropDuplicates(["fid"]), ["A", "B"]).collect()}
    assert stats[1, "A"].n_data == 1 and stats[1, "B"].nodata == 1 and stats[1, "B"].insufficient
    assert C.bands(cropped).where("pc IS NULL").count() == 1
    assert C.mask(empty).count() == 0 and C.tile(empty).count() == 0
    assert M.prism(own.withColumn("base", F.lit(1)).withColumn("top", F.lit(None).cast("int"))).count() == 0


def test_terrain_source(spark):
    rows = [("a", 0, 2, 2020, False), ("b", 1, 1, 2018, False), ("c", 2, 1, 2019, False), ("d", 3, 0, 2024, True)]
    schema = "pc string, ord int, quality int, date int, date_only boolean"
    assert S.terrain_source(spark.createDataFrame(rows, schema)).first().pc == "c"
    assert S.terrain_source(spark.createDataFrame(rows[3:], schema)).count() == 0


def test_crop_joins_by_cells(spark):
    from terrakiln.plans import views as V

    plan = C.crop(V.points(spark, DATA), V.footprint(spark, DATA))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry(spark):
    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
