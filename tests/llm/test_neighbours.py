import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrakiln.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, label int, v string, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "v", 1) for i, v in rows], SCHEMA)


def brute(rows, k=5):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for q, a in rows:
        if q % 50 == 0:
            best = sorted((-float((a * b).sum() / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum()))), i) for i, b in rows if i != q)[:k]
            out[q] = [i for _, i in best]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_recall_and_blocks(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 24))
    rows = [(i, centres[i % 20] + 0.5 * rng.standard_normal(24)) for i in range(1500)]
    expected = brute(rows)
    found = got(N.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, leaf=100, block=64, chunk=10))
    assert found.keys() == expected.keys()
    assert np.mean([len({*found[q]} & {*expected[q]}) / 5 for q in expected]) >= 0.97


def test_recall_without_structure(spark):
    """Uniform directions: the test rules out part of the leaves, and rarely wrongly."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(32)) for i in range(4000)]
    expected = brute(rows)
    found = got(N.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, leaf=64))
    assert np.mean([len({*found[q]} & {*expected[q]}) / 5 for q in expected]) >= 0.9


def test_near_leaves_are_enough_for_near_neighbours():
    """The second round visits few leaves where the first has found near ones."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((64, 48)) * 3
    v = np.repeat(centres, 64, 0) + 0.1 * rng.standard_normal((64 * 64, 48))
    p = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ N.projection(48, N.DIMS)
    leaf = N.Tree(p, 6).leaf(p)
    low, high = (np.array([f(p[leaf == x], axis=0) for x in np.unique(leaf)]) for f in (np.min, np.max))
    x = N.box_distances(p, low, high)
    assert (x[np.arange(len(p)), np.searchsorted(np.unique(leaf), leaf)] == 0).all()
    least = 0.99
    assert (x <= N.chi_square_at(N.CONFIDENCE, N.DIMS) * (2 - 2 * least)).mean() < 0.25


def test_ties_of_a_common_vector(spark):
    rows = [(i, [1, 2, 3, 4]) if i % 3 else (i, [i, 1, 0, 2]) for i in range(300)]
    assert got(N.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, block=64, leaf=32)) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1, 0]), (1, None), (2, [0, 0]), (3, [None, 1]), (4, [float("nan"), 1]), (5, [float("inf"), 1]), (6, [1, 1]), (None, [1, 0]), (50, []), (7, [1, 0, 0]), (100, [2, 2]), (100, [2, 2])]
    assert got(N.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0)) == {0: [6, 100], 100: [6, 0]}
    assert N.nearest(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_chi_square():
    assert N.chi_square(N.chi_square_at(0.99, 8), 8) == pytest.approx(0.99)
    assert N.chi_square_at(0.99, 8) == pytest.approx(20.09, abs=0.01)


def test_an_id_of_several_vectors_takes_one_place(spark):
    rows = [(0, [1, 0, 0]), *((1, [1, 0.001 * j, 0]) for j in range(1, 7)), *((i, [1, 0.1 * i, 0]) for i in range(2, 9))]
    assert got(N.nearest(frame(spark, rows), F.col("vec_id") == 0)) == {0: [1, 2, 3, 4, 5]}
