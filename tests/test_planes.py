import math

import numpy as np
import pytest

from terrakiln.recon import planes as P


def sheet(f, x0=0.0, x1=10.0, n=30, seed=0):
    xs, ys = np.meshgrid(np.linspace(x0, x1, n), np.linspace(0, 10, n))
    xy = np.stack([xs.ravel(), ys.ravel()], 1) + np.random.default_rng(seed).uniform(-0.05, 0.05, (n * n, 2))
    return np.concatenate([xy, f(xy[:, 0], xy[:, 1])[:, None]], 1)


GABLE = sheet(lambda x, y: 6 - np.abs(x - 5) * 0.6)


def test_nearest_is_brute_force():
    points = np.random.default_rng(3).uniform(0, 10, (300, 3)) * [1, 1, 0.3]
    d = ((points[:, None] - points[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert (P.nearest(points, 15) == np.argsort(d, 1, kind="stable")[:, :15]).all()
    assert P.nearest(points[:3], 15).shape == (3, 2)
    assert P.nearest(np.zeros((20, 3)), 4).shape == (20, 4)


def test_gable():
    found = P.detect(GABLE)
    assert found.roof_type == "slanted" and len(found.planes) == 2
    assert (found.label > 0).mean() > 0.95
    tilts = [math.degrees(math.acos(p[2])) for p in found.planes.values()]
    assert tilts == pytest.approx([math.degrees(math.atan(0.6))] * 2, abs=0.5)
    lines = P.intersections(GABLE, found, P.adjacency(found.label, P.nearest(GABLE, 15)))
    assert len(lines) == 1 and lines[0]["ridge"]
    for end in (lines[0]["start"], lines[0]["end"]):
        assert end[0] == pytest.approx(5, abs=0.1) and end[2] == pytest.approx(6, abs=0.1)


def test_flat_roofs_and_noise():
    assert P.detect(sheet(lambda x, y: 5 + 0 * x)).roof_type == "horizontal"
    two = np.concatenate([sheet(lambda x, y: 4 + 0 * x, 0, 5), sheet(lambda x, y: 8 + 0 * x, 5.3, 10)])
    found = P.detect(two)
    assert found.roof_type == "multiple horizontal" and sorted(round(-p[3]) for p in found.planes.values()) == [4, 8]
    assert P.detect(GABLE[:14]).roof_type == "no points"
    assert P.detect(np.random.default_rng(0).uniform(0, 40, (60, 3))).roof_type == "no planes"


def test_walls_are_dropped():
    ys, zs = np.meshgrid(np.linspace(0, 10, 25), np.linspace(0, 6, 25))
    wall = np.stack([0.001 * ys.ravel(), ys.ravel(), zs.ravel()], 1)
    assert P.detect(wall).roof_type == "no planes"


def test_same_for_any_order(spark):
    rows = [(1, "A", *map(float, p * 100)) for p in GABLE] + [(2, "A", 1.0, 2.0, 3.0)]
    frame = spark.createDataFrame(rows, "fid long, pc string, x double, y double, z double")
    got = {r.fid: r for r in P.roof_planes(frame).collect()}
    assert (got[1].roof_type, got[1].n_planes, got[1].n_ridges, got[2].roof_type) == ("slanted", 2, 1, "no points")
    again = {r.fid: r for r in P.roof_planes(frame.repartition(3)).collect()}
    assert got == again
