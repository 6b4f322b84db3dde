"""Solids of known roofs, and the parts they are made by."""

import itertools

import numpy as np
import pytest

from terrakiln.recon import arrangement as A
from terrakiln.recon import build as B

SQUARE = np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float)
COURT = np.array([(3, 3), (3, 7), (7, 7), (7, 3)], float)


def cloud(f, rings=(SQUARE,), n=1500, seed=1):
    r = np.random.default_rng(seed)
    xy = r.uniform(0, 10, (n, 2))
    xy = xy[A.inside(list(rings), *xy.T)]
    return np.column_stack([xy, f(*xy.T)])


GABLE = lambda x, y: 6 - 0.6 * np.abs(x - 5)


@pytest.mark.parametrize(("f", "rings", "floor", "volumes", "roof"), [
    (lambda x, y: 5 + 0 * x, [SQUARE], 0, {"1.1": 500, "1.2": 500, "1.3": 500, "2.2": 500}, "horizontal"),
    (lambda x, y: 5 + 0 * x, [SQUARE, COURT], 0, {"1.1": 420, "2.2": 420}, "horizontal"),
    (GABLE, [SQUARE], 0, {"2.2": 450}, "slanted"),
    (lambda x, y: np.where(x < 5, 4.0, 8.0), [SQUARE], 0, {"1.3": 600, "2.2": 600, "1.2": 800}, "multiple horizontal"),
    (lambda x, y: np.where(x < 5, 4.0, 6.0), [SQUARE], 0, {"1.3": 600, "2.2": 500}, "multiple horizontal"),
])
def test_known_solids(f, rings, floor, volumes, roof):
    status, meshes, found = B.reconstruct(cloud(f, rings) + [150_000, 450_000, 0], [r + [150_000, 450_000] for r in rings], floor)
    assert (status, found.roof_type) == ("ok", roof)
    assert {k: meshes[k].volume() for k in volumes} == pytest.approx(volumes, rel=0.02)
    assert all(m.bad_edges() == 0 for m in meshes.values())
    assert B.rmse(meshes["2.2"], cloud(f, rings, seed=2) + [150_000, 450_000, 0]) < 0.35


def test_gable_faces():
    _, meshes, _ = B.reconstruct(cloud(GABLE), [SQUARE], 0)
    m = meshes["2.2"]
    assert (m.count(B.ROOF), m.count(B.OUTER), m.count(B.INNER)) == (2, 6, 0)
    ridge = [p for k, rings in m.faces if k == B.ROOF for p in rings[0] if abs(p[0] - 5) < 0.2]
    assert len(ridge) == 4 and all(abs(p[2] - 6) < 0.1 for p in ridge)
    two = B.reconstruct(cloud(lambda x, y: np.where(x < 5, 4.0, 8.0)), [SQUARE], 0)[1]["2.2"]
    assert (two.count(B.ROOF), two.count(B.INNER)) == (2, 1)


def test_crossing_roofs_are_closed():
    """A shed roof beside a flat one that it crosses."""
    _, meshes, _ = B.reconstruct(cloud(lambda x, y: np.where(x < 5, 5.0, 2 + 0.6 * y), n=4000), [SQUARE], 0)
    m = meshes["2.2"]
    assert m.bad_edges() == 0
    assert m.volume() == pytest.approx(250 + 250, rel=0.03)
    assert m.count(B.INNER) == 2


def test_odd_input():
    assert B.reconstruct(np.zeros((0, 3)), [SQUARE], 0)[0] == "no points"
    assert B.reconstruct(cloud(GABLE), [np.array([(0, 0), (1, 1), (2, 2)], float)], 0)[0] == "no area"
    status, meshes, _ = B.reconstruct(cloud(GABLE)[:14], [SQUARE], 0)
    assert status == "no points" and set(meshes) == set(B.LODS) and meshes["2.2"].bad_edges() == 0
    assert B.reconstruct(cloud(GABLE), [SQUARE], 0, block=True)[0] == "block"
    noise = np.random.default_rng(3).uniform(0, 10, (200, 3))
    assert all(m.bad_edges() == 0 for m in B.reconstruct(noise, [SQUARE], 0)[1].values())
    doubled = np.repeat(cloud(GABLE, n=400), 2, 0)
    assert B.reconstruct(doubled[::-1], [SQUARE], 0)[1]["2.2"].volume() == B.reconstruct(doubled, [SQUARE], 0)[1]["2.2"].volume()


def test_labels_have_least_energy():
    r = np.random.default_rng(4)
    for _ in range(30):
        n, k = 5, 2
        cost = r.uniform(0, 3, (n, k))
        pairs = {(i, j): float(r.uniform(0, 2)) for i, j in itertools.combinations(range(n), 2) if r.random() < 0.6}
        best = min(A.energy(cost, pairs, np.array(x)) for x in itertools.product(range(k), repeat=n))
        assert A.energy(cost, pairs, A.expand(cost, pairs)) == pytest.approx(best)


def test_partition_covers_the_footprint():
    ell = np.array([(0, 0), (10, 0), (10, 5), (5, 5), (5, 10), (0, 10)], float)
    parts = A.Partition([ell])
    for line in (A.line_through(np.array([0, 3.0]), np.array([10, 4.0])), A.line_through(np.array([2.0, 0]), np.array([3.0, 10]))):
        parts.cut(line)
    assert parts.areas().sum() == pytest.approx(75)
    whole = A.trace(parts, np.zeros(len(parts.cells), np.int64))
    assert len(whole) == 1 and len(whole[0]) == 1
    assert np.allclose(sorted(parts.at[v] for v in whole[0][0]), sorted(map(tuple, ell)))
    xy = np.random.default_rng(5).uniform(0, 10, (500, 2))
    assert ((parts.locate(xy) >= 0) == A.inside([ell], *xy.T)).all()


def test_triangles_fill_a_face_with_a_hole():
    mesh = B.reconstruct(cloud(lambda x, y: 5 + 0 * x, [SQUARE, COURT]), [SQUARE, COURT], 0)[1]["1.1"]
    flat = [t for k, rings in mesh.faces if k == B.ROOF for t in B.triangulate(rings)]
    area = sum(np.linalg.norm(np.cross(t[1] - t[0], t[2] - t[0])) / 2 for t in flat)
    assert area == pytest.approx(84)
    every = B.triangulate_mesh(mesh)
    centre = every.reshape(-1, 3).mean(0)
    volume = sum(float((t[0] - centre) @ np.cross(t[1] - centre, t[2] - centre)) for t in every) / 6
    assert volume == pytest.approx(mesh.volume())
