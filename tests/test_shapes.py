import json
import sqlite3

import numpy as np
import pytest

import terrakiln
from terrakiln.operators import crop as C
from terrakiln.plans import views as V
from terrakiln.recon import build as B
from terrakiln.recon import planes as P
from terrakiln.recon import shapes as H
from terrakiln.sources import gpkg
from terrakiln.streaming import tiles

SQUARE = np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float)
DATA = "/root/testdata/sf0.001"


def test_simplified_rings():
    noisy = np.array([(0, 0), (5, 0.005), (10, 0), (10, 10), (5, 9.995), (0, 10), (0.004, 5)], float)
    assert {tuple(p) for p in H.simplify(noisy)} == {tuple(p) for p in SQUARE}
    assert len(H.simplify(np.array([(0, 0), (5, 0.5), (10, 0), (10, 10), (0, 10)], float))) == 5
    flat = np.array([(0, 0), (1, 0), (2, 0), (3, 0)], float)
    assert len(H.simplify(flat)) == 4


def test_empty_circle_against_a_fine_grid():
    r = np.random.default_rng(1)
    for rings in ([SQUARE], [SQUARE, np.array([(3, 3), (3, 7), (7, 7), (7, 3)], float)]):
        points = r.uniform(0, 10, (60, 2))
        _, radius = H.empty_circle(points, rings)
        g = np.stack(np.meshgrid(np.arange(0.01, 10, 0.02), np.arange(0.01, 10, 0.02)), -1).reshape(-1, 2)
        g = g[B.A.inside(rings, *g.T)]
        sites = np.concatenate([points, H.densified(rings, 0.5)])
        best = H._reach(g, sites).max()
        assert best - 0.002 <= radius <= best + 0.02
    assert H.empty_circle(np.zeros((0, 2)), [SQUARE])[1] == pytest.approx(5, abs=0.02)
    assert H.empty_circle(np.zeros((0, 2)), [SQUARE[:2]]) is None


def test_terrain_heights():
    t = np.array([[(0, 0, 0), (10, 0, 10), (0, 10, 20)], [(10, 0, 10), (10, 10, 30), (0, 10, 20)]], float)
    ground = H.Terrain(t)
    assert ground.at(5, 0) == pytest.approx(5) and ground.at(5, 5) == pytest.approx(15) and ground.at(11, 0) is None
    assert ground.percentile(0.5) == 10 and H.Terrain(constant=3.0).at(99, 99) == 3.0


def gable():
    r = np.random.default_rng(1)
    xy = r.uniform(0, 10, (1500, 2))
    return np.column_stack([xy, 6 - 0.6 * np.abs(xy[:, 0] - 5)])


def test_height_field_faces_and_distances():
    mesh = terrakiln.reconstruct(gable(), [SQUARE], 0)[1]["2.2"]
    field, low, cell = H.height_field(mesh, 0.5)
    assert field.shape == (20, 20) and np.isfinite(field).all()
    assert np.nanmean(field) == pytest.approx(4.5, abs=0.05)
    assert H.height_field(mesh, 0.5, most=100)[2] == 1.0
    faces = H.face_heights(mesh, 0.1)
    assert len(faces) == 2 and all(f["h_min"] == pytest.approx(3, abs=0.2) and f["h_50p"] == pytest.approx(4.5, abs=0.1) and f["h_max"] == pytest.approx(6, abs=0.1) for f in faces)
    off, face = H.to_roof(gable(), mesh)
    assert np.sqrt((off**2).mean()) < 0.05 and set(face) == {0, 1}
    far, _ = H.to_roof(np.array([(5.0, 5.0, 16.0), (-3.0, 5.0, 3.0)]), mesh)
    assert far == pytest.approx([10, 3], abs=0.1)
    assert (H.to_points(mesh, gable()) < 0.6).all() and len(H.to_points(mesh, gable()[:0])) == 0
    assert np.isnan(H.to_roof(gable()[:2], B.Mesh())[0]).all()
    assert len(terrakiln.triangulate_mesh(mesh)) > 10


def test_other_detectors():
    found = P.ransac(gable())
    assert len(found.planes) == 2 and found.roof_type == "slanted"
    mesh = terrakiln.reconstruct(gable(), [SQUARE], 0, terrakiln.BuildParameters(detector="ransac"))[1]["2.2"]
    assert mesh.volume() == pytest.approx(450, rel=0.02)
    assert P.ransac(gable()[:5]).roof_type == "no points"
    r = np.random.default_rng(2)
    xy = r.uniform(0, 10, (2000, 2))
    z = np.where(xy[:, 0] < 5, 4 + 0.01 * xy[:, 1], np.where(xy[:, 1] < 5, 4.05, 8.0))
    points = np.column_stack([xy, z])
    label = np.where(xy[:, 0] < 5, 1, np.where(xy[:, 1] < 5, 2, 3))
    apart = P.Planes(label, {k: P.fit(points[label == k]) for k in (1, 2, 3)}, {1, 2, 3}, True)
    one = P.regularise(apart, points)
    assert len(one.planes) == 2 and (one.label[label == 1] == one.label[label == 2][0]).all()
    assert one.planes[1][:3] == pytest.approx(one.planes[2][:3])


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    hole = [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0)]
    outer = [tuple(p) for p in SQUARE.tolist()]
    assert gpkg.write_file(path, "homes", [([outer[::-1], hole], {"id": "x", "n": 1}), ([[(*p, 5.0) for p in outer]], {"id": None, "n": 2})], srs=7415) == 2
    assert gpkg.write_file(path, "homes", [([outer], {"id": "z", "n": 3})], srs=7415, append=True) == 1
    gpkg.write_file(path, "other", [([outer], {"k": 1.5})])
    rows = gpkg.read_gpkg(spark, [path], "homes").orderBy("feature").collect()
    assert [json.loads(r.properties)["id"] for r in rows] == ["x", None, "z"]
    assert [(p.x, p.y) for p in rows[0].ring] == outer[::-1][::-1] or gpkg._area2([(p.x, p.y) for p in rows[0].ring]) == 200
    assert gpkg._area2([(p.x, p.y) for p in rows[0].holes[0]]) == -8 and len(rows[1].ring) == 4
    assert gpkg.read_gpkg(spark, [path], 0, "n >= 2").count() == 2 and gpkg.read_gpkg(spark, [path], 1).count() == 1
    assert gpkg.layers(path) == [("homes", "geom", 7415), ("other", "geom", 0)]
    for bad in ("none", 2):
        with pytest.raises(ValueError, match="no layer"):
            list(gpkg.read_file(path, bad))
    with sqlite3.connect(path) as c:
        c.execute("INSERT INTO homes (geom) VALUES (NULL)")
    assert len(list(gpkg.read_file(path))) == 3
    multi = b"GP\0\1" + b"\0" * 4 + b"\1" + (6).to_bytes(4, "little") + (2).to_bytes(4, "little") + 2 * gpkg.geometry([outer], 0)[8:]
    assert len(gpkg.polygons(multi)) == 2
    with pytest.raises(ValueError, match="not a polygon"):
        gpkg.polygons(b"GP\0\1" + b"\0" * 4 + b"\1" + (1).to_bytes(4, "little") + b"\0" * 20)


def test_points_that_arrive(spark, tmp_path):
    own = V.points(spark, DATA).select("pc", "x", "y", "z", "cls", "yr")
    foot = V.footprint(spark, DATA)
    for part in range(3):
        own.where(f"x % 3 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        tiles.count_arrivals(spark, str(tmp_path / "in"), foot, str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination(120)
    tiles.count_arrivals(spark, str(tmp_path / "in"), foot, str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination(120)
    rows = lambda df: sorted(map(str, (r.asDict() for r in df.collect())))
    assert rows(tiles.counts(spark, str(tmp_path / "out"))) == rows(C.crop_counts(C.crop(own, foot)))
