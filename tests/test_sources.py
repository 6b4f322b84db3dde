import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrakiln.operators import models as M
from terrakiln.sinks import city
from terrakiln.sources import las, polygons


def test_las_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    xyz = np.round(rng.uniform(0, 100, (500, 3)), 2)
    cls = rng.choice([2, 6], 500)
    (tmp_path / "a.las").write_bytes(las.write_las(xyz, cls, wkt='PROJCS["x"]'))
    (tmp_path / "b.LAS").write_bytes(las.write_las(xyz[:0], cls[:0]))
    heads = {r.path.rsplit("/", 1)[1]: r for r in las.read_headers(spark, str(tmp_path)).collect()}
    assert heads["a.las"].n_points == 500 and heads["a.las"].crs == 'PROJCS["x"]' and heads["b.LAS"].crs is None
    assert heads["a.las"].max_z == pytest.approx(xyz[:, 2].max())
    rows = las.read_las(spark, str(tmp_path)).collect()
    assert sorted((round(r.x, 2), round(r.y, 2), round(r.z, 2), r.cls) for r in rows) == sorted((*map(float, p), int(c)) for p, c in zip(xyz, cls, strict=True))


def test_las_area_parts_and_bad_files(spark, tmp_path):
    grid = np.array([(x, y, 1.0) for x in range(10) for y in range(10)], float)
    (tmp_path / "near.las").write_bytes(las.write_las(grid, np.full(100, 6)))
    (tmp_path / "far.las").write_bytes(las.write_las(grid + [1000, 0, 0], np.full(100, 6)))
    found = las.read_las(spark, str(tmp_path), (2, 2, 5, 4), split=7).collect()
    assert sorted((r.x, r.y) for r in found) == [(x, y) for x in (2, 3, 4) for y in (2, 3)]
    assert {r.path.rsplit("/", 1)[1] for r in found} == {"near.las"}
    assert las.read_las(spark, str(tmp_path), split=7).count() == 200
    (tmp_path / "bad.las").write_bytes(b"no points")
    with pytest.raises(Exception, match="not a LAS file"):
        las.read_headers(spark, str(tmp_path)).collect()
    assert las.read_las(spark, str(tmp_path), skip=True).count() == 200


def test_las_reference_system_behind_the_points(tmp_path):
    import struct

    raw = bytearray(las.write_las(np.zeros((3, 3)), np.zeros(3, np.int64)))
    head = bytearray(375)
    head[:227] = raw[:227]
    head[25] = 4
    struct.pack_into("<HI", head, 94, 375, 375)
    body = raw[227:]
    struct.pack_into("<QI", head, 235, 375 + len(body), 2)
    record = lambda n, b: struct.pack("<H16sHQ32s", 0, b"x", n, len(b), b"") + b
    (tmp_path / "a.las").write_bytes(bytes(head) + body + record(7, b"other") + record(las.WKT_RECORD, b"WKT here\0\0"))
    with las._open(f"file:{tmp_path}/a.las") as f:
        assert las._header(f)["crs"] == "WKT here"


def test_geojson(spark, tmp_path):
    square = [[0, 0], [0, 10], [10, 10], [10, 0], [0, 0]]
    hole = [[2, 2], [4, 2], [4, 4], [2, 4], [2, 2]]
    bow = [[0, 0], [10, 10], [10, 0], [0, 10], [0, 0]]
    feature = lambda i, kind, c: {"type": "Feature", "properties": {"id": i}, "geometry": {"type": kind, "coordinates": c}}
    layer = {"type": "FeatureCollection", "features": [feature("ok", "Polygon", [square, hole]), feature("bad", "Polygon", [bow]), feature("two", "MultiPolygon", [[square], [square]])]}
    (tmp_path / "l.geojson").write_text(json.dumps(layer))
    rows = polygons.read_geojson(spark, str(tmp_path)).orderBy("feature", "part").collect()
    assert [json.loads(r.properties)["id"] for r in rows] == ["ok", "bad", "two", "two"]
    assert [r.valid for r in rows] == [True, False, True, True]
    assert len(rows[0].ring) == 4 and len(rows[0].holes) == 1
    turned = spark.createDataFrame([(rows[0].ring, rows[0].holes[0])], "r array<struct<x: double, y: double>>, h array<struct<x: double, y: double>>")
    assert tuple(turned.select(polygons.area2(F.col("r")), polygons.area2(F.col("h"))).first()) == (200, -8)


def test_city_holes_attributes_and_labels(spark):
    rings = [[(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (7, 3), (7, 7), (3, 7)]]
    base = spark.createDataFrame([(7, rings, 0, 5)], "fid long, rings array<array<struct<x: long, y: long>>>, base long, top long")
    line = json.loads(city.features(M.prism(base).withColumn("attributes", F.lit('{"a":null,"b":2}'))).first().value)
    shell = line["CityObjects"]["7-0"]["geometry"][0]["boundaries"][0]
    assert sorted(len(rings) for rings in shell) == [1] * 8 + [2, 2]
    assert line["CityObjects"]["7"]["attributes"] == {"fid": 7, "a": None, "b": 2}
    square = [(0.0, 0.0, 1.9), (1.0, 0.0, 1.9), (0.0, -1.9, 1.9)]
    told = json.loads(city.feature("x", {"2.2": [(1, [square]), (1, [square]), (3, [square])]}, roofs=[{"slope": 1}, {"slope": 2}]))
    solid = told["CityObjects"]["x-0"]["geometry"][0]
    assert solid["semantics"] == {"surfaces": [{"type": "RoofSurface", "slope": 1}, {"type": "RoofSurface", "slope": 2}, {"type": "InteriorWallSurface"}], "values": [[0, 1, 2]]}
    assert told["vertices"] == [[0, 0, 1], [1, 0, 1], [0, -1, 1]]
    with pytest.raises(ValueError, match="label"):
        city.feature("x", {"1.2": [(9, [square])]})
    assert city.features(M.prism(base).limit(0)).count() == 0


def test_terrain_relief():
    tri = lambda *p: [(*q, 0.0) for q in p]
    three = np.array([tri((0, 0), (1, 0), (0, 1)), tri((1, 0), (1, 1), (0, 1)), tri((1, 1), (2, 1), (2, 2))])
    assert city.components(three).tolist() == [0, 0, 1]
    line = json.loads(city.terrain_feature("t", three))
    assert [len(s["boundaries"]) for s in line["CityObjects"]["t"]["geometry"]] == [2, 1] and len(line["vertices"]) == 6
    assert json.loads(city.terrain_feature("t", three[:0]))["vertices"] == []


def test_city_lines(spark, tmp_path):
    ring = [(0, 0), (10, 0), (10, 10), (0, 10)]
    base = spark.createDataFrame([(7, ring, 0, 5)], "fid long, ring array<struct<x: long, y: long>>, base long, top long")
    lines = city.features(M.prism(base), scale=0.01)
    line = json.loads(lines.first().value)
    solid = line["CityObjects"]["7-0"]["geometry"][0]
    assert len(line["vertices"]) == 8 and max(map(max, line["vertices"])) == 1000
    assert [solid["semantics"]["surfaces"][v]["type"] for v in solid["semantics"]["values"][0]] == ["GroundSurface", "RoofSurface"] + ["WallSurface"] * 4
    assert line["CityObjects"]["7"]["geometry"][0]["lod"] == "0" and line["CityObjects"]["7"]["attributes"] == {"fid": 7}
    placed = lines.withColumn("tile_x", F.lit(0)).withColumn("tile_y", F.lit(1))
    city.write(placed, str(tmp_path / "out"), city.metadata_line((0, 0, 0)))
    kept = [json.loads(r.value)["type"] for r in spark.read.text(str(tmp_path / "out" / "tile_x=0" / "tile_y=1")).collect()]
    assert kept == ["CityJSON", "CityJSONFeature"]
    city.write_names(placed, str(tmp_path / "names"))
    assert [r.value for r in spark.read.text(str(tmp_path / "names")).collect()] == ["7"]
    assert json.loads(city.metadata_line((0, 0, 0), extent=(0, 0, 0, 1, 1, 1)))["metadata"]["geographicalExtent"][3] == 1
    assert json.loads(city.metadata_line((0, 0, 0), day="2024-01-01"))["metadata"]["referenceDate"] == "2024-01-01"
