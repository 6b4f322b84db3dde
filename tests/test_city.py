"""The whole chain, from settings to features."""

import json

import numpy as np
import pytest

from terrakiln import config
from terrakiln.plans import city

SOURCES = "pc string, ord int, quality int, date int, date_only boolean"


def inputs(spark):
    r = np.random.default_rng(1)
    points, rings = [], []
    for fid, ox in ((1, 15_000_000), (2, 15_004_000)):
        ring = [(ox, 45_000_000), (ox + 1000, 45_000_000), (ox + 1000, 45_001_000), (ox, 45_001_000)]
        rings.append((fid, ring, None if fid == 1 else "second", json.dumps({"use": None, "n": fid})))
        for pc in "AB":
            for x, y in r.integers(0, 1000, (1800, 2)).tolist():
                z = 600 - abs(x - 500) * 6 // 10 if fid == 1 else 500
                points.append((pc, ox + x, 45_000_000 + y, z, 6, 2020))
            points += [(pc, ox - 200, 45_000_000 + int(y), 100, 2, 2020) for y in r.integers(0, 1000, 40)]
    rings.append((3, [(16_000_000, 45_000_000), (16_001_000, 45_000_000), (16_001_000, 45_001_000)], None, None))
    rings += [rings[0], (4, None, None, None)]
    foot = spark.createDataFrame(rings, "fid long, ring array<struct<x: long, y: long>>, name string, attributes string")
    return spark.createDataFrame(points, "pc string, x long, y long, z long, cls int, yr int"), foot


def test_features(spark):
    points, foot = inputs(spark)
    sources = spark.createDataFrame([("A", 0, 1, 20200101, False), ("B", 1, 2, 20190101, False)], SOURCES)
    s = config.load("unit-scale = 0.01\n[reconstruct]\nlod12 = true\n[crop]\nceil-point-density = 30.0\n[output]\ntiling = true\nscale = 0.001\n")
    made = {r.fid: (r, json.loads(r.value)) for r in city.features(points, foot, sources, s, (150_000.0, 450_000.0, 0.0)).collect()}
    assert set(made) == {1, 2, 3}
    assert (made[1][0].tile_x, made[1][0].tile_y) == (150, 450)
    gable, flat, bare = (made[k][1] for k in (1, 2, 3))
    told = gable["CityObjects"]["1"]["attributes"]
    assert told["tk_roof_type"] == "slanted" and told["tk_status"] == "ok" and told["tk_pc"] == "A" and told["tk_pc_reason"] == "PREFERRED_AND_LATEST"
    assert told["tk_volume_lod22"] == pytest.approx(350, rel=0.02) and told["tk_h_ground"] == 1.0 and told["use"] is None and told["n"] == 1
    assert flat["id"] == "second" and flat["CityObjects"]["second"]["attributes"]["tk_volume_lod12"] == pytest.approx(400, rel=0.01)
    assert [g["lod"] for g in gable["CityObjects"]["1-0"]["geometry"]] == ["1.2", "2.2"]
    assert bare["CityObjects"]["3-0"]["geometry"] == [] and bare["CityObjects"]["3"]["attributes"]["tk_mode"] == "SKIP"
    assert max(max(v) for v in gable["vertices"]) <= 10_000


def test_one_acquisition_and_empty_tables(spark):
    points, foot = inputs(spark)
    one = spark.createDataFrame([("A", 0, 1, 20200101, True)], SOURCES)
    s = config.load("unit-scale = 0.01\n[reconstruct]\nlod22 = false\nlod13 = true\n")
    lines = [json.loads(r.value) for r in city.features(points, foot.where("fid = 2"), one, s).collect()]
    assert [g["lod"] for g in lines[0]["CityObjects"]["second-0"]["geometry"]] == ["1.3"]
    assert city.features(points, foot.limit(0), one, s).count() == 0
