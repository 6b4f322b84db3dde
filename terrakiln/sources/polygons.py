"""Footprint layers: GeoJSON read by Spark, rings normalised, multi-part features split, invalid rings set apart.

Rings are opened (no closing vertex), outer rings counter-clockwise, holes clockwise. A ring is invalid if it has fewer
than three different corners, no area, or edges that cross.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G

_FEATURE = "struct<type: string, geometry: string, properties: string>"
_POLYGON, _MULTI = "struct<type: string, coordinates: array<array<array<double>>>>", "struct<type: string, coordinates: array<array<array<array<double>>>>>"


def crosses_itself(ring: Column) -> Column:
    """Whether two edges that aren't neighbours meet."""
    n = F.size(ring)
    at = lambda i: F.get(ring, i % n)
    turn = lambda a, b, c: F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))

    def meet(i: Column, j: Column) -> Column:
        a, b, c, d = at(i), at(i + 1), at(j), at(j + 1)
        apart = (j - i >= 2) & ~((i == 0) & (j == n - 1))
        return apart & (turn(a, b, c) * turn(a, b, d) <= 0) & (turn(c, d, a) * turn(c, d, b) <= 0)

    index = F.sequence(F.lit(0), n - 1)
    return F.exists(index, lambda i: F.exists(index, lambda j: meet(i, j)))


def area2(ring: Column) -> Column:
    return F.aggregate(G._edges(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)


def valid(ring: Column) -> Column:
    return (F.size(F.array_distinct(ring)) >= 3) & (area2(ring) != 0) & ~crosses_itself(ring)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """feature, part, properties (JSON), ring, holes, valid: a row per polygon of each file's features."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"struct<features: array<{_FEATURE}>>").alias("v"))
    features = whole.select("file", F.posexplode("v.features").alias("feature", "f"))
    kind = F.get_json_object("f.geometry", "$.type")
    parts = F.when(kind == "Polygon", F.array(F.from_json("f.geometry", _POLYGON)["coordinates"])).when(kind == "MultiPolygon", F.from_json("f.geometry", _MULTI)["coordinates"])
    checked = F.when(parts.isNull(), F.raise_error(F.concat(F.lit("not a polygon: "), F.coalesce(kind, F.lit("none"))))).otherwise(parts)
    polygons = features.select("file", "feature", F.col("f.properties").alias("properties"), F.posexplode(checked).alias("part", "p"))
    ring = lambda r: G.open_ring(F.transform(r, lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"))))
    rings = polygons.withColumn("r", F.transform("p", ring))
    turned = lambda r, sign: F.when(area2(r) * sign < 0, F.reverse(r)).otherwise(r)
    outer = F.get("r", F.lit(0))
    holes = F.transform(F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))), lambda h: turned(h, -1))
    return rings.select("file", "feature", "part", "properties", turned(outer, 1).alias("ring"), holes.alias("holes"), valid(outer).alias("valid"))
