"""Connected components by alternating large and small stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """The new edges and what they read. Links each node's neighbours (large: the greater ones, else itself and the smaller ones) to the least of all."""
    if large:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stored(around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")))
    linked = around.join(least, F.col("u") == F.col("_u"))
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct(), least


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of edges (u, v: any ordered type)."""
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    said = None
    while True:
        old, (wide, one) = edges, _star(edges, True)
        narrow, two = _star(wide, False)
        edges = stored(narrow)
        release(old, one, two)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == said:
            break
        said = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
