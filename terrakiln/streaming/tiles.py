"""Points that arrive file by file: each micro-batch is cropped and counted, and its counts are merged into a table.

The reference's queues of tiles are batches here: a file is read once, by the stream's checkpoint; a batch that is run
again after a failure replaces its own part, so counts don't double. Defined cases: an empty batch writes nothing; a
building or class without points has no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import crop as C

POINTS = "pc string, x long, y long, z long, cls int, yr int"


def count_arrivals(spark: SparkSession, arrivals: str, footprints: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream over Parquet files of points in `arrivals`, all that are there, into parts of `out`."""

    def merge(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        C.crop_counts(C.crop(batch, footprints)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(POINTS).parquet(arrivals)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(spark: SparkSession, out: str) -> DataFrame:
    """The counts of all batches so far, as crop_counts() of all points."""
    parts = spark.read.parquet(out)
    return parts.groupBy("fid", "pc", "cls").agg(
        F.sum("n").alias("n"), F.sum("n_inside").alias("n_inside"), F.min("z_min").alias("z_min"), F.max("z_max").alias("z_max"), F.max("acquired").alias("acquired"),
    )
