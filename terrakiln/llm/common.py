"""What the corpus operators share: table access, lineage cuts, size-checked broadcasts, memory given back."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but ASCII white space (Java and RE2 syntax).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset the warehouse, or for a master
    in this process (tests) a temporary folder."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            alone = sc.master.split("[")[0] == "local"
            named = tempfile.mkdtemp(prefix="terrakiln-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/_terrakiln"
        sc.setCheckpointDir(named)
        found = sc.getCheckpointDir()
    return found


def _path(spark: SparkSession, path: str):
    """The path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame) -> DataFrame:
    """Computes df once and keeps it as a Parquet table in the shared folder: it cuts the lineage, a lost executor costs no
    recomputation, and later reads prune columns. The table goes with release(), or when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terrakiln-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, files = _path(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._held = (path, None)
    return out


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """As stored(), dealt by key into as many buckets as there are shuffle partitions: grouping by key moves nothing."""
    spark = df.sparkSession
    name = f"terrakiln_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(parts(spark), key).option("path", path).format("parquet").saveAsTable(name)
    at, files = _path(spark, path)
    files.deleteOnExit(at)
    out = spark.table(name)
    out._held = (path, name)
    return out


def release(*frames: DataFrame) -> None:
    """Deletes what stored() or bucketed() kept for frames of which nothing will be read again."""
    for df in frames:
        path, name = getattr(df, "_held", (None, None))
        if name:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path:
            at, files = _path(df.sparkSession, path)
            files.delete(at, True)


def sweep(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM collects the handles of their stages, which a driver with little to do would
    not do for long. Python's own handles are let go by a thread that looks for them about once a second."""
    gc.collect()
    time.sleep(1.5)
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Python workers are used again by later tasks: what this one freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f (batches to batches), giving memory back at the end of its task."""

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def small(df: DataFrame, rows: int) -> DataFrame:
    """df (already stored) with a broadcast hint if it has at most `rows` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
