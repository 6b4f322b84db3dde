"""Tables kept in the folder that driver and executors share, so that a query computes a common part once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset the warehouse, or for a master in this process (tests) a temporary folder."""
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


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and read back from Parquet: lost executors cost no recomputation, later reads prune columns. The
    files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
