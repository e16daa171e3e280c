"""Stage boundaries: spreading narrow inputs and cutting long plans at a written table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


_WRITTEN: list[str] = []


ROWS_PER_TASK = 10_000


def spread(df: DataFrame) -> DataFrame:
    """Deal a table's rows out evenly where its splits do not: fewer splits than cores, or a split that holds many rows.

    Splits are cut by bytes, but a Parquet row group lies in one of them however large it is, so the number of splits says little. The rows of
    each split are counted from the files' footers; no column is read for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = df.groupBy(F.spark_partition_id().alias("split")).count()
    rows, largest = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    if df.rdd.getNumPartitions() >= cores and largest <= 2 * ROWS_PER_TASK:
        return df
    return df.repartition(max(cores, -(-rows // ROWS_PER_TASK)))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.  Only a local master without one gets a temporary folder: executors elsewhere would not see it."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="faultline-")
        sc.setCheckpointDir(path)
    return path


def drop_stages(spark: SparkSession) -> int:
    """Delete the stage tables that this process wrote; returns their number.  Call it when their results are stored."""
    n = len(_WRITTEN)
    jvm = spark.sparkContext._jvm
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def fresh(spark: SparkSession) -> str:
    """A new path in the shared folder, which ``drop_stages`` deletes too."""
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write a stage and read it back: later stages prune columns, push filters, see sizes, and a
    lost executor re-reads the table instead of recomputing the stage."""
    path = fresh(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
