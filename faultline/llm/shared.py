"""Helpers of this subpackage: the shared folder, written stage tables, and hashing of columns."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where none is set, as in local tests, a temporary folder is made and set as the checkpoint folder; a cluster
    without the setting is refused, since its executors would not see the driver's folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="llm-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends at files that survive a lost executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 32 << 20


def hinted(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows fit into BROADCAST_BYTES; beyond that Spark joins by shuffling."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def file_system(uri: str):
    """(file system, path) of a URI for tasks; works for local folders and for any store that pyarrow knows."""
    from pyarrow import fs
    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def crc_of_id(column: str) -> Column:
    """crc32 of the id's decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


HOT_ROWS = 20_000


def spread_join(left: DataFrame, right: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left`` joined (left outer) with ``right`` on ``key``, of which ``right`` has each value once.

    Keys with more than ``hot_rows`` rows in ``left`` are few (one for each ``hot_rows`` rows of it at most): their rows are dealt to as many
    parts as they need, and their row of ``right`` is copied to each part. The rows are those of a plain join.
    """
    hot = cut(left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
              .select(F.col(key).alias("_hot"), F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts")), "hot")
    if hot.isEmpty():
        return left.join(right, key, "left")
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    known = hinted(hot, 16)
    dealt = left.join(known, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts).cast("int"))
    copied = right.join(known, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.drop("_hot", "_parts").join(copied.drop("_hot", "_parts"), [key, "_part"], "left").drop("_part")
