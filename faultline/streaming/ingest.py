"""Incremental ingestion: commit and log streams through the same operators as batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import commits as co, index as ix
from ..plans import retrieval as rt
from ..sources import commits as sc


def stream_commits(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def analyze_stream(commits: DataFrame) -> DataFrame:
    """Row-local analysis, so the stream needs no state."""
    return commits.transform(co.analyze_commits).transform(co.annotate_version)


def diagnose_stream(logs: DataFrame) -> DataFrame:
    return rt.diagnose(logs)


def index_stream(commits: DataFrame, index_path: str, checkpoint: str, dim: int = 512):
    """Append each micro-batch to the index; returns the started query.

    A batch that is retried after a failure adds nothing twice: rows that the index has by hash, or by id where the hash
    is empty, are anti-joined away, and the checkpoint resumes where the last batch ended.
    """
    def write(batch: DataFrame, _: int) -> None:
        ix.append_index(ix.index_rows(batch, dim), index_path)
    return (commits.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def index_dumps(spark: SparkSession, dumps: str, index_path: str, checkpoint: str, dim: int = 512, since: str | None = None, hold_last: bool = True):
    """What has been added to a folder of growing dumps since the checkpoint goes into the index; returns the started query.

    The first run of an index that was loaded otherwise starts at the day before its newest commit (``since="resume"``).
    """
    if since == "resume":
        since = ix.resume_since(spark, index_path) if ix.exists_index(spark, index_path) else None
    return index_stream(sc.stream_git_log(spark, dumps, since=since, hold_last=hold_last), index_path, checkpoint, dim)
