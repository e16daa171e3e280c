"""The commit index: build, append, persist, version back-fill, task rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.stage import cut
from ..sources import committed
from . import commits as co, vectors as ve

_C = F.col
TASK_TTL_SECONDS = 86_400

INDEX_COLUMNS = ["id", "commit_hash", "subject", "body", "subsystem", "bug_type", "author", "date", "committer_date",
                 "files_changed", "file_changes", "functions", "fix_tags", "score", "lock_added", "refcount_fix",
                 "rcu_fix", "insertions", "deletions", "kernel_version", "kernel_version_major",
                 "kernel_version_minor", "embedding_text", "vec"]


def index_rows(commits: DataFrame, dim: int = 512, encoder=None) -> DataFrame:
    """Raw commits to index rows: analysed, root-caused, version-annotated and encoded; no shuffle."""
    df = (commits.transform(co.analyze_commits).transform(co.annotate_version).transform(co.build_root_cause)
          .transform(co.embedding_text).withColumn("id", _C("pos")))
    df = ve.encode_text(df, "embedding_text", "vec", dim, encoder)
    # missing labels are settled at write time so that scans can push plain comparisons down
    return df.withColumns({c: F.coalesce(_C(c), F.lit("unknown")) for c in ("subsystem", "bug_type")}).select(*INDEX_COLUMNS)


def store_row(df: DataFrame, widths: dict[str, int] | None = None) -> DataFrame:
    """Row of a vector collection: plain strings, joined lists.  ``widths``: characters that a store's column holds."""
    def fitted(c: str, text: Column) -> Column:
        n = (widths or {}).get(c)
        return (text if n is None else F.substring(text, 1, n)).alias(c)
    return df.select(*[fitted(c, F.coalesce(_C(c).cast("string"), F.lit(""))) for c in ("commit_hash", "subject", "subsystem", "bug_type", "author", "date")],
                     *[fitted(c, F.array_join(c, ", ")) for c in ("files_changed", "fix_tags")],
                     F.coalesce(_C("score"), F.lit(0.0)).cast("float").alias("score"))


def write_index(df: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = 1_000_000) -> None:
    """Parquet by subsystem.  Each subsystem is spread over as many tasks and files as its counted rows need."""
    counts = {r.subsystem: r["count"] for r in df.groupBy("subsystem").count().collect()}  # one row per subsystem
    files = F.lit(1)
    for name, n in counts.items():
        if n > rows_per_file:
            files = F.when(_C("subsystem") == name, F.lit(-(-n // rows_per_file))).otherwise(files)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64("commit_hash", "id"), files))
    (salted.repartition("subsystem", "_salt").drop("_salt").write.mode(mode)
     .option("maxRecordsPerFile", rows_per_file).partitionBy("subsystem").parquet(path))


BUCKETS = 64


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An index that was appended to (its committed rows), or one that was written as a whole."""
    return committed.read(spark, path) if committed.exists(path) else spark.read.parquet(path)


def exists_index(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def drop_index(spark: SparkSession, path: str) -> bool:
    """Delete an index; False where there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_rows(rows: DataFrame, index: DataFrame, key: str = "commit_hash", row_id: str | None = None) -> DataFrame:
    """Rows whose key is not in the index yet (anti join).

    Rows with an empty key have no name: they always count as new, or with ``row_id`` unless the index has an empty-key row
    of that id.  With ``row_id`` a key that is repeated in ``rows`` also goes in once, with its smallest id.
    """
    if row_id is None:
        return rows.join(index.where(_C(key) != "").select(key).distinct(), key, "left_anti")
    named = F.coalesce(_C(key), F.lit("")) != ""
    known = index.select(F.coalesce(_C(key), F.lit("")).alias("_k"), F.when(~named, _C(row_id)).alias("_i")).distinct()
    first = rows.where(named).groupBy(_C(key).alias("_k")).agg(F.min(row_id).alias("_i"))
    keyed = rows.withColumns({"_key": F.coalesce(_C(key), F.lit("")), "_row": _C(row_id)})
    once = keyed.join(first, (_C("_key") == _C("_k")) & (_C("_row") == _C("_i")), "left_semi")
    nameless = keyed.where("_key = ''").dropDuplicates(["_row"])
    kept = once.unionByName(nameless)
    mark = F.when(_C("_key") == "", _C("_row"))
    return kept.join(known, (_C("_key") == _C("_k")) & mark.eqNullSafe(_C("_i")), "left_anti").drop("_key", "_row")


def append_index(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Incremental append of not yet indexed commits; an index that does not exist is made.  Appending again adds nothing.

    Rows lie in buckets by the hash of their commit hash (of their id, where that is empty). An append reads the keys of those files only whose Bloom
    filter may hold one of its rows, and commits its files as a whole: a failed append leaves the index as it was.
    """
    spark = rows.sparkSession
    named = F.coalesce(_C("commit_hash"), F.lit("")) != ""
    rows = cut(rows.withColumn("_by", F.when(named, F.concat(F.lit("h"), "commit_hash")).otherwise(F.concat(F.lit("i"), _C("id").cast("string")))))
    files = committed.files_that_may_hold(rows, path, "_by", buckets) if committed.exists(path) else []
    known = committed.read(spark, path, rows.drop("_by").schema, files).select("commit_hash", "id")
    new = cut(new_rows(rows, known, row_id="id"))
    committed.append(new.select(*rows.columns), path, "_by", buckets, ["subsystem"], keep_key=False)


def resume_since(spark: SparkSession, path: str) -> str | None:
    """Day before the newest indexed date: where a resumed load starts reading again."""
    top = read_index(spark, path).where(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}")).agg(
        F.date_sub(F.max(F.substring("date", 1, 10)).cast("date"), 1).cast("string")).first()[0]
    return top


def index_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count("vec").alias("vectors"),
                  F.count_distinct("commit_hash").alias("hashes"), F.min("date").alias("first_date"),
                  F.max("date").alias("last_date"))


def progress(done, total, elapsed):
    """(percent, seconds left) of a load, as columns."""
    pct = F.when(total > 0, F.round(done / total * 100, 2)).otherwise(F.lit(0.0))
    return pct, F.when(done > 0, F.round(elapsed / done * (total - done), 2))


# --- task rows ----------------------------------------------------------------------------------

def latest_tasks(updates: DataFrame, now, ttl: int = TASK_TTL_SECONDS) -> DataFrame:
    """Current task rows from an update log (task_id, ts, status, deleted): latest wins, expired and
    deleted tasks are gone.  ``max_by`` aggregates map-side, so a chatty task is not one big group."""
    last = updates.groupBy("task_id").agg(
        F.max_by(F.struct("ts", "status", "deleted"), F.struct("ts", "seq")).alias("l"), F.min("ts").alias("created"))
    alive = (F.unix_timestamp(now) - F.unix_timestamp(_C("l.ts"))) < ttl
    return last.where(~_C("l.deleted") & alive).select("task_id", "created", _C("l.ts").alias("updated"), "l.status")
