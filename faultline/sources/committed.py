"""A table folder whose readers see whole appends only.

``data/`` holds parquet files by bucket, each with a Bloom filter of its keys beside it, and ``log/`` one small JSON file per append that names the
append's files. Tasks write files under new names; the append exists from the moment its log entry does, which the driver writes last and under its final
name by a rename. A failed task or driver leaves files that no entry names, and readers go on with the entries that are there. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .store import files_under, open_store

BITS_PER_KEY, HASHES = 12, 8
FILE_ROWS = 1_000_000


# --- Bloom filters ------------------------------------------------------------------------------

def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each 64-bit hash: two halves, combined."""
    h = hashes.astype(np.int64).view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (low[:, None] + np.arange(HASHES, dtype=np.uint64)[None] * high[:, None]) % np.uint64(bits)


def bloom_of(hashes: np.ndarray) -> bytes:
    bits = max(64, -(-len(hashes) * BITS_PER_KEY // 8) * 8)
    flags = np.zeros(bits, np.uint8)
    flags[_places(hashes, bits).ravel()] = 1
    return np.packbits(flags).tobytes()


def bloom_may_hold(bloom: bytes, hashes: np.ndarray) -> np.ndarray:
    flags = np.frombuffer(bloom, np.uint8)
    at = _places(hashes, 8 * len(flags))
    return ((flags[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).all(1)


# --- writing ------------------------------------------------------------------------------------

@dataclass
class _Written(WriterCommitMessage):
    files: list


class CommittedWriter(DataSourceArrowWriter):
    """Rows with ``_bucket`` int and ``_hash`` bigint, which are not stored; rows of a bucket should stand together."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.append = path, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        import pyarrow.parquet as pq
        store, path = open_store(self.path)
        done, open_ = [], None

        def close() -> None:
            writer, name, bucket, hashes, _ = open_
            writer.close()
            with store.open_output_stream(f"{path}/data/{name}.bloom") as f:
                f.write(bloom_of(np.concatenate(hashes)))
            done.append([bucket, name, int(sum(map(len, hashes)))])

        for b in batches:
            buckets = b.column("_bucket").to_numpy()
            cuts = [0, *(np.nonzero(np.diff(buckets))[0] + 1).tolist(), len(buckets)] if len(buckets) else []
            for lo, hi in zip(cuts, cuts[1:]):
                part, bucket = b.slice(lo, hi - lo), int(buckets[lo])
                if open_ and (open_[2] != bucket or open_[4] >= FILE_ROWS):
                    close()
                    open_ = None
                rows = pa.Table.from_batches([part]).drop_columns(["_bucket", "_hash"])
                if open_ is None:
                    name = f"{self.append}-{uuid.uuid4().hex}.parquet"
                    store.create_dir(f"{path}/data", recursive=True)
                    open_ = [pq.ParquetWriter(f"{path}/data/{name}", rows.schema, filesystem=store), name, bucket, [], 0]
                open_[0].write_table(rows)
                open_[3].append(part.column("_hash").to_numpy())
                open_[4] += hi - lo
        if open_:
            close()
        return _Written(done)

    def commit(self, messages: list) -> None:
        store, path = open_store(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        log = [] if self.overwrite else entries(self.path)
        if not files and log:
            return
        number = len(entries(self.path))
        store.create_dir(f"{path}/log", recursive=True)
        with store.open_output_stream(f"{path}/log/_{self.append}") as f:
            f.write(json.dumps({"append": self.append, "replaces": self.overwrite, "files": files}).encode())
        store.move(f"{path}/log/_{self.append}", f"{path}/log/{number:010d}.json")

    def abort(self, messages: list) -> None:
        """Delete what the tasks of this append have written, also those that never reported."""
        store, path = open_store(self.path)
        for name, _ in files_under(f"{self.path}/data"):
            if name.rsplit("/", 1)[-1].startswith(self.append):
                store.delete_file(name)


class CommittedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    def writer(self, schema, overwrite: bool) -> CommittedWriter:
        return CommittedWriter(self.options["path"], overwrite)


def entries(path: str) -> list[dict]:
    """The log, oldest first."""
    store, _ = open_store(path)
    out = []
    for name, _ in files_under(f"{path}/log"):
        if name.endswith(".json"):
            with store.open_input_stream(name) as f:
                out.append(json.loads(f.read()))
    return out


def exists(path: str) -> bool:
    return any(name.endswith(".json") for name, _ in files_under(f"{path}/log"))


def files_of(path: str, buckets: set[int] | None = None) -> list[tuple[int, str]]:
    """(bucket, path) of the committed files; an entry that replaces hides what stands before it."""
    log = entries(path)
    first = max((k for k, e in enumerate(log) if e["replaces"]), default=0)
    return [(b, f"{path}/data/{name}") for e in log[first:] for b, name, _ in e["files"] if buckets is None or b in buckets]


def append(rows: DataFrame, path: str, key: str, buckets: int, within: list[str], overwrite: bool = False, keep_key: bool = True) -> None:
    """Commit rows by the hash of ``key`` (a text column, which is stored if ``keep_key``). A bucket with many rows is spread over tasks; ``within`` orders the rows of a file."""
    spark = rows.sparkSession
    spark.dataSource.register(CommittedSource)
    keyed = rows.withColumn("_hash", F.xxhash64(key)).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("_bucket").agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("_files"))  # at most one row a bucket
    dealt = keyed.join(F.broadcast(sizes), "_bucket").withColumn("_file", F.pmod(F.monotonically_increasing_id(), F.col("_files")))
    (dealt.repartition("_bucket", "_file").sortWithinPartitions("_bucket", "_file", *within).select(*[c for c in rows.columns if keep_key or c != key], "_bucket", "_hash")
     .write.format("committed").option("path", path).mode("overwrite" if overwrite else "append").save())


def read(spark: SparkSession, path: str, schema=None, files: list[str] | None = None) -> DataFrame:
    names = [f for _, f in files_of(path)] if files is None else files
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*names) if names else spark.createDataFrame([], schema)


def files_that_may_hold(keys: DataFrame, path: str, key: str, buckets: int) -> list[str]:
    """Committed files in which some key may be, by their Bloom filters; only filters of touched buckets are read, in tasks."""
    hashed = keys.select(F.xxhash64(key).alias("h")).withColumn("b", F.pmod("h", F.lit(buckets)).cast("int"))
    touched = {r.b for r in hashed.select("b").distinct().collect()}  # at most one row a bucket
    by_bucket: dict[int, list[str]] = {}
    for b, name in files_of(path, touched):
        by_bucket.setdefault(b, []).append(name)
    if not by_bucket:
        return []
    sent = keys.sparkSession.sparkContext.broadcast(by_bucket)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(path)
        blooms: dict[str, bytes] = {}
        hit: set[str] = set()
        for batch in batches:
            h, b = batch.column("h").to_numpy(), batch.column("b").to_numpy()
            for bucket in np.unique(b).tolist():
                for name in sent.value.get(bucket, ()):
                    if name in hit:
                        continue
                    if name not in blooms:
                        with store.open_input_stream(open_store(f"{name}.bloom")[1]) as f:
                            blooms[name] = f.read()
                    if bloom_may_hold(blooms[name], h[b == bucket]).any():
                        hit.add(name)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(hit), pa.string())], names=["file"])

    return sorted(r.file for r in hashed.mapInArrow(probe, "file string").distinct().collect())  # names of files, as many as the log holds at most
