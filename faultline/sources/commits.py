"""Commit sources: columnar or JSON tables, and `git log` dumps through a Python data source."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators import commits as co
from .store import files_under, open_store

GITLOG_SCHEMA = ("commit_hash string, author string, email string, date string, committer_date string, parents string, "
                 "message string, diff_content string, pos bigint")
# git log --format=%x1e%H%x1f%an%x1f%ae%x1f%ad%x1f%cd%x1f%P%x1f%B%x1f -p --date=format:'%Y-%m-%d %H:%M:%S'
RECORD, FIELD = "\x1e", "\x1f"


SPLIT_BYTES = 64 << 20


class _Dump(InputPartition):
    def __init__(self, path: str, first: int, lo: int, hi: int):
        self.path, self.first, self.lo, self.hi = path, first, lo, hi


def _first_place(name: str) -> int:
    """Where the places of a file begin: a hash of its name under the dump folder, so that batch and stream number alike whatever other files there are."""
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big") >> 3


class _Dumps:
    """Byte ranges of dump files on any store, cut at record marks; the options since and to bound ``date`` while reading."""

    def __init__(self, options):
        self.path, self.split_bytes = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        self.since, self.to = options.get("since"), options.get("to")
        self.hold_last = options.get("holdLast", "true").lower() == "true"

    def files(self) -> dict[str, tuple[str, int]]:
        """(path, size) by name under the folder; the name of a single dump is its last part."""
        root = open_store(self.path)[1].rstrip("/")
        return {path[len(root):].lstrip("/") or root.rsplit("/", 1)[-1]: (path, size) for path, size in files_under(self.path)}

    def ranges(self, name: str, path: str, lo: int, hi: int) -> list[_Dump]:
        return [_Dump(path, _first_place(name), at, min(at + self.split_bytes, hi)) for at in range(lo, hi, self.split_bytes)]

    def read(self, part: _Dump):
        for at, record in _records(open_store(self.path)[0], part.path, part.lo, part.hi):
            fields = record.decode("utf-8", "replace").split(FIELD)
            if len(fields) == 8 and (self.since is None or fields[3] >= self.since) and (self.to is None or fields[3] <= self.to):
                yield (*(x.strip("\n") for x in fields), part.first + at)


class GitLogReader(_Dumps, DataSourceReader):
    def partitions(self):
        return [d for name, (path, size) in self.files().items() for d in self.ranges(name, path, 0, size)] or [_Dump("", 0, 0, 0)]

    def read(self, part: _Dump):
        return iter(()) if not part.path else super().read(part)


class GitLogStreamReader(_Dumps, DataSourceStreamReader):
    """Growing dumps. An offset is the byte up to which each known file is read.

    With ``holdLast`` (the default) a file's last record waits until another record's mark ends it, so a record that is still being written is never
    cut; without it the end of the file ends the last record.
    """

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store = open_store(self.path)[0]
        return {name: _last_mark(store, path, size) if self.hold_last else size for name, (path, size) in sorted(self.files().items())}

    def partitions(self, start: dict, end: dict):
        files = self.files()
        return [d for name, hi in end.items() if name in files for d in self.ranges(name, files[name][0], start.get(name, 0), hi)]


def _last_mark(store, path: str, size: int, step: int = 1 << 20) -> int:
    """Place of the last record mark of a file, 0 where it has none."""
    with store.open_input_file(path) as f:
        hi = size
        while hi > 0:
            lo = max(0, hi - step)
            f.seek(lo)
            at = f.read(hi - lo).rfind(RECORD.encode())
            if at >= 0:
                return lo + at
            hi = lo
    return 0


def _records(store, path: str, lo: int, hi: int, size: int = 1 << 20):
    """(place, record) of the records whose mark lies in [lo, hi); a dump may be larger than memory."""
    mark = RECORD.encode()
    with store.open_input_file(path) as f:
        f.seek(lo)
        at, held, started = lo, b"", False
        while True:
            block = f.read(size)
            held += block
            while True:
                if not started:
                    begin = held.find(mark)
                    if begin < 0:
                        at, held = at + len(held), b""
                        break
                    at, held, started = at + begin, held[begin + 1:], True
                    if at >= hi:
                        return
                end = held.find(mark)
                if end < 0:
                    break
                yield at, held[:end]
                at, held = at + 1 + end, held[end + 1:]
                if at >= hi:
                    return
            if not block:
                if started:
                    yield at, held
                return
            if not started and at >= hi:
                return


class GitLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return GITLOG_SCHEMA

    def reader(self, schema) -> GitLogReader:
        return GitLogReader(self.options)

    def streamReader(self, schema) -> GitLogStreamReader:
        return GitLogStreamReader(self.options)


def _commits(df: DataFrame) -> DataFrame:
    return (df.withColumn("subject", F.substring_index("message", "\n", 1)).withColumn("body", F.col("message"))
            .withColumn("parent_hashes", F.filter(F.split("parents", " "), lambda p: p != ""))
            .withColumn("is_merge", F.size("parent_hashes") > 1).drop("message", "parents")).transform(co.changed_files)


def stream_git_log(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, since: str | None = None, to: str | None = None, hold_last: bool = True) -> DataFrame:
    """The commits of growing dumps as a stream; each row as ``read_git_log`` gives it."""
    spark.dataSource.register(GitLogSource)
    reader = spark.readStream.format("gitlog").option("path", path).option("splitBytes", str(split_bytes)).option("holdLast", str(hold_last).lower())
    for name, value in (("since", since), ("to", to)):
        reader = reader.option(name, value) if value else reader
    return _commits(reader.load())


def read_git_log(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, since: str | None = None, to: str | None = None) -> DataFrame:
    """Dumps to commits, ready for the index: subject = first line, body = whole message, merge flag from the parents, changed
    files and lines from the diff.  The reader skips commits outside [since, to]; ``pos`` grows with the place in a dump, and each dump has a range of its own."""
    spark.dataSource.register(GitLogSource)
    reader = spark.read.format("gitlog").option("path", path).option("splitBytes", str(split_bytes))
    for name, value in (("since", since), ("to", to)):
        reader = reader.option(name, value) if value else reader
    return _commits(reader.load())


def read_commits(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, since: str | None = None,
                 to: str | None = None, filepath: str | None = None, only_no_merge: bool = True,
                 limit: int | None = None) -> DataFrame:
    """Commit table with the scan options of the collector; date bounds reach the file scan."""
    reader = spark.read.format(fmt)
    df = (reader.schema(schema) if schema else reader).load(path)
    return scan_options(df, since, to, filepath, only_no_merge, limit)


def scan_options(df: DataFrame, since=None, to=None, filepath=None, only_no_merge=True, limit=None) -> DataFrame:
    if since:
        df = df.where(F.col("date") >= since)
    if to:
        df = df.where(F.col("date") <= to)
    if filepath:
        df = df.where(F.array_contains("files_changed", filepath))
    if only_no_merge and "is_merge" in df.columns:
        df = df.where(~F.col("is_merge"))
    return df.limit(limit) if limit else df


def is_git_repo(path: str) -> bool:
    return os.path.exists(os.path.join(path, ".git"))


def first_existing(paths: list[str]) -> str | None:
    """The first data folder that exists (index resolution order)."""
    return next((p for p in paths if p and os.path.exists(p)), None)
