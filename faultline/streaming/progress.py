"""Progress of a load as rows: a query listener that turns progress events into (run, batch, done, total, percent, seconds left)."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import index as ix
from ..sources.store import open_store

SCHEMA = "query string, run_id string, batch_id bigint, done bigint, total bigint, elapsed double, percent double, seconds_left double, state string"


class LoadProgress(StreamingQueryListener):
    """Writes one small JSON file per progress event of any query into ``path``, which ``progress_rows`` reads.

    ``total``: how many rows the load will have, if known; without it percent and time left are 0 and null.
    """

    def __init__(self, path: str, total: int | None = None):
        self.path, self.total = path, total
        self.store, self.folder = open_store(path)
        self.store.create_dir(self.folder, recursive=True)
        self.done: dict[str, int] = {}
        self.began: dict[str, float] = {}

    def _write(self, run: str, name: str | None, batch: int, state: str) -> None:
        row = {"query": name, "run_id": run, "batch_id": batch, "done": self.done.get(run, 0), "total": self.total,
               "elapsed": round(time.time() - self.began.get(run, time.time()), 3), "state": state}
        with self.store.open_output_stream(f"{self.folder}/{run}-{batch:08d}-{state}.json") as f:
            f.write(json.dumps(row).encode())

    def onQueryStarted(self, event) -> None:
        run = str(event.runId)
        self.began[run], self.done[run] = time.time(), 0
        self._write(run, event.name, -1, "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        run = str(p.runId)
        self.done[run] = self.done.get(run, 0) + int(p.numInputRows)
        self._write(run, p.name, int(p.batchId), "progress")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        self._write(run, None, 1 << 26, "failed" if event.exception else "ended")


def progress_rows(spark: SparkSession, path: str) -> DataFrame:
    """Percent and seconds left follow from the rows done, the total and the seconds since the start."""
    from pyspark.sql import functions as F
    raw = spark.read.schema("query string, run_id string, batch_id bigint, done bigint, total bigint, elapsed double, state string").json(path)
    percent, left = ix.progress(F.col("done"), F.col("total"), F.col("elapsed"))
    return raw.withColumns({"percent": F.coalesce(percent, F.lit(0.0)), "seconds_left": left}).select(*[x.split()[0] for x in SCHEMA.split(", ")])
