import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import graph as gr, index as ix
from faultline.sources import commits as sc, committed as cm
from faultline.streaming import ingest, progress


def _rows(spark, ids):
    return spark.createDataFrame([(i, f"h{i}" if i % 10 else "", ["mm", "fs"][i % 2]) for i in ids], "id long, commit_hash string, subsystem string")


def test_append_reads_only_files_that_may_hold_its_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    for lo in range(0, 600, 200):
        ix.append_index(_rows(spark, range(lo, lo + 200)), path, buckets=16)
    read, plain = [], cm.read
    monkeypatch.setattr(cm, "read", lambda s, p, schema=None, files=None: (read.append(files), plain(s, p, schema, files))[1])
    ix.append_index(_rows(spark, [601, 602]), path, buckets=16)
    assert len(cm.files_of(path)) > 40 and len(read[0]) <= 2  # two new keys: Bloom filters pass by chance only
    ix.append_index(_rows(spark, [5, 5, 10, 603]), path, buckets=16)  # a known hash twice, a known nameless row
    assert 2 <= len(read[1]) <= 4
    monkeypatch.undo()
    got = sorted((r.id, r.commit_hash) for r in ix.read_index(spark, path).collect())
    assert got == sorted((i, f"h{i}" if i % 10 else "") for i in [*range(600), 601, 602, 603])
    assert ix.read_index(spark, path).columns == ["id", "commit_hash", "subsystem"]


def test_failed_append_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = _rows(spark, range(100))
    cm.append(rows, path, "commit_hash", 8, ["id"])
    before, files = sorted(map(tuple, cm.read(spark, path).collect())), len(cm.files_under(path))
    bad = _rows(spark, range(100, 200)).withColumn("id", F.when(F.col("id") == 150, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken"):
        cm.append(bad.repartition(3), path, "commit_hash", 8, ["id"])
    assert sorted(map(tuple, cm.read(spark, path).collect())) == before and len(cm.entries(path)) == 1
    assert len(cm.files_under(path)) == files  # abort has removed what tasks had written
    # files without a log entry are not part of the table
    (tmp_path / "t" / "data" / "x.parquet").write_bytes(b"half a file")
    assert sorted(map(tuple, cm.read(spark, path).collect())) == before
    cm.append(_rows(spark, [7]), path, "commit_hash", 8, ["id"], overwrite=True)
    assert [r.id for r in cm.read(spark, path).collect()] == [7]


def test_bloom_filter_has_no_misses():
    rng = np.random.default_rng(1)
    held, other = rng.integers(-2 ** 63, 2 ** 63 - 1, 5000), rng.integers(-2 ** 63, 2 ** 63 - 1, 5000)
    bloom = cm.bloom_of(held)
    assert cm.bloom_may_hold(bloom, held).all() and cm.bloom_may_hold(bloom, other).mean() < 0.02


def _record(i):
    return f"\x1eh{i:03d}\x1fJane é\x1fj@x.org\x1f2020-01-{i % 28 + 1:02d} 10:00:00\x1f2020-01-01 11:00:00\x1fp1\x1fmm: fix leak {i}\n\nbody {'x' * (i * 7 % 50)}\x1f\n+spin_lock(a)\n"


def test_growing_dumps_feed_the_index(spark, tmp_path):
    dumps, path, state = tmp_path / "dumps", str(tmp_path / "index"), str(tmp_path / "state")
    (dumps / "new").mkdir(parents=True)
    whole = {name: "".join(map(_record, ids)).encode() for name, ids in (("b.txt", range(0, 20)), ("new/a.txt", range(20, 30)))}
    (dumps / "b.txt").write_bytes(whole["b.txt"][:700])  # ends within a record
    listener = progress.LoadProgress(str(tmp_path / "progress"), total=30)
    spark.streams.addListener(listener)
    try:
        ingest.index_dumps(spark, str(dumps), path, state).awaitTermination()
        first = {r.commit_hash for r in ix.read_index(spark, path).collect()}
        assert 0 < len(first) < 20
        # both files grow to their ends; a closing mark ends the last records
        (dumps / "b.txt").write_bytes(whole["b.txt"] + b"\x1e")
        (dumps / "new" / "a.txt").write_bytes(whole["new/a.txt"] + b"\x1e")
        query = ingest.index_dumps(spark, str(dumps), path, state)
        query.awaitTermination()
        assert sum(p["numInputRows"] for p in query.recentProgress) == 30 - len(first)  # nothing is read twice
        query = ingest.index_dumps(spark, str(dumps), path, state)
        query.awaitTermination()
        assert sum(p["numInputRows"] for p in query.recentProgress) == 0
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        spark.streams.removeListener(listener)
    batch = ix.index_rows(sc.read_git_log(spark, f"file:{dumps}"))
    key = lambda df: sorted((r.id, r.commit_hash, r.subject, r.bug_type, r.score) for r in df.collect())
    assert key(ix.read_index(spark, path)) == key(batch) and batch.count() == 30
    assert ix.resume_since(spark, path) == "2020-01-27"
    rows = progress.progress_rows(spark, str(tmp_path / "progress")).where("state = 'progress'").collect()
    assert max(r.percent for r in rows) > 50 and all(r.total == 30 and 0 <= r.done <= 30 for r in rows)


def test_ancestors_of_any_depth_and_cycles(spark):
    table = [("e", "d"), ("d", "c"), ("c", "b"), ("b", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("x", "x"), (None, "a"), ("q", None)]
    got = {(r.node, r.ancestor): r.depth for r in gr.closure(spark.createDataFrame(table, "node string, parent string")).collect()}
    assert {k: v for k, v in got.items() if k[0] == "e"} == {("e", "d"): 1, ("e", "c"): 2, ("e", "b"): 3, ("e", "a"): 4}
    assert {k for k in got if k[0] == "x"} == {("x", "y"), ("x", "z")}
    deep = dict(table[:4])
    assert spark.range(1).select(gr.ancestors(F.lit("e"), deep).alias("a"), gr.ancestors(F.lit("?"), deep).alias("b")).first() == (["d", "c", "b", "a"], [])
    with pytest.raises(ValueError):
        gr.ancestors(F.lit("x"), {"x": "y", "y": "x"})
    # the fixed hierarchy, by the iterated join, equals what the column gives
    edges = spark.createDataFrame(list(gr.parent_table().items()), "node string, parent string")
    chains = {n: [a for _, a in sorted((r.depth, r.ancestor) for r in rows)] for n, rows in _grouped(gr.closure(edges).collect()).items()}
    named = spark.createDataFrame([(n,) for n in gr.parent_table()], "n string").select("n", gr.ancestors(F.col("n")).alias("a")).collect()
    assert {r.n: r.a for r in named} == chains


def _grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.node, []).append(r)
    return out
