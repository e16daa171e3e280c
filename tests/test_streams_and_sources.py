import random
from collections import defaultdict

from pyspark.sql import functions as F

from faultline.operators import index as ix
from faultline.plans import views as vw
from faultline.sources import commits as sc, logs as sl
from faultline.streaming import ingest, state

SF = "/root/testdata/sf0.001"


def _run(df, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def test_rate_limit_matches_brute_force(spark, tmp_path):
    rnd, t, rows = random.Random(3), 1_700_000_000.0, []
    for i in range(400):
        t += rnd.random() * 3
        rows.append((rnd.choice([1, 1, 1, 2]), t, i))
    for part in (rows[:150], rows[150:]):
        spark.createDataFrame(part, "client long, s double, request_id long").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long"))) \
            .drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("client long, ts timestamp, request_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    _run(state.rate_limit(src, limit=5, window=10, delay="1 hour"), "limited")
    got = {r.request_id: r.allowed for r in spark.table("limited").collect()}
    seen, want = defaultdict(list), {}
    for client, s, i in rows:
        us = int(s * 1e6)
        live = [x for x in seen[client] if x > us - 10_000_000]
        want[i] = len(live) < 5
        seen[client] = live + [us] if want[i] else live
    assert got == want and not all(want.values())


def test_one_client_with_very_many_requests_in_a_batch(spark, tmp_path):
    n = 1_000_000
    spark.range(n).select(F.lit(1).cast("long").alias("client"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + (F.col("id") * 7919 % n) * 1000).alias("ts"),
                          F.col("id").alias("request_id")).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("client long, ts timestamp, request_id long").parquet(str(tmp_path / "in"))
    state.rate_limit(src, limit=60, window=60, delay="1 day").writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    # one request a millisecond for 1,000 s: the first 60 of each minute from the last accepted batch on
    assert out.count() == n and out.where("allowed").count() == 60 * 17


def test_task_rows_keep_the_latest(spark, tmp_path):
    spark.createDataFrame([(1, 10, "new"), (1, 30, "done"), (1, 20, "run"), (2, 5, "new")], "task_id long, s long, status string") \
        .select("task_id", F.timestamp_seconds("s").alias("ts"), "status").write.parquet(str(tmp_path / "t"))
    src = spark.readStream.schema("task_id long, ts timestamp, status string").parquet(str(tmp_path / "t"))
    _run(state.task_rows(src, delay="1 day"), "tasks", "update")
    assert {r.task_id: r.status for r in spark.table("tasks").collect() if r.status != "expired"} == {1: "done", 2: "new"}


def test_index_stream_equals_batch_and_is_idempotent(spark, tmp_path):
    commits = vw.commits(spark, SF).withColumn("commit_hash", F.when(F.col("pos") % 20 == 0, "").otherwise(F.col("commit_hash")))
    assert commits.where("commit_hash = ''").count() > 1 and commits.select("commit_hash").distinct().count() < commits.count()
    commits.repartition(2).write.parquet(str(tmp_path / "in"))
    path = str(tmp_path / "index")
    for run in ("a", "b"):  # a fresh checkpoint replays everything
        src = ingest.stream_commits(spark, str(tmp_path / "in"), commits.schema, 1)
        ingest.index_stream(src, path, str(tmp_path / run)).awaitTermination()
    every = ix.index_rows(spark.read.parquet(str(tmp_path / "in"))).collect()
    rows = ix.read_index(spark, path).collect()
    # each hash once, whichever of its rows came first, and each row without hash once
    assert sorted(r.commit_hash for r in rows if r.commit_hash) == sorted({r.commit_hash for r in every} - {""})
    assert sorted(r.id for r in rows if not r.commit_hash) == sorted(r.id for r in every if not r.commit_hash)
    of = {r.id: (r.commit_hash, r.subsystem, r.bug_type, r.score) for r in every}
    assert all(of[r.id] == (r.commit_hash, r.subsystem, r.bug_type, r.score) for r in rows)
    assert ix.exists_index(spark, path)
    assert ix.resume_since(spark, path) < max(r.date for r in rows if r.date[:2] == "20")
    assert ix.drop_index(spark, path) and not ix.exists_index(spark, path)


def test_large_subsystem_is_spread_over_files(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "mm").otherwise("fs").alias("subsystem"), F.col("id").cast("string").alias("commit_hash"))
    ix.write_index(df, str(tmp_path / "i"), rows_per_file=200)
    assert len(list((tmp_path / "i" / "subsystem=mm").glob("*.parquet"))) >= 5 and len(list((tmp_path / "i" / "subsystem=fs").glob("*.parquet"))) == 1


def test_git_log_source(spark, tmp_path):
    rec = "".join(f"\x1eh{i}\x1fJane\x1fj@x.org\x1f2020-01-0{i} 10:00:00\x1f2020-01-0{i} 11:00:00\x1fp1{' p2' if i == 3 else ''}"
                  f"\x1ffix {i}\n\nbody\x1f\n+spin_lock(a)\n" for i in (1, 2, 3))
    (tmp_path / "dump.txt").write_text(rec)
    df = sc.read_git_log(spark, str(tmp_path))
    assert [(r.commit_hash, r.subject, r.is_merge) for r in df.orderBy("commit_hash").collect()] == [
        ("h1", "fix 1", False), ("h2", "fix 2", False), ("h3", "fix 3", True)]
    assert df.where("date >= '2020-01-02'").count() == 2
    assert [r.commit_hash for r in sc.read_git_log(spark, str(tmp_path), since="2020-01-02", to="2020-01-02 23").collect()] == ["h2"]
    assert sc.scan_options(df, since="2020-01-02").count() == 1


def test_dump_to_index_and_back(spark, tmp_path):
    diff = ("diff --git a/mm/slub.c b/mm/slub.c\nindex 1..2 100644\n--- a/mm/slub.c\n+++ b/mm/slub.c\n@@ -1,2 +1,3 @@ void f(void)\n-kfree(p);\n+spin_lock(&l);\n+kfree(p);\n"
            "+++ odd line\ndiff --git a/fs/old.c b/fs/old.c\ndeleted file mode 100644\n--- a/fs/old.c\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\n"
            "diff --git a/fs/a.c b/fs/b.c\nsimilarity index 100%\nrename from fs/a.c\nrename to fs/b.c")
    rec = "".join(f"\x1eh{i:03d}\x1fJane é\x1fj@x.org\x1f2020-01-{i % 28 + 1:02d} 10:00:00\x1f2020-01-01 11:00:00\x1fp1\x1fmm: fix use-after-free {i}\n\nbody {'x' * (i * 7 % 50)}\x1f\n{diff}\n"
                  for i in range(60))
    (tmp_path / "dump.txt").write_text(rec, encoding="utf-8")
    whole = sc.read_git_log(spark, str(tmp_path)).collect()
    for size in (97, 1000, 5000):  # ranges that begin anywhere in a record
        assert sorted(sc.read_git_log(spark, str(tmp_path), size).collect()) == sorted(whole)
    assert len({r.pos for r in whole}) == len(whole) == 60
    r = min(whole, key=lambda r: r.pos)
    assert r.commit_hash == "h000" and r.files_changed == ["mm/slub.c", "fs/old.c", "fs/b.c"] and (r.insertions, r.deletions) == (3, 2)
    assert [(f.added_lines, f.deleted_lines) for f in r.file_changes] == [(3, 1), (0, 1), (0, 0)]
    df = sc.scan_options(sc.read_git_log(spark, str(tmp_path)), since="2020-01-05", to="2020-01-10", filepath="mm/slub.c")
    assert {r.date[:10] for r in df.collect()} == {f"2020-01-{d:02d}" for d in range(5, 10)}
    path = str(tmp_path / "index")
    ix.append_index(ix.index_rows(sc.read_git_log(spark, str(tmp_path))), path)
    ix.append_index(ix.index_rows(sc.read_git_log(spark, str(tmp_path), 500)), path)
    back = ix.read_index(spark, path).collect()
    assert sorted(r.commit_hash for r in back) == [f"h{i:03d}" for i in range(60)]
    assert {(r.subsystem, r.bug_type) for r in back} == {("mm", "use_after_free")} and all(r.lock_added for r in back)


def test_log_source(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Oops: 1\nCall Trace:\n f+0x1/0x2\n")
    r = ingest.diagnose_stream(sl.read_logs(spark, str(tmp_path))).first()
    assert r.name == "a.txt" and r.rule_id == "R024" and r.call_trace == ["f+0x1/0x2"]
