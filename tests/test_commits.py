from pyspark.sql import functions as F

from faultline.functions import text as tf, versions as vf
from faultline.operators import commits as co


def _commits(spark, rows):
    return spark.createDataFrame(rows, "commit_hash string, subject string, body string, diff_content string")


def test_best_diff_rule(spark):
    rows = [("a", "mm: fix use-after-free in slub allocator", "", "+kref_get(x)\n-kfree(x)\n+kfree_rcu(x)"),
            ("b", "net: fix deadlock in tcp stack error path", "", "+mutex_unlock(&l);\n+return -ENOMEM;"),
            ("c", "fix: null pointer", "", None), ("d", "x", "", "+++ b/mutex_unlock(\n--- a/spin_lock(")]
    got = {r.commit_hash: r.diff_rule for r in co.score_diff_rules(_commits(spark, rows)).collect()}
    assert got == {"a": "C02", "b": "L03", "c": None, "d": None}


def test_bug_type_by_title(spark):
    rows = [("1", "mm: fix use-after-free in slub allocator", "use_after_free"), ("2", "net: fix NULL pointer dereference", "null_pointer"),
            ("3", "sched: fix soft lockup in CFS load balancer", "unknown"), ("4", "mm: fix memory leak in vmalloc", "memory_leak"),
            ("5", "net: trace path cleanup", "race_condition"), ("6", "locking: fix deadlock in mutex_unlock path", "deadlock")]
    df = spark.createDataFrame(rows, "commit_hash string, subject string, want string").withColumn("body", F.lit(""))
    assert all(r.bug_type == r.want for r in co.detect_bug_type(df).collect())


def test_tags_need_word_borders(spark):
    df = _commits(spark, [("a", "prefix fixes: réfix bugs", "null_x", None)])
    assert co.extract_fix_tags(df).first().fix_tags == ["Fixes"]


def test_release_of_dates(spark):
    rows = [("2016-01-01", (4, 9)), ("2022-12-11", (6, 1)), ("2022-12-12", (6, 2)), ("2018-11-01", (5, 0)), ("2019-01-15", (5, 0)),
            ("2025-06-01", (6, 13)), ("2023-13-45", None), ("", None)]
    df = spark.createDataFrame([r[0] for r in rows], "string").select("value", vf.resolve_version(F.col("value")).alias("v"))
    got = {r.value: (tuple(r.v) if r.v else None) for r in df.collect()}
    assert got == dict(rows)


def test_version_texts(spark):
    rows = [("6.1.0-15-amd64", "6.1.0"), ("Linux 6.1.0-rc5", "6.1.0"), ("6.1", "6.1.0"), ("100.1", None), ("none", None)]
    df = spark.createDataFrame(rows, "raw string, want string")
    assert all(r.got == r.want for r in df.select(vf.normalize_version(F.col("raw")).alias("got"), "want").collect())


def test_labels(spark):
    rows = [("uaf", "use_after_free"), ("NULL pointer dereference", "null_pointer"), ("rcu_related", "unknown"),
            ("deadlock_or_lock_contention", "deadlock"), ("", "unknown"), (None, "unknown")]
    df = spark.createDataFrame(rows, "raw string, want string")
    assert all(r.got == r.want for r in df.select(tf.normalize_bug_type(F.col("raw")).alias("got"), "want").collect())
    assert all(tf.normalize_bug_label(a) == b for a, b in rows)


def test_text_utilities(spark):
    df = spark.createDataFrame([("\x1b[31mred\x1b[0m  \r\n\r\n\r\n\r\nend \t", "word " * 60, 0.0005, 61500.0)], "t string, w string, a double, b double")
    r = df.select(tf.clean_text(F.col("t")).alias("c"), tf.truncate_text(F.col("w"), 50).alias("s"), tf.format_duration(F.col("a")).alias("x"),
                  tf.format_duration(F.col("b")).alias("y"), tf.overlap_score(F.lit("A b  a"), F.lit("b c")).alias("o")).first()
    assert r.c == "red\n\nend" and r.s == ("word " * 10)[:44] + "..." and (r.x, r.y) == ("0μs", "1m 2s") and r.o == 0.5


def test_tags_are_found_in_either_case_beside_other_letters(spark):
    rows = [(1, "FIXES a BuG", "no crashed thing, İ oopsie, CVE-1"), (2, None, None), (3, "prefix", "nullable; Kaos Leakİ racė _panic panic")]
    df = spark.createDataFrame(rows, "doc_id bigint, subject string, body string")
    got = {r.doc_id: r.fix_tags for r in co.extract_fix_tags(df).collect()}
    assert got == {1: ["Fixes", "BUG", "bug", "CVE"], 2: [], 3: ["panic", "race"]}


def test_tags_and_evidence_try_few_regexes(spark):
    """A tag's letters come before the sign in front of them, and an evidence pattern is tried where its longest piece occurs; the hits are as before."""
    texts = ["fix", "a_fix", "é fix.", "1fix", "FIX-leak", "prefix nullé", "ref count\nleak", "a ref b leak", "inconsistent x ref", "synchronize the rcu", "rcu bug", "missing put", ""]
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], "k int, subject string, body string").withColumn("added_lines", F.array().cast("array<string>"))
    out = df.transform(co.extract_fix_tags).transform(co.fix_evidence)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "(?i)(?<!" not in plan and "Contains(_msg" in plan.replace(" ", "")
    got = {texts[r.k]: (r.fix_tags, r.refcount_fix, r.rcu_fix) for r in out.collect()}
    assert got["fix"][0] == got["é fix."][0] == ["fix"]
    assert got["a_fix"][0] == got["1fix"][0] == got["prefix nullé"][0] == got[""][0] == [] and "leak" in got["FIX-leak"][0]
    assert [t for t in texts if got[t][1]] == ["a ref b leak", "inconsistent x ref", "missing put"] and [t for t in texts if got[t][2]] == ["synchronize the rcu", "rcu bug"]


def test_a_word_is_hashed_once(monkeypatch):
    import hashlib
    import numpy as np
    from faultline.operators import models as md
    calls, md5 = [], hashlib.md5
    monkeypatch.setattr(hashlib, "md5", lambda b: calls.append(b) or md5(b))
    out = md.hashed_model(8)(np.array(["a b a", None, "", "B a"], object))
    assert len(calls) == 2 and out.sum(1).tolist() == [3, 0, 0, 2] and out.max() == 2
