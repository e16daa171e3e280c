import random
import re

from pyspark.sql import functions as F

from faultline.operators import crashes as cx, graph
from faultline.plans import views as vw

FRAME = re.compile(r"\w+\+0x[0-9a-f]+/0x[0-9a-f]+")
START = re.compile(r"[Cc]all [Tt]race:|Stack trace:|Backtrace:|---\[ end trace [\da-fA-F]+ \]---")
STOP = re.compile(r"Code: (?:Bad RIP value\.|[0-9a-fA-F].+)|Kernel panic - not syncing:|---\[ end trace|^\s*$")


def bounds(text):
    """Brute force over the definition: first marker (or frame), then the first run of frames."""
    lines = text.split("\n")
    is_frame = [bool(FRAME.search(x)) or (bool(re.search(r"\[\s*<[\da-fA-F]+>\]\s+", x.strip())) and not x.strip().startswith("?"))
                for x in lines]
    starts = [i for i, x in enumerate(lines) if START.search(x)] or [i for i, f in enumerate(is_frame) if f]
    if not starts:
        return -1, -1
    s = starts[0]
    frames = [i for i in range(s + 1, len(lines)) if is_frame[i]]
    blocks = [i for i in range(s + 1, len(lines)) if not is_frame[i] and STOP.search(lines[i].strip())]
    if not frames or (blocks and blocks[0] < frames[0]):
        return s, s
    end = frames[0]
    while end + 1 < len(lines) and is_frame[end + 1]:
        end += 1
    return s, end


def test_trace_bounds_match_brute_force(spark):
    rnd = random.Random(7)
    texts = [t.replace("{fn}", "a_b").replace("{fn2}", "c_d").replace("{ver}", "6.1.0").replace("{addr}", "00ff") for t in vw.LOGS]
    for t in list(texts):
        for _ in range(12):
            lines = t.split("\n")
            rnd.shuffle(lines)
            texts.append("\n".join(lines))
    df = spark.createDataFrame(list(enumerate(texts)), "crash_id long, content string").transform(cx.locate_trace)
    got = {r.crash_id: (r.trace_start, r.trace_end) for r in df.select("crash_id", "trace_start", "trace_end").collect()}
    assert got == {i: bounds(t) for i, t in enumerate(texts)}


def _features(spark, rows):
    return spark.createDataFrame(rows, "crash_id int, panic_msg string, call_trace array<string>")


def test_expert_rules(spark):
    rows = [(1, "BUG: unable to handle kernel NULL pointer dereference at 08", ["some_function"]),
            (2, "INFO: task kworker blocked for more than 120 seconds", ["mutex_lock"]),
            (3, "KASAN: use-after-free in kmem_cache_alloc", ["kmem_cache_alloc"]),
            (4, "Kernel panic - not syncing: Out of memory and no killable processes", []),
            (5, "nothing here", []), (6, "", ["mutex_lock+0x1/0x2"])]
    got = {r.crash_id: (r.rule_id, r.rule_score) for r in cx.match_rules(_features(spark, rows)).collect()}
    assert got == {1: ("R002", .95), 2: ("R014", .95), 3: ("R003", .95), 4: ("R023", .95), 5: (None, None), 6: ("R004", .70)}


def test_trace_structure(spark):
    rows = [(1, "", ["spin_lock_irqsave", "mutex_lock", "try_to_wake_up"]), (2, "", ["kmalloc", "kfree", "kasan_report"]),
            (3, "", ["rcu_read_lock", "synchronize_rcu", "rcu_dereference"]), (4, "", [])]
    got = {r.crash_id: r.inferred_issue for r in cx.trace_structure(_features(spark, rows)).collect()}
    assert got == {1: "deadlock_or_lock_contention", 2: "memory_related", 3: "possible_lock_issue", 4: "unknown"}


def test_panic_details_keep_last_value(spark):
    df = spark.createDataFrame([(1, "Oops: 1\nkernel BUG at a.c:7\nOops: 2")], "crash_id long, content string")
    r = df.transform(cx.locate_trace).transform(cx.panic_info).first()
    assert r.panic_type == "kernel_oops" and r.panic_msg == "Oops: 1" and r.panic_details == {"group_0": "2", "group_1": "7"}
    assert r.matched_patterns == ["kernel_oops", "bug_on", "kernel_oops"]


def test_graph_paths(spark):
    rows = [("kernel/rcu/tree.c", "kernel"), ("virt/kvm/kvm_main.c", "kvm"), ("arch/x86/kvm/x86.c", "arch"), ("include/linux/list.h", None),
            ("mm/slab.c", "mm"), ("net/ipv4/tcp.c", "net")]
    df = spark.createDataFrame(rows, "p string, want string")
    assert all(r.got == r.want for r in df.select(graph.subsystem_of_path(F.col("p")).alias("got"), "want").collect())


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from faultline.plans import stage
    n = 5 * stage.ROWS_PER_TASK
    pq.write_table(pa.table({"event_id": list(range(n))}), f"{tmp_path}/one.parquet", row_group_size=n)
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = spark.read.parquet(f"{tmp_path}/one.parquet")
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = stage.spread(df).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(sizes) == n and max(sizes) <= 2 * stage.ROWS_PER_TASK
        assert stage.spread(df).distinct().count() == n
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)


def test_anchors_are_in_every_match():
    from faultline.functions import sqltext as sq
    from faultline.rules import crash_rules as cr
    assert sq.anchor(r"INFO: task .* blocked for more than \d+ seconds") == " blocked for more than "
    assert sq.anchor(r"ab?cd") == "cd" and sq.anchor(r"x\[ab\]") == "x[ab]" and sq.anchor("UBSAN: (a|b)") == "ubsan: "
    for unsure in ("a|b", "x{2}", "[ab]cd", "(a(b)c)d", r"\Qab", r"a\\b", "(?i)ab", "ä"):
        assert sq.anchor(unsure) == ""
    assert all(sq.anchor(p) for r in cr.EXPERT_RULES for p in r[5])


def test_best_rule_level_comes_before_table_order(spark):
    rules = [("A", "a", "x", 1, ["alpha"], [], [], ""), ("B", "b", "x", 1, ["beta"], [r"oops: \d+"], [], ""), ("C", "c", "x", 1, ["beta"], [r"OOPS: \d+"], [], "")]
    rows = [(1, "alpha Oops: 12", []), (2, "beta", ["alpha+0x1/0x2"]), (3, "none", ["beta+0x1/0x2", "ALPHA+0x1/0x2"]), (4, None, None), (5, "oops: x", [])]
    df = spark.createDataFrame(rows, "crash_id bigint, panic_msg string, call_trace array<string>")
    got = {r.crash_id: (r.rule_id, r.rule_score, r.rule_match) for r in cx.match_rules(df, rules).collect()}
    assert got == {1: ("B", 0.95, r"panic_pattern:oops: \d+"), 2: ("B", 0.85, "panic_keyword:beta"), 3: ("A", 0.7, "trace_keyword:alpha"),
                   4: (None, None, None), 5: (None, None, None)}


def test_modules_of_long_words(spark):
    """The module pattern tried each place of a word: a word of 200,000 characters took 2 * 10^10 steps, also in logs that name no module."""
    import time
    rows = [(0, None), (1, "x" * 200_000), (2, "evil_mod: loading out-of-tree module taints\nb: loading out-of-tree module"), (3, "")]
    df = spark.createDataFrame(rows, "k int, content string")
    started = time.time()
    got = {r.k: r.modules for r in df.select("k", cx.modules_in(F.col("content")).alias("modules")).collect()}
    assert got == {0: None, 1: [], 2: ["evil_mod", "b"], 3: []} and time.time() - started < 8


def test_trace_marks_with_white_space_around(spark):
    lines = ["  Call Trace:", "\u2003 \u00a0", "Code: 4 ", "  Code: ", "---[ end trace 0a ]---", "---[ end trace x", " f+0x1/0x2\u3000", "?[<ff>] f", "[<ff>] ", " [<ff>] g",
             "x Kernel panic - not syncing: y"]
    df = spark.createDataFrame([(x,) for x in lines], "l string").select(
        "l", F.array_join(F.array(*[F.when(t(F.col("l")), F.lit(n)).otherwise(F.lit("")) for n, t in
                                    (("s", cx._is_start), ("e", cx._is_end), ("f", cx.is_frame))]), "").alias("kind"))
    assert [r.kind for r in df.collect()] == ["s", "e", "e" if STOP.search("Code: 4") else "", "", "se", "e", "f", "", "", "f", "e"]


def test_lock_calls_of_frames_in_any_case(spark):
    df = spark.createDataFrame([(1, ["MUTEX_LOCK+0x1/0x2", "mutex_unlock+0x1/0x2"]), (2, None), (3, [])], "k int, call_trace array<string>")
    got = {r.k: (r.locks_acquired, r.locks_released) for r in graph.lock_usage(df).collect()}
    assert "mutex_lock" in got[1][0] and "mutex_unlock" in got[1][1] and got[2] == (None, None) and got[3] == ([], [])


def test_symptom_words_are_looked_for_once(spark):
    """Scores as counted word by word, from one search a distinct word: there were two for each word of each symptom."""
    from faultline.rules import knowledge as kn

    def scores(text):
        out = []
        for i, (bug, p) in enumerate(kn.BUG_PATTERNS.items()):
            counts = [(sum(w in text.lower() for w in words), len(words)) for words in (s.lower().split() for s in p["symptoms"])]
            if total := sum(n for n, of in counts if n >= of * 0.5):
                out.append((total, -i, bug, p["name"]))
        return sorted(out, reverse=True)
    symptoms = [s for p in kn.BUG_PATTERNS.values() for s in p["symptoms"]]
    texts = ["", *symptoms, *(" ".join(x) for x in zip(symptoms, symptoms[7:])), "KASAN: USE-AFTER-FREE in x", "list_del corruption corruption /"]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "k int, panic_msg string").transform(cx.symptom_matches, "panic_msg")
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(") <= 10
    got = {r.k: [tuple(s) for s in r.symptoms] for r in df.collect()}
    assert got.pop(-1) == [] and got == {i: scores(t) for i, t in enumerate(texts)}


def test_only_words_that_decide_are_looked_for():
    from faultline.functions import sqltext as sq
    assert sq.decisive([("a", ["lock", "deadlock", "lock"]), ("b", ["spinlock", "race"]), ("c", ["races"])]) == [("a", ["lock"]), ("b", ["race"])]


def test_symptom_rows_search_words_once(spark):
    """A row for each match; a plain explode let Spark filter by the list's size below the masks, which wrote their searches out 244 times."""
    df = spark.createDataFrame([(1, "use-after-free in x"), (1, "use-after-free in x"), (2, ""), (3, None)], "k int, panic_msg string")
    rows = cx.symptom_rows(df, "k", "panic_msg")
    assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("aggregate(") <= 4
    want = {r.k: r.symptoms for r in df.transform(cx.symptom_matches, "panic_msg").collect()}
    assert want[1] and not want[2] and not want[3]
    assert sorted((r.k, r.place, r.bug_type, r.score) for r in rows.collect()) == sorted(
        (1, i + 1, s.bug_type, s.score) for i, s in enumerate(want[1]) for _ in range(2))
