"""Crash-log operators: trace bounds, panic facts, features and layered root cause.

A log is one row; every operator works on that row's line array with built-in
array functions, so no operator here shuffles and logs scale out by rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import numeric as nf, sqltext as sq, text as tf
from ..rules import crash_rules as cr, knowledge as kn, texts as say
from . import graph

_C = F.col


def _empty() -> Column:
    return F.array().cast("array<string>")


# --- lines and trace ----------------------------------------------------------------------------

def is_frame(line: Column) -> Column:
    """Stack frame: ``f+0x1/0x2`` anywhere, or an ``[<addr>]`` prefix unless marked uncertain."""
    # the first pattern neither begins nor ends with white space: only the second needs a stripped line
    func = F.contains(line, F.lit("+0x")) & line.rlike(cr.FRAME_FUNC)
    s = tf.strip(line)
    return func | (F.contains(line, F.lit(">]")) & ~s.startswith("?") & s.rlike(cr.FRAME_ADDR))


def _is_start(line: Column) -> Column:
    """A start marker; plain markers are looked for as they are, the one with a hash by its pattern."""
    *plain, ended = cr.TRACE_START
    return tf.any_contains(line, plain) | (F.contains(line, F.lit("---[ end trace ")) & line.rlike(ended))


def _is_end(line: Column) -> Column:
    """An end marker in the stripped line."""
    code, panic, _, _ = cr.TRACE_END
    return ((F.ltrim(line, F.lit(tf.SPACES)) == "") | tf.any_contains(line, [panic, "---[ end trace"])
            | (F.contains(line, F.lit("Code: ")) & tf.strip(line).rlike(code)))


def locate_trace(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``lines``, ``trace_start``, ``trace_end`` (0-based, -1 when there is no trace).

    Start = first start marker, else first frame.  The region grows over the first run of
    frames after the start; an end marker before that run leaves it empty.
    """
    df = df.withColumn("lines", F.split(F.coalesce(_C(content), F.lit("")), "\n"))
    df = df.withColumn("_kind", F.transform("lines", lambda l: F.when(is_frame(l), F.lit("f")).when(
        _is_end(l), F.lit("e")).otherwise(F.lit("o"))))
    df = df.withColumn("_mark", F.array_position(F.transform("lines", _is_start), True))
    df = df.withColumn("_s", F.when(_C("_mark") > 0, _C("_mark")).otherwise(F.array_position("_kind", "f")))
    df = df.withColumn("_after", F.when(_C("_s") > 0, F.slice("_kind", _C("_s").cast("int") + 1, F.size("lines")))
                       .otherwise(_empty()))
    df = df.withColumn("_f", F.array_position("_after", "f")).withColumn("_e", F.array_position("_after", "e"))
    has_run = (_C("_f") > 0) & ((_C("_e") == 0) | (_C("_f") < _C("_e")))
    df = df.withColumn("_run", F.when(has_run, F.transform(
        F.slice("_after", _C("_f").cast("int"), F.size("lines")), lambda k: k == "f")))
    gap = F.array_position("_run", False)
    run_len = F.when(gap > 0, gap - 1).otherwise(F.size("_run"))
    end = F.when(_C("_s") == 0, F.lit(-1)).when(has_run, _C("_s") - 1 + _C("_f") + run_len - 1).otherwise(_C("_s") - 1)
    return (df.withColumn("trace_start", (_C("_s") - 1).cast("int")).withColumn("trace_end", end.cast("int"))
            .drop("_kind", "_mark", "_s", "_after", "_f", "_e", "_run"))


def call_trace(df: DataFrame) -> DataFrame:
    """Stripped frames inside the bounds."""
    region = F.slice("lines", _C("trace_start") + 1, _C("trace_end") - _C("trace_start") + 1)
    frames = F.filter(F.transform(region, tf.strip), is_frame)
    return df.withColumn("call_trace", F.when(_C("trace_start") >= 0, frames).otherwise(_empty()))


def trace_region(df: DataFrame, context: int = 2) -> DataFrame:
    """The trace with ``context`` lines on both sides, as text."""
    lo = F.greatest(F.lit(0), _C("trace_start") - context)
    hi = F.least(F.size("lines"), _C("trace_end") + context + 1)
    return df.withColumn("trace_region", F.when(_C("trace_start") >= 0, F.array_join(
        F.slice("lines", lo + 1, hi - lo), "\n")).otherwise(F.lit("")))


# A lower-case piece every match of the pattern must contain: a cheap test before the regex.
_ANCHORS = {
    "kernel_panic": "not syncing:", "kernel_bug": "bug", "kernel_oops": "oops:",
    "general_protection": "general protection fault:", "null_pointer_deref": "unable to handle kernel",
    "kasan_uaf": "use-after-free in", "kasan_double_free": "invalid free in", "kasan_oob": "-out-of-bounds",
    "list_corruption": "corruption", "hardlockup": "hard lockup", "softlockup": "soft lockup",
    "hungtask": "blocked for more than", "rcu_stall": "rcu_", "refcount_underflow": "refcount_t", "bug_on": "kernel bug at",
    "warning": "warning:", "machine_check": "machine check exception", "divide_error": "divide error:",
    "ubsan": "ubsan:", "bad_mode": "bad mode in", "alignment_fault": "alignment fault", "irq_storm": "nobody cared",
    "stack_overflow": "stack ",
}


# --- panic facts --------------------------------------------------------------------------------

def panic_info(df: DataFrame) -> DataFrame:
    """panic_type/panic_msg of the first match (line-major, then pattern order), every matched
    pattern with repeats, and per group index the last non-empty capture."""
    arms = []
    for name, pattern, groups in cr.PANIC_PATTERNS:
        p = sq.lit("(?i)" + pattern)
        caps = [f"regexp_extract(x.l, {p}, {g + 1})" if g < groups else "''" for g in range(2)]
        arms.append((f"contains(x.w, {sq.lit(_ANCHORS[name])}) AND x.l RLIKE {p}",
                     f"named_struct('name', {sq.lit(name)}, 'msg', trim(regexp_extract(x.l, {p}, 0)), "
                     f"'g0', {caps[0]}, 'g1', {caps[1]})"))
    screen = sq.any_contains("x.w", sorted(set(_ANCHORS.values())))
    df = df.withColumn("_hits", F.expr(
        "flatten(transform(filter(transform(lines, l -> named_struct('l', l, 'w', lower(l))), "
        f"x -> {screen}), x -> {sq.kept(arms)}))"))

    def last(g: str) -> Column:
        kept = F.filter(F.transform("_hits", lambda h: h[g]), lambda x: x != "")
        return F.when(F.size(kept) > 0, F.element_at(kept, -1))
    first = F.get("_hits", 0)
    entries = F.array_compact(F.array(*[F.when(last(g).isNotNull(), F.struct(
        F.lit(f"group_{i}").alias("k"), last(g).alias("v"))) for i, g in enumerate(("g0", "g1"))]))
    return (df.withColumn("panic_type", F.coalesce(first["name"], F.lit("unknown")))
            .withColumn("panic_msg", F.coalesce(first["msg"], F.lit("")))
            .withColumn("matched_patterns", F.transform("_hits", lambda h: h["name"]))
            .withColumn("panic_details", F.map_from_entries(entries)).drop("_hits"))


def log_hints(df: DataFrame, content: str = "content") -> DataFrame:
    """Keyword subsystem and bug type of the whole log."""
    return df.withColumn("_low", F.lower(_C(content))).withColumns({
        "subsystem": tf.first_group("_low", cr.LOG_SUBSYSTEM_HINTS),
        "bug_type": tf.first_group("_low", cr.LOG_BUG_HINTS, relabel=tf.normalize_bug_label)}).drop("_low")


def kernel_version_in(text: Column) -> Column:
    return F.coalesce(*[tf.extract(text, "(?i)" + p) for p in cr.KERNEL_VERSION_PATTERNS], F.lit(""))


def rip_function_in(text: Column) -> Column:
    return F.regexp_extract(text, "(?i)" + cr.RIP_PATTERN, 1)


def modules_in(text: Column) -> Column:
    return F.when(~F.contains(text, F.lit(": loading out-of-tree module")), _empty()).otherwise(
        F.regexp_extract_all(text, F.lit(cr.MODULE_PATTERN), 1))


def parse_logs(df: DataFrame, content: str = "content") -> DataFrame:
    """Full log parse: trace, panic facts, subsystem, bug type, version, RIP, modules."""
    out = (df.transform(locate_trace, content).transform(call_trace).transform(panic_info)
           .transform(trace_region).transform(log_hints, content))
    text = _C(content)
    return out.withColumns({
        "kernel_version": kernel_version_in(text), "rip_function": rip_function_in(text),
        "modules": modules_in(text)}).drop("lines")


# --- model answers ------------------------------------------------------------------------------

ANSWER_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("subsystem", T.StringType()), ("bug_type", T.StringType()), ("severity", T.StringType()),
    ("root_cause_hypothesis", T.StringType()), ("trigger_function", T.StringType()),
    ("confidence", T.DoubleType()), ("keywords", T.ArrayType(T.StringType())),
    ("fix_type_hints", T.ArrayType(T.StringType()))]])


def parse_model_answer(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Recover, validate and default a model's crash analysis; adds struct ``analysis``."""
    def attempt(t: Column) -> Column:
        return F.when(F.try_parse_json(t).isNotNull(), F.from_json(t, ANSWER_SCHEMA))
    raw = _C(answer)
    df = df.withColumn("_a", F.coalesce(attempt(raw), attempt(F.regexp_extract(raw, r"\{[\s\S]*\}", 0))))
    a = _C("_a")

    def one_of(name: str, valid: list[str], default: str) -> Column:
        return F.when(a[name].isin(valid), a[name]).otherwise(F.lit(default))
    good = F.struct(
        one_of("subsystem", cr.VALID_SUBSYSTEMS, "unknown").alias("subsystem"),
        one_of("bug_type", cr.VALID_BUG_TYPES, "unknown").alias("bug_type"),
        one_of("severity", cr.VALID_SEVERITIES, "medium").alias("severity"),
        F.coalesce(a["root_cause_hypothesis"], F.lit("")).alias("root_cause_hypothesis"),
        F.coalesce(a["trigger_function"], F.lit("")).alias("trigger_function"),
        nf.clamp01(F.coalesce(a["confidence"], F.lit(0.5))).alias("confidence"),
        F.coalesce(a["keywords"], _empty()).alias("keywords"),
        F.filter(F.coalesce(a["fix_type_hints"], _empty()), lambda h: h.isin(cr.VALID_FIX_HINTS)).alias("fix_type_hints"))
    bad = F.struct(
        F.lit("unknown").alias("subsystem"), F.lit("unknown").alias("bug_type"), F.lit("low").alias("severity"),
        F.concat(F.lit("Failed to parse LLM response: "), raw).alias("root_cause_hypothesis"),
        F.lit("").alias("trigger_function"), F.lit(0.1).alias("confidence"), _empty().alias("keywords"),
        _empty().alias("fix_type_hints"))
    return df.withColumn("analysis", F.when(a.isNotNull(), good).otherwise(bad)).drop("_a")


def apply_model_answer(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Confident known answers override the keyword subsystem and bug type."""
    sure = _C("analysis.confidence") >= threshold
    return df.withColumns({n: F.when(sure & (_C(f"analysis.{n}") != "unknown"), _C(f"analysis.{n}"))
                          .otherwise(_C(n)) for n in ("subsystem", "bug_type")})


def fallback_severity(panic: Column) -> Column:
    low = F.lower(panic)
    return (F.when(tf.any_contains(low, ["hard lockup", "machine check", "kernel panic"]), F.lit("critical"))
            .when(tf.any_contains(low, ["use-after-free", "use after free", "double free",
                                        "general protection", "bug:", "null pointer"]), F.lit("high"))
            .otherwise(F.lit("medium")))


# --- trace structure ----------------------------------------------------------------------------

def trace_function_names(trace: Column) -> Column:
    """Function names of frames, without time stamps, addresses, '?' and offsets."""
    def name(line: Column) -> Column:
        x = F.regexp_replace(tf.strip(line), r"^\[\s*[\d]+[\.\d]*\s*\]\s*", "")
        x = F.regexp_replace(x, r"\[\s*<[0-9a-fA-F]+>\s*\]\s*", "")
        return F.regexp_extract(F.ltrim(x, F.lit("? ")), r"^(\w+)\+0x[0-9a-fA-F]+/0x[0-9a-fA-F]+", 1)
    return F.filter(F.transform(trace, name), lambda n: n != "")


def trace_structure(df: DataFrame) -> DataFrame:
    """Lock/memory/RCU/scheduler function sets of the trace, the issue and subsystem they suggest."""
    df = df.withColumn("_t", F.lower(F.array_join("call_trace", "\n")))
    sets = {"lock_functions": cr.LOCK_TRACE_FUNCTIONS, "memory_functions": cr.MEMORY_TRACE_FUNCTIONS,
            "rcu_functions": cr.RCU_TRACE_FUNCTIONS, "sched_functions": cr.SCHED_TRACE_FUNCTIONS}
    df = df.withColumns({n: tf.matching_words("_t", w) for n, w in sets.items()})
    has = {n: F.size(n) > 0 for n in sets}
    issue = (F.when(has["lock_functions"] & has["sched_functions"], F.lit("deadlock_or_lock_contention"))
             .when(has["lock_functions"], F.lit("possible_lock_issue"))
             .when(has["rcu_functions"], F.lit("rcu_related")).when(has["memory_functions"], F.lit("memory_related"))
             .when(has["sched_functions"], F.lit("scheduling_related")).otherwise(F.lit("unknown")))
    return (df.withColumn("inferred_issue", issue)
            .withColumn("involved_subsystem", tf.first_group("_t", cr.TRACE_SUBSYSTEM_HINTS)).drop("_t"))


# --- expert rules -------------------------------------------------------------------------------

def match_rules(df: DataFrame, rules: list = cr.EXPERT_RULES) -> DataFrame:
    """Best expert rule: .95 panic pattern, .85 panic keyword, .70 trace keyword.

    All rules are evaluated in one projection; table order breaks score ties.  The combined-text
    level (.60) only differs for keywords that span the panic/trace boundary.
    """
    df = df.withColumns({"_p": F.lower(F.coalesce(_C("panic_msg"), F.lit(""))),
                         "_t": F.lower(F.array_join("call_trace", "\n"))})
    arms = []
    for i, (rid, _, _, _, keywords, patterns, _, _) in enumerate(rules):
        spanning = [k for k in keywords if "\n" in k]
        levels = [(0.95, "panic_pattern", [(p, sq.anchored("panic_msg", "_p", p)) for p in patterns]),
                  (0.85, "panic_keyword", [(k, f"contains(_p, {sq.lit(k.lower())})") for k in keywords]),
                  (0.70, "trace_keyword", [(k, f"contains(_t, {sq.lit(k.lower())})") for k in keywords]),
                  (0.60, "combined_keyword", [(k, f"contains(concat(_p, '\n', _t), {sq.lit(k.lower())})") for k in spanning])]
        arms += [(-level, i, cond, f"named_struct('score', {level}D, 'id', {sq.lit(rid)}, 'how', {sq.lit(f'{kind}:{v}')})")
                 for level, kind, tests in levels for v, cond in tests]
    # best level first, then table order: the first that holds is the best, and no later one is tried
    best = F.expr(sq.first_of([(cond, value) for *_, cond, value in sorted(arms, key=lambda a: a[:2])], "NULL"))
    return (df.withColumn("_best", best).withColumn("rule_id", _C("_best.id"))
            .withColumn("rule_score", _C("_best.score")).withColumn("rule_match", _C("_best.how"))
            .drop("_p", "_t", "_best"))


def symptom_matches(df: DataFrame, text: str, out: str = "symptoms") -> DataFrame:
    """Knowledge symptoms: array of struct(score, o, bug_type, name), best first.

    A symptom counts when at least half of its words occur in the text; a pattern's score is the
    number of matched words over its counting symptoms.
    """
    words = sorted({t for p in kn.BUG_PATTERNS.values() for s in p["symptoms"] for t in s.lower().split()})
    place = {w: (f"_has{i // 60}", i % 60) for i, w in enumerate(words)}
    # every word is looked for once, into a bit (one lambda over a constant list); a symptom's words are then counted by its bits
    masks = {f"_has{lo // 60}": F.expr(f"aggregate({sq.arr([sq.lit(w) for w in words[lo:lo + 60][::-1]])}, 0L, (m, w) -> shiftleft(m, 1) + if(contains(_low, w), 1L, 0L))")
             for lo in range(0, len(words), 60)}

    def hits(tokens: list[str]) -> str:
        bits: dict[tuple[int, str], int] = {}
        for t in set(tokens):
            column, bit = place[t]
            for nth in range(tokens.count(t)):  # a word that stands twice counts twice
                bits[nth, column] = bits.get((nth, column), 0) | 1 << bit
        return "(" + " + ".join(f"bit_count({column} & {m}L)" for (_, column), m in sorted(bits.items())) + ")"
    rows = []
    for i, (bug, p) in enumerate(kn.BUG_PATTERNS.items()):
        parts = []
        for symptom in p["symptoms"]:
            tokens = symptom.lower().split()
            n = hits(tokens)
            parts.append(f"CASE WHEN {n} >= {len(tokens) * 0.5}D THEN {n} ELSE 0 END")
        rows.append(f"named_struct('score', {' + '.join(parts)}, 'o', {-i}, 'bug_type', {sq.lit(bug)}, "
                    f"'name', {sq.lit(p['name'])})")
    found = f"sort_array(filter({sq.arr(rows)}, s -> s.score > 0), false)"
    return df.withColumn("_low", F.lower(_C(text))).withColumns(masks).withColumn(out, F.expr(found)).drop("_low", *masks)


def symptom_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each symptom match: (key, place from 1, bug_type, score).

    The explode is an outer one: for an inner one Spark filters the rows by the list's size first, below the masks, with all their word searches
    written out wherever a symptom reads one.
    """
    found = df.select(key, text).transform(symptom_matches, text).select(key, F.posexplode_outer("symptoms"))
    return found.where("pos IS NOT NULL").select(key, (_C("pos") + 1).alias("place"), "col.bug_type", "col.score")


def fix_flags(bug_type: Column, panic: Column) -> dict[str, Column]:
    """needs_* flags of a bug type with trace and panic additions (reads the trace set columns)."""
    low = F.lower(panic)
    kfree = F.exists("memory_functions", lambda f: F.contains(f, F.lit("kfree")))
    extra = {"needs_lock_fix": F.size("lock_functions") > 0, "needs_rcu_fix": F.size("rcu_functions") > 0, "needs_refcount_fix": kfree,
             "needs_null_check": F.contains(low, F.lit("null pointer")),
             "needs_bound_check": F.contains(low, F.lit("out of bound")) | F.contains(low, F.lit("overflow"))}
    return {k: bug_type.isin([b for b, (f, _) in cr.FIX_HINTS.items() if k in f]) | extra[k] for k in extra}


def fix_keywords(bug_type: Column) -> Column:
    """Suggested search keywords, sorted (the source of truth is an unordered set)."""
    table = F.expr(sq.map_of({b: k for b, (_, k) in cr.FIX_HINTS.items()}))
    base = F.coalesce(F.try_element_at(table, bug_type), _empty())
    joined = F.array_join(base, "|")
    lock = F.when((F.size("lock_functions") > 0) & ~F.contains(joined, F.lit("spin_lock")),
                  F.array(F.lit("spin_lock"), F.lit("mutex_lock"))).otherwise(_empty())
    with_lock = F.concat(base, lock)
    rcu = F.when((F.size("rcu_functions") > 0) & ~F.contains(F.array_join(with_lock, "|"), F.lit("rcu")),
                 F.array(F.lit("kfree_rcu"))).otherwise(_empty())
    return F.sort_array(F.array_distinct(F.concat(with_lock, rcu)))


def infer_fixes(df: DataFrame, bug_type: str = "bug_type") -> DataFrame:
    flags = fix_flags(_C(bug_type), _C("panic_msg"))
    return (df.withColumns(flags)
            .withColumn("search_keywords", fix_keywords(_C(bug_type))))


def confirm_fixes(df: DataFrame) -> DataFrame:
    """Fixes seen in a commit's diff confirm the inferred ones: flags are set and their search words join (sorted, once)."""
    seen = {"lock": _C("lock_added"), "refcount": _C("refcount_fix"), "rcu": _C("rcu_fix")}
    words = [F.when(c, F.array(*[F.lit(w) for w in kn.DIFF_EVIDENCE_WORDS[k]])).otherwise(_empty()) for k, c in seen.items()]
    return df.withColumns({**{f"needs_{k}_fix": _C(f"needs_{k}_fix") | c for k, c in seen.items()},
                           "search_keywords": F.sort_array(F.array_distinct(F.concat("search_keywords", *words)))})


def retrieval_query(df: DataFrame) -> DataFrame:
    """Labelled query text of a diagnosed crash (mirrors the commit embedding text)."""
    known = lambda c: F.when(F.coalesce(_C(c), F.lit("unknown")).isin("unknown", "") == F.lit(False), _C(c))
    key = F.array_distinct(F.concat(trace_function_names(_C("call_trace")), "lock_functions", "memory_functions", "rcu_functions"))
    fixes = F.array_compact(F.array(*[F.when(_C(k), F.lit(s)) for k, s in cr.FIX_SENTENCES]))
    parts = [F.concat(F.lit("RootCause: "), _C("root_cause")),
             F.concat(F.lit("BugType: "), F.translate(known("cause_bug_type"), "_", " ")),
             F.concat(F.lit("Subsystem: "), known("subsystem")),
             F.concat(F.lit("KernelVersion: "), tf.non_empty(_C("kernel_version"))),
             F.concat(F.lit("PanicInfo: "), tf.non_empty(_C("panic_msg"))),
             F.when(F.size(key) > 0, F.concat(F.lit("KeyFunctions: "), F.array_join(key, ", "))),
             F.concat(F.lit("CrashFunction: "), tf.non_empty(_C("rip_function"))),
             F.when(F.size(fixes) > 0, F.concat(F.lit("FixPattern: commit that "), F.array_join(fixes, "; "))),
             F.when(F.size("causal_chain") > 0, F.concat(
                 F.lit("CausalChain: "), F.array_join("causal_chain", " -> ")))]
    return df.withColumn("retrieval_query", F.concat_ws("\n", *parts))


def _layer(found: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in found.items()])


def analyze_root_cause(df: DataFrame) -> DataFrame:
    """Layered root cause of parsed crashes: rules, trace structure, knowledge, bug type, panic words."""
    df = df.transform(trace_structure)
    df = df.withColumn("subsystem", F.when((_C("subsystem") == "unknown") & (_C("involved_subsystem") != "unknown"),
                                           _C("involved_subsystem")).otherwise(_C("subsystem")))
    df = df.transform(match_rules)
    df = df.transform(symptom_matches, "panic_msg")
    df = df.transform(graph.lock_usage).withColumn("related_subsystems", graph.related_subsystems(_C("subsystem")))

    by_rule = {r[0]: r for r in cr.EXPERT_RULES}
    sev = {rid: f"Severity: {cr.SEVERITY_TEXT.get(r[3], 'Unknown')}" for rid, r in by_rule.items()}
    rule_layer = F.when(_C("rule_id").isNotNull(), _layer({
        "name": tf.lookup(_C("rule_id"), {k: r[1] for k, r in by_rule.items()}),
        "bug": tf.lookup(_C("rule_id"), {k: r[2] for k, r in by_rule.items()}),
        "score": _C("rule_score"), "reason": tf.lookup(_C("rule_id"), {k: r[7] for k, r in by_rule.items()}),
        "chain": F.array(F.concat(F.lit("Expert Rule: "), _C("rule_id"), F.lit(" ("), _C("rule_match"), F.lit(")")),
                         tf.lookup(_C("rule_id"), sev))}))

    def in_trace(label: str, col: str) -> Column:
        return F.when(F.size(col) > 0, F.concat(F.lit(label), F.array_join(col, ", ")))

    def score_of(key: Column, table: dict) -> Column:
        return F.try_element_at(F.expr(sq.map_of({k: float(v[2]) for k, v in table.items()})), key)
    issue = _C("inferred_issue")
    issue_name = tf.lookup(issue, {k: v[0] for k, v in cr.TRACE_ISSUES.items()})
    trace_layer = F.when(issue != "unknown", _layer({
        "name": issue_name, "bug": issue, "score": score_of(issue, cr.TRACE_ISSUES),
        "reason": tf.lookup(issue, {k: v[1] for k, v in cr.TRACE_ISSUES.items()}),
        "chain": F.array_compact(F.array(
            F.concat(F.lit("Trace Structure: "), issue_name),
            in_trace("Lock Functions in trace: ", "lock_functions"),
            in_trace("Memory Functions in trace: ", "memory_functions"),
            in_trace("RCU Functions in trace: ", "rcu_functions")))}))
    top = F.get("symptoms", 0)
    knows = F.size("symptoms") > 0
    know_layer = F.when(knows, _layer({
        "name": top["name"], "bug": top["bug_type"], "score": F.least(F.lit(0.90), top["score"] * 0.2 + 0.6),
        "reason": F.concat(F.lit(say.KNOWN), top["name"], F.lit(say.KNOWN_END)),
        "chain": F.array(F.concat(F.lit("Knowledge Base: "), top["name"], F.lit(" (score="),
                                  top["score"].cast("string"), F.lit(")")))}))
    bug = _C("bug_type")
    bug_layer = F.when(bug.isin(list(cr.BUG_ABSTRACTIONS)), _layer({
        "name": tf.lookup(bug, {k: v[0] for k, v in cr.BUG_ABSTRACTIONS.items()}), "bug": bug,
        "score": score_of(bug, cr.BUG_ABSTRACTIONS),
        "reason": tf.lookup(bug, {k: v[1] for k, v in cr.BUG_ABSTRACTIONS.items()}),
        "chain": F.array(F.concat(F.lit("Bug Type: "), bug))}))
    hint_layer = None
    for pattern, name, reason, score in cr.PANIC_HINTS:
        value = _layer({"name": F.lit(name), "bug": bug, "score": F.lit(score), "reason": F.lit(reason),
                        "chain": F.array(F.lit(f"Panic Keyword: {name}"))})
        cond = F.lower(_C("panic_msg")).rlike(pattern)
        hint_layer = F.when(cond, value) if hint_layer is None else hint_layer.when(cond, value)
    unknown_layer = _layer({
        "name": F.lit(cr.UNKNOWN_CAUSE[0]), "bug": F.when(bug != "unknown", bug).otherwise(F.lit("crash")),
        "score": F.lit(cr.UNKNOWN_CAUSE[2]), "reason": F.lit(cr.UNKNOWN_CAUSE[1]),
        "chain": F.array(F.lit("Insufficient information for root cause determination"))})

    df = df.withColumn("_early", F.coalesce(rule_layer, trace_layer))
    df = df.withColumn("_cause", F.coalesce(_C("_early"), know_layer))
    df = df.withColumn("_late", F.when(_C("_cause").isNull(), F.coalesce(bug_layer, hint_layer, unknown_layer)))
    df = df.withColumn("_final", F.coalesce(_C("_cause"), _C("_late")))
    related = F.when((_C("subsystem") != "unknown") & (F.size("related_subsystems") > 1), F.concat(
        F.lit("Related Subsystems: "), F.array_join("related_subsystems", ", ")))
    none = _empty()
    chain = F.concat(
        F.coalesce(_C("_cause.chain"), none),
        F.when(F.size("call_trace") > 0, F.transform("lock_issues", lambda i: F.concat(F.lit("Lock Issue: "), i)))
        .otherwise(none),
        F.array_compact(F.array(related)), F.coalesce(_C("_late.chain"), none))
    df = df.withColumn("_chain", chain)
    affected = F.when((_C("subsystem") != "unknown") & ~F.exists("_chain", lambda c: F.contains(c, F.lit("Subsystem"))),
                      F.concat(F.lit("Affected Subsystem: "), _C("subsystem")))
    tail = F.array_compact(F.array(
        affected, F.concat(F.lit("Kernel Version: "), tf.non_empty(_C("kernel_version"))),
        F.when(F.size("modules") > 0, F.concat(F.lit("Loaded Modules: "), F.array_join("modules", ", ")))))
    df = df.withColumns({
        "root_cause": _C("_final.name"), "cause_bug_type": _C("_final.bug"), "reason": _C("_final.reason"),
        # a knowledge hit confirms an already found cause
        "score": F.when(_C("_early").isNotNull() & knows, F.greatest(_C("_final.score"), F.lit(0.85)))
        .otherwise(_C("_final.score")),
        "causal_chain": F.concat(_C("_chain"), tail)})
    df = df.drop("_early", "_cause", "_late", "_final", "_chain")
    df = df.transform(infer_fixes, "cause_bug_type").transform(retrieval_query)
    return df.withColumn("log_bug_type", bug).withColumn("bug_type", tf.normalize_bug_type(_C("cause_bug_type")))


# --- evidence -----------------------------------------------------------------------------------

def root_cause_evidence(df: DataFrame) -> DataFrame:
    msg = F.coalesce(_C("panic_msg"), F.lit(""))
    label = None
    for name, patterns in cr.PANIC_LABELS:
        cond = tf.any_rlike(msg, patterns, ignore_case=True)
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    return df.withColumns({
        "panic_keyword": label, "fault_address": tf.extract(msg, cr.FAULT_ADDRESS_PATTERN),
        "error_code": tf.extract(msg, cr.ERROR_CODE_PATTERN, 0),
        "matched_rule_name": tf.lookup(_C("rule_id"), {r[0]: r[1] for r in cr.EXPERT_RULES}),
        "trace_functions": _C("call_trace")})


def possible_causes(bug_type: Column, subsystem: Column, trace: Column) -> Column:
    table = F.expr(sq.map_of(cr.POSSIBLE_CAUSES))
    base = F.coalesce(F.try_element_at(table, tf.normalize_bug_type(bug_type)),
                      F.array(*[F.lit(c) for c in cr.POSSIBLE_CAUSES_DEFAULT]))
    context = F.array_compact(F.array(tf.lookup(subsystem, cr.SUBSYSTEM_CONTEXTS)))
    names = F.array_join(F.transform(trace, lambda f: F.substring_index(f, "+", 1)), ", ")
    head, tail = cr.CAUSE_TRACE_FORMAT.split("{funcs}")
    via = F.when(F.size(trace) > 0, F.array(F.concat(F.lit(head), names, F.lit(tail)))).otherwise(_empty())
    return F.concat(context, base, via)


def confidence_breakdown(df: DataFrame, history: Column | None = None) -> DataFrame:
    """Percentage shares of the confidence; rule_match takes the remainder."""
    total = F.round(_C("score") * 100, 1)
    hist = history if history is not None else F.lit(0.0)
    msg = F.lower(F.coalesce(_C("panic_msg"), F.lit("")))
    rule = _C("rule_id").isNotNull()
    addr = tf.any_contains(msg, ["virtual address", "at 0x"])

    def share(cond: Column, with_rule: float, without: float, base: Column = total) -> Column:
        return F.when(cond, F.round(base * F.when(rule, with_rule).otherwise(without), 1)).otherwise(0.0)
    fault = share(addr, 0.18, 0.20)
    sub = share(F.coalesce(_C("subsystem"), F.lit("unknown")).isin("unknown", "") == F.lit(False), 0.10, 0.15)
    trace = share(F.size("call_trace") > 0, 0.10, 0.20)
    past = share(hist > 0, 0.12, 0.20, hist * 100)
    return df.withColumns({
        "pct_fault": fault, "pct_subsystem": sub, "pct_trace": trace, "pct_history": past,
        "pct_register": F.lit(0.0),
        "pct_rule": F.round(F.greatest(F.lit(0.0), total - (fault + sub + trace + past)), 1)})


def evidence_coverage(df: DataFrame, has_patches: Column) -> DataFrame:
    """Weighted share of available evidence items and the reliability grade."""
    known = F.coalesce(_C("subsystem"), F.lit("unknown")).isin("unknown", "") == F.lit(False)
    have = {"Panic Keyword": F.coalesce(_C("panic_msg"), F.lit("")) != "", "Fault Address": _C("fault_address").isNotNull(),
            "Call Trace": F.size("call_trace") > 0, "Kernel Version": F.coalesce(_C("kernel_version"), F.lit("")) != "",
            "Error Code": _C("error_code").isNotNull(), "Subsystem": known, "Loaded Modules": F.lit(False),
            "Commit Diff": has_patches, "Expert Rule": _C("rule_id").isNotNull()}
    got = reduce(lambda a, b: a + b, [F.when(have[n], w).otherwise(0) for n, w in cr.COVERAGE_ITEMS])
    missing = F.array_compact(F.array(*[F.when(~have[n], F.lit(n)) for n, w in cr.COVERAGE_ITEMS if w == 3]))
    pct = F.round(got / sum(w for _, w in cr.COVERAGE_ITEMS) * 100, 1)
    n = F.size("missing_high")
    return (df.withColumn("missing_high", missing).withColumn("coverage_pct", pct)
            .withColumn("reliability", F.when((_C("coverage_pct") >= 75) & (n == 0), F.lit("High"))
                        .when((_C("coverage_pct") >= 50) & (n <= 1), F.lit("Medium")).otherwise(F.lit("Low"))))


def hybrid_root_cause(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Merge a rule diagnosis with a model diagnosis (struct ``llm``; null = model unavailable)."""
    llm = _C("llm")
    primary = (F.when(llm.isNull(), F.lit("rule_only (llm failed)"))
               .when(_C("score") >= threshold, F.lit("hybrid_rule_primary")).otherwise(F.lit("hybrid_llm_primary")))
    model_first = primary == "hybrid_llm_primary"
    steps = F.coalesce(llm["causal_chain"], _empty())
    extra = F.transform(F.array_except(steps, _C("causal_chain")), lambda s: F.concat(F.lit("[LLM] "), s))
    chain = (F.when(llm.isNull(), _C("causal_chain")).when(~model_first, F.concat("causal_chain", extra))
             .when(F.size(steps) > 0, steps).otherwise(_C("causal_chain")))

    def over(name: str, cond: Column) -> Column:
        return F.when(model_first & F.coalesce(cond, F.lit(False)), llm[name]).otherwise(_C(name))
    has = lambda n: F.coalesce(llm[n], F.lit("")) != ""
    return df.withColumns({
        "analysis_source": primary, "causal_chain": chain, "root_cause": over("root_cause", has("root_cause")),
        "bug_type": over("bug_type", has("bug_type") & (llm["bug_type"] != "unknown")),
        "score": over("score", llm["score"] > _C("score")), "reason": over("reason", has("reason")),
        "retrieval_query": F.when(has("retrieval_query") & (model_first | (_C("retrieval_query") == "")),
                                  llm["retrieval_query"]).otherwise(_C("retrieval_query"))})


# --- memory dumps -------------------------------------------------------------------------------

def infer_from_dump(df: DataFrame, trace: str = "dump_trace") -> DataFrame:
    """Bug type, subsystem and confidence suggested by a memory dump's stack."""
    df = df.withColumn("_t", F.lower(F.array_join(trace, "\n")))
    lock, mem = tf.any_contains("_t", cr.DUMP_LOCK_FUNCTIONS), tf.any_contains("_t", cr.DUMP_MEMORY_FUNCTIONS)
    return df.withColumns({
        "dump_bug_type": F.when(lock, F.lit("deadlock")).when(mem, F.lit("memory_corruption")).otherwise(F.lit("unknown")),
        "dump_confidence": F.when(lock, 0.6).when(mem, 0.5).otherwise(0.0),
        "dump_subsystem": tf.first_group("_t", cr.DUMP_SUBSYSTEM_HINTS)}).drop("_t")


def fuse_features(dump: DataFrame, log: DataFrame, key: str = "crash_id") -> DataFrame:
    """Dump features win except for the panic message; modules are united (sorted).

    A full outer join on the crash key: both sides shuffle once on a unique key.
    """
    j = dump.join(log, key, "full_outer")

    def first(a: str, b: str, empty: str) -> Column:
        ok = lambda c: F.when(F.coalesce(_C(c), F.lit(empty)) != empty, _C(c))
        return F.coalesce(ok(a), ok(b), F.lit(empty))
    trace = F.when(F.size(F.coalesce(_C("dump_trace"), _empty())) > 0, _C("dump_trace")).otherwise(
        F.coalesce(_C("call_trace"), _empty()))
    return j.select(
        key, first("dump_subsystem", "subsystem", "unknown").alias("subsystem"),
        first("dump_bug_type", "bug_type", "unknown").alias("bug_type"), trace.alias("call_trace"),
        first("panic_msg", "dump_panic", "").alias("panic_msg"),
        first("dump_version", "kernel_version", "").alias("kernel_version"),
        F.sort_array(F.array_union(F.coalesce(_C("dump_modules"), _empty()), F.coalesce(_C("modules"), _empty())))
        .alias("modules"))


def panic_class(panic: Column) -> Column:
    low = F.lower(F.coalesce(panic, F.lit("")))
    needle, sub, default = cr.PANIC_CLASS_PANIC
    out = F
    for words, label in sub:
        out = out.when(F.contains(low, F.lit(needle)) & tf.any_contains(low, words), F.lit(label))
    out = out.when(F.contains(low, F.lit(needle)), F.lit(default))
    for words, label in cr.PANIC_CLASSES:
        out = out.when(tf.any_contains(low, words), F.lit(label))
    return out.otherwise(F.lit("Unknown"))


def rule_catalog(spark) -> DataFrame:
    """The expert rules as a table (the caller may extend and pass its own list)."""
    rows = [(i, r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for i, r in enumerate(cr.EXPERT_RULES)]
    return spark.createDataFrame(rows, "ord int, rule_id string, name string, bug_type string, severity int, "
                                       "keywords array<string>, panic_patterns array<string>, "
                                       "related_subsystems array<string>")
