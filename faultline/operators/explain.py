"""Patch explanations, comparison tables and diagnosis reports (rows in, rows out)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numeric as nf, text as tf
from ..rules import texts as say
from ..rules.knowledge import DISPLAY_WEIGHTS, PATCH_REASONS
from . import crashes

_C = F.col


def first_ranks(df: DataFrame, top: int | None) -> DataFrame:
    return df if top is None else df.where(_C("rank") <= top)


def patch_explanations(df: DataFrame, top: int | None = None) -> DataFrame:
    """Fix target, fix method, affected folders and match reasons of each query's patches (``top``: the first ones).

    Reads rank, subject, subsystem, bug_type, functions, files_changed, fix_tags, evidence flags,
    crash_subsystem, crash_bug_type and crash_trace.
    """
    tags = F.lower(F.array_join("fix_tags", " "))
    from_subject = F.when(F.contains("subject", F.lit(":")), tf.extract(_C("subject"), r"(\w+)\s*\(\)"))
    target = F.coalesce(tf.non_empty(F.get("functions", 0)), from_subject, F.lit(""))
    flags = F.array_compact(F.array(F.when(_C("lock_added"), F.lit("add_lock")),
                                    F.when(_C("refcount_fix"), F.lit("fix_refcount")),
                                    F.when(_C("rcu_fix"), F.lit("add_rcu_sync"))))
    by_tag = F.array_compact(F.array(
        F.when(F.contains(tags, F.lit("null")), F.lit("NULL check")),
        F.when(tf.any_contains(tags, ["overflow", "bound"]), F.lit("bound check")),
        F.when(F.contains(tags, F.lit("leak")), F.lit("fix leak"))))
    method = F.array_join(F.when(F.size(flags) > 0, flags).otherwise(by_tag), ", ")
    folders = F.array_sort(F.array_distinct(F.transform(
        F.filter("files_changed", lambda f: F.contains(f, F.lit("/"))), lambda f: F.substring_index(f, "/", 1))))
    trace = F.lower(F.array_join("crash_trace", "\n"))
    shared = F.sort_array(F.array_distinct(F.filter(
        "functions", lambda f: (F.length(f) > 3) & F.contains(trace, F.lower(f)))))
    reasons = F.array_compact(F.array(
        F.when((_C("subsystem") != "unknown") & (_C("subsystem") == _C("crash_subsystem")), F.lit("same subsystem")),
        F.when((_C("bug_type") != "unknown") & (_C("bug_type") == _C("crash_bug_type")), F.lit("same bug")),
        F.when(F.size(shared) > 0, F.concat(F.lit("same path: "), F.array_join(shared, ", "))),
        F.when(F.exists("fix_tags", lambda t: F.contains(F.lower(t), F.lit("stable"))), F.lit("Cc: stable"))))
    unknown = lambda c: F.when(c != "", c).otherwise(F.lit("unknown"))
    return first_ranks(df, top).withColumns({
        "fix_target": target, "fix_method": unknown(method),
        "affected_path": unknown(F.array_join(folders, ", ")), "reasons": reasons})


def rank_reasons(df: DataFrame) -> DataFrame:
    """Adds ``rank_reasons``: why a patch stands where it does, from its labels and match reasons."""
    same = lambda a, b: (_C(a) != "unknown") & (_C(a) == _C(b))
    found = lambda word: F.exists("reasons", lambda r: F.contains(r, F.lit(word)))
    sub, bug, path, stable = PATCH_REASONS
    return df.withColumn("rank_reasons", F.array_compact(F.array(
        F.when(same("subsystem", "crash_subsystem"), F.concat("subsystem", F.lit(sub))),
        F.when(same("bug_type", "crash_bug_type"), F.concat("bug_type", F.lit(bug))),
        F.when(found("same path"), F.lit(path)), F.when(found("stable"), F.lit(stable)))))


def evidence_table(crash_df: DataFrame, best: DataFrame, key: str = "crash_id") -> DataFrame:
    """(key, ord, field, value, status): what is known of a crash and its best patch (rank 1 of ``best``, at most one a crash)."""
    top = best.where("rank = 1").select(_C("query_id").alias(key), _C("vector_score").alias("_v"), _C("reranker_score").alias("_r"))
    text = lambda c: tf.non_empty(F.coalesce(c, F.lit("")))
    fields = [("Rule Match", F.coalesce(_C("rule_id"), F.lit("unknown"))), ("Bug Type", _C("bug_type")), ("Subsystem", _C("subsystem")),
              ("Embedding Score", F.format_number("_v", 2)), ("Rerank Score", F.format_number("_r", 3)),
              ("Call Trace", text(F.array_join("call_trace", ", "))), ("Kernel Version", text(_C("kernel_version")))]
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("field"), v.alias("value")) for i, (n, v) in enumerate(fields)])
    return crash_df.join(top, key, "left").select(key, F.explode(rows).alias("e")).select(
        key, "e.ord", "e.field", F.coalesce("e.value", F.lit("N/A")).alias("value"),
        F.when(_C("e.value").isNull(), F.lit("Unavailable")).otherwise(F.lit("Available")).alias("status"))


def patch_comparison(df: DataFrame, top: int) -> DataFrame:
    """One row per query and dimension, one column per rank (Top1..TopN, as many as the caller wants to see)."""
    dims = [(say.DIM_SUBSYSTEM, _C("subsystem")), (say.DIM_BUG_TYPE, _C("bug_type")),
            ("Embedding", F.format_number("vector_score", 3)), ("Rerank", F.format_number("reranker_score", 3)),
            (say.DIM_FIX, _C("fix_method")), (say.DIM_VERSION, F.coalesce("kernel_version", F.lit(""))),
            (say.DIM_REASONS, F.when(F.size("reasons") > 0, F.array_join("reasons", "; ")).otherwise(F.lit(say.NOTHING)))]
    cells = df.select("query_id", "rank", F.explode(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(n).alias("dimension"), v.alias("value")) for i, (n, v) in enumerate(dims)])
    ).alias("c")).select("query_id", "rank", "c.*")
    return cells.groupBy("query_id", "ord", "dimension").agg(*[
        F.max(F.when(_C("rank") == r, _C("value"))).alias(f"top{r}") for r in range(1, top + 1)])


def evidence_summary(df: DataFrame, top: int | None = None) -> DataFrame:
    """Per query, the crash/patch/common lines of its patches, which are at most the k of the search."""
    funcs = F.array_sort(F.array_distinct(F.flatten(F.transform(
        "crash_trace", lambda f: F.regexp_extract_all(f, F.lit(r"(\w+)\+0x[0-9a-f]+"), 1)))))
    crash = F.when(F.size(funcs) > 0, F.array_join(funcs, ", ")).otherwise(F.lit("unknown"))
    patch = F.coalesce(tf.non_empty(_C("fix_target")), tf.non_empty(F.array_join("functions", ", ")),
                       F.lit("unknown"))
    common = F.when(F.size("reasons") > 0, F.array_join("reasons", "; ")).otherwise(F.lit("N/A"))
    block = F.concat(F.lit("Evidence "), _C("rank").cast("string"), F.lit(":\n  Crash:  "), crash,
                     F.lit("\n  Patch:  "), patch, F.lit(say.COMMON), common, F.lit("\n"))
    rows = first_ranks(df, top).select("query_id", F.struct("rank", block.alias("text")).alias("b"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("b")), lambda b: b["text"]), "\n").alias("evidence_summary"))


def report_scores(df: DataFrame) -> DataFrame:
    """Five report scores per patch; embedding and rerank relative to the query's maximum."""
    w = Window.partitionBy("query_id")
    top_v, top_r = (F.coalesce(F.when(F.max(c).over(w) != 0, F.max(c).over(w)), F.lit(1.0))
                    for c in ("vector_score", "reranker_score"))
    sub = (_C("subsystem") != "unknown") & (_C("subsystem") == _C("crash_subsystem"))
    bug = (_C("bug_type") != "unknown") & (_C("bug_type") == _C("crash_bug_type"))
    n_path = F.size(F.filter("reasons", lambda r: F.contains(r, F.lit("same path"))))
    return df.withColumns({
        "rep_expert": F.round(F.when(sub, 0.6).otherwise(0.0) + F.when(bug, 0.4).otherwise(0.0), 2),
        "rep_embedding": F.round(F.least(_C("vector_score") / top_v, F.lit(1.0)), 2),
        "rep_callstack": F.round(F.least(n_path / 5.0, F.lit(1.0)), 2),
        "rep_functions": F.round(F.least(F.size("functions") / 10.0, F.lit(1.0)), 2),
        "rep_rerank": F.round(F.least(_C("reranker_score") / top_r, F.lit(1.0)), 2)})


def _patch_rows() -> Column:
    return F.transform("patches", lambda p: F.concat(
        F.lit("| "), p["rank"].cast("string"), F.lit(" | `"), p["commit_hash"], F.lit("` | "),
        p["subsystem"], F.lit(" | "), p["bug_type"], F.lit(" | "), F.format_number(p["final_score"], 3), F.lit(" | "),
        p["subject"], F.lit(" |")))


def reports(crash_df: DataFrame, ranked: DataFrame, key: str = "query_id", top: int | None = None) -> DataFrame:
    """Diagnosis report per crash: report columns, JSON and Markdown (``top``: the first patches only)."""
    patches = first_ranks(ranked, top).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        "rank", "commit_hash", "subject", "subsystem", "bug_type", "final_score"))).alias("patches"))
    none = F.array().cast("array<struct<rank:int,commit_hash:string,subject:string,subsystem:string,bug_type:string,final_score:double>>")
    df = crash_df.join(patches, key, "left").withColumn("patches", F.coalesce("patches", none))
    df = df.withColumns({"severity": nf.severity_label(_C("score")), "panic_class": crashes.panic_class(_C("panic_msg"))})
    chain = F.transform("causal_chain", lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c))
    table = F.when(F.size("patches") > 0, F.concat(
        F.lit("| # | Commit | Subsystem | Bug Type | Score | Subject |\n|---|--------|-----------|----------|-------|---------|\n"),
        F.array_join(_patch_rows(), "\n"))).otherwise(F.lit("*(No matching patches found)*"))
    md = F.concat_ws("\n", F.lit("# Kernel Crash Report"), F.concat(F.lit("**Panic Type**: "), _C("panic_class")),
                     F.concat(F.lit("**Severity**: "), _C("severity")), F.concat(F.lit("**Subsystem**: "), _C("subsystem")),
                     F.concat(F.lit("**Root Cause**: "), _C("root_cause")), F.array_join(chain, "\n"), table)
    body = F.struct(key, "panic_class", "severity", "subsystem", "root_cause", "bug_type", "causal_chain",
                    F.round("score", 4).alias("confidence"), _C("patches").alias("recommended_patches"))
    return df.withColumn("report_json", F.to_json(body)).withColumn("report_markdown", md)


_DIMENSIONS = (("Embedding", "embedding"), ("Reranker", "reranker"), ("Expert Rule", "expert_rule"), ("Call Stack", "callstack_match"),
               ("Subsystem", "subsystem_match"), ("Version", "version_match"), ("LLM Judge", "llm_judge"))


def rule_explanation(crash_df: DataFrame, ranked: DataFrame, key: str = "query_id", top: int | None = None) -> DataFrame:
    """Adds ``explanation``: a report from rules and scores alone, for when no model is there; one row per crash.

    ``crash_df`` has the diagnosis and its evidence, ``ranked`` the patches with score breakdown and why-not columns. All patches of a crash are
    listed, or the first ``top``; whole subjects. A crash without patches gets the report that says so.
    """
    num = F.format_number
    scores = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(DISPLAY_WEIGHTS[c])).alias("weight"), _C(f"{c}_score").alias("score"),
                                _C(f"{c}_contribution").alias("part")) for name, c in _DIMENSIONS])
    patch = F.struct("rank", "commit_hash", "subject", "bug_type", "final_score", "rank_reason", "different_aspects", "ranking_reason",
                     F.when(_C("rank") == 1, scores).alias("scores"))
    patches = first_ranks(ranked, top).groupBy(key).agg(F.array_sort(F.collect_list(patch)).alias("_p"))  # at most the k of the search
    df = crash_df.join(patches, key, "left")
    first, second = F.get("_p", 0), F.get("_p", 1)
    say_if = lambda c, *parts: F.when(c, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    lines = lambda *xs: F.concat_ws("\n", *xs)
    there = F.size("call_trace") > 0
    missing = F.array_join(F.array_compact(F.array(F.when(~there, F.lit("Call Trace")), F.when(F.coalesce("kernel_version", F.lit("")) == "", F.lit("Kernel Version")))), ", ")
    yes = F.lit(True)
    table = F.transform("_p", lambda p: F.concat(F.lit("| "), p["rank"].cast("string"), F.lit(" | "), num(p["final_score"], 3), F.lit(" | `"), p["commit_hash"],
                                                 F.lit("` | "), p["subject"], F.lit(" |")))
    parts = F.transform(first["scores"], lambda d: F.concat(F.lit("| "), d["name"], F.lit(" | "), num(d["weight"] * 100, 0), F.lit("% | "), num(d["score"], 3), F.lit(" | "),
                                                            num(d["part"], 3), F.lit(" |")))
    reasons = F.transform("_p", lambda p: lines(
        F.concat(F.lit("**Top"), p["rank"].cast("string"), F.lit("** — "), p["subject"], F.lit("...")), F.concat(F.lit(say.RULES_MATCH), p["rank_reason"]),
        F.when(F.size(p["different_aspects"]) > 0, F.concat(F.lit(say.RULES_DIFFERENCE), F.array_join(p["different_aspects"], "; "))),
        F.concat(F.lit(say.RULES_PLACE), p["ranking_reason"]), F.lit("")))
    gap = first["final_score"] - second["final_score"]
    text = lines(
        F.lit(say.RULES_HEAD), say_if(yes, say.RULES_CAUSE, _C("root_cause")), say_if(yes, say.RULES_SUBSYSTEM, _C("subsystem"), "`"),
        say_if(yes, say.RULES_CONFIDENCE, num(_C("score") * 100, 0), "%"),
        F.lit(say.RULES_EVIDENCE), say_if(_C("panic_keyword").isNotNull(), say.RULES_KEYWORD, _C("panic_keyword")), say_if(_C("fault_address").isNotNull(), say.RULES_ADDRESS, _C("fault_address"), "`"),
        say_if(_C("rule_id").isNotNull(), say.RULES_RULE, _C("rule_id"), " — ", F.coalesce("matched_rule_name", F.lit(""))),
        say_if(there, say.RULES_FUNCTIONS, F.array_join("call_trace", ", ")),
        F.lit(say.RULES_PATCHES), F.array_join(table, "\n"),
        F.lit(say.RULES_SCORES), F.array_join(parts, "\n"), say_if(yes, "| **Total** | — | — | **", num(first["final_score"], 3), "** |"),
        F.lit(say.RULES_REASONS), F.array_join(reasons, "\n"),
        say_if(missing != "", say.RULES_LIMITS, missing, say.RULES_LIMITS_END, missing, say.RULES_LIMITS_CLOSE),
        say_if(yes, say.RULES_DECISION, first["commit_hash"], "` — *", first["subject"], "*"), say_if(yes, say.RULES_WHY, num(first["final_score"], 3), ")"),
        say_if(yes, say.RULES_BY_RULE, F.coalesce("rule_id", F.lit("N/A"))), say_if(yes, say.RULES_KIND, first["bug_type"], say.RULES_KIND_MIDDLE, _C("root_cause"), say.RULES_KIND_END),
        say_if(second.isNotNull() & (gap < 0.01), say.RULES_CLOSE_RACE, num(gap, 4), say.RULES_CLOSE_RACE_END),
        say_if(second.isNotNull() & (gap >= 0.01), say.RULES_CLEAR, num(gap, 4), say.RULES_CLEAR_END),
        F.lit(say.RULES_STEPS), say_if(missing != "", say.RULES_RISK, missing, say.RULES_RISK_END, missing, say.RULES_RISK_CLOSE), F.when(missing == "", F.lit(say.RULES_TRUST)),
        F.lit(say.RULES_SCOPE))
    return df.withColumn("explanation", F.when(F.size("_p") > 0, text).otherwise(F.lit(say.RULES_NONE))).drop("_p")
