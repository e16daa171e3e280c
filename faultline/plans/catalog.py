"""Registered queries: every operator over whole tables, results as plain columns.

Lists are joined with '|' and counts are 64-bit so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import numeric as nf, sqltext as sq, text as tf, versions as vf
from ..operators import aggregates as ag, commits as co, crashes as cx, explain as ex, filters as fl, graph as gr
from ..operators import index as ix, models as md, ranking as rk, vectors as ve, vectorstore as vs
from . import retrieval as rt, views as vw
from .stage import cut, fresh, spread

_C = F.col
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_STAGES: dict[tuple, DataFrame] = {}


def query(name: str):
    def add(fn):
        _QUERIES[name] = fn
        return fn
    return add


def stage(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A written stage table, built once per session and input folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STAGES:
        _STAGES[key] = cut(build())
    return _STAGES[key]


_STORES: dict[tuple, vs.StoredIndex] = {}


def store(spark: SparkSession, sf: str, name: str, rows: DataFrame, metric: str) -> vs.StoredIndex:
    """A stored vector index, built once per session and input folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORES:
        _STORES[key] = rt.store_of(rows, fresh(spark), metric)
    return _STORES[key]


def vector_store(spark, sf) -> vs.StoredIndex:
    return store(spark, sf, "vector", vector_index(spark, sf), "ip")


def text_store(spark, sf) -> vs.StoredIndex:
    return store(spark, sf, "text", text_index(spark, sf), "cosine")


def joined(c) -> Column:
    return F.array_join(c, "|")


def big(c) -> Column:
    c = _C(c) if isinstance(c, str) else c
    return c.cast("bigint")


# --- stages -------------------------------------------------------------------------------------

def analysed(spark, sf) -> DataFrame:
    """Analysed commits with releases; every seventh commit keeps unknown releases."""
    def build():
        df = vw.commits(spark, sf).transform(co.analyze_commits).transform(co.annotate_version)
        hide = _C("doc_id") % 7 == 3
        return df.withColumns({c: F.when(~hide, _C(c)) for c in
                               ("kernel_version", "kernel_version_major", "kernel_version_minor")})
    return stage(spark, sf, "analysed", build)


def caused(spark, sf) -> DataFrame:
    return stage(spark, sf, "caused", lambda: analysed(spark, sf).transform(co.build_root_cause).transform(co.embedding_text))


def parsed(spark, sf) -> DataFrame:
    return stage(spark, sf, "parsed", lambda: vw.crashes(spark, sf).transform(cx.parse_logs))


def diagnosed(spark, sf) -> DataFrame:
    return stage(spark, sf, "diagnosed", lambda: parsed(spark, sf).transform(cx.analyze_root_cause)
                 .transform(cx.root_cause_evidence))


# Targets of the ten label queries, one value per label.
TARGETS = [
    ("query_text", vw.pick("label", [
        "fix null pointer dereference in tcp_sendmsg()", "use-after-free in kmem_cache_alloc", "[mm] [deadlock] fix",
        "memory leak in driver probe", "race condition", "", "soft lockup in rcu_core()", "fs: fix overflow",
        "net: fix double free in netif_rx()", "[kernel] [security] privilege escalation"])),
    ("target_subsystem", vw.pick("label", ["net", "mm", "mm", "drivers", "unknown", "block", "rcu", "fs", "net", "kernel"])),
    ("target_bug_type", vw.pick("label", ["null_pointer", "use_after_free", "unknown", "memory_leak", "race_condition",
                                          "unknown", "unknown", "unknown", "double_free", "unknown"])),
    ("target_version", vw.pick("label", ["5.15.0-91-generic", "6.1.0", "", "4.19", "5.4.0", "bad", "6.8.0-rc1",
                                         "5.10.1", "4.14.2", "6.12.0"])),
    ("rule_id", vw.pick("label", ["R002", "R003", "", "", "R001", "", "R013", "", "R005", ""])),
    ("crash_trace", "CASE label % 3 WHEN 0 THEN {arr}('tcp_sendmsg+0x1/0x2', 'netif_rx+0x3/0x4') "
                    "WHEN 1 THEN {arr}('kmem_cache_alloc+0x8/0x9', 'vfs_write+0x1/0x2', 'rcu_core+0x1/0x9') ELSE {arr}() END"),
]


def label_queries(spark, sf) -> DataFrame:
    def build():
        mean = ve.label_centroids(vw.table(spark, sf, "embeddings"), "label", "embedding", 64)
        cols = [f"{e.replace('{arr}', 'array')} AS {n}" for n, e in TARGETS]
        return mean.selectExpr("CAST(label AS BIGINT) AS query_id", "vec", *cols)
    return stage(spark, sf, "label_queries", build)


def vector_index(spark, sf) -> DataFrame:
    """Given embeddings with the metadata of the commit of the same number."""
    def build():
        meta = analysed(spark, sf).drop("pos", "score", "added_lines", "file_changes").withColumnRenamed("doc_id", "id")
        emb = vw.table(spark, sf, "embeddings").select(_C("vec_id").alias("id"), _C("embedding").alias("vec"), "label")
        # whole commits meet the vectors only where there is a vector
        return emb.join(meta.join(emb.select("id"), "id", "left_semi"), "id", "left").withColumns({
            c: F.coalesce(_C(c), F.lit("unknown")) for c in ("subsystem", "bug_type")})
    return stage(spark, sf, "vector_index", build)


def hits(spark, sf, k=100) -> DataFrame:
    return rt.recall(label_queries(spark, sf).select("query_id", "vec"), vector_index(spark, sf), k, cosine=False)


def ranked(spark, sf, mode=rt.STANDARD) -> DataFrame:
    def build():
        return rt.retrieve(label_queries(spark, sf), vector_index(spark, sf), mode, cosine=False).withColumns({
            "crash_subsystem": _C("target_subsystem"), "crash_bug_type": _C("target_bug_type"),
            "crash_version": _C("target_version")})
    return stage(spark, sf, f"ranked_{mode}", build)


# --- commit side --------------------------------------------------------------------------------

@query("s2_split_message")
def _(spark, sf):
    d = vw.commits(spark, sf).select("doc_id", _C("body").alias("message"))
    return d.transform(co.split_message).select("doc_id", "subject", F.md5("body").alias("body_md5"))


@query("s8_by_author")
def _(spark, sf):
    return co.by_author(vw.commits(spark, sf), "EXAMPLE.org").select("doc_id", "author", "email", "date")


@query("s8_since_date")
def _(spark, sf):
    return co.since_date(vw.commits(spark, sf), "2020-01-01").select("doc_id", "commit_hash", "date")


@query("p1_keywords")
def _(spark, sf):
    return vw.commits(spark, sf).transform(co.extract_keywords).select("doc_id", joined("keywords").alias("keywords"))


@query("p2_fix_tags")
def _(spark, sf):
    return vw.commits(spark, sf).transform(co.extract_fix_tags).select("doc_id", joined("fix_tags").alias("fix_tags"))


@query("p3_functions")
def _(spark, sf):
    return vw.commits(spark, sf).transform(co.extract_functions).select("doc_id", joined("functions").alias("functions"))


@query("p4_subject")
def _(spark, sf):
    return vw.commits(spark, sf).transform(co.parse_subject).select("doc_id", "subject_prefix", "subject_text")


@query("p5_fix_commit")
def _(spark, sf):
    return vw.commits(spark, sf).transform(co.flag_fix_commit).select("doc_id", "is_fix")


@query("p6_subsystem")
def _(spark, sf):
    d = vw.commits(spark, sf).transform(co.detect_subsystem)
    return d.select("doc_id", "subsystem", joined(co.subsystem_hierarchy(_C("subsystem"))).alias("hierarchy"))


@query("p8_guess_subsystem")
def _(spark, sf):
    return vw.commits(spark, sf).transform(co.guess_subsystem, "body").select("doc_id", "guess")


@query("p9_bug_type")
def _(spark, sf):
    d = vw.commits(spark, sf).transform(co.detect_bug_type).transform(co.detect_all_bug_types)
    return d.select("doc_id", "bug_type", joined("bug_types").alias("bug_types"),
                    tf.bug_description(_C("bug_type")).alias("description"), tf.bug_category(_C("bug_type")).alias("category"))


@query("p12_evidence")
def _(spark, sf):
    d = vw.commits(spark, sf).transform(co.added_lines).transform(co.fix_evidence)
    return d.select("doc_id", joined("added_lines").alias("added"), "lock_added", "refcount_fix", "rcu_fix")


@query("p16_score")
def _(spark, sf):
    return analysed(spark, sf).select("doc_id", "subsystem", "bug_type", "score")


@query("p18_simple_text")
def _(spark, sf):
    d = co.embedding_text_routed(analysed(spark, sf), use_root_cause=False)
    return d.select("doc_id", "embedding_text")


@query("p20_diff_rules")
def _(spark, sf):
    d = vw.commits(spark, sf).transform(co.score_diff_rules)
    return d.select("doc_id", "diff_rule", big("diff_score").alias("diff_score"))


@query("p23_root_cause")
def _(spark, sf):
    return caused(spark, sf).select("doc_id", "root_cause", big("severity").alias("severity"), "typical_fix", "fix_pattern",
                                    joined("evidence").alias("evidence"), joined("cves").alias("cves"), "confidence")


@query("p22_message_fallback")
def _(spark, sf):
    d = vw.commits(spark, sf).withColumns({"confidence": F.lit(0.5), "bug_type": F.lit("unknown"), "root_cause": F.lit("none"),
                                           "evidence": F.array().cast("array<string>")})
    return d.transform(co.message_fallback).select("doc_id", "bug_type", "root_cause", "confidence")


@query("p24_embedding_text")
def _(spark, sf):
    return caused(spark, sf).select("doc_id", "embedding_text")


@query("p25_key_lines")
def _(spark, sf):
    return vw.commits(spark, sf).select("doc_id", co.key_diff_lines(_C("diff_content")).alias("key_lines"))


@query("p27_crash_feature")
def _(spark, sf):
    d = analysed(spark, sf).where("commit_hash <> ''").transform(co.to_crash_feature)
    return d.groupBy("subsystem", "bug_type").agg(F.count("*").alias("n"), F.sum(F.length("panic_msg")).alias("chars"))


@query("p29_diff_preview")
def _(spark, sf):
    return analysed(spark, sf).transform(co.diff_preview).select("doc_id", "diff_preview")


@query("p30_json_round_trip")
def _(spark, sf):
    d = analysed(spark, sf).transform(co.metadata_projection)
    schema = "doc_id bigint, commit_hash string, subject string, fix_tags array<string>, score double"
    return co.from_json_row(co.to_json_row(d), schema).withColumn("fix_tags", joined("fix_tags"))


# --- versions -----------------------------------------------------------------------------------

def _order_days(spark, sf) -> DataFrame:
    day = F.date_add(F.to_date("o_orderdate"), 8000).cast("string")
    d = spread(vw.table(spark, sf, "orders")).select("o_orderkey", F.when(_C("o_orderkey") % 50 == 7, "2023-13-45").otherwise(day).alias("day"))
    return d


@query("v1_resolve_version")
def _(spark, sf):
    v = vf.resolve_version(_C("day"))
    return _order_days(spark, sf).withColumn("v", v).select(
        "o_orderkey", big("v.major").alias("major"), big("v.minor").alias("minor"),
        vf.version_string(_C("v.major"), _C("v.minor")).alias("version"))


@query("v3_parse_versions")
def _(spark, sf):
    d = vw.crashes(spark, sf).select("crash_id", cx.kernel_version_in(_C("content")).alias("raw"))
    t = vf.parse_version(vf.normalize_version(_C("raw")))
    return d.select("crash_id", vf.normalize_version(_C("raw")).alias("normalized"), big(t["major"]).alias("major"),
                    big(t["minor"]).alias("minor"), big(vf.compare_versions(F.regexp_replace("raw", "[-+].*", ""), F.lit("5.15.0"))).alias("vs_5_15"))


@query("v6_version_weight")
def _(spark, sf):
    v = vf.resolve_version(_C("day"))
    d = _order_days(spark, sf).withColumn("v", v).withColumn("d", vf.version_distance(_C("v.major"), _C("v.minor"), F.lit(5), F.lit(4)))
    return d.select("o_orderkey", big("d").alias("distance"), F.when(_C("d").isNotNull(), vf.version_weight(_C("d"))).alias("weight"))


@query("v7_date_compatible")
def _(spark, sf):
    c = vf.date_compatible(_C("day"), F.lit(5), F.lit(4), 1)
    return _order_days(spark, sf).select("o_orderkey", F.coalesce(c.cast("string"), F.lit("unknown")).alias("compatible"))


@query("s21_backfill")
def _(spark, sf):
    d = vw.commits(spark, sf).withColumns({
        "kernel_version": F.when(_C("doc_id") % 3 == 0, F.lit("4.4.0")), "kernel_version_major": F.when(_C("doc_id") % 3 == 0, 4),
        "kernel_version_minor": F.when(_C("doc_id") % 3 == 0, 4), "kernel_version_patch": F.when(_C("doc_id") % 3 == 0, 0)})
    return d.transform(co.annotate_version).select("doc_id", "kernel_version", big("kernel_version_minor").alias("minor"))


# --- text utilities -----------------------------------------------------------------------------

@query("u1_text_scalars")
def _(spark, sf):
    d = spread(vw.table(spark, sf, "documents"))
    t = _C("text")
    return d.select("doc_id", tf.truncate_text(t, 200).alias("short"), F.md5(tf.clean_text(t)).alias("clean_md5"),
                    tf.commit_hash_in(t).alias("hash"), joined(tf.emails(t)).alias("emails"),
                    F.sha2(t, 256).alias("sha256"), F.sha1(t).alias("sha1"), F.left(F.md5(t), F.lit(8)).alias("short_hash"))


@query("u4_cve_ids")
def _(spark, sf):
    return vw.commits(spark, sf).select("doc_id", joined(tf.cve_ids(_C("body"))).alias("cves"))


@query("u6_safe_filename")
def _(spark, sf):
    return vw.table(spark, sf, "pages").select("page_id", tf.safe_filename(_C("url"), 30).alias("name"))


@query("u8_numbers")
def _(spark, sf):
    d = vw.table(spark, sf, "lineitem")
    ms = _C("l_extendedprice")
    return d.select("l_orderkey", big("l_linenumber").alias("line"),
                    F.round(nf.safe_divide(_C("l_extendedprice"), _C("l_discount")), 4).alias("ratio"),
                    F.round(nf.sigmoid(_C("l_quantity") / 25 - 1), 8).alias("sig"),
                    F.round(nf.display_score(_C("l_quantity") / 10 - 1), 8).alias("shown"), tf.format_duration(ms * 7 - 8000).alias("took"))


@query("u12_json_and_bool")
def _(spark, sf):
    d = vw.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return d.select("event_id", k.alias("k"), tf.to_bool((k % 3).cast("string")).alias("flag"))


# --- crash side ---------------------------------------------------------------------------------

@query("d2_trace_bounds")
def _(spark, sf):
    d = vw.crashes(spark, sf).transform(cx.locate_trace).transform(cx.call_trace).transform(cx.trace_region)
    return d.select("crash_id", big("trace_start").alias("trace_start"), big("trace_end").alias("trace_end"),
                    joined("call_trace").alias("frames"), "trace_region")


@query("d6_panic_info")
def _(spark, sf):
    return parsed(spark, sf).select("crash_id", "panic_type", "panic_msg", joined("matched_patterns").alias("matched"),
                                    _C("panic_details")["group_0"].alias("g0"), _C("panic_details")["group_1"].alias("g1"))


@query("d11_parse")
def _(spark, sf):
    return parsed(spark, sf).select("crash_id", "subsystem", "bug_type", "kernel_version", "rip_function", joined("modules").alias("modules"),
                                    cx.panic_class(_C("panic_msg")).alias("panic_class"), cx.fallback_severity(_C("panic_msg")).alias("severity"))


@query("d15_trace_structure")
def _(spark, sf):
    return parsed(spark, sf).transform(cx.trace_structure).select(
        "crash_id", joined(cx.trace_function_names(_C("call_trace"))).alias("names"), joined("lock_functions").alias("lock_f"),
        joined("memory_functions").alias("mem_f"), joined("rcu_functions").alias("rcu_f"), joined("sched_functions").alias("sched_f"),
        "inferred_issue", "involved_subsystem")


@query("d18_expert_rule")
def _(spark, sf):
    return parsed(spark, sf).transform(cx.match_rules).select("crash_id", "rule_id", "rule_score", "rule_match")


@query("a9_symptoms")
def _(spark, sf):
    d = cx.symptom_rows(parsed(spark, sf), "crash_id", "panic_msg")
    return d.select("crash_id", big("place").alias("place"), "bug_type", big("score").alias("match_score"))


@query("d21_root_cause")
def _(spark, sf):
    return diagnosed(spark, sf).select("crash_id", "root_cause", "bug_type", F.round("score", 4).alias("score"), "reason",
                                       "subsystem", joined("causal_chain").alias("chain"), nf.severity_label(_C("score")).alias("severity"))


@query("d16_fix_inference")
def _(spark, sf):
    return diagnosed(spark, sf).select("crash_id", "needs_lock_fix", "needs_refcount_fix", "needs_rcu_fix", "needs_null_check", "needs_bound_check",
                                       joined("search_keywords").alias("keywords"))


@query("d17_retrieval_query")
def _(spark, sf):
    return diagnosed(spark, sf).select("crash_id", "retrieval_query")


@query("d22_evidence")
def _(spark, sf):
    """Patches and history are those of the query of the same number: history is the share of them that fix the crash's bug type."""
    p = ranked(spark, sf).groupBy(_C("query_id").alias("crash_id")).agg(F.collect_list("bug_type").alias("fixed"))  # at most k a query
    d = diagnosed(spark, sf).join(p, "crash_id", "left")
    same = F.size(F.filter("fixed", lambda b: b == _C("bug_type"))) / F.size("fixed")
    d = cx.evidence_coverage(cx.confidence_breakdown(d, F.coalesce(same, F.lit(0.0))), _C("fixed").isNotNull())
    return d.select("crash_id", "panic_keyword", "fault_address", "error_code", "matched_rule_name", joined("trace_functions").alias("frames"),
                    "pct_rule", "pct_fault", "pct_subsystem", "pct_trace", "pct_history", "coverage_pct", "reliability",
                    joined("missing_high").alias("missing"))


@query("d23_possible_causes")
def _(spark, sf):
    return diagnosed(spark, sf).select("crash_id", joined(cx.possible_causes(
        _C("bug_type"), _C("subsystem"), _C("call_trace"))).alias("causes"))


@query("d12_model_answers")
def _(spark, sf):
    d = cx.parse_model_answer(vw.answers(spark, sf)).withColumns({"subsystem": F.lit("fs"), "bug_type": F.lit("hang")})
    return cx.apply_model_answer(d).select(
        "conv_id", "turn", _C("analysis.subsystem").alias("said_subsystem"), _C("analysis.bug_type").alias("said_bug"),
        _C("analysis.severity").alias("severity"), _C("analysis.confidence").alias("confidence"), "subsystem", "bug_type",
        _C("analysis.root_cause_hypothesis").alias("hypothesis"))


@query("x7_structured_output")
def _(spark, sf):
    got = tf.json_from_answer(_C("answer"), "subsystem string, severity string")
    return vw.answers(spark, sf).withColumn("g", got).select("conv_id", "turn", _C("g").isNotNull().alias("ok"),
                                                            _C("g.subsystem").alias("subsystem"), _C("g.severity").alias("severity"))


@query("d26_hybrid")
def _(spark, sf):
    """Crash n meets the model answer of every turn of conversation n; crashes without one keep the rules."""
    a = cx.parse_model_answer(vw.answers(spark, sf)).select(_C("conv_id").alias("crash_id"), "turn", F.struct(
        _C("analysis.root_cause_hypothesis").alias("root_cause"), _C("analysis.bug_type").alias("bug_type"),
        _C("analysis.confidence").alias("score"), F.lit("model says so").alias("reason"),
        F.array(F.lit("step one"), F.lit("step two")).alias("causal_chain"), F.lit("").alias("retrieval_query")).alias("llm"))
    d = diagnosed(spark, sf).join(a, "crash_id", "left")
    return cx.hybrid_root_cause(d).select("crash_id", "turn", "analysis_source", "root_cause", "bug_type", F.round("score", 4).alias("score"),
                                          joined("causal_chain").alias("chain"))


@query("d28_fuse_dump_and_log")
def _(spark, sf):
    dump = cx.infer_from_dump(vw.dumps(spark, sf))
    f = cx.fuse_features(dump, parsed(spark, sf))
    return f.select("crash_id", "subsystem", "bug_type", joined("call_trace").alias("trace"), "panic_msg", "kernel_version",
                    joined("modules").alias("modules"))


# --- knowledge ----------------------------------------------------------------------------------

@query("g5_subsystem_graph")
def _(spark, sf):
    s = _C("subsystem")
    d = analysed(spark, sf).select("doc_id", "subsystem", "bug_type")
    return d.select("doc_id", gr.subsystem_title(s).alias("title"), joined(gr.children(s)).alias("children"), gr.parent(s).alias("parent"),
                    joined(gr.ancestors(s)).alias("ancestors"), joined(gr.related_subsystems(s)).alias("related"),
                    joined(gr.subsystems_of_bug_type(_C("bug_type"))).alias("by_bug"))


@query("g6_path_and_function")
def _(spark, sf):
    d = vw.commits(spark, sf).transform(co.extract_functions).select("doc_id", "functions", F.posexplode("files_changed"))
    return d.select("doc_id", big("pos").alias("file_no"), _C("col").alias("path"), gr.subsystem_of_path(_C("col")).alias("subsystem"),
                    gr.subsystem_of_function(F.coalesce(F.get("functions", 0), F.lit(""))).alias("by_function"))


@query("g9_bug_pattern")
def _(spark, sf):
    k = gr.bug_pattern_key(_C("bug_type"))
    return analysed(spark, sf).select("doc_id", k.alias("pattern"), joined(gr.bug_pattern_list(k, "fixes")).alias("fixes"),
                                      joined(gr.bug_pattern_list(k, "keywords")).alias("keywords"),
                                      joined(gr.bug_pattern_list(k, "tools")).alias("tools"), joined(gr.bug_pattern_list(k, "causes")).alias("causes"),
                                      joined(gr.bug_pattern_list(k, "options")).alias("options"))


@query("g14_lock_usage")
def _(spark, sf):
    d = gr.lock_usage(parsed(spark, sf))
    return d.select("crash_id", joined("lock_types").alias("types"), joined("locks_acquired").alias("acquired"),
                    joined("locks_released").alias("released"), joined("lock_issues").alias("issues"),
                    joined(gr.deadlock_patterns(_C("panic_msg"))).alias("deadlocks"), joined(gr.lock_ordering(_C("subsystem"))).alias("ordering"))


@query("g11_lock_type")
def _(spark, sf):
    d = parsed(spark, sf).select("crash_id", F.posexplode(cx.trace_function_names(_C("call_trace"))))
    return d.select("crash_id", big("pos").alias("frame_no"), gr.lock_type_of_function(_C("col")).alias("lock_type"),
                    gr.lock_type(_C("col")).alias("by_name"))


@query("g16_normalize_bug_type")
def _(spark, sf):
    d = vw.table(spark, sf, "part").select("p_partkey", F.expr(vw.pick("p_partkey % 12", RAW_BUGS)).alias("raw"))
    return d.select("p_partkey", tf.normalize_bug_type(_C("raw")).alias("bug_type"),
                    tf.bug_category(tf.normalize_bug_type(_C("raw"))).alias("category"))


RAW_BUGS = ["uaf", "Use-After-Free", "NULL pointer dereference", "deadlock_or_lock_contention", "rcu_related", " hang ",
            "kernel oops", "", "OOM", "memory leak", "gpf", "leak"]


# --- vectors ------------------------------------------------------------------------------------

@query("r2_topk")
def _(spark, sf):
    q = label_queries(spark, sf).where("query_id = 3").select("query_id", "vec")
    h = ve.topk(q, vector_index(spark, sf), 10)
    return h.select("query_id", "id", F.round("score", 6).alias("score"), big("rank").alias("rank"))


@query("r10_batch_topk")
def _(spark, sf):
    h = vs.search(vector_store(spark, sf), label_queries(spark, sf), 50)
    return h.select("query_id", "id", F.round("score", 6).alias("score"), big("rank").alias("rank"))


@query("r3_auto_index")
def _(spark, sf):
    h = vs.search(vector_store(spark, sf), label_queries(spark, sf).select("query_id", "vec"), 20)
    return h.select("query_id", "id", F.round("score", 6).alias("score"), big("rank").alias("rank"))


@query("r5_prefilter")
def _(spark, sf):
    cond = fl.scalar_filter("mm", "use_after_free", "2017-01-01", "2024-12-31")
    h = ve.topk(label_queries(spark, sf), vector_index(spark, sf).where(cond), 10)
    return h.select("query_id", "id", big("rank").alias("rank"))


@query("r4_postfilter")
def _(spark, sf):
    h = ve.post_filter(hits(spark, sf, 50), 'bug_type=="memory_leak"')
    return h.select("query_id", "id", "bug_type", F.round("distance", 6).alias("distance"))


@query("r11_recall_stats")
def _(spark, sf):
    h = hits(spark, sf)
    return ve.recall_stats(h).select("query_id", "hit_count", F.round("avg_distance", 5).alias("avg_distance"))


@query("r11_recall_counts")
def _(spark, sf):
    return ve.recall_counts(hits(spark, sf)).select("query_id", "facet", "value", "n", big("place").alias("place"))


@query("x3_evidence_table")
def _(spark, sf):
    """Every crash with the best patch of the query of the same number."""
    return ex.evidence_table(diagnosed(spark, sf), ranked(spark, sf)).select("crash_id", big("ord").alias("ord"), "field", "value", "status")


@query("p28_confirmed_fixes")
def _(spark, sf):
    d = analysed(spark, sf).withColumn("panic_msg", _C("subject"))
    for n in ("lock_functions", "memory_functions", "rcu_functions"):
        d = d.withColumn(n, F.array().cast("array<string>"))
    d = cx.confirm_fixes(cx.infer_fixes(d, "bug_type"))
    return d.select("doc_id", "needs_lock_fix", "needs_refcount_fix", "needs_rcu_fix", joined("search_keywords").alias("keywords"))


@query("a8_usage")
def _(spark, sf):
    return ag.usage(vw.table(spark, sf, "conversations"), "role", "text").select("role", "calls", "characters", "words")


@query("u11_flatten")
def _(spark, sf):
    d = vw.table(spark, sf, "documents").select("doc_id", F.struct("lang", F.struct("source", "n_chars").alias("of")).alias("meta"))
    return d.select(*tf.flattened(d.schema, "_"))


@query("g12_lock_fix")
def _(spark, sf):
    d = vw.table(spark, sf, "part").select("p_partkey", F.expr(vw.pick("p_partkey % 9", [*LOCK_FIX_KINDS, "other"])).alias("kind"))
    return d.select("p_partkey", "kind", gr.lock_fix(_C("kind")).alias("fix"))


LOCK_FIX_KINDS = ["add_spinlock", "add_spinlock_irqsave", "add_mutex", "add_rcu", "fix_ordering", "reduce_critical_section", "convert_to_atomic",
                  "add_rcu_dereference"]


@query("g15_lock_context")
def _(spark, sf):
    return gr.lock_context(parsed(spark, sf)).select("crash_id", "lock_context")


@query("k6_extended_reason")
def _(spark, sf):
    d = rk.extended_reason(rk.score_breakdown(ranked(spark, sf)))
    return d.select("query_id", big("rank").alias("rank"), "id", "reason_extended")


@query("g4_closure")
def _(spark, sf):
    """The subsystem hierarchy that the commits' files span (folder above folder), closed by iterated joins: (node, ancestor, depth)."""
    files = vw.commits(spark, sf).select(F.explode("files_changed").alias("f")).distinct()
    parts = files.select(F.split("f", "/").alias("p")).select(F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("n"), "p").where("n > 0")
    edges = parts.select(F.array_join(F.slice("p", 1, _C("n") + 1), "/").alias("node"), F.array_join(F.slice("p", 1, _C("n")), "/").alias("parent")).distinct()
    return gr.closure(edges).select("node", "ancestor", big("depth").alias("depth"))


@query("k1_scorer_hook")
def _(spark, sf):
    """The standard mode with a batched model hook in the reranker's place; the hook's stand-in is the token overlap, row for row."""
    d = rt.retrieve(label_queries(spark, sf), vector_index(spark, sf), cosine=False, scorer=md.pair_scorer(md.overlap_model))
    return d.select("query_id", big("rank").alias("rank"), "id", F.round("vector_score", 10).alias("vector_score"), F.round("reranker_score", 10).alias("reranker_score"),
                    F.round("final_score", 12).alias("final_score"), "rank_reason")


@query("r1_encoder_hook")
def _(spark, sf):
    """Benchmark texts against all commit texts, both encoded through the batched model hook."""
    hook = md.text_encoder(md.hashed_model)
    q = ve.encode_text(vw.table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id"), "text", encoder=hook)
    c = ve.encode_text(caused(spark, sf).withColumnRenamed("doc_id", "id"), "embedding_text", encoder=hook)
    h = ve.topk(q.select("query_id", "vec"), c.select("id", "vec"), 10, cosine=True)
    return h.select("query_id", "id", F.round("score", 6).alias("score"), big("rank").alias("rank"))


@query("g15_bug_context")
def _(spark, sf):
    return analysed(spark, sf).select("doc_id", gr.bug_context(_C("bug_type")).alias("bug_context"))


@query("a1_facets")
def _(spark, sf):
    return ag.facets(analysed(spark, sf), ["subsystem", "bug_type", "kernel_version"])


@query("r12_similar_commits")
def _(spark, sf):
    """Benchmark texts against all commit texts, hashed term vectors, cosine."""
    q = ve.encode_text(vw.table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id"), "text")
    # written once: making a store reads its rows several times
    c = stage(spark, sf, "encoded", lambda: ve.encode_text(caused(spark, sf).select(_C("doc_id").alias("id"), "subsystem", "bug_type", "embedding_text"),
                                                           "embedding_text").drop("embedding_text"))
    h = vs.search(store(spark, sf, "caused", c, "cosine"), q, 10)
    return h.select("query_id", "id", F.round("score", 6).alias("score"), big("rank").alias("rank"))


@query("s12_normalize_and_number")
def _(spark, sf):
    d = ag.dense_number(vw.table(spark, sf, "embeddings"), "vec_id", "row_no")
    v = ve.l2_normalize(_C("embedding"))
    return d.select("vec_id", big("row_no").alias("row_no"), F.round(ve.dot(v, v), 5).alias("norm"), F.round(F.get(v, 0), 5).alias("x0"))


@query("s13_store_rows")
def _(spark, sf):
    return ix.store_row(analysed(spark, sf)).withColumn("score", F.round(_C("score").cast("double"), 2))


# --- filters ------------------------------------------------------------------------------------

@query("f1_dedupe")
def _(spark, sf):
    return fl.dedupe_verdict(vw.commits(spark, sf).select("doc_id", "pos", "commit_hash")).select("doc_id", "verdict")


@query("f2_scalar_verdicts")
def _(spark, sf):
    return analysed(spark, sf).select(
        "doc_id", fl.subsystem_verdict("rcu").alias("rcu"), fl.subsystem_verdict("mm").alias("mm"),
        fl.subsystem_verdict("mm", related=False).alias("mm_only"), fl.bug_type_verdict("use_after_free").alias("uaf"),
        fl.bug_type_verdict("race_condition", exact=True).alias("race"), fl.version_verdict("5.4.0-150-generic").alias("v54"),
        fl.version_verdict("4.19", strict=True).alias("v419"), fl.version_verdict("junk").alias("vjunk"),
        fl.keyword_verdict(["fix", "leak"]).alias("any_kw"), fl.keyword_verdict(["fix", "leak"], match_any=False).alias("all_kw"))


@query("w2_boosts")
def _(spark, sf):
    d = analysed(spark, sf)
    return d.select("doc_id", F.round(fl.security_boost(), 4).alias("boosted"), fl.version_factor("5.10.0").alias("weight"))


@query("f6_filter_chain")
def _(spark, sf):
    d = fl.apply_filters(analysed(spark, sf), "fs", "use_after_free", "5.10.0-9-amd64", keywords=["fix"])
    return d.select("doc_id", "uncertain", "version_weight", F.round("boosted_score", 4).alias("boosted"))


# --- ranking ------------------------------------------------------------------------------------

@query("k15_standard")
def _(spark, sf):
    return ranked(spark, sf).select("query_id", big("rank").alias("rank"), "id", F.round("vector_score", 10).alias("vector_score"),
                                    F.round("reranker_score", 10).alias("reranker_score"), F.round("final_score", 12).alias("final_score"), "rank_reason")


@query("k15_fast")
def _(spark, sf):
    return ranked(spark, sf, rt.FAST).select("query_id", big("rank").alias("rank"), "id", F.round("final_score", 6).alias("final_score"),
                                             F.round("boosted_score", 10).alias("boosted"))


@query("k15_deep")
def _(spark, sf):
    """Deep mode with one judge answer a query: three candidates get a score, one of them far down, the others the default."""
    q = label_queries(spark, sf)
    said = q.select("query_id", F.concat(F.lit('Scores: [{"index": '), (_C("query_id") % 3).cast("string"), F.lit(
        ', "score": 0.9, "reason": "same lock"}, {"index": 4, "score": 0.1}, {"index": 61, "score": 0.8, "reason": "far"}] end')).alias("answer"))
    d = rt.retrieve(q, vector_index(spark, sf), rt.DEEP, cosine=False, answers=said)
    return d.select("query_id", big("rank").alias("rank"), "id", F.round("judge_score", 6).alias("judge_score"), "judge_reason",
                    F.round("final_score", 12).alias("final_score"))


@query("k16_quick_search")
def _(spark, sf):
    """Benchmark texts as free queries against every commit; no targets, so only the ranking applies."""
    q = rt.text_queries(vw.table(spark, sf, "benchmark").select(_C("item_id").alias("query_id"), _C("text").alias("query_text")))
    h = rt.retrieve(q, text_index(spark, sf), rt.STANDARD, 50, store=text_store(spark, sf))
    return h.where("rank <= 5").select("query_id", big("rank").alias("rank"), "id", F.round("vector_score", 10).alias("vector_score"),
                                       F.round("reranker_score", 10).alias("reranker_score"), F.round("final_score", 12).alias("final_score"))


@query("k7_breakdown")
def _(spark, sf):
    d = rk.score_breakdown(ranked(spark, sf))
    cols = ("expert_rule_score", "callstack_match_score", "subsystem_match_score", "version_match_score", "version_penalty")
    return d.select("query_id", big("rank").alias("rank"), *[F.round(c, 4).alias(c) for c in cols],
                    F.round("callstack_match_contribution", 4).alias("callstack_part"))


@query("k14_version_analysis")
def _(spark, sf):
    return rk.version_analysis(ranked(spark, sf)).select("query_id", big("rank").alias("rank"), "version_distance", "compatibility",
                                                         big("distance_value").alias("distance_value"), "patch_kernel_version", "crash_release_date")


@query("k13_why_not")
def _(spark, sf):
    d = rk.why_not(ranked(spark, sf))
    return d.select("query_id", big("rank").alias("rank"), joined("same_aspects").alias("same"), joined("different_aspects").alias("different"),
                    "ranking_reason", F.round("score_gap", 12).alias("gap"))


@query("k3_judge_answers")
def _(spark, sf):
    """One judge answer per conversation turn over five candidates; the turn's whole text is the reason given."""
    d = vw.table(spark, sf, "conversations").select("conv_id", "turn", F.expr(JUDGE).alias("answer"))
    return rk.parse_judge(d, "answer", 5).select("conv_id", "turn", big("index").alias("index"), "judge_score", "judge_reason")


JUDGE = (f"CASE (conv_id + turn) % 3 WHEN 0 THEN concat('Scores: [{{\"index\": ', CAST(conv_id % 5 AS STRING), "
         f"', \"score\": 0.75, \"reason\": \"', {vw.QUOTED}, '\"}}, {{\"index\": 9, \"score\": 1.0}}] end') "
         "WHEN 1 THEN '[]' ELSE concat('sorry, no scores: ', replace(coalesce(text, ''), '[', '(')) END")


@query("a6_normalizers")
def _(spark, sf):
    d = vw.table(spark, sf, "events").select("event_id", "event_type", "value")
    d = ag.softmax(ag.min_max(d, ["event_type"], "value"), ["event_type"], "normalized")
    return d.select("event_id", F.round("normalized", 6).alias("normalized"), F.round(_C("probability") * 1000, 6).alias("permille"))


@query("x1_patch_explain")
def _(spark, sf):
    d = ex.rank_reasons(ex.report_scores(ex.patch_explanations(ranked(spark, sf))))
    return d.select("query_id", big("rank").alias("rank"), "fix_target", "fix_method", "affected_path", joined("reasons").alias("reasons"),
                    "rep_expert", "rep_callstack", "rep_functions", F.round("rep_embedding", 1).alias("rep_embedding"),
                    F.round("rep_rerank", 1).alias("rep_rerank"), joined("rank_reasons").alias("rank_reasons"))


@query("x2_comparison")
def _(spark, sf):
    d = ex.patch_comparison(ex.patch_explanations(ranked(spark, sf)), 5)
    return d.select("query_id", big("ord").alias("ord"), "dimension", "top1", "top2", "top3", "top4", "top5")


@query("x5_reports")
def _(spark, sf):
    """Report rows of all crashes joined with the ranked patches of the query of the same number."""
    d = diagnosed(spark, sf).withColumn("query_id", _C("crash_id"))
    r = ex.reports(d, ranked(spark, sf))
    return r.select("crash_id", "severity", "panic_class", F.size("patches").cast("bigint").alias("n_patches"),
                    F.get_json_object("report_json", "$.root_cause").alias("json_cause"), "report_markdown")


@query("x6_rule_explanation")
def _(spark, sf):
    """All crashes, each with the ranked patches of the query of the same number."""
    d = diagnosed(spark, sf).withColumn("query_id", _C("crash_id"))
    return ex.rule_explanation(d, rk.score_breakdown(rk.why_not(ranked(spark, sf)))).select("crash_id", "explanation")


@query("x3_evidence_summary")
def _(spark, sf):
    return ex.evidence_summary(ex.patch_explanations(ranked(spark, sf)))


@query("g15_contexts")
def _(spark, sf):
    d = analysed(spark, sf)
    return d.select("doc_id", gr.subsystem_context(_C("subsystem")).alias("subsystem_context"))


@query("k16_search_by_bug_type")
def _(spark, sf):
    """One labelled query per (subsystem, bug type) present in the commits, against every commit."""
    def build():
        kinds = analysed(spark, sf).groupBy("subsystem", "bug_type").agg(F.min("doc_id").alias("query_id"))
        return rt.bug_type_queries(kinds)
    q = stage(spark, sf, "bug_queries", build).select("query_id", "vec", "query_text", "target_subsystem", "target_bug_type", "target_version")
    h = rt.retrieve(q, text_index(spark, sf), rt.STANDARD, 50, store=text_store(spark, sf))
    return h.where("rank <= 5").select("query_id", big("rank").alias("rank"), "id", F.round("vector_score", 10).alias("vector_score"),
                                       F.round("reranker_score", 10).alias("reranker_score"), F.round("final_score", 12).alias("final_score"))


def text_index(spark, sf) -> DataFrame:
    return stage(spark, sf, "text_index", lambda: ix.index_rows(vw.commits(spark, sf)))


@query("k18_diagnose")
def _(spark, sf):
    """Every crash log against every commit: parse, diagnose, encode, recall, filter, rank; top 3."""
    d = rt.diagnose_and_retrieve(vw.crashes(spark, sf), text_index(spark, sf), rt.FAST, 100, 3, text_store(spark, sf))
    return d.select("crash_id", big("rank").alias("rank"), "root_cause", "commit_hash", "subject", F.round("final_score", 6).alias("final_score"))


# --- aggregation, paging, maintenance -----------------------------------------------------------

@query("k19_page")
def _(spark, sf):
    d = ag.page(analysed(spark, sf), [F.desc("score"), F.asc("doc_id")], 3, 20)
    return d.select("doc_id", "score", "subsystem")


@query("k19_deep_page")
def _(spark, sf):
    """Page 30 of all orders by price, from the ranges that hold it."""
    d = ag.page(vw.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 30, 25, gather=100)
    return d.select("o_orderkey", "o_totalprice")


@query("s19_index_stats")
def _(spark, sf):
    return ix.index_stats(vector_index(spark, sf))


@query("s22_stratified")
def _(spark, sf):
    d = analysed(spark, sf).withColumn("ver", F.coalesce(F.substring_index("kernel_version", ".", 2), F.lit("0.0")))
    s = ag.stratified_sample(d, 200, "ver", F.coalesce("committer_date", "date"), "doc_id")
    return s.select("doc_id", "ver", big("rank").alias("rank"))


@query("u10_batches")
def _(spark, sf):
    d = vw.table(spark, sf, "orders").select("o_orderkey")
    return ag.even_chunks(ag.batches(d, "o_orderkey", 1000), "o_orderkey", 7).select(
        "o_orderkey", big("batch_no").alias("batch_no"), big("chunk_no").alias("chunk_no"))


@query("a7_status_counts")
def _(spark, sf):
    return ag.status_counts(vw.table(spark, sf, "orders"), "o_orderstatus", ["O", "F", "P"], ["o_orderpriority"])


@query("st4_attempts")
def _(spark, sf):
    d = ag.attempts_in_window(vw.table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 3600)
    return d.select("event_id", big("attempts").alias("attempts"))


@query("s23_latest_tasks")
def _(spark, sf):
    u = vw.table(spark, sf, "events").select(_C("user_id").alias("task_id"), "ts", _C("event_id").alias("seq"),
                                             _C("event_type").alias("status"), (_C("event_type") == "error").alias("deleted"))
    d = ix.latest_tasks(u, F.to_timestamp(F.lit("2024-01-30 12:00:00")))
    return d.select("task_id", "status", F.date_format("updated", "yyyy-MM-dd HH:mm:ss").alias("updated"))


@query("s24_store_cap")
def _(spark, sf):
    d = ag.newest_per_store(vw.table(spark, sf, "events"), 500, "ts", "event_id")
    return d.select("event_id", "user_id")


@query("s15_new_rows")
def _(spark, sf):
    known = vw.commits(spark, sf).where("date < '2019-01-01'")
    return ix.new_rows(vw.commits(spark, sf), known).select("doc_id", "commit_hash")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)
