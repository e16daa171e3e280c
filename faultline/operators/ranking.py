"""Rerank, fusion and per-candidate explanations.  Windows run per query over at most top-k rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numeric as nf, text as tf, versions as vf
from ..rules import knowledge as kn, texts as say
from . import filters as fl

_C = F.col


def fuse(vector: Column, rerank: Column, judge: Column, weights=kn.FUSION_WEIGHTS) -> Column:
    """Weighted sum of clamped scores, clamped; a missing score counts 0.5."""
    v, r, j = (nf.clamp01(F.coalesce(c, F.lit(0.5))) for c in (vector, rerank, judge))
    return nf.clamp01(weights[0] * v + weights[1] * r + weights[2] * j)


def batch_relative(score: Column, query: str = "query_id") -> Column:
    """Boosted scores to [0,1]: relative to the query's maximum when that is above 1 or below .01."""
    top = F.max(F.when(score > 0, score)).over(Window.partitionBy(query))
    rel = F.round(F.least(F.lit(0.99), score / top), 4)
    return F.when(top.isNull(), score).when((top > 1.0) | (top < 0.01), rel).otherwise(nf.clamp01(score))


def document_text() -> Column:
    tags = F.array_join(F.coalesce(_C("fix_tags"), F.array().cast("array<string>")), "', '")
    base = F.concat(F.lit("["), _C("subsystem"), F.lit("] ["), _C("bug_type"), F.lit("] "), _C("subject"))
    return F.when(tags != "", F.concat(base, F.lit(" Fixes: ['"), tags, F.lit("']"))).otherwise(base)


def rank_reason(final: Column, rerank: Column) -> Column:
    grade = (F.when(final >= 0.85, F.lit(say.GRADE_HIGH)).when(final >= 0.70, F.lit(say.GRADE_MARKED))
             .when(final >= 0.50, F.lit(say.GRADE_MIDDLE)).otherwise(F.lit(say.GRADE_LOW)))
    return F.concat_ws("; ", grade, F.concat(F.lit(say.SUBSYSTEM_IS), _C("subsystem")),
                       F.concat(F.lit(say.BUG_TYPE_IS), _C("bug_type")), F.when(rerank >= 0.80, F.lit(say.MEANING_CLOSE)))


def rerank(df: DataFrame, query_text: str = "query_text", scorer=None, judge: str | None = None,
           weights=kn.FUSION_WEIGHTS) -> DataFrame:
    """Score, fuse and rank filtered candidates of each query.

    ``df`` needs query_id, order_no (filter order) and boosted_score.  ``scorer`` is a pandas UDF
    (query, document) -> score; without one, token overlap is used.
    """
    doc = document_text()
    scored = df.withColumns({
        "vector_score": nf.clamp01(batch_relative(_C("boosted_score"))),
        "reranker_score": nf.clamp01(scorer(_C(query_text), doc) if scorer else tf.overlap_score(_C(query_text), doc)),
        "judge_score": nf.clamp01(F.coalesce(_C(judge), F.lit(0.5)) if judge else F.lit(0.5))})
    scored = scored.withColumn("final_score", F.round(fuse(
        _C("vector_score"), _C("reranker_score"), _C("judge_score"), weights), 12))
    w = Window.partitionBy("query_id").orderBy(F.desc("final_score"), F.asc("order_no"))
    return (scored.withColumn("rank", F.row_number().over(w))
            .withColumn("rank_reason", rank_reason(_C("final_score"), _C("reranker_score"))))


def parse_judge(df: DataFrame, answer: str = "answer", n: Column | int = 50) -> DataFrame:
    """Judge answer to one row per candidate index: (…, index, judge_score, judge_reason)."""
    n = n if isinstance(n, Column) else F.lit(n)
    text = F.regexp_extract(_C(answer), r"(?s)\[.*\]", 0)
    items = F.when(F.try_parse_json(text).isNotNull(), F.from_json(
        text, "array<struct<index:int,score:double,reason:string>>"))
    df = df.withColumn("_items", items).withColumn("index", F.explode(F.sequence(F.lit(0), n - 1)))
    hit = F.element_at(F.filter("_items", lambda i: F.coalesce(i["index"], F.lit(-1)) == _C("index")), -1)
    hit = F.when(F.size(F.filter("_items", lambda i: F.coalesce(i["index"], F.lit(-1)) == _C("index"))) > 0, hit)
    return (df.withColumn("_hit", hit)
            .withColumn("judge_score", F.when(_C("_hit").isNotNull(), F.coalesce(_C("_hit.score"), F.lit(0.5))).otherwise(0.5))
            .withColumn("judge_reason", F.when(_C("_items").isNull(), F.lit("Parse failed"))
                        .when(_C("_hit").isNull(), F.lit("Not found in response"))
                        .otherwise(F.coalesce(_C("_hit.reason"), F.lit("")))).drop("_items", "_hit"))


# --- seven display dimensions -------------------------------------------------------------------

def expert_rule_score(patch: Column, crash: Column, rule: Column) -> Column:
    unknown = F.coalesce(crash, F.lit("")).isin("", "unknown")
    same = tf.normalize_bug_type(crash) == tf.normalize_bug_type(patch)
    return (F.when(unknown, 0.5).when(patch == crash, 0.95)
            .when((F.coalesce(patch, F.lit("")) != "") & same, 0.85)
            .when(F.coalesce(rule, F.lit("")) != "", 0.70).otherwise(0.30))


def callstack_score(files: Column, functions: Column, patch_sub: Column, trace: Column, crash_sub: Column) -> Column:
    text = F.lower(F.array_join(trace, " "))
    hit = lambda xs: F.coalesce(F.exists(xs, lambda x: F.contains(text, F.lower(x))), F.lit(False))
    same = (F.coalesce(patch_sub, F.lit("")) != "") & (patch_sub == crash_sub)
    return (F.when(F.coalesce(F.size(trace), F.lit(0)) <= 0, 0.30).when(hit(files), 0.90).when(hit(functions), 1.00)
            .when(same, 0.50).otherwise(0.10))


def _relation(a: Column, b: Column, table: dict[str, list[str]]) -> Column:
    """True when b is listed under a."""
    pairs = [f"{k}>{s}" for k, v in table.items() for s in v]
    return F.concat_ws(">", a, b).isin(pairs)


def subsystem_score(patch: Column, crash: Column) -> Column:
    empty = (F.coalesce(patch, F.lit("")) == "") | (F.coalesce(crash, F.lit("")) == "")
    return (F.when(empty, 0.30).when(patch == crash, 1.00)
            .when(_relation(crash, patch, kn.FILTER_HIERARCHY), 0.80).when(_relation(patch, crash, kn.FILTER_HIERARCHY), 0.75)
            .when(_relation(crash, patch, kn.FILTER_RELATED), 0.60).when(_relation(patch, crash, kn.FILTER_RELATED), 0.55)
            .otherwise(0.20))


def crash_release(version: Column) -> Column:
    """struct(major, minor) of a crash version with major 2..7, else null."""
    a = vf.version_part(version, 0)
    b = F.when(F.size(F.split(version, r"\.")) > 1, vf.version_part(version, 1)).otherwise(F.lit(0))
    return F.when(a.between(2, 7) & b.isNotNull(), F.struct(a.alias("major"), b.alias("minor")))


def release_gap(version: Column) -> Column:
    major, minor = fl.candidate_release()
    c = crash_release(version)
    return vf.version_distance(major, minor, c["major"], c["minor"])


def version_score(version: Column) -> Column:
    d = release_gap(version)
    return (F.when(d.isNull(), 0.50).when(d == 0, 1.00).when(d.between(1, 2), 0.90).when(d.between(3, 5), 0.70)
            .when(d > 5, 0.50).otherwise(0.65))


def score_breakdown(df: DataFrame) -> DataFrame:
    """Seven scores, their weighted contributions and the version penalty.

    Reads crash_subsystem, crash_bug_type, crash_version, crash_trace, rule_id next to the candidate.
    """
    s = {"embedding": nf.display_score(_C("vector_score")), "reranker": nf.clamp01(_C("reranker_score")),
         "expert_rule": expert_rule_score(_C("bug_type"), _C("crash_bug_type"), _C("rule_id")),
         "callstack_match": callstack_score(_C("files_changed"), _C("functions"), _C("subsystem"), _C("crash_trace"),
                                            _C("crash_subsystem")),
         "subsystem_match": subsystem_score(_C("subsystem"), _C("crash_subsystem")),
         "version_match": version_score(_C("crash_version")), "llm_judge": nf.clamp01(_C("judge_score"))}
    df = df.withColumns({f"{n}_score": F.round(c.cast("double"), 4) for n, c in s.items()})
    df = df.withColumns({f"{n}_contribution": F.round(_C(f"{n}_score") * w, 4) for n, w in kn.DISPLAY_WEIGHTS.items()})
    return df.withColumn("version_penalty", F.round((_C("version_match_score") - 1.0) * kn.DISPLAY_WEIGHTS["version_match"], 4))


def extended_reason(df: DataFrame) -> DataFrame:
    """Rank reason enriched with the display dimensions."""
    f, ss, cs, v, er = (_C(c) for c in ("final_score", "subsystem_match_score", "callstack_match_score",
                                        "version_match_score", "expert_rule_score"))
    return df.withColumn("reason_extended", F.concat_ws(
        " | ", F.when(f >= 0.85, F.lit(say.GRADE_HIGH)).when(f >= 0.70, F.lit(say.GRADE_MARKED)).when(f >= 0.50, F.lit(say.GRADE_MIDDLE))
        .otherwise(F.lit(say.GRADE_LOW)),
        F.when(ss >= 0.80, F.lit(say.SUBSYSTEM_EXACT)).when(ss >= 0.50, F.lit(say.SUBSYSTEM_PARTLY)),
        F.when(cs >= 0.80, F.lit(say.STACK_HIT)).when(cs >= 0.40, F.lit(say.STACK_NEAR)),
        F.when(v >= 1.0, F.lit(say.VERSION_FITS)).when(v < 0.80, F.lit(say.VERSION_POOR)),
        F.when(er >= 0.85, F.lit(say.RULE_FITS))))


def version_analysis(df: DataFrame, version: str = "crash_version") -> DataFrame:
    """Distance text, compatibility grade and the crash release date."""
    major, minor = fl.candidate_release()
    crash = crash_release(_C(version))
    d = vf.version_distance(major, minor, crash["major"], crash["minor"])
    n = F.abs(d).cast("string")
    no_patch = major.isNull() | minor.isNull()
    dist = (F.when(crash.isNull(), F.lit(say.VERSION_MISSING)).when(no_patch, F.lit("Unknown"))
            .when(d == 0, F.lit("Same Version")).when(d.between(1, 5), F.concat(n, F.lit(" Minor Release")))
            .when(d > 5, F.concat(n, F.lit(" Minor Release (Cross Minor)")))
            .otherwise(F.concat(n, F.lit(" Minor Release Behind"))))
    grade = (F.when(crash.isNull() | no_patch, F.lit("Unknown")).when(d.between(0, 2), F.lit("High"))
             .when(d.between(3, 5) | (d < 0), F.lit("Medium")).otherwise(F.lit("Low")))
    value = F.when(crash.isNull(), F.lit(-1)).when(no_patch, F.lit(0)).otherwise(F.abs(d))
    return df.withColumns({
        "version_distance": dist, "compatibility": grade, "distance_value": value,
        "patch_kernel_version": F.when(major.isNotNull(), F.concat(
            major.cast("string"), F.lit("."), F.coalesce(minor.cast("string"), F.lit("None")), F.lit(".0"))),
        "crash_release_date": vf.release_date(crash["major"], crash["minor"])})


def why_not(df: DataFrame) -> DataFrame:
    """Compare every candidate with its query's rank 1 (null for rank 1): shared/different aspects, gap."""
    w = Window.partitionBy("query_id").orderBy("rank")
    first = lambda c: F.first_value(c).over(w)
    df = df.withColumns({f"_{c}": first(c) for c in ("bug_type", "subsystem", "final_score", "vector_score",
                                                     "reranker_score", "version_weight")})
    num = lambda c, n: F.format_number(c, n)
    rank = _C("rank").cast("string")
    pair = lambda label, c, gap: F.concat(
        F.lit(label), num(_C(f"_{c}"), 3), F.lit(" vs Top"), rank, F.lit("="), num(_C(c), 3),
        *([F.lit(say.GAP), num(_C(f"_{c}") - _C(c), 4), F.lit(")")] if gap else []))
    vw, tw = _C("version_weight"), _C("_version_weight")
    far = F.abs(vw - tw) > 0.01
    same = F.array_compact(F.array(
        F.when((_C("bug_type") == _C("_bug_type")) & (_C("bug_type") != "unknown"),
               F.concat(F.lit(say.SAME_BUG), _C("bug_type"), F.lit(say.FIX_END))),
        F.when((_C("subsystem") == _C("_subsystem")) & (_C("subsystem") != "unknown"),
               F.concat(F.lit(say.SAME_SUBSYSTEM), _C("subsystem"))),
        F.when(_C("_vector_score") == _C("vector_score"), F.lit(say.SAME_VECTOR)),
        F.when(far & (vw > tw), F.concat(F.lit(say.SAME_VERSION), num(vw, 2), F.lit(" vs Top1 "), num(tw, 2), F.lit(")")))))
    diff = F.array_compact(F.array(
        F.when(_C("bug_type") != _C("_bug_type"), F.concat(
            F.lit(say.OTHER_BUG), _C("bug_type"), F.lit(" vs "), _C("_bug_type"), F.lit(say.OTHER_BUG_END))),
        F.when(_C("subsystem") != _C("_subsystem"), F.concat(
            F.lit(say.OTHER_SUBSYSTEM), _C("subsystem"), F.lit(say.OTHER_SUBSYSTEM_END), _C("_subsystem"))),
        pair(say.FINAL_SCORES, "final_score", True),
        F.when(_C("_vector_score") != _C("vector_score"), F.concat(
            F.lit(say.VECTOR_SCORES), num(_C("_vector_score"), 3), F.lit(" > Top"), rank, F.lit("="),
            num(_C("vector_score"), 3))),
        pair(say.RERANK_SCORES, "reranker_score", True),
        F.when(far & (vw < tw), F.concat(F.lit(say.LOWER_VERSION), num(vw, 2), F.lit(" vs Top1 "), num(tw, 2), F.lit(")")))
        .when(~far & (vw != 1.0), F.concat(F.lit(say.VERSION_WEIGHT), num(vw, 2), F.lit(say.OFF_NEUTRAL)))))
    other = _C("rank") > 1
    gap = _C("_final_score") - _C("final_score")
    reason = F.concat(F.lit(say.RANK_OF), F.size("different_aspects").cast("string"), F.lit(say.DIFFERENT_COUNT),
                      F.size("same_aspects").cast("string"), F.lit(say.SAME_COUNT), rank,
                      F.lit(say.SCORE_GAP), num(gap, 4), F.lit(say.CLOSE))
    out = df.withColumn("same_aspects", F.when(other, same)).withColumn("different_aspects", F.when(other, diff))
    return (out.withColumn("score_gap", F.when(other, gap)).withColumn("ranking_reason", F.when(other, reason))
            .drop("_bug_type", "_subsystem", "_final_score", "_vector_score", "_reranker_score", "_version_weight"))
