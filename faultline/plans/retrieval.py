"""Crash diagnosis and retrieval over an index: recall, filter, rerank, explain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators import crashes as cx, filters as fl, ranking as rk, vectors as ve, vectorstore as vs
from .stage import cut

_C = F.col

FAST, STANDARD, DEEP = "fast", "standard", "deep"


RESUME_GROWTH = 4


def recall(queries: DataFrame, index: DataFrame, k: int = 100, condition: Column | None = None,
           cosine: bool = True, store: vs.StoredIndex | None = None) -> DataFrame:
    """Top-k candidates with metadata per query; ``condition`` filters the index before the search.

    ``store`` is a stored index of the same rows; it is searched by bounds where no condition narrows the rows.
    """
    pool = index if condition is None else index.where(condition)
    return _scored(cut(_search(queries, pool, k, cosine, store if condition is None else None)), pool)  # at most k rows per query, size now known


def _search(queries: DataFrame, pool: DataFrame, k: int, cosine: bool, store: vs.StoredIndex | None) -> DataFrame:
    return ve.topk(queries, pool, k, cosine) if store is None else vs.search(store, queries, k)


def _scored(hits: DataFrame, pool: DataFrame) -> DataFrame:
    hits = ve.normalize_recall(hits)
    return ve.with_metadata(hits.withColumnRenamed("score", "recall_score"), pool.drop("vec", "score", "label")).withColumn(
        "score", _C("recall_score")).withColumn("pos", _C("rank")).drop("rank", "recall_score")


def _continued(queries: DataFrame, pool: DataFrame, k: int, cosine: bool, store, targets: DataFrame, want: int) -> DataFrame:
    """Hits (query_id, id, score, rank) until ``want`` of each query's survive the filters, or no row is left.

    A search that was cut at k while fewer survive goes on behind its last (score, id), with k four times as large each time, for those queries
    only. What survives does not depend on scores, so a round counts them before any weight.
    """
    hits = cut(_search(queries, pool, k, cosine, store))
    open_, seen, size = hits, 0, k
    while True:
        full = open_.groupBy("query_id").agg(F.count("*").alias("n"), F.max_by(F.struct("score", "id"), "rank").alias("last")).where(_C("n") == seen + size)
        if full.isEmpty():
            return hits
        found = open_.join(full.select("query_id"), "query_id", "left_semi")
        kept = (fl.apply_filters(_scored(found, pool).join(targets, "query_id"), _C("target_subsystem"), _C("target_bug_type"), _C("target_version"), query="query_id")
                .groupBy("query_id").agg(F.count("*").alias("kept")))
        short = cut(full.join(kept, "query_id", "left").where(F.coalesce("kept", F.lit(0)) < want).select(
            "query_id", _C("last.score").alias("after_score"), _C("last.id").alias("after_id")))
        if short.isEmpty():
            return hits
        seen, size = seen + size, size * RESUME_GROWTH
        more = cut(_search(queries.join(short, "query_id"), pool, size, cosine, store).withColumn("rank", _C("rank") + seen))
        if more.isEmpty():
            return hits
        hits = hits.unionByName(more)
        open_ = hits.join(short.select("query_id"), "query_id", "left_semi")


def label_of(subsystem: Column, bug_type: Column) -> Column:
    return F.concat_ws("/", F.coalesce(subsystem, F.lit("unknown")), F.coalesce(bug_type, F.lit("unknown")))


def allowed_labels(subsystem: Column, bug_type: Column, labels: list[str]) -> Column:
    """Those of the index's ``labels`` whose subsystem and bug type a query may find."""
    of = F.array(*[F.lit(x) for x in labels]) if labels else F.array().cast("array<string>")
    sub_ok = lambda x: fl.no_target(subsystem) | F.array_contains(fl.allowed_subsystems(subsystem), F.substring_index(x, "/", 1))
    bug_ok = lambda x: fl.no_target(bug_type) | F.array_contains(fl.allowed_bug_types(bug_type), F.substring_index(x, "/", -1))
    return F.filter(of, lambda x: sub_ok(x) & bug_ok(x))


def retrieve(queries: DataFrame, index: DataFrame, mode: str = STANDARD, k: int = 100, rerank_k: int | None = None,
             condition: Column | None = None, scorer=None, judge: str | None = None, cosine: bool = True,
             filter_first: bool = False, answers: DataFrame | None = None, judged: int | None = None, want: int | None = None,
             store: vs.StoredIndex | None = None) -> DataFrame:
    """Ranked candidates of a batch of queries.

    ``queries``: query_id, vec, query_text, target_subsystem, target_bug_type, target_version.
    Fast mode orders by the boosted score and reports the raw one; standard reranks the filtered
    candidates (``rerank_k``: the first ones only); deep also uses the ``judge`` score column of the queries, or
    ``answers`` (query_id, answer): a judge's texts on the first ``judged`` (all ``k``) candidates of each query.
    With ``filter_first`` the k of the search are the best of those that a query's subsystem and bug type
    allow; without it the k best of all are filtered afterwards. With ``want``, a query of which fewer survive the filters is searched on
    behind its k-th row. ``store``: a stored index of the same rows, with their ``label`` where filters come first.
    """
    targets = queries.drop("vec")
    asked = queries.select("query_id", "vec")
    if filter_first:
        index = index.withColumn("label", label_of(_C("subsystem"), _C("bug_type")))
        # as many labels as subsystems times bug types, whatever the index's size
        labels = [r.label for r in index.select("label").distinct().collect()]
        asked = queries.select("query_id", "vec", allowed_labels(_C("target_subsystem"), _C("target_bug_type"), sorted(labels)).alias("allowed"))
    if want is None:
        found = recall(asked, index, k, condition, cosine, store)
    else:
        pool = index if condition is None else index.where(condition)
        found = _scored(_continued(asked, pool, k, cosine, store if condition is None else None, targets, want), pool)
    found = found.join(targets, "query_id")
    kept = fl.apply_filters(found, _C("target_subsystem"), _C("target_bug_type"), _C("target_version"), query="query_id")
    order = Window.partitionBy("query_id").orderBy(F.round("boosted_score", 10).desc(), "uncertain", "pos")
    kept = kept.withColumn("order_no", F.row_number().over(order))
    if mode == FAST:
        return kept.withColumns({"rank": _C("order_no"), "vector_score": _C("score"), "final_score": _C("score")})
    if mode == DEEP and answers is not None:
        scores = rk.parse_judge(answers.select("query_id", "answer"), "answer", judged or k).select(
            "query_id", (_C("index") + 1).alias("order_no"), _C("judge_score").alias("_said"), "judge_reason")
        kept, judge = kept.join(scores, ["query_id", "order_no"], "left"), "_said"
    return rk.rerank(kept if rerank_k is None else kept.where(_C("order_no") <= rerank_k), scorer=scorer,
                     judge=judge if mode == DEEP else None)


def store_of(index: DataFrame, path: str, metric: str = "cosine") -> vs.StoredIndex:
    """A stored index of the rows' vectors and labels; below ``FLAT_BELOW`` rows one cell is enough."""
    rows = index.select("id", "vec", label_of(_C("subsystem"), _C("bug_type")).alias("label"))
    return vs.create(rows, path, "flat" if rows.count() < vs.FLAT_BELOW else "ivf", metric)


def text_queries(df: DataFrame, dim: int = 512) -> DataFrame:
    """Free-text queries (query_id, query_text): no targets, so only ranking applies."""
    return ve.encode_text(df, "query_text", "vec", dim).withColumns({
        "target_subsystem": F.lit("unknown"), "target_bug_type": F.lit(""), "target_version": F.lit("")})


def bug_type_queries(df: DataFrame, dim: int = 512) -> DataFrame:
    """(query_id, bug_type, subsystem) to labelled query texts."""
    text = F.concat_ws("\n", F.concat(F.lit("RootCause: "), F.translate("bug_type", "_", " ")),
                       F.concat(F.lit("BugType: "), _C("bug_type")),
                       F.when(_C("subsystem") != "unknown", F.concat(F.lit("Subsystem: "), _C("subsystem"))))
    q = ve.encode_text(df.withColumn("query_text", text), "query_text", "vec", dim)
    return q.withColumns({"target_subsystem": _C("subsystem"), "target_bug_type": F.lit(""), "target_version": F.lit("")})


def diagnose(logs: DataFrame) -> DataFrame:
    """Raw logs (crash_id, content) to diagnosed crashes; row-local, no shuffle."""
    return logs.transform(cx.parse_logs).transform(cx.analyze_root_cause)


def query_key(df: DataFrame) -> DataFrame:
    """Adds ``query_key``: equal for crashes with equal query text, subsystem, bug type and version."""
    return df.withColumn("query_key", F.sha2(F.concat_ws("\x1f", "retrieval_query", "subsystem", "bug_type", "kernel_version"), 256))


def crash_queries(diagnosed: DataFrame, dim: int = 512) -> DataFrame:
    """One query per distinct key: equal crashes search once, however many copies a key has
    (the grouping keeps one row per key map-side)."""
    distinct = query_key(diagnosed).groupBy("query_key").agg(
        F.min("crash_id").alias("query_id"), F.any_value("retrieval_query").alias("query_text"),
        F.any_value("subsystem").alias("target_subsystem"), F.any_value("bug_type").alias("target_bug_type"),
        F.any_value("kernel_version").alias("target_version"))
    return ve.encode_text(distinct, "query_text", "vec", dim)


def diagnose_and_retrieve(logs: DataFrame, index: DataFrame, mode: str = FAST, k: int = 100, top: int = 5,
                          store: vs.StoredIndex | None = None) -> DataFrame:
    """Every crash log with its root cause and its top patches; one row without patch where none survives the filters.

    The search goes on until ``top`` patches survive, however many copies and rejected releases stand before them.
    """
    crashes = cut(query_key(diagnose(logs).select(
        "crash_id", "retrieval_query", "subsystem", "bug_type", "kernel_version", "root_cause",
        _C("score").alias("confidence"), "rule_id")))
    queries = cut(crash_queries(crashes))
    ranked = cut(retrieve(queries, index, mode, k, filter_first=True, want=top, store=store).where(_C("rank") <= top).select(
        "query_key", "query_id", "rank", "commit_hash", "subject", _C("subsystem").alias("patch_subsystem"),
        _C("bug_type").alias("patch_bug_type"), "vector_score", "final_score"))
    # at most ``top`` rows per key with a known size: broadcast while small, else a skew-split join
    return crashes.select("crash_id", "query_key", "root_cause", "subsystem", "bug_type", "confidence", "rule_id").join(
        ranked, "query_key", "left").drop("query_key")
