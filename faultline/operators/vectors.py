"""Vector operators: text encoding, exact top-k, recall statistics.

Exact search never materialises query × corpus pairs.  Each task multiplies its corpus rows with
a query block and emits at most k rows per query; only those meet in a shuffle.  Stored indexes are in ``vectorstore``.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numeric as nf, text as tf
from . import aggregates as ag

# Query blocks up to this size travel as a broadcast; larger ones meet the corpus by cell.
MAX_BROADCAST_BYTES = 64 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    # the norm is a lambda's argument, or Spark would compute it anew for each component
    norm = F.sqrt(dot(v, v)) + 1e-8
    return F.get(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x.cast("double") / n)), 0)


def _bucket(token: str, dim: int) -> int:
    return int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big") % dim


KEPT_TOKENS = 1 << 18
ROWS_AT_ONCE = 1000


def _token_counts(dim: int):
    """Counts by hash bucket of the tokens of texts that have a space wherever tokens end. A token is hashed once in a while, not wherever it stands."""
    @F.arrow_udf("array<float>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bucket = functools.lru_cache(KEPT_TOKENS)(lambda t: _bucket(t, dim) if t else -1)
        for texts in batches:
            parts = [pa.array([], pa.list_(pa.float32()))]
            for lo in range(0, len(texts), ROWS_AT_ONCE):
                tokens = pc.split_pattern(texts.slice(lo, ROWS_AT_ONCE), " ")
                words = tokens.flatten().dictionary_encode()
                of = np.fromiter(map(bucket, words.dictionary.to_pylist()), np.int64, len(words.dictionary))[words.indices.to_numpy()]
                row = np.repeat(np.arange(len(tokens)), np.diff(tokens.offsets.to_numpy()))
                found = of >= 0
                counts = np.bincount(row[found] * dim + of[found], minlength=len(tokens) * dim).astype(np.float32)
                parts.append(pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * dim), pa.array(counts)))
            yield pa.concat_arrays(parts)
    return count


def encode_text(df: DataFrame, text: str, out: str = "vec", dim: int = 512, encoder=None) -> DataFrame:
    """Term vectors of whole texts: counts of their tokens (runs of word characters, in lower case) by hash bucket.  ``encoder`` (a pandas UDF
    string -> array<float>) replaces the deterministic hashing encoder; cosine scoring normalises at search time."""
    if encoder is not None:
        return df.withColumn(out, encoder(F.col(text)))
    apart = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), rf"[^{tf.WORD}]+", " ")
    return df.withColumn(out, _token_counts(dim)(apart))


def label_centroids(df: DataFrame, label: str, vec: str, dim: int) -> DataFrame:
    """Mean vector per label (one shuffle of ``dim`` partial sums per label)."""
    means = df.groupBy(label).agg(*[F.avg(F.get(vec, i).cast("double")).alias(f"m{i}") for i in range(dim)])
    return means.select(label, F.array(*[f"m{i}" for i in range(dim)]).alias("vec"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(arr)
    return np.asarray(arr.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1))
    return np.where(n == 0, 1.0, n)


class _TopK:
    """Running k best (score desc, id asc) per query over any number of corpus batches.

    ``allowed``: (sets of labels, number of each query's set). ``after``: (score, id) marks; only rows behind a query's mark in that order count.
    ``floor``: scores below which a query needs no row. Hits are merged when as many wait as are kept, and each merge raises the floors.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str = "ip", digits: int = 6, allowed: tuple | None = None, after: tuple | None = None,
                 floor: np.ndarray | None = None):
        self.q, self.k, self.metric, self.digits, self.after = queries, k, metric, digits, after
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor.copy()
        self.codes: dict[str, int] | None = None
        if allowed is not None:
            sets, self.set_of = allowed
            self.codes = {x: i for i, x in enumerate(sorted({x for a in sets for x in a or ()}))}
            self.may = np.zeros((len(self.codes) + 1, len(sets)), bool)  # last row: labels that no query allows
            for j, a in enumerate(sets):
                self.may[[self.codes[x] for x in a or ()], j] = True
        self.qn = _unit(queries)
        self.kept = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        self.waiting: list[tuple] = []
        self.n_waiting = 0

    def scores(self, vecs: np.ndarray, vn: np.ndarray, which: np.ndarray) -> np.ndarray:
        sims = vecs @ self.q[which].T
        if self.metric == "cosine":
            sims /= vn[:, None] * self.qn[None, which]
        elif self.metric == "l2":
            sims = 2 * sims - (vecs * vecs).sum(1)[:, None] - (self.q[which] ** 2).sum(1)[None]
        return np.round(sims, self.digits) + 0.0

    def add(self, ids: np.ndarray, vecs: np.ndarray, labels: list[str] | None = None, which: np.ndarray | None = None) -> None:
        """Rows for the queries ``which`` (all, if not given)."""
        if not len(ids):
            return
        if self.codes is not None:
            label = np.array([self.codes.get(x, len(self.codes)) for x in labels])
        vn = _unit(vecs)
        which = np.arange(len(self.q)) if which is None else which
        for lo in range(0, len(which), 512):
            part = which[lo:lo + 512]
            sims = self.scores(vecs, vn, part)
            may = sims >= self.floor[part]
            if self.codes is not None:
                may &= self.may[label][:, self.set_of[part]]
            if self.after is not None:
                score, mark = self.after[0][part], self.after[1][part]
                may &= (sims < score) | ((sims == score) & (ids[:, None] > mark))
            if len(ids) > self.k:
                sims = np.where(may, sims, -np.inf)
                may &= sims >= np.partition(sims, len(ids) - self.k, axis=0)[len(ids) - self.k]
            rows, cols = np.nonzero(may)
            self.waiting.append((part[cols], sims[rows, cols], ids[rows]))
            self.n_waiting += len(rows)
        if self.n_waiting > max(len(self.kept[0]), 100_000):
            self.merge()

    def merge(self) -> tuple:
        """(query number, score, id) of the k best so far."""
        if self.waiting:
            q, s, i = (np.concatenate(p) for p in zip(self.kept, *self.waiting))
            order = np.lexsort((i, -s, q))
            q, s, i = q[order], s[order], i[order]
            place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
            keep = place < self.k
            self.kept, self.waiting, self.n_waiting = (q[keep], s[keep], i[keep]), [], 0
            last = place == self.k - 1
            self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
        return self.kept


HITS = "query_id bigint, id bigint, score double"


def hit_batches(names: np.ndarray, top: _TopK, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    q, s, i = top.merge()
    for lo in range(0, len(q), rows):
        yield pa.RecordBatch.from_arrays([pa.array(names[q[lo:lo + rows]]), pa.array(i[lo:lo + rows]), pa.array(s[lo:lo + rows])], ["query_id", "id", "score"])


def rank_hits(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query: thinned by salt first, since every task of a scan sends up to k."""
    return ag.top_n_per_group(hits, ["query_id"], [F.desc("score"), F.asc("id")], k, "id", salts=16)


def numbered_sets(queries: DataFrame) -> tuple[DataFrame, list[list[str]]]:
    """Queries with the number of their ``allowed`` set instead of it, and the distinct sets.

    The sets follow from the distinct targets of the queries, a fixed vocabulary; more than MAX_BROADCAST_BYTES of them are refused.
    """
    distinct = queries.select("allowed").distinct()
    size = distinct.agg(F.sum(F.length(F.array_join("allowed", " ")))).first()[0] or 0
    if size > MAX_BROADCAST_BYTES:
        raise ValueError(f"the distinct allowed sets hold {size} characters; {MAX_BROADCAST_BYTES} are the limit")
    sets = sorted([r.allowed or [] for r in distinct.collect()])
    number = queries.sparkSession.createDataFrame([("\x1f".join(x), i) for i, x in enumerate(sets)], "_set string, set_no int")
    named = queries.withColumn("_set", F.array_join(F.coalesce("allowed", F.array().cast("array<string>")), "\x1f"))
    return named.join(F.broadcast(number), "_set", "left").drop("_set", "allowed"), sets


@dataclass
class Asked:
    """Queries as arrays, for a task."""
    names: np.ndarray
    vectors: np.ndarray
    sets: list[list[str]] | None
    set_of: np.ndarray | None
    after: tuple | None

    @staticmethod
    def of(rows: pa.Table | pa.RecordBatch, sets: list[list[str]] | None) -> "Asked":
        names = np.asarray(rows.column("query_id").to_numpy(), dtype=np.int64)
        set_of = None if sets is None else np.asarray(rows.column("set_no").to_numpy(), dtype=np.int64)
        after = None
        if "after_id" in rows.schema.names:
            after = tuple(np.asarray(rows.column(c).to_numpy()) for c in ("after_score", "after_id"))
        return Asked(names, _matrix(rows.column("vec")), sets, set_of, after)

    def top(self, k: int, metric: str, digits: int, floor: np.ndarray | None = None) -> _TopK:
        return _TopK(self.vectors, k, metric, digits, None if self.sets is None else (self.sets, self.set_of), self.after, floor)


def asked_columns(queries: DataFrame) -> tuple[DataFrame, list[list[str]] | None]:
    """query_id, vec and what else a search reads of its queries: set_no for ``allowed``, after_score and after_id."""
    queries = queries.where("vec IS NOT NULL").select("query_id", "vec", *[c for c in ("allowed", "after_score", "after_id") if c in queries.columns])
    return numbered_sets(queries) if "allowed" in queries.columns else (queries, None)


def topk(queries: DataFrame, corpus: DataFrame, k: int, cosine: bool = False, digits: int = 6, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Exact top-k by inner product (or cosine): (query_id, id, score, rank).

    ``queries``: query_id bigint, vec[, allowed array<string>][, after_score, after_id]; ``corpus``: id bigint, vec[, label].
    With ``allowed``, only rows of an allowed label are candidates; with a mark, only rows behind it. Order is score (rounded to ``digits``)
    descending, then id. Queries whose size is checked to be small are broadcast and the corpus is scanned in place; more queries meet
    the cells of an inverted file that is written for them, block by block and only where bounds allow (``vectorstore``).
    """
    spark, metric = corpus.sparkSession, "cosine" if cosine else "ip"
    queries, sets = asked_columns(queries)
    corpus = corpus.where("vec IS NOT NULL").select("id", "vec", *["label"] * (sets is not None))
    probe = queries.select(F.size("vec").alias("n")).first()
    if probe is None:
        return spark.createDataFrame([], HITS + ", rank int")
    cap = max(1, max_bytes // (8 * (max(1, probe["n"]) + 3)))
    rows = queries.limit(cap + 1).toArrow()
    if rows.num_rows > cap:
        from . import vectorstore as vs
        return vs.search_cells(vs.temporary(corpus, metric), queries, sets, k, digits)
    block = spark.sparkContext.broadcast(vars(Asked.of(rows, sets)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Asked(**block.value)
        top = asked.top(k, metric, digits)
        for b in batches:
            if b.num_rows:
                top.add(np.asarray(b.column("id"), dtype=np.int64), _matrix(b.column("vec")), b.column("label").to_pylist() if sets is not None else None)
        yield from hit_batches(asked.names, top)
    return rank_hits(corpus.mapInArrow(scan, HITS), k)


# --- recall helpers -----------------------------------------------------------------------------

def normalize_recall(hits: DataFrame) -> DataFrame:
    """Raw inner products to [0,1] per query; raw value kept as ``distance``."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("distance", F.col("score")).withColumn("score", nf.recall_score(
        F.col("distance"), F.greatest(top, F.lit(0.0))))


def with_metadata(hits: DataFrame, meta: DataFrame, key: str = "id") -> DataFrame:
    """Attach index rows to hits; a hit without metadata keeps nulls.

    The index is first reduced to the hit ids (a semi join whose small side is the hits), so the
    outer join never moves the whole index.
    """
    wanted = meta.join(hits.select(key).distinct(), key, "left_semi")
    return hits.join(wanted, key, "left")


def recall_stats(hits: DataFrame) -> DataFrame:
    """hit_count and avg_distance per query."""
    return hits.groupBy("query_id").agg(F.count("*").alias("hit_count"), F.avg("distance").alias("avg_distance"))


def recall_counts(hits: DataFrame) -> DataFrame:
    """(query_id, facet, value, n): how many hits of a query each subsystem and bug type has, most frequent first in ``place``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c), F.lit("unknown")).alias("value")) for c in ("subsystem", "bug_type")]))
    counted = hits.select("query_id", pairs.alias("p")).groupBy("query_id", "p.facet", "p.value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("query_id", "facet").orderBy(F.desc("n"), "value")  # as many rows as values
    return counted.withColumn("place", F.row_number().over(order))


def post_filter(hits: DataFrame, expr: str | None) -> DataFrame:
    """Single equality applied after top-k (fewer than k rows may remain); no '==' keeps all rows."""
    if not expr or "==" not in expr:
        return hits
    field, value = expr.split("==", 1)
    field, value = field.strip(), value.strip().strip("'\"")
    if field not in hits.columns:
        return hits.where(F.lit(value == ""))
    return hits.where(F.coalesce(F.col(field).cast("string"), F.lit("")) == value)
