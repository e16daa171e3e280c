"""Hard-negative mining with Fagin's threshold algorithm.

Every shard of candidates holds one sorted list per dimension. An anchor reads each list from its good end (from the top where
its component is positive, from the bottom where it is negative), scores every row that it meets by random access, and
stops once the threshold, the best score that a row not met yet can have, lies strictly below the k-th score of each of
its windows, or once all rows that count are met; when most of them are met, the rest are met at once, without their places in the lists. First the best rows of the anchor's own label are found, then, between two shares of each one's score, rows of other labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import cut, hinted

SHARD_ROWS = 20_000
ANCHORS_PER_TASK = 100_000
EXACT = 2 ** 53
_FIRST_DEPTH = 8
_OUT = 20_000


class SortedLists:
    """The sorted lists of a shard: row numbers by ascending component, one list a dimension."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.vectors, self.ids, self.labels, self.rows = vectors, ids, labels, rows
        self.order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)
        self.values = np.take_along_axis(vectors.T, self.order, axis=1)
        self.largest = float(np.abs(vectors).max()) if vectors.size else 0.0
        self.met = 0  # random accesses so far
        self.read = 0  # places of lists read so far

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Integer inner products, exact at any size."""
        if self.largest * float(np.abs(anchor).max(initial=0)) * max(1, len(anchor)) < EXACT:
            # of most rows: multiplied in place, without a copy of their vectors
            return ((self.vectors @ anchor)[at] if 2 * len(at) > len(self.vectors) else self.vectors[at] @ anchor).astype(np.int64)
        a = [int(x) for x in anchor]
        return np.array([sum(int(x) * y for x, y in zip(v, a)) for v in self.vectors[at]], dtype=object)

    def first(self, fit: np.ndarray, scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """Places of the k first of the fitting rows by (score desc, id, row)."""
        places = np.nonzero(fit)[0]
        if len(places) <= k or scores.dtype == object:
            return places
        held = scores[places]
        places = places[held >= np.partition(held, len(held) - k)[len(held) - k]]
        return places[np.lexsort((self.rows[at[places]], self.ids[at[places]], -scores[places]))[:k]]

    def search(self, anchor: np.ndarray, row: int, label: int, same: bool, windows: list[tuple], k: int) -> list[list[tuple]]:
        """For each (lowest, highest) window the k best (score, id, row number) of the rows that have (``same``) or do not have the
        label, without the anchor's own row; ties to the smaller id."""
        n, live = len(self.ids), np.nonzero(anchor)[0]
        whole = len(live) == len(anchor)  # then the lists serve as they are, without a copy for each anchor
        weight, lists, values = anchor[live], self.order if whole else self.order[live], self.values if whole else self.values[live]
        up, each = weight > 0, np.arange(len(live))
        may = ((self.labels == label) == same) & (self.rows != row)
        counting = np.count_nonzero(may)
        seen = np.zeros(n, bool)
        best: list[list[tuple]] = [[] for _ in windows]

        def threshold(depth: int) -> float:
            """No row that all lists hold at ``depth`` or later scores more. Sums of doubles: raised by their rounding."""
            if depth >= n:
                return -np.inf
            parts = weight * values[each, np.where(up, n - 1 - depth, depth)]
            return float(parts.sum()) + float(np.abs(parts).sum()) * 1e-12

        def target(j: int):
            return best[j][-1][0] if len(best[j]) == k else windows[j][0]

        depth, wanted = 0, min(n, _FIRST_DEPTH)
        if not len(live):  # a zero anchor: all rows score 0 and no list can be ranked
            wanted = n
        while wanted > depth:
            new = np.zeros(n, bool)
            if wanted < n and len(live):
                self.read += len(live) * (wanted - depth)
                new[lists[up, n - wanted:n - depth].ravel()] = True
                new[lists[~up, depth:wanted].ravel()] = True
            else:
                new[:] = True
            new &= ~seen
            seen |= new
            depth = wanted
            at = np.nonzero(new & may)[0]
            self.met += len(at)
            scores = self.scores(at, anchor)
            for j, (low, high) in enumerate(windows):
                fit = (scores >= low) & (scores <= high) if len(at) else np.zeros(0, bool)
                if len(best[j]) == k:
                    fit &= scores >= best[j][-1][0]
                fit = self.first(fit, scores, at, k)
                found = list(zip(scores[fit].tolist(), self.ids[at[fit]].tolist(), self.rows[at[fit]].tolist()))
                best[j] = sorted(best[j] + found, key=lambda x: (-x[0], x[1], x[2]))[:k]
            least = min(target(j) for j in range(len(windows)))
            left = np.count_nonzero(may & ~seen)
            if threshold(depth) < least or not left:  # or no row is left to meet
                break
            if 2 * left < counting:  # the lists mostly hold rows met before: the rest are met at once
                wanted = n
                continue
            low, high = depth, n  # the first depth at which the threshold lies below what is held now
            while low < high:
                middle = (low + high) // 2
                low, high = (low, middle) if threshold(middle) < least else (middle + 1, high)
            wanted = min(low, 2 * depth)
        return best


def labelled_vectors(rows: DataFrame, relabel_every: int = 7) -> DataFrame:
    """row, vec_id, label, v (floor(256 * x) as doubles), n (components) of the rows that take part.

    Rows without vec_id or label, and vectors that are null or hold null or non-finite components, take no part. Rows are
    numbered, so that rows which repeat a vec_id stay apart. The label of a vec_id divisible by ``relabel_every`` becomes (label + 1) % 10.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    vec_id, label = F.col("vec_id").cast("bigint"), F.col("label").cast("bigint")
    return (rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole)
            .select(F.monotonically_increasing_id().alias("row"), vec_id.alias("vec_id"),
                    F.when(vec_id % relabel_every == 0, (label + 1) % 10).otherwise(label).alias("label"),
                    F.transform(x, lambda c: F.when(F.abs(c) < 2.0 ** 44, F.floor(c * 256).cast("double")).otherwise(c * 256)).alias("v")).withColumn("n", F.size("v")))


_ROW = "row bigint, vec_id bigint, label bigint, v array<double>"
_FOUND = "row bigint, anchor_id bigint, asked bigint, other_row bigint, other_id bigint, score bigint"


def _meet(rows: DataFrame, anchors: DataFrame, key: list[str], same: bool, k: int) -> DataFrame:
    """Every anchor to the candidates of its key. Rows of a key come sorted to one task, candidates first: the lists are built once and
    the anchors pass by in batches, so a task holds one shard however many anchors it answers."""
    of = F.struct(*key).alias("key")
    cells = (rows.select(of, F.lit(0).alias("kind"), *_names(_ROW), F.expr("cast(null as array<bigint>)").alias("scores"))
             .unionByName(anchors.select(of, F.lit(1).alias("kind"), *_names(_ROW), "scores")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, lists, out = None, [], None, []
        for batch in batches:
            cols = {name: batch.column(name) for name in batch.schema.names}
            keys, kinds = cols["key"].to_pylist(), cols["kind"].to_numpy()
            ids, row_no, labels = (cols[c].to_numpy() for c in ("vec_id", "row", "label"))
            bounds = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or kinds[i] != kinds[i - 1]), len(keys)]
            for lo, hi in zip(bounds, bounds[1:]):
                if lo == hi:
                    continue
                if keys[lo] != key:
                    key, held, lists = keys[lo], [], None
                part = cols["v"].slice(lo, hi - lo)
                v = part.flatten().to_numpy().reshape(hi - lo, -1) if len(part.flatten()) else np.zeros((hi - lo, 0))
                if kinds[lo] == 0:
                    held.append((v, ids[lo:hi], labels[lo:hi], row_no[lo:hi]))
                    continue
                if not held and lists is None:
                    continue
                if lists is None:
                    lists, held = SortedLists(*(np.concatenate(x) for x in zip(*held))), []
                asked = cols["scores"].slice(lo, hi - lo).to_pylist()
                for i in range(hi - lo):
                    marks = sorted(set(asked[i])) if asked[i] is not None else [None]
                    windows = [(-np.inf, np.inf) if p is None else (-(-50 * p // 100), 95 * p // 100) for p in marks]
                    open_ = [j for j, (low, high) in enumerate(windows) if low <= high]
                    if not open_:
                        continue
                    found = lists.search(v[i], row_no[lo + i], labels[lo + i], same, [windows[j] for j in open_], k)
                    out += [(int(row_no[lo + i]), int(ids[lo + i]), marks[j], r, c, s) for j, hits in zip(open_, found) for s, c, r in hits]
                    if len(out) >= _OUT:
                        yield _batch(out)
                        out = []
        yield _batch(out)

    n = max(rows.sparkSession.sparkContext.defaultParallelism, rows.select(*key).distinct().count())
    return (cells.repartition(n, "key").sortWithinPartitions("key", "kind").mapInArrow(run, _FOUND))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _batch(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) if out else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_names(_FOUND))


def mine(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, shard_rows: int = SHARD_ROWS,
         anchors_per_task: int = ANCHORS_PER_TASK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: the (written) table of ``labelled_vectors``. Anchors are the rows whose vec_id is divisible by ``every``; each row of a repeated
    vec_id is an anchor and a candidate of its own. Vectors meet only those with as many components. Labels with many rows are
    dealt into shards by row number, so equal rows spread; an anchor without positives or without fitting rows has no result,
    and an empty table gives none. Ties go to the smaller vec_id, then to the earlier row.
    """
    anchors = rows.filter(F.col("vec_id") % every == 0)

    def dealt(df: DataFrame, of: list[str]) -> tuple[DataFrame, DataFrame]:
        """(rows with shard and block, anchors once for each shard of theirs), by the counted rows and anchors of ``of``."""
        sizes = cut(df.groupBy(*of).agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")).join(
            anchors.groupBy(*of).agg(F.ceil(F.count("*") / anchors_per_task).cast("int").alias("blocks")), of), "shards")
        sizes = hinted(sizes, 64)
        of_row = lambda by: F.pmod(F.xxhash64("row"), F.col(by)).cast("int")
        every_of = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
        left = df.join(sizes, of).withColumn("shard", of_row("shards")).withColumn("block", every_of("blocks"))
        return left, sizes.select(*of, "shards", "blocks").withColumn("shard", every_of("shards")).drop("shards")

    asked = anchors.withColumn("scores", F.expr("cast(null as array<bigint>)"))
    left, cells = dealt(rows, ["label", "n"])
    right = asked.join(cells, ["label", "n"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    found = _meet(left, right, ["label", "n", "shard", "block"], True, positives)
    own = Window.partitionBy("row").orderBy(F.col("score").desc(), "other_id", "other_row")
    best = cut(found.withColumn("place", F.row_number().over(own)).filter(F.col("place") <= positives)
               .select("row", "anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"), "place"), "positives")

    asked = anchors.join(best.groupBy("row").agg(F.collect_set("positive_score").alias("scores")), "row")  # at most ``positives`` scores
    left, cells = dealt(rows, ["n"])
    right = asked.join(cells, "n").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    found = _meet(left, right, ["n", "shard", "block"], False, negatives)
    window = Window.partitionBy("row", "asked").orderBy(F.col("score").desc(), "other_id", "other_row")
    hits = (found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= negatives)
            .select("row", F.col("asked").alias("positive_score"), "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score")))
    return best.join(hits, ["row", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def mine_table(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of a whole embeddings table; extra columns are ignored."""
    return mine(cut(labelled_vectors(embeddings), "labelled"))
