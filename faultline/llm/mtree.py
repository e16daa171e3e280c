"""Exact top-k inner product search with M-trees.

Each vector x gets one more coordinate, sqrt(M^2 - |x|^2), and a query q gets 0; M is the largest norm of the tree. Then
|q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>, so the nearest points of a metric space are the largest inner products. The rows are
dealt by nearness to pivots into shards of bounded size. In a round, a task builds a shard's tree once and the queries that the shard may serve pass by it
in batches; a query first visits the shard that can hold its largest score, and its k-th score there goes with it to the others, which it visits only
if their bound reaches it. Best-first search opens pages by their lower bound; stored parent distances skip entries without computing their distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .shared import cut, hinted

SHARD_ROWS = 20_000
PIVOTS = 4096  # at most; they travel to all tasks
EXACT = 2 ** 53
PAGE = 256
FANOUT = 16
_SLACK = 1e-6  # far above the rounding of distances, far below a step of integer scores for bounds kept


@dataclass
class Page:
    """A node: entries of a routing page are pages, those of a leaf are rows. ``to_parent``: distance of every entry's pivot
    (row) to this page's pivot, stored when the tree is built."""
    pivot: np.ndarray
    radius: float
    points: np.ndarray | None = None  # leaf: rows x dimension
    ids: np.ndarray | None = None
    rows: np.ndarray | None = None
    children: list["Page"] = field(default_factory=list)
    to_parent: np.ndarray | None = None
    radii: np.ndarray | None = None
    pivots: np.ndarray | None = None


class MTree:
    """Bulk-loaded from integer vectors (as doubles); ids are any integers, and ``rows`` (the ids, if not given) tell rows of one id apart."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None, page: int = PAGE, fanout: int = FANOUT):
        squares = np.einsum("ij,ij->i", vectors, vectors)
        self.limit = float(squares.max()) if len(vectors) else 0.0
        points = np.column_stack([vectors, np.sqrt(np.maximum(self.limit - squares, 0))])
        self.computed = 0
        self.root = self._build(points, ids, ids if rows is None else rows, page, fanout) if len(vectors) else None

    def _build(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, page: int, fanout: int) -> Page:
        pivot = points.mean(0)
        distance = np.sqrt(((points - pivot) ** 2).sum(1))
        node = Page(pivot, float(distance.max()))
        if len(points) <= page or (points == points[0]).all():  # the mean of equal rows is rounded: their radius need not be 0
            order = np.argsort(distance, kind="stable")
            node.points, node.ids, node.rows, node.to_parent = points[order], ids[order], rows[order], distance[order]
            return node
        # farthest-first pivots, each row to its nearest one; then groups are evened by cutting large ones again below
        chosen = [int(distance.argmax())]
        near = ((points - points[chosen[0]]) ** 2).sum(1)
        owner = np.zeros(len(points), int)
        while len(chosen) < min(fanout, len(points)) and near.max() > 0:
            chosen.append(int(near.argmax()))
            d = ((points - points[chosen[-1]]) ** 2).sum(1)
            owner[d < near] = len(chosen) - 1
            near = np.minimum(near, d)
        for k in range(len(chosen)):
            mine = owner == k
            if mine.any():
                node.children.append(self._build(points[mine], ids[mine], rows[mine], page, fanout))
        node.pivots = np.stack([c.pivot for c in node.children])
        node.radii = np.array([c.radius for c in node.children])
        node.to_parent = np.sqrt(((node.pivots - pivot) ** 2).sum(1))
        return node

    def search(self, query: np.ndarray, own: int, k: int, floor: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (score, id) of at least ``floor``, ties to the smaller id; the row ``own`` takes no part."""
        if self.root is None:
            return []
        q = np.append(query, 0.0)
        shift = float(query @ query) + self.limit
        best: list[tuple[float, int]] = []  # heap of (score, -id): the worst on top
        at_score = lambda score: np.sqrt(max(0.0, shift - 2 * score)) * (1 + _SLACK) + _SLACK  # noqa: E731  distance of a score
        bound = np.inf if floor == -np.inf else at_score(floor)  # the k-th distance so far
        first = float(np.sqrt(((q - self.root.pivot) ** 2).sum()))
        heap = [(max(0.0, first - self.root.radius), 0, first, self.root)]
        n = 1
        while heap:
            low, _, d, node = heapq.heappop(heap)
            if low > bound:
                break
            # |d(q, parent) - d(entry, parent)| - radius bounds an entry's distance without computing it
            radii = 0.0 if node.radii is None else node.radii
            near = np.abs(d - node.to_parent) - radii <= bound
            if node.points is None:
                at = np.nonzero(near)[0]
                distances = np.sqrt(((node.pivots[at] - q) ** 2).sum(1))
                self.computed += len(at)
                for j, dj in zip(at, distances):
                    if (lj := max(0.0, float(dj) - node.radii[j])) <= bound:
                        heapq.heappush(heap, (lj, n, float(dj), node.children[j]))
                        n += 1
                continue
            self.computed += int(near.sum())
            scores = node.points[near][:, :-1] @ query
            better = (scores >= (best[0][0] if len(best) == k else floor)) & (node.rows[near] != own)
            for score, i in zip(scores[better].tolist(), node.ids[near][better].tolist()):
                if len(best) < k:
                    heapq.heappush(best, (score, -i))
                elif (score, -i) > best[0]:
                    heapq.heapreplace(best, (score, -i))
            if len(best) == k:
                bound = min(bound, at_score(best[0][0]))
        return [(int(s), -i) for s, i in sorted(best, reverse=True)]


def integer_vectors(rows: DataFrame) -> DataFrame:
    """row, vec_id and v: floor(256 * x) of every component as a double.

    Vectors that are null, or hold null or non-finite components, and rows without vec_id take no part. Rows are numbered, so that
    rows which repeat a vec_id stay apart.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = lambda c: F.when(F.abs(c) < 2.0 ** 44, F.floor(c * 256).cast("double")).otherwise(c * 256)  # noqa: E731  whole beyond that
    return (rows.filter(F.col("vec_id").isNotNull() & whole)
            .select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, scaled).alias("v")))


def exact_search(vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best by whole numbers of any size, for shards whose products doubles do not hold."""
    q = [int(x) for x in query]
    scored = [(-sum(int(x) * y for x, y in zip(v, q)), int(i)) for v, i, r in zip(vectors, ids, rows) if r != own]
    return [(-s, i) for s, i in heapq.nsmallest(k, scored)]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def _sharded(rows: DataFrame, shard_rows: int) -> DataFrame:
    """Rows with n (components), shard and split: the nearest of their length's pivots, and a part of it by row number where very many rows are near.

    Pivots are rows taken by hash, one for each ``shard_rows`` rows, PIVOTS at most.
    """
    rows = rows.withColumn("n", F.size("v"))
    counts = rows.groupBy("n").agg(F.least(F.ceil(F.count("*") / shard_rows), F.lit(PIVOTS)).cast("int").alias("want"))
    drawn = Window.partitionBy("n").orderBy(F.xxhash64("row"), "row")
    picked = rows.join(F.broadcast(counts), "n").withColumn("_p", F.row_number().over(drawn)).filter(F.col("_p") <= F.col("want"))
    pivots: dict[int, list] = {}
    for r in picked.select("n", "v").limit(PIVOTS).collect():
        pivots.setdefault(r.n, []).append(r.v)
    sent = rows.sparkSession.sparkContext.broadcast({n: np.array(x, float).reshape(len(x), n) for n, x in pivots.items()})

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, shard = b.column("n").to_numpy(), np.zeros(b.num_rows, np.int32)
            for size in np.unique(n):
                at = np.nonzero(n == size)[0]
                v, p = _matrix(b.column("v").take(pa.array(at))), sent.value.get(int(size))
                if p is not None and len(p) > 1:
                    shard[at] = (v @ p.T - (p * p).sum(1) / 2).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard)], names=[*b.schema.names, "shard"])

    dealt = cut(rows.mapInArrow(near, "row bigint, vec_id bigint, v array<double>, n int, shard int"), "sharded")
    parts = dealt.groupBy("n", "shard").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("_parts"))
    return dealt.join(hinted(cut(parts, "parts"), 32), ["n", "shard"]).withColumn("split", F.pmod(F.xxhash64("row"), F.col("_parts")).cast("int")).drop("_parts")


_FOUND = "row bigint, query_id bigint, vec_id bigint, score bigint"


def _visit(rows: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """Queries (row, vec_id, v, floor) to the shards (n, shard, split) they visit. A shard's rows come first and become its tree; the queries follow."""
    key = F.struct("n", "shard", "split").alias("key")
    both = (rows.select(key, F.lit(0).alias("kind"), "row", "vec_id", "v", F.lit(0.0).alias("floor"))
            .unionByName(visits.select(key, F.lit(1).alias("kind"), "row", "vec_id", "v", "floor")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree, largest, out = None, [], None, 0.0, []
        for b in batches:
            keys, kinds = b.column("key").to_pylist(), b.column("kind").to_numpy()
            row, ids, floor = (b.column(c).to_numpy() for c in ("row", "vec_id", "floor"))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or kinds[i] != kinds[i - 1]), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if keys[lo] != key:
                    key, held, tree = keys[lo], [], None
                v = _matrix(b.column("v").slice(lo, hi - lo))
                if kinds[lo] == 0:
                    held.append((v, ids[lo:hi], row[lo:hi]))
                    continue
                if tree is None and held:
                    shard = [np.concatenate(x) for x in zip(*held)]
                    tree, largest, held = MTree(*shard), float(np.abs(shard[0]).max(initial=0)), []
                if tree is None:
                    continue
                for q, i, own, low in zip(v, ids[lo:hi].tolist(), row[lo:hi].tolist(), floor[lo:hi].tolist()):
                    exact = largest * float(np.abs(q).max(initial=0)) * max(1, len(q)) < EXACT
                    found = tree.search(q, own, k, low) if exact else exact_search(*shard, q, own, k)
                    out += [(own, i, c, s) for s, c in found]
                if len(out) > 20_000:
                    yield batch(out)
                    out = []
        yield batch(out)

    def batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 4)], names=[x.split()[0] for x in _FOUND.split(", ")])

    parts = max(rows.sparkSession.sparkContext.defaultParallelism, rows.select("n", "shard", "split").distinct().count())
    return both.repartition(parts, "key").sortWithinPartitions("key", "kind").mapInArrow(run, _FOUND)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products for each query row.

    ``rows`` and ``queries`` have row, vec_id and v. All rows but the query's own are its candidates; a repeated vec_id is a candidate once per row, and each
    row of a repeated query is a query. Vectors meet only those of their own length. A task holds one shard of about ``shard_rows`` rows, whatever the number of
    queries; rows that are alike are split by row number. Scores are exact at any size; those beyond a long stop the job.
    """
    sharded = cut(_sharded(rows, shard_rows), "shards")
    shards = cut(_balls(sharded), "balls")
    asked = queries.select("row", "vec_id", "v", F.size("v").alias("n"))
    # a query and the shards of its length: bounds of blocks of queries, not rows, decide; a shard is one row of 20,000
    bounds = cut(asked.join(hinted(shards, 1024), "n").select("row", "n", "shard", "split", (_dot("v", "centre") + _norm("v") * F.col("radius")).alias("bound")), "bounds")
    first = bounds.groupBy("row").agg(F.max_by(F.struct("shard", "split"), F.struct("bound", F.struct("shard", "split"))).alias("s"))
    home = first.select("row", F.col("s.shard").alias("shard"), F.col("s.split").alias("split"))
    best = cut(_visit(sharded, asked.join(home, "row").withColumn("floor", F.lit(float("-inf"))), k), "found")
    kth = best.groupBy("row").agg(F.count("*").alias("found"), F.min("score").alias("kth")).filter(F.col("found") == k).select("row", F.col("kth").cast("double").alias("floor"))
    rest = bounds.join(home, ["row", "shard", "split"], "left_anti").join(kth, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    rest = rest.filter(F.col("bound") + F.abs("bound") * 1e-9 + 1 >= F.col("floor")).select("row", "shard", "split", "floor")
    more = _visit(sharded, asked.join(rest, "row"), k)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return (best.unionByName(more).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _dot(a: str, b: str) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _norm(v: str) -> F.Column:
    return F.sqrt(_dot(v, v))


def _balls(sharded: DataFrame) -> DataFrame:
    """n, shard, split, centre, radius of each shard: mean vector and largest distance to it, with room for rounding."""
    long = sharded.select("n", "shard", "split", F.posexplode("v").alias("at", "x")).groupBy("n", "shard", "split", "at").agg(F.avg("x").alias("m"))
    centre = long.groupBy("n", "shard", "split").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "m"))), lambda p: p["m"]).alias("centre"))
    centre = sharded.select("n", "shard", "split").distinct().join(centre, ["n", "shard", "split"], "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<double>")))
    apart = F.aggregate(F.zip_with("v", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    radius = (sharded.join(hinted(centre.select("n", "shard", "split", "centre"), 1024), ["n", "shard", "split"]).groupBy("n", "shard", "split")
              .agg(F.max(F.sqrt(apart)).alias("radius")))
    return centre.join(radius, ["n", "shard", "split"]).select("n", "shard", "split", "centre", (F.col("radius") * (1 + 1e-9) + 1e-6).alias("radius"))


def search_table(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows. An empty table gives no rows."""
    rows = cut(integer_vectors(embeddings), "vectors")
    return top_k(rows, rows.filter(F.col("vec_id") % every == 0), k)
