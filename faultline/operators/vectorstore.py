"""Stored vector indexes: a folder of cells with centroids, radii and a manifest, and searches that open few of its files.

Layout of an index: ``rows/cell=<n>/`` holds the vectors (and any other columns) of a cell, ``centroids/`` each cell's centroid, radius and
number of rows, ``edges/`` the neighbour graph of kind ``graph``, and ``manifest/``, written last, one row about the whole. A folder without manifest is no index.

Search by bounds. Queries are gathered in blocks around the centroid they are nearest to. For a block with radius R around p and a
cell with radius r around c, no inner product exceeds p.c + |p| r + R |c| + R r. A block visits its cells by falling bound, in
few rounds; each round's worst k-th score ends the visits of the block at the first cell whose bound is lower. So neither queries × rows nor queries ×
cells are ever formed, and the files of cells that no block visits are not opened.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..plans.stage import cut, fresh
from . import index as ix, vectors as ve

KINDS, METRICS = ("flat", "ivf", "graph"), ("ip", "cosine", "l2")
FLAT_BELOW = 1000
SAMPLE_PER_CELL = 64  # k-means learns from at most this many rows a cell
ITERATIONS = 5
BLOCK_QUERIES = 256
SPLIT_BYTES = 64 << 20  # vectors of a cell that one task holds
QUERIES_PER_TASK = 200_000
ROUNDS = (4, 32)  # cells that a block may have visited after each round; the last round has no limit
FILE_ROWS = 1_000_000
SLACK = 1e-9


@dataclass
class StoredIndex:
    """An index folder, opened: its manifest, and centroids as (cell, vec, radius, n)."""
    spark: SparkSession
    path: str
    kind: str
    metric: str
    dim: int
    lists: int
    rows_n: int
    schema: str

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")  # no file is opened to learn the schema

    @property
    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/centroids")

    @property
    def edges(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/edges")


def lists_for(n: int) -> int:
    """Number of cells for n vectors."""
    return max(100, min(4096, int(2 * math.sqrt(max(n, 100)))))


def exists(spark: SparkSession, path: str) -> bool:
    return ix.exists_index(spark, f"{path}/manifest/_SUCCESS")


def drop(spark: SparkSession, path: str) -> bool:
    """Delete an index; False where there is none. The manifest goes first, so that no reader finds half an index."""
    there = exists(spark, path)
    ix.drop_index(spark, f"{path}/manifest")
    ix.drop_index(spark, path)
    return there


def open_index(spark: SparkSession, path: str) -> StoredIndex:
    if not exists(spark, path):
        raise FileNotFoundError(f"no index at {path}")
    m = spark.read.parquet(f"{path}/manifest").first()
    return StoredIndex(spark, path, m.kind, m.metric, m.dim, m.lists, m.n, m.schema)


def create(corpus: DataFrame, path: str, kind: str = "ivf", metric: str = "ip", lists: int | None = None, replace: bool = False,
           neighbours: int = 16, seed: int = 42) -> StoredIndex:
    """Write an index of ``corpus`` (id bigint, vec, further columns) and open it. One that exists is opened as it is, unless ``replace``.

    Centroids are learned from a sample of at most SAMPLE_PER_CELL rows a cell, taken by hash of the id; every row is indexed. Kinds: ``flat`` (one cell),
    ``ivf``, and ``graph``, an ``ivf`` with edges to ``neighbours`` near rows each. Rows without vector are left out.
    """
    spark = corpus.sparkSession
    if kind not in KINDS or metric not in METRICS:
        raise ValueError(f"kinds: {KINDS}, metrics: {METRICS}")
    if exists(spark, path) and not replace:
        return open_index(spark, path)
    drop(spark, path)
    corpus = corpus.where("vec IS NOT NULL AND id IS NOT NULL")
    n = corpus.count()
    first = corpus.select(F.size("vec").alias("dim")).first()
    dim = first.dim if first else 0
    k = 1 if kind == "flat" or not n else min(lists or lists_for(n), n)
    centres = _centres(corpus, k, n, metric, seed)
    _write_cells(_assigned(corpus, centres, metric), centres, path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in corpus.schema.fields) + ", cell int"
    if kind == "graph":
        _write_edges(StoredIndex(spark, path, kind, metric, dim, len(centres), n, schema), neighbours)
    spark.createDataFrame([(kind, metric, dim, len(centres), n, schema)], "kind string, metric string, dim int, lists int, n bigint, schema string").coalesce(1).write.parquet(f"{path}/manifest")
    return open_index(spark, path)


def temporary(corpus: DataFrame, metric: str) -> StoredIndex:
    """An inverted file in the shared stage folder, for one search of very many queries."""
    return create(corpus, fresh(corpus.sparkSession), "ivf", metric)


def _space(m: np.ndarray, metric: str) -> np.ndarray:
    """The vectors that centroids and radii are about: of length 1 for cosine."""
    return m / ve._unit(m)[:, None] if metric == "cosine" else m


def _centres(corpus: DataFrame, k: int, n: int, metric: str, seed: int) -> np.ndarray:
    if not n:
        return np.zeros((0, 0))
    share = min(1.0, k * SAMPLE_PER_CELL / n)
    by_hash = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= int(share * (1 << 20))
    v = F.col("vec").cast("array<double>")
    picked = corpus.where(by_hash).select("id", (ve.l2_normalize(v) if metric == "cosine" else v).alias("v")).orderBy(F.xxhash64("id"), "id").limit(k * SAMPLE_PER_CELL)
    sample = cut(picked)
    if k == 1:
        return np.array([r.v for r in sample.select("v").collect()]).mean(0, keepdims=True)
    centres = ve._matrix(sample.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).select("v").toArrow().column("v"))
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    sample = cut(sample.select("v").repartition(cores))  # the sample is one file, which would be one task
    for _ in range(ITERATIONS):
        centres = _moved(sample, centres, cores)
    return centres


def _moved(sample: DataFrame, centres: np.ndarray, parts: int) -> np.ndarray:
    """A step of k-means: the mean of the rows nearest to each centroid, which stays where it is without any. Sums meet by cell, so the driver gets one row a cell."""
    sent, dim = sample.sparkSession.sparkContext.broadcast(centres), centres.shape[1]

    def table(cells: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * dim), pa.array(sums.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), flat, pa.array(counts.astype(np.int64))], names=["cell", "v", "n"])

    def total(at: np.ndarray, m: np.ndarray, sums: np.ndarray, counts: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        cells, first = np.unique(at[order], return_index=True)
        sums[cells] += np.add.reduceat(m[order], first)
        counts[cells] += np.add.reduceat(n[order], first)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        sums, counts = np.zeros(c.shape), np.zeros(len(c), np.int64)
        for b in batches:
            if b.num_rows:
                m = ve._matrix(b.column("v"))
                total(_homes(m, c)[0], m, sums, counts, np.ones(len(m), np.int64))
        met = np.nonzero(counts)[0]
        yield table(met, sums[met], counts[met])

    def joined(t: pa.Table) -> pa.Table:
        cells, at = np.unique(t.column("cell").to_numpy(), return_inverse=True)
        sums, counts = np.zeros((len(cells), dim)), np.zeros(len(cells), np.int64)
        total(at, ve._matrix(t.column("v")), sums, counts, t.column("n").to_numpy())
        return pa.Table.from_batches([table(cells, sums, counts)])

    kinds = "cell int, v array<double>, n bigint"
    rows = sample.mapInArrow(nearest, kinds).groupBy(F.pmod("cell", F.lit(parts))).applyInArrow(joined, kinds).toArrow()
    out, at = centres.copy(), rows.column("cell").to_numpy()
    out[at] = ve._matrix(rows.column("v")) / rows.column("n").to_numpy()[:, None]
    return out


def _assigned(corpus: DataFrame, centres: np.ndarray, metric: str) -> DataFrame:
    """Rows with their nearest cell and the distance to its centroid. At most 4096 centroids travel."""
    sent = corpus.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        half = (c * c).sum(1) / 2 if len(c) else c
        for b in batches:
            if not b.num_rows:
                continue
            m = _space(ve._matrix(b.column("vec")), metric)
            cell = np.concatenate([(m[lo:lo + 2048] @ c.T - half).argmax(1) for lo in range(0, len(m), 2048)])
            apart = np.sqrt(((m - c[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(apart)], names=[*b.schema.names, "cell", "apart"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in corpus.schema.fields)
    return corpus.mapInArrow(assign, f"{kinds}, cell int, apart double")


def _write_cells(assigned: DataFrame, centres: np.ndarray, path: str) -> None:
    spark = assigned.sparkSession
    rows = cut(assigned)
    sizes = {r.cell: (r.n, r.radius) for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()}  # one row a cell
    files = F.lit(1)
    for cell, (n, _) in sizes.items():
        if n > FILE_ROWS:
            files = F.when(F.col("cell") == cell, F.lit(-(-n // FILE_ROWS))).otherwise(files)
    salted = rows.drop("apart").withColumn("_salt", F.pmod(F.xxhash64("id"), files))
    salted.repartition("cell", "_salt").drop("_salt").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("cell").parquet(f"{path}/rows")
    if not sizes:  # partitioned writes leave nothing of an empty table
        rows.drop("apart").write.mode("overwrite").parquet(f"{path}/rows")
    table = [(i, [float(x) for x in c], float(sizes[i][1]) * (1 + SLACK) + SLACK, sizes[i][0]) for i, c in enumerate(centres) if i in sizes]
    spark.createDataFrame(table, "cell int, vec array<double>, radius double, n bigint").coalesce(1).write.parquet(f"{path}/centroids")


# --- search by bounds ---------------------------------------------------------------------------

def block_bounds(p: np.ndarray, big: float, centres: np.ndarray, radii: np.ndarray, metric: str) -> np.ndarray:
    """Largest score that a query within ``big`` of ``p`` can have with a row of each cell."""
    if metric == "l2":
        return -np.maximum(0, np.sqrt(((centres - p) ** 2).sum(1)) - radii - big) ** 2
    length = np.sqrt((centres * centres).sum(1))
    return centres @ p + np.sqrt(p @ p) * radii + big * (length + radii)


def _centroid_arrays(index: StoredIndex) -> tuple[np.ndarray, ...]:
    rows = index.centroids.orderBy("cell").toArrow()  # at most 4096
    return rows.column("cell").to_numpy(), ve._matrix(rows.column("vec")), rows.column("radius").to_numpy(), rows.column("n").to_numpy()


def search(index: StoredIndex, queries: DataFrame, k: int, digits: int = 6, exact: bool = True, probes: int | None = None,
           max_bytes: int = ve.MAX_BROADCAST_BYTES, work: list[int] | None = None) -> DataFrame:
    """Top-k of a stored index: (query_id, id, score, rank), the rows of ``vectors.topk`` by the index's metric (score of l2: minus the squared distance).

    With ``exact=False`` each block of queries visits its ``probes`` (32) best cells only. ``work`` takes the products (query, row) that each round computes.
    """
    queries, sets = ve.asked_columns(queries)
    return search_cells(index, queries, sets, k, digits, None if exact else probes or 32, max_bytes, work)


def search_cells(index: StoredIndex, queries: DataFrame, sets: list[list[str]] | None, k: int, digits: int = 6, probes: int | None = None,
                 max_bytes: int = ve.MAX_BROADCAST_BYTES, work: list[int] | None = None) -> DataFrame:
    spark, work = index.spark, [] if work is None else work
    empty = spark.createDataFrame([], ve.HITS + ", rank int")
    if not index.rows_n:
        return empty
    cap = max(1, max_bytes // (8 * (index.dim + 4)))
    rows = queries.limit(cap + 1).toArrow()
    if not rows.num_rows:
        return empty
    if rows.num_rows > cap:
        return _search_many(index, queries, sets, k, digits, probes, work)
    return _search_few(index, rows, sets, k, digits, probes, work)


def _homes(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector, and the distance to it."""
    half = (centres * centres).sum(1) / 2
    home = np.concatenate([(vectors[lo:lo + 2048] @ centres.T - half).argmax(1) for lo in range(0, len(vectors), 2048)])
    return home, np.sqrt(((vectors - centres[home]) ** 2).sum(1))


def _search_few(index: StoredIndex, rows: pa.Table, sets, k: int, digits: int, probes: int | None, work: list[int]) -> DataFrame:
    """Queries of a checked size travel to the files of the cells that their blocks visit; the rows stay where they are."""
    cells, centres, radii, sizes = _centroid_arrays(index)
    asked = ve.Asked.of(rows, sets)
    points = _space(asked.vectors, index.metric)
    home, apart = _homes(points, centres)
    order = np.lexsort((apart, home))
    cuts = [0, *(i for i in range(1, len(order)) if home[order[i]] != home[order[i - 1]]), len(order)]
    blocks = [order[lo:min(lo + BLOCK_QUERIES, hi)] for a, hi in zip(cuts, cuts[1:]) for lo in range(a, hi, BLOCK_QUERIES)]
    bounds = [block_bounds(centres[home[b[0]]], float(apart[b].max()), centres, radii, index.metric) + 10.0 ** -digits for b in blocks]
    falling = [np.argsort(-x, kind="stable") for x in bounds]
    visited, floor, best = np.zeros(len(blocks), int), np.full(len(home), -np.inf), None
    sc = index.spark.sparkContext
    sent = sc.broadcast(vars(asked))
    for limit in (probes,) if probes else (*ROUNDS, None):
        wanted: dict[int, list[np.ndarray]] = {}
        for b, block in enumerate(blocks):
            low = floor[block].min()
            for at in falling[b][visited[b]:limit]:
                if bounds[b][at] < low:
                    break
                # of the block, those queries whose own bound reaches their k-th score
                own = points[block] @ centres[at] + np.sqrt((points[block] ** 2).sum(1)) * radii[at] + 10.0 ** -digits if index.metric != "l2" else np.inf
                if len(mine := block[own >= floor[block]]):
                    wanted.setdefault(int(cells[at]), []).append(mine)
            visited[b] = len(cells) if limit is None else limit
        if not wanted:
            continue
        n_of = dict(zip(cells.tolist(), sizes.tolist()))
        work.append(sum(n_of[c] * sum(map(len, x)) for c, x in wanted.items()))
        visits = sc.broadcast({c: np.concatenate(x) for c, x in wanted.items()})
        floors = sc.broadcast(floor.copy())
        found = _scan(index, sent, visits, floors, sorted(wanted), k, digits, sets is not None)
        found = ve.rank_hits(found if best is None else found.unionByName(best.drop("rank")), k)
        if limit is None or probes:
            return found
        best = cut(found)
        last = best.where(F.col("rank") == k).select("query_id", "score").toArrow()  # one row a query, of a checked number
        kth = dict(zip(last.column("query_id").to_pylist(), last.column("score").to_pylist()))
        floor = np.array([kth.get(x, -np.inf) for x in asked.names.tolist()])
    return best


def _scan(index: StoredIndex, sent, visits, floors, cells: list[int], k: int, digits: int, labelled: bool) -> DataFrame:
    metric = index.metric
    rows = index.rows.where(F.col("cell").isin(cells)).select("id", "vec", "cell", *["label"] * labelled)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = ve.Asked(**sent.value)
        top = asked.top(k, metric, digits, floors.value)
        for b in batches:
            of = b.column("cell").to_numpy()
            for c in np.unique(of):
                at = np.nonzero(of == c)[0]
                part = b.take(pa.array(at)) if len(at) < len(of) else b
                top.add(np.asarray(part.column("id"), dtype=np.int64), ve._matrix(part.column("vec")), part.column("label").to_pylist() if labelled else None,
                        visits.value[int(c)])
        yield from ve.hit_batches(asked.names, top)
    return rows.mapInArrow(scan, ve.HITS)


def _search_many(index: StoredIndex, queries: DataFrame, sets, k: int, digits: int, probes: int | None, work: list[int]) -> DataFrame:
    """Any number of queries. Blocks are rows: (block, home, reach, n); a round's visits are (block, cell) rows, and queries and rows meet by cell."""
    spark, metric = index.spark, index.metric
    cells, centres, radii, _ = _centroid_arrays(index)
    sent = spark.sparkContext.broadcast((cells, centres, radii))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, apart = _homes(_space(ve._matrix(b.column("vec")), metric), sent.value[1])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(apart)], names=[*b.schema.names, "home", "apart"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)
    homed = cut(queries.mapInArrow(home, f"{kinds}, home int, apart double"))
    parts = homed.groupBy("home").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("bigint").alias("parts"))
    # a block: a home and a part of its queries, by hash
    block = (F.col("home").cast("bigint") * (1 << 40) + F.pmod(F.xxhash64("query_id"), F.col("parts"))).alias("block")
    asked = cut(homed.join(F.broadcast(parts), "home").withColumn("block", block).drop("parts"))
    blocks = asked.groupBy("block").agg(F.first("home").alias("home"), F.max("apart").alias("reach"), F.count("*").alias("n"))
    best, done = None, 0
    for limit in (probes,) if probes else (*ROUNDS, None):
        state = blocks.withColumn("low", F.lit(float("-inf")))
        if best is not None:
            full = asked.select("query_id", "block").join(best.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth")), "query_id", "left")
            low = full.groupBy("block").agg(F.min(F.coalesce("kth", F.lit(float("-inf")))).alias("low"))
            state = blocks.join(low, "block")

        def visits(batches: Iterator[pa.RecordBatch], done=done, limit=limit) -> Iterator[pa.RecordBatch]:
            cells, centres, radii = sent.value
            for b in batches:
                names, to = [], []
                for name, at, reach, low in zip(*(b.column(c).to_pylist() for c in ("block", "home", "reach", "low"))):
                    bound = block_bounds(centres[at], reach, centres, radii, metric) + 10.0 ** -digits
                    order = np.argsort(-bound, kind="stable")[done:limit]
                    order = order[bound[order] >= low]
                    names += [name] * len(order)
                    to += cells[order].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(to, pa.int32())], names=["block", "cell"])

        wanted = cut(state.select("block", "home", "reach", "low").mapInArrow(visits, "block bigint, cell int"))
        done = limit
        if wanted.isEmpty():
            continue
        work.append(wanted.join(blocks.select("block", "n"), "block").join(index.centroids.select("cell", F.col("n").alias("_n")), "cell").agg(F.sum(F.col("n") * F.col("_n"))).first()[0])
        found = _meet(index, asked, blocks, wanted, best, sets, k, digits)
        found = ve.rank_hits(found if best is None else found.unionByName(best.drop("rank")), k)
        if limit is None or probes:
            return found
        best = cut(found)
    return best


def _meet(index: StoredIndex, asked: DataFrame, blocks: DataFrame, wanted: DataFrame, best: DataFrame | None, sets, k: int, digits: int) -> DataFrame:
    """Queries to the rows of the cells that their block visits. Rows of a task's part of a cell come first and are held (bounded), queries follow in batches."""
    split_rows = max(1024, SPLIT_BYTES // (8 * max(1, index.dim)))
    sizes = (wanted.join(blocks.select("block", "n"), "block").groupBy("cell").agg(F.sum("n").alias("asked"))
             .join(index.centroids.select("cell", "n"), "cell")
             .select("cell", F.ceil(F.col("n") / split_rows).cast("int").alias("splits"), F.ceil(F.col("asked") / QUERIES_PER_TASK).cast("int").alias("shares")))
    sizes = cut(sizes)  # at most one row a cell
    names = [r.cell for r in sizes.select("cell").collect()]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    if best is not None:
        asked = asked.join(best.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor")), "query_id", "left")
    else:
        asked = asked.withColumn("floor", F.lit(None).cast("double"))
    asked = asked.withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    labelled = sets is not None
    own = [c for c in ("set_no", "after_score", "after_id") if c in asked.columns]
    kinds = {f.name: f.dataType for f in asked.schema.fields}
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    left = (index.rows.where(F.col("cell").isin(names)).join(F.broadcast(sizes), "cell")
            .withColumn("split", F.pmod(F.xxhash64("id"), F.col("splits")).cast("int")).withColumn("share", every("shares"))
            .select("cell", "split", "share", F.lit(0).alias("kind"), "id", F.col("vec").cast("array<double>").alias("vec"), *["label"] * labelled,
                    none("query_id", "bigint"), none("floor", "double"), *[none(c, kinds[c]) for c in own]))
    right = (wanted.join(asked, "block").join(F.broadcast(sizes), "cell")
             .withColumn("share", F.pmod(F.xxhash64("query_id"), F.col("shares")).cast("int")).withColumn("split", every("splits"))
             .select("cell", "split", "share", F.lit(1).alias("kind"), none("id", "bigint"), F.col("vec").cast("array<double>").alias("vec"), *[none("label", "string")] * labelled,
                     "query_id", "floor", *own))
    metric = index.metric

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, rows = None, [], None
        for b in batches:
            at = np.stack([b.column(c).to_numpy() for c in ("cell", "split", "share", "kind")], axis=1)
            cuts = [0, *(np.nonzero((at[1:] != at[:-1]).any(1))[0] + 1).tolist(), len(at)] if len(at) else [0, 0]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if tuple(at[lo][:3]) != key:
                    key, held, rows = tuple(at[lo][:3]), [], None
                part = b.slice(lo, hi - lo)
                if at[lo][3] == 0:
                    held.append((part.column("id").to_numpy(), ve._matrix(part.column("vec")), part.column("label").to_pylist() if labelled else None))
                    continue
                if rows is None and held:
                    rows = (np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [x for h in held for x in h[2]] if labelled else None)
                    held = []
                if rows is None:
                    continue
                mine = ve.Asked.of(part, sets)
                top = mine.top(k, metric, digits, part.column("floor").to_numpy())
                top.add(*rows)
                yield from ve.hit_batches(mine.names, top)

    n = max(index.spark.sparkContext.defaultParallelism, sizes.agg(F.sum(F.col("splits") * F.col("shares"))).first()[0] or 1)
    return (left.unionByName(right).repartition(min(n, 20_000), "cell", "split", "share").sortWithinPartitions("cell", "split", "share", "kind")
            .mapInArrow(run, ve.HITS))


# --- neighbour graph ----------------------------------------------------------------------------

REFINEMENTS = 2
OVERLAP, ENTRY_CELLS = 3, 3


def _similar(metric: str):
    """Scores of pairs of rows, in Arrow batches: (x, y) array columns to score; other columns pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = ve._matrix(b.column("x")), ve._matrix(b.column("y"))
            s = -((x - y) ** 2).sum(1) if metric == "l2" else (x * y).sum(1)
            if metric == "cosine":
                s = s / (ve._unit(x) * ve._unit(y))
            kept = [n for n in b.schema.names if n not in ("x", "y")]
            yield pa.RecordBatch.from_arrays([*map(b.column, kept), pa.array(np.round(s, 6) + 0.0)], names=[*kept, "score"])
    return run


def _nearest_of(pairs: DataFrame, n: int) -> DataFrame:
    """The n best-scored neighbours of each row; a row that very many others point to is thinned by salt."""
    from . import aggregates as ag
    return ag.top_n_per_group(pairs, ["id"], [F.desc("score"), F.asc("nbr")], n, "nbr", salts=16).select("id", "nbr", "score")


def _write_edges(index: StoredIndex, neighbours: int) -> None:
    """``edges/``: (id, nbr, nbr_cell). Every row joins the groups of its OVERLAP nearest cells (a large cell has several), and its first neighbours are the nearest
    of its groups, so cells are linked; then neighbours of neighbours, in both directions, are scored and the best are kept, REFINEMENTS times. Links between entry
    rows of near cells are added for long steps."""
    metric, spark = index.metric, index.spark
    rows = cut(index.rows.select("id", F.col("vec").cast("array<double>").alias("vec"), "cell"))
    part = max(256, min(4096, SPLIT_BYTES // (8 * max(1, index.dim))))
    cells, centres, _, _ = _centroid_arrays(index)
    sent = spark.sparkContext.broadcast((cells, centres))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, centres = sent.value
        half = (centres * centres).sum(1) / 2
        for b in batches:
            m = _space(ve._matrix(b.column("vec")), metric) if b.num_rows else np.zeros((0, centres.shape[1]))
            near = np.argsort(-(m @ centres.T - half), axis=1, kind="stable")[:, :OVERLAP]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(cells[near].tolist(), pa.list_(pa.int32()))], names=["id", "vec", "groups"])

    in_groups = cut(rows.select("id", "vec").mapInArrow(groups, "id bigint, vec array<double>, groups array<int>"))
    many = in_groups.select("id", "vec", F.explode("groups").alias("cell"))
    sizes = many.groupBy("cell").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))  # one row a cell
    dealt = many.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def within(t: pa.Table) -> pa.Table:
        top = ve._TopK(ve._matrix(t.column("vec")), neighbours + 1, metric)
        ids = t.column("id").to_numpy()
        top.add(ids, top.q)
        q, s, i = top.merge()
        keep = ids[q] != i
        return pa.table({"id": ids[q[keep]], "nbr": i[keep], "score": s[keep]})

    found = dealt.select("cell", "part", "id", "vec").groupBy("cell", "part").applyInArrow(within, "id bigint, nbr bigint, score double")
    edges = cut(_nearest_of(found.dropDuplicates(["id", "nbr"]), neighbours))
    vec = rows.select("id", "vec")
    for _ in range(REFINEMENTS):
        both = edges.select("id", "nbr").union(edges.select(F.col("nbr").alias("id"), F.col("id").alias("nbr")))
        far = both.select(F.col("id").alias("a"), F.col("nbr").alias("b")).join(edges.select(F.col("id").alias("b"), F.col("nbr").alias("c")), "b").select(F.col("a").alias("id"), F.col("c").alias("nbr"))
        new = cut(far.union(both).where("id <> nbr").distinct())
        scored = (new.join(vec.withColumnRenamed("vec", "x"), "id").join(vec.select(F.col("id").alias("nbr"), F.col("vec").alias("y")), "nbr")
                  .select("id", "nbr", "x", "y").mapInArrow(_similar(metric), "id bigint, nbr bigint, score double"))
        edges = cut(_nearest_of(scored, neighbours))
    # an edge serves both ways, or a row that is nobody's neighbour could not be reached
    edges = edges.select("id", "nbr").union(_across(index, rows))
    reached = edges.union(edges.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"))).distinct()
    reached.join(rows.select(F.col("id").alias("nbr"), F.col("cell").alias("nbr_cell")), "nbr").select("id", "nbr", "nbr_cell").write.parquet(f"{index.path}/edges")
    _entries(rows, index).write.parquet(f"{index.path}/entries")


def _entries(rows: DataFrame, index: StoredIndex) -> DataFrame:
    """(cell, id): each cell's row nearest to its centroid."""
    scored = rows.join(F.broadcast(index.centroids.select("cell", F.col("vec").alias("y"))), "cell").select("cell", "id", F.col("vec").alias("x"), "y")
    near = scored.mapInArrow(_similar("l2" if index.metric == "l2" else "cosine"), "cell int, id bigint, score double")
    return near.groupBy("cell").agg(F.max_by("id", F.struct("score", "id")).alias("id"))


def _across(index: StoredIndex, rows: DataFrame) -> DataFrame:
    """(id, nbr): links from each cell's entry row to those of the four nearest cells."""
    cells, centres, _, _ = _centroid_arrays(index)
    square = (centres * centres).sum(1)
    apart = square[:, None] + square[None] - 2 * centres @ centres.T
    np.fill_diagonal(apart, np.inf)
    near = [(int(cells[i]), int(cells[j])) for i in range(len(cells)) for j in np.argsort(apart[i], kind="stable")[:min(4, len(cells) - 1)]]
    pairs = index.spark.createDataFrame(near, "cell int, other int")  # four rows a cell
    entry = cut(_entries(rows, index))
    return entry.join(F.broadcast(pairs), "cell").join(entry.select(F.col("cell").alias("other"), F.col("id").alias("nbr")), "other").select("id", "nbr")


def search_graph(index: StoredIndex, queries: DataFrame, k: int, ef: int = 64, beam: int = 16, max_rounds: int = 100) -> DataFrame:
    """Approximate top-k by steps along the graph: (query_id, id, score, rank). ``search`` on the same index is the exact way.

    A query holds its ``ef`` best rows so far. It starts from the entry rows of its nearest cells; in each round the best ``beam`` rows that have
    not been left yet send it to their neighbours, which are scored, and it ends when all its ``ef`` rows have been left. A round is joins of at most
    ``beam`` rows a query; rows are read from the cells of their neighbours only. ``max_rounds`` ends a search that would not end.
    """
    if index.kind != "graph":
        raise ValueError("this index has no neighbour graph")
    spark, metric = index.spark, index.metric
    queries, _ = ve.asked_columns(queries.drop("allowed", "after_score", "after_id"))
    asked = cut(queries.select("query_id", F.col("vec").cast("array<double>").alias("x")))
    if asked.isEmpty() or not index.rows_n:
        return spark.createDataFrame([], ve.HITS + ", rank int")
    cells, centres, _, _ = _centroid_arrays(index)
    sent = spark.sparkContext.broadcast((cells, centres))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, centres = sent.value
        half = (centres * centres).sum(1) / 2
        for b in batches:
            if b.num_rows:
                near = np.argsort(-(_space(ve._matrix(b.column("x")), metric) @ centres.T - half), axis=1, kind="stable")[:, :ENTRY_CELLS]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("query_id").to_numpy(), near.shape[1])), pa.array(cells[near.ravel()].astype(np.int32))], names=["query_id", "cell"])

    entries = spark.read.schema("cell int, id bigint").parquet(f"{index.path}/entries")
    start = asked.mapInArrow(enter, "query_id bigint, cell int").join(entries, "cell").select("query_id", "id", "cell")
    edges = spark.read.schema("id bigint, nbr bigint, nbr_cell int").parquet(f"{index.path}/edges")

    def scored(at: DataFrame) -> DataFrame:
        at = cut(at)
        used = [r.cell for r in at.select("cell").distinct().collect()]  # cells at most
        rows = index.rows.where(F.col("cell").isin(used)).select("id", F.col("vec").cast("array<double>").alias("y"))
        return at.join(rows, "id").join(asked, "query_id").select("query_id", "id", "x", "y").mapInArrow(_similar(metric), "query_id bigint, id bigint, score double")

    by_query = Window.partitionBy("query_id")
    best = by_query.orderBy(F.desc("score"), "id")
    state = cut(scored(start.distinct()).withColumn("left", F.lit(False)))
    for _ in range(max_rounds):
        open_ = state.where(~F.col("left")).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= beam).select("query_id", "id")
        if open_.isEmpty():
            break
        to = open_.join(edges, "id").select("query_id", F.col("nbr").alias("id"), F.col("nbr_cell").alias("cell")).distinct()
        to = to.join(state.select("query_id", "id"), ["query_id", "id"], "left_anti")
        gone = state.join(open_.withColumn("_open", F.lit(True)), ["query_id", "id"], "left").withColumn("left", F.col("left") | F.col("_open").isNotNull()).drop("_open")
        grown = gone.unionByName(scored(to).withColumn("left", F.lit(False)))
        state = cut(grown.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= ef).drop("_n"))
    return state.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")
