"""Centroid clustering over Hilbert-ordered blocks with zone maps.

Vectors are sorted along a Hilbert curve through all their dimensions and cut into blocks, and each block keeps the box of its vectors
(smallest and largest component) and their sum. In every round a block's box bounds its distance to each centroid: a
centroid that is farther than another one everywhere in the box is no candidate of the block. Blocks with one candidate give
their stored sum without a look at their vectors; the rows of the others are compared, exactly, with the candidates only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import cut

SIZE, SCALE = 64, 1024
CENTROIDS, ROUNDS = 8, 10
BLOCK_ROWS = 256
PARTITION_ROWS = 65_536
CURVE_BITS = 4  # a dimension; the curve's key has SIZE * CURVE_BITS bits
LARGEST = 2 ** 26  # components beyond it would take squared distances out of a long


def kept_vectors(rows: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """row, vec_id, v: integers floor(scale * x) of the vectors with exactly ``size`` components, none null or non-finite.

    Rows are numbered, so that repeated ones stay apart; a row without vec_id is clustered like any other. A component of 2^26
    or more after scaling stops the job with an error.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = (F.size("embedding") == size) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole_number = lambda c: F.when(F.abs(c * scale) < LARGEST, F.floor(c * scale).cast("int")).otherwise(
        F.raise_error(F.lit(f"a scaled component reaches {LARGEST}")).cast("int"))
    return rows.filter(F.col("embedding").isNotNull() & whole).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, whole_number).alias("v"))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid cells (below 2^bits in every dimension), as big-endian bytes.

    The cells' coordinates are turned into the curve's transposed index bit by bit: from the highest bit on, a set bit reflects the lower bits
    of the first dimension, a clear one swaps them with the first dimension's; Gray coding of the dimensions follows.
    """
    x = cells.astype(np.uint32).T.copy()  # dimension by row
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, lower = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for d in range(dims):
            inside = (x[d] & bit) != 0
            swap = np.where(inside, np.uint32(0), (x[0] ^ x[d]) & lower)
            x[0] ^= np.where(inside, lower, np.uint32(0)) ^ swap
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flips = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where(x[-1] & np.uint32(1 << level), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= flips
    planes = (x[None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)[:, None, None]) & 1  # highest bits of all dimensions first
    return np.packbits(planes.reshape(bits * dims, -1).T.astype(np.uint8), axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks_of(kept: DataFrame, block_rows: int = BLOCK_ROWS, partition_rows: int = PARTITION_ROWS, bits: int = CURVE_BITS) -> DataFrame:
    """ids, v (int32 matrix, row by row), low, high, total: blocks along the curve.

    The curve's grid spans each dimension's range. Ranges of keys go to tasks by sampled bounds; the row number is part of the order, so a
    vector that very many rows repeat is spread over tasks too.
    """
    size = kept.select(F.size("v")).first()
    if size is None:
        return kept.sparkSession.createDataFrame([], "ids array<bigint>, v binary, low array<int>, high array<int>, total array<bigint>")
    size = size[0]
    ends = kept.agg(F.count("*").alias("n"), *[f(F.get("v", i)).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(size)]).first()
    low = np.array([ends[f"min{i}"] for i in range(size)], float)
    width = np.array([ends[f"max{i}"] for i in range(size)], float) - low + 1

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = ((_matrix(b.column("v")) - low) / width * (1 << bits)).astype(np.uint32) if b.num_rows else np.zeros((0, size), np.uint32)
            keys = hilbert_keys(cells, bits)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([k.tobytes() for k in keys], pa.binary())], names=[*b.schema.names, "key"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], np.zeros((0, size), np.int32)

        def out(ids: list, v: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([ids], pa.list_(pa.int64())), pa.array([v.tobytes()], pa.binary()), pa.array([v.min(0).tolist()], pa.list_(pa.int32())),
                pa.array([v.max(0).tolist()], pa.list_(pa.int32())), pa.array([v.sum(0, dtype=np.int64).tolist()], pa.list_(pa.int64()))],
                names=["ids", "v", "low", "high", "total"])

        for b in batches:
            ids += b.column("vec_id").to_pylist()
            held = np.concatenate([held, _matrix(b.column("v")).astype(np.int32)]) if b.num_rows else held
            while len(ids) >= block_rows:
                yield out(ids[:block_rows], held[:block_rows])
                ids, held = ids[block_rows:], held[block_rows:]
        if ids:
            yield out(ids, held)

    parts = max(kept.sparkSession.sparkContext.defaultParallelism, -(-ends["n"] // partition_rows))
    curve = cut(kept.mapInArrow(keyed, "row bigint, vec_id bigint, v array<int>, key binary"), "curve")
    return (curve.repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row")
            .mapInArrow(pack, "ids array<bigint>, v binary, low array<int>, high array<int>, total array<bigint>"))


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers, ascending, of the centroids that can be nearest to some point of the box (all arguments int64).

    A centroid whose least distance exceeds another's largest one goes; then one that is farther than the box middle's nearest centroid
    at every corner: the difference of two squared distances is linear, so each dimension has its largest value at an end.
    """
    outside = np.maximum(0, np.maximum(low - centroids, centroids - high))
    reach = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    may = (outside ** 2).sum(1) <= (reach ** 2).sum(1).min()
    first = int(((low + high - 2 * centroids) ** 2).sum(1).argmin())
    slope = 2 * (centroids - centroids[first])
    most = np.maximum(slope * low, slope * high).sum(1) + (centroids[first] ** 2).sum() - (centroids ** 2).sum(1)
    may &= most >= 0  # largest value of d(x, first) - d(x, centroid); below 0 the first is strictly nearer everywhere
    may[first] = True
    return np.nonzero(may)[0]


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by centroid: by matrix product where doubles hold them, else by 64-bit integers."""
    largest = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * v.shape[1] * largest * largest < 2 ** 53:
        x, c = v.astype(float), centroids.astype(float)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]).astype(np.int64)
    return np.stack([((v.astype(np.int64) - c) ** 2).sum(1) for c in centroids], axis=1)


def _blocks(b: pa.RecordBatch, size: int):
    lows, highs, totals = (_matrix(b.column(c)).astype(np.int64) if b.num_rows else () for c in ("low", "high", "total"))
    for i in range(b.num_rows):
        yield b.column("ids")[i], np.frombuffer(b.column("v")[i].as_buffer(), np.int32).reshape(-1, size), lows[i], highs[i], totals[i]


def _round(blocks: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid's next place. A task adds up its blocks; the sums of tasks meet by (centroid, dimension)."""
    now, size = np.array(centroids, np.int64), len(centroids[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(now), np.int64), np.zeros((len(now), size), np.int64)
        for b in batches:
            for _, v, low, high, block_total in _blocks(b, size):
                near = candidates(low, high, now)
                if len(near) == 1:
                    count[near[0]] += len(v)
                    total[near[0]] += block_total
                    continue
                owner = near[distances(v, now[near]).argmin(1)]
                count += np.bincount(owner, minlength=len(now))
                for j in near:
                    total[j] += v[owner == j].sum(0, dtype=np.int64)
        used = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))],
                                         names=["cluster", "n", "total"])

    added = (blocks.select("v", "low", "high", "total", F.expr("cast(null as array<bigint>)").alias("ids"))
             .mapInArrow(sums, "cluster int, n bigint, total array<bigint>").select("cluster", "n", F.posexplode("total").alias("at", "x"))
             .groupBy("cluster", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect())  # centroids x dimensions rows
    moved = [list(c) for c in centroids]
    for r in added:
        moved[r.cluster][r["at"]] = r.x // r.n  # Python's // is floor at any size
    return moved


def first_centroids(kept: DataFrame, k: int = CENTROIDS) -> list[list[int]]:
    """The k vectors with the smallest sha256 of ``3:<vec_id>``; equal ids go by vector, rows without vec_id come last."""
    mark = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    return [list(r.v) for r in kept.orderBy(mark.asc_nulls_last(), "v").limit(k).select("v").collect()]


def cluster(kept: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row for each row of ``kept`` (the written ``kept_vectors``).

    Ties go to the smaller centroid number; a centroid without vectors stays where it is. Tables with fewer than k rows start with as many
    centroids; an empty table gives no rows. The driver holds the k centroids only. Rounds after one that moves nothing would repeat it and are left out.
    """
    blocks = cut(blocks_of(kept, block_rows, partition_rows), "blocks")
    centroids = first_centroids(kept, k)
    for _ in range(rounds if centroids else 0):
        moved = _round(blocks, centroids)
        if moved == centroids:
            break
        centroids = moved
    size = len(centroids[0]) if centroids else 0
    now = np.array(centroids, np.int64).reshape(len(centroids), size)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, v, low, high, _ in _blocks(b, size):
                near = candidates(low, high, now)
                d = distances(v, now[near])
                best = d.argmin(1)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(near[best].astype(np.int32)), pa.array(d[np.arange(len(v)), best])],
                                                 names=["vec_id", "cluster", "distance"])

    rows = cut(blocks.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint"), "clusters")
    inertia = {r.cluster: r.x for r in rows.groupBy("cluster").agg(F.sum("distance").alias("x")).collect()}  # at most k rows
    of = lambda xs, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in xs]), F.col("cluster") + 1)
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    if not centroids:
        return rows.withColumns({"cluster_inertia": F.lit(0).cast("bigint"), "inertia": F.lit(0).cast("bigint"), "centroid_sha256": F.lit("")})
    return rows.withColumns({"cluster_inertia": of([inertia.get(j, 0) for j in range(len(centroids))], "bigint"),
                             "inertia": F.lit(sum(inertia.values())).cast("bigint"), "centroid_sha256": of(marks, "string")})


def cluster_table(embeddings: DataFrame) -> DataFrame:
    """Clusters of a whole embeddings table; extra columns are ignored."""
    return cluster(cut(kept_vectors(embeddings), "kept"))


def candidate_share(blocks: DataFrame, centroids: list[list[int]]) -> float:
    """Share of (row, centroid) pairs that the boxes leave to compare; blocks with one candidate compare none."""
    now = np.array(centroids, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, v, low, high, _ in _blocks(b, now.shape[1]):
                near = len(candidates(low, high, now))
                yield pa.RecordBatch.from_arrays([pa.array([len(v) * len(now)]), pa.array([len(v) * near if near > 1 else 0])], names=["pairs", "compared"])
    r = blocks.mapInArrow(count, "pairs bigint, compared bigint").agg(F.sum("compared") / F.sum("pairs")).first()
    return float(r[0] or 0.0)


def kmeans_sql(k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> str:
    """The same clustering as SQL: one pair of subqueries a round."""
    floor = "((s - ((s % n) + n) % n) // n)"
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS c, v AS w FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) <= {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, v, c, d FROM (SELECT r, vec_id, v, c, list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
  FROM v CROSS JOIN c{i}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m, w) AS w FROM c{i} LEFT JOIN (SELECT c, list({floor} ORDER BY p) AS m FROM
  (SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{i}) GROUP BY c, p) GROUP BY c) USING (c))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""
