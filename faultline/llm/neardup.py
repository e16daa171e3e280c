"""Near-duplicate classes with DartMinHash signatures.

Text -> five-word shingles, weighted by how often they occur -> signature of K earliest darts -> bands -> candidate pairs -> exact
weighted Jaccard similarity >= 0.8 -> connected classes.

A shingle of weight w owns w unit columns of a half plane whose height is rank. Each column gets a Poisson stream of darts, drawn
from hashes of (shingle, copy, dart number), and each dart falls on one of K coordinates; the earliest dart of a coordinate is
its signature. Two texts share it with the probability of their weighted Jaccard similarity. Only darts below a rank limit are
drawn, about K ln K of them however long the text is; the limit doubles for texts with an empty coordinate.

Exact copies (equal word sequences) are one text from the first shuffle on. In a bucket, every text is compared with the
bucket's first one. The other texts of a bucket that are then still in different classes are compared in blocks, by matrix
products, so that no link between classes is lost and pairs of texts never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import cut, hinted, spare, spread_join, text_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
CACHE_WORDS = 500_000
BATCH_WORDS = 400_000
BLOCK = 1024


# --- hashing ------------------------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = x + _M3
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash; emptied at CACHE_WORDS."""

    def __missing__(self, word: str) -> int:
        import xxhash
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def words_of(text: str) -> list[str]:
    return text.lower().split()


def shingles(texts: list[str], hashes: WordHashes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, copy) of all texts: the copies of a shingle within its text count from 0.

    A text of fewer than ``size`` words is one shingle; a text without words has none. Sorted by row and shingle.
    """
    words = [words_of(t) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    padded = np.where(lengths > 0, np.maximum(lengths, size), 0)
    h = np.zeros(int(padded.sum()), np.uint64)
    starts = np.concatenate([[0], padded.cumsum()[:-1]]) if len(padded) else padded
    for w, at in zip(words, starts):
        if w:
            h[at:at + len(w)] = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    n = np.maximum(padded - size + 1, 0) * (padded > 0)
    row = np.repeat(np.arange(len(texts)), n)
    first = np.repeat(starts, n) + (np.arange(len(row)) - np.repeat(np.concatenate([[0], n.cumsum()[:-1]]), n))
    value = np.zeros(len(row), np.uint64)
    for j in range(size):
        value = mix(value ^ h[first + j])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    at = np.arange(len(row))
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    copy = at - np.maximum.accumulate(np.where(fresh, at, 0)) if len(at) else at
    return row, value, copy


def units(value: np.ndarray, copy: np.ndarray) -> np.ndarray:
    """One 64-bit name per unit column (shingle, copy): the weighted Jaccard of counts is the plain Jaccard of these names."""
    return mix(value ^ mix(copy.astype(np.uint64) * _M2))


def dart_signatures(row: np.ndarray, unit: np.ndarray, n_rows: int, k: int, last_weight: np.ndarray | None = None) -> np.ndarray:
    """n_rows x k earliest darts (64-bit names). Rows without units have zeros.

    ``last_weight`` (0 < w <= 1 per unit) gives a column's width, for weights that are not whole: a dart right of it misses.
    """
    earliest = np.full((n_rows, k), np.inf)
    name = np.zeros((n_rows, k), np.uint64)
    total = np.bincount(row, last_weight, n_rows)
    todo = total > 0
    limit = np.zeros(n_rows)
    limit[todo] = (k * np.log(k) + 2 * k) / total[todo]
    low = np.zeros(n_rows)  # darts below it were drawn
    while todo.any():
        mine = todo[row]
        r, u = row[mine], unit[mine]
        width = None if last_weight is None else last_weight[mine]
        rank, seed = np.zeros(len(r)), u
        while len(r):
            seed = mix(seed ^ _M1)
            uniform = ((seed >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53
            rank = rank - np.log(uniform)
            alive = rank < limit[r]
            r, u, rank, seed = r[alive], u[alive], rank[alive], seed[alive]
            if width is not None:
                width = width[alive]
            dart = mix(seed + _M2)
            hit = rank >= low[r]
            if width is not None:
                hit &= ((mix(dart ^ _M3) >> np.uint64(11)).astype(float) * 2.0 ** -53) < width
            coordinate = (dart % np.uint64(k)).astype(np.int64)
            hr, hc, hrank, hdart = r[hit], coordinate[hit], rank[hit], dart[hit]
            order = np.argsort(-hrank, kind="stable")  # the earliest is written last
            hr, hc, hrank, hdart = hr[order], hc[order], hrank[order], hdart[order]
            flat = hr * k + hc
            slot, last = np.unique(flat[::-1], return_index=True)
            pick = len(flat) - 1 - last
            best = earliest.ravel()
            better = hrank[pick] < best[slot]
            best[slot[better]] = hrank[pick][better]
            name.ravel()[slot[better]] = hdart[pick][better]
        todo &= ~np.isfinite(earliest).all(1)
        low[todo] = limit[todo]
        limit[todo] *= 2
    return name


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), bands)).copy()
    for j in range(rows):
        key = mix(key ^ signatures[:, j::rows][:, :bands])
    return key.view(np.int64)


# --- Spark --------------------------------------------------------------------------------------

def _parts(texts: list[str]) -> Iterator[slice]:
    lo, size = 0, 0
    for hi, t in enumerate(texts):
        size += len(t) // 5 + 1
        if size >= BATCH_WORDS:
            yield slice(lo, hi + 1)
            lo, size = hi + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, node (64-bit name of the word sequence, null without words), keys (one per band)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in _parts(texts):
                t = texts[part]
                row, value, copy = shingles(t, hashes)
                keys = band_keys(dart_signatures(row, units(value, copy), len(t), bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.start, len(t)), pa.array(node_names(t)), lists], names=["doc_id", "node", "keys"])

    rows_in = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows_in.mapInArrow(run, "doc_id bigint, node bigint, keys array<bigint>")


def node_names(texts: list[str]) -> pd.array:
    """64-bit name of each text's word sequence; null without words."""
    import xxhash
    joined = (" ".join(words_of(t)) for t in texts)
    # signed, as Spark's bigint
    return pd.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) if x else None for x in joined], "Int64")


def _names(docs: DataFrame) -> DataFrame:
    """node and its unit names as sorted 64-bit numbers, one row per row of ``docs`` that has words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            texts = batch["text"].tolist()
            for part in _parts(texts):
                t = texts[part]
                row, value, copy = shingles(t, hashes)
                name, ends = units(value, copy), np.bincount(row, minlength=len(t)).cumsum()
                sets = [np.sort(x).tobytes() for x in np.split(name, ends[:-1])]
                yield pd.DataFrame({"node": node_names(t), "names": sets}).dropna(subset="node")

    return docs.select(text_of().alias("text")).mapInPandas(run, "node bigint, names binary")


def similar_pairs(pairs: DataFrame, names: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is at least ``similarity``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = min(len(x), len(y)), max(len(x), len(y))
                if small < similarity * large:
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common >= similarity * (len(both) - common) - 1e-9)
            yield batch.loc[keep, ["a", "b"]]

    left = names.select(F.col("node").alias("a"), F.col("names").alias("x"))
    right = names.select(F.col("node").alias("b"), F.col("names").alias("y"))
    # one text may be the first of very many pairs
    return spread_join(pairs, left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(run, "a bigint, b bigint")


def linked_within(names: list[np.ndarray], root: np.ndarray, node: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that join the classes of a block of texts as all its similar pairs would: a spanning forest over the roots.

    Sizes of all intersections are products of incidence matrices, taken over bounded slices of the names that occur twice.
    """
    size = np.array([len(x) for x in names])
    row, flat = np.repeat(np.arange(len(names)), size), np.concatenate(names)
    order = np.argsort(flat, kind="stable")
    row, flat = row[order], flat[order]
    column = np.cumsum(np.diff(flat, prepend=flat[:1]) != 0)
    often = np.bincount(column)[column] > 1
    row, column = row[often], column[often]
    common = np.zeros((len(names), len(names)), np.float32)
    lo = 0
    while lo < len(row):
        hi = int(np.searchsorted(column, column[lo] + 2048))
        x = np.zeros((len(names), 2048), np.float32)
        x[row[lo:hi], column[lo:hi] - column[lo]] = 1
        common += x @ x.T
        lo = hi
    near = common >= similarity * (size[:, None] + size[None, :] - common) - 1e-6
    parent = {r: r for r in root.tolist()}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    out = []
    for i, j in zip(*(k.tolist() for k in np.nonzero(near & (root[:, None] != root[None, :])))):
        if (a := find(int(root[i]))) != (b := find(int(root[j]))):
            parent[a] = b
            out.append((int(node[i]), int(node[j])))
    return out


def links_in_buckets(rows: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links between the texts of each bucket; rows: key, n (texts of the bucket), node, root, names.

    A bucket of more than ``block`` texts is cut into blocks by hash, and each pair of blocks is a group of its own; a task holds
    one group at a time. Pairs of texts never become rows.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = rows.withColumn("_i", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), "node", "root", "names")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None

        def links(part: pd.DataFrame) -> list[tuple[int, int]]:
            if len(part) < 2 or part["root"].nunique() < 2:
                return []
            names = [np.frombuffer(x, np.uint64) for x in part["names"]]
            return linked_within(names, part["root"].to_numpy("int64"), part["node"].to_numpy("int64"), similarity)

        for batch in batches:
            out = []
            for key, part in batch.groupby(["key", "i", "j"], sort=False):
                if held and key != last:
                    out += links(pd.concat(held))
                    held = []
                held.append(part)
                last = key
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")
        if held:
            yield pd.DataFrame(links(pd.concat(held)), columns=["a", "b"]).astype("int64")

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInPandas(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """id, root: the smallest id of its connected component, for all ids of ``edges`` (a, b).

    Alternates large-star and small-star steps; each is one grouping of the current edges, whose number never grows, and the
    number of rounds is logarithmic. Each round ends at a written table.
    """
    edges = cut(edges.filter("a <> b").distinct(), "edges")
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: the larger neighbours of a node link to the smallest of the node and its neighbours
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = spread_join(both.filter("b > a"), low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours link to the smallest neighbour (pairs are now larger, smaller)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (spread_join(large, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        after = cut(small, "edges")
        # done when each node has one edge and no root is itself a node: stars
        linked = after.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        if linked.filter("n > 1").isEmpty() and after.join(linked.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return after.select(F.col("a").alias("id"), F.col("b").alias("root"))
        edges = after


def _with_root(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` (node, ...) with the root of their class; very many rows may have one text, so one node."""
    return spread_join(members, roots.select(F.col("id").alias("node"), "root"), "node").withColumn("root", F.coalesce("root", "node"))


def _linked(docs: DataFrame, table: DataFrame, similarity: float) -> DataFrame:
    """id, root of all texts (nodes) that are linked to another text."""
    texts = table.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    members = texts.select("node", "doc_id", F.explode("keys").alias("key"))
    full = members.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = cut(members.join(full, "key"), "members")  # key, node, doc_id, first

    star = cut(members.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    used = cut(members.select(F.col("doc_id").alias("_used")).distinct(), "used")
    source = docs.join(hinted(used, 16), F.col("doc_id").eqNullSafe(F.col("_used")), "left_semi")
    names = cut(_names(source).dropDuplicates(["node"]), "names")
    links = cut(similar_pairs(star, names, similarity), "links")
    roots = components(links)

    # the star compared a bucket's first text with all others; what is left are buckets whose other texts are in different classes
    others = _with_root(members.filter("node <> first"), roots)
    mixed = (others.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"))
             .filter("lo <> hi").select("key", "n"))
    rest = others.select("key", "node", "root").join(mixed, "key").join(names, "node")
    more = cut(links_in_buckets(rest, similarity), "links")
    return roots if more.isEmpty() else components(links.union(more))


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id for every row: the smallest doc_id of its class of near copies.

    Null text counts as empty. Texts without words belong to no class but their own. Rows that repeat a doc_id have one class if
    their texts have; a null doc_id takes part through its text, and a class of such rows only has a null class_id. Other columns are
    ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    table = cut(signed(docs, bands, rows), "signatures")
    roots = _linked(docs, table, similarity)
    found = cut(_with_root(table.select("doc_id", "node"), roots), "roots")
    by_root = found.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return (spread_join(found, by_root, "root")
            .select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows whose doc_id is their class_id, with columns and texts as given: one of each class.

    Rows that repeat both doc_id and text stay once; rows without doc_id stay.
    """
    name = spare(docs, "_id")
    mine = F.col("doc_id") == F.col("class_id")
    ids = cut(classes(docs, similarity).filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(name))
              .agg(F.count_if(mine).alias("kept")), "kept")
    # few are dropped or repeated, so their ids are mostly small enough to go to the texts, not the texts to them
    among = lambda rows: hinted(ids.filter(rows).select(name), 16)
    same = F.col("doc_id") == F.col(name)
    out = docs.join(among("kept = 0"), same, "left_anti")
    repeated = ids.filter("kept > 1").select(name)
    if not repeated.isEmpty():
        once = out.join(among("kept > 1"), same, "left_semi").dropDuplicates(["doc_id", "text"])
        out = out.join(among("kept > 1"), same, "left_anti").unionByName(once)
    return out
