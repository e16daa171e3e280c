"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

The index is built per chunk of items whose text is bounded (``CHUNK_BYTES``), and each chunk is broadcast in turn, so a larger
benchmark means more chunks, never a larger broadcast; document frequencies, mean and greatest length are those of all items, so that chunks
do not change results. A passage of an item is a window of twice its words, so that the item lies whole in one. Its score is BM25 over its
distinct terms, as a share of the item's score for its own text. Block-max WAND retrieves all items at or above a threshold in
windows sized by the longest item: sums of block maxima discard most windows for all blocks at once, and the rest
move through the posting lists by pivots. Retrieved items are verified in their own passages by score and by overlap of question and answer.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import cut, text_of

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.6
GRAM = 3
BLOCKS = 32
CHUNK_BYTES = 4 << 20
_WORD = re.compile(r"\w+")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def terms_of(text: str) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence is the answer; of a text of one sentence, the last quarter of its words."""
    parts = [p for p in _SENTENCE_END.split(text.strip()) if terms_of(p)]
    if len(parts) > 1:
        return [t for p in parts[:-1] for t in terms_of(p)], terms_of(parts[-1])
    words = terms_of(text)
    at = len(words) - max(1, len(words) // 4)
    return words[:at], words[at:]


def grams(words: list[str] | list[int], n: int = GRAM) -> set[tuple]:
    n = min(n, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


class Index:
    """Postings of a chunk of items, ordered by item, in at most ``BLOCKS`` blocks of items.

    Impacts are BM25 weights divided by the item's score for its own text: 1 means that all its terms occur.
    ``stats``: number, mean and greatest length of all items, and their document frequencies by term, where the chunk is not all.
    """

    def __init__(self, items: list[tuple[int | None, str]], threshold: float = THRESHOLD, stats: tuple[int, float, int, dict[str, int]] | None = None):
        items = sorted(((i, t) for i, t in items if terms_of(t)), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        self.ids, self.threshold = [i for i, _ in items], threshold
        words = [terms_of(t) for _, t in items]
        self.longest = max(map(len, words), default=1)
        self.vocabulary = {t: k for k, t in enumerate(sorted({t for w in words for t in w}))}
        self.block = max(1, -(-len(items) // BLOCKS))
        n_blocks, n_terms = -(-len(items) // self.block), len(self.vocabulary)
        coded = [np.array([self.vocabulary[t] for t in w]) for w in words]
        if stats:
            n_items, mean, self.longest, frequency = stats
            df = np.array([frequency[t] for t in self.vocabulary], float)
        else:
            n_items, mean = len(items), sum(map(len, words)) / len(words) if words else 1.0
            df = np.bincount(np.concatenate([np.unique(c) for c in coded]), minlength=n_terms) if coded else np.zeros(0)
        idf = np.log(1 + (n_items - df + 0.5) / (df + 0.5))
        lists: list[list[tuple[int, float]]] = [[] for _ in range(n_terms)]
        self.lengths, self.weights = [len(w) for w in words], []
        self.block_max = np.zeros((n_terms + 1, n_blocks), np.float32)  # the last row is for words that no item has
        for item, c in enumerate(coded):
            term, tf = np.unique(c, return_counts=True)
            weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(c) / mean))
            weight /= weight.sum()
            self.weights.append(dict(zip(term.tolist(), weight.tolist())))
            for t, w in zip(term.tolist(), weight.tolist()):
                lists[t].append((item, w))
                b = item // self.block
                self.block_max[t, b] = max(self.block_max[t, b], np.nextafter(np.float32(w), np.float32(2)))
        self.postings = [([i for i, _ in p], [w for _, w in p]) for p in lists]
        self.term_max = [max(w) for _, w in self.postings]
        self.parts = []
        for _, text in items:
            q, a = question_and_answer(text)
            self.parts.append((grams([self.vocabulary[t] for t in q]), grams([self.vocabulary[t] for t in a]), min(GRAM, len(q)), min(GRAM, len(a))))

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """All (item, score) of at least the threshold for distinct terms, by block-max WAND."""
        limit = self.threshold - 1e-9
        cursors = [[self.postings[t][0][0], t, 0] for t in terms]  # current item, term, place
        most = dict(zip(terms, self.block_max[terms].tolist()))
        found = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(cursors):
                total += self.term_max[t]
                if total >= limit:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // self.block
            if sum([most[t][block] for _, t, _ in cursors[:pivot + 1]]) >= limit:
                if cursors[0][0] == item:
                    score = sum(self.postings[t][1][p] for _, t, p in cursors[:pivot + 1])
                    if score >= limit:
                        found.append((item, score))
                    goal = item + 1
                else:
                    goal = item
            else:  # no item of this block can pass by these terms: to the next block, or the next list's item
                goal = (block + 1) * self.block
                if pivot + 1 < len(cursors):
                    goal = min(goal, cursors[pivot + 1][0])
                goal = max(goal, item + 1)
            alive = []
            for c in cursors[:pivot + 1]:
                ids = self.postings[c[1]][0]
                c[2] = bisect_left(ids, goal, c[2])
                if c[2] < len(ids):
                    c[0] = ids[c[2]]
                    alive.append(c)
            cursors = alive + cursors[pivot + 1:]
        return found

    def overlaps(self, item: int, passage: list[int]) -> tuple[float, float]:
        """Shares of the question's and the answer's word n-grams that the passage has."""
        q, a, nq, na = self.parts[item]
        have = {n: {tuple(passage[i:i + n]) for i in range(len(passage) - n + 1)} for n in {nq, na} if n}
        share = lambda g, n: len(g & have[n]) / len(g) if g else 1.0
        return share(q, nq), share(a, na)


def search_text(index: Index, text: str, overlap: float = OVERLAP) -> list[tuple]:
    """(item, start, score, question share, answer share) of each item that a passage of ``text`` holds; the best passage of each.

    Windows have 2 s words and start at each multiple of s, where s is the number of words of the longest item. Passages of an item of n words
    are the runs of 2 n words in a window at each n words, and the last one: every n words that stand together lie in one.
    """
    words = terms_of(text)
    t = np.fromiter(map(index.vocabulary.get, words, repeat(-1)), np.int32, len(words))
    step = index.longest
    # distinct (segment, term) pairs; a window is two neighbouring segments, so their sums bound it from above
    at = np.nonzero(t >= 0)[0]
    if not len(at):
        return []
    n_terms, n_segments = len(index.postings), -(-len(t) // step)
    key = np.unique((at // step) * n_terms + t[at])
    segment, term = key // n_terms, key % n_terms
    first = np.nonzero(np.diff(segment, prepend=-1))[0]
    bound = np.zeros((n_segments + 1, index.block_max.shape[1]), np.float32)
    bound[segment[first]] = np.add.reduceat(index.block_max[term], first, 0)
    windows = np.nonzero((bound[:-1] + bound[1:]).max(1) >= index.threshold - 1e-4)[0]
    best: dict[int, tuple] = {}
    for w in windows.tolist():
        window = t[w * step:(w + 2) * step]
        distinct = np.unique(window)
        distinct = distinct[distinct >= 0]
        if index.block_max[distinct].sum(0).max() < index.threshold - 1e-4:
            continue
        for item, _ in index.wand(distinct.tolist()):
            n, weights = index.lengths[item], index.weights[item]
            last = 2 * (step - n)
            for at in [*range(0, last, n), last]:
                start = w * step + at
                passage = window[at:at + 2 * n].tolist()
                have = set(passage)
                score = sum(x for k, x in weights.items() if k in have)
                if score < index.threshold - 1e-9:
                    continue
                q, a = index.overlaps(item, passage)
                if q >= overlap and a >= overlap:
                    row = (score, q, a, -start)
                    if item not in best or row > best[item]:
                        best[item] = row
    return [(index.ids[i], -at, score, q, a) for i, (score, q, a, at) in sorted(best.items())]


# --- Spark --------------------------------------------------------------------------------------

FOUND = "doc_id bigint, item_id bigint, passage_start bigint, score double, question_overlap double, answer_overlap double"


def item_terms(items: DataFrame) -> DataFrame:
    """chunk, term, n, words, longest: for each distinct term of a chunk the number of its items; for a null term all its items, and their words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for chunk, text in zip(batch["chunk"], batch["text"]):
                if words := terms_of(text):
                    out += [(chunk, None, len(words)), *((chunk, t, 0) for t in set(words))]
            yield pd.DataFrame(out, columns=["chunk", "term", "words"]).astype({"term": object})

    rows = items.select("chunk", "text").mapInPandas(run, "chunk bigint, term string, words bigint")
    return rows.groupBy("chunk", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"), F.max("words").alias("longest"))


def item_indexes(items: DataFrame, threshold: float = THRESHOLD, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Index]:
    """Indexes of the items in chunks of about ``chunk_bytes`` of text, dealt by hash; each chunk, with its terms, comes to the driver alone."""
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), text_of().alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    if chunks == 1:
        yield Index([(r.item_id, r.text) for r in items.collect()], threshold)
        return
    items = cut(items.withColumn("chunk", F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)).cast("bigint")), "items")
    terms = cut(item_terms(items), "terms")
    n, words, longest = terms.filter(F.col("term").isNull()).agg(F.sum("n"), F.sum("words"), F.max("longest")).first()
    terms = terms.filter(F.col("term").isNotNull()).select("chunk", "term", "n")
    df = cut(terms.select("chunk", "term").join(terms.groupBy("term").agg(F.sum("n").alias("df")), "term"), "frequencies")
    for k in range(chunks):
        frequency = {r.term: r.df for r in df.filter(F.col("chunk") == k).select("term", "df").collect()}
        yield Index([(r.item_id, r.text) for r in items.filter(F.col("chunk") == k).collect()], threshold, (n, words / n, longest, frequency) if n else None)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
                 chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, item_id, passage_start, score, question_overlap, answer_overlap: the items that each document holds.

    One row per document row and item. Null texts are empty and hold nothing; items without words are left out; items that repeat
    an item_id are searched alike, each giving its own row. A null doc_id or item_id stays null. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    out = None
    for index in item_indexes(items, threshold, chunk_bytes):
        found = docs.mapInArrow(_searcher(docs, index, overlap), FOUND)
        out = found if out is None else out.unionAll(found)
    return out


def _sent(docs: DataFrame, index: Index):
    """The index's lists and arrays, sent to all tasks; a task wraps them in an Index of its own."""
    return docs.sparkSession.sparkContext.broadcast(vars(index))


def _received(parts) -> Index:
    index = Index.__new__(Index)
    vars(index).update(parts.value)
    return index


def _searcher(docs: DataFrame, index: Index, overlap: float):
    parts = _sent(docs, index)
    names = [f.split()[0] for f in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _received(parts)
        for batch in batches:
            out = [(d, *row) for d, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text"))) for row in search_text(index, text, overlap)]
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 3 else pa.float64()) for k, c in enumerate(columns)], names=names)

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their own columns, of any type, as they are.

    Each chunk of items filters what the one before kept. Null texts are empty and stay; repeated rows, and rows without doc_id, are rows of their own.
    """
    for index in item_indexes(items):
        parts = _sent(docs, index)

        def run(batches: Iterator[pa.RecordBatch], parts=parts) -> Iterator[pa.RecordBatch]:
            index = _received(parts)
            for batch in batches:
                yield batch.filter(pa.array([not search_text(index, t or "") for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
