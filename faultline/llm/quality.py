"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

The trees are fitted on a bounded sample of labelled rows (``sample_rows``), flattened into arrays and sent to the tasks, which
traverse them for many rows at once. Statistics never use labels, lang, source or doc_id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import crc_of_id, text_of

SAMPLE_ROWS = 20_000
FEATURES = ["log_bytes", "log_words", "log_lines", "word_bytes", "line_words", "upper", "lower", "digit", "space", "high", "period_comma",
            "exclaim", "symbol", "bar", "quote", "other_punctuation", "distinct_words", "top_word", "repeats", "caps_words",
            "symbol_words", "letterless_words", "long_words", "distinct_lines", "top_line", "ended_lines", "short_lines", "entropy"]


# --- statistics ---------------------------------------------------------------------------------

def _class_table() -> np.ndarray:
    """Class of each byte: upper, lower, digit, space, high, then punctuation groups."""
    groups = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\n\x0b\x0c", None, ".,;:", "!?",
              "#$%&*@^~<>=+\\/_{}[]`", "|", "\"'()-"]
    table = np.full(256, len(groups), np.int64)
    table[128:] = 4
    for k, chars in enumerate(groups):
        for c in chars or "":
            table[ord(c)] = k
    return table


def statistics(texts: list[str]) -> np.ndarray:
    """One row of ``FEATURES`` per text; an empty text has zeros only."""
    table, out = _class_table(), np.zeros((len(texts), len(FEATURES)))
    ends = (".", "!", "?", ":", ";", "\"", "'", ")")
    for row, text in zip(out, texts):
        if not text:
            continue
        data = text.encode("utf-8", "surrogatepass")
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        kinds = np.bincount(table, weights=counts, minlength=11) / len(data)
        words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
        n, m = max(1, len(words)), max(1, len(lines))
        by_word, by_line = Counter(words), Counter(lines)
        share = counts[counts > 0] / len(data)
        caps = symbols = letterless = long = 0
        for w, c in by_word.items():
            if w.isupper() and len(w) > 1:
                caps += c
            if not w.isalnum() and not w[:-1].isalnum() and not w[-1].isalnum() and len(w) > 2 and w[0].isalpha():
                symbols += c
            if not w[0].isalpha() and not any(map(str.isalpha, w)):
                letterless += c
            if len(w) > 20:
                long += c
        row[:] = [np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(lines)), sum(map(len, words)) / n, len(words) / m, *kinds[:4], kinds[4],
                  *kinds[5:], len(by_word) / n, max(by_word.values(), default=0) / n, sum(map(str.__eq__, words, words[1:])) / n, caps / n,
                  symbols / n, letterless / n, long / n, len(by_line) / m, max(by_line.values(), default=0) / m,
                  sum(x.rstrip().endswith(ends) for x in lines) / m, sum(len(x) < 20 for x in lines) / m, -(share * np.log2(share)).sum()]
    return out


# --- trees --------------------------------------------------------------------------------------

@dataclass
class Forest:
    """All trees in flat arrays: an inner node has a feature and a threshold, a leaf is its own child and has a value."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; every step moves all rows one level down a tree."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, min_rows: int = 10,
        ridge: float = 1.0) -> Forest:
    """Boosting on the logistic loss with second-order leaf values; splits are searched in histograms of at most ``bins`` bins.

    With rows of one label only, or none, there are no trees and the score is the smoothed share of label 1.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    n_features = x.shape[1]
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(n_features)]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        offsets = np.arange(n_features) * bins
        flat, score = binned + offsets, np.full(len(y), base)

        def histogram(at: np.ndarray, w: np.ndarray) -> np.ndarray:
            return np.bincount(flat[at].ravel(), np.repeat(w[at], n_features), n_features * bins).reshape(n_features, bins)

        def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, level: int) -> int:
            k, sum_g, sum_h = len(nodes), g[at].sum(), h[at].sum()
            nodes.append([0, np.inf, k, k, -rate * sum_g / (sum_h + ridge)])
            if level == depth or len(at) < 2 * min_rows:
                return k
            lg, lh, ln = (histogram(at, w).cumsum(1) for w in (g, h, np.ones(len(y))))
            gain = lg ** 2 / (lh + ridge) + (sum_g - lg) ** 2 / (sum_h - lh + ridge) - sum_g ** 2 / (sum_h + ridge)
            gain[(ln < min_rows) | (len(at) - ln < min_rows)] = 0
            f, b = divmod(int(gain.argmax()), bins)
            if gain[f, b] <= 1e-9:
                return k
            low = binned[at, f] <= b
            nodes[k][:2] = [f, edges[f][b]]
            nodes[k][2] = grow(at[low], g, h, level + 1)
            nodes[k][3] = grow(at[~low], g, h, level + 1)
            return k

        rows = np.arange(len(y))
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            first = len(nodes)
            roots.append(grow(rows, p - y, p * (1 - p), 0))
            tree = Forest(*_columns(nodes[first:], first), np.array([0]), depth, 0.0)
            s = tree.score(x)
            score += np.log(s / (1 - s))
    return Forest(*_columns(nodes, 0), np.array(roots, int), depth, base)


def _columns(nodes: list[list], first: int) -> tuple[np.ndarray, ...]:
    f, t, left, right, v = zip(*nodes) if nodes else ((), (), (), (), ())
    return np.array(f, int), np.array(t, float), np.array(left, int) - first, np.array(right, int) - first, np.array(v, float)


# --- Spark --------------------------------------------------------------------------------------

def _model(docs: DataFrame, forest: Forest):
    """The forest's arrays, sent to all tasks; a task builds its own Forest from them."""
    return docs.sparkSession.sparkContext.broadcast(tuple(getattr(forest, f.name) for f in fields(forest)))


def _scored(docs: DataFrame, columns: list[str], forest: Forest | None) -> DataFrame:
    """``columns`` with the statistics of text (no forest) or its score. Other columns pass as they are, as Arrow arrays."""
    model = None if forest is None else _model(docs, forest)
    name, kind = ("x", "array<double>") if forest is None else ("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = None if model is None else Forest(*model.value)
        for batch in batches:
            x = statistics(batch.column("_text").to_pylist())
            made = pa.array(x.tolist(), pa.list_(pa.float64())) if trees is None else pa.array(trees.score(x))
            yield pa.RecordBatch.from_arrays([*map(batch.column, columns), made], names=[*columns, name])

    rows = docs.select(*columns, text_of().alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, {name} {kind}")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on at most ``sample_rows`` labelled rows, taken by hash of the id (so any size gives a fair sample).

    ``labels`` has doc_id and quality; a doc_id labelled twice has the smaller label, null labels are left out. Rows whose doc_id
    is not labelled are not read into the sample; the driver gets ``sample_rows`` rows of statistics.
    """
    ids = (labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id"))
           .agg(F.min("quality").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows))
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(ids), "_id")
    # ids may repeat in docs: the order decides which rows are taken, the same ones in every run
    sample = _scored(rows, ["_id", "_label"], None).orderBy(F.xxhash64("_id"), "_id", "x").limit(sample_rows).toArrow()
    x = np.array(sample.column("x").to_pylist(), float).reshape(sample.num_rows, len(FEATURES))
    order = np.lexsort(x.T)
    return fit(x[order], np.array(sample.column("_label").to_pylist(), float)[order])


def held_out() -> F.Column:
    return crc_of_id("doc_id") % 3 == 1


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; rows held out never teach.

    Null text counts as empty, empty and repeated texts are scored like others, and a null doc_id stays null. Without labels
    every score is the prior, 0.5. Other columns of both tables are ignored.
    """
    taught = labels.filter(~held_out())
    forest = train(docs.filter(~held_out()), taught, sample_rows)
    out = _scored(docs.select("doc_id", "text"), ["doc_id"], forest)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their own columns, of any type, as they are.

    Null text counts as empty and is scored like others; repeated rows, and rows without doc_id, are rows of their own. An empty table gives none.
    """
    model = _model(docs, train(docs.filter(~held_out()), labels.filter(~held_out()), sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Forest(*model.value)
        for batch in batches:
            score = trees.score(statistics([t or "" for t in batch.column("text").to_pylist()]))
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify_table(spark: SparkSession, sf: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
