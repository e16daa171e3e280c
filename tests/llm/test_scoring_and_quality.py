import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from faultline.llm import lm, quality
from faultline.llm.eliasfano import EliasFano, Trie
from faultline.llm.shared import crc_of_id

SF = "/root/testdata/sf0.001"
EDGE = "doc_id long, text string, n long, score string, block string"


@pytest.mark.parametrize("n,top", [(0, 5), (1, 1), (1, 1 << 62), (300, 1 << 62), (300, 400), (5000, 5000)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    packed = EliasFano.build(values)
    asked = np.concatenate([values, rng.integers(0, top + 9, 200, dtype=np.uint64), [np.uint64(0), np.uint64(1 << 62)]])
    assert (packed.get(np.arange(n)) == values).all()
    assert (packed.successor(asked) == np.searchsorted(values, asked)).all()
    assert ((packed.find(asked) >= 0) == np.isin(asked, values)).all()


def test_trie_round_trip():
    rng = np.random.default_rng(1)
    pairs = np.unique(np.stack([rng.integers(0, 50, 2000, dtype=np.uint64) << np.uint64(50), rng.integers(0, 1 << 40, 2000, dtype=np.uint64)], 1), axis=0)
    code = rng.integers(1, 256, len(pairs)).astype(np.uint8)
    trie = Trie.map(Trie.build(pairs[:, 0], pairs[:, 1], code).to_bytes())
    assert (trie.lookup(pairs[:, 0], pairs[:, 1]) == code).all()
    assert not trie.lookup(pairs[:, 0], pairs[:, 1] + np.uint64(1)).any()
    assert not trie.lookup(pairs[:, 0] + np.uint64(1), pairs[:, 1]).any()


def reference(rows, m):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or "")) + [None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    words, pairs, texts = Counter(), Counter(), 0
    for t, h in zip(tokens, held):
        if not h:
            words.update(t)
            pairs.update(zip([0, *t], t))
            texts += 1
    n, v = sum(words.values()), len(words)
    out = []
    for (i, _), t, h in zip(rows, tokens, held):
        p1 = [(words[w] + 1) / (n + v + 1) for w in t]
        p2 = [(pairs[b] + m * p) / ((words[b[0]] if b[0] != 0 else texts) + m) for b, p in zip(zip([0, *t], t), p1)]
        out.append((i, h, len(t), sum(words[w] > 0 for w in t), n, round(sum(map(math.log10, p1)), 8), round(sum(map(math.log10, p2)), 8)))
    return sorted(out, key=str)


def test_scores_equal_brute_force_whatever_the_blocks(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows = [(i, t[:3000]) for i, t in rows] + [(900, None), (901, ""), (902, " \x0b\x1c a A\x85b "), (None, "the THE The"), (5, "repeated"), (5, "repeated")]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], EDGE).repartition(3)
    for blocks, shards in ((10 ** 6, 10 ** 6), (700, 500)):
        got = lm.score(docs, crc_of_id("doc_id") % 7 == 2, block_tokens=blocks, shard_ngrams=shards).collect()
        m = got[0].weight
        want = reference(rows, m)
        mine = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8), r.score) for r in got], key=str)
        assert [x[:6] for x in mine] == [x[:6] for x in want]
        # counts above EXACT are quantised
        assert all(abs(a[6] - b[6]) < 0.03 * a[2] for a, b in zip(mine, want))


def test_order_three_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "a b c a b c d " * 3) for i in range(9)], "doc_id long, text string")
    two, three = (lm.score(docs, crc_of_id("doc_id") % 7 == 2, order=k).agg({"score": "sum"}).first()[0] for k in (2, 3))
    assert three > two
    assert lm.score(docs.limit(0), crc_of_id("doc_id") % 7 == 2).count() == 0


def test_start_context_is_spread_over_shards(spark):
    """Short texts, each with a first word of its own: no shard gets most n-grams of the start, whatever the order, and scores stay."""
    docs = spark.createDataFrame([(i, f"w{i} x{i % 50}") for i in range(3000)], "doc_id long, text string").repartition(3)
    held = crc_of_id("doc_id") % 7 == 2
    table = lm.blocks(docs, held, 1000).cache()
    start = int(lm._names([lm.START])[0])
    two = lm.heavy_contexts(table, 2, 9000, 0.05)
    assert two == {start: 1 / 3}
    assert int(lm._names([lm.END])[0]) not in two
    three = lm.heavy_contexts(table, 3, 9000, 0.05)
    assert list(three.values()) == [1 / 3]
    for k, heavy in ((2, two), (3, three)):
        rows = 0
        for row in table.collect():
            codes, lengths, names, _ = lm._block_arrays(row)
            g = lm.Grams(codes, lengths, names, k)
            part = g.shards(18, heavy)[g.context == np.uint64(next(iter(heavy)))]
            rows = rows + np.bincount(part, minlength=24)
        assert rows.sum() == 3000 and rows.max() < 700  # six shards of about 500
    for order in (2, 3):
        one, many = ({r.doc_id: round(r.score, 8) for r in lm.score(docs, held, order, 1000, n).collect()} for n in (10 ** 6, 500))
        assert one == many


def test_trees_learn_and_traverse():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    forest = quality.fit(x[:1000], y[:1000], trees=40, depth=3)
    assert ((forest.score(x[1000:]) >= 0.5) == y[1000:]).mean() > 0.95

    def walk(row):
        z = forest.base
        for k in forest.roots:
            while forest.left[k] != k:
                k = forest.left[k] if row[forest.feature[k]] <= forest.threshold[k] else forest.right[k]
            z += forest.value[k]
        return 1 / (1 + math.exp(-z))
    assert np.allclose(forest.score(x[:50]), [walk(r) for r in x[:50]])


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.classify_table(spark, sf)
    both = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert len(both) > 80 and (both["predicted"] == both["quality"]).mean() > 0.97
    assert out.count() == 1000


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 1, "a", "b"), (1, "", 1, "a", "b"), (None, "x " * 100000, 1, "a", "b"), (2, "퟿ é", 2, None, None)], EDGE)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (7, None)], "doc_id long, quality int")
    for taught in (labels, labels.limit(0)):
        rows = quality.classify(docs, taught).collect()
        assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns
