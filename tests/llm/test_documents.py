import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from faultline.llm import decontam, neardup, packing, pii, quality
from faultline.llm.registry import tokenizer_path

SF = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, _kept string, _rows string, node string, names string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], CLASH)


# --- near duplicates ----------------------------------------------------------------------------

def bags(rows):
    out = []
    for _, t in rows:
        w = (t or "").lower().split()
        w += [""] * (5 - len(w)) if 0 < len(w) < 5 else []
        out.append(Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)))
    return out


def near_classes(rows):
    bag, parent = bags(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if bag[i] and bag[j] and sum((bag[i] & bag[j]).values()) >= 0.8 * sum((bag[i] | bag[j]).values()) - 1e-9:
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted(((d, ids.get(find(i)) if bag[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def test_classes_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(150)]
    for i in range(200, 330):  # one large group of near copies, some of which are linked through others only
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(400 + i, "Copied TEXT of some words") for i in range(20)] + [(500, None), (501, ""), (502, " \n "), (503, "one"), (504, "ONE"), (None, "one"),
             (None, "only here"), (503, "one"), (600, "a b c d e " * 3000), (601, "a b c d e " * 3001), (602, "a b c d e " * 9)]
    got = sorted([(r.doc_id, r.class_id) for r in neardup.classes(frame(spark, rows)).collect()], key=str)
    assert got == near_classes(rows)
    kept = neardup.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows[:1]).columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == sorted({c for d, c in got if d is not None})
    assert neardup.classes(frame(spark, rows).limit(0)).count() == 0


def test_blocks_of_a_bucket_find_all_links(spark):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40, dtype=np.uint64)) for _ in range(90)]
    rows = spark.createDataFrame([(1, 90, i, i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "key long, n long, node long, root long, names binary")
    want = [(i, j) for i in range(90) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.55 * len(np.union1d(sets[i], sets[j]))]

    def roots(links):
        parent = list(range(90))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for a, b in links:
            parent[find(a)] = find(b)
        groups = {}
        for i in range(90):
            groups.setdefault(find(i), []).append(i)
        return sorted(groups.values())
    for block in (1024, 16):
        assert roots([(r.a, r.b) for r in neardup.links_in_buckets(rows, 0.55, block).collect()]) == roots(want)


def test_signatures_estimate_weighted_similarity():
    a, b = "x y z q r s t u v w " * 30 + "tail one two three four five", "x y z q r s t u v w " * 24 + "tail six seven eight nine ten"
    row, value, copy = neardup.shingles([a, b, "", "x"], neardup.WordHashes())
    unit = neardup.units(value, copy)
    signature = neardup.dart_signatures(row, unit, 4, 2048)
    x, y = set(unit[row == 0].tolist()), set(unit[row == 1].tolist())
    assert abs((signature[0] == signature[1]).mean() - len(x & y) / len(x | y)) < 0.04
    assert not signature[2].any() and signature[3].all()
    half = neardup.dart_signatures(row, unit, 4, 2048, np.where(row == 1, 0.5, 1.0))
    assert abs((half[0] == half[1]).mean() - len(x & y) * 0.5 / (len(x) + 0.5 * len(y) - 0.5 * len(x & y))) < 0.04


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 150)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


# --- decontamination ----------------------------------------------------------------------------

ITEMS = [(1, "What is the tallest peak of the eastern range? It is the old stone crown."), (2, "one two three four five six seven eight"),
         (3, None), (4, "..."), (5, "a"), (None, "left out")]


def test_items_found_wherever_they_stand(spark):
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, doc_id string")
    filler = [f"f{i}" for i in range(500)]
    rows = [(k, " ".join([*filler[:k * 7], ITEMS[0][1].upper(), *filler[k * 7:]])) for k in range(40)]
    rows += [(100, "What is the tallest peak of the eastern range? Nobody knows the answer here today."), (101, None), (102, ""), (103, "it is the old stone crown"),
             (104, ITEMS[1][1]), (104, ITEMS[1][1]), (None, ITEMS[1][1]), (105, "eight seven six five four three two one")]
    docs = frame(spark, rows)
    for size in (1 << 20, 40):  # one chunk, and one item a chunk
        got = sorted([(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items, chunk_bytes=size).collect() if r.item_id != 5], key=str)
        assert got == sorted([(k, 1) for k in range(40)] + [(104, 2), (104, 2), (None, 2)], key=str)
    kept = decontam.drop_contaminated(docs, items.filter("item_id < 5"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {100, 101, 102, 103, 105}
    assert decontam.contaminated(docs.limit(0), items).count() == 0
    assert decontam.contaminated(docs, items.limit(0)).count() == 0


def test_chunks_do_not_change_results(spark):
    """Edited passages near the threshold, items of different lengths: scores and places are the same however items are dealt."""
    rng = random.Random(8)
    words = [f"w{int(rng.expovariate(0.02))}" for _ in range(4000)]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in [8, 12, 20, 30, 300] * 6]
    rows = []
    for k in range(90):
        w = texts[k % 30].split()
        for _ in range(len(w) * (k // 30) // 8):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((k, " ".join([rng.choice(words) for _ in range(rng.randint(0, 90))] + w)))
    # the trigrams of a short item, far apart: no passage of its own length holds them
    short = texts[1].split()
    rows.append((900, " ".join(" ".join([*short[i:i + 3], *["filler"] * 20]) for i in range(0, 12))))
    docs = frame(spark, rows)
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    one, many, all_apart = (sorted(tuple(r) for r in decontam.contaminated(docs, items, chunk_bytes=size).collect()) for size in (1 << 20, 3000, 1500))
    assert one == many == all_apart
    assert {(k, k) for k in range(30)} <= {r[:2] for r in one} and not [r for r in one if r[0] == 900]


def test_items_without_item_id_count(spark):
    big = 2 ** 62 + 1
    items = spark.createDataFrame([(None, "one two three four five six seven eight"), (None, "red green blue black white grey pink brown"),
                                   (big, "one two three four five six seven eight"), (None, None)], "item_id long, text string")
    docs = frame(spark, [(1, "x y one two three four five six seven eight z"), (2, "red green blue black white grey pink brown"), (3, "nothing of these")])
    for size in (1 << 20, 40):
        got = Counter((r.doc_id, r.item_id) for r in decontam.contaminated(docs, items, chunk_bytes=size).collect())
        assert got == {(1, None): 1, (1, big): 1, (2, None): 1}
    assert [r.doc_id for r in decontam.drop_contaminated(docs, items.filter("item_id is null")).collect()] == [3]


def test_wand_equals_full_scores():
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    index = decontam.Index(items)
    for _, text in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall():
        terms = sorted({index.vocabulary[t] for t in decontam.terms_of(text)[:80] if t in index.vocabulary})
        scores = Counter()
        for t in terms:
            for item, weight in zip(*index.postings[t]):
                scores[item] += weight
        for index.threshold in (0.1, 0.3, 0.6):
            assert {i for i, _ in index.wand(terms)} == {i for i, s in scores.items() if s >= index.threshold - 1e-9}


# --- packing ------------------------------------------------------------------------------------

def check_packing(rows, texts, capacity, per_document):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        n, first = len(ids) // 4, (len(ids) // 4) % capacity or capacity
        cuts = [(0, n)] if n <= capacity else [(0, first)] + [(s, s + capacity) for s in range(first, n, capacity)]
        want.update((i, k, a, b - a, zlib.crc32(ids[4 * a:4 * b])) for k, (a, b) in enumerate(cuts))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) <= per_document * sum(r.length for r in rows) / capacity + 2


def test_packing_round_trip(spark):
    rng = random.Random(1)
    signs = ["a", "B", " ", "  ", "\n", "\t", "'s", "12", "é", "!", "\x1c", "\x85", "　", "，", "中", "\r\n", "​", "<|endoftext|>", "word", " the"]
    texts = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    texts += [(500, None), (501, ""), (502, "long text " * 3000), (503, "x" * 20000), (None, "no id"), (7, "again"), (7, "again"), (2 ** 62, "large id")]
    texts += duckdb.sql(f"select doc_id + 1000, text from '{SF}/documents.parquet'").fetchall()
    check_packing(packing.pack_documents(frame(spark, texts), tokenizer_path()).collect(), texts, 2048, 1.05)
    check_packing(packing.pack(packing.pieces(frame(spark, texts), tokenizer_path(), 64), 64, group_rows=500).collect(), texts, 64, 1.2)
    assert packing.pack_documents(frame(spark, texts).limit(0), tokenizer_path()).count() == 0


def test_equal_pieces_spread_over_groups(spark):
    """A third of all rows are equal: no group takes them all, and every piece is packed once."""
    texts = [(None, "")] * 1000 + [(i, f"text {i}") for i in range(2000)]
    pieces = packing.pieces(frame(spark, texts).repartition(3), tokenizer_path(), 64)
    rows = packing.pack(pieces, 64, group_rows=100).collect()
    check_packing(rows, texts, 64, 1.2)
    groups = Counter(r.sequence_id >> 32 for r in rows)
    assert max(groups.values()) <= 200  # at most 2 group_rows


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(5)
    lengths = sorted((rng.randint(1, 100) for _ in range(400)), reverse=True)
    bins, _ = packing.best_fit_decreasing(lengths, 100)
    left, want = [], []
    for n in lengths:
        fits = [r for r in left if r >= n]
        if fits:
            left[left.index(min(fits))] -= n
        else:
            left.append(100 - n)
    assert len(left) == max(bins) + 1
    assert sorted(100 - sum(n for n, b in zip(lengths, bins) if b == k) for k in range(len(left))) == sorted(left)


# --- ids and columns ----------------------------------------------------------------------------

BIG = 2 ** 60
WIDE = "doc_id long, text string, lang string, source string, n_chars long, nested struct<a:array<long>,b:map<string,long>>, money decimal(38,9), at timestamp"


def wide(spark):
    """Ids and numbers beyond doubles beside nulls in one batch, with columns of types that pandas does not keep."""
    from datetime import datetime
    from decimal import Decimal
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    texts = ["the quick brown fox jumps over the lazy dog near the river bank", "another text of quite different words, said twice for good measure", item, None, ""]
    rows = [(BIG + 1 + 3 * k if k != 3 else None, t, "en", None, BIG + 2 if k != 1 else None, ([BIG + 1, None], {"k": BIG + 3}), Decimal("12345678901234567890.000000001"),
             datetime(2020, 1, 2, 3, 4, 5, 678901)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, WIDE).coalesce(1), rows


def test_large_ids_stay_exact(spark):
    docs, rows = wide(spark)
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    ids = sorted((r[0] for r in rows), key=str)
    assert sorted((r.doc_id for r in quality.classify(docs, labels).collect()), key=str) == ids
    found = neardup.classes(docs).collect()
    assert sorted((r.doc_id for r in found), key=str) == ids and all(r.class_id == r.doc_id for r in found)
    assert {r.doc_id for r in decontam.contaminated(docs, items).collect()} == {BIG + 7}
    assert sorted((r.doc_id for r in packing.pack_documents(docs, tokenizer_path()).collect()), key=str) == ids
    assert sorted((r.doc_id for r in pii.find_personal_data(docs).collect()), key=str) == ids


def test_stages_keep_columns_of_any_type(spark):
    docs, _ = wide(spark)
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    given = {str(r) for r in docs.collect()}
    for kept in (quality.keep_good(docs, labels, threshold=0.0), neardup.keep_one(docs), decontam.drop_contaminated(docs, items), pii.redact(docs)):
        assert kept.columns == docs.columns
        got = [str(r) for r in kept.collect()]
        assert len(got) >= 4 and set(got) <= given


def test_join_on_a_hot_key_equals_a_plain_join(spark):
    from faultline.llm.shared import spread_join
    left = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN null ELSE id END AS k")
    right = spark.range(0, 3000, 7).selectExpr("id AS k", "id * 2 AS v")
    want = sorted(map(tuple, left.join(right, "k", "left").select("id", "k", "v").collect()), key=str)
    joined = spread_join(left, right, "k", hot_rows=100)
    assert sorted(map(tuple, joined.select("id", "k", "v").collect()), key=str) == want


# --- pipeline -----------------------------------------------------------------------------------

def test_pipeline_equals_its_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted == 1}
    rows = sorted((i, texts[i]) for i in good)
    kept = {c for _, c in near_classes(rows)}
    held = {r.doc_id for r in decontam.contaminated(docs, items).collect()}
    clean = [(i, texts[i]) for i in sorted(kept - held)]
    redacted = [(r.doc_id, r.text) for r in pii.redact(spark.createDataFrame(clean, "doc_id long, text string")).collect()]
    assert dict(redacted).keys() == dict(clean).keys()
    check_packing(corpus_pipeline.run(spark, SF).collect(), redacted, 2048, 1.05)
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
