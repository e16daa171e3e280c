import hashlib
import itertools
import math
import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from faultline.llm import chat, negatives, zonemaps
from faultline.llm.registry import tokenizer_path
from faultline.llm.shared import cut

SF = "/root/testdata/sf0.001"
BIG = 2 ** 60


@pytest.mark.parametrize("name", ["op11_fagin_threshold", "op12_offset_masks", "op13_zone_maps"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in cols)) for r in df.collect())


# --- hard negatives -----------------------------------------------------------------------------

def mined(rows, every=50):
    whole = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for n, (a, label, v) in enumerate(whole):
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for m, (i, other, w) in enumerate(whole) if m != n and len(v) == len(w))
        for s, p, _ in [x for x in scored if x[2]][:5]:
            fit = [(t, i) for t, i, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(fit)]
    return sorted(out)


def _negatives(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=5).round(2).tolist(), int(rng.integers(0, 3))) for i in range(500)]
    rows += [(600 + i, [0.5, 0.25, 1.0, 0.0, 0.5], i % 4) for i in range(80)]  # ties
    rows += [(650, [0.5, 0.25, 1.0, 0.0, 0.5], 1)] * 3  # a repeated anchor
    rows += [(700, None, 1), (701, [None] * 5, 1), (750, [float("nan")] * 5, 2), (800, [float("inf")] * 5, 2), (None, [1.0] * 5, 1), (850, [1.0] * 5, None),
             (900, [0.0] * 5, 1), (950, [1.0, 2.0], 1), (951, [2.0, 1.0], 1), (952, [1.5, 1.0], 2), (1000, [], 1), (1001, [], 1), (1002, [], 2),
             (BIG - BIG % 50, [2.0, 0.0, 0.0, 1.0, 0.0], 2), (BIG + 1, [1.0, 0.0, 0.0, 1.0, 0.0], 1)]
    table = spark.createDataFrame([(i, v, x, 1, "y") for i, v, x in rows], "vec_id long, embedding array<float>, label int, row int, shard string").repartition(3)
    want = mined(rows)
    assert len(want) > 150 and _negatives(negatives.mine_table(table)) == want
    kept = cut(negatives.labelled_vectors(table))
    assert _negatives(negatives.mine(kept, shard_rows=200, anchors_per_task=30)) == want
    assert negatives.mine_table(table.limit(0)).count() == 0


def test_scores_beyond_doubles(spark):
    rows = [(50, [2.0 ** 22, 3.0], 1), (51, [2.0 ** 22, 1.0], 1), (52, [2.0 ** 21, 1.0], 2), (53, [2.0 ** 21, 2.0], 2), (54, [2.0 ** 21 + 0.5, 2.0], 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert _negatives(negatives.mine_table(table)) == mined(rows) != []


def test_lists_stop_early():
    rng = np.random.default_rng(2)
    v = rng.integers(-50, 50, (4000, 3)).astype(float)
    lists = negatives.SortedLists(v, np.arange(4000), np.zeros(4000, int), np.arange(4000))
    for i in range(30):
        got = lists.search(v[i], i, 0, True, [(-np.inf, np.inf)], 5)[0]
        want = sorted(((-int(v[i] @ v[j]), j) for j in range(4000) if j != i))[:5]
        assert [(-s, j) for s, j, _ in got] == want
    assert lists.met < 30 * 4000 * 0.5
    # nothing fits the window: the search ends when the threshold leaves it
    assert lists.search(v[0], 0, 1, False, [(10 ** 6, 10 ** 7)], 3) == [[]]


# --- chat ---------------------------------------------------------------------------------------

def digests(rows):
    out, of = [], {}
    for i, turn, role, text in rows:
        of.setdefault(i, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    for i, turns in of.items():
        turns.sort()
        loss = "".join(t for *_, role, _, t in turns if role == "assistant")
        chars = sum(32 + len(chat.escape(role)) + len(chat.escape(t)) for *_, role, _, t in turns)
        out.append((i, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, _, t in turns).encode()).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(), chars))
    return sorted(out, key=str)


def _talk(rng):
    return "".join(rng.choice(["<|im_end|>", "<|im_start|>", "<|", "<\\|", "<", "|", "\\", "é", "🙂", "\n", " ", "  ", "\t", "ok", "assistant", "<|endoftext|>", "x" * 30, "日本"])
                   for _ in range(rng.randint(0, 40)))


def test_conversations_round_trip(spark):
    rng = random.Random(4)
    rows = [(i, t, rng.choice(["user", "assistant", "system", "a<|im_sep|>\n"]), _talk(rng)) for i in range(60) for t in range(rng.randint(1, 6))]
    rows += [(70, t, "assistant" if t % 2 else "user", _talk(rng)) for t in range(400)]  # a hot conversation
    rows += [(80, 1, "assistant", "same"), (80, 1, "assistant", "same"), (80, 1, "assistant", "other"), (80, None, None, None), (80, 2, "assistant", None),
             (None, 0, "user", "lost"), (None, 1, "assistant", "found"), (BIG + 1, 0, "assistant", "x" * 200_000), (BIG + 4, 0, "user", ""), (90, 0, "assistant", "")]
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "p", True) for r in rows], "conv_id long, turn long, role string, text string, piece string, whole boolean").repartition(5)
    want = digests(rows)
    get = lambda df: sorted(map(tuple, df.collect()), key=str)
    formatted = cut(chat.format_conversations(table, tokenizer_path()))
    assert formatted.filter("whole").count() == len(want) and get(chat.digest(formatted)) == want
    pieces = cut(chat.format_conversations(table, tokenizer_path(), piece_chars=500, partition_chars=40_000))
    of_hot = pieces.filter("conv_id = 70").orderBy("piece").collect()
    assert len(of_hot) > 5 and len({r.piece >> 32 for r in of_hot}) > 1 and get(chat.digest(pieces)) == want
    # the tokens of the pieces are those of the whole
    whole = formatted.filter("conv_id = 70").first()
    assert whole.ids == [x for r in of_hot for x in r.ids] and whole.loss == [x for r in of_hot for x in r.loss]
    assert chat.format_table(table.limit(0), tokenizer_path()).count() == 1  # conversation -1


def test_mask_by_binary_search():
    encoder = chat.tokenizer(tokenizer_path())
    rng = random.Random(1)
    for _ in range(50):
        turns = [(rng.choice(["user", "assistant"]), _talk(rng)) for _ in range(rng.randint(0, 5))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        e = encoder.encode(text, add_special_tokens=False)
        at = np.array(e.offsets).reshape(-1, 2)
        loss = chat.mask(at[:, 0], at[:, 1], spans)
        assert loss.tolist() == [any(a < hi and b > lo for lo, hi in spans) for a, b in e.offsets]
        assert all(not (a < lo < b or a < hi < b) for a, b in e.offsets for lo, hi in spans)  # no token crosses an end
        assert chat.masked_texts(text, at[:, 0], at[:, 1], loss) == [t for r, t in turns if r == "assistant" and t]
        assert encoder.decode(e.ids, skip_special_tokens=False) == text


# --- clusters -----------------------------------------------------------------------------------

def clustered(rows, size=64, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    centroids = [v for *_, v in named[:k]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        owner = [nearest(v)[1] for _, v in kept]
        centroids = [[sum(x) // len(mine) for x in zip(*mine)] if (mine := [v for (_, v), o in zip(kept, owner) if o == j]) else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = {j: sum(d for _, d, o in found if o == j) for j in range(len(centroids))}
    return sorted(((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found), key=str)


def _clusters(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>, row string, v string, key int"


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 64))
    rows = [(i, (centres[i % 5] + rng.normal(size=64) * 0.05).round(3).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.25] * 64) for i in range(120)] + [(1000, [0.25] * 64)] * 30  # ties, repeated rows
    rows += [(None, [0.5] * 64), (2000, None), (2001, [None] * 64), (2002, [float("nan")] * 64), (2003, [float("inf")] * 64), (2004, [1.0] * 63), (2005, []),
             (BIG + 1, [-0.5] * 64), (BIG + 4, [-0.3] * 64)]
    table = spark.createDataFrame([(i, v, "a", "b", 1) for i, v in rows], SCHEMA).repartition(4)
    want = clustered(rows)
    assert _clusters(zonemaps.cluster_table(table)) == want
    kept = cut(zonemaps.kept_vectors(table))
    assert _clusters(zonemaps.cluster(kept, block_rows=7, partition_rows=50)) == want
    assert zonemaps.cluster_table(table.limit(0)).count() == 0
    few = rows[:3] + [(7, [0.1] * 64)]
    assert _clusters(zonemaps.cluster_table(spark.createDataFrame([(i, v, "a", "b", 1) for i, v in few], SCHEMA))) == clustered(few)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=64) * 15_000).astype(np.float32).tolist()) for i in range(40)]
    table = spark.createDataFrame([(i, v, "a", "b", 1) for i, v in rows], SCHEMA)
    assert _clusters(zonemaps.cluster_table(table)) == clustered(rows)
    with pytest.raises(Exception, match="scaled component"):
        zonemaps.kept_vectors(spark.createDataFrame([(1, [1e6] * 64, "a", "b", 1)], SCHEMA)).collect()


def test_boxes_leave_out_far_centroids(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(8, 64))
    rows = [(i, (centres[rng.integers(0, 8)] + rng.normal(size=64) * 0.02).tolist(), "a", "b", 1) for i in range(2000)]
    kept = cut(zonemaps.kept_vectors(spark.createDataFrame(rows, SCHEMA)))
    blocks = cut(zonemaps.blocks_of(kept, 32))
    assert sum(len(r.ids) for r in blocks.select("ids").collect()) == 2000
    assert zonemaps.candidate_share(blocks, np.floor(centres * 1024).astype(int).tolist()) < 0.2


def test_candidates_hold_every_nearest_centroid():
    rng = np.random.default_rng(3)
    for _ in range(200):
        centroids = rng.integers(-20, 20, (6, 3))
        v = rng.integers(-8, 9, (30, 3)) + rng.integers(-15, 15, 3)
        near = zonemaps.candidates(v.min(0), v.max(0), centroids)
        assert set(zonemaps.distances(v, centroids).argmin(1)) <= set(near.tolist())


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (3, 4), (5, 2)])
def test_curve_walks_to_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = [k.tobytes() for k in zonemaps.hilbert_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[sorted(range(len(cells)), key=lambda i: keys[i])]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_only_the_first_rows_are_listed():
    rng = np.random.default_rng(7)
    n, k = 500, 3
    scores, ids, rows = rng.integers(0, 9, n), rng.integers(0, 40, n), rng.permutation(n)
    lists = negatives.SortedLists(rng.normal(size=(n, 4)), ids, np.zeros(n, int), rows)
    fit = scores < 7
    for s in (scores, scores.astype(object)):
        found = lists.first(fit, s, np.arange(n), k)
        best = sorted(np.nonzero(fit)[0], key=lambda i: (-scores[i], ids[i], rows[i]))[:k]
        assert sorted(found.tolist(), key=lambda i: (-scores[i], ids[i], rows[i]))[:k] == best
    assert len(lists.first(fit, scores, np.arange(n), k)) == k


def test_search_ends_when_all_rows_are_met():
    """Lists of one short label: the rows are met long before the lists end, and nothing is read behind them."""
    rng = np.random.default_rng(8)
    n, dim = 2000, 64
    v, labels = rng.integers(-99, 99, (n, dim)).astype(float), np.where(np.arange(n) < 5, 1, 2)
    lists = negatives.SortedLists(v, np.arange(n), labels, np.arange(n))
    read = []
    whole = lists.order

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, tuple) and isinstance(at[1], slice):
                read.append((at[1].stop or 0) - (at[1].start or 0))
            return np.asarray(super().__getitem__(at))
    lists.order = whole.view(Counted)
    found = lists.search(v[0], 0, 1, True, [(-np.inf, np.inf)], 10)[0]
    scores = v[1:5] @ v[0]
    assert [x[0] for x in found] == sorted(scores.astype(int).tolist(), reverse=True)
    assert 0 < sum(read) < n  # both ends of the lists; 2n when read to the end


def test_rest_is_met_at_once_when_most_rows_are_met():
    """On evenly spread vectors no threshold falls: the lists are left when they mostly hold rows met before, and the result is that of all rows."""
    rng = np.random.default_rng(5)
    n, dims = 4000, 64
    v = np.floor(256 * rng.normal(size=(n, dims)))
    lists = negatives.SortedLists(v, np.arange(n), np.arange(n) % 10, np.arange(n))
    for a in (0, 7, 11):
        scores = (v @ v[a]).astype(int)
        others = [i for i in range(n) if i % 10 != a % 10]
        high = int(np.median(scores))
        windows = [(-high - 1000, high), (high, high + 10_000)]
        want = []
        for low, top in windows:
            fit = [(int(scores[i]), i, i) for i in others if low <= scores[i] <= top]
            want.append(sorted(fit, key=lambda x: (-x[0], x[1]))[:3])
        before = lists.read
        assert lists.search(v[a], a, a % 10, False, windows, 3) == want
        assert lists.read - before < dims * n * 0.1
