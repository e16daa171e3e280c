import gzip
import hashlib
import io
import json
import math
import random
import uuid

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from faultline.llm import mtree, warc
from faultline.llm.shared import cut, file_system

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op4_warc_members", "op9_mtree_top_k"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in cols)) for r in df.collect())


# --- metric trees -------------------------------------------------------------------------------

def brute(rows, every, k):
    whole = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for at, (q, a) in enumerate(whole):
        if q % every:
            continue
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for n, (i, b) in enumerate(whole) if n != at and len(a) == len(b))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(400)]
    rows += [(500 + i, [0.5] * 6) for i in range(60)]  # ties
    rows += [(700, None), (701, [None] * 6), (702, [float("nan")] * 6), (750, [float("inf")] * 6), (None, [1.0] * 6), (800, []), (850, [0.0] * 6), (703, [1.0, 2.0]), (704, [2.0, 1.0]),
             (900, [0.5] * 6), (900, [0.5] * 6), (900, [1.0] * 6), (801, []), (950, [2.0 ** 22, 3.0]), (951, [2.0 ** 22, 1.0]), (952, [2.0 ** 22, 2.0])]
    table = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, v string, shard string")
    get = lambda df: sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())
    want = sorted(brute(rows, 50, 5))
    assert get(mtree.search_table(table)) == want
    ints = cut(mtree.integer_vectors(table))
    assert get(mtree.top_k(ints, ints.filter("vec_id % 50 = 0"), 5, shard_rows=120)) == want
    assert mtree.search_table(table.limit(0)).count() == 0


def test_equal_vectors_spread_over_shards(spark, tmp_path, monkeypatch):
    rows = [(1, [3.0, 4.0])] * 900 + [(i, [float(i), 1.0]) for i in range(2, 102)]
    ints = cut(spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "row long, vec_id long, v array<double>").repartition(3))
    queries = ints.filter("vec_id = 50")

    class Seen(mtree.MTree):
        def __init__(self, points, ids, rows):
            (tmp_path / f"{uuid.uuid4().hex}-{len(ids)}").touch()
            super().__init__(points, ids, rows)

    monkeypatch.setattr(mtree, "MTree", Seen)
    got = mtree.top_k(ints, queries, 5, shard_rows=100).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(k + 1, 101 - k, (101 - k) * 50 + 1) for k in range(5)]
    sizes = [int(f.name.split("-")[1]) for f in tmp_path.iterdir()]
    assert sum(sizes) < 500 and max(sizes) < 200  # bounds leave most shards without a tree
    shards = [r["count"] for r in mtree._sharded(ints, 100).groupBy("n", "shard", "split").count().collect()]
    assert sum(shards) == 1000 and max(shards) < 200


def test_tree_of_equal_vectors():
    tree = mtree.MTree(np.array([[3.0, 4.0]] * 900 + [[50.0, 1.0]]), np.arange(901))
    assert tree.search(np.array([1.0, 1.0]), -1, 3) == [(51, 900), (7, 0), (7, 1)]


def test_tree_skips_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (40, 16))
    points = (centres[rng.integers(0, 40, 5000)] + rng.integers(-5, 6, (5000, 16))).astype(float)
    tree = mtree.MTree(points, np.arange(5000), page=32)
    for q in points[:20]:
        want = sorted(((int(q @ p), -i) for i, p in enumerate(points)), reverse=True)[:5]
        assert tree.search(q, -1, 5) == [(s, -i) for s, i in want]
    assert tree.computed < 20 * 5000 * 0.8


# --- archives -----------------------------------------------------------------------------------

def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(1)
    long = "é\r\n\r\nWARC/1.1 <p>" * 200
    rows = [(i, f"http://x/{i}\r\nX: y", "".join(rng.choice("ab<>é\r\n") for _ in range(rng.randint(0, 3000)))) for i in range(60)]
    rows += [(100, "u", long), (101, None, long), (102, "u", long), (102, "u", long), (103, "u", "short"), (104, "u", "short"), (105, "u", None), (106, "u", ""),
             (None, "u", long), (107, "u", "x" * 999), (108, "u", "x" * 999), (109, "u", "y" * 1000), (110, "u", "y" * 1000), (111, "u", "z" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "a", "b") for r in rows], "page_id long, url string, html string, payload string, _kept string").repartition(3)
    archives = warc.write_monolithic(warc.classify(pages), f"file:{tmp_path}/one")
    normal = warc.normalise(archives, f"file:{tmp_path}/many")
    index = warc.read_index(normal)
    got = sorted([(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in warc.read_indexed(index).collect()], key=str)
    want, kept = [], {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            kept[h] = max(kept.get(h, -1), -1 if i is None else i)
    for i, u, h in rows:
        b = (h or "").encode()
        again = len(b) >= 1000 and kept[h] != (-1 if i is None else i)
        want.append((i, u, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", kept[h] if again else None, b"" if again else b))
    assert got == sorted(want, key=str)
    # each member of a normalised archive is a record, and the members are the monolithic stream
    for row in normal.collect():
        fs, path = file_system(row.archive)
        data = fs.open_input_stream(path, compression=None).read()
        entries = [json.loads(x) for x in open(file_system(row.sidecar)[1])]
        members = [gzip.decompress(data[e["offset"]:e["offset"] + e["length"]]) for e in entries]
        assert sum(e["length"] for e in entries) == len(data) and all(m.startswith(b"WARC/1.1\r\n") for m in members)
        assert gzip.open(path.replace("/many/", "/one/")).read() == b"".join(members)
    # normalising again changes nothing
    again = warc.read_index(warc.normalise(normal, f"file:{tmp_path}/again"))
    assert sorted((r.record, r.offset, r.length) for r in again.collect()) == sorted((r.record, r.offset, r.length) for r in index.collect())
    assert warc.archive_pages(spark, pages.limit(0)).count() == 0


def test_truncated_archive_is_refused():
    record = warc.record_bytes("1", "u", b"abc", 3, "d", "response", None)
    assert [h["WARC-Type"] for h, _ in warc.split_records(iter([record[:7], record[7:], record]))] == ["response"] * 2
    with pytest.raises(ValueError):
        list(warc.split_records(iter([record, record[:-3]])))
    packed = gzip.compress(record * 2000)
    assert b"".join(warc.inflate(io.BytesIO(packed + packed))) == record * 4000
    for end in (-1, -9, 40):
        with pytest.raises(ValueError):
            list(warc.inflate(io.BytesIO(packed[:end])))
