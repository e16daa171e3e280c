import numpy as np
from pyspark.sql import functions as F

from faultline.operators import aggregates as ag, filters as fl, vectors as ve


def _vecs(spark, n, dim, key, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, dim)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{key} long, vec array<float>")


def _brute(qs, cs, k):
    out = set()
    for q, qv in qs:
        best = sorted(((-round(float(np.dot(qv, cv)), 6), c) for c, cv in cs))[:k]
        out |= {(q, c, r + 1) for r, (_, c) in enumerate(best)}
    return out


def _rows(df):
    return {(r.query_id, r.id, r["rank"]) for r in df.collect()}


def test_topk_with_ties_broadcast_and_cells(spark):
    qs, q = _vecs(spark, 7, 6, "query_id", 1)
    cs, c = _vecs(spark, 400, 6, "id", 2)
    c = c.repartition(5)
    want = _brute(qs, cs, 9)
    assert _rows(ve.topk(q, c, 9)) == want
    assert _rows(ve.topk(q, c, 9, max_bytes=100)) == want  # more queries than may travel


def test_topk_fewer_rows_than_k_and_prefixes(spark):
    _, q = _vecs(spark, 2, 3, "query_id", 3)
    _, c = _vecs(spark, 4, 3, "id", 4)
    assert ve.topk(q, c, 10).count() == 8
    assert _rows(ve.topk(q, c, 2)) <= _rows(ve.topk(q, c, 4))


def test_dedupe_with_a_hot_hash(spark):
    df = spark.range(3000).select(F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "")
                                  .otherwise(F.col("id").cast("string")).alias("commit_hash"))
    got = fl.dedupe_verdict(df)
    assert got.count() == 3000
    assert got.where("verdict = 'rejected'").count() == 999
    assert got.where("commit_hash = 'hot' and verdict = 'passed'").first().pos == 0


def test_scalar_filter_is_pushed_to_the_scan(spark, tmp_path):
    spark.range(10).select(F.lit("mm").alias("subsystem"), F.lit("hang").alias("bug_type"), F.lit("2020").alias("date")).write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(fl.scalar_filter("mm", "hang", "2019"))._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters:")[1]
    assert "block,fs,kernel,mm]" in pushed and "EqualTo(bug_type,hang" in pushed  # the text form is cut after 100 characters
    assert fl.scalar_filter_text("mm", "use_after_free") == ('(subsystem=="mm" || subsystem=="fs" || subsystem=="block" || subsystem=="kernel")'
                                                             ' && bug_type=="use_after_free"')


def test_numbering_chunks_and_top_n(spark):
    df = spark.range(0, 1000, 7).withColumnRenamed("id", "k")
    got = [r.row_no for r in ag.dense_number(df, "k").orderBy("k").collect()]
    assert got == list(range(143))
    sizes = [r["count"] for r in ag.even_chunks(df, "k", 4).groupBy("chunk_no").count().orderBy("chunk_no").collect()]
    assert sizes == [36, 36, 36, 35]
    g = spark.range(500).select("id", F.when(F.col("id") < 400, "hot").otherwise("cold").alias("g"))
    top = ag.top_n_per_group(g, ["g"], [F.desc("id")], 3, "id", salts=8)
    assert {(r.g, r.id) for r in top.collect()} == {("hot", 399), ("hot", 398), ("hot", 397), ("cold", 499), ("cold", 498), ("cold", 497)}


def test_deep_pages_read_their_ranges_only(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("score")).repartition(8)
    order = [F.desc("score"), F.asc("id")]
    want = sorted(((r.id, r.score) for r in df.collect()), key=lambda r: (-r[1], r[0]))
    for number, size in [(1, 40), (4, 40), (63, 40), (125, 40), (126, 40), (2, 4999), (1, 6000)]:
        got = ag.page(df, order, number, size, gather=10)
        assert [(r.id, r.score) for r in got.collect()] == want[(number - 1) * size:number * size], (number, size)
        assert got.columns == ["id", "score"]
    assert ag.page(df.limit(0), order, 2, 10, gather=1).count() == 0


def test_attempts_with_a_busy_key_ties_and_nulls(spark):
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 50 == 0 else "busy" if i % 3 else str(i % 11), None if i % 97 == 0 else float(t) / 4) for i, t in enumerate(rng.integers(0, 2000, 1500))]
    df = spark.createDataFrame(rows, "id long, user string, at double").withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))
    got = {r.id: r.attempts for r in ag.attempts_in_window(df, "user", "ts", 30).collect()}
    want = {i: sum(u == v and b is not None and t - 30 < b <= t for _, v, b in rows) for i, u, t in rows if t is not None}
    assert got == want
    assert ag.attempts_in_window(df, "user", "ts", 30).columns == [*df.columns, "attempts"]
    assert ag.attempts_in_window(df.limit(0), "user", "ts", 30).count() == 0
