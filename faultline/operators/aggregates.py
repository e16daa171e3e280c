"""Facets, statistics, paging, dense numbering, top-n per group and score normalisers.

Group sizes are not assumed to be even: counts aggregate map-side, per-group top-n works on
salted sub-groups first, and numbering, deep pages and running counts work in ranges of equal row counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.stage import cut

_C = F.col


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Value counts of several columns in one pass: (facet, value, n)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(_C(c).cast("string"), F.lit("unknown"))
                                         .alias("value")) for c in columns])).alias("p")
    return df.select(pairs).select("p.*").groupBy("facet", "value").agg(F.count("*").alias("n"))


def usage(df: DataFrame, by: str, text: str) -> DataFrame:
    """Calls, characters and words by ``by`` (null: unknown); sums join map-side."""
    t = F.coalesce(_C(text), F.lit(""))
    words = F.size(F.filter(F.split(t, " "), lambda w: w != ""))
    return df.groupBy(F.coalesce(_C(by), F.lit("unknown")).alias(by)).agg(
        F.count("*").alias("calls"), F.sum(F.char_length(t)).cast("bigint").alias("characters"), F.sum(words).cast("bigint").alias("words"))


def status_counts(df: DataFrame, status: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    aggs = [F.count("*").alias("total")] + [F.count_if(_C(status) == v).alias(f"n_{v}") for v in values]
    return (df.groupBy(*by) if by else df).agg(*aggs)


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, salt_key: str,
                    salts: int = 64, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each group in a total ``order``; a hot group is thinned per salt first."""
    by = [_C(g) for g in group]
    first = Window.partitionBy(*by, "_salt").orderBy(*order)
    final = Window.partitionBy(*by).orderBy(*order)
    return (df.withColumn("_salt", F.pmod(F.xxhash64(salt_key), F.lit(salts)))
            .withColumn("_r", F.row_number().over(first)).where(_C("_r") <= n)
            .withColumn(rank, F.row_number().over(final)).where(_C(rank) <= n).drop("_salt", "_r"))


def stratified_sample(df: DataFrame, max_count: int, group: str, newest: Column, tie: str) -> DataFrame:
    """Even quota per group, newest first, groups in descending string order, cut to ``max_count``."""
    groups = df.agg(F.count_distinct(group)).first()[0]
    quota = max(1, max_count // max(1, groups))
    picked = top_n_per_group(df.withColumn("_newest", newest), [group], [F.desc("_newest"), F.asc(tie)], quota, tie)
    return picked.orderBy(F.desc(group), F.asc("rank")).limit(max_count).drop("_newest")


def _ranges(df: DataFrame, order: list[Column], weight: Column) -> tuple[DataFrame, DataFrame]:
    """``df`` cut into ranges of ``order`` with _p, the range; and _p, _w, _off: the weight of each range and of all before it.

    Ranges have about equal row counts and there are as many as shuffle partitions, however uneven the keys are.  The
    ranged rows are written first, so all later steps see the same ranges.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sums = ranged.groupBy("_p").agg(F.sum(weight).alias("_w"))
    return ranged, cut(sums.withColumn("_off", F.coalesce(F.sum("_w").over(before), F.lit(0))))


def dense_number(df: DataFrame, key: str, out: str = "row_no") -> DataFrame:
    """Consecutive 0-based numbers in the order of a unique ``key``: rows are numbered inside their range and shifted by
    the counts of earlier ranges."""
    ranged, offsets = _ranges(df, [_C(key)], F.lit(1))
    inner = Window.partitionBy("_p").orderBy(key)
    return ranged.join(offsets.drop("_w"), "_p").withColumn(out, _C("_off") + F.row_number().over(inner) - 1).drop("_p", "_off")


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    return dense_number(df, key, "_no").withColumn("batch_no", F.floor(_C("_no") / size)).drop("_no")


def even_chunks(df: DataFrame, key: str, n_chunks: int) -> DataFrame:
    """n chunks whose sizes differ by at most one, larger chunks first."""
    total = df.count()
    q, r = divmod(total, n_chunks)
    no = _C("_no")
    big = r * (q + 1)
    chunk = F.when(no < big, F.floor(no / (q + 1))).otherwise(r + F.floor((no - big) / max(q, 1)))
    return dense_number(df, key, "_no").withColumn("chunk_no", chunk).drop("_no")


def page(df: DataFrame, order: list[Column], number: int, size: int, gather: int = 10_000) -> DataFrame:
    """Page ``number`` (from 1) of an ordered result.

    A page within the first ``gather`` rows is a top-k.  A deeper one would bring all rows before it to one task; there the
    rows are cut into ranges of the order, and only the ranges that hold the page are read and sorted.
    """
    first, last = (number - 1) * size, number * size
    if last <= gather:
        return df.orderBy(*order).offset(first).limit(size)
    ranged, offsets = _ranges(df, order, F.lit(1))
    held = offsets.where((_C("_off") < last) & (_C("_off") + _C("_w") > first)).orderBy("_p").collect()
    skipped = held[0]["_off"] if held else 0
    return ranged.where(_C("_p").isin([r["_p"] for r in held])).orderBy(*order).offset(first - skipped if held else 0).limit(size).drop("_p")


def min_max(df: DataFrame, group: list[str], value: str, out: str = "normalized") -> DataFrame:
    """Min-max per group (0.5 for a constant group).  One row per group joins back; the statistics
    are written first, so Spark knows their size and only broadcasts a small table."""
    stats = cut(df.groupBy(*group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")))
    v = _C(value)
    return (df.join(stats, group).withColumn(out, F.when(_C("_lo") == _C("_hi"), F.lit(0.5)).otherwise(
        (v - _C("_lo")) / (_C("_hi") - _C("_lo")))).drop("_lo", "_hi"))


def softmax(df: DataFrame, group: list[str], value: str, out: str = "probability") -> DataFrame:
    top = cut(df.groupBy(*group).agg(F.max(value).alias("_top")))
    e = df.join(top, group).withColumn("_e", F.exp(_C(value) - _C("_top")))
    return (e.join(cut(e.groupBy(*group).agg(F.sum("_e").alias("_sum"))), group)
            .withColumn(out, _C("_e") / _C("_sum")).drop("_top", "_e", "_sum"))


def attempts_in_window(df: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """Requests of the same key in (ts - seconds, ts], this one included; rows without ts are left out, null keys are one key.

    A window's count is the difference of two running counts.  Rows of one key and time are counted map-side; both ends of
    each window are marks in one order of (key, time), cut into ranges of equal row counts, so a busy key, or a busy hour of
    it, spans as many ranges as it needs.  Counts run within a range and are shifted by those of all ranges before.
    """
    span = seconds * 1_000_000
    rows = df.withColumn("_us", F.unix_micros(_C(ts).cast("timestamp"))).where(_C("_us").isNotNull())
    times = rows.groupBy(_C(key).alias("_key"), "_us").agg(F.count("*").alias("_n"))
    mark = lambda at, late, n, sign: F.struct(at.alias("at"), F.lit(late).alias("late"), n.alias("n"), F.lit(sign).alias("sign"))
    ends = F.explode(F.array(mark(_C("_us"), 0, _C("_n"), 1), mark(_C("_us") - span, 1, F.lit(0).cast("bigint"), -1)))
    marks = times.select("_key", "_us", ends.alias("_m")).select("_key", "_us", "_m.*")
    order = [_C("_key"), _C("at"), _C("late")]  # a window's open end follows the rows of its time
    ranged, offsets = _ranges(marks, order, _C("n"))
    running = F.sum("n").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    counted = ranged.join(offsets.drop("_w"), "_p").withColumn("_count", _C("sign") * (running + _C("_off")))
    found = counted.groupBy("_key", _C("_us").alias("_at")).agg(F.sum("_count").alias("attempts"))
    return (rows.join(found, _C(key).eqNullSafe(_C("_key")) & (_C("_us") == _C("_at"))).drop("_us", "_key", "_at"))


def newest_per_store(df: DataFrame, cap: int, created: str, tie: str) -> DataFrame:
    """Keep the ``cap`` newest rows (the store's eviction rule)."""
    return df.orderBy(F.desc(created), F.desc(tie)).limit(cap)
