"""Spans of a text as column expressions: positions in code points, without Python.

A span is a struct (start, ord, kind, stop, piece, before, after); ``stop`` is exclusive, ``ord`` is the kind's place in its list, and
``before`` and ``after`` are the nearest characters around it. Java's matcher finds matches leftmost and without overlap; splitting
by the same pattern gives the text between them, so lengths add up to positions.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

AROUND = 32
BLOCK = 64  # appending copies an array: spans are built in blocks, so that a text with very many of them copies few
SPAN = "struct<start:int,ord:int,kind:string,stop:int,piece:string,before:string,after:string>"


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def matches(text: Column, kind: str, ord_: int, pattern: str, gate: Column) -> Column:
    """All matches of ``pattern`` where ``gate`` holds; it must hold wherever the pattern can match."""
    pieces, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # the last gap has no piece
    rows = F.arrays_zip(gaps.alias("gap"), pieces.alias("piece"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        stop = start + F.char_length(x["piece"])
        span = F.struct(start.alias("start"), F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), stop.alias("stop"),
                        x["piece"].alias("piece"), F.right(x["gap"], F.lit(AROUND)).alias("before"), F.left(x["next"], F.lit(AROUND)).alias("after"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def spans_of(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.struct(start.alias("at"), none().alias("out")), step, lambda acc: acc["out"])

    def width(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda n, x: n + F.char_length(x["gap"]) + F.char_length(x["piece"]))

    def shift(acc: Column, block: Column) -> Column:
        return F.struct((acc["at"] + width(block)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def of_blocks(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), shift, lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, starts, spans_of))

    def of_rows(rows: Column) -> Column:
        last = F.greatest(F.ceil(F.size(rows) / BLOCK).cast("int") - 1, F.lit(0))
        return let(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(rows, b * BLOCK + 1, F.lit(BLOCK))), of_blocks)

    return F.when(gate, let(F.filter(rows, lambda x: x["piece"].isNotNull()), of_rows)).otherwise(none())


def listed(spans: Column) -> Column:
    """kind:start:end of each span, by start and then kind, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def uncovered(spans: Column, by: Column) -> Column:
    """The spans that overlap none of ``by``."""
    return F.filter(spans, lambda s: ~F.exists(by, lambda b: (s["start"] < b["stop"]) & (b["start"] < s["stop"])))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"),
                        F.when(apart, F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), s["kind"], F.lit("]"))))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(F.array_sort(spans), start, step, lambda acc: F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.char_length(text)))))
    return F.when(F.size(spans) > 0, F.array_join(done, "")).otherwise(text)
