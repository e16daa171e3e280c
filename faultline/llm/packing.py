"""Best-fit packing: token pieces into sequences of fixed length.

Documents are tokenised in Spark tasks, which keep only (document, piece, length, checksum) rows. These small rows are dealt
by hash to groups of bounded size (equal rows by their row number), and each group is packed by best-fit decreasing; a segment tree over the remaining
capacities finds the tightest open sequence in logarithmic time. Groups grow in number, never in size.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import cut, hinted, text_of

CAPACITY = 2048
GROUP_ROWS = 25_000
_SPACE = r"[^\S\x1c-\x1f]"  # white space as the tokenizer sees it
_PLAIN = re.compile(r"[\t\n\r -~\xa1-\u024f]*")
#: FIXED VALUE: how byte-level BPE of this kind divides text before merging.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNIT = re.compile(rf"{_SPACE}*[\S\x1c-\x1f]+|{_SPACE}+")

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


def _rank_encoder(tokenizer_path: str):
    """An encoder that merges by rank, made from the tokenizer's own vocabulary, or None where merges are not in order of ids."""
    import tiktoken
    model = json.loads(Path(tokenizer_path).read_text())["model"]
    vocab, merges = model["vocab"], model["merges"]
    # byte-level vocabularies write each byte as a printable character: printable bytes as themselves, the others from U+0100 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    if [vocab.get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))) or any(vocab.get(c, 256) > 255 for c in byte_of):
        return None
    ranks = {bytes(map(byte_of.__getitem__, token)): k for token, k in vocab.items() if k < 256 + len(pairs)}
    return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


class TextEncoder:
    """Token ids of texts as little-endian 32-bit bytes, equal to ``tokenizers`` for every text.

    Texts of plain characters, on whose classes all Unicode versions agree, go to an encoder that merges the same pairs by
    rank. Others are cut at white space: merges never cross its start, so a text is the concatenation of its units (white space plus
    the word after it), and each unit that is not plain is encoded by ``tokenizers`` itself.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._ranks = _rank_encoder(tokenizer_path)

    def _plain(self, text: str) -> bool:
        return self._ranks is not None and bool(_PLAIN.fullmatch(text)) and not any(a in text for a in self._added)

    def encode(self, text: str) -> bytes:
        if self._plain(text):
            return _packed(self._ranks.encode_ordinary(text))
        if any(any(c.isspace() for c in a) for a in self._added):  # such a token could reach over units
            return _packed(self._tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self._unit, _UNIT.findall(text)))

    def _unit(self, unit: str) -> bytes:
        return _packed(self._ranks.encode_ordinary(unit) if self._plain(unit) else self._tokenizer.encode(unit, add_special_tokens=False).ids)


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def cut_points(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all but the first are full."""
    first = length % capacity or capacity
    if length <= capacity:
        return [(0, length)]
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of a document's ids followed by the end id 0.

    A null or empty text is one piece holding the end id. Rows that repeat a doc_id are documents of their own; a null
    doc_id is kept. Other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(tokenizer_path)
        for batch in batches:
            out = []
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text"))):
                ids = encoder.encode(text) + b"\0\0\0\0"
                for k, (start, n) in enumerate(cut_points(len(ids) // 4, capacity)):
                    out.append((doc_id, k, start, n, zlib.crc32(ids[4 * start:4 * (start + n)])))
            kinds = [f.split() for f in PIECES.split(", ")]
            columns = zip(*out) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == "int" else pa.int64()) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, PIECES)


class CapacityTree:
    """Segment tree over the capacities 0..capacity: how many open bins have each remaining capacity."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, remaining: int, change: int) -> None:
        k = remaining + self.size
        while k:
            self.count[k] += change
            k >>= 1

    def tightest(self, need: int) -> int:
        """The smallest remaining capacity of at least ``need`` that an open bin has, or -1."""
        count, k = self.count, need + self.size
        if count[k]:
            return need
        while k > 1:
            if not k & 1 and count[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if count[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length; lengths must come in decreasing order."""
    tree, open_bins, made = CapacityTree(capacity), {}, 0
    bins, offsets = [], []
    for n in lengths:
        left = tree.tightest(n)
        if left < 0:
            b, left, made = made, capacity, made + 1
        else:
            b = open_bins[left].pop()
            tree.add(left, -1)
        bins.append(b)
        offsets.append(capacity - left)
        if left > n:
            open_bins.setdefault(left - n, []).append(b)
            tree.add(left - n, 1)
    return bins, offsets


def pack(pieces_table: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add sequence_id and offset to piece rows. Every group holds about ``group_rows`` rows, whatever the input's size.

    Rows are dealt by what they hold. Groups of over 2 ``group_rows``, into which equal rows have met, are dealt again by row number.
    """
    groups = max(1, -(-pieces_table.count() // group_rows))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = best_fit_decreasing(rows.column("length").to_pylist(), capacity)
        first = rows.column("_group")[0].as_py() << 32
        return (rows.drop_columns("_group").append_column("sequence_id", pa.array(np.array(bins, "int64") + first))
                .append_column("offset", pa.array(offsets, pa.int64())))

    dealt = pieces_table.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    full = (dealt.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > 2 * group_rows)
            .select("_group", F.ceil(F.col("_rows") / group_rows).alias("_parts")))
    # at most one full group to 2 group_rows rows: a small table
    dealt = dealt.withColumn("_row", F.xxhash64(F.monotonically_increasing_id())).join(hinted(full, 16), "_group", "left")
    part = F.coalesce(F.pmod("_row", "_parts"), F.lit(0))
    return dealt.withColumn("_group", F.col("_group") + groups * part).drop("_row", "_parts").groupBy("_group").applyInArrow(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Tokenise, cut and pack documents; see ``pieces`` and ``pack``. An empty table gives no rows."""
    return pack(cut(pieces(docs, tokenizer_path, capacity), "pieces"), capacity, group_rows)
