"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole, ``<|im_start|>role<|im_sep|>text<|im_end|>`` per turn, and encoded once with offsets. The three
control strings are tokens of their own, so no token crosses the end of a text. The mask is found by binary search of the tokens' offsets in
the sorted spans of the assistant's texts.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import cut, hinted

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Longer conversations are rendered and encoded in pieces of whole turns (a longer turn is a piece).
PIECE_CHARS = 2_000_000
PARTITION_CHARS = 32_000_000
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
FORMATTED = ("conv_id bigint, piece bigint, whole boolean, n_turns bigint, text string, ids array<int>, starts array<int>, ends array<int>, "
             "loss array<boolean>")


def escape(text: str) -> str:
    """One more backslash between every ``<`` and ``|`` that backslashes or nothing divide: no control string is left."""
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation and the spans of the assistant's texts in it (code points, ascending)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        parts += [head, body, END]
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) turns of a rendered conversation."""
    turns = [x.removeprefix(START).split(SEP, 1) for x in text.split(END)[:-1]]
    return [(unescape(r), unescape(t)) for r, t in turns]


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens that overlap a span: the first span that ends behind the token's start must begin before its end."""
    if not spans:
        return np.zeros(len(starts), bool)
    low, high = np.array(spans, np.int64).T
    at = np.searchsorted(high, starts, side="right")
    return (at < len(low)) & (low[np.minimum(at, len(low) - 1)] < ends) & (starts < ends)


def masked_texts(text: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The unescaped runs of text under a mask. Tokens of one character's bytes share its offsets."""
    out, lo, hi = [], 0, 0
    for a, b in zip(starts[loss].tolist(), ends[loss].tolist()):
        if a > hi:
            out.append(text[lo:hi])
            lo = a
        hi = max(hi, b)
    out.append(text[lo:hi])
    return [unescape(x) for x in out if x]


def tokenizer(path: str):
    """The tokenizer of a file with the control strings as tokens and offsets that keep white space."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
    from tokenizers import AddedToken, Tokenizer, processors
    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, SEP, END)])
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


def _turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the text's digest, which orders the rows of one turn and role."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text")).withColumn("_digest", F.md5("text"))


def _formatter(path: str, piece_chars: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encoder, first = tokenizer(path), TaskContext.get().partitionId() << 32
        pieces, key, turns, chars = 0, (), [], 0

        def out() -> pa.RecordBatch:
            text, spans = render(turns)
            e = encoder.encode(text, add_special_tokens=False)
            at = np.array(e.offsets, np.int32).reshape(-1, 2)
            loss = mask(at[:, 0], at[:, 1], spans)
            one = lambda x, kind: pa.ListArray.from_arrays([0, len(x)], pa.array(x, kind))
            return pa.RecordBatch.from_arrays([
                pa.array([key[0]], pa.int64()), pa.array([first + pieces], pa.int64()), pa.array([whole]), pa.array([len(turns)], pa.int64()),
                pa.array([text]), one(e.ids, pa.int32()), one(at[:, 0], pa.int32()), one(at[:, 1], pa.int32()), one(loss, pa.bool_())],
                names=[x.split()[0] for x in FORMATTED.split(", ")])

        for b in batches:
            for conv_id, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if key and (key[0] != conv_id or not whole and chars + len(text) > piece_chars):
                    yield out()
                    pieces, turns, chars = pieces + 1, [], 0
                key = (conv_id,)
                turns.append((role, text))
                chars += len(text)
        if key:
            yield out()
    return run


def format_conversations(rows: DataFrame, tokenizer_path: str, piece_chars: int = PIECE_CHARS, partition_chars: int = PARTITION_CHARS) -> DataFrame:
    """conv_id, piece, whole, n_turns, text, ids, starts, ends, loss: rendered and encoded conversations with their loss masks.

    ``rows``: conv_id, turn, role, text in any order, extra columns ignored. Null roles and texts are empty ones, rows without conv_id are one
    conversation without id, a null turn comes first, and rows of one turn go by role and the text's md5; repeated rows are turns of their own. A
    conversation of at most ``piece_chars`` characters is one row, ``whole``. A longer one is split over tasks by ranges of its turns and comes in
    pieces of whole turns; as control strings are tokens, the tokens of its pieces are those of the whole. ``piece`` ascends along a conversation.
    """
    turns = _turns(rows)
    sizes = turns.groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"))
    every = turns.sparkSession.sparkContext.defaultParallelism
    total = sizes.agg(F.sum("chars"), F.max("chars")).first()
    parts = max(every, -(-(total[0] or 0) // partition_chars))
    order = ("conv_id", "turn", "role", "_digest")
    if (total[1] or 0) <= piece_chars:
        return turns.repartition(parts, "conv_id").sortWithinPartitions(*order).mapInArrow(_formatter(tokenizer_path, piece_chars, True), FORMATTED)
    long = hinted(cut(sizes.filter(F.col("chars") > piece_chars).select(F.col("conv_id").alias("_long")), "long"), 16)
    same = F.col("conv_id").eqNullSafe(F.col("_long"))
    short = turns.join(long, same, "left_anti").repartition(parts, "conv_id").sortWithinPartitions(*order)
    ranged = (*order, "_row")  # repeated rows are told apart, so that ranges can cut between them
    ranges = turns.join(long, same, "left_semi").withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *ranged).sortWithinPartitions(*ranged)
    return (short.mapInArrow(_formatter(tokenizer_path, piece_chars, True), FORMATTED)
            .unionByName(ranges.mapInArrow(_formatter(tokenizer_path, piece_chars, False), FORMATTED)))


DIGESTED = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
_READ = ("conv_id bigint, piece bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, "
         "turns string, loss string")


def _read_back(b: pa.RecordBatch) -> Iterator[tuple]:
    """(conv_id, piece, turns, text of the turns, text under the mask, characters) read from formatted rows alone."""
    for i in range(b.num_rows):
        text = b.column("text")[i].as_py()
        starts, ends, loss = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("starts", "ends", "loss"))
        turns = parse(text)
        yield (b.column("conv_id")[i].as_py(), b.column("piece")[i].as_py(), len(turns), "".join(f"{r}\n{t}\n" for r, t in turns),
               "".join(masked_texts(text, starts, ends, loss)), len(text))


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted conversations.

    Whole conversations are digested where they are. The pieces of a long one pass through one task in their order, one at a time: a
    digest is a sequential sum, but no more than a piece is held.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column("whole").to_pylist()
            yield _table([(i, piece, n, *_sums(t, x), c, None, None) if one else (i, piece, n, None, len(x), None, c, t, x)
                          for one, (i, piece, n, t, x, c) in zip(whole, _read_back(b))], _READ)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def closed() -> pa.RecordBatch:
            return _table([(key[0], held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4])], DIGESTED)

        for b in batches:
            rows = []
            for i in range(b.num_rows):
                conv_id, _, n, turns_sha, n_loss, loss_sha, chars, turns, loss = (c[i].as_py() for c in b.columns)
                if turns is None:
                    rows.append((conv_id, n, turns_sha, n_loss, loss_sha, chars))
                    continue
                if key != (conv_id,):
                    if key:
                        yield closed()
                    key, held = (conv_id,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                held[0] += n
                held[1].update(turns.encode())
                held[2] += n_loss
                held[3].update(loss.encode())
                held[4] += chars
            yield _table(rows, DIGESTED)
        if key:
            yield closed()

    return (formatted.mapInArrow(read, _READ).repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(joined, DIGESTED))


def _sums(turns: str, loss: str) -> tuple[str, int, str]:
    return hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def conversation_minus_one(conversations: DataFrame) -> DataFrame:
    """The table with a conversation -1 whose texts are control strings."""
    said = "<|im_end|><|im_start|>assistant ok"
    two = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(two)


def format_table(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    return digest(format_conversations(conversation_minus_one(conversations), tokenizer_path))




SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, md5(text)), '')) AS loss_sha256,
       CAST(sum(32 + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
