"""N-gram language-model scoring with Elias-Fano tries.

Texts are coded once into blocks of about BLOCK_TOKENS tokens, a written table. Each block sends the distinct n-grams of its texts, with
their training counts, to shards by name; a shard sums the counts, builds the trie of its trained n-grams (``eliasfano.Trie``) with a
quantised probability each, writes it to the shared folder, maps it, and answers the n-grams of every block from it. The answers go back
to the blocks, which score their texts. So every n-gram crosses the network once per block and order, however often it occurs, and no
task, nor the driver, holds the model: shards grow in number with the corpus.

A shard is a range of context names. Contexts of over a shard's share of all tokens, the start of the text among them, are counted for each
order and spread over several shards by their successors.

Model: p_1(w) = (c(w) + 1) / (N + V + 1), and for order k, with context h: p_k(w|h) = (c(hw) + m p_{k-1}(w)) / (c(h) + m). The tries keep the
probability of hw; m is chosen from GRID by the leave-one-out likelihood of the training texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .eliasfano import Trie
from .shared import crc_of_id, cut, file_system, fresh_path, text_of

ORDER = 2
BLOCK_TOKENS = 600_000
SHARD_NGRAMS = 1_000_000
HEAVY_SHARE = 0.001
GRID = (1.0, 5.0, 25.0, 100.0, 400.0, 1600.0)
EXACT, RATIO = 32, 1.115  # codes of counts: each up to EXACT, then steps of RATIO
_U = np.uint64


def _names(words: list[bytes]) -> np.ndarray:
    """62-bit names. No word is empty or a space, so these name the end and the start."""
    import xxhash
    return np.fromiter((xxhash.xxh64_intdigest(w) >> 2 for w in words), _U, len(words))


END, START = b"", b" "


# --- blocks -------------------------------------------------------------------------------------

class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def tokens_of(text: str) -> list[bytes]:
    """Words between white space (0x20, 0x09-0x0D) with A-Z lowered, then the end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


BLOCKS = "block string, ids binary, known_ids binary, held binary, lengths binary, codes binary, names binary, counts binary, tokens bigint, trained bigint, texts bigint"


def _planes(numbers: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bytes by bytes of equal weight: the upper ones are mostly zero, so that shuffles compress them well."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<i8").ravel()


def blocks(docs: DataFrame, held: F.Column, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Coded texts in blocks: codes count a block's words in order of appearance; counts are those of its training texts."""
    def coded(name: str, rows: list[tuple], codes: _Codes, ids: list[np.ndarray]) -> tuple:
        lengths, flat = np.array([len(x) for x in ids], np.int64), np.concatenate(ids)
        held_out = np.array([r[1] for r in rows], bool)
        trained = np.bincount(flat[~np.repeat(held_out, lengths)], minlength=len(codes))
        doc_ids = np.array([-1 if r[0] is None else r[0] for r in rows], "<i8")
        return (name, doc_ids.tobytes(), np.array([r[0] is not None for r in rows], np.uint8).tobytes(), held_out.astype(np.uint8).tobytes(),
                lengths.astype("<i8").tobytes(), _planes(flat, 3), _names(list(codes)).astype("<u8").tobytes(), _planes(trained, 4),
                len(flat), int(trained.sum()), int((~held_out).sum()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        part, n = TaskContext.get().partitionId(), 0
        columns = [c.split()[0] for c in BLOCKS.split(", ")]
        rows, codes, ids, size = [], _Codes(), [], 0
        for batch in batches:
            for doc_id, text, out in zip(batch["doc_id"], batch["text"], batch["held"]):
                words = tokens_of(text)
                rows.append((None if doc_id is None or doc_id != doc_id else int(doc_id), out))
                ids.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
                size += len(words)
                if size >= block_tokens:
                    yield pd.DataFrame([coded(f"{part}-{n}", rows, codes, ids)], columns=columns)
                    rows, codes, ids, size, n = [], _Codes(), [], 0, n + 1
        if rows:
            yield pd.DataFrame([coded(f"{part}-{n}", rows, codes, ids)], columns=columns)

    # ids as decimals keep large numbers and nulls exact through pandas
    rows = docs.select(F.col("doc_id").cast("bigint").cast("string").alias("doc_id"), text_of().alias("text"), held.alias("held"))
    return rows.mapInPandas(run, BLOCKS)


# --- words: counts over all training texts ------------------------------------------------------

def _of_range(names: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges of the names' space each name is in."""
    return np.minimum((names.astype(float) * (parts / 2.0 ** bits)).astype(np.int64), parts - 1)


def word_counts(table: DataFrame, shards: int) -> DataFrame:
    """block, part, counts (of the block's words of that shard, in order of name), distinct (trained words of the shard)."""
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, names, counts in zip(batch["block"], batch["names"], batch["counts"]):
                names, counts = np.frombuffer(names, "<u8"), _from_planes(counts, 4)
                order = np.argsort(names)
                names, counts = names[order], counts[order]
                part = _of_range(names, 62, shards)
                at = np.nonzero(np.diff(part, prepend=-1))[0]
                yield pd.DataFrame([(int(part[a]), block, names[a:b].tobytes(), _planes(counts[a:b], 4)) for a, b in zip(at, [*at[1:], len(names)])],
                                   columns=["part", "block", "names", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        names = [np.frombuffer(x, "<u8") for x in rows["names"]]
        counts = np.concatenate([_from_planes(x, 4) for x in rows["counts"]])
        distinct, inverse = np.unique(np.concatenate(names), return_inverse=True)
        total = np.bincount(inverse, counts, len(distinct)).astype("<i8")
        ends = np.cumsum([len(x) for x in names])[:-1]
        return pd.DataFrame({"block": rows["block"], "part": rows["part"], "counts": [_planes(x, 6) for x in np.split(total[inverse], ends)],
                             "distinct": int((total > 0).sum())})

    sent = table.select("block", "names", "counts").mapInPandas(send, "part bigint, block string, names binary, counts binary")
    return sent.groupBy("part").applyInPandas(add, "block string, part bigint, counts binary, distinct bigint")


def contexts_of(codes: np.ndarray, lengths: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Name of each token's context: those of the k - 1 tokens before it, mixed; starts fill what is missing."""
    starts, start_name = np.cumsum(lengths) - lengths, _names([START])[0]
    previous, context = codes, None
    for _ in range(k - 1):
        previous = np.concatenate([[-1], previous[:-1]])
        previous[starts] = -1
        name = np.where(previous >= 0, names[previous], start_name)
        context = name if context is None else _mix(context ^ (_mix(name) >> _U(2))) >> _U(2)
    return context


def heavy_contexts(table: DataFrame, k: int, tokens: int, share: float = HEAVY_SHARE) -> dict[int, float]:
    """Names of the contexts of order k that over ``share`` of all tokens follow -> their share; at most 1 / share of them.

    Such a context has over share / 2 of some block's tokens, or too few tokens to matter; only those are counted over all blocks.
    """
    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                codes, lengths, names, _ = _block_arrays(row)
                name, counts = np.unique(contexts_of(codes, lengths, names, k), return_counts=True)
                top = np.nonzero(counts > max(1.0, len(codes) * share / 2))[0]
                yield pd.DataFrame({"name": name[top].astype(np.int64), "n": counts[top].astype(np.int64)})

    rows = (table.select("codes", "lengths", "names", "held").mapInPandas(local, "name bigint, n bigint").groupBy("name").agg(F.sum("n").alias("n"))
            .filter(F.col("n") > tokens * share).collect())
    return {r.name: r.n / tokens for r in rows}


# --- n-grams ------------------------------------------------------------------------------------

class Grams:
    """The distinct n-grams of order k of a block, sorted by context name and word name.

    ``of``: the n-gram of each token. ``context``, ``word``: their names (word: its upper 40 bits). ``code``: the word's code in the block.
    ``before``: for order 2 the code of the context word (-1: start); for higher orders the lower-order n-gram that is the context, by token.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, names: np.ndarray, k: int):
        order = np.argsort(names)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        distinct, context_rank = np.unique(contexts_of(codes, lengths, names, k), return_inverse=True)
        key, self.of = np.unique(context_rank.astype(_U) << _U(32) | rank[codes].astype(_U), return_inverse=True)
        self.context = distinct[(key >> _U(32)).astype(np.int64)]
        self.code = order[(key & _U(0xFFFFFFFF)).astype(np.int64)]
        self.word = names[self.code] >> _U(22)
        first = np.zeros(len(key), np.int64)
        first[self.of[::-1]] = np.arange(len(codes))[::-1]
        self.first = first  # a token of each n-gram

    def shards(self, parts: int, heavy: dict[int, float]) -> np.ndarray:
        """Each n-gram's shard: a range of contexts, or for a heavy context a range of its words."""
        out = _of_range(self.context, 62, parts)
        at = parts
        for name, share in sorted(heavy.items()):
            n = int(np.ceil(share * parts))
            if n > 1:
                lo, hi = np.searchsorted(self.context, [_U(name), _U(name + 1)])
                out[lo:hi] = at + _of_range(self.word[lo:hi], 40, n)
                at += n
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def quantise(counts: np.ndarray) -> np.ndarray:
    """8-bit codes of positive counts; 0 is no n-gram."""
    steps = np.round(np.log(np.maximum(counts, EXACT) / EXACT) / np.log(RATIO))
    return np.where(counts <= EXACT, counts, np.minimum(EXACT + steps, 255)).astype(np.uint8)


def count_table() -> np.ndarray:
    """Code -> count; divided by the tokens of the training texts, the n-gram's probability."""
    code = np.arange(256, dtype=float)
    return np.where(code <= EXACT, code, EXACT * RATIO ** (code - EXACT))


def _block_arrays(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (_from_planes(row.codes, 3), np.frombuffer(row.lengths, "<i8"), np.frombuffer(row.names, "<u8"),
            np.frombuffer(row.held, np.uint8).astype(bool))


def ngram_codes(table: DataFrame, k: int, parts: int, heavy: dict[int, float], folder: str, keep: bool = False) -> DataFrame:
    """block, part, codes: the trie codes of a block's n-grams of each shard, in their order.

    A shard's trie lies in ``folder`` while its task reads it, and with ``keep`` also afterwards.
    """
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                codes, lengths, names, held = _block_arrays(row)
                g = Grams(codes, lengths, names, k)
                counts = np.bincount(g.of[~np.repeat(held, lengths)], minlength=len(g.context))
                part = g.shards(parts, heavy)
                order = np.argsort(part, kind="stable")
                context, word, counts, part = g.context[order], g.word[order], counts[order], part[order]
                at = np.nonzero(np.diff(part, prepend=-1))[0]
                out = []
                for a, b in zip(at, [*at[1:], len(part)]):
                    first = np.nonzero(np.diff(context[a:b], prepend=~context[a:a + 1]) != 0)[0]
                    sizes = np.diff(np.append(first, b - a))
                    w = word[a:b]
                    out.append((int(part[a]), row.block, context[a:b][first].tobytes(), _planes(sizes, 4), w.astype("<u4").tobytes(),
                                (w >> _U(32)).astype(np.uint8).tobytes(), _planes(counts[a:b], 4)))
                yield pd.DataFrame(out, columns=["part", "block", "contexts", "sizes", "low", "high", "counts"])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        contexts = [np.frombuffer(x, "<u8") for x in rows["contexts"]]
        sizes = [_from_planes(x, 4) for x in rows["sizes"]]
        distinct, place = np.unique(np.concatenate(contexts), return_inverse=True)
        key = np.repeat(place.astype(_U) << _U(40), np.concatenate(sizes))
        word = np.concatenate([np.frombuffer(x, "<u4") for x in rows["low"]]).astype(_U)
        word |= np.concatenate([np.frombuffer(x, np.uint8) for x in rows["high"]]).astype(_U) << _U(32)
        counts = np.concatenate([_from_planes(x, 4) for x in rows["counts"]])
        key |= word
        trained = np.nonzero(counts)[0]
        known, inverse = np.unique(key[trained], return_inverse=True)
        total = np.bincount(inverse, counts[trained], len(known))
        built = Trie.build(distinct[(known >> _U(40)).astype(np.int64)], known & _U((1 << 40) - 1), quantise(total))
        fs, path = _write(f"{folder}/order-{k}-shard-{int(rows['part'].iloc[0])}{'' if keep else '-' + uuid.uuid4().hex}.trie", built.to_bytes())
        trie = Trie.open(fs, path)
        del built, key, known, inverse, total, counts
        out, at = [], 0
        for c, n in zip(contexts, sizes):
            m = int(n.sum())
            out.append(trie.lookup(np.repeat(c, n), word[at:at + m]).tobytes())
            at += m
        if not keep:
            del trie
            fs.delete_file(path)
        return pd.DataFrame({"block": rows["block"], "part": rows["part"], "codes": out})

    sent = table.select("block", "codes", "lengths", "names", "held").mapInPandas(
        send, "part bigint, block string, contexts binary, sizes binary, low binary, high binary, counts binary")
    return sent.groupBy("part").applyInPandas(answer, "block string, part bigint, codes binary")


def _write(uri: str, data: bytes):
    """A whole file under its final name, whatever attempt writes it."""
    fs, path = file_system(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    mine = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(mine) as f:
        f.write(data)
    fs.move(mine, path)
    return fs, path


# --- scores -------------------------------------------------------------------------------------

SCORES = "doc_id string, held_out boolean, n_tokens bigint, n_known bigint, base_score double, scores array<double>, left_out array<double>"


def _score_block(row, answers: pd.DataFrame, order: int, parts: int, heavy: dict[int, dict[int, float]], tokens: int, distinct: int, texts: int) -> pd.DataFrame:
    codes, lengths, names, held = _block_arrays(row)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    answers = answers.sort_values(["k", "part"])
    by_order = {k: [_from_planes(x, 6) if k == 1 else np.frombuffer(x, np.uint8) for x in part["codes"]] for k, part in answers.groupby("k")}
    count = np.empty(len(names), np.int64)
    count[np.argsort(names)] = np.concatenate(by_order[1])
    total = float(tokens + distinct + 1)
    base = np.log10((count + 1) / total)
    starts = np.cumsum(lengths) - lengths
    per_doc = lambda w: np.bincount(doc, w, len(lengths))
    levels, of_context = [], count[codes]  # of each token: count of its n-gram, and of the context alone
    for k in range(2, order + 1):
        g = Grams(codes, lengths, names, k)
        c = np.empty(len(g.context))
        c[np.argsort(g.shards(parts, heavy[k]), kind="stable")] = count_table()[np.concatenate(by_order[k])]
        before = np.concatenate([[0], of_context[:-1]]).astype(float)
        before[starts] = texts
        of_context = c[g.of]
        levels.append((of_context, before))
        del g
    scores, left_out = np.empty((len(lengths), len(GRID))), np.empty((len(lengths), len(GRID)))
    for j, m in enumerate(GRID):
        # probabilities of each token, and with its own occurrence left out
        p, q = ((count + 1) / total)[codes], (np.maximum(count, 1) / (total - 1))[codes]
        for c, before in levels:
            p = (c + m * p) / (before + m)
            q = (np.maximum(c - 1, 0) + m * q) / (np.maximum(before - 1, 0) + m)
        scores[:, j], left_out[:, j] = per_doc(np.log10(p)), per_doc(np.log10(q)) * ~held
    ids, known = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.known_ids, np.uint8)
    return pd.DataFrame({"doc_id": [str(i) if ok else None for i, ok in zip(ids.tolist(), known.tolist())], "held_out": held, "n_tokens": lengths,
                         "n_known": per_doc((count > 0)[codes]).astype(np.int64), "base_score": per_doc(base[codes]), "scores": list(scores),
                         "left_out": list(left_out)})


def score(docs: DataFrame, held: F.Column, order: int = ORDER, block_tokens: int = BLOCK_TOKENS, shard_ngrams: int = SHARD_NGRAMS,
          model: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, weight (the m in use); texts with ``held`` never teach.

    Null text counts as empty: its one token is the end. Repeated rows teach and are scored as often as they stand; a null doc_id stays
    null; other columns are ignored; an empty table gives no rows. ``model``: a shared folder in which the tries stay. Without training texts N = V = 0 and every token has probability 1.
    """
    spark = docs.sparkSession
    table = cut(blocks(docs, held, block_tokens), "blocks")
    sums = table.agg(F.sum("tokens"), F.sum("trained"), F.sum("texts"), F.sum(F.octet_length("names") / 8)).first()
    all_tokens, tokens, texts, words = (int(x or 0) for x in sums)
    parts = max(1, -(-all_tokens // shard_ngrams))
    heavy = {k: heavy_contexts(table, k, all_tokens, min(HEAVY_SHARE, 1 / parts)) for k in range(2, order + 1)}
    counted = cut(word_counts(table, max(1, -(-words // shard_ngrams))), "words")
    distinct = counted.groupBy("part").agg(F.max("distinct").alias("n")).agg(F.sum("n")).first()[0] or 0
    folder = model or fresh_path(spark, "tries")
    answers = counted.select("block", F.lit(1).alias("k"), "part", F.col("counts").alias("codes"))
    for k in range(2, order + 1):
        got = cut(ngram_codes(table, k, parts, heavy[k], folder, model is not None), "codes")
        answers = answers.unionAll(got.select("block", F.lit(k).alias("k"), "part", "codes"))

    def run(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([_score_block(row, found, order, parts, heavy, tokens, int(distinct), texts) for row in block.itertuples(index=False)])

    rows = table.select("block", "ids", "known_ids", "held", "lengths", "codes", "names")
    scored = cut(rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, SCORES), "scores")
    likelihood = scored.agg(*[F.sum(F.col("left_out")[j]).alias(f"m{j}") for j in range(len(GRID))]).first()
    best = max(range(len(GRID)), key=lambda j: (likelihood[j] or 0.0, -j))
    return scored.select(F.col("doc_id").cast("bigint").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"),
                         "base_score", F.col("scores")[best].alias("score"), F.lit(GRID[best]).alias("weight"))


def score_table(spark: SparkSession, sf: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf}/documents.parquet"), crc_of_id("doc_id") % 7 == 2)
