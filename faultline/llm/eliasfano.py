"""Elias-Fano sequences and n-gram tries over them, held in one memory-mapped buffer and queried in batches.

A sequence of n growing numbers below u keeps the low log2(u / n) bits of each number packed, and the high parts in unary: about 2 +
log2(u / n) bits a number. Queries never unpack a level: a batch of lookups touches the words it needs.

A trie has a level of contexts, a level of pointers (where each context's successors begin) and a level of successors. Successor names are made
to grow across contexts by adding the last value of the context before; a lookup adds the same base, taken from the level itself,
and so searches relative to its context.
"""

from __future__ import annotations

import mmap

import numpy as np

_U = np.uint64
BATCH = 1 << 15
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(1, dtype=np.uint8)
#: Place of the r-th one of a byte (0 where it has fewer).
_PLACE = np.stack([np.where(_ONES > r, (_BITS.cumsum(1) > r).argmax(1), 0) for r in range(8)], 1).astype(np.uint8)


class EliasFano:
    """A non-decreasing sequence of numbers below 2^63, kept as distances to the first (a shard's names fill a small range)."""

    def __init__(self, n: int, low_bits: int, least: int, lows: np.ndarray, highs: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.least = n, low_bits, _U(least)
        self.lows, self.highs = lows, highs  # packed low parts; unary high parts (a one for each number, a zero for each bucket's end)
        self.zeros, self.ones = zeros, ones  # how many zeros and ones lie before each word of highs

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, _U)
        n = len(values)
        least = int(values[0]) if n else 0
        values = values - _U(least)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        high = (values >> _U(low_bits)).astype(np.int64)
        length = n + (int(high[-1]) if n else 0) + 1
        bits = np.zeros(-(-length // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        bits[length:] = 1  # padding holds no zeros
        highs = np.packbits(bits, bitorder="little").view("<u8")
        count = bits.reshape(-1, 64).sum(1, dtype=np.int64)
        ones = np.concatenate([[0], count.cumsum()]).astype("<i8")
        zeros = (np.arange(len(ones), dtype=np.int64) * 64 - ones).astype("<i8")
        return cls(n, low_bits, least, cls._pack(values, low_bits), highs, zeros, ones)

    @staticmethod
    def _pack(values: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(len(values) * width // 64 + 2, "<u8")
        if width:
            low = values & _U((1 << width) - 1)
            at = np.arange(len(values), dtype=np.int64) * width
            word, shift = at >> 6, (at & 63).astype(_U)
            # fields overlap words but not each other, so sums of parts are their union
            starts = np.nonzero(np.diff(word, prepend=-1))[0]
            if len(starts):
                out[word[starts]] = np.bitwise_or.reduceat(low << shift, starts)
            over = np.nonzero((at & 63) + width > 64)[0]
            out[word[over] + 1] |= low[over] >> (_U(64) - shift[over])
        return out

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), _U)
        at = index.astype(np.int64) * self.low_bits
        word, shift = at >> 6, (at & 63).astype(_U)
        first = self.lows[word] >> shift
        second = np.where(shift > 0, self.lows[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return (first | second) & _U((1 << self.low_bits) - 1)

    def _select(self, rank: np.ndarray, counts: np.ndarray, of_ones: bool) -> np.ndarray:
        """Place of the rank-th (from 0) one or zero."""
        word = np.searchsorted(counts, rank, "right") - 1
        words = self.highs[word] if of_ones else ~self.highs[word]
        eight = words.view(np.uint8).reshape(-1, 8)
        seen = _ONES[eight].cumsum(1, dtype=np.uint8)
        left = (rank - counts[word]).astype(np.uint8)
        byte = (seen <= left[:, None]).sum(1)
        row = np.arange(len(word))
        left -= np.where(byte > 0, seen[row, byte - 1], 0).astype(np.uint8)
        return word * 64 + byte * 8 + _PLACE[eight[row, byte], left]

    def _in_batches(self, f, *columns: np.ndarray) -> np.ndarray:
        parts = [f(*[c[lo:lo + BATCH] for c in columns]) for lo in range(0, len(columns[0]), BATCH)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def get(self, index: np.ndarray) -> np.ndarray:
        """The numbers at these places."""
        def part(i):
            high = self._select(i, self.ones, True) - i
            return ((high.astype(_U) << _U(self.low_bits)) | self._low(i)) + self.least
        return self._in_batches(part, np.asarray(index, np.int64)).astype(_U)

    def successor(self, value: np.ndarray) -> np.ndarray:
        """For each value the place of the first number that is not smaller; n where there is none."""
        return self._in_batches(lambda v: self._search(v)[0], np.asarray(value, _U))

    def find(self, value: np.ndarray) -> np.ndarray:
        """The place of the first number that equals each value, -1 where none does."""
        def part(v):
            place, equal = self._search(v)
            return np.where(equal, place, -1)
        return self._in_batches(part, np.asarray(value, _U))

    def _search(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Successors' places, and whether they equal the values."""
        below = value < self.least
        value = np.where(below, _U(0), value - self.least)
        high = (value >> _U(self.low_bits)).astype(np.int64)
        low = value & _U((1 << self.low_bits) - 1)
        buckets = int(self.zeros[-1])  # every bucket up to that of the largest number ends in a zero
        inside = np.minimum(high, buckets)
        # a bucket begins after the zero of the one before it and ends at its own
        start = np.where(inside > 0, self._select(np.maximum(inside - 1, 0), self.zeros, False) + 1, 0) - inside
        end = start.copy()
        mine = np.nonzero(high < buckets)[0]
        end[mine] = self._select(high[mine], self.zeros, False) - high[mine]
        last = end.copy()
        todo = mine[start[mine] < end[mine]]
        while len(todo):  # binary search in every bucket at once: large contexts fill their buckets
            middle = (start[todo] + end[todo]) >> 1
            smaller = self._low(middle) < low[todo]
            start[todo[smaller]] = middle[smaller] + 1
            end[todo[~smaller]] = middle[~smaller]
            todo = todo[start[todo] < end[todo]]
        equal = np.zeros(len(value), bool)
        some = np.nonzero((start < last) & ~below)[0]
        equal[some] = self._low(start[some]) == low[some]
        return start, equal

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits, int(self.least), len(self.lows), len(self.highs)], "<i8"), self.lows, self.highs, self.zeros, self.ones]

    @classmethod
    def read(cls, words: np.ndarray, at: int) -> tuple["EliasFano", int]:
        """A sequence at a place of a buffer of 64-bit words, and the place after it."""
        n, low_bits, least, lows, highs = (int(x) for x in words[at:at + 5])
        cut = np.cumsum([at + 5, lows, highs, highs + 1, highs + 1])
        parts = [words[a:b] for a, b in zip(cut, cut[1:])]
        return cls(n, low_bits, least, parts[0], parts[1], parts[2].view("<i8"), parts[3].view("<i8")), int(cut[-1])

    @property
    def bits(self) -> int:
        return 64 * sum(len(a) for a in (self.lows, self.highs, self.zeros, self.ones))


class Trie:
    """Contexts, their successors and a code for each; names are numbers below 2^63 (contexts) and 2^40 (successors)."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray):
        self.contexts, self.pointers, self.successors, self.codes = contexts, pointers, successors, codes

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, code: np.ndarray) -> "Trie":
        """From entries sorted by context and then word, each pair once."""
        first = np.nonzero(np.diff(context, prepend=~context[:1]) != 0)[0] if len(context) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(context)))
        # a context's values begin after the last value of the one before
        lasts = word[np.append(first[1:], len(word)) - 1].astype(_U) + _U(1) if len(context) else np.zeros(0, _U)
        base = np.concatenate([[_U(0)], np.cumsum(lasts)[:-1]]).astype(_U) if len(lasts) else lasts
        values = np.repeat(base, sizes) + word.astype(_U) + _U(1)
        return cls(EliasFano.build(context[first]), EliasFano.build(np.append(first, len(context))), EliasFano.build(values), code.astype(np.uint8))

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The codes of (context, word) pairs, sorted by context; 0 where the trie has none."""
        out = np.zeros(len(context), np.uint8)
        if not self.contexts.n or not len(context):
            return out
        first = np.nonzero(np.diff(context, prepend=~context[:1]) != 0)[0]
        place = self.contexts.find(context[first])
        known = place >= 0
        begin, end, base = (np.zeros(len(first), np.int64) for _ in range(3))
        begin[known] = self.pointers.get(place[known])
        end[known] = self.pointers.get(place[known] + 1)
        later = known & (begin > 0)
        base[later] = self.successors.get(begin[later] - 1)
        sizes = np.diff(np.append(first, len(context)))
        asked = np.nonzero(np.repeat(known, sizes))[0]
        of = np.repeat(np.arange(len(first)), sizes)[asked]
        found = self.successors.find(base[of].astype(_U) + word[asked].astype(_U) + _U(1))
        inside = (found >= begin[of]) & (found < end[of])
        out[asked[inside]] = self.codes[found[inside]]
        return out

    def to_bytes(self) -> bytes:
        parts = [a for level in (self.contexts, self.pointers, self.successors) for a in level.arrays()]
        return b"".join(np.ascontiguousarray(a).tobytes() for a in parts) + self.codes.tobytes()

    @classmethod
    def map(cls, buffer) -> "Trie":
        """A trie over a buffer (a memory map or bytes); levels are views of it."""
        words = np.frombuffer(buffer, "<u8", len(buffer) // 8)
        contexts, at = EliasFano.read(words, 0)
        pointers, at = EliasFano.read(words, at)
        successors, at = EliasFano.read(words, at)
        return cls(contexts, pointers, successors, np.frombuffer(buffer, np.uint8, successors.n, 8 * at))

    @classmethod
    def open(cls, fs, path: str) -> "Trie":
        """Map a written trie: pages are read as lookups touch them. Stores without local files are read into an anonymous map."""
        from pyarrow import fs as stores
        if isinstance(fs, stores.LocalFileSystem):
            with open(path, "rb") as f:
                return cls.map(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        with fs.open_input_file(path) as f:
            held = mmap.mmap(-1, f.size())
            held.write(f.read())
            return cls.map(held)
