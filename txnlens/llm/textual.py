"""Word and n-gram hashing of many texts at once, on byte buffers.

Words are maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, which in
UTF-8 are the characters of ``WORD``. Hashes are differences of running polynomial sums modulo 2^64, so the cost per
byte or word is constant whatever the length of an n-gram. They depend on fixed constants only: retries agree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Odd multipliers for bytes in a word and for words in an n-gram, and their inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}
BATCH_BYTES = 1 << 20


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of an odd base, or of its inverse."""
    have = _POWERS.get((base, inverse))
    if have is None or len(have) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        have = np.full(max(n, 1 << 16), step, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if len(have) <= 1 << 22:
            _POWERS[base, inverse] = have
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of ``values[start:end]`` for each pair, independent of where it stands."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    # cut the range at the first start so that small spans of a long buffer need few inverses
    return (sums[end] - sums[start]) * powers(base, len(values) + 1, inverse=True)[start]


class Words:
    """The words of several texts: where each starts and ends in ``data``, its text's number, its hash."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = b" ".join(texts) + b" "
        self.n = len(texts)
        buf = np.frombuffer(self.data, np.uint8)
        if lower:
            buf = _LOWER[buf]
        space = _SPACE[buf]
        before = np.empty_like(space)
        before[0] = True
        before[1:] = space[:-1]
        self.start = np.flatnonzero(before & ~space)
        self.end = np.flatnonzero(space & ~before)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, begins)  # number of the first word of each text, and the total
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.counts)
        size = (self.end - self.start).astype(np.uint64)
        self.hash = mix(spans(buf.astype(np.uint64) + np.uint64(1), self.start, self.end, BASES[0]) + size)

    def grams(self, n: int, base: int = BASES[1], salt: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(number of the first word, hash) of every run of ``n`` words inside one text."""
        at = np.arange(max(0, len(self.hash) - n + 1))
        at = at[self.doc[at] == self.doc[at + n - 1]] if len(at) else at
        return at, mix(spans(self.hash, at, at + n, base), salt)

    def slice(self, first: int, last: int) -> bytes:
        """The bytes from word ``first`` to word ``last``, both included."""
        return self.data[self.start[first]:self.end[last]]


def encoded(texts) -> list[bytes]:
    """UTF-8 bytes of each text, empty for a null."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def _ranges(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of items of about ``limit`` together; a larger item stands alone."""
    begin = size = end = 0
    for i, n in enumerate(sizes):
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size, end = size + n, i + 1
    if begin < end:
        yield begin, end


def parts(texts: list[bytes], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together; a longer text stands alone."""
    return _ranges(map(len, texts), limit)


def pieces(batches: Iterable[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with about ``limit`` bytes of ``text`` (binary, no nulls), and their texts.

    Only the texts of a slice become Python objects; a batch of long texts is held once, as Arrow has it.
    """
    for batch in batches:
        for lo, hi in _ranges(pc.binary_length(batch.column("text")).to_pylist(), limit):
            piece = batch.slice(lo, hi - lo)
            yield piece, piece.column("text").to_pylist()


# Letters (with every byte of a longer character), capitals and digits are a class each, and so is any other byte.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[97:123] = _KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND_LOWER = _KIND[_LOWER]


class Runs:
    """Runs of bytes of one class in several texts, white space left out: word parts, capitals, numbers, symbols."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = b" ".join(texts) + b" "
        buf = np.frombuffer(data, np.uint8)
        kind = (_KIND_LOWER if lower else _KIND)[buf]
        self.n, self.buf = len(texts), (_LOWER[buf] if lower else buf)
        edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
        self.start = edge[kind[edge] != 0]
        stop = np.append(edge, len(buf))
        self.end = stop[np.searchsorted(stop, self.start, side="right")]
        self.kind = kind[self.start]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, begins)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.counts)
        self._values = self.buf.astype(np.uint64) + np.uint64(1)

    def hashes(self, length: int | None = None, which: np.ndarray | None = None) -> np.ndarray:
        """Hash of each run (of those in ``which``), or of its first ``length`` bytes."""
        start, end = (self.start, self.end) if which is None else (self.start[which], self.end[which])
        if length is not None:
            end = np.minimum(end, start + length)
        return mix(spans(self._values, start, end, BASES[0]) + (end - start).astype(np.uint64), 21)
