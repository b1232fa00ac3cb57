"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Texts are tokenised where they are read; what travels afterwards is one narrow row per piece. Pieces are dealt out
evenly to shards of about ``SHARD`` rows; each shard fills its sequences on its own, so memory is bounded and a lost
shard is repacked alike. A shard's last sequences are the only ones that a packing of everything at once could improve.
"""

from __future__ import annotations

import itertools
import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from txnlens.llm.common import text_of
from txnlens.llm.textual import BASES, encoded, mix, parts, spans
from txnlens.sources.scratch import stored

CAPACITY = 2048
SHARD = 60_000
REMEMBERED = 400_000  # words and runs of punctuation whose ids a worker keeps, some 150 MB
JOINED = 1000  # words that go to the tokenizer as one text
PUNCTUATION = b".,;:!?*#$%&|<>"  # of these, and no apostrophe, which may begin a token with letters
_SPACE, _PUNCTUATION = np.zeros((2, 256), bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = _PUNCTUATION[list(PUNCTUATION)] = True
_CODERS: dict[str, Coder] = {}
# Texts whose ids must be those of their words for a tokenizer to be used word by word.
PROBES = ["Ab cD  eF\n\tGh", " one 2 three33 ", "l'été DON'T can't 'tis o'clock", "x,y z-w (q) [r] \u00c9t\u00c9 \u00f1\u00d1", "a" * 40 + " " + "B" * 40]


class _Generation(dict):
    """Runs by number, in the order of their entry, with their ids in one growing array."""

    def __init__(self):
        super().__init__()
        self.pool, self.at, self.size = np.zeros(1 << 12, np.uint32), *np.zeros((2, 1 << 10), int)
        self.known = self.full = 0
        self.new: list[bytes] = []  # entered, but without ids so far

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), int, len(words))

    def add(self, size: np.ndarray, flat: np.ndarray) -> None:
        """The ids of the words without ids, in the order of their numbers."""
        n = self.known + len(size)
        while n > len(self.at):
            self.at, self.size = (np.append(x, np.zeros_like(x)) for x in (self.at, self.size))
        while self.full + len(flat) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.at[self.known:n] = self.full + np.cumsum(size) - size
        self.size[self.known:n] = size
        self.pool[self.full:self.full + len(flat)] = flat
        self.known, self.full, self.new = n, self.full + len(flat), []

    def ids_of(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, all ids) of words by number."""
        size = self.size[number]
        upto = np.cumsum(size)
        return size, self.pool[np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.at[number] - upto + size, size)]


class Coder:
    """Token ids of texts through the ids of their words.

    For tokenizers that lower-case, drop white space and never join tokens across it, a text's ids are those of its
    words in turn; ASCII letters may be lowered first. ``PROBES`` are tried when a tokenizer is loaded, and one that does
    otherwise gets every text whole. Within some texts each run is looked up once, by a 64-bit hash of its bytes. Runs are
    remembered in two generations: when the young one is full it becomes the old one, from which only runs that are met
    again return. Runs of letters alone go to the tokenizer many at a time. A text that holds the beginning of a special
    token goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young, self.old = _Generation(), _Generation()
        words = [w for p in PROBES for w in p.lower().split()]
        marks = [f"ab{chr(c)}{chr(d)}" for c in PUNCTUATION for d in PUNCTUATION]
        self.by_word = (
            [i for p in PROBES for i in self._whole(p)] == [i for w in words for i in self._whole(w)]
            and all(self._whole(m) == self._whole("ab") + self._whole(m[2:]) for m in marks))
        ends = [i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]
        self.ends = np.zeros(max(self.tokenizer.get_vocab_size(), max(ends, default=0) + 1), bool)
        self.ends[ends] = True

    def __len__(self) -> int:
        return len(self.young) + len(self.old)

    def __contains__(self, word: bytes) -> bool:
        """Whether the ids of all runs of a word are remembered."""
        data, start, stop, _ = _runs([word])
        return all(data[a:b] in self.young or data[a:b] in self.old for a, b in zip(start, stop, strict=True))

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, all ids) of words that the tokenizer takes as they are."""
        if not words:
            return np.zeros(0, int), np.zeros(0, np.uint32)
        texts = [w.decode() for w in words]
        letters = np.fromiter(map(str.isalpha, texts), bool, len(texts))
        alone = [texts[i] for i in np.flatnonzero(~letters)]
        got = [e.ids for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
        many = [texts[i] for i in np.flatnonzero(letters)]
        if many:
            runs = [" ".join(many[k:k + JOINED]) for k in range(0, len(many), JOINED)]
            flat = np.fromiter(itertools.chain.from_iterable(
                e.ids for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)), np.uint32)
            # A word of letters ends with its only token that is marked as a word's end.
            stop = np.flatnonzero(self.ends[flat]) + 1
            if len(stop) == len(many) and stop[-1] == len(flat):
                size = np.zeros(len(texts), int)
                size[letters], size[~letters] = np.diff(np.append(0, stop)), [len(x) for x in got]
                out = np.zeros(size.sum(), np.uint32)
                own = np.repeat(letters, size)
                out[own], out[~own] = flat, list(itertools.chain.from_iterable(got))
                return size, out
        every = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([len(x) for x in every], int), np.fromiter(itertools.chain.from_iterable(every), np.uint32)

    def _learn(self) -> None:
        """Ids for all runs that the young generation lacks: from the old one, or encoded."""
        fresh = self.young.new
        back = np.fromiter(map(self.old.__contains__, fresh), bool, len(fresh))
        groups = [(back, *self.old.ids_of(self.old.numbers([fresh[i] for i in np.flatnonzero(back)]))),
                  (~back, *self._encoded([fresh[i] for i in np.flatnonzero(~back)]))]
        size = np.zeros(len(fresh), int)
        for which, sizes, _ in groups:
            size[which] = sizes
        flat = np.zeros(size.sum(), np.uint32)
        for which, _, ids in groups:
            flat[np.repeat(which, size)] = ids
        self.young.add(size, flat)

    def ids(self, texts: list[bytes], end: int) -> list[np.ndarray]:
        """The ids of each text followed by ``end``."""
        if len(self.young) > REMEMBERED // 2:
            self.old, self.young = self.young, _Generation()
        whole = [not self.by_word or b"<|" in t for t in texts]
        data, start, stop, last_run = _runs([b"" if w else t for t, w in zip(texts, whole, strict=True)])
        # Each run of these texts is looked up once.
        values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        _, first, which = np.unique(mix(spans(values, start, stop, BASES[0]) + (stop - start).astype(np.uint64)), return_index=True, return_inverse=True)
        number = self.young.numbers([data[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist(), strict=True)])
        if self.young.new:
            self._learn()
        size, flat = self.young.ids_of(number[which])
        ends = np.append(0, np.cumsum(size))[last_run]
        out, last = [], 0
        for text, alone, upto in zip(texts, whole, ends.tolist(), strict=True):
            ids = np.array(self._whole(text.decode()), np.uint32) if alone else flat[last:upto]
            out.append(np.append(ids, np.uint32(end)))
            last = upto
        return out


def _runs(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased texts as one buffer, where their runs start and end, and the number of runs up to each text's end.

    A run is a word, or a word without the punctuation at its end behind a letter, or that punctuation, which is a token
    run of its own.
    """
    data = (b" ".join(texts) + b" ").lower()
    buf = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[buf], prepend=True))
    start, end = edge[::2], edge[1::2]
    core = np.maximum(np.maximum.accumulate(np.where(_PUNCTUATION[buf], -1, np.arange(len(buf))))[end - 1] + 1, start)
    before, ahead = buf[core - 1], buf[np.maximum(core - 2, 0)]
    letter = (before >= 97) & (before <= 122) | (ahead == 0xC3) & (core - 2 >= start) & (before != 0x97) & (before != 0xB7)
    cut = (core < end) & (core > start) & letter
    place = np.cumsum(1 + cut) - 1 - cut
    starts, ends = np.zeros((2, len(start) + cut.sum()), int)
    starts[place], ends[place] = start, np.where(cut, core, end)
    starts[place[cut] + 1], ends[place[cut] + 1] = core[cut], end[cut]
    return data, starts, ends, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) for each row of ``docs``.

    ``tokenizer`` is the path of a tokenizer file that every executor can open. A null or empty text is one piece with
    the end token alone. Only documents of more than ``capacity`` tokens are cut. Repeated rows give repeated pieces;
    an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _CODERS.get(tokenizer) or _CODERS.setdefault(tokenizer, Coder(tokenizer))
        for batch in batches:
            texts, doc_ids = encoded(batch["text"]), batch["doc_id"].array
            for lo, hi in parts(texts):
                rows = []
                for i, ids in enumerate(coder.ids(texts[lo:hi], end), lo):
                    for start in range(0, len(ids), capacity):
                        part = ids[start:start + capacity].astype("<u4")
                        rows.append((doc_ids[i], start // capacity, start, len(part), zlib.crc32(part.tobytes()),
                                     *([part.astype(np.int64)] if with_ids else [])))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"doc_id": "Int64"})

    columns = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return base.mapInPandas(run, columns + (", ids array<bigint>" if with_ids else ""))


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each length, all between 1 and ``capacity``.

    A bin is filled with the longest document that fits, again and again. If room stays, its shortest document is
    swapped for the two unpacked ones that fill the widened room best, if they fill it better.
    """
    order = np.argsort(-lengths, kind="stable")
    left = np.bincount(lengths, minlength=capacity + 1).tolist()
    have = [n for n, c in enumerate(left) if c]  # lengths still unpacked, ascending

    def take(length: int, k: int) -> None:
        left[length] -= k
        if not left[length]:
            del have[bisect_left(have, length)]

    def give(length: int) -> None:
        if not left[length]:
            insort(have, length)
        left[length] += 1

    placed: list[tuple[int, int, int, int]] = []  # length, how many, bin, offset
    number = 0
    while have:
        filled: list[list[int]] = []
        room = capacity
        while room and (i := bisect_right(have, room)):
            length = have[i - 1]
            k = min(left[length], room // length)
            filled.append([length, k])
            take(length, k)
            room -= k * length
        if room and have and (pair := _pair(have, left, room + filled[-1][0], filled[-1][0])):
            shortest = filled[-1]
            shortest[1] -= 1
            give(shortest[0])
            for length in pair:
                take(length, 1)
                filled.append([length, 1])
        offset = 0
        for length, k in filled:
            if k:
                placed.append((length, k, number, offset))
                offset += length * k
        number += 1
    table = np.array(placed, np.int64).reshape(-1, 4)
    table = table[np.argsort(-table[:, 0], kind="stable")]  # as ``order`` has the lengths
    times = table[:, 1]
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    bins[order] = np.repeat(table[:, 2], times)
    offsets[order] = np.repeat(table[:, 3], times) + nth * np.repeat(table[:, 0], times)
    return bins, offsets


def _pair(have: list[int], left: list[int], room: int, beat: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the greatest sum above ``beat`` and up to ``room``."""
    best, found = beat, None
    i, j = 0, bisect_right(have, room) - 1
    while i <= j:
        total = have[i] + have[j]
        if total > room:
            j -= 1
            continue
        if total > best and (i < j or left[have[i]] > 1):
            best, found = total, (have[j], have[i])
            if total == room:
                break
        i += 1
    return found


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (stored; with ``length``) with ``sequence_id`` and ``offset``: pieces fill a sequence from 0 without gaps.

    Lengths must lie between 1 and ``capacity``. No pieces: no rows.
    """
    shards = max(1, -(-pieces.count() // SHARD))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        rows = pd.concat(rows, ignore_index=True) if rows else None
        if rows is None or not len(rows):
            return
        bins, offsets = best_two_fit(rows["length"].to_numpy(np.int64), capacity)
        rows["sequence_id"] = bins + (TaskContext.get().partitionId() << 32)
        rows["offset"] = offsets
        yield rows

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.repartition(shards).mapInPandas(run, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Token pieces of the documents with their sequence and offset."""
    return pack(stored(token_pieces(docs, tokenizer, capacity, end), "pack-pieces"), capacity)
