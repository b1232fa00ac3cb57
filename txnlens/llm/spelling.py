"""Spelling variants: words one edit apart, by Gram matrices of letter-count blocks.

One inserted or deleted letter changes one letter count by one; a replaced letter changes two. So two words one edit
apart have letter counts whose squared distance is at most 2 and lengths that differ by at most 1. Words are dealt to
blocks by how many of their letters fall into each of a few letter groups (the counts of a block add up to its length):
an edit moves a word to the same block, to one where a letter went from one group to another, or to one with a letter
more, so only such blocks of equal or adjacent length meet. The number of groups follows the vocabulary, which keeps
blocks small. Where two blocks meet, one NumPy product of their count matrices gives all squared distances, pairs at
most 2 apart are verified letter by letter, and each word keeps the number of its near words and the most frequent one.

A block of more than ``TILE`` words, or of more than ``TILE_LETTERS`` letters, is cut into pieces that meet piece by piece:
neither a common shape of words nor very long words make a task that grows with the corpus. No pairs leave a task, only
a row for each word that found some there. Counting is done by Spark's own functions; the form that most near words
share is followed to the last by doubling steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.sources.scratch import stored

TILE = 4096
TILE_LETTERS = 1 << 20
ROWS = 512  # of a tile that one product takes
LEAST_LENGTH, LEAST_COUNT, DAMAGE = 5, 3, 97
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]  # of lower-cased runs
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = "word string, n_near bigint, near_n bigint, near string"
_PLACE = np.zeros(256, np.int64)
_PLACE[LETTERS] = np.arange(len(LETTERS))


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n``: the words of at least 5 letters that occur at least 3 times, some damaged by a rule on their hash.

    A null text has no words; a null id enters the hash as nothing. Rows that repeat count again.
    """
    text = F.translate(docs["text"].cast("string"), CAPITALS, SMALL)
    run = F.explode(F.split(text, r"[^a-zÀ-ÿ]+")).alias("run")
    runs = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("id"), run).where(F.length("run") >= LEAST_LENGTH)
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    runs = runs.select("run", h.alias("h"))
    cut = (F.col("h") % F.length("run")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % DAMAGE == 0, damaged).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def _block(word: Column, groups: int) -> Column:
    """How many letters of the word fall into each group of letters."""
    def members(g: int) -> str:
        return "".join(chr(c) for c in LETTERS if c % groups == g)

    return F.array(*[F.length(word) - F.length(F.translate(word, members(g), "")) for g in range(groups)])


def _steps(groups: int) -> list[list[int]]:
    """What an edit may add to a block: nothing, a letter moved to a later group, or one more letter; each pair once."""
    def step(**at: int) -> list[int]:
        return [at.get(f"g{g}", 0) for g in range(groups)]

    moves = [step(**{f"g{a}": -1, f"g{b}": 1}) for a in range(groups) for b in range(a + 1, groups)]
    return [step(), *moves, *[step(**{f"g{g}": 1}) for g in range(groups)]]


class _Side:
    """Letters and letter counts of the words of one tile, all of one length."""

    def __init__(self, words: list[str]):
        self.length = len(words[0])
        self.letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), self.length)
        cells = np.arange(len(words))[:, None] * len(LETTERS) + _PLACE[self.letters]
        self.counts = np.bincount(cells.ravel(), minlength=len(words) * len(LETTERS)).reshape(len(words), -1)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters differ by exactly one edit; ``b`` has as many letters as ``a`` or one more."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    ahead = np.cumprod(a == b[:, :n], axis=1, dtype=bool).sum(axis=1)
    behind = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=bool).sum(axis=1)
    return ahead + behind >= n


def near_pairs(left: _Side, right: _Side, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in two tiles whose words are one edit apart; of one tile with itself each pair once."""
    used = np.flatnonzero(left.counts.any(axis=0) | right.counts.any(axis=0))
    # Exact in the smallest kind of number that holds four squared lengths.
    kind = np.float32 if right.length < 2048 else np.float64 if right.length < 1 << 25 else np.int64
    a, b = (side.counts[:, used].astype(kind) for side in (left, right))
    a, b = (np.column_stack(x) for x in ((-2 * a, (a * a).sum(axis=1), np.ones(len(a), kind)), (b, np.ones(len(b), kind), (b * b).sum(axis=1))))
    few = max(1, (1 << 22) // right.length)
    for at in range(0, len(a), ROWS):
        squares = a[at:at + ROWS] @ b.T
        i, j = np.divmod(np.flatnonzero(squares.ravel() < 2.5), len(b))
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), few):
            p, q = i[k:k + few], j[k:k + few]
            good = _one_edit(left.letters[p], right.letters[q])
            yield p[good], q[good]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of two tiles: how many near words it has in the other, and the first of them in the tile's order."""
    for batch in batches:
        for r in batch.to_pylist():
            sides = [_Side(r["words"]), _Side(r["others"])]
            words, counts = (r["words"], r["others"]), (r["ns"], r["other_ns"])
            n_near = [np.zeros(len(w), np.int64) for w in words]
            best = [np.full(len(w), 1 << 60) for w in words]
            for i, j in near_pairs(*sides, same=r["same"]):
                for side, own, other in ((0, i, j), (1, j, i)):
                    n_near[side] += np.bincount(own, minlength=len(words[side]))
                    np.minimum.at(best[side], own, other)
            if r["same"]:
                n_near, best = [n_near[0] + n_near[1]], [np.minimum(*best)]
            rows = [(words[s][k], int(n_near[s][k]), counts[1 - s][best[s][k]], words[1 - s][best[s][k]])
                    for s in range(len(n_near)) for k in np.flatnonzero(n_near[s])]
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["word", "n_near", "near_n", "near"])


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, near_n, near`` of each word (stored, with ``word, n``) that has near words."""
    size = words.count()
    groups = max(2, round(math.log2(size + 2) / 4.5))
    keyed = words.withColumn("key", _block(F.col("word"), groups))
    length = F.aggregate("key", F.lit(0), lambda a, b: a + b)
    room = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(TILE_LETTERS / length)))
    blocks = stored(keyed.groupBy("key").agg(F.count("*").alias("size")).select(
        "key", F.ceil(F.col("size") / room).cast("int").alias("pieces")), "spelling-blocks")
    # The most frequent word comes first in its tile, so the first near word found there is its best.
    tiles = keyed.join(blocks, "key").groupBy("key", F.pmod(F.xxhash64("word"), "pieces").cast("int").alias("piece")).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), "word", "n"))).alias("w"))
    tiles = stored(tiles.select("key", "piece", F.col("w.word").alias("words"), F.col("w.n").alias("ns")), "spelling-tiles")

    steps = F.array(*[F.array(*map(F.lit, s)) for s in _steps(groups)])
    meetings = tiles.select("key", "piece", F.posexplode(steps).alias("step", "add"))
    meetings = meetings.withColumn("to", F.zip_with("key", "add", lambda a, b: a + b)).drop("add").join(
        blocks.select(F.col("key").alias("to"), "pieces"), "to")
    meetings = meetings.withColumn("to_piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    meetings = meetings.where("step > 0 OR to_piece >= piece")
    others = tiles.select(F.col("key").alias("to"), F.col("piece").alias("to_piece"), F.col("words").alias("others"), F.col("ns").alias("other_ns"))
    met = meetings.join(tiles, ["key", "piece"]).join(others, ["to", "to_piece"])
    met = met.select("words", "ns", "others", "other_ns", F.expr("step = 0 AND piece = to_piece").alias("same"))
    found = met.mapInArrow(_meet, FOUND)
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near", "near_n"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.near_n").alias("near_n"), F.col("b.near").alias("near"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: forms followed to the last, twice as far in each round.

    Frequencies at least double along a chain, so there are at most 6 rounds of 64-bit counts.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stored(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not now.where("moved").limit(1).count():
            return now.drop("moved")
        now = now.drop("moved")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every counted word of ``docs``.

    Two words are near if one inserted, deleted or replaced letter tells them apart. The form is the near word of largest
    n (the first in code-point order among equals) where that is at least twice the word's; the root is the last form, the
    word itself where it has none. Without words, as in an empty table, there are no rows; other columns are ignored.
    """
    words = stored(count_words(docs), "spelling-words")
    near = near_words(words)
    is_form = F.col("near_n") >= 2 * F.col("n")
    known = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "spelling-forms")
    roots = _roots(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
