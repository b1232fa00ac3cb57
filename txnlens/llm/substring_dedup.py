"""Exact removal of repeated passages by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document; the minimiser of a window is the least hash of the runs of
``SEED`` words inside it. Consecutive windows with the same minimiser form a super-k-mer, which travels as one packed
string of words to the bucket of its minimiser; equal windows always meet there, and sorting the windows of a bucket
counts them.

Two things keep this small and even. Minimisers are counted first, as bare numbers with a map-side combine: a
super-k-mer whose minimiser occurs nowhere else cannot hold a repeated window and does not travel. And a minimiser that
occurs more than ``HOT`` times (a passage that very many documents share) does not go to one bucket: its super-k-mers
are dealt into shares. Those that meet an equal one in their share repeat as a whole; then one of each kind is counted
window by window, and those that met no equal one look theirs up.

Buckets are sorted by Spark (it spills) and read as a stream. A window's identity is a 128-bit hash of its words, all
else is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.common import let, text_of, words_of
from txnlens.llm.textual import BASES, Words, mix, parts, pieces, spans
from txnlens.sources.scratch import stored

WINDOW = 35
SEED = 8
PART_BYTES = 1 << 18  # of texts hashed at once: over a dozen arrays of eight bytes per byte or word of them stand beside each other
HOT = 5000  # so many super-k-mers at most are one bucket
SHARE = 100  # so many super-k-mers of a hot minimiser, about, are one share
FOUND = ["doc_id", "text_key", "first", "last", "packed", "size", "n"]


def super_kmers(w: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first word, number of windows) of each run of windows of one text that share a minimiser.

    The minimiser is a place: where its value occurs twice, in a text that repeats itself, that makes two runs.
    """
    n = len(w.hash) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int)
    at = np.arange(len(w.hash) - seed + 1)
    low = mix(spans(w.hash, at, at + seed, BASES[1]), 3)
    width, have = window - seed + 1, 1
    while have < width:  # sliding minimum and its place, by doubling
        step = min(have, width - have)
        later = low[step:] < low[:len(low) - step]
        low, at = (np.where(later, x[step:], x[:len(x) - step]) for x in (low, at))
        have += step
    inside = w.doc[:n] == w.doc[window - 1:]
    change = np.ones(n, bool)
    change[1:] = (at[1:] != at[:-1]) | (w.doc[1:n] != w.doc[:n - 1]) | ~inside[:-1]
    first = np.flatnonzero(change & inside)
    ends = np.append(np.flatnonzero(change), n)
    size = ends[np.searchsorted(ends, first, side="right")] - first
    # a run ends where windows stop lying inside one text
    stop = np.append(np.flatnonzero(~inside), n)
    size = np.minimum(size, stop[np.searchsorted(stop, first)] - first)
    return low[first], first, size


def _minimisers(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches, PART_BYTES):
            low, _, _ = super_kmers(Words(texts), window, seed)
            values, counts = np.unique(low, return_counts=True)
            yield pa.RecordBatch.from_pydict({"minimiser": values.view(np.int64), "n": counts.astype(np.int64)})

    return run


def _places(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in pieces(batches, PART_BYTES):
            w = Words(texts)
            low, first, size = super_kmers(w, window, seed)
            doc = w.doc[first] if len(first) else np.zeros(0, int)
            yield pa.RecordBatch.from_pydict({
                "minimiser": low.view(np.int64), "doc_id": piece.column("doc_id").take(pa.array(doc)),
                "text_key": piece.column("text_key").take(pa.array(doc)),
                "first": (first - w.first[doc]).astype(np.int32), "size": size.astype(np.int32)})

    return run


def _pack(window: int):
    """Each listed super-k-mer as a packed string of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in pieces(batches, PART_BYTES):
            w = Words(texts)
            runs = piece.column("runs")
            doc = np.repeat(np.arange(len(texts)), runs.value_lengths().to_numpy())
            minimiser, first, size, shares = runs.flatten().flatten()
            begin = w.first[doc] + first.to_numpy()
            packed = [b" ".join(w.slice(i, j).split()) for i, j in zip(begin, begin + size.to_numpy() + window - 2)]
            yield pa.RecordBatch.from_pydict({
                "minimiser": minimiser, "packed": pa.array(packed, pa.binary()), "shares": shares, "first": first, "size": size,
                "doc_id": piece.column("doc_id").take(pa.array(doc)), "text_key": piece.column("text_key").take(pa.array(doc))})

    return run


def window_hashes(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the window at each word (of those that lie inside one text, only these are used)."""
    at = np.arange(max(0, len(w.hash) - window + 1))
    return tuple(mix(spans(w.hash, at, at + window, base), salt).view(np.int64) for base, salt in ((BASES[1], 4), (BASES[2], 5)))


def _unpacked(group: pd.DataFrame, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in it, two hashes) of every window of packed super-k-mers."""
    packed, sizes = list(group["packed"]), group["size"].to_numpy()
    ends = np.append(0, np.cumsum(sizes))
    row = np.repeat(np.arange(len(group)), sizes)
    place = np.arange(len(row)) - ends[row]
    hashes = []
    for lo, hi in parts(packed, PART_BYTES):
        w = Words(packed[lo:hi])
        some = slice(ends[lo], ends[hi])
        at = w.first[:-1][row[some] - lo] + place[some]
        hashes.append([h[at] for h in window_hashes(w, window)])
    return row, place, *np.concatenate(hashes, axis=1)


def _equal_hot(hot: pd.DataFrame, window: int) -> Iterator[pd.DataFrame]:
    """Super-k-mers of hot minimisers, ``n`` equal ones as one row, and the ranges of those that have equals here."""
    kind = pd.factorize(hot["packed"])[0]
    n = np.bincount(kind)
    yield hot.assign(last=np.int32(0), n=n[kind])[FOUND][~hot["packed"].duplicated()]
    equal = hot[n[kind] > 1]
    yield equal.assign(last=(equal["first"] + equal["size"] + window - 1).astype(np.int32), packed=None, size=np.int32(0), n=0)[FOUND]


def _count(window: int):
    """Word ranges of the windows that occur twice or more in their bucket, from rows sorted by bucket.

    A share of a hot minimiser does not hold all of its super-k-mers: they pass, equal ones as one row.
    """

    def ranges(group: pd.DataFrame) -> pd.DataFrame:
        row, place, h1, h2 = _unpacked(group, window)
        bucket = group["bucket"].to_numpy()[row]
        order = np.lexsort((h2, h1, bucket))
        equal = (np.diff(bucket[order]) == 0) & (np.diff(h1[order]) == 0) & (np.diff(h2[order]) == 0)
        twice = np.zeros(len(row), bool)
        twice[order[1:]] |= equal
        twice[order[:-1]] |= equal
        row, place = row[twice], place[twice]
        new = np.ones(len(row), bool)
        new[1:] = (np.diff(row) != 0) | (np.diff(place) != 1)
        starts = np.flatnonzero(new)
        length = np.diff(np.append(starts, len(row)))
        out = group.iloc[row[starts]][["doc_id", "text_key", "first"]].reset_index(drop=True)
        out["first"] += place[starts].astype(np.int32)
        out["last"] = (out["first"] + length + window - 1).astype(np.int32)
        return out.assign(packed=None, size=np.int32(0), n=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            hot = batch["shares"].to_numpy() > 0
            if hot.any():
                yield from _equal_hot(batch[hot], window)
            batch = batch[~hot]
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(held):
                continue
            done = held["bucket"] != held["bucket"].iloc[-1]  # the last bucket may go on in the next batch
            if done.any():
                yield ranges(held[done])
                held = held[~done]
        if held is not None and len(held):
            yield ranges(held)

    return run


def _windows(window: int):
    """Every window of distinct super-k-mers, with how often the super-k-mer occurs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                group = batch.iloc[lo:lo + 500]
                row, place, h1, h2 = _unpacked(group, window)
                yield pd.DataFrame({"k1": group["k1"].to_numpy()[row], "k2": group["k2"].to_numpy()[row], "place": place.astype(np.int32),
                                    "h1": h1, "h2": h2, "n": group["n"].to_numpy()[row]})

    return run


def _hot_ranges(hot: DataFrame, window: int) -> DataFrame:
    """Ranges of repeated windows in the super-k-mers of hot minimisers that met no equal one.

    Equal super-k-mers are combined first, which leaves one of each however often a passage occurs; the windows of what
    is left are counted by their hashes.
    """
    keyed = hot.select("doc_id", "text_key", "first", "size", "n", "packed", F.xxhash64("packed").alias("k1"), F.xxhash64(F.lit(1), "packed").alias("k2"))
    kinds = keyed.groupBy("k1", "k2").agg(F.first("packed").alias("packed"), F.first("size").alias("size"), F.sum("n").alias("n"))
    windows = stored(kinds.mapInPandas(
        _windows(window), "k1 bigint, k2 bigint, place int, h1 bigint, h2 bigint, n bigint"), "passages-windows")
    often = windows.groupBy("h1", "h2").agg(F.sum("n").alias("times")).where("times > 1").select("h1", "h2")
    known = windows.join(often, ["h1", "h2"]).groupBy("k1", "k2").agg(F.max("n").alias("n"), F.collect_list("place").alias("places"))
    # A super-k-mer that has equals repeats as a whole. The ranges of those that met an equal one are known already.
    whole = F.array(F.struct("first", (F.col("first") + F.col("size") + window - 1).alias("last")))
    some = F.transform("places", lambda p: F.struct((F.col("first") + p).alias("first"), (F.col("first") + p + window).alias("last")))
    alone = keyed.where("n = 1").drop("packed", "n")
    return alone.join(known, ["k1", "k2"]).select("doc_id", "text_key", F.when(F.col("n") > 1, whole).otherwise(some).alias("found"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and touching ranges of a document as one."""
    for batch in batches:
        found = batch.column("found")
        row = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy())
        first, last = (x.to_numpy().astype(np.int64) for x in found.flatten().flatten())
        order = np.lexsort((first, row))
        # one line of words on which the documents lie behind each other, a word apart
        row, base = row[order], row[order] * (last.max(initial=0) + 2)
        first, last = first[order] + base, np.maximum.accumulate(last[order] + base)
        new = np.ones(len(row), bool)
        new[1:] = first[1:] > last[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(row))[:len(starts)] - 1
        spans_ = pa.StructArray.from_arrays(
            [(x - base[starts]).astype(np.int32) for x in (first[starts], last[ends])], ["first", "last"])
        offsets = np.searchsorted(row[starts], np.arange(len(found) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("key"), pa.ListArray.from_arrays(offsets, spans_)], ["id", "key", "cut"])


def repeated_ranges(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``id, key, cut``: word ranges [first, last) covered by windows that start more than once, per id and text hash."""
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    counts = base.select("text").mapInArrow(_minimisers(window, seed), "minimiser bigint, n bigint")
    # into how many shares a hot minimiser is dealt, 0 for others
    shares = F.when(F.col("n") > HOT, F.ceil(F.col("n") / SHARE)).otherwise(0).cast("long")
    shared = stored(counts.groupBy("minimiser").agg(F.sum("n").alias("n")).where("n > 1").select(
        "minimiser", shares.alias("shares")), "passages-minimisers")
    places = base.mapInArrow(_places(window, seed), "minimiser bigint, doc_id bigint, text_key bigint, first int, size int")
    runs = places.join(shared, "minimiser").groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("minimiser", "first", "size", "shares")).alias("runs"))
    runs = runs.withColumnsRenamed({"doc_id": "id", "text_key": "key"})
    listed = base.join(runs, F.expr("doc_id <=> id AND text_key = key")).select("doc_id", "text_key", "text", "runs")
    packed = listed.mapInArrow(
        _pack(window), "minimiser bigint, packed binary, shares bigint, first int, size int, doc_id bigint, text_key bigint")
    share = F.xxhash64("minimiser", F.pmod(F.xxhash64("doc_id", "text_key", "first"), F.greatest("shares", F.lit(1))))
    packed = packed.withColumn("bucket", F.when(F.col("shares") > 0, share).otherwise(F.col("minimiser")))
    found = stored(packed.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(
        _count(window), "doc_id bigint, text_key bigint, first int, last int, packed binary, size int, n bigint"), "passages-found")
    cold = found.where("packed IS NULL").select("doc_id", "text_key", F.struct("first", "last").alias("range"))
    hot = _hot_ranges(found.where("packed IS NOT NULL"), window).select("doc_id", "text_key", F.explode("found").alias("range"))
    # Rows that repeat an id and a text give the same ranges, which count once: no list outgrows its text.
    by_doc = cold.unionByName(hot).groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(
        F.collect_set("range").alias("found"))
    return by_doc.mapInArrow(_merged, "id bigint, key bigint, cut array<struct<first:int,last:int>>")


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` in a struct ``doc``, with ``n_words``, ``n_removed`` and ``kept`` (words joined by a space).

    A null or empty text has no words and an empty ``kept``. Rows that repeat an id and a text count as often as they
    occur, so their windows all start more than once. Texts shorter than a window lose nothing. An empty table gives no
    rows.
    """
    cut = stored(repeated_ranges(docs, window, seed), "passages-cut")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("t"))
    joined = rows.join(cut, F.expr("doc_id <=> id AND xxhash64(t) = key"), "left")

    def kept(w):
        inside = F.filter(w, lambda x, i: ~F.exists(F.col("cut"), lambda r: (i >= r["first"]) & (i < r["last"])))
        return F.struct(F.size(w).cast("long").alias("n"), F.array_join(F.when(F.col("cut").isNull(), w).otherwise(inside), " ").alias("kept"))

    removed = F.aggregate(F.coalesce("cut", F.array()), F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    return joined.select("doc", let(words_of(F.col("t")), kept).alias("w"), removed.alias("n_removed")).select(
        "doc", F.col("w.n").alias("n_words"), "n_removed", F.col("w.kept").alias("kept"))
