"""Ranked lexical search over a length-stratified index.

A document's score for a term depends on its tf and on its normaliser m only, so documents of equal m form a stratum and
the index keeps, per stratum and term, the documents of each tf. A stratum of more than ``SLICE_WORDS`` terms is dealt
to several slices, so neither one common length nor a very common term makes a row or a task that grows with the corpus.

* **Index.** One pass counts terms per document (a histogram of lengths gives N, L and the slices of each m); a second
  deals the texts to their slices and writes one row per (slice, term): ``tfs``, the number of documents of each, and the
  documents as places in the slice, which follow doc_id. The whole vocabulary of every document is indexed.
* **Search.** The largest tf of a term in a slice bounds what the slice can add for it; the sum over an item's terms
  bounds every score in the slice. Each item first visits the slices with the greatest bounds, which gives a 10th best
  score; then only slices whose bound reaches that score are visited. A visit turns each tf of the slice into an impact
  once and adds weights times impacts in numpy. Slices and blocks of items meet, never documents and items.

Terms are compared by a 64-bit hash: of 10^10 forms and 10,000 terms asked for, two differ with one hash with
probability 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.llm.common import text_of
from txnlens.llm.textual import BASES, encoded, mix, parts, spans
from txnlens.sources.scratch import stored

SLICE_WORDS = 1 << 20  # terms of a stratum that one task indexes, unless a single document has more
FIRST_VISITS = 8  # slices that each item visits before its threshold is known
ITEM_BLOCK = 2048  # items that meet a slice in one task
INDEX = "m bigint, slice bigint, term bigint, max_tf int, tfs array<int>, counts array<int>, docs array<int>, ids array<bigint>"
FOUND = "item bigint, m bigint, slice bigint, place int, score bigint"
RESULT = "item_id bigint, rank int, doc_id bigint, score bigint"
NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what stands between terms
# What terms are made of: digits, letters and every byte of a character beyond ASCII.
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _edges(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, where each term starts and ends, and the number of each term's text."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    change = np.flatnonzero(np.diff(_TERM[buf], prepend=False))
    start, end = change[::2], change[1::2]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return buf, start, end, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, begins)))


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its text) of every term of the texts, in order."""
    hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in parts(texts):
        buf, start, end, doc = _edges(texts[lo:hi])
        values = _LOWER[buf].astype(np.uint64) + np.uint64(1)
        hashes.append(mix(spans(values, start, end, BASES[0]) + (end - start).astype(np.uint64), 31))
        docs.append(doc + lo)
    return np.concatenate(hashes), np.concatenate(docs)


def term_count(text: Column) -> Column:
    """Number of terms in a text, row by row: no batch of texts is held to size them."""
    return F.size(F.array_remove(F.split(text, NO_TERM), "")).cast("long")


def _lists(starts: np.ndarray, total: int, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, total), pa.int32()), pa.array(values, kind))


def _index_slice(key: tuple, rows: pa.Table) -> pa.Table:
    """The index rows of one slice; the row without a term holds the ids of its documents by place."""
    rows = rows.sort_by([("doc_id", "ascending")])  # nulls come last
    term, doc = term_hashes(encoded(rows["text"].to_pylist()))
    order = np.argsort(term, kind="stable")
    term, doc = term[order], doc[order]
    first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])))
    tf = np.diff(np.append(first, len(term)))
    term, doc = term[first], doc[first]
    number = np.cumsum(np.append(0, term[1:] != term[:-1]))
    order = np.lexsort((tf, number))
    tf, doc, number = tf[order], doc[order], number[order]
    group = np.flatnonzero(np.append(True, (tf[1:] != tf[:-1]) | (number[1:] != number[:-1])))
    of_term = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    n, in_groups = len(of_term), np.searchsorted(group, of_term)
    tfs, counts = tf[group], np.diff(np.append(group, len(tf)))
    out = {
        "term": pa.array(term[of_term].view(np.int64)), "max_tf": pa.array(tf[np.append(of_term[1:], len(tf)) - 1], pa.int32()),
        "tfs": _lists(in_groups, len(group), tfs, pa.int32()), "counts": _lists(in_groups, len(group), counts, pa.int32()),
        "docs": _lists(of_term, len(doc), doc, pa.int32()), "ids": pa.nulls(n, pa.list_(pa.int64())),
    }
    kinds = {k: v.type for k, v in out.items()}
    own = {k: pa.array([rows["doc_id"].to_pylist() if k == "ids" else None], t) for k, t in kinds.items()}
    whole = pa.concat_tables([pa.table(out), pa.table(own)])
    for k, name in enumerate(("m", "slice")):
        whole = whole.add_column(k, name, pa.array(np.full(n + 1, key[k].as_py()), pa.int64()))
    return whole


def build_index(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """The stored index of all documents, their number N and the number L of their terms.

    Documents without a term are not counted. Rows that repeat are documents of their own; a null id is kept and comes
    last among ties. Other columns are ignored. Without any term the index is empty and N and L are 0.
    """
    spark = docs.sparkSession
    sized = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    sized = sized.withColumn("n", term_count(F.col("text"))).where("n > 0")
    lengths = stored(sized.groupBy("n").agg(F.count("*").alias("docs")), "search-lengths")
    total = lengths.agg(F.sum("docs"), F.sum(F.col("n") * F.col("docs"))).first()
    if not total[0]:
        return spark.createDataFrame([], INDEX), 0, 0
    n_docs, n_all = int(total[0]), int(total[1])
    # A decimal product: 90 * n * N may pass 64 bits where its quotient does not.
    m = F.expr(f"100 - 90 + (CAST(90 * n AS DECIMAL(19,0)) * CAST({n_docs} AS DECIMAL(19,0))) div {n_all}")
    slices = lengths.groupBy(m.alias("m")).agg(F.ceil(F.sum(F.col("n") * F.col("docs")) / SLICE_WORDS).alias("slices"))
    # The partition's number spreads rows that repeat id and text; it is the same when a task runs again.
    dealt = sized.withColumns({"m": m, "h": F.xxhash64("doc_id", "text", F.spark_partition_id())})
    dealt = dealt.join(slices, "m").select("m", F.pmod("h", "slices").alias("slice"), "doc_id", "text")
    return stored(dealt.groupBy("m", "slice").applyInArrow(_index_slice, INDEX), "search-index"), n_docs, n_all


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        term, row = term_hashes(encoded(batch.column("text").to_pylist()))
        pairs = pd.DataFrame({"row": row, "term": term.view(np.int64)}).drop_duplicates()
        yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(pairs["row"])), pa.array(pairs["term"])], ["item", "term"])


def impact(tf: Column | np.ndarray, m: Column | int) -> Column | np.ndarray:
    """What one unit of weight adds for a term that occurs ``tf`` times in a document of normaliser ``m``."""
    if isinstance(tf, Column):
        return F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, F.lit(1000).cast("long") * tf + 8 * m)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and where each row's begin."""
    array = lists.combine_chunks()
    return array.flatten().to_numpy(), np.append(0, np.cumsum(array.value_lengths().to_numpy(zero_copy_only=False)))


def _visit(k: int):
    """The ``k`` best documents of a slice for each item that visits it, at least as good as the item's threshold."""

    def run(key: tuple, postings: pa.Table, visits: pa.Table) -> pa.Table:
        found = []
        if len(postings) and len(visits):
            m, slice_ = (key[i].as_py() for i in (0, 1))
            postings = postings.sort_by("term")
            known = postings["term"].to_numpy()
            docs, begin = _flat(postings["docs"])
            tfs, counts = (_flat(postings[c])[0].astype(np.int64) for c in ("tfs", "counts"))
            distinct, which = np.unique(tfs, return_inverse=True)
            impacts = np.repeat(impact(distinct, m)[which], counts)  # one division for each tf of the slice
            score = np.zeros(docs.max() + 1, np.int64)
            terms, first = _flat(visits["terms"])
            weights, _ = _flat(visits["weights"])
            at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
            here = known[at] == terms
            for row, (item, least) in enumerate(zip(visits["item"].to_pylist(), visits["least"].to_pylist(), strict=True)):
                score[:] = 0
                for t in np.flatnonzero(here[first[row]:first[row + 1]]) + first[row]:
                    own = slice(begin[at[t]], begin[at[t] + 1])
                    score[docs[own]] += weights[t] * impacts[own]
                good = np.flatnonzero(score >= max(least, 1))
                if len(good) > k:
                    good = good[score[good] >= np.partition(score[good], -k)[-k]]
                for place in good[np.argsort(-score[good], kind="stable")][:k]:
                    found.append((item, m, slice_, int(place), int(score[place])))
        columns = list(zip(*found, strict=True)) if found else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["item", "m", "slice", "place", "score"])

    return run


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of ``index`` for each item, none with a score of 0.

    Equal scores go by ascending doc_id. Items are told apart by id and text, and rows that repeat both are one item; an
    item without a term, or whose terms are in no document, gives no rows.
    """
    if not n_docs:
        return items.sparkSession.createDataFrame([], RESULT)
    asked = items.select(items["item_id"].cast("long").alias("item_id"), text_of(items).alias("text")).distinct()
    asked = stored(asked.withColumn("item", F.xxhash64("item_id", "text")), "search-items")
    blocks = -(-max(asked.count(), 1) // ITEM_BLOCK)
    wanted = stored(asked.select("item", "text").mapInArrow(_item_terms, "item bigint, term bigint"), "search-wanted")
    postings = stored(index.where("term IS NOT NULL").drop("ids").join(wanted.select("term").distinct(), "term"), "search-postings")

    df = postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    w = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighted = stored(wanted.join(df.select("term", w.alias("w")).where("w > 0"), "term"), "search-weights")
    lists = weighted.groupBy("item").agg(F.collect_list(F.struct("term", "w")).alias("q")).select(
        "item", F.col("q.term").alias("terms"), F.col("q.w").alias("weights"))

    most = postings.select("m", "slice", "term", "max_tf").join(weighted, "term").groupBy("m", "slice", "item").agg(
        F.sum(F.col("w") * impact(F.col("max_tf"), F.col("m"))).alias("bound"))
    bounds = stored(most, "search-bounds")
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block")
    keys = ["m", "slice", "block"]

    def visit(visits: DataFrame) -> DataFrame:
        """``visits`` has m, slice, item, least."""
        there = postings.join(visits.select("m", "slice", block).distinct(), ["m", "slice"])
        asking = visits.join(lists, "item").select("m", "slice", block, "item", "least", "terms", "weights")
        met = there.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(_visit(k), FOUND)
        return stored(met, "search-found")

    best_first = Window.partitionBy("item").orderBy(F.desc("bound"), "m", "slice")
    first = stored(bounds.withColumn("turn", F.row_number().over(best_first)).where(F.col("turn") <= FIRST_VISITS), "search-first")
    found = visit(first.select("m", "slice", "item", F.lit(1).cast("long").alias("least")))
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), "m", "slice", "place")
    least = found.withColumn("r", F.row_number().over(by_score)).where(f"r <= {k}").groupBy("item").agg(
        F.count("*").alias("n"), F.min("score").alias("s")).where(f"n = {k}").select("item", F.col("s").alias("least"))
    rest = bounds.join(first.select("m", "slice", "item"), ["m", "slice", "item"], "left_anti").join(least, "item", "left")
    rest = rest.withColumn("least", F.coalesce("least", F.lit(1).cast("long"))).where("bound >= least")
    found = found.unionByName(visit(rest.select("m", "slice", "item", "least")))

    # Only what can be among the k best meets the ids; places follow ids inside a slice, ties across slices need them.
    top = found.withColumn("r", F.rank().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(f"r <= {k}")
    ids = index.where("term IS NULL").select("m", "slice", F.posexplode("ids").alias("place", "doc_id"))
    named = top.join(ids, ["m", "slice", "place"]).select("item", "doc_id", "score")
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    named = named.withColumn("rank", F.row_number().over(ranked).cast("int")).where(f"rank <= {k}")
    return named.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def search_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``search`` over a new index of ``docs``."""
    index, n_docs, _ = build_index(docs)
    return search(index, n_docs, items, k)
