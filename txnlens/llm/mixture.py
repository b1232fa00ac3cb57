"""Mixing sources to target weights with hash-threshold histograms.

Sizes are summed by source and hash bucket; the running sum says in which bucket a source's budget runs out; only that
bucket is split again by the next bits of the hash, level by level, until the hash is used up. A document is then taken
or not by comparing its hash with its source's threshold: nothing is sorted, and the largest table that is ordered has
one row per source and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.llm.common import SPACES, let, text_of
from txnlens.sources.scratch import stored

BITS = 60  # of the hash
STEP = 12  # bits that a level looks at: at most 4096 buckets per source


def word_count(text: Column) -> Column:
    return let(F.split(text, SPACES), lambda w: F.size(w) - F.size(F.filter(w, lambda x: x == ""))).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, h``: words of the text (null: 0) and a hash of the id that reruns repeat."""
    return docs.select(
        docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"),
        word_count(text_of(docs)).alias("size"), id_hash(docs["doc_id"]).alias("h"),
    )


def id_hash(doc_id: Column) -> Column:
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150) -> DataFrame:
    """``source, source_size, target``: one row per source.

    Sources by code point, null last, weigh ``weights`` in turn. A target never exceeds twice its source's size; what
    that cuts off is shared again by weight among the others. Ordering sources by (twice the size) / weight gives the
    result in one pass: the first ones are at their limit, and the others share the rest. Works on one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    kinds = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("place", F.row_number().over(order) - 1)
    per = per.withColumn("w", F.get(kinds, F.col("place") % len(weights)).cast("long"))
    full = Window.orderBy(F.col("source_size") / F.col("w"), "place")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    here = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumns({
        "total": F.sum("source_size").over(everything), "rest_w": F.sum("w").over(here),
        "used": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
    })
    # The share per weight once the sources before this one are at their limits.
    per = per.withColumn("share", (F.lit(float(percent)) * F.col("total") / 100 - 2.0 * F.col("used")) / F.col("rest_w"))
    # The first source that the share does not fill decides; a source before it is full.
    first = F.min(F.when(2.0 * F.col("source_size") >= F.col("share") * F.col("w"), F.struct(
        (F.col("source_size") / F.col("w")).alias("r"), "place", "share"))).over(everything)
    per = per.withColumn("first", first)
    return per.select("source", "source_size", F.least(2.0 * F.col("source_size"), F.col("first.share") * F.col("w")).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """``source, source_size, target, copies, limit``: documents with ``h < limit`` are taken once more than ``copies``.

    The words under ``limit`` come as near to what is left of the target as whole documents (equal hashes together) can.
    """
    state = goals.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    state = state.withColumns({
        "need": F.col("target") - F.col("copies") * F.col("source_size"), "low": F.lit(0).cast("long"),
        "under": F.lit(0).cast("long"),
    })
    used = 0
    while used < BITS:
        used += STEP
        width = 1 << (BITS - used)  # of a bucket of this level
        rows = sizes.alias("d").join(state.alias("s"), F.expr("d.source <=> s.source")).where(
            F.expr(f"h >= low AND h < low + {width << STEP}"))
        hist = rows.groupBy("s.source", F.expr(f"(h - low) DIV {width}").alias("bucket")).agg(
            F.sum("size").alias("words"), F.first("need").alias("need"), F.first("under").alias("under"))
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.col("under") + F.sum("words").over(run))
        # The boundary bucket is the first that goes beyond the need; without one, all of this range is taken.
        found = hist.where("upto > need").groupBy("source").agg(
            F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "upto")).alias("b"))
        state = state.alias("s").join(found.alias("f"), F.expr("s.source <=> f.source"), "left").select(
            "s.source", "source_size", "target", "copies", "need",
            F.expr(f"CASE WHEN b IS NULL THEN low ELSE low + b.bucket * {width} END").alias("low"),
            F.expr("CASE WHEN b IS NULL THEN under ELSE b.before END").alias("under"), F.col("b.upto").alias("upto"),
        )
        state = stored(state, "mix-level")
        if used < BITS:
            state = state.drop("upto")
    # ``low`` is now the hash of the documents at the boundary: taking them or not, whichever is nearer.
    take = F.expr("CASE WHEN upto IS NULL THEN 0 WHEN upto - need < need - under THEN 1 ELSE 0 END")
    # A source that whole copies fill takes nothing more, wordless documents included.
    limit = F.when(F.col("target") <= F.col("copies") * F.col("source_size"), 0).otherwise(F.col("low") + take)
    return state.select("source", "source_size", "target", "copies", limit.alias("limit"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` for each row of ``docs``.

    A null text has size 0, a null source is a source of its own, a null id has one fixed hash. Rows that repeat an id
    share its hash: they are taken together or not at all. An empty table gives no rows; other columns are ignored.
    """
    sizes = stored(sized(docs), "mix-sizes")
    cut = thresholds(sizes, stored(targets(sizes, weights, percent), "mix-targets"))
    out = sizes.alias("d").join(cut.alias("s"), F.expr("d.source <=> s.source"))
    copies = F.col("copies") + F.when(F.col("h") < F.col("limit"), 1).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mix takes it."""
    sizes = stored(sized(docs), "mix-sizes")
    cut = thresholds(sizes, stored(targets(sizes, weights, percent), "mix-targets")).select(
        F.col("source").alias("of"), "copies", "limit")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    rows = rows.join(cut, F.expr("CAST(doc.source AS STRING) <=> of"))
    copies = F.col("copies") + F.when(id_hash(F.col("doc.doc_id")) < F.col("limit"), 1).otherwise(0)
    rows = rows.withColumn("copies", copies).where("copies > 0").select(
        "doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
