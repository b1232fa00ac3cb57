"""MinHash near-dedup by an inverted join over signature coordinates.

Documents with equal shingle sets form one class; everything after works on one document per class. Every coordinate of
a class's MinHash signature is a posting key (coordinate, value). Two classes that agree on at least ``MATCHES`` of the
``COORDINATES`` share a key among the rarest ``COORDINATES - MATCHES + 1`` keys of each (prefix), so the frequent keys,
those of boilerplate, are skipped. Candidates are confirmed on their full sets.

A posting list of n classes is not expanded into n^2 pairs: first every member is compared with the most typical member
of the list, which joins up groups of near copies; then only clusters of lists that still hold several components are
compared block by block, signatures first and full sets after, inside a task, and only confirmed links between
components leave it; the members of a cluster's largest component do not meet each other. Pairs inside one component cannot change the result and are not compared.

A pair with similarity 0.85 agrees on fewer than 36 of 64 coordinates with probability 8e-9; all other steps are exact
on 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.common import text_of
from txnlens.llm.components import components
from txnlens.llm.textual import BASES, Words, encoded, mix, parts, spans
from txnlens.sources.scratch import stored

SHINGLE = 5
COORDINATES = 64
MATCHES = 36
ROWS = "doc_id bigint, text_key bigint, n_shingles bigint, k1 bigint, k2 bigint, signature array<bigint>"
BLOCK = 512  # members of a cluster that one task holds on either side
_SALTS = (mix(np.arange(COORDINATES, dtype=np.uint64), 7) | np.uint64(1), mix(np.arange(COORDINATES, dtype=np.uint64), 8))


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, lower-cased A-Z; short texts are one shingle, empty ones none."""
    for lo, hi in parts(texts):
        w = Words(texts[lo:hi], lower=True)
        at, h = w.grams(size)
        cut = np.searchsorted(w.doc[at], np.arange(w.n + 1)) if len(at) else np.zeros(w.n + 1, int)
        short = np.flatnonzero((w.counts > 0) & (w.counts < size))
        whole = dict(zip(short.tolist(), mix(spans(w.hash, w.first[short], w.first[short + 1], BASES[1]), 2), strict=True))
        for d in range(w.n):
            yield np.array([whole[d]], np.uint64) if d in whole else np.unique(h[cut[d]:cut[d + 1]])


def signature(shingles: np.ndarray) -> np.ndarray:
    """For each coordinate the least value of its hash function over the set."""
    best = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(best, (shingles[at:at + 2048, None] * _SALTS[0] + _SALTS[1]).min(axis=0), out=best)
    return best


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for s in shingle_sets(encoded(batch["text"])):
            key = [int(x) for x in (mix(s, 11).sum(dtype=np.uint64), mix(s, 12).sum(dtype=np.uint64))]
            rows.append((len(s), *np.array(key, np.uint64).view(np.int64), signature(s).view(np.int64) if len(s) else None))
        out = pd.DataFrame(rows, columns=["n_shingles", "k1", "k2", "signature"])
        yield pd.concat([batch[["doc_id", "text_key"]].reset_index(drop=True), out], axis=1)


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"node": batch["node"], "shingles": [s.view(np.int64) for s in shingle_sets(encoded(batch["text"]))]})


def _postings(classes: DataFrame) -> DataFrame:
    """``token, node, typical``: the rarest keys of each class, without keys that no other class has."""
    keys = classes.select("node", F.posexplode("signature").alias("k", "value")).select(
        F.xxhash64("k", "value").alias("token"), "node")
    shared = keys.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    mine = keys.join(shared, "token").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("n", "token"))).alias("keys"), F.sum("n").alias("typical"))
    prefix = COORDINATES - MATCHES + 1
    take = F.greatest(F.lit(0), F.lit(prefix - COORDINATES) + F.size("keys"))  # keys of its own come first and find nobody
    return mine.select("node", "typical", F.explode(F.slice("keys", F.lit(1), take)).alias("key")).select(
        "key.token", "node", "typical")


def _matches(a, b):
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _shingles_of(nodes: DataFrame, documents: DataFrame, classes: DataFrame) -> DataFrame:
    """``node, shingles``: the full set of each listed class, from the text of one of its documents."""
    owner = classes.join(nodes, "node").select("node", F.col("doc_id").alias("owner"), F.col("text_key").alias("key"))
    texts = documents.join(owner, F.expr("doc_id <=> owner AND text_key = key")).dropDuplicates(["node"])
    return stored(texts.select("node", "text").mapInPandas(_sets, "node bigint, shingles array<bigint>"), "dedup-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u < v`` whose full shingle sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u").join(
        sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v")
    both = both.select("u", "v", F.size(F.array_intersect("su", "sv")).alias("shared"), (F.size("su") + F.size("sv")).alias("sizes"))
    return stored(both.where(100 * F.col("shared") >= percent * (F.col("sizes") - F.col("shared"))).select("u", "v"), "dedup-links")


def _first_pairs(postings: DataFrame) -> DataFrame:
    """Each member of a list with the list's most typical member."""
    centre = postings.groupBy("token").agg(F.max(F.struct("typical", "node")).alias("c"), F.count("*").alias("n"))
    joined = postings.join(centre.where("n > 1").select("token", F.col("c.node").alias("centre")), "token")
    return joined.where("node <> centre").select(
        F.least("node", "centre").alias("u"), F.greatest("node", "centre").alias("v")).distinct()


def _compare(percent: int):
    """Confirmed links between different parts among the members of one or two blocks."""

    def run(members: pd.DataFrame) -> pd.DataFrame:
        i, j = members["i"].iloc[0], members["j"].iloc[0]
        left, right = members[members["block"] == i], members[members["block"] == j]
        sets = [[np.asarray(x) for x in side["shingles"]] for side in (left, right)]
        nodes, parts_ = ([side[c].to_numpy() for side in (left, right)] for c in ("node", "part"))
        signatures = np.stack(right["signature"].to_list()) if len(right) else np.zeros((0, COORDINATES))
        size = np.array([len(x) for x in sets[1]])
        links = []
        for a, (node, part, signed) in enumerate(zip(nodes[0], parts_[0], left["signature"], strict=True)):
            other = parts_[1] != part
            if i == j:
                other[:a + 1] = False
            n = len(sets[0][a])
            other &= 100 * np.minimum(size, n) >= percent * np.maximum(size, n)
            near = np.flatnonzero(other)
            near = near[(signatures[near] == np.asarray(signed)).sum(axis=1) >= MATCHES] if len(near) else near
            for b in near:
                shared = len(np.intersect1d(sets[0][a], sets[1][b], assume_unique=True))
                if 100 * shared >= percent * (n + size[b] - shared):
                    links.append(sorted((int(node), int(nodes[1][b]))))
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return run


def _other_links(stars: DataFrame, parts_: DataFrame, signed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links between the parts of a cluster, where a cluster is what shares posting lists directly or in turn.

    The members of a cluster are dealt to blocks of about ``BLOCK``: those of its largest part to some (counted from -1
    down), all others to further ones (from 0 up). Every two blocks meet in one task of bounded size, but for two of the
    largest part; only confirmed links leave it. Of n members, m of them outside the largest part, that is about
    (2 n m - m m) / BLOCK rows.
    """
    nodes = components(stars).withColumnRenamed("component", "cluster").join(parts_, "node", "left").select(
        "cluster", "node", F.coalesce("component", "node").alias("part"))
    nodes = stored(nodes, "dedup-clusters")
    mixed = nodes.groupBy("cluster", "part").agg(F.count("*").alias("size")).groupBy("cluster").agg(
        F.max(F.struct("size", "part")).alias("largest"), F.sum("size").alias("n"), F.count("*").alias("parts"))
    # Of a cluster of two, the only pair was compared.
    blocks = [F.ceil(n / BLOCK).cast("int") for n in (F.col("largest.size"), F.col("n") - F.col("largest.size"))]
    mixed = mixed.where("parts > 1 AND n > 2").select(
        "cluster", F.col("largest.part").alias("largest"), blocks[0].alias("lower"), blocks[1].alias("upper"))
    inside, dealt = F.col("part") == F.col("largest"), F.xxhash64("node")
    block = F.when(inside, -1 - F.pmod(dealt, F.col("lower"))).otherwise(F.pmod(dealt, F.col("upper"))).cast("int")
    rows = nodes.join(mixed, "cluster").withColumn("block", block)
    first = F.when(inside, 0).otherwise(-F.col("lower"))
    rows = rows.join(signed, "node").join(sets, "node").withColumn("k", F.explode(F.sequence(first, F.col("upper") - 1)))
    rows = rows.select("cluster", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "node", "part", "signature", "shingles")
    return stored(rows.groupBy("cluster", "i", "j").applyInPandas(_compare(percent), "u bigint, v bigint"), "dedup-more")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_key`` for each row of ``docs``.

    A null or empty text has no shingles and is linked with nothing: its component is its own id. ``component_id`` is
    the least id that is not null; a component in which every id is null has a null id, and its rows are kept. Rows
    that repeat an id and a text share a class and each give a row. An empty table gives no rows; other columns are
    ignored. ``text_key`` is a hash of the text.
    """
    documents = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("text_key"), "text")
    rows = stored(documents.mapInPandas(_described, ROWS), "dedup-rows")
    full = rows.where("n_shingles > 0")
    classes = full.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("least"), F.first(F.struct("doc_id", "text_key", "signature")).alias("one"))
    # A class is named by a hash of its set; the ids it stands for are kept beside it.
    classes = stored(classes.select(
        F.xxhash64("k1", "k2", "least").alias("node"), "k1", "k2", "least", F.col("one.doc_id").alias("doc_id"),
        F.col("one.text_key").alias("text_key"), F.col("one.signature").alias("signature")), "dedup-classes")
    postings = stored(_postings(classes), "dedup-postings")
    signed = classes.select("node", "signature")

    pairs = stored(_first_pairs(postings), "dedup-stars")
    likely = pairs.join(signed.select(F.col("node").alias("u"), F.col("signature").alias("a")), "u").join(
        signed.select(F.col("node").alias("v"), F.col("signature").alias("b")), "v").where(_matches(F.col("a"), F.col("b")) >= MATCHES)
    sets = _shingles_of(postings.select("node").distinct(), documents, classes)
    links = _confirmed(likely.select("u", "v"), sets, percent)
    parts_ = components(links)

    more = _other_links(pairs, parts_, signed, sets, percent)
    parts_ = components(links.unionByName(more))

    named = classes.join(parts_, "node", "left").select("k1", "k2", "least", F.coalesce("component", "node").alias("part"))
    ids = named.groupBy("part").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "part").select("k1", "k2", F.col("component_id"), F.lit(True).alias("known"))
    out = rows.select("doc_id", "text_key", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key")
