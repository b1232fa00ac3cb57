"""Document fingerprints: a quartile bucket digest, and a bounded difference between two digests.

Byte triplets are hashed to ``BUCKETS`` buckets and counted. A digest holds the length on a logarithmic scale, the ratios
of the quartiles of the counts, and for each bucket the quartile its count falls in (two bits).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.common import text_of
from txnlens.llm.textual import encoded, parts

BUCKETS = 256
# The triplets taken from five bytes in a row.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))
LENGTH_STEPS = 12  # per doubling
MOST = 255 + 2 * 15 + 6 * BUCKETS  # the greatest difference
_CODES = np.array([[(b >> s) & 3 for s in (6, 4, 2, 0)] for b in range(256)], np.int16)


def _counts(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), BUCKETS), np.int64)
    for lo, hi in parts(texts):
        data = np.frombuffer(b"".join(texts[lo:hi]), np.uint8).astype(np.uint32)
        doc = np.repeat(np.arange(hi - lo), [len(t) for t in texts[lo:hi]])
        for salt, (_, b, c) in enumerate(TRIPLETS):
            n = len(data) - c
            if n <= 0:
                continue
            inside = doc[:n] == doc[c:]
            x = (data[:n] | data[b:n + b] << np.uint32(8) | data[c:] << np.uint32(16) | np.uint32(salt << 24)) * np.uint32(0x9E3779B1)
            bucket = ((x ^ x >> np.uint32(15)) * np.uint32(0x85EBCA77)) >> np.uint32(24)
            out[lo:hi] += np.bincount((doc[:n] * BUCKETS + bucket)[inside], minlength=(hi - lo) * BUCKETS).reshape(-1, BUCKETS)
    return out


def digests(texts: list[bytes]) -> np.ndarray:
    """A digest per text: length, two quartile ratios, and the packed quartile of each bucket. Equal texts agree."""
    counts = _counts(texts)
    ranked = np.sort(counts, axis=1)
    q = ranked[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts[:, :, None] > q[:, None, :]).sum(axis=2, dtype=np.uint8)
    body = code[:, 0::4] << 6 | code[:, 1::4] << 4 | code[:, 2::4] << 2 | code[:, 3::4]
    top = np.maximum(q[:, 2], 1)
    size = np.array([len(t) for t in texts], float)
    length = np.minimum(np.round(LENGTH_STEPS * np.log2(size + 1)), 255)
    head = np.stack([length, 15 * q[:, 0] // top, 15 * q[:, 1] // top], axis=1)
    return np.concatenate([head, body], axis=1).astype(np.uint8)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between 0 and ``MOST`` for each pair of digests; opposite quartiles count double."""
    head = np.abs(a[:, :3].astype(np.int16) - b[:, :3]).sum(axis=1)
    apart = np.abs(_CODES[a[:, 3:]] - _CODES[b[:, 3:]])
    return head + np.where(apart == 3, 6, apart).sum(axis=(1, 2))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - difference(a, b) / MOST


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _fingerprint(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a bucket in order, its last row being the first of the next bucket; a row waits for the one after it."""
    held = None
    for batch in batches:
        rows = list(zip(batch["bucket"], batch["tail"], batch["doc_id"].astype("Int64"), batch["text"], strict=True))
        pairs = []
        for row in rows:
            if held is not None and held[0] == row[0]:
                pairs.append((held, row))
            held = None if row[1] else row
        for lo, hi in parts([p[0][3].encode() for p in pairs]):
            some = pairs[lo:hi]
            texts, after = [p[0][3] for p in some], [p[1][3] for p in some]
            edits = encoded([_edited(a, b) for a, b in zip(texts, after, strict=True)])
            own, other, changed = digests(encoded(texts)), digests(encoded(after)), digests(edits)
            yield pd.DataFrame({
                "doc_id": pd.array([p[0][2] for p in some], "Int64"), "n_chars": [len(t) for t in texts],
                "edited_sha256": [hashlib.sha256(t).hexdigest() for t in edits], "fingerprint": [d.tobytes().hex() for d in own],
                "edited_fingerprint": [d.tobytes().hex() for d in changed], "near_edited": likeness(own, changed),
                "near_next": likeness(own, other)})


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint beside those of an edit of it and of the next text.

    Next is by descending id (null ids last, equal ids by text), and after the last comes the first. A null text counts
    as empty. One row per row of ``docs``: repeated rows follow each other. Texts are moved once, to ranges of ids of
    equal depth; the first row of each range is also given to the range before it. Rows without an id are one range.
    """
    spark = docs.sparkSession
    base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = base.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 50 * ranges)).first()[0] or []
    splits = [float("-inf"), *sorted({float(c) for c in cuts}), float("inf")]
    if len(splits) < 3:
        splits.insert(1, 0.0)
    into = Bucketizer(splits=splits, inputCol="at", outputCol="bucket", handleInvalid="keep")  # NaN has a range of its own
    rows = into.transform(base.withColumn("at", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("nan"))))).drop("at")
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).collect()  # a row per range
    heads.sort(key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))
    before = {heads[i]["doc_id"]: heads[i - 1]["bucket"] for i in range(len(heads))}
    if not heads:
        return base.mapInPandas(lambda batches: iter(()), _SCHEMA)
    ids = [i for i in before if i is not None]
    first = base.where(F.col("doc_id").isin(ids) | (F.col("doc_id").isNull() if None in before else F.lit(False)))
    first = first.groupBy("doc_id").agg(F.min("text").alias("text"))
    keys = sorted(ids)
    to = F.array(*[F.lit(float(before[i])) for i in keys]) if keys else None
    place = F.array_position(F.array(*[F.lit(i) for i in keys]), F.col("doc_id")).cast("int") if keys else None
    home = F.lit(float(before[None])) if None in before else F.lit(None).cast("double")
    tails = first.select(F.when(F.col("doc_id").isNull(), home).otherwise(F.get(to, place - 1) if keys else home).alias("bucket"),
                         F.lit(1).alias("tail"), "doc_id", "text")
    every = rows.select("bucket", F.lit(0).alias("tail"), "doc_id", "text").unionByName(tails)
    every = every.repartition(ranges, "bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), "text")
    return every.mapInPandas(_fingerprint, _SCHEMA)


_SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
