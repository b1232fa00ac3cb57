"""Which batches of a table may hold an id: a Bloom filter for each batch and bucket of id hashes.

Ids are dealt to buckets by their hash, and a batch keeps one filter per bucket with ``BITS`` bits for each of its ids, so
a filter's size follows its batch and an id that a batch does not hold passes with probability 1.3e-6. Probing meets each
bucket's new ids with that bucket's filters, one filter at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
BITS = 32
PROBES = 11
PIECE = 10_000  # ids that are probed at once
FILTER = "bucket int, bits binary"


def _hashed(ids: DataFrame) -> DataFrame:
    h = ids.select(F.xxhash64("event_id").alias("h1"), F.xxhash64("event_id", F.lit("second")).alias("h2"))
    return h.withColumn("bucket", F.pmod("h1", F.lit(BUCKETS)).cast("int"))


def _places(h1: np.ndarray, h2: np.ndarray, size: int) -> np.ndarray:
    """The bits of each id in a filter of ``size`` bits."""
    h1, h2 = (np.asarray(h).astype(np.int64).view(np.uint64) for h in (h1, h2))
    return (h1[:, None] + np.arange(PROBES, dtype=np.uint64) * (h2 | np.uint64(1))[:, None]) % np.uint64(size)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(BITS * -(-len(rows) // 8) * 8, bool)
    bits[_places(rows["h1"], rows["h2"], len(bits)).ravel()] = True
    return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "bits": [np.packbits(bits).tobytes()]})


def _holds_any(bits: bytes, h1: np.ndarray, h2: np.ndarray) -> bool:
    held = np.frombuffer(bits, np.uint8)
    for at in range(0, len(h1), PIECE):
        places = _places(h1[at:at + PIECE], h2[at:at + PIECE], 8 * len(held))
        # as ``np.packbits`` lays them out, the highest bit of a byte first
        if (held[places >> np.uint64(3)] >> (np.uint64(7) - places & np.uint64(7)).astype(np.uint8) & 1).all(axis=1).any():
            return True
    return False


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        hits, ids = set(), rows.column("ids")
        ends, h1, h2 = (np.asarray(x) for x in (ids.offsets, ids.values.field("h1"), ids.values.field("h2")))
        for k, (batch_id, bits) in enumerate(zip(rows.column("batch_id").to_pylist(), rows.column("bits"), strict=True)):
            one = slice(ends[k], ends[k + 1])
            if batch_id not in hits and _holds_any(bits.as_buffer(), h1[one], h2[one]):
                hits.add(batch_id)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(hits), pa.int64())], ["batch_id"])


def filters_of(ids: DataFrame) -> DataFrame:
    """The filters of one batch, from its ``event_id``."""
    return _hashed(ids.where("event_id IS NOT NULL")).groupBy("bucket").applyInPandas(_build, FILTER)


def suspects(ids: DataFrame, filters: DataFrame) -> set[int]:
    """Numbers of the batches that may hold any of ``ids``; ``filters`` has ``batch_id, bucket, bits``."""
    asked = _hashed(ids).groupBy("bucket").agg(F.collect_set(F.struct("h1", "h2")).alias("ids"))
    met = filters.join(asked, "bucket").select("batch_id", "bits", "ids")
    return {r["batch_id"] for r in met.mapInArrow(_probe, "batch_id long").distinct().collect()}
