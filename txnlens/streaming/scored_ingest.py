"""Incremental load of scored-event files: each event id lands once, first write wins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from txnlens.sources.events import first_writes, parse_scored_events
from txnlens.sources.grown_files import grown_lines
from txnlens.sources.id_filters import filters_of, suspects
from txnlens.sources.scratch import stored


def _numbers(spark: SparkSession, pattern: str) -> set[int]:
    """The numbers in the last path part before any marker of what matches the pattern."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return {int(re.search(r"(\d+)(/_SUCCESS)?$", f.getPath().toString()).group(1)) for f in found or []}


def _committed(spark: SparkSession, folder: str) -> set[int]:
    return _numbers(spark, f"{folder}/batch_id=*/_SUCCESS")


def batches_to_open(spark: SparkSession, out: str, fresh: DataFrame, batch_id: int) -> list[int]:
    """Batches before ``batch_id`` whose id filters do not exclude the ids of ``fresh``, and those without a filter."""
    earlier = {n for n in _committed(spark, out) if n < batch_id}
    filtered = earlier & _committed(spark, f"{out}_ids")
    if not filtered:
        return sorted(earlier)
    folders = [f"{out}_ids/batch_id={n}" for n in sorted(filtered)]
    filters = spark.read.option("basePath", f"{out}_ids").schema("bucket int, bits binary, batch_id long").parquet(*folders)
    return sorted((earlier - filtered) | suspects(fresh.select("event_id"), filters))


def _load_batch(out: str):
    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = first_writes(parse_scored_events(batch))
        # The folder of this batch is left out, so a replay writes the same rows again.
        if any(n < batch_id for n in _committed(spark, out)):
            fresh = stored(fresh, "fresh-events")
            opened = batches_to_open(spark, out, fresh, batch_id)
            if opened:
                known = spark.read.schema("event_id string").parquet(*[f"{out}/batch_id={n}" for n in opened])
                fresh = fresh.join(known, "event_id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        written = spark.read.schema("event_id string").parquet(f"{out}/batch_id={batch_id}")
        filters_of(written).write.mode("overwrite").parquet(f"{out}_ids/batch_id={batch_id}")

    return load


def stream_scored_events(
    spark: SparkSession, source: str, checkpoint: str, out: str, max_files: int | None = None
):
    """Read new ``dt=*/hr=*`` files since the last run, then stop.

    The file source's checkpoint remembers file names: a file must be whole when it appears and
    must not change later.  For files that grow use ``ingest_scored_events``.
    """
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.schema("value string, dt string, hr string").text(source).select("value")
    return (
        lines.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(_load_batch(out))
        .start()
    )


def ingest_scored_events(spark: SparkSession, source: str, out: str) -> int:
    """Load what is new below ``source`` into ``out/batch_id=N``; returns the number of lines read.

    Files may grow: a load reads the bytes appended since the last one, by the offsets that the stream keeps in
    ``out_progress``, up to the last complete line. An event id lands once, the first write wins; of the batches before
    only those are opened whose id filters (``out_ids``) do not exclude the new ids. A load that fails is repeated with
    the same lines and writes the same rows. One load at a time.
    """
    progress = f"{out}_progress"
    # A run that finds a batch that failed repeats that one alone.
    failed = _numbers(spark, f"{progress}/offsets/[0-9]*") - _numbers(spark, f"{progress}/commits/[0-9]*")
    lines = 0
    for _ in range(2 if failed else 1):
        query = (
            grown_lines(spark, source).writeStream.option("checkpointLocation", progress)
            .trigger(availableNow=True).foreachBatch(_load_batch(out)).start()
        )
        query.awaitTermination()
        lines += sum(p.numInputRows for p in query.recentProgress)
    return lines
