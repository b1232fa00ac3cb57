"""Scored events: line format, hour-partitioned files, history reads, staging export."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.functions import columns as c
from txnlens.functions.schema import (
    CATEGORICAL_FEATURES,
    FEATURE_VERSION,
    NUMERIC_FEATURES,
    SCORED_EVENT,
    TXN_COLUMNS,
)

DAY_US = 86_400_000_000
HOUR_FOLDER = re.compile(r"/dt=([^/]+)/hr=([^/]+)/")
FLAT_COLUMNS = [
    "event_id", "account_id", "event_ts_us", "scored_at_us", "fraud_score", "decision", "threshold",
    "had_prev_state", "model_name", "model_version", "transaction", "features",
]


def to_scored_events(
    rows: DataFrame,
    score: str = "score",
    scored_at: str = "event_ts_us",
    threshold: float = 0.5,
    model_name: str = "ledger-risk",
    model_version: str = "1",
) -> DataFrame:
    """Event rows from transactions that already carry their features and a score.

    ``rows`` holds the transaction columns, the feature columns and ``score``.
    """
    names = NUMERIC_FEATURES + CATEGORICAL_FEATURES
    made = rows.schema["f"]
    if made.dataType.names == names and not made.nullable:
        features = "f"  # taking it apart and naming each field anew costs more than all features do
    else:
        features = f"named_struct({', '.join(f"'{n}', f.{n}" for n in names)})"
    txn = ", ".join(f"'{n}', {n}" for n in TXN_COLUMNS)
    return rows.selectExpr(
        "event_id",
        "account_id",
        "event_ts_us",
        f"CAST({scored_at} AS BIGINT) AS scored_at_us",
        f"CAST({score} AS DOUBLE) AS fraud_score",
        f"CASE WHEN {score} >= {threshold}D THEN 'FRAUD' ELSE 'LEGIT' END AS decision",
        f"{threshold}D AS threshold",
        "f.txn_count_prior > 0 AS had_prev_state",
        f"'{model_name}' AS model_name",
        f"'{model_version}' AS model_version",
        f"{FEATURE_VERSION} AS feature_schema_version",
        f"named_struct({txn}) AS transaction",
        f"{features} AS features",
        "1 AS event_schema_version",
        "CAST(NULL AS STRING) AS trace_id",
    )


def to_lines(events: DataFrame) -> DataFrame:
    """One compact JSON document per event."""
    return events.selectExpr("to_json(struct(*)) AS value")


def parse_scored_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed events from text lines; malformed lines and lines without an id are skipped."""
    doc = F.from_json(F.col(column), SCORED_EVENT, {"mode": "PERMISSIVE"})
    # A generator, as a filter would move below a projection and parse each line a second time.
    return lines.select(F.inline(F.array(doc))).where("event_id IS NOT NULL")


def first_writes(events: DataFrame) -> DataFrame:
    """Of the events with one id, the one that was scored first."""
    cols = ", ".join(events.columns)
    first = F.expr(f"min_by(struct({cols}), struct(scored_at_us, fraud_score)) AS row")
    return events.groupBy("event_id").agg(first).select("row.*")


def with_hour_partition(df: DataFrame, ts_us: str = "scored_at_us") -> DataFrame:
    return df.selectExpr("*", f"{c.hour_dt(ts_us)} AS dt", f"{c.hour_hr(ts_us)} AS hr")


def write_scored_events(events: DataFrame, path: str) -> None:
    """Append events as JSON lines below ``dt=/hr=``.

    Rows are range-partitioned by time, so an hour is written by few tasks and a busy hour
    by several.  Files are gzipped, as lines mostly repeat the names of their fields; level three takes
    less than half the time of the default, six, for files that are a fifth larger.  Spark's
    commit protocol leaves ``_SUCCESS`` at the root; hours are closed one by one with ``close_hours``.
    """
    parted = with_hour_partition(events).repartitionByRange("dt", "hr", "scored_at_us", "event_id")
    packed = parted.write.mode("append").partitionBy("dt", "hr").option("compression", "gzip")
    packed.option("zlib.compress.level", "THREE").json(path)


def hour_folders(spark: SparkSession, path: str) -> dict[tuple[str, str], bool]:
    """Each hour folder ``(dt, hr)``, oldest first, and whether it carries its close marker.

    Folders are listed, not the files in them: one entry per hour of the data.
    """

    def listed(pattern: str) -> set[tuple[str, str]]:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}")
        found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
        return {HOUR_FOLDER.search(f"{status.getPath().toString()}/").groups() for status in found or []}

    closed = listed("dt=*/hr=*/_SUCCESS")
    return {hour: hour in closed for hour in sorted(listed("dt=*/hr=*"))}


def close_hours(spark: SparkSession, path: str, before: tuple[str, str] | None = None) -> int:
    """Mark finished hours with an empty ``_SUCCESS``: those before hour ``(dt, hr)``, or all.

    The writer calls this once nothing more will go to those hours.  Returns how many were marked now.
    """
    hours = hour_folders(spark, path)
    todo = [hour for hour, closed in hours.items() if not closed and (before is None or hour < before)]

    def close(hour: tuple[str, str]) -> None:
        marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/dt={hour[0]}/hr={hour[1]}/_SUCCESS")
        marker.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(marker)

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(close, todo))
    return len(todo)


def read_scored_events(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType(list(SCORED_EVENT.fields)).add("dt", "string").add("hr", "string")
    return spark.read.schema(schema).json(path)


def recent_events(spark: SparkSession, path: str, max_hours: int, max_rows: int) -> DataFrame:
    """The newest events: only the latest ``max_hours`` hour folders are opened.

    Hour folders are listed first, so pruning happens before any file is read.
    The row bound is the feature itself; it becomes a per-task top-k, not a full sort.
    """
    events = read_scored_events(spark, path)
    latest = list(hour_folders(spark, path))[-max_hours:] if max_hours > 0 else []
    return (
        events.where(" OR ".join(f"(dt = '{dt}' AND hr = '{hr}')" for dt, hr in latest) or "false")
        .orderBy(F.desc("scored_at_us"), F.desc("event_id"))
        .limit(max_rows)
    )


def events_frame(events: DataFrame) -> DataFrame:
    return events.select(*FLAT_COLUMNS)


def export_staging(silver: DataFrame, path: str) -> None:
    """Write the label-free transaction stream as JSON lines in source order.

    The write goes to a folder that did not exist before, so readers see all or nothing.
    """
    ordered = silver.repartitionByRange("bronze_row_num").sortWithinPartitions("bronze_row_num")
    ordered.select(*TXN_COLUMNS).write.mode("errorifexists").json(path)


def cached(spark: SparkSession, folder: str, key: str, fingerprint: str, build) -> DataFrame:
    """Build a frame once per (key, data fingerprint) and read the Parquet copy afterwards.

    A copy counts once its write has been committed; what a failed write left is written over.
    """
    path = f"{folder}/{key}-{fingerprint}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
