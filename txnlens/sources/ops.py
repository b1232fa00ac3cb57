"""Small operational tables: labels, job runs, model deployments."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = "run_id string, layer string, started_at double, finished_at double, status string, rows_in long, rows_out long, detail string"


def apply_label_edits(labels: DataFrame, edits: DataFrame, order: str | None = None) -> DataFrame:
    """Set or clear ground truth: an edit with a NULL label removes the row.

    Of several edits of one event the last by ``order`` counts; without an order, or at the same
    place in it, setting goes before clearing and fraud before not.
    """
    last = ([F.col(order)] if order else []) + [F.col("is_fraud").isNotNull(), F.col("is_fraud")]
    edits = edits.groupBy("event_id").agg(F.max_by(F.struct(*edits.columns), F.struct(*last)).alias("e")).select("e.*")
    kept = labels.join(edits, "event_id", "left_anti")
    return kept.unionByName(edits.where("is_fraud IS NOT NULL").select(*labels.columns))


def parse_label_csv(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Free-form booleans to labels; ids absent from the loaded history are marked."""
    parsed = rows.selectExpr(
        "event_id", "lower(trim(is_fraud)) IN ('true', '1', 'yes', 'fraud') AS is_fraud"
    )
    seen = known.select("event_id").distinct().selectExpr("event_id", "true AS known")
    return parsed.join(seen, "event_id", "left").selectExpr(
        "event_id", "is_fraud", "coalesce(known, false) AS known"
    )


def write_counted(df: DataFrame, path: str) -> int:
    """Write a table and count its rows in the same pass."""
    seen = Observation("written")
    df.observe(seen, F.expr("count(1) AS n")).write.mode("overwrite").parquet(path)
    return seen.get["n"]


def move_counted(source: DataFrame, path: str, transform: Callable[[DataFrame], DataFrame], run: dict) -> None:
    """Write ``transform(source)`` and note in ``run`` the rows that went in and came out, counted in the same pass.

    A source that the transform reads several times is counted each time.
    """
    taken = Observation("taken")
    run["rows_out"] = write_counted(transform(source.observe(taken, F.expr("count(1) AS n"))), path)
    run["rows_in"] = taken.get["n"]


@contextmanager
def track_run(spark: SparkSession, table: str, layer: str):
    """Append one audit row per job run; a failure is recorded and raised again."""
    run = {"rows_in": None, "rows_out": None, "detail": ""}
    started = time.time()
    status = "success"
    try:
        yield run
    except Exception as error:
        status, run["detail"] = "failed", f"{type(error).__name__}: {error}"
        raise
    finally:
        row = (f"{layer}-{started:.6f}", layer, started, time.time(), status, run["rows_in"], run["rows_out"], run["detail"])
        spark.createDataFrame([row], RUN_SCHEMA).write.mode("append").parquet(table)


def latest_deployment(deployments: DataFrame, now_us: int, max_age_us: int) -> DataFrame:
    """Newest version per model, whether everybody resolved the same one, and its age."""
    return deployments.groupBy("model_name").agg(
        F.expr("max_by(version, struct(resolved_at_us, version)) AS version"),
        F.expr("max(resolved_at_us) AS resolved_at_us"),
        F.expr("count(DISTINCT version) AS versions_seen"),
        F.expr(f"max(resolved_at_us) >= {now_us - max_age_us} AS is_fresh"),
    )
