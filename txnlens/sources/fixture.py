"""Ledger derived from the generic ``events`` table (see FIXTURES.md for the rules)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txnlens.functions.columns import micros
from txnlens.functions.schema import SIM_EPOCH_US, US_PER_HOUR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ledger row per event; projections only, so filters reach the Parquet scan."""
    base = table(spark, sf_dir, "events").selectExpr(
        "event_id + 1 AS row_num",
        f"({micros('ts')} - {SIM_EPOCH_US}) div {US_PER_HOUR} + 1 AS step",
        "CASE event_type WHEN 'signup' THEN 'CASH_IN' WHEN 'view' THEN 'PAYMENT' WHEN 'click' THEN 'DEBIT' "
        "WHEN 'purchase' THEN 'CASH_OUT' WHEN 'error' THEN 'TRANSFER' END AS txn_type",
        "value AS amount",
        "user_id AS u",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
    )
    return base.selectExpr(
        "*",
        "CASE WHEN k % 7 = 0 THEN amount WHEN k % 5 = 0 THEN 0D ELSE round(amount + 10 * k, 2) END AS oldbalance_org",
        "CASE WHEN k % 3 = 0 THEN 0D ELSE 25.5D * (u % 11) END AS oldbalance_dest",
    ).selectExpr(
        "row_num",
        "step",
        "txn_type",
        "amount",
        "concat('C', u) AS account_id",
        "oldbalance_org",
        "round(greatest(oldbalance_org - amount, 0D), 2) AS newbalance_orig",
        "concat(CASE WHEN k < 25 THEN 'M' ELSE 'C' END, k) AS dest_id",
        "oldbalance_dest",
        "CASE WHEN k % 4 = 0 THEN oldbalance_dest ELSE round(oldbalance_dest + amount, 2) END AS newbalance_dest",
        "txn_type IN ('TRANSFER', 'CASH_OUT') AND (7 * k + 3 * u) % 29 = 0 AS is_fraud",
        "txn_type = 'TRANSFER' AND amount >= 200 AS is_flagged_fraud",
        "k",
        "u",
    )


def scored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows with an integer label ``y`` and two deterministic model scores."""
    points = ledger(spark, sf_dir).selectExpr(
        "*",
        "least(999L, (37 * k + 11 * u + 13 * (row_num - 1)) % 700 + 300 * CAST(is_fraud AS INT)) AS points",
    )
    return points.selectExpr(
        "*", "CAST(is_fraud AS INT) AS y", "points / 1000D AS score", "(points * 7 % 1000) / 1000D AS score_b"
    )


def prediction_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground-truth edits: the ``labels`` table read as (event, is_fraud)."""
    return table(spark, sf_dir, "labels").selectExpr(
        "concat('ps-', lpad(CAST(doc_id + 1 AS STRING), 10, '0')) AS event_id", "toxic = 1 AS is_fraud"
    )
