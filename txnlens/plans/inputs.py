"""Frames the queries start from, and the same frames as DuckDB text for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txnlens.functions.columns import r6
from txnlens.functions.schema import TXN_COLUMNS
from txnlens.operators.account import account_features, with_features
from txnlens.operators.medallion import event_id, to_silver, with_event_ts
from txnlens.sources import fixture
from txnlens.sources.scratch import stored


def ledger(spark: SparkSession, d: str) -> DataFrame:
    return fixture.ledger(spark, d).drop("k", "u")


def silver(spark: SparkSession, d: str) -> DataFrame:
    return to_silver(ledger(spark, d))


def silver_table(spark: SparkSession, d: str) -> DataFrame:
    """Silver written as a table: the feature fold reads its input several times."""
    return stored(silver(spark, d), "silver")


def gold(spark: SparkSession, d: str) -> DataFrame:
    return account_features(silver_table(spark, d))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return fixture.scored_ledger(spark, d)


def scored_silver(spark: SparkSession, d: str) -> DataFrame:
    return with_event_ts(scored(spark, d)).selectExpr(f"{event_id()} AS event_id", "*")


def scored_silver_table(spark: SparkSession, d: str) -> DataFrame:
    return stored(scored_silver(spark, d), "scored")


def scored_with_features(spark: SparkSession, d: str) -> DataFrame:
    """Transactions with their score and a struct ``f`` of the features seen at scoring."""
    rows = scored_silver_table(spark, d)
    return with_features(rows, [*TXN_COLUMNS, "score", "y"], score="score")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.selectExpr(*[f"{r6(n)} AS {n}" if n in names else n for n in df.columns])


# --- DuckDB text -------------------------------------------------------------
LEDGER = """base AS (
  SELECT event_id, user_id AS u, value AS a, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
    CAST((epoch_us(ts) - 1704067200000000) // 3600000000 + 1 AS BIGINT) AS step, event_type
  FROM events),
ledger AS (
  SELECT event_id + 1 AS row_num, step, txn_type, a AS amount, 'C' || u AS account_id, oldbalance_org,
    round(greatest(oldbalance_org - a, 0.0), 2) AS newbalance_orig,
    (CASE WHEN k < 25 THEN 'M' ELSE 'C' END) || k AS dest_id, oldbalance_dest,
    CASE WHEN k % 4 = 0 THEN oldbalance_dest ELSE round(oldbalance_dest + a, 2) END AS newbalance_dest,
    (txn_type IN ('TRANSFER', 'CASH_OUT') AND (7 * k + 3 * u) % 29 = 0) AS is_fraud,
    (txn_type = 'TRANSFER' AND a >= 200) AS is_flagged_fraud, k, u
  FROM (SELECT *,
      CASE event_type WHEN 'signup' THEN 'CASH_IN' WHEN 'view' THEN 'PAYMENT' WHEN 'click' THEN 'DEBIT'
        WHEN 'purchase' THEN 'CASH_OUT' WHEN 'error' THEN 'TRANSFER' END AS txn_type,
      CASE WHEN k % 7 = 0 THEN a WHEN k % 5 = 0 THEN 0.0 ELSE round(a + 10 * k, 2) END::DOUBLE AS oldbalance_org,
      CASE WHEN k % 3 = 0 THEN 0.0 ELSE 25.5 * (u % 11) END::DOUBLE AS oldbalance_dest FROM base))"""

SCORED = LEDGER + """,
scored AS (
  SELECT *, pts / 1000.0::DOUBLE AS score, (pts * 7 % 1000) / 1000.0::DOUBLE AS score_b FROM (
    SELECT *, CAST(is_fraud AS INTEGER) AS y,
      least(999, (37 * k + 11 * u + 13 * (row_num - 1)) % 700 + 300 * CAST(is_fraud AS INTEGER)) AS pts
    FROM ledger))"""

_TS = """(
  SELECT *, 'ps-' || lpad(CAST(row_num AS VARCHAR), 10, '0') AS event_id, row_num AS bronze_row_num,
    CAST(1704067200000000 + (step - 1) * 3600000000
      + ((row_number() OVER (PARTITION BY step ORDER BY row_num) - 1) * 3600000000)
        // count(*) OVER (PARTITION BY step) AS BIGINT) AS event_ts_us
  FROM {src})"""
SILVER = LEDGER + ",\nsilver AS " + _TS.format(src="ledger")
SCORED_SILVER = SCORED + ",\nsilver AS " + _TS.format(src="scored")

_PRIOR = """,
prior AS (
  SELECT *, row_number() OVER w - 1 AS n,
    lag(event_ts_us) OVER w AS p_ts, lag(step) OVER w AS p_step, lag(txn_type) OVER w AS p_type,
    lag(amount) OVER w AS p_amount, lag(newbalance_orig) OVER w AS p_new, lag(dest_id) OVER w AS p_dest,
    {score} AS p_score,
    CAST(sum(CAST(amount AS DECIMAL(18,2))) OVER b AS DOUBLE) AS sum_a,
    CAST(sum(CAST(amount AS DECIMAL(18,2)) * CAST(amount AS DECIMAL(18,2))) OVER b AS DOUBLE) AS sum_sq,
    max(amount) OVER b AS max_a, min(event_ts_us) OVER b AS first_ts
  FROM silver
  WINDOW w AS (PARTITION BY account_id ORDER BY event_ts_us, event_id),
    b AS (PARTITION BY account_id ORDER BY event_ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_FEATURES = """,
{to}2 AS (
  SELECT *, (event_ts_us - p_ts) / 1000000.0::DOUBLE AS gap_s, (event_ts_us - first_ts) / 3600000000.0::DOUBLE AS age_h,
    CASE WHEN n > 0 THEN sum_a / n END AS mean_a, oldbalance_org - p_new AS gap_b FROM {to}),
{gold} AS (
  SELECT event_id, account_id, event_ts_us, 1 AS feature_schema_version,
    (n = 0)::INT::DOUBLE AS is_first_txn,
    gap_s AS seconds_since_last_txn,
    CASE WHEN gap_s >= 0 THEN ln(1 + gap_s) END AS log1p_seconds_since_last,
    (step - p_step)::DOUBLE AS steps_since_last_txn,
    amount, ln(1 + amount) AS log1p_amount,
    amount - p_amount AS amount_delta_vs_last,
    CASE WHEN abs(p_amount) >= 1e-9 THEN amount / p_amount END AS amount_ratio_vs_last,
    CASE WHEN n > 0 THEN amount / greatest(gap_s, 1.0) END AS amount_velocity,
    CASE WHEN abs(mean_a) >= 1e-9 THEN amount / mean_a END AS amount_ratio_vs_prior_mean,
    CASE WHEN abs(max_a) >= 1e-9 THEN amount / max_a END AS amount_ratio_vs_prior_max,
    CASE WHEN n >= 2 AND sqrt(greatest(sum_sq / n - mean_a * mean_a, 0.0)) >= 1e-9
      THEN (amount - mean_a) / sqrt(greatest(sum_sq / n - mean_a * mean_a, 0.0)) END AS amount_z_vs_prior,
    n::DOUBLE AS txn_count_prior, age_h AS account_age_hours,
    CASE WHEN n > 0 THEN n / greatest(age_h, 1e-9) END AS txn_rate_per_hour,
    (txn_type <> p_type)::INT::DOUBLE AS type_changed,
    (txn_type IN ('CASH_OUT', 'TRANSFER'))::INT::DOUBLE AS is_fraud_capable_type,
    gap_b AS balance_gap_org, (abs(gap_b) > 0.01::DOUBLE)::INT::DOUBLE AS balance_gap_flag,
    oldbalance_org - amount - newbalance_orig AS error_balance_orig,
    oldbalance_dest + amount - newbalance_dest AS error_balance_dest,
    newbalance_orig - oldbalance_org AS balance_delta_org,
    CASE WHEN abs(oldbalance_org) >= 1e-9 THEN amount / oldbalance_org END AS amount_to_balance_ratio,
    (newbalance_orig < 0.01::DOUBLE AND oldbalance_org > 0.01::DOUBLE)::INT::DOUBLE AS drains_account,
    (oldbalance_org < 0.01::DOUBLE)::INT::DOUBLE AS orig_balance_was_zero,
    starts_with(dest_id, 'M')::INT::DOUBLE AS dest_is_merchant,
    (dest_id <> p_dest)::INT::DOUBLE AS dest_is_new,
    (oldbalance_dest < 0.01::DOUBLE)::INT::DOUBLE AS dest_balance_was_zero,
    ((step - 1) % 24)::DOUBLE AS hour_of_day, ((step - 1) // 24 % 7)::DOUBLE AS sim_day_of_week,
    p_score AS prev_fraud_score,
    txn_type, coalesce(p_type, '__NONE__') AS prev_txn_type,
    coalesce(p_type, '__NONE__') || '->' || txn_type AS type_pair, is_fraud, is_flagged_fraud
  FROM {to}2)"""
# The same totals over what was scored before, in the order of scoring; the previous row is the newest of those.
_LAST = ", ".join(f"arg_max({c}, (event_ts_us, event_id)) OVER b AS {name}" for c, name in (
    ("event_ts_us", "p_ts"), ("step", "p_step"), ("txn_type", "p_type"), ("amount", "p_amount"), ("newbalance_orig", "p_new"),
    ("dest_id", "p_dest"), ("score", "p_score")))
_PRIOR_AS_OF = f""",
known AS (
  SELECT *, count(*) OVER b AS n, {_LAST},
    CAST(sum(CAST(amount AS DECIMAL(18,2))) OVER b AS DOUBLE) AS sum_a,
    CAST(sum(CAST(amount AS DECIMAL(18,2)) * CAST(amount AS DECIMAL(18,2))) OVER b AS DOUBLE) AS sum_sq,
    max(amount) OVER b AS max_a, min(event_ts_us) OVER b AS first_ts
  FROM (SELECT *, {{scored_at}} AS scored_at FROM silver)
  WINDOW b AS (PARTITION BY account_id ORDER BY scored_at, event_ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_GOLD = _PRIOR + _FEATURES.format(to="prior", gold="gold")
GOLD = SILVER + _GOLD.format(score="CAST(NULL AS DOUBLE)")
SCORED_GOLD = SCORED_SILVER + _GOLD.format(score="lag(score) OVER w")


def as_of_cte(scored_at: str) -> str:
    """``gold_as_of``: the features of every transaction from what was scored before it."""
    return _PRIOR_AS_OF.format(scored_at=scored_at) + _FEATURES.format(to="known", gold="gold_as_of")

_STATE = """(
  SELECT account_id, arg_max(event_id, (event_ts_us, event_id)) AS last_event_id,
    max(event_ts_us) AS last_event_ts_us,
    arg_max(step, (event_ts_us, event_id)) AS last_step,
    arg_max(txn_type, (event_ts_us, event_id)) AS last_txn_type,
    arg_max(amount, (event_ts_us, event_id)) AS last_amount,
    arg_max(oldbalance_org, (event_ts_us, event_id)) AS last_oldbalance_org,
    arg_max(newbalance_orig, (event_ts_us, event_id)) AS last_newbalance_orig,
    arg_max(dest_id, (event_ts_us, event_id)) AS last_dest_id,
    arg_max(starts_with(dest_id, 'M'), (event_ts_us, event_id)) AS last_dest_is_merchant,
    CAST(NULL AS DOUBLE) AS last_fraud_score,
    min(event_ts_us) AS first_event_ts_us, count(*) AS txn_count,
    CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount_sum,
    CAST(sum(CAST(amount AS DECIMAL(18,2)) * CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount_sqsum,
    max(amount) AS max_amount, max(event_ts_us) AS updated_at_us, 1 AS state_version
  FROM silver {where} GROUP BY account_id)"""


def state_cte(name: str = "states", where: str = "") -> str:
    return f",\n{name} AS " + _STATE.format(where=where)


def with_ctes(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def r6_list(*names: str) -> str:
    return ", ".join(f"rnd({n}, 6) AS {n}" for n in names)
