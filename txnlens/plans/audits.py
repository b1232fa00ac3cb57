"""Data quality, skew, drift and raw-table audits."""

from __future__ import annotations

from txnlens.functions.schema import NUMERIC_FEATURES
from txnlens.operators import quality as q
from txnlens.operators.account import account_features
from txnlens.plans.inputs import (
    GOLD, LEDGER, SCORED_GOLD, SILVER, as_of_cte, gold, ledger, rounded, scored_with_features, silver, with_ctes,
)
from txnlens.plans.registry import query
from txnlens.sources import events
from txnlens.sources.scratch import fresh_dir, stored

LOW, HIGH = 0.001, 0.05  # bounds that fit this ledger


@query("dq_row_parity", with_ctes(GOLD, """SELECT (SELECT count(*) FROM ledger) AS bronze_rows, (SELECT count(*) FROM silver) AS silver_rows,
  count(*) AS gold_rows, (SELECT count(*) FROM ledger) = count(*) AS equal FROM gold"""))
def dq_row_parity(spark, d):
    return q.row_parity(bronze=ledger(spark, d), silver=silver(spark, d), gold=gold(spark, d))


@query("dq_ts_strict", with_ctes(SILVER, """SELECT count(*) FILTER (WHERE p >= event_ts_us) AS not_after_previous,
  count(*) FILTER (WHERE p > event_ts_us) AS before_previous FROM (
  SELECT event_ts_us, lag(event_ts_us) OVER (PARTITION BY account_id ORDER BY row_num) AS p FROM silver)"""))
def dq_ts_strict(spark, d):
    return q.ts_order_violations(silver(spark, d))


@query("dq_null_ts", with_ctes(SILVER, "SELECT count(*) - count(event_ts_us) AS null_timestamps FROM silver"))
def dq_null_ts(spark, d):
    return q.null_ts(silver(spark, d))


MONEY = ["amount", "oldbalance_org", "newbalance_orig", "oldbalance_dest", "newbalance_dest"]


@query("dq_finite", with_ctes(SILVER, " UNION ALL ".join(
    f"SELECT '{m}' AS \"column\", count(*) FILTER (WHERE isnan({m}) OR isinf({m})) AS non_finite FROM silver" for m in MONEY)))
def dq_finite(spark, d):
    return q.non_finite(silver(spark, d), MONEY)


@query("dq_no_infinite", with_ctes(GOLD, " UNION ALL ".join(
    f"SELECT '{f}' AS feature, count(*) FILTER (WHERE isinf({f})) AS infinite FROM gold" for f in NUMERIC_FEATURES)))
def dq_no_infinite(spark, d):
    return q.infinite_features(gold(spark, d))


@query("dq_fraud_rate", with_ctes(LEDGER, f"""SELECT count(*) AS rows, rnd(avg(is_fraud::INT), 6) AS rate,
  avg(is_fraud::INT) BETWEEN {LOW} AND {HIGH} AS within FROM ledger"""))
def dq_fraud_rate(spark, d):
    return rounded(q.fraud_rate(silver(spark, d), LOW, HIGH), "rate")


@query("dq_label_types", with_ctes(LEDGER, """SELECT count(*) AS positives_of_other_types FROM ledger
  WHERE is_fraud AND txn_type NOT IN ('TRANSFER')"""))
def dq_label_types(spark, d):
    return q.label_types(silver(spark, d), ("TRANSFER",))


@query("dq_first_txn", with_ctes(GOLD, """SELECT sum(is_first_txn)::BIGINT AS first_flags, count(DISTINCT account_id) AS accounts,
  sum(is_first_txn) = count(DISTINCT account_id) AS equal FROM gold"""))
def dq_first_txn(spark, d):
    return q.first_txn(gold(spark, d))


@query("dq_balance_gap", with_ctes(GOLD, """SELECT count(balance_gap_org) AS checked, count(*) FILTER (WHERE balance_gap_flag = 1) AS gaps,
  rnd(count(*) FILTER (WHERE balance_gap_flag = 1) / count(balance_gap_org), 6) AS gap_share FROM gold"""))
def dq_balance_gap(spark, d):
    return rounded(q.balance_gaps(gold(spark, d)), "gap_share")


@query(
    "dq_suite",
    with_ctes(GOLD, f"""SELECT 'row_parity' AS "check", CASE WHEN (SELECT count(*) FROM ledger) = count(*) THEN 'pass' ELSE 'fail' END AS status, count(*)::DOUBLE AS observed, 'bronze = silver = gold' AS bound FROM gold
      UNION ALL SELECT 'ts_strict', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END, count(*)::DOUBLE, '0' FROM (
        SELECT event_ts_us, lag(event_ts_us) OVER (PARTITION BY account_id ORDER BY row_num) AS p FROM silver) WHERE p >= event_ts_us
      UNION ALL SELECT 'null_ts', CASE WHEN count(*) = count(event_ts_us) THEN 'pass' ELSE 'fail' END, (count(*) - count(event_ts_us))::DOUBLE, '0' FROM silver
      UNION ALL SELECT 'finite_amount', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END, count(*)::DOUBLE, '0' FROM silver WHERE isnan(amount) OR isinf(amount)
      UNION ALL SELECT 'no_infinite', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END, count(*)::DOUBLE, '0' FROM gold WHERE {' OR '.join(f'isinf({f})' for f in NUMERIC_FEATURES)}
      UNION ALL SELECT 'fraud_rate', CASE WHEN avg(is_fraud::INT) BETWEEN {LOW} AND {HIGH} THEN 'pass' ELSE 'fail' END, rnd(avg(is_fraud::INT), 6), '{LOW}..{HIGH}' FROM silver
      UNION ALL SELECT 'label_types', CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END, count(*)::DOUBLE, '0' FROM silver WHERE is_fraud AND txn_type NOT IN ('TRANSFER', 'CASH_OUT')
      UNION ALL SELECT 'first_txn', CASE WHEN sum(is_first_txn) = count(DISTINCT account_id) THEN 'pass' ELSE 'fail' END, sum(is_first_txn), 'accounts' FROM gold
      UNION ALL SELECT 'balance_gap', 'pass', (count(*) FILTER (WHERE balance_gap_flag = 1))::DOUBLE, 'advisory' FROM gold"""),
)
def dq_suite(spark, d):
    layer = stored(silver(spark, d), "silver")
    features = stored(account_features(layer), "gold")
    return rounded(q.suite(ledger(spark, d), layer, features, LOW, HIGH), "observed")


@query("expected_row_count", with_ctes(LEDGER, "SELECT count(*) AS rows, true AS dense FROM ledger"))
def expected_row_count(spark, d):
    return q.expected_rows(ledger(spark, d))


LATE = "CASE WHEN CAST(substring(event_id, 4) AS BIGINT) % 10 = 0 THEN event_ts_us + 10800000000 ELSE event_ts_us END"


def _skew_sql(f: str) -> str:
    logged = f"l.{f}" if f != "amount_velocity" else "l.amount_velocity + CASE WHEN l.txn_type = 'DEBIT' THEN 1.0::DOUBLE ELSE 0 END"
    return f"""SELECT '{f}' AS feature, count(*) AS compared, count(*) FILTER (WHERE (({logged}) IS NULL) <> (r.{f} IS NULL)
      OR abs(({logged}) - r.{f}) > 1e-9 * greatest(1.0, abs(r.{f}))) AS mismatches FROM gold l JOIN gold_as_of r USING (event_id)"""


@query("skew_audit", with_ctes(SCORED_GOLD + as_of_cte(LATE), " UNION ALL ".join(map(_skew_sql, NUMERIC_FEATURES))))
def skew_audit(spark, d):
    """A log whose features are wrong where a tenth of the events came three hours late, and whose velocity is wrong on debits.

    The log is written to files and read again; the audit knows nothing but its lines.
    """
    path = fresh_dir(spark, "log")
    rows = scored_with_features(spark, d).selectExpr(
        "* EXCEPT (f)",
        "struct(f.* EXCEPT (amount_velocity), f.amount_velocity + CASE WHEN txn_type = 'DEBIT' THEN 1D ELSE 0D END AS amount_velocity) AS f")
    events.write_scored_events(events.to_scored_events(rows, scored_at=LATE), path)
    return q.audit_log(spark.read.text(path).select("value"))


STATS = ["mean", "std", "p25", "p50", "p75"]


def stats_sql(src: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, count({f}) AS n, avg({f}) AS mean, stddev_samp({f}) AS std, quantile_cont({f}, 0.25) AS p25,
          quantile_cont({f}, 0.5) AS p50, quantile_cont({f}, 0.75) AS p75 FROM {src}""" for f in NUMERIC_FEATURES)


@query("feature_stats", with_ctes(GOLD + f", st AS ({stats_sql('gold')})",
       "SELECT feature, n, " + ", ".join(f"rnd({s}, 6) AS {s}" for s in STATS) + " FROM st"))
def feature_stats(spark, d):
    return rounded(q.feature_stats(stored(gold(spark, d), "gold")), *STATS)


DRIFT_FEATURES = NUMERIC_FEATURES
DRIFT = ["base_mean", "window_mean", "mean_shift", "median_shift", "spread_ratio"]
SPLIT_US = 1_704_067_200_000_000 + 480 * 3_600_000_000


def _drift_stats(src: str, where: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, avg({f}) AS mean, stddev_samp({f}) AS std, quantile_cont({f}, 0.5) AS p50 FROM {src} WHERE {where}"
        for f in DRIFT_FEATURES)


@query(
    "drift_check",
    with_ctes(GOLD + f", b AS ({_drift_stats('gold', f'event_ts_us < {SPLIT_US}')}), w AS ({_drift_stats('gold', f'event_ts_us >= {SPLIT_US}')})",
              """SELECT feature, rnd(b.mean, 6) AS base_mean, rnd(w.mean, 6) AS window_mean, rnd((w.mean - b.mean) / b.std, 6) AS mean_shift,
      rnd((w.p50 - b.p50) / b.std, 6) AS median_shift, rnd(w.std / b.std, 6) AS spread_ratio FROM b JOIN w USING (feature)"""),
)
def drift_check(spark, d):
    rows = stored(gold(spark, d).select("event_ts_us", *DRIFT_FEATURES), "gold")
    base = q.feature_stats(rows.where(f"event_ts_us < {SPLIT_US}"), DRIFT_FEATURES)
    window = q.feature_stats(rows.where(f"event_ts_us >= {SPLIT_US}"), DRIFT_FEATURES)
    return rounded(q.drift(base, window), *DRIFT)


LEDGER_COLUMNS = ["row_num", "step", "txn_type", "amount", "account_id", "oldbalance_org", "newbalance_orig", "dest_id",
                  "oldbalance_dest", "newbalance_dest", "is_fraud", "is_flagged_fraud"]


@query("null_audit", with_ctes(LEDGER, " UNION ALL ".join(
    f"SELECT '{x}' AS \"column\", count(*) - count({x}) AS nulls FROM ledger" for x in LEDGER_COLUMNS)))
def null_audit(spark, d):
    return q.null_audit(ledger(spark, d))


@query("dup_audit", with_ctes(LEDGER, f"""SELECT count(*) FILTER (WHERE n > 1) AS repeated_groups, sum(n - 1)::BIGINT AS surplus_rows, sum(n)::BIGINT AS rows
  FROM (SELECT count(*) AS n FROM ledger GROUP BY {', '.join(LEDGER_COLUMNS[1:])})"""))
def dup_audit(spark, d):
    return q.dup_audit(ledger(spark, d), LEDGER_COLUMNS[1:])


@query("range_audit", with_ctes(LEDGER, """SELECT min(step) AS step_min, max(step) AS step_max, """ + ", ".join(
    f"count(*) FILTER (WHERE {m} < 0) AS negative_{m}" for m in MONEY)
    + ", count(*) FILTER (WHERE amount = 0) AS zero_amounts, min(amount) AS amount_min, max(amount) AS amount_max FROM ledger"))
def range_audit(spark, d):
    return q.range_audit(ledger(spark, d))


CARD = {"row_num": "bigint", "step": "bigint", "txn_type": "string", "amount": "double", "account_id": "string",
        "oldbalance_org": "double", "newbalance_orig": "double", "dest_id": "string", "oldbalance_dest": "double",
        "newbalance_dest": "double", "is_fraud": "boolean", "is_flagged_fraud": "boolean"}


@query("cardinality", with_ctes(LEDGER, " UNION ALL ".join(
    f"""SELECT '{x}' AS "column", '{t}' AS type, count(DISTINCT {x}) AS distinct_values, min(CAST({x} AS VARCHAR)) AS sample,
      rnd(count(DISTINCT {x}) / count(*), 6) AS id_ratio FROM ledger""" for x, t in CARD.items())))
def cardinality(spark, d):
    return rounded(q.cardinality(ledger(spark, d), list(CARD)), "id_ratio")
