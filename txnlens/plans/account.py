"""Time derivation and the per-account feature groups."""

from __future__ import annotations

from txnlens.functions import columns as c
from txnlens.functions.schema import COLD_START_NULL, FEATURES, GOLD_COLUMNS, NUMERIC_FEATURES
from txnlens.operators.account import account_features, cold_start_violations, column_role, null_counts
from txnlens.operators.medallion import event_id, to_silver, with_event_ts
from txnlens.plans.inputs import (
    GOLD, LEDGER, SCORED_GOLD, SILVER, gold, ledger, r6_list, rounded, scored_silver_table, silver, with_ctes,
)
from txnlens.plans.registry import query


@query("silver_event_ts", with_ctes(SILVER, "SELECT row_num, step, event_ts_us FROM silver"))
def silver_event_ts(spark, d):
    return with_event_ts(ledger(spark, d)).select("row_num", "step", "event_ts_us")


@query("silver_event_id", with_ctes(SILVER, "SELECT row_num, event_id FROM silver"))
def silver_event_id(spark, d):
    return ledger(spark, d).selectExpr("row_num", f"{event_id()} AS event_id")


@query(
    "silver_txn",
    with_ctes(SILVER, """SELECT event_id, account_id, dest_id, txn_type, amount, oldbalance_org, newbalance_orig,
      oldbalance_dest, newbalance_dest, step, event_ts_us, is_fraud, is_flagged_fraud, bronze_row_num FROM silver"""),
)
def silver_txn(spark, d):
    return to_silver(ledger(spark, d))


@query("step_from_ts", with_ctes(SILVER, "SELECT event_id, step FROM silver"))
def step_from_ts(spark, d):
    return silver(spark, d).selectExpr("event_id", f"{c.step_from_ts('event_ts_us')} AS step")


@query(
    "calendar_core",
    with_ctes(LEDGER, """SELECT row_num, (step - 1) // 24 AS sim_day, (step - 1) % 24 AS hour_of_day,
      (step - 1) // 24 % 7 AS sim_day_of_week FROM ledger"""),
)
def calendar_core(spark, d):
    return ledger(spark, d).selectExpr(
        "row_num", f"{c.core_day()} AS sim_day", f"{c.core_hour()} AS hour_of_day", f"{c.core_dow()} AS sim_day_of_week")


@query(
    "calendar_notebook",
    with_ctes(LEDGER, """SELECT row_num, step % 24 AS hour_of_day, step // 24 AS day_index, step // 24 % 7 AS day_of_week,
      CAST(step % 24 <= 5 AS INTEGER) AS is_night, CAST(step // 24 % 7 >= 5 AS INTEGER) AS is_weekend FROM ledger"""),
)
def calendar_notebook(spark, d):
    return ledger(spark, d).selectExpr(
        "row_num", f"{c.plain_hour()} AS hour_of_day", f"{c.plain_day()} AS day_index",
        f"({c.plain_day()}) % 7 AS day_of_week", f"CAST({c.plain_hour()} <= 5 AS INT) AS is_night",
        f"CAST(({c.plain_day()}) % 7 >= 5 AS INT) AS is_weekend")


@query("report_day", with_ctes(LEDGER, "SELECT row_num, (step - 1) // 24 + 1 AS report_day FROM ledger"))
def report_day(spark, d):
    return ledger(spark, d).selectExpr("row_num", f"{c.report_day()} AS report_day")


# --- feature groups: each query asks for a few columns, the optimizer prunes the rest ----
GROUPS = {
    "f_is_first_txn": ["is_first_txn"],
    "f_txn_count_prior": ["txn_count_prior"],
    "f_recency": ["seconds_since_last_txn", "log1p_seconds_since_last", "steps_since_last_txn"],
    "f_amount": ["amount", "log1p_amount"],
    "f_amount_vs_last": ["amount_delta_vs_last", "amount_ratio_vs_last", "amount_velocity"],
    "f_amount_vs_prior": ["amount_ratio_vs_prior_mean", "amount_ratio_vs_prior_max"],
    "f_amount_z": ["amount_z_vs_prior"],
    "f_tenure": ["account_age_hours", "txn_rate_per_hour"],
    "f_type_transition": ["type_changed", "is_fraud_capable_type", "prev_txn_type", "type_pair"],
    "f_balance_gap": ["balance_gap_org", "balance_gap_flag"],
    "f_balance_errors": ["error_balance_orig", "error_balance_dest", "balance_delta_org", "amount_to_balance_ratio"],
    "f_balance_flags": ["drains_account", "orig_balance_was_zero", "dest_balance_was_zero"],
    "f_dest": ["dest_is_merchant", "dest_is_new"],
    "f_calendar": ["hour_of_day", "sim_day_of_week"],
}


def _group(name: str, cols: list[str]) -> None:
    numeric = [x for x in cols if x in NUMERIC_FEATURES]
    text = [x for x in cols if x not in NUMERIC_FEATURES]
    sql = f"SELECT {', '.join(['event_id', *text])}, {r6_list(*numeric)} FROM gold"

    @query(name, with_ctes(GOLD, sql))
    def feature_group(spark, d):
        return rounded(gold(spark, d).select("event_id", *cols), *numeric)


for _name, _cols in GROUPS.items():
    _group(_name, _cols)


@query("f_prev_score", with_ctes(SCORED_GOLD, "SELECT event_id, prev_fraud_score FROM gold"))
def f_prev_score(spark, d):
    return account_features(scored_silver_table(spark, d), score="score").select("event_id", "prev_fraud_score")


_OTHER = [x for x in GOLD_COLUMNS if x not in NUMERIC_FEATURES]


@query("gold_features", with_ctes(GOLD, f"SELECT {', '.join(_OTHER)}, {r6_list(*NUMERIC_FEATURES)} FROM gold"))
def gold_features(spark, d):
    return rounded(gold(spark, d), *NUMERIC_FEATURES)


@query(
    "gold_null_counts",
    with_ctes(GOLD, "\nUNION ALL ".join(
        f"SELECT '{f}' AS feature, count(*) - count({f}) AS null_count FROM gold" for f in FEATURES)),
)
def gold_null_counts(spark, d):
    return null_counts(gold(spark, d))


@query(
    "schema_guard",
    with_ctes(GOLD, "\nUNION ALL ".join(
        [f"SELECT '{f}' AS feature, 'feature' AS role, count({f}) FILTER (WHERE is_first_txn = 1) AS violations FROM gold"
         for f in COLD_START_NULL]
        + ["""SELECT 'prev_txn_type', 'feature',
           count(*) FILTER (WHERE is_first_txn = 1 AND prev_txn_type <> '__NONE__') FROM gold"""])),
)
def schema_guard(spark, d):
    roles = " ".join(f"WHEN '{f}' THEN '{column_role(f)}'" for f in [*COLD_START_NULL, "prev_txn_type"])
    return cold_start_violations(gold(spark, d)).selectExpr(
        "feature", f"CASE feature {roles} END AS role", "violations")
