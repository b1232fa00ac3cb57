"""Schemas, feature lists and fixed values shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
SIM_EPOCH_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z
US_PER_HOUR = 3_600_000_000
US_PER_SECOND = 1_000_000
EPSILON = 1e-9
BALANCE_EPSILON = 0.01
NO_PREV = "__NONE__"
FEATURE_VERSION = 1
STATE_VERSION = 1
CAPABLE_TYPES = ("CASH_OUT", "TRANSFER")
MERCHANT_PREFIX = "M"
CAPTURE_RATE = 1.0
FP_AMOUNT_RATE = 0.20
ALERT_COST = 5.0
EV_MULTIPLIER = 1.20
# -----------------------------------------------------------------------------

# Source column -> (snake_case name, type) of the raw ledger file.
RAW_COLUMNS = {
    "step": ("step", T.LongType()),
    "type": ("txn_type", T.StringType()),
    "amount": ("amount", T.DoubleType()),
    "nameOrig": ("account_id", T.StringType()),
    "oldbalanceOrg": ("oldbalance_org", T.DoubleType()),
    "newbalanceOrig": ("newbalance_orig", T.DoubleType()),
    "nameDest": ("dest_id", T.StringType()),
    "oldbalanceDest": ("oldbalance_dest", T.DoubleType()),
    "newbalanceDest": ("newbalance_dest", T.DoubleType()),
    "isFraud": ("is_fraud", T.IntegerType()),
    "isFlaggedFraud": ("is_flagged_fraud", T.IntegerType()),
}
RAW = T.StructType([T.StructField(name, typ) for name, (_, typ) in RAW_COLUMNS.items()])

# The label-free transaction event: what a stream or an export may carry.
TXN = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("account_id", T.StringType()),
        T.StructField("dest_id", T.StringType()),
        T.StructField("txn_type", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("oldbalance_org", T.DoubleType()),
        T.StructField("newbalance_orig", T.DoubleType()),
        T.StructField("oldbalance_dest", T.DoubleType()),
        T.StructField("newbalance_dest", T.DoubleType()),
        T.StructField("step", T.LongType()),
        T.StructField("event_ts_us", T.LongType()),
    ]
)
TXN_COLUMNS = TXN.fieldNames()
SILVER_COLUMNS = [*TXN_COLUMNS, "is_fraud", "is_flagged_fraud", "bronze_row_num"]
LABEL_COLUMNS = ["is_fraud", "is_flagged_fraud"]

# One row per account.
STATE = T.StructType(
    [
        T.StructField("account_id", T.StringType()),
        T.StructField("last_event_id", T.StringType()),
        T.StructField("last_event_ts_us", T.LongType()),
        T.StructField("last_step", T.LongType()),
        T.StructField("last_txn_type", T.StringType()),
        T.StructField("last_amount", T.DoubleType()),
        T.StructField("last_oldbalance_org", T.DoubleType()),
        T.StructField("last_newbalance_orig", T.DoubleType()),
        T.StructField("last_dest_id", T.StringType()),
        T.StructField("last_dest_is_merchant", T.BooleanType()),
        T.StructField("last_fraud_score", T.DoubleType()),
        T.StructField("first_event_ts_us", T.LongType()),
        T.StructField("txn_count", T.LongType()),
        T.StructField("amount_sum", T.DoubleType()),
        T.StructField("amount_sqsum", T.DoubleType()),
        T.StructField("max_amount", T.DoubleType()),
        T.StructField("updated_at_us", T.LongType()),
        T.StructField("state_version", T.IntegerType()),
    ]
)
STATE_COLUMNS = STATE.fieldNames()
ANCHOR_COLUMNS = [c for c in STATE_COLUMNS if c.startswith("last_")]

# Feature names in table order.
NUMERIC_FEATURES = [
    "is_first_txn",
    "seconds_since_last_txn",
    "log1p_seconds_since_last",
    "steps_since_last_txn",
    "amount",
    "log1p_amount",
    "amount_delta_vs_last",
    "amount_ratio_vs_last",
    "amount_velocity",
    "amount_ratio_vs_prior_mean",
    "amount_ratio_vs_prior_max",
    "amount_z_vs_prior",
    "txn_count_prior",
    "account_age_hours",
    "txn_rate_per_hour",
    "type_changed",
    "is_fraud_capable_type",
    "balance_gap_org",
    "balance_gap_flag",
    "error_balance_orig",
    "error_balance_dest",
    "balance_delta_org",
    "amount_to_balance_ratio",
    "drains_account",
    "orig_balance_was_zero",
    "dest_is_merchant",
    "dest_is_new",
    "dest_balance_was_zero",
    "hour_of_day",
    "sim_day_of_week",
    "prev_fraud_score",
]
CATEGORICAL_FEATURES = ["txn_type", "prev_txn_type", "type_pair"]
FEATURES = [*NUMERIC_FEATURES, *CATEGORICAL_FEATURES]

# Features that must be NULL (numeric) or NO_PREV (categorical) on a first transaction.
COLD_START_NULL = [
    "seconds_since_last_txn",
    "log1p_seconds_since_last",
    "steps_since_last_txn",
    "amount_delta_vs_last",
    "amount_ratio_vs_last",
    "amount_velocity",
    "amount_ratio_vs_prior_mean",
    "amount_ratio_vs_prior_max",
    "amount_z_vs_prior",
    "account_age_hours",
    "txn_rate_per_hour",
    "type_changed",
    "balance_gap_org",
    "balance_gap_flag",
    "dest_is_new",
    "prev_fraud_score",
]
# Columns no feature may be derived from at scoring time.
FORBIDDEN_FEATURES = ["is_fraud", "is_flagged_fraud", "event_id", "account_id", "dest_id"]

GOLD_COLUMNS = ["event_id", "account_id", "event_ts_us", "feature_schema_version", *FEATURES, *LABEL_COLUMNS]

SCORED_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("account_id", T.StringType()),
        T.StructField("event_ts_us", T.LongType()),
        T.StructField("scored_at_us", T.LongType()),
        T.StructField("fraud_score", T.DoubleType()),
        T.StructField("decision", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("had_prev_state", T.BooleanType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("feature_schema_version", T.IntegerType()),
        T.StructField("transaction", TXN),
        T.StructField(
            "features",
            T.StructType(
                [T.StructField(c, T.DoubleType()) for c in NUMERIC_FEATURES]
                + [T.StructField(c, T.StringType()) for c in CATEGORICAL_FEATURES]
            ),
        ),
        T.StructField("event_schema_version", T.IntegerType()),
        T.StructField("trace_id", T.StringType()),
    ]
)
