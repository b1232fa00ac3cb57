"""Per-account features of each transaction, given everything the account did before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions import columns as c
from txnlens.functions.schema import (
    BALANCE_EPSILON,
    CAPABLE_TYPES,
    COLD_START_NULL,
    EPSILON,
    FEATURE_VERSION,
    FEATURES,
    FORBIDDEN_FEATURES,
    GOLD_COLUMNS,
    LABEL_COLUMNS,
    MERCHANT_PREFIX,
    NO_PREV,
    NUMERIC_FEATURES,
    TXN_COLUMNS,
    US_PER_HOUR,
    US_PER_SECOND,
)
from txnlens.operators.prefix import HOT_ROWS, prior_rows

PREV_COLUMNS = ["event_ts_us", "event_id", "step", "txn_type", "amount", "newbalance_orig", "dest_id"]


# Column of the previous row -> the field of a stored account state that replaces it.
STATE_PREV = {
    "event_ts_us": "last_event_ts_us",
    "event_id": "last_event_id",
    "step": "last_step",
    "txn_type": "last_txn_type",
    "amount": "last_amount",
    "newbalance_orig": "last_newbalance_orig",
    "dest_id": "last_dest_id",
}


def _continue_from(rows: DataFrame, states: DataFrame, prev: list[str], score: str | None) -> DataFrame:
    """Add stored states to the totals of the rows at hand.

    The previous transaction is the later one of the row before and the stored anchor, so a
    late event never moves the anchor back.
    """
    known = states.selectExpr("account_id", f"struct({', '.join(x for x in states.columns if x != 'account_id')}) AS s")
    fields = {**STATE_PREV, **({score: "last_fraud_score"} if score else {})}
    anchor = ", ".join(f"'{c}', s.{fields[c]}" for c in prev)
    older = "prev IS NULL OR struct(s.last_event_ts_us, s.last_event_id) > struct(prev.event_ts_us, prev.event_id)"
    combined = {
        "n": "n + coalesce(s.txn_count, 0L)",
        "sum_a": "coalesce(sum_a, 0) + coalesce(CAST(s.amount_sum AS DECIMAL(28,2)), 0)",
        "sum_sq": "coalesce(sum_sq, 0) + coalesce(CAST(s.amount_sqsum AS DECIMAL(38,4)), 0)",
        "max_a": "greatest(max_a, s.max_amount)",
        "first_ts": "least(first_ts, s.first_event_ts_us)",
        "prev": f"CASE WHEN s IS NOT NULL AND ({older}) THEN named_struct({anchor}) ELSE prev END",
    }
    joined = rows.join(known, "account_id", "left")
    return joined.selectExpr(*[f"{combined[x]} AS {x}" if x in combined else x for x in rows.columns])


# What the features need of the running totals and the previous row.
DERIVED = [
    f"(event_ts_us - prev.event_ts_us) / {US_PER_SECOND}D AS gap_s",
    "CASE WHEN n > 0 THEN CAST(sum_a AS DOUBLE) / n END AS mean_a",
    "CASE WHEN n > 0 THEN CAST(sum_sq AS DOUBLE) / n END AS mean_sq",
    f"(event_ts_us - first_ts) / {US_PER_HOUR}D AS age_h",
    "oldbalance_org - prev.newbalance_orig AS balance_gap",
    f"coalesce(prev.txn_type, '{NO_PREV}') AS prev_type",
]


def with_prior(
    silver: DataFrame, score: str | None = None, hot_rows: int = HOT_ROWS, states: DataFrame | None = None
) -> DataFrame:
    """Attach the account's previous row and running totals to every transaction."""
    prev = [*PREV_COLUMNS, *([score] if score else [])]
    rows = prior_rows(
        silver,
        ["account_id"],
        "event_ts_us",
        {
            "n": ("count", "1"),
            "sum_a": ("sum", c.money("amount")),
            "sum_sq": ("sum", c.money_square("amount")),
            "max_a": ("max", "amount"),
            "first_ts": ("min", "event_ts_us"),
        },
        prev=prev,
        tie=["event_id"],
        hot_rows=hot_rows,
    )
    if states is not None:
        rows = _continue_from(rows, states, prev, score)
    return rows.selectExpr("*", *DERIVED)


def feature_columns(score: str | None = None) -> dict[str, str]:
    """Every feature as SQL over the output of :func:`with_prior`."""
    tiny = f"{BALANCE_EPSILON}D"
    capable = ", ".join(f"'{t}'" for t in CAPABLE_TYPES)
    spread = "sqrt(greatest(mean_sq - mean_a * mean_a, 0D))"
    values = {
        "is_first_txn": "n = 0",
        "seconds_since_last_txn": "gap_s",
        "log1p_seconds_since_last": c.log1p_or_null("gap_s"),
        "steps_since_last_txn": "step - prev.step",
        "amount": "amount",
        "log1p_amount": c.log1p_or_null("amount"),
        "amount_delta_vs_last": "amount - prev.amount",
        "amount_ratio_vs_last": c.safe_ratio("amount", "prev.amount"),
        "amount_velocity": "CASE WHEN n > 0 THEN amount / greatest(gap_s, 1D) END",
        "amount_ratio_vs_prior_mean": c.safe_ratio("amount", "mean_a"),
        "amount_ratio_vs_prior_max": c.safe_ratio("amount", "max_a"),
        "amount_z_vs_prior": f"CASE WHEN n >= 2 THEN {c.safe_ratio('amount - mean_a', spread)} END",
        "txn_count_prior": "n",
        "account_age_hours": "age_h",
        "txn_rate_per_hour": f"CASE WHEN n > 0 THEN n / greatest(age_h, {EPSILON!r}) END",
        "type_changed": "txn_type <> prev.txn_type",
        "is_fraud_capable_type": f"txn_type IN ({capable})",
        "balance_gap_org": "balance_gap",
        "balance_gap_flag": f"abs(balance_gap) > {tiny}",
        "error_balance_orig": "oldbalance_org - amount - newbalance_orig",
        "error_balance_dest": "oldbalance_dest + amount - newbalance_dest",
        "balance_delta_org": "newbalance_orig - oldbalance_org",
        "amount_to_balance_ratio": c.safe_ratio("amount", "oldbalance_org"),
        "drains_account": f"newbalance_orig < {tiny} AND oldbalance_org > {tiny}",
        "orig_balance_was_zero": f"oldbalance_org < {tiny}",
        "dest_is_merchant": f"startswith(dest_id, '{MERCHANT_PREFIX}')",
        "dest_is_new": "dest_id <> prev.dest_id",
        "dest_balance_was_zero": f"oldbalance_dest < {tiny}",
        "hour_of_day": c.core_hour(),
        "sim_day_of_week": c.core_dow(),
        "prev_fraud_score": f"prev.{score}" if score else "NULL",
    }
    features = {name: f"CAST({values[name]} AS DOUBLE)" for name in NUMERIC_FEATURES}
    features["txn_type"] = "txn_type"
    features["prev_txn_type"] = "prev_type"
    features["type_pair"] = "concat(prev_type, '->', txn_type)"
    return features


def account_features(
    silver: DataFrame, score: str | None = None, hot_rows: int = HOT_ROWS, states: DataFrame | None = None
) -> DataFrame:
    """The gold table: identity, version, all features, and labels attached at the end.

    ``states`` continues from stored account states: ``silver`` then holds only transactions
    those states have not seen.

    ``score`` names a column holding the score each row received; without it (a batch
    refresh) ``prev_fraud_score`` is NULL.
    """
    labels = [name for name in LABEL_COLUMNS if name in silver.columns]
    return with_prior(silver, score, hot_rows, states).selectExpr(
        "event_id",
        "account_id",
        "event_ts_us",
        f"{FEATURE_VERSION} AS feature_schema_version",
        *[f"{expr} AS {name}" for name, expr in feature_columns(score).items()],
        *labels,
    )


def with_features(silver: DataFrame, columns: list[str], score: str | None = None, hot_rows: int = HOT_ROWS,
                  states: DataFrame | None = None) -> DataFrame:
    """``columns`` of ``silver`` and a struct ``f`` of the features, as a join of ``account_features`` by event id gives them.

    The features are made beside the columns, so nothing is joined. Only where an id repeats, which one count of ids
    tells, do its rows meet by a join. Rows without an id are left out.
    """
    rows = silver.where("event_id IS NOT NULL")
    twice = rows.groupBy("event_id").agg(F.expr("count(1) AS _n")).where("_n > 1")
    if twice.isEmpty():
        made = ", ".join(f"{expr} AS {name}" for name, expr in feature_columns(score).items())
        return with_prior(silver, score, hot_rows, states).where("event_id IS NOT NULL").selectExpr(
            *columns, f"struct({made}) AS f")
    feats = account_features(silver, score, hot_rows, states).selectExpr("event_id", f"struct({', '.join(FEATURES)}) AS f")
    return silver.select(*columns).join(feats, "event_id")


def features_as_of(
    events: DataFrame, history: DataFrame, score: str = "fraud_score", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``event_id, account_id`` and every feature of each event, from what was known of its account when it was scored.

    ``events`` has the transaction columns and ``known_us``, the moment of scoring; ``history`` has the same columns and
    the score that each transaction received, known from its own ``known_us`` on. An event sees the history rows of its
    account before it in the order (moment, event time, event id), whatever their event times: a late transaction counts
    the ones that were scored before it, and the previous transaction is the newest of those. One ordered pass per account over
    events and history together, cut for hot accounts.
    """
    at_rest = [*TXN_COLUMNS, "known_us"]
    anchor = f"struct({', '.join([*PREV_COLUMNS, score])})"
    known = {
        "n_in": "1L", "sum_in": c.money("amount"), "sq_in": c.money_square("amount"), "max_in": "amount", "first_in": "event_ts_us",
        "prev_in": anchor,
    }
    past = history.selectExpr(*at_rest, "1 AS kind", *[f"{v} AS {k}" for k, v in known.items()])
    types = dict(past.dtypes)
    now = events.selectExpr(*at_rest, "0 AS kind", *[f"CAST(NULL AS {types[k]}) AS {k}" for k in known])
    # An event's own row in the history comes right after it.
    rows = prior_rows(
        now.unionByName(past), ["account_id"], "known_us",
        {
            "n_known": ("sum", "n_in"), "sum_a": ("sum", "sum_in"), "sum_sq": ("sum", "sq_in"), "max_a": ("max", "max_in"),
            "first_ts": ("min", "first_in"), "prev": ("max", "prev_in"),
        },
        tie=["event_ts_us", "event_id", "kind"], hot_rows=hot_rows)
    rows = rows.where("kind = 0").selectExpr("*", "coalesce(n_known, 0L) AS n").selectExpr("*", *DERIVED)
    return rows.selectExpr("event_id", "account_id", *[f"{expr} AS {name}" for name, expr in feature_columns(score).items()])


def null_counts(gold: DataFrame, features: list[str] | None = None) -> DataFrame:
    """NULLs per feature in one pass."""
    names = features or FEATURES
    counted = gold.selectExpr(*[f"count_if({f} IS NULL) AS {f}" for f in names])
    return counted.unpivot([], names, "feature", "null_count")


def check_schema(columns: list[str]) -> None:
    """Refuse a gold frame whose columns are not exactly the declared ones, in order."""
    if columns != GOLD_COLUMNS:
        missing = sorted(set(GOLD_COLUMNS) - set(columns))
        extra = sorted(set(columns) - set(GOLD_COLUMNS))
        raise ValueError(f"gold columns differ (missing={missing}, extra={extra}, or order/duplicates)")
    leaked = sorted(set(FEATURES) & set(FORBIDDEN_FEATURES))
    if leaked:
        raise ValueError(f"forbidden feature sources: {leaked}")


def column_role(name: str) -> str:
    if name in LABEL_COLUMNS:
        return "target"
    if name in FORBIDDEN_FEATURES:
        return "forbidden"
    return "feature" if name in FEATURES else "metadata"


def cold_start_violations(gold: DataFrame) -> DataFrame:
    """First transactions that carry a value where history is undefined; must be all zero."""
    check_schema(gold.columns)
    bad = [f"count_if(is_first_txn = 1 AND {f} IS NOT NULL) AS {f}" for f in COLD_START_NULL]
    bad.append(f"count_if(is_first_txn = 1 AND prev_txn_type <> '{NO_PREV}') AS prev_txn_type")
    return gold.selectExpr(*bad).unpivot([], [*COLD_START_NULL, "prev_txn_type"], "feature", "violations")
