"""Entity history in ledger order, bursts, counterparties and laundering motifs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions import columns as c
from txnlens.operators.pit import bucketed, past
from txnlens.operators.prefix import HOT_ROWS, prior_rows

CAP = 10_000_000  # fixed value: the largest amount the ledger allows


def capable(ledger: DataFrame) -> DataFrame:
    return ledger.where("txn_type IN ('TRANSFER', 'CASH_OUT')")


def stateless(rows: DataFrame, night_until: int = 5, strict_round: bool = False) -> DataFrame:
    """Thirteen features of the row alone; the strict variant asks round amounts to be > 0."""
    positive = " AND amount > 0" if strict_round else ""
    angle = f"2 * pi() * ({c.plain_hour()}) / 24D"
    return rows.selectExpr(
        "row_num",
        "amount",
        "log10(amount + 1D) AS amount_log10",
        "CAST(txn_type = 'TRANSFER' AS INT) AS is_transfer",
        f"{c.plain_hour()} AS hour_of_day",
        f"({c.plain_day()}) % 7 AS day_of_week",
        f"{c.plain_day()} AS day_index",
        f"CAST({c.plain_hour()} <= {night_until} AS INT) AS is_night",
        f"CAST(({c.plain_day()}) % 7 >= 5 AS INT) AS is_weekend",
        f"CAST(amount % 1000 = 0{positive} AS INT) AS is_round_1k",
        f"CAST(amount % 10000 = 0{positive} AS INT) AS is_round_10k",
        f"CAST(amount = {CAP} AS INT) AS is_capped_10m",
        f"sin({angle}) AS hour_sin",
        f"cos({angle}) AS hour_cos",
    )


def stateless_log(rows: DataFrame) -> DataFrame:
    """Seven-column set; its first four columns after the id are the smaller set."""
    angle = f"2 * pi() * ({c.plain_hour()}) / 24D"
    return rows.selectExpr(
        "row_num", "step", "CAST(txn_type = 'TRANSFER' AS INT) AS type_code", "amount",
        "CAST(is_flagged_fraud AS INT) AS is_flagged", "log1p(amount) AS log_amount",
        f"sin({angle}) AS hour_sin", f"cos({angle}) AS hour_cos",
    )


def history(rows: DataFrame, entity: str, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Count and money of the entity's earlier rows; the mean divides by count + 1."""
    before = prior_rows(
        rows, [entity], "row_num",
        {"_n": ("count", "1"), "_sum": ("sum", c.money("amount"))}, hot_rows=hot_rows,
    )
    total = "coalesce(CAST(_sum AS DOUBLE), 0D)"
    mean = f"({total} / (_n + 1))"
    return before.selectExpr(
        *rows.columns,
        f"_n AS {name}_count_hist",
        f"{total} AS {name}_amount_sum_hist",
        f"{mean} AS {name}_amount_mean_hist",
        f"amount / ({mean} + 1) AS amount_to_{name}_mean_ratio",
        f"CAST(_n >= 5 AS INT) AS {name}_is_frequent",
        f"CAST(_n = 0 AS INT) AS {name}_is_first_seen",
    )


def edge_history(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    before = prior_rows(rows, ["account_id", "dest_id"], "row_num", {"_n": ("count", "1")}, hot_rows=hot_rows)
    return before.selectExpr(*rows.columns, "_n AS edge_count_hist", "CAST(_n = 0 AS INT) AS edge_is_new")


def velocity(rows: DataFrame, entity: str, name: str) -> DataFrame:
    """Rows of the entity in the same hour and the same day, including later ones.

    Counts come from (entity, hour) totals joined back: a window over the raw rows would
    hold a whole entity in one task.
    """
    per_hour = rows.groupBy(entity, "step").agg(F.expr(f"count(1) AS {name}_velocity_1h"))
    totals = per_hour.selectExpr(
        "*", f"sum({name}_velocity_1h) OVER (PARTITION BY {entity}, step div 24) AS {name}_velocity_24h"
    )
    return rows.join(totals, [entity, "step"])


def surge(name: str) -> str:
    return f"({name}_velocity_1h + 1D) / ({name}_velocity_24h / 24D + 1D)"


def velocity_strict(rows: DataFrame, entity: str, name: str, hours: tuple[int, ...] = (1, 24)) -> DataFrame:
    """The repaired counts: only earlier steps."""
    totals = bucketed(rows, entity).selectExpr(
        entity, "step", *[f"coalesce({past('sum(cnt)', entity, h)}, 0L) AS {name}_prior_{h}h" for h in hours]
    )
    return rows.join(totals, [entity, "step"])


def mule_features(rows: DataFrame) -> DataFrame:
    """Cash-outs by accounts that received a transfer in an earlier step.

    ``first_step`` is the minimum over all transfers, ``first_amount`` that of the first one
    in ledger order.
    """
    inflow = rows.where("txn_type = 'TRANSFER'").groupBy(F.col("dest_id").alias("account_id")).agg(
        F.expr("min(step) AS first_step"), F.expr("min_by(amount, row_num) AS first_amount")
    )
    joined = rows.join(inflow, "account_id", "left").selectExpr(
        "*", "coalesce(txn_type = 'CASH_OUT' AND first_step < step, false) AS is_mule"
    )
    close = "abs(amount - coalesce(first_amount, 0D)) / (coalesce(first_amount, 0D) + 1D) <= 0.20D"
    return joined.selectExpr(
        *rows.columns,
        "CAST(is_mule AS INT) AS is_mule_chain",
        "CASE WHEN is_mule THEN step - first_step ELSE 0L END AS mule_time_since_transfer",
        f"CAST(is_mule AND step - first_step <= 6 AND {close} AS INT) AS is_rapid_passthrough",
    )


def mule_accounts(ledger: DataFrame) -> DataFrame:
    """Accounts that both received a transfer and cashed out."""
    received = ledger.where("txn_type = 'TRANSFER'").selectExpr("dest_id AS account_id")
    cashed = ledger.where("txn_type = 'CASH_OUT'").select("account_id")
    return received.intersect(cashed)
