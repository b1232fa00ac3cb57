"""Point-in-time recipient history: only steps strictly before the current one count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions import columns as c

COUNT_HOURS = (1, 24)
AMOUNT_HOURS = (1, 24, 168)
SENDER_HOURS = (24, 168)
LOOKBACK = 168
NEVER = 999

PIT_FEATURES = [
    "current_amount", "transaction_type_transfer", "pit_prior_count_1h", "pit_prior_amount_1h",
    "pit_prior_count_24h", "pit_prior_amount_24h", "pit_prior_amount_168h", "pit_distinct_senders_24h",
    "pit_distinct_senders_168h", "pit_steps_since_last_event",
]
DEPLOYABLE = [
    "current_amount", "transaction_type_transfer", "pit_prior_count_1h", "pit_prior_amount_1h",
    "pit_prior_count_24h", "pit_prior_amount_24h", "pit_steps_since_last_event",
]


def population(ledger: DataFrame) -> DataFrame:
    """Rows that are scored; history always comes from every row."""
    return ledger.where("txn_type IN ('CASH_OUT', 'TRANSFER') AND startswith(dest_id, 'C')")


def bucketed(rows: DataFrame, entity: str) -> DataFrame:
    """Rows and exact money per (entity, step).  An entity has one row per hour at most, so
    the windows that follow are bounded however many rows the entity has."""
    return rows.groupBy(entity, "step").agg(
        F.expr("count(1) AS cnt"), F.expr(f"CAST(sum({c.money('amount')}) AS DECIMAL(28,2)) AS amt")
    )


def past(expr: str, entity: str, hours: int) -> str:
    return f"{expr} OVER (PARTITION BY {entity} ORDER BY step RANGE BETWEEN {hours} PRECEDING AND 1 PRECEDING)"


HOURS = sorted({*COUNT_HOURS, *AMOUNT_HOURS, *SENDER_HOURS})
MEASURES = {
    **{f"c{h}": "BIGINT" for h in COUNT_HOURS},
    **{f"a{h}": "DECIMAL(28,2)" for h in AMOUNT_HOURS},
    **{f"d{h}": "BIGINT" for h in SENDER_HOURS},
}


def _change(at: str, seen: str = "0", **measures: str) -> str:
    """One change of the running measures of a recipient, taking effect at step ``at``."""
    cells = ", ".join(f"'{m}', CAST({measures.get(m, '0')} AS {typ})" for m, typ in MEASURES.items())
    return f"named_struct('at', {at}, 'seen', {seen}, {cells})"


def activity_changes(ledger: DataFrame) -> DataFrame:
    """What each active (recipient, step) adds from the next step on, and takes back when it
    leaves a window.  Running sums of the changes replace sliding frames."""
    enter = {**{f"c{h}": "cnt" for h in COUNT_HOURS}, **{f"a{h}": "amt" for h in AMOUNT_HOURS}}
    changes = [_change("step", seen="1"), _change("step + 1", **enter)]
    for hours in HOURS:
        leave = {m: f"-{x}" for m, x in enter.items() if m in (f"c{hours}", f"a{hours}")}
        changes.append(_change(f"step + {hours + 1}", **leave))
    return bucketed(ledger, "dest_id").selectExpr("dest_id", f"inline(array({', '.join(changes)}))")


def sender_changes(ledger: DataFrame) -> DataFrame:
    """When a sender becomes, or stops being, recently seen by a recipient.

    A payment at step u makes its sender recent for steps u+1 .. u+w.  Payments of one
    sender closer than w form one stretch, which counts +1 where it starts and -1 after it
    ends; running sums of these changes are exact distinct counts, without any set.
    """
    pairs = ledger.select("dest_id", "account_id", "step").distinct()
    w = "OVER (PARTITION BY dest_id, account_id ORDER BY step)"
    edges = pairs.selectExpr("dest_id", "step", f"lag(step) {w} AS p", f"lead(step) {w} AS n")
    changes = []
    for hours in SENDER_HOURS:
        name = f"d{hours}"
        changes.append(f"CASE WHEN p IS NULL OR step - p > {hours} THEN {_change('step + 1', **{name: '1'})} END")
        changes.append(f"CASE WHEN n IS NULL OR n - step > {hours} THEN {_change(f'step + {hours + 1}', **{name: '-1'})} END")
    return edges.selectExpr("dest_id", f"inline(filter(array({', '.join(changes)}), x -> x IS NOT NULL))")


def recipient_history(ledger: DataFrame) -> DataFrame:
    """All window features per (recipient, step) with activity, in one running-sum pass."""
    changes = activity_changes(ledger).unionByName(sender_changes(ledger))
    per_step = changes.groupBy("dest_id", F.col("at").alias("step")).agg(
        F.expr("max(seen) AS seen"), *[F.expr(f"CAST(sum({m}) AS {typ}) AS {m}") for m, typ in MEASURES.items()]
    )
    w = "OVER (PARTITION BY dest_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND {to})"
    now, before = w.format(to="CURRENT ROW"), w.format(to="1 PRECEDING")
    running = per_step.selectExpr(
        "dest_id", "step", "seen", *[f"sum({m}) {now} AS {m}" for m in MEASURES],
        f"step - max(CASE WHEN seen = 1 THEN step END) {before} AS since",
    )
    return running.where("seen = 1").selectExpr(
        "dest_id",
        "step",
        *[f"c{h} AS pit_prior_count_{h}h" for h in COUNT_HOURS],
        *[f"CAST(a{h} AS DOUBLE) AS pit_prior_amount_{h}h" for h in AMOUNT_HOURS],
        *[f"d{h} AS pit_distinct_senders_{h}h" for h in SENDER_HOURS],
        f"CASE WHEN since <= {LOOKBACK} THEN since ELSE {NEVER}L END AS pit_steps_since_last_event",
    )


def pit_frame(ledger: DataFrame) -> DataFrame:
    """The modelling frame: one row per scored transaction with its ten features."""
    current = population(ledger).selectExpr(
        "row_num", "dest_id", "step", "amount AS current_amount",
        "CASE WHEN txn_type = 'TRANSFER' THEN 1D ELSE 0D END AS transaction_type_transfer",
        "CAST(is_fraud AS INT) AS y",
    )
    joined = current.join(recipient_history(ledger), ["dest_id", "step"])
    return joined.select("row_num", "dest_id", "step", *PIT_FEATURES, "y")
