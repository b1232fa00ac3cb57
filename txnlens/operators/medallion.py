"""Bronze to silver: ids and unique microsecond timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions import columns as c
from txnlens.functions.schema import SILVER_COLUMNS
from txnlens.operators.prefix import HOT_ROWS, prior_rows


def with_event_ts(bronze: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``event_ts_us``: the rows of a step spread over its hour in source order."""
    seq = prior_rows(bronze, ["step"], "row_num", {"_before": ("count", "1")}, hot_rows=hot_rows)
    # One row per hour of the ledger: bounded by its time span, whatever its row count.
    per_step = F.broadcast(bronze.groupBy("step").agg(F.expr("count(1) AS _rows_in_step")))
    return seq.join(per_step, "step", "left").selectExpr(
        *bronze.columns, f"{c.event_ts_us('step', '(_before + 1)', '_rows_in_step')} AS event_ts_us"
    )


def event_id(row_num: str = "row_num") -> str:
    return f"concat('ps-', lpad(CAST({row_num} AS STRING), 10, '0'))"


def to_silver(bronze: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    made = {"event_id": f"{event_id()} AS event_id", "bronze_row_num": "row_num AS bronze_row_num"}
    return with_event_ts(bronze, hot_rows).selectExpr(*[made.get(name, name) for name in SILVER_COLUMNS])
