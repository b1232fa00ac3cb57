"""SQL expressions: time, ratios, exact money, deterministic hashing.

Every function takes and returns Spark SQL text for ``selectExpr`` / ``expr``; one parsed
string per column keeps plan building cheap and the whole expression in generated code.
"""

from __future__ import annotations

from txnlens.functions.schema import EPSILON, SIM_EPOCH_US, US_PER_HOUR


def safe_ratio(n: str, d: str) -> str:
    """``n / d``, NULL where ``d`` is (almost) zero, so no infinity is ever produced."""
    return f"CASE WHEN abs({d}) >= {EPSILON!r} THEN ({n}) / ({d}) END"


def ratio_or(n: str, d: str, default: str = "0D") -> str:
    return f"CASE WHEN ({d}) > 0 THEN CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) ELSE {default} END"


def log1p_or_null(x: str) -> str:
    return f"CASE WHEN ({x}) >= 0 THEN log1p({x}) END"


def money(x: str) -> str:
    """Exact two-decimal money: sums of it do not depend on partitioning."""
    return f"CAST({x} AS DECIMAL(18,2))"


def money_square(x: str) -> str:
    return f"CAST({money(x)} * {money(x)} AS DECIMAL(36,4))"


def money_sum(x: str, where: str | None = None) -> str:
    cond = f" FILTER (WHERE {where})" if where else ""
    return f"coalesce(CAST(sum({money(x)}){cond} AS DOUBLE), 0D)"


def r6(x: str) -> str:
    """Six decimals, ties decided on the scaled double (as C's ``round`` does)."""
    return f"round(CAST({x} AS DOUBLE) * 1000000D) / 1000000D"


# --- time --------------------------------------------------------------------
def event_ts_us(step: str, seq: str, cardinality: str) -> str:
    """Spread the ``cardinality`` rows of a step evenly over its hour."""
    return f"{SIM_EPOCH_US} + ({step} - 1) * {US_PER_HOUR} + (({seq} - 1) * {US_PER_HOUR}) div {cardinality}"


def step_from_ts(ts_us: str) -> str:
    return f"1 + greatest(0L, ({ts_us} - {SIM_EPOCH_US}) div {US_PER_HOUR})"


def core_day(step: str = "step") -> str:
    return f"({step} - 1) div 24"


def core_hour(step: str = "step") -> str:
    return f"({step} - 1) % 24"


def core_dow(step: str = "step") -> str:
    return f"(({step} - 1) div 24) % 7"


def plain_day(step: str = "step") -> str:
    """Calendar without the -1 shift, used by the modelling frames."""
    return f"{step} div 24"


def plain_hour(step: str = "step") -> str:
    return f"{step} % 24"


def report_day(step: str = "step") -> str:
    return f"(({step} - 1) div 24) + 1"


def hour_dt(ts_us: str) -> str:
    """UTC date text of a microsecond timestamp, whatever the session time zone."""
    return f"CAST(date_add(DATE'1970-01-01', CAST(({ts_us}) div {24 * US_PER_HOUR} AS INT)) AS STRING)"


def hour_hr(ts_us: str) -> str:
    return f"lpad(CAST((({ts_us}) div {US_PER_HOUR}) % 24 AS STRING), 2, '0')"


def micros(ts: str) -> str:
    """Microseconds since the epoch of a zone-less timestamp column."""
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))"


# --- deterministic randomness ------------------------------------------------
def md5_number(*parts: str) -> str:
    """A number in [0, 2^32) from the first eight hex digits of an md5."""
    text = ", ".join(f"CAST({p} AS STRING)" for p in parts)
    return f"CAST(conv(substr(md5(concat_ws('|', {text})), 1, 8), 16, 10) AS BIGINT)"


def md5_unit(*parts: str) -> str:
    """Uniform in [0, 1)."""
    return f"({md5_number(*parts)} / 4294967296D)"
