"""Data-quality checks, audits and feature statistics; each is one pass over its table."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions.schema import NUMERIC_FEATURES
from txnlens.operators.account import features_as_of
from txnlens.operators.prefix import HOT_ROWS, prior_rows, union_all
from txnlens.sources.events import first_writes, parse_scored_events
from txnlens.sources.scratch import stored


def result(check: str, frame: DataFrame, observed: str, ok: str, bound: str) -> DataFrame:
    """One row ``(check, status, observed, bound)`` from a one-row frame."""
    return frame.selectExpr(
        f"'{check}' AS check", f"CASE WHEN {ok} THEN 'pass' ELSE 'fail' END AS status",
        f"CAST({observed} AS DOUBLE) AS observed", f"'{bound}' AS bound",
    )


def row_parity(**layers: DataFrame) -> DataFrame:
    """Row counts of the layers side by side (only counts travel)."""
    counts = union_all([df.selectExpr(f"'{name}' AS layer", "1 AS one") for name, df in layers.items()])
    names = list(layers)
    wide = counts.groupBy().agg(*[F.expr(f"count_if(layer = '{n}') AS {n}_rows") for n in names])
    same = " AND ".join(f"{names[0]}_rows = {n}_rows" for n in names[1:])
    return wide.selectExpr("*", f"({same}) AS equal")


def ts_order_violations(silver: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows not later than the account's previous row, in source order, by both readings."""
    before = prior_rows(silver, ["account_id"], "bronze_row_num", {}, prev=["event_ts_us"], hot_rows=hot_rows)
    return before.selectExpr(
        "count_if(prev.event_ts_us >= event_ts_us) AS not_after_previous",
        "count_if(prev.event_ts_us > event_ts_us) AS before_previous",
    )


def null_ts(silver: DataFrame) -> DataFrame:
    return silver.selectExpr("count_if(event_ts_us IS NULL) AS null_timestamps")


def non_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and infinite values per column, all columns in one scan."""
    bad = "count_if(isnan({x}) OR abs({x}) = double('infinity')) AS {x}"
    return df.selectExpr(*[bad.format(x=x) for x in columns]).unpivot([], columns, "column", "non_finite")


def infinite_features(gold: DataFrame) -> DataFrame:
    counts = gold.selectExpr(*[f"count_if(abs({f}) = double('infinity')) AS {f}" for f in NUMERIC_FEATURES])
    return counts.unpivot([], NUMERIC_FEATURES, "feature", "infinite")


def fraud_rate(silver: DataFrame, low: float, high: float) -> DataFrame:
    """Positive rate and whether it is within bounds; an empty table fails."""
    rate = silver.selectExpr("count(1) AS rows", "avg(CAST(is_fraud AS INT)) AS rate")
    return rate.selectExpr("rows", "rate", f"rows > 0 AND coalesce(rate BETWEEN {low}D AND {high}D, false) AS within")


def label_types(silver: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Positives whose type is not an allowed one."""
    spark = silver.sparkSession
    ok = spark.createDataFrame([(t,) for t in allowed], "txn_type string")
    stray = silver.where("is_fraud").join(F.broadcast(ok), "txn_type", "left_anti")  # allowed: a fixed list
    return stray.selectExpr("count(1) AS positives_of_other_types")


def first_txn(gold: DataFrame) -> DataFrame:
    """First-transaction flags against accounts, per account first, so nothing is deduplicated
    in one place."""
    per_account = gold.groupBy("account_id").agg(F.expr("sum(is_first_txn) AS firsts"))
    return per_account.selectExpr(
        "CAST(sum(firsts) AS BIGINT) AS first_flags", "count(1) AS accounts",
        "CAST(sum(firsts) AS BIGINT) = count(1) AS equal",
    )


def balance_gaps(gold: DataFrame) -> DataFrame:
    return gold.selectExpr(
        "count(balance_gap_org) AS checked", "count_if(balance_gap_flag = 1) AS gaps",
        "count_if(balance_gap_flag = 1) / greatest(count(balance_gap_org), 1) AS gap_share",
    )


def expected_rows(ledger: DataFrame, expected: int | None = None) -> DataFrame:
    """Row count, and that row numbers run 1..n without gaps or repeats.

    Repeats are found per row number (map-side combined), never as one distinct set.
    """
    per_id = ledger.groupBy("row_num").agg(F.expr("count(1) AS n"))
    stats = per_id.selectExpr("sum(n) AS rows", "count(1) AS ids", "min(row_num) AS lo", "max(row_num) AS hi")
    size = "" if expected is None else f" AND rows = {expected}"
    return stats.selectExpr("rows", f"(rows = ids AND lo = 1 AND hi = rows{size}) AS dense")


def suite(bronze: DataFrame, silver: DataFrame, gold: DataFrame, low: float, high: float) -> DataFrame:
    """Every check as one row."""
    parity = row_parity(bronze=bronze, silver=silver, gold=gold)
    order = ts_order_violations(silver)
    inf = infinite_features(gold).groupBy().agg(F.expr("sum(infinite) AS n"))
    bad = non_finite(silver, ["amount"]).selectExpr("non_finite AS n")
    return union_all([
        result("row_parity", parity, "gold_rows", "equal", "bronze = silver = gold"),
        result("ts_strict", order, "not_after_previous", "not_after_previous = 0", "0"),
        result("null_ts", null_ts(silver), "null_timestamps", "null_timestamps = 0", "0"),
        result("finite_amount", bad, "n", "n = 0", "0"),
        result("no_infinite", inf, "n", "n = 0", "0"),
        result("fraud_rate", fraud_rate(silver, low, high), "rate", "within", f"{low}..{high}"),
        result("label_types", label_types(silver, ("TRANSFER", "CASH_OUT")), "positives_of_other_types",
               "positives_of_other_types = 0", "0"),
        result("first_txn", first_txn(gold), "first_flags", "equal", "accounts"),
        result("balance_gap", balance_gaps(gold), "gaps", "true", "advisory"),
    ])


# --- serving skew ------------------------------------------------------------
def skew_audit(logged: DataFrame, recomputed: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Logged against recomputed feature values, per feature.

    ``logged`` are scored events with their nested ``features``; ``recomputed`` holds the
    same events' features from the true prior state.  Two NULLs agree.
    """
    pairs = ", ".join(
        f"named_struct('feature', '{f}', 'logged', features.{f}, 'recomputed', r_{f})" for f in NUMERIC_FEATURES
    )
    right = recomputed.selectExpr("event_id", *[f"{f} AS r_{f}" for f in NUMERIC_FEATURES])
    long = logged.select("event_id", "features").join(right, "event_id").selectExpr("event_id", f"inline(array({pairs}))")
    differ = (
        "CASE WHEN logged IS NULL AND recomputed IS NULL THEN false WHEN logged IS NULL OR recomputed IS NULL THEN true "
        f"ELSE abs(logged - recomputed) > {tolerance!r} * greatest(1D, abs(recomputed)) END"
    )
    return long.groupBy("feature").agg(F.expr("count(1) AS compared"), F.expr(f"count_if({differ}) AS mismatches"))


def audit_log(lines: DataFrame, hot_rows: int = HOT_ROWS, tolerance: float = 1e-9) -> DataFrame:
    """``skew_audit`` of logged event lines, which say themselves what was scored, when, and with which score.

    The log is parsed, of events that it holds more than once the first write counts, and the features of each are
    recomputed from the events that were scored before it. The log must reach back to the accounts' first events.
    """
    logged = stored(first_writes(parse_scored_events(lines)), "logged")
    scored = logged.selectExpr("transaction.*", "scored_at_us AS known_us", "fraud_score")
    return skew_audit(logged, features_as_of(scored, scored, hot_rows=hot_rows), tolerance)


# --- statistics --------------------------------------------------------------
SKETCH = 10_000  # a sketch of this accuracy misses a rank by at most rows / SKETCH
INSIDE = 100_000  # values between which the last step looks for a rank
SAMPLE = 200_000  # rows that a sketch is made of; it only proposes brackets, which are then counted over all rows
SAMPLED = 0.01  # how far from its rank a quantile of such a sample may lie: over four standard deviations
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


@dataclass
class _Bracket:
    """Where the value at a rank (counted from 0, maybe between two) of a feature lies: from ``lo`` to ``hi``."""

    feature: str
    name: str
    n: int
    rank: float
    lo: float
    hi: float
    below: int = 0  # values under lo
    upto: int = 0  # values up to hi

    def settle(self, below: int, upto: int) -> None:
        """Take the counts; a side that the rank lies beyond is opened."""
        self.below, self.upto = below, upto
        if below > math.floor(self.rank):
            self.lo, self.below = -math.inf, 0
        if upto <= math.ceil(self.rank):
            self.hi, self.upto = math.inf, self.n

    @property
    def inside(self) -> int:
        return 0 if self.lo == self.hi else self.upto - self.below

    def within(self) -> str:
        return f"{self.feature} BETWEEN {_double(self.lo)} AND {_double(self.hi)}"


def _double(x: float) -> str:
    return f"CAST('{x}' AS DOUBLE)" if math.isinf(x) else f"{x!r}D"


def _count_sides(gold: DataFrame, brackets: list[_Bracket]) -> None:
    """One pass over the table that counts what lies under and up to every bracket."""
    counts = gold.agg(*[F.expr(f"count_if({b.feature} {op} {_double(x)})") for b in brackets for op, x in (("<", b.lo), ("<=", b.hi))]).first()
    for i, b in enumerate(brackets):
        b.settle(counts[2 * i], counts[2 * i + 1])


def _sampled(gold: DataFrame, rows: int, wanted: int) -> DataFrame:
    """About ``wanted`` of ``rows`` rows, in few partitions: what is merged at the end does not grow with the table."""
    return gold if rows <= wanted else gold.sample(wanted / rows, seed=7).repartition(32)


def _narrow(gold: DataFrame, brackets: list[_Bracket], sketch: int) -> None:
    """One pass that sketches values inside each bracket and closes in on the rank."""
    fewest = min(b.inside for b in brackets)
    near = max(2.0 / sketch, SAMPLED if fewest > SAMPLE else 0.0)
    asked = []
    for b in brackets:
        at = (b.rank - b.below) / max(1, b.inside - 1)
        asked.append(F.expr(f"percentile_approx({b.feature}, array({max(0.0, at - near)!r}D, {min(1.0, at + near)!r}D), {sketch}) "
                            f"FILTER (WHERE {b.within()})"))
    cuts = _sampled(gold, fewest, SAMPLE).agg(*asked).first()
    for b, cut in zip(brackets, cuts, strict=True):
        b.lo, b.hi = cut or (b.lo, b.hi)


def feature_stats(
    gold: DataFrame, features: list[str] | None = None, sketch: int = SKETCH, inside: int = INSIDE
) -> DataFrame:
    """Mean, std and exact quartiles of every numeric feature.

    Every pass is one aggregate over the table for all features, which shuffles one row per task.  Sketches, of a sample
    where the table is large, bracket each quartile, a pass over all rows counts what lies outside, and brackets that
    still hold more than ``inside`` values are sketched again among those, until they hold fewer.  At the end only rows inside brackets are looked
    at, and the exact rank is picked among at most ``inside`` distinct values.  A value that fills its bracket needs no
    more.  Brackets are a few numbers per feature.
    """
    spark = gold.sparkSession
    names = features or NUMERIC_FEATURES
    rows = gold.count()
    near = max(2.0 / sketch, SAMPLED if rows > SAMPLE else 2.0 / max(1, rows))
    at = ", ".join(f"{x!r}D" for p in QUARTILES.values() for x in (max(0.0, p - near), min(1.0, p + near)))
    first = gold.agg(*[F.expr(e) for f in names for e in (f"count({f})", f"avg({f})", f"stddev_samp({f})")]).first()
    proposed = _sampled(gold, rows, SAMPLE).agg(*[F.expr(f"percentile_approx({f}, array({at}), {sketch})") for f in names]).first()
    brackets = []
    for i, f in enumerate(names):
        n, cuts = first[3 * i], proposed[i] or [-math.inf, math.inf] * len(QUARTILES)  # a sample may miss a rare value
        for k, (name, p) in enumerate(QUARTILES.items() if n else ()):
            brackets.append(_Bracket(f, name, n, p * (n - 1), cuts[2 * k], cuts[2 * k + 1]))
    if brackets:
        _count_sides(gold, brackets)
    while wide := [b for b in brackets if b.inside > inside]:
        before = sum(b.inside for b in wide)
        _narrow(gold, wide, sketch)
        _count_sides(gold, wide)
        if sum(b.inside for b in wide) >= before:  # a few values that repeat often: the last step counts them first
            break
    found = {(b.feature, b.name): b.lo for b in brackets if not b.inside} | _ranked_values(gold, [b for b in brackets if b.inside])
    out = [(f, *first[3 * i:3 * i + 3], *[found.get((f, q)) for q in QUARTILES]) for i, f in enumerate(names)]
    return spark.createDataFrame(out, "feature string, n long, mean double, std double, p25 double, p50 double, p75 double")


def _ranked_values(gold: DataFrame, brackets: list[_Bracket]) -> dict[tuple[str, str], float]:
    """The interpolated value at the rank of each bracket, from the rows inside."""
    if not brackets:
        return {}
    hits = ", ".join(f"CASE WHEN {b.within()} THEN named_struct('i', {i}, 'v', CAST({b.feature} AS DOUBLE)) END" for i, b in enumerate(brackets))
    inside = gold.selectExpr(f"inline(array_compact(array({hits})))")
    ranks = F.broadcast(gold.sparkSession.createDataFrame(
        [(i, b.rank, b.below) for i, b in enumerate(brackets)], "i int, rank double, below long"))  # a few per feature
    counts = inside.groupBy("i", "v").agg(F.expr("count(1) AS n")).join(ranks, "i")
    running = counts.selectExpr("*", "below + sum(n) OVER (PARTITION BY i ORDER BY v) AS upto")
    placed = running.groupBy("i", "rank").agg(
        F.expr("min(v) FILTER (WHERE upto > floor(rank)) AS lo"), F.expr("min(v) FILTER (WHERE upto > ceil(rank)) AS hi")
    ).selectExpr("i", "lo + (hi - lo) * (rank - floor(rank)) AS v")
    return {(brackets[r["i"]].feature, brackets[r["i"]].name): r["v"] for r in placed.collect()}


def drift(baseline: DataFrame, window: DataFrame) -> DataFrame:
    """Shift of a window's mean and spread against baseline statistics, in baseline stds."""
    b = baseline.selectExpr("feature", "mean AS base_mean", "std AS base_std", "p50 AS base_p50")
    shift = "CASE WHEN base_std >= 1e-9 THEN (mean - base_mean) / base_std END"
    return b.join(window, "feature").selectExpr(
        "feature", "base_mean", "mean AS window_mean", f"{shift} AS mean_shift",
        "CASE WHEN base_std >= 1e-9 THEN (p50 - base_p50) / base_std END AS median_shift",
        "CASE WHEN base_std >= 1e-9 THEN std / base_std END AS spread_ratio",
    )


# --- raw table audits --------------------------------------------------------
def null_audit(df: DataFrame) -> DataFrame:
    names = df.columns
    return df.selectExpr(*[f"count_if({x} IS NULL) AS {x}" for x in names]).unpivot([], names, "column", "nulls")


def dup_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that repeat an earlier row in the given columns."""
    groups = df.groupBy(*columns).agg(F.expr("count(1) AS n"))
    return groups.selectExpr("count_if(n > 1) AS repeated_groups", "sum(n - 1) AS surplus_rows", "sum(n) AS rows")


def range_audit(df: DataFrame) -> DataFrame:
    money = ["amount", "oldbalance_org", "newbalance_orig", "oldbalance_dest", "newbalance_dest"]
    return df.selectExpr(
        "min(step) AS step_min", "max(step) AS step_max", *[f"count_if({m} < 0) AS negative_{m}" for m in money],
        "count_if(amount = 0) AS zero_amounts", "min(amount) AS amount_min", "max(amount) AS amount_max",
    )


def cardinality(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Type, distinct values, smallest value and id-ness of each column.

    Exact counts shuffle (column, value) pairs once for all columns; ``approximate`` keeps
    one sketch per column instead.
    """
    types = dict(df.dtypes)
    pairs = ", ".join(f"named_struct('column', '{x}', 'type', '{types[x]}', 'value', CAST({x} AS STRING))" for x in columns)
    long = df.selectExpr(f"inline(array({pairs}))")
    if approximate:
        return long.groupBy("column", "type").agg(
            F.expr("approx_count_distinct(value) AS distinct_values"), F.expr("min(value) AS sample"),
            F.expr("approx_count_distinct(value) / count(1) AS id_ratio"))
    values = long.groupBy("column", "type", "value").agg(F.expr("count(1) AS n"))
    return values.groupBy("column", "type").agg(
        F.expr("count(value) AS distinct_values"), F.expr("min(value) AS sample"),
        F.expr("count(value) / sum(n) AS id_ratio"))
