"""Exploratory aggregates over the ledger; ``y`` is the 0/1 label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions import columns as c
from txnlens.operators.prefix import quantiles

ROWS = "count(1) AS rows"
POSITIVES = "sum(y) AS positives"


def _agg(df: DataFrame, keys: list[str], *exprs: str) -> DataFrame:
    return df.groupBy(*[F.expr(k) for k in keys]).agg(*[F.expr(e) for e in exprs])


def imbalance(df: DataFrame) -> DataFrame:
    by_class = _agg(df, ["y"], ROWS, f"{c.money_sum('amount')} AS amount")
    # two rows, so the overall totals are trivial
    return by_class.selectExpr("*", "rows / sum(rows) OVER () AS row_share", "amount / sum(amount) OVER () AS amount_share")


def by_type(df: DataFrame) -> DataFrame:
    per = _agg(df, ["txn_type"], ROWS, POSITIVES, f"{c.money_sum('amount')} AS amount",
               f"{c.money_sum('amount', 'y = 1')} AS positive_amount")
    return per.selectExpr("*", "positives / rows AS rate", "rows / sum(rows) OVER () AS row_share")


CLASS_PROBS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def quantiles_by_class(df: DataFrame) -> DataFrame:
    """One row per statistic: value for negatives, for positives, and their ratio."""
    q = quantiles(df, ["y"], "amount", CLASS_PROBS)
    moments = _agg(df, ["y"], "avg(amount) AS mean", "stddev_samp(amount) AS std", "min(amount) AS min", "max(amount) AS max")
    names = ["mean", "std", "min", *CLASS_PROBS, "max"]
    long = moments.join(q, "y").unpivot(["y"], names, "statistic", "v")
    wide = _agg(long, ["statistic"], "max(v) FILTER (WHERE y = 0) AS negative", "max(v) FILTER (WHERE y = 1) AS positive")
    return wide.selectExpr("*", f"{c.safe_ratio('positive', 'negative')} AS ratio")


def amount_by_type(df: DataFrame) -> DataFrame:
    q = quantiles(df, ["txn_type"], "amount", {"p50": 0.5, "p99": 0.99})
    return _agg(df, ["txn_type"], "avg(amount) AS mean", "max(amount) AS max").join(q, "txn_type")


def flag_crosstab(df: DataFrame) -> DataFrame:
    flagged = "is_flagged_fraud"
    return _agg(df, ["y"], f"count_if(NOT {flagged}) AS not_flagged", f"count_if({flagged}) AS flagged",
                f"{c.money_sum('amount', flagged)} AS flagged_amount", f"{c.money_sum('amount', f'NOT {flagged}')} AS not_flagged_amount")


ERRORS = {
    "orig_error": "oldbalance_org - amount - newbalance_orig",
    "dest_error": "oldbalance_dest + amount - newbalance_dest",
}


def balance_errors(df: DataFrame) -> DataFrame:
    """Distribution of the bookkeeping error of either side, by class."""
    pairs = ", ".join(f"named_struct('side', '{n}', 'v', round({e}, 2))" for n, e in ERRORS.items())
    long = df.selectExpr("y", f"inline(array({pairs}))")
    q = quantiles(long, ["y", "side"], "v", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return _agg(long, ["y", "side"], "avg(v) AS mean", "avg(CASE WHEN abs(v) < 0.01D THEN 1D ELSE 0D END) AS exact_share").join(q, ["y", "side"])


def zero_balance(df: DataFrame) -> DataFrame:
    drained = "newbalance_orig < 0.01D AND oldbalance_org > 0.01D"
    both = "oldbalance_org < 0.01D AND newbalance_orig < 0.01D"
    unknown = "oldbalance_dest < 0.01D AND newbalance_dest < 0.01D AND amount > 0"
    share = "avg(CASE WHEN {x} THEN 1D ELSE 0D END) AS {n}"
    return _agg(df, ["txn_type", "y"], ROWS, share.format(x=drained, n="drained_share"),
                share.format(x=both, n="both_zero_share"), share.format(x=unknown, n="unknown_dest_share"))


def fingerprint(df: DataFrame) -> DataFrame:
    """How well "amount equals the old balance and empties it" marks positives."""
    hit = "oldbalance_org = amount AND newbalance_orig = 0 AND amount > 0"
    return df.selectExpr(
        f"count_if({hit}) AS matches", f"count_if(({hit}) AND y = 1) AS positives_matched", "sum(y) AS positives",
    ).selectExpr("*", f"{c.ratio_or('positives_matched', 'matches')} AS precision", f"{c.ratio_or('positives_matched', 'positives')} AS recall")


def ledger_consistency(df: DataFrame) -> DataFrame:
    books = "abs(oldbalance_org - amount - newbalance_orig) < 0.01D"
    return _agg(df.where("y = 0"), ["txn_type"], ROWS, f"avg(CASE WHEN {books} THEN 1D ELSE 0D END) AS consistent_share",
                "count_if(amount > oldbalance_org + 0.01D) AS overdrawn")


def volume(df: DataFrame, bucket: str, name: str) -> DataFrame:
    return _agg(df, [f"{bucket} AS {name}"], ROWS, POSITIVES, f"{c.money_sum('amount')} AS amount")


def step_quantiles(df: DataFrame) -> DataFrame:
    """Spread of rows per step; there is one number per hour of the ledger."""
    per_step = df.groupBy("step").agg(F.expr("count(1) AS rows"))
    return per_step.selectExpr(
        "count(1) AS steps", "min(rows) AS min", "percentile(rows, 0.5) AS p50", "percentile(rows, 0.9) AS p90", "max(rows) AS max")


def amount_deciles(df: DataFrame, bins: int = 10) -> DataFrame:
    """Positive rate per quantile bin: interpolated edges, right-closed, first bin closed."""
    names = {f"e{i}": i / bins for i in range(1, bins)}
    edges = F.broadcast(quantiles(df, [], "amount", names))  # one row
    index = " + ".join(f"CAST(amount > e{i} AS INT)" for i in range(1, bins))
    placed = df.select("amount", "y").crossJoin(edges).selectExpr("amount", "y", f"{index} + 1 AS bin")
    return _agg(placed, ["bin"], ROWS, POSITIVES, "min(amount) AS lowest", "max(amount) AS highest").selectExpr(
        "*", "positives / rows AS rate")


def median_by_type_class(df: DataFrame) -> DataFrame:
    med = quantiles(df, ["txn_type", "y"], "amount", {"m": 0.5})
    wide = _agg(med, ["txn_type"], "max(m) FILTER (WHERE y = 0) AS negative_median", "max(m) FILTER (WHERE y = 1) AS positive_median")
    return wide.selectExpr("*", f"{c.safe_ratio('positive_median', 'negative_median')} AS ratio")


def type_dest_matrix(df: DataFrame) -> DataFrame:
    return _agg(df, ["txn_type", "substring(dest_id, 1, 1) AS dest_kind"], ROWS, POSITIVES).selectExpr("*", "positives / rows AS rate")


def correlations(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Pearson correlation of every pair, in one aggregate; long form."""
    names = list(columns)
    base = df.selectExpr(*[f"CAST({e} AS DOUBLE) AS {n}" for n, e in columns.items()])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    wide = base.selectExpr(*[f"corr({a}, {b}) AS p{i}" for i, (a, b) in enumerate(pairs)])
    rows = ", ".join(f"named_struct('a', '{a}', 'b', '{b}', 'correlation', p{i})" for i, (a, b) in enumerate(pairs))
    return wide.selectExpr(f"inline(array({rows}))")


def entity_counts(df: DataFrame) -> DataFrame:
    """Distinct accounts on either side, merchant rows and merchant positives."""
    ends = df.selectExpr(
        "inline(array(named_struct('side', 'o', 'id', account_id, 'm', 0, 'p', 0), named_struct('side', 'd', 'id', dest_id, "
        "'m', CAST(startswith(dest_id, 'M') AS INT), 'p', CAST(startswith(dest_id, 'M') AND y = 1 AS INT))))")
    per_id = _agg(ends, ["side", "id"], "sum(m) AS m", "sum(p) AS p")
    return per_id.selectExpr(
        "count_if(side = 'o') AS origins", "count_if(side = 'd') AS recipients", "sum(m) AS merchant_rows", "sum(p) AS merchant_positives")


def sample_rows(df: DataFrame, n: int, seed: str = "sample", row_id: str = "row_num") -> DataFrame:
    """A fixed-size random sample, the same every time: the ``n`` smallest hashes."""
    return df.orderBy(F.expr(c.md5_number(repr(seed), row_id)), row_id).limit(n)


def hist_bins(df: DataFrame, per_decade: int = 4) -> DataFrame:
    """Counts per logarithmic bin of the amount, by class; zero amounts have bin NULL."""
    b = f"CASE WHEN amount > 0 THEN CAST(floor(log10(amount) * {per_decade}) AS BIGINT) END AS bin"
    return _agg(df.selectExpr(b, "y"), ["bin"], "count_if(y = 0) AS negatives", "count_if(y = 1) AS positives")
