"""Encoders fitted on training rows only and applied to every row.

``train`` is SQL for the training mask (default ``split = 'train'``).  Group tables over
small fixed domains (type x hour) are broadcast; tables that grow with the recipients are
joined by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions import columns as c
from txnlens.operators.prefix import prior_rows, quantiles
from txnlens.sources.scratch import stored

TRAIN = "split = 'train'"
SMOOTHING = 10.0
FOLDS = 5


def zscore_by_group(
    rows: DataFrame, value: str, group: list[str], out: str, pad: float = 1.0, train: str = TRAIN
) -> DataFrame:
    """``(value - mean) / (std + pad)`` by training group.

    A group of one row has std 1; groups never trained use the overall training figures.
    The table of groups is joined by key: the planner broadcasts it where it is small.
    """
    fit = rows.where(train)
    stats = fit.groupBy(*group).agg(
        F.expr(f"avg({value}) AS _m"), F.expr(f"coalesce(stddev_samp({value}), 1D) AS _s")
    )
    overall = fit.selectExpr(f"avg({value}) AS _gm", f"stddev_samp({value}) AS _gs")
    joined = rows.join(stats, group, "left").crossJoin(F.broadcast(overall))
    return joined.selectExpr(
        *rows.columns, f"({value} - coalesce(_m, _gm)) / (coalesce(_s, _gs) + {pad}D) AS {out}"
    )


def fold_of(row_id: str = "row_num", folds: int = FOLDS) -> str:
    return f"{c.md5_number(chr(39) + 'fold' + chr(39), row_id)} % {folds}"


def target_encode(rows: DataFrame, key: str, out: str, train: str = TRAIN, smoothing: float = SMOOTHING) -> DataFrame:
    """Smoothed positive rate of the key over all training rows; unseen keys get the prior."""
    fit = rows.where(train)
    prior = F.broadcast(fit.selectExpr("avg(y) AS _prior"))
    per_key = fit.groupBy(key).agg(F.expr("count(1) AS _n"), F.expr("sum(y) AS _pos"))
    rate = f"(coalesce(_pos, 0) + {smoothing}D * _prior) / (coalesce(_n, 0) + {smoothing}D)"
    return rows.join(per_key, key, "left").crossJoin(prior).selectExpr(*rows.columns, f"{rate} AS {out}")


def target_encode_oof(
    rows: DataFrame, key: str, out: str, train: str = TRAIN, smoothing: float = SMOOTHING, folds: int = FOLDS
) -> DataFrame:
    """Training rows are encoded by the other folds, all other rows by the whole training part.

    One pass: totals per key minus the totals of the row's own fold.
    """
    tagged = rows.selectExpr("*", f"CAST({fold_of(folds=folds)} AS INT) AS _fold")
    fit = tagged.where(train)
    prior = F.broadcast(fit.selectExpr("avg(y) AS _prior"))
    own_n = ", ".join(f"count_if(_fold = {i})" for i in range(folds))
    own_pos = ", ".join(f"coalesce(sum(y) FILTER (WHERE _fold = {i}), 0)" for i in range(folds))
    per_key = fit.groupBy(key).agg(
        F.expr("count(1) AS _n"), F.expr("sum(y) AS _pos"),
        F.expr(f"array({own_n}) AS _own_n"), F.expr(f"array({own_pos}) AS _own_pos"),
    )
    minus = "CASE WHEN {train} THEN coalesce(element_at({own}, _fold + 1), 0) ELSE 0 END"
    n = f"(coalesce(_n, 0) - {minus.format(train=train, own='_own_n')})"
    pos = f"(coalesce(_pos, 0) - {minus.format(train=train, own='_own_pos')})"
    rate = f"({pos} + {smoothing}D * _prior) / ({n} + {smoothing}D)"
    joined = tagged.join(per_key, key, "left").crossJoin(prior)
    return joined.selectExpr(*rows.columns, f"{rate} AS {out}")


def train_aggregates(rows: DataFrame, train: str = TRAIN, mean_default: str = "0D") -> DataFrame:
    """Recipient frequency, mean amount, distinct types and cash-outs over training rows.

    ``mean_default`` is 0 or ``'global'`` (the training mean) for recipients never trained.
    Distinct types are counted from one flag per type, so the aggregate combines map-side.
    """
    fit = rows.where(train)
    kinds = ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER")
    distinct = " + ".join(f"max(CASE WHEN txn_type = '{k}' THEN 1L ELSE 0L END)" for k in kinds)
    per_dest = fit.groupBy("dest_id").agg(
        F.expr("count(1) AS _freq"),
        F.expr(f"CAST(sum({c.money('amount')}) AS DOUBLE) / count(1) AS _mean"),
        F.expr(f"{distinct} AS _types"),
        F.expr("count_if(txn_type = 'CASH_OUT') AS _cash"),
    )
    overall = F.broadcast(fit.selectExpr(f"CAST(sum({c.money('amount')}) AS DOUBLE) / count(1) AS _global"))
    default = "_global" if mean_default == "global" else mean_default
    return rows.join(per_dest, "dest_id", "left").crossJoin(overall).selectExpr(
        *rows.columns,
        "coalesce(_freq, 0L) AS dest_freq",
        f"coalesce(_mean, {default}) AS dest_amount_mean",
        "coalesce(_types, 0L) AS dest_type_count",
        "coalesce(_cash, 0L) AS dest_cashout_freq",
    )


def amount_ratio_by_type(rows: DataFrame, train: str = TRAIN) -> DataFrame:
    medians = F.broadcast(quantiles(rows.where(train), ["txn_type"], "amount", {"_median": 0.5}))
    return rows.join(medians, "txn_type", "left").selectExpr(
        *rows.columns, f"{c.safe_ratio('amount', '_median')} AS amount_ratio"
    )


def amount_ratio_global(rows: DataFrame, train: str = TRAIN) -> DataFrame:
    mean = rows.where(train).selectExpr(f"CAST(sum({c.money('amount')}) AS DOUBLE) / count(1) AS _mean")
    return rows.crossJoin(F.broadcast(mean)).selectExpr(*rows.columns, "amount / (_mean + 1) AS amount_ratio")


def type_code(rows: DataFrame, column: str = "txn_type", out: str = "type_code") -> DataFrame:
    """Category to integer by sorted label; any number of labels, numbered by ranges where there are many."""
    labels = rows.select(column).where(F.col(column).isNotNull()).distinct().selectExpr("0 AS _all", column)
    codes = prior_rows(stored(labels, "labels"), ["_all"], column, {"_before": ("count", "1")})
    codes = codes.selectExpr(column, f"CAST(_before AS INT) AS {out}")
    return rows.join(codes, column, "left").select(*rows.columns, out)


def frequency_encode(rows: DataFrame, key: str, out: str, train: str = "true") -> DataFrame:
    counts = rows.where(train).groupBy(key).agg(F.expr(f"count(1) AS {out}"))
    return rows.join(counts, key, "left").selectExpr(*rows.columns, f"coalesce({out}, 0L) AS {out}")


def class_weights(rows: DataFrame, train: str = TRAIN) -> DataFrame:
    """Positives weighted by value; the negative-to-positive ratio of the training part beside it."""
    ratio = F.broadcast(rows.where(train).selectExpr("count_if(y = 0) / greatest(count_if(y = 1), 1) AS imbalance_ratio"))
    return rows.crossJoin(ratio).selectExpr(
        *rows.columns, "CASE WHEN y = 1 THEN 1D + 2D * log10(amount + 1D) ELSE 1D END AS sample_weight", "imbalance_ratio"
    )
