"""Evaluation of alerts and scores; every denominator comes from the evaluated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions import columns as c
from txnlens.functions.schema import ALERT_COST, CAPTURE_RATE, EV_MULTIPLIER, FP_AMOUNT_RATE
from txnlens.operators.frontier import fbeta, ranking_metrics
from txnlens.sources.scratch import stored

def with_alert(scored: DataFrame, condition: str) -> DataFrame:
    return scored.selectExpr("*", f"({condition}) AS alert")


def confusion(alerted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return alerted.groupBy(*(keys or [])).agg(
        F.expr("count_if(NOT alert AND y = 0) AS tn"),
        F.expr("count_if(alert AND y = 0) AS fp"),
        F.expr("count_if(NOT alert AND y = 1) AS fn"),
        F.expr("count_if(alert AND y = 1) AS tp"),
    )


def outcome(alerted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Confusion counts together with the four money totals, in one aggregate."""
    return alerted.groupBy(*(keys or [])).agg(
        F.expr("count_if(NOT alert AND y = 0) AS tn"),
        F.expr("count_if(alert AND y = 0) AS fp"),
        F.expr("count_if(NOT alert AND y = 1) AS fn"),
        F.expr("count_if(alert AND y = 1) AS tp"),
        F.expr(f"{c.money_sum('amount', 'alert AND y = 1')} AS captured_amount"),
        F.expr(f"{c.money_sum('amount', 'y = 1')} AS total_positive_amount"),
        F.expr(f"{c.money_sum('amount', 'alert AND y = 0')} AS fp_amount"),
        F.expr(f"{c.money_sum('amount', 'y = 0')} AS total_legit_amount"),
    )


def classification(counts: DataFrame) -> DataFrame:
    """Rates over confusion counts; a zero denominator gives 0."""
    rated = counts.selectExpr(
        "*",
        f"{c.ratio_or('tp', 'tp + fp')} AS precision",
        f"{c.ratio_or('tp', 'tp + fn')} AS recall",
        f"{c.ratio_or('tp + tn', 'tp + tn + fp + fn')} AS accuracy",
        f"{c.ratio_or('fp', 'fp + tn')} AS fpr",
        f"{c.ratio_or('tp + fp', 'tp + tn + fp + fn')} AS alert_rate",
    )
    return rated.selectExpr("*", f"{fbeta(1.0, 'precision', 'recall')} AS f1")


def monetary(totals: DataFrame) -> DataFrame:
    """Business value on top of :func:`outcome`."""
    value = totals.selectExpr(
        "*",
        "total_positive_amount - captured_amount AS missed_amount",
        f"{c.ratio_or('captured_amount', 'total_positive_amount')} AS value_recall",
        f"{FP_AMOUNT_RATE}D * fp_amount AS fp_penalty",
        f"{ALERT_COST}D * (tp + fp) AS handling_cost",
        f"{CAPTURE_RATE}D * captured_amount - {FP_AMOUNT_RATE}D * fp_amount - {ALERT_COST}D * (tp + fp) AS net_value",
        f"{CAPTURE_RATE}D * total_positive_amount - {ALERT_COST}D * (tp + fn) AS oracle_value",
    )
    return value.selectExpr(
        "*",
        f"{c.ratio_or('net_value', 'total_positive_amount')} AS normalized_value",
        f"{c.ratio_or('net_value', 'oracle_value')} AS value_efficiency",
    )


def calibration_errors(scored: DataFrame, keys: list[str] | None = None, score: str = "score") -> DataFrame:
    p = f"least(greatest({score}, 1e-15), 1D - 1e-15)"
    return scored.groupBy(*(keys or [])).agg(
        F.expr(f"avg(({score} - y) * ({score} - y)) AS brier"),
        F.expr(f"avg(CASE WHEN y = 1 THEN -ln({p}) ELSE -ln(1D - {p}) END) AS log_loss"),
    )


def lift(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return ranking_metrics(scored, keys).selectExpr(
        *(keys or []), "average_precision", "positives / rows AS prevalence",
        f"{c.ratio_or('average_precision', 'positives / rows')} AS lift",
    )


def evaluate(alerted: DataFrame, keys: list[str] | None = None, score: str = "score") -> DataFrame:
    """The complete evaluation: counts, rates, money and ranking, per key."""
    keys = keys or []
    totals = outcome(alerted, keys)
    ranks = ranking_metrics(alerted, keys, score).select(*keys, "average_precision", "roc_auc")
    return guarded_rates(totals.join(ranks, keys) if keys else totals.crossJoin(F.broadcast(ranks)))


def guarded_rates(totals: DataFrame) -> DataFrame:
    """Rates and net value of :func:`outcome` columns, denominators floored."""
    rated = totals.selectExpr(
        "*",
        "tp / greatest(tp + fp, 1L) AS precision",
        "tp / greatest(tp + fn, 1L) AS recall",
        "fp / greatest(fp + tn, 1L) AS fpr",
        "captured_amount / greatest(total_positive_amount, 1e-6) AS value_recall",
        "fp_amount / greatest(total_legit_amount, 1e-6) AS legit_amount_alerted_rate",
        f"{CAPTURE_RATE}D * captured_amount - {FP_AMOUNT_RATE}D * fp_amount - {ALERT_COST}D * (tp + fp) AS net_value",
    )
    return rated.selectExpr("*", "2 * precision * recall / greatest(precision + recall, 1e-6) AS f1")


def expected_value(p: str, amount: str = "amount") -> str:
    """Expected gain of alerting one row with calibrated probability ``p``."""
    return f"({EV_MULTIPLIER}D * {p} * {amount} - {FP_AMOUNT_RATE}D * {amount} - {ALERT_COST}D)"


def break_even(amount: str = "amount") -> str:
    return f"CASE WHEN {amount} > 0 THEN ({FP_AMOUNT_RATE}D * {amount} + {ALERT_COST}D) / ({EV_MULTIPLIER}D * {amount}) END"


def sliced_ap(scored: DataFrame, slices: dict[str, str]) -> DataFrame:
    """Average precision per named slice; slices may overlap, one-class slices are left out."""
    tags = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in slices.items())
    long = scored.selectExpr("y", "amount", "score", f"explode(filter(array({tags}), s -> s IS NOT NULL)) AS slice")
    ranked = ranking_metrics(long, ["slice"])
    return ranked.where("positives > 0 AND positives < rows").select("slice", "rows", "positives", "average_precision")


def labelled_metrics(predictions: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Metrics over labelled predictions, with how many predictions are labelled at all."""
    joined = predictions.select("event_id", "fraud_score").join(labels.select("event_id", "is_fraud"), "event_id", "left")
    counts = joined.selectExpr(
        "count(1) AS predictions",
        "count(is_fraud) AS labelled",
        f"count_if(fraud_score >= {threshold}D AND is_fraud) AS tp",
        f"count_if(fraud_score >= {threshold}D AND NOT is_fraud) AS fp",
        f"count_if(fraud_score < {threshold}D AND is_fraud) AS fn",
        f"count_if(fraud_score < {threshold}D AND NOT is_fraud) AS tn",
    )
    return classification(counts).selectExpr("*", f"{c.ratio_or('labelled', 'predictions')} AS coverage")


def error_samples(alerted: DataFrame, n: int, tie: str = "row_num") -> DataFrame:
    """The ``n`` wrong rows with the highest scores (a per-task top-k, not a sort)."""
    wrong = alerted.where("alert <> (y = 1)")
    return wrong.orderBy(F.desc("score"), tie).limit(n)


def filter_predictions(
    events: DataFrame, score_range=(0.0, 1.0), decision: str | None = None, version: str | None = None,
    scored_after_us: int | None = None,
) -> DataFrame:
    out = events.where(f"fraud_score BETWEEN {score_range[0]}D AND {score_range[1]}D")
    if decision:
        out = out.where(F.col("decision") == decision)
    if version:
        out = out.where(F.col("model_version") == version)
    return out if scored_after_us is None else out.where(f"scored_at_us >= {scored_after_us}")


def redecide(events: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Decision at another threshold, and whether the label (if any) agrees."""
    joined = events.select("event_id", "fraud_score").join(labels.select("event_id", "is_fraud"), "event_id", "left")
    hit = f"fraud_score >= {threshold}D"
    return joined.selectExpr(
        "event_id",
        f"CASE WHEN {hit} THEN 'FRAUD' ELSE 'LEGIT' END AS decision",
        f"CASE WHEN is_fraud IS NULL THEN 'unlabeled' WHEN is_fraud = ({hit}) THEN 'correct' ELSE 'wrong' END AS correctness",
    )


def axis_points(events: DataFrame, x: str, y: str) -> DataFrame:
    """Two fields of the nested records per event, rows lacking either dropped but counted."""
    points = stored(events.selectExpr("event_id", f"{x} AS x", f"{y} AS y", "decision AS color"), "points")
    dropped = points.selectExpr("count_if(x IS NULL OR y IS NULL) AS excluded")
    return points.where("x IS NOT NULL AND y IS NOT NULL").crossJoin(F.broadcast(dropped))
