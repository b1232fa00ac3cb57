"""Evaluation metrics and inspection of scored events."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnlens.functions import columns as c
from txnlens.functions.schema import SIM_EPOCH_US
from txnlens.operators import frontier, metrics, pit
from txnlens.operators.prefix import quantiles
from txnlens.plans.history import PIT_SQL
from txnlens.plans.inputs import (
    GOLD, SCORED, SCORED_GOLD, SCORED_SILVER, gold, ledger, rounded, scored, scored_silver, scored_with_features, with_ctes,
)
from txnlens.plans.policy import FR, frontier_ctes
from txnlens.plans.registry import query
from txnlens.plans.tables import LABEL_CTE
from txnlens.sources import events, fixture
from txnlens.sources.scratch import stored

T = 0.7
ALERT = f"score >= {T}"
CONF = SCORED + """,
o AS (SELECT count(*) FILTER (WHERE score < 0.7::DOUBLE AND y = 0) AS tn, count(*) FILTER (WHERE score >= 0.7::DOUBLE AND y = 0) AS fp,
  count(*) FILTER (WHERE score < 0.7::DOUBLE AND y = 1) AS fn, count(*) FILTER (WHERE score >= 0.7::DOUBLE AND y = 1) AS tp,
  coalesce(sum(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE score >= 0.7::DOUBLE AND y = 1), 0)::DOUBLE AS cap,
  coalesce(sum(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE y = 1), 0)::DOUBLE AS pa,
  coalesce(sum(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE score >= 0.7::DOUBLE AND y = 0), 0)::DOUBLE AS fa,
  coalesce(sum(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE y = 0), 0)::DOUBLE AS la FROM scored)"""


def alerted(spark, d):
    return metrics.with_alert(scored(spark, d), f"score >= {T}D")


@query("confusion", with_ctes(CONF, "SELECT tn, fp, fn, tp FROM o"))
def confusion(spark, d):
    return metrics.confusion(alerted(spark, d))


@query(
    "classification_metrics",
    with_ctes(CONF, """SELECT tn, fp, fn, tp, rnd(tp / (tp + fp), 6) AS precision, rnd(tp / (tp + fn), 6) AS recall,
      rnd((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, rnd(fp / (fp + tn), 6) AS fpr,
      rnd((tp + fp) / (tp + tn + fp + fn), 6) AS alert_rate, rnd(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM o"""),
)
def classification_metrics(spark, d):
    out = metrics.classification(metrics.confusion(alerted(spark, d)))
    return rounded(out, "precision", "recall", "accuracy", "fpr", "alert_rate", "f1")


@query("fbeta", with_ctes(CONF, """SELECT beta, rnd((1 + beta * beta) * tp / ((1 + beta * beta) * tp + beta * beta * fn + fp), 6) AS fbeta
  FROM o, (SELECT unnest([0.5, 1.0, 1.75, 2.0])::DOUBLE AS beta)"""))
def fbeta(spark, d):
    rates = metrics.classification(metrics.confusion(alerted(spark, d)))
    pairs = ", ".join(f"named_struct('beta', {b}D, 'fbeta', {frontier.fbeta(b, 'precision', 'recall')})" for b in (0.5, 1.0, 1.75, 2.0))
    return rounded(rates.selectExpr(f"inline(array({pairs}))"), "fbeta")


MONEY = ["captured_amount", "missed_amount", "total_positive_amount", "value_recall", "fp_amount", "fp_penalty",
         "handling_cost", "net_value", "normalized_value", "oracle_value", "value_efficiency"]


@query(
    "monetary_metrics",
    with_ctes(CONF, """, v AS (SELECT *, cap - 0.2::DOUBLE * fa - 5 * (tp + fp) AS nbv, pa - 5.0::DOUBLE * (tp + fn) AS orc FROM o)
      SELECT rnd(cap, 6) AS captured_amount, rnd(pa - cap, 6) AS missed_amount, rnd(pa, 6) AS total_positive_amount,
      rnd(cap / pa, 6) AS value_recall, rnd(fa, 6) AS fp_amount, rnd(0.2::DOUBLE * fa, 6) AS fp_penalty,
      rnd(5.0::DOUBLE * (tp + fp), 6) AS handling_cost, rnd(nbv, 6) AS net_value, rnd(nbv / pa, 6) AS normalized_value,
      rnd(orc, 6) AS oracle_value, rnd(CASE WHEN orc > 0 THEN nbv / orc ELSE 0 END, 6) AS value_efficiency FROM v"""),
)
def monetary_metrics(spark, d):
    return rounded(metrics.monetary(metrics.outcome(alerted(spark, d))).select(*MONEY), *MONEY)


# AP and ROC area the textbook way: recall steps and pairwise trapezoids over the frontier.
def rank_ctes(src: str = "scored", keys: tuple[str, ...] = (), name: str = "fr") -> str:
    k = "".join(f"{x}, " for x in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    return frontier_ctes(src, keys, name=name) + f""",
{name}_l AS (SELECT *, lag(tp, 1, 0) OVER w AS tp0, lag(fp, 1, 0) OVER w AS fp0 FROM {name} WINDOW w AS ({part}ORDER BY threshold DESC)),
{name}_m AS (SELECT {k}(max(np) + max(nn))::BIGINT AS rows, max(np)::BIGINT AS positives,
  coalesce(sum((tp - tp0) * (tp / (tp + fp))) / nullif(max(np), 0), 0) AS average_precision,
  coalesce(sum((fp - fp0) * (tp + tp0) / 2) / nullif(max(np), 0) / nullif(max(nn), 0), 0.5) AS roc_auc FROM {name}_l{group})"""


RANK = SCORED + rank_ctes()


@query("average_precision", with_ctes(RANK, "SELECT rows, positives, rnd(average_precision, 6) AS average_precision FROM fr_m"))
def average_precision(spark, d):
    out = frontier.ranking_metrics(scored(spark, d)).select("rows", "positives", "average_precision")
    return rounded(out, "average_precision")


@query("roc_auc", with_ctes(RANK, "SELECT rnd(roc_auc, 6) AS roc_auc FROM fr_m"))
def roc_auc(spark, d):
    return rounded(frontier.ranking_metrics(scored(spark, d)).select("roc_auc"), "roc_auc")


@query("pr_curve", with_ctes(FR, "SELECT threshold, rnd(precision, 6) AS precision, rnd(recall_count, 6) AS recall FROM fr"))
def pr_curve(spark, d):
    out = frontier.exact_frontier(scored(spark, d)).selectExpr("threshold", "precision", "recall_count AS recall")
    return rounded(out, "precision", "recall")


@query("roc_curve", with_ctes(FR, "SELECT threshold, rnd(fpr, 6) AS fpr, rnd(recall_count, 6) AS tpr FROM fr"))
def roc_curve(spark, d):
    out = frontier.exact_frontier(scored(spark, d)).selectExpr("threshold", "fpr", "recall_count AS tpr")
    return rounded(out, "fpr", "tpr")


@query("brier", with_ctes(SCORED, "SELECT rnd(avg(pow(score - y, 2)), 6) AS brier FROM scored"))
def brier(spark, d):
    return rounded(metrics.calibration_errors(scored(spark, d)).select("brier"), "brier")


@query(
    "log_loss",
    with_ctes(SCORED, """SELECT rnd(avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS log_loss FROM (
      SELECT y, least(greatest(score, 1e-15::DOUBLE), 1.0::DOUBLE - 1e-15::DOUBLE) AS p FROM scored)"""),
)
def log_loss(spark, d):
    return rounded(metrics.calibration_errors(scored(spark, d)).select("log_loss"), "log_loss")


@query(
    "prevalence_lift",
    with_ctes(RANK, """SELECT rnd(average_precision, 6) AS average_precision, rnd(positives / rows, 6) AS prevalence,
      rnd(average_precision / (positives / rows), 6) AS lift FROM fr_m"""),
)
def prevalence_lift(spark, d):
    return rounded(metrics.lift(scored(spark, d)), "average_precision", "prevalence", "lift")


SLICES = {
    "transfer": "txn_type = 'TRANSFER'",
    "cash_out": "txn_type = 'CASH_OUT'",
    "payment": "txn_type = 'PAYMENT'",
    "large": "amount >= 100",
    "to_merchant": "startswith(dest_id, 'M')",
    "night": "step % 24 <= 5",
}
SLICE_SQL = SCORED + ",\nsl AS (" + " UNION ALL ".join(
    f"SELECT y, amount, score, '{n}' AS slice FROM scored WHERE {cond.replace('startswith', 'starts_with')}" for n, cond in SLICES.items()) + ")"


@query(
    "sliced_ap",
    with_ctes(SLICE_SQL + rank_ctes("sl", ("slice",)),
              "SELECT slice, rows, positives, rnd(average_precision, 6) AS average_precision FROM fr_m WHERE positives > 0 AND positives < rows"),
)
def sliced_ap(spark, d):
    return rounded(metrics.sliced_ap(scored(spark, d), SLICES), "average_precision")



@query(
    "warm_cold",
    with_ctes(SCORED + PIT_SQL[len(SCORED.split(",\nscored AS")[0]):] + """,
      coh AS (SELECT s.y, s.amount, s.score, CASE WHEN p.pit_distinct_senders_168h > 0 THEN 'warm' ELSE 'cold' END AS cohort
        FROM scored s JOIN pit p USING (row_num))""" + rank_ctes("coh", ("cohort",)),
              "SELECT cohort, rows, positives, rnd(average_precision, 6) AS average_precision FROM fr_m WHERE positives > 0"),
)
def warm_cold(spark, d):
    known = pit.pit_frame(ledger(spark, d)).selectExpr(
        "row_num", "CASE WHEN pit_distinct_senders_168h > 0 THEN 'warm' ELSE 'cold' END AS cohort")
    rows = scored(spark, d).select("row_num", "y", "amount", "score").join(known, "row_num")
    out = frontier.ranking_metrics(rows, ["cohort"]).where("positives > 0")
    return rounded(out.select("cohort", "rows", "positives", "average_precision"), "average_precision")


EVAL = ["captured_amount", "total_positive_amount", "fp_amount", "total_legit_amount", "average_precision", "roc_auc",
        "precision", "recall", "fpr", "value_recall", "legit_amount_alerted_rate", "net_value", "f1"]


@query(
    "denominator_correct_eval",
    with_ctes(CONF + rank_ctes(), """SELECT tn, fp, fn, tp, rnd(cap, 6) AS captured_amount, rnd(pa, 6) AS total_positive_amount,
      rnd(fa, 6) AS fp_amount, rnd(la, 6) AS total_legit_amount, rnd(average_precision, 6) AS average_precision,
      rnd(roc_auc, 6) AS roc_auc, rnd(tp / (tp + fp), 6) AS precision, rnd(tp / (tp + fn), 6) AS recall, rnd(fp / (fp + tn), 6) AS fpr,
      rnd(cap / pa, 6) AS value_recall, rnd(fa / la, 6) AS legit_amount_alerted_rate,
      rnd(cap - 0.2::DOUBLE * fa - 5 * (tp + fp), 6) AS net_value, rnd(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM o, fr_m"""),
)
def denominator_correct_eval(spark, d):
    return rounded(metrics.evaluate(alerted(spark, d)), *EVAL)


# --- scored events and their labels ------------------------------------------
def scored_events(spark, d):
    return events.to_scored_events(scored_with_features(spark, d), scored_at="event_ts_us + 250000")


def light_events(spark, d):
    """Score and decision only: the features are not needed, so they are not computed."""
    return scored_silver(spark, d).selectExpr(
        "event_id", "event_ts_us + 250000 AS scored_at_us", "score AS fraud_score",
        "CASE WHEN score >= 0.5D THEN 'FRAUD' ELSE 'LEGIT' END AS decision", "'1' AS model_version")


LAB = SCORED_SILVER + ", " + LABEL_CTE


@query(
    "labeled_subset_metrics",
    with_ctes(LAB, """, j AS (SELECT s.score, l.is_fraud AS f FROM silver s LEFT JOIN labs l USING (event_id)),
      o AS (SELECT count(*) AS predictions, count(f) AS labelled, count(*) FILTER (WHERE score >= 0.5 AND f) AS tp,
        count(*) FILTER (WHERE score >= 0.5 AND NOT f) AS fp, count(*) FILTER (WHERE score < 0.5 AND f) AS fn,
        count(*) FILTER (WHERE score < 0.5 AND NOT f) AS tn FROM j)
      SELECT *, rnd(tp / (tp + fp), 6) AS precision, rnd(tp / (tp + fn), 6) AS recall, rnd((tp + tn) / labelled, 6) AS accuracy,
        rnd(fp / (fp + tn), 6) AS fpr, rnd((tp + fp) / labelled, 6) AS alert_rate, rnd(2 * tp / (2 * tp + fp + fn), 6) AS f1,
        rnd(labelled / predictions, 6) AS coverage FROM o"""),
)
def labeled_subset_metrics(spark, d):
    out = metrics.labelled_metrics(light_events(spark, d), fixture.prediction_labels(spark, d), 0.5)
    return rounded(out, "precision", "recall", "accuracy", "fpr", "alert_rate", "f1", "coverage")


@query(
    "error_samples",
    with_ctes(SCORED, """SELECT row_num, dest_id, step, y, score FROM scored WHERE (score >= 0.7) <> (y = 1)
      ORDER BY score DESC, row_num LIMIT 300"""),
)
def error_samples(spark, d):
    return metrics.error_samples(alerted(spark, d), 300).select("row_num", "dest_id", "step", "y", "score")


CUTOFF = SIM_EPOCH_US + 10 * events.DAY_US


@query(
    "prediction_filters",
    with_ctes(SCORED_SILVER, f"""SELECT event_id, score AS fraud_score, event_ts_us + 250000 AS scored_at_us FROM silver
      WHERE score BETWEEN 0.3 AND 0.9 AND score >= 0.5 AND event_ts_us + 250000 >= {CUTOFF}"""),
)
def prediction_filters(spark, d):
    out = metrics.filter_predictions(light_events(spark, d), (0.3, 0.9), "FRAUD", "1", CUTOFF)
    return out.select("event_id", "fraud_score", "scored_at_us")


@query(
    "redecide",
    with_ctes(LAB, """SELECT s.event_id, CASE WHEN score >= 0.6 THEN 'FRAUD' ELSE 'LEGIT' END AS decision,
      CASE WHEN is_fraud_l IS NULL THEN 'unlabeled' WHEN is_fraud_l = (score >= 0.6) THEN 'correct' ELSE 'wrong' END AS correctness
      FROM silver s LEFT JOIN (SELECT event_id, is_fraud AS is_fraud_l FROM labs) l USING (event_id)"""),
)
def redecide(spark, d):
    return metrics.redecide(light_events(spark, d), fixture.prediction_labels(spark, d), 0.6)


@query(
    "axis_points",
    with_ctes(SCORED_GOLD, """SELECT g.event_id, rnd(g.log1p_amount, 6) AS x, rnd(g.amount_z_vs_prior, 6) AS y,
      CASE WHEN s.score >= 0.5 THEN 'FRAUD' ELSE 'LEGIT' END AS color,
      (SELECT count(*) FROM gold WHERE log1p_amount IS NULL OR amount_z_vs_prior IS NULL) AS excluded
      FROM gold g JOIN silver s USING (event_id) WHERE g.log1p_amount IS NOT NULL AND g.amount_z_vs_prior IS NOT NULL"""),
)
def axis_points(spark, d):
    return rounded(metrics.axis_points(scored_events(spark, d), "features.log1p_amount", "features.amount_z_vs_prior"), "x", "y")


PROBS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


@query(
    "latency_summary",
    with_ctes(GOLD, "SELECT rnd(avg(seconds_since_last_txn), 6) AS mean, " + ", ".join(
        f"rnd(quantile_cont(seconds_since_last_txn, {p}), 6) AS {n}" for n, p in PROBS.items()) + " FROM gold"),
)
def latency_summary(spark, d):
    """Summary of a duration column; here the wait between an account's transactions."""
    waits = stored(gold(spark, d).select("seconds_since_last_txn"), "waits")
    points = quantiles(waits, [], "seconds_since_last_txn", PROBS)
    mean = waits.selectExpr("avg(seconds_since_last_txn) AS mean")
    return rounded(mean.crossJoin(F.broadcast(points)), "mean", *PROBS)
