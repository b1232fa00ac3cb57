"""Many models x many splits x many policies, as grouped jobs over one long score frame."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions import columns as c
from txnlens.functions.schema import ALERT_COST, CAPTURE_RATE, FP_AMOUNT_RATE
from txnlens.operators import frontier as fr
from txnlens.operators import metrics
from txnlens.operators.prefix import union_all
from txnlens.operators.splits import stage
from txnlens.sources.scratch import stored

MODELS = {"main": "score", "weak": "score_b"}
POLICIES = ["top1", "fpr1", "nbv", "ev", "fpr0.1", "fpr0.25", "fpr0.5", "fpr2"]
BUDGETS = {"fpr1": 0.01, "fpr0.1": 0.001, "fpr0.25": 0.0025, "fpr0.5": 0.005, "fpr2": 0.02}

# A universe names the part of every row; thresholds are chosen on 'policy', judged on 'test'.
# A split without a policy part chooses on its training rows.
UNIVERSES = {
    "four_stage": stage(["train", "calibration", "policy", "test"], (480, 552, 600)),
    "three_stage": stage(["train", "policy", "test"], (480, 600)),
    "alternative": stage(["train", "policy", "test"], (520, 631)),
    "single_cut": stage(["policy", "test"], (355,)),
    "random80": f"CASE WHEN {c.md5_unit(repr('42'), 'row_num')} < 0.8D THEN 'policy' ELSE 'test' END",
}
# The same universes for DuckDB, over a table ``scored``.
UNIVERSE_SQL = """,
uni AS (
  SELECT *, 'four_stage' AS universe, CASE WHEN step <= 480 THEN 'train' WHEN step <= 552 THEN 'calibration'
    WHEN step <= 600 THEN 'policy' ELSE 'test' END AS part FROM scored
  UNION ALL SELECT *, 'three_stage', CASE WHEN step <= 480 THEN 'train' WHEN step <= 600 THEN 'policy' ELSE 'test' END FROM scored
  UNION ALL SELECT *, 'alternative', CASE WHEN step <= 520 THEN 'train' WHEN step <= 631 THEN 'policy' ELSE 'test' END FROM scored
  UNION ALL SELECT *, 'single_cut', CASE WHEN step <= 355 THEN 'policy' ELSE 'test' END FROM scored
  UNION ALL SELECT *, 'random80', CASE WHEN CAST('0x' || substr(md5('42|' || row_num), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.8::DOUBLE
    THEN 'policy' ELSE 'test' END FROM scored)"""

KEYS = ["model", "universe"]


def in_universes(scored: DataFrame) -> DataFrame:
    """Each row once per universe, with its part there (a handful of copies, no join)."""
    tags = ", ".join(f"named_struct('universe', '{u}', 'part', {expr})" for u, expr in UNIVERSES.items())
    return scored.selectExpr("*", f"inline(array({tags}))")


def by_model(rows: DataFrame, models: dict[str, str] = MODELS) -> DataFrame:
    """Long form: one row per model, ``score`` holding that model's score."""
    tags = ", ".join(f"named_struct('model', '{m}', 'score', {expr})" for m, expr in models.items())
    kept = [x for x in rows.columns if x not in ("score", "score_b", "k", "u")]
    return rows.selectExpr(*kept, f"inline(array({tags}))")


def plan(scored: DataFrame) -> DataFrame:
    """All planned runs with the size of the parts each would use."""
    sizes = in_universes(scored.select("row_num", "step")).groupBy("universe").agg(
        F.expr("count_if(part = 'policy') AS policy_rows"), F.expr("count_if(part = 'test') AS test_rows")
    )
    models = ", ".join(f"'{m}'" for m in MODELS)
    policies = ", ".join(f"'{p}'" for p in POLICIES)
    return sizes.selectExpr("*", f"explode(array({models})) AS model").selectExpr(
        "*", f"explode(array({policies})) AS policy"
    ).selectExpr(
        "concat_ws('__', model, universe, policy) AS run_id", "model", "universe", "policy", "policy_rows", "test_rows",
        "policy_rows > 0 AND test_rows > 0 AS runnable",
    )


def outcomes_at(points: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion and money of every threshold, from per-score points instead of raw rows.

    ``thresholds`` has one row per (keys, policy): its size is set by the configuration.
    """
    cuts = thresholds.selectExpr(*keys, "policy", "threshold AS cut")
    hit = "threshold >= cut"
    money = "coalesce(CAST(sum({x}) FILTER (WHERE {w}) AS DOUBLE), 0D) AS {n}"
    return points.join(F.broadcast(cuts), keys).groupBy(*keys, "policy", F.col("cut").alias("threshold")).agg(
        F.expr(f"coalesce(sum(fp) FILTER (WHERE NOT ({hit})), 0L) AS tn"),
        F.expr(f"coalesce(sum(fp) FILTER (WHERE {hit}), 0L) AS fp"),
        F.expr(f"coalesce(sum(tp) FILTER (WHERE NOT ({hit})), 0L) AS fn"),
        F.expr(f"coalesce(sum(tp) FILTER (WHERE {hit}), 0L) AS tp"),
        F.expr(money.format(x="tp_amt", w=hit, n="captured_amount")),
        F.expr(money.format(x="tp_amt", w="true", n="total_positive_amount")),
        F.expr(money.format(x="fp_amt", w=hit, n="fp_amount")),
        F.expr(money.format(x="fp_amt", w="true", n="total_legit_amount")),
    )


def factorial_eval(scored: DataFrame) -> DataFrame:
    """Thresholds from the policy part, metrics on the test part, for every combination."""
    rows = by_model(in_universes(scored)).where("part IN ('policy', 'test')")
    # One pass over the rows; everything that follows reads the much smaller points.
    points = stored(fr.score_points(rows, [*KEYS, "part"]), "points")
    policy, test = (points.where(f"part = '{part}'").drop("part") for part in ("policy", "test"))
    chosen_on = fr.frontier_of(policy, KEYS)
    budgets = fr.fpr_budgets(chosen_on, tuple(BUDGETS.values()), KEYS)
    names = " ".join(f"WHEN budget = {b!r}D THEN '{p}'" for p, b in BUDGETS.items())
    thresholds = union_all([
        budgets.selectExpr(*KEYS, f"CASE {names} END AS policy", "threshold"),
        fr.nbv_subsample(chosen_on, keys=KEYS).selectExpr(*KEYS, "'nbv' AS policy", "threshold"),
        fr.capacity_cut(fr.frontier_of(test, KEYS), keys=KEYS).selectExpr(*KEYS, "'top1' AS policy", "threshold"),
    ])
    cut = outcomes_at(test, thresholds, KEYS)
    alerted = metrics.with_alert(rows.where("part = 'test'"), f"{metrics.expected_value('score')} > 0")
    ev = metrics.outcome(alerted, KEYS)
    together = cut.unionByName(ev.selectExpr("*", "'ev' AS policy", "0D AS threshold"))
    ranks = fr.ranking_of(test, KEYS).select(*KEYS, "average_precision", "roc_auc")
    # One ranking row per model and universe: set by the configuration.
    return metrics.guarded_rates(together.join(F.broadcast(ranks), KEYS))


# --- leaderboards ------------------------------------------------------------
def leaderboard(results: DataFrame, policy: str = "fpr1") -> DataFrame:
    w = "OVER (PARTITION BY universe ORDER BY {m} DESC)"
    return results.where(F.col("policy") == policy).selectExpr(
        "model", "universe", "value_recall", "average_precision",
        f"dense_rank() {w.format(m='value_recall')} AS rank_value_recall",
        f"dense_rank() {w.format(m='average_precision')} AS rank_average_precision",
    )


def rank_matrix(board: DataFrame) -> DataFrame:
    return board.groupBy("model").pivot("universe", list(UNIVERSES)).agg(F.expr("max(rank_value_recall)"))


def robustness(board: DataFrame) -> DataFrame:
    """Rank statistics per model over the universes (few values each)."""
    return board.groupBy("model").agg(
        F.expr("avg(rank_value_recall) AS mean_rank"),
        F.expr("median(rank_value_recall) AS median_rank"),
        F.expr("count_if(rank_value_recall = 1) AS win_count"),
        F.expr("count_if(rank_value_recall <= 3) AS top3_count"),
        F.expr("stddev_samp(rank_value_recall) AS rank_std"),
    ).orderBy("mean_rank", F.desc("win_count"))


def reproduction(results: DataFrame, reported: dict[str, float], tolerance: float = 0.08) -> DataFrame:
    """Recomputed average precision beside the reported one."""
    names = " ".join(f"WHEN '{m}' THEN {v!r}D" for m, v in reported.items())
    return results.selectExpr(
        "model", "average_precision AS recomputed", f"CASE model {names} END AS reported"
    ).selectExpr("*", "recomputed - reported AS delta", f"abs(recomputed - reported) <= {tolerance} AS pass")


def daily_stability(scored: DataFrame, share: float = 0.01) -> DataFrame:
    """Per model and day: metrics of that day's own top share; days without positives drop out."""
    rows = by_model(scored.selectExpr("*", f"{c.plain_day()} AS day"))
    keys = ["model", "day"]
    points = stored(fr.score_points(rows, keys), "points")
    cuts = fr.capacity_cut(fr.frontier_of(points, keys), share, keys)
    totals = outcomes_at(points, cuts.selectExpr(*keys, "'top' AS policy", "threshold"), keys)
    ranks = fr.ranking_of(points, keys).select(*keys, "average_precision", "roc_auc")
    return metrics.guarded_rates(totals.where("tp + fn > 0").join(ranks, keys)).drop("policy")


# --- bootstrap ---------------------------------------------------------------
# Cumulative probabilities of a Poisson(1) count, as far as double precision tells them from 1.
POISSON_1 = tuple(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(17))


def poisson_weight() -> str:
    """Poisson(1) count for a uniform number in ``_u``."""
    whens = " ".join(f"WHEN _u < {p!r}D THEN {i}" for i, p in enumerate(POISSON_1))
    return f"CASE {whens} ELSE {len(POISSON_1)} END"


def _summary(value: str, name: str) -> list:
    return [
        F.expr(f"avg({value}) AS mean_{name}"),
        F.expr(f"percentile({value}, 0.025) AS {name}_low"),
        F.expr(f"percentile({value}, 0.975) AS {name}_high"),
    ]


def paired_bootstrap(scored: DataFrame, replicates: int = 200, share: float = 0.01, seed: str = "boot") -> DataFrame:
    """Difference in value recall of two scores under row resampling.

    Each row gets an independent Poisson(1) weight per replicate.  Only positives enter the
    statistic, so only they are repeated, and the sums combine before the shuffle.
    """
    models = by_model(scored)
    cuts = fr.capacity_cut(fr.exact_frontier(models, ["model"]), share, ["model"])
    pair = F.broadcast(cuts.selectExpr(  # one row
        "max(threshold) FILTER (WHERE model = 'main') AS cut_a", "max(threshold) FILTER (WHERE model = 'weak') AS cut_b"))
    hits = scored.where("y = 1").crossJoin(pair).selectExpr(
        "row_num", f"{c.money('amount')} AS amt", "score >= cut_a AS a", "score_b >= cut_b AS b")
    drawn = hits.selectExpr("*", f"explode(sequence(1, {replicates})) AS rep").selectExpr(
        "amt", "a", "b", "rep", f"{c.md5_unit(repr(seed), 'row_num', 'rep')} AS _u"
    ).selectExpr("a", "b", "rep", f"amt * {poisson_weight()} AS w_amt")
    per_rep = drawn.groupBy("rep").agg(
        F.expr("CAST(sum(w_amt) AS DOUBLE) AS total"),
        F.expr("coalesce(CAST(sum(w_amt) FILTER (WHERE a) AS DOUBLE), 0D) AS cap_a"),
        F.expr("coalesce(CAST(sum(w_amt) FILTER (WHERE b) AS DOUBLE), 0D) AS cap_b"),
    ).where("total > 0").selectExpr("(cap_a - cap_b) / total AS delta")
    # One row per replicate from here on.
    return per_rep.agg(F.expr("count(1) AS replicates"), *_summary("delta", "delta"),
                       F.expr("avg(CASE WHEN delta <= 0 THEN 1D ELSE 0D END) AS p_value"))


def block_bootstrap(scored: DataFrame, replicates: int = 200, share: float = 0.01, seed: str = "block") -> DataFrame:
    """The same comparison, and net value, resampling whole days instead of rows."""
    rows = by_model(scored.selectExpr("*", f"{c.plain_day()} AS day"))
    cuts = fr.capacity_cut(fr.exact_frontier(rows, ["model"]), share, ["model"])
    hit = rows.join(F.broadcast(cuts.select("model", F.col("threshold").alias("cut"))), "model").selectExpr(
        "model", "day", "y", "amount", "score >= cut AS alert")
    daily = hit.groupBy("model", "day").agg(
        F.expr(f"{c.money_sum('amount', 'alert AND y = 1')} AS cap"),
        F.expr(f"{c.money_sum('amount', 'alert AND y = 0')} AS fa"),
        F.expr("count_if(alert) AS alerts"),
        F.expr(f"{c.money_sum('amount', 'y = 1')} AS total"),
    )
    nbv = f"{CAPTURE_RATE}D * cap - {FP_AMOUNT_RATE}D * fa - {ALERT_COST}D * alerts"
    paired = daily.groupBy("day").agg(
        F.expr(f"sum(CASE model WHEN 'main' THEN {nbv} ELSE -({nbv}) END) AS d_nbv"),
        F.expr("sum(CASE model WHEN 'main' THEN cap ELSE -cap END) AS d_cap"),
        F.expr("max(total) AS total"),
    )
    drawn = paired.selectExpr("*", f"explode(sequence(1, {replicates})) AS rep").selectExpr(
        "*", f"{c.md5_unit(repr(seed), 'day', 'rep')} AS _u").selectExpr("*", f"{poisson_weight()} AS w")
    per_rep = drawn.groupBy("rep").agg(
        F.expr("sum(w * d_nbv) AS nbv"), F.expr("sum(w * d_cap) AS cap"), F.expr("sum(w * total) AS total")
    ).where("total > 0").selectExpr("nbv", "cap / total AS recall")
    return per_rep.agg(F.expr("count(1) AS replicates"), *_summary("nbv", "nbv"), *_summary("recall", "recall"))


def blend(weights: dict[str, float]) -> str:
    """Weighted sum of model scores as an expression over the wide score frame."""
    return " + ".join(f"{w!r}D * {col}" for col, w in weights.items())


def pareto_points(results: DataFrame, by: str = "universe") -> DataFrame:
    """Runs no other run of the same universe beats on both fpr and value recall.

    Best value recall per fpr, then a running maximum over rising fpr: no pairwise comparison.
    """
    best = results.groupBy(by, "fpr").agg(F.expr("max(value_recall) AS best"))
    lower = best.selectExpr(
        by, "fpr", "best",
        f"max(best) OVER (PARTITION BY {by} ORDER BY fpr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below",
    )
    keep = lower.where("below IS NULL OR best > below").selectExpr(by, "fpr", "best AS value_recall")
    return results.join(keep, [by, "fpr", "value_recall"], "left_semi")


def sensitivity(results: DataFrame, authored: str, repaired: str, policy: str = "fpr1") -> DataFrame:
    """What a leaky evaluation adds: value recall there minus value recall in the repaired one."""
    rows = results.where(F.col("policy") == policy)
    return rows.groupBy("model").agg(
        F.expr(f"max(value_recall) FILTER (WHERE universe = '{authored}') AS authored_value_recall"),
        F.expr(f"max(value_recall) FILTER (WHERE universe = '{repaired}') AS repaired_value_recall"),
    ).selectExpr("*", "authored_value_recall - repaired_value_recall AS delta")
