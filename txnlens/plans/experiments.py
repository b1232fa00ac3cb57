"""Factorial runs, leaderboards, stability and bootstrap."""

from __future__ import annotations

from txnlens.operators import experiments as ex
from txnlens.operators import frontier, splits
from txnlens.plans.encoding import FOLDS
from txnlens.plans.evaluation import rank_ctes
from txnlens.plans.inputs import SCORED, rounded, scored, with_ctes
from txnlens.plans.policy import frontier_ctes
from txnlens.plans.registry import query
from txnlens.sources.scratch import stored

LONG = SCORED + ex.UNIVERSE_SQL + """,
ml AS (SELECT row_num, step, amount, y, universe, part, 'main' AS model, score FROM uni
  UNION ALL SELECT row_num, step, amount, y, universe, part, 'weak', score_b FROM uni),
pol AS (SELECT * FROM ml WHERE part = 'policy'), tst AS (SELECT * FROM ml WHERE part = 'test')"""
K = ("model", "universe")
D = "::DOUBLE"


def guarded(src: str) -> str:
    """Rates over tn, fp, fn, tp and the four money totals."""
    return f"""SELECT *, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall, fp / greatest(fp + tn, 1) AS fpr,
      cap / greatest(pa, 1e-6) AS value_recall, fa / greatest(la, 1e-6) AS legit_rate, cap - 0.2{D} * fa - 5 * (tp + fp) AS net_value FROM {src}"""


def outcome_sql(hit: str, keys: str, src: str) -> str:
    m = "coalesce(sum(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE {w}), 0)::DOUBLE"
    return f"""SELECT {keys}, count(*) FILTER (WHERE NOT ({hit}) AND y = 0) AS tn, count(*) FILTER (WHERE ({hit}) AND y = 0) AS fp,
      count(*) FILTER (WHERE NOT ({hit}) AND y = 1) AS fn, count(*) FILTER (WHERE ({hit}) AND y = 1) AS tp,
      {m.format(w=f'({hit}) AND y = 1')} AS cap, {m.format(w='y = 1')} AS pa, {m.format(w=f'({hit}) AND y = 0')} AS fa,
      {m.format(w='y = 0')} AS la FROM {src} GROUP BY {keys}"""


FACTORIAL = LONG + frontier_ctes("pol", K, name="fp") + rank_ctes("tst", K, name="ft") + f""",
bud AS (SELECT * FROM (VALUES ('fpr1', 0.01), ('fpr0.1', 0.001), ('fpr0.25', 0.0025), ('fpr0.5', 0.005), ('fpr2', 0.02)) v(policy, b)),
rk AS (SELECT *, row_number() OVER (PARTITION BY model, universe ORDER BY threshold DESC) AS r, count(*) OVER (PARTITION BY model, universe) AS n FROM fp),
kth AS (SELECT *, row_number() OVER (PARTITION BY model, universe ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY model, universe) AS n FROM tst),
thr AS (SELECT model, universe, policy, coalesce(arg_max(threshold, (captured_amount, threshold)) FILTER (WHERE fpr <= b{D}), max(threshold)) AS threshold
    FROM fp, bud GROUP BY model, universe, policy
  UNION ALL SELECT model, universe, 'nbv', arg_max(threshold, (net_value, threshold)) FROM rk WHERE (r - 1) % greatest(1, n // 50) = 0 GROUP BY model, universe
  UNION ALL SELECT model, universe, 'top1', score FROM kth WHERE r = ceil(0.01{D} * n)
  UNION ALL SELECT DISTINCT model, universe, 'ev', 0.0 FROM tst),
jn AS (SELECT t.*, h.policy, h.threshold, CASE WHEN h.policy = 'ev' THEN 1.2{D} * score * amount - 0.2{D} * amount - 5 > 0
    ELSE score >= h.threshold END AS hit FROM tst t JOIN thr h USING (model, universe)),
oc AS ({outcome_sql('hit', 'model, universe, policy, threshold', 'jn')}),
gr AS ({guarded('oc')}),
res AS (SELECT gr.*, 2 * precision * recall / greatest(precision + recall, 1e-6) AS f1, m.average_precision, m.roc_auc
  FROM gr JOIN ft_m m USING (model, universe))"""
RENAMED = {"captured_amount": "cap", "total_positive_amount": "pa", "fp_amount": "fa", "total_legit_amount": "la",
           "legit_amount_alerted_rate": "legit_rate"}
FIELDS = ["captured_amount", "total_positive_amount", "fp_amount", "total_legit_amount", "precision", "recall", "fpr",
          "value_recall", "legit_amount_alerted_rate", "net_value", "f1", "average_precision", "roc_auc"]
SHOWN = ", ".join(f"rnd({RENAMED.get(f, f)}, 6) AS {f}" for f in FIELDS)


def results(spark, d):
    return ex.factorial_eval(scored(spark, d))


@query("factorial_eval", with_ctes(FACTORIAL, f"SELECT model, universe, policy, rnd(threshold, 6) AS threshold, tn, fp, fn, tp, {SHOWN} FROM res"))
def factorial_eval(spark, d):
    return rounded(results(spark, d), "threshold", *FIELDS)


# Reported average precision the recomputation is compared with (configuration of this query).
REPORTED = {"main": 0.10, "weak": 0.05}


@query(
    "native_reproduction",
    with_ctes(SCORED + """, ml AS (SELECT y, amount, score, 'main' AS model FROM scored UNION ALL SELECT y, amount, score_b, 'weak' FROM scored)"""
              + rank_ctes("ml", ("model",)), """, r AS (SELECT model, average_precision AS a, CASE model WHEN 'main' THEN 0.10 ELSE 0.05 END::DOUBLE AS reported FROM fr_m)
      SELECT model, rnd(a, 6) AS recomputed, reported, rnd(a - reported, 6) AS delta, abs(a - reported) <= 0.08::DOUBLE AS pass FROM r"""),
)
def native_reproduction(spark, d):
    ranked = frontier.ranking_metrics(ex.by_model(scored(spark, d)), ["model"])
    return rounded(ex.reproduction(ranked, REPORTED), "recomputed", "delta")


BOARD = FACTORIAL + """, lb AS (SELECT model, universe, value_recall, average_precision,
  dense_rank() OVER (PARTITION BY universe ORDER BY value_recall DESC) AS rank_value_recall,
  dense_rank() OVER (PARTITION BY universe ORDER BY average_precision DESC) AS rank_average_precision FROM res WHERE policy = 'fpr1')"""


def board(spark, d):
    return ex.leaderboard(results(spark, d))


@query("leaderboard", with_ctes(BOARD, """SELECT model, universe, rnd(value_recall, 6) AS value_recall, rnd(average_precision, 6) AS average_precision,
  CAST(rank_value_recall AS INTEGER) AS rank_value_recall, CAST(rank_average_precision AS INTEGER) AS rank_average_precision FROM lb"""))
def leaderboard(spark, d):
    return rounded(board(spark, d), "value_recall", "average_precision")


@query("rank_matrix", with_ctes(BOARD, "SELECT model, " + ", ".join(
    f"CAST(max(rank_value_recall) FILTER (WHERE universe = '{u}') AS INTEGER) AS {u}" for u in ex.UNIVERSES) + " FROM lb GROUP BY model"))
def rank_matrix(spark, d):
    return ex.rank_matrix(board(spark, d))


@query(
    "robustness",
    with_ctes(BOARD, """SELECT model, rnd(avg(rank_value_recall), 6) AS mean_rank, rnd(median(rank_value_recall), 6) AS median_rank,
      count(*) FILTER (WHERE rank_value_recall = 1) AS win_count, count(*) FILTER (WHERE rank_value_recall <= 3) AS top3_count,
      rnd(stddev_samp(rank_value_recall), 6) AS rank_std FROM lb GROUP BY model"""),
)
def robustness(spark, d):
    return rounded(ex.robustness(board(spark, d)), "mean_rank", "median_rank", "rank_std")


DAILY = SCORED + """,
ml AS (SELECT row_num, step // 24 AS day, amount, y, 'main' AS model, score FROM scored
  UNION ALL SELECT row_num, step // 24, amount, y, 'weak', score_b FROM scored)""" + rank_ctes("ml", ("model", "day"), name="fd") + f""",
kd AS (SELECT *, row_number() OVER (PARTITION BY model, day ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY model, day) AS n FROM ml),
cut AS (SELECT model, day, score AS threshold FROM kd WHERE r = ceil(0.01::DOUBLE * n)),
jn AS (SELECT ml.*, threshold, score >= threshold AS hit FROM ml JOIN cut USING (model, day)),
oc AS ({outcome_sql('hit', 'model, day, threshold', 'jn')}), gr AS ({guarded('oc')}),
res AS (SELECT gr.*, 2 * precision * recall / greatest(precision + recall, 1e-6) AS f1, m.average_precision, m.roc_auc
  FROM gr JOIN fd_m m USING (model, day) WHERE tp + fn > 0)"""


@query("daily_stability", with_ctes(DAILY, f"SELECT model, day, rnd(threshold, 6) AS threshold, tn, fp, fn, tp, {SHOWN} FROM res"))
def daily_stability(spark, d):
    return rounded(ex.daily_stability(scored(spark, d)), "threshold", *FIELDS)


POISSON = "CASE " + " ".join(f"WHEN u < {p!r}::DOUBLE THEN {i}" for i, p in enumerate(ex.POISSON_1)) + f" ELSE {len(ex.POISSON_1)} END"
CUTS = SCORED + """,
n AS (SELECT CAST(ceil(0.01::DOUBLE * count(*)) AS BIGINT) AS k FROM scored),
ra AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS r FROM scored),
rb AS (SELECT score_b, row_number() OVER (ORDER BY score_b DESC) AS r FROM scored),
cuts AS (SELECT (SELECT score FROM ra, n WHERE r = k) AS ca, (SELECT score_b FROM rb, n WHERE r = k) AS cb),
reps AS (SELECT unnest(range(1, 201)) AS rep)"""


@query(
    "paired_bootstrap",
    with_ctes(CUTS, f""", w AS (SELECT rep, CAST(amount AS DECIMAL(18,2)) AS amt, score >= ca AS a, score_b >= cb AS b,
        CAST('0x' || substr(md5('boot|' || row_num || '|' || rep), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM scored, cuts, reps WHERE y = 1),
      p AS (SELECT rep, sum(amt * {POISSON})::DOUBLE AS total, coalesce(sum(amt * {POISSON}) FILTER (WHERE a), 0)::DOUBLE AS cap_a,
        coalesce(sum(amt * {POISSON}) FILTER (WHERE b), 0)::DOUBLE AS cap_b FROM w GROUP BY rep),
      dl AS (SELECT (cap_a - cap_b) / total AS delta FROM p WHERE total > 0)
      SELECT count(*) AS replicates, rnd(avg(delta), 6) AS mean_delta, rnd(quantile_cont(delta, 0.025), 6) AS delta_low,
        rnd(quantile_cont(delta, 0.975), 6) AS delta_high, rnd(avg((delta <= 0)::INTEGER), 6) AS p_value FROM dl"""),
)
def paired_bootstrap(spark, d):
    return rounded(ex.paired_bootstrap(scored(spark, d)), "mean_delta", "delta_low", "delta_high", "p_value")


@query(
    "block_bootstrap",
    with_ctes(CUTS, f""", dd AS (SELECT step // 24 AS day, sum(CAST(amount AS DECIMAL(18,2)) * (CASE WHEN y = 1 THEN (score >= ca)::INT - (score_b >= cb)::INT ELSE 0 END))::DOUBLE AS d_cap,
        sum(CAST(amount AS DECIMAL(18,2)) * (CASE WHEN y = 0 THEN (score >= ca)::INT - (score_b >= cb)::INT ELSE 0 END))::DOUBLE AS d_fa,
        sum((score >= ca)::INT - (score_b >= cb)::INT) AS d_n, coalesce(sum(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE y = 1), 0)::DOUBLE AS total
        FROM scored, cuts GROUP BY 1),
      w AS (SELECT *, CAST('0x' || substr(md5('block|' || day || '|' || rep), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM dd, reps),
      p AS (SELECT rep, sum({POISSON} * (d_cap - 0.2::DOUBLE * d_fa - 5 * d_n)) AS nbv, sum({POISSON} * d_cap) / sum({POISSON} * total) AS recall
        FROM w GROUP BY rep HAVING sum({POISSON} * total) > 0)
      SELECT count(*) AS replicates, rnd(avg(nbv), 6) AS mean_nbv, rnd(quantile_cont(nbv, 0.025), 6) AS nbv_low, rnd(quantile_cont(nbv, 0.975), 6) AS nbv_high,
        rnd(avg(recall), 6) AS mean_recall, rnd(quantile_cont(recall, 0.025), 6) AS recall_low, rnd(quantile_cont(recall, 0.975), 6) AS recall_high FROM p"""),
)
def block_bootstrap(spark, d):
    return rounded(ex.block_bootstrap(scored(spark, d)), "mean_nbv", "nbv_low", "nbv_high", "mean_recall", "recall_low", "recall_high")


@query(
    "ensemble_blend",
    with_ctes(SCORED, """SELECT row_num, rnd(0.7::DOUBLE * score + 0.3::DOUBLE * score_b, 6) AS blend2,
      rnd(0.34::DOUBLE * score + 0.33::DOUBLE * score_b + 0.33::DOUBLE * (score + score_b) / 2, 6) AS blend3 FROM scored"""),
)
def ensemble_blend(spark, d):
    rows = scored(spark, d).selectExpr("*", "(score + score_b) / 2 AS score_c")
    two = ex.blend({"score": 0.7, "score_b": 0.3})
    three = ex.blend({"score": 0.34, "score_b": 0.33, "score_c": 0.33})
    return rounded(rows.selectExpr("row_num", f"{two} AS blend2", f"{three} AS blend3"), "blend2", "blend3")


@query(
    "pareto_points",
    with_ctes(FACTORIAL, """SELECT model, universe, policy, rnd(fpr, 6) AS fpr, rnd(value_recall, 6) AS value_recall FROM res r
      WHERE NOT EXISTS (SELECT 1 FROM res q WHERE q.universe = r.universe AND q.fpr <= r.fpr AND q.value_recall >= r.value_recall
        AND (q.fpr < r.fpr OR q.value_recall > r.value_recall))"""),
)
def pareto_points(spark, d):
    out = ex.pareto_points(results(spark, d)).select("model", "universe", "policy", "fpr", "value_recall")
    return rounded(out, "fpr", "value_recall")


@query(
    "governance_sensitivity",
    with_ctes(FACTORIAL, """, s AS (SELECT model, max(value_recall) FILTER (WHERE universe = 'random80') AS a,
        max(value_recall) FILTER (WHERE universe = 'three_stage') AS r FROM res WHERE policy = 'fpr1' GROUP BY model)
      SELECT model, rnd(a, 6) AS authored_value_recall, rnd(r, 6) AS repaired_value_recall, rnd(a - r, 6) AS delta FROM s"""),
)
def governance_sensitivity(spark, d):
    out = ex.sensitivity(results(spark, d), "random80", "three_stage")
    return rounded(out, "authored_value_recall", "repaired_value_recall", "delta")


@query(
    "walk_forward_embargo",
    with_ctes(SCORED + FOLDS.format(e="(0), (24), (168)") + """,
      learnt AS (SELECT embargo, cut, txn_type, step % 24 AS hour, (sum(y) + 1)::DOUBLE / (count(*) + 100) AS rate
        FROM scored JOIN folds ON step <= train_end GROUP BY ALL),
      ft AS (SELECT f.embargo, f.cut, y, amount, coalesce(l.rate, 0) AS score FROM scored s
        JOIN folds f ON s.step > f.cut AND s.step <= f.test_end LEFT JOIN learnt l
        ON l.embargo = f.embargo AND l.cut = f.cut AND l.txn_type = s.txn_type AND l.hour = s.step % 24)"""
              + rank_ctes("ft", ("embargo", "cut")), """SELECT embargo, rnd(avg(average_precision), 6) AS mean, rnd(stddev_samp(average_precision), 6) AS std,
      rnd(min(average_precision), 6) AS min, rnd(max(average_precision), 6) AS max FROM fr_m WHERE positives > 0 AND positives < rows GROUP BY embargo"""),
)
def walk_forward_embargo(spark, d):
    folds = splits.fold_table(spark, embargos=splits.EMBARGOS)
    scores = stored(splits.fold_scores(scored(spark, d), folds), "fold-scores")
    ranked = frontier.ranking_metrics(scores, ["embargo", "cut"])
    return rounded(splits.embargo_summary(ranked), "mean", "std", "min", "max")
