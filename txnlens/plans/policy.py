"""Frontiers, grids and threshold policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnlens.operators import experiments, frontier, metrics
from txnlens.operators.prefix import quantiles
from txnlens.plans.inputs import SCORED, rounded, scored, with_ctes
from txnlens.plans.registry import query


def frontier_ctes(src: str = "scored", keys: tuple[str, ...] = (), score: str = "score", name: str = "fr") -> str:
    k = "".join(f"{x}, " for x in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f""",
{name}_p AS (SELECT {k}{score} AS threshold, count(*) FILTER (WHERE y = 1) AS tp, count(*) FILTER (WHERE y = 0) AS fp,
    coalesce(sum(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE y = 1), 0)::DECIMAL(38,2) AS ta,
    coalesce(sum(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE y = 0), 0)::DECIMAL(38,2) AS fa
  FROM {src} GROUP BY {k}{score}),
{name}_c AS (SELECT {k}threshold, tp AS pos, fp AS neg, (sum(tp) OVER w)::BIGINT AS tp, (sum(fp) OVER w)::BIGINT AS fp,
    (sum(ta) OVER w)::DOUBLE AS ta, (sum(fa) OVER w)::DOUBLE AS fa,
    (sum(tp) OVER t)::BIGINT AS np, (sum(fp) OVER t)::BIGINT AS nn, (sum(ta) OVER t)::DOUBLE AS npa, (sum(fa) OVER t)::DOUBLE AS nna
  FROM {name}_p WINDOW w AS ({part}ORDER BY threshold DESC), t AS ({part.strip()})),
{name} AS (SELECT {k}threshold, pos, neg, tp, fp, np - tp AS fn, nn - fp AS tn, np, nn, fp / greatest(nn, 1) AS fpr,
    tp / greatest(np, 1) AS recall_count, ta AS captured_amount, CASE WHEN npa > 0 THEN ta / npa ELSE 0 END AS value_recall,
    fa AS legit_amount_alerted, CASE WHEN nna > 0 THEN fa / nna ELSE 0 END AS legit_amount_alerted_rate,
    tp / (tp + fp) AS precision, ta - 0.2::DOUBLE * fa - 5 * (tp + fp) AS net_value FROM {name}_c)"""


FR = SCORED + frontier_ctes()
DOUBLES = ["fpr", "recall_count", "captured_amount", "value_recall", "legit_amount_alerted",
           "legit_amount_alerted_rate", "precision", "net_value"]


def front(spark, d):
    return frontier.exact_frontier(scored(spark, d))


@query("exact_frontier", with_ctes(FR, "SELECT threshold, tp, fp, fn, tn, " + ", ".join(f"rnd({x}, 6) AS {x}" for x in DOUBLES) + " FROM fr"))
def exact_frontier(spark, d):
    return rounded(front(spark, d).drop("rank"), *DOUBLES)


_LO, _HI, _N = frontier.GRID
_STEP = (_HI - _LO) / (_N - 1)
GRID = SCORED + f""",
g AS (SELECT CASE WHEN i = {_N - 1} THEN {_HI}::DOUBLE ELSE {_LO}::DOUBLE + i * {_STEP!r}::DOUBLE END AS threshold
  FROM (SELECT unnest(range({_N})) AS i)),
gc AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND y = 0) AS fp,
    count(*) FILTER (WHERE score < threshold AND y = 1) AS fn, count(*) FILTER (WHERE score < threshold AND y = 0) AS tn,
    coalesce(sum(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE score >= threshold AND y = 1), 0)::DOUBLE AS tp_amount,
    coalesce(sum(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE score >= threshold AND y = 0), 0)::DOUBLE AS fp_amount,
    sum(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE y = 1)::DOUBLE AS pa
  FROM g, scored GROUP BY threshold),
gm AS (SELECT threshold, tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END::DOUBLE AS precision,
    tp / (tp + fn) AS recall, fp / (fp + tn) AS fpr, tp_amount, fp_amount, tp_amount / pa AS recall_amount,
    tp_amount - 0.2::DOUBLE * fp_amount - 5 * (tp + fp) AS net_value FROM gc),
grid AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM gm)"""
GRID_DOUBLES = ["threshold", "precision", "recall", "fpr", "tp_amount", "fp_amount", "recall_amount", "f1", "net_value"]


def grid(spark, d):
    return frontier.threshold_grid(scored(spark, d))


@query("threshold_grid", with_ctes(GRID, "SELECT tp, fp, fn, tn, " + ", ".join(f"rnd({x}, 6) AS {x}" for x in GRID_DOUBLES) + " FROM grid"))
def threshold_grid(spark, d):
    return rounded(grid(spark, d), *GRID_DOUBLES)


def _argmax_sql(ctes: str, table: str, metric: str, where: str = "true", fallback: str | None = None, tie: str = "-threshold") -> str:
    best = f"arg_max(threshold, ({metric}, {tie})) FILTER (WHERE {where})"
    other = f", arg_max(threshold, ({fallback}, {tie}))" if fallback else ""
    return with_ctes(ctes, f"SELECT rnd(coalesce({best}{other}), 6) AS threshold FROM {table}")


@query("t_best_f1", _argmax_sql(GRID, "grid", "f1"))
def t_best_f1(spark, d):
    return rounded(frontier.argmax(grid(spark, d), "f1"), "threshold")


@query("t_best_nbv", _argmax_sql(GRID, "grid", "net_value"))
def t_best_nbv(spark, d):
    return rounded(frontier.argmax(grid(spark, d), "net_value"), "threshold")


@query(
    "t_min_precision",
    with_ctes(GRID, " UNION ALL ".join(
        f"""SELECT {p}::DOUBLE AS floor, rnd(coalesce(arg_max(threshold, (recall, -threshold)) FILTER (WHERE precision >= {p}::DOUBLE),
          arg_max(threshold, (f1, -threshold))), 6) AS threshold FROM grid""" for p in (0.8, 0.9))),
)
def t_min_precision(spark, d):
    g = grid(spark, d)
    picks = [frontier.argmax(g, "recall", where=f"precision >= {p}D", fallback="f1").selectExpr(f"{p}D AS floor", "threshold")
             for p in (0.8, 0.9)]
    return rounded(picks[0].unionByName(picks[1]), "threshold")


@query("t_min_value_recall", _argmax_sql(GRID, "grid", "precision", "recall_amount >= 0.8::DOUBLE", "f1"))
def t_min_value_recall(spark, d):
    return rounded(frontier.argmax(grid(spark, d), "precision", where="recall_amount >= 0.8D", fallback="f1"), "threshold")


F1 = "(CASE WHEN precision + recall_count > 0 THEN 2 * precision * recall_count / (precision + recall_count) ELSE 0 END)"


@query("t_min_recall", _argmax_sql(FR, "fr", "precision", "recall_count >= 0.5::DOUBLE", F1))
def t_min_recall(spark, d):
    out = frontier.argmax(front(spark, d), "precision", where="recall_count >= 0.5D", fallback=frontier.fbeta(1.0))
    return rounded(out, "threshold")


BETAS = (0.5, 1.0, 1.75, 2.0, 3.0)


@query(
    "t_fbeta",
    with_ctes(FR, """, b AS (SELECT unnest([0.5, 1.0, 1.75, 2.0, 3.0])::DOUBLE AS beta),
      f AS (SELECT beta, threshold, CASE WHEN beta * beta * precision + recall_count > 0
        THEN (1 + beta * beta) * precision * recall_count / (beta * beta * precision + recall_count) ELSE 0 END AS f FROM fr, b),
      m AS (SELECT beta, max(f) AS best FROM f GROUP BY beta)
    SELECT beta, rnd(max(threshold), 6) AS threshold, rnd(max(best), 6) AS fbeta FROM f JOIN m USING (beta)
      WHERE f >= best - 1e-12 * abs(best) GROUP BY beta"""),
)
def t_fbeta(spark, d):
    return rounded(frontier.best_fbeta(front(spark, d), BETAS), "threshold", "fbeta")


BUDGETS = (0.001, 0.0025, 0.005, 0.01, 0.02)


@query(
    "t_fpr_budget",
    with_ctes(FR, """, b AS (SELECT unnest([0.001, 0.0025, 0.005, 0.01, 0.02])::DOUBLE AS budget)
    SELECT budget, coalesce(arg_max(threshold, (captured_amount, threshold)) FILTER (WHERE fpr <= budget), max(threshold)) AS threshold
      FROM fr, b GROUP BY budget"""),
)
def t_fpr_budget(spark, d):
    return frontier.fpr_budgets(front(spark, d), BUDGETS)


@query("t_fpr_grid", with_ctes(GRID, "SELECT rnd(coalesce(min(threshold) FILTER (WHERE fpr <= 0.01::DOUBLE), 0.5), 6) AS threshold FROM grid"))
def t_fpr_grid(spark, d):
    out = grid(spark, d).selectExpr("coalesce(min(threshold) FILTER (WHERE fpr <= 0.01D), 0.5D) AS threshold")
    return rounded(out, "threshold")


@query("t_fpr_nearest", with_ctes(FR, """SELECT threshold, rnd(fpr, 6) AS fpr FROM fr
  ORDER BY abs(fpr - 0.01::DOUBLE), threshold DESC LIMIT 1"""))
def t_fpr_nearest(spark, d):
    return rounded(frontier.nearest_fpr(front(spark, d)), "fpr")


@query(
    "t_topk_capacity",
    with_ctes(SCORED, """, k AS (SELECT score AS threshold FROM scored ORDER BY score DESC
        LIMIT 1 OFFSET (SELECT CAST(ceil(0.01::DOUBLE * count(*)) AS BIGINT) - 1 FROM scored))
      SELECT threshold, count(*) AS alerts FROM k, scored WHERE score >= threshold GROUP BY threshold"""),
)
def t_topk_capacity(spark, d):
    return frontier.capacity_cut(front(spark, d))


@query("t_percentile", with_ctes(SCORED, "SELECT rnd(quantile_cont(score, 0.99), 6) AS threshold FROM scored"))
def t_percentile(spark, d):
    return rounded(quantiles(scored(spark, d), [], "score", {"threshold": 0.99}), "threshold")


SHARES = (0.001, 0.005, 0.01)


def _topk_sql(shares, rounding: str) -> str:
    listed = ", ".join(str(s) for s in shares)
    return with_ctes(SCORED, f""", r AS (SELECT y, row_number() OVER (ORDER BY score DESC, row_num) AS rk, count(*) OVER () AS n,
        sum(y) OVER () AS pos FROM scored), s AS (SELECT unnest([{listed}])::DOUBLE AS share),
      c AS (SELECT share, greatest(1, CAST({rounding}(share * n) AS BIGINT)) AS flagged, y, rk, pos FROM r, s)
      SELECT share, flagged, rnd(sum(y) FILTER (WHERE rk <= flagged) / flagged, 6) AS precision_at_k,
        rnd(sum(y) FILTER (WHERE rk <= flagged) / any_value(pos), 6) AS recall_at_k FROM c GROUP BY share, flagged""")


@query("precision_at_k", _topk_sql(SHARES, "floor"))
def precision_at_k(spark, d):
    return rounded(frontier.top_share(scored(spark, d), SHARES), "precision_at_k", "recall_at_k")


@query("recall_at_1pct", _topk_sql((0.01,), "ceil"))
def recall_at_1pct(spark, d):
    return rounded(frontier.top_share(scored(spark, d), (0.01,), rounding="ceil"), "precision_at_k", "recall_at_k")


@query(
    "policy_nbv_subsample",
    with_ctes(FR, """, r AS (SELECT *, row_number() OVER (ORDER BY threshold DESC) AS rk, count(*) OVER () AS n FROM fr)
      SELECT arg_max(threshold, (net_value, threshold)) AS threshold FROM r WHERE (rk - 1) % greatest(1, n // 50) = 0"""),
)
def policy_nbv_subsample(spark, d):
    return frontier.nbv_subsample(front(spark, d))


@query(
    "policy_instance_ev",
    with_ctes(SCORED, """SELECT row_num, 1.2::DOUBLE * score * amount - 0.2::DOUBLE * amount - 5 > 0 AS alert,
      rnd(1.2::DOUBLE * score * amount - 0.2::DOUBLE * amount - 5, 6) AS expected_value FROM scored"""),
)
def policy_instance_ev(spark, d):
    ev = metrics.expected_value("score")
    return rounded(scored(spark, d).selectExpr("row_num", f"{ev} > 0 AS alert", f"{ev} AS expected_value"), "expected_value")


@query("policy_ev_threshold", with_ctes(SCORED, """SELECT row_num,
  rnd(CASE WHEN amount > 0 THEN (0.2::DOUBLE * amount + 5) / (1.2::DOUBLE * amount) END, 6) AS break_even FROM scored"""))
def policy_ev_threshold(spark, d):
    return rounded(scored(spark, d).selectExpr("row_num", f"{metrics.break_even()} AS break_even"), "break_even")


@query(
    "policy_grid",
    with_ctes(SCORED + experiments.UNIVERSE_SQL, """, n AS (SELECT universe, count(*) FILTER (WHERE part = 'policy') AS policy_rows,
        count(*) FILTER (WHERE part = 'test') AS test_rows FROM uni GROUP BY universe)
      SELECT model || '__' || universe || '__' || policy AS run_id, model, universe, policy, policy_rows, test_rows,
        policy_rows > 0 AND test_rows > 0 AS runnable
      FROM (SELECT unnest(['main', 'weak']) AS model), n,
        (SELECT unnest(['top1', 'fpr1', 'nbv', 'ev', 'fpr0.1', 'fpr0.25', 'fpr0.5', 'fpr2']) AS policy)"""),
)
def policy_grid(spark, d):
    return experiments.plan(scored(spark, d))


@query(
    "rule_baseline",
    with_ctes(SCORED, """, r AS (SELECT count(*) FILTER (WHERE is_flagged_fraud AND y = 1) AS tp, count(*) FILTER (WHERE is_flagged_fraud AND y = 0) AS fp,
        sum(y)::BIGINT AS np, coalesce(sum(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE is_flagged_fraud AND y = 1), 0)::DOUBLE AS cap,
        sum(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE y = 1)::DOUBLE AS pa,
        coalesce(sum(CAST(amount AS DECIMAL(18,2))) FILTER (WHERE is_flagged_fraud AND y = 0), 0)::DOUBLE AS fa FROM scored)
      SELECT tp, fp, np - tp AS fn, rnd(tp / greatest(tp + fp, 1), 6) AS precision, rnd(tp / np, 6) AS recall, rnd(cap, 6) AS captured_amount,
        rnd(cap / pa, 6) AS value_recall, rnd(cap - 0.2::DOUBLE * fa - 5 * (tp + fp), 6) AS net_value FROM r"""),
)
def rule_baseline(spark, d):
    alerted = metrics.with_alert(scored(spark, d), "is_flagged_fraud")
    out = metrics.monetary(metrics.classification(metrics.outcome(alerted)))
    cols = ["precision", "recall", "captured_amount", "value_recall", "net_value"]
    return rounded(out.select("tp", "fp", "fn", *cols), *cols)
