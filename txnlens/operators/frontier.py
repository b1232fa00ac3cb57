"""Exact score frontiers and everything read off them.

A frontier has one row per distinct score, descending, with the totals of all rows scored at
or above it.  Rows are first folded to one row per score; only those points are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions import columns as c
from txnlens.functions.schema import ALERT_COST, CAPTURE_RATE, FP_AMOUNT_RATE
from txnlens.operators.prefix import SINGLE_WINDOW_VALUES, cumulate_desc, prior_rows
from txnlens.sources.scratch import stored

TOTALS = ["tp", "fp", "tp_amt", "fp_amt"]
NBV = f"({CAPTURE_RATE}D * {{tp}} - {FP_AMOUNT_RATE}D * {{fp}} - {ALERT_COST}D * ({{n}}))"


def _join_totals(df: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Totals have one row per key (model, day, slice): far fewer than the scores joined."""
    return df.join(totals, keys) if keys else df.crossJoin(F.broadcast(totals))


def score_points(scored: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    return scored.groupBy(*keys, F.col(score).alias("threshold")).agg(
        F.expr("count_if(y = 1) AS tp"),
        F.expr("count_if(y = 0) AS fp"),
        F.expr(f"coalesce(sum({c.money('amount')}) FILTER (WHERE y = 1), 0) AS tp_amt"),
        F.expr(f"coalesce(sum({c.money('amount')}) FILTER (WHERE y = 0), 0) AS fp_amt"),
    )


def class_totals(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(
        F.expr("sum(tp) AS total_pos"), F.expr("sum(fp) AS total_neg"),
        F.expr("CAST(sum(tp_amt) AS DOUBLE) AS total_pos_amt"), F.expr("CAST(sum(fp_amt) AS DOUBLE) AS total_neg_amt"),
    )


def frontier_of(points: DataFrame, keys: list[str], limit: int = SINGLE_WINDOW_VALUES) -> DataFrame:
    """Frontier from :func:`score_points`; ``rank`` numbers the thresholds from the top."""
    ranked = points.selectExpr(*keys, "threshold", *TOTALS, "1L AS rank")
    running = cumulate_desc(ranked, keys, "threshold", [*TOTALS, "rank"], limit)
    joined = _join_totals(running, class_totals(points, keys), keys)
    captured, alerted = "CAST(tp_amt AS DOUBLE)", "CAST(fp_amt AS DOUBLE)"
    return joined.selectExpr(
        *keys,
        "threshold",
        "rank",
        "tp",
        "fp",
        "total_pos - tp AS fn",
        "total_neg - fp AS tn",
        "fp / greatest(total_neg, 1L) AS fpr",
        "tp / greatest(total_pos, 1L) AS recall_count",
        f"{captured} AS captured_amount",
        f"{c.ratio_or(captured, 'total_pos_amt')} AS value_recall",
        f"{alerted} AS legit_amount_alerted",
        f"{c.ratio_or(alerted, 'total_neg_amt')} AS legit_amount_alerted_rate",
        "tp / (tp + fp) AS precision",
        f"{NBV.format(tp=captured, fp=alerted, n='tp + fp')} AS net_value",
    )


def exact_frontier(
    scored: DataFrame, keys: list[str] | None = None, score: str = "score", limit: int = SINGLE_WINDOW_VALUES
) -> DataFrame:
    """``scored`` has ``y`` (0/1), ``amount`` and a score; one frontier per value of ``keys``."""
    keys = keys or []
    return frontier_of(stored(score_points(scored, keys, score), "points"), keys, limit)


# --- ranking metrics ---------------------------------------------------------
def ranking_of(points: DataFrame, keys: list[str], limit: int = SINGLE_WINDOW_VALUES) -> DataFrame:
    """Average precision and ROC area per key, from running counts over distinct scores.

    Each point adds its own positives and negatives to the sums, so no neighbour lookup is
    needed: recall grows by pos/total_pos at precision tp/(tp+fp); the area gains
    neg * (tp - pos/2).  With one class missing the area is 0.5.
    """
    own = points.selectExpr(*keys, "threshold", "tp AS pos", "fp AS neg", "tp", "fp")
    running = cumulate_desc(own, keys, "threshold", ["tp", "fp"], limit, keep=["pos", "neg"])
    folded = running.groupBy(*keys).agg(
        F.expr("sum(pos) AS positives"),
        F.expr("sum(neg) AS negatives"),
        F.expr("sum(pos * (tp / (tp + fp))) AS ap_sum"),
        F.expr("sum(neg * (tp - pos / 2D)) AS auc_sum"),
    )
    return folded.selectExpr(
        *keys,
        "positives + negatives AS rows",
        "positives",
        "CASE WHEN positives > 0 THEN ap_sum / positives ELSE 0D END AS average_precision",
        "CASE WHEN positives > 0 AND negatives > 0 THEN auc_sum / positives / negatives ELSE 0.5D END AS roc_auc",
    )


def ranking_metrics(
    scored: DataFrame, keys: list[str] | None = None, score: str = "score", limit: int = SINGLE_WINDOW_VALUES
) -> DataFrame:
    keys = keys or []
    counted = scored.groupBy(*keys, F.col(score).alias("threshold")).agg(
        F.expr("count_if(y = 1) AS tp"), F.expr("count_if(y = 0) AS fp")
    )
    return ranking_of(stored(counted, "points"), keys, limit)


# --- grid --------------------------------------------------------------------
GRID = (0.001, 0.999, 500)  # fixed values: first, last and number of grid thresholds


def threshold_grid(scored: DataFrame, keys: list[str] | None = None, grid=GRID) -> DataFrame:
    """Metrics at equally spaced thresholds in one pass.

    Each row falls into the last grid cell whose threshold it reaches; counts per cell are
    then summed from the top.  The grid is fixed, so its window is bounded.
    """
    keys = keys or []
    lo, hi, n = grid
    spark = scored.sparkSession
    step = (hi - lo) / (n - 1)
    thresholds = spark.range(n).selectExpr(
        "CAST(id AS INT) AS cell", f"CASE WHEN id = {n - 1} THEN {hi!r}D ELSE {lo!r}D + id * {step!r}D END AS threshold"
    )
    guess = f"CAST(floor((score - {lo!r}D) / {step!r}D) AS INT)"
    at = f"CASE WHEN {{i}} >= {n - 1} THEN {hi!r}D ELSE {lo!r}D + {{i}} * {step!r}D END"
    # The division can land one cell off; compare with the real thresholds and correct.
    cell = (
        f"CASE WHEN score < {lo!r}D THEN -1 "
        f"WHEN _g + 1 <= {n - 1} AND score >= {at.format(i='(_g + 1)')} THEN _g + 1 "
        f"WHEN score < {at.format(i='_g')} THEN _g - 1 ELSE _g END"
    )
    placed = scored.selectExpr(*keys, "y", "amount", "score", f"least({guess}, {n - 1}) AS _g").selectExpr(
        *keys, "y", "amount", f"CAST({cell} AS INT) AS cell"
    )
    counts = score_points(placed, keys, "cell").withColumnRenamed("threshold", "cell")
    totals = class_totals(counts, keys)
    empty = totals.select(*keys) if keys else spark.range(1).select()
    frame = empty.crossJoin(F.broadcast(thresholds)).join(counts, [*keys, "cell"], "left")
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    top = f"OVER ({part}ORDER BY cell DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    summed = frame.selectExpr(*keys, "threshold", *[f"coalesce(sum({t}) {top}, 0) AS {t}" for t in TOTALS])
    joined = _join_totals(summed, totals, keys)
    rec = c.ratio_or("tp", "total_pos")
    base = joined.selectExpr(
        *keys, "threshold", "tp", "fp", "total_pos - tp AS fn", "total_neg - fp AS tn",
        "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1D END AS precision",
        f"{rec} AS recall",
        f"{c.ratio_or('fp', 'total_neg')} AS fpr",
        "CAST(tp_amt AS DOUBLE) AS tp_amount", "CAST(fp_amt AS DOUBLE) AS fp_amount",
        f"{c.ratio_or('CAST(tp_amt AS DOUBLE)', 'total_pos_amt')} AS recall_amount",
    )
    return base.selectExpr(
        "*",
        "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0D END AS f1",
        f"{NBV.format(tp='tp_amount', fp='fp_amount', n='tp + fp')} AS net_value",
    )


# --- choosing a threshold ----------------------------------------------------
def argmax(frontier: DataFrame, metric: str, keys: list[str] | None = None, where: str = "true",
           first: str = "lowest", fallback: str | None = None) -> DataFrame:
    """Threshold with the largest metric among rows satisfying ``where``.

    Ties go to the ``lowest`` or ``highest`` threshold.  Without any qualifying row the
    threshold maximising ``fallback`` is used.
    """
    keys = keys or []
    tie = "-threshold" if first == "lowest" else "threshold"
    best = f"max_by(threshold, struct({metric}, {tie})) FILTER (WHERE {where})"
    other = f"max_by(threshold, struct({fallback}, {tie}))" if fallback else "NULL"
    return frontier.groupBy(*keys).agg(F.expr(f"coalesce({best}, {other}) AS threshold"))


def fbeta(beta: float, precision: str = "precision", recall: str = "recall_count") -> str:
    b2 = beta * beta
    return (
        f"CASE WHEN {b2!r}D * {precision} + {recall} > 0 "
        f"THEN {1 + b2!r}D * {precision} * {recall} / ({b2!r}D * {precision} + {recall}) ELSE 0D END"
    )


def best_fbeta(frontier: DataFrame, betas: tuple[float, ...], keys: list[str] | None = None) -> DataFrame:
    """Per beta the highest threshold whose F-beta equals the maximum (relative 1e-12)."""
    keys = keys or []
    cols = ", ".join(f"named_struct('beta', {b!r}D, 'f', {fbeta(b)})" for b in betas)
    long = frontier.selectExpr(*keys, "threshold", f"inline(array({cols}))")
    top = long.groupBy(*keys, "beta").agg(F.expr("max(f) AS best"))
    near = long.join(F.broadcast(top) if not keys else top, [*keys, "beta"]).where("f >= best - 1e-12 * abs(best)")
    return near.groupBy(*keys, "beta").agg(F.expr("max(threshold) AS threshold"), F.expr("max(best) AS fbeta"))


def fpr_budgets(frontier: DataFrame, budgets: tuple[float, ...], keys: list[str] | None = None) -> DataFrame:
    """Per budget: most captured money with fpr within it, else the first (highest) threshold."""
    keys = keys or []
    best = [
        f"named_struct('budget', {b!r}D, 'threshold', coalesce("
        f"max_by(threshold, struct(captured_amount, threshold)) FILTER (WHERE fpr <= {b!r}), max(threshold)))"
        for b in budgets
    ]
    agg = frontier.groupBy(*keys).agg(F.expr(f"array({', '.join(best)}) AS picks"))
    return agg.selectExpr(*keys, "inline(picks)")


def nearest_fpr(frontier: DataFrame, target: float = 0.01, keys: list[str] | None = None) -> DataFrame:
    near = f"min_by(struct(threshold, fpr), struct(abs(fpr - {target!r}D), -threshold)) AS pick"
    return frontier.groupBy(*(keys or [])).agg(F.expr(near)).selectExpr(*(keys or []), "pick.threshold AS threshold", "pick.fpr AS fpr")


def capacity_cut(frontier: DataFrame, share: float = 0.01, keys: list[str] | None = None) -> DataFrame:
    """Score of the k-th highest row, k = ceil(share * rows); rows tied with it are alerted too."""
    keys = keys or []
    k = f"ceil({share!r}D * (tp + fp + fn + tn))"
    return frontier.groupBy(*keys).agg(
        F.expr(f"max(threshold) FILTER (WHERE tp + fp >= {k}) AS threshold"),
        F.expr(f"min(tp + fp) FILTER (WHERE tp + fp >= {k}) AS alerts"),
    )


def nbv_subsample(frontier: DataFrame, candidates: int = 50, keys: list[str] | None = None) -> DataFrame:
    """Best net value over every (n / candidates)-th frontier row, first maximum wins."""
    keys = keys or []
    size = frontier.groupBy(*keys).agg(F.expr(f"greatest(1L, max(rank) div {candidates}) AS stride"))
    every = _join_totals(frontier, size, keys).where("(rank - 1) % stride = 0")
    return argmax(every, "net_value", keys, first="highest")


def top_share(scored: DataFrame, shares: tuple[float, ...], rounding: str = "floor", tie: str = "row_num") -> DataFrame:
    """Precision and recall of the best-scored ``share`` of rows, ties in a fixed row order.

    Whole score groups come from the frontier; only the rows of the one score that straddles
    the cut are ordered among themselves.
    """
    frontier = exact_frontier(scored)
    parts = ", ".join(
        f"named_struct('share', {s!r}D, 'flagged', "
        f"greatest(1L, CAST({rounding}({s!r}D * (tp + fp + fn + tn)) AS BIGINT)))"
        for s in shares
    )
    cuts = frontier.selectExpr("threshold", "tp", "fp", "fn", f"inline(array({parts}))")
    whole = "tp + fp <= flagged"
    picked = cuts.groupBy("share", "flagged").agg(  # one row per share asked for
        F.expr(f"coalesce(max(tp + fp) FILTER (WHERE {whole}), 0L) AS taken"),
        F.expr(f"coalesce(max(tp) FILTER (WHERE {whole}), 0L) AS tp_whole"),
        F.expr(f"max(threshold) FILTER (WHERE NOT ({whole})) AS cut_score"),
        F.expr("max(tp + fn) AS total_pos"),
    )
    picked = stored(picked, "cuts")
    open_cuts = F.broadcast(picked.where("cut_score IS NOT NULL AND taken < flagged"))
    straddling = scored.join(open_cuts, F.expr("score = cut_score")).selectExpr("share", "flagged - taken AS room", tie, "y")
    ordered = prior_rows(straddling, ["share"], tie, {"_rank": ("count", "1")})
    extra = ordered.where("_rank < room").groupBy("share").agg(F.expr("sum(y) AS tp_part"))
    return picked.join(extra, "share", "left").selectExpr(
        "share", "flagged", "(tp_whole + coalesce(tp_part, 0)) / flagged AS precision_at_k",
        "CASE WHEN total_pos > 0 THEN (tp_whole + coalesce(tp_part, 0)) / total_pos ELSE 0D END AS recall_at_k",
    )

