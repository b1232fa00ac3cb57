"""Fitting, scoring, calibrating and comparing models with Spark ML."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.functions import columns as c
from txnlens.functions.schema import FEATURE_VERSION
from txnlens.operators.frontier import argmax, exact_frontier, fbeta, ranking_metrics
from txnlens.operators.portable import array_model
from txnlens.operators.prefix import in_ranges, prior_rows, union_all
from txnlens.sources.scratch import fresh_dir, stored

SEED = 42
SPREAD_ROWS = 100_000  # rows of one file that models are fitted from
KINDS = {
    "tree": lambda **p: DecisionTreeClassifier(seed=SEED, **{"maxDepth": 5, **p}),
    "forest": lambda **p: RandomForestClassifier(seed=SEED, **{"numTrees": 25, "maxDepth": 16, "minInstancesPerNode": 20, **p}),
    "gbt": lambda **p: GBTClassifier(seed=SEED, **{"maxIter": 20, "maxDepth": 3, **p}),
    "logistic": lambda **p: LogisticRegression(**{"maxIter": 25, **p}),
}


def balanced(rows: DataFrame) -> DataFrame:
    """Weight both classes equally: n / (2 * rows of the class)."""
    sizes = F.broadcast(rows.selectExpr("count(1) AS _n", "count_if(y = 1) AS _pos"))  # one row
    weight = "_n / (2D * greatest(CASE WHEN y = 1 THEN _pos ELSE _n - _pos END, 1))"
    return rows.crossJoin(sizes).selectExpr(*rows.columns, f"{weight} AS weight")


def fit(kind: str, rows: DataFrame, features: list[str], **params) -> PipelineModel:
    """Impute missing values by the training median, assemble, and fit with balanced classes."""
    filled = [f"{f}__filled" for f in features]
    estimator = KINDS[kind](featuresCol="x", labelCol="y", weightCol="weight", **params)
    stages = [
        Imputer(inputCols=features, outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="x"),
        estimator,
    ]
    doubles = rows.selectExpr("y", *[f"CAST({f} AS DOUBLE) AS {f}" for f in features])
    fitted = Pipeline(stages=stages).fit(balanced(doubles))
    return PipelineModel([*fitted.stages[:-1], _without_summary(fitted.stages[-1], rows.sparkSession)])


def _without_summary(stage, spark: SparkSession):
    """The model as a saved copy has it.

    A training summary holds the session, which cannot travel to the executors once an ``Observation`` was used in it.
    """
    if not getattr(stage, "hasSummary", False):
        return stage
    path = fresh_dir(spark, "fitted")
    stage.write().save(path)
    return type(stage).load(path)


def score(model: PipelineModel, rows: DataFrame, features: list[str], out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Positive-class probability of every row, beside the columns in ``keep`` (all).

    The scores are written once: frontiers and metrics read them several times, and the model
    must not be evaluated again for each.  A logistic model is scored by its coefficients.
    """
    kept = rows.columns if keep is None else keep
    if isinstance(model.stages[-1], LogisticRegressionModel):
        line = array_model(rows.sparkSession, model)
        terms = [f"{w!r}D * coalesce(nanvl(CAST({f} AS DOUBLE), NULL), {m!r}D)"
                 for f, w, m in zip(line.features, line.weights.tolist(), line.fill.tolist(), strict=True)]
        scored = rows.selectExpr(*kept, f"1D / (1D + exp(-({' + '.join([f'{line.intercept!r}D', *terms])}))) AS {out}")
    else:
        cast = rows.selectExpr(*[f"CAST({x} AS DOUBLE) AS {x}" if x in features else x for x in rows.columns])
        scored = model.transform(cast).select(*kept, vector_to_array("probability")[1].alias(out))
    return stored(scored, "scores")


def batch_score(model: PipelineModel, rows: DataFrame, features: list[str], threshold: float, version: str) -> DataFrame:
    scored = score(model, rows, features, "fraud_score")
    return scored.selectExpr(
        "*", f"CASE WHEN fraud_score >= {threshold}D THEN 'FRAUD' ELSE 'LEGIT' END AS decision",
        f"'{version}' AS model_version", f"{FEATURE_VERSION} AS feature_schema_version",
    )


def score_matrix(rows: DataFrame, features: list[str], kinds: list[str], partitions: dict[str, str]) -> DataFrame:
    """One score per (row, model, training part), long; joined by row id, never by position."""
    parts = []
    for key, where in partitions.items():
        train = rows.where(where)
        for kind in kinds:
            scored = score(fit(kind, train, features), rows, features, keep=["row_num", "y", "amount", "step"])
            parts.append(scored.selectExpr("row_num", f"'{kind}' AS model", f"'{key}' AS train_key", "score", "y", "amount", "step"))
    return union_all(parts)


# --- calibration -------------------------------------------------------------
def platt(scored: DataFrame, window: str, steps: int = 25) -> DataFrame:
    """Logistic curve on the raw score, fitted on ``window`` rows; other rows are scored too.

    Newton's method over one point per distinct score: each step is one aggregate of five sums, and the two
    coefficients are all that comes to the driver.  It stops when they no longer move; scores that part the classes
    have no finite fit, then the last step counts.
    """
    points = stored(scored.where(window).groupBy("score").agg(
        F.expr("sum(y) AS pos"), F.expr("CAST(count(1) AS DOUBLE) AS n")), "points")
    slope = shift = 0.0
    for _ in range(steps):
        p = f"(1D / (1D + exp(-({slope!r}D * score + {shift!r}D))))"
        w = f"(n * {p} * (1D - {p}))"
        g = points.selectExpr(
            f"sum((pos - n * {p}) * score) AS gs", f"sum(pos - n * {p}) AS gi", f"sum({w} * score * score) AS ss",
            f"sum({w} * score) AS si", f"sum({w}) AS ii").first()
        det = (g["ss"] or 0.0) * (g["ii"] or 0.0) - (g["si"] or 0.0) ** 2
        if not det > 0:
            break
        moves = (g["gs"] * g["ii"] - g["gi"] * g["si"]) / det, (g["gi"] * g["ss"] - g["gs"] * g["si"]) / det
        slope, shift = slope + moves[0], shift + moves[1]
        if max(map(abs, moves)) <= 1e-10 * max(1.0, abs(slope), abs(shift)):
            break
    return scored.selectExpr("*", f"1D / (1D + exp(-({slope!r}D * score + {shift!r}D))) AS calibrated")


POOLED = 1_000_000  # blocks that one task pools


def _pool(blocks: pd.DataFrame) -> pd.DataFrame:
    """Pool adjacent violators: neighbouring blocks whose rates do not rise become one."""
    out: list[list[float]] = []
    for lo, hi, pos, n in blocks.sort_values("lo")[["lo", "hi", "pos", "n"]].itertuples(index=False):
        out.append([lo, hi, pos, n])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            last = out.pop()
            out[-1] = [out[-1][0], last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    return pd.DataFrame(out, columns=["lo", "hi", "pos", "n"]).assign(_chunk=blocks["_chunk"].iloc[0])


BLOCKS = "lo double, hi double, pos double, n double, _chunk long"


def _falls(cut: DataFrame) -> bool:
    """Whether any block's rate does not rise above the one before it, inside a range or from one to the next."""
    one = "struct(pos, n)"
    inner = cut.selectExpr(f"{one} AS now", f"lag({one}) OVER (PARTITION BY _chunk ORDER BY lo) AS before")
    ends = cut.groupBy("_chunk").agg(F.expr(f"min_by({one}, lo) AS first"), F.expr(f"max_by({one}, lo) AS last"))
    # One row per range.
    outer = ends.selectExpr("first AS now", "lag(last) OVER (ORDER BY _chunk) AS before")
    return not inner.unionByName(outer).where("before.pos * now.n >= now.pos * before.n").isEmpty()


def isotonic_blocks(points: DataFrame, limit: int = POOLED) -> DataFrame:
    """``lo, hi, pos, n``: the score blocks of the best rising step function, from ``score, pos, n`` per distinct score.

    Ranges of at most ``2 * limit`` blocks are pooled each in one task, and then the upper half of each range with the
    lower half of the next.  Pooling in any order leads to the same blocks, so this is repeated, over ranges cut anew,
    until every block rises above the one before it.  Ranges of a single block could keep two blocks apart for ever:
    a round that pools nothing is followed by one with ranges twice as long.
    """
    blocks = points.selectExpr("score AS lo", "score AS hi", "CAST(pos AS DOUBLE) AS pos", "CAST(n AS DOUBLE) AS n")
    before = None
    while True:
        cut = in_ranges(blocks, ["lo"], limit)
        if not _falls(cut):
            return cut.drop("_chunk")
        size = cut.count()
        limit, before = 2 * limit if size == before else limit, size
        once = stored(cut.groupBy("_chunk").applyInPandas(_pool, BLOCKS), "blocks")
        middle = once.groupBy("_chunk").agg(F.expr("percentile_approx(lo, 0.5) AS _mid"))  # one row per range
        moved = once.join(middle, "_chunk").withColumn("_chunk", F.expr("_chunk + CASE WHEN lo > _mid THEN 1 ELSE 0 END"))
        blocks = stored(moved.groupBy("_chunk").applyInPandas(_pool, BLOCKS).drop("_chunk"), "blocks")


def isotonic(scored: DataFrame, window: str, limit: int = POOLED) -> DataFrame:
    """Monotone curve through the blocks of equal rate; between two blocks it rises in a straight line.

    Scores beyond the fitted ones take the first or last rate.
    """
    points = scored.where(window).groupBy("score").agg(F.expr("sum(y) AS pos"), F.expr("count(1) AS n"))
    blocks = isotonic_blocks(stored(points, "points"), limit)
    # A step function between knots: each score meets the knots around it in one ordered pass.
    knots = blocks.selectExpr("lo AS score", "pos / n AS rate").unionByName(blocks.selectExpr("hi AS score", "pos / n AS rate")).distinct()
    asked = scored.select("score").distinct().join(knots, "score", "left")
    curve = _between_knots(stored(asked.unionByName(knots, allowMissingColumns=True).distinct(), "knots"), limit)
    return stored(scored.join(curve, "score", "left"), "calibrated")


def _between_knots(marks: DataFrame, limit: int) -> DataFrame:
    """``score, calibrated`` for every score of ``marks`` (``score, rate``, the rate NULL but at knots)."""
    cut = in_ranges(marks, ["score"], limit)
    knot = "CASE WHEN rate IS NOT NULL THEN struct(score, rate) END"
    ends = cut.groupBy("_chunk").agg(F.expr(f"max({knot}) AS _last"), F.expr(f"min({knot}) AS _first"))
    # One row per range.
    carried = ends.selectExpr(
        "_chunk", "max(_last) OVER (ORDER BY _chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _below",
        "min(_first) OVER (ORDER BY _chunk ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS _above")
    here = cut.selectExpr(
        "*", f"max({knot}) OVER (PARTITION BY _chunk ORDER BY score) AS _lo",
        f"min({knot}) OVER (PARTITION BY _chunk ORDER BY score ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS _hi")
    both = here.join(carried, "_chunk").selectExpr("score", "rate", "coalesce(_lo, _below) AS a", "coalesce(_hi, _above) AS b")
    return both.selectExpr(
        "score", """CASE WHEN rate IS NOT NULL THEN rate WHEN a IS NULL THEN b.rate WHEN b IS NULL THEN a.rate
          ELSE a.rate + (b.rate - a.rate) * (score - a.score) / (b.score - a.score) END AS calibrated""").distinct()


# --- selection ---------------------------------------------------------------
def tune(rows: DataFrame, features: list[str], kind: str, grid: list[dict], folds: list[tuple[int, int]], patience: int = 3) -> DataFrame:
    """Mean average precision over walk-forward folds per parameter set, stopping after
    ``patience`` sets without improvement.  The loop is over models; rows stay in Spark."""
    out, best, stale = [], -1.0, 0
    for params in grid:
        parts = []
        for cut, end in folds:
            model = fit(kind, rows.where(f"step <= {cut}"), features, **params)
            parts.append(score(model, rows.where(f"step > {cut} AND step <= {end}"), features, keep=["y", "amount"]).selectExpr(
                f"{cut} AS cut", "y", "amount", "score"))
        ap = ranking_metrics(union_all(parts), ["cut"]).agg(F.avg("average_precision")).first()[0]
        out.append((json.dumps(params, sort_keys=True), float(ap)))
        best, stale = (ap, 0) if ap > best else (best, stale + 1)
        if stale >= patience:
            break
    return rows.sparkSession.createDataFrame(out, "params string, mean_average_precision double")


def spread(rows: DataFrame, depth: int | None = None) -> DataFrame:
    """The rows in files of about ``depth`` rows; a table of at most that many is left as it is.

    Features compress so well that a table of millions of rows may be one row group, which one task reads in every pass of
    every fit.
    """
    depth = depth or SPREAD_ROWS
    pieces = -(-rows.count() // depth)
    return rows if pieces <= 1 else stored(rows.repartition(pieces), "spread")


def walk_forward_models(rows: DataFrame, features: list[str], folds: DataFrame, kind: str = "forest", **params) -> DataFrame:
    """Average precision per fold of a model fitted on the fold's training rows alone.

    ``folds`` has ``embargo, cut, train_end, test_end``, a few rows; training ends ``embargo`` steps before the cut. Folds
    without training rows of both classes or whose test part lacks a class are left out. The loop is over folds; rows
    stay in Spark, spread evenly over files once for all fits.
    """
    rows = spread(rows.select(*dict.fromkeys(["step", "y", "amount", *features])))
    classes = rows.groupBy("step").agg(F.expr("count_if(y = 1) AS pos"), F.expr("count_if(y = 0) AS neg"))
    sized = F.broadcast(folds).join(classes, F.expr("step <= test_end")).groupBy(*folds.columns).agg(*[
        F.expr(f"coalesce(sum({n}) FILTER (WHERE {w}), 0) > 0 AS {p}_{n}")
        for p, w in (("train", "step <= train_end"), ("test", "step > cut")) for n in ("pos", "neg")])
    parts = []
    for f in sized.where("train_pos AND train_neg AND test_pos AND test_neg").orderBy("embargo", "cut").collect():
        model = fit(kind, rows.where(f"step <= {f['train_end']}"), features, **params)
        scored = score(model, rows.where(f"step > {f['cut']} AND step <= {f['test_end']}"), features, keep=["y", "amount"])
        parts.append(scored.selectExpr(f"{f['embargo']} AS embargo", f"{f['cut']} AS cut", "y", "amount", "score"))
    return ranking_metrics(union_all(parts), ["embargo", "cut"]) if parts else rows.sparkSession.createDataFrame(
        [], "embargo int, cut int, rows long, positives long, average_precision double, roc_auc double")


def refit_and_seal(rows: DataFrame, features: list[str], kind: str, train_max: int, val_max: int, beta: float = 1.75, **params) -> DataFrame:
    """Choose the threshold on validation rows, refit on train + validation, score the test once."""
    first = fit(kind, rows.where(f"step <= {train_max}"), features, **params)
    val = score(first, rows.where(f"step > {train_max} AND step <= {val_max}"), features)
    threshold = argmax(exact_frontier(val), fbeta(beta), first="highest").first()["threshold"]
    final = fit(kind, rows.where(f"step <= {val_max}"), features, **params)
    return score(final, rows.where(f"step > {val_max}"), features).selectExpr(
        "*", f"{threshold!r}D AS threshold", f"score >= {threshold!r}D AS alert")


def ablation(train: DataFrame, test: DataFrame, features: list[str], kind: str = "tree") -> DataFrame:
    """Loss of average precision when one feature is left out; features that help are kept."""
    def ap(names: list[str], label: str) -> DataFrame:
        return score(fit(kind, train, names), test, names, keep=["y", "amount"]).selectExpr(f"'{label}' AS feature", "y", "amount", "score")

    runs = [ap(features, "__all__")] + [ap([f for f in features if f != x], x) for x in features]
    ranked = ranking_metrics(union_all(runs), ["feature"])
    whole = F.broadcast(ranked.where("feature = '__all__'").selectExpr("average_precision AS base"))  # one row
    return ranked.where("feature <> '__all__'").crossJoin(whole).selectExpr(
        "feature", "base", "average_precision", "base - average_precision AS delta", "base - average_precision >= 0 AS keep")


def permutation_importance(model: PipelineModel, rows: DataFrame, features: list[str], repeats: int = 5) -> DataFrame:
    """Loss of average precision when one feature's values are shuffled, averaged over repeats.

    Each repeat pairs every row with the row at the same place in a hashed order.  The rank
    counts use the splitting prefix helper, so no single task numbers all rows.
    """
    seq = f"explode(sequence(1, {repeats})) AS rep"
    base = rows.selectExpr("row_num", "y", "amount", *features)
    own = prior_rows(base.selectExpr("*", seq), ["rep"], "row_num", {"_at": ("count", "1")})
    other = prior_rows(
        base.selectExpr("row_num", *features, seq).selectExpr("*", f"{c.md5_number(repr('perm'), 'row_num', 'rep')} AS _h"),
        ["rep"], "_h", {"_at": ("count", "1")}, tie=["row_num"])
    partner = other.selectExpr("rep", "_at", *[f"{f} AS o_{f}" for f in features])
    paired = own.join(partner, ["rep", "_at"])
    variants = []
    for name in ["__none__", *features]:
        cols = ", ".join(f"'{f}', CAST({'o_' + f if f == name else f} AS DOUBLE)" for f in features)
        variants.append(f"named_struct('feature', '{name}', 'v', named_struct({cols}))")
    shuffled = paired.selectExpr("rep", "y", "amount", f"inline(array({', '.join(variants)}))").selectExpr(
        "rep", "feature", "y", "amount", "v.*")
    ranked = ranking_metrics(score(model, shuffled, features, keep=["rep", "feature", "y", "amount"]), ["rep", "feature"])
    plain = ranked.where("feature = '__none__'").selectExpr("rep", "average_precision AS base")
    drops = ranked.where("feature <> '__none__'").join(plain, "rep").groupBy("feature").agg(
        F.expr("avg(base - average_precision) AS importance"), F.expr("stddev_samp(base - average_precision) AS spread"))
    # one row per feature
    return drops.selectExpr("*", "rank() OVER (ORDER BY importance DESC) AS importance_rank")


def impurity_importance(model: PipelineModel, spark: SparkSession, features: list[str]) -> DataFrame:
    """The share of the impurity gain that each feature has in a fitted tree, forest or boosted trees."""
    gains = model.stages[-1].featureImportances.toArray().tolist()
    frame = spark.createDataFrame(list(zip(features, gains, strict=True)), "feature string, importance double")
    return frame.selectExpr("*", "rank() OVER (ORDER BY importance DESC) AS importance_rank")  # one row per feature


def rank_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """How two rankings (``feature, importance_rank``) of the same features agree: Spearman's rho and Kendall's tau-b.

    Ties share their mean rank in rho; tau-b counts pairs of features in the same and in opposite order.  Both are NULL
    where a ranking ties all features.  Tables have one row per feature.
    """
    both = a.select("feature", F.col("importance_rank").alias("ra")).join(
        b.select("feature", F.col("importance_rank").alias("rb")), "feature")
    mean = "{r} + (count(1) OVER (PARTITION BY {r}) - 1) / 2D AS m{r}"
    rho = both.selectExpr("*", mean.format(r="ra"), mean.format(r="rb")).agg(F.expr("count(1) AS features"), F.expr("covar_pop(mra, mrb) / nullif(stddev_pop(mra) * stddev_pop(mrb), 0D) AS spearman"))
    x, y = both.alias("x"), both.alias("y")
    pairs = x.join(y, F.expr("x.feature < y.feature")).selectExpr("sign(x.ra - y.ra) AS sa", "sign(x.rb - y.rb) AS sb")
    tau = pairs.agg(F.expr("count_if(sa * sb > 0) AS same_order"), F.expr("count_if(sa * sb < 0) AS opposite_order"), F.expr(
        "sum(sa * sb) / nullif(sqrt(sum(sa * sa) * sum(sb * sb)), 0) AS kendall"))
    return rho.crossJoin(F.broadcast(tau))  # one row each


def compare_importance(model: PipelineModel, rows: DataFrame, features: list[str], repeats: int = 5) -> DataFrame:
    """Per feature its permutation and impurity importance with ranks, and on each row how the two rankings agree."""
    moved = stored(permutation_importance(model, rows, features, repeats), "importance")
    gain = impurity_importance(model, rows.sparkSession, features)
    named = gain.selectExpr("feature", "importance AS impurity", "importance_rank AS impurity_rank")
    both = moved.selectExpr("feature", "importance AS permutation", "importance_rank AS permutation_rank").join(named, "feature")
    return both.crossJoin(F.broadcast(rank_agreement(moved, gain)))  # one row


# --- saved models ------------------------------------------------------------
def save(model: PipelineModel, spark: SparkSession, path: str, version: str) -> None:
    """Write the model and, beside it, the feature version it was trained for."""
    model.write().overwrite().save(f"{path}/model")
    meta = [(version, FEATURE_VERSION)]
    spark.createDataFrame(meta, "version string, feature_schema_version int").write.mode("overwrite").json(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, str]:
    """Read a model back; refuse one made for other features."""
    meta = spark.read.schema("version string, feature_schema_version int").json(f"{path}/meta").first()
    if meta["feature_schema_version"] != FEATURE_VERSION:
        raise ValueError(f"model {meta['version']} needs feature version {meta['feature_schema_version']}, not {FEATURE_VERSION}")
    return PipelineModel.load(f"{path}/model"), meta["version"]


def compatible(versions: DataFrame, feature_version: int = FEATURE_VERSION) -> DataFrame:
    """Loadable versions, newest first."""
    return versions.where(f"feature_schema_version = {feature_version}").orderBy(F.desc("created_us"), F.desc("version"))
