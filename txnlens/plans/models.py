"""Model jobs; the fitted ones have no SQL equivalent and are checked by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnlens.functions.columns import micros
from txnlens.operators import models, pit, splits
from txnlens.operators.frontier import ranking_metrics
from txnlens.operators.metrics import calibration_errors
from txnlens.plans.inputs import LEDGER, SCORED, ledger, rounded, scored, with_ctes
from txnlens.plans.registry import query
from txnlens.sources import fixture
from txnlens.sources.scratch import fresh_dir, stored

FEATURES = pit.PIT_FEATURES


def frame(spark, d):
    """The point-in-time frame, written once: several fits read it."""
    path = fresh_dir(spark, "frame")
    pit.pit_frame(ledger(spark, d)).withColumn("amount", F.col("current_amount")).write.parquet(path)
    return spark.read.parquet(path)


def _fit_query(kind: str) -> None:
    @query(f"fit_{kind}")
    def run(spark, d):
        rows = frame(spark, d)
        model = models.fit(kind, rows.where("step <= 480"), FEATURES)
        out = models.score(model, rows, FEATURES).selectExpr(
            "CASE WHEN step <= 480 THEN 'train' WHEN step <= 600 THEN 'val' ELSE 'test' END AS split", "y", "amount", "score")
        return ranking_metrics(out, ["split"])


for _kind in ("tree", "forest", "gbt"):
    _fit_query(_kind)


@query("score_matrix")
def score_matrix(spark, d):
    parts = {"to_480": "step <= 480", "to_355": "step <= 355"}
    return models.score_matrix(frame(spark, d), FEATURES, ["tree", "forest", "logistic"], parts).select("row_num", "model", "train_key", "score")


WINDOW = "step > 480 AND step <= 552"


def _calibrated(fn):
    def run(spark, d):
        rows = scored(spark, d).select("row_num", "step", "y", "amount", "score")
        out = fn(rows, WINDOW).where("step > 552")
        raw = calibration_errors(out).selectExpr("'raw' AS kind", "brier", "log_loss")
        both = raw.unionByName(calibration_errors(out, score="calibrated").selectExpr("'calibrated' AS kind", "brier", "log_loss"))
        return rounded(both, "brier", "log_loss")

    return run


# Scores of the window as points; the scores to calibrate are those after it.
_POINTS_SQL = """,
pts AS MATERIALIZED (SELECT score, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM scored WHERE step > 480 AND step <= 552 GROUP BY score)"""
_ERRORS_SQL = """SELECT kind, rnd(avg((p - y) * (p - y)), 6) AS brier,
  rnd(avg(CASE WHEN y = 1 THEN -ln(least(greatest(p, 1e-15), 1 - 1e-15)) ELSE -ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) END), 6) AS log_loss
FROM (SELECT 'raw' AS kind, score::DOUBLE AS p, y FROM scored WHERE step > 552
  UNION ALL SELECT 'calibrated', calibrated, y FROM scored JOIN curve USING (score) WHERE step > 552) GROUP BY kind"""


def _newton_sql(steps: int = 12) -> str:
    """The same two-parameter fit, one table per step."""
    out = ", s0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"
    for k in range(steps):
        out += f""",
g{k} AS MATERIALIZED (SELECT any_value(a) AS a, any_value(b) AS b, sum((pos - n * p) * score) AS gs, sum(pos - n * p) AS gi,
  sum(n * p * (1 - p) * score * score) AS ss, sum(n * p * (1 - p) * score) AS si, sum(n * p * (1 - p)) AS ii
  FROM (SELECT *, 1.0::DOUBLE / (1 + exp(-(a * score + b))) AS p FROM pts, s{k})),
s{k + 1} AS MATERIALIZED (SELECT a + (gs * ii - gi * si) / (ss * ii - si * si) AS a, b + (gi * ss - gs * si) / (ss * ii - si * si) AS b FROM g{k})"""
    return out + f", curve AS (SELECT score, 1.0::DOUBLE / (1 + exp(-(a * score + b))) AS calibrated FROM (SELECT DISTINCT score FROM scored), s{steps})"


# The greatest over starts of the least over ends of the mean rate between them; straight lines between points.
_MAX_MIN_SQL = """,
cum AS (SELECT score, row_number() OVER o AS i, sum(pos) OVER o AS cp, sum(n) OVER o AS cn, pos, n FROM pts WINDOW o AS (ORDER BY score)),
means AS (SELECT a.i AS a, b.i AS b, (b.cp - a.cp + a.pos) / (b.cn - a.cn + a.n) AS mean FROM cum a JOIN cum b ON a.i <= b.i),
ends AS (SELECT a, b AS i, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS least FROM means),
rates AS (SELECT score, max(least) AS rate FROM ends JOIN cum USING (i) GROUP BY score),
around AS (SELECT s.score, max(struct_pack(x := r.score, v := r.rate)) FILTER (WHERE r.score <= s.score) AS a,
    min(struct_pack(x := r.score, v := r.rate)) FILTER (WHERE r.score >= s.score) AS b
  FROM (SELECT DISTINCT score FROM scored) s, rates r GROUP BY s.score),
curve AS (SELECT score, CASE WHEN a IS NULL THEN b.v WHEN b IS NULL OR a.x = b.x THEN a.v
    ELSE a.v + (b.v - a.v) * (score - a.x) / (b.x - a.x) END AS calibrated FROM around)"""

query("platt_calibrate", with_ctes(SCORED + _POINTS_SQL + _newton_sql(), _ERRORS_SQL))(_calibrated(models.platt))
query("isotonic_calibrate", with_ctes(SCORED + _POINTS_SQL + _MAX_MIN_SQL, _ERRORS_SQL))(_calibrated(models.isotonic))


@query("tune_walk_forward")
def tune_walk_forward(spark, d):
    grid = [{"maxDepth": 3}, {"maxDepth": 5}, {"maxDepth": 5, "minInstancesPerNode": 20}]
    folds = [(cut, cut + splits.WALK_WIDTH) for cut in splits.WALK_CUTS]
    return models.tune(frame(spark, d), FEATURES, "tree", grid, folds, patience=2)


@query("walk_forward_models")
def walk_forward_models(spark, d):
    """Spread of a forest's average precision over walk-forward folds, per embargo."""
    folds = splits.fold_table(spark, embargos=splits.EMBARGOS)
    ranked = models.walk_forward_models(frame(spark, d), FEATURES, folds, "forest", numTrees=10, maxDepth=6)
    return splits.embargo_summary(stored(ranked, "folds"))


@query("refit_and_seal")
def refit_and_seal(spark, d):
    out = models.refit_and_seal(frame(spark, d), FEATURES, "tree", 480, 600)
    return out.select("row_num", "y", "score", "threshold", "alert")


@query("batch_score")
def batch_score(spark, d):
    rows = frame(spark, d)
    path = fresh_dir(spark, "model")
    models.save(models.fit("logistic", rows.where("step <= 480"), FEATURES), spark, path, "7")
    model, version = models.load(spark, path)
    out = models.batch_score(model, rows, FEATURES, 0.5, version)
    return out.select("row_num", "fraud_score", "decision", "model_version", "feature_schema_version")


@query("loo_ablation")
def loo_ablation(spark, d):
    rows = frame(spark, d)
    return models.ablation(rows.where("step <= 480"), rows.where("step > 480"), FEATURES)


@query("permutation_importance")
def permutation_importance(spark, d):
    rows = frame(spark, d)
    model = models.fit("tree", rows.where("step <= 480"), FEATURES)
    return models.permutation_importance(model, rows.where("step > 480"), FEATURES)


@query("importance_comparison")
def importance_comparison(spark, d):
    rows = frame(spark, d)
    model = models.fit("forest", rows.where("step <= 480"), FEATURES, numTrees=10, maxDepth=6)
    return models.compare_importance(model, rows.where("step > 480"), FEATURES, repeats=2)


RANKED = ["amount", "oldbalance_org", "newbalance_orig", "oldbalance_dest", "newbalance_dest", "step"]
_HALF_SQL = " UNION ALL ".join(
    f"SELECT {h} AS half, '{f}' AS feature, abs(corr({f}, CAST(is_fraud AS INTEGER))) AS strength FROM ledger WHERE row_num % 2 = {h}"
    for h in (0, 1) for f in RANKED)


@query("rank_agreement", with_ctes(LEDGER, f""", strengths AS ({_HALF_SQL}),
  ranks AS (SELECT half, feature, rank() OVER (PARTITION BY half ORDER BY rnd(strength, 6) DESC) AS r FROM strengths),
  sides AS (SELECT a.feature, a.r AS ra, b.r AS rb, a.r + (count(*) OVER (PARTITION BY a.r) - 1) / 2.0::DOUBLE AS ma,
      b.r + (count(*) OVER (PARTITION BY b.r) - 1) / 2.0::DOUBLE AS mb FROM ranks a JOIN ranks b USING (feature) WHERE a.half = 0 AND b.half = 1),
  pairs AS (SELECT sign(x.ra - y.ra)::DOUBLE AS sa, sign(x.rb - y.rb)::DOUBLE AS sb FROM sides x JOIN sides y ON x.feature < y.feature)
  SELECT (SELECT count(*) FROM sides) AS features, rnd((SELECT corr(ma, mb) FROM sides), 6) AS spearman,
    count(*) FILTER (WHERE sa * sb > 0) AS same_order, count(*) FILTER (WHERE sa * sb < 0) AS opposite_order,
    rnd(sum(sa * sb) / nullif(sqrt(sum(sa * sa) * sum(sb * sb)), 0), 6) AS kendall FROM pairs"""))
def rank_agreement(spark, d):
    """How the strength of the raw columns ranks in one half of the ledger and in the other."""
    rows = ledger(spark, d)
    halves = []
    for half in (0, 1):
        strengths = rows.where(f"row_num % 2 = {half}").selectExpr(
            *[f"abs(corr({f}, CAST(is_fraud AS INT))) AS {f}" for f in RANKED]).unpivot([], RANKED, "feature", "strength")
        halves.append(rounded(strengths, "strength").selectExpr("feature", "rank() OVER (ORDER BY strength DESC) AS importance_rank"))
    return rounded(models.rank_agreement(*halves), "spearman", "kendall")


@query(
    "model_compat",
    """SELECT event_type AS model_name, 'v' || event_id AS version, epoch_us(ts) AS created_us FROM events
      WHERE 1 + CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 3 = 1""",
)
def model_compat(spark, d):
    """Events read as registered model versions; those for other feature versions are refused."""
    versions = fixture.table(spark, d, "events").selectExpr(
        "event_type AS model_name", "concat('v', event_id) AS version", f"{micros('ts')} AS created_us",
        "1 + CAST(get_json_object(props, '$.k') AS BIGINT) % 3 AS feature_schema_version")
    return models.compatible(versions).select("model_name", "version", "created_us")
