import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from txnlens.operators import frontier, models, pit
from txnlens.plans.models import FEATURES, frame

SF = "/root/testdata/sf0.01"
FEW = ["current_amount", "transaction_type_transfer", "pit_prior_count_24h", "pit_distinct_senders_168h"]


@pytest.fixture(scope="module")
def rows(spark):
    return frame(spark, SF)


def test_fit_score_and_version_guard(spark, rows, tmp_path):
    model = models.fit("tree", rows.where("step <= 480"), FEATURES)
    scored = models.score(model, rows, FEATURES)
    assert scored.count() == rows.count()
    assert scored.where("score < 0 OR score > 1").count() == 0
    models.save(model, spark, str(tmp_path / "m"), "3")
    back, version = models.load(spark, str(tmp_path / "m"))
    assert version == "3"
    assert models.score(back, rows, FEATURES).exceptAll(scored).count() == 0
    spark.createDataFrame([("4", 99)], "version string, feature_schema_version int").write.mode("overwrite").json(str(tmp_path / "m" / "meta"))
    with pytest.raises(ValueError, match="feature version 99"):
        models.load(spark, str(tmp_path / "m"))


def test_balanced_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "y int")
    w = models.balanced(df).groupBy("y").sum("weight").collect()
    assert all(r["sum(weight)"] == pytest.approx(2.0) for r in w)


def test_calibration_is_monotone_and_helps(spark):
    from txnlens.operators.metrics import calibration_errors
    from txnlens.plans import inputs

    s = inputs.scored(spark, SF).select("row_num", "step", "y", "amount", "score")
    for fn in (models.platt, models.isotonic):
        out = fn(s, "step <= 480").cache()
        pairs = [(r.score, r.calibrated) for r in out.select("score", "calibrated").distinct().orderBy("score").collect()]
        assert all(a[1] <= b[1] + 1e-12 for a, b in zip(pairs, pairs[1:]))
        assert calibration_errors(out, score="calibrated").first().brier < calibration_errors(out).first().brier


def test_permuting_the_only_signal_hurts_most(spark):
    base = spark.range(2000).selectExpr(
        "id AS row_num", "CAST(id % 10 = 0 AS INT) AS y", "1D AS amount",
        "CAST(id % 10 = 0 AS DOUBLE) + rand(1) * 0.1 AS signal", "rand(2) AS noise")
    df = spark.createDataFrame(base.collect(), base.schema)
    model = models.fit("tree", df, ["signal", "noise"])
    got = {r.feature: r for r in models.permutation_importance(model, df, ["signal", "noise"], repeats=2).collect()}
    assert got["signal"].importance > 0.5 and got["signal"].importance_rank == 1
    assert abs(got["noise"].importance) < 0.05
    loo = {r.feature: r for r in models.ablation(df, df, ["signal", "noise"]).collect()}
    assert loo["signal"].delta > 0.5 and loo["signal"].keep


def test_seal_uses_later_rows_only(rows):
    out = models.refit_and_seal(rows, FEW, "tree", 480, 600)
    assert out.selectExpr("min(step)").first()[0] > 600
    assert out.where("alert <> (score >= threshold)").count() == 0


def test_tuning_stops_after_patience(rows):
    grid = [{"maxDepth": 2}] * 4
    got = models.tune(rows, FEW, "tree", grid, [(480, 535)], patience=1).collect()
    assert len(got) == 2


def test_score_matrix_is_long(rows):
    m = models.score_matrix(rows, FEW, ["tree"], {"a": "step <= 300", "b": "step <= 480"})
    assert m.count() == 2 * rows.count()
    assert {r.train_key for r in m.select("train_key").distinct().collect()} == {"a", "b"}
    assert frontier.ranking_metrics(m, ["model", "train_key"]).count() == 2


def test_frame_has_the_declared_features(rows):
    assert set(pit.PIT_FEATURES) <= set(rows.columns)


def pooled(values):
    """Least squares rising fit by pooling adjacent violators."""
    out = []
    for score, pos, n in values:
        out.append([[score], pos, n])
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            last = out.pop()
            out[-1] = [out[-1][0] + last[0], out[-1][1] + last[1], out[-1][2] + last[2]]
    return {s: p / n for scores, p, n in out for s in scores}


@pytest.mark.parametrize("kind, limit", [("noise", 8), ("rising", 8), ("falling", 8), ("noise", 10_000)])
def test_isotonic_in_ranges_equals_one_pass(spark, kind, limit):
    rng = random.Random(8)
    rate = {"noise": lambda k: rng.random(), "rising": lambda k: k / 60, "falling": lambda k: 1 - k / 60}[kind]
    points = [(k / 7, float(round(20 * rate(k))), 20.0) for k in range(60)]
    blocks = models.isotonic_blocks(spark.createDataFrame(points, "score double, pos double, n double"), limit).collect()
    want = pooled(points)
    got = {s: b.pos / b.n for s, *_ in points for b in blocks if b.lo <= s <= b.hi}
    assert got == want and len(blocks) == len(set(want.values()))


def test_isotonic_curve_between_and_beyond_its_knots(spark):
    rows = [(float(s), y, "fit") for s, y in ((1, 0), (2, 1), (2, 0), (4, 0), (4, 1), (6, 1))] + [(s, 0, "ask") for s in (0.0, 1.5, 3.0, 5.0, 9.0)]
    frame_ = spark.createDataFrame(rows, "score double, y int, part string")
    for limit in (2, 100):
        got = {r.score: r.calibrated for r in models.isotonic(frame_, "part = 'fit'", limit).collect()}
        assert got == {0.0: 0.0, 1.0: 0.0, 1.5: 0.25, 2.0: 0.5, 3.0: 0.5, 4.0: 0.5, 5.0: 0.75, 6.0: 1.0, 9.0: 1.0}


def test_two_rankings_agree_as_counted(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "feature string, importance_rank int")
    b = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2), ("d", 4)], "feature string, importance_rank int")
    r = models.rank_agreement(a, b).first()
    assert (r.features, r.same_order, r.opposite_order) == (4, 5, 1)
    assert r.spearman == pytest.approx(0.8) and r.kendall == pytest.approx(4 / 6)
    tied = spark.createDataFrame([(x, 1) for x in "abcd"], "feature string, importance_rank int")
    assert models.rank_agreement(a, tied).first().kendall is None


def test_importance_by_two_methods(spark):
    base = spark.range(1500).selectExpr(
        "id AS row_num", "CAST(id % 10 = 0 AS INT) AS y", "1D AS amount", "CAST(id % 10 = 0 AS DOUBLE) AS signal", "CAST(id * 37 % 101 AS DOUBLE) AS noise")
    model = models.fit("tree", base, ["signal", "noise"])
    got = {r.feature: r for r in models.compare_importance(model, base, ["signal", "noise"], repeats=1).collect()}
    assert (got["signal"].permutation_rank, got["signal"].impurity_rank) == (1, 1) and got["signal"].impurity > 0.9
    assert {r.features for r in got.values()} == {2}


@pytest.mark.parametrize("kind", ["forest", "logistic", "gbt"])
def test_models_score_in_a_session_that_has_observed(spark, kind):
    """Observations make the session unfit to travel; a fitted model must not drag it along."""
    seen = Observation("seen")
    spark.range(3).observe(seen, F.expr("count(1) AS n")).collect()
    rows = spark.range(300).selectExpr("CAST(id % 3 = 0 AS INT) AS y", "CAST(id % 3 AS DOUBLE) AS a", "CAST(id AS DOUBLE) AS b")
    fitted = models.fit(kind, rows, ["a", "b"], **({"maxDepth": 2} if kind != "logistic" else {}))
    assert seen.get["n"] == 3 and models.score(fitted, rows, ["a", "b"]).where("(y = 1) = (score > 0.5)").count() >= 200


def test_folds_learn_from_their_past_alone(spark):
    """The label follows ``a`` up to step 60 and its opposite later; an embargo decides whether training has seen the change."""
    rows = spark.range(2000).selectExpr("id AS row_num", "id div 20 AS step", "CAST(id % 2 AS DOUBLE) AS a", "1D AS amount").selectExpr(
        "*", "CAST(CASE WHEN step <= 60 THEN a = 1 ELSE a = 0 END AS INT) AS y")
    folds = spark.createDataFrame([(0, 50, 50, 60), (0, 90, 90, 99), (40, 90, 50, 99), (0, 5, -1, 10), (0, 200, 200, 210)],
                                  "embargo int, cut int, train_end int, test_end int")
    got = {(r.embargo, r.cut): r for r in models.walk_forward_models(rows, ["a"], folds, "tree", maxDepth=2).collect()}
    assert sorted(got) == [(0, 50), (0, 90), (40, 90)]
    assert got[0, 50].roc_auc == 1.0 and got[40, 90].roc_auc == 0.0 and got[0, 50].rows == 200


def test_large_tables_are_spread_over_files_for_fits(spark):
    rows = spark.range(1000).coalesce(1)
    cut = models.spread(rows, 100)
    assert len(cut.inputFiles()) == 10 and cut.agg(F.sum("id"), F.count("id")).first()[:] == (499500, 1000)
    assert max(r["count"] for r in cut.groupBy(F.input_file_name()).count().collect()) <= 150
    assert models.spread(rows, 1000) is rows
