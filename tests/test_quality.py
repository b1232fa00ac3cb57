import numpy as np
import pytest

from txnlens.operators import quality as q
from txnlens.operators import splits
from txnlens.operators.account import account_features

from helpers import frame, txn


def test_non_finite_catches_nan_and_infinity(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (float("inf"), 2.0), (float("-inf"), None)], "a double, b double")
    assert {r.column: r.non_finite for r in q.non_finite(df, ["a", "b"]).collect()} == {"a": 2, "b": 1}


def test_timestamp_order_readings_differ_on_ties(spark):
    rows = [txn(1, "A", 1, 1, ts=10), txn(2, "A", 1, 1, ts=10), txn(3, "A", 1, 1, ts=5), txn(4, "B", 1, 1, ts=1)]
    r = q.ts_order_violations(frame(spark, rows)).first()
    assert (r.not_after_previous, r.before_previous) == (2, 1)


def test_fraud_rate_of_empty_table_fails(spark):
    assert q.fraud_rate(frame(spark, []), 0.0, 1.0).first().within is False


def test_expected_rows_sees_gaps_and_repeats(spark):
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "row_num long")
    assert q.expected_rows(ids([1, 2, 3])).first().dense
    assert not q.expected_rows(ids([1, 3])).first().dense
    assert not q.expected_rows(ids([1, 2, 2])).first().dense
    assert not q.expected_rows(ids([1, 2]), expected=3).first().dense


def test_suite_reports_a_failure(spark):
    rows = [txn(1, "A", 1, 5, fraud=True), txn(2, "A", 2, 5), txn(3, "B", 1, 5)]
    silver = frame(spark, rows)
    got = {r.check: r.status for r in q.suite(silver, silver, account_features(silver), 0.0, 0.1).collect()}
    assert got["fraud_rate"] == "fail" and got["label_types"] == "fail"
    assert got["row_parity"] == got["first_txn"] == got["ts_strict"] == got["no_infinite"] == "pass"


@pytest.mark.parametrize("sketch, inside", [(50, 100_000), (50, 20), (10_000, 100_000), (10_000, 0)])
def test_feature_stats_are_exact(spark, sketch, inside):
    rng = np.random.default_rng(4)
    vals = np.round(np.concatenate([rng.exponential(50, 3000), np.full(1500, 7.0)]), 3)
    df = spark.createDataFrame([(float(v), None if i % 5 else float(i)) for i, v in enumerate(vals)], "a double, b double")
    got = {r.feature: r for r in q.feature_stats(df, ["a", "b"], sketch=sketch, inside=inside).collect()}
    b = np.arange(0, len(vals), 5)
    for name, v in (("a", vals), ("b", b)):
        assert got[name].n == len(v)
        assert [got[name][p] for p in ("p25", "p50", "p75")] == pytest.approx(list(np.percentile(v, [25, 50, 75])))
        assert got[name]["std"] == pytest.approx(np.std(v, ddof=1))


def test_sampled_sketches_only_propose(spark, monkeypatch):
    """Brackets from samples of 300 rows, some far off, still end at the exact quartiles."""
    monkeypatch.setattr(q, "SAMPLE", 300)
    df = spark.range(30_000).selectExpr(
        "CAST(id * 7919 % 30011 AS DOUBLE) AS a", "CASE WHEN id = 5 THEN 3D END AS rare", "CAST(id div 29999 AS DOUBLE) AS flag")
    got = {r.feature: r for r in q.feature_stats(df, ["a", "rare", "flag"], inside=500).collect()}
    a = np.arange(30_000) * 7919 % 30011
    assert [got["a"][p] for p in ("p25", "p50", "p75")] == list(np.percentile(a, [25, 50, 75]))
    assert (got["rare"].n, got["rare"].p50) == (1, 3.0) and got["flag"].p75 == 0.0


def test_brackets_close_in_level_by_level(spark, monkeypatch):
    """With a coarse sketch and few values allowed inside, brackets are sketched again and stay around their ranks."""
    levels = []
    narrow = q._narrow
    monkeypatch.setattr(q, "_narrow", lambda gold, brackets, sketch: (levels.append(max(b.inside for b in brackets)), narrow(gold, brackets, sketch)))
    df = spark.range(60_000).selectExpr("CAST(id * 7919 % 60013 AS DOUBLE) AS a", "CAST(id % 3 AS DOUBLE) AS b")
    got = {r.feature: r for r in q.feature_stats(df, ["a", "b"], sketch=100, inside=30).collect()}
    a = np.arange(60_000) * 7919 % 60013
    assert [got["a"][p] for p in ("p25", "p50", "p75")] == list(np.percentile(a, [25, 50, 75]))
    assert [got["b"][p] for p in ("p25", "p50", "p75")] == [0.0, 1.0, 2.0]
    assert len(levels) >= 2 and levels == sorted(levels, reverse=True) and levels[-1] < levels[0] / 10


def test_feature_stats_of_an_empty_feature(spark):
    df = spark.createDataFrame([(None,)], "a double")
    r = q.feature_stats(df, ["a"]).first()
    assert r.n == 0 and r["mean"] is None and r.p50 is None


def test_drift_shift(spark):
    a = spark.range(100).selectExpr("CAST(id AS DOUBLE) AS a")
    b = spark.range(100).selectExpr("CAST(id + 29 AS DOUBLE) AS a")
    r = q.drift(q.feature_stats(a, ["a"]), q.feature_stats(b, ["a"])).first()
    assert r.mean_shift == pytest.approx(29 / np.std(np.arange(100), ddof=1)) and r.spread_ratio == pytest.approx(1.0)


def test_stratified_split_is_exact_and_repeatable(spark):
    df = spark.range(1000).selectExpr("id AS row_num", "CAST(id % 10 = 0 AS INT) AS y")
    out = splits.split_random_stratified(df)
    n = {(r.y, r.split): r["count"] for r in out.groupBy("y", "split").count().collect()}
    assert n == {(0, "train"): 720, (0, "test"): 180, (1, "train"): 80, (1, "test"): 20}
    again = splits.split_random_stratified(df.repartition(5))
    assert out.exceptAll(again.select(*out.columns)).count() == 0


def test_stage_rejects_bad_cuts():
    with pytest.raises(ValueError):
        splits.stage(["a", "b"], (3, 2))


def test_walk_forward_embargo_shrinks_training_only(spark):
    df = spark.range(0, 1440).selectExpr("id AS row_num", "id div 2 + 1 AS step", "CAST(id % 7 = 0 AS INT) AS y")
    got = {(r.embargo, r.cut): r for r in splits.walk_forward(df, splits.fold_table(spark, embargos=(0, 24))).collect()}
    assert got[(24, 360)].train_rows == got[(0, 360)].train_rows - 48
    assert got[(24, 360)].test_rows == got[(0, 360)].test_rows == 110
    assert all(r.usable for r in got.values())
