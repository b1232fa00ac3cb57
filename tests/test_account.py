import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txnlens.functions.schema import COLD_START_NULL, FEATURES, GOLD_COLUMNS
from txnlens.operators.account import account_features, check_schema, cold_start_violations, column_role, with_features

from helpers import close, expected_features, frame, txn


def features(spark, rows, **kw):
    return {r.event_id: r for r in account_features(frame(spark, rows), **kw).collect()}


def test_three_row_account(spark):
    rows = [txn(1, "A", 1, 100, "TRANSFER"), txn(2, "A", 2, 200, "CASH_OUT"), txn(3, "A", 4, 900, "TRANSFER")]
    third = features(spark, rows)["e0003"]
    assert third.amount_ratio_vs_prior_mean == pytest.approx(6.0)
    assert third.amount_ratio_vs_prior_max == pytest.approx(4.5)
    assert third.amount_z_vs_prior == pytest.approx(15.0)


def test_two_row_account(spark):
    rows = [txn(1, "A", 1, 100, ts=0), txn(2, "A", 3, 300, ts=7_200_000_000)]
    second = features(spark, rows)["e0002"]
    assert (second.seconds_since_last_txn, second.steps_since_last_txn) == (7200.0, 2.0)
    assert (second.amount_delta_vs_last, second.amount_ratio_vs_last, second.txn_count_prior) == (200.0, 3.0, 1.0)
    assert second.amount_z_vs_prior is None


def test_type_change_and_balance_gap(spark):
    rows = [txn(1, "A", 1, 100, "PAYMENT", old=1000, new=900), txn(2, "A", 2, 50, "CASH_OUT", old=950), txn(3, "B", 1, 100, old=1000, new=900), txn(4, "B", 2, 5, old=900)]
    got = features(spark, rows)
    assert (got["e0002"].type_pair, got["e0002"].type_changed) == ("PAYMENT->CASH_OUT", 1.0)
    assert (got["e0002"].balance_gap_org, got["e0002"].balance_gap_flag) == (50.0, 1.0)
    assert (got["e0004"].balance_gap_org, got["e0004"].balance_gap_flag) == (0.0, 0.0)


def test_zero_denominators_give_null(spark):
    rows = [txn(1, "A", 1, 0, old=0, new=0), txn(2, "A", 2, 500, old=0, new=0)]
    second = features(spark, rows)["e0002"]
    assert second.amount_ratio_vs_last is None
    assert second.amount_to_balance_ratio is None
    assert second.amount_ratio_vs_prior_mean is None


def test_cold_start(spark):
    gold = account_features(frame(spark, [txn(1, "A", 1, 10), txn(2, "A", 2, 20), txn(3, "B", 1, 5)]))
    assert gold.columns == GOLD_COLUMNS
    assert sum(r.violations for r in cold_start_violations(gold).collect()) == 0
    first = {r.event_id: r for r in gold.collect()}["e0003"]
    assert all(first[f] is None for f in COLD_START_NULL)
    assert (first.prev_txn_type, first.type_pair) == ("__NONE__", "__NONE__->PAYMENT")


def test_schema_guard_names_the_problem():
    with pytest.raises(ValueError, match="missing=\\['amount'\\]"):
        check_schema([c for c in GOLD_COLUMNS if c != "amount"])
    assert [column_role(c) for c in ("amount", "is_fraud", "account_id", "event_ts_us")] == ["feature", "target", "forbidden", "metadata"]


cents = st.integers(0, 10_000_000).map(lambda x: x / 100)
event = st.tuples(st.sampled_from("ABC"), st.integers(1, 744), cents, st.sampled_from(["PAYMENT", "TRANSFER", "CASH_OUT", "DEBIT", "CASH_IN"]), st.sampled_from(["M1", "C2", "C3"]))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(event, min_size=1, max_size=12), st.sampled_from([2, 1000]))
def test_features_equal_a_sequential_fold(spark, events, hot_rows):
    rows = [txn(i, a, s, v, t, d, old=v + 10) for i, (a, s, v, t, d) in enumerate(events)]
    got, want = features(spark, rows, hot_rows=hot_rows), expected_features(rows)
    for event_id, values in want.items():
        for name, value in values.items():
            if name == "amount_z_vs_prior" and value is None:
                continue  # near-constant amounts: the fold's own variance is noise
            assert close(got[event_id][name], value, rel=1e-6), (name, event_id)


def test_whole_ledger_equals_fold(spark):
    from txnlens.plans import inputs
    from helpers import NAMES

    silver = inputs.silver(spark, "/root/testdata/sf0.001")
    rows = [tuple(r[n] for n in NAMES) for r in silver.collect()]
    got, want = {r.event_id: r for r in account_features(silver, hot_rows=20).collect()}, expected_features(rows)
    assert len(got) == len(want) == 1000
    for event_id, values in want.items():
        for name, value in values.items():
            assert close(got[event_id][name], value, rel=1e-7), (name, event_id)


def test_features_stand_beside_their_rows_without_a_join(spark):
    rows = frame(spark, [txn(k, "AB"[k % 2], k, 10 * k, typ="CASH_OUT") for k in range(1, 9)]).withColumn("score", F.expr("step / 10D"))

    def joined(df):
        return df.select("event_id", "amount").join(
            account_features(df, "score").selectExpr("event_id", f"struct({', '.join(FEATURES)}) AS f"), "event_id")

    made = with_features(rows, ["event_id", "amount"], "score")
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    by_id = [{r.event_id: r for r in df.collect()} for df in (made, joined(rows))]
    assert made.dtypes == joined(rows).dtypes and by_id[0] == by_id[1] and len(by_id[0]) == 8
    odd = rows.unionByName(rows.limit(2)).unionByName(rows.limit(1).withColumn("event_id", F.lit(None).cast("string")))
    got = with_features(odd, ["event_id", "amount"], "score").collect()
    assert sorted(r.event_id for r in got) == sorted(r.event_id for r in joined(odd).collect()) and len(got) == 6 + 2 * 4
