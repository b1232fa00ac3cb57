import itertools

import numpy as np
import pytest

from txnlens.functions.schema import TXN_COLUMNS
from txnlens.operators import models, scoring
from txnlens.operators.account import account_features
from txnlens.operators.portable import array_model
from txnlens.operators.scoring import DEFAULT_MODEL, LogisticModel, score_requests, score_sequential
from txnlens.operators.state import (
    account_state, decoded, lookup_states, lookup_totals, merge_states, read_state_json, upsert_latest, with_state_json,
)
from txnlens.sources.events import read_scored_events
from txnlens.sources.state_log import StateLog
from txnlens.streaming.score_stream import stream_scores
from txnlens.streaming.state_stream import current_states, stream_state

from helpers import frame, txn

ROWS = [txn(1, "A", 3, 30), txn(2, "A", 1, 10), txn(3, "A", 2, 20), txn(4, "B", 1, 7, dest="C9")]


def by_account(df):
    return {r.account_id: r for r in df.collect()}


def test_out_of_order_equals_sorted(spark):
    a = by_account(account_state(frame(spark, ROWS)))["A"]
    assert (a.last_event_id, a.last_step, a.txn_count, a.amount_sum, a.amount_sqsum, a.max_amount) == ("e0001", 3, 3, 60.0, 1400.0, 30.0)
    assert a.first_event_ts_us == ROWS[1][10]


def test_late_event_keeps_the_anchor(spark):
    newer, late = frame(spark, [txn(1, "A", 5, 200)]), frame(spark, [txn(2, "A", 1, 50)])
    m = by_account(merge_states(account_state(newer), account_state(late)))["A"]
    assert (m.last_event_id, m.txn_count, m.amount_sum) == ("e0001", 2, 250.0)
    assert m.first_event_ts_us < m.last_event_ts_us


def test_merge_is_associative_and_commutative(spark):
    parts = [account_state(frame(spark, [r])) for r in ROWS]
    whole = sorted(map(tuple, account_state(frame(spark, ROWS)).collect()))
    for order in list(itertools.permutations(range(4)))[::5]:
        merged = parts[order[0]]
        for i in order[1:]:
            merged = merge_states(merged, parts[i])
        assert sorted(map(tuple, merged.collect())) == whole


def test_equal_timestamps_break_by_event_id(spark):
    rows = [txn(1, "A", 1, 5, ts=100), txn(2, "A", 1, 9, ts=100)]
    for order in (rows, rows[::-1]):
        assert by_account(account_state(frame(spark, order)))["A"].last_event_id == "e0002"


def test_json_round_trip_and_junk(spark):
    states = account_state(frame(spark, ROWS))
    stored = with_state_json(states)
    assert sorted(map(tuple, read_state_json(stored).collect())) == sorted(map(tuple, states.collect()))
    assert {r.state_key for r in stored.collect()} == {"txnlens:acct:v1:A", "txnlens:acct:v1:B"}
    good = {r.account_id: r.state_json for r in stored.collect()}["A"]
    junk = [("A", good), ("B", "{not json"), ("C", "[1]"), ("D", None), ("E", good.replace('"state_version":1', '"state_version":2')), ("F", "")]
    df = spark.createDataFrame(junk, "account_id string, state_json string")
    assert [r.account_id for r in decoded(df).where("state is not null").collect()] == ["A"]
    keys = spark.createDataFrame([(k,) for k in "ABZ"], "account_id string")
    looked_up = lookup_states(keys, df)
    assert {r.account_id: r.hit for r in looked_up.collect()} == {"A": True, "B": False, "Z": False}
    totals = lookup_totals(looked_up).first()
    assert (totals.requests, totals.hits, totals.misses, totals.unreadable) == (3, 1, 2, 1)


@pytest.mark.parametrize("ties,want", [("keep", "old"), ("take", "new")])
def test_upsert_ties_and_staleness(spark, ties, want):
    schema = "account_id string, v string, updated_at_us long"
    stored = spark.createDataFrame([("A", "old", 10), ("B", "old", 10), ("C", "old", 10)], schema)
    incoming = spark.createDataFrame([("A", "new", 10), ("B", "new", 9), ("C", "new", 11), ("D", "new", 1)], schema)
    got = {r.account_id: r.v for r in upsert_latest(stored, incoming, ties).collect()}
    assert got == {"A": want, "B": "old", "C": "new", "D": "new"}
    kept = upsert_latest(stored, incoming, ties, ttl_us=5, now_us=12)
    assert {r.account_id for r in kept.collect()} == {"A", "B", "C"}


def test_upsert_rejects_unknown_rule(spark):
    with pytest.raises(ValueError):
        upsert_latest(None, None, ties="maybe")


def test_stream_restart_never_counts_twice(spark, tmp_path):
    src, ckpt, out = (str(tmp_path / x) for x in ("src", "ckpt", "out"))
    frame(spark, [txn(1, "A", 1, 10)]).select(*TXN_COLUMNS).coalesce(1).write.json(src)
    stream_state(spark, src, ckpt, out).awaitTermination()
    assert by_account(current_states(spark, out))["A"].txn_count == 1
    stream_state(spark, src, ckpt, out).awaitTermination()  # nothing new
    frame(spark, [txn(2, "A", 1, 5, ts=1)]).select(*TXN_COLUMNS).coalesce(1).write.mode("append").json(src)
    stream_state(spark, src, ckpt, out).awaitTermination()
    a = by_account(current_states(spark, out))["A"]
    # the second event is late: totals are corrected although the freshness stays
    assert (a.txn_count, a.amount_sum, a.last_event_id) == (2, 15.0, "e0001")


def sequential(spark, rows, model, seeds=None):
    """Row-by-row recurrence over natively computed features."""
    import math

    feats = sorted(account_features(frame(spark, rows)).collect(), key=lambda r: (r.account_id, r.event_ts_us, r.event_id))
    last, out = dict(seeds or {}), {}
    for r in feats:
        m = model.intercept + sum(w * (r[n] or 0.0) for n, w in model.weights.items())
        p = 1 / (1 + math.exp(-(m + model.feedback * last.get(r.account_id, 0.0))))
        out[r.event_id] = last[r.account_id] = p
    return out


@pytest.mark.parametrize("hot_rows", [7, 10_000])
@pytest.mark.parametrize("feedback", [0.9, -2.5, 40.0])
def test_sequential_scoring_equals_recurrence(spark, hot_rows, feedback):
    rows = [txn(i, "A" if i % 3 else "B", 1 + i // 2, 10 + (i * 37) % 90, "TRANSFER" if i % 4 else "PAYMENT") for i in range(1, 120)]
    model = LogisticModel(DEFAULT_MODEL.intercept, DEFAULT_MODEL.weights, feedback)
    got = {r.event_id: r.fraud_score for r in score_sequential(frame(spark, rows), model, 0.5, hot_rows=hot_rows).collect()}
    want = sequential(spark, rows, model)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-13) for k in want)


def test_sequential_scoring_starts_from_stored_score(spark):
    rows = [txn(1, "A", 1, 10), txn(2, "A", 2, 20)]
    whole = sequential(spark, rows, DEFAULT_MODEL)
    first = frame(spark, rows[:1]).selectExpr("*", f"{whole['e0001']!r}D AS s")
    got = score_sequential(frame(spark, rows[1:]), DEFAULT_MODEL, 0.5, states=account_state(first, score="s")).first()
    assert got.had_prev_state and got.fraud_score == pytest.approx(whole["e0002"], abs=1e-13)


def test_features_continue_from_stored_states(spark):
    rows = [txn(i, "AB"[i % 2], 1 + i // 3, 5 + (i * 31) % 70, "TRANSFER" if i % 3 else "PAYMENT", f"C{i % 4}") for i in range(1, 40)]
    whole = {r.event_id: r for r in account_features(frame(spark, rows)).collect()}
    states = account_state(frame(spark, rows[:22]))
    for hot_rows in (4, 1000):
        rest = account_features(frame(spark, rows[22:]), states=states, hot_rows=hot_rows).collect()
        assert len(rest) == 17 and all(r == whole[r.event_id] for r in rest)


def test_late_row_is_compared_with_the_stored_anchor(spark):
    states = account_state(frame(spark, [txn(1, "A", 9, 100, "TRANSFER")]))
    late = account_features(frame(spark, [txn(2, "A", 2, 10), txn(3, "A", 3, 10)]), states=states).collect()
    assert {r.prev_txn_type for r in late} == {"TRANSFER"} and {r.txn_count_prior for r in late} == {1.0, 2.0}


def test_score_stream_equals_one_pass(spark, tmp_path):
    rows = [txn(i, "AB"[i % 2], 1 + i // 3, 5 + (i * 31) % 70, "TRANSFER" if i % 3 else "PAYMENT", f"C{i % 4}") for i in range(1, 30)]
    src, ckpt, scores, states = (str(tmp_path / x) for x in ("src", "ckpt", "scores", "states"))
    log = StateLog(states, compact_every=2)
    for part in (rows[:11], rows[11:20], rows[20:]):
        frame(spark, part).select(*TXN_COLUMNS).coalesce(1).write.mode("append").json(src)
        stream_scores(spark, src, ckpt, scores, log, DEFAULT_MODEL, 0.5).awaitTermination()
    got = {r.event_id: r.fraud_score for r in spark.read.parquet(scores).collect()}
    want = sequential(spark, rows, DEFAULT_MODEL)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-13) for k in want)
    last = by_account(log.current(spark))
    whole = by_account(account_state(frame(spark, rows)))
    assert {k: (r.txn_count, r.amount_sum, r.last_event_id) for k, r in last.items()} == {
        k: (r.txn_count, r.amount_sum, r.last_event_id) for k, r in whole.items()}
    assert last["A"].last_fraud_score == pytest.approx(want[last["A"].last_event_id], abs=1e-13)


def many(n=90):
    return [txn(i, "ABC"[i % 3 if i % 7 else 0], 1 + i // 4, 5 + (i * 31) % 70, "TRANSFER" if i % 3 else "PAYMENT", f"C{i % 4}") for i in range(1, n)]


@pytest.mark.parametrize("kind", ["tree", "forest", "gbt", "logistic"])
def test_array_model_gives_the_fitted_models_probabilities(spark, kind):
    rows = spark.range(700).selectExpr(
        "CAST(id % 7 = 0 OR id % 11 < 3 AS INT) AS y", "CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(id % 7 AS DOUBLE) END AS a",
        "CASE WHEN id % 13 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(id % 11 AS DOUBLE) END AS b", "CAST(id * 37 % 101 AS DOUBLE) AS c")
    fitted = models.fit(kind, rows, ["a", "b", "c"], **({"maxDepth": 6} if kind != "logistic" else {}))
    got = models.score(fitted, rows, ["a", "b", "c"]).collect()
    x = np.array([[np.nan if r[f] is None else r[f] for f in "abc"] for r in got])
    assert np.allclose(array_model(spark, fitted).predict(x), [r.score for r in got], atol=1e-12)


@pytest.mark.parametrize("kind", ["tree", "logistic"])
@pytest.mark.parametrize("batch", [4, 10_000])
def test_fitted_models_fold_as_row_by_row(spark, kind, batch):
    """The fold equals one prediction at a time, with the previous score among the features."""
    names = ["amount_ratio_vs_prior_max", "amount_z_vs_prior", "dest_is_new", "prev_fraud_score"]
    rows = many()
    seen = account_features(frame(spark, rows).selectExpr("*", "amount / 100 AS s"), score="s")
    model = array_model(spark, models.fit(kind, seen.selectExpr(*names, "CAST(amount % 3 < 1 OR coalesce(prev_fraud_score, 0D) > 0.5 AS INT) AS y"), names))
    feats = sorted(account_features(frame(spark, rows)).collect(), key=lambda r: (r.account_id, r.event_ts_us, r.event_id))
    last, want = {}, {}
    for r in feats:
        values = [last.get(r.account_id) if n == "prev_fraud_score" else r[n] for n in names]
        p = model.predict(np.array([[np.nan if v is None else v for v in values]]))[0]
        want[r.event_id] = last[r.account_id] = p
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.event_id: r.fraud_score for r in score_sequential(frame(spark, rows), model, 0.5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert len({round(v, 9) for v in want.values()}) > 2


def test_requests_commit_dry_run_and_restart(spark, tmp_path, monkeypatch):
    log, logged = StateLog(str(tmp_path / "states"), compact_every=2), str(tmp_path / "events")
    rows = many(40)
    want = sequential(spark, rows, DEFAULT_MODEL)

    def ask(part, **options):
        asked = frame(spark, part[::-1]).selectExpr("*", "CAST(-row_number() OVER (ORDER BY event_ts_us, event_id) AS BIGINT) AS request_no")
        return score_requests(asked, DEFAULT_MODEL, 0.5, log, logged, **options).collect()

    assert not [r for r in ask(rows[:3], dry_run=True) if r.event_id == "e0001" and r.had_prev_state]
    assert log.batches(spark) == [] and not (tmp_path / "events").exists()
    first = ask(rows[:15])
    assert [r.request_no for r in first] == sorted(r.request_no for r in first)  # not the order of the fold
    dry = {r.event_id: r.fraud_score for r in ask(rows[15:28], dry_run=True)}
    assert log.batches(spark) == [0]
    monkeypatch.setattr(scoring, "merge_states", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):  # events are out, the states are not
        ask(rows[15:28])
    monkeypatch.undo()
    again = {r.event_id: r.fraud_score for r in ask(rows[15:28])}
    rest = ask(rows[28:])
    assert again == dry and all(r.had_prev_state for r in rest)
    got = {r.event_id: r.fraud_score for r in [*first, *rest]} | again
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-13) for k in want)
    events = read_scored_events(spark, logged)
    assert events.count() == len(rows) + 13 and events.select("event_id", "fraud_score").distinct().count() == len(rows)
    assert by_account(log.current(spark))["A"].last_fraud_score == pytest.approx(want[by_account(log.current(spark))["A"].last_event_id], abs=1e-13)


def test_log_reads_snapshot_and_tail_and_survives_a_broken_compaction(spark, tmp_path):
    log = StateLog(str(tmp_path / "log"), compact_every=3)
    states = [account_state(frame(spark, [txn(k, "AB"[k % 2], k, 10 * k), txn(50 + k, f"K{k}", k, 1)])) for k in range(8)]
    for k in range(5):
        log.write(states[k], k)
    assert [s.rsplit("/", 1)[1] for s in log.sources(spark, 5)] == ["through=2", "batch_id=3", "batch_id=4"]
    whole = by_account(log.current(spark))
    assert len(whole) == 7 and (whole["A"].last_amount, whole["B"].last_amount) == (40, 30)
    # a compaction that dies before its marker changes nothing, and its repeat counts
    log.compact(spark, 4)
    (tmp_path / "log_snapshots" / "through=4" / "_SUCCESS").unlink()
    assert by_account(log.current(spark)) == whole and log.sources(spark, 5)[0].endswith("through=2")
    log.compact(spark, 4)
    assert by_account(log.current(spark)) == whole and [s.rsplit("/", 1)[1] for s in log.sources(spark, 5)] == ["through=4"]
    # a repeated batch sees what it saw first
    seen = by_account(log.before(spark, 4))
    log.write(states[4], 4)
    assert by_account(log.before(spark, 4)) == seen and by_account(log.current(spark)) == whole
    assert log.prune(spark) == 3 and log.batches(spark) == [3, 4] and by_account(log.current(spark)) == whole
    for k in (5, 6, 7):
        log.write(states[k], k)
    assert len(by_account(log.current(spark))) == 10 and log.next_batch(spark) == 8
