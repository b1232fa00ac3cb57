"""The skew audit over logs that online scoring wrote, late events included."""

import random

import pytest

from txnlens.functions.schema import NUMERIC_FEATURES, TXN_COLUMNS
from txnlens.operators.account import features_as_of
from txnlens.operators.quality import audit_log
from txnlens.operators.scoring import DEFAULT_MODEL, score_requests
from txnlens.sources.state_log import StateLog

from helpers import frame, txn


def rows():
    return [txn(i, "AB"[i % 5 == 0], 1 + i // 3, 5 + (i * 31) % 70, "TRANSFER" if i % 3 else "PAYMENT", f"C{i % 4}") for i in range(1, 40)]


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """What three batches logged; some events of early steps come with the later batches."""
    folder = tmp_path_factory.mktemp("served")
    parts = [[], [], []]
    for i, row in enumerate(rows()):
        parts[2 if i % 7 == 3 else 1 if i % 5 == 2 and i < 26 else min(i // 13, 2)].append(row)
    states = StateLog(str(folder / "states"))
    for k, part in enumerate(parts):
        asked = frame(spark, part).selectExpr("*", "event_ts_us AS request_no")
        score_requests(asked, DEFAULT_MODEL, 0.5, states, str(folder / "events"), scored_at=f"{(k + 1) * 10**16}").collect()
    return spark.read.text(str(folder / "events")).select("value")


@pytest.mark.parametrize("hot_rows", [3, 10_000])
def test_a_true_log_has_no_skew(log, hot_rows):
    got = audit_log(log, hot_rows).collect()
    assert sorted(r.feature for r in got) == sorted(NUMERIC_FEATURES)
    assert all((r.compared, r.mismatches) == (39, 0) for r in got)


def test_faults_of_the_log_are_counted(log):
    spoiled = log.selectExpr("regexp_replace(value, '\"dest_is_new\":1.0', '\"dest_is_new\":0.0') AS value")
    wrong = log.where("value LIKE '%\"dest_is_new\":1.0%'").count()
    more = log.selectExpr("replace(value, '\"scored_at_us\":', '\"scored_at_us\":9') AS value")  # repeats, written later
    got = {r.feature: (r.compared, r.mismatches) for r in audit_log(spoiled.unionByName(more)).collect()}
    assert wrong and got.pop("dest_is_new") == (39, wrong) and set(got.values()) == {(39, 0)}


def test_event_time_order_would_report_late_events(spark, log):
    """The same events audited as if each had been scored at its own time differ: the log has late events."""
    early = log.selectExpr("regexp_replace(value, '\"event_ts_us\":([0-9]+),\"scored_at_us\":[0-9]+', '\"event_ts_us\":$1,\"scored_at_us\":$1') AS value")
    assert sum(r.mismatches for r in audit_log(early).collect()) > 0


def test_features_as_of_equal_a_replay(spark):
    random.seed(5)
    order = rows()
    random.shuffle(order)
    known = {r["event_id"] if isinstance(r, dict) else r[TXN_COLUMNS.index("event_id")]: k // 2 for k, r in enumerate(order)}
    moments = spark.createDataFrame(list(known.items()), "event_id string, known_us long")
    events = frame(spark, order).select(*TXN_COLUMNS).join(moments, "event_id").selectExpr("*", "amount / 100 AS fraud_score")
    table = {r.event_id: r for r in events.collect()}
    for hot_rows in (4, 1000):
        for r in features_as_of(events, events, hot_rows=hot_rows).collect():
            own = table[r.event_id]
            place = (own.known_us, own.event_ts_us, own.event_id)
            past = [x for x in table.values() if x.account_id == own.account_id and (x.known_us, x.event_ts_us, x.event_id) < place]
            last = max(past, key=lambda x: (x.event_ts_us, x.event_id), default=None)
            assert r.txn_count_prior == len(past) and r.prev_txn_type == (last.txn_type if last else "__NONE__")
            assert r.prev_fraud_score == (last.fraud_score if last else None)
            assert r.amount_delta_vs_last == (own.amount - last.amount if last else None)
            assert r.amount_ratio_vs_prior_max == (pytest.approx(own.amount / max(x.amount for x in past)) if past else None)
