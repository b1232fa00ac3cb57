import random

import pytest

from txnlens.operators import entity, pit


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out, step = [], 1
    for i in range(1, 401):
        step += rng.choice([0, 0, 1, 2, 30])
        dest = "C0" if i % 3 == 0 else f"{rng.choice('CM')}{rng.randrange(6)}"
        out.append((i, step, rng.choice(["TRANSFER", "CASH_OUT", "PAYMENT"]), rng.randrange(1, 9000) / 100, f"C{rng.randrange(8)}", dest, False))
    return out


SCHEMA = "row_num long, step long, txn_type string, amount double, account_id string, dest_id string, is_fraud boolean"


def test_point_in_time_features_equal_range_scan(spark, rows):
    got = {r.row_num: r for r in pit.pit_frame(spark.createDataFrame(rows, SCHEMA)).collect()}
    scored = [r for r in rows if r[2] != "PAYMENT" and r[5].startswith("C")]
    assert got.keys() == {r[0] for r in scored}
    for i, step, _, amount, _, dest, _ in scored:
        past = [r for r in rows if r[5] == dest and step - 168 <= r[1] <= step - 1]
        within = lambda h: [r for r in past if r[1] >= step - h]
        r = got[i]
        assert (r.pit_prior_count_1h, r.pit_prior_count_24h) == (len(within(1)), len(within(24)))
        for h in (1, 24, 168):
            assert r[f"pit_prior_amount_{h}h"] == pytest.approx(sum(x[3] for x in within(h)))
        for h in (24, 168):
            assert r[f"pit_distinct_senders_{h}h"] == len({x[4] for x in within(h)})
        assert r.pit_steps_since_last_event == (step - max(x[1] for x in past) if past else 999)


@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_entity_history_in_row_order(spark, rows, hot_rows):
    df = entity.capable(spark.createDataFrame(rows, SCHEMA))
    got = {r.row_num: r for r in entity.edge_history(entity.history(df, "dest_id", "dest", hot_rows), hot_rows).collect()}
    kept = [r for r in rows if r[2] != "PAYMENT"]
    for i, _, _, amount, orig, dest, _ in kept:
        past = [r[3] for r in kept if r[5] == dest and r[0] < i]
        mean = sum(past) / (len(past) + 1)
        r = got[i]
        assert r.dest_count_hist == len(past)
        assert r.dest_amount_mean_hist == pytest.approx(mean)
        assert r.amount_to_dest_mean_ratio == pytest.approx(amount / (mean + 1))
        assert r.edge_count_hist == sum(1 for x in kept if x[4] == orig and x[5] == dest and x[0] < i)


def test_velocity_counts_the_whole_bucket_and_strict_only_the_past(spark, rows):
    df = entity.capable(spark.createDataFrame(rows, SCHEMA))
    both = entity.velocity_strict(entity.velocity(df, "dest_id", "dest"), "dest_id", "past")
    kept = [r for r in rows if r[2] != "PAYMENT"]
    for r in both.collect():
        same = [x for x in kept if x[5] == r.dest_id]
        assert r.dest_velocity_1h == sum(x[1] == r.step for x in same)
        assert r.dest_velocity_24h == sum(x[1] // 24 == r.step // 24 for x in same)
        assert r.past_prior_24h == sum(r.step - 24 <= x[1] <= r.step - 1 for x in same)


def test_mule_motifs(spark):
    rows = [
        (1, 5, "TRANSFER", 100.0, "C1", "C2", True),
        (2, 5, "CASH_OUT", 100.0, "C2", "C9", False),   # same step: not a mule
        (3, 8, "CASH_OUT", 90.0, "C2", "C9", True),     # rapid and close in amount
        (4, 8, "CASH_OUT", 10.0, "C2", "C9", False),    # amount too different
        (5, 20, "CASH_OUT", 100.0, "C2", "C9", False),  # too late to be rapid
        (6, 4, "TRANSFER", 7.0, "C3", "C2", False),     # earlier step, later row: first step but not first amount
        (7, 9, "CASH_OUT", 100.0, "C7", "C9", False),
    ]
    got = {r.row_num: (r.is_mule_chain, r.mule_time_since_transfer, r.is_rapid_passthrough)
           for r in entity.mule_features(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2] == (1, 1, 1) and got[3] == (1, 4, 1) and got[4] == (1, 4, 0) and got[5] == (1, 16, 0)
    assert got[7] == (0, 0, 0) and got[1] == (0, 0, 0)


def test_round_and_cap_flags(spark):
    rows = [(1, 6, "TRANSFER", 10_000_000.0, "C1", "C2", True), (2, 6, "CASH_OUT", 3000.0, "C1", "C2", True), (3, 6, "CASH_OUT", 0.0, "C1", "C2", True)]
    df = spark.createDataFrame(rows, SCHEMA)
    loose = {r.row_num: (r.is_round_1k, r.is_round_10k, r.is_capped_10m, r.is_night) for r in entity.stateless(df).collect()}
    strict = {r.row_num: (r.is_round_1k, r.is_round_10k, r.is_capped_10m, r.is_night) for r in entity.stateless(df, 6, True).collect()}
    assert loose == {1: (1, 1, 1, 0), 2: (1, 0, 0, 0), 3: (1, 1, 0, 0)}
    assert strict == {1: (1, 1, 1, 1), 2: (1, 0, 0, 1), 3: (0, 0, 0, 1)}
