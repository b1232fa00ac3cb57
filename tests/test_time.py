import random

import pytest

from txnlens.functions import columns as c
from txnlens.operators.medallion import to_silver, with_event_ts

from helpers import EPOCH, HOUR


def test_timestamp_formula_is_exact(spark):
    rng = random.Random(3)
    cases = [(1, 1, 1), (1, 1, 8500), (1, 8500, 8500), (744, 1, 1), (500, 4250, 8500)]
    for _ in range(20_000):
        n = rng.randint(1, 60_000)
        cases.append((rng.randint(1, 744), rng.randint(1, n), n))
    df = spark.createDataFrame(cases, "step long, seq long, n long")
    got = df.selectExpr("step", "seq", "n", f"{c.event_ts_us('step', 'seq', 'n')} AS ts", f"{c.step_from_ts(c.event_ts_us('step', 'seq', 'n'))} AS back").collect()
    for r in got:
        assert r.ts == EPOCH + (r.step - 1) * HOUR + ((r.seq - 1) * HOUR) // r.n
        assert r.back == r.step


@pytest.mark.parametrize("step,want", [(1, (0, 0, 0)), (24, (0, 23, 0)), (25, (1, 0, 1)), (744, (30, 23, 2))])
def test_core_calendar(spark, step, want):
    df = spark.range(1).selectExpr(f"{step}L AS step")
    r = df.selectExpr(f"{c.core_day()} AS d", f"{c.core_hour()} AS h", f"{c.core_dow()} AS w").first()
    assert (r.d, r.h, r.w) == want


def test_hot_step_gets_the_same_timestamps(spark):
    bronze = spark.range(1, 501).selectExpr("id AS row_num", "CASE WHEN id < 400 THEN 3L ELSE id % 5 END AS step")
    plain, split = with_event_ts(bronze), with_event_ts(bronze, hot_rows=20)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, split.collect()))
    assert plain.select("event_ts_us").distinct().count() == 500


def test_silver_ids_are_padded(spark):
    from txnlens.plans import inputs

    first = to_silver(inputs.ledger(spark, "/root/testdata/sf0.001")).orderBy("bronze_row_num").first()
    assert first.event_id == "ps-0000000001"
