import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from txnlens.operators.prefix import cumulate_desc, in_ranges, prior_rows, quantiles, recent_values


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows, another two rows, the rest is spread."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        rows.append((i, key, rng.randrange(200), round(rng.uniform(0, 500), 2)))
    rows += [(900, "rare", 5, 1.0), (901, "rare", 5, 2.0)]
    return rows, spark.createDataFrame(rows, "id long, k string, t long, v double")


def brute(rows):
    out = {}
    for i, k, t, v in rows:
        past = sorted((r for r in rows if r[1] == k and (r[2], r[0]) < (t, i)), key=lambda r: (r[2], r[0]))
        vals = [p[3] for p in past]
        out[i] = (len(vals), round(sum(vals), 2) if vals else None, min(vals, default=None), max(vals, default=None), past[-1][3] if past else None)
    return out


@pytest.mark.parametrize("hot_rows", [5, 50, 10_000])
def test_prior_rows_equals_brute_force(skewed, hot_rows):
    rows, df = skewed
    aggs = {
        "n": ("count", "1"), "s": ("sum", "CAST(v AS DECIMAL(18,2))"), "lo": ("min", "v"), "hi": ("max", "v"),
    }
    got = prior_rows(df, ["k"], "t", aggs, prev=["v"], tie=["id"], hot_rows=hot_rows).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        n, s, lo, hi, prev = want[r.id]
        assert (r.n, None if r.s is None else float(r.s), r.lo, r.hi) == (n, s, lo, hi)
        assert (r.prev.v if r.prev else None) == prev


@pytest.mark.parametrize("hot_rows", [4, 10_000])
def test_recent_values_crosses_chunks(skewed, hot_rows):
    rows, df = skewed
    got = {r.id: r.last for r in recent_values(df, ["k"], "t", ["id"], "v", 7, "last", hot_rows).collect()}
    for i, k, t, v in rows:
        past = sorted((r for r in rows if r[1] == k and (r[2], r[0]) <= (t, i)), key=lambda r: (r[2], r[0]))
        assert got[i] == [p[3] for p in past][-7:]


def test_cumulate_in_ranges_equals_single_window(skewed):
    _, df = skewed
    points = df.groupBy("k", "v").count().withColumnRenamed("count", "n")
    plain = cumulate_desc(points, ["k"], "v", ["n"])
    ranged = cumulate_desc(points, ["k"], "v", ["n"], limit=20)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, ranged.collect()))
    total = points.groupBy("v").sum("n").withColumnRenamed("sum(n)", "n")
    assert sorted(map(tuple, cumulate_desc(total, [], "v", ["n"]).collect())) == sorted(
        map(tuple, cumulate_desc(total, [], "v", ["n"], limit=20).collect()))


def test_ranges_of_tied_scores_are_shallow(spark):
    """99% of the rows share one score; the ranges follow the 2,001 distinct ones."""
    rows = spark.range(200_000).selectExpr("CASE WHEN id % 100 > 0 THEN 0.5D ELSE id / 200000D END AS v")
    points = rows.groupBy("v").agg(F.count("*").alias("n"))
    cut = in_ranges(points, [F.desc("v")], 100)
    depth = [r[0] for r in cut.groupBy("_chunk").count().select("count").collect()]
    assert max(depth) <= 200 and sum(depth) == points.count() >= 2000
    spans = cut.groupBy("_chunk").agg(F.min("v"), F.max("v")).orderBy("_chunk").collect()
    assert all(a[1] > b[2] for a, b in zip(spans, spans[1:]))  # descending and apart
    got = {r.v: r.n for r in cumulate_desc(points, [], "v", ["n"], limit=100).collect()}
    above = 0
    for v, n in sorted(((r.v, r.n) for r in points.collect()), reverse=True):
        above += n
        assert got[v] == above
    assert quantiles(rows, [], "v", {"m": 0.5, "z": 0.999}, limit=100).first() == quantiles(rows, [], "v", {"m": 0.5, "z": 0.999}).first()


def test_a_burst_is_cut_by_depth(spark):
    """19,999 of 20,000 rows of a key stand within a moment of each other."""
    rows = spark.range(20_000).selectExpr("CAST(NULL AS STRING) AS k", "CASE WHEN id = 0 THEN 0L ELSE 1000000000L + id div 50 END AS t", "id", "id % 7 AS v")
    rows = rows.unionByName(spark.range(30).selectExpr("'cold' AS k", "id AS t", "id", "id AS v"))
    hot = in_ranges(rows.where("k IS NULL"), ["k", "t", "id"], 1000)
    assert max(r[0] for r in hot.groupBy("_chunk").count().select("count").collect()) <= 2000
    aggs = {"n": ("count", "1"), "s": ("sum", "v")}
    split, whole = (prior_rows(rows, ["k"], "t", aggs, prev=["id"], tie=["id"], hot_rows=h) for h in (1000, 10**6))
    assert sorted(map(tuple, split.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def test_quantiles_equal_numpy(skewed):
    rows, df = skewed
    got = {r.k: r for r in quantiles(df, ["k"], "v", {"a": 0.1, "m": 0.5, "z": 0.99}).collect()}
    for k in {r[1] for r in rows}:
        vals = [r[3] for r in rows if r[1] == k]
        for name, p in (("a", 0.1), ("m", 0.5), ("z", 0.99)):
            assert got[k][name] == pytest.approx(np.percentile(vals, p * 100))
