import random

import pytest

from txnlens.operators import experiments as ex
from txnlens.operators import frontier as fr
from txnlens.operators import metrics


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        y = int(rng.random() < 0.1)
        score = round(min(0.999, max(0.0, rng.gauss(0.7 if y else 0.3, 0.2))), 2 if i % 2 else 4)
        rows.append((i, y, rng.randrange(1, 50_000) / 100, score, i % 3))
    return rows, spark.createDataFrame(rows, "row_num long, y int, amount double, score double, g int")


def at(rows, t):
    hit = [r for r in rows if r[3] >= t]
    tp = [r for r in hit if r[1] == 1]
    return len(tp), len(hit) - len(tp), sum(r[2] for r in tp), sum(r[2] for r in hit) - sum(r[2] for r in tp)


@pytest.mark.parametrize("limit", [30, 10**6])
def test_frontier_equals_counting(data, limit):
    rows, df = data
    got = fr.exact_frontier(df, limit=limit).collect()
    assert len(got) == len({r[3] for r in rows})
    for r in got:
        tp, fp, ta, fa = at(rows, r.threshold)
        assert (r.tp, r.fp) == (tp, fp)
        assert r.captured_amount == pytest.approx(ta) and r.legit_amount_alerted == pytest.approx(fa)
        assert r.net_value == pytest.approx(ta - 0.2 * fa - 5 * (tp + fp))
        assert r.rank == len({x[3] for x in rows if x[3] >= r.threshold})


def average_precision(rows):
    pos = sum(r[1] for r in rows)
    ap, last = 0.0, 0
    for t in sorted({r[3] for r in rows}, reverse=True):
        tp, fp, _, _ = at(rows, t)
        ap += (tp - last) / pos * tp / (tp + fp)
        last = tp
    return ap


def auc(rows):
    p, n = [r[3] for r in rows if r[1]], [r[3] for r in rows if not r[1]]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in n) / len(p) / len(n)


@pytest.mark.parametrize("limit", [30, 10**6])
def test_ranking_metrics_per_key(data, limit):
    rows, df = data
    got = {r.g: r for r in fr.ranking_metrics(df, ["g"], limit=limit).collect()}
    for g in range(3):
        part = [r for r in rows if r[4] == g]
        assert got[g].average_precision == pytest.approx(average_precision(part))
        assert got[g].roc_auc == pytest.approx(auc(part))


def test_one_class_has_half_area(spark):
    df = spark.createDataFrame([(0, 1.0, 0.5), (0, 1.0, 0.7)], "y int, amount double, score double")
    r = fr.ranking_metrics(df).first()
    assert (r.roc_auc, r.average_precision) == (0.5, 0.0)


def test_grid_equals_counting(data):
    rows, df = data
    for r in fr.threshold_grid(df, grid=(0.0, 1.0, 101)).collect():
        assert (r.tp, r.fp) == at(rows, r.threshold)[:2], r.threshold


def test_keyed_grid_covers_every_key(data):
    rows, df = data
    got = fr.threshold_grid(df, ["g"], grid=(0.1, 0.9, 9)).collect()
    assert len(got) == 27
    for r in got:
        assert (r.tp, r.fp) == at([x for x in rows if x[4] == r.g], r.threshold)[:2]


def test_policies(data):
    rows, df = data
    f = fr.exact_frontier(df)
    neg = sum(1 - r[1] for r in rows)
    cut = fr.capacity_cut(f, 0.05).first()
    ordered = sorted((r[3] for r in rows), reverse=True)
    assert cut.threshold == ordered[29] and cut.alerts == sum(s >= ordered[29] for s in ordered)
    for r in fr.fpr_budgets(f, (0.0, 0.02)).collect():
        ok = [(at(rows, t)[2], t) for t in {x[3] for x in rows} if at(rows, t)[1] / neg <= r.budget]
        assert r.threshold == (max(ok)[1] if ok else max(x[3] for x in rows))
    beta2 = {r.beta: r for r in fr.best_fbeta(f, (1.0, 2.0)).collect()}
    pos = sum(r[1] for r in rows)
    for beta, r in beta2.items():
        def score(t):
            tp, fp, _, _ = at(rows, t)
            return (1 + beta**2) * tp / ((1 + beta**2) * tp + beta**2 * (pos - tp) + fp)
        best = max(score(t) for t in {x[3] for x in rows})
        assert r.fbeta == pytest.approx(best)
        assert r.threshold == max(t for t in {x[3] for x in rows} if score(t) >= best * (1 - 1e-12))


def test_top_share_splits_a_tied_score_by_row(data):
    rows, df = data
    for r in fr.top_share(df, (0.01, 0.1)).collect():
        n = max(1, int(len(rows) * r.share))
        top = sorted(rows, key=lambda x: (-x[3], x[0]))[:n]
        assert r.flagged == n
        assert r.precision_at_k == pytest.approx(sum(x[1] for x in top) / n)


def test_threshold_fallback(data):
    _, df = data
    f = fr.exact_frontier(df)
    never = fr.argmax(f, "recall_count", where="precision > 2", fallback="net_value", first="highest").first()
    assert never.threshold == fr.argmax(f, "net_value", first="highest").first().threshold


def test_outcome_at_threshold_equals_direct(data):
    _, df = data
    alerted = metrics.with_alert(df, "score >= 0.55D")
    direct = metrics.outcome(alerted, ["g"]).collect()
    cuts = df.select("g").distinct().selectExpr("g", "'p' AS policy", "0.55D AS threshold")
    via = {r.g: r for r in ex.outcomes_at(fr.score_points(df, ["g"]), cuts, ["g"]).collect()}
    for r in direct:
        assert all(r[x] == pytest.approx(via[r.g][x]) for x in ("tp", "fp", "fn", "tn", "captured_amount", "fp_amount", "total_legit_amount"))


def test_zero_alerts_precision(data):
    _, df = data
    r = metrics.classification(metrics.confusion(metrics.with_alert(df, "false"))).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)
    top = fr.threshold_grid(df, grid=(0.0, 2.0, 3)).where("threshold = 2").first()
    assert (top.tp, top.fp, top.precision) == (0, 0, 1.0)


def test_bootstrap_brackets_the_observed_difference(spark):
    from txnlens.plans import inputs

    rows = inputs.scored(spark, "/root/testdata/sf0.01")
    r = ex.paired_bootstrap(rows, replicates=60).first()
    assert r.replicates == 60 and r.delta_low <= r.mean_delta <= r.delta_high
    assert 0 <= r.p_value <= 1


def test_poisson_weights_have_mean_one(spark):
    from txnlens.functions.columns import md5_unit

    w = spark.range(20_000).selectExpr(f"{md5_unit('id')} AS _u").selectExpr(f"{ex.poisson_weight()} AS w")
    m = w.selectExpr("avg(w) AS m", "var_samp(w) AS v").first()
    assert m.m == pytest.approx(1.0, abs=0.03) and m.v == pytest.approx(1.0, abs=0.05)


def test_pareto(spark):
    pts = [("u", 0.1, 0.5), ("u", 0.2, 0.5), ("u", 0.2, 0.9), ("u", 0.3, 0.8), ("u", 0.2, 0.9), ("v", 0.9, 0.1)]
    df = spark.createDataFrame(pts, "universe string, fpr double, value_recall double")
    got = sorted(map(tuple, ex.pareto_points(df).select("universe", "fpr", "value_recall").collect()))
    assert got == [("u", 0.1, 0.5), ("u", 0.2, 0.9), ("u", 0.2, 0.9), ("v", 0.9, 0.1)]
