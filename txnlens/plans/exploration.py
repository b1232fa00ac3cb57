"""Exploratory aggregates."""

from __future__ import annotations

from txnlens.functions import columns as c
from txnlens.operators import profile as p
from txnlens.plans.inputs import SCORED, rounded, scored, with_ctes
from txnlens.plans.registry import query


def register(name: str, sql: str, fn, *doubles: str, ctes: str = SCORED) -> None:
    @query(name, with_ctes(ctes, sql))
    def run(spark, d):
        return rounded(fn(scored(spark, d)), *doubles)


register("imbalance", """SELECT y, count(*) AS rows, rnd(sum(amount), 6) AS amount, rnd(count(*) / sum(count(*)) OVER (), 6) AS row_share,
  rnd(sum(amount) / sum(sum(amount)) OVER (), 6) AS amount_share FROM scored GROUP BY y""", p.imbalance, "amount", "row_share", "amount_share")

register("by_type", """SELECT txn_type, count(*) AS rows, sum(y)::BIGINT AS positives, rnd(sum(amount), 6) AS amount,
  rnd(coalesce(sum(amount) FILTER (WHERE y = 1), 0), 6) AS positive_amount, rnd(avg(y), 6) AS rate,
  rnd(count(*) / sum(count(*)) OVER (), 6) AS row_share FROM scored GROUP BY txn_type""", p.by_type,
  "amount", "positive_amount", "rate", "row_share")


def _stat(name: str, expr: str) -> str:
    neg, pos = expr.format(w="y = 0"), expr.format(w="y = 1")
    return f"""SELECT '{name}' AS statistic, rnd({neg}, 6) AS negative, rnd({pos}, 6) AS positive,
      rnd(CASE WHEN abs({neg}) >= 1e-9 THEN {pos} / {neg} END, 6) AS ratio FROM scored"""


register("quantiles_by_class", " UNION ALL ".join(
    [_stat(n, f"{f}(amount) FILTER (WHERE {{w}})") for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))]
    + [_stat(n, f"quantile_cont(amount, {v}) FILTER (WHERE {{w}})") for n, v in p.CLASS_PROBS.items()]),
    p.quantiles_by_class, "negative", "positive", "ratio")

register("amount_by_type", """SELECT txn_type, rnd(avg(amount), 6) AS mean, max(amount) AS max, rnd(quantile_cont(amount, 0.5), 6) AS p50,
  rnd(quantile_cont(amount, 0.99), 6) AS p99 FROM scored GROUP BY txn_type""", p.amount_by_type, "mean", "p50", "p99")

register("flag_crosstab", """SELECT y, count(*) FILTER (WHERE NOT is_flagged_fraud) AS not_flagged, count(*) FILTER (WHERE is_flagged_fraud) AS flagged,
  rnd(coalesce(sum(amount) FILTER (WHERE is_flagged_fraud), 0), 6) AS flagged_amount,
  rnd(coalesce(sum(amount) FILTER (WHERE NOT is_flagged_fraud), 0), 6) AS not_flagged_amount FROM scored GROUP BY y""",
  p.flag_crosstab, "flagged_amount", "not_flagged_amount")

register("balance_errors", """SELECT y, side, rnd(avg(v), 6) AS mean, rnd(avg((abs(v) < 0.01::DOUBLE)::INT), 6) AS exact_share,
  rnd(quantile_cont(v, 0.05), 6) AS p05, rnd(quantile_cont(v, 0.5), 6) AS p50, rnd(quantile_cont(v, 0.95), 6) AS p95 FROM (
  SELECT y, 'orig_error' AS side, round(oldbalance_org - amount - newbalance_orig, 2) AS v FROM scored
  UNION ALL SELECT y, 'dest_error', round(oldbalance_dest + amount - newbalance_dest, 2) FROM scored) GROUP BY y, side""",
  p.balance_errors, "mean", "exact_share", "p05", "p50", "p95")

register("zero_balance", """SELECT txn_type, y, count(*) AS rows,
  rnd(avg((newbalance_orig < 0.01::DOUBLE AND oldbalance_org > 0.01::DOUBLE)::INT), 6) AS drained_share,
  rnd(avg((newbalance_orig < 0.01::DOUBLE AND oldbalance_org < 0.01::DOUBLE)::INT), 6) AS both_zero_share,
  rnd(avg((oldbalance_dest < 0.01::DOUBLE AND newbalance_dest < 0.01::DOUBLE AND amount > 0)::INT), 6) AS unknown_dest_share
  FROM scored GROUP BY txn_type, y""", p.zero_balance, "drained_share", "both_zero_share", "unknown_dest_share")

register("fingerprint", """, f AS (SELECT count(*) FILTER (WHERE oldbalance_org = amount AND newbalance_orig = 0 AND amount > 0) AS matches,
    count(*) FILTER (WHERE oldbalance_org = amount AND newbalance_orig = 0 AND amount > 0 AND y = 1) AS positives_matched,
    sum(y)::BIGINT AS positives FROM scored)
  SELECT *, rnd(positives_matched / greatest(matches, 1), 6) AS precision, rnd(positives_matched / greatest(positives, 1), 6) AS recall FROM f""",
  p.fingerprint, "precision", "recall")

register("ledger_consistency", """SELECT txn_type, count(*) AS rows,
  rnd(avg((abs(oldbalance_org - amount - newbalance_orig) < 0.01::DOUBLE)::INT), 6) AS consistent_share,
  count(*) FILTER (WHERE amount > oldbalance_org + 0.01::DOUBLE) AS overdrawn FROM scored WHERE y = 0 GROUP BY txn_type""",
  p.ledger_consistency, "consistent_share")


def _volume(name: str, bucket: str, col: str) -> None:
    register(name, f"SELECT {bucket.replace(' div ', ' // ')} AS {col}, count(*) AS rows, sum(y)::BIGINT AS positives, rnd(sum(amount), 6) AS amount FROM scored GROUP BY 1",
             lambda df: p.volume(df, bucket, col), "amount")


_volume("hourly", c.plain_hour(), "hour_of_day")
_volume("daily", c.report_day(), "report_day")

register("per_step", """SELECT count(*) AS steps, min(n) AS min, rnd(quantile_cont(n, 0.5), 6) AS p50, rnd(quantile_cont(n, 0.9), 6) AS p90, max(n) AS max
  FROM (SELECT count(*) AS n FROM scored GROUP BY step)""", p.step_quantiles, "p50", "p90")

_EDGES = ", ".join(f"quantile_cont(amount, {i / 10}) AS e{i}" for i in range(1, 10))
_BIN = " + ".join(f"(amount > e{i})::INT" for i in range(1, 10))
register("amount_deciles", f""", e AS (SELECT {_EDGES} FROM scored)
  SELECT CAST({_BIN} + 1 AS INTEGER) AS bin, count(*) AS rows, sum(y)::BIGINT AS positives, min(amount) AS lowest, max(amount) AS highest,
  rnd(avg(y), 6) AS rate FROM scored, e GROUP BY 1""", p.amount_deciles, "rate")

register("median_by_type_class", """, m AS (SELECT txn_type, median(amount) FILTER (WHERE y = 0) AS a, median(amount) FILTER (WHERE y = 1) AS b FROM scored GROUP BY txn_type)
  SELECT txn_type, rnd(a, 6) AS negative_median, rnd(b, 6) AS positive_median, rnd(b / a, 6) AS ratio FROM m""",
  p.median_by_type_class, "negative_median", "positive_median", "ratio")

register("type_dest_matrix", """SELECT txn_type, substr(dest_id, 1, 1) AS dest_kind, count(*) AS rows, sum(y)::BIGINT AS positives,
  rnd(avg(y), 6) AS rate FROM scored GROUP BY 1, 2""", p.type_dest_matrix, "rate")

CORR = {
    "label": "y", "amount": "amount", "old_org": "oldbalance_org", "new_org": "newbalance_orig", "old_dest": "oldbalance_dest",
    "new_dest": "newbalance_dest", "error_orig": "newbalance_orig + amount - oldbalance_org",
    "error_dest": "oldbalance_dest + amount - newbalance_dest", "is_transfer": "CAST(txn_type = 'TRANSFER' AS INT)",
    "orig_drained": "CAST(newbalance_orig = 0 AS INT)", "dest_both_zero": "CAST(oldbalance_dest = 0 AND newbalance_dest = 0 AS INT)",
    "amount_to_org": "amount / (oldbalance_org + 1)", "amount_to_dest": "amount / (oldbalance_dest + 1)",
}
CAPABLE = "txn_type IN ('TRANSFER', 'CASH_OUT')"
_NAMES = list(CORR)
register("correlations", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, rnd(corr({CORR[a]}, {CORR[b]}), 6) AS correlation FROM scored WHERE {CAPABLE}"
    for i, a in enumerate(_NAMES) for b in _NAMES[i + 1:]), lambda df: p.correlations(df.where(CAPABLE), CORR), "correlation")

register("entity_counts", """SELECT count(DISTINCT account_id) AS origins, count(DISTINCT dest_id) AS recipients,
  count(*) FILTER (WHERE starts_with(dest_id, 'M')) AS merchant_rows, count(*) FILTER (WHERE starts_with(dest_id, 'M') AND y = 1) AS merchant_positives
  FROM scored""", p.entity_counts)

register("sample_rows", """SELECT row_num, step, txn_type, amount FROM scored
  ORDER BY CAST('0x' || substr(md5('sample|' || row_num), 1, 8) AS BIGINT), row_num LIMIT 1000""",
  lambda df: p.sample_rows(df, 1000).select("row_num", "step", "txn_type", "amount"))

register("hist_bins", """SELECT CASE WHEN amount > 0 THEN CAST(floor(log10(amount) * 4) AS BIGINT) END AS bin,
  count(*) FILTER (WHERE y = 0) AS negatives, count(*) FILTER (WHERE y = 1) AS positives FROM scored GROUP BY 1""", p.hist_bins)
