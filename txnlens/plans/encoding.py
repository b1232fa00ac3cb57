"""Fit-on-train encoders, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnlens.functions import columns as c
from txnlens.operators import encode, splits
from txnlens.plans.inputs import SCORED, rounded, scored, with_ctes
from txnlens.plans.registry import query

CAP = SCORED + """,
cap AS (SELECT *, step % 24 AS hour, (step % 24 <= 5)::INTEGER AS is_night, log10(amount + 1) AS la,
  CASE WHEN step <= 480 THEN 'train' WHEN step <= 600 THEN 'val' ELSE 'test' END AS split
  FROM scored WHERE txn_type IN ('TRANSFER', 'CASH_OUT')),
tr AS (SELECT * FROM cap WHERE split = 'train')"""


def capable(spark, d):
    rows = scored(spark, d).where("txn_type IN ('TRANSFER', 'CASH_OUT')").selectExpr(
        "row_num", "step", "txn_type", "amount", "account_id", "dest_id", "y",
        f"{c.plain_hour()} AS hour", f"CAST({c.plain_hour()} <= 5 AS INT) AS is_night", "log10(amount + 1D) AS la")
    return splits.split_3stage(rows)


def _z_sql(value: str, pad: str, out: str) -> str:
    return with_ctes(CAP, f""", g AS (SELECT txn_type, hour, is_night, avg({value}) AS m, coalesce(stddev_samp({value}), 1.0) AS s
        FROM tr GROUP BY ALL), o AS (SELECT avg({value}) AS gm, stddev_samp({value}) AS gs FROM tr)
      SELECT row_num, rnd(({value} - coalesce(m, gm)) / (coalesce(s, gs) + {pad}), 6) AS {out}
      FROM cap LEFT JOIN g USING (txn_type, hour, is_night), o""")


@query("zscore_by_group", _z_sql("amount", "1", "amount_zscore"))
def zscore_by_group(spark, d):
    out = encode.zscore_by_group(capable(spark, d), "amount", ["txn_type", "hour", "is_night"], "amount_zscore")
    return rounded(out.select("row_num", "amount_zscore"), "amount_zscore")


@query("log_zscore_by_group", _z_sql("la", "0.1", "amount_log_zscore"))
def log_zscore_by_group(spark, d):
    out = encode.zscore_by_group(capable(spark, d), "la", ["txn_type", "hour", "is_night"], "amount_log_zscore", pad=0.1)
    return rounded(out.select("row_num", "amount_log_zscore"), "amount_log_zscore")


@query(
    "target_encode",
    with_ctes(CAP, """, p AS (SELECT avg(y) AS prior FROM tr), k AS (SELECT dest_id, count(*) AS n, sum(y) AS pos FROM tr GROUP BY dest_id)
      SELECT row_num, rnd((coalesce(pos, 0) + 10 * prior) / (coalesce(n, 0) + 10), 6) AS dest_risk
      FROM cap LEFT JOIN k USING (dest_id), p"""),
)
def target_encode(spark, d):
    return rounded(encode.target_encode(capable(spark, d), "dest_id", "dest_risk").select("row_num", "dest_risk"), "dest_risk")


@query(
    "target_encode_oof",
    with_ctes(CAP, """, p AS (SELECT avg(y) AS prior FROM tr),
      f AS (SELECT *, CAST('0x' || substr(md5('fold|' || row_num), 1, 8) AS BIGINT) % 5 AS fold FROM cap)
      SELECT a.row_num, rnd((coalesce(sum(b.y), 0) + 10 * any_value(prior)) / (count(b.y) + 10), 6) AS dest_risk
      FROM f a CROSS JOIN p LEFT JOIN f b ON b.dest_id = a.dest_id AND b.split = 'train' AND (a.split <> 'train' OR b.fold <> a.fold)
      GROUP BY a.row_num"""),
)
def target_encode_oof(spark, d):
    return rounded(encode.target_encode_oof(capable(spark, d), "dest_id", "dest_risk").select("row_num", "dest_risk"), "dest_risk")


ALL = SCORED + """,
al AS (SELECT *, CASE WHEN step <= 480 THEN 'train' WHEN step <= 600 THEN 'val' ELSE 'test' END AS split FROM scored),
tr AS (SELECT * FROM al WHERE split = 'train')"""


def everything(spark, d):
    return splits.split_3stage(scored(spark, d))


AGGS = ["dest_freq", "dest_amount_mean", "dest_type_count", "dest_cashout_freq"]


@query(
    "train_aggregates",
    with_ctes(ALL, """, k AS (SELECT dest_id, count(*) AS n, sum(CAST(amount AS DECIMAL(18,2)))::DOUBLE / count(*) AS m, count(DISTINCT txn_type) AS t,
        count(*) FILTER (WHERE txn_type = 'CASH_OUT') AS co FROM tr GROUP BY dest_id)
      SELECT row_num, coalesce(n, 0) AS dest_freq, rnd(coalesce(m, (SELECT avg(amount) FROM tr)), 6) AS dest_amount_mean,
        coalesce(t, 0) AS dest_type_count, coalesce(co, 0) AS dest_cashout_freq FROM al LEFT JOIN k USING (dest_id)"""),
)
def train_aggregates(spark, d):
    out = encode.train_aggregates(everything(spark, d), mean_default="global")
    return rounded(out.select("row_num", *AGGS), "dest_amount_mean")


@query(
    "amount_ratio_by_type",
    with_ctes(ALL, """, k AS (SELECT txn_type, median(amount) AS m FROM tr GROUP BY txn_type)
      SELECT row_num, rnd(amount / m, 6) AS amount_ratio FROM al LEFT JOIN k USING (txn_type)"""),
)
def amount_ratio_by_type(spark, d):
    return rounded(encode.amount_ratio_by_type(everything(spark, d)).select("row_num", "amount_ratio"), "amount_ratio")


@query("amount_ratio_global", with_ctes(ALL, "SELECT row_num, rnd(amount / ((SELECT avg(amount) FROM tr) + 1), 6) AS amount_ratio FROM al"))
def amount_ratio_global(spark, d):
    return rounded(encode.amount_ratio_global(everything(spark, d)).select("row_num", "amount_ratio"), "amount_ratio")


@query("type_code", with_ctes(SCORED, "SELECT row_num, CAST(dense_rank() OVER (ORDER BY txn_type) - 1 AS INTEGER) AS type_code FROM scored"))
def type_code(spark, d):
    return encode.type_code(scored(spark, d)).select("row_num", "type_code")


@query("frequency_encode", with_ctes(SCORED, "SELECT row_num, count(*) OVER (PARTITION BY dest_id) AS dest_rows FROM scored"))
def frequency_encode(spark, d):
    return encode.frequency_encode(scored(spark, d), "dest_id", "dest_rows").select("row_num", "dest_rows")


@query(
    "class_weights",
    with_ctes(ALL, """SELECT row_num, rnd(CASE WHEN y = 1 THEN 1 + 2 * log10(amount + 1) ELSE 1 END, 6) AS sample_weight,
      rnd((SELECT count(*) FILTER (WHERE y = 0) / greatest(count(*) FILTER (WHERE y = 1), 1) FROM tr), 6) AS imbalance_ratio FROM al"""),
)
def class_weights(spark, d):
    out = encode.class_weights(everything(spark, d)).select("row_num", "sample_weight", "imbalance_ratio")
    return rounded(out, "sample_weight", "imbalance_ratio")


# --- splits ------------------------------------------------------------------
@query(
    "split_3stage",
    with_ctes(SCORED, "SELECT row_num, " + ", ".join(
        f"CASE WHEN step <= {a} THEN 'train' WHEN step <= {b} THEN 'val' ELSE 'test' END AS {name}"
        for name, (a, b) in splits.THREE_STAGE.items()) + " FROM scored"),
)
def split_3stage(spark, d):
    return scored(spark, d).selectExpr(
        "row_num", *[f"{splits.stage(['train', 'val', 'test'], cuts)} AS {name}" for name, cuts in splits.THREE_STAGE.items()])


FOUR = """CASE WHEN step <= 480 THEN 'train' WHEN step <= 552 THEN 'calibration' WHEN step <= 600 THEN 'policy' ELSE 'oot' END AS split"""


@query(
    "split_4stage",
    with_ctes(SCORED, f""", s AS (SELECT split, min(step) AS first_step, max(step) AS last_step
        FROM (SELECT step, {FOUR} FROM scored) GROUP BY split)
      SELECT *, NOT EXISTS (SELECT 1 FROM s o WHERE o.first_step < s.first_step AND o.last_step >= s.first_step) AS disjoint FROM s"""),
)
def split_4stage(spark, d):
    return splits.stages_disjoint(splits.split_4stage(scored(spark, d)))


@query("split_quantile", with_ctes(SCORED, "SELECT row_num, CASE WHEN step <= 355 THEN 'train' ELSE 'test' END AS split FROM scored"))
def split_quantile(spark, d):
    return splits.split_quantile(scored(spark, d)).select("row_num", "split")


@query(
    "split_random_stratified",
    with_ctes(SCORED, """, u AS (SELECT row_num, y,
        CAST('0x' || substr(md5('42|' || row_num), 1, 8) AS BIGINT) AS a,
        CAST('0x' || substr(md5('42-inner|' || row_num), 1, 8) AS BIGINT) AS b FROM scored),
      o AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY a, row_num) <= floor(0.8::DOUBLE * count(*) OVER (PARTITION BY y)) AS tr FROM u),
      i AS (SELECT *, row_number() OVER (PARTITION BY y, tr ORDER BY b, row_num) <= floor(0.8::DOUBLE * count(*) OVER (PARTITION BY y, tr)) AS fi FROM o)
      SELECT row_num, CASE WHEN tr THEN 'train' ELSE 'test' END AS split,
        CASE WHEN tr THEN CASE WHEN fi THEN 'fit' ELSE 'val' END END AS inner_split FROM i"""),
)
def split_random_stratified(spark, d):
    return splits.split_random_stratified(scored(spark, d)).select("row_num", "split", "inner_split")


@query(
    "split_summary",
    with_ctes(SCORED, f"""SELECT split, count(*) AS rows, sum(y)::BIGINT AS positives, rnd(sum(amount), 6) AS amount,
      rnd(coalesce(sum(amount) FILTER (WHERE y = 1), 0), 6) AS positive_amount, rnd(count(*) / sum(count(*)) OVER (), 6) AS row_share,
      rnd(avg(y), 6) AS positive_rate FROM (SELECT *, {FOUR} FROM scored) GROUP BY split"""),
)
def split_summary(spark, d):
    out = splits.split_summary(splits.split_4stage(scored(spark, d)))
    return rounded(out, "amount", "positive_amount", "row_share", "positive_rate")


FOLDS = """, folds AS (SELECT e AS embargo, c AS cut, c - e AS train_end, c + 55 AS test_end
  FROM (VALUES (360), (420), (480), (540)) t(c), (VALUES {e}) s(e))"""
SIZES = """SELECT embargo, cut, count(*) FILTER (WHERE step <= train_end) AS train_rows,
  coalesce(sum(y) FILTER (WHERE step <= train_end), 0)::BIGINT AS train_positives,
  count(*) FILTER (WHERE step > cut AND step <= test_end) AS test_rows,
  coalesce(sum(y) FILTER (WHERE step > cut AND step <= test_end), 0)::BIGINT AS test_positives,
  count(*) FILTER (WHERE step <= train_end) > 0 AND count(DISTINCT y) FILTER (WHERE step > cut AND step <= test_end) = 2 AS usable
  FROM folds, scored GROUP BY embargo, cut"""


@query("walk_forward", with_ctes(SCORED + FOLDS.format(e="(0)"), SIZES))
def walk_forward(spark, d):
    return splits.walk_forward(scored(spark, d), splits.fold_table(spark))


@query(
    "walk_forward_segments",
    with_ctes(SCORED, """, b AS (SELECT min(step) AS lo, max(step) + 1 AS hi FROM scored),
      f AS (SELECT fold, lo, floor(lo + (hi - lo) * fold::DOUBLE / 6)::BIGINT AS test_start,
        floor(lo + (hi - lo) * (fold + 1)::DOUBLE / 6)::BIGINT AS test_stop FROM b, (SELECT unnest([1, 2, 3, 4, 5]) AS fold))
      SELECT fold, test_start, test_stop, count(*) FILTER (WHERE step >= lo AND step < test_start) AS train_rows,
        count(*) FILTER (WHERE step >= test_start AND step < test_stop) AS test_rows,
        sum(y) FILTER (WHERE step >= test_start AND step < test_stop)::BIGINT AS test_positives
      FROM f, scored GROUP BY fold, test_start, test_stop"""),
)
def walk_forward_segments(spark, d):
    return splits.walk_forward_segments(scored(spark, d))


@query(
    "partition_fingerprint",
    with_ctes(SCORED, f"""SELECT split, bit_xor(CAST('0x' || substr(md5(CAST(row_num AS VARCHAR)), 1, 8) AS BIGINT)) AS fingerprint,
      count(*) AS rows FROM (SELECT row_num, {FOUR} FROM scored) GROUP BY split"""),
)
def partition_fingerprint(spark, d):
    return splits.partition_fingerprint(splits.split_4stage(scored(spark, d)))
