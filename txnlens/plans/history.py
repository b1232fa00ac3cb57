"""Recipient point-in-time features, entity history, bursts and motifs."""

from __future__ import annotations

from txnlens.operators import entity, pit
from txnlens.plans.inputs import LEDGER, ledger, r6_list, rounded, with_ctes
from txnlens.plans.registry import query

# The check pairs every scored row with each earlier payment to its recipient and looks at
# the payment's age, instead of summing changes.
_NEWER = {h: f"FILTER (WHERE age BETWEEN 1 AND {h})" for h in (1, 24, 168)}
PIT_SQL = LEDGER + f""",
paid AS (SELECT dest_id, step, account_id, amount::DECIMAL(18,2) AS money FROM ledger),
aged AS (SELECT row_num, l.dest_id, l.step, l.amount, txn_type, is_fraud, l.step - p.step AS age, p.account_id AS sender, money
  FROM ledger l LEFT JOIN paid p ON p.dest_id = l.dest_id AND p.step < l.step
  WHERE txn_type IN ('TRANSFER', 'CASH_OUT') AND l.dest_id LIKE 'C%'),
pit AS (SELECT row_num, any_value(dest_id) AS dest_id, any_value(step) AS step, any_value(amount) AS current_amount,
    any_value(txn_type = 'TRANSFER')::INTEGER::DOUBLE AS transaction_type_transfer, any_value(is_fraud)::INTEGER AS y,
    """ + ", ".join(
    [f"count(*) {_NEWER[h]} AS pit_prior_count_{h}h" for h in (1, 24)]
    + [f"ifnull(sum(money) {_NEWER[h]}, 0)::DOUBLE AS pit_prior_amount_{h}h" for h in (1, 24, 168)]
    + [f"count(DISTINCT sender) {_NEWER[h]} AS pit_distinct_senders_{h}h" for h in (24, 168)]
) + f""", ifnull(min(age) {_NEWER[168]}, 999) AS pit_steps_since_last_event
  FROM aged GROUP BY row_num)"""

PIT_GROUPS = {
    "pit_count": ["pit_prior_count_1h", "pit_prior_count_24h"],
    "pit_amount": ["pit_prior_amount_1h", "pit_prior_amount_24h", "pit_prior_amount_168h"],
    "pit_distinct_senders": ["pit_distinct_senders_24h", "pit_distinct_senders_168h"],
    "pit_steps_since_last": ["pit_steps_since_last_event"],
    "pit_current": ["current_amount", "transaction_type_transfer"],
    "pit_frame": ["dest_id", "step", *pit.PIT_FEATURES, "y"],
    "pit7_subset": ["step", *pit.DEPLOYABLE, "y"],
}


def _pit(name: str, cols: list[str]) -> None:
    @query(name, with_ctes(PIT_SQL, f"SELECT row_num, {', '.join(cols)} FROM pit"))
    def group(spark, d):
        return pit.pit_frame(ledger(spark, d)).select("row_num", *cols)


for _name, _cols in PIT_GROUPS.items():
    _pit(_name, _cols)

CAPABLE = LEDGER + ",\ncap AS (SELECT * FROM ledger WHERE txn_type IN ('TRANSFER', 'CASH_OUT'))"


def capable(spark, d):
    return entity.capable(ledger(spark, d))


def _stateless_sql(night: str, tail: str) -> str:
    return with_ctes(CAPABLE, f"""SELECT row_num, amount, rnd(log10(amount + 1), 6) AS amount_log10,
      (txn_type = 'TRANSFER')::INTEGER AS is_transfer, step % 24 AS hour_of_day, step // 24 % 7 AS day_of_week,
      step // 24 AS day_index, (step % 24 {night})::INTEGER AS is_night, (step // 24 % 7 >= 5)::INTEGER AS is_weekend,
      (amount % 1000 = 0 {tail})::INTEGER AS is_round_1k, (amount % 10000 = 0 {tail})::INTEGER AS is_round_10k,
      (amount = 10000000)::INTEGER AS is_capped_10m, rnd(sin(2 * pi() * (step % 24) / 24), 6) AS hour_sin,
      rnd(cos(2 * pi() * (step % 24) / 24), 6) AS hour_cos FROM cap""")


@query("stateless13", _stateless_sql("<= 5", ""))
def stateless13(spark, d):
    return rounded(entity.stateless(capable(spark, d)), "amount_log10", "hour_sin", "hour_cos")


@query("stateless13_strict", _stateless_sql("<= 6", "AND amount > 0"))
def stateless13_strict(spark, d):
    out = entity.stateless(capable(spark, d), night_until=6, strict_round=True)
    return rounded(out, "amount_log10", "hour_sin", "hour_cos")


@query(
    "stateless_log",
    with_ctes(CAPABLE, """SELECT row_num, step, (txn_type = 'TRANSFER')::INTEGER AS type_code, amount,
      is_flagged_fraud::INTEGER AS is_flagged, rnd(ln(1 + amount), 6) AS log_amount,
      rnd(sin(2 * pi() * (step % 24) / 24), 6) AS hour_sin, rnd(cos(2 * pi() * (step % 24) / 24), 6) AS hour_cos FROM cap"""),
)
def stateless_log(spark, d):
    return rounded(entity.stateless_log(capable(spark, d)), "log_amount", "hour_sin", "hour_cos")


def _history_sql(key: str, name: str) -> str:
    return with_ctes(CAPABLE, f""", h AS (SELECT row_num, amount,
        count(*) OVER b AS n, coalesce(sum(CAST(amount AS DECIMAL(18,2))) OVER b, 0)::DOUBLE AS s FROM cap
        WINDOW b AS (PARTITION BY {key} ORDER BY row_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT row_num, n AS {name}_count_hist, s AS {name}_amount_sum_hist, rnd(s / (n + 1), 6) AS {name}_amount_mean_hist,
        rnd(amount / (s / (n + 1) + 1), 6) AS amount_to_{name}_mean_ratio, (n >= 5)::INTEGER AS {name}_is_frequent,
        (n = 0)::INTEGER AS {name}_is_first_seen FROM h""")


def _history(spark, d, key: str, name: str):
    base = capable(spark, d)
    out = entity.history(base, key, name)
    out = out.select("row_num", *[x for x in out.columns if x not in base.columns])
    return rounded(out, f"{name}_amount_mean_hist", f"amount_to_{name}_mean_ratio")


@query("hist_dest", _history_sql("dest_id", "dest"))
def hist_dest(spark, d):
    return _history(spark, d, "dest_id", "dest")


@query("hist_orig", _history_sql("account_id", "orig"))
def hist_orig(spark, d):
    return _history(spark, d, "account_id", "orig")


@query(
    "hist_edge",
    with_ctes(CAPABLE, """SELECT row_num, n AS edge_count_hist, (n = 0)::INTEGER AS edge_is_new FROM (
      SELECT row_num, row_number() OVER (PARTITION BY account_id, dest_id ORDER BY row_num) - 1 AS n FROM cap)"""),
)
def hist_edge(spark, d):
    return entity.edge_history(capable(spark, d)).select("row_num", "edge_count_hist", "edge_is_new")


@query(
    "velocity_bucket",
    with_ctes(CAPABLE, """SELECT row_num, count(*) OVER (PARTITION BY dest_id, step) AS dest_velocity_1h,
      count(*) OVER (PARTITION BY dest_id, step // 24) AS dest_velocity_24h,
      count(*) OVER (PARTITION BY account_id, step) AS orig_velocity_1h,
      count(*) OVER (PARTITION BY account_id, step // 24) AS orig_velocity_24h FROM cap"""),
)
def velocity_bucket(spark, d):
    rows = capable(spark, d).select("row_num", "dest_id", "account_id", "step")
    both = entity.velocity(entity.velocity(rows, "dest_id", "dest"), "account_id", "orig")
    return both.select("row_num", "dest_velocity_1h", "dest_velocity_24h", "orig_velocity_1h", "orig_velocity_24h")


@query(
    "velocity_surge",
    with_ctes(CAPABLE, """SELECT row_num, rnd((count(*) OVER (PARTITION BY dest_id, step) + 1.0::DOUBLE)
      / (count(*) OVER (PARTITION BY dest_id, step // 24) / 24.0::DOUBLE + 1), 6) AS dest_velocity_surge_ratio FROM cap"""),
)
def velocity_surge(spark, d):
    rows = entity.velocity(capable(spark, d).select("row_num", "dest_id", "step"), "dest_id", "dest")
    return rounded(rows.selectExpr("row_num", f"{entity.surge('dest')} AS dest_velocity_surge_ratio"),
                   "dest_velocity_surge_ratio")


@query(
    "velocity_strict",
    with_ctes(CAPABLE, """SELECT c.row_num, count(s.row_num) FILTER (WHERE s.step = c.step - 1) AS dest_prior_1h,
      count(s.row_num) AS dest_prior_24h FROM cap c LEFT JOIN cap s
      ON s.dest_id = c.dest_id AND s.step BETWEEN c.step - 24 AND c.step - 1 GROUP BY c.row_num"""),
)
def velocity_strict(spark, d):
    rows = capable(spark, d).select("row_num", "dest_id", "step", "amount")
    return entity.velocity_strict(rows, "dest_id", "dest").select("row_num", "dest_prior_1h", "dest_prior_24h")


MULE = CAPABLE + """,
inflow AS (SELECT dest_id, min(step) AS fs, arg_min(amount, row_num) AS fa FROM cap WHERE txn_type = 'TRANSFER' GROUP BY dest_id),
mule AS (SELECT c.*, i.fs, coalesce(i.fa, 0.0) AS fa, coalesce(c.txn_type = 'CASH_OUT' AND i.fs < c.step, false) AS m
  FROM cap c LEFT JOIN inflow i ON i.dest_id = c.account_id)"""


@query("mule_chain", with_ctes(MULE, """SELECT row_num, m::INTEGER AS is_mule_chain,
  CASE WHEN m THEN step - fs ELSE 0 END AS mule_time_since_transfer FROM mule"""))
def mule_chain(spark, d):
    return entity.mule_features(capable(spark, d)).select("row_num", "is_mule_chain", "mule_time_since_transfer")


@query("rapid_passthrough", with_ctes(MULE, """SELECT row_num,
  (m AND step - fs <= 6 AND abs(amount - fa) / (fa + 1) <= 0.20::DOUBLE)::INTEGER AS is_rapid_passthrough FROM mule"""))
def rapid_passthrough(spark, d):
    return entity.mule_features(capable(spark, d)).select("row_num", "is_rapid_passthrough")


@query("mule_accounts", with_ctes(LEDGER, """SELECT DISTINCT dest_id AS account_id FROM ledger WHERE txn_type = 'TRANSFER'
  AND dest_id IN (SELECT account_id FROM ledger WHERE txn_type = 'CASH_OUT')"""))
def mule_accounts(spark, d):
    return entity.mule_accounts(ledger(spark, d))


@query("dest_kind", with_ctes(LEDGER, """SELECT substr(dest_id, 1, 1) AS dest_kind, count(*) AS rows,
  count(DISTINCT dest_id) AS recipients FROM ledger GROUP BY 1"""))
def dest_kind(spark, d):
    from pyspark.sql import functions as F

    per_dest = ledger(spark, d).groupBy("dest_id").agg(F.expr("count(1) AS n"))
    return per_dest.groupBy(F.expr("substring(dest_id, 1, 1) AS dest_kind")).agg(
        F.expr("sum(n) AS rows"), F.expr("count(1) AS recipients"))
