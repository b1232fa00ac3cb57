"""Account state: batch fold, merging, storage form, streams, sequential scoring."""

from __future__ import annotations

from txnlens.functions.schema import STATE_COLUMNS, TXN_COLUMNS
from txnlens.operators import models, scoring
from txnlens.operators.account import account_features
from txnlens.operators.portable import array_model
from txnlens.operators.state import (
    account_state, decoded, diff_states, merge_states, read_state_json, state_cover, upsert_latest, with_state_json,
)
from txnlens.plans.inputs import (
    GOLD, SCORED_GOLD, SCORED_SILVER, SILVER, gold, ledger, rounded, scored_silver, scored_silver_table, scored_with_features, silver, silver_table,
    state_cte, with_ctes,
)
from txnlens.plans.registry import query
from txnlens.sources import events
from txnlens.sources.scratch import fresh_dir, stored
from txnlens.sources.state_log import StateLog
from txnlens.streaming.state_stream import backfill_state, current_states, stream_state

SUMS = ("amount_sum", "amount_sqsum")


def _state_list(alias: str = "") -> str:
    return ", ".join(f"rnd({alias}{n}, 6) AS {n}" if n in SUMS else f"{alias}{n}" for n in STATE_COLUMNS)


WHOLE_STATE = with_ctes(SILVER + state_cte(), f"SELECT {_state_list()} FROM states")


@query("account_state", WHOLE_STATE)
def q_account_state(spark, d):
    return rounded(account_state(silver(spark, d)), *SUMS)


@query("merge_states", WHOLE_STATE)
def q_merge_states(spark, d):
    """Three overlapping-in-accounts parts merged pairwise give the state of the whole."""
    rows = silver_table(spark, d)
    parts = [account_state(rows.where(f"txn_type IN ({t})")) for t in
             ("'TRANSFER', 'DEBIT'", "'CASH_OUT'", "'PAYMENT', 'CASH_IN'")]
    return rounded(merge_states(parts[2], merge_states(parts[0], parts[1])), *SUMS)


@query("advance_state_late", WHOLE_STATE)
def q_advance_state_late(spark, d):
    """Late half folded in after the newer half: totals change, the anchor does not go back."""
    rows = silver_table(spark, d)
    newer, late = account_state(rows.where("step > 360")), account_state(rows.where("step <= 360"))
    return rounded(merge_states(newer, late), *SUMS)


@query("state_json", with_ctes(SILVER + state_cte(), f"""SELECT 'txnlens:acct:v1:' || account_id AS state_key, {_state_list()}
  FROM states WHERE last_txn_type NOT IN ('DEBIT', 'CASH_IN')"""))
def q_state_json(spark, d):
    """Round trip through the stored document; corrupt and foreign-version documents vanish."""
    documents = with_state_json(account_state(silver(spark, d))).selectExpr(
        "state_key",
        "CASE WHEN state_json LIKE '%\"last_txn_type\":\"DEBIT\"%' THEN substring(state_json, 1, 25) "
        "WHEN state_json LIKE '%\"last_txn_type\":\"CASH_IN\"%' "
        "THEN replace(state_json, '\"state_version\":1', '\"state_version\":2') ELSE state_json END AS state_json")
    back = decoded(documents).where("state IS NOT NULL").selectExpr("state_key", "state.*")
    return rounded(back, *SUMS)


def _staged(spark, d):
    path = fresh_dir(spark, "staging")
    events.export_staging(silver(spark, d), path)
    return path


@query("stream_state", WHOLE_STATE)
def q_stream_state(spark, d):
    """Two runs of the stream over a growing folder: the restart adds only the new files."""
    path, ckpt, out = fresh_dir(spark, "ctx"), fresh_dir(spark, "ckpt"), fresh_dir(spark, "states")
    rows = silver_table(spark, d).select(*TXN_COLUMNS)
    for part in ("step > 300", "step <= 300"):
        rows.where(part).write.mode("append").json(path)
        stream_state(spark, path, ckpt, out).awaitTermination()
    return rounded(current_states(spark, out), *SUMS)


@query("backfill_state", WHOLE_STATE)
def q_backfill_state(spark, d):
    return rounded(backfill_state(spark, _staged(spark, d)), *SUMS)


@query("state_repair_rule", with_ctes(SILVER + state_cte("cur") + state_cte("inc", "WHERE step <= 240"),
  "SELECT account_id, txn_count, updated_at_us FROM cur"))
def q_state_repair_rule(spark, d):
    """A repair from older data neither removes accounts nor overwrites fresher states."""
    cols = ["account_id", "txn_count", "updated_at_us"]
    rows = silver_table(spark, d)
    fresh = account_state(rows).select(*cols)
    old = account_state(rows.where("step <= 240")).select(*cols)
    return upsert_latest(fresh, old, ties="keep")


@query("state_vs_gold_cover", with_ctes(GOLD, """SELECT count(DISTINCT account_id) AS state_accounts,
  count(DISTINCT account_id) AS gold_accounts, true AS covered FROM gold"""))
def q_state_vs_gold_cover(spark, d):
    return state_cover(account_state(silver(spark, d)), gold(spark, d))


@query(
    "state_divergence",
    with_ctes(SILVER + state_cte("w") + state_cte("o", "WHERE step <= 700"), """SELECT account_id, o.last_event_id IS DISTINCT FROM w.last_event_id AS last_event_id_differs,
      o.last_event_ts_us IS DISTINCT FROM w.last_event_ts_us AS last_event_ts_us_differs,
      o.last_amount IS DISTINCT FROM w.last_amount AS last_amount_differs,
      o.txn_count IS DISTINCT FROM w.txn_count AS txn_count_differs
    FROM w JOIN o USING (account_id)"""),
)
def q_state_divergence(spark, d):
    rows = silver_table(spark, d)
    return diff_states(account_state(rows.where("step <= 700")), account_state(rows))


CHAIN_SQL = with_ctes("RECURSIVE " + GOLD, """, m AS (SELECT event_id, account_id, txn_count_prior::BIGINT AS n,
      -2.0 + 0.6 * coalesce(amount_ratio_vs_prior_max, 0) + 0.25 * coalesce(amount_z_vs_prior, 0)
        + 0.3 * coalesce(dest_is_new, 0) + 0.8 * drains_account + 1.2 * is_fraud_capable_type AS margin FROM gold),
    chain AS (SELECT event_id, account_id, n, 1.0::DOUBLE / (1 + exp(-margin)) AS p FROM m WHERE n = 0
      UNION ALL SELECT m.event_id, m.account_id, m.n, 1.0::DOUBLE / (1 + exp(-(m.margin + 0.9 * c.p)))
        FROM chain c JOIN m ON m.account_id = c.account_id AND m.n = c.n + 1)
    SELECT event_id, rnd(p, 6) AS fraud_score, CASE WHEN p >= 0.5 THEN 'FRAUD' ELSE 'LEGIT' END AS decision,
      n > 0 AS had_prev_state FROM chain""")


@query("sequential_scoring", CHAIN_SQL)
def q_sequential_scoring(spark, d):
    out = scoring.score_sequential(silver_table(spark, d), scoring.DEFAULT_MODEL, threshold=0.5)
    return rounded(out.select("event_id", "fraud_score", "decision", "had_prev_state"), "fraud_score")


@query("sequential_scoring_requests", CHAIN_SQL)
def q_sequential_scoring_requests(spark, d):
    """Three batches of requests, each committed before the next; what the logged events and the states say afterwards."""
    rows = silver_table(spark, d)
    log, logged = StateLog(fresh_dir(spark, "served"), compact_every=2), fresh_dir(spark, "served-events")
    for part in ("step <= 240", "step > 240 AND step <= 500", "step > 500"):
        scoring.score_requests(rows.where(part), scoring.DEFAULT_MODEL, 0.5, log, logged, request="bronze_row_num")
    out = events.read_scored_events(spark, logged).select("event_id", "fraud_score", "decision", "had_prev_state")
    return rounded(out, "fraud_score")


@query("sequential_scoring_fitted")
def q_sequential_scoring_fitted(spark, d):
    """A fitted tree over account features and its own previous score, folded along each account."""
    rows = scored_silver_table(spark, d)
    names = ["amount_ratio_vs_prior_max", "seconds_since_last_txn", "drains_account", "is_fraud_capable_type", "prev_fraud_score"]
    train = stored(account_features(rows, score="score").selectExpr(*names, "CAST(is_fraud AS INT) AS y"), "train")
    model = array_model(spark, models.fit("tree", train, names))
    out = scoring.score_sequential(rows, model, threshold=0.5)
    return out.select("event_id", "fraud_score", "decision", "had_prev_state")


@query(
    "scored_event_build",
    with_ctes(SCORED_GOLD, """SELECT s.event_id, s.score AS fraud_score, CASE WHEN s.score >= 0.7 THEN 'FRAUD' ELSE 'LEGIT' END AS decision,
      CAST(0.7 AS DOUBLE) AS threshold, g.txn_count_prior > 0 AS had_prev_state, s.dest_id, g.type_pair,
      rnd(g.amount_ratio_vs_prior_max, 6) AS ratio_max FROM silver s JOIN gold g USING (event_id)"""),
)
def q_scored_event_build(spark, d):
    ev = events.to_scored_events(scored_with_features(spark, d), threshold=0.7)
    return rounded(ev.selectExpr(
        "event_id", "fraud_score", "decision", "threshold", "had_prev_state", "transaction.dest_id AS dest_id",
        "features.type_pair AS type_pair", "features.amount_ratio_vs_prior_max AS ratio_max"), "ratio_max")


@query(
    "replay_join",
    with_ctes(SCORED_SILVER, """SELECT event_id, account_id, CASE WHEN txn_type <> 'DEBIT' THEN score END AS fraud_score,
      is_fraud, is_flagged_fraud FROM silver"""),
)
def q_replay_join(spark, d):
    rows = scored_silver(spark, d)
    scores = rows.where("txn_type <> 'DEBIT'").selectExpr("event_id", "score AS fraud_score")
    return scoring.replay_result(silver(spark, d), scores)
