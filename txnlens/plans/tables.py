"""Sources, sinks and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnlens.functions import columns as c
from txnlens.functions.schema import RAW_COLUMNS, SIM_EPOCH_US, TXN_COLUMNS
from txnlens.operators.account import account_features
from txnlens.operators.splits import content_identity
from txnlens.operators.state import account_state, lookup_states, lookup_totals, upsert_latest, with_state_json
from txnlens.plans.inputs import (
    GOLD, LEDGER, SCORED_GOLD, SCORED_SILVER, SILVER, ledger, r6_list, rounded, scored, scored_silver,
    scored_with_features, silver, silver_table, state_cte, with_ctes,
)
from txnlens.plans.registry import query
from txnlens.sources import events, fixture, ops
from txnlens.sources.ledger import read_ledger, to_bronze, write_ledger
from txnlens.sources.scratch import fresh_dir, stored
from txnlens.streaming.scored_ingest import ingest_scored_events

NOW_US = SIM_EPOCH_US + 30 * events.DAY_US

RAW_SQL = ", ".join(
    f'CAST({n} AS INTEGER) AS "{src}"' if src.startswith("is") else f'{n} AS "{src}"'
    for src, (n, _) in RAW_COLUMNS.items()
)


@query("src_ledger_csv", with_ctes(LEDGER, f"SELECT {RAW_SQL} FROM ledger"))
def src_ledger_csv(spark, d):
    path = fresh_dir(spark, "ledger-csv")
    write_ledger(ledger(spark, d), path)
    return read_ledger(spark, path)


@query("src_ledger_badlines", with_ctes(LEDGER, f"SELECT {RAW_SQL} FROM ledger WHERE txn_type <> 'DEBIT'"))
def src_ledger_badlines(spark, d):
    """Debit rows are written with a broken amount; reading drops exactly those lines."""
    path = fresh_dir(spark, "ledger-bad")
    cells = {n: f"CAST({n} AS STRING)" for n, _ in RAW_COLUMNS.values()}
    cells["amount"] = "CASE WHEN txn_type = 'DEBIT' THEN 'n/a' ELSE CAST(amount AS STRING) END"
    for name in ("is_fraud", "is_flagged_fraud"):
        cells[name] = f"CAST(CAST({name} AS INT) AS STRING)"
    raw = ledger(spark, d).selectExpr(*[f"{cells[n]} AS {src}" for src, (n, _) in RAW_COLUMNS.items()])
    raw.write.option("header", True).csv(path)
    return read_ledger(spark, path, mode="DROPMALFORMED")


@query(
    "bronze_load",
    with_ctes(LEDGER, """SELECT row_num, step, txn_type, amount, account_id, oldbalance_org, newbalance_orig, dest_id,
      oldbalance_dest, newbalance_dest, is_fraud, is_flagged_fraud, 'ledger.csv' AS source_file FROM ledger"""),
)
def bronze_load(spark, d):
    path = fresh_dir(spark, "ledger-csv")
    write_ledger(ledger(spark, d), path)
    return to_bronze(read_ledger(spark, path), "ledger.csv").drop("loaded_at")


EVENTS_SQL = """SELECT event_id, account_id, event_ts_us, event_ts_us + 250000 AS scored_at_us, score AS fraud_score,
  CASE WHEN score >= 0.5 THEN 'FRAUD' ELSE 'LEGIT' END AS decision FROM silver"""


def scored_events(spark, d):
    return events.to_scored_events(scored_with_features(spark, d), scored_at="event_ts_us + 250000")


def identity(df):
    return df.select("event_id", "account_id", "event_ts_us", "scored_at_us", "fraud_score", "decision")


@query("ingest_scored_jsonl", with_ctes(SCORED_SILVER, EVENTS_SQL))
def ingest_scored_jsonl(spark, d):
    """Half of the events arrive first, with junk lines; then all of them in the same hours, with repeats that were
    scored later and otherwise; a last load finds nothing new."""
    src, out = fresh_dir(spark, "scored"), fresh_dir(spark, "scored-table")
    ev = stored(scored_events(spark, d), "events")
    again = ev.selectExpr(*[{"scored_at_us": "scored_at_us + 1000000 AS scored_at_us",
                             "fraud_score": "1D - fraud_score AS fraud_score"}.get(x, x) for x in ev.columns])
    events.write_scored_events(ev.where("crc32(event_id) % 2 = 0"), src)
    junk = ev.selectExpr("substring(to_json(transaction), 1, 40) AS value", f"{c.hour_dt('scored_at_us')} AS dt",
                         f"{c.hour_hr('scored_at_us')} AS hr").repartitionByRange("dt", "hr", "value")
    junk.write.mode("append").partitionBy("dt", "hr").text(src)
    ingest_scored_events(spark, src, out)
    events.write_scored_events(ev.unionByName(again), src)
    ingest_scored_events(spark, src, out)
    events.close_hours(spark, src)
    for _ in range(2):
        ingest_scored_events(spark, src, out)
    return identity(spark.read.parquet(out))


@query("scored_events_parse", with_ctes(SCORED_SILVER, EVENTS_SQL + " WHERE txn_type <> 'DEBIT'"))
def scored_events_parse(spark, d):
    """Lines of debit rows lose their id key or are cut short, and must be skipped."""
    lines = scored_events(spark, d).selectExpr("to_json(struct(*)) AS line", "transaction.txn_type AS t", "fraud_score")
    lines = lines.selectExpr(
        "CASE WHEN t <> 'DEBIT' THEN replace(line, '{\"event_id\"', '{\"unknown_key\":1,\"event_id\"') "
        "WHEN fraud_score < 0.5D THEN substring(line, 1, 60) "
        "ELSE replace(line, '\"event_id\":', '\"other_id\":') END AS value"
    )
    return identity(events.parse_scored_events(lines))


HOUR_SQL = "strftime(make_timestamp(event_ts_us + 250000), '%Y-%m-%d') AS dt, strftime(make_timestamp(event_ts_us + 250000), '%H') AS hr"


@query(
    "sink_scored_jsonl",
    with_ctes(SCORED_SILVER, f"""SELECT {HOUR_SQL}, count(*) AS events, rnd(sum(score), 6) AS score_sum,
      count(*) FILTER (WHERE score >= 0.5) AS alerts FROM silver GROUP BY ALL"""),
)
def sink_scored_jsonl(spark, d):
    path = fresh_dir(spark, "scored")
    events.write_scored_events(scored_events(spark, d), path)
    return events.read_scored_events(spark, path).groupBy("dt", "hr").agg(
        F.expr("count(event_id) AS events"),
        F.expr(f"{c.r6('sum(fraud_score)')} AS score_sum"),
        F.expr("count_if(decision = 'FRAUD') AS alerts"),
    )


@query("hour_partition", with_ctes(SILVER, """SELECT event_id, strftime(make_timestamp(event_ts_us), '%Y-%m-%d') AS dt,
  strftime(make_timestamp(event_ts_us), '%H') AS hr FROM silver"""))
def hour_partition(spark, d):
    return events.with_hour_partition(silver(spark, d), "event_ts_us").select("event_id", "dt", "hr")


@query("export_staging", with_ctes(SILVER, f"SELECT {', '.join(TXN_COLUMNS)} FROM silver"))
def export_staging(spark, d):
    path = fresh_dir(spark, "staging")
    events.export_staging(silver(spark, d), path)
    return spark.read.json(path).select(*TXN_COLUMNS)


@query(
    "history_recent",
    with_ctes(SCORED_SILVER, f"""SELECT event_id, scored_at_us, fraud_score, dt, hr FROM (
      SELECT event_id, event_ts_us + 250000 AS scored_at_us, score AS fraud_score, {HOUR_SQL} FROM silver)
      WHERE (dt, hr) IN (SELECT (dt, hr) FROM (SELECT DISTINCT {HOUR_SQL} FROM silver) ORDER BY dt DESC, hr DESC LIMIT 48)
      ORDER BY scored_at_us DESC, event_id DESC LIMIT 500"""),
)
def history_recent(spark, d):
    path = fresh_dir(spark, "scored")
    events.write_scored_events(scored_events(spark, d), path)
    recent = events.recent_events(spark, path, max_hours=48, max_rows=500)
    return recent.select("event_id", "scored_at_us", "fraud_score", "dt", "hr")


@query(
    "history_flatten",
    with_ctes(SCORED_GOLD, """SELECT s.event_id, s.account_id, s.event_ts_us, s.event_ts_us + 250000 AS scored_at_us,
      s.score AS fraud_score, CASE WHEN s.score >= 0.5 THEN 'FRAUD' ELSE 'LEGIT' END AS decision,
      CAST(0.5 AS DOUBLE) AS threshold, g.txn_count_prior > 0 AS had_prev_state, 'ledger-risk' AS model_name,
      '1' AS model_version, s.amount, g.prev_fraud_score FROM silver s JOIN gold g USING (event_id)"""),
)
def history_flatten(spark, d):
    flat = events.events_frame(scored_events(spark, d))
    return flat.selectExpr(*events.FLAT_COLUMNS[:-2], "transaction.amount AS amount",
                           "features.prev_fraud_score AS prev_fraud_score")


@query(
    "frame_cache",
    with_ctes(GOLD, f"SELECT event_id, {r6_list('amount_z_vs_prior', 'txn_rate_per_hour')} FROM gold"),
)
def frame_cache(spark, d):
    rows = silver_table(spark, d)
    print_id = content_identity(rows)
    folder = fresh_dir(spark, "frames")
    for _ in range(2):
        frame = events.cached(spark, folder, "account-features", print_id, lambda: account_features(rows))
    return rounded(frame.select("event_id", "amount_z_vs_prior", "txn_rate_per_hour"), "amount_z_vs_prior", "txn_rate_per_hour")


def _halves(spark, d):
    """Stored states from the first half of the ledger, incoming ones from a later cut."""
    rows = silver_table(spark, d)
    stored = account_state(rows.where("step <= 360"))
    incoming = account_state(rows.where("step >= 300"))
    cols = ["account_id", "txn_count", "amount_sum", "updated_at_us"]
    return stored.select(*cols), incoming.select(*cols)


def _upsert_sql(better: str, tail: str = "") -> str:
    ctes = SILVER + state_cte("cur", "WHERE step <= 360") + state_cte("inc", "WHERE step >= 300")
    take = f"(c.account_id IS NULL OR i.updated_at_us {better} c.updated_at_us)"
    cols = ", ".join(f"CASE WHEN i.account_id IS NOT NULL AND {take} THEN i.{x} ELSE c.{x} END AS {x}"
                     for x in ("txn_count", "amount_sum", "updated_at_us"))
    return with_ctes(ctes, f"""SELECT * FROM (SELECT coalesce(c.account_id, i.account_id) AS account_id, {cols}
      FROM cur c FULL JOIN inc i ON c.account_id = i.account_id) {tail}""")


@query("keyed_upsert_pg", _upsert_sql(">"))
def keyed_upsert_pg(spark, d):
    stored, incoming = _halves(spark, d)
    return upsert_latest(stored, incoming, ties="keep")


@query("keyed_upsert_cas", _upsert_sql(">=", f"WHERE updated_at_us >= {NOW_US - 15 * events.DAY_US}"))
def keyed_upsert_cas(spark, d):
    stored, incoming = _halves(spark, d)
    return upsert_latest(stored, incoming, ties="take", ttl_us=15 * events.DAY_US, now_us=NOW_US)


@query(
    "state_lookup",
    with_ctes(SILVER + state_cte(), """, keys AS (SELECT DISTINCT dest_id AS account_id FROM silver)
      SELECT k.account_id, s.account_id IS NOT NULL AND s.last_txn_type IN ('PAYMENT', 'TRANSFER', 'CASH_OUT') AS hit,
        CASE WHEN s.last_txn_type IN ('PAYMENT', 'TRANSFER', 'CASH_OUT') THEN s.txn_count END AS txn_count
      FROM keys k LEFT JOIN states s USING (account_id)"""),
)
def state_lookup(spark, d):
    """Recipients looked up as accounts; some stored documents are corrupt or of another version."""
    return _looked_up(spark, d).selectExpr("account_id", "hit", "state.txn_count AS txn_count")


def _looked_up(spark, d):
    rows = silver_table(spark, d)
    states = account_state(rows)
    spoiled = with_state_json(states).join(states.select("account_id", "last_txn_type"), "account_id").selectExpr(
        "account_id",
        "CASE last_txn_type WHEN 'DEBIT' THEN substring(state_json, 1, 30) "
        "WHEN 'CASH_IN' THEN replace(state_json, '\"state_version\":1', '\"state_version\":99') "
        "ELSE state_json END AS state_json",
    )
    return lookup_states(rows.selectExpr("dest_id AS account_id").distinct(), spoiled)


@query(
    "state_lookup_totals",
    with_ctes(SILVER + state_cte(), """, keys AS (SELECT DISTINCT dest_id AS account_id FROM silver),
      seen AS (SELECT s.account_id IS NOT NULL AS found, coalesce(s.last_txn_type IN ('PAYMENT', 'TRANSFER', 'CASH_OUT'), false) AS hit
        FROM keys k LEFT JOIN states s USING (account_id))
      SELECT count(*) AS requests, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses,
        count(*) FILTER (WHERE NOT hit AND found) AS unreadable,
        rnd(count(*) FILTER (WHERE hit) / greatest(count(*), 1)::DOUBLE, 6) AS hit_rate FROM seen"""),
)
def state_lookup_totals(spark, d):
    return rounded(lookup_totals(_looked_up(spark, d)), "hit_rate")


LABEL_CTE = """labs AS (SELECT 'ps-' || lpad(CAST(doc_id + 1 AS VARCHAR), 10, '0') AS event_id, toxic = 1 AS is_fraud, quality FROM labels)"""


@query(
    "labels_upsert",
    with_ctes(LABEL_CTE, """SELECT event_id, CASE WHEN quality = 0 THEN NOT is_fraud ELSE is_fraud END AS is_fraud FROM labs"""),
)
def labels_upsert(spark, d):
    """Labels of low-quality rows are corrected."""
    stored = fixture.prediction_labels(spark, d)
    edits = fixture.table(spark, d, "labels").where("quality = 0").selectExpr(
        "concat('ps-', lpad(CAST(doc_id + 1 AS STRING), 10, '0')) AS event_id", "toxic <> 1 AS is_fraud")
    return ops.apply_label_edits(stored, edits)


@query("labels_clear", with_ctes(LABEL_CTE, "SELECT event_id, is_fraud FROM labs WHERE quality <> 0"))
def labels_clear(spark, d):
    """Clearing a label removes the row; it never becomes false."""
    edits = fixture.table(spark, d, "labels").where("quality = 0").selectExpr(
        "concat('ps-', lpad(CAST(doc_id + 1 AS STRING), 10, '0')) AS event_id", "CAST(NULL AS BOOLEAN) AS is_fraud")
    return ops.apply_label_edits(fixture.prediction_labels(spark, d), edits)


@query(
    "labels_import_parse",
    with_ctes(SILVER + ", " + LABEL_CTE, """SELECT l.event_id, l.is_fraud,
      coalesce(s.txn_type IN ('TRANSFER', 'CASH_OUT'), false) AS known FROM labs l LEFT JOIN silver s USING (event_id)"""),
)
def labels_import_parse(spark, d):
    text = fixture.table(spark, d, "labels").selectExpr(
        "concat('ps-', lpad(CAST(doc_id + 1 AS STRING), 10, '0')) AS event_id",
        "CASE WHEN toxic = 1 THEN element_at(array(' Yes', 'TRUE ', '1', 'fraud'), CAST(doc_id % 4 + 1 AS INT)) "
        "ELSE element_at(array('False', '0', 'legit', ''), CAST(doc_id % 4 + 1 AS INT)) END AS is_fraud")
    known = silver(spark, d).where("txn_type IN ('TRANSFER', 'CASH_OUT')")
    return ops.parse_label_csv(text, known)


@query("run_audit", with_ctes(LEDGER, """SELECT 'bronze' AS layer, 'success' AS status, count(*) AS rows_in,
    count(*) FILTER (WHERE txn_type <> 'DEBIT') AS rows_out, '' AS detail FROM ledger
  UNION ALL SELECT 'gold', 'failed', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 'ValueError: bad column set'"""))
def run_audit(spark, d):
    table, out = fresh_dir(spark, "runs"), fresh_dir(spark, "bronze")
    with ops.track_run(spark, table, "bronze") as run:
        ops.move_counted(ledger(spark, d), out, lambda rows: rows.where("txn_type <> 'DEBIT'"), run)
    try:
        with ops.track_run(spark, table, "gold"):
            raise ValueError("bad column set")
    except ValueError:
        pass
    return spark.read.parquet(table).select("layer", "status", "rows_in", "rows_out", "detail")


@query(
    "deployment_audit",
    f"""SELECT model_name, arg_max(version, (resolved_at_us, version)) AS version, max(resolved_at_us) AS resolved_at_us,
      count(DISTINCT version) AS versions_seen, max(resolved_at_us) >= {NOW_US - 3_600_000_000} AS is_fresh
    FROM (SELECT 'model-' || event_type AS model_name, 'v' || (user_id % 5) AS version, epoch_us(ts) AS resolved_at_us FROM events)
    GROUP BY model_name""",
)
def deployment_audit(spark, d):
    """Each event is read as one process reporting the version it resolved."""
    log = fixture.table(spark, d, "events").selectExpr(
        "concat('model-', event_type) AS model_name", "concat('v', user_id % 5) AS version",
        f"{c.micros('ts')} AS resolved_at_us")
    return ops.latest_deployment(log, NOW_US, 3_600_000_000)
