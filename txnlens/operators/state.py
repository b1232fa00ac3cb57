"""Per-account state: one row per account, mergeable in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions import columns as c
from txnlens.functions.schema import ANCHOR_COLUMNS, MERCHANT_PREFIX, STATE, STATE_COLUMNS, STATE_VERSION

SUM_TYPES = {"amount_sum": "decimal(28,2)", "amount_sqsum": "decimal(38,4)"}
FRESHEST = "max_by(struct({cols}), struct({order}))"


def row_states(txn: DataFrame, score: str | None = None) -> DataFrame:
    """The state an account would have after this one transaction alone."""
    return txn.selectExpr(
        "account_id",
        "event_id AS last_event_id",
        "event_ts_us AS last_event_ts_us",
        "step AS last_step",
        "txn_type AS last_txn_type",
        "amount AS last_amount",
        "oldbalance_org AS last_oldbalance_org",
        "newbalance_orig AS last_newbalance_orig",
        "dest_id AS last_dest_id",
        f"startswith(dest_id, '{MERCHANT_PREFIX}') AS last_dest_is_merchant",
        f"CAST({score or 'NULL'} AS DOUBLE) AS last_fraud_score",
        "event_ts_us AS first_event_ts_us",
        "1L AS txn_count",
        f"CAST({c.money('amount')} AS {SUM_TYPES['amount_sum']}) AS amount_sum",
        f"CAST({c.money_square('amount')} AS {SUM_TYPES['amount_sqsum']}) AS amount_sqsum",
        "amount AS max_amount",
        "event_ts_us AS updated_at_us",
    )


def _combine(states: DataFrame) -> DataFrame:
    """Fold partial states per account; every aggregate is associative and commutative.

    The anchor follows the total order (timestamp, event id), so a late event adds to the
    totals but never moves the anchor back.
    """
    anchor = FRESHEST.format(cols=", ".join(ANCHOR_COLUMNS), order="last_event_ts_us, last_event_id")
    folded = states.groupBy("account_id").agg(
        F.expr(f"{anchor} AS anchor"),
        F.expr("min(first_event_ts_us) AS first_event_ts_us"),
        F.expr("sum(txn_count) AS txn_count"),
        F.expr("sum(amount_sum) AS amount_sum"),
        F.expr("sum(amount_sqsum) AS amount_sqsum"),
        F.expr("max(max_amount) AS max_amount"),
        F.expr("max(updated_at_us) AS updated_at_us"),
    )
    flat = {name: f"anchor.{name}" for name in ANCHOR_COLUMNS}
    flat["state_version"] = str(STATE_VERSION)
    types = {f.name: f.dataType.simpleString() for f in STATE.fields}
    return folded.selectExpr(*[f"CAST({flat.get(n, n)} AS {types[n]}) AS {n}" for n in STATE_COLUMNS])


def account_state(txn: DataFrame, score: str | None = None) -> DataFrame:
    """Fold transactions into one state row per account (batch or streaming frame)."""
    return _combine(row_states(txn, score))


def merge_states(a: DataFrame, b: DataFrame) -> DataFrame:
    """Combine two state frames; accounts found on one side only pass through."""
    both = a.select(*STATE_COLUMNS).unionByName(b.select(*STATE_COLUMNS))
    exact = [f"CAST({n} AS {SUM_TYPES[n]}) AS {n}" if n in SUM_TYPES else n for n in STATE_COLUMNS]
    return _combine(both.selectExpr(*exact))


def state_key(prefix: str = "txnlens") -> str:
    return f"concat_ws(':', '{prefix}', 'acct', 'v{STATE_VERSION}', account_id)"


def with_state_json(states: DataFrame, prefix: str = "txnlens") -> DataFrame:
    """Storage form: key, version, compact JSON with sorted names, freshness."""
    doc = f"to_json(struct({', '.join(sorted(STATE_COLUMNS))}), map('ignoreNullFields', 'false'))"
    return states.selectExpr(
        "account_id", f"{state_key(prefix)} AS state_key", "state_version", f"{doc} AS state_json", "updated_at_us"
    )


def decoded(stored: DataFrame, json_col: str = "state_json") -> DataFrame:
    """Add ``state``: the parsed document, NULL for corrupt text and other versions."""
    doc = F.from_json(F.col(json_col), STATE, {"mode": "PERMISSIVE"})
    good = f"CASE WHEN _doc.state_version = {STATE_VERSION} AND _doc.account_id IS NOT NULL THEN _doc END AS state"
    return stored.withColumn("_doc", doc).selectExpr(*stored.columns, good)


def read_state_json(stored: DataFrame) -> DataFrame:
    return decoded(stored).where("state IS NOT NULL").selectExpr("state.*")


def upsert_latest(
    current: DataFrame,
    incoming: DataFrame,
    ties: str = "keep",
    ttl_us: int | None = None,
    now_us: int | None = None,
    key: str = "account_id",
) -> DataFrame:
    """Keep, per key, the row with the newest ``updated_at_us``.

    Equal timestamps keep the stored row (``ties='keep'``) or take the incoming one
    (``ties='take'``).  With ``ttl_us`` rows older than ``now_us - ttl_us`` expire.
    """
    if ties not in ("keep", "take"):
        raise ValueError(f"ties must be keep or take, not {ties!r}")
    names = current.columns
    stored_rank, incoming_rank = (1, 0) if ties == "keep" else (0, 1)
    both = current.selectExpr("*", f"{stored_rank} AS _rank").unionByName(
        incoming.selectExpr(*names, f"{incoming_rank} AS _rank")
    )
    best = FRESHEST.format(cols=", ".join(names), order="updated_at_us, _rank")
    kept = both.groupBy(key).agg(F.expr(f"{best} AS row")).select("row.*")
    return kept if ttl_us is None else kept.where(f"updated_at_us >= {now_us - ttl_us}")


def lookup_states(keys: DataFrame, stored: DataFrame) -> DataFrame:
    """Previous state for each requested account; anything unreadable is a cold start.

    ``hit`` says whether there is a state, ``found`` whether anything was stored.
    """
    readable = decoded(stored).selectExpr("account_id", "state", "true AS _found")
    return keys.join(readable, "account_id", "left").selectExpr(
        *keys.columns, "state", "state IS NOT NULL AS hit", "coalesce(_found, false) AS found")


def lookup_totals(looked_up: DataFrame) -> DataFrame:
    """Requests, hits and misses of a lookup, by whether the account's stored document was missing or unreadable."""
    return looked_up.selectExpr(
        "count(1) AS requests", "count_if(hit) AS hits", "count_if(NOT hit) AS misses",
        "count_if(NOT hit AND found) AS unreadable", "count_if(hit) / greatest(count(1), 1) AS hit_rate")


def state_cover(states: DataFrame, gold: DataFrame) -> DataFrame:
    """Accounts on either side and whether the two sets are the same size."""
    sides = states.selectExpr("account_id", "true AS s", "false AS g").unionByName(
        gold.selectExpr("account_id", "false AS s", "true AS g")
    )
    per_account = sides.groupBy("account_id").agg(F.expr("max(s) AS s"), F.expr("max(g) AS g"))
    return per_account.selectExpr(
        "count_if(s) AS state_accounts", "count_if(g) AS gold_accounts", "count_if(s) = count_if(g) AS covered"
    )


def diff_states(online: DataFrame, warehouse: DataFrame, n: int | None = None) -> DataFrame:
    """Compare anchors of all warehouse accounts, or of ``n`` hash-chosen ones; absence online is fine."""
    compared = ["last_event_id", "last_event_ts_us", "last_amount", "txn_count"]
    picked = warehouse if n is None else warehouse.orderBy(F.expr(c.md5_number("account_id")), "account_id").limit(n)
    joined = picked.alias("w").join(online.alias("o"), "account_id")
    return joined.selectExpr("account_id", *[f"NOT (o.{x} <=> w.{x}) AS {x}_differs" for x in compared])
