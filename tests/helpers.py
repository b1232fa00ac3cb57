"""Plain-Python oracles and builders used by the tests only."""

from __future__ import annotations

import math

EPOCH = 1_704_067_200_000_000
HOUR = 3_600_000_000


def txn(i, account, step, amount, typ="PAYMENT", dest="M1", old=1000.0, new=None, ts=None, fraud=False):
    return (
        f"e{i:04d}", account, dest, typ, float(amount), float(old), float(old - amount if new is None else new), 0.0, float(amount),
        step, EPOCH + (step - 1) * HOUR + i if ts is None else ts, fraud, False, i,
    )


TXN_SCHEMA = (
    "event_id string, account_id string, dest_id string, txn_type string, amount double, oldbalance_org double, "
    "newbalance_orig double, oldbalance_dest double, newbalance_dest double, step long, event_ts_us long, "
    "is_fraud boolean, is_flagged_fraud boolean, bronze_row_num long"
)
NAMES = [c.split()[0] for c in TXN_SCHEMA.split(", ")]


def frame(spark, rows):
    return spark.createDataFrame(rows, TXN_SCHEMA)


def ratio(n, d):
    return None if d is None or abs(d) < 1e-9 else n / d


def walk(rows):
    """Visit each account's rows in time order; yield (row dict, history list)."""
    seen: dict[str, list[dict]] = {}
    for row in sorted((dict(zip(NAMES, r)) for r in rows), key=lambda r: (r["account_id"], r["event_ts_us"], r["event_id"])):
        past = seen.setdefault(row["account_id"], [])
        yield row, past
        past.append(row)


def expected_features(rows):
    """A few history features per event, straight from their definitions."""
    out = {}
    for row, past in walk(rows):
        a, n = row["amount"], len(past)
        amounts = [p["amount"] for p in past]
        mean = sum(amounts) / n if n else None
        var = max(sum(x * x for x in amounts) / n - mean * mean, 0.0) if n else None
        last = past[-1] if n else None
        out[row["event_id"]] = {
            "is_first_txn": float(n == 0),
            "txn_count_prior": float(n),
            "seconds_since_last_txn": (row["event_ts_us"] - last["event_ts_us"]) / 1e6 if n else None,
            "amount_delta_vs_last": a - last["amount"] if n else None,
            "amount_ratio_vs_last": ratio(a, last["amount"]) if n else None,
            "amount_ratio_vs_prior_mean": ratio(a, mean) if n else None,
            "amount_ratio_vs_prior_max": ratio(a, max(amounts)) if n else None,
            "amount_z_vs_prior": ratio(a - mean, math.sqrt(var)) if n >= 2 and var > 1e-6 else None,
            "account_age_hours": (row["event_ts_us"] - past[0]["event_ts_us"]) / 3.6e9 if n else None,
            "balance_gap_org": row["oldbalance_org"] - last["newbalance_orig"] if n else None,
            "dest_is_new": float(row["dest_id"] != last["dest_id"]) if n else None,
            "prev_txn_type": last["txn_type"] if n else "__NONE__",
        }
    return out


def close(a, b, rel=1e-9):
    if a is None or b is None or isinstance(a, str):
        return a == b
    return math.isclose(a, b, rel_tol=rel, abs_tol=1e-9)
