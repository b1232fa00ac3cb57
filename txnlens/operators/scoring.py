"""Scoring where each score feeds the next row of the same account."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions.schema import LABEL_COLUMNS, TXN_COLUMNS
from txnlens.operators.account import account_features, with_features
from txnlens.operators.portable import LinearModel
from txnlens.operators.prefix import HOT_ROWS
from txnlens.operators.state import account_state, merge_states
from txnlens.sources.events import to_scored_events, write_scored_events
from txnlens.sources.scratch import stored
from txnlens.sources.state_log import StateLog

FEEDBACK = "prev_fraud_score"


class Scorer(Protocol):
    """What scores a matrix with one column for each of ``features``; a missing value is NaN."""

    features: tuple[str, ...]

    def predict(self, x: np.ndarray) -> np.ndarray: ...


@dataclass(frozen=True)
class LogisticModel:
    """``sigmoid(intercept + weights . features + feedback * previous score)``; NULLs count as 0."""

    intercept: float
    weights: dict[str, float] = field(default_factory=dict)
    feedback: float = 0.0

    @property
    def features(self) -> tuple[str, ...]:
        return (*sorted(self.weights), FEEDBACK)

    def predict(self, x: np.ndarray) -> np.ndarray:
        weights = np.array([self.weights[f] for f in sorted(self.weights)] + [self.feedback])
        return LinearModel(self.features, np.zeros(len(weights)), weights, self.intercept).predict(x)


# Fixed weights of the demonstration model.
DEFAULT_MODEL = LogisticModel(
    intercept=-2.0,
    weights={
        "amount_ratio_vs_prior_max": 0.6,
        "amount_z_vs_prior": 0.25,
        "is_fraud_capable_type": 1.2,
        "drains_account": 0.8,
        "dest_is_new": 0.3,
    },
    feedback=0.9,
)


def _fold(model: Scorer):
    """Score rows that come account by account in time order.

    Only the last account and its score are kept from one batch of rows to the next. Inside a batch the first rows of all
    accounts are scored together, then the second ones, and so on.
    """
    at = model.features.index(FEEDBACK) if FEEDBACK in model.features else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        account, last = None, np.nan
        for rows in batches:
            if not len(rows):
                continue
            x = rows[list(model.features)].to_numpy(float)
            score = np.empty(len(rows))
            if at is None:
                score = model.predict(x)
            else:
                names = rows["account_id"].to_numpy(object)
                begins = np.append(True, names[1:] != names[:-1])
                begin = np.flatnonzero(begins)
                before = rows["seed"].to_numpy(float)[begin]
                if names[0] == account:
                    before[0] = last
                length = np.diff(np.append(begin, len(rows)))
                for k in range(length.max()):
                    live = length > k
                    here = begin[live] + k
                    x[here, at] = before[live]
                    score[here] = before[live] = model.predict(x[here])
                account, last = names[-1], score[-1]
            yield pd.DataFrame({"event_id": rows["event_id"], "fraud_score": score})

    return run


def score_sequential(
    txn: DataFrame, model: Scorer, threshold: float, hot_rows: int = HOT_ROWS, states: DataFrame | None = None
) -> DataFrame:
    """Score every row in its account's time order, feeding each score into the next row; nothing is written.

    ``model`` is anything with ``features`` and ``predict``, such as ``array_model`` of a fitted pipeline. All features but
    the previous score come from Spark's windows; only the recurrence runs in a task, over rows sorted by account and time
    that stream through it. ``states`` are the account states before these rows: features and scores continue there.

    The rule for hot accounts: the scores of one account form a chain, so its rows stay in one task, which holds one batch
    of them whatever their number; its time grows with the account's rows, one prediction each. A model without
    ``prev_fraud_score`` has no chain and scores whole batches at once.
    """
    keep = ["event_id", "account_id", "event_ts_us", "seconds_since_last_txn", "txn_count_prior"]
    inputs = [f for f in model.features if f != FEEDBACK]
    features = stored(account_features(txn, hot_rows=hot_rows, states=states).select(*dict.fromkeys([*keep, *inputs])), "features")
    rows = features.select("event_id", "account_id", "event_ts_us", *[F.col(f).cast("double").alias(f) for f in inputs])
    if states is not None:
        rows = rows.join(states.selectExpr("account_id", "last_fraud_score AS seed"), "account_id", "left")
    else:
        rows = rows.withColumn("seed", F.lit(None).cast("double"))
    if FEEDBACK in model.features:
        rows = rows.withColumn(FEEDBACK, F.lit(None).cast("double"))
        rows = rows.repartition("account_id").sortWithinPartitions("account_id", "event_ts_us", "event_id")
    scores = rows.mapInPandas(_fold(model), "event_id string, fraud_score double")
    return features.join(scores, "event_id").selectExpr(
        "event_id", "account_id", "event_ts_us", "seconds_since_last_txn", "txn_count_prior > 0 AS had_prev_state", "fraud_score",
        f"CASE WHEN fraud_score >= {threshold}D THEN 'FRAUD' ELSE 'LEGIT' END AS decision")


def score_requests(
    requests: DataFrame, model: Scorer, threshold: float, log: StateLog, events: str, *, request: str = "request_no",
    scored_at: str = "event_ts_us", dry_run: bool = False, model_version: str = "1", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Score a batch of transactions from the stored account states; results come in the order of ``request``.

    A ``dry_run`` reads the states and writes nothing, so it gives the scores that a live batch would get. Otherwise the
    scored events are appended below ``events`` and then the new states become the log's next batch. A run that fails in
    between left the states as they were: repeated, it gives the same scores and appends the same events again, of which
    the load of scored events keeps the first. ``scored_at`` is the moment that the events say. One batch at a time.
    """
    spark = requests.sparkSession
    number = log.next_batch(spark)
    rows = stored(requests.select(*TXN_COLUMNS, request), "requests")
    before = stored(log.before(spark, number).join(rows.select("account_id").distinct(), "account_id", "left_semi"), "states-before")
    scores = stored(score_sequential(rows, model, threshold, hot_rows, before), "scores")
    if not dry_run:
        scored = stored(rows.join(scores.select("event_id", "fraud_score"), "event_id"), "scored")
        seen = _with_feedback(scored, before, hot_rows)
        write_scored_events(to_scored_events(
            seen, "fraud_score", scored_at, threshold=threshold, model_version=model_version), events)
        log.write(merge_states(before, account_state(scored, score="fraud_score")), number)
    out = scores.join(rows.select("event_id", request), "event_id").withColumn("model_version", F.lit(model_version))
    return out.select(request, *[c for c in out.columns if c != request]).orderBy(request)


def _with_feedback(scored: DataFrame, before: DataFrame, hot_rows: int) -> DataFrame:
    """Scored rows with a struct ``f`` of all features, the previous score included."""
    return with_features(scored, scored.columns, score="fraud_score", states=before, hot_rows=hot_rows)


def replay_result(txn: DataFrame, scores: DataFrame) -> DataFrame:
    """Batch scores attached to the labelled transactions; unscored rows stay with NULL."""
    return txn.select("event_id", "account_id", *LABEL_COLUMNS).join(scores, "event_id", "left").select(
        "event_id", "account_id", "fraud_score", *LABEL_COLUMNS
    )
