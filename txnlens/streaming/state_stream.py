"""Continuous account state over a watched folder of transaction files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txnlens.functions.schema import TXN
from txnlens.operators.state import account_state
from txnlens.sources.state_log import StateLog


def state_log(out: str, compact_every: int = 20) -> StateLog:
    """The log that ``stream_state`` writes to ``out``.

    Equal freshness takes the later batch: a late transaction changes totals without
    changing ``updated_at_us``, and that correction must win.
    """
    return StateLog(out, order="updated_at_us, batch_id", compact_every=compact_every)


def stream_state(
    spark: SparkSession, source: str, checkpoint: str, out: str, once: bool = True, interval: str = "500 milliseconds",
    compact_every: int = 20,
):
    """Start the stream; every change of an account's state is appended to ``out``, a log with snapshots.

    Totals live in the checkpointed state store, so a restart continues and counts no file
    twice.  With ``once`` the stream takes what is there and stops.
    """
    log = state_log(out, compact_every)

    def append(batch: DataFrame, batch_id: int) -> None:
        # One folder per micro-batch, overwritten when a batch is replayed: writing is
        # idempotent and costs only the accounts that changed.
        log.write(batch, batch_id)

    txn = spark.readStream.schema(TXN).json(source)
    writer = account_state(txn).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(append)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()


def current_states(spark: SparkSession, out: str) -> DataFrame:
    """Latest state per account: the last snapshot and the changes since."""
    return state_log(out).current(spark)


def backfill_state(spark: SparkSession, source: str) -> DataFrame:
    """The same fold over a static folder, one pass."""
    return account_state(spark.read.schema(TXN).json(source))
