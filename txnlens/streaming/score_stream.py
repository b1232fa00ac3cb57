"""Continuous scoring: each micro-batch continues from the states the batches before left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txnlens.functions.schema import TXN
from txnlens.operators.scoring import Scorer, score_sequential
from txnlens.operators.state import account_state, merge_states
from txnlens.sources.scratch import stored
from txnlens.sources.state_log import StateLog


def _score_batch(model: Scorer, threshold: float, scores: str, log: StateLog):
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = batch.select("account_id").distinct()
        before = stored(log.before(spark, batch_id).join(touched, "account_id", "left_semi"), "states-before")
        score_sequential(batch, model, threshold, states=before).write.mode("overwrite").parquet(f"{scores}/batch_id={batch_id}")
        scored = spark.read.parquet(f"{scores}/batch_id={batch_id}").select("event_id", "fraud_score")
        here = account_state(batch.join(scored, "event_id"), score="fraud_score")
        log.write(merge_states(before, here), batch_id)

    return run


def stream_scores(
    spark: SparkSession, source: str, checkpoint: str, scores: str, log: StateLog, model: Scorer, threshold: float,
    max_files: int | None = None,
):
    """Score new transaction files once each.

    Scores have one folder per micro-batch, and so has the log of states; a replay overwrites them and reads only what
    earlier batches left, so a restart repeats nothing and loses nothing. A batch costs its accounts, the last snapshot
    and the batches after it, not the whole log.
    """
    reader = spark.readStream.schema(TXN)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return (
        reader.json(source).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(_score_batch(model, threshold, scores, log)).start()
    )
