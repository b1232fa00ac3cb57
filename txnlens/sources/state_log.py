"""A log of keyed states: a folder of changes per batch, with snapshots so that reading costs keys and a short tail.

``path/batch_id=N`` holds the rows that batch N changed, ``path_snapshots/through=N`` the latest row of every key among
batches 0 to N. Spark writes a folder's ``_SUCCESS`` last, so a snapshot counts from the moment that marker appears, and a
compaction that fails before leaves readers with the snapshot and the tail they had. All folders are overwritten when a
batch or a compaction is repeated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.functions.schema import STATE


@dataclass(frozen=True)
class StateLog:
    """``order`` says which of a key's rows is the latest; it may use ``batch_id``."""

    path: str
    order: str = "batch_id"
    key: str = "account_id"
    schema: T.StructType = STATE
    compact_every: int = 20  # batches

    @property
    def snapshots(self) -> str:
        return f"{self.path}_snapshots"

    def _numbers(self, spark: SparkSession, pattern: str) -> list[int]:
        where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
        return sorted(int(re.search(r"=(\d+)/_SUCCESS$", f.getPath().toString()).group(1)) for f in found or [])

    def batches(self, spark: SparkSession) -> list[int]:
        """Numbers of the batches whose write has been committed."""
        return self._numbers(spark, f"{self.path}/batch_id=*/_SUCCESS")

    def next_batch(self, spark: SparkSession) -> int:
        done = self.batches(spark) + self._numbers(spark, f"{self.snapshots}/through=*/_SUCCESS")
        return max(done, default=-1) + 1

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The latest row of each key among batches below ``batch_id``: what that batch saw when it first ran."""
        return self._latest(spark, batch_id).drop("batch_id")

    def current(self, spark: SparkSession) -> DataFrame:
        return self.before(spark, self.next_batch(spark))

    def sources(self, spark: SparkSession, batch_id: int) -> list[str]:
        """The folders that hold what came before ``batch_id``: the last snapshot and the batches after it."""
        taken = max((n for n in self._numbers(spark, f"{self.snapshots}/through=*/_SUCCESS") if n < batch_id), default=None)
        tail = [f"{self.path}/batch_id={n}" for n in self.batches(spark) if (-1 if taken is None else taken) < n < batch_id]
        return ([] if taken is None else [f"{self.snapshots}/through={taken}"]) + tail

    def _latest(self, spark: SparkSession, batch_id: int) -> DataFrame:
        schema = T.StructType(list(self.schema.fields)).add("batch_id", "long")
        folders = self.sources(spark, batch_id)
        if not folders:
            return spark.createDataFrame([], schema)
        # The number is kept in the rows, so one read takes snapshot and tail.
        rows = spark.read.schema(schema).parquet(*folders)
        best = F.expr(f"max_by(struct({', '.join(schema.names)}), struct({self.order})) AS row")
        return rows.groupBy(self.key).agg(best).select("row.*")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """The rows that batch ``batch_id`` changed; now and then a snapshot."""
        named = rows.select(*self.schema.names).withColumn("batch_id", F.lit(batch_id).cast("long"))
        named.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")
        if (batch_id + 1) % self.compact_every == 0:
            self.compact(rows.sparkSession, batch_id)

    def compact(self, spark: SparkSession, through: int) -> None:
        """Write the snapshot of batches 0 to ``through``."""
        self._latest(spark, through + 1).write.mode("overwrite").parquet(f"{self.snapshots}/through={through}")

    def prune(self, spark: SparkSession) -> int:
        """Delete the batches below the last snapshot but one; returns how many.

        What a repeat of any batch since then reads is left alone.
        """
        taken = self._numbers(spark, f"{self.snapshots}/through=*/_SUCCESS")[:-1]
        old = [n for n in self.batches(spark) if taken and n <= taken[-1]]
        for n in old:
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch_id={n}")
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        return len(old)
