"""The raw ledger file: reading, writing, and the bronze table made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from txnlens.functions.schema import RAW, RAW_COLUMNS
from txnlens.sources.ops import write_counted

CORRUPT = "_corrupt_record"


class MissingColumns(ValueError):
    pass


def check_columns(found: list[str]) -> None:
    missing = [c for c in RAW_COLUMNS if c not in found]
    if missing:
        raise MissingColumns(f"ledger lacks columns: {', '.join(missing)}")


def read_ledger(spark: SparkSession, path: str, limit: int | None = None, mode: str = "FAILFAST") -> DataFrame:
    """Read the ledger CSV with its fixed schema.

    The header is read first, so a missing column is an error that names it.  ``limit``
    keeps the first rows of the source, of those that the mode keeps.  ``mode`` is Spark's CSV
    parse mode; ``PERMISSIVE`` keeps bad lines in ``_corrupt_record``, ``DROPMALFORMED`` skips
    them.  Every column of a line is parsed whatever a query reads, so which lines are bad does
    not depend on it.
    """
    header = spark.read.option("header", True).csv(path).columns
    check_columns(header)
    fields = {f.name: f for f in RAW.fields}
    schema = T.StructType([fields.get(c, T.StructField(c, T.StringType())) for c in header])
    skip = mode == "DROPMALFORMED"
    if skip or mode == "PERMISSIVE":
        schema = schema.add(CORRUPT, T.StringType())
    reader = spark.read.schema(schema).option("header", True).option("columnPruning", False)
    df = reader.option("mode", "PERMISSIVE" if skip else mode).option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    if skip:
        # The second condition always holds; it makes the scan read the whole line.
        df = df.where(F.col(CORRUPT).isNull() & (F.length(F.concat_ws("", *[F.col(c).cast("string") for c in header])) >= 0))
    keep = [*RAW_COLUMNS, *([CORRUPT] if mode == "PERMISSIVE" else [])]
    if limit is not None:
        df = number_rows(df).where(F.col("row_num") <= limit)
    return df.select(*keep)


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Write a ledger frame as raw CSV, part files following ``row_num``."""
    raw = ledger.select(
        "row_num",
        *[
            F.col(name).cast("int").alias(src) if src.startswith("is") else F.col(name).cast(typ).alias(src)
            for src, (name, typ) in RAW_COLUMNS.items()
        ],
    )
    parts = raw.repartitionByRange("row_num").sortWithinPartitions("row_num")
    parts.drop("row_num").write.option("header", True).csv(path)


def number_rows(df: DataFrame) -> DataFrame:
    """Add dense 1-based ``row_num`` in source order, straight on top of a file scan.

    Order is (file name, offset in file, line).  Only one small row per input split is
    ordered globally; the data itself is not shuffled.
    """
    tagged = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    blocks = tagged.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy(F.lit(0)).orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select(
        "_file", "_start", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    # One row per input split, so its size is bounded by input bytes / split size.
    return (
        tagged.join(F.broadcast(offsets), ["_file", "_start"])
        .withColumn("row_num", F.col("_offset") + F.col("_id") - F.col("_first") + 1)
        .drop("_file", "_start", "_id", "_first", "_offset")
    )


def to_bronze(raw: DataFrame, source_file: str) -> DataFrame:
    """Typed, unmodified ledger rows; ``raw`` carries ``row_num`` or sits on a file scan."""
    numbered = raw if "row_num" in raw.columns else number_rows(raw)
    typed = [
        (F.col(src) == 1 if src.startswith("is") else F.col(src).cast(typ)).alias(name)
        for src, (name, typ) in RAW_COLUMNS.items()
    ]
    return numbered.select(
        "row_num", *typed, F.lit(source_file).alias("source_file"), F.current_timestamp().alias("loaded_at")
    )


def load_bronze(spark: SparkSession, csv_path: str, out: str) -> int:
    """Full refresh of the bronze table; returns the number of rows written."""
    raw = read_ledger(spark, csv_path)
    return write_counted(to_bronze(raw, csv_path), out)
