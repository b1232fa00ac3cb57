"""A training-data pipeline over ``documents``: rules, near-dedup, passage dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes it as Parquet in the session's shared
folder and reads it again as the next stage's documents. All but the last keep the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.llm import mixture, near_dedup, packing, quality_rules, substring_dedup
from txnlens.llm.queries import ship, table
from txnlens.sources.scratch import stored

TOKENIZER = "word_bpe_49k.json"
ORACLE_SQL = None  # the learnt rules and the tokenizer are beyond SQL; tests compare with a brute-force version


def _whole(docs: DataFrame) -> DataFrame:
    """The rows as one struct column, so that no column name of theirs can clash."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and meet no learnt rule for rejection."""
    ship(spark)
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id. Rows that repeat it go."""
    ship(spark)
    found = near_dedup.near_duplicates(docs).where("kept")
    ids = found.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    rows = _whole(docs).withColumns({"t": F.xxhash64(F.coalesce(F.col("doc.text").cast("string"), F.lit(""))), "i": F.col("doc.doc_id").cast("long")})
    kept = rows.join(ids, F.expr("i <=> id AND t = key"), "left_semi")
    return _named(kept.dropDuplicates(["i", "t"]), docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated passages; a text that loses nothing stays as it was."""
    ship(spark)
    rows = substring_dedup.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("doc.text"))
    return _named(rows.select(F.col("doc").withField("text", text).alias("doc")), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    ship(spark)
    return mixture.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", quality), ("minhash_dedup", near_duplicates), ("substring_dedup", passages),
    ("mix_sources", mixing), ("best_two_fit", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
