"""Time-ordered and deterministic splits, folds and data identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.functions import columns as c
from txnlens.operators.prefix import prior_rows
from txnlens.sources.scratch import stored

# Fixed cut points: last step of each stage before the final one.
THREE_STAGE = {"main": (480, 600), "alternative": (520, 631), "late": (594, 674)}
FOUR_STAGE = (480, 552, 600)
SINGLE_CUT = 355
WALK_CUTS = (360, 420, 480, 540)
WALK_WIDTH = 55
EMBARGOS = (0, 24, 168)


def stage(names: list[str], cuts: tuple[int, ...], step: str = "step") -> str:
    """SQL naming the stage of a step; ``cuts`` are inclusive upper ends."""
    if len(names) != len(cuts) + 1 or list(cuts) != sorted(set(cuts)):
        raise ValueError("need one more name than strictly increasing cuts")
    whens = " ".join(f"WHEN {step} <= {cut} THEN '{name}'" for name, cut in zip(names, cuts))
    return f"CASE {whens} ELSE '{names[-1]}' END"


def split_3stage(df: DataFrame, cuts: tuple[int, int] = THREE_STAGE["main"]) -> DataFrame:
    return df.selectExpr("*", f"{stage(['train', 'val', 'test'], cuts)} AS split")


def split_4stage(df: DataFrame, cuts: tuple[int, int, int] = FOUR_STAGE) -> DataFrame:
    return df.selectExpr("*", f"{stage(['train', 'calibration', 'policy', 'oot'], cuts)} AS split")


def split_quantile(df: DataFrame, cut: int = SINGLE_CUT) -> DataFrame:
    return df.selectExpr("*", f"{stage(['train', 'test'], (cut,))} AS split")


def _take_share(df: DataFrame, strata: list[str], row_id: str, seed: str, share: float, out: str) -> DataFrame:
    """Mark the first ``share`` of each stratum in hash order.

    Strata are few and huge, so the ranking is the split-key prefix count; hash values are
    uniform and cut evenly.
    """
    hashed = df.selectExpr("*", f"{c.md5_number(repr(seed), row_id)} AS _h")
    ranked = prior_rows(hashed, strata, "_h", {"_rank": ("count", "1")}, tie=[row_id])
    sizes = df.groupBy(*strata).agg(F.expr("count(1) AS _n"))
    return ranked.join(sizes, strata).selectExpr(*df.columns, f"_rank < floor({share!r}D * _n) AS {out}")


def split_random_stratified(
    df: DataFrame, label: str = "y", row_id: str = "row_num", seed: int = 42, train: float = 0.8
) -> DataFrame:
    """Exact share of every class for training, drawn by hash: the same on every run.

    ``inner_split`` divides the training part once more.
    """
    outer = stored(_take_share(df, [label], row_id, f"{seed}", train, "_train"), "outer")
    inner = _take_share(outer, [label, "_train"], row_id, f"{seed}-inner", train, "_fit")
    return inner.selectExpr(
        *df.columns,
        "CASE WHEN _train THEN 'train' ELSE 'test' END AS split",
        "CASE WHEN _train THEN CASE WHEN _fit THEN 'fit' ELSE 'val' END END AS inner_split",
    )


def stages_disjoint(df: DataFrame) -> DataFrame:
    """Per split its step range, and whether it starts after every earlier split ended."""
    spans = df.groupBy("split").agg(F.expr("min(step) AS first_step"), F.expr("max(step) AS last_step"))
    # A handful of rows, one per split.
    return spans.selectExpr(
        "split", "first_step", "last_step",
        "coalesce(first_step > max(last_step) OVER (ORDER BY first_step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS disjoint",
    )


def split_summary(df: DataFrame) -> DataFrame:
    parts = df.groupBy("split").agg(
        F.expr("count(1) AS rows"),
        F.expr("sum(y) AS positives"),
        F.expr(f"{c.money_sum('amount')} AS amount"),
        F.expr(f"{c.money_sum('amount', 'y = 1')} AS positive_amount"),
    )
    # One row per split, so the unpartitioned total is over a few rows.
    return parts.selectExpr("*", "rows / sum(rows) OVER () AS row_share", "positives / rows AS positive_rate")


def fold_table(spark: SparkSession, cuts=WALK_CUTS, width: int = WALK_WIDTH, embargos=(0,)) -> DataFrame:
    rows = [(e, cut, cut - e, cut + width) for e in embargos for cut in cuts]
    return spark.createDataFrame(rows, "embargo int, cut int, train_end int, test_end int")


def step_totals(df: DataFrame, *extra: str) -> DataFrame:
    """Rows and positives per step: fold sizes need no more than this small table."""
    return df.groupBy("step", *extra).agg(F.expr("count(1) AS rows"), F.expr("sum(y) AS positives"))


def walk_forward(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Size and usability of each fold, from per-step totals instead of copies of the rows."""
    sized = F.broadcast(folds).join(step_totals(df), F.expr("step <= test_end"))
    train, test = "step <= train_end", "step > cut"
    return sized.groupBy("embargo", "cut").agg(
        F.expr(f"coalesce(sum(rows) FILTER (WHERE {train}), 0) AS train_rows"),
        F.expr(f"coalesce(sum(positives) FILTER (WHERE {train}), 0) AS train_positives"),
        F.expr(f"coalesce(sum(rows) FILTER (WHERE {test}), 0) AS test_rows"),
        F.expr(f"coalesce(sum(positives) FILTER (WHERE {test}), 0) AS test_positives"),
    ).selectExpr("*", "train_rows > 0 AND test_positives > 0 AND test_positives < test_rows AS usable")


def fold_test_rows(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Test rows of every fold; a row is repeated only for folds whose window covers it."""
    return df.join(F.broadcast(folds), F.expr("step > cut AND step <= test_end"))


def fold_scores(df: DataFrame, folds: DataFrame, weight: float = 100.0) -> DataFrame:
    """Test rows of every fold with a score fitted on its training rows alone, which end ``embargo`` steps before the cut.

    The model is the smoothed fraud rate of the type and hour of day, learnt from per-step totals; what training
    has not seen scores 0.
    """
    hour = c.plain_hour()
    rates = F.broadcast(folds).join(step_totals(df, "txn_type"), F.expr("step <= train_end")).groupBy(
        "embargo", "cut", "txn_type", F.expr(hour).alias("hour")).agg(
        F.expr(f"(sum(positives) + 1) / (sum(rows) + {weight!r}D) AS rate"))
    rows = fold_test_rows(df.select("step", "txn_type", "y", "amount"), folds).withColumn("hour", F.expr(hour))
    # Folds x types x hours: the configuration and the domain fix its size.
    out = rows.join(F.broadcast(rates), ["embargo", "cut", "txn_type", "hour"], "left")
    return out.selectExpr("embargo", "cut", "y", "amount", "coalesce(rate, 0D) AS score")


def embargo_summary(ranked: DataFrame) -> DataFrame:
    """Spread of a fold metric per embargo, over folds whose test part has both classes."""
    usable = ranked.where("positives > 0 AND positives < rows")
    stats = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    return usable.groupBy("embargo").agg(*[F.expr(f"{fn}(average_precision) AS {n}") for n, fn in stats.items()])


def segment_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    """Expanding folds over equal step segments between the first and last step."""
    span = df.selectExpr("min(step) AS lo", "max(step) + 1 AS hi")
    edge = f"CAST(floor(lo + (hi - lo) * CAST({{}} AS DOUBLE) / {folds + 1}) AS BIGINT)"
    return span.selectExpr("*", f"explode(sequence(1, {folds})) AS fold").selectExpr(
        "fold", "lo AS train_start", f"{edge.format('fold')} AS test_start", f"{edge.format('(fold + 1)')} AS test_stop"
    )


def walk_forward_segments(df: DataFrame, folds: int = 5) -> DataFrame:
    bounds = F.broadcast(segment_folds(df, folds))  # one row per fold
    sized = step_totals(df).join(bounds, F.expr("step >= train_start AND step < test_stop"))
    return sized.groupBy("fold", "test_start", "test_stop").agg(
        F.expr("coalesce(sum(rows) FILTER (WHERE step < test_start), 0) AS train_rows"),
        F.expr("coalesce(sum(rows) FILTER (WHERE step >= test_start), 0) AS test_rows"),
        F.expr("coalesce(sum(positives) FILTER (WHERE step >= test_start), 0) AS test_positives"),
    )


def partition_fingerprint(df: DataFrame, by: str = "split", row_id: str = "row_num") -> DataFrame:
    """Order-free identity of the rows in each part: xor of row hashes, combined map-side."""
    return df.groupBy(by).agg(
        F.expr(f"bit_xor({c.md5_number(row_id)}) AS fingerprint"), F.expr("count(1) AS rows")
    )


def content_identity(df: DataFrame) -> str:
    """Identity of a table's whole content whatever the order of its rows: count, sum and xor of 64-bit row hashes."""
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    got = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(20,0)")), F.bit_xor(row)).first()
    return "-".join(str(x or 0) for x in got)


def data_identity(df: DataFrame, row_id: str = "row_num") -> DataFrame:
    return df.selectExpr(
        f"bit_xor({c.md5_number(row_id)}) AS fingerprint",
        "count(1) AS rows",
        "min(step) AS step_min",
        "max(step) AS step_max",
        f"{c.r6('avg(y)')} AS positive_rate",
    )
