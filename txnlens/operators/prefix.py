"""Ordered "everything before this row" computations that survive hot keys.

A plain window partitioned by a key sends all rows of that key to one task.  Here the key is
split: keys with more than ``hot_rows`` rows are cut into consecutive ranges of about equal
depth, the window runs inside ``(key, range)``, and each range is lifted by the combined result
of the ranges before it.  Keys below the limit keep the single-window plan.  Ranges follow the
rows themselves (Spark samples them), so bursts and ties of values make no deep range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.sources.scratch import stored

HOT_ROWS = 5_000_000  # rows of one key that one task is allowed to order
RECUTS = 6  # times that ranges are cut twice as fine when a sample has left one too deep


def _over(keys: list[str], order: list[str], frame: str = "") -> str:
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f"OVER ({part}ORDER BY {', '.join(order)} {frame})"


BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
UP_TO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _combine(kind: str, before: str, here: str) -> str:
    if kind == "count":
        return f"coalesce({before}, 0L) + {here}"
    if kind == "sum":
        return f"CASE WHEN {before} IS NULL THEN {here} ELSE {before} + coalesce({here}, 0) END"
    return f"{'least' if kind == 'min' else 'greatest'}({before}, {here})"


def in_ranges(rows: DataFrame, order: list[str | Column], depth: int) -> DataFrame:
    """The rows, stored, with ``_chunk``: consecutive ranges along ``order`` of at most ``2 * depth`` rows each.

    ``_chunk`` grows along the order. Spark's range partitioning finds the cuts by sampling; the depths are counted
    afterwards, and where one is too deep all is cut finer. Rows that are equal in all of ``order`` stay together.
    """
    pieces = -(-rows.count() // depth)
    for _ in range(RECUTS):
        cut = stored(rows.repartitionByRange(max(1, pieces), *order).withColumn("_chunk", F.spark_partition_id().cast("long")), "ranges")
        deepest = cut.groupBy("_chunk").count().agg(F.max("count")).first()[0] or 0
        if deepest <= 2 * depth:
            break
        pieces *= 2
    return cut


def _chunked(df: DataFrame, keys: list[str], order: list[str], hot_rows: int, inputs: list[str]) -> tuple[DataFrame, bool]:
    """Add ``_chunk``, NULL for keys that need no splitting, and say whether any key does.

    The hot list holds at most ``rows / hot_rows`` keys, so broadcasting it is safe.
    """
    rows = df.selectExpr(*df.columns, *inputs)
    hot = df.groupBy(*keys).agg(F.expr("count(1) AS _n")).where(f"_n > {hot_rows}").select(*keys)
    found = hot.collect()
    if not found:
        return rows.withColumn("_chunk", F.lit(None).cast("long")), False
    listed = F.broadcast(df.sparkSession.createDataFrame(found, hot.schema))
    same = reduce(lambda x, y: x & y, [rows[k].eqNullSafe(listed[k]) for k in keys])
    cold = rows.join(listed, same, "left_anti").withColumn("_chunk", F.lit(None).cast("long"))
    return cold.unionByName(in_ranges(rows.join(listed, same, "left_semi"), [*keys, *order], hot_rows)), True


def prior_rows(
    df: DataFrame,
    keys: list[str],
    pos: str,
    aggs: dict[str, tuple[str, str]],
    prev: list[str] | None = None,
    tie: list[str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add one column per aggregate over the rows of the same key strictly before this one.

    ``df`` is read several times (finding hot keys, the windows, range totals), so it
    should be a table or cheap to compute.  ``pos`` is the leading integer ordering column and
    ``tie`` the columns that break its ties.  ``aggs`` maps an output name to ``(count|sum|min|max, expression)``.  With ``prev``
    a struct column ``prev`` holds those columns of the immediately preceding row.
    """
    order = [pos, *(tie or [])]
    rows, split = _chunked(df, keys, order, hot_rows, [f"{expr} AS _in_{name}" for name, (_, expr) in aggs.items()])

    inside = [*keys, "_chunk"]
    local = [f"{kind}(_in_{n}) {_over(inside, order, BEFORE)} AS _here_{n}" for n, (kind, _) in aggs.items()]
    # Totals exist for chunks of hot keys only; map-side combine keeps this shuffle tiny.
    totals = [f"{kind}(_in_{n}) AS _tot_{n}" for n, (kind, _) in aggs.items()]
    fold = {"count": "sum"}
    carried = [
        f"{fold.get(kind, kind)}(_tot_{n}) {_over(keys, ['_chunk'], BEFORE)} AS _carry_{n}"
        for n, (kind, _) in aggs.items()
    ]
    out = [f"{_combine(kind, f'_carry_{n}', f'_here_{n}')} AS {n}" for n, (kind, _) in aggs.items()]
    if prev:
        row = f"struct({', '.join(prev)})"
        local.append(f"lag({row}) {_over(inside, order)} AS _here_prev")
        totals.append(f"max_by({row}, struct({', '.join(order)})) AS _tot_prev")
        carried.append(f"lag(_tot_prev) {_over(keys, ['_chunk'])} AS _carry_prev")
        out.append("coalesce(_here_prev, _carry_prev) AS prev")
    if not split:
        whole = [x.replace(", _chunk ORDER BY", " ORDER BY") for x in local]
        plain = [f"_here_{n} AS {n}" for n in aggs] + (["_here_prev AS prev"] if prev else [])
        return rows.selectExpr(*df.columns, *whole).selectExpr(*df.columns, *plain)

    chunks = rows.where("_chunk IS NOT NULL").groupBy(*inside).agg(*[F.expr(t) for t in totals])
    # One row per range of a hot key: at most rows / hot_rows of them.
    carry = chunks.selectExpr(*inside, *carried)
    here = rows.selectExpr(*df.columns, "_chunk", *local)
    joined = here.join(carry.select(*[F.col(k).alias(f"_k_{k}") for k in inside], *[c for c in carry.columns if c not in inside]),
                       reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in inside]), "left")
    return joined.selectExpr(*df.columns, *out)


# Distinct ordering values up to which a single window per key is used.
SINGLE_WINDOW_VALUES = 1_000_000


def cumulate_desc(
    points: DataFrame, keys: list[str], value: str, sums: list[str], limit: int = SINGLE_WINDOW_VALUES,
    keep: list[str] | None = None,
) -> DataFrame:
    """Replace each column in ``sums`` by its running total over ``value`` descending.

    ``points`` has one row per (keys, value) and should be stored: it is counted first; columns in ``keep`` pass
    through.  Beyond ``limit`` points the order is cut into ranges of points, not of the rows behind them: windows run
    inside a range and the totals of the higher ranges of the key are added.
    """
    down = [f"{value} DESC"]
    kept = [*keys, value, *(keep or [])]
    if points.count() <= limit:
        return points.selectExpr(*kept, *[f"sum({c}) {_over(keys, down, UP_TO)} AS {c}" for c in sums])
    rows = in_ranges(points, [*keys, F.desc(value)], limit)
    inside = [*keys, "_chunk"]
    local = [f"sum({c}) {_over(inside, down, UP_TO)} AS _here_{c}" for c in sums]
    totals = rows.groupBy(*inside).agg(*[F.expr(f"sum({c}) AS _tot_{c}") for c in sums])
    # One row per (key, range): at most points / limit and the number of keys.
    carry = totals.selectExpr(
        *[f"{k} AS _k_{k}" for k in inside],
        *[f"sum(_tot_{c}) {_over(keys, ['_chunk'], BEFORE)} AS _carry_{c}" for c in sums])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in inside])
    joined = rows.selectExpr(*kept, "_chunk", *local).join(carry, same, "left")
    return joined.selectExpr(*kept, *[f"_here_{c} + coalesce(_carry_{c}, 0) AS {c}" for c in sums])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def recent_values(
    df: DataFrame, keys: list[str], pos: str, tie: list[str], value: str, n: int, out: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``out``: the last ``n`` values of the key up to and including this row, oldest first.

    ``value`` must not be NULL.  Hot keys are cut into chunks; each chunk receives the last
    ``n`` values before it, so arrays never exceed ``n`` entries per chunk looked at.
    """
    order = [pos, *tie]
    rows, _ = _chunked(df, keys, order, hot_rows, [f"{value} AS _v"])
    inside = [*keys, "_chunk"]
    frame = f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    backwards = [f"{o} DESC" for o in order]
    tails = (
        rows.where("_chunk IS NOT NULL")
        .selectExpr(*inside, *order, "_v", f"row_number() {_over(inside, backwards)} AS _back")
        .where(f"_back <= {n}")
        .groupBy(*inside)
        .agg(F.expr(f"transform(array_sort(collect_list(struct({', '.join(order)}, _v))), x -> x._v) AS _tail"))
    )
    earlier = f"flatten(collect_list(_tail) {_over(keys, ['_chunk'], f'ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING')})"
    carry = tails.selectExpr(*inside, f"{earlier} AS _earlier")
    joined = rows.selectExpr(*df.columns, "_chunk", f"collect_list(_v) {_over(inside, order, frame)} AS _here").join(
        carry, inside, "left"
    )
    lifted = f"reverse(slice(reverse(concat(_earlier, _here)), 1, {n}))"
    return joined.selectExpr(*df.columns, f"CASE WHEN _earlier IS NULL THEN _here ELSE {lifted} END AS {out}")


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], limit: int = SINGLE_WINDOW_VALUES) -> DataFrame:
    """Exact interpolated quantiles per key, one column per entry of ``probs``.

    Equal values are counted first and ranks come from running counts, so no task holds all
    values of a group (as the ``percentile`` aggregate would).
    """
    points = stored(df.where(f"{value} IS NOT NULL").groupBy(*keys, value).agg(F.expr("count(1) AS _rows")), "points")
    ranked = cumulate_desc(points, keys, value, ["_rows"], limit)
    sizes = points.groupBy(*keys).agg(F.expr("sum(_rows) AS _n"))
    # ``_rows`` now counts the values >= this one; ascending rank r is reached by the
    # smallest value that has at most n - 1 - r values strictly above the group's rest.
    sized = ranked.join(sizes, keys) if keys else ranked.crossJoin(F.broadcast(sizes))
    picks = []
    for name, p in probs.items():
        at = f"({p!r}D * (_n - 1))"
        picks.append(F.expr(f"max({value}) FILTER (WHERE _rows >= _n - floor({at})) AS _lo_{name}"))
        picks.append(F.expr(f"max({value}) FILTER (WHERE _rows >= _n - ceil({at})) AS _hi_{name}"))
        picks.append(F.expr(f"max({at} - floor({at})) AS _part_{name}"))
    picked = sized.groupBy(*keys).agg(*picks)
    return picked.selectExpr(
        *keys, *[f"_lo_{n} + (_hi_{n} - _lo_{n}) * _part_{n} AS {n}" for n in probs]
    )
