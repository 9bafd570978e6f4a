"""As-of joins, event merges and other alignments of series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_MS = 3_600_000


def asof(
    queries: DataFrame,
    readings: DataFrame,
    by: list[str],
    value: str,
    direction: str = "backward",
    tolerance_ms: int | None = None,
    tie: str | None = None,
) -> DataFrame:
    """Each query row with the value of the last reading at or before its ``ts`` (backward), or the first at or after (forward).

    Adds ``value`` and ``value_ts``; both null where there is no such reading, or none within
    ``tolerance_ms``. Of readings at the same ts the one with the largest ``tie`` counts. Null keys
    or times never match; null values are no readings.

    Queries and readings are laid together and one running window carries the reading along: one
    exchange of each side, no pairs. The window runs per ``by`` and hour; what is carried into an
    hour from earlier ones comes from the last (first) reading of each hour, a table of one row per
    key and hour. So a key that holds most rows is spread over its hours.
    """
    backward = direction == "backward"
    tie_col = F.col(tie) if tie else F.lit(0)
    r = readings.where(F.col(value).isNotNull() & F.col("ts").isNotNull()).select(*by, "ts", F.col(value).alias("_v"), tie_col.alias("_tie"))
    q = queries.withColumn("_q", F.lit(1))
    both = q.unionByName(r.withColumn("_q", F.lit(0)), allowMissingColumns=True).withColumn("_block", F.floor(F.col("ts") / BLOCK_MS))
    hit = F.when(F.col("_q") == 0, F.struct(F.col("ts").alias("t"), F.col("_v").alias("v")))
    if backward:
        order = [F.col("ts").asc(), F.col("_q").asc(), F.col("_tie").asc_nulls_first()]
        end = F.max_by(F.struct(F.col("ts").alias("t"), F.col("_v").alias("v")), F.struct("ts", "_tie"))
    else:
        order = [F.col("ts").desc(), F.col("_q").asc(), F.col("_tie").asc_nulls_first()]
        end = F.min_by(F.struct(F.col("ts").alias("t"), F.col("_v").alias("v")), F.struct(F.col("ts"), (-F.col("_tie")).alias("tie")))
    days = both.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    ends = r.withColumn("_block", F.floor(F.col("ts") / BLOCK_MS)).groupBy(*by, "_block").agg(end.alias("_own"))
    by_day = Window.partitionBy(*by).orderBy(F.col("_block").asc() if backward else F.col("_block").desc())
    carried = (
        days.join(ends, [*by, "_block"], "left")
        .withColumn("_carry", F.last("_own", ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, -1)))
        .select(*by, "_block", "_carry")
    )
    run = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_hit", F.last(hit, ignorenulls=True).over(run)).where("_q = 1").join(carried, [*by, "_block"], "left")
    best = F.coalesce("_hit", "_carry")
    near = F.lit(True)
    for c in by:
        near = near & F.col(c).isNotNull()
    if tolerance_ms is not None:
        near = near & (F.abs(F.col("ts") - best["t"]) <= tolerance_ms)
    return seen.withColumn("value", F.when(near, best["v"])).withColumn("value_ts", F.when(near, best["t"])).select(*queries.columns, "value", "value_ts")


def merged_events(tables: dict[str, DataFrame], columns: list[str], ranks: dict[str, int]) -> DataFrame:
    """Several event tables as one stream with ``kind`` and its tie rank; columns a table lacks are null.

    Ordering is left to the reader: (event_ms, kind_rank) is the stream's order.
    """
    parts = [df.withColumn("kind", F.lit(k)).withColumn("kind_rank", F.lit(ranks[k])) for k, df in tables.items()]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.select("event_ms", "kind", "kind_rank", *columns)


def complete_rows(long: DataFrame, at: str, source: str, sources: int) -> DataFrame:
    """Rows of the times at which every one of ``sources`` has a value."""
    full = long.groupBy(at).agg(F.count_distinct(source).alias("_n")).where(F.col("_n") == sources).select(at)
    return long.join(full, at, "leftsemi")


def calendar(first: str, last: str) -> str:
    """SQL expression of all days from ``first`` to ``last``, both included."""
    return f"explode(sequence(date'{first}', date'{last}', interval 1 day))"


def outside_intervals(rows: DataFrame, intervals: DataFrame, by: list[str], at: str) -> DataFrame:
    """Rows not strictly inside any interval (lo, hi) of their key. Intervals are few per key and joined by it."""
    inside = rows.join(intervals, by).where((F.col(at) > F.col("lo")) & (F.col(at) < F.col("hi"))).select(*by, at).distinct()
    return rows.join(inside, [*by, at], "leftanti")
