"""Ranks, floor-split buckets, correlation of ranks and multiple testing: one implementation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1 within ``by``; ties get the mean of their ranks."""
    w = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2


def floor_bucket(by: list[str], order: list[Column], parts: int) -> Column:
    """Bucket 0..parts-1 of a floor split: bucket d holds rows [n d // parts, n (d + 1) // parts) in order."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return F.floor((parts * rn - 1) / n).cast("int")


def pearson(x: str, y: str) -> Column:
    """Correlation; 0 where one side doesn't vary or there are fewer than two pairs."""
    return F.coalesce(F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)), F.lit(0.0))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation per ``by`` over pairs without nulls: ``ic`` (0 if degenerate) and pairs ``n``."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = pairs.withColumn("_rx", average_rank(x, by)).withColumn("_ry", average_rank(y, by))
    return ranked.groupBy(*by).agg(pearson("_rx", "_ry").alias("ic"), F.count(F.lit(1)).alias("n"))


def rejected(tests: DataFrame, p: str, alpha: float, dependent: bool = False) -> DataFrame:
    """Step-up false discovery control: ``rejected`` for all tests up to the last with p <= rank alpha / m.

    ``dependent`` divides by the harmonic number of m (valid under any dependence). A null p never
    rejects but counts in m. The window spans all tests: their number is that of hypotheses, one
    row each, not of data rows.
    """
    every = Window.partitionBy(F.lit(0))
    m = F.count(F.lit(1)).over(every)
    rank = F.row_number().over(every.orderBy(F.col(p).asc_nulls_last()))
    out = tests.withColumn("_m", m).withColumn("_rank", rank)
    scale = F.aggregate(F.sequence(F.lit(1), F.col("_m").cast("int")), F.lit(0.0), lambda a, k: a + 1 / k) if dependent else F.lit(1.0)
    limit = F.col("_rank") * alpha / (F.col("_m") * scale)
    last = F.max(F.when(F.col(p) <= limit, F.col("_rank"))).over(every)
    return out.withColumn("rejected", F.coalesce((F.col("_rank") <= last) & F.col(p).isNotNull(), F.lit(False))).drop("_m", "_rank")


def exact_percentiles(df: DataFrame, by: list[str], value: str, at: list[float], name: str) -> DataFrame:
    """Per group an array ``name`` of percentiles interpolated between neighbours, without a group's values in memory.

    Equal values are counted on the map side; a group's distinct values are sorted with spill and run
    through a window. Null values are none; a group without values has no row.
    """
    order = Window.partitionBy(*by).orderBy(value)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = counts.withColumn("_upto", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    ends = []
    for k, p in enumerate(at):
        place = F.lit(p) * (F.col("_n") - 1)
        ends += [F.min(F.when(F.col("_upto") > F.floor(place), F.col(value))).alias(f"_l{k}"), F.min(F.when(F.col("_upto") > F.ceil(place), F.col(value))).alias(f"_h{k}")]
    g = ranked.groupBy(*by).agg(F.max("_n").alias("_n"), *ends)
    share = lambda p: F.lit(p) * (F.col("_n") - 1) - F.floor(F.lit(p) * (F.col("_n") - 1))
    return g.select(*by, F.array(*[F.col(f"_l{k}") + (F.col(f"_h{k}") - F.col(f"_l{k}")) * share(p) for k, p in enumerate(at)]).alias(name))
