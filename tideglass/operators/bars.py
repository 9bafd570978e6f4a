"""Bars, buckets and daily aggregates of trades and readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE_MS = 60_000


def exact(size: str) -> Column:
    return F.col(size).cast("decimal(38,12)")


def ohlcv(trades: DataFrame, by: list[str], step_ms: int = MINUTE_MS, bucket: str = "minute_idx") -> DataFrame:
    """Bars that do not depend on the order of rows.

    Trades (``by``, ts, price, size, side). First and last go by (ts, price): at equal time the
    lowest price is first, the highest last. Sizes are summed as exact decimals; a size that is
    missing counts the trade but adds nothing (``n_size_unparsed``). Sides other than buy and sell
    are in the total only. One exchange of partial bars.
    """
    at = F.struct("ts", "price")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, exact("size"))), F.lit(0)).cast("double")
    return trades.groupBy(*by, F.floor(F.col("ts") / step_ms).alias(bucket)).agg(
        F.min_by("price", at).alias("px_first"),
        F.max_by("price", at).alias("px_last"),
        F.max("price").alias("px_high"),
        F.min("price").alias("px_low"),
        total(F.col("side") == "buy").alias("vol_buy"),
        total(F.col("side") == "sell").alias("vol_sell"),
        total(F.lit(True)).alias("vol_total"),
        F.count(F.lit(1)).alias("n_trades"),
        F.count_if(F.col("side") == "buy").alias("n_buy"),
        F.count_if(F.col("side") == "sell").alias("n_sell"),
        F.count_if(F.col("size").isNull()).alias("n_size_unparsed"),
    )


def last_per_bucket(rows: DataFrame, by: list[str], value: str, step_ms: int, tie: str) -> DataFrame:
    """Last non-null value of each bucket, how many rows it had and how many of them a value."""
    order = F.when(F.col(value).isNotNull(), F.struct("ts", tie))
    return rows.groupBy(*by, F.floor(F.col("ts") / step_ms).alias("bucket")).agg(
        F.max_by(value, order).alias("last"), F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("n_values")
    )


def signed_flow(trades: DataFrame, by: list[str], step_ms: int, strict: bool) -> DataFrame:
    """Bought minus sold size per bucket. ``strict`` drops other sides, else they count as sold."""
    rows = trades.where(F.col("side").isin("buy", "sell")) if strict else trades
    signed = F.when(F.col("side") == "buy", exact("size")).otherwise(-exact("size"))
    return rows.groupBy(*by, F.floor(F.col("ts") / step_ms).alias("bucket")).agg(
        F.coalesce(F.sum(signed), F.lit(0)).cast("double").alias("flow"), F.count(F.lit(1)).alias("n")
    )


def on_grid(buckets: DataFrame, by: list[str], bucket: str, fill: dict[str, object]) -> DataFrame:
    """Every bucket from the first to the last of each group; missing ones take ``fill`` (None for null)."""
    span = buckets.groupBy(*by).agg(F.min(bucket).alias("_a"), F.max(bucket).alias("_b"))
    grid = span.select(*by, F.explode(F.sequence("_a", "_b")).alias(bucket))
    joined = grid.join(buckets, [*by, bucket], "left")
    return joined.select(*by, bucket, *[(F.coalesce(F.col(c), F.lit(v)) if v is not None else F.col(c)).alias(c) for c, v in fill.items()])


def parent_orders(trades: DataFrame, by: list[str]) -> DataFrame:
    """Fills of one time and side as one order: notional and number of fills."""
    return trades.groupBy(*by, "ts", "side").agg(
        F.sum((F.col("price") * F.col("size")).cast("decimal(38,8)")).cast("double").alias("notional"), F.count(F.lit(1)).alias("fills")
    )


def log_returns(bars: DataFrame, by: list[str], order: str, price: str, consecutive_only: bool = False) -> DataFrame:
    """``ret``: log price minus that of the bar before; null for the first, and after a gap if ``consecutive_only``."""
    w = Window.partitionBy(*by).orderBy(order)
    step = F.ln(F.col(price)) - F.ln(F.lag(price).over(w))
    if consecutive_only:
        step = F.when(F.col(order) - F.lag(order).over(w) == 1, step)
    return bars.withColumn("ret", step)


def realised(returns: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """Realised variance measures per group: sum of squares, its root and log, bipower variation; null under ``least`` returns."""
    n = F.count("ret")
    ok = lambda c: F.when(n >= least, c)
    square = F.sum(F.col("ret") * F.col("ret"))
    return returns.groupBy(*by).agg(
        n.alias("n_ret"),
        ok(square).alias("rv"),
        ok(F.sqrt(square)).alias("rvol"),
        ok(F.ln(F.nullif(square, F.lit(0.0)))).alias("log_rv"),
    )


def filled_forward(rows: DataFrame, by: list[str], order: str, value: str, most: int | None = None) -> DataFrame:
    """``filled``: the last value at or before each row, at most ``most`` rows old; null before the first."""
    w = Window.partitionBy(*by).orderBy(order)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(value, ignorenulls=True).over(back)
    if most is None:
        return rows.withColumn("filled", last)
    numbered = rows.withColumn("_i", F.row_number().over(w))
    seen = F.last(F.when(F.col(value).isNotNull(), F.col("_i")), ignorenulls=True).over(back)
    return numbered.withColumn("filled", F.when(F.col("_i") - seen <= most, last)).drop("_i")
