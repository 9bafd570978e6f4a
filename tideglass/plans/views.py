"""Cleaned views of the market tables that queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.functions.events import DAY_MS, timed_records
from tideglass.sources.tables import table


def fills(spark: SparkSession, folder: str) -> DataFrame:
    """Each plausible trade once: trade_id, ts, symbol, price, size, side (buy, sell or null), day.

    Deliveries meet by the hash of the whole record, so a symbol that holds most rows of a day is
    spread evenly; what aggregates by symbol and time after that combines before its own exchange.
    """
    side = F.lower("side")
    return (
        table(spark, folder, "trades")
        .where("symbol <> '' AND price > 0 AND NOT isnan(price)")
        .select("trade_id", "ts", "symbol", "price", F.col("volume").alias("size"), F.when(side.isin("buy", "sell"), side).alias("side"), F.floor(F.col("ts") / DAY_MS).alias("day"))
        .distinct()
    )


FILLS = """(SELECT DISTINCT trade_id, ts, symbol, price, volume AS size, CASE WHEN lower(side) IN ('buy', 'sell') THEN lower(side) END AS side
  FROM trades WHERE symbol <> '' AND price > 0 AND NOT isnan(price))"""


def quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Each timed ticker record once: tick_id, ts, symbol, prices, top of book, funding, open interest, day.

    ``ts`` is the event time: of a record whose own is 0, the receive time of its first delivery.
    """
    columns = ["tick_id", "symbol", "last_price", "mark_price", "index_price", "funding_rate", "open_interest", "bid1_price", "bid1_size", "ask1_price", "ask1_size"]
    timed = timed_records(table(spark, folder, "tickers"), "tick_id", columns).withColumnRenamed("event_ms", "ts")
    return timed.withColumn("day", F.floor(F.col("ts") / DAY_MS)).distinct()


QUOTES = """(SELECT DISTINCT tick_id, symbol, last_price, mark_price, index_price, funding_rate, open_interest, bid1_price, bid1_size, ask1_price, ask1_size,
  CASE WHEN ts <> 0 THEN ts ELSE CAST(floor(first_recv * 1000) AS BIGINT) END AS ts
  FROM (SELECT *, min(recv_ts) OVER (PARTITION BY tick_id) AS first_recv FROM tickers) t WHERE ts <> 0 OR (ts = 0 AND first_recv IS NOT NULL))"""


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """Daily panel of the orders: symbol (customer nation), day_no, close, turnover."""
    o = table(spark, folder, "orders").join(table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return o.groupBy(F.col("c_nationkey").alias("symbol"), F.unix_date(F.to_date("o_orderdate")).alias("day_no")).agg(
        F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("close"), F.round(F.sum("o_totalprice"), 2).alias("turnover")
    )


DAILY = """(SELECT c_nationkey AS symbol, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day_no,
  arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, round(sum(o_totalprice), 2) AS turnover
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def weekly(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly panel: symbol, week_idx (Monday weeks), close (last day's), turnover, days."""
    return (
        daily(spark, folder)
        .withColumn("week_idx", F.floor((F.col("day_no") + 3) / 7))
        .groupBy("symbol", "week_idx")
        .agg(F.max_by("close", "day_no").alias("close"), F.round(F.sum("turnover"), 2).alias("turnover"), F.count(F.lit(1)).alias("days"))
    )


WEEKLY = f"""(SELECT symbol, CAST(floor((day_no + 3) / 7.0) AS BIGINT) AS week_idx, arg_max(close, day_no) AS close, round(sum(turnover), 2) AS turnover, count(*) AS days
  FROM {DAILY} d GROUP BY 1, 2)"""


def weekly_returns(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly log returns over consecutive weeks only, and the return of the week after."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("week_idx")
    after = lambda c, k: F.when(F.lead("week_idx", k).over(w) == F.col("week_idx") + k, F.lead(c, k).over(w))
    r = weekly(spark, folder).withColumn("ret", F.when(F.col("week_idx") - F.lag("week_idx").over(w) == 1, F.ln("close") - F.ln(F.lag("close").over(w))))
    return r.withColumn("next_ret", after("ret", 1))


RETURNS = f"""(SELECT *, CASE WHEN lead(week_idx) OVER w = week_idx + 1 THEN lead(ret) OVER w END AS next_ret FROM (
  SELECT *, CASE WHEN week_idx - lag(week_idx) OVER w = 1 THEN ln(close) - ln(lag(close) OVER w) END AS ret FROM {WEEKLY} k WINDOW w AS (PARTITION BY symbol ORDER BY week_idx)) r
  WINDOW w AS (PARTITION BY symbol ORDER BY week_idx))"""
