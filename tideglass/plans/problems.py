"""Queries on the market tables: snapshot changes, regular grids, late events, spikes, heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.functions.events import DAY_MS, HOUR_MS, floor_to, steps, timed_records
from tideglass.operators.grid_smoother import regular_grid
from tideglass.operators.late_events import PeriodStore
from tideglass.operators.salted import two_stage
from tideglass.operators.snapshot_diff import snapshot_changes
from tideglass.operators.spikes import Field, implausible_readings
from tideglass.sources.tables import table

TICKER_FIELDS = [
    Field("last_price", positive=True, runs=True, spikes="both", margin=5.0),
    Field("funding_rate", positive=False, runs=False, spikes="both", margin=5.0, bound=1.0),
    Field("open_interest", positive=True, runs=True, spikes="both", margin=5.0),
]
BOOK_FIELDS = [Field("size", positive=True, runs=False, spikes="high", margin=1.0)]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Book records added, removed or changed from each snapshot of a symbol to its next on the same UTC day."""
    sizes = table(spark, folder, "instruments").select("symbol", "book_step", "qty_step")
    rows = (
        table(spark, folder, "orderbook_snapshots")
        .join(sizes, "symbol")
        .select(
            "row_id",
            "symbol",
            "ts",
            F.lower("side").alias("side"),
            steps(F.col("price"), F.col("book_step")).alias("price_ticks"),
            steps(F.col("size"), F.col("qty_step")).alias("size_steps"),
        )
    )
    ts, priced = F.col("ts"), F.col("price_ticks").isNotNull()
    return snapshot_changes(rows, ["symbol"], "ts", floor_to(ts, DAY_MS), ["side", "price_ticks"], ["size_steps"], priced, ["row_id"], floor_to(ts, HOUR_MS))


def p1_changes_per_symbol(spark: SparkSession, folder: str) -> DataFrame:
    """How many records changed, per symbol and kind."""
    return p1_found(spark, folder).groupBy("symbol", "change_kind").agg(F.count(F.lit(1)).alias("n"))


def p2_grid(spark: SparkSession, folder: str) -> DataFrame:
    """mark_price per symbol on a grid of five minutes, filled, with uncertainty and missing flags."""
    return regular_grid(_mark_readings(spark, folder), "symbol", "mark_price", across=True).withColumnRenamed("value", "mark_price")


def _mark_readings(spark: SparkSession, folder: str) -> DataFrame:
    readings = table(spark, folder, "tickers").where("mark_price > 0 AND NOT isnan(mark_price)")
    return timed_records(readings, "tick_id", ["symbol", "mark_price"])


def p2_periods(spark: SparkSession, folder: str) -> DataFrame:
    """How many readings each period of p2_grid has, whether it is filled, and that what fills it has a spread."""
    return p2_grid(spark, folder).select("symbol", "period_ms", "readings", "is_missing", ((F.col("value_sd") >= 0) & (F.col("mark_price") > 0)).alias("has_value"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Periods without a mark_price reading between the first and the last of a symbol and UTC day."""
    return regular_grid(_mark_readings(spark, folder), "symbol", "mark_price").where("is_missing").select("symbol", "period_ms")


def _both_feeds(spark: SparkSession, folder: str) -> DataFrame:
    ticks = table(spark, folder, "tickers").select(
        F.lit("tickers").alias("src_table"), F.col("tick_id").alias("rec_id"), "symbol", "ts", F.col("last_price").alias("price"), F.lit(None).cast("double").alias("size"), "recv_ts"
    )
    trades = table(spark, folder, "trades").select(
        F.lit("trades").alias("src_table"), F.col("trade_id").alias("rec_id"), "symbol", "ts", "price", F.col("volume").alias("size"), "recv_ts"
    )
    return ticks.unionByName(trades)


def late_event_store(spark: SparkSession, folder: str, batches: int = 3) -> PeriodStore:
    """A store that has taken in both feeds in ``batches`` deliveries, in order of arrival."""
    store = PeriodStore(spark)
    store.ingest_all(_both_feeds(spark, folder), batches)
    return store


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that came late, and those past the cut-off."""
    return late_event_store(spark, folder).records().where("outcome IN ('late', 'too_late')").select("src_table", "rec_id", "outcome")


def p4_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Aggregates per feed, symbol and five-minute period after all corrections."""
    return late_event_store(spark, folder).aggregates()


def p5_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Implausible readings of tickers and book sizes with the reason."""
    ticks = timed_records(
        table(spark, folder, "tickers").withColumn("rec_id", F.col("tick_id")), "tick_id", ["rec_id", "symbol", "last_price", "funding_rate", "open_interest"]
    )
    book = table(spark, folder, "orderbook_snapshots").select("symbol", F.col("ts").alias("event_ms"), F.col("row_id").alias("rec_id"), "size").where("size IS NOT NULL")
    return (
        implausible_readings(ticks, "symbol", TICKER_FIELDS)
        .withColumn("src_table", F.lit("tickers"))
        .unionByName(implausible_readings(book, "symbol", BOOK_FIELDS).withColumn("src_table", F.lit("orderbook_snapshots")))
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Record and field of every implausible reading."""
    return p5_flags(spark, folder).groupBy("src_table", "rec_id", "field_name").agg(F.count(F.lit(1)).alias("_n")).drop("_n")


def p7_symbol_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Per symbol: trades (records, volume, last price) and book snapshots (count, mean size of their records)."""
    trades = two_stage(
        table(spark, folder, "trades"),
        "symbol",
        F.col("trade_id"),
        ["trade_id", "ts", "price", "volume"],
        {
            "records": F.count(F.lit(1)),
            "volume": F.sum(F.col("volume").cast("decimal(30,8)")),
            "last": F.max(F.when(F.col("price").isNotNull(), F.struct("ts", "trade_id", "price"))),
        },
        {"records": F.sum("records"), "volume": F.sum("volume").cast("double"), "last_price": F.max("last")["price"]},
    )
    books = two_stage(
        table(spark, folder, "orderbook_snapshots"),
        "symbol",
        F.col("ts"),
        ["row_id", "ts", "size"],
        {"snapshots": F.count_distinct("ts"), "total": F.sum(F.col("size").cast("decimal(30,8)")), "sizes": F.count("size")},
        {"snapshots": F.sum("snapshots"), "mean_size": F.round(F.sum("total").cast("double") / F.nullif(F.sum("sizes"), F.lit(0)), 6)},
    )
    a, b = trades.alias("a"), books.alias("b")
    return a.join(b, F.col("a.symbol").eqNullSafe(F.col("b.symbol")), "full").select(
        F.coalesce("a.symbol", "b.symbol").alias("symbol"), "records", "volume", "last_price", "snapshots", "mean_size"
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_changes_per_symbol, p2_found, p2_grid, p2_periods, p4_found, p4_periods, p5_found, p5_flags, p7_symbol_totals)}

_TICKS = """SELECT tick_id, any_value(symbol) AS symbol, any_value(mark_price) AS mark_price, any_value(last_price) AS last_price,
  min(recv_ts) AS recv_ts, CASE WHEN any_value(ts) <> 0 THEN any_value(ts) ELSE CAST(floor(min(recv_ts) * 1000) AS BIGINT) END AS event_ms
  FROM tickers GROUP BY tick_id"""
_BOOK = """SELECT DISTINCT row_id, s.symbol, ts, ts - ts % 86400000 AS day, lower(side) AS side,
  CAST(round(price / book_step) AS BIGINT) AS price_ticks, CAST(round(size / qty_step) AS BIGINT) AS q
  FROM orderbook_snapshots s JOIN instruments i ON s.symbol = i.symbol"""
_CHANGES = f"""WITH book AS ({_BOOK}),
  heads AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol, day ORDER BY ts) AS before FROM (SELECT DISTINCT symbol, day, ts FROM book) x),
  later AS (SELECT b.symbol, b.ts, side, price_ticks, q FROM book b JOIN heads h ON b.symbol = h.symbol AND b.ts = h.ts WHERE before IS NOT NULL AND price_ticks IS NOT NULL),
  earlier AS (SELECT h.symbol, h.ts, side, price_ticks, q FROM book b JOIN heads h ON b.symbol = h.symbol AND b.ts = h.before WHERE price_ticks IS NOT NULL),
  l AS (SELECT * FROM later EXCEPT ALL SELECT * FROM earlier), e AS (SELECT * FROM earlier EXCEPT ALL SELECT * FROM later)
  SELECT coalesce(l.symbol, e.symbol) AS symbol, coalesce(l.ts, e.ts) AS ts, coalesce(l.side, e.side) AS side,
    coalesce(l.price_ticks, e.price_ticks) AS price_ticks,
    CASE WHEN e.symbol IS NULL THEN 'added' WHEN l.symbol IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM l FULL JOIN e ON l.symbol = e.symbol AND l.ts = e.ts AND l.side = e.side AND l.price_ticks = e.price_ticks"""
_FEEDS = f"""SELECT 'tickers' AS src_table, tick_id AS rec_id, symbol, event_ms, last_price AS price, CAST(NULL AS DOUBLE) AS size, recv_ts FROM ({_TICKS}) t
  UNION ALL SELECT 'trades', trade_id, any_value(symbol), any_value(ts), any_value(price), any_value(volume), min(recv_ts) FROM trades GROUP BY trade_id"""
_OUTCOMES = f"""SELECT *, event_ms - event_ms % 300000 AS period_ms, recv_ts * 1000 - (event_ms - event_ms % 300000 + 300000) AS delay FROM ({_FEEDS}) f WHERE event_ms IS NOT NULL"""

ORACLE = {
    "p1_found": _CHANGES,
    "p1_changes_per_symbol": f"SELECT symbol, change_kind, count(*) AS n FROM ({_CHANGES}) c GROUP BY symbol, change_kind",
    "p2_found": f"""WITH r AS (SELECT DISTINCT symbol, event_ms - event_ms % 86400000 AS day, event_ms - event_ms % 300000 AS period_ms
      FROM ({_TICKS}) t WHERE mark_price > 0 AND event_ms IS NOT NULL),
      g AS (SELECT symbol, unnest(generate_series(min(period_ms), max(period_ms), 300000)) AS period_ms FROM r GROUP BY symbol, day)
      SELECT symbol, period_ms FROM g EXCEPT SELECT symbol, period_ms FROM r""",
    "p2_periods": f"""WITH r AS (SELECT symbol, event_ms - event_ms % 300000 AS period_ms, count(DISTINCT event_ms) AS n FROM ({_TICKS}) t WHERE mark_price > 0 AND event_ms IS NOT NULL GROUP BY 1, 2),
      g AS (SELECT symbol, unnest(generate_series(min(period_ms), max(period_ms), 300000)) AS period_ms FROM r GROUP BY symbol)
      SELECT g.symbol, g.period_ms, coalesce(n, 0) AS readings, n IS NULL AS is_missing, true AS has_value FROM g LEFT JOIN r ON g.symbol = r.symbol AND g.period_ms = r.period_ms""",
    "p4_found": f"""SELECT src_table, rec_id, CASE WHEN delay > 600000 THEN 'too_late' ELSE 'late' END AS outcome FROM ({_OUTCOMES}) o WHERE delay > 10000""",
    "p4_periods": f"""WITH o AS (SELECT *, delay IS NULL OR delay <= 600000 AS kept FROM ({_OUTCOMES}) x)
      SELECT src_table, symbol, period_ms, count(*) FILTER (kept) AS records, count(*) FILTER (kept AND delay > 10000) AS late_records,
      count(*) FILTER (NOT kept) AS too_late_records, round(sum(size) FILTER (kept), 6) AS total_size, min(price) FILTER (kept) AS low,
      max(price) FILTER (kept) AS high, arg_max(price, (event_ms, rec_id)) FILTER (kept AND price IS NOT NULL) AS last
      FROM o GROUP BY src_table, symbol, period_ms""",
    "p7_symbol_totals": """WITH t AS (SELECT trade_id, any_value(symbol) AS symbol, any_value(ts) AS ts, any_value(price) AS price, any_value(volume) AS volume FROM trades GROUP BY trade_id),
      b AS (SELECT row_id, any_value(symbol) AS symbol, any_value(ts) AS ts, any_value(size) AS size FROM orderbook_snapshots GROUP BY row_id),
      a AS (SELECT symbol, count(*) AS records, CAST(sum(CAST(volume AS DECIMAL(30,8))) AS DOUBLE) AS volume, arg_max(price, (ts, trade_id)) FILTER (price IS NOT NULL) AS last_price FROM t GROUP BY symbol),
      c AS (SELECT symbol, count(DISTINCT ts) AS snapshots, round(CAST(sum(CAST(size AS DECIMAL(30,8))) AS DOUBLE) / nullif(count(size), 0), 6) AS mean_size FROM b GROUP BY symbol)
      SELECT coalesce(a.symbol, c.symbol) AS symbol, records, volume, last_price, snapshots, mean_size FROM a FULL JOIN c ON a.symbol IS NOT DISTINCT FROM c.symbol""",
}
