"""Queries on trades, tickers and books: bars, flows, alignment, order book measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.functions.events import timed_records
from tideglass.operators import align, bars
from tideglass.operators.blocks import with_last_known, with_previous, with_trailing
from tideglass.plans.registry import query
from tideglass.plans.views import FILLS, QUOTES, fills, quotes
from tideglass.sources.tables import table

D38 = "CAST(size AS DECIMAL(38,12))"
_BARS = f"""SELECT symbol, CAST(ts // {{step}} AS BIGINT) AS minute_idx, arg_min(price, (ts, price)) AS px_first, arg_max(price, (ts, price)) AS px_last, max(price) AS px_high, min(price) AS px_low,
  CAST(coalesce(sum({D38}) FILTER (side = 'buy'), 0) AS DOUBLE) AS vol_buy, CAST(coalesce(sum({D38}) FILTER (side = 'sell'), 0) AS DOUBLE) AS vol_sell,
  CAST(coalesce(sum({D38}), 0) AS DOUBLE) AS vol_total, count(*) AS n_trades, count(*) FILTER (side = 'buy') AS n_buy, count(*) FILTER (side = 'sell') AS n_sell,
  count(*) FILTER (size IS NULL) AS n_size_unparsed FROM {FILLS} f GROUP BY 1, 2"""


@query(_BARS.format(step=60000))
def ohlcv_1min(spark: SparkSession, folder: str) -> DataFrame:
    return bars.ohlcv(fills(spark, folder), ["symbol", "day"]).drop("day")


@query(_BARS.format(step=3600000).replace("minute_idx", "hour_idx"))
def ohlcv_1h(spark: SparkSession, folder: str) -> DataFrame:
    return bars.ohlcv(fills(spark, folder), ["symbol", "day"], 3_600_000, "hour_idx").drop("day")


@query(f"""SELECT symbol, CAST(ts // 60000 AS BIGINT) AS bucket, arg_max(last_price, (ts, tick_id)) FILTER (last_price IS NOT NULL) AS last, count(*) AS n_rows, count(last_price) AS n_values FROM {QUOTES} q GROUP BY 1, 2""")
def last_price_per_minute(spark: SparkSession, folder: str) -> DataFrame:
    return bars.last_per_bucket(quotes(spark, folder), ["symbol", "day"], "last_price", 60_000, "tick_id").drop("day")


@query(f"""SELECT symbol, CAST(ts // 1000 AS BIGINT) AS bucket, CAST(coalesce(sum(CASE WHEN side = 'buy' THEN {D38} ELSE -{D38} END), 0) AS DOUBLE) AS flow, count(*) AS n FROM {FILLS} f WHERE side IS NOT NULL GROUP BY 1, 2""")
def signed_flow_1s(spark: SparkSession, folder: str) -> DataFrame:
    return bars.signed_flow(fills(spark, folder), ["symbol", "day"], 1000, strict=True).drop("day")


@query(
    f"""WITH b AS (SELECT symbol, CAST(ts // 300000 AS BIGINT) AS bucket, CAST(coalesce(sum(CASE WHEN side = 'buy' THEN {D38} ELSE -{D38} END), 0) AS DOUBLE) AS flow, count(*) AS n FROM {FILLS} f GROUP BY 1, 2),
  g AS (SELECT symbol, unnest(generate_series(min(bucket), max(bucket))) AS bucket FROM b GROUP BY symbol)
  SELECT g.symbol, g.bucket, coalesce(flow, 0.0) AS flow, coalesce(n, 0) AS n FROM g LEFT JOIN b ON g.symbol = b.symbol AND g.bucket = b.bucket"""
)
def ofi_bins_5min(spark: SparkSession, folder: str) -> DataFrame:
    return bars.on_grid(bars.signed_flow(fills(spark, folder), ["symbol", "day"], 300_000, strict=False).drop("day"), ["symbol"], "bucket", {"flow": 0.0, "n": 0})


@query(f"""SELECT symbol, ts, side, CAST(sum(CAST(price * size AS DECIMAL(38,8))) AS DOUBLE) AS notional, count(*) AS fills FROM {FILLS} f GROUP BY symbol, ts, side""")
def parent_orders(spark: SparkSession, folder: str) -> DataFrame:
    return bars.parent_orders(fills(spark, folder), ["symbol", "day"]).drop("day")


_MINUTE = f"(SELECT symbol, CAST(ts // 86400000 AS BIGINT) AS day, CAST(ts // 60000 AS BIGINT) AS m, arg_max(price, (ts, price)) AS px FROM {FILLS} f GROUP BY 1, 2, 3)"
_MRET = f"(SELECT symbol, day, m, ln(px) - ln(lag(px) OVER (PARTITION BY symbol, day ORDER BY m)) AS ret FROM {_MINUTE} a)"


def _minute_returns(spark: SparkSession, folder: str) -> DataFrame:
    m = fills(spark, folder).groupBy("symbol", "day", F.floor(F.col("ts") / 60_000).alias("m")).agg(F.max_by("price", F.struct("ts", "price")).alias("px"))
    return bars.log_returns(m, ["symbol", "day"], "m", "px")


@query(
    f"""SELECT symbol, day, count(ret) AS n_ret, round(CASE WHEN count(ret) >= 5 THEN sum(ret * ret) END, 12) AS rv, round(CASE WHEN count(ret) >= 5 THEN sqrt(sum(ret * ret)) END, 9) AS rvol,
  round(CASE WHEN count(ret) >= 5 THEN ln(nullif(sum(ret * ret), 0)) END, 8) AS log_rv FROM {_MRET} r GROUP BY symbol, day"""
)
def daily_realised_variance(spark: SparkSession, folder: str) -> DataFrame:
    out = bars.realised(_minute_returns(spark, folder), ["symbol", "day"], least=5)
    return out.select("symbol", "day", "n_ret", F.round("rv", 12).alias("rv"), F.round("rvol", 9).alias("rvol"), F.round("log_rv", 8).alias("log_rv"))


@query(
    f"""SELECT symbol, day, round(sum(abs(ret) * before) * (pi() / 2), 12) AS bipower, round(greatest(sum(ret * ret) - sum(abs(ret) * before) * (pi() / 2), 0), 12) AS jump
  FROM (SELECT *, abs(lag(ret) OVER (PARTITION BY symbol, day ORDER BY m)) AS before FROM {_MRET} r) x GROUP BY symbol, day HAVING count(before) > 0"""
)
def bipower_jump(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("symbol", "day").orderBy("m")
    r = _minute_returns(spark, folder).withColumn("before", F.abs(F.lag("ret").over(w)))
    bv = F.sum(F.abs("ret") * F.col("before")) * (F.pi() / 2)
    out = r.groupBy("symbol", "day").agg(bv.alias("bv"), F.sum(F.col("ret") * F.col("ret")).alias("rv"), F.count("before").alias("n")).where("n > 0")
    return out.select("symbol", "day", F.round("bv", 12).alias("bipower"), F.round(F.greatest(F.col("rv") - F.col("bv"), F.lit(0.0)), 12).alias("jump"))


@query(
    f"""WITH b AS (SELECT symbol, CAST(ts // 300000 AS BIGINT) AS bucket, arg_max(price, (ts, price)) AS px FROM {FILLS} f GROUP BY 1, 2),
  g AS (SELECT symbol, unnest(generate_series(min(bucket), max(bucket))) AS bucket FROM b GROUP BY symbol),
  j AS (SELECT g.symbol, g.bucket, px, row_number() OVER (PARTITION BY g.symbol ORDER BY g.bucket) AS i FROM g LEFT JOIN b ON g.symbol = b.symbol AND g.bucket = b.bucket),
  k AS (SELECT *, last_value(px IGNORE NULLS) OVER w AS last, last_value(CASE WHEN px IS NOT NULL THEN i END IGNORE NULLS) OVER w AS seen FROM j WINDOW w AS (PARTITION BY symbol ORDER BY bucket ROWS UNBOUNDED PRECEDING))
  SELECT symbol, bucket, px, CASE WHEN i - seen <= 3 THEN last END AS filled FROM k"""
)
def ffill_capped(spark: SparkSession, folder: str) -> DataFrame:
    b = fills(spark, folder).groupBy("symbol", "day", F.floor(F.col("ts") / 300_000).alias("bucket")).agg(F.max_by("price", F.struct("ts", "price")).alias("px"))
    return bars.filled_forward(bars.on_grid(b, ["symbol"], "bucket", {"px": None}), ["symbol"], "bucket", "px", most=3)


_ASOF_Q = f"(SELECT trade_id, symbol, ts FROM {FILLS} f)"
_ASOF_R = f"(SELECT symbol, ts AS value_ts, mark_price AS value FROM {QUOTES} q WHERE mark_price IS NOT NULL)"


def _asof(spark: SparkSession, folder: str, **how) -> DataFrame:
    return align.asof(fills(spark, folder).select("trade_id", "symbol", "ts"), quotes(spark, folder), ["symbol"], "mark_price", tie="tick_id", **how).select("trade_id", "value", "value_ts")


@query(f"SELECT trade_id, value, value_ts FROM {_ASOF_Q} q ASOF LEFT JOIN {_ASOF_R} r ON q.symbol = r.symbol AND q.ts >= r.value_ts")
def asof_backward(spark: SparkSession, folder: str) -> DataFrame:
    return _asof(spark, folder, direction="backward")


@query(f"SELECT trade_id, value, value_ts FROM {_ASOF_Q} q ASOF LEFT JOIN {_ASOF_R} r ON q.symbol = r.symbol AND q.ts <= r.value_ts")
def asof_forward(spark: SparkSession, folder: str) -> DataFrame:
    return _asof(spark, folder, direction="forward")


@query(
    f"""SELECT trade_id, CASE WHEN ts - value_ts <= 60000 THEN value END AS value, CASE WHEN ts - value_ts <= 60000 THEN value_ts END AS value_ts
  FROM {_ASOF_Q} q ASOF LEFT JOIN {_ASOF_R} r ON q.symbol = r.symbol AND q.ts >= r.value_ts"""
)
def asof_tolerance(spark: SparkSession, folder: str) -> DataFrame:
    return _asof(spark, folder, direction="backward", tolerance_ms=60_000)


@query(
    f"""SELECT ts AS event_ms, 'trade' AS kind, 0 AS kind_rank, symbol, price, size, CAST(NULL AS DOUBLE) AS mark_price FROM {FILLS} f
  UNION ALL SELECT DISTINCT ts, 'book', 1, symbol, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM orderbook_snapshots
  UNION ALL SELECT ts, 'ticker', 2, symbol, NULL, NULL, mark_price FROM {QUOTES} q
  UNION ALL SELECT CAST((ts // 3600000 + 1) * 3600000 AS BIGINT), 'bar', 3, symbol, arg_max(price, (ts, price)), CAST(sum(CAST(size AS DECIMAL(38,12))) AS DOUBLE), NULL FROM {FILLS} f GROUP BY ts // 3600000, symbol"""
)
def event_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Four tables as one stream: trades, snapshots, ticker records and closed hourly bars."""
    own = lambda df: df.withColumn("event_ms", F.col("ts"))
    f = fills(spark, folder)
    hours = f.groupBy("symbol", F.floor(F.col("ts") / 3_600_000).alias("h")).agg(F.max_by("price", F.struct("ts", "price")).alias("price"), F.sum(bars.exact("size")).cast("double").alias("size"))
    tables = {
        "trade": own(f),
        "book": own(table(spark, folder, "orderbook_snapshots").select("symbol", "ts").distinct()),
        "ticker": own(quotes(spark, folder)),
        "bar": hours.withColumn("event_ms", (F.col("h") + 1) * 3_600_000),
    }
    return align.merged_events(tables, ["symbol", "price", "size", "mark_price"], {"trade": 0, "book": 1, "ticker": 2, "bar": 3})


@query(
    f"""WITH b AS (SELECT symbol, CAST(ts // 1800000 AS BIGINT) AS bucket, arg_max(price, (ts, price)) AS px FROM {FILLS} f GROUP BY 1, 2)
  SELECT symbol, bucket, px FROM b WHERE bucket IN (SELECT bucket FROM b GROUP BY bucket HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM b))"""
)
def panel_synchronised(spark: SparkSession, folder: str) -> DataFrame:
    """All series on a shared grid, only where every one has a bar."""
    b = fills(spark, folder).groupBy("symbol", "day", F.floor(F.col("ts") / 1_800_000).alias("bucket")).agg(F.max_by("price", F.struct("ts", "price")).alias("px")).drop("day")
    return align.complete_rows(b, "bucket", "symbol", b.select("symbol").distinct().count())


_BOOK1 = """(SELECT DISTINCT row_id, symbol, ts, lower(side) AS side, level, price, size FROM orderbook_snapshots)"""


def _book(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orderbook_snapshots").groupBy("row_id", "symbol", "ts", F.lower("side").alias("side"), "level", "price", "size").agg(F.count(F.lit(1)).alias("_n")).drop("_n")


@query(
    f"""SELECT symbol, ts, list(price ORDER BY level) FILTER (side = 'bid' AND price IS NOT NULL) AS bid_prices, list(price ORDER BY level) FILTER (side = 'ask' AND price IS NOT NULL) AS ask_prices,
  count(*) AS n_levels FROM {_BOOK1} b WHERE level < 5 GROUP BY symbol, ts"""
)
def l2_snapshot_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """One row per snapshot with the prices of each side in level order, top five levels; null for a side without any."""
    pick = lambda s: F.collect_list(F.when((F.col("side") == s) & F.col("price").isNotNull(), F.struct("level", "price")))
    rows = _book(spark, folder).where("level < 5").groupBy("symbol", "ts").agg(pick("bid").alias("b"), pick("ask").alias("a"), F.count(F.lit(1)).alias("n_levels"))
    prices = lambda c: F.when(F.size(c) > 0, F.transform(F.array_sort(c), lambda x: x["price"]))
    return rows.select("symbol", "ts", prices("b").alias("bid_prices"), prices("a").alias("ask_prices"), "n_levels")


@query(
    f"""WITH s AS (SELECT symbol, ts, sum(CAST(size AS DECIMAL(38,12))) FILTER (side = 'bid') AS b, sum(CAST(size AS DECIMAL(38,12))) FILTER (side = 'ask') AS a,
    max(price) FILTER (side = 'bid' AND level = 0) AS bb, min(price) FILTER (side = 'ask' AND level = 0) AS ba FROM {_BOOK1} x WHERE level < 5 GROUP BY 1, 2)
  SELECT symbol, ts, round(CAST(b - a AS DOUBLE) / nullif(CAST(b + a AS DOUBLE), 0), 8) + 0.0 AS imbalance, round((bb + ba) / 2, 8) AS mid, round((ba - bb) / ((bb + ba) / 2) * 10000, 6) AS spread_bps FROM s WHERE b IS NOT NULL AND a IS NOT NULL"""
)
def book_imbalance(spark: SparkSession, folder: str) -> DataFrame:
    side = lambda s: F.col("side") == s
    size = F.col("size").cast("decimal(38,12)")
    s = _book(spark, folder).where("level < 5").groupBy("symbol", "ts").agg(
        F.sum(F.when(side("bid"), size)).alias("b"), F.sum(F.when(side("ask"), size)).alias("a"),
        F.max(F.when(side("bid") & (F.col("level") == 0), F.col("price"))).alias("bb"), F.min(F.when(side("ask") & (F.col("level") == 0), F.col("price"))).alias("ba"),
    ).where("b IS NOT NULL AND a IS NOT NULL")
    mid = (F.col("bb") + F.col("ba")) / 2
    return s.select(
        "symbol", "ts", (F.round((F.col("b") - F.col("a")).cast("double") / F.nullif((F.col("b") + F.col("a")).cast("double"), F.lit(0.0)), 8) + 0.0).alias("imbalance"),
        F.round(mid, 8).alias("mid"), F.round((F.col("ba") - F.col("bb")) / mid * 10000, 6).alias("spread_bps"),
    )


@query(
    f"""WITH s AS (SELECT symbol, ts, side, size, sum(size) OVER (PARTITION BY symbol, ts, side) AS total FROM {_BOOK1} b WHERE size > 0)
  SELECT symbol, ts, round(avg(h), 6) AS entropy FROM (SELECT symbol, ts, side, -sum(size / total * log2(size / total + 1e-12)) AS h FROM s GROUP BY 1, 2, 3) x GROUP BY 1, 2"""
)
def book_entropy(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("symbol", "ts", "side")
    p = F.col("size") / F.sum("size").over(w)
    s = _book(spark, folder).where("size > 0").withColumn("p", p)
    h = s.groupBy("symbol", "ts", "side").agg((-F.sum(F.col("p") * F.log2(F.col("p") + 1e-12))).alias("h"))
    return h.groupBy("symbol", "ts").agg(F.round(F.avg("h"), 6).alias("entropy"))


_CKS = f"""(SELECT symbol, ts, tick_id,
  CASE WHEN lag(ts) OVER w IS NULL THEN 0.0 ELSE (CASE WHEN bid1_price >= lag(bid1_price) OVER w THEN bid1_size ELSE 0 END) - (CASE WHEN bid1_price <= lag(bid1_price) OVER w THEN lag(bid1_size) OVER w ELSE 0 END)
  - (CASE WHEN ask1_price <= lag(ask1_price) OVER w THEN ask1_size ELSE 0 END) + (CASE WHEN ask1_price >= lag(ask1_price) OVER w THEN lag(ask1_size) OVER w ELSE 0 END) END AS e
  FROM {QUOTES} q WHERE bid1_price IS NOT NULL AND ask1_price IS NOT NULL AND bid1_size IS NOT NULL AND ask1_size IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY ts, tick_id))"""


@query(f"SELECT tick_id, round(e, 6) + 0.0 AS e, round(sum(e) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW), 5) + 0.0 AS ofi_60s FROM {_CKS} c")
def ofi_cks(spark: SparkSession, folder: str) -> DataFrame:
    """Order flow imbalance from moves of the best quotes, and its sum over the last minute."""
    q = quotes(spark, folder).where("bid1_price IS NOT NULL AND ask1_price IS NOT NULL AND bid1_size IS NOT NULL AND ask1_size IS NOT NULL")
    q = with_previous(q, ["symbol"], ["ts", "tick_id"], ["ts", "bid1_price", "bid1_size", "ask1_price", "ask1_size"])
    was = lambda c: F.col(f"prev.{c}")
    bid = F.when(F.col("bid1_price") >= was("bid1_price"), F.col("bid1_size")).otherwise(0.0) - F.when(F.col("bid1_price") <= was("bid1_price"), was("bid1_size")).otherwise(0.0)
    ask = F.when(F.col("ask1_price") <= was("ask1_price"), F.col("ask1_size")).otherwise(0.0) - F.when(F.col("ask1_price") >= was("ask1_price"), was("ask1_size")).otherwise(0.0)
    e = q.select("symbol", "ts", "tick_id", F.when(was("ts").isNull(), 0.0).otherwise(bid - ask).alias("e"))
    t = with_trailing(e, ["symbol"], "ts", 60_000, 0, {"s": F.sum("e")})
    return t.select("tick_id", (F.round("e", 6) + 0.0).alias("e"), (F.round("s", 5) + 0.0).alias("ofi_60s"))


@query(
    f"""WITH d AS (SELECT *, sign(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, trade_id)) AS s FROM {FILLS} f)
  SELECT trade_id, CAST(coalesce(last_value(nullif(s, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING), 0) AS INTEGER) AS tick FROM d"""
)
def tick_rule(spark: SparkSession, folder: str) -> DataFrame:
    """Sign of the last non-zero price move of the symbol; 0 before the first."""
    d = with_previous(fills(spark, folder), ["symbol"], ["ts", "trade_id"], ["price"]).withColumn("s", F.nullif(F.signum(F.col("price") - F.col("prev.price")), F.lit(0.0)))
    return with_last_known(d, ["symbol"], ["ts", "trade_id"], "s", "known").select("trade_id", F.coalesce("known", F.lit(0.0)).cast("int").alias("tick"))


@query(f"""SELECT symbol, round(sum(dp * sv) / nullif(sum(sv * sv), 0), 12) AS kyle_lambda, count(dp) AS n FROM (
  SELECT symbol, price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS dp, CASE WHEN side = 'buy' THEN size WHEN side = 'sell' THEN -size END AS sv FROM {FILLS} f) x WHERE dp IS NOT NULL AND sv IS NOT NULL GROUP BY symbol""")
def kyle_lambda(spark: SparkSession, folder: str) -> DataFrame:
    f = with_previous(fills(spark, folder), ["symbol"], ["ts", "trade_id"], ["price"])
    r = f.select("symbol", (F.col("price") - F.col("prev.price")).alias("dp"), F.when(F.col("side") == "buy", F.col("size")).when(F.col("side") == "sell", -F.col("size")).alias("sv"))
    return r.where("dp IS NOT NULL AND sv IS NOT NULL").groupBy("symbol").agg(
        F.round(F.sum(F.col("dp") * F.col("sv")) / F.nullif(F.sum(F.col("sv") * F.col("sv")), F.lit(0.0)), 12).alias("kyle_lambda"), F.count("dp").alias("n")
    )


@query(f"""SELECT symbol, CAST(ts // 86400000 AS BIGINT) AS day, arg_max(mark_price, (ts, tick_id)) FILTER (mark_price IS NOT NULL) AS mark, arg_max(index_price, (ts, tick_id)) FILTER (index_price IS NOT NULL) AS index,
  round(arg_max(mark_price, (ts, tick_id)) FILTER (mark_price IS NOT NULL) / nullif(arg_max(index_price, (ts, tick_id)) FILTER (index_price IS NOT NULL), 0) - 1, 10) AS basis FROM {QUOTES} q GROUP BY 1, 2""")
def daily_basis(spark: SparkSession, folder: str) -> DataFrame:
    """Last known mark and index price per day, each by itself, and their ratio."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "tick_id")))
    q = quotes(spark, folder).groupBy("symbol", "day").agg(last("mark_price").alias("mark"), last("index_price").alias("index"))
    return q.withColumn("basis", F.round(F.col("mark") / F.nullif(F.col("index"), F.lit(0.0)) - 1, 10))


@query(f"""SELECT symbol, CAST(ts // 86400000 AS BIGINT) AS day, round(avg(funding_rate) + 1e-13, 10) AS mean_rate, count(funding_rate) AS n, arg_max(open_interest, (ts, tick_id)) FILTER (open_interest IS NOT NULL) AS oi_close FROM {QUOTES} q GROUP BY 1, 2""")
def daily_funding_and_oi(spark: SparkSession, folder: str) -> DataFrame:
    """Mean rate and last open interest per day; means that fall between two roundings go up, whatever the order of rows."""
    return quotes(spark, folder).groupBy("symbol", "day").agg(
        F.round(F.sum(F.col("funding_rate").cast("decimal(38,18)")).cast("double") / F.count("funding_rate") + 1e-13, 10).alias("mean_rate"), F.count("funding_rate").alias("n"), F.max_by("open_interest", F.when(F.col("open_interest").isNotNull(), F.struct("ts", "tick_id"))).alias("oi_close")
    )


@query(f"""SELECT symbol, count(*) FILTER (seq <= before) AS breaks, count(*) AS n FROM (SELECT symbol, tick_id AS seq, lag(tick_id) OVER (PARTITION BY symbol ORDER BY ts, tick_id) AS before FROM {QUOTES} q) x GROUP BY symbol""")
def sequence_breaks(spark: SparkSession, folder: str) -> DataFrame:
    q = with_previous(quotes(spark, folder), ["symbol"], ["ts", "tick_id"], ["tick_id"])
    return q.groupBy("symbol").agg(F.count_if(F.col("tick_id") <= F.col("prev.tick_id")).alias("breaks"), F.count(F.lit(1)).alias("n"))


@query("""SELECT symbol, lower(side) AS side, count(*) AS n, min(level) AS least, CAST(quantile_cont(level, 0.5) AS DOUBLE) AS median, max(level) AS most, count(price) AS priced FROM orderbook_snapshots GROUP BY 1, 2""")
def l2_census(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orderbook_snapshots").groupBy("symbol", F.lower("side").alias("side")).agg(
        F.count(F.lit(1)).alias("n"), F.min("level").alias("least"), F.percentile("level", 0.5).alias("median"), F.max("level").alias("most"), F.count("price").alias("priced")
    )


@query(f"""SELECT 'trades' AS table_name, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM trades
  UNION ALL SELECT 'tickers', (SELECT count(*) FROM tickers), min(ts), max(ts) FROM {QUOTES} q
  UNION ALL SELECT 'orderbook_snapshots', count(*), min(ts), max(ts) FROM orderbook_snapshots""")
def coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each table and the range of event times (of tickers without an own time, the first receive time)."""
    rows = lambda name: table(spark, folder, name).select("ts", F.lit(1).alias("_n"))
    ticks = table(spark, folder, "tickers")
    times = timed_records(ticks, "tick_id", ["tick_id"]).select(F.col("event_ms").alias("ts"), F.lit(0).alias("_n"))
    parts = {"trades": rows("trades"), "tickers": ticks.select(F.lit(None).cast("long").alias("ts"), F.lit(1).alias("_n")).unionByName(times), "orderbook_snapshots": rows("orderbook_snapshots")}
    out = [p.agg(F.sum("_n").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select(F.lit(k).alias("table_name"), "n", "first_ts", "last_ts") for k, p in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""SELECT symbol, ts - before AS gap_ms, count(*) AS n FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS before FROM {FILLS} f) x WHERE ts > before GROUP BY 1, 2""")
def inter_arrival(spark: SparkSession, folder: str) -> DataFrame:
    f = with_previous(fills(spark, folder), ["symbol"], ["ts", "trade_id"], ["ts"])
    return f.withColumn("gap_ms", F.col("ts") - F.col("prev.ts")).where("gap_ms > 0").groupBy("symbol", "gap_ms").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH d AS (SELECT symbol, CAST(ts // 86400000 AS BIGINT) AS day, *, row_number() OVER (PARTITION BY symbol, ts // 86400000 ORDER BY ts, trade_id) AS rn FROM {FILLS} f) SELECT trade_id FROM d WHERE rn <= 100""")
def row_cap_per_day(spark: SparkSession, folder: str) -> DataFrame:
    """The first hundred trades of each symbol and day (the cap is the operator)."""
    w = Window.partitionBy("symbol", "day").orderBy("ts", "trade_id")
    return fills(spark, folder).withColumn("rn", F.row_number().over(w)).where("rn <= 100").select("trade_id")


@query(f"""SELECT symbol, CAST(ts // 300000 AS BIGINT) AS bucket, count(*) AS n, list_resize(list(price ORDER BY ts, trade_id)[1:16], 16) AS prices FROM {FILLS} f GROUP BY 1, 2 HAVING count(*) >= 4""")
def event_windows_5min(spark: SparkSession, folder: str) -> DataFrame:
    """First sixteen prices of each five minutes with at least four trades, padded with nulls (sequence length is the operator's parameter)."""
    w = Window.partitionBy("symbol", "bucket")
    numbered = fills(spark, folder).withColumn("bucket", F.floor(F.col("ts") / 300_000)).withColumn("rn", F.row_number().over(w.orderBy("ts", "trade_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    g = numbered.where("n >= 4 AND rn <= 16").groupBy("symbol", "bucket", "n").agg(F.sort_array(F.collect_list(F.struct("rn", "price"))).alias("s"))
    padding = F.array_repeat(F.lit(None).cast("double"), 16 - F.size("s"))
    return g.select("symbol", "bucket", "n", F.concat(F.transform("s", lambda x: x["price"]), padding).alias("prices"))


@query(f"""WITH m AS (SELECT symbol, CAST(ts // 3600000 AS BIGINT) AS hour, CAST(ts // 60000 AS BIGINT) AS m, arg_max(price, (ts, price)) AS px, sum(CAST(size AS DECIMAL(38,12))) AS v, count(*) AS n FROM {FILLS} f GROUP BY 1, 2, 3),
  r AS (SELECT *, CASE WHEN m - lag(m) OVER w = 1 THEN ln(px) - ln(lag(px) OVER w) END AS r FROM m WINDOW w AS (PARTITION BY symbol, hour ORDER BY m))
  SELECT symbol, hour, round(ln(1 + CAST(sum(v) AS DOUBLE)), 8) AS log_volume, round(ln(1 + sum(n)), 8) AS log_trades, round(sqrt(sum(r * r)), 9) AS rv, arg_max(px, m) AS close, count(*) >= 45 AS whole FROM r GROUP BY 1, 2""")
def bucket_state(spark: SparkSession, folder: str) -> DataFrame:
    """Volume, trades, realised volatility over consecutive minutes and close of each hour, and whether 45 of its minutes traded."""
    m = fills(spark, folder).groupBy("symbol", F.floor(F.col("ts") / 3_600_000).alias("hour"), F.floor(F.col("ts") / 60_000).alias("m")).agg(
        F.max_by("price", F.struct("ts", "price")).alias("px"), F.sum(bars.exact("size")).alias("v"), F.count(F.lit(1)).alias("n"))
    r = bars.log_returns(m, ["symbol", "hour"], "m", "px", consecutive_only=True)
    return r.groupBy("symbol", "hour").agg(
        F.round(F.ln(1 + F.sum("v").cast("double")), 8).alias("log_volume"), F.round(F.ln(1 + F.sum("n")), 8).alias("log_trades"), F.round(F.sqrt(F.sum(F.col("ret") * F.col("ret"))), 9).alias("rv"),
        F.max_by("px", "m").alias("close"), (F.count(F.lit(1)) >= 45).alias("whole"),
    )


@query(f"""SELECT symbol, CAST(ts // 60000 AS BIGINT) AS m, round(count(*) / 60.0, 8) AS rate_per_s, max(size) AS largest FROM {FILLS} f GROUP BY 1, 2""")
def event_rate(spark: SparkSession, folder: str) -> DataFrame:
    return fills(spark, folder).groupBy("symbol", "day", F.floor(F.col("ts") / 60_000).alias("m")).agg(F.round(F.count(F.lit(1)) / 60.0, 8).alias("rate_per_s"), F.max("size").alias("largest")).drop("day")


@query(f"""SELECT tick_id, CAST(28800 - (ts // 1000) % 28800 AS BIGINT) AS seconds_to_settlement FROM {QUOTES} q""")
def seconds_to_settlement(spark: SparkSession, folder: str) -> DataFrame:
    return quotes(spark, folder).select("tick_id", (F.lit(28_800) - F.pmod(F.floor(F.col("ts") / 1000), F.lit(28_800))).cast("long").alias("seconds_to_settlement"))


@query(f"""SELECT tick_id, round((mark_price - index_price) / index_price - least(greatest((mark_price - index_price) / index_price, -0.0005), 0.0005), 10) AS pressure, round((mark_price - index_price) / index_price, 10) AS basis FROM {QUOTES} q WHERE mark_price > 0 AND index_price > 0""")
def funding_pressure(spark: SparkSession, folder: str) -> DataFrame:
    b = (F.col("mark_price") - F.col("index_price")) / F.col("index_price")
    return quotes(spark, folder).where("mark_price > 0 AND index_price > 0").select("tick_id", F.round(b - F.least(F.greatest(b, F.lit(-0.0005)), F.lit(0.0005)), 10).alias("pressure"), F.round(b, 10).alias("basis"))
