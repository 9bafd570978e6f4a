"""Streams over the tables, run until their source is drained: every record passes through readStream, state and a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.functions.events import floor_to
from tideglass.operators import bars
from tideglass.plans.registry import query
from tideglass.plans.views import FILLS, QUOTES, fills, quotes
from tideglass.session import shared_folder, written
from tideglass.streaming import streams

LATENESS_MS = 10_000


def _feed(spark: SparkSession, rows: DataFrame, batches: int = 1) -> DataFrame:
    """A stream over a table written to a folder, its files taken in as ``batches`` batches; in a single one nothing is late."""
    folder = f"{shared_folder(spark)}/feed"
    files = len(written(rows, folder).inputFiles())
    reader = spark.readStream.schema(rows.schema)
    return (reader if batches == 1 else reader.option("maxFilesPerTrigger", max(1, -(-files // batches)))).parquet(folder)


def _trades(spark: SparkSession, folder: str) -> DataFrame:
    """Trades as a stream with each delivered twice; every eleventh has no key and comes once."""
    f = fills(spark, folder).select("symbol", "ts", F.when(F.col("trade_id") % 11 != 0, F.col("trade_id").cast("string")).alias("trade_key"), "price", "size", "side")
    return f.unionByName(f.where("trade_key IS NOT NULL"))


_CLOSED = f"(SELECT max(ts) - {LATENESS_MS} FROM {FILLS} z)"


@query(f"""SELECT * FROM (SELECT symbol, CAST(ts // 60000 * 60000 AS BIGINT) AS start_ms, arg_min(price, (ts, price)) AS px_first, arg_max(price, (ts, price)) AS px_last, max(price) AS px_high, min(price) AS px_low, round(CAST(sum(CAST(size AS DECIMAL(38,12))) AS DOUBLE), 6) AS vol_total, count(*) AS n_trades FROM {FILLS} f GROUP BY 1, 2) x WHERE start_ms + 60000 <= {_CLOSED}""")
def stream_minute_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Bars of the minutes the watermark has passed; repeats are dropped in state, keyless trades all count."""
    feed = _feed(spark, _trades(spark, folder)).withColumn("size", bars.exact("size"))
    out = streams.drained(streams.streaming_bars(feed, lateness=f"{LATENESS_MS} milliseconds"), shared_folder(spark))
    return out.withColumn("vol_total", F.round(F.col("vol_total").cast("double"), 6))


@query(f"""WITH b AS (SELECT symbol, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) < 30000 THEN 0 ELSE 1 END AS new FROM {FILLS} f), s AS (SELECT symbol, ts, sum(new) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b)
  SELECT * FROM (SELECT symbol, min(ts) AS start_ms, max(ts) + 30000 AS end_ms, count(*) AS n FROM s GROUP BY symbol, k) x WHERE end_ms <= {_CLOSED}""")
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of trades of a symbol without a pause of thirty seconds, closed by the watermark."""
    feed = _feed(spark, fills(spark, folder).select("symbol", "ts"))
    return streams.drained(streams.streaming_sessions(feed, lateness=f"{LATENESS_MS} milliseconds"), shared_folder(spark))


@query(f"SELECT symbol, max(ts) AS ts, arg_max(mark_price, (ts, mark_price)) AS mark_price FROM {QUOTES} q WHERE mark_price IS NOT NULL GROUP BY 1")
def stream_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Last mark of each symbol, kept over four batches in no order."""
    feed = _feed(spark, quotes(spark, folder).select("symbol", "ts", "mark_price"), 4)
    out = streams.drained(streams.latest_per_key(feed, "symbol", "mark_price"), shared_folder(spark), "update")
    return out.groupBy("symbol").agg(F.max_by(F.struct("ts", "mark_price"), "_batch").alias("l")).select("symbol", "l.ts", "l.mark_price")


@query(f"""WITH r AS (SELECT symbol, ts, size, max(ts) OVER (PARTITION BY symbol) AS top, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, size DESC) AS rn FROM {FILLS} f WHERE size IS NOT NULL)
  SELECT symbol, max(ts) AS ts, count(*) AS n, round(sum(size), 6) AS total, arg_max(size, (ts, size)) AS last FROM r WHERE rn <= 50 AND ts > top - 3600000 GROUP BY 1""")
def stream_buffers(spark: SparkSession, folder: str) -> DataFrame:
    """Buffers of the newest fifty sizes within an hour per symbol, after four batches in no order."""
    feed = _feed(spark, fills(spark, folder).where("size IS NOT NULL").select("symbol", "ts", "size"), 4)
    out = streams.drained(streams.recent(feed, "symbol", "ts", "size", 3_600_000, 50), shared_folder(spark), "update")
    last = out.groupBy("symbol").agg(F.max_by(F.struct("ts", "n", "total", "last"), "_batch").alias("l")).select("symbol", "l.*")
    return last.withColumn("total", F.round("total", 6))


@query(f"""SELECT symbol, count(*) AS n, count(*) FILTER (ts // 86400000 = (SELECT min(ts // 86400000) FROM {QUOTES} z)) AS first_day, 3 AS schema_version FROM {QUOTES} q GROUP BY 1""")
def stream_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Readings written as dated segments of a declared schema, read back."""
    q = quotes(spark, folder)
    root = shared_folder(spark)
    query_ = streams.segments(_feed(spark, q, 3), f"{root}/out", f"{root}/cp", "0 seconds", "symbol string, ts long, mark_price double, absent double", 3)
    query_.processAllAvailable()
    query_.stop()
    out = spark.read.schema("symbol string, ts long, mark_price double, absent double, schema_version int, date date").parquet(f"{root}/out")
    first = q.agg(F.to_date(F.timestamp_millis(F.min("ts")))).first()[0]
    return out.where("absent IS NULL").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("date") == F.lit(first)).alias("first_day"), F.max("schema_version").alias("schema_version"))


@query(f"""SELECT symbol, ts, mark_price FROM {QUOTES} q WHERE mark_price > 0""")
def stream_routed_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Ticker frames among trade frames, routed by topic and unwrapped."""
    q, f = quotes(spark, folder).where("mark_price > 0"), fills(spark, folder)
    frame = lambda df, topic, body: df.select((F.col("ts") * 1_000_000).alias("ts_local_ns"), F.col("ts").alias("ts_exchange_ms"), F.concat(F.lit(topic), "symbol").alias("topic"), F.lit("s").alias("stream"), "symbol", body.alias("payload_json"))
    both = frame(q, "tickers.", F.to_json(F.struct(F.struct(F.col("mark_price").alias("markPrice")).alias("data")))).unionByName(frame(f, "publicTrade.", F.to_json(F.struct(F.array(F.struct(F.col("price").cast("string").alias("p"), F.col("ts").alias("T"))).alias("data")))))
    routed = streams.routed(_feed(spark, both, 2))
    return streams.drained(routed["tickers"], shared_folder(spark)).select("symbol", "ts", "mark_price")


@query(f"SELECT tick_id, CAST(ts // 28800000 * 28800000 + 28800000 AS BIGINT) AS settles_ms, CAST(28800000 - ts % 28800000 AS BIGINT) AS left_ms FROM {QUOTES} q")
def stream_settlements(spark: SparkSession, folder: str) -> DataFrame:
    """The settlement each reading falls before."""
    feed = _feed(spark, quotes(spark, folder).select("tick_id", "ts"), 2)
    return streams.drained(streams.next_settlement(feed, "ts"), shared_folder(spark)).drop("ts")


@query(f"""SELECT symbol, CAST(ts // 300000 * 300000 AS BIGINT) AS period_ms, max(price) AS high, min(price) AS low, count(*) AS n FROM {FILLS} f GROUP BY 1, 2""")
def stream_corrected_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Five-minute aggregates kept in update mode over three batches in no order of time: late records correct what was given before."""
    feed = _feed(spark, fills(spark, folder).select("symbol", "ts", "price"), 3)
    agg = feed.groupBy("symbol", floor_to(F.col("ts"), 300_000).alias("period_ms")).agg(F.max("price").alias("high"), F.min("price").alias("low"), F.count(F.lit(1)).alias("n"))
    out = streams.drained(agg, shared_folder(spark), "update")
    return out.groupBy("symbol", "period_ms").agg(F.max_by(F.struct("high", "low", "n"), "_batch").alias("l")).select("symbol", "period_ms", "l.high", "l.low", "l.n")
