"""Round trips through sources and sinks: tables written in a store's own form and read back by its reader."""

from __future__ import annotations

import json
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.functions.events import DAY_MS
from tideglass.operators import bars, normalize
from tideglass.operators.orderbook import exploded_snapshots
from tideglass.plans.market_queries import _book
from tideglass.plans.registry import query
from tideglass.plans.views import DAILY, FILLS, QUOTES, daily, fills, quotes
from tideglass.session import shared_folder, written
from tideglass.sources import frames, paged, sinks
from tideglass.sources.tables import table

_DATE = "strftime(make_timestamp(ts * 1000), '%Y-%m-%d')"


def _date(ts: str = "ts"):
    return F.date_format(F.timestamp_millis(ts), "yyyy-MM-dd")


def _raw_tree(spark: SparkSession, folder: str) -> str:
    """All trades as flat frames in the tree of a harvest; the trees of even symbols lack the columns topic and stream."""
    root = shared_folder(spark)
    text = lambda c: F.col(c).cast("decimal(30,10)").cast("string")
    payload = F.to_json(F.struct(F.initcap("side").alias("side"), text("price").alias("price"), text("size").alias("size"), F.col("trade_id").cast("string").alias("trdMatchID")))
    f = fills(spark, folder).select("symbol", _date().alias("date"), F.col("ts").alias("ts_exchange_ms"), payload.alias("payload_json"))
    f.hint("rebalance", "symbol", "date").write.partitionBy("symbol", "date").parquet(f"{root}/raw/venue/trades")
    return root


_TAPE = f"(SELECT symbol, {_DATE} AS date, CAST(trade_id AS VARCHAR) AS trade_key, ts, side, CAST(CAST(price AS DECIMAL(30,10)) AS DOUBLE) AS price, CAST(CAST(size AS DECIMAL(30,10)) AS DOUBLE) AS size FROM {FILLS} f)"


@query(f"SELECT * FROM {_TAPE} t")
def raw_tree_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The harvest tree with dates and symbols as text, normalised to trades."""
    tree = frames.raw_frames(spark, _raw_tree(spark, folder), "venue", "trades")
    return normalize.trade_rows(tree, keep=("symbol", "date")).drop("is_envelope").withColumn("size", F.col("size").cast("double"))


@query(f"SELECT symbol, trade_key, ts, price FROM {_TAPE} t WHERE date >= (SELECT max(date) FROM {_TAPE} u) AND side IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts, trade_key) <= 500")
def trade_window_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The first 500 trades with a side of each symbol from the last day on (the bound is the scan's parameter); earlier days are not listed."""
    last = fills(spark, folder).agg(F.max("ts")).first()[0] or 0
    first = spark.range(1).select(F.date_format(F.timestamp_millis(F.lit(last)), "yyyy-MM-dd")).first()[0]
    tree = frames.raw_frames(spark, _raw_tree(spark, folder), "venue", "trades", first=first)
    t = normalize.trade_rows(tree, keep=("symbol",)).where("side IS NOT NULL")
    return frames.latest_ticks(t, last - last % DAY_MS, last + 1, 500).select("symbol", "trade_key", "ts", "price")


@query(f"SELECT symbol, date, count(*) AS n FROM {_TAPE} t GROUP BY 1, 2")
def existing_files_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Files named one by one for all symbols and days, those that don't exist left out."""
    base = f"{_raw_tree(spark, folder)}/raw/venue/trades"
    keys = fills(spark, folder).select("symbol", _date().alias("date")).distinct()
    names = [f"{base}/symbol={r.symbol}/date={r.date}" for r in keys.collect()]
    return frames.existing(spark, [*names, f"{base}/symbol=NONE/date=2000-01-01"]).groupBy(F.regexp_extract(F.col("_metadata.file_path"), "symbol=([^/]+)/", 1).alias("symbol"), F.regexp_extract(F.col("_metadata.file_path"), "date=([^/]+)/", 1).alias("date")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT symbol, ts, last_price FROM {QUOTES} q WHERE ts >= (SELECT max(ts) - 3600000 FROM {QUOTES} z)")
def ticker_range_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of the last hour by event time."""
    q = quotes(spark, folder)
    last = q.agg(F.max("ts")).first()[0] or 0
    return q.where(F.col("ts") >= last - 3_600_000).select("symbol", "ts", "last_price")


_KLINES = f"""(SELECT symbol, CAST(ts // 3600000 * 3600000 AS BIGINT) AS start_ms, arg_min(price, (ts, price)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, price)) AS close FROM {FILLS} f GROUP BY 1, 2)"""


def _klines(spark: SparkSession, folder: str) -> DataFrame:
    k = bars.ohlcv(fills(spark, folder), ["symbol"], 3_600_000, "hour")
    return k.select("symbol", (F.col("hour") * 3_600_000).alias("start_ms"), F.col("px_first").alias("open"), F.col("px_high").alias("high"), F.col("px_low").alias("low"), F.col("px_last").alias("close"))


@query(f"SELECT * FROM {_KLINES} k WHERE start_ms >= (SELECT min(start_ms) + 3600000 FROM {_KLINES} z)")
def kline_csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly klines through a CSV file with a strict schema, from the second hour on."""
    path = f"{shared_folder(spark)}/klines.csv"
    _klines(spark, folder).write.option("header", True).csv(path)
    k = frames.tabular(spark, path, "symbol string, start_ms long, open double, high double, low double, close double")
    first = k.agg(F.min("start_ms")).first()[0] or 0
    return k.where(F.col("start_ms") >= first + 3_600_000)


@query(f"SELECT * FROM {_KLINES} k")
def paged_kline_source(spark: SparkSession, folder: str) -> DataFrame:
    """Klines behind a paged source that gives the newest first, one request per symbol, fetched where the request lies.

    The canned fetcher answers from the request, which carries its own rows: a source without a network.
    """
    per = _klines(spark, folder).groupBy("symbol").agg(F.to_json(F.array_sort(F.collect_list(F.struct("start_ms", "open", "high", "low", "close")))).alias("rows"))

    def fetch(request: dict) -> dict:
        rows = [r for r in json.loads(request["rows"]) if r["start_ms"] < request["end"]]
        page = rows[::-1][:7]
        return {"retCode": 0, "result": {"list": [{"start": r["start_ms"], **r} for r in page]}}

    def row(request: dict, e: dict) -> tuple:
        return (request["symbol"], e["start_ms"], float(e["open"]), float(e["high"]), float(e["low"]), float(e["close"]))

    return paged.paged(per, fetch, "symbol string, start_ms long, open double, high double, low double, close double", row, partial(paged.pages_back, start_ms=0, end_ms=1 << 60))


@query(f"SELECT symbol, count(*) AS n FROM {_KLINES} k WHERE symbol NOT IN (SELECT symbol FROM instruments WHERE status <> 'Trading' OR length(symbol) % 2 = 0) GROUP BY 1")
def backfill_requests(spark: SparkSession, folder: str) -> DataFrame:
    """What a history backfill still has to fetch: hours of symbols the manifest doesn't have as done."""
    done = table(spark, folder, "instruments").where("status <> 'Trading' OR length(symbol) % 2 = 0").select("symbol", F.lit("DONE").alias("status"))
    return paged.still_to_fetch(_klines(spark, folder).select("symbol", "start_ms"), done, ["symbol"]).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT symbol, CAST(ts // 60000 AS BIGINT) AS minute_idx, {_DATE} AS date, count(*) AS n_trades, max(price) AS px_high FROM {FILLS} f GROUP BY 1, 2, 3")
def bar_cache_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Minute bars written as immutable days with fingerprints, the second run finding them done, and read back by version."""
    root = shared_folder(spark)
    b = fills(spark, folder).groupBy("symbol", F.floor(F.col("ts") / 60_000).alias("minute_idx"), _date().alias("date")).agg(F.count(F.lit(1)).alias("n_trades"), F.max("price").alias("px_high"))
    for version in (1, 2):
        sinks.write_immutable(b.hint("rebalance", "date"), f"{root}/bars", ["date"], f"{root}/manifest", version)
    out = frames.cached_bars(spark, f"{root}/bars", spark.read.parquet(f"{root}/manifest"), 1, "1970-01-01", "9999-12-31")
    return out.select("symbol", "minute_idx", F.date_format("date", "yyyy-MM-dd").alias("date") if dict(out.dtypes)["date"] != "string" else "date", "n_trades", "px_high")


_YEARS = f"(SELECT symbol, year(DATE '1970-01-01' + day_no::INTEGER) AS year, day_no * 86400000 AS start_ms, close FROM {DAILY} d)"


def _panel_rows(spark: SparkSession, folder: str) -> DataFrame:
    day = F.date_from_unix_date("day_no")
    return daily(spark, folder).select("symbol", F.year(day).alias("year"), (F.col("day_no").cast("long") * DAY_MS).alias("start_ms"), "close")


@query(f"SELECT symbol, year, count(*) AS n_rows, CASE WHEN count(*) >= 250 THEN 'DONE' ELSE 'PARTIAL' END AS status FROM {_YEARS} y GROUP BY 1, 2")
def panel_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """Status of the panel's partitions by symbol and year; a repeated write gives the same."""
    root = shared_folder(spark)
    rows = written(_panel_rows(spark, folder).hint("rebalance", "symbol", "year"), f"{root}/rows")
    for _ in range(2):
        sinks.write_panel(rows, f"{root}/panel", f"{root}/manifest", 250)
    return sinks.panel_manifest(spark, f"{root}/manifest").select("symbol", "year", "n_rows", "status")


@query(f"SELECT symbol, year, start_ms, close FROM {_YEARS} y")
def panel_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The panel read back, unfinished years allowed."""
    root = shared_folder(spark)
    sinks.write_panel(_panel_rows(spark, folder).hint("rebalance", "symbol", "year"), f"{root}/panel", f"{root}/manifest", 250)
    return sinks.read_panel(spark, f"{root}/panel", f"{root}/manifest", partial=True)


@query(f"""SELECT CAST(symbol AS VARCHAR) || CASE WHEN symbol % 5 = 0 THEN '#delisted' ELSE '' END AS symbol, CAST(day_no AS BIGINT) AS day, close FROM {DAILY} d WHERE symbol % 5 IN (0, 1)
  UNION ALL SELECT CAST(symbol AS VARCHAR), CAST(day_no AS BIGINT), close FROM {DAILY} d WHERE symbol % 5 NOT IN (1)""")
def survivor_union(spark: SparkSession, folder: str) -> DataFrame:
    """Panels of living and ended series as one; an ended series whose name lives again is told apart."""
    d = daily(spark, folder).select(F.col("symbol").cast("string").alias("symbol"), F.col("day_no").cast("long").alias("day"), "close")
    alive, ended = d.where("CAST(symbol AS INT) % 5 <> 1"), d.where("CAST(symbol AS INT) % 5 IN (0, 1)")
    return paged.panel_union(alive, paged.renamed_relistings(alive, ended))


@query(f"SELECT tick_id, 'cold' AS store FROM (SELECT *, max(ts) OVER () AS m FROM {QUOTES} q) x WHERE ts < m - 3600000 UNION ALL SELECT tick_id, 'hot' FROM (SELECT *, max(ts) OVER () AS m FROM {QUOTES} q) x WHERE ts >= m - 3600000")
def archived_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Readings older than an hour in the cold store, the others in the hot one; archiving twice repeats nothing."""
    root, q = shared_folder(spark), quotes(spark, folder)
    cut = (q.agg(F.max("ts")).first()[0] or 0) - 3_600_000
    for _ in range(2):
        sinks.archive(q, cut, f"{root}/cold", f"{root}/hot")
    part = lambda n: (spark.read.schema(q.schema).parquet(f"{root}/{n}")).select("tick_id", F.lit(n).alias("store"))
    return part("cold").unionByName(part("hot"))


@query(f"SELECT symbol, ts, CAST(mark_price AS DOUBLE) AS mark_price, CAST(NULL AS DOUBLE) AS volatility FROM {QUOTES} q")
def typed_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Readings appended as batches of a declared schema: unknown columns dropped, missing ones null, a repeated batch in once."""
    root, q = shared_folder(spark), quotes(spark, folder)
    schema = "symbol string, ts long, mark_price double, volatility double"
    for half in (0, 1, 1):
        sinks.append_typed(q.where(F.pmod("tick_id", F.lit(2)) == half), f"{root}/t", schema, f"b{half}")
    return spark.read.parquet(f"{root}/t").drop("batch")


@query("""WITH s AS (SELECT symbol, ts, lower(side) AS side, row_number() OVER (PARTITION BY symbol, ts, lower(side) ORDER BY level, row_id) - 1 AS level, price, size FROM (SELECT DISTINCT row_id, symbol, ts, side, level, price, size FROM orderbook_snapshots WHERE lower(side) IN ('bid', 'ask')) b)
  SELECT symbol, ts, side, CAST(level AS INTEGER) AS level, price, size FROM s""")
def snapshot_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots as arrays of prices and sizes, written one row per level."""
    b = _book(spark, folder)

    def column(side: str, name: str):
        levels = F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("level", "row_id", "price", "size"))))
        return F.transform(levels, lambda x: x[name]).alias(f"{side}_{name}s")

    arrays = [column(s, c) for s in ("bid", "ask") for c in ("price", "size")]
    return exploded_snapshots(b.groupBy("symbol", "ts").agg(*arrays)).withColumn("level", F.col("level").cast("int"))


@query(f"SELECT symbol, ts, price, size FROM {FILLS} f")
def journal_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """All trades through a CSV journal: numbers read back as they were."""
    root = shared_folder(spark)
    f = fills(spark, folder).select("symbol", "ts", "price", "size")
    for half in (0, 1):
        sinks.append_csv(f.where(F.pmod("ts", F.lit(2)) == half), f"{root}/journal")
    return spark.read.csv(f"{root}/journal", header=True, schema="symbol string, ts long, price double, size double", mode="FAILFAST")


@query("SELECT symbol, status, CAST(tick_size AS DOUBLE) AS tick_size, CASE WHEN length(symbol) % 2 = 0 THEN NULL ELSE qty_step END AS qty_step FROM instruments")
def report_pair(spark: SparkSession, folder: str) -> DataFrame:
    """A small table as JSON and Markdown, read back from the JSON; NaN came back as null."""
    root = shared_folder(spark)
    i = table(spark, folder, "instruments").select("symbol", "status", "tick_size", F.when(F.length("symbol") % 2 == 0, float("nan")).otherwise(F.col("qty_step")).alias("qty_step"))
    sinks.write_report(i, root, "Instruments")
    return spark.read.schema("symbol string, status string, tick_size double, qty_step double").json(f"{root}/json")


@query("SELECT symbol, tick_size FROM instruments")
def listed_json_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Instruments out of a JSON file that wraps its entries in ``result.list``."""
    root = shared_folder(spark)
    entry = F.struct("symbol", F.col("tick_size").alias("tickSize"))
    whole = table(spark, folder, "instruments").agg(F.to_json(F.struct(F.struct(F.collect_list(entry).alias("list")).alias("result"))).alias("value"))
    whole.coalesce(1).write.text(f"{root}/instruments")
    return frames.listed_json(spark, f"{root}/instruments").select(F.get_json_object("entry", "$.symbol").alias("symbol"), F.get_json_object("entry", "$.tickSize").cast("double").alias("tick_size"))


@query("SELECT symbol, status, max_launch FROM (SELECT symbol, status, epoch_ms(launch_ts) AS max_launch FROM instruments) i")
def merged_register(spark: SparkSession, folder: str) -> DataFrame:
    """A register merged with what it has already: equal keys under equal parameters stay one row."""
    i = table(spark, folder, "instruments").select("symbol", F.col("status").alias("parameters"), F.unix_millis(F.col("launch_ts").cast("timestamp")).alias("max_launch"))
    return sinks.merged(i, i.where("length(symbol) > 6"), ["symbol"]).withColumnRenamed("parameters", "status")


@query(f"SELECT count(DISTINCT symbol) AS streams, count(DISTINCT symbol) AS gone FROM {FILLS} f")
def storage_cap(spark: SparkSession, folder: str) -> DataFrame:
    """Usage of a store by stream, and the streams whose files all have to go under a cap of nothing."""
    root = shared_folder(spark)
    fills(spark, folder).select("symbol", "ts").hint("rebalance", "symbol").write.partitionBy("symbol").parquet(f"{root}/raw/venue")
    used = sinks.disk_usage(spark, f"{root}/raw").where("files > 0 AND bytes > 0").agg(F.count_distinct("stream").alias("streams"))
    gone = sinks.beyond_cap(spark, f"{root}/raw", 0).agg(F.count_distinct(F.regexp_extract("path", "symbol=([^/]+)/", 1)).alias("gone"))
    both = used.select("streams", F.lit(None).cast("long").alias("gone")).unionByName(gone.select(F.lit(None).cast("long").alias("streams"), "gone"))
    return both.agg(F.max("streams").alias("streams"), F.max("gone").alias("gone"))


@query(f"""SELECT symbol, count(*) AS n, count(*) FILTER (funding_rate IS NULL) AS missing, count(*) FILTER (mark_price IS NULL) AS no_mark, min(tick_id) FILTER (mark_price IS NULL) AS sample FROM {QUOTES} q GROUP BY 1""")
def field_presence(spark: SparkSession, folder: str) -> DataFrame:
    """How often fields are missing from the frames, with a record to look at."""
    return quotes(spark, folder).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("funding_rate").isNull()).alias("missing"), F.count_if(F.col("mark_price").isNull()).alias("no_mark"), F.min(F.when(F.col("mark_price").isNull(), F.col("tick_id"))).alias("sample"))


@query(f"SELECT tick_id, mark_price FROM {QUOTES} q WHERE mark_price IS NOT NULL")
def prefiltered_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Frames whose text names a field, chosen before any JSON is parsed (the text test is pushed into a scan of raw frames)."""
    q = quotes(spark, folder).select(F.to_json(F.struct(F.col("tick_id").alias("id"), F.struct(F.col("mark_price").alias("markPrice"), F.col("last_price").alias("lastPrice")).alias("data"))).alias("payload_json"))
    tree = written(q, f"{shared_folder(spark)}/frames").where(F.col("payload_json").contains('"markPrice"'))
    return tree.select(F.get_json_object("payload_json", "$.id").cast("long").alias("tick_id"), normalize.ticker_field(F.col("payload_json"), "markPrice").alias("mark_price"))


@query(f"SELECT symbol, {_DATE} AS date, round(avg(funding_rate) + 1e-13, 10) AS mean_rate FROM {QUOTES} q WHERE funding_rate IS NOT NULL GROUP BY 1, 2")
def funding_alias_loader(spark: SparkSession, folder: str) -> DataFrame:
    """Daily mean funding of frames in which the field goes by several names."""
    names = ("fundingRate", "funding_rate", "r")
    bodies = [F.to_json(F.struct(F.col("funding_rate").alias(n))) for n in names]
    q = quotes(spark, folder).where("funding_rate IS NOT NULL").select("symbol", "ts", F.element_at(F.array(*bodies), (F.pmod("tick_id", F.lit(3)) + 1).cast("int")).alias("payload"))
    value = F.coalesce(*[normalize.ticker_field(F.col("payload"), n) for n in names])
    return q.groupBy("symbol", _date().alias("date")).agg(F.round(F.sum(value.cast("decimal(38,18)")).cast("double") / F.count(value) + 1e-13, 10).alias("mean_rate"))


@query(f"SELECT symbol, {_DATE} AS date, max(ts) AS ts, arg_max(mark_price, (ts, mark_price)) AS value FROM {QUOTES} q WHERE mark_price > 0 GROUP BY 1, 2")
def index_close(spark: SparkSession, folder: str) -> DataFrame:
    """Value of the last index frame of each day (marks stand in for the volatility)."""
    q = quotes(spark, folder).where("mark_price > 0").select("symbol", _date().alias("date"), "ts", F.to_json(F.struct(F.col("mark_price").alias("volatility"))).alias("payload"))
    return normalize.last_payload(q, ["symbol", "date"], "payload", "ts", "volatility")


@query("SELECT symbol, epoch_ms(date_trunc('minute', launch_ts)) AS at_ms, CASE WHEN status = 'Trading' THEN 'listing' ELSE 'delisting' END AS category FROM instruments WHERE regexp_matches(symbol, '^[A-Z0-9]{2,15}(USDT|PERP)$')")
def announcement_register(spark: SparkSession, folder: str) -> DataFrame:
    """Notices about instruments through a paged source, read for symbol, time and kind."""
    word = F.when(F.col("status") == "Trading", "New listing: ").otherwise("Delisting of ")
    day = F.date_format("launch_ts", "yyyy-MM-dd HH:mm")
    i = table(spark, folder, "instruments").select("symbol", F.concat(word, F.col("symbol"), F.lit(" at "), day, F.lit(" UTC.")).alias("title"))

    def fetch(request: dict) -> dict:
        return {"retCode": 0, "result": {"list": [{"title": request["title"]}]}}

    notices = paged.paged(i, fetch, "title string", lambda request, e: (e["title"],))
    said = normalize.announced(F.col("title"))
    return notices.select(F.explode(said["symbols"]).alias("symbol"), said["at_ms"].alias("at_ms"), said["category"].alias("category"))
