"""Queries on payloads, text, sets and the generic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.operators import normalize
from tideglass.operators.blocks import with_last_known, with_previous
from tideglass.plans.registry import query
from tideglass.plans.views import FILLS, fills
from tideglass.sources.tables import table


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    """Trades as raw frames: flat in one dialect, and enveloped by second and symbol in another; null fields are left out.

    The key of an even id is its half, so symbols share some; every eleventh trade has none, every seventh size is no number.
    """
    f = fills(spark, folder)
    text = lambda c: F.col(c).cast("decimal(30,10)").cast("string")
    own = F.when(F.col("trade_id") % 2 == 0, F.floor(F.col("trade_id") / 2)).otherwise(F.col("trade_id"))
    key = F.when(F.col("trade_id") % 11 != 0, own.cast("string"))
    size = F.when(F.col("trade_id") % 7 == 0, "bad").otherwise(text("size"))
    flat = f.where("trade_id % 3 <> 0").select("symbol", F.col("ts").alias("ts_exchange_ms"), F.to_json(F.struct(F.initcap("side").alias("side"), text("price").alias("price"), size.alias("size"), key.alias("trdMatchID"))).alias("payload_json"))
    item = F.struct(F.col("ts").alias("T"), F.initcap("side").alias("S"), size.alias("v"), text("price").alias("p"), key.alias("i"))
    packed = f.where("trade_id % 3 = 0 OR trade_id % 5 = 0").groupBy("symbol", "day", (F.floor(F.col("ts") / 1000) * 1000 + 999).alias("ts_exchange_ms")).agg(F.to_json(F.struct(F.collect_list(item).alias("data"))).alias("payload_json")).drop("day")
    return flat.unionByName(packed)


_ROWS = f"""(SELECT symbol, CASE WHEN trade_id % 11 <> 0 THEN CAST(CASE WHEN trade_id % 2 = 0 THEN trade_id // 2 ELSE trade_id END AS VARCHAR) END AS trade_key, ts, side, CAST(CAST(price AS DECIMAL(30,10)) AS DOUBLE) AS price,
  CASE WHEN trade_id % 7 <> 0 THEN CAST(CAST(size AS DECIMAL(30,10)) AS DOUBLE) END AS size, trade_id FROM {FILLS} f)"""
_FORMS = f"""(SELECT symbol, false AS is_envelope, trade_key, ts, side, price, size FROM {_ROWS} a WHERE trade_id % 3 <> 0 UNION ALL SELECT symbol, true, trade_key, ts, side, price, size FROM {_ROWS} b WHERE trade_id % 3 = 0 OR trade_id % 5 = 0)"""


@query(f"SELECT * FROM {_FORMS} x")
def envelope_explode(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of both dialects (built from all trades) normalised to one row per trade."""
    return normalize.trade_rows(_frames(spark, folder), keep=("symbol",)).withColumn("size", F.col("size").cast("double"))


@query(f"SELECT * FROM {_FORMS} x WHERE NOT is_envelope OR trade_key IS NULL OR NOT EXISTS (SELECT 1 FROM {_FORMS} y WHERE NOT y.is_envelope AND y.symbol = x.symbol AND y.trade_key = x.trade_key)")
def cross_form_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Enveloped trades that came flat too are dropped, ids being those of a symbol."""
    return normalize.without_cross_form_repeats(envelope_explode(spark, folder), ("symbol",))


@query(f"SELECT symbol, count(*) AS n, count(*) FILTER (price > 0) AS kept, count(*) FILTER (price IS NULL) AS no_price, count(*) FILTER (price <= 0) AS bad_price, count(*) FILTER (size IS NULL) AS no_size FROM {_FORMS} x GROUP BY symbol")
def dropped_trades(spark: SparkSession, folder: str) -> DataFrame:
    """How many trades of each symbol the plausibility filter takes and drops."""
    return normalize.counted_drops(envelope_explode(spark, folder), ["symbol"])


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events""")
def json_extract(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (value > 100) AS n_large, count(*) FILTER (CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL) AS n_missing FROM events GROUP BY 1""")
def journal_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 100).alias("n_large"), F.count_if(F.get_json_object("props", "$.k").try_cast("bigint").isNull()).alias("n_missing"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, epoch_us(ts) // 1000 AS ms, CAST(date_trunc('week', ts) AS DATE) AS week, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS epoch_day FROM events""")
def date_arithmetic(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select("event_id", F.date_format(ts, "yyyy-MM-dd").alias("day"), F.unix_millis(ts).alias("ms"), F.to_date(F.date_trunc("week", ts)).alias("week"), F.unix_date(F.to_date(ts)).cast("long").alias("epoch_day"))


@query("""WITH s AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800000 THEN 1 ELSE 0 END AS new FROM events),
  t AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM s) SELECT user_id, epoch_us(min(ts)) // 1000 AS started, count(*) AS n FROM t GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of a user: events at most thirty minutes apart."""
    e = table(spark, folder, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    order = ["ms", "event_id"]
    p = with_previous(e, ["user_id"], order, ["ms"])
    begun = p.withColumn("_begun", F.when(F.col("prev").isNull() | (F.col("ms") - F.col("prev.ms") > 1_800_000), F.col("ms")))
    return with_last_known(begun, ["user_id"], order, "_begun", "started").groupBy("user_id", "started").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, list_distinct(regexp_extract_all(text, '\\b([A-Z0-9]{2,15}(?:USDT|PERP))\\b', 1)) IS NOT NULL AND len(list_distinct(regexp_extract_all(text, '\\b([A-Z0-9]{2,15}(?:USDT|PERP))\\b', 1))) > 0 AS names_any,
  len(list_distinct(regexp_extract_all(text, '\\b([A-Z0-9]{2,15}(?:USDT|PERP))\\b', 1))) AS n_symbols FROM documents WHERE text IS NOT NULL""")
def text_symbols(spark: SparkSession, folder: str) -> DataFrame:
    found = normalize.extracted_symbols(F.col("text"))
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", (F.size(found) > 0).alias("names_any"), F.size(found).cast("long").alias("n_symbols"))


@query("""SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0""")
def set_intersection(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, folder, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("""SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders""")
def set_difference(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, folder, "orders").select("o_custkey"))


@query("""SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) x WHERE rn = 1""")
def first_wins_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The first order of each customer: an aggregate, so a customer with most orders is combined where they lie."""
    first = F.min(F.struct("o_orderdate", "o_orderkey")).alias("_first")
    return table(spark, folder, "orders").groupBy("o_custkey").agg(first).select("_first.o_orderkey", "o_custkey")


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def semi_join(spark: SparkSession, folder: str) -> DataFrame:
    done = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, folder, "customer").select("c_custkey").join(done, "c_custkey", "leftsemi")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def anti_join(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey").join(table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "leftanti")


@query("""SELECT l_returnflag AS symbol, round(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0), 6) AS weighted_mean, max(l_extendedprice) AS best, arg_max(l_orderkey, (l_extendedprice, l_orderkey, l_linenumber)) AS best_key, count(*) AS n FROM lineitem GROUP BY 1""")
def trade_weighted_mean(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("symbol")).agg(
        F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.nullif(F.sum("l_quantity"), F.lit(0.0)), 6).alias("weighted_mean"), F.max("l_extendedprice").alias("best"),
        F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("best_key"), F.count(F.lit(1)).alias("n"),
    )


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def top_n(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty-five largest orders (a top-k report)."""
    return table(spark, folder, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query(f"SELECT symbol, n FROM (SELECT symbol, count(*) AS n FROM {FILLS} f GROUP BY 1) x ORDER BY n DESC, symbol LIMIT 1")
def busiest_symbol(spark: SparkSession, folder: str) -> DataFrame:
    """The symbol with most trades (a top-1 report); ties go by name."""
    return fills(spark, folder).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "symbol").limit(1)


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) - 30000, 2) AS pnl FROM lineitem ORDER BY pnl, l_orderkey, l_linenumber LIMIT 20")
def worst_trades(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty worst results (a top-k report)."""
    pnl = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) - 30000, 2)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", pnl.alias("pnl")).orderBy("pnl", "l_orderkey", "l_linenumber").limit(20)


@query("""SELECT c_mktsegment AS symbol, count(*) AS n, round(quantile_cont(o_totalprice, 0.5), 6) AS median, min(o_totalprice) AS worst FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment UNION ALL SELECT NULL, count(*), round(quantile_cont(o_totalprice, 0.5), 6), min(o_totalprice) FROM orders JOIN customer ON o_custkey = c_custkey""")
def pooled_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics per group and pooled (null group)."""
    j = table(spark, folder, "orders").join(table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("symbol")), "o_custkey")
    return j.rollup("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("o_totalprice", 0.5), 6).alias("median"), F.min("o_totalprice").alias("worst"))


_OPTION = """(SELECT o_orderkey, 'BTC-' || (o_orderkey % 27 + 1) || ['JAN','FEB','JUN','SEP','DEC','XXX'][o_orderkey % 6 + 1] || '26-' || (60000 + 500 * (o_orderkey % 40)) || CASE WHEN o_orderkey % 5 = 0 THEN 'd5' ELSE '' END || '-' || CASE WHEN o_orderkey % 2 = 0 THEN 'C' ELSE 'P' END AS name FROM orders)"""


@query(f"""SELECT o_orderkey, CASE WHEN ok THEN 'BTC' END AS underlying, CASE WHEN ok THEN '2026-' || m || '-' || lpad(CAST(o_orderkey % 27 + 1 AS VARCHAR), 2, '0') END AS expiry, CASE WHEN ok THEN CAST(60000 + 500 * (o_orderkey % 40) + CASE WHEN o_orderkey % 5 = 0 THEN 0.5 ELSE 0 END AS DOUBLE) END AS strike, CASE WHEN ok THEN right(name, 1) END AS option_right
  FROM (SELECT *, o_orderkey % 6 <> 5 AS ok, ['01','02','06','09','12','00'][o_orderkey % 6 + 1] AS m FROM {_OPTION} n) x""")
def option_names(spark: SparkSession, folder: str) -> DataFrame:
    """Option names built from the orders, parsed into their parts; impossible months give nulls."""
    k = F.col("o_orderkey")
    month = F.element_at(F.array(*[F.lit(m) for m in "JAN FEB JUN SEP DEC XXX".split()]), (k % 6 + 1).cast("int"))
    name = F.concat(F.lit("BTC-"), (k % 27 + 1).cast("string"), month, F.lit("26-"), (60_000 + 500 * (k % 40)).cast("string"), F.when(k % 5 == 0, "d5").otherwise(""), F.lit("-"), F.when(k % 2 == 0, "C").otherwise("P"))
    return table(spark, folder, "orders").select("o_orderkey", *[c.alias(n) for n, c in normalize.parsed_instrument(name).items()])


@query("""SELECT l_returnflag, l_linestatus, CAST(floor(l_quantity / 10) AS BIGINT) AS bucket, count(*) AS n, round(quantile_cont(l_discount, 0.25), 6) AS p25, round(quantile_cont(l_discount, 0.5), 6) AS p50, round(quantile_cont(l_discount, 0.9), 6) AS p90 FROM lineitem GROUP BY 1, 2, 3""")
def quote_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Quantiles of a measure per bucket of another."""
    q = F.percentile("l_discount", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9)))
    g = table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus", F.floor(F.col("l_quantity") / 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), q.alias("q"))
    return g.select("l_returnflag", "l_linestatus", "bucket", "n", *[F.round(F.col("q")[i], 6).alias(p) for i, p in enumerate(("p25", "p50", "p90"))])


@query("""SELECT day, n, total FROM (SELECT unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY))::DATE AS day FROM orders) c LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) o ON c.day = o.d""")
def calendar_left_join(spark: SparkSession, folder: str) -> DataFrame:
    """A gapless axis from the first to the last day with orders, with the orders of each; null where there are none."""
    o = table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    days = o.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("day"))
    return days.join(o, "day", "left")


@query("""SELECT coalesce(a.k, b.k) AS k, a.v AS left_v, b.v AS right_v, a.v IS NULL OR b.v IS NULL OR abs(a.v - b.v) > 1000 AS differs FROM (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k""")
def comparison_join(spark: SparkSession, folder: str) -> DataFrame:
    """Two sources of the same figure side by side, flagged where one lacks it or they differ."""
    side = lambda s, n: table(spark, folder, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias(n))
    j = side("F", "left_v").join(side("O", "right_v"), "k", "full")
    return j.withColumn("differs", F.coalesce(F.abs(F.col("left_v") - F.col("right_v")) > 1000, F.lit(True)))
