"""Queries on who is in the panel when, what a signal earned, and how activity is shared and settles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.operators import bars
from tideglass.operators.grouped import per_series
from tideglass.operators.ranks import average_rank, floor_bucket, pearson, spearman
from tideglass.plans.market_queries import _MRET, _minute_returns
from tideglass.plans.registry import query
from tideglass.plans.views import DAILY, FILLS, QUOTES, RETURNS, WEEKLY, daily, fills, quotes, weekly, weekly_returns
from tideglass.sources.tables import table

_ALIVE = f"""(SELECT symbol, week_idx, turnover, ret, next_ret, week_idx - first_week >= 8 AND week_idx <= last_week AS alive FROM (
  SELECT *, min(week_idx) OVER (PARTITION BY symbol) AS first_week, max(week_idx) OVER (PARTITION BY symbol) AS last_week FROM {RETURNS} r) x)"""


def _alive(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly returns with ``alive``: eight weeks of history by then and not past the last week."""
    own = Window.partitionBy("symbol")
    r = weekly_returns(spark, folder).withColumn("_a", F.min("week_idx").over(own)).withColumn("_b", F.max("week_idx").over(own))
    return r.withColumn("alive", (F.col("week_idx") - F.col("_a") >= 8) & (F.col("week_idx") <= F.col("_b"))).drop("_a", "_b")


@query(f"SELECT symbol, week_idx, alive FROM {_ALIVE} a")
def alive_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Membership as it was known in each week."""
    return _alive(spark, folder).select("symbol", "week_idx", "alive")


@query(f"""SELECT cohort, count(*) AS symbols, CAST(sum(weeks) AS BIGINT) AS symbol_weeks, round(avg(weeks), 6) AS mean_weeks FROM (SELECT symbol, CAST(floor(min(week_idx) / 52.0) AS BIGINT) AS cohort, count(*) AS weeks FROM {WEEKLY} w GROUP BY 1) x GROUP BY 1""")
def listing_cohorts(spark: SparkSession, folder: str) -> DataFrame:
    """Series by the year of their first week, and how long they lasted."""
    own = weekly(spark, folder).groupBy("symbol").agg(F.floor(F.min("week_idx") / 52).alias("cohort"), F.count(F.lit(1)).alias("weeks"))
    return own.groupBy("cohort").agg(F.count(F.lit(1)).alias("symbols"), F.sum("weeks").alias("symbol_weeks"), F.round(F.avg("weeks"), 6).alias("mean_weeks"))


_VOLS = f"""(SELECT symbol, CAST(floor((day_no + 3) / 7.0) AS BIGINT) AS week_idx, sqrt(count(r)) * stddev_samp(r) AS sigma FROM (SELECT symbol, day_no, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY day_no)) AS r FROM {DAILY} d) x GROUP BY 1, 2 HAVING count(r) >= 2)"""


@query(f"""WITH j AS (SELECT r.symbol, r.week_idx, r.next_ret, v.sigma, (SELECT quantile_cont(sigma, 0.5) FROM {_VOLS} z) AS target FROM {RETURNS} r JOIN {_VOLS} v ON r.symbol = v.symbol AND r.week_idx = v.week_idx WHERE next_ret IS NOT NULL)
  SELECT symbol, week_idx, round(target / greatest(sigma, 1e-8), 7) AS weight, round(0.5 * sigma * sigma, 8) AS drag, round((next_ret + 0.5 * sigma * sigma) * target / greatest(sigma, 1e-8), 7) AS outcome FROM j""")
def vol_scaled_outcome(spark: SparkSession, folder: str) -> DataFrame:
    """Next week's return with the log drag put back, weighted by the forming week's volatility against the median of all."""
    by_day = Window.partitionBy("symbol").orderBy("day_no")
    r = daily(spark, folder).withColumn("r", F.ln("close") - F.ln(F.lag("close").over(by_day)))
    v = r.groupBy("symbol", F.floor((F.col("day_no") + 3) / 7).alias("week_idx")).agg((F.sqrt(F.count("r")) * F.stddev_samp("r")).alias("sigma"), F.count("r").alias("n")).where("n >= 2").drop("n")
    target = v.agg(F.percentile("sigma", 0.5)).first()[0]
    j = weekly_returns(spark, folder).where("next_ret IS NOT NULL").join(v, ["symbol", "week_idx"])
    drag, weight = 0.5 * F.col("sigma") * F.col("sigma"), F.lit(target) / F.greatest("sigma", F.lit(1e-8))
    return j.select("symbol", "week_idx", F.round(weight, 7).alias("weight"), F.round(drag, 8).alias("drag"), F.round((F.col("next_ret") + drag) * weight, 7).alias("outcome"))


_PAIRS = f"""(SELECT *, sum(ret) OVER (PARTITION BY symbol ORDER BY week_idx ROWS 3 PRECEDING) AS trail, lead(alive) OVER (PARTITION BY symbol ORDER BY week_idx) AS stays FROM {_ALIVE} a)"""
_POOL = f"""(SELECT * FROM (SELECT symbol, week_idx, trail, next_ret, count(*) OVER (PARTITION BY week_idx) AS k FROM {_PAIRS} p WHERE alive AND stays AND trail IS NOT NULL AND next_ret IS NOT NULL {{extra}}) q WHERE k >= 10)"""
_POOLED = """SELECT count(*) AS pairs, round(coalesce(corr(a, b), 0.0), 8) AS rho FROM (SELECT rank() OVER (ORDER BY trail) + (count(*) OVER (PARTITION BY trail) - 1) / 2.0 AS a, rank() OVER (ORDER BY next_ret) + (count(*) OVER (PARTITION BY next_ret) - 1) / 2.0 AS b FROM {pool} x) y"""


def _pooled(pool: DataFrame, x: str, y: str, sample: str) -> DataFrame:
    """Rank correlation of all pairs at once: average ranks from the counts of distinct values, by ranges of the value."""
    ranked = pool.select(x, y)
    for c, name in ((x, "_a"), (y, "_b")):
        ranked = ranked.join(_global_ranks(pool, c, name), c)
    return ranked.agg(F.count(F.lit(1)).alias("pairs"), F.round(pearson("_a", "_b"), 8).alias("rho")).withColumn("sample", F.lit(sample))


def _global_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Average rank of every distinct value over all rows, without a window over all rows: ranges of the value, then the offsets of the ranges."""
    n = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_range", F.floor(F.col(value) * 64))
    sums = n.groupBy("_range").agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(offsets, "_range").select(value, (F.col("_before") + F.col("_in") + (F.col("_n") + 1) / 2).alias(name))


@query(f"""SELECT 'all' AS sample, pairs, rho FROM ({_POOLED.format(pool=_POOL.format(extra=""))}) a UNION ALL SELECT 'survivors', pairs, rho FROM ({_POOLED.format(pool=_POOL.format(extra=f"AND symbol IN (SELECT symbol FROM {WEEKLY} w GROUP BY 1 HAVING max(week_idx) = (SELECT max(week_idx) FROM {WEEKLY} z))"))}) b""")
def pooled_momentum_ic(spark: SparkSession, folder: str) -> DataFrame:
    """Rank correlation of four-week momentum with the week after, pooled, with and without the series that ended: the survivorship bias."""
    w = Window.partitionBy("symbol").orderBy("week_idx")
    p = _alive(spark, folder).withColumn("trail", F.sum("ret").over(w.rowsBetween(-3, 0))).withColumn("stays", F.lead("alive").over(w))
    p = p.where("alive AND stays AND trail IS NOT NULL AND next_ret IS NOT NULL").select("symbol", "week_idx", "trail", "next_ret")
    ends = weekly(spark, folder).groupBy("symbol").agg(F.max("week_idx").alias("_end"))
    last = ends.agg(F.max("_end")).first()[0]
    whole = lambda d: d.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("week_idx"))).where("k >= 10")
    living = p.join(ends.where(F.col("_end") == F.lit(last)), "symbol", "leftsemi")
    return _pooled(whole(p), "trail", "next_ret", "all").unionByName(_pooled(whole(living), "trail", "next_ret", "survivors")).select("sample", "pairs", "rho")


_RK = "rank() OVER (PARTITION BY week_idx ORDER BY {c}) + (count(*) OVER (PARTITION BY week_idx, {c}) - 1) / 2.0"


@query(f"""WITH p AS (SELECT week_idx, {_RK.format(c='ret')} AS x, {_RK.format(c='next_ret')} AS y, {_RK.format(c='turnover')} AS z FROM {RETURNS} r WHERE ret IS NOT NULL AND next_ret IS NOT NULL),
  c AS (SELECT week_idx, count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM p GROUP BY 1 HAVING count(*) >= 5)
  SELECT week_idx, n, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 7) AS partial_ic FROM c""")
def partial_ic(spark: SparkSession, folder: str) -> DataFrame:
    """Rank correlation of a week's with the next week's returns, with turnover's rank taken out of both."""
    p = weekly_returns(spark, folder).where("ret IS NOT NULL AND next_ret IS NOT NULL")
    for c, n in (("ret", "x"), ("next_ret", "y"), ("turnover", "z")):
        p = p.withColumn(n, average_rank(c, ["week_idx"]))
    c = p.groupBy("week_idx").agg(F.count(F.lit(1)).alias("n"), pearson("x", "y").alias("xy"), pearson("x", "z").alias("xz"), pearson("y", "z").alias("yz")).where("n >= 5")
    xz, yz = F.col("xz"), F.col("yz")
    return c.select("week_idx", "n", F.round((F.col("xy") - xz * yz) / F.nullif(F.sqrt((1 - xz * xz) * (1 - yz * yz)), F.lit(0.0)), 7).alias("partial_ic"))


_EIGHTHS = f"""(SELECT symbol, ts // 86400000 AS day, count(*) AS n, sum(CAST(funding_rate AS DECIMAL(38,12))) / count(*) AS mean_rate FROM {QUOTES} q WHERE funding_rate IS NOT NULL GROUP BY 1, 2)"""


@query(f"""WITH d AS (SELECT symbol, n, CAST(mean_rate AS DOUBLE) AS m, CASE WHEN n <= 3 THEN 480 WHEN n <= 12 THEN 240 WHEN n <= 24 THEN 120 ELSE 60 END AS minutes FROM {_EIGHTHS} e)
  SELECT minutes, count(*) AS symbol_days, count(*) FILTER (abs(m - 0.0001 * minutes / 480) < 1e-5) AS hits, round(count(*) FILTER (abs(m - 0.0001 * minutes / 480) < 1e-5) / count(*), 8) AS share FROM d GROUP BY 1""")
def interval_census(spark: SparkSession, folder: str) -> DataFrame:
    """Days by the interval their number of readings implies, and how many have exactly the base rate of that interval."""
    d = quotes(spark, folder).where("funding_rate IS NOT NULL").groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("funding_rate").cast("decimal(38,12)")).cast("double").alias("s"))
    minutes = F.when(F.col("n") <= 3, 480).when(F.col("n") <= 12, 240).when(F.col("n") <= 24, 120).otherwise(60)
    d = d.withColumn("minutes", minutes).withColumn("hit", F.abs(F.col("s") / F.col("n") - 0.0001 * F.col("minutes") / 480) < 1e-5)
    return d.groupBy("minutes").agg(F.count(F.lit(1)).alias("symbol_days"), F.count_if("hit").alias("hits"), F.round(F.count_if("hit") / F.count(F.lit(1)), 8).alias("share"))


@query(f"""SELECT week_idx, count(*) AS n, round(avg((abs(k) < 0.05)::INT), 8) AS lump_share, round(avg((k <= -0.05)::INT), 8) AS neg_share, round(avg((k >= 0.05)::INT), 8) AS pos_share, avg((k <= -0.05)::INT) < 0.1 AS low_degenerate, avg((k >= 0.05)::INT) < 0.1 AS high_degenerate
  FROM (SELECT week_idx, round(ret, 9) AS k FROM {_ALIVE} a WHERE alive AND ret IS NOT NULL) x GROUP BY 1""")
def decile_degeneration(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of the sort key at, below and above its lump per week, and whether a decile reaches into the lump."""
    k = F.round("ret", 9)
    g = _alive(spark, folder).where("alive AND ret IS NOT NULL").groupBy("week_idx").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c.cast("int")).alias(n) for n, c in (("lump", F.abs(k) < 0.05), ("neg", k <= -0.05), ("pos", k >= 0.05))])
    return g.select("week_idx", "n", *[F.round(c, 8).alias(f"{c}_share") for c in ("lump", "neg", "pos")], (F.col("neg") < 0.1).alias("low_degenerate"), (F.col("pos") < 0.1).alias("high_degenerate"))


@query("""WITH v AS (SELECT n_regionkey AS exchange, c_nationkey AS series, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), s AS (SELECT *, sum(v * v) OVER () AS t FROM v)
  SELECT exchange, round(sum(v * v / t), 8) AS load, row_number() OVER (ORDER BY round(sum(v * v / t), 8) DESC, exchange) = 1 AS dominant FROM s GROUP BY 1""")
def exchange_load(spark: SparkSession, folder: str) -> DataFrame:
    """Share of a vector's squared length that each group of series carries; ties of the largest go by name. One row per group goes into the window."""
    v = table(spark, folder, "customer").join(table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("exchange")), "c_nationkey").groupBy("exchange", "c_nationkey").agg(F.avg("c_acctbal").alias("v"))
    g = v.groupBy("exchange").agg(F.sum(F.col("v") * F.col("v")).alias("s"))
    every = Window.partitionBy(F.lit(0))
    g = g.withColumn("load", F.round(F.col("s") / F.sum("s").over(every), 8))
    return g.select("exchange", "load", (F.row_number().over(every.orderBy(F.desc("load"), "exchange")) == 1).alias("dominant"))


@query(f"""SELECT symbol, day_no FROM (SELECT symbol, day_no, row_number() OVER w AS i, count(r) OVER (PARTITION BY symbol ORDER BY day_no ROWS 9 PRECEDING) AS back, count(r) OVER (PARTITION BY symbol ORDER BY day_no ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead FROM (
  SELECT symbol, day_no, CASE WHEN day_no - lag(day_no) OVER (PARTITION BY symbol ORDER BY day_no) <= 4 THEN ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY day_no)) END AS r FROM {DAILY} d) x WINDOW w AS (PARTITION BY symbol ORDER BY day_no)) y WHERE back = 10 AND ahead = 5 AND (i - 10) % 2 = 0""")
def anchor_validity(spark: SparkSession, folder: str) -> DataFrame:
    """Every second day that has all ten returns up to it and all five after it; a return over a gap of more than four days is none."""
    w = Window.partitionBy("symbol").orderBy("day_no")
    r = daily(spark, folder).withColumn("r", F.when(F.col("day_no") - F.lag("day_no").over(w) <= 4, F.ln("close") - F.ln(F.lag("close").over(w))))
    x = r.withColumn("i", F.row_number().over(w)).withColumn("back", F.count("r").over(w.rowsBetween(-9, 0))).withColumn("ahead", F.count("r").over(w.rowsBetween(1, 5)))
    return x.where("back = 10 AND ahead = 5 AND (i - 10) % 2 = 0").select("symbol", "day_no")


@query(f"""WITH j AS (SELECT a.symbol AS a, b.symbol AS b, a.day_no, a.close AS x, b.close AS y FROM {DAILY} a JOIN {DAILY} b ON a.day_no = b.day_no AND a.symbol < b.symbol)
  SELECT a, b, count(dx) AS n, round(coalesce(nullif(corr(dx, dy), 'nan'), 0.0), 7) AS r FROM (SELECT a, b, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM j WINDOW w AS (PARTITION BY a, b ORDER BY day_no)) d GROUP BY 1, 2 HAVING count(dx) > 0""")
def differenced_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of daily series on the days both have, differenced there, and their correlation."""
    d = daily(spark, folder)
    a, b = d.select(F.col("symbol").alias("a"), "day_no", F.col("close").alias("x")), d.select(F.col("symbol").alias("b"), "day_no", F.col("close").alias("y"))
    w = Window.partitionBy("a", "b").orderBy("day_no")
    j = a.join(b, "day_no").where("a < b").select("a", "b", (F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("y") - F.lag("y").over(w)).alias("dy")).where("dx IS NOT NULL")
    return j.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.round(pearson("dx", "dy"), 7).alias("r"))


@query(f"SELECT symbol, CAST(ts // 1000 AS BIGINT) AS sec, arg_max(price, (ts, price)) AS px, count(*) AS n_raw, count(size) AS n_parsed FROM {FILLS} f GROUP BY 1, 2")
def last_price_per_second(spark: SparkSession, folder: str) -> DataFrame:
    """Last price of each second, with how many trades it had and how many of them a size."""
    return fills(spark, folder).groupBy("symbol", F.floor(F.col("ts") / 1000).alias("sec")).agg(F.max_by("price", F.struct("ts", "price")).alias("px"), F.count(F.lit(1)).alias("n_raw"), F.count("size").alias("n_parsed"))


@query(f"""SELECT DISTINCT day_no FROM (SELECT day_no FROM (SELECT symbol, day_no, close >= quantile_cont(close, 0.9) OVER (PARTITION BY symbol ORDER BY day_no RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS flag FROM {DAILY} d) x WHERE flag UNION ALL SELECT unnest([9500, 9600])) u""")
def flagged_days_union(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which any series is flagged, together with days named from outside."""
    from tideglass.plans.panel_queries import roll_pctl_flag

    named = spark.createDataFrame([(9500,), (9600,)], "day_no int")
    return roll_pctl_flag(spark, folder).where("flag").select("day_no").union(named).distinct()


@query("""SELECT o_orderpriority AS cell, o_orderkey AS seed, o_totalprice AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) x WHERE rn = (n - 1) // 2 + 1""")
def median_seed(spark: SparkSession, folder: str) -> DataFrame:
    """The run whose score is the (lower) median of its cell."""
    w = Window.partitionBy("o_orderpriority")
    x = table(spark, folder, "orders").withColumn("rn", F.row_number().over(w.orderBy("o_totalprice", "o_orderkey"))).withColumn("n", F.count(F.lit(1)).over(w))
    return x.where("rn = floor((n - 1) / 2) + 1").select(F.col("o_orderpriority").alias("cell"), F.col("o_orderkey").alias("seed"), F.col("o_totalprice").alias("score"))


_TILT = """(SELECT symbol, ts, CAST(ts // 86400000 AS BIGINT) AS day, round(CAST(b - a AS DOUBLE) / CAST(b + a AS DOUBLE), 8) AS tilt FROM (SELECT symbol, ts, sum(CAST(size AS DECIMAL(38,12))) FILTER (lower(side) = 'bid') AS b, sum(CAST(size AS DECIMAL(38,12))) FILTER (lower(side) = 'ask') AS a
  FROM (SELECT DISTINCT row_id, symbol, ts, side, size FROM orderbook_snapshots WHERE size > 0) x GROUP BY 1, 2) s WHERE b IS NOT NULL AND a IS NOT NULL)"""


@query(f"SELECT symbol, day, count(*) AS n, round(quantile_cont(tilt, 0.5), 7) + 0.0 AS median_tilt, round(count(DISTINCT ts // 60000) / 1440.0, 8) AS coverage FROM {_TILT} t GROUP BY 1, 2")
def daily_tilt(spark: SparkSession, folder: str) -> DataFrame:
    """Median tilt of a day's snapshots and the share of its minutes that have one."""
    size = F.col("size").cast("decimal(38,12)")
    rows = table(spark, folder, "orderbook_snapshots").where("size > 0").select("row_id", "symbol", "ts", F.lower("side").alias("side"), "size").distinct()
    s = rows.groupBy("symbol", "ts").agg(F.sum(F.when(F.col("side") == "bid", size)).alias("b"), F.sum(F.when(F.col("side") == "ask", size)).alias("a")).where("b IS NOT NULL AND a IS NOT NULL")
    t = s.withColumn("tilt", F.round((F.col("b") - F.col("a")).cast("double") / (F.col("b") + F.col("a")).cast("double"), 8))
    g = t.groupBy("symbol", F.floor(F.col("ts") / 86_400_000).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.percentile("tilt", 0.5).alias("m"), F.count_distinct(F.floor(F.col("ts") / 60_000)).alias("k"))
    return g.select("symbol", "day", "n", (F.round("m", 7) + 0.0).alias("median_tilt"), F.round(F.col("k") / 1440.0, 8).alias("coverage"))


@query(f"SELECT symbol, count(*) AS n, round(avg(hit), 8) AS balanced_accuracy FROM (SELECT symbol, ret > 0 AS y, avg((sign(ret) = sign(next_ret))::INT) AS hit FROM {RETURNS} r WHERE ret <> 0 AND next_ret <> 0 GROUP BY 1, 2) x GROUP BY 1".replace("ret > 0 AS y", "next_ret > 0 AS y"))
def balanced_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Mean recall over the classes of the sign of next week's return, guessed by this week's; ``n`` classes."""
    r = weekly_returns(spark, folder).where("ret <> 0 AND next_ret <> 0")
    c = r.groupBy("symbol", (F.col("next_ret") > 0).alias("y")).agg(F.avg((F.signum("ret") == F.signum("next_ret")).cast("int")).alias("hit"))
    return c.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 8).alias("balanced_accuracy"))


def binomial_tail(k: Column, n: Column) -> Column:
    """P(Bin(n, 1/2) >= k) exactly as a sum of exp of log terms; 1 where n is 0."""
    log_choose = lambda i: F.aggregate(F.sequence(F.lit(1), F.greatest(i, F.lit(1))), F.lit(0.0), lambda a, j: a + F.when(j <= i, F.ln((n - i + j).cast("double")) - F.ln(j.cast("double"))).otherwise(0.0))
    tail = F.aggregate(F.sequence(k.cast("int"), F.greatest(n, k).cast("int")), F.lit(0.0), lambda a, i: a + F.when(i <= n, F.exp(log_choose(i) - n * math.log(2))).otherwise(0.0))
    return F.when(n <= 0, 1.0).otherwise(F.least(F.lit(1.0), tail))


@query(f"""WITH c AS (SELECT symbol, count(*) AS pairs, count(*) FILTER (next_ret > ret) AS greater, count(*) FILTER (next_ret = ret) AS ties FROM (SELECT symbol, round(ret, 9) AS ret, round(next_ret, 9) AS next_ret FROM {RETURNS} r WHERE ret IS NOT NULL AND next_ret IS NOT NULL) x GROUP BY 1),
  t AS (SELECT *, pairs - ties AS n FROM c)
  SELECT symbol, pairs, greater, ties, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(generate_series(greater, n), lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2))))) END, 7) AS p FROM t""")
def sign_test(spark: SparkSession, folder: str) -> DataFrame:
    """Exact one-sided paired sign test of a week's return against the next one's; ties are dropped."""
    r = weekly_returns(spark, folder).select("symbol", F.round("ret", 9).alias("ret"), F.round("next_ret", 9).alias("next_ret")).where("ret IS NOT NULL AND next_ret IS NOT NULL")
    c = r.groupBy("symbol").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("next_ret") > F.col("ret")).alias("greater"), F.count_if(F.col("next_ret") == F.col("ret")).alias("ties"))
    return c.withColumn("p", F.round(binomial_tail(F.col("greater"), F.col("pairs") - F.col("ties")), 7))


@query(f"""WITH c AS (SELECT symbol, week_idx, {", ".join(f"round(sum(ret) OVER (PARTITION BY symbol ORDER BY week_idx ROWS {k - 1} PRECEDING), 9) AS mom{k}" for k in (1, 2, 4))}, round(-lag(ret) OVER (PARTITION BY symbol ORDER BY week_idx), 9) AS rev_gap FROM {RETURNS} r) SELECT * FROM c""")
def momentum_family(spark: SparkSession, folder: str) -> DataFrame:
    """Momentum over one, two and four weeks (short heads allowed) and reversal with a week left out."""
    w = Window.partitionBy("symbol").orderBy("week_idx")
    r = weekly_returns(spark, folder)
    return r.select("symbol", "week_idx", *[F.round(F.sum("ret").over(w.rowsBetween(1 - k, 0)), 9).alias(f"mom{k}") for k in (1, 2, 4)], F.round(-F.lag("ret").over(w), 9).alias("rev_gap"))


@query(f"""WITH d AS (SELECT week_idx, ret, row_number() OVER (PARTITION BY week_idx ORDER BY md5(CAST(symbol AS VARCHAR) || '/' || CAST(week_idx AS VARCHAR)), symbol) AS rn, count(*) OVER (PARTITION BY week_idx) AS n FROM {RETURNS} r WHERE ret IS NOT NULL),
  l AS (SELECT week_idx, avg(ret) FILTER (rn > n - greatest(1, n // 10)) - avg(ret) FILTER (rn <= greatest(1, n // 10)) AS ls FROM d WHERE n >= 10 GROUP BY 1)
  SELECT count(*) AS weeks, round(stddev_samp(ls), 8) AS sigma_ls FROM l""")
def random_long_short(spark: SparkSession, folder: str) -> DataFrame:
    """Spread of a decile long/short on an uninformative key (a hash of series and week)."""
    w = Window.partitionBy("week_idx")
    key = F.md5(F.concat(F.col("symbol").cast("string"), F.lit("/"), F.col("week_idx").cast("string")))
    d = weekly_returns(spark, folder).where("ret IS NOT NULL").withColumn("rn", F.row_number().over(w.orderBy(key, "symbol"))).withColumn("n", F.count(F.lit(1)).over(w)).where("n >= 10")
    leg = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    ls = d.groupBy("week_idx").agg((F.avg(F.when(F.col("rn") > F.col("n") - leg, F.col("ret"))) - F.avg(F.when(F.col("rn") <= leg, F.col("ret")))).alias("ls"))
    return ls.agg(F.count(F.lit(1)).alias("weeks"), F.round(F.stddev_samp("ls"), 8).alias("sigma_ls"))


@query(f"""WITH b AS (SELECT week_idx, ret, next_ret, (10 * row_number() OVER (PARTITION BY week_idx ORDER BY turnover, symbol) - 1) // count(*) OVER (PARTITION BY week_idx) AS d FROM {RETURNS} r WHERE ret IS NOT NULL AND next_ret IS NOT NULL),
  i AS (SELECT week_idx, corr(x, y) AS ic FROM (SELECT week_idx, {_RK.format(c='ret')} AS x, {_RK.format(c='next_ret')} AS y FROM b WHERE d > 0) z GROUP BY 1 HAVING count(*) >= 5) SELECT count(*) AS weeks, round(avg(ic), 8) AS mean_ic FROM i""")
def liquidity_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    """Mean weekly rank correlation with each week's lowest decile of turnover left out."""
    b = weekly_returns(spark, folder).where("ret IS NOT NULL AND next_ret IS NOT NULL").withColumn("d", floor_bucket(["week_idx"], [F.col("turnover"), F.col("symbol")], 10)).where("d > 0")
    return spearman(b, ["week_idx"], "ret", "next_ret").where("n >= 5").agg(F.count(F.lit(1)).alias("weeks"), F.round(F.avg("ic"), 8).alias("mean_ic"))


_FLOW = f"""(SELECT m.symbol, m.day, m.m, r.ret, flow FROM (SELECT symbol, CAST(ts // 86400000 AS BIGINT) AS day, CAST(ts // 60000 AS BIGINT) AS m, CAST(coalesce(sum(CASE side WHEN 'buy' THEN CAST(size AS DECIMAL(38,12)) WHEN 'sell' THEN -CAST(size AS DECIMAL(38,12)) END), 0) AS DOUBLE) AS flow FROM {FILLS} f GROUP BY 1, 2, 3) m JOIN {_MRET} r ON m.symbol = r.symbol AND m.m = r.m)"""


@query(f"""SELECT symbol, day, count(*) AS n, round(coalesce(nullif(corr(x, y), 'nan'), 0.0), 7) AS ic FROM (SELECT symbol, day, rank() OVER (PARTITION BY symbol, day ORDER BY flow) + (count(*) OVER (PARTITION BY symbol, day, flow) - 1) / 2.0 AS x, rank() OVER (PARTITION BY symbol, day ORDER BY round(ret, 10)) + (count(*) OVER (PARTITION BY symbol, day, round(ret, 10)) - 1) / 2.0 AS y FROM {_FLOW} f WHERE ret IS NOT NULL) z GROUP BY 1, 2 HAVING count(*) >= 30""")
def flow_impact_ic(spark: SparkSession, folder: str) -> DataFrame:
    """Daily rank correlation of signed volume with the return of the same minute; days of thirty minutes or more."""
    size = bars.exact("size")
    flow = fills(spark, folder).groupBy("symbol", F.floor(F.col("ts") / 60_000).alias("m")).agg(F.coalesce(F.sum(F.when(F.col("side") == "buy", size).when(F.col("side") == "sell", -size)), F.lit(0)).cast("double").alias("flow"))
    r = _minute_returns(spark, folder).select("symbol", "day", "m", F.round("ret", 10).alias("ret"))
    return spearman(r.join(flow, ["symbol", "m"]), ["symbol", "day"], "flow", "ret").where("n >= 30").select("symbol", "day", "n", (F.round("ic", 7) + 0.0).alias("ic"))


@query(f"""WITH z AS (SELECT week_idx, symbol, next_ret, coalesce((ret - avg(ret) OVER w) / nullif(stddev_pop(ret) OVER w, 0), 0.0) AS z, sqrt(avg(ret * ret) OVER w) AS rv FROM {RETURNS} r WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY week_idx)),
  c AS (SELECT quantile_cont(rv, 0.9) AS cut FROM (SELECT DISTINCT week_idx, rv FROM z) y)
  SELECT week_idx, symbol, round(z, 6) AS z, round(-sign(round(z, 6)) * next_ret, 8) + 0.0 AS reversion, abs(round(z, 6)) >= 1 AS stretched, round(rv, 9) <= round(cut, 9) AS calm, abs(round(z, 6)) >= 1 AND round(rv, 9) <= round(cut, 9) AS conditioned FROM z, c WHERE next_ret IS NOT NULL""")
def event_table_z(spark: SparkSession, folder: str) -> DataFrame:
    """Reversion after a stretched week, conditioned on weeks outside the most volatile tenth."""
    w = Window.partitionBy("week_idx")
    r = weekly_returns(spark, folder).where("ret IS NOT NULL")
    z = r.withColumn("z", F.round(F.coalesce((F.col("ret") - F.avg("ret").over(w)) / F.nullif(F.stddev_pop("ret").over(w), F.lit(0.0)), F.lit(0.0)), 6)).withColumn("rv", F.sqrt(F.avg(F.col("ret") * F.col("ret")).over(w)))
    cut = r.groupBy("week_idx").agg(F.sqrt(F.avg(F.col("ret") * F.col("ret"))).alias("rv")).agg(F.percentile("rv", 0.9)).first()[0]
    stretched, calm = F.abs("z") >= 1, F.round("rv", 9) <= F.round(F.lit(cut), 9)
    return z.where("next_ret IS NOT NULL").select("week_idx", "symbol", "z", (F.round(-F.signum("z") * F.col("next_ret"), 8) + 0.0).alias("reversion"), stretched.alias("stretched"), calm.alias("calm"), (stretched & calm).alias("conditioned"))


@query(f"""WITH r AS (SELECT week_idx, symbol, next_ret, (10 * row_number() OVER (PARTITION BY week_idx ORDER BY round(ret, 9), symbol) - 1) // count(*) OVER (PARTITION BY week_idx) AS d FROM {RETURNS} x WHERE ret IS NOT NULL)
  SELECT CAST(d AS INTEGER) AS decile, count(*) AS n, round(avg(CASE WHEN d < 5 THEN next_ret ELSE -next_ret END), 8) AS reversion FROM r WHERE next_ret IS NOT NULL GROUP BY 1""")
def event_table_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Mean reversion by decile of the week's return: bought below the middle, sold above it."""
    r = weekly_returns(spark, folder).where("ret IS NOT NULL").withColumn("decile", floor_bucket(["week_idx"], [F.round("ret", 9), F.col("symbol")], 10)).where("next_ret IS NOT NULL")
    return r.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("decile") < 5, F.col("next_ret")).otherwise(-F.col("next_ret"))), 8).alias("reversion"))


@query(f"""WITH r AS (SELECT symbol, day_no, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY day_no)) AS r FROM {DAILY} d), m AS (SELECT symbol, day_no, count(r) OVER w AS n, avg(r) OVER w AS mu, list(r) OVER w AS v FROM r WINDOW w AS (PARTITION BY symbol ORDER BY day_no ROWS 19 PRECEDING)),
  s AS (SELECT symbol, day_no, list_sum(list_transform(v, lambda x: power(x - mu, 2))) AS s2, list_sum(list_transform(v, lambda x: power(x - mu, 3))) AS s3, list_sum(list_transform(v, lambda x: power(x - mu, 4))) AS s4 FROM m WHERE n = 20)
  SELECT symbol, day_no, round(20 * sqrt(19) / 18 * s3 / power(s2, 1.5), 5) AS skew, round(20 * 21 * 19.0 / (18 * 17) * s4 / (s2 * s2) - 3 * 19 * 19.0 / (18 * 17), 5) AS kurt FROM s""")
def rolling_shape(spark: SparkSession, folder: str) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis of the last twenty returns, full windows only."""
    w = Window.partitionBy("symbol").orderBy("day_no")
    r = daily(spark, folder).withColumn("r", F.ln("close") - F.ln(F.lag("close").over(w)))
    f = w.rowsBetween(-19, 0)
    m = r.select("symbol", "day_no", F.count("r").over(f).alias("n"), F.avg("r").over(f).alias("mu"), F.collect_list("r").over(f).alias("v")).where("n = 20")
    s = lambda k: F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(x - F.col("mu"), F.lit(k)))
    s2 = F.col("s2")
    x = m.select("symbol", "day_no", s(2).alias("s2"), s(3).alias("s3"), s(4).alias("s4"))
    return x.select("symbol", "day_no", F.round(20 * math.sqrt(19) / 18 * F.col("s3") / F.pow(s2, F.lit(1.5)), 5).alias("skew"), F.round(20 * 21 * 19.0 / (18 * 17) * F.col("s4") / (s2 * s2) - 3 * 19 * 19.0 / (18 * 17), 5).alias("kurt"))


@query(f"""WITH h AS (SELECT symbol, CAST(ts // 3600000 AS BIGINT) AS h, ln(1 + count(*)) AS a FROM {FILLS} f GROUP BY 1, 2), e AS (SELECT symbol, h, a - avg(a) OVER (PARTITION BY symbol) AS e FROM h), p AS (SELECT symbol, e AS e0, CASE WHEN lead(h) OVER w = h + 1 THEN lead(e) OVER w END AS e1 FROM e WINDOW w AS (PARTITION BY symbol ORDER BY h)),
  f AS (SELECT symbol, count(*) AS n_pairs, sum(e0 * e1) / nullif(sum(e0 * e0), 0) AS phi FROM p WHERE e1 IS NOT NULL GROUP BY 1)
  SELECT symbol, n_pairs, round(phi, 7) AS phi, round(CASE WHEN n_pairs >= 3 AND phi > 1e-6 THEN -ln(phi) END, 6) AS decay_per_h, round(CASE WHEN n_pairs >= 3 AND phi > 1e-6 AND phi < 1 THEN ln(2) / -ln(phi) END, 5) AS half_life_h FROM f""")
def relaxation_fit(spark: SparkSession, folder: str) -> DataFrame:
    """How fast a symbol's excess activity decays: first-order fit through the origin over consecutive hours; no decay has no half-life."""
    w = Window.partitionBy("symbol").orderBy("h")
    h = fills(spark, folder).groupBy("symbol", F.floor(F.col("ts") / 3_600_000).alias("h")).agg(F.ln(1 + F.count(F.lit(1))).alias("a"))
    e = h.withColumn("e0", F.col("a") - F.avg("a").over(Window.partitionBy("symbol"))).withColumn("e1", F.when(F.lead("h").over(w) == F.col("h") + 1, F.lead("e0").over(w))).where("e1 IS NOT NULL")
    f = e.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_pairs"), (F.sum(F.col("e0") * F.col("e1")) / F.nullif(F.sum(F.col("e0") * F.col("e0")), F.lit(0.0))).alias("phi"))
    known, lam = (F.col("n_pairs") >= 3) & (F.col("phi") > 1e-6), -F.ln("phi")
    return f.select("symbol", "n_pairs", F.round("phi", 7).alias("phi"), F.round(F.when(known, lam), 6).alias("decay_per_h"), F.round(F.when(known & (F.col("phi") < 1), math.log(2) / lam), 5).alias("half_life_h"))


@query(f"""WITH h AS (SELECT symbol, CAST(ts // 3600000 AS BIGINT) AS h, ln(1 + count(*)) AS a FROM {FILLS} f GROUP BY 1, 2), s AS (SELECT symbol, h, a - quantile_cont(a, 0.5) OVER (PARTITION BY symbol) AS e FROM h), k AS (SELECT symbol, h AS h0, abs(e) AS e0 FROM s WHERE e > 0.5)
  SELECT k.symbol, h0, CAST(coalesce(min(s.h - h0) FILTER (abs(s.e) <= 0.5 * e0), 6) AS BIGINT) AS hours, count(*) FILTER (abs(s.e) <= 0.5 * e0) = 0 AS censored FROM k LEFT JOIN s ON s.symbol = k.symbol AND s.h > h0 AND s.h <= h0 + 6 GROUP BY k.symbol, h0""")
def time_to_return(spark: SparkSession, folder: str) -> DataFrame:
    """Hours until the excess of a busy hour has halved, censored after six; each row looks at six hours after it."""
    h = fills(spark, folder).groupBy("symbol", F.floor(F.col("ts") / 3_600_000).alias("h")).agg(F.ln(1 + F.count(F.lit(1))).alias("a"))
    s = h.join(h.groupBy("symbol").agg(F.percentile("a", 0.5).alias("m")), "symbol").select("symbol", "h", (F.col("a") - F.col("m")).alias("e"))
    near = F.collect_list(F.struct("h", "e")).over(Window.partitionBy("symbol").orderBy("h").rangeBetween(1, 6))
    back = F.filter(near, lambda x: F.abs(x["e"]) <= 0.5 * F.abs("e"))
    k = s.withColumn("back", back).where("e > 0.5")
    return k.select("symbol", F.col("h").alias("h0"), F.coalesce(F.array_min(F.transform("back", lambda x: x["h"])) - F.col("h"), F.lit(6)).cast("long").alias("hours"), (F.size("back") == 0).alias("censored"))


@query(f"""SELECT symbol, CAST(floor((u - 1e-12) * 10) AS BIGINT) AS bin, count(*) AS n FROM (SELECT symbol, rank() OVER (PARTITION BY week_idx ORDER BY ret, symbol) / (count(*) OVER (PARTITION BY week_idx) + 1.0) AS u FROM {RETURNS} r WHERE ret IS NOT NULL) x GROUP BY 1, 2""")
def rank_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """In which tenth of the weeks' cross-section a series lay, and how often."""
    w = Window.partitionBy("week_idx")
    u = F.rank().over(w.orderBy("ret", "symbol")) / (F.count(F.lit(1)).over(w) + 1)
    x = weekly_returns(spark, folder).where("ret IS NOT NULL").withColumn("u", u)
    return x.groupBy("symbol", F.floor((F.col("u") - 1e-12) * 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT symbol, day, round(sqrt(sum(ret * ret) * 365), 8) AS annual_vol FROM {_MRET} r GROUP BY 1, 2 HAVING count(ret) >= 5""")
def annualised_volatility(spark: SparkSession, folder: str) -> DataFrame:
    """Realised volatility of a day's minutes as an annual figure."""
    r = bars.realised(_minute_returns(spark, folder), ["symbol", "day"], least=5).where("rv IS NOT NULL")
    return r.select("symbol", "day", F.round(F.sqrt(F.col("rv") * 365), 8).alias("annual_vol"))


@query(f"""SELECT trade_id, n5, round(v5, 6) AS v5 FROM (SELECT trade_id, count(*) OVER w AS n5, CAST(coalesce(sum(CAST(size AS DECIMAL(38,12))) OVER w, 0) AS DOUBLE) AS v5 FROM {FILLS} f WINDOW w AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN 5000 PRECEDING AND CURRENT ROW)) x""")
def recent_trades_buffer(spark: SparkSession, folder: str) -> DataFrame:
    """What a buffer of the last five seconds holds at each trade: how many trades and their volume."""
    from tideglass.operators.blocks import with_trailing

    t = with_trailing(fills(spark, folder), ["symbol"], "ts", 5000, 0, {"n5": F.count(F.lit(1)), "v5": F.sum(bars.exact("size"))})
    return t.select("trade_id", "n5", F.round(F.coalesce("v5", F.lit(0)).cast("double"), 6).alias("v5"))


@query(f"""SELECT symbol, day_no, q05, q95 FROM (SELECT symbol, day_no, round(quantile_cont(close, 0.05) OVER w, 6) AS q05, round(quantile_cont(close, 0.95) OVER w, 6) AS q95, count(*) OVER w AS n FROM {DAILY} d WINDOW w AS (PARTITION BY symbol ORDER BY day_no ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) x WHERE n >= 20""")
def rolling_tail_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Fifth and ninety-fifth percentile of the sixty values before each, from twenty on."""
    w = Window.partitionBy("symbol").orderBy("day_no").rowsBetween(-60, -1)
    x = daily(spark, folder).select("symbol", "day_no", F.percentile("close", F.array(F.lit(0.05), F.lit(0.95))).over(w).alias("q"), F.count(F.lit(1)).over(w).alias("n")).where("n >= 20")
    return x.select("symbol", "day_no", F.round(F.col("q")[0], 6).alias("q05"), F.round(F.col("q")[1], 6).alias("q95"))


@query("""WITH d AS (SELECT vec_id % 5 AS day, label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings), m AS (SELECT day, label, i, avg(CAST(v AS DOUBLE)) AS v FROM d GROUP BY 1, 2, 3)
  SELECT a.day, a.label AS a, b.label AS b, round(1 - sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 7) AS distance FROM m a JOIN m b ON a.day = b.day AND a.i = b.i AND a.label < b.label GROUP BY 1, 2, 3""")
def daily_embedding_distance(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine distance between the mean embeddings of every two labels per day (vec_id modulo five stands in for the day)."""
    d = table(spark, folder, "embeddings").select((F.col("vec_id") % 5).alias("day"), "label", F.posexplode("embedding").alias("i", "v"))
    m = d.groupBy("day", "label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    own = m.groupBy("day", "label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("e")).select("day", "label", F.transform("e", lambda x: x["v"]).alias("e"))
    a, b = own.select("day", F.col("label").alias("a"), F.col("e").alias("ea")), own.select("day", F.col("label").alias("b"), F.col("e").alias("eb"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return a.join(b, "day").where("a < b").select("day", "a", "b", F.round(1 - dot("ea", "eb") / F.sqrt(dot("ea", "ea") * dot("eb", "eb")), 7).alias("distance"))


@query()
def permutation_drop(spark: SparkSession, folder: str) -> DataFrame:
    """How far the rolling permutation entropy of the closes has fallen below its own median of the sixty values before."""
    import numpy as np

    from tideglass.functions import kernels as k

    def drop(t, x):
        pe = k.rolling_permutation_entropy(x, 30, 3)
        base = np.array([np.median(pe[max(0, i - 60) : i]) if i >= 20 and np.isfinite(pe[max(0, i - 60) : i]).all() else np.nan for i in range(len(pe))])
        return {"at": t, "value": base - pe}

    closes = daily(spark, folder).select("symbol", "day_no", F.ln("close").alias("x"))
    return per_series(closes, ["symbol"], ["day_no"], ["x"], drop, "at double, value double")
