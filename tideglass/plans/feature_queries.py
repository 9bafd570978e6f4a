"""Queries of rolling features, buckets, folds, tokens and panel reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.functions.events import DAY_MS
from tideglass.operators import bars
from tideglass.operators.blocks import with_previous, with_trailing
from tideglass.operators.ranks import exact_percentiles, floor_bucket, spearman
from tideglass.plans.registry import query
from tideglass.plans.views import DAILY, FILLS, QUOTES, RETURNS, WEEKLY, daily, fills, quotes, weekly, weekly_returns
from tideglass.sources.tables import table


def _day():
    return Window.partitionBy("symbol").orderBy("day_no")


_HALF = f"(SELECT symbol, CAST(ts // 1800000 AS BIGINT) AS b, arg_max(price, (ts, price)) AS px FROM {FILLS} f GROUP BY 1, 2)"


def _half_hours(spark: SparkSession, folder: str) -> DataFrame:
    return fills(spark, folder).groupBy("symbol", F.floor(F.col("ts") / 1_800_000).alias("b")).agg(F.max_by("price", F.struct("ts", "price")).alias("px"))


@query(f"SELECT symbol, b, round(CASE WHEN b - lag(b) OVER w = 1 THEN ln(px) - ln(lag(px) OVER w) END, 9) AS ret FROM {_HALF} h WINDOW w AS (PARTITION BY symbol ORDER BY b)")
def half_hour_returns(spark: SparkSession, folder: str) -> DataFrame:
    """Log returns of half-hour closes over consecutive half hours only."""
    r = bars.log_returns(_half_hours(spark, folder), ["symbol"], "b", "px", consecutive_only=True)
    return r.select("symbol", "b", F.round("ret", 9).alias("ret"))


@query(f"SELECT a.symbol AS left_symbol, z.symbol AS right_symbol, a.b, a.px AS left_px, z.px AS right_px FROM {_HALF} a JOIN {_HALF} z ON a.b = z.b WHERE a.symbol < z.symbol")
def shared_grid_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of series side by side on the buckets both have."""
    h = _half_hours(spark, folder)
    one = lambda n: h.select("b", F.col("symbol").alias(f"{n}_symbol"), F.col("px").alias(f"{n}_px"))
    return one("left").join(one("right"), "b").where("left_symbol < right_symbol")


@query(
    f"""WITH r AS (SELECT symbol, day_no, turnover, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY day_no)) AS r FROM {DAILY} d)
  SELECT symbol, day_no, round(CASE WHEN count(r) OVER w = 10 THEN sqrt(sum(r * r) OVER w) END, 8) AS rv10, round(CASE WHEN count(r) OVER w = 10 THEN avg(r) OVER w END, 9) AS mean10,
  round(CASE WHEN count(r) OVER w = 10 THEN turnover / nullif(avg(turnover) OVER w, 0) END, 7) AS volume_ratio, round(sin(2 * pi() * ((day_no + 3) % 7) / 7.0), 9) AS week_sin FROM r WINDOW w AS (PARTITION BY symbol ORDER BY day_no ROWS 9 PRECEDING)"""
)
def rolling_features(spark: SparkSession, folder: str) -> DataFrame:
    """Rolling measures that need their whole window: null until it is full."""
    r = daily(spark, folder).withColumn("r", F.ln("close") - F.ln(F.lag("close").over(_day())))
    w = _day().rowsBetween(-9, 0)
    full = lambda c: F.when(F.count("r").over(w) == 10, c)
    return r.select(
        "symbol", "day_no", F.round(full(F.sqrt(F.sum(F.col("r") * F.col("r")).over(w))), 8).alias("rv10"), F.round(full(F.avg("r").over(w)), 9).alias("mean10"),
        F.round(full(F.col("turnover") / F.nullif(F.avg("turnover").over(w), F.lit(0.0))), 7).alias("volume_ratio"), F.round(F.sin(2 * F.pi() * F.pmod(F.col("day_no") + 3, F.lit(7)) / 7.0), 9).alias("week_sin"),
    )


@query(f"""SELECT tick_id, round(stddev_pop(funding_rate) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN 86400000 PRECEDING AND 1 PRECEDING), 7) AS sigma FROM {QUOTES} q WHERE funding_rate IS NOT NULL""")
def trailing_sigma_24h(spark: SparkSession, folder: str) -> DataFrame:
    """Spread of the last 24 hours' funding, readings of the same ms excluded."""
    q = with_trailing(quotes(spark, folder).where("funding_rate IS NOT NULL"), ["symbol"], "ts", DAY_MS, -1, {"s": F.stddev_pop("funding_rate")})
    return q.select("tick_id", F.round("s", 7).alias("sigma"))


@query(f"""SELECT symbol, day_no, round(close, 6) AS close, CASE WHEN count(*) OVER w >= 20 THEN close > quantile_cont(close, 0.9) OVER w END AS above_q90 FROM {DAILY} d WINDOW w AS (PARTITION BY symbol ORDER BY day_no ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""")
def rolling_quantile_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a value exceeds the 90th percentile of the sixty before it; null with fewer than twenty."""
    w = _day().rowsBetween(-60, -1)
    flag = F.when(F.count(F.lit(1)).over(w) >= 20, F.col("close") > F.percentile("close", 0.9).over(w))
    return daily(spark, folder).select("symbol", "day_no", F.round("close", 6).alias("close"), flag.alias("above_q90"))


@query(f"""SELECT symbol, week_idx, n_days, round(sd, 9) AS vol, round(mx, 9) AS largest FROM (SELECT symbol, CAST(floor((day_no + 3) / 7.0) AS BIGINT) AS week_idx, count(r) AS n_days, CASE WHEN count(r) >= 2 THEN stddev_samp(r) END AS sd, max(r) AS mx FROM (
  SELECT symbol, day_no, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY day_no)) AS r FROM {DAILY} d) x GROUP BY 1, 2) y""")
def weekly_volatility(spark: SparkSession, folder: str) -> DataFrame:
    r = daily(spark, folder).withColumn("r", F.ln("close") - F.ln(F.lag("close").over(_day())))
    g = r.groupBy("symbol", F.floor((F.col("day_no") + 3) / 7).alias("week_idx")).agg(F.count("r").alias("n_days"), F.when(F.count("r") >= 2, F.stddev_samp("r")).alias("sd"), F.max("r").alias("mx"))
    return g.select("symbol", "week_idx", "n_days", F.round("sd", 9).alias("vol"), F.round("mx", 9).alias("largest"))


@query(f"""WITH n AS (SELECT symbol, CAST(ts // 3600000 AS BIGINT) AS h, count(*) AS n FROM {FILLS} f GROUP BY 1, 2), c AS (SELECT *, CASE WHEN n < 10 THEN 'quiet' WHEN n < 60 THEN 'normal' ELSE 'busy' END AS cls FROM n),
  m AS (SELECT *, CASE WHEN h - lag(h) OVER w = 1 AND cls = lag(cls) OVER w THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY symbol ORDER BY h)), i AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY h) AS run FROM m),
  r AS (SELECT symbol, cls, run, count(*) AS len FROM i GROUP BY 1, 2, 3) SELECT symbol, cls, count(*) AS runs, CAST(max(len) AS BIGINT) AS longest, round(quantile_cont(len, 0.5), 6) AS median FROM r GROUP BY 1, 2""")
def run_durations(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of runs of hours in one class of activity."""
    n = fills(spark, folder).groupBy("symbol", F.floor(F.col("ts") / 3_600_000).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    c = n.withColumn("cls", F.when(F.col("n") < 10, "quiet").when(F.col("n") < 60, "normal").otherwise("busy"))
    w = Window.partitionBy("symbol").orderBy("h")
    same = (F.col("h") - F.lag("h").over(w) == 1) & (F.col("cls") == F.lag("cls").over(w))
    i = c.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    r = i.groupBy("symbol", "cls", "run").agg(F.count(F.lit(1)).alias("len"))
    return r.groupBy("symbol", "cls").agg(F.count(F.lit(1)).alias("runs"), F.max("len").alias("longest"), F.round(F.percentile("len", 0.5), 6).alias("median"))


_TAPE = f"(SELECT symbol, CAST(ts // 86400000 AS BIGINT) AS day, CAST(ts // 60000 AS BIGINT) AS m, arg_max(price, (ts, price)) AS px, sum(CAST(size AS DECIMAL(38,12))) AS v FROM {FILLS} f GROUP BY 1, 2, 3)"


@query(f"""WITH r AS (SELECT symbol, day, v, CASE WHEN m - lag(m) OVER w = 1 THEN ln(px) - ln(lag(px) OVER w) END AS r FROM {_TAPE} t WINDOW w AS (PARTITION BY symbol, day ORDER BY m))
  SELECT symbol, day, count(r) AS n_consecutive, round(sum(r * r), 10) AS rv1, round(CAST(sum(v * v) AS DOUBLE) / nullif(CAST(sum(v) AS DOUBLE) * CAST(sum(v) AS DOUBLE), 0), 8) AS hhi FROM (SELECT symbol, day, r, CAST(v AS DOUBLE) AS v FROM r) x GROUP BY 1, 2""")
def tape_descriptors(spark: SparkSession, folder: str) -> DataFrame:
    """Realised variance over consecutive minutes and concentration of volume over minutes."""
    t = fills(spark, folder).groupBy("symbol", "day", F.floor(F.col("ts") / 60_000).alias("m")).agg(F.max_by("price", F.struct("ts", "price")).alias("px"), F.sum(bars.exact("size")).cast("double").alias("v"))
    r = bars.log_returns(t, ["symbol", "day"], "m", "px", consecutive_only=True)
    return r.groupBy("symbol", "day").agg(F.count("ret").alias("n_consecutive"), F.round(F.sum(F.col("ret") * F.col("ret")), 10).alias("rv1"), F.round(F.sum(F.col("v") * F.col("v")) / F.nullif(F.sum("v") * F.sum("v"), F.lit(0.0)), 8).alias("hhi"))


@query(f"""WITH w AS (SELECT symbol, CAST(ts // 60000 AS BIGINT) AS m, arg_max((ask1_price - bid1_price) / ((ask1_price + bid1_price) / 2) * 10000, (ts, tick_id)) AS bp FROM {QUOTES} q WHERE bid1_price > 0 AND ask1_price > 0 GROUP BY 1, 2)
  SELECT m, count(*) AS n, round(quantile_cont(bp, 0.5), 6) AS p50, round(quantile_cont(bp, 0.75), 6) AS p75, round(max(bp), 6) AS widest FROM w GROUP BY m""")
def minute_width(spark: SparkSession, folder: str) -> DataFrame:
    """Quoted width of each symbol's last frame per minute, then its quantiles per minute."""
    bp = (F.col("ask1_price") - F.col("bid1_price")) / ((F.col("ask1_price") + F.col("bid1_price")) / 2) * 10_000
    w = quotes(spark, folder).where("bid1_price > 0 AND ask1_price > 0").withColumn("bp", bp).groupBy("symbol", F.floor(F.col("ts") / 60_000).alias("m")).agg(F.max_by("bp", F.struct("ts", "tick_id")).alias("bp"))
    q = F.percentile("bp", F.array(F.lit(0.5), F.lit(0.75)))
    return w.groupBy("m").agg(F.count(F.lit(1)).alias("n"), q.alias("q"), F.round(F.max("bp"), 6).alias("widest")).select("m", "n", F.round(F.col("q")[0], 6).alias("p50"), F.round(F.col("q")[1], 6).alias("p75"), "widest")


@query(f"""SELECT symbol, (3 * row_number() OVER (ORDER BY t, symbol) - 1) // count(*) OVER () AS tercile, t AS median_turnover, share_missing FROM (SELECT symbol, round(quantile_cont(turnover, 0.5), 4) AS t, round(1 - count(*) / (max(day_no) - min(day_no) + 1.0), 8) AS share_missing FROM {DAILY} d GROUP BY symbol) x""")
def turnover_terciles(spark: SparkSession, folder: str) -> DataFrame:
    """Median turnover, its tercile and the share of missing days per symbol. One row per symbol goes into the window."""
    x = daily(spark, folder).groupBy("symbol").agg(F.round(F.percentile("turnover", 0.5), 4).alias("median_turnover"), F.round(1 - F.count(F.lit(1)) / (F.max("day_no") - F.min("day_no") + 1), 8).alias("share_missing"))
    return x.withColumn("_all", F.lit(0)).withColumn("tercile", floor_bucket(["_all"], [F.col("median_turnover"), F.col("symbol")], 3).cast("long")).drop("_all")


@query(f"""SELECT symbol, width_bucket, count(*) AS n FROM (SELECT symbol, CAST(floor((price * size / 10000 - 0.4) / 0.01 + 1e-9) AS BIGINT) AS width_bucket FROM {FILLS} f WHERE price * size / 10000 >= 0.4 AND price * size / 10000 < 1.3) x GROUP BY 1, 2""")
def notional_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Ninety half-open bins of notional around ten thousand."""
    s = F.col("price") * F.col("size") / 10_000
    return fills(spark, folder).where((s >= 0.4) & (s < 1.3)).groupBy("symbol", F.floor((s - 0.4) / 0.01 + 1e-9).alias("width_bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH o AS (SELECT trade_id, symbol, side, size, CAST(ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS DOUBLE) AS iat, ts // 86400000 AS day, min(ts // 86400000) OVER () AS d0 FROM {FILLS} f),
  e AS (SELECT symbol, quantile_cont(size, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS se, quantile_cont(iat, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS ie FROM o WHERE day = d0 AND size IS NOT NULL AND iat IS NOT NULL AND side IS NOT NULL GROUP BY symbol)
  SELECT o.trade_id, CAST(CASE WHEN side = 'buy' THEN 64 ELSE 0 END + 8 * len(list_filter(se, lambda x: x <= size)) + len(list_filter(ie, lambda x: x <= iat)) AS INTEGER) AS token FROM o JOIN e ON o.symbol = e.symbol WHERE size IS NOT NULL AND iat IS NOT NULL AND side IS NOT NULL""")
def trade_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Token of side, size octile and gap octile; the edges are those of the first day (the training part)."""
    f = with_previous(fills(spark, folder), ["symbol"], ["ts", "trade_id"], ["ts"])
    o = f.withColumn("iat", (F.col("ts") - F.col("prev.ts")).cast("double")).where("size IS NOT NULL AND iat IS NOT NULL AND side IS NOT NULL")
    first = fills(spark, folder).agg(F.floor(F.min("ts") / DAY_MS)).first()[0]
    eighths = [k / 8 for k in range(1, 8)]
    train = o.where(F.col("day") == F.lit(first)) if first is not None else o
    e = exact_percentiles(train, ["symbol"], "size", eighths, "se").join(exact_percentiles(train, ["symbol"], "iat", eighths, "ie"), "symbol")
    below = lambda edges, v: F.size(F.filter(edges, lambda x: x <= F.col(v)))
    token = F.when(F.col("side") == "buy", 64).otherwise(0) + 8 * below("se", "size") + below("ie", "iat")
    return o.join(e, "symbol").select("trade_id", token.cast("int").alias("token"))


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day_no) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM {DAILY} d) SELECT symbol, CAST(4 * i // n AS BIGINT) AS part, count(*) AS rows_in, min(day_no) AS first_day, max(day_no) AS last_day FROM s GROUP BY 1, 2""")
def window_split(spark: SparkSession, folder: str) -> DataFrame:
    """Each series in four contiguous disjoint parts."""
    i = F.row_number().over(_day()) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    s = daily(spark, folder).withColumn("part", F.floor(4 * i / n))
    return s.groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("rows_in"), F.min("day_no").alias("first_day"), F.max("day_no").alias("last_day"))


@query(f"""WITH b AS (SELECT min(day_no) AS lo, max(day_no) + 1 AS hi FROM {DAILY} d), f AS (SELECT k, CAST(lo + (hi - lo) * k // 5 AS BIGINT) AS a, CAST(lo + (hi - lo) * (k + 1) // 5 AS BIGINT) AS z FROM b, (SELECT unnest(generate_series(1, 4)) AS k) g)
  SELECT k AS fold, count(*) FILTER (day_no < a - 5) AS n_train, count(*) FILTER (day_no >= a AND day_no < z) AS n_test FROM {DAILY} d JOIN f ON day_no < z GROUP BY k""")
def walk_forward_folds(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of four expanding folds with an embargo of five days before each test part; the fold table has four rows."""
    d = daily(spark, folder)
    lo, hi = d.agg(F.min("day_no"), F.max("day_no") + 1).first()
    edges = [(k, lo + (hi - lo) * k // 5, lo + (hi - lo) * (k + 1) // 5) for k in range(1, 5)] if lo is not None else []
    f = F.broadcast(spark.createDataFrame(edges, "fold long, a long, z long"))
    j = d.join(f, F.col("day_no") < F.col("z"))
    return j.groupBy("fold").agg(F.count_if(F.col("day_no") < F.col("a") - 5).alias("n_train"), F.count_if((F.col("day_no") >= F.col("a")) & (F.col("day_no") < F.col("z"))).alias("n_test"))


@query(f"""SELECT symbol, day_no, list(close) OVER (PARTITION BY symbol ORDER BY day_no ROWS 7 PRECEDING) AS lookback FROM {DAILY} d QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day_no) % 4 = 0 AND row_number() OVER (PARTITION BY symbol ORDER BY day_no) >= 8""")
def sliding_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Lookback arrays of eight closes, every fourth day."""
    s = daily(spark, folder).withColumn("lookback", F.collect_list("close").over(_day().rowsBetween(-7, 0))).withColumn("rn", F.row_number().over(_day()))
    return s.where("rn % 4 = 0 AND rn >= 8").select("symbol", "day_no", "lookback")


@query(f"""SELECT lag_k, count(*) AS n, round(avg(r), 9) AS mean_next FROM (SELECT k AS lag_k, lead(ret, 1) OVER (PARTITION BY symbol, k ORDER BY week_idx) AS r, abs(ret) > 1 AS shock FROM {RETURNS} x, (SELECT unnest([1, 2]) AS k) g WHERE ret IS NOT NULL) y WHERE shock AND r IS NOT NULL GROUP BY 1""")
def shock_followups(spark: SparkSession, folder: str) -> DataFrame:
    """Mean return after weeks that moved by more than one log point, per variant of the event table."""
    w = Window.partitionBy("symbol", "lag_k").orderBy("week_idx")
    x = weekly_returns(spark, folder).where("ret IS NOT NULL").withColumn("lag_k", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("r", F.lead("ret", 1).over(w))
    return x.where("abs(ret) > 1 AND r IS NOT NULL").groupBy("lag_k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 9).alias("mean_next"))


_LAGIC = "rank() OVER (PARTITION BY k, week_idx ORDER BY {c}) + (count(*) OVER (PARTITION BY k, week_idx, {c}) - 1) / 2.0"


@query(f"""WITH p AS (SELECT k, x.week_idx, x.ret, y.ret AS later FROM {RETURNS} x JOIN (SELECT unnest([1, 2, 3]) AS k) g ON true JOIN {RETURNS} y ON y.symbol = x.symbol AND y.week_idx = x.week_idx + k WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL),
  c AS (SELECT k, week_idx, corr(a, b) AS ic FROM (SELECT k, week_idx, {_LAGIC.format(c='ret')} AS a, {_LAGIC.format(c='later')} AS b FROM p) q GROUP BY 1, 2 HAVING count(*) >= 5)
  SELECT k AS lag_k, count(*) AS weeks, round(avg(ic), 8) AS mean_ic FROM c GROUP BY k""")
def lag_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Mean weekly rank correlation of returns with those 1, 2 and 3 weeks later; weeks of at least five pairs."""
    r = weekly_returns(spark, folder).where("ret IS NOT NULL").select("symbol", "week_idx", "ret")
    later = r.select("symbol", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("lag_k"), "week_idx", F.col("ret").alias("later")).withColumn("week_idx", F.col("week_idx") - F.col("lag_k"))
    ic = spearman(r.join(later, ["symbol", "week_idx"]), ["lag_k", "week_idx"], "ret", "later").where("n >= 5")
    return ic.groupBy("lag_k").agg(F.count(F.lit(1)).alias("weeks"), F.round(F.avg("ic"), 8).alias("mean_ic"))


@query(f"""SELECT symbol, week_idx, round(CASE WHEN count(*) OVER w >= 4 THEN quantile_cont(turnover, 0.5) OVER w END, 4) AS median_turnover FROM {WEEKLY} k WINDOW w AS (PARTITION BY symbol ORDER BY week_idx ROWS 7 PRECEDING)""")
def trailing_median_turnover(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("week_idx").rowsBetween(-7, 0)
    return weekly(spark, folder).select("symbol", "week_idx", F.round(F.when(F.count(F.lit(1)).over(w) >= 4, F.percentile("turnover", 0.5).over(w)), 4).alias("median_turnover"))


@query(f"""SELECT symbol, CAST(ts // 86400000 AS BIGINT) AS day, round(sum(funding_rate), 10) AS cash_flow, count(funding_rate) AS n FROM (SELECT symbol, ts, funding_rate FROM {QUOTES} q QUALIFY row_number() OVER (PARTITION BY symbol, ts // 28800000 ORDER BY ts DESC, tick_id DESC) = 1) x GROUP BY 1, 2""")
def daily_funding_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Funding paid per day: the last rate of each eight hours."""
    w = Window.partitionBy("symbol", "day", F.floor(F.col("ts") / 28_800_000)).orderBy(F.desc("ts"), F.desc("tick_id"))
    x = quotes(spark, folder).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return x.groupBy("symbol", "day").agg(F.round(F.sum("funding_rate"), 10).alias("cash_flow"), F.count("funding_rate").alias("n"))


@query(f"""SELECT symbol, day_no, round(coalesce(f.v, 0), 6) AS paid, d.close FROM {DAILY} d LEFT JOIN (SELECT date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS dn, sum(l_discount) AS v FROM lineitem GROUP BY 1) f ON d.day_no = f.dn""")
def attach_daily_flow(spark: SparkSession, folder: str) -> DataFrame:
    """A daily flow joined to each series' closes, 0 where there is none."""
    f = table(spark, folder, "lineitem").groupBy(F.unix_date(F.to_date("l_shipdate")).alias("day_no")).agg(F.sum("l_discount").alias("v"))
    return daily(spark, folder).join(f, "day_no", "left").select("symbol", "day_no", F.round(F.coalesce("v", F.lit(0.0)), 6).alias("paid"), "close")


@query("""SELECT o_orderpriority AS symbol, t AS seconds, round(avg(CASE WHEN d <= t THEN 1.0 ELSE 0.0 END), 8) AS filled FROM (SELECT o_orderpriority, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey) x, (SELECT unnest([10, 30, 60, 90]) AS t) g GROUP BY 1, 2""")
def fill_curves(spark: SparkSession, folder: str) -> DataFrame:
    """Share of orders filled within each horizon (ship delays stand in for fill times)."""
    x = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate").join(table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate"), "o_orderkey")
    d = x.select(F.col("o_orderpriority").alias("symbol"), F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("d"))
    shares = d.groupBy("symbol").agg(*[F.round(F.avg(F.when(F.col("d") <= t, 1.0).otherwise(0.0)), 8).alias(str(t)) for t in (10, 30, 60, 90)])
    return shares.select("symbol", F.explode(F.array(*[F.struct(F.lit(t).alias("seconds"), F.col(str(t)).alias("filled")) for t in (10, 30, 60, 90)])).alias("x")).select("symbol", "x.seconds", "x.filled")
