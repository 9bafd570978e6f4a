"""Queries on the daily and weekly panel: characteristics, information coefficients, deciles, episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.operators.ranks import average_rank, floor_bucket, pearson, spearman
from tideglass.plans.registry import query
from tideglass.plans.views import DAILY, RETURNS, WEEKLY, daily, weekly, weekly_returns

def _by_week_idx():
    return Window.partitionBy("symbol").orderBy("week_idx")


def _by_day_no():
    return Window.partitionBy("symbol").orderBy("day_no")


@query(f"SELECT symbol, week_idx, close, turnover, days FROM {WEEKLY} w")
def weekly_close(spark: SparkSession, folder: str) -> DataFrame:
    return weekly(spark, folder)


@query(f"SELECT symbol, week_idx, round(ret, 9) AS ret, round(next_ret, 9) AS next_ret FROM {RETURNS} r")
def weekly_return_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return weekly_returns(spark, folder).select("symbol", "week_idx", F.round("ret", 9).alias("ret"), F.round("next_ret", 9).alias("next_ret"))


@query(f"""SELECT symbol, week_idx, round(sum(ret) OVER (PARTITION BY symbol ORDER BY week_idx ROWS 3 PRECEDING), 9) AS mom4, round(max(ret) OVER (PARTITION BY symbol ORDER BY week_idx ROWS 7 PRECEDING), 9) AS vol_max,
  round(CASE WHEN count(ret) OVER w8 >= 8 THEN stddev_samp(ret) OVER w8 END, 9) AS vol_rv FROM {RETURNS} r WINDOW w8 AS (PARTITION BY symbol ORDER BY week_idx ROWS 7 PRECEDING)""")
def characteristics(spark: SparkSession, folder: str) -> DataFrame:
    """Momentum over four weeks (short head allowed), largest and spread of the last eight (full window only)."""
    w8 = _by_week_idx().rowsBetween(-7, 0)
    r = weekly_returns(spark, folder)
    return r.select(
        "symbol", "week_idx", F.round(F.sum("ret").over(_by_week_idx().rowsBetween(-3, 0)), 9).alias("mom4"), F.round(F.max("ret").over(w8), 9).alias("vol_max"),
        F.round(F.when(F.count("ret").over(w8) >= 8, F.stddev_samp("ret").over(w8)), 9).alias("vol_rv"),
    )


_MARKET = f"(SELECT week_idx, avg(ret) AS market FROM {RETURNS} r GROUP BY week_idx)"
_BETA = f"""(SELECT x.symbol, x.week_idx, x.ret, x.next_ret, CASE WHEN count(ret * market) OVER w >= 4 THEN regr_slope(ret, market) OVER w END AS beta FROM {RETURNS} x JOIN {_MARKET} m ON x.week_idx = m.week_idx
  WINDOW w AS (PARTITION BY x.symbol ORDER BY x.week_idx ROWS 7 PRECEDING))"""


def _betas(spark: SparkSession, folder: str, back=(-7, 0)) -> DataFrame:
    """Beta on the mean return of all symbols over the trailing weeks; at least four pairs."""
    r = weekly_returns(spark, folder)
    x = r.withColumn("market", F.avg("ret").over(Window.partitionBy("week_idx")))
    w = _by_week_idx().rowsBetween(*back)
    return x.withColumn("beta", F.when(F.count(F.col("ret") * F.col("market")).over(w) >= 4, F.regr_slope("ret", "market").over(w)))


@query(f"SELECT symbol, week_idx, round(beta, 7) AS beta FROM {_BETA} b")
def beta_8w(spark: SparkSession, folder: str) -> DataFrame:
    return _betas(spark, folder).select("symbol", "week_idx", F.round("beta", 7).alias("beta"))


@query(f"SELECT symbol, week_idx, round(beta, 7) AS beta FROM {_BETA.replace('ROWS 7 PRECEDING', 'ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING')} b")
def beta_excluding_current(spark: SparkSession, folder: str) -> DataFrame:
    return _betas(spark, folder, (-8, -1)).select("symbol", "week_idx", F.round("beta", 7).alias("beta"))


_RANK = "rank() OVER (PARTITION BY week_idx ORDER BY {c}) + (count(*) OVER (PARTITION BY week_idx, {c}) - 1) / 2.0"


@query(f"""SELECT week_idx, count(*) AS n, round(coalesce(nullif(corr(a, b), 'nan'), 0.0), 8) AS ic FROM (SELECT week_idx, {_RANK.format(c='ret')} AS a, {_RANK.format(c='next_ret')} AS b FROM {RETURNS} r WHERE ret IS NOT NULL AND next_ret IS NOT NULL) x GROUP BY week_idx""")
def weekly_ic(spark: SparkSession, folder: str) -> DataFrame:
    """Rank correlation per week of this week's with next week's returns."""
    return spearman(weekly_returns(spark, folder), ["week_idx"], "ret", "next_ret").select("week_idx", "n", F.round("ic", 8).alias("ic"))


@query(f"""WITH p AS (SELECT week_idx, symbol, beta, next_ret, regr_slope(next_ret, beta) OVER w AS s, regr_intercept(next_ret, beta) OVER w AS i, count(*) OVER w AS n FROM {_BETA} b WHERE beta IS NOT NULL AND next_ret IS NOT NULL WINDOW w AS (PARTITION BY week_idx))
  SELECT week_idx, symbol, round(next_ret - i - s * beta, 7) AS residual FROM p WHERE n >= 5""")
def fm_residual(spark: SparkSession, folder: str) -> DataFrame:
    """Next week's return left over by the week's regression on beta; weeks of at least five symbols."""
    w = Window.partitionBy("week_idx")
    p = _betas(spark, folder).where("beta IS NOT NULL AND next_ret IS NOT NULL")
    p = p.withColumn("s", F.regr_slope("next_ret", "beta").over(w)).withColumn("i", F.regr_intercept("next_ret", "beta").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    return p.where("n >= 5").select("week_idx", "symbol", F.round(F.col("next_ret") - F.col("i") - F.col("s") * F.col("beta"), 7).alias("residual"))


@query(f"""WITH b AS (SELECT week_idx, symbol, beta, ret, CAST((5 * row_number() OVER (PARTITION BY week_idx ORDER BY beta, symbol) - 1) // count(*) OVER (PARTITION BY week_idx) AS INTEGER) AS quintile FROM {_BETA} x WHERE beta IS NOT NULL AND ret IS NOT NULL)
  SELECT week_idx, symbol, quintile, row_number() OVER (PARTITION BY week_idx, quintile ORDER BY ret, symbol) AS inner_rank FROM b""")
def double_sort(spark: SparkSession, folder: str) -> DataFrame:
    b = _betas(spark, folder).where("beta IS NOT NULL AND ret IS NOT NULL").withColumn("quintile", floor_bucket(["week_idx"], [F.col("beta"), F.col("symbol")], 5))
    return b.select("week_idx", "symbol", "quintile", F.row_number().over(Window.partitionBy("week_idx", "quintile").orderBy("ret", "symbol")).alias("inner_rank"))


@query(f"""WITH b AS (SELECT week_idx, turnover, close, CAST((10 * row_number() OVER (PARTITION BY week_idx ORDER BY turnover DESC, symbol) - 1) // count(*) OVER (PARTITION BY week_idx) AS INTEGER) AS decile FROM {WEEKLY} w)
  SELECT decile, count(*) AS n, round(quantile_cont(close, 0.5), 6) AS median_close, round(sum(turnover), 2) AS turnover FROM b GROUP BY decile""")
def decile_spread(spark: SparkSession, folder: str) -> DataFrame:
    """Median close per floor-split decile of turnover."""
    b = weekly(spark, folder).withColumn("decile", floor_bucket(["week_idx"], [F.col("turnover").desc(), F.col("symbol")], 10))
    return b.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("close", 0.5), 6).alias("median_close"), F.round(F.sum("turnover"), 2).alias("turnover"))


@query(f"""SELECT week_idx, symbol, round(coalesce((ret - avg(ret) OVER w) / nullif(stddev_pop(ret) OVER w, 0), 0.0), 6) AS z FROM {RETURNS} r WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY week_idx)""")
def cross_sectional_z(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("week_idx")
    r = weekly_returns(spark, folder).where("ret IS NOT NULL")
    sd = F.stddev_pop("ret").over(w)
    return r.select("week_idx", "symbol", F.round(F.coalesce((F.col("ret") - F.avg("ret").over(w)) / F.nullif(sd, F.lit(0.0)), F.lit(0.0)), 6).alias("z"))


@query(f"""SELECT week_idx, symbol FROM (SELECT week_idx, symbol, row_number() OVER (PARTITION BY week_idx ORDER BY abs(round(ret, 9)) DESC, symbol) AS rn FROM {RETURNS} r WHERE ret IS NOT NULL) x WHERE rn = 1""")
def largest_move_per_week(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("week_idx").orderBy(F.abs(F.round("ret", 9)).desc(), "symbol")
    return weekly_returns(spark, folder).where("ret IS NOT NULL").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("week_idx", "symbol")


@query(f"""SELECT week_idx, count(*) AS n, round(stddev_samp(ret), 9) AS sd FROM {RETURNS} r WHERE ret IS NOT NULL GROUP BY week_idx""")
def cross_sectional_sd(spark: SparkSession, folder: str) -> DataFrame:
    return weekly_returns(spark, folder).where("ret IS NOT NULL").groupBy("week_idx").agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_samp("ret"), 9).alias("sd"))


@query(f"""SELECT symbol, day_no, round(close - quantile_cont(close, 0.5) OVER (PARTITION BY symbol ORDER BY day_no ROWS 14 PRECEDING), 6) AS detrended FROM {DAILY} d""")
def roll_median_detrend(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder).select("symbol", "day_no", F.round(F.col("close") - F.percentile("close", 0.5).over(_by_day_no().rowsBetween(-14, 0)), 6).alias("detrended"))


@query(f"""SELECT symbol, day_no, close >= quantile_cont(close, 0.9) OVER (PARTITION BY symbol ORDER BY day_no RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS flag FROM {DAILY} d""")
def roll_pctl_flag(spark: SparkSession, folder: str) -> DataFrame:
    """Days at or above the 90th percentile of the last 60 calendar days, the day included."""
    return daily(spark, folder).select("symbol", "day_no", (F.col("close") >= F.percentile("close", 0.9).over(_by_day_no().rangeBetween(-60, 0))).alias("flag"))


@query(f"""SELECT symbol, day_no, round(CASE WHEN count(close) OVER w >= 6 THEN (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) END, 6) AS score FROM {DAILY} d WINDOW w AS (PARTITION BY symbol ORDER BY day_no ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
def cropper_score(spark: SparkSession, folder: str) -> DataFrame:
    w = _by_day_no().rowsBetween(-5, 5)
    return daily(spark, folder).select("symbol", "day_no", F.round(F.when(F.count("close").over(w) >= 6, (F.col("close") - F.avg("close").over(w)) / F.nullif(F.stddev_samp("close").over(w), F.lit(0.0))), 6).alias("score"))


_SCORES = f"(SELECT symbol, day_no, round(CASE WHEN count(close) OVER w >= 6 THEN (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) END, 6) AS score FROM {DAILY} d WINDOW w AS (PARTITION BY symbol ORDER BY day_no ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))"


@query(f"""SELECT day_no, count(*) AS n_avail, count(*) FILTER (score >= 1.5) AS n_up, count(*) FILTER (score <= -1.5) AS n_down FROM {_SCORES} s WHERE score IS NOT NULL GROUP BY day_no
  HAVING count(*) >= 5 AND greatest(count(*) FILTER (score >= 1.5), count(*) FILTER (score <= -1.5)) >= 0.2 * count(*)""")
def pointer_days(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which a fifth of the available series score 1.5 or more in one direction."""
    g = cropper_score(spark, folder).where("score IS NOT NULL").groupBy("day_no").agg(F.count(F.lit(1)).alias("n_avail"), F.count_if(F.col("score") >= 1.5).alias("n_up"), F.count_if(F.col("score") <= -1.5).alias("n_down"))
    return g.where((F.col("n_avail") >= 5) & (F.greatest("n_up", "n_down") >= 0.2 * F.col("n_avail")))


_STRESS = f"(SELECT DISTINCT day_no FROM (SELECT symbol, day_no, close >= quantile_cont(close, 0.9) OVER (PARTITION BY symbol ORDER BY day_no RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS flag FROM {DAILY} d) x WHERE flag AND symbol IN (0, 1))"


@query(f"""WITH i AS (SELECT day_no, sum(CASE WHEN day_no - before > 3 THEN 1 ELSE 0 END) OVER (ORDER BY day_no) AS island FROM (SELECT day_no, lag(day_no) OVER (ORDER BY day_no) AS before FROM {_STRESS} s) x)
  SELECT min(day_no) AS first_day, max(day_no) AS last_day, count(*) AS days FROM i GROUP BY island""")
def episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged days of two series joined to episodes where at most three days lie between them. One row per day goes into the window."""
    days = roll_pctl_flag(spark, folder).where("flag AND symbol IN (0, 1)").select("day_no").distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("day_no")
    i = days.withColumn("new", F.when(F.col("day_no") - F.lag("day_no").over(w) > 3, 1).otherwise(0)).withColumn("island", F.sum("new").over(w))
    return i.groupBy("island").agg(F.min("day_no").alias("first_day"), F.max("day_no").alias("last_day"), F.count(F.lit(1)).alias("days")).drop("island")


@query(f"""WITH r AS (SELECT symbol, day_no, close - lag(close) OVER (PARTITION BY symbol ORDER BY day_no) AS pnl FROM {DAILY} d), c AS (SELECT symbol, day_no, pnl, sum(pnl) OVER (PARTITION BY symbol ORDER BY day_no) AS cum FROM r WHERE pnl IS NOT NULL),
  m AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY symbol ORDER BY day_no)) AS top FROM c)
  SELECT symbol, count(*) AS n, round(sum(pnl), 4) AS total, round(max(top - cum), 4) AS max_drawdown, round(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252), 8) AS sharpe, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 8) AS win_rate FROM m GROUP BY symbol""")
def drawdown_sharpe(spark: SparkSession, folder: str) -> DataFrame:
    """Cumulative result, drawdown from the running maximum (0 included) and Sharpe ratio by the root of 252."""
    r = daily(spark, folder).withColumn("pnl", F.col("close") - F.lag("close").over(_by_day_no())).where("pnl IS NOT NULL")
    m = r.withColumn("cum", F.sum("pnl").over(_by_day_no())).withColumn("top", F.greatest(F.lit(0.0), F.max("cum").over(_by_day_no())))
    return m.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("pnl"), 4).alias("total"), F.round(F.max(F.col("top") - F.col("cum")), 4).alias("max_drawdown"),
        F.round(F.avg("pnl") / F.nullif(F.stddev_samp("pnl"), F.lit(0.0)) * F.sqrt(F.lit(252.0)), 8).alias("sharpe"), F.round(F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)), 8).alias("win_rate"),
    )


@query(f"""SELECT symbol, day_no, round(CASE WHEN count(*) OVER w = 5 THEN sum(r * r) OVER w END, 9) AS forward_var FROM (SELECT symbol, day_no, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY day_no)) AS r FROM {DAILY} d) x WINDOW w AS (PARTITION BY symbol ORDER BY day_no ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""")
def forward_variance(spark: SparkSession, folder: str) -> DataFrame:
    r = daily(spark, folder).withColumn("r", F.ln("close") - F.ln(F.lag("close").over(_by_day_no())))
    w = _by_day_no().rowsBetween(1, 5)
    return r.select("symbol", "day_no", F.round(F.when(F.count(F.lit(1)).over(w) == 5, F.sum(F.col("r") * F.col("r")).over(w)), 9).alias("forward_var"))


@query(f"""SELECT week_idx, count(*) FILTER (alive) AS alive, count(*) FILTER (week_idx = first_week) AS listed, count(*) FILTER (week_idx = last_week) AS ended FROM (
  SELECT week_idx, min(week_idx) OVER w AS first_week, max(week_idx) OVER w AS last_week, week_idx >= min(week_idx) OVER w + 8 AS alive FROM {WEEKLY} k WINDOW w AS (PARTITION BY symbol)) x GROUP BY week_idx""")
def universe_size(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols with at least eight weeks of history per week, first and last weeks."""
    w = Window.partitionBy("symbol")
    x = weekly(spark, folder).select("week_idx", F.min("week_idx").over(w).alias("a"), F.max("week_idx").over(w).alias("b"))
    c = F.count_if
    return x.groupBy("week_idx").agg(c(F.col("week_idx") >= F.col("a") + 8).alias("alive"), c(F.col("week_idx") == F.col("a")).alias("listed"), c(F.col("week_idx") == F.col("b")).alias("ended"))


@query(f"""SELECT day_no, symbol, round(({_RANK.format(c='close').replace('week_idx', 'day_no')}) / (count(*) OVER (PARTITION BY day_no) + 1), 9) AS u FROM {DAILY} d""")
def quantile_normalised(spark: SparkSession, folder: str) -> DataFrame:
    u = average_rank("close", ["day_no"]) / (F.count(F.lit(1)).over(Window.partitionBy("day_no")) + 1)
    return daily(spark, folder).select("day_no", "symbol", F.round(u, 9).alias("u"))


@query(f"""SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(coalesce(nullif(corr(a.ret, b.ret), 'nan'), 0.0), 7) AS r FROM {RETURNS} a JOIN {RETURNS} b ON a.week_idx = b.week_idx AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2""")
def pair_correlations(spark: SparkSession, folder: str) -> DataFrame:
    """Correlation of weekly returns of every pair of series, over shared weeks (a week has one row per series)."""
    r = weekly_returns(spark, folder).where("ret IS NOT NULL").select("symbol", "week_idx", "ret")
    a, b = r.alias("a"), r.alias("b")
    j = a.join(b, (F.col("a.week_idx") == F.col("b.week_idx")) & (F.col("a.symbol") < F.col("b.symbol")))
    return j.groupBy(F.col("a.symbol").alias("a"), F.col("b.symbol").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.round(pearson("a.ret", "b.ret"), 7).alias("r"))


@query(f"""SELECT symbol, lag_k, round(coalesce(nullif(corr(ret, was), 'nan'), 0.0), 7) AS r, count(*) AS n FROM (SELECT r.symbol, k.lag_k, r.ret, s.ret AS was FROM {RETURNS} r JOIN (SELECT unnest([1, 2, 4]) AS lag_k) k ON true JOIN {RETURNS} s ON r.symbol = s.symbol AND s.week_idx = r.week_idx - k.lag_k) x WHERE ret IS NOT NULL AND was IS NOT NULL GROUP BY 1, 2""")
def autocorrelation(spark: SparkSession, folder: str) -> DataFrame:
    """Autocorrelation at lags of 1, 2 and 4 weeks, gaps not bridged."""
    r = weekly_returns(spark, folder).where("ret IS NOT NULL").select("symbol", "week_idx", "ret")
    shifted = r.select("symbol", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))).alias("lag_k"), "week_idx", F.col("ret").alias("then")).withColumn("week_idx", F.col("week_idx") + F.col("lag_k"))
    j = r.join(shifted, ["symbol", "week_idx"])
    return j.groupBy("symbol", "lag_k").agg(F.round(pearson("ret", "then"), 7).alias("r"), F.count(F.lit(1)).alias("n"))
