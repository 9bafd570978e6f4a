"""Queries of fitted models, searches over parameters, resumable plans and rules judged by their trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.operators import align, bars, models
from tideglass.plans.registry import query
from tideglass.plans.views import DAILY, FILLS, RETURNS, daily, fills, weekly_returns
from tideglass.session import shared_folder

FEATURES = ["d", "w", "m"]


def _day():
    return Window.partitionBy("symbol").orderBy("day_no")


def _log_variances(spark: SparkSession, folder: str) -> DataFrame:
    r = daily(spark, folder).withColumn("r", F.ln("close") - F.ln(F.lag("close").over(_day()))).withColumn("lv", F.ln(F.col("r") * F.col("r") + 1e-6)).where("r IS NOT NULL")
    return r.select("symbol", "day_no", F.col("lv").alias("d"), F.avg("lv").over(_day().rowsBetween(-4, 0)).alias("w"), F.avg("lv").over(_day().rowsBetween(-21, 0)).alias("m"), F.lead("lv").over(_day()).alias("label"))


def _assembled(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def _folds(rows: DataFrame) -> list[tuple[int, int, int, int]]:
    lo, hi = rows.agg(F.min("day_no"), F.max("day_no") + 1).first()
    return models.expanding_folds(lo, hi, 4, 2) if lo is not None else []


def _linear(train: DataFrame):
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(regParam=0.0, solver="normal").fit(train)


@query()
def har_regression(spark: SparkSession, folder: str) -> DataFrame:
    """Next day's log variance on the day's, week's and month's: one linear model a fold, fitted two days before its test part begins."""
    v = _assembled(_log_variances(spark, folder))
    return models.walk_forward(v, "day_no", "label", _folds(v), _linear).select("symbol", "day_no", "fold", F.round("prediction", 6).alias("forecast"))


@query()
def boosted_trees(spark: SparkSession, folder: str) -> DataFrame:
    """The same by gradient-boosted trees: rows, error and that of the training mean per fold."""
    from pyspark.ml.regression import GBTRegressor

    v = _assembled(_log_variances(spark, folder))
    p = models.walk_forward(v, "day_no", "label", _folds(v), lambda t: GBTRegressor(maxIter=10, maxDepth=3, seed=7).fit(t)).where("label IS NOT NULL")
    return p.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("prediction") - F.col("label")) ** 2), 6).alias("mse"), F.round(F.var_pop("label"), 6).alias("variance"))


@query()
def feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    """How much the linear model's error grows when a feature's values change places."""
    v = _log_variances(spark, folder)
    model = _linear(_assembled(v.where("label IS NOT NULL")))
    return models.permutation_importance(v, model, FEATURES, _assembled, "label", ["symbol", "day_no"], 11)


@query()
def linear_probe(spark: SparkSession, folder: str) -> DataFrame:
    """Class-balanced logistic probe of the aggressor's side from size and price move, fitted on one half of the trades (by hash of their id): balanced accuracy per symbol on the other."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from tideglass.operators.blocks import with_previous

    f = with_previous(fills(spark, folder), ["symbol"], ["ts", "trade_id"], ["price"])
    x = f.where("side IS NOT NULL AND size > 0 AND prev IS NOT NULL").select("symbol", (F.pmod(F.xxhash64("trade_id"), F.lit(2)) == 0).alias("train"), (F.col("side") == "buy").cast("double").alias("label"), F.ln("size").alias("s"), (F.ln("price") - F.ln("prev.price")).alias("move"))
    share = x.where("train").agg(F.avg("label")).first()[0]
    if not share or share == 1:
        return x.limit(0).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("balanced_accuracy"))
    w = VectorAssembler(inputCols=["s", "move"], outputCol="features").transform(x.withColumn("weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share))))
    p = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=20).fit(w.where("train")).transform(w.where("NOT train"))
    hit = (F.col("prediction") == F.col("label")).cast("double")
    c = p.groupBy("symbol", "label").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("recall"))
    return c.groupBy("symbol").agg(F.sum("n").alias("n"), F.round(F.avg("recall"), 6).alias("balanced_accuracy"))


@query(f"""WITH e AS (SELECT symbol, CAST(ts // 300000 AS BIGINT) AS bucket, price, size, row_number() OVER (PARTITION BY symbol, ts // 300000 ORDER BY ts, trade_id) AS rn, count(*) OVER (PARTITION BY symbol, ts // 300000) AS n FROM {FILLS} f)
  SELECT symbol, bucket, count(*) AS events, round(avg(ln(price)), 8) AS price_mean, round(stddev_pop(ln(price)), 8) + 0.0 AS price_sd, round(avg(size), 6) AS size_mean, round(stddev_pop(size), 6) + 0.0 AS size_sd FROM e WHERE n >= 4 AND rn <= 16 GROUP BY 1, 2""")
def window_encodings(spark: SparkSession, folder: str) -> DataFrame:
    """Masked mean and spread of each channel over the first sixteen events of a window: the encoder without a network."""
    w = Window.partitionBy("symbol", "bucket")
    e = fills(spark, folder).withColumn("bucket", F.floor(F.col("ts") / 300_000)).withColumn("rn", F.row_number().over(w.orderBy("ts", "trade_id"))).withColumn("n", F.count(F.lit(1)).over(w)).where("n >= 4 AND rn <= 16")
    p = F.ln("price")
    return e.groupBy("symbol", "bucket").agg(F.count(F.lit(1)).alias("events"), F.round(F.avg(p), 8).alias("price_mean"), (F.round(F.stddev_pop(p), 8) + 0.0).alias("price_sd"), F.round(F.avg("size"), 6).alias("size_mean"), (F.round(F.stddev_pop("size"), 6) + 0.0).alias("size_sd"))


_RULES = f"""(SELECT k, week_idx, avg(sign(round(s, 9)) * next_ret) AS pnl FROM (SELECT k, symbol, week_idx, next_ret, sum(ret) OVER (PARTITION BY k, symbol ORDER BY week_idx RANGE BETWEEN k - 1 PRECEDING AND CURRENT ROW) AS s FROM {RETURNS} r, (SELECT unnest([1, 2, 4, 8]) AS k) g WHERE ret IS NOT NULL) x WHERE next_ret IS NOT NULL GROUP BY 1, 2)"""


@query(f"""WITH b AS (SELECT min(week_idx) AS lo, max(week_idx) + 1 AS hi FROM {_RULES} r), c AS (SELECT f AS fold, lo + (hi - lo) * f // 4 AS a, lo + (hi - lo) * (f + 1) // 4 AS z FROM b, (SELECT unnest([1, 2, 3]) AS f) g),
  s AS (SELECT fold, k, avg(pnl) FILTER (week_idx < a) / nullif(stddev_samp(pnl) FILTER (week_idx < a), 0) AS trained, avg(pnl) FILTER (week_idx >= a AND week_idx < z) / nullif(stddev_samp(pnl) FILTER (week_idx >= a AND week_idx < z), 0) AS tested, count(*) FILTER (week_idx >= a AND week_idx < z) AS weeks FROM {_RULES} r, c GROUP BY 1, 2)
  SELECT CAST(fold AS INTEGER) AS fold, CAST(arg_max(k, (round(trained, 9), -k)) AS INTEGER) AS lookback, round(arg_max(tested, (round(trained, 9), -k)), 7) AS tested, CAST(arg_max(weeks, (round(trained, 9), -k)) AS BIGINT) AS weeks FROM s WHERE trained IS NOT NULL GROUP BY 1""")
def grid_search(spark: SparkSession, folder: str) -> DataFrame:
    """The lookback of a momentum rule chosen on the weeks before each fold, and what it gave in the fold; all parameters in one pass."""
    r = weekly_returns(spark, folder).where("ret IS NOT NULL").withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 2, 4, 8)])))
    w = Window.partitionBy("k", "symbol").orderBy("week_idx")
    s = F.coalesce(*[F.when(F.col("k") == k, F.sum("ret").over(w.rangeBetween(1 - k, 0))) for k in (1, 2, 4, 8)])
    pnl = r.withColumn("s", s).where("next_ret IS NOT NULL").groupBy("k", "week_idx").agg(F.avg(F.signum(F.round("s", 9)) * F.col("next_ret")).alias("pnl"))
    lo, hi = pnl.agg(F.min("week_idx"), F.max("week_idx") + 1).first()
    cuts = [(f, lo + (hi - lo) * f // 4, lo + (hi - lo) * (f + 1) // 4) for f in (1, 2, 3)] if lo is not None else []
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(a).alias("a"), F.lit(z).alias("z")) for f, a, z in cuts])).alias("c") if cuts else None
    if each is None:
        return pnl.select(F.lit(0).alias("fold"), F.col("k").alias("lookback"), F.col("pnl").alias("tested"), F.lit(0).cast("long").alias("weeks"))
    x = pnl.select("k", "week_idx", "pnl", each).select("k", "week_idx", "pnl", "c.*")
    before, inside = F.col("week_idx") < F.col("a"), (F.col("week_idx") >= F.col("a")) & (F.col("week_idx") < F.col("z"))
    ratio = lambda c: F.avg(F.when(c, F.col("pnl"))) / F.nullif(F.stddev_samp(F.when(c, F.col("pnl"))), F.lit(0.0))
    g = x.groupBy("fold", "k").agg(ratio(before).alias("trained"), ratio(inside).alias("tested"), F.count_if(inside).alias("weeks")).where("trained IS NOT NULL")
    order = F.struct(F.round("trained", 9), -F.col("k"))
    return g.groupBy("fold").agg(F.max_by("k", order).alias("lookback"), F.round(F.max_by("tested", order), 7).alias("tested"), F.max_by("weeks", order).alias("weeks"))


@query(f"SELECT symbol, CAST(day_no % 3 AS INTEGER) AS part, count(*) AS n, round(avg(close), 5) AS mean_close FROM {DAILY} d GROUP BY 1, 2")
def resumed_plan(spark: SparkSession, folder: str) -> DataFrame:
    """A plan of tasks by series and part, stopped after a third and taken up again: only what was missing is run."""
    root, d = f"{shared_folder(spark)}/results", daily(spark, folder).withColumn("part", (F.col("day_no") % 3).cast("int"))
    tasks = d.select("symbol", "part").distinct()

    def run(rest: DataFrame) -> DataFrame:
        return d.join(rest, ["symbol", "part"]).groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("close"), 5).alias("mean_close"))

    models.resumed(spark, tasks.where("part = 0"), ["symbol", "part"], root, "a", run, "first")
    models.resumed(spark, tasks.where("part = 1"), ["symbol", "part"], root, "b", run, "other")
    return models.resumed(spark, tasks, ["symbol", "part"], root, "a", run, "second")


_FLOW5 = f"(SELECT symbol, CAST((ts // 300000 + 1) * 300000 AS BIGINT) AS due, CAST(coalesce(sum(CASE side WHEN 'buy' THEN CAST(size AS DECIMAL(38,12)) WHEN 'sell' THEN -CAST(size AS DECIMAL(38,12)) END), 0) AS DOUBLE) AS flow FROM {FILLS} f GROUP BY 1, 2)"
_TICKS = f"(SELECT symbol, ts, max(price) AS price FROM {FILLS} f GROUP BY 1, 2)"


@query(f"""WITH s AS (SELECT symbol, due, -sign(flow) AS direction, due + 500 AS t0, due + 60500 AS t1 FROM {_FLOW5} f WHERE flow <> 0),
  a AS (SELECT s.*, p.price AS p0 FROM s ASOF LEFT JOIN {_TICKS} p ON s.symbol = p.symbol AND s.t0 >= p.ts), b AS (SELECT a.*, p.price AS p1 FROM a ASOF LEFT JOIN {_TICKS} p ON a.symbol = p.symbol AND a.t1 >= p.ts)
  SELECT symbol, count(*) AS trips, round(avg(direction * (ln(p1) - ln(p0)) * 10000), 6) + 0.0 AS captured_bps, round(avg(direction * (ln(p1) - ln(p0)) * 10000) - 11.0, 6) AS net_bps FROM b GROUP BY 1""")
def fade_round_trips(spark: SparkSession, folder: str) -> DataFrame:
    """Against the flow of each five minutes, entered after half a second and held for a minute, at last known prices; net of eleven basis points."""
    size = bars.exact("size")
    f = fills(spark, folder)
    flow = F.coalesce(F.sum(F.when(F.col("side") == "buy", size).when(F.col("side") == "sell", -size)), F.lit(0)).cast("double")
    s = f.groupBy("symbol", ((F.floor(F.col("ts") / 300_000) + 1) * 300_000).alias("at")).agg(flow.alias("flow")).where("flow <> 0").select("symbol", "at", (-F.signum("flow")).alias("direction"))
    for shift, name in ((500, "p0"), (60_500, "p1")):
        s = align.asof(s.withColumn("ts", F.col("at") + shift), f, ["symbol"], "price", tie="price").drop("ts", "value_ts").withColumnRenamed("value", name)
    bps = F.col("direction") * (F.ln("p1") - F.ln("p0")) * 10_000
    return s.groupBy("symbol").agg(F.count(F.lit(1)).alias("trips"), (F.round(F.avg(bps), 6) + 0.0).alias("captured_bps"), F.round(F.avg(bps) - 11.0, 6).alias("net_bps"))


@query(f"""WITH r AS (SELECT symbol, day_no, ln(close) - ln(lag(close) OVER w) AS r FROM {DAILY} d WINDOW w AS (PARTITION BY symbol ORDER BY day_no)), e AS (SELECT *, sum(r) OVER w AS equity, stddev_samp(r) OVER (PARTITION BY symbol ORDER BY day_no ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS vol, count(r) OVER (PARTITION BY symbol ORDER BY day_no ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS n FROM r WHERE r IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY day_no)),
  t AS (SELECT *, greatest(0, max(equity) OVER (PARTITION BY symbol ORDER BY day_no)) - equity AS dd FROM e)
  SELECT symbol, day_no, round(dd, 7) AS drawdown, coalesce(max(round(dd, 7) >= 3) OVER (PARTITION BY symbol ORDER BY day_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS halted, round(CASE WHEN n = 20 THEN least(1.0 / nullif(vol, 0), 1.0) END, 7) AS scale FROM t""")
def drawdown_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Drawdown from the running top, whether it had passed its limit before, and the size that the volatility so far allows."""
    r = daily(spark, folder).select("symbol", "day_no", (F.ln("close") - F.ln(F.lag("close").over(_day()))).alias("r")).where("r IS NOT NULL")
    past = _day().rowsBetween(-20, -1)
    e = r.withColumn("equity", F.sum("r").over(_day())).withColumn("vol", F.stddev_samp("r").over(past)).withColumn("n", F.count("r").over(past))
    t = e.withColumn("drawdown", F.round(F.greatest(F.lit(0.0), F.max("equity").over(_day())) - F.col("equity"), 7))
    halted = F.coalesce(F.max(F.col("drawdown") >= 3).over(_day().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return t.select("symbol", "day_no", "drawdown", halted.alias("halted"), F.round(F.when(F.col("n") == 20, F.least(1.0 / F.nullif("vol", F.lit(0.0)), F.lit(1.0))), 7).alias("scale"))
