"""Queries of statistics: information measures, tails, accuracy, false discovery, moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideglass.operators.ranks import rejected
from tideglass.plans.registry import query
from tideglass.plans.views import DAILY, FILLS, RETURNS, daily, fills, weekly_returns
from tideglass.sources.tables import table

def _by_day_no():
    return Window.partitionBy("symbol").orderBy("day_no")


@query(f"""SELECT day, round(sum(p * p), 10) AS hhi, arg_max(symbol, (p, symbol)) AS largest FROM (SELECT ts // 86400000 AS day, symbol, sum(size) / sum(sum(size)) OVER (PARTITION BY ts // 86400000) AS p FROM {FILLS} f GROUP BY 1, 2) x GROUP BY day""")
def volume_concentration(spark: SparkSession, folder: str) -> DataFrame:
    v = fills(spark, folder).groupBy(F.floor(F.col("ts") / 86_400_000).alias("day"), "symbol").agg(F.sum("size").alias("v"))
    p = v.withColumn("p", F.col("v") / F.sum("v").over(Window.partitionBy("day")))
    return p.groupBy("day").agg(F.round(F.sum(F.col("p") * F.col("p")), 10).alias("hhi"), F.max_by("symbol", F.struct("p", "symbol")).alias("largest"))


_LOSS = f"(SELECT symbol, -(ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY day_no))) AS loss FROM {DAILY} d)"


@query(f"""WITH t AS (SELECT symbol, loss, quantile_cont(loss, 0.9) OVER (PARTITION BY symbol) AS u FROM {_LOSS} l WHERE loss IS NOT NULL)
  SELECT symbol, count(*) AS n, round(avg(ln(loss / u)), 8) AS hill, round(avg(loss - u), 8) AS mean_excess FROM t WHERE loss > u AND u > 0 GROUP BY symbol""")
def hill_tail(spark: SparkSession, folder: str) -> DataFrame:
    """Hill estimate and mean excess over the 90th percentile of losses."""
    l = daily(spark, folder).select("symbol", (-(F.ln("close") - F.ln(F.lag("close").over(_by_day_no())))).alias("loss")).where("loss IS NOT NULL")  # noqa: E741
    u = l.groupBy("symbol").agg(F.percentile("loss", 0.9).alias("u"))
    return l.join(u, "symbol").where("loss > u AND u > 0").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.ln(F.col("loss") / F.col("u"))), 8).alias("hill"), F.round(F.avg(F.col("loss") - F.col("u")), 8).alias("mean_excess"))


@query(f"""WITH m AS (SELECT symbol, ln(abs(loss)) / ln(10) AS m FROM {_LOSS} l WHERE loss <> 0), t AS (SELECT symbol, m, quantile_cont(m, 0.5) OVER (PARTITION BY symbol) AS c FROM m)
  SELECT symbol, count(*) AS n, round(1 / ln(10) / nullif(avg(m - c), 0), 6) AS b_value FROM t WHERE m >= c GROUP BY symbol""")
def magnitude_law(spark: SparkSession, folder: str) -> DataFrame:
    """How fast the number of moves falls with their magnitude (log10), by likelihood above the median one."""
    m = daily(spark, folder).select("symbol", (F.ln("close") - F.ln(F.lag("close").over(_by_day_no()))).alias("r")).where("r <> 0").select("symbol", (F.ln(F.abs("r")) / F.ln(F.lit(10.0))).alias("m"))
    t = m.join(m.groupBy("symbol").agg(F.percentile("m", 0.5).alias("c")), "symbol").where("m >= c")
    return t.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(1 / F.ln(F.lit(10.0)) / F.nullif(F.avg(F.col("m") - F.col("c")), F.lit(0.0)), 6).alias("b_value"))


@query("""WITH e AS (SELECT (event_type = 'purchase')::INT AS y, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM events)
  SELECT count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 8) AS auc FROM e""")
def auc(spark: SparkSession, folder: str) -> DataFrame:
    """Rank-sum AUC of ``value`` for one event type. The global rank comes from counts per distinct value."""
    by = table(spark, folder, "events").groupBy("value").agg(F.count_if(F.col("event_type") == "purchase").alias("pos"), F.count_if(F.col("event_type") != "purchase").alias("neg"))
    span = by.withColumn("_part", F.floor(F.col("value")))
    sums = span.groupBy("_part").agg(F.sum("neg").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("_part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = span.withColumn("_below", below).join(sums, "_part").withColumn("wins", F.col("pos") * (F.col("_below") + F.col("_before") + F.col("neg") / 2))
    return r.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.round(F.sum("wins") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0)), 8).alias("auc"))


@query(f"""SELECT count(*) AS n, round(avg(CASE WHEN sign(ret) = sign(next_ret) THEN 1.0 ELSE 0.0 END), 8) AS hit_rate FROM {RETURNS} r WHERE ret <> 0 AND next_ret <> 0""")
def hit_rate(spark: SparkSession, folder: str) -> DataFrame:
    r = weekly_returns(spark, folder).where("ret <> 0 AND next_ret <> 0")
    return r.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.signum("ret") == F.signum("next_ret"), 1.0).otherwise(0.0)), 8).alias("hit_rate"))


@query(f"""WITH b AS (SELECT symbol, (4 * row_number() OVER (PARTITION BY symbol ORDER BY ret, week_idx) - 1) // count(*) OVER (PARTITION BY symbol) AS x, (4 * row_number() OVER (PARTITION BY symbol ORDER BY next_ret, week_idx) - 1) // count(*) OVER (PARTITION BY symbol) AS y
  FROM {RETURNS} r WHERE ret IS NOT NULL AND next_ret IS NOT NULL), c AS (SELECT symbol, x, y, count(*) AS n FROM b GROUP BY 1, 2, 3),
  m AS (SELECT *, sum(n) OVER (PARTITION BY symbol, x) AS nx, sum(n) OVER (PARTITION BY symbol, y) AS ny, sum(n) OVER (PARTITION BY symbol) AS t FROM c)
  SELECT symbol, round(sum(n / t * ln(n * t / (nx * ny))), 8) AS mutual_info FROM m GROUP BY symbol""")
def mutual_information(spark: SparkSession, folder: str) -> DataFrame:
    """Plug-in mutual information in nats of this and next week's return, in four rank bins each."""
    from tideglass.operators.ranks import floor_bucket

    r = weekly_returns(spark, folder).where("ret IS NOT NULL AND next_ret IS NOT NULL")
    b = r.withColumn("x", floor_bucket(["symbol"], [F.col("ret"), F.col("week_idx")], 4)).withColumn("y", floor_bucket(["symbol"], [F.col("next_ret"), F.col("week_idx")], 4))
    c = b.groupBy("symbol", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    total = lambda *g: F.sum("n").over(Window.partitionBy("symbol", *g))
    m = c.withColumn("nx", total("x")).withColumn("ny", total("y")).withColumn("t", total())
    return m.groupBy("symbol").agg(F.round(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))), 8).alias("mutual_info"))


_STATES = f"""(SELECT symbol, week_idx, (3 * row_number() OVER (PARTITION BY symbol ORDER BY ret, week_idx) - 1) // count(*) OVER (PARTITION BY symbol) AS s FROM {RETURNS} r WHERE ret IS NOT NULL)"""


@query(f"""WITH s AS {_STATES}, m AS (SELECT a.symbol AS source, b.symbol, n.s AS nxt, b.s AS own, a.s AS src, count(*) AS c FROM s b JOIN s n ON n.symbol = b.symbol AND n.week_idx = b.week_idx + 1 JOIN s a ON a.week_idx = b.week_idx WHERE b.symbol <> a.symbol GROUP BY 1, 2, 3, 4, 5),
  t AS (SELECT *, sum(c) OVER (PARTITION BY source, symbol) AS t, sum(c) OVER (PARTITION BY source, symbol, own, src) AS os, sum(c) OVER (PARTITION BY source, symbol, nxt, own) AS no, sum(c) OVER (PARTITION BY source, symbol, own) AS o FROM m)
  SELECT source, symbol, round(greatest(sum(c / t * log2(c * o / (os * no))), 0), 8) AS transfer_entropy, CAST(max(t) AS BIGINT) AS n FROM t GROUP BY source, symbol""")
def transfer_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Transfer entropy in bits from each series (source) to each other, three rank bins, lag of one week."""
    from tideglass.operators.ranks import floor_bucket

    s = weekly_returns(spark, folder).where("ret IS NOT NULL").withColumn("s", floor_bucket(["symbol"], [F.col("ret"), F.col("week_idx")], 3))
    own = s.select("symbol", "week_idx", F.col("s").alias("own"))
    nxt = s.select("symbol", (F.col("week_idx") - 1).alias("week_idx"), F.col("s").alias("nxt"))
    src = s.select(F.col("symbol").alias("source"), "week_idx", F.col("s").alias("src"))
    c = own.join(nxt, ["symbol", "week_idx"]).join(src, "week_idx").where("source <> symbol").groupBy("source", "symbol", "nxt", "own", "src").agg(F.count(F.lit(1)).alias("c"))
    total = lambda *g: F.sum("c").over(Window.partitionBy("source", "symbol", *g))
    t = c.withColumn("t", total()).withColumn("os", total("own", "src")).withColumn("no", total("nxt", "own")).withColumn("o", total("own"))
    te = F.sum(F.col("c") / F.col("t") * F.log2(F.col("c") * F.col("o") / (F.col("os") * F.col("no"))))
    return t.groupBy("source", "symbol").agg(F.round(F.greatest(te, F.lit(0.0)), 8).alias("transfer_entropy"), F.max("t").alias("n"))


_CODES = f"""(SELECT symbol, CASE WHEN a <= b AND b <= c THEN 0 WHEN a <= c AND c < b THEN 1 WHEN b < a AND a <= c THEN 2 WHEN c < a AND a <= b THEN 3 WHEN b <= c AND c < a THEN 4 ELSE 5 END AS code FROM (
  SELECT symbol, lag(close, 2) OVER w AS a, lag(close, 1) OVER w AS b, close AS c FROM {DAILY} d WINDOW w AS (PARTITION BY symbol ORDER BY day_no)) x WHERE a IS NOT NULL)"""


@query(f"""SELECT symbol, CAST(sum(n) AS BIGINT) AS n, round(-sum(n / t * ln(n / t)) / ln(6), 8) AS perm_entropy FROM (SELECT symbol, count(*) AS n, sum(count(*)) OVER (PARTITION BY symbol) AS t FROM {_CODES} c GROUP BY symbol, code) x GROUP BY symbol""")
def permutation_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Entropy of ordinal patterns of three closes, as share of its maximum; ties go by time."""
    x = daily(spark, folder).select("symbol", F.lag("close", 2).over(_by_day_no()).alias("a"), F.lag("close", 1).over(_by_day_no()).alias("b"), F.col("close").alias("c")).where("a IS NOT NULL")
    code = F.expr("CASE WHEN a <= b AND b <= c THEN 0 WHEN a <= c AND c < b THEN 1 WHEN b < a AND a <= c THEN 2 WHEN c < a AND a <= b THEN 3 WHEN b <= c AND c < a THEN 4 ELSE 5 END")
    n = x.groupBy("symbol", code.alias("code")).agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.sum("n").over(Window.partitionBy("symbol")))
    p = F.col("n") / F.col("t")
    return n.groupBy("symbol").agg(F.sum("n").alias("n"), F.round(-F.sum(p * F.ln(p)) / F.ln(F.lit(6.0)), 8).alias("perm_entropy"))


_P = f"(SELECT symbol, round(2 * (1 - least(abs(avg(ret)) / nullif(stddev_samp(ret), 0) * sqrt(count(ret)), 4) / 4), 6) / 2 AS p FROM {RETURNS} r WHERE ret IS NOT NULL GROUP BY symbol)"


def _tests(spark: SparkSession, folder: str) -> DataFrame:
    r = weekly_returns(spark, folder).where("ret IS NOT NULL").groupBy("symbol").agg((F.abs(F.avg("ret")) / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * F.sqrt(F.count("ret"))).alias("t"))
    return r.select("symbol", (F.round(2 * (1 - F.least("t", F.lit(4.0)) / 4), 6) / 2).alias("p"))


@query(f"""WITH r AS (SELECT symbol, p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM {_P} t) SELECT symbol, p, k <= coalesce(max(CASE WHEN p <= k * 0.9 / m THEN k END) OVER (), 0) AS rejected FROM r""")
def bh_fdr(spark: SparkSession, folder: str) -> DataFrame:
    return rejected(_tests(spark, folder), "p", 0.9)


@query(f"""WITH r AS (SELECT symbol, p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM {_P} t), h AS (SELECT *, (SELECT sum(1.0 / i) FROM (SELECT unnest(generate_series(1, (SELECT count(*) FROM {_P} z))) AS i) q) AS hm FROM r)
  SELECT symbol, p, k <= coalesce(max(CASE WHEN p <= k * 0.9 / (m * hm) THEN k END) OVER (), 0) AS rejected FROM h""")
def by_fdr(spark: SparkSession, folder: str) -> DataFrame:
    return rejected(_tests(spark, folder), "p", 0.9, dependent=True)


_Z = f"(SELECT symbol, ret - avg(ret) OVER (PARTITION BY symbol) AS d FROM {RETURNS} r WHERE ret IS NOT NULL)"


@query(f"""SELECT symbol, count(*) AS n, round(avg(d * d * d) / nullif(power(avg(d * d), 1.5), 0), 6) AS skew, round(avg(d * d * d * d) / nullif(power(avg(d * d), 2), 0) - 3, 6) AS excess_kurtosis FROM {_Z} z GROUP BY symbol""")
def moments(spark: SparkSession, folder: str) -> DataFrame:
    """Population skewness and excess kurtosis."""
    return weekly_returns(spark, folder).where("ret IS NOT NULL").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.skewness("ret"), 6).alias("skew"), F.round(F.kurtosis("ret"), 6).alias("excess_kurtosis"))


@query(f"""SELECT symbol, round(1 - sum((next_ret - ret) * (next_ret - ret)) / nullif(sum((next_ret - m) * (next_ret - m)), 0), 7) AS oos_r2 FROM (SELECT *, avg(next_ret) OVER (PARTITION BY symbol) AS m FROM {RETURNS} r WHERE ret IS NOT NULL AND next_ret IS NOT NULL) x GROUP BY symbol""")
def oos_r2(spark: SparkSession, folder: str) -> DataFrame:
    """1 - SS(error of the last value as forecast) / SS(around the mean)."""
    r = weekly_returns(spark, folder).where("ret IS NOT NULL AND next_ret IS NOT NULL")
    e = F.col("next_ret") - F.col("ret")
    return r.groupBy("symbol").agg(F.round(1 - F.sum(e * e) / F.nullif(F.var_pop("next_ret") * F.count("next_ret"), F.lit(0.0)), 7).alias("oos_r2"))


@query(f"""SELECT symbol, round(avg(a / f - ln(a / f) - 1), 7) AS qlike, count(*) AS n FROM (SELECT symbol, ret * ret + 1e-6 AS f, next_ret * next_ret + 1e-6 AS a FROM {RETURNS} r WHERE ret IS NOT NULL AND next_ret IS NOT NULL) x GROUP BY symbol""")
def qlike(spark: SparkSession, folder: str) -> DataFrame:
    r = weekly_returns(spark, folder).where("ret IS NOT NULL AND next_ret IS NOT NULL")
    ratio = (F.col("next_ret") * F.col("next_ret") + 1e-6) / (F.col("ret") * F.col("ret") + 1e-6)
    return r.groupBy("symbol").agg(F.round(F.avg(ratio - F.ln(ratio) - 1), 7).alias("qlike"), F.count(F.lit(1)).alias("n"))


@query(f"""SELECT symbol, round(quantile_cont(ret, 0.05), 9) AS p5, round(quantile_cont(ret, 0.5), 9) AS p50, round(quantile_cont(ret, 0.95), 9) AS p95, round(stddev_samp(ret), 9) AS sd FROM {RETURNS} r WHERE ret IS NOT NULL GROUP BY symbol""")
def distribution_report(spark: SparkSession, folder: str) -> DataFrame:
    q = F.percentile("ret", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    r = weekly_returns(spark, folder).where("ret IS NOT NULL").groupBy("symbol").agg(q.alias("q"), F.stddev_samp("ret").alias("sd"))
    return r.select("symbol", *[F.round(F.col("q")[k], 9).alias(n) for k, n in enumerate(("p5", "p50", "p95"))], F.round("sd", 9).alias("sd"))


@query(f"""WITH e AS (SELECT symbol, ret - avg(ret) OVER (PARTITION BY symbol) AS e0, next_ret - avg(ret) OVER (PARTITION BY symbol) AS e1 FROM {RETURNS} r WHERE ret IS NOT NULL)
  SELECT symbol, round(sum(e0 * e1) / nullif(sum(e0 * e0) FILTER (e1 IS NOT NULL), 0), 7) AS phi, count(e1) AS n FROM e GROUP BY symbol""")
def ar1(spark: SparkSession, folder: str) -> DataFrame:
    """First-order autoregression through the mean, over consecutive weeks."""
    e = weekly_returns(spark, folder).where("ret IS NOT NULL").withColumn("m", F.avg("ret").over(Window.partitionBy("symbol"))).select("symbol", (F.col("ret") - F.col("m")).alias("e0"), (F.col("next_ret") - F.col("m")).alias("e1"))
    return e.groupBy("symbol").agg(F.round(F.sum(F.col("e0") * F.col("e1")) / F.nullif(F.sum(F.when(F.col("e1").isNotNull(), F.col("e0") * F.col("e0"))), F.lit(0.0)), 7).alias("phi"), F.count("e1").alias("n"))


@query("""WITH d AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS v FROM d GROUP BY 1, 2)
  SELECT a.label AS a, b.label AS b, round(1 - sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 8) AS distance FROM m a JOIN m b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2""")
def centroid_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine distance between mean embeddings of every two labels."""
    d = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    m = d.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    j = m.alias("a").join(m.alias("b"), (F.col("a.i") == F.col("b.i")) & (F.col("a.label") < F.col("b.label")))
    s = lambda x, y: F.sum(F.col(f"{x}.v") * F.col(f"{y}.v"))
    return j.groupBy(F.col("a.label").alias("a"), F.col("b.label").alias("b")).agg(F.round(1 - s("a", "b") / F.sqrt(s("a", "a") * s("b", "b")), 8).alias("distance"))
