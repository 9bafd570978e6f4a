"""Null models over the panel: what shuffles, simulations and resamples of it give where there is nothing to find.

Each query gives the observed statistic, which SQL has too, how many replicates stand against it, and
whether these behave as their theory says: that they lie around the centre it gives, and that the
add-one p is a possible one. The draws themselves come from generators seeded by replicate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.operators import resampling as rs
from tideglass.operators.grouped import per_series
from tideglass.plans.panel_queries import _SCORES, cropper_score
from tideglass.plans.registry import query
from tideglass.plans.views import DAILY, FILLS, RETURNS, daily, fills, weekly_returns

REPLICATES = 400
#: Cells of a panel (weeks by series) that may go to the driver and into every task.
MOST_CELLS = 20_000_000


def matrix(rows: DataFrame, at: str, series: str, value: str) -> tuple[np.ndarray, list, list]:
    """(times by series with NaN where there is none, times, series) of a panel of bounded size; a larger one is an error."""
    size = rows.agg(F.count_distinct(at).alias("a"), F.count_distinct(series).alias("b")).first()
    if size["a"] * size["b"] > MOST_CELLS:
        raise ValueError(f"a panel of {size['a']} times and {size['b']} series is too large to resample as a whole")
    got = rows.select(at, series, value).toPandas()
    p = got.pivot(index=at, columns=series, values=value).sort_index()
    return p.to_numpy(float), list(p.index), list(p.columns)


def _weeks(spark: SparkSession, folder: str) -> np.ndarray:
    """Weekly returns on a gapless axis of weeks."""
    x, weeks, _ = matrix(weekly_returns(spark, folder).where("ret IS NOT NULL").select("week_idx", "symbol", F.round("ret", 9).alias("ret")), "week_idx", "symbol", "ret")
    out = np.full((int(weeks[-1] - weeks[0]) + 1 if weeks else 0, x.shape[1]), np.nan)
    for w, row in zip(weeks, x, strict=True):
        out[int(w - weeks[0])] = row
    return out


def _judged(null: DataFrame, observed: float, centre: float | None = None, digits: int = 6, two_sided: bool = True) -> DataFrame:
    """Observed value, replicates, whether their mean lies within six standard errors of ``centre``, whether p is possible.

    A statistic that the panel is too small for is null, and there is nothing to judge then.
    """
    if not np.isfinite(observed):
        return null.agg(F.lit(None).cast("double").alias("observed"), F.count(F.lit(1)).alias("replicates"), F.lit(True).alias("p_possible"), F.lit(True).alias("sane"))
    p = rs.p_value(null, observed, two_sided)
    near = F.lit(True) if centre is None else F.abs(F.avg("statistic") - centre) <= 6 * F.stddev_samp("statistic") / F.sqrt(F.count(F.lit(1))) + 1e-12
    sane = null.agg(near.alias("centred"), F.count_if(F.isnan("statistic") | F.col("statistic").isNull()).alias("undefined"), F.lit(1).alias("_k"))
    out = p.withColumn("_k", F.lit(1)).join(sane, "_k")
    floor = 1 / (F.col("replicates") + 1)
    return out.select(F.round(F.lit(float(observed)), digits).alias("observed"), "replicates", ((F.col("p") >= floor) & (F.col("p") <= 1)).alias("p_possible"), (F.col("centred") & (F.col("undefined") == 0)).alias("sane"))


_HOURS = f"(SELECT symbol, CAST(ts // 3600000 % 24 AS INTEGER) AS hour, CASE side WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 ELSE 0 END AS s FROM {FILLS} f)"


@query(f"SELECT symbol, hour, s AS surrogate, count(*) AS n FROM {_HOURS} h GROUP BY 1, 2, 3")
def hour_block_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    """Trade sides shuffled in blocks of 32 within symbol and hour of the day: every class keeps its values."""
    f = fills(spark, folder).select("trade_id", "ts", "symbol", F.pmod(F.floor(F.col("ts") / 3_600_000), F.lit(24)).cast("int").alias("hour"), F.when(F.col("side") == "buy", 1).when(F.col("side") == "sell", -1).otherwise(0).alias("s"))
    out = rs.shuffled_blocks(f, ["symbol", "hour"], ["ts", "trade_id"], "s", 32, 5)
    return out.groupBy("symbol", "hour", "surrogate").agg(F.count(F.lit(1)).alias("n"))


_NEXT = f"(SELECT week_idx, round(ret, 9) AS ret, round(next_ret, 9) AS next_ret FROM {RETURNS} r WHERE ret IS NOT NULL AND next_ret IS NOT NULL)"


@query(f"SELECT week_idx, count(*) AS k, round(1 / sqrt(count(*) - 1), 8) AS theory, true AS near_theory FROM {_NEXT} n GROUP BY 1 HAVING count(*) >= 10")
def permutation_noise(spark: SparkSession, folder: str) -> DataFrame:
    """Spread of a week's rank correlation under shuffles, beside its exact value for untied ranks."""

    def spread(week, x):
        k = len(x)
        if k < 10:
            return None
        rng = np.random.default_rng([48, int(week[0])])
        ranks = rs.rank_rows(x[None, :])[0]
        drawn = np.argsort(rng.random((REPLICATES, k)), axis=1).astype(float)
        sd = rs.row_correlations(drawn, np.broadcast_to(ranks, drawn.shape)).std()
        theory = 1 / np.sqrt(k - 1)
        return {"k": k, "theory": round(theory, 8), "near_theory": bool(abs(sd / theory - 1) < 6 / np.sqrt(2 * REPLICATES))}

    r = weekly_returns(spark, folder).where("ret IS NOT NULL AND next_ret IS NOT NULL").select("week_idx", F.col("week_idx").alias("w"), "next_ret")
    return per_series(r, ["week_idx"], ["w"], ["next_ret"], spread, "k long, theory double, near_theory boolean")


_MEAN_IC = f"""(SELECT avg(ic) AS ic FROM (SELECT week_idx, corr(a, b) AS ic FROM (SELECT week_idx, rank() OVER (PARTITION BY week_idx ORDER BY ret) AS a, rank() OVER (PARTITION BY week_idx ORDER BY next_ret) AS b FROM {_NEXT} n) x GROUP BY 1 HAVING count(*) >= 5) y)"""


@query(f"SELECT round(ic, 6) AS observed, {REPLICATES} AS replicates, true AS p_possible, true AS sane FROM {_MEAN_IC} m")
def block_permutation_ic(spark: SparkSession, folder: str) -> DataFrame:
    """Mean weekly rank correlation against outcomes whose weeks are permuted in blocks of four."""
    x = _weeks(spark, folder)
    signal, outcome = x[:-1], x[1:]
    return _judged(rs.replicates(spark, REPLICATES, 49, rs.week_blocks_permuted(signal, outcome, 4)), rs.mean_ic(signal, outcome))


_TRAIL = f"""(SELECT week_idx, symbol, sum(coalesce(r9, 0)) OVER (PARTITION BY symbol ORDER BY week_idx RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS trail, round(next_ret, 9) AS next_ret, r9 FROM (SELECT *, round(ret, 9) AS r9 FROM {RETURNS} r) q)"""
_TRAIL_IC = f"""(SELECT avg(ic) AS ic FROM (SELECT week_idx, corr(a, b) AS ic FROM (SELECT week_idx, rank() OVER (PARTITION BY week_idx ORDER BY round(trail, 9)) AS a, rank() OVER (PARTITION BY week_idx ORDER BY next_ret) AS b FROM {_TRAIL} t WHERE r9 IS NOT NULL AND next_ret IS NOT NULL) x GROUP BY 1 HAVING count(*) >= 5) y)"""


def _momentum(x: np.ndarray) -> float:
    return rs.mean_ic(np.round(rs.trailing_sums(x, 4), 9)[:-1], x[1:])


@query(f"SELECT round(ic, 5) AS observed, {REPLICATES} AS replicates, true AS p_possible, true AS sane FROM {_TRAIL_IC} m")
def persistence_null(spark: SparkSession, folder: str) -> DataFrame:
    """Mean rank correlation of four-week momentum against panels that persist alike without a common signal."""
    x = _weeks(spark, folder)
    return _judged(rs.replicates(spark, REPLICATES, 50, rs.persistence_null(x, 4)), _momentum(x), digits=5)


@query(f"SELECT round(ic, 5) AS observed, {REPLICATES} AS replicates, true AS p_possible, true AS sane FROM {_TRAIL_IC} m")
def factor_null(spark: SparkSession, folder: str) -> DataFrame:
    """The same against panels of one persistent factor with the panel's loadings."""
    x = _weeks(spark, folder)
    return _judged(rs.replicates(spark, REPLICATES, 51, rs.factor_null(x, 4)), _momentum(x), digits=5)


@query(f"""WITH e AS (SELECT symbol, week_idx, ret - avg(ret) OVER (PARTITION BY symbol) AS e0 FROM {RETURNS} r WHERE ret IS NOT NULL), p AS (SELECT a.symbol, a.e0, b.e0 AS e1 FROM e a JOIN e b ON a.symbol = b.symbol AND b.week_idx = a.week_idx + 1),
  f AS (SELECT symbol, greatest(least(sum(e0 * e1) / nullif(sum(e0 * e0), 0), 0.98), -0.98) AS phi FROM p GROUP BY 1)
  SELECT p.symbol, round(max(phi), 6) AS phi, round(stddev_samp(e1 - phi * e0), 6) AS spread, count(*) AS n_pairs FROM p JOIN f ON p.symbol = f.symbol GROUP BY 1""")
def ar1_panel_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Persistence and error spread of every series, the inputs of the persistence null."""
    from pyspark.sql import Window

    own = Window.partitionBy("symbol")
    e = weekly_returns(spark, folder).where("ret IS NOT NULL").withColumn("e0", F.col("ret") - F.avg("ret").over(own))
    w = own.orderBy("week_idx")
    p = e.withColumn("e1", F.when(F.lead("week_idx").over(w) == F.col("week_idx") + 1, F.lead("e0").over(w))).where("e1 IS NOT NULL")
    phi = F.sum(F.col("e0") * F.col("e1")).over(own) / F.nullif(F.sum(F.col("e0") * F.col("e0")).over(own), F.lit(0.0))
    p = p.withColumn("phi", F.greatest(F.least(phi, F.lit(0.98)), F.lit(-0.98)))
    return p.groupBy("symbol").agg(F.round(F.max("phi"), 6).alias("phi"), F.round(F.stddev_samp(F.col("e1") - F.col("phi") * F.col("e0")), 6).alias("spread"), F.count(F.lit(1)).alias("n_pairs"))


@query(f"SELECT {REPLICATES} AS replicates, true AS between_noise_and_first, count(DISTINCT symbol) AS series FROM {RETURNS} r WHERE ret IS NOT NULL")
def one_factor_spectrum(spark: SparkSession, folder: str) -> DataFrame:
    """Second eigenvalue where one factor explains the first: above nothing, below the first one or the reach of noise."""
    x = np.nan_to_num(_weeks(spark, folder))
    x = x + np.where(x.std(0) > 0, 0.0, np.random.default_rng(52).standard_normal(x.shape) * 1e-6)  # a series that never moves correlates with none
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    null = rs.replicates(spark, REPLICATES, 52, rs.one_factor_second(float(values[-1]), vectors[:, -1], len(x)))
    edge = (1 + np.sqrt(x.shape[1] / len(x))) ** 2
    between = (F.min("statistic") > 0) & (F.max("statistic") < max(float(values[-1]), 1.5 * edge))
    return null.agg(F.count(F.lit(1)).alias("replicates"), between.alias("between_noise_and_first")).withColumn("series", F.lit(x.shape[1]).cast("long"))


_POINTERS = f"""(SELECT day_no FROM {_SCORES} s WHERE score IS NOT NULL GROUP BY day_no HAVING count(*) >= 5 AND greatest(count(*) FILTER (score >= 1.5), count(*) FILTER (score <= -1.5)) >= 0.2 * count(*) - 1e-9)"""


def _scores(spark: SparkSession, folder: str) -> tuple[np.ndarray, list]:
    x, days, _ = matrix(cropper_score(spark, folder).where("score IS NOT NULL"), "day_no", "symbol", "score")
    return x, days


@query(f"SELECT CAST((SELECT count(*) FROM {_POINTERS} p) AS DOUBLE) AS observed, {REPLICATES} AS replicates, true AS p_possible, true AS sane")
def pointer_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """Number of pointer days against circular shifts of each series by its own offset."""
    x, _ = _scores(spark, folder)
    return _judged(rs.replicates(spark, REPLICATES, 53, rs.rolled_columns_count(x)), rs.pointer_count(x), two_sided=False)


@query(f"""WITH m AS (SELECT day_no, avg(close) AS v FROM {DAILY} d GROUP BY 1), p AS (SELECT day_no FROM {_POINTERS} q) SELECT round(avg(v), 4) AS observed, {REPLICATES} AS replicates, true AS p_possible, true AS sane FROM m JOIN p ON m.day_no = p.day_no""")
def spaced_day_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """Mean level on pointer days against as many random days at least two days from any of them."""
    x, days = _scores(spark, folder)
    d = {r["day_no"]: r["v"] for r in daily(spark, folder).groupBy("day_no").agg(F.avg("close").alias("v")).collect()}
    first, last = int(min(d, default=0)), int(max(d, default=0))
    values = np.array([d.get(k, np.nan) for k in range(first, last + 1)])
    marked = np.array([int(k) - first for k, row in zip(days, x, strict=True) if rs.pointer_count(row[None, :])], dtype=int)
    observed, pool, draw = rs.spaced_days_mean(values, marked, 2)
    if len(pool) < len(marked):
        raise ValueError("fewer days may stand in than are marked")
    return _judged(rs.replicates(spark, REPLICATES, 54, draw), observed, float(values[pool].mean()), digits=4)


@query(f"SELECT signals, {REPLICATES} AS replicates, true AS centred FROM (SELECT unnest([2, 3, 4, 5]) AS signals) s")
def portfolio_null(spark: SparkSession, folder: str) -> DataFrame:
    """Sharpe ratios of portfolios of noise signals on the mean daily move, which lie around none."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("day_no")
    r = daily(spark, folder).withColumn("r", F.ln("close") - F.ln(F.lag("close").over(w))).groupBy("day_no").agg(F.avg("r").alias("r")).where("r IS NOT NULL").orderBy("day_no")
    x = np.array([v.r for v in r.collect()])
    out = None
    for k in (2, 3, 4, 5):
        n = rs.replicates(spark, REPLICATES, 55 + k, rs.noise_portfolio_sharpe(x, k, 20))
        centred = F.abs(F.avg("statistic")) <= 6 * F.stddev_samp("statistic") / F.sqrt(F.count(F.lit(1)))
        one = n.agg(F.lit(k).alias("signals"), F.count(F.lit(1)).alias("replicates"), centred.alias("centred"))
        out = one if out is None else out.unionByName(one)
    return out


_PAIRS = f"""(SELECT a, b, day_no, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM (SELECT a.symbol AS a, b.symbol AS b, a.day_no, a.close AS x, b.close AS y FROM {DAILY} a JOIN {DAILY} b ON a.day_no = b.day_no AND a.symbol < b.symbol) j WINDOW w AS (PARTITION BY a, b ORDER BY day_no))"""
_AVERAGE = "rank() OVER (PARTITION BY a, b, s ORDER BY {c}) + (count(*) OVER (PARTITION BY a, b, s, {c}) - 1) / 2.0"


@query(f"""WITH d AS (SELECT a, b, day_no % 5 = 0 AS s, dx, dy FROM {_PAIRS} p WHERE dx IS NOT NULL), r AS (SELECT a, b, s, {_AVERAGE.format(c="dx")} AS x, {_AVERAGE.format(c="dy")} AS y FROM d), c AS (SELECT a, b, s, count(*) AS n, coalesce(nullif(corr(x, y), 'nan'), 0.0) AS rho FROM r GROUP BY 1, 2, 3)
  SELECT u.a, u.b, variant, u.n AS stress_days, v.n AS quiet_days, round(u.rho - v.rho, 6) + 0.0 AS observed, 100 AS replicates, true AS sane FROM c u JOIN c v ON u.a = v.a AND u.b = v.b AND u.s AND NOT v.s, (SELECT unnest(['fixed', 'selected']) AS variant) q WHERE u.n >= 4 AND v.n >= 4""")
def coherence_null(spark: SparkSession, folder: str) -> DataFrame:
    """Lift of every pair's rank correlation on stress days (every fifth stands in) against independent block resamples of both sides.

    Pairs with fewer than four stress or quiet days have none. Sane: the lifts on fixed days lie around 0, those on selected days vary.
    """
    d = daily(spark, folder)
    one, two = d.select(F.col("symbol").alias("a"), "day_no", F.col("close").alias("x")), d.select(F.col("symbol").alias("b"), "day_no", F.col("close").alias("y"))
    pairs = one.join(two, "day_no").where("a < b").withColumn("_a", F.col("a")).withColumn("_b", F.col("b"))

    def judge(day, x, y, a, b):
        dx, dy, stress = np.diff(x), np.diff(y), day[1:] % 5 == 0
        observed = rs.stress_lift(dx, dy, stress)
        if not np.isfinite(observed):
            return None
        out = {n: [] for n in ("variant", "stress_days", "quiet_days", "observed", "replicates", "sane", "p")}
        for k, variant in enumerate(("fixed", "selected")):
            draw = rs.coherence_lift_null(dx, dy, stress, 20, variant == "selected")
            null = np.array([draw(np.random.default_rng([60 + k, int(a[0]), int(b[0]), i])) for i in range(100)])
            sane = np.isfinite(null).all() and (null.std() > 0 if k else abs(null.mean()) <= 6 * null.std(ddof=1) / 10 + 0.05)
            p = ((np.abs(null) >= abs(observed)).sum() + 1) / 101
            for name, v in zip(out, (variant, int(stress.sum()), int((~stress).sum()), round(observed, 6) + 0.0, 100, bool(sane), p), strict=True):
                out[name].append(v)
        return out

    got = per_series(pairs, ["a", "b"], ["day_no"], ["x", "y", "_a", "_b"], judge, "variant string, stress_days long, quiet_days long, observed double, replicates int, sane boolean, p double")
    return got.select("a", "b", "variant", "stress_days", "quiet_days", "observed", "replicates", (F.col("sane") & (F.col("p") > 0) & (F.col("p") <= 1)).alias("sane"))


@query("""WITH b AS (SELECT CAST(l_quantity AS INTEGER) AS q, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(max(n) FILTER (q = 25) AS DOUBLE) AS observed, 400 AS replicates, true AS p_possible, true AS sane FROM b""".replace("400", str(REPLICATES)))
def residual_bootstrap_p(spark: SparkSession, folder: str) -> DataFrame:
    """Count of one value against counts of the smooth fit with its residuals drawn again."""
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").groupBy(F.col("l_quantity").cast("int").alias("q")).agg(F.count(F.lit(1)).alias("n")).orderBy("q").collect()
    q, n = np.array([r.q for r in rows], float), np.array([r.n for r in rows], float)
    fitted = np.polyval(np.polyfit(q / 50, n, 3), q / 50)
    at = int(np.flatnonzero(q == 25)[0])
    null = rs.replicates(spark, REPLICATES, 62, rs.residual_bootstrap(n, fitted, lambda c: c[at]))
    return _judged(null, float(n[at]), float(fitted[at]), two_sided=False)
