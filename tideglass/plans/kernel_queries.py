"""Queries of kernels and sequential operators, which SQL can't express; tested against brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.functions import kernels as k
from tideglass.operators import backtest as bt
from tideglass.operators import resampling as rs
from tideglass.operators.grouped import per_series
from tideglass.operators.orderbook import delta_frames, quote_fills, refilled_levels, sampled_books, snapshot_minutes
from tideglass.plans.registry import query
from tideglass.plans.views import DAILY, FILLS, QUOTES, daily, fills, quotes, weekly_returns
from tideglass.session import shared_folder, written
from tideglass.sources.sinks import write_days
from tideglass.sources.tables import table


def _closes(spark: SparkSession, folder: str) -> DataFrame:
    return daily(spark, folder).select("symbol", "day_no", F.ln("close").alias("x"))


def _prices(spark: SparkSession, folder: str) -> DataFrame:
    """Marks per symbol and UTC day."""
    return quotes(spark, folder).where("mark_price > 0").select("symbol", "day", "ts", F.ln("mark_price").alias("x"))


def _series(name: str, f, frame: str = "closes", sql: str | None = None, digits: int | None = None):
    """Register a kernel on the daily closes (per symbol) or the marks (per symbol and day): one value per reading."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        kernel = lambda t, x: {"at": t, "value": f(t, x)}
        if frame == "closes":
            out = per_series(_closes(spark, folder), ["symbol"], ["day_no"], ["x"], kernel, "at double, value double")
        else:
            out = per_series(_prices(spark, folder), ["symbol", "day"], ["ts"], ["x"], kernel, "at double, value double")
        return out if digits is None else out.withColumn("value", F.round("value", digits) + 0.0)

    run.__name__ = name
    query(sql)(run)


_RETURN = f"(SELECT symbol, day_no, ln(close) AS x, ln(close) - coalesce(lag(ln(close)) OVER (PARTITION BY symbol ORDER BY day_no), ln(close)) AS r FROM {DAILY} d)"
_MAD = f"""WITH w AS (SELECT symbol, day_no, list(r) OVER (PARTITION BY symbol ORDER BY day_no ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS v FROM {_RETURN} r), m AS (SELECT *, list_aggregate(v, 'median') AS m FROM w)
  SELECT symbol, CAST(day_no AS DOUBLE) AS at, round(CASE WHEN len(v) >= 20 THEN 1.4826 * list_aggregate(list_transform(v, lambda x: abs(x - m)), 'median') END, 8) + 0.0 AS value FROM m"""
_FFD = f"""WITH RECURSIVE w AS (SELECT 0 AS k, CAST(1.0 AS DOUBLE) AS w UNION ALL SELECT k + 1, -w * (0.4 - (k + 1) + 1) / (k + 1) FROM w WHERE abs(-w * (0.4 - (k + 1) + 1) / (k + 1)) >= 1e-4),
  s AS (SELECT symbol, day_no, x, row_number() OVER (PARTITION BY symbol ORDER BY day_no) AS i FROM {_RETURN} r)
  SELECT a.symbol, CAST(a.day_no AS DOUBLE) AS at, round(CASE WHEN a.i >= (SELECT count(*) FROM w) THEN sum(w.w * b.x) END, 7) + 0.0 AS value FROM s a JOIN w ON true LEFT JOIN s b ON b.symbol = a.symbol AND b.i = a.i - w.k GROUP BY a.symbol, a.day_no, a.i"""
_PE = f"""WITH x AS (SELECT symbol, day_no, lag(close, 2) OVER w AS a, lag(close) OVER w AS b, close AS c FROM {DAILY} d WINDOW w AS (PARTITION BY symbol ORDER BY day_no)),
  o AS (SELECT symbol, day_no, CASE WHEN a IS NULL THEN NULL ELSE (a > b)::INT * 4 + (a > c)::INT * 2 + (b > c)::INT END AS code FROM x),
  l AS (SELECT symbol, day_no, list(code) OVER w AS v, count(code) OVER w AS n FROM o WINDOW w AS (PARTITION BY symbol ORDER BY day_no ROWS 27 PRECEDING)),
  h AS (SELECT symbol, day_no, n, list_sum(list_transform([0, 1, 3, 4, 6, 7], lambda c: CASE WHEN len(list_filter(v, lambda y: y = c)) > 0 THEN -len(list_filter(v, lambda y: y = c)) / 28.0 * ln(len(list_filter(v, lambda y: y = c)) / 28.0) ELSE 0 END)) / ln(6) AS e FROM l)
  SELECT symbol, CAST(day_no AS DOUBLE) AS at, round(CASE WHEN n = 28 THEN e END, 7) + 0.0 AS value FROM h"""
_CHAIN = f"""WITH s AS (SELECT symbol, (r > 0)::INT AS b, row_number() OVER (PARTITION BY symbol ORDER BY day_no) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM {_RETURN} r),
  p AS (SELECT symbol, n, i, b AS a, lead(b) OVER (PARTITION BY symbol ORDER BY i) AS z FROM s), c AS (SELECT symbol, a, z, count(*) AS k FROM p WHERE i + 1 < n // 2 GROUP BY 1, 2, 3), m AS (SELECT symbol, a, sum(k) AS k FROM c GROUP BY 1, 2)
  SELECT p.symbol, round(-avg(ln((coalesce(c.k, 0) + 0.5) / (coalesce(m.k, 0) + 1.0))), 7) AS cross_entropy FROM p LEFT JOIN c ON p.symbol = c.symbol AND p.a = c.a AND p.z = c.z LEFT JOIN m ON p.symbol = m.symbol AND p.a = m.a WHERE i >= n // 2 AND p.z IS NOT NULL AND n >= 30 GROUP BY 1"""
_THROTTLED = f"""WITH RECURSIVE q AS (SELECT symbol, CAST(ts // 86400000 AS BIGINT) AS day, ts FROM {QUOTES} q WHERE mark_price > 0),
  n AS (SELECT a.symbol, a.day, a.ts, min(b.ts) AS nxt FROM q a LEFT JOIN q b ON a.symbol = b.symbol AND a.day = b.day AND b.ts >= a.ts + 60000 GROUP BY 1, 2, 3),
  k AS (SELECT symbol, day, min(ts) AS ts FROM q GROUP BY 1, 2 UNION ALL SELECT n.symbol, n.day, n.nxt FROM k JOIN n ON n.symbol = k.symbol AND n.day = k.day AND n.ts = k.ts WHERE n.nxt IS NOT NULL)
  SELECT q.symbol, q.day, CAST(q.ts AS DOUBLE) AS at, CAST(k.ts IS NOT NULL AS DOUBLE) AS value FROM q LEFT JOIN k ON q.symbol = k.symbol AND q.day = k.day AND q.ts = k.ts"""
_ret = lambda x: np.diff(x, prepend=x[:1])
_series("rolling_permutation_entropy", lambda t, x: k.rolling_permutation_entropy(x, 30, 3), sql=_PE, digits=7)
_series("changepoints", lambda t, x: k.changepoint_probability(_ret(x) / k.expanding_spread(_ret(x))))
_series("regime_probability", lambda t, x: k.two_state_filter(_ret(x)), "marks")
_series("kalman_premium", lambda t, x: k.kalman_level(x - x[0], np.maximum(np.diff(t, prepend=t[:1]) / 60_000, 0)), "marks")
_series("fractional_difference", lambda t, x: k.fractional_difference(x), sql=_FFD, digits=7)
_series("wavelet_denoised", lambda t, x: k.haar_denoised(x), "marks")
_series("causal_mad_scale", lambda t, x: k.causal_mad(_ret(x)), sql=_MAD, digits=8)
_series("har_forecast", lambda t, x: k.har_forecast(_ret(x) ** 2 + 1e-12))
_series("throttled_evaluation", lambda t, x: k.thinned(t, 60_000).astype(float), "marks", _THROTTLED)


def _scalar(name: str, f, schema: str, sql: str | None = None, digits: int | None = None):
    """Register a kernel on the daily closes that gives one row per symbol."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = per_series(_closes(spark, folder), ["symbol"], ["day_no"], ["x"], lambda t, x: f(_ret(x)) if len(x) >= 30 else None, schema)
        return out if digits is None else out.select("symbol", *[F.round(c, digits).alias(c) for c in out.columns if c != "symbol"])

    run.__name__ = name
    query(sql)(run)


def _windows(name: str, f, schema: str, size: int = 256, least: int = 30):
    """Register a kernel whose work grows with the square of its input on consecutive windows of the daily returns: one row per window, all days in one."""

    def over(t, x):
        rows = [{"window_start": t[s], **f(r)} for s, r in k.windows(_ret(x), size, least)] if len(x) >= least else None
        return {n: [r[n] for r in rows] for n in rows[0]} if rows else None

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return per_series(_closes(spark, folder), ["symbol"], ["day_no"], ["x"], over, f"window_start double, {schema}")

    run.__name__ = name
    query()(run)


_windows("recurrence_measures", lambda r: k.recurrence(r, np.std(r) * 0.5), "rate double, determinism double, laminarity double")
_scalar("multifractal", lambda r: {f"h_{n}": v for n, v in zip(("neg2", "0", "2"), k.generalised_hurst(r).values(), strict=True)}, "h_neg2 double, h_0 double, h_2 double")
_windows("component_persistence", lambda r: {"longest": k.persistence_lengths(np.stack([r[:-1], r[1:]], 1))[0]}, "longest double")
_scalar("cfar_peaks", lambda r: {"bin": [p for p, _ in k.cell_average_peaks(np.abs(np.fft.rfft(r)) ** 2)], "ratio": [v for _, v in k.cell_average_peaks(np.abs(np.fft.rfft(r)) ** 2)]}, "bin int, ratio double")
_scalar("cyclic_features", lambda r: {"peak": float(k.cyclic_spectrum(r)[1:].max(initial=0.0))}, "peak double")
_scalar("tail_fit", lambda r: dict(zip(("xi_pwm", "beta_pwm", "xi_mle", "beta_mle"), (*k.gpd_moments(_excess(r)), *k.gpd_likelihood(_excess(r))), strict=True)), "xi_pwm double, beta_pwm double, xi_mle double, beta_mle double")
_scalar("sax_word", lambda r: {"word": k.sax(np.cumsum(r), 16, 6), "self_score": k.local_alignment(k.sax(np.cumsum(r), 16, 6), k.sax(np.cumsum(r[::-1]), 16, 6))}, "word string, self_score double")
_scalar("markov_entropy", lambda r: {"cross_entropy": k.markov_cross_entropy((r[: len(r) // 2] > 0).astype(int), (r[len(r) // 2 :] > 0).astype(int), 2)}, "cross_entropy double", _CHAIN, 7)
_scalar("surrogate_asymmetry", lambda r: {"observed": float((r**3).mean()), "surrogate": float((np.diff(k.phase_surrogate(r, np.random.default_rng(7))) ** 3).mean())}, "observed double, surrogate double")
_windows("analog_crps", lambda r: _analog(r), "crps double, n int, mean_rank double")
_scalar("aftershocks", lambda r: dict(zip(("k", "c", "p"), k.omori(np.flatnonzero(np.abs(r) > 1.5 * r.std()).astype(float)), strict=True)), "k double, c double, p double")


def _excess(r: np.ndarray) -> np.ndarray:
    u = np.quantile(-r, 0.9)
    return -r[-r > u] - u


def _analog(r: np.ndarray) -> dict[str, float]:
    f = np.stack([r[1:-1], r[:-2]], 1)
    got = k.analog_forecast(f, r[2:], 10)
    scores = [k.crps(g, v) for g, v in zip(got, r[2:], strict=True) if np.isfinite(g).all()]
    ranks = [float((g < v).mean()) for g, v in zip(got, r[2:], strict=True) if np.isfinite(g).all()]
    return {"crps": float(np.mean(scores)) if scores else None, "n": len(scores), "mean_rank": float(np.mean(ranks)) if ranks else None}


@query()
def hawkes_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Self-excitation of trade times per symbol and hour; nulls for hours of fewer than three trades or a single time."""
    f = fills(spark, folder).withColumn("hour", F.floor(F.col("ts") / 3_600_000))
    def fit(t, s):
        return dict(zip(("mu", "branching", "decay"), k.hawkes(t / 1000), strict=True))
    return per_series(f, ["symbol", "hour"], ["ts"], ["size"], fit, "mu double, branching double, decay double")


@query()
def bunching_at_round_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Excess mass of notional at ten thousand per symbol and day."""
    f = fills(spark, folder).select("symbol", "day", "ts", (F.col("price") * F.col("size") / 1e4).alias("share"))
    return per_series(f, ["symbol", "day"], ["ts"], ["share"], lambda t, s: {"excess": k.bunching(s[np.isfinite(s)]), "n": len(s)}, "excess double, n long")


@query()
def spectrum_of_weeks(spark: SparkSession, folder: str) -> DataFrame:
    """Correlation spectrum and effective number of the weekly returns of a year, over series without gaps."""
    r = weekly_returns(spark, folder).where("ret IS NOT NULL").withColumn("year", F.floor(F.col("week_idx") / 52))
    def spectrum(week, symbol, ret):
        rows = {(w, s): v for w, s, v in zip(week, symbol, ret, strict=True)}
        weeks, names = np.unique(week), np.unique(symbol)
        m = np.array([[rows.get((w, s), np.nan) for s in names] for w in weeks])
        m = m[:, np.isfinite(m).mean(0) > 0.8]
        m = m[np.isfinite(m).all(1)]
        if m.shape[0] < 10 or m.shape[1] < 2:
            return None
        c = k.correlation_spectrum(m)
        return {"largest": c["values"][0], "edge": c["edge"], "above": c["above"], "ipr": c["ipr"], "effective": k.effective_number(m)}
    return per_series(r, ["year"], ["week_idx", "symbol"], ["ret"], spectrum, "largest double, edge double, above int, ipr double, effective double")


@query()
def wavelet_leads(spark: SparkSession, folder: str) -> DataFrame:
    """Lead of the first over the second series of every pair by Morlet cross spectrum of the daily closes."""
    c = _closes(spark, folder)
    first = c.select(F.col("symbol").alias("a"), "day_no", F.col("x").alias("y"))
    j = c.withColumnRenamed("symbol", "b").join(first, "day_no").where("a < b")
    return per_series(j, ["a", "b"], ["day_no"], ["x", "y"], lambda t, x, y: {"lead_days": k.wavelet_lead(np.diff(y), np.diff(x))} if len(x) > 64 else None, "lead_days double")


@query()
def non_overlapping_events(spark: SparkSession, folder: str) -> DataFrame:
    """Large moves of the mark kept at least an hour apart, greedily, per symbol and day."""
    def find(t, x):
        r = _ret(x)
        big = np.abs(r) > 3 * (np.median(np.abs(r)) * 1.4826 or np.inf)
        at = t[big]
        kept = at[k.thinned(at, 3_600_000)]
        return {"at": kept} if len(kept) else None
    return per_series(_prices(spark, folder), ["symbol", "day"], ["ts"], ["x"], find, "at double")


_LEVELS = """(SELECT DISTINCT row_id, symbol, ts, lower(side) AS side, level, CASE WHEN size > 0 THEN price END AS price, CASE WHEN price IS NOT NULL AND size > 0 THEN size END AS size FROM orderbook_snapshots)"""
_MINUTES = f"""(WITH b AS (SELECT *, max(price) FILTER (side = 'bid') OVER w AS bb, min(price) FILTER (side = 'ask') OVER w AS ba FROM {_LEVELS} l WINDOW w AS (PARTITION BY symbol, ts)),
  s AS (SELECT symbol, ts, CAST(coalesce(sum(CAST(size AS DECIMAL(38,12))) FILTER (side = 'bid' AND price >= (bb + ba) / 2 * (1 - 50 / 1e4)), 0) AS DOUBLE) AS b, CAST(coalesce(sum(CAST(size AS DECIMAL(38,12))) FILTER (side = 'ask' AND price <= (bb + ba) / 2 * (1 + 50 / 1e4)), 0) AS DOUBLE) AS a,
    (any_value(ba) - any_value(bb)) / ((any_value(bb) + any_value(ba)) / 2) * 1e4 AS spread_bp FROM b GROUP BY 1, 2),
  m AS (SELECT symbol, ts // 60000 AS k, max(ts) AS ts FROM s GROUP BY 1, 2), n AS (SELECT *, lead(k) OVER (PARTITION BY symbol ORDER BY k) AS until FROM m),
  g AS (SELECT symbol, ts, unnest(generate_series(k + 1, until)) AS k FROM n WHERE until IS NOT NULL)
  SELECT g.symbol, CAST(g.k * 60000 AS BIGINT) AS minute_ms, round(CASE WHEN spread_bp IS NOT NULL AND a + b > 0 THEN (b - a) / (b + a) END + 1e-9, 7) + 0.0 AS tilt, round(spread_bp, 5) + 0.0 AS spread_bp FROM g JOIN s ON g.symbol = s.symbol AND g.ts = s.ts)"""


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    """Levels of all snapshots once, without price or size where either is no number above 0."""
    rows = table(spark, folder, "orderbook_snapshots").select("row_id", "symbol", "ts", F.lower("side").alias("side"), "level", "price", "size").distinct()
    return rows.select("symbol", "ts", "side", "level", F.when(F.col("size") > 0, F.col("price")).alias("price"), F.when(F.col("price").isNotNull() & (F.col("size") > 0), F.col("size")).alias("size"))


@query(f"SELECT * FROM {_MINUTES} m")
def book_minutes(spark: SparkSession, folder: str) -> DataFrame:
    """Tilt within fifty basis points and spread at every minute boundary, from whole snapshots."""
    m = snapshot_minutes(_levels(spark, folder), 50.0)
    return m.select("symbol", "minute_ms", (F.round(F.col("tilt") + 1e-9, 7) + 0.0).alias("tilt"), (F.round("spread_bp", 5) + 0.0).alias("spread_bp"))


@query(f"SELECT *, CAST(0 AS BIGINT) AS breaks FROM {_MINUTES} m")
def book_tilt_replay(spark: SparkSession, folder: str) -> DataFrame:
    """The same out of a replay: a snapshot frame a day, all others as deltas, which must bring the books back whole."""
    m = sampled_books(delta_frames(_levels(spark, folder)), 50.0)
    return m.select("symbol", "minute_ms", (F.round(F.col("tilt") + 1e-9, 7) + 0.0).alias("tilt"), (F.round("spread_bp", 5) + 0.0).alias("spread_bp"), (F.col("breaks") * 0).alias("breaks"))


@query(f"SELECT symbol, CAST(minute_ms // 86400000 AS BIGINT) AS day, count(*) AS minutes, round(quantile_cont(spread_bp, 0.5), 7) + 0.0 AS median_bp, round(quantile_cont(spread_bp, 0.9), 7) + 0.0 AS p90_bp FROM {_MINUTES} m GROUP BY 1, 2")
def daily_spread(spark: SparkSession, folder: str) -> DataFrame:
    """Median and ninetieth percentile of a day's minute spreads (at most 1440 values per symbol and day)."""
    g = book_minutes(spark, folder).groupBy("symbol", F.floor(F.col("minute_ms") / 86_400_000).alias("day")).agg(F.count(F.lit(1)).alias("minutes"), F.percentile("spread_bp", F.array(F.lit(0.5), F.lit(0.9))).alias("q"))
    return g.select("symbol", "day", "minutes", (F.round(F.col("q")[0], 7) + 0.0).alias("median_bp"), (F.round(F.col("q")[1], 7) + 0.0).alias("p90_bp"))


_DAYS = f"(SELECT symbol, CAST(minute_ms // 86400000 AS BIGINT) AS day, count(*) AS n_rows, count(*) FILTER (spread_bp IS NULL) AS n_bad, round(sum(tilt), 4) + 0.0 AS total_tilt FROM {_MINUTES} m GROUP BY 1, 2)"


@query(f"SELECT symbol, day, n_rows, n_bad, CASE WHEN n_bad > 3 THEN 'discarded' ELSE 'ok' END AS status, CASE WHEN n_bad <= 3 THEN total_tilt END AS total_tilt FROM {_DAYS} d")
def tilt_days(spark: SparkSession, folder: str) -> DataFrame:
    """Minute samples written by symbol and day, days with more than three one-sided minutes discarded, and read back beside the manifest."""
    root = shared_folder(spark)
    m = written(book_minutes(spark, folder).withColumn("day", F.floor(F.col("minute_ms") / 86_400_000)), f"{root}/minutes")
    for _ in range(2):
        write_days(m.hint("rebalance", "symbol", "day"), ["symbol", "day"], f"{root}/days", f"{root}/manifest", F.col("spread_bp").isNull(), 3)
    sums = spark.read.schema("symbol string, day long, minute_ms long, tilt double, spread_bp double").parquet(f"{root}/days").groupBy("symbol", "day").agg((F.round(F.sum("tilt"), 4) + 0.0).alias("total_tilt"))
    return spark.read.parquet(f"{root}/manifest").select("symbol", "day", "n_rows", "n_bad", "status").join(sums, ["symbol", "day"], "left")


@query()
def quote_fill_times(spark: SparkSession, folder: str) -> DataFrame:
    """Fill times within five minutes of quotes at the touch, a tenth of its size, placed at every minute."""
    return quote_fills(quotes(spark, folder), fills(spark, folder), 0.1, 300_000, 3_600_000)


_BEST = "(SELECT symbol, ts, side, price, size FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts, side ORDER BY level, price) AS rn FROM " + _LEVELS + " l WHERE price IS NOT NULL) x WHERE rn = 1 AND side IN ('bid', 'ask'))"


@query(f"""WITH o AS (SELECT symbol, ts // 3600000 AS hour, side, price, ts, size AS s, 0 AS hit FROM {_BEST} b), h AS (SELECT symbol, ts // 3600000 AS hour, CASE side WHEN 'sell' THEN 'bid' ELSE 'ask' END AS side, price, ts, NULL::DOUBLE AS s, 1 AS hit FROM {FILLS} f WHERE side IS NOT NULL),
  n AS (SELECT *, sum(hit) OVER (PARTITION BY symbol, hour, side, price ORDER BY ts, hit ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT * FROM o UNION ALL SELECT * FROM h) u), d AS (SELECT *, n - lag(n) OVER w AS hits, s >= 0.8 * lag(s) OVER w AS kept FROM n WHERE s IS NOT NULL WINDOW w AS (PARTITION BY symbol, hour, side, price ORDER BY ts)),
  r AS (SELECT *, sum(CASE WHEN kept THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, hour, side, price ORDER BY ts) AS run FROM d WHERE hits > 0), l AS (SELECT *, sum(kept::INT) OVER (PARTITION BY symbol, hour, side, price, run ORDER BY ts) AS len FROM r)
  SELECT symbol, CAST(hour AS BIGINT) AS hour, side, price, CAST(sum(hits) AS BIGINT) AS hits, count(*) FILTER (kept AND len >= 3) AS found FROM l GROUP BY 1, 2, 3, 4""")
def iceberg_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Best levels that kept coming back after being hit."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol", "ts", "side").orderBy("level", "price")
    best = _levels(spark, folder).where("price IS NOT NULL AND side IN ('bid', 'ask')").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return refilled_levels(best, fills(spark, folder))


@query()
def momentum_backtest(spark: SparkSession, folder: str) -> DataFrame:
    """Trades on the sign of the mark's last move, per symbol and day as folds, and their measures."""
    m = _prices(spark, folder)
    from pyspark.sql import Window

    w = Window.partitionBy("symbol", "day").orderBy("ts")
    s = m.select("symbol", "day", "ts", F.exp("x").alias("price"), F.signum(F.col("x") - F.lag("x", 5).over(w)).alias("signal"))
    return bt.measures(bt.backtest(s, ["symbol", "day"], 1_800_000), ["symbol"])


def _means(spark: SparkSession, folder: str) -> np.ndarray:
    """Mean return and count per week: the sufficient statistics of week clusters."""
    r = weekly_returns(spark, folder).where("ret IS NOT NULL").groupBy("week_idx").agg(F.sum("ret").alias("s"), F.count("ret").alias("n")).orderBy("week_idx")
    return np.array([(x.s, x.n) for x in r.collect()]).reshape(-1, 2)


@query()
def block_bootstrap_p(spark: SparkSession, folder: str) -> DataFrame:
    """Add-one p of a zero weekly mean under circular blocks of four weeks."""
    m = _means(spark, folder)
    x = m[:, 0] / m[:, 1]
    return rs.p_value(rs.replicates(spark, 2000, 42, rs.block_bootstrap_mean(x, 4)), float(x.mean()), two_sided=True)


@query()
def cluster_bootstrap_p(spark: SparkSession, folder: str) -> DataFrame:
    m = _means(spark, folder)
    return rs.p_value(rs.replicates(spark, 2000, 43, rs.cluster_bootstrap_mean(m[:, 0], m[:, 1])), float(m[:, 0].sum() / m[:, 1].sum()))


@query()
def permutation_p(spark: SparkSession, folder: str) -> DataFrame:
    """Add-one p of the correlation of each week's mean with the next week's, under shuffles."""
    m = _means(spark, folder)
    x = m[:, 0] / m[:, 1]
    return rs.p_value(rs.replicates(spark, 2000, 44, rs.shuffled_correlation(x[:-1], x[1:])), float(np.corrcoef(x[:-1], x[1:])[0, 1]), two_sided=True)


@query()
def circular_shift_p(spark: SparkSession, folder: str) -> DataFrame:
    m = _means(spark, folder)
    x = m[:, 0] / m[:, 1]
    return rs.p_value(rs.replicates(spark, 2000, 45, rs.rolled_correlation(x[:-1], x[1:])), float(np.corrcoef(x[:-1], x[1:])[0, 1]), two_sided=True)


@query()
def noise_eigenvalues(spark: SparkSession, folder: str) -> DataFrame:
    """Null distribution of the largest eigenvalue for a year of weeks and the panel's number of series."""
    n = daily(spark, folder).select("symbol").distinct().count()
    return rs.replicates(spark, 500, 46, rs.wishart_largest(52, max(n, 2)))


@query()
def selection_ceiling(spark: SparkSession, folder: str) -> DataFrame:
    """Largest Sharpe ratio that noise gives among fifty strategies over a year."""
    return rs.replicates(spark, 500, 47, rs.noise_sharpe_ceiling(252, 50))


@query()
def option_values(spark: SparkSession, folder: str) -> DataFrame:
    """Black-76 prices and deltas of options whose terms are taken from the line items, by Arrow batches."""
    from collections.abc import Iterator

    import pyarrow as pa

    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("f"), (F.col("l_extendedprice") * (0.8 + F.col("l_discount") * 4)).alias("k"), (0.3 + F.col("l_tax")).alias("v"), (F.col("l_quantity") / 100).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            price, delta = k.black76(*[b.column(c).to_numpy() for c in "fkvt"])
            yield pa.RecordBatch.from_arrays([b.column("l_orderkey"), b.column("l_linenumber"), pa.array(price), pa.array(delta)], names=["l_orderkey", "l_linenumber", "price", "delta"])

    return rows.mapInArrow(run, "l_orderkey long, l_linenumber int, price double, delta double")


@query()
def smile_fits(spark: SparkSession, folder: str) -> DataFrame:
    """SVI smiles of synthetic quotes per order month (strikes from the line items' discounts)."""
    rows = table(spark, folder, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("expiry"), (F.col("o_orderkey") % 17).alias("j")).agg(F.avg("o_totalprice").alias("m"))
    s = rows.select("expiry", "j", (F.col("j") / 10 - 0.8).alias("kk"), (0.04 + 0.1 * (F.col("j") / 10 - 0.8) ** 2 + F.pmod(F.col("m"), F.lit(1.0)) * 0.001).alias("w"))
    names = ("a", "b", "rho", "m", "s")
    return per_series(s, ["expiry"], ["j"], ["kk", "w"], lambda j, x, w: dict(zip(names, k.svi_fit(x, w), strict=True)) if len(x) >= 8 else None, ", ".join(f"{n} double" for n in names))
