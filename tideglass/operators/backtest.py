"""Event-time backtests: position rules, adverse fills, fees, and their measures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideglass.operators.grouped import per_series

TRADE = "entry_ts double, exit_ts double, direction double, entry_price double, exit_price double, pnl double, pnl_bps double, forced boolean"


def round_trip(direction: float, entry: float, exit_: float, fee: float, slip: float) -> tuple[float, float, float, float]:
    """Both legs slipped against the position and charged: (entry, exit, result per unit, in bps of the entry)."""
    a, b = entry * (1 + direction * slip), exit_ * (1 - direction * slip)
    pnl = direction * (b - a) - fee * (a + b)
    return a, b, pnl, pnl / a * 1e4


def positions(ts: np.ndarray, price: np.ndarray, signal: np.ndarray, hold_ms: float, fee: float, slip: float) -> dict[str, list] | None:
    """One position at a time: open on a non-zero signal when flat, close on the opposite signal or after ``hold_ms``; forced at the end."""
    rows, open_at = [], None
    for i in range(len(ts)):
        if open_at is not None:
            j, d = open_at
            last = i == len(ts) - 1
            if signal[i] == -d or ts[i] - ts[j] >= hold_ms or last:
                stopped = last and signal[i] != -d and ts[i] - ts[j] < hold_ms
                rows.append((ts[j], ts[i], d, *round_trip(d, price[j], price[i], fee, slip), stopped))
                open_at = None
                continue
        if open_at is None and signal[i] != 0 and np.isfinite(signal[i]) and i < len(ts) - 1:
            open_at = (i, signal[i])
    names = [c.split()[0] for c in TRADE.split(", ")]
    return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else None


def backtest(signals: DataFrame, by: list[str], hold_ms: float, fee: float = 0.00055, slip: float = 0.0001) -> DataFrame:
    """Trades of each series (``by``, ts, price, signal of -1, 0, 1). Put the fold into ``by``: positions end with it."""
    return per_series(signals, by, ["ts"], ["price", "signal"], lambda t, p, s: positions(t, p, s, hold_ms, fee, slip), TRADE)


def measures(trades: DataFrame, by: list[str]) -> DataFrame:
    """Per group: trades, total, mean and worst bps, win rate, Sharpe by the root of 252, largest drawdown from 0 or a later top."""
    w = Window.partitionBy(*by).orderBy("exit_ts", "entry_ts")
    run = trades.withColumn("_cum", F.sum("pnl").over(w)).withColumn("_top", F.greatest(F.lit(0.0), F.max("_cum").over(w)))
    return run.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"),
        F.sum("pnl").alias("total"),
        F.avg("pnl_bps").alias("mean_bps"),
        F.min("pnl_bps").alias("worst_bps"),
        F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        (F.avg("pnl") / F.nullif(F.stddev_samp("pnl"), F.lit(0.0)) * 252**0.5).alias("sharpe"),
        F.max(F.col("_top") - F.col("_cum")).alias("max_drawdown"),
    )


def throttled(ts: np.ndarray, least_ms: float) -> np.ndarray:
    """Mask of evaluations at most one per ``least_ms`` of event time."""
    from tideglass.functions.kernels import thinned

    return thinned(ts, least_ms)


def lead_lag_trips(queries: DataFrame, own: DataFrame, other: DataFrame, lag_ms: int, latency_ms: int, hold_ms: int) -> DataFrame:
    """Sign of the other's move over ``lag_ms`` traded in the own series after ``latency_ms``, held for ``hold_ms``; in bps.

    ``queries`` has id and ts; ``own`` and ``other`` have ts and price. All prices are the last known.
    """
    from tideglass.operators.align import asof

    def at(df, shift, prices, name):
        moved = df.withColumn("ts", F.col("ts") + shift).withColumn("_k", F.lit(0))
        got = asof(moved, prices.withColumn("_k", F.lit(0)), ["_k"], "price").drop("_k", "value_ts").withColumnRenamed("value", name)
        return got.withColumn("ts", F.col("ts") - shift)

    q = queries.select("id", "ts")
    for shift, prices, name in ((0, other, "_o1"), (-lag_ms, other, "_o0"), (latency_ms, own, "_p0"), (latency_ms + hold_ms, own, "_p1")):
        q = at(q, shift, prices, name)
    sign = F.signum(F.ln("_o1") - F.ln("_o0"))
    return q.select("id", "ts", sign.alias("direction"), (sign * (F.ln("_p1") - F.ln("_p0")) * 1e4).alias("captured_bps"))
