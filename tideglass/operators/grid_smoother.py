"""Irregular readings onto a regular grid by a Kalman smoother with a continuous-time local trend."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideglass.functions.events import DAY_MS, PERIOD_MS
from tideglass.operators.series import longs, numbers, whole_series

#: Noise of a reading against the level's own movement per minute, tried per series by likelihood.
NOISE_RATIOS = (0.01, 0.1, 1.0, 10.0)
#: Diffusion of the slope against that of the level (per minute squared): the first for the choice of noise, then the best of all.
SLOPE_SHARE = 1e-5
SLOPE_SHARES = (SLOPE_SHARE, 1e-7, 1e-3)
#: Readings of the neighbouring blocks that a block's series begins and ends with where rows run across blocks.
CARRIED = 16
CELLS = 400_000


def _filter(dt, y, q, r, share, keep: bool):
    """Forward pass over [step, series] arrays; NaN in ``y`` is a step without a reading."""
    steps, width = y.shape
    first = np.argmax(~np.isnan(y), axis=0)
    level, slope = y[first, np.arange(width)].copy(), np.zeros(width)
    a, b, c = np.full(width, 1e4) * (q + r), np.zeros(width), q * 1.0
    qs = q * share
    logs, scores, seen = np.zeros(width), np.zeros(width), np.zeros(width)
    store = np.empty((10, steps, width)) if keep else None
    for k in range(steps):
        d = dt[k]
        level = level + d * slope
        d2 = d * d
        a = a + 2 * d * b + d2 * c + q * d + qs * d2 * d / 3
        b = b + d * c + qs * d2 / 2
        c = c + qs * d
        if keep:
            store[0:5, k] = level, slope, a, b, c
        has = ~np.isnan(y[k])
        gap = np.where(has, y[k] - level, 0.0)
        s = a + r
        ga, gb = np.where(has, a / s, 0.0), np.where(has, b / s, 0.0)
        if not keep:
            late = has & (seen > 0)
            logs += np.where(late, np.log(s), 0.0)
            scores += np.where(late, gap * gap / s, 0.0)
            seen += has
        level, slope = level + ga * gap, slope + gb * gap
        c = c - gb * b
        b = b - ga * b
        a = a - ga * a
        if keep:
            store[5:10, k] = level, slope, a, b, c
    if keep:
        return store
    n = np.maximum(seen - 1, 1)
    scale = np.maximum(scores / n, 1e-300)
    return scale, logs + n * np.log(scale)


def _smooth(dt, y, q, r, share=SLOPE_SHARE):
    """Smoothed level and its variance at each step (Rauch-Tung-Striebel)."""
    store = _filter(dt, y, q, r, share, keep=True)
    steps, width = y.shape
    level, slope = store[5, -1].copy(), store[6, -1].copy()
    a, b, c = store[7, -1].copy(), store[8, -1].copy(), store[9, -1].copy()
    out, var = np.empty((steps, width)), np.empty((steps, width))
    out[-1], var[-1] = level, a
    for k in range(steps - 2, -1, -1):
        d = dt[k + 1]
        pl, ps, pa_, pb, pc = store[0:5, k + 1]
        fl, fs, fa, fb, fc = store[5:10, k]
        det = np.maximum(pa_ * pc - pb * pb, 1e-300)
        m00, m01 = fa + d * fb, fb
        m10, m11 = fb + d * fc, fc
        g00, g01 = (m00 * pc - m01 * pb) / det, (m01 * pa_ - m00 * pb) / det
        g10, g11 = (m10 * pc - m11 * pb) / det, (m11 * pa_ - m10 * pb) / det
        el, es = level - pl, slope - ps
        level, slope = fl + g00 * el + g01 * es, fs + g10 * el + g11 * es
        da, db, dc = a - pa_, b - pb, c - pc
        a = fa + g00 * g00 * da + 2 * g00 * g01 * db + g01 * g01 * dc
        b = fb + g00 * g10 * da + (g00 * g11 + g01 * g10) * db + g01 * g11 * dc
        c = fc + g10 * g10 * da + 2 * g10 * g11 * db + g11 * g11 * dc
        out[k], var[k] = level, np.maximum(a, 0.0)
    return out, var


def smooth_bundle(series: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Smoothed value and standard deviation at grid times, of several series in lockstep.

    Each series is (reading times ms, readings, grid times ms), times ascending. The model of a
    series is level' = slope + noise, slope' = noise in continuous time. The noise of a reading against
    the level's is chosen by likelihood among ``NOISE_RATIOS``, then the slope's among
    ``SLOPE_SHARES``, and the overall scale by concentrated likelihood.
    One reading, or equal readings, give a constant with the smallest scale.
    """
    width = len(series)
    merged = []
    for t, x, g in series:
        when = np.concatenate([t, g])
        order = np.argsort(when, kind="stable")
        merged.append((when[order], np.concatenate([x - x[0], np.full(len(g), np.nan)])[order], order >= len(t)))
    steps = max(len(m[0]) for m in merged)
    dt, y = np.zeros((steps, width)), np.full((steps, width), np.nan)
    for j, (when, value, _) in enumerate(merged):
        dt[1 : len(when), j] = np.diff(when) / 60_000.0
        y[: len(when), j] = value
    floor = np.array([max(1e-18, 1e-16 * s[1][0] ** 2) for s in series])
    best_q, best_ratio, best_share, best = np.ones(width), np.ones(width), np.full(width, SLOPE_SHARES[0]), np.full(width, np.inf)
    trials = [(np.full(width, ratio), SLOPE_SHARES[0]) for ratio in NOISE_RATIOS] + [(None, share) for share in SLOPE_SHARES[1:]]
    for ratio, share in trials:
        ratio = best_ratio if ratio is None else ratio
        scale, score = _filter(dt, y, np.ones(width), ratio, share, keep=False)
        take = score < best
        best = np.where(take, score, best)
        best_q = np.where(take, np.maximum(scale, floor), best_q)
        best_ratio, best_share = np.where(take, ratio, best_ratio), np.where(take, share, best_share)
    level, var = _smooth(dt, y, best_q, best_q * best_ratio, best_share)
    result = []
    for j, ((_, x, _), (when, _, grid)) in enumerate(zip(series, merged, strict=True)):
        at = np.flatnonzero(grid)
        assert at[-1] < len(when)
        result.append((level[at, j] + x[0], np.sqrt(var[at, j])))
    return result


def _bundles(tables: Iterator[pa.Table]) -> Iterator[list[pa.Table]]:
    """Series that fit together into ``CELLS`` cells of the padded arrays; a longer series goes alone."""
    held: list[pa.Table] = []
    longest = 0
    for t in tables:
        most = max(longest, t.num_rows + DAY_MS // PERIOD_MS)
        if held and (len(held) + 1) * most > CELLS:
            yield held
            held, most = [], t.num_rows + DAY_MS // PERIOD_MS
        held.append(t)
        longest = most
    if held:
        yield held


def _carried(rows: DataFrame, block_ms: int) -> DataFrame:
    """For each block between a source's first and last reading, empty ones too: the last readings before it and the first after it."""
    at = rows.groupBy("_source", "_block", "event_ms").agg(F.avg("_value").alias("_value"))
    own = Window.partitionBy("_source", "_block")
    numbered = at.withColumn("_up", F.row_number().over(own.orderBy("event_ms"))).withColumn("_down", F.row_number().over(own.orderBy(F.desc("event_ms")))).where((F.col("_up") <= CARRIED) | (F.col("_down") <= CARRIED))
    blocks = rows.select("_source", "_block").distinct()
    breaks = blocks.withColumn("_next", F.lead("_block").over(Window.partitionBy("_source").orderBy("_block"))).where("_next IS NOT NULL")
    step = F.lit(block_ms).cast("long")
    ends = lambda which: numbered.where(F.col(which) <= CARRIED).select("_source", F.col("_block").alias("_from"), "event_ms", "_value")
    before = breaks.withColumn("_from", F.col("_block")).join(ends("_down"), ["_source", "_from"]).select("_source", F.explode(F.sequence(F.col("_block") + step, "_next", step)).alias("_block"), "event_ms", "_value")
    after = breaks.withColumn("_from", F.col("_next")).join(ends("_up"), ["_source", "_from"]).select("_source", F.explode(F.sequence(F.col("_block"), F.col("_next") - step, step)).alias("_block"), "event_ms", "_value")
    return before.unionByName(after)


def regular_grid(readings: DataFrame, source: str, value: str, step_ms: int = PERIOD_MS, block_ms: int = DAY_MS, across: bool = False) -> DataFrame:
    """A regular series per source: one row per step from the first to the last reading of each block.

    ``readings`` has ``source``, ``event_ms`` (long) and ``value`` (double). Rows of the result:
    source, ``period_ms`` (start of the step), ``readings`` (how many fell into the step),
    ``is_missing`` (none did), ``value`` (smoothed level at ``period_ms``, on all readings of the
    block before and after) and ``value_sd`` (its standard deviation).

    With ``across`` the rows run from the source's first to its last reading without a break: each
    block, also one without readings, is filled to its ends with the last ``CARRIED`` readings before it and
    the first after it as further readings of its series: the smoother comes into a block with the
    level and slope it had at the end of the one before.

    A block (a UTC day) of a source is one series of the smoother; blocks are what splits a source
    that holds most rows. Series run through the filter in lockstep, vectorised across series.

    Nulls: rows with null source, time or value, and values that are not finite, are no readings.
    Readings of one source at the same ms are one reading (their mean). A block without readings
    has no rows; an empty table gives an empty result.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bundle in _bundles(whole_series(batches, ["_source", "_block"])):
            series, counts = [], []
            for t in bundle:
                when, first, size = np.unique(longs(t, "event_ms"), return_index=True, return_counts=True)
                x = np.add.reduceat(numbers(t, "_value"), first) / size
                start = t.column("_block")[0].as_py()
                own = when[(when >= start) & (when < start + block_ms)]
                first_ms = start if when[0] < start else when[0] - when[0] % step_ms
                grid = np.arange(first_ms, min(when[-1] + 1, start + block_ms), step_ms)
                series.append((when, x, grid))
                counts.append(np.bincount((own - grid[0]) // step_ms, minlength=len(grid)))
            for t, (_, _, grid), n, (level, sd) in zip(bundle, series, counts, smooth_bundle(series), strict=True):
                name = t.column("_source")[0].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(grid), pa.string()), pa.array(grid), pa.array(n.astype("int64")), pa.array(n == 0), pa.array(level), pa.array(sd)],
                    names=[source, "period_ms", "readings", "is_missing", "value", "value_sd"],
                )

    rows = readings.select(
        F.col(source).alias("_source"),
        (F.col("event_ms") - F.pmod("event_ms", F.lit(block_ms))).alias("_block"),
        "event_ms",
        F.col(value).alias("_value"),
    ).where("_source IS NOT NULL AND event_ms IS NOT NULL AND _value IS NOT NULL AND NOT isnan(_value) AND abs(_value) < double('inf')")
    if across:
        rows = rows.unionByName(_carried(rows, block_ms))
    schema = f"`{source}` string, period_ms long, readings long, is_missing boolean, value double, value_sd double"
    return rows.repartition("_source", "_block").sortWithinPartitions("_source", "_block", "event_ms").mapInArrow(kernel, schema)
