"""Implausible readings: spikes, stuck values and impossible values, per source."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.functions.events import DAY_MS
from tideglass.operators.series import longs, numbers, whole_series
from tideglass.session import shared_folder, written

WEEK_MS = 7 * DAY_MS
HOUR_MS = 3_600_000
#: Readings on each side of the one that make up the moving median; a spike of up to 3 is a minority of 9.
SIDE = 4
RUN = 10
#: Non-null readings kept at each end of a block to close runs and medians over block borders.
EDGE = RUN + 2 * SIDE
#: A season needs so many readings in its hour of day.
SEASON_LEAST = 30


def esd_limits(n: int, most: int, alpha: float) -> np.ndarray:
    """Critical values of the generalised extreme studentised deviate test for 1..``most`` outliers among ``n``."""
    i = np.arange(1, most + 1)
    left = np.maximum(n - i + 1, 3)
    z = np.array([NormalDist().inv_cdf(1 - alpha / (2 * m)) for m in left])
    df = np.maximum(left - 2, 1).astype(float)
    t = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2)
    return (left - 1) * t / np.sqrt((df + t * t) * left)


def esd_outliers(residual: np.ndarray, margin: float, alpha: float = 0.05, scale: float | None = None) -> np.ndarray:
    """Mask of residuals beyond ``margin`` times the generalised ESD limits.

    Deviates are studentised by median and median absolute deviation, so the outliers sought don't
    widen the scale and all limits can be compared at once: with the largest deviates in falling
    order, as many are outliers as the last that exceeds its limit. Up to a tenth of the readings
    (at least three) are tested. A scale of 0 (most readings equal) falls back to the mean absolute
    deviation; if that is 0 too there are no outliers.
    """
    n = len(residual)
    out = np.zeros(n, dtype=bool)
    if n < 3:
        return out
    away = np.abs(residual - np.median(residual))
    if scale is None:
        scale = np.median(away) * 1.4826 or away.mean() * 1.2533
    if not scale > 0:
        return out
    most = min(max(n // 10, 3), n - 2)
    top = np.argpartition(-away, most - 1)[:most]
    top = top[np.argsort(-away[top], kind="stable")]
    beyond = np.flatnonzero(away[top] / scale > margin * esd_limits(n, most, alpha))
    if len(beyond):
        out[top[: beyond[-1] + 1]] = True
    return out


def group_median(x: np.ndarray, g: np.ndarray, size: int, least: int = 1) -> np.ndarray:
    """Median of ``x`` per group 0..size-1; 0 for groups with fewer than ``least`` readings."""
    order = np.lexsort((x, g))
    n = np.bincount(g, minlength=size)
    start = np.cumsum(n) - n
    out = np.zeros(size)
    ok = n >= least
    s = x[order]
    out[ok] = (s[start[ok] + (n[ok] - 1) // 2] + s[start[ok] + n[ok] // 2]) / 2
    return out


def moving_median(x: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Median of the readings from ``side`` before to ``side`` after; ends are mirrored."""
    if len(x) < 3:
        return np.full(len(x), np.median(x)) if len(x) else x.copy()
    padded = np.pad(x, side, mode="reflect" if len(x) > side else "symmetric")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, 2 * side + 1), axis=1)


def seasonal_trend(x: np.ndarray, when: np.ndarray, trend_by: str) -> np.ndarray:
    """Residual of a robust seasonal-trend decomposition, by medians.

    ``readings``: the trend is the moving median over neighbouring readings. ``days``: the trend is
    the median of the day. The season is the median of what is left per hour of day, and trend and
    season are each taken again without the other.
    """
    hour, day = (when % DAY_MS) // HOUR_MS, when // DAY_MS
    day = day - day.min()

    def trend(y):
        return moving_median(y) if trend_by == "readings" else group_median(y, day, int(day.max()) + 1)[day]

    season = group_median(x - trend(x), hour, 24, SEASON_LEAST)[hour]
    season = season + group_median(x - trend(x - season) - season, hour, 24, SEASON_LEAST)[hour]
    return x - season - trend(x - season)


def in_runs(x: np.ndarray, least: int = RUN) -> np.ndarray:
    """Mask of readings in a row of ``least`` or more equal ones."""
    if not len(x):
        return np.zeros(0, dtype=bool)
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    size = np.diff(np.append(start, len(x)))
    return np.repeat(size >= least, size)


class Field:
    """How one field is judged.

    positive: values must be above 0 and are compared as logarithms. bound: absolute values from
    here on are impossible. runs: look for stuck values. spikes: ``both`` directions against the
    neighbouring readings, or ``high`` values against the usual level of the day. margin: multiple
    of the ESD limit from which a deviate counts as far.
    """

    def __init__(self, name: str, positive: bool, runs: bool, spikes: str, margin: float, bound: float | None = None):
        self.name, self.positive, self.runs, self.spikes, self.margin, self.bound = name, positive, runs, spikes, margin, bound

    def impossible(self, x: np.ndarray) -> np.ndarray:
        bad = ~np.isfinite(x)
        if self.positive:
            bad |= ~(x > 0)
        if self.bound is not None:
            bad |= np.abs(x) >= self.bound
        return bad


def _flags(f: Field, x: np.ndarray, when: np.ndarray, scale: float | None = None):
    """(impossible, spike, stuck) masks of one contiguous series without gaps, and its residual scale."""
    bad, spike = f.impossible(x), np.zeros(len(x), dtype=bool)
    good = np.flatnonzero(~bad)
    used = np.nan
    if len(good):
        y = np.log(x[good]) if f.positive else x[good]
        rest = seasonal_trend(y, when[good], "readings" if f.spikes == "both" else "days")
        used = np.median(np.abs(rest - np.median(rest))) * 1.4826
        hit = esd_outliers(rest, f.margin, scale=scale)
        spike[good] = hit if f.spikes == "both" else hit & (rest > np.median(rest))
    return bad, spike, in_runs(x) if f.runs else np.zeros(len(x), dtype=bool), used


_OUT = pa.schema(
    [("_source", pa.string()), ("field_name", pa.string()), ("rec_id", pa.int64()), ("reason", pa.string()), ("event_ms", pa.int64()), ("value", pa.float64()), ("scale", pa.float64()), ("near", pa.bool_()), ("gap", pa.bool_())]
)
_OUT_DDL = "_source string, field_name string, rec_id long, reason string, event_ms long, value double, scale double, near boolean, gap boolean"


def _rows(source, field, ids, reason, when, x, scale, near, gap) -> pa.RecordBatch:
    n = len(ids)
    text = lambda v: pa.array([v] * n, pa.string()) if isinstance(v, str) else pa.array(v, pa.string())
    return pa.RecordBatch.from_arrays(
        [text(source), text(field), pa.array(ids), text(reason), pa.array(when), pa.array(x), pa.array(np.full(n, scale)), pa.array(near), pa.array(gap)], schema=_OUT
    )


def _block_kernel(fields: list[Field]):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_series(batches, ["_source", "_block"]):
            source = t.column("_source")[0].as_py()
            when_all, id_all = longs(t, "event_ms"), longs(t, "rec_id")
            order = np.lexsort((id_all, when_all))
            when_all, id_all = when_all[order], id_all[order]
            once = np.ones(len(id_all), dtype=bool)
            once[1:] = (id_all[1:] != id_all[:-1]) | (when_all[1:] != when_all[:-1])
            for f in fields:
                has = once & ~t.column(f.name).is_null().to_numpy()[order]
                x, when, ids = numbers(t, f.name)[order][has], when_all[has], id_all[has]
                n = len(x)
                if not n:
                    continue
                bad, spike, stuck, scale = _flags(f, x, when)
                at = np.arange(n)
                if f.spikes == "both":
                    near = (at < SIDE + 1) | (at >= n - SIDE - 1)
                    edge = (at < EDGE) | (at >= n - EDGE)
                    yield _rows(source, f.name, ids[edge], "edge", when[edge], x[edge], scale, near[edge], (n > 2 * EDGE) & (at[edge] == n - EDGE))
                    spike &= ~near
                for reason, mask in (("impossible", bad), ("spike", spike), ("stuck", stuck)):
                    if mask.any():
                        no = np.zeros(int(mask.sum()), dtype=bool)
                        yield _rows(source, f.name, ids[mask], reason, when[mask], x[mask], scale, no, no)

    return kernel


def _edge_kernel(fields: list[Field]):
    by_name = {f.name: f for f in fields}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_series(batches, ["_source", "field_name"]):
            f = by_name[t.column("field_name")[0].as_py()]
            x, when, ids = numbers(t, "value"), longs(t, "event_ms"), longs(t, "rec_id")
            scales, near = numbers(t, "scale"), t.column("near").to_numpy()
            cuts = [0, *[c for c in np.flatnonzero(t.column("gap").to_numpy()) if c], len(x)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                s = slice(lo, hi)
                y = x[s]
                stuck = in_runs(y) if f.runs else np.zeros(hi - lo, dtype=bool)
                spike = np.zeros(hi - lo, dtype=bool)
                good = np.flatnonzero(~f.impossible(y))
                if len(good):
                    z = np.log(y[good]) if f.positive else y[good]
                    rest = np.abs(z - moving_median(z))
                    own = scales[s][good]
                    limit = f.margin * esd_limits(10_000, 1, 0.05)[0]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        spike[good] = near[s][good] & (own > 0) & (rest / own > limit)
                for reason, mask in (("spike", spike), ("stuck", stuck)):
                    if mask.any():
                        no = np.zeros(int(mask.sum()), dtype=bool)
                        yield _rows(t.column("_source")[0].as_py(), f.name, ids[s][mask], reason, when[s][mask], y[mask], np.nan, no, no)

    return kernel


def implausible_readings(readings: DataFrame, source: str, fields: list[Field], block_ms: int = WEEK_MS, folder: str | None = None) -> DataFrame:
    """Readings that cannot be true: ``rec_id``, ``field_name`` and ``reason`` (impossible, spike, stuck).

    ``readings`` has ``source``, ``rec_id`` (long), ``event_ms`` (long) and a double column per
    field. Per source and block of time (a week) each field goes through a robust seasonal-trend
    decomposition, and residuals beyond ``margin`` times the generalised ESD limits are spikes; a
    level that lasts moves the median with it and is none. Stuck values and impossible values are
    separate checks.

    Blocks split a source that holds most rows and run in parallel. What lies across a block's
    border is settled in a second step that sees only the ``EDGE`` first and last readings of each
    block, in order: a run of equal values is found whole, and the first and last readings are
    compared with their true neighbours, at the scale of their own block. Between the two steps
    stands a small written table (flags and edges).

    Nulls: a null reading is none (the next one follows the one before); rows with null source, id
    or time are left out. NaN is an impossible reading. Repeated deliveries count once. Too few
    readings for a scale (fewer than 3, or all equal) give no spikes. An empty table gives an
    empty result.
    """
    names = [f.name for f in fields]
    block = F.col("event_ms") - F.pmod("event_ms", F.lit(block_ms))
    rows = readings.select(F.col(source).alias("_source"), block.alias("_block"), "event_ms", "rec_id", *names).where(
        "_source IS NOT NULL AND event_ms IS NOT NULL AND rec_id IS NOT NULL"
    )
    found = rows.repartition("_source", "_block").sortWithinPartitions("_source", "_block").mapInArrow(_block_kernel(fields), _OUT_DDL)
    if not any(f.spikes == "both" for f in fields):
        return found.select("rec_id", "field_name", "reason").distinct()
    first = written(found, folder or shared_folder(readings.sparkSession))
    edges = first.where("reason = 'edge'").repartition("_source", "field_name").sortWithinPartitions("_source", "field_name", "event_ms", "rec_id")
    second = edges.mapInArrow(_edge_kernel(fields), _OUT_DDL)
    return first.where("reason <> 'edge'").unionByName(second).select("rec_id", "field_name", "reason").distinct()
