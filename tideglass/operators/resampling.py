"""Null distributions by replicates: each replicate is a row of spark.range with a seed of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def replicates(spark: SparkSession, n: int, seed: int, statistic: Callable[[np.random.Generator], float], parts: int = 8) -> DataFrame:
    """(replicate, statistic): ``statistic(generator)`` with the generator seeded by [seed, replicate].

    Independent of partitioning and of lost executors: a replicate run again draws the same. What
    ``statistic`` closes over travels to every task, so it must be small (sufficient statistics).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([float(statistic(np.random.default_rng([seed, int(i)]))) for i in ids])], names=["replicate", "statistic"])

    return spark.range(0, n, 1, parts).mapInArrow(run, "replicate long, statistic double")


def p_value(null: DataFrame, observed: float, two_sided: bool = False) -> DataFrame:
    """Add-one p: (replicates at least as far + 1) / (replicates + 1)."""
    far = F.abs("statistic") >= abs(observed) if two_sided else F.col("statistic") >= observed
    return null.agg(((F.count_if(far) + 1) / (F.count(F.lit(1)) + 1)).alias("p"), F.count(F.lit(1)).alias("replicates"), F.lit(float(observed)).alias("observed"))


def circular_blocks(n: int, block: int, rng: np.random.Generator) -> np.ndarray:
    """Indices of a circular block resample of length ``n``."""
    starts = rng.integers(0, n, -(-n // block))
    return ((starts[:, None] + np.arange(block)) % n).ravel()[:n]


def moving_blocks(n: int, block: int, rng: np.random.Generator) -> np.ndarray:
    starts = rng.integers(0, max(n - block, 0) + 1, -(-n // block))
    return (starts[:, None] + np.arange(min(block, n))).ravel()[:n]


def stationary_blocks(n: int, mean_block: float, rng: np.random.Generator) -> np.ndarray:
    """Indices of a stationary bootstrap: a jump with probability 1 / mean_block, circular."""
    jump = rng.random(n) < 1 / mean_block
    jump[0] = True
    start = np.where(jump, rng.integers(0, n, n), 0)
    first = np.maximum.accumulate(np.where(jump, np.arange(n), 0))
    return (start[first] + np.arange(n) - first) % n


def block_bootstrap_mean(x: np.ndarray, block: int) -> Callable[[np.random.Generator], float]:
    """Mean of a centred circular block resample: the null of a zero mean."""
    centred = x - x.mean()
    return lambda rng: centred[circular_blocks(len(centred), block, rng)].mean()


def cluster_bootstrap_mean(sums: np.ndarray, counts: np.ndarray) -> Callable[[np.random.Generator], float]:
    """Mean after resampling whole clusters, from the sum and count of each."""
    centred = sums - counts * sums.sum() / counts.sum()

    def draw(rng):
        k = rng.integers(0, len(sums), len(sums))
        return centred[k].sum() / counts[k].sum()

    return draw


def shuffled_correlation(x: np.ndarray, y: np.ndarray) -> Callable[[np.random.Generator], float]:
    return lambda rng: np.corrcoef(x, rng.permutation(y))[0, 1]


def rolled_correlation(x: np.ndarray, y: np.ndarray) -> Callable[[np.random.Generator], float]:
    """Correlation after a circular shift of one side by 1..n-1."""
    return lambda rng: np.corrcoef(x, np.roll(y, rng.integers(1, len(y))))[0, 1]


def wishart_largest(rows: int, columns: int) -> Callable[[np.random.Generator], float]:
    """Largest eigenvalue of the correlation of independent noise."""

    def draw(rng):
        z = rng.standard_normal((rows, columns))
        return np.linalg.eigvalsh(np.corrcoef(z.T))[-1]

    return draw


def noise_sharpe_ceiling(days: int, strategies: int) -> Callable[[np.random.Generator], float]:
    """Largest annual Sharpe ratio among ``strategies`` of pure noise."""

    def draw(rng):
        z = rng.standard_normal((days, strategies))
        return (z.mean(0) / z.std(0, ddof=1)).max() * np.sqrt(252)

    return draw


def shuffled_blocks(rows: DataFrame, by: list[str], order: list[str], value: str, block: int, seed: int) -> DataFrame:
    """``rows`` with ``surrogate``: the values of each ``by`` group with its blocks of ``block`` rows in a random order.

    Blocks keep their inner order and stay inside their group (an hour of the day), so every group
    keeps its values; a group of one block stays as it is. The order of blocks is that of a hash of
    seed, group and block: a task that runs again draws the same. Two sorts per group, with spill,
    nothing gathered. Null group keys are a group; an empty table gives no rows.
    """
    w = Window.partitionBy(*by)
    numbered = rows.withColumn("_at", F.row_number().over(w.orderBy(*order)) - 1)
    keyed = numbered.withColumn("_key", F.xxhash64(F.lit(seed), *by, F.floor(F.col("_at") / block)))
    drawn = keyed.withColumn("_to", F.row_number().over(w.orderBy("_key", "_at")) - 1)
    same = lambda c: F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    source = drawn.select(*[F.col(c).alias(f"_s_{c}") for c in by], F.col("_to").alias("_s_at"), F.col(value).alias("surrogate"))
    on = [same(c) for c in by] + [F.col("_at") == F.col("_s_at")]
    return numbered.join(source, on).drop("_at", "_s_at", *[f"_s_{c}" for c in by])


def rank_rows(x: np.ndarray) -> np.ndarray:
    """Ranks along the last axis, NaN staying NaN; ties in order of position."""
    order = np.argsort(np.argsort(x, axis=-1, kind="stable"), axis=-1, kind="stable").astype(float)
    return np.where(np.isfinite(x), order, np.nan)


def row_correlations(a: np.ndarray, b: np.ndarray, least: int = 2) -> np.ndarray:
    """Correlation of the rows of two matrices over the cells both have; NaN below ``least`` or where a side doesn't vary."""
    ok = np.isfinite(a) & np.isfinite(b)
    n = ok.sum(-1)
    a, b = np.where(ok, a, 0.0), np.where(ok, b, 0.0)
    m = np.maximum(n, 1)
    da, db = np.where(ok, a - (a.sum(-1) / m)[..., None], 0.0), np.where(ok, b - (b.sum(-1) / m)[..., None], 0.0)
    scale = np.sqrt((da * da).sum(-1) * (db * db).sum(-1))
    return np.where((n >= least) & (scale > 0), (da * db).sum(-1) / np.where(scale > 0, scale, 1.0), np.nan)


def mean_ic(signal: np.ndarray, outcome: np.ndarray, least: int = 5) -> float:
    """Mean over weeks (rows) of the rank correlation across series, over cells both have."""
    ok = np.isfinite(signal) & np.isfinite(outcome)
    ics = row_correlations(rank_rows(np.where(ok, signal, np.nan)), rank_rows(np.where(ok, outcome, np.nan)), least)
    return float(np.nanmean(ics)) if np.isfinite(ics).any() else np.nan


def week_blocks_permuted(signal: np.ndarray, outcome: np.ndarray, block: int) -> Callable[[np.random.Generator], float]:
    """Mean IC with the outcome's weeks moved in whole blocks; the signal stays."""
    starts = np.arange(0, len(outcome), block)

    def draw(rng):
        order = np.concatenate([np.arange(s, min(s + block, len(outcome))) for s in rng.permutation(starts)])
        return mean_ic(signal, outcome[order])

    return draw


def ar1_fits(panel: np.ndarray, most: float = 0.98) -> tuple[np.ndarray, np.ndarray]:
    """(persistence, spread of its errors) of each column around its mean, over consecutive weeks both known."""
    d = panel - np.nanmean(panel, axis=0)
    ok = np.isfinite(d[:-1]) & np.isfinite(d[1:])
    x, y = np.where(ok, d[:-1], 0.0), np.where(ok, d[1:], 0.0)
    square = (x * x).sum(0)
    phi = np.clip(np.where(square > 0, (x * y).sum(0) / np.where(square > 0, square, 1.0), 0.0), -most, most)
    e, n = np.where(ok, y - phi * x, 0.0), ok.sum(0)
    m = np.maximum(n, 1)
    spread = np.sqrt(np.maximum((e * e).sum(0) - e.sum(0) ** 2 / m, 0.0) / np.maximum(n - 1, 1))
    return phi, np.where(n > 1, spread, 0.0)


def persistent_panel(phi: np.ndarray, spread: np.ndarray, weeks: int, rng: np.random.Generator) -> np.ndarray:
    """Independent first-order series that start in their stationary state."""
    shocks = rng.standard_normal((weeks, len(phi))) * spread
    shocks[0] /= np.sqrt(1 - phi**2)
    for t in range(1, weeks):
        shocks[t] += phi * shocks[t - 1]
    return shocks


def persistence_null(panel: np.ndarray, trail: int) -> Callable[[np.random.Generator], float]:
    """Mean IC of trailing momentum in panels that persist like this one but hold no common signal."""
    phi, spread = ar1_fits(panel)
    missing = ~np.isfinite(panel)

    def draw(rng):
        sim = persistent_panel(phi, spread, len(panel), rng)
        sim[missing] = np.nan
        return mean_ic(trailing_sums(sim, trail)[:-1], sim[1:])

    return draw


def trailing_sums(panel: np.ndarray, weeks: int) -> np.ndarray:
    """Sum of the last ``weeks`` rows up to each, unknown cells as 0 and unknown where the row's own cell is."""
    c = np.cumsum(np.nan_to_num(panel), axis=0)
    c[weeks:] = c[weeks:] - c[:-weeks]
    return np.where(np.isfinite(panel), c, np.nan)


def factor_null(panel: np.ndarray, trail: int) -> Callable[[np.random.Generator], float]:
    """Mean IC of momentum in panels of one persistent factor with this panel's loadings and idiosyncratic spreads."""
    ok = np.isfinite(panel)
    known = np.maximum(ok.sum(1), 1)
    factor = np.where(ok.any(1), np.nansum(panel, axis=1) / known, np.nan)
    f = np.where(ok, factor[:, None], np.nan)
    df, dp = f - np.nanmean(f, axis=0), panel - np.nanmean(panel, axis=0)
    beta = np.nansum(df * dp, axis=0) / np.maximum(np.nansum(df * df, axis=0), 1e-300)
    rest = np.nanstd(dp - beta * df, axis=0)
    phi, spread = ar1_fits(factor[:, None])

    def draw(rng):
        sim = persistent_panel(phi, spread, len(panel), rng) * beta + rng.standard_normal(panel.shape) * rest
        sim[~ok] = np.nan
        return mean_ic(trailing_sums(sim, trail)[:-1], sim[1:])

    return draw


def one_factor_second(largest: float, vector: np.ndarray, rows: int) -> Callable[[np.random.Generator], float]:
    """Second eigenvalue of the correlation of a one-factor world whose first eigenpair is this one."""
    load = np.clip(np.sqrt(largest) * np.abs(vector) / np.linalg.norm(vector), 0.0, 1.0)

    def draw(rng):
        x = rng.standard_normal((rows, 1)) * load + rng.standard_normal((rows, len(load))) * np.sqrt(1 - load**2)
        return np.linalg.eigvalsh(np.corrcoef(x.T))[-2]

    return draw


def pointer_count(scores: np.ndarray, threshold: float = 1.5, share: float = 0.2, least: int = 5) -> int:
    """Days (rows) on which a share of the available series scores beyond the threshold in one direction."""
    n = np.isfinite(scores).sum(1)
    s = np.nan_to_num(scores)
    most = np.maximum((s >= threshold).sum(1), (s <= -threshold).sum(1))
    return int(((n >= least) & (most >= share * n - 1e-9)).sum())


def rolled_columns_count(scores: np.ndarray) -> Callable[[np.random.Generator], float]:
    """Pointer days after a circular shift of every series by its own 1..n-1 days."""
    days, series = scores.shape
    rows = np.arange(days)[:, None]

    def draw(rng):
        return pointer_count(scores[(rows - rng.integers(1, days, series)) % days, np.arange(series)])

    return draw


def spaced_days_mean(values: np.ndarray, marked: np.ndarray, gap: int) -> tuple[float, np.ndarray, Callable[[np.random.Generator], float]]:
    """(mean at the marked days, the days that may stand in for them, the same mean at as many random ones of those).

    A day may stand in if it has a value and lies at least ``gap`` days from every marked one.
    """
    known = np.flatnonzero(np.isfinite(values))
    hits = marked[np.isfinite(values[marked])]
    near = np.searchsorted(np.sort(marked), known)
    s = np.sort(marked)
    left = np.where(near > 0, known - s[np.maximum(near - 1, 0)], gap) if len(s) else np.full(len(known), gap)
    right = np.where(near < len(s), s[np.minimum(near, max(len(s) - 1, 0))] - known, gap) if len(s) else left
    pool = known[(left >= gap) & (right >= gap)]
    return float(values[hits].mean()) if len(hits) else np.nan, pool, lambda rng: values[rng.choice(pool, len(hits), replace=False)].mean()


def noise_portfolio_sharpe(returns: np.ndarray, signals: int, block: int) -> Callable[[np.random.Generator], float]:
    """Annual Sharpe ratio of the mean of ``signals`` strategies that hold a random sign for ``block`` days."""
    n = len(returns)

    def draw(rng):
        signs = rng.integers(0, 2, (signals, -(-n // block))) * 2 - 1
        pnl = np.repeat(signs, block, axis=1)[:, :n].mean(0) * returns
        sd = pnl.std(ddof=1)
        return pnl.mean() / sd * np.sqrt(252) if sd > 0 else 0.0

    return draw


def rank_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Rank correlation with average ranks; 0 where a side doesn't vary."""
    ranks = []
    for v in (x, y):
        values, at, n = np.unique(v, return_inverse=True, return_counts=True)
        ranks.append((np.cumsum(n) - (n - 1) / 2)[at])
    a, b = ranks[0] - ranks[0].mean(), ranks[1] - ranks[1].mean()
    scale = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / scale) if scale > 0 else 0.0


def stress_lift(x: np.ndarray, y: np.ndarray, stress: np.ndarray) -> float:
    """Rank correlation under stress minus that of the other days; unknown with fewer than four of either."""
    if min(stress.sum(), (~stress).sum()) < 4:
        return np.nan
    return rank_correlation(x[stress], y[stress]) - rank_correlation(x[~stress], y[~stress])


def coherence_lift_null(x: np.ndarray, y: np.ndarray, stress: np.ndarray, block: int, selected: bool = False) -> Callable[[np.random.Generator], float]:
    """Lift of the rank correlation under stress when both sides are resampled in blocks independently.

    ``selected`` picks the stress days anew as those of the largest joint moves: what selection on
    size alone gives.
    """
    n, q = len(x), int(stress.sum())

    def draw(rng):
        a, b = x[circular_blocks(n, block, rng)], y[circular_blocks(n, block, rng)]
        mask = stress
        if selected:
            mask = np.zeros(n, bool)
            mask[np.argsort(-(np.abs(a) + np.abs(b)), kind="stable")[:q]] = True
        return stress_lift(a, b, mask)

    return draw


def residual_bootstrap(counts: np.ndarray, fitted: np.ndarray, statistic: Callable[[np.ndarray], float]) -> Callable[[np.random.Generator], float]:
    """The statistic of the fit with its residuals drawn again, floored at 0."""
    rest = counts - fitted
    rest = rest - rest.mean()
    return lambda rng: statistic(np.maximum(fitted + rng.choice(rest, len(rest)), 0.0))
