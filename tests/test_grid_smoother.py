import numpy as np
import pytest

from tideglass.functions.events import DAY_MS, PERIOD_MS, timed_records
from tideglass.operators.grid_smoother import SLOPE_SHARE, _smooth, regular_grid, smooth_bundle

SCHEMA = "symbol string, event_ms long, v double"


def dense(t, y, grid, q, r):
    """The same model as one Gaussian system: level and slope at all times, solved at once."""
    times = np.unique(np.concatenate([t, grid]))
    n = len(times)
    rows, rhs = [], []
    for i in range(1, n):
        d = (times[i] - times[i - 1]) / 60_000
        f = np.array([[1, d], [0, 1]])
        qs = q * SLOPE_SHARE
        c = np.linalg.cholesky(np.linalg.inv(np.array([[q * d + qs * d**3 / 3, qs * d * d / 2], [qs * d * d / 2, qs * d]]))).T
        block = np.zeros((2, 2 * n))
        block[:, 2 * i : 2 * i + 2] = c
        block[:, 2 * i - 2 : 2 * i] = -c @ f
        rows.append(block)
        rhs.append(np.zeros(2))
    prior = np.zeros((2, 2 * n))
    prior[0, 0], prior[1, 1] = 1 / np.sqrt(1e4 * (q + r)), 1 / np.sqrt(q)
    rows.append(prior)
    rhs.append(np.array([y[0] * prior[0, 0], 0]))
    for a, b in zip(t, y):
        row = np.zeros((1, 2 * n))
        row[0, 2 * np.searchsorted(times, a)] = 1 / np.sqrt(r)
        rows.append(row)
        rhs.append(np.array([b / np.sqrt(r)]))
    a, b = np.concatenate(rows), np.concatenate(rhs)
    cov = np.linalg.inv(a.T @ a)
    x = cov @ a.T @ b
    at = 2 * np.searchsorted(times, grid)
    return x[at], np.sqrt(np.diag(cov)[at])


def test_smoother_equals_dense_solution():
    rng = np.random.default_rng(1)
    t = np.sort(rng.choice(100, 12, replace=False)) * 60_000.0
    y = np.cumsum(rng.standard_normal(12)) + 5
    grid = np.arange(t[0], t[-1], 7 * 60_000.0) + 1000
    when = np.concatenate([t, grid])
    order = np.argsort(when, kind="stable")
    z = np.concatenate([y, np.full(len(grid), np.nan)])[order][:, None]
    dt = np.diff(when[order], prepend=when[order][0])[:, None] / 60_000
    level, var = _smooth(dt, z, np.array([0.5]), np.array([0.2]))
    want, sd = dense(t, y, grid, 0.5, 0.2)
    mask = np.isnan(z[:, 0])
    assert np.allclose(level[mask, 0], want, rtol=1e-4, atol=1e-4)
    assert np.allclose(np.sqrt(var[mask, 0]), sd, rtol=1e-3)


def test_lockstep_equals_each_alone():
    rng = np.random.default_rng(2)
    series = []
    for n in (3, 40, 9):
        t = np.sort(rng.choice(2000, n, replace=False)).astype(np.int64) * 10_000
        series.append((t, 100 + np.cumsum(rng.standard_normal(n)), np.arange(t[0] // PERIOD_MS * PERIOD_MS, t[-1] + 1, PERIOD_MS)))
    together = smooth_bundle(series)
    for s, (level, sd) in zip(series, together):
        (alone, sd2), = smooth_bundle([s])
        assert np.allclose(level, alone) and np.allclose(sd, sd2)


def test_gaps_flags_and_bad_rows(spark, rows):
    m = 60_000
    data = [("a", 0, 10.0), ("a", 0, 10.0), ("a", 16 * m, 12.0), ("a", DAY_MS + m, 5.0), ("b", None, 1.0), (None, 5, 1.0), ("b", 7, float("nan")), ("b", 8, None), ("b", 9, float("inf"))]
    df = spark.createDataFrame(data, SCHEMA)
    out = regular_grid(df.selectExpr("*", "1 AS value", "2 AS period_ms", "3 AS _block", "4 AS is_missing"), "symbol", "v")
    assert set(rows(out, "symbol", "period_ms", "readings", "is_missing")) == {("a", 0, 1, False), ("a", 300_000, 0, True), ("a", 600_000, 0, True), ("a", 900_000, 1, False), ("a", DAY_MS, 1, False)}
    filled = {r.period_ms: r for r in out.where("is_missing").collect()}
    assert 10 <= filled[300_000].value <= filled[600_000].value <= 12
    near = out.where("period_ms = 0").first()
    assert near.value == pytest.approx(10, abs=0.5) and near.value_sd < filled[600_000].value_sd


def test_constant_series_and_empty(spark):
    data = [("a", k * 400_000, 7.0) for k in range(10)]
    out = regular_grid(spark.createDataFrame(data, SCHEMA), "symbol", "v").collect()
    assert all(abs(r.value - 7) < 1e-6 for r in out)
    assert regular_grid(spark.createDataFrame([], SCHEMA), "symbol", "v").count() == 0


def test_event_time_is_that_of_the_first_delivery(spark, rows):
    data = [(1, 0, "a", 2.0, 100.5), (1, 0, "a", 2.0, 90.25), (2, 70, "a", 3.0, None), (3, 0, "a", 1.0, None), (4, None, "a", 1.0, 5.0)]
    df = spark.createDataFrame(data, "id long, ts long, symbol string, v double, recv_ts double")
    assert rows(timed_records(df, "id", ["id", "v"]), "id", "v", "event_ms") == [(1, 2.0, 90_250), (2, 3.0, 70)]
