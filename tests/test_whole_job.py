"""Queries give the whole job: nothing is left out that their tables hold."""

import math

import numpy as np
import pytest

from tideglass.functions import kernels as k
from tideglass.functions.events import DAY_MS
from tideglass.operators.grid_smoother import regular_grid
from tideglass.plans.events_queries import cross_form_dedup, envelope_explode
from tideglass.plans.kernel_queries import hawkes_fit
from tideglass.plans.views import quotes

TICKERS = "tick_id long, ts long, symbol string, last_price double, mark_price double, index_price double, funding_rate double, open_interest double, bid1_price double, bid1_size double, ask1_price double, ask1_size double, recv_ts double"


def test_quotes_place_records_without_own_time_by_their_first_delivery(spark, rows, tmp_path):
    rest = (None,) * 7
    data = [(1, 0, "a", 1.0, 2.0, *rest, 90_000.7), (1, 0, "a", 1.0, 2.0, *rest, 90_000.25), (2, 70, "a", 1.0, 3.0, *rest, None), (2, 70, "a", 1.0, 3.0, *rest, 5.0), (3, 0, "a", 1.0, 4.0, *rest, None)]
    spark.createDataFrame(data, TICKERS).write.parquet(f"{tmp_path}/tickers.parquet")
    assert rows(quotes(spark, str(tmp_path)), "tick_id", "ts", "day", "mark_price") == [(1, 90_000_250, 1, 2.0), (2, 70, 0, 3.0)]


def _hawkes_cost(t, mu, n, b):
    """Negative log likelihood event by event, excitement from earlier times only."""
    rate = [mu + n * b * np.exp(-b * (v - t[t < v])).sum() for v in t]
    return mu * (t[-1] - t[0]) + n * (1 - np.exp(-b * (t[-1] - t))).sum() - np.log(rate).sum()


def test_hawkes_counts_equal_times_as_events():
    rng = np.random.default_rng(3)
    t = np.sort(np.concatenate([rng.uniform(0, 600, 40)] * 2 + [rng.uniform(0, 600, 30)]))
    fit = k.hawkes(t)
    best = _hawkes_cost(t, *fit)
    for i in range(3):
        for f in (0.97, 1.03):
            assert best <= _hawkes_cost(t, *[v * (f if i == j else 1) for j, v in enumerate(fit)]) + 1e-6
    mu, n, b = fit
    assert mu * (t[-1] - t[0]) + n * (1 - np.exp(-b * (t[-1] - t))).sum() == pytest.approx(len(t), rel=0.02)
    assert np.isfinite(k.hawkes(np.array([0.0, 5.0, 5.0]))).all() and np.isnan(k.hawkes(np.array([1.0, 1.0, 1.0]))).all()


def test_hawkes_fit_has_every_symbol_and_hour(spark, tmp_path):
    data = [(i, 3_600_000 * h + 1000 * i, "a", 1.0, 1.0, "Buy") for h, n in enumerate((1, 3, 6)) for i in range(10 * h, 10 * h + n)]
    spark.createDataFrame(data, "trade_id long, ts long, symbol string, price double, volume double, side string").write.parquet(f"{tmp_path}/trades.parquet")
    got = {r.hour: r.mu for r in hawkes_fit(spark, str(tmp_path)).collect()}
    assert set(got) == {0, 1, 2} and got[0] is None and got[1] > 0 and got[2] > 0


def test_changepoints_keep_every_run_length():
    x = np.random.default_rng(0).standard_normal(420)
    weight, stats, want = [1.0], [(0.0, 1.0, 1.0, 1.0)], []
    for v in x:
        dens = []
        for m, c, a, b in stats:
            s = b * (c + 1) / (a * c)
            dens.append(math.exp(math.lgamma(a + 0.5) - math.lgamma(a)) / math.sqrt(2 * a * math.pi * s) * (1 + (v - m) ** 2 / (2 * a * s)) ** -(a + 0.5))
        joint = [w * d for w, d in zip(weight, dens)]
        weight = [sum(joint) * 0.01, *[j * 0.99 for j in joint]]
        weight = [w / sum(weight) for w in weight]
        stats = [(0.0, 1.0, 1.0, 1.0), *[((c * m + v) / (c + 1), c + 1, a + 0.5, b + c * (v - m) ** 2 / (2 * (c + 1))) for m, c, a, b in stats]]
        want.append(sum(weight[:5]))
    assert np.allclose(k.changepoint_probability(x), want, atol=1e-9)


def test_fractional_difference_takes_weights_down_to_the_threshold():
    w = k.fractional_weights(0.4, 283)
    assert k.fractional_length(0.4) == 282 and abs(w[281]) >= 1e-4 > abs(w[282])
    out = k.fractional_difference(np.full(300, 12.0))
    assert np.isnan(out[:281]).all() and np.allclose(out[281:], 12 * w[:282].sum())
    assert k.fractional_length(1.0) == 2


def test_grid_runs_over_midnight_and_empty_days(spark, rows):
    data = [("a", DAY_MS - 700_000, 10.0), ("a", 3 * DAY_MS + 400_000, 14.0), ("a", 3 * DAY_MS + 400_000, 16.0), ("b", 5, 1.0)]
    out = regular_grid(spark.createDataFrame(data, "symbol string, event_ms long, v double"), "symbol", "v", across=True)
    got = rows(out, "symbol", "period_ms", "readings", "is_missing")
    periods = range(DAY_MS - 900_000, 3 * DAY_MS + 300_001, 300_000)
    assert set(got) == {("a", p, int(p in (periods[0], periods[-1])), p not in (periods[0], periods[-1])) for p in periods} | {("b", 0, 1, False)}
    assert len(got) == len(periods) + 1
    value = {r.period_ms: r.value for r in out.where("symbol = 'a'").collect()}
    assert value[DAY_MS] == pytest.approx(10, abs=0.2) and value[2 * DAY_MS] == pytest.approx(12.5, abs=0.3) and value[3 * DAY_MS] == pytest.approx(15, abs=0.2)


def test_frames_hold_trades_without_side_or_size(spark, rows, tmp_path):
    data = [(1, 5, "a", 1.0, None, "Buy"), (3, 6, "a", 2.0, 4.0, None), (15, 7, "a", 3.0, None, "")]
    spark.createDataFrame(data, "trade_id long, ts long, symbol string, price double, volume double, side string").write.parquet(f"{tmp_path}/trades.parquet")
    want = [(False, "1", 5, "buy", 1.0, None), (True, "15", 7, None, 3.0, None), (True, "3", 6, None, 2.0, 4.0)]
    for q in (envelope_explode, cross_form_dedup):
        assert rows(q(spark, str(tmp_path)), "is_envelope", "trade_key", "ts", "side", "price", "size") == want


def test_a_block_begins_with_the_level_and_slope_of_the_one_before(spark):
    rng = np.random.default_rng(5)
    times = np.sort(rng.choice(np.arange(0, 2 * DAY_MS, 60_000), 700, replace=False))
    value = 100 + times / DAY_MS * 10 + rng.normal(0, 0.02, 700)
    data = [("a", int(t), float(v)) for t, v in zip(times, value) if not DAY_MS - 1_800_000 < t < DAY_MS + 1_800_000]
    out = regular_grid(spark.createDataFrame(data, "symbol string, event_ms long, v double"), "symbol", "v", across=True)
    near = {r.period_ms: r for r in out.where(f"abs(period_ms - {DAY_MS}) <= 1500000").collect()}
    assert len(near) == 11 and all(r.is_missing for r in near.values())
    assert all(abs(r.value - (100 + p / DAY_MS * 10)) < 0.05 for p, r in near.items())
