import itertools
import math

import numpy as np
import pytest

from tideglass.functions import kernels as k

RNG = np.random.default_rng(3)


def test_distributions():
    assert k.normal_cdf([0.0, 1.959964])[1] == pytest.approx(0.975, abs=1e-6)
    assert k.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert k.chi2_tail(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert k.chi2_tail(0, 4) == 1
    call, delta = k.black76(100, 100, 0.2, 1.0)
    assert call[0] == pytest.approx(7.9656, abs=1e-3) and delta[0] == pytest.approx(0.5398, abs=1e-3)
    put, _ = k.black76(100, 90, 0.2, 1.0, call=False)
    other, _ = k.black76(100, 90, 0.2, 1.0)
    assert other[0] - put[0] == pytest.approx(10)


def test_ordinal_patterns():
    for m in (3, 4):
        codes = {int(k.ordinal_codes(np.array(p, float), m)[0]) for p in itertools.permutations(range(m))}
        assert codes == set(range(math.factorial(m)))
    h = k.rolling_permutation_entropy(np.arange(50.0), 20, 3)
    assert np.isnan(h[:19]).all() and np.allclose(h[19:], 0)
    noise = RNG.standard_normal(4000)
    assert k.rolling_permutation_entropy(noise, 3000, 3)[-1] > 0.99
    assert len(k.rolling_permutation_entropy(np.ones(2), 20, 3)) == 2


def test_recurrence_by_hand():
    r = k.recurrence(np.tile([0.0, 1.0], 20), 0.1, dim=1)
    assert r["rate"] == pytest.approx(380 / 780) and r["determinism"] == pytest.approx(1, abs=0.01)
    assert np.isnan(k.recurrence(np.ones(2), 0.1)["rate"])


def test_scaling_and_components():
    h = k.generalised_hurst(RNG.standard_normal(8000))
    assert h[2] == pytest.approx(0.5, abs=0.08)
    assert k.persistence_lengths(np.array([[0.0, 0], [1, 0], [5, 0]])).tolist() == [4, 1]


def test_changepoint_rises_at_a_shift():
    x = np.concatenate([RNG.standard_normal(100), 8 + RNG.standard_normal(30)])
    p = k.changepoint_probability(x)
    assert p[101:104].max() > 0.9 and p[60:95].max() < 0.5
    assert k.changepoint_probability(np.array([1.0, np.nan]))[1] == k.changepoint_probability(np.array([1.0]))[0]


def test_filters():
    assert k.fractional_weights(1.0, 4).tolist() == [1, -1, 0, 0]
    x = RNG.standard_normal(80)
    assert np.allclose(k.fractional_difference(x, 1.0, 10)[9:], np.diff(x)[8:])
    step = np.repeat([0.0, 5.0], 64)
    noisy = step + 0.3 * RNG.standard_normal(128)
    assert ((k.haar_denoised(noisy) - step) ** 2).mean() < ((noisy - step) ** 2).mean() / 2
    wide = np.concatenate([RNG.standard_normal(200) * 0.2, RNG.standard_normal(100) * 3])
    p = k.two_state_filter(wide)
    assert p[50:200].mean() < 0.1 < 0.9 < p[220:].mean()
    assert np.abs(k.kalman_level(np.ones(300), np.ones(300))[-1] - 1) < 0.1


def test_spectra():
    t = np.arange(512)
    power = np.abs(np.fft.rfft(np.sin(2 * np.pi * 40 * t / 512) + 0.1 * RNG.standard_normal(512))) ** 2
    assert k.cell_average_peaks(power)[0][0] == 40
    x = np.cumsum(RNG.standard_normal(1000))
    assert k.wavelet_lead(x[5:], x[:-5]) == pytest.approx(-k.wavelet_lead(x[:-5], x[5:]), rel=0.2)
    c = k.correlation_spectrum(RNG.standard_normal((400, 10)) + RNG.standard_normal((400, 1)))
    assert sum(c["values"]) == pytest.approx(10) and c["above"] == 1
    assert k.effective_number(RNG.standard_normal((2000, 5))) == pytest.approx(5, abs=0.2)
    assert k.cyclic_spectrum(np.ones(5)).size == 0


def test_surrogate_keeps_values_and_spectrum():
    x = np.cumsum(RNG.standard_normal(256))
    y = k.phase_surrogate(x, np.random.default_rng(0))
    assert np.array_equal(np.sort(x), np.sort(y))
    a, b = np.abs(np.fft.rfft(x)), np.abs(np.fft.rfft(y))
    assert np.corrcoef(a, b)[0, 1] > 0.98


def test_tails():
    u = RNG.random(4000)
    x = 2.0 / 0.3 * (u**-0.3 - 1)
    for xi, beta in (k.gpd_moments(x), k.gpd_likelihood(x)):
        assert xi == pytest.approx(0.3, abs=0.08) and beta == pytest.approx(2, abs=0.25)
    assert k.minimise(lambda p: ((p - [1, 2]) ** 2).sum(), np.zeros(2)) == pytest.approx([1, 2], abs=1e-3)


def test_point_processes():
    rng = np.random.default_rng(1)
    t = np.cumsum(rng.exponential(1, 300))
    mu, n, b = k.hawkes(t)
    span = t[-1] - t[0]
    expected = mu * span + n * (1 - np.exp(-b * (t[-1] - t))).sum()  # equals the count where the likelihood is largest
    assert expected == pytest.approx(len(t), rel=0.05)
    after = (rng.random(2000) ** -1.0 - 1) * 0.5
    _, c, p = k.omori(after[after < 500])
    assert p == pytest.approx(2, abs=0.4)
    s, i = np.empty(60), np.empty(60)
    s[0], i[0] = 990, 10
    for j in range(59):
        new = 0.0005 * s[j] * i[j]
        s[j + 1], i[j + 1] = s[j] - new, i[j] + new - 0.1 * i[j]
    assert k.sir_rates(s, i) == pytest.approx((0.0005, 0.1), rel=1e-6)
    assert k.sir_rates(s[:3], i[:3]) == (0.001, 0.1)


def test_smile_bunching_words():
    grid = np.linspace(-0.5, 0.5, 21)
    p = k.svi_fit(grid, k.svi_variance((0.02, 0.2, -0.3, 0.05, 0.15), grid))
    assert np.abs(k.svi_variance(p, grid) - k.svi_variance((0.02, 0.2, -0.3, 0.05, 0.15), grid)).max() < 1e-3
    flat = np.linspace(0.4, 1.3, 90_001)[:-1]
    assert abs(k.bunching(flat)) < 0.1 and k.bunching(np.concatenate([flat, np.ones(1000)])) > 0.9
    assert k.sax(np.ones(10), 5, 4) == "ccccc" and k.sax(np.arange(40.0), 4, 4) == "abcd"
    assert k.local_alignment("xxabcd", "abcdyy") == 8


def test_forecasts():
    assert k.crps(np.array([1.0, 3.0]), 2.0) == pytest.approx(0.5)
    f = np.arange(60.0)[:, None] % 7
    got = k.analog_forecast(f, f[:, 0], k=3, embargo=1)
    assert np.isnan(got[2]).all() and (got[50] == f[50, 0]).all()
    assert np.isfinite(k.har_forecast(np.exp(RNG.standard_normal(120)))[60:]).all()
    assert k.markov_cross_entropy(np.array([0, 1] * 50), np.array([0, 1] * 50), 2) < 0.05


def test_sequential_rules():
    assert k.thinned(np.array([0, 5, 10, 14, 20.0]), 10).tolist() == [True, False, True, False, True]
    r = np.array([np.nan, 1, -1, 2, -2, 3.0])
    assert k.causal_mad(r, 60, 3)[5] == pytest.approx(1.4826 * np.median(np.abs(np.array([1, -1, 2, -2.0]))))


def test_regimes_know_the_past_only():
    x = np.concatenate([RNG.standard_normal(300) * 0.2, RNG.standard_normal(300) * 2, RNG.standard_normal(300) * 0.2])
    p = k.two_state_filter(x)
    assert np.isnan(p[:50]).all() and np.isfinite(p[50:]).all()
    assert np.allclose(k.two_state_filter(np.concatenate([x[:500], np.full(400, 50.0)]))[50:500], p[50:500])
    narrow, wide, stay = k.fitted_regimes(x)
    assert narrow == pytest.approx(0.2, rel=0.2) and wide == pytest.approx(2, rel=0.2) and stay > 0.98
    assert p[700:].mean() < 0.1 and k.two_state_filter(np.zeros(120))[60:].max() < 0.5


def test_spread_before_each_value_and_windows():
    x = RNG.standard_normal(40)
    sd = k.expanding_spread(x)
    assert sd[20] == pytest.approx(x[:20].std()) and (sd[:5] == sd[0]).all() and (k.expanding_spread(np.zeros(9)) == 1).all()
    assert [(s, len(w)) for s, w in k.windows(np.arange(25), 10, 6)] == [(0, 10), (10, 15)] and [len(w) for _, w in k.windows(np.arange(27), 10, 6)] == [10, 10, 7]
    assert sum(len(w) for _, w in k.windows(np.arange(3), 10, 6)) == 3


def test_chi_squared_tails_of_odd_and_even_degrees():
    for x, df in ((3.841459, 1), (5.991465, 2), (7.814728, 3), (9.487729, 4), (24.9958, 15)):
        assert k.chi2_tail(x, df) == pytest.approx(0.05, abs=1e-5)


def test_chains_of_higher_order_and_density():
    x = np.array([0, 0, 1, 1] * 60)
    assert k.markov_cross_entropy(x, x, 2, order=2) < 0.05 < 0.6 < k.markov_cross_entropy(x, x, 2, order=1)
    assert np.isnan(k.markov_cross_entropy(x, x[:2], 2, order=2))
    grid = np.linspace(-3, 3, 6001)
    p = k.risk_neutral_density((0.04, 0.1, -0.3, 0.0, 0.2), grid)
    assert (p > -1e-9).all() and p.sum() * (grid[1] - grid[0]) == pytest.approx(1, abs=1e-3) and (p * np.exp(grid)).sum() * (grid[1] - grid[0]) == pytest.approx(1, abs=1e-3)
