"""Numerical kernels over one series: plain NumPy, no state outside the arguments."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

NORMAL = NormalDist()


# -- distributions --------------------------------------------------------------------------
def normal_cdf(x: np.ndarray) -> np.ndarray:
    """Standard normal distribution function."""
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in np.atleast_1d(np.asarray(x, float))])


def normal_quantile(p: float) -> float:
    return NORMAL.inv_cdf(p)


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution with whole degrees of freedom, by its finite sum upwards from one or two of them."""
    if x <= 0:
        return 1.0
    half = x / 2
    tail = math.erfc(math.sqrt(half)) if df % 2 else math.exp(-half)
    for d in range(1 if df % 2 else 2, df, 2):
        tail += math.exp(d / 2 * math.log(half) - half - math.lgamma(d / 2 + 1))
    return min(1.0, tail)


def black76(forward, strike, vol, years, call=True):
    """Price (undiscounted) and delta of options on a forward."""
    f, k, s, t = (np.asarray(v, float) for v in (forward, strike, vol, years))
    sd = s * np.sqrt(t)
    d1 = np.log(f / k) / sd + sd / 2
    n1, n2 = normal_cdf(d1), normal_cdf(d1 - sd)
    c = f * n1 - k * n2
    call = np.asarray(call)
    return np.where(call, c, c - f + k), np.where(call, n1, n1 - 1)


# -- entropy, recurrence, scaling -----------------------------------------------------------
def ordinal_codes(x: np.ndarray, m: int = 4) -> np.ndarray:
    """Pattern number (0..m!-1) of each window of ``m``; equal values go by time."""
    if len(x) < m:
        return np.zeros(0, dtype=int)
    order = np.argsort(np.lib.stride_tricks.sliding_window_view(x, m), axis=1, kind="stable")
    code = np.zeros(len(order), dtype=int)
    for i in range(m):
        code += (order[:, i + 1 :] < order[:, i : i + 1]).sum(1) * math.factorial(m - 1 - i)
    return code


def rolling_permutation_entropy(x: np.ndarray, window: int = 60, m: int = 4) -> np.ndarray:
    """Normalised entropy of the patterns inside each trailing window; NaN before it is full."""
    out = np.full(len(x), np.nan)
    code = ordinal_codes(x, m)
    k = window - m + 1
    if len(code) < k or k < 1:
        return out
    hot = np.zeros((len(code) + 1, math.factorial(m)))
    hot[np.arange(1, len(code) + 1), code] = 1
    counts = np.cumsum(hot, axis=0)
    p = (counts[k:] - counts[:-k]) / k
    with np.errstate(divide="ignore", invalid="ignore"):
        h = -np.where(p > 0, p * np.log(p), 0).sum(1) / math.log(math.factorial(m))
    out[window - 1 :] = np.clip(h, 0, 1)
    return out


def recurrence(x: np.ndarray, radius: float, dim: int = 3, least: int = 2) -> dict[str, float]:
    """Recurrence rate, determinism (upper triangle) and laminarity (whole matrix) of delay vectors."""
    n = len(x) - dim + 1
    if n < 3:
        return {"rate": np.nan, "determinism": np.nan, "laminarity": np.nan}
    v = np.lib.stride_tricks.sliding_window_view(x, dim)
    r = np.ones((n, n), dtype=bool)
    for j in range(dim):
        r &= np.abs(v[:, None, j] - v[None, :, j]) < radius

    def lines(vectors):
        total = 0
        for line in vectors:
            edges = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(int), [0]])))
            size = edges[1::2] - edges[::2]
            total += size[size >= least].sum()
        return total

    upper = [np.diagonal(r, k) for k in range(1, n)]
    points = sum(d.sum() for d in upper)
    return {
        "rate": points / (n * (n - 1) / 2),
        "determinism": lines(upper) / points if points else 0.0,
        "laminarity": lines(r.T) / r.sum(),
    }


def generalised_hurst(x: np.ndarray, scales=(8, 16, 32, 64), orders=(-2, 0, 2)) -> dict[float, float]:
    """Multifractal detrended fluctuation: slope of the log q-order fluctuation on the log scale."""
    profile = np.cumsum(x - x.mean())
    use = [s for s in scales if len(x) >= 4 * s]
    if len(use) < 2:
        return dict.fromkeys(orders, np.nan)
    logs = {q: [] for q in orders}
    for s in use:
        parts = profile[: len(profile) // s * s].reshape(-1, s)
        t = np.arange(s) - (s - 1) / 2
        flat = parts - parts.mean(1, keepdims=True)
        rest = flat - (flat @ t / (t @ t))[:, None] * t
        f2 = np.maximum((rest**2).mean(1), 1e-300)
        for q in orders:
            logs[q].append(0.5 * np.log(f2).mean() if q == 0 else np.log((f2 ** (q / 2)).mean()) / q)
    return {q: float(np.polyfit(np.log(use), logs[q], 1)[0]) for q in orders}


def persistence_lengths(points: np.ndarray) -> np.ndarray:
    """Lifetimes of connected components under growing radius: the edges of the minimum spanning tree."""
    n = len(points)
    if n < 2:
        return np.zeros(0)
    best = np.linalg.norm(points - points[0], axis=1)
    done = np.zeros(n, dtype=bool)
    done[0] = True
    out = []
    for _ in range(n - 1):
        j = int(np.argmin(np.where(done, np.inf, best)))
        out.append(best[j])
        done[j] = True
        best = np.minimum(best, np.linalg.norm(points - points[j], axis=1))
    return np.sort(np.array(out))[::-1]


# -- filters --------------------------------------------------------------------------------
def changepoint_probability(x: np.ndarray, hazard: float = 1 / 100) -> np.ndarray:
    """Bayesian online changepoint detection with a Student-t predictive: mass of short runs (under 5) after each point.

    Every run length is kept, so time grows with the square of the series.
    """
    mu, beta = np.zeros(1), np.ones(1)
    log_run = np.zeros(1)
    kappas = 1.0 + np.arange(len(x) + 1)
    alphas = 1.0 + 0.5 * np.arange(len(x) + 1)
    gammas = np.array([math.lgamma(a + 0.5) - math.lgamma(a) for a in alphas])
    out = np.full(len(x), np.nan)
    for i, v in enumerate(x):
        if np.isfinite(v):
            kappa, alpha = kappas[: len(mu)], alphas[: len(mu)]
            df, scale = 2 * alpha, beta * (kappa + 1) / (alpha * kappa)
            pred = gammas[: len(mu)] - 0.5 * np.log(df * np.pi * scale) - (df + 1) / 2 * np.log1p((v - mu) ** 2 / (df * scale))
            grow = log_run + pred
            top = grow.max()
            change = top + math.log(np.exp(grow - top).sum()) + math.log(hazard)
            log_run = np.concatenate([[change], grow + math.log(1 - hazard)])
            top = log_run.max()
            log_run -= top + math.log(np.exp(log_run - top).sum())
            beta = np.concatenate([[1.0], beta + kappa * (v - mu) ** 2 / (2 * (kappa + 1))])
            mu = np.concatenate([[0.0], (kappa * mu + v) / (kappa + 1)])
        out[i] = np.exp(log_run[:5]).sum()
    return out


def _regime_pass(x: list[float], narrow: float, wide: float, stay: float) -> tuple[list[float], list[float], float, float]:
    """Forward and backward pass of the two-state chain: filtered and smoothed weight of the wide state, and how often it was kept or left."""
    a, b = 1 / narrow, 1 / wide
    like = [(a * math.exp(-0.5 * (v * a) ** 2) + 1e-300, b * math.exp(-0.5 * (v * b) ** 2) + 1e-300) for v in x]
    p, filtered, ahead = 0.5, [], []
    for n, w in like:
        prior = p * stay + (1 - p) * (1 - stay)
        ahead.append(prior)
        up, down = prior * w, (1 - prior) * n
        p = up / (up + down)
        filtered.append(p)
    smooth, same = filtered[:], 0.0
    for i in range(len(x) - 2, -1, -1):
        f, prior = filtered[i], ahead[i + 1]
        up = f * stay * smooth[i + 1] / prior
        down = f * (1 - stay) * (1 - smooth[i + 1]) / (1 - prior)
        smooth[i] = up + down
        same += up + (1 - f) * stay * (1 - smooth[i + 1]) / (1 - prior)
    return filtered, smooth, same, p


def fitted_regimes(x: np.ndarray, rounds: int = 8) -> tuple[float, float, float]:
    """Spreads of the narrow and the wide state and the chance to stay, by expectation-maximisation; the wide one is at least twice the narrow."""
    v = np.asarray(x, float)
    square = v * v
    narrow = max(float(np.median(np.abs(v))) * 1.4826, 1e-12)
    wide, stay = max(2 * narrow, 2 * float(v.std())), 0.98
    for _ in range(rounds):
        _, smooth, same, _ = _regime_pass(v.tolist(), narrow, wide, stay)
        g = np.array(smooth)
        narrow = max(math.sqrt(((1 - g) * square).sum() / max((1 - g).sum(), 1e-9)), 1e-12)
        wide = max(math.sqrt((g * square).sum() / max(g.sum(), 1e-9)), 2 * narrow)
        stay = min(max((same + 49) / (len(v) - 1 + 50), 0.8), 0.999)
    return narrow, wide, stay


def two_state_filter(x: np.ndarray, first: int = 50) -> np.ndarray:
    """Filtered probability of the wide state of a two-state Gaussian hidden Markov model, from what was known at each point only.

    The model is fitted on the first ``first`` values when they are in, and again on all values so far
    whenever their number has doubled. Before the first fit the probability is unknown (NaN). A series
    without movement is all narrow.
    """
    out = np.full(len(x), np.nan)
    v = np.where(np.isfinite(x), x, 0.0)
    at = first
    while at < len(v):
        narrow, wide, stay = fitted_regimes(v[:at]) if np.abs(v[:at]).max() > 0 else (1.0, 2.0, 0.98)
        upto = min(2 * at, len(v))
        out[at:upto] = _regime_pass(v[:upto].tolist(), narrow, wide, stay)[0][at:]
        at = upto
    return out


def expanding_spread(x: np.ndarray, least: int = 5) -> np.ndarray:
    """Standard deviation of all values before each one; that of the first ``least`` for these, 1 where there is none."""
    n = np.arange(1, len(x) + 1)
    m, s = np.cumsum(x) / n, np.cumsum(x * x) / n
    sd = np.sqrt(np.maximum(s - m * m, 0.0))
    out = np.concatenate([[0.0], sd[:-1]])
    out[:least] = sd[min(least, len(x)) - 1]
    return np.where(out > 1e-12, out, 1.0)


def windows(x: np.ndarray, size: int, least: int) -> list[tuple[int, np.ndarray]]:
    """(start, values) of consecutive windows of ``size``; a last one of fewer than ``least`` values is joined to the one before."""
    starts = list(range(0, len(x), size))
    if len(starts) > 1 and len(x) - starts[-1] < least:
        starts.pop()
    return [(s, x[s : (starts[i + 1] if i + 1 < len(starts) else len(x))]) for i, s in enumerate(starts)]


def kalman_level(x: np.ndarray, dt: np.ndarray, phi: float = 0.99, q: float = 1e-3, r: float = 1e-2) -> np.ndarray:
    """Filtered mean-reverting level with drift; transition and noise scale with the time step."""
    s, p = np.zeros(2), np.eye(2)
    out = np.empty(len(x))
    for i, v in enumerate(x):
        f = np.array([[phi ** dt[i], dt[i]], [0.0, phi ** dt[i]]])
        s, p = f @ s, f @ p @ f.T + np.eye(2) * q * dt[i]
        if np.isfinite(v):
            gain = p[:, 0] / (p[0, 0] + r)
            s = s + gain * (v - s[0])
            p = p - np.outer(gain, p[0])
        out[i] = s[0]
    return out


def fractional_weights(d: float, length: int) -> np.ndarray:
    """Weights of fractional differencing: w_k = -w_{k-1} (d - k + 1) / k."""
    w = np.ones(length)
    for k in range(1, length):
        w[k] = -w[k - 1] * (d - k + 1) / k
    return w


def fractional_length(d: float, least: float = 1e-4) -> int:
    """Number of weights before the first below ``least`` in absolute value."""
    k, w = 0, 1.0
    while abs(w) >= least:
        k += 1
        w = -w * (d - k + 1) / k
    return k


def fractional_difference(x: np.ndarray, d: float = 0.4, length: int | None = None) -> np.ndarray:
    """Fractional differences by ``length`` weights, or all down to 1e-4; NaN before the filter is full."""
    length = fractional_length(d) if length is None else length
    out = np.full(len(x), np.nan)
    if len(x) >= length:
        out[length - 1 :] = np.convolve(x, fractional_weights(d, length), "valid")
    return out


def haar_denoised(x: np.ndarray, levels: int = 3) -> np.ndarray:
    """Soft-thresholded Haar wavelet transform at the universal threshold."""
    n = 1 << max(math.ceil(math.log2(max(len(x), 2))), levels)
    a = np.pad(x, (0, n - len(x)), mode="edge")
    details = []
    for _ in range(levels):
        details.append((a[::2] - a[1::2]) / math.sqrt(2))
        a = (a[::2] + a[1::2]) / math.sqrt(2)
    limit = np.median(np.abs(details[0])) / 0.6745 * math.sqrt(2 * math.log(n))
    for d in reversed(details):
        d = np.sign(d) * np.maximum(np.abs(d) - limit, 0)
        b = np.empty(2 * len(a))
        b[::2], b[1::2] = (a + d) / math.sqrt(2), (a - d) / math.sqrt(2)
        a = b
    return a[: len(x)]


# -- spectra --------------------------------------------------------------------------------
def cell_average_peaks(power: np.ndarray, train: int = 8, guard: int = 2, factor: float = 4.0) -> list[tuple[int, float]]:
    """Cells above ``factor`` times the mean of the training cells outside the guard cells: (index, ratio), strongest first."""
    out = []
    for i in range(len(power)):
        around = np.concatenate([power[max(i - guard - train, 0) : max(i - guard, 0)], power[i + guard + 1 : i + guard + 1 + train]])
        if len(around) and around.mean() > 0 and power[i] > factor * around.mean():
            out.append((i, float(power[i] / around.mean())))
    return sorted(out, key=lambda p: -p[1])


def cyclic_spectrum(x: np.ndarray, segment: int = 64) -> np.ndarray:
    """Spectral correlation density |mean X(f + a/2) conj X(f - a/2)| over half-overlapping windowed segments, [a, f]."""
    y = (x - x.mean())[: len(x)]
    if len(y) < segment:
        return np.zeros((0, 0))
    parts = np.lib.stride_tricks.sliding_window_view(y, segment)[:: segment // 2] * np.hanning(segment)
    f = np.fft.fft(parts, axis=1)
    shifts = range(segment // 4)
    return np.stack([np.abs((np.roll(f, -a, 1) * np.conj(np.roll(f, a, 1))).mean(0)) for a in shifts])


def wavelet_lead(x: np.ndarray, y: np.ndarray, scales=(8, 16, 32)) -> float:
    """Time by which ``x`` leads ``y``: phase over angular frequency of the Morlet cross spectrum, weighted by coherence and power."""
    def transform(v, s):
        w = 2 * np.pi * np.fft.fftfreq(len(v))
        return np.fft.ifft(np.fft.fft(v - v.mean()) * np.where(w > 0, np.exp(-0.5 * (s * w - 6) ** 2), 0) * math.sqrt(s))

    total = weight = 0.0
    box = np.ones(max(3, len(x) // 16))
    box /= len(box)
    smooth = lambda v: np.convolve(v, box, "same")
    for s in scales:
        a, b = transform(x, s), transform(y, s)
        cross = smooth(a * np.conj(b))
        power = smooth(np.abs(a) ** 2) * smooth(np.abs(b) ** 2)
        coherence = np.clip(np.abs(cross) ** 2 / np.maximum(power, 1e-300), 0, 1)
        w = coherence * np.sqrt(power)
        total += (np.angle(cross) / (6 / s) * w).sum()
        weight += w.sum()
    return float(total / weight) if weight > 0 else np.nan


def correlation_spectrum(rows: np.ndarray) -> dict[str, object]:
    """Eigenvalues (falling) of the correlation of complete rows, share above the Marchenko-Pastur edge, participation of the first."""
    z = rows - rows.mean(0)
    sd = z.std(0)
    keep = sd > 0
    z = z[:, keep] / sd[keep]
    if z.shape[0] < 2 or z.shape[1] < 2:
        return {"values": [], "edge": np.nan, "above": 0, "ipr": np.nan}
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    edge = (1 + math.sqrt(z.shape[1] / len(z))) ** 2
    return {"values": values[::-1].tolist(), "edge": edge, "above": int((values > edge).sum()), "ipr": float((vectors[:, -1] ** 4).sum())}


def effective_number(rows: np.ndarray) -> float:
    """(sum of eigenvalues)^2 / sum of squares of the Ledoit-Wolf shrunk correlation."""
    z = rows - rows.mean(0)
    z = z / np.maximum(z.std(0), 1e-300)
    n, p = z.shape
    c = z.T @ z / n
    mean = np.trace(c) / p
    d2 = ((c - mean * np.eye(p)) ** 2).sum()
    b2 = min(sum(((np.outer(r, r) - c) ** 2).sum() for r in z) / n**2, d2)
    shrunk = c if d2 == 0 else b2 / d2 * mean * np.eye(p) + (1 - b2 / d2) * c
    lam = np.linalg.eigvalsh(shrunk)
    return float(lam.sum() ** 2 / (lam**2).sum())


def phase_surrogate(x: np.ndarray, rng: np.random.Generator, rounds: int = 50) -> np.ndarray:
    """Iterative amplitude-adjusted surrogate: the spectrum of ``x`` and exactly its values."""
    amplitude, sortedx = np.abs(np.fft.rfft(x)), np.sort(x)
    y = rng.permutation(x)
    before = None
    for _ in range(rounds):
        f = np.fft.rfft(y)
        y = np.fft.irfft(amplitude * np.exp(1j * np.angle(f)), len(x))
        ranks = np.argsort(np.argsort(y, kind="stable"), kind="stable")
        y = sortedx[ranks]
        if before is not None and (ranks == before).all():
            break
        before = ranks
    return y


# -- tails, fits ----------------------------------------------------------------------------
def gpd_moments(excess: np.ndarray) -> tuple[float, float]:
    """Generalised Pareto shape and scale by probability-weighted moments."""
    x = np.sort(excess)
    n = len(x)
    a0, a1 = x.mean(), (x * (n - np.arange(1, n + 1)) / max(n - 1, 1)).mean()
    if n < 2 or a0 == 2 * a1:
        return np.nan, np.nan
    return -(a0 / (a0 - 2 * a1) - 2), 2 * a0 * a1 / (a0 - 2 * a1)


def minimise(f, start: np.ndarray, rounds: int = 300, step: float = 0.2) -> np.ndarray:
    """Nelder-Mead downhill simplex."""
    n = len(start)
    s = [np.array(start, float)] + [np.array(start, float) + step * (np.eye(n)[i] * (abs(start[i]) + 0.5)) for i in range(n)]
    v = [f(p) for p in s]
    for _ in range(rounds):
        order = np.argsort(v)
        s, v = [s[i] for i in order], [v[i] for i in order]
        if abs(v[-1] - v[0]) < 1e-10 * (abs(v[0]) + 1e-10):
            break
        mid = np.mean(s[:-1], axis=0)
        r = 2 * mid - s[-1]
        fr = f(r)
        if fr < v[0]:
            e = 3 * mid - 2 * s[-1]
            fe = f(e)
            s[-1], v[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < v[-2]:
            s[-1], v[-1] = r, fr
        else:
            c = (mid + (r if fr < v[-1] else s[-1])) / 2
            fc = f(c)
            if fc < min(fr, v[-1]):
                s[-1], v[-1] = c, fc
            else:
                s = [s[0]] + [(s[0] + p) / 2 for p in s[1:]]
                v = [v[0]] + [f(p) for p in s[1:]]
    return s[int(np.argmin(v))]


def gpd_likelihood(excess: np.ndarray) -> tuple[float, float]:
    """Generalised Pareto shape and scale by maximum likelihood."""
    xi, beta = gpd_moments(excess)
    if not np.isfinite(xi) or beta <= 0:
        return np.nan, np.nan

    def cost(p):
        shape, scale = p[0], math.exp(min(p[1], 50))
        z = 1 + shape * excess / scale
        if (z <= 0).any():
            return 1e300
        return len(excess) * math.log(scale) + ((1 + 1 / shape) * np.log(z).sum() if abs(shape) > 1e-9 else excess.sum() / scale)

    best = minimise(cost, np.array([xi, math.log(beta)]))
    return float(best[0]), float(math.exp(best[1]))


def hawkes(times: np.ndarray) -> tuple[float, float, float]:
    """Base rate, branching ratio and decay of a self-exciting process, by maximum likelihood with exponential kernel.

    Events of one time are separate events that do not excite each other (the intensity sums over
    earlier times only); else a decay without bound would be the likeliest. NaN for fewer than
    three events or a single time.
    """
    if len(times) < 3 or times[-1] <= times[0]:
        return np.nan, np.nan, np.nan
    t, size = np.unique(times - times[0], return_counts=True)
    span, rate = t[-1], len(times) / t[-1]
    step, count = np.diff(t), size.tolist()

    def values(p):
        mu, n, b = np.clip(p, -50, 50)
        return math.exp(mu), 1 / (1 + math.exp(-n)), math.exp(b)

    def cost(p):
        mu, n, b = values(p)
        a, before = 0.0, [0.0]
        for c, left in zip(count, np.exp(-b * step).tolist()):
            a = (a + c) * left
            before.append(a)
        return mu * span + n * (size * (1 - np.exp(-b * (span - t)))).sum() - (size * np.log(mu + n * b * np.array(before))).sum()

    return values(minimise(cost, np.array([math.log(rate / 2), 0.0, math.log(rate)]), 400))


def omori(times: np.ndarray) -> tuple[float, float, float]:
    """K, c and p of the aftershock rate K / (t + c)^p, by maximum likelihood."""
    t = np.sort(times[times > 0])
    if len(t) < 5:
        return np.nan, np.nan, np.nan
    end = t[-1]

    def mass(c, p):
        return math.log((end + c) / c) if abs(p - 1) < 1e-6 else ((end + c) ** (1 - p) - c ** (1 - p)) / (1 - p)

    def cost(q):
        c, p = math.exp(np.clip(q[0], -20, 20)), math.exp(np.clip(q[1], -3, 2))
        m = mass(c, p)
        return 1e300 if m <= 0 else p * np.log(t + c).sum() + len(t) * math.log(m)

    q = minimise(cost, np.array([math.log(np.median(t)), 0.0]))
    c, p = math.exp(np.clip(q[0], -20, 20)), math.exp(np.clip(q[1], -3, 2))
    return len(t) / mass(c, p), c, p


def sir_rates(s: np.ndarray, i: np.ndarray) -> tuple[float, float]:
    """Infection and recovery rate from the changes of the infected; (0.001, 0.1) where they can't be told."""
    rows = i[:-1] > 0
    if rows.sum() >= 5:
        x = np.stack([(s * i)[:-1], i[:-1]], axis=1)[rows]
        b, *_ = np.linalg.lstsq(x, np.diff(i)[rows], rcond=None)
        if b[0] > 0 and b[1] < 0:
            return float(b[0]), float(-b[1])
    return 0.001, 0.1


def bunching(share: np.ndarray, low: float = 0.4, high: float = 1.3, bins: int = 90, degree: int = 7) -> float:
    """Excess mass at 1 against a polynomial through the bins outside [0.9, 1.1), over the mean counterfactual there."""
    width = (high - low) / bins
    k = np.floor((share - low) / width + 1e-9).astype(int)
    n = np.bincount(k[(k >= 0) & (k < bins)], minlength=bins).astype(float)
    mid = low + (np.arange(bins) + 0.5) * width
    inside = (mid >= 0.9) & (mid < 1.1)
    fit = np.polynomial.Polynomial.fit(mid[~inside], n[~inside], degree)
    cf = np.maximum(fit(mid[inside]), 0)
    return float((n[inside].sum() - cf.sum()) / cf.mean()) if cf.mean() > 0 else np.nan


def svi_variance(p, k):
    """Raw SVI total variance a + b (rho (k - m) + sqrt((k - m)^2 + s^2))."""
    a, b, rho, m, s = p
    return a + b * (rho * (k - m) + np.sqrt((k - m) ** 2 + s * s))


def svi_fit(k: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Least-squares raw SVI smile."""
    def free(q):
        return np.array([q[0], math.exp(np.clip(q[1], -20, 5)), math.tanh(q[2]), q[3], math.exp(np.clip(q[4], -20, 5))])

    q = minimise(lambda q: float(((svi_variance(free(q), k) - w) ** 2).sum()), np.array([w.min() * 0.5, math.log(max(w.std(), 1e-4)), -0.3, 0.0, math.log(0.1)]), 800)
    return free(q)


def sax(x: np.ndarray, parts: int, letters: int) -> str:
    """Piecewise means, standardised, as letters between Gaussian breakpoints."""
    cut = np.round(np.arange(parts + 1) * len(x) / parts).astype(int)
    paa = np.array([x[a:b].mean() for a, b in zip(cut[:-1], cut[1:], strict=True)])
    sd = paa.std()
    if sd == 0:
        return chr(97 + letters // 2) * parts
    edges = [normal_quantile(j / letters) for j in range(1, letters)]
    return "".join(chr(97 + int(np.searchsorted(edges, v, side="right"))) for v in (paa - paa.mean()) / sd)


def local_alignment(a: str, b: str, match: float = 2.0, miss: float = -1.0, gap: float = -1.0) -> float:
    """Best local alignment score of two words."""
    row, best = np.zeros(len(b) + 1), 0.0
    for x in a:
        new = np.zeros(len(b) + 1)
        for j, y in enumerate(b, 1):
            new[j] = max(0.0, row[j - 1] + (match if x == y else miss), row[j] + gap, new[j - 1] + gap)
        row, best = new, max(best, new.max())
    return float(best)


# -- forecasts ------------------------------------------------------------------------------
def har_forecast(rv: np.ndarray, embargo: int = 1, least: int = 30) -> np.ndarray:
    """Next day's log variance from the day's, the week's and the month's, refitted each day on what was known."""
    lv = np.log(np.maximum(rv, 1e-300))
    mean = lambda w: np.convolve(lv, np.ones(w) / w, "full")[: len(lv)]
    x = np.stack([np.ones(len(lv)), lv, mean(5), mean(22)], axis=1)
    out = np.full(len(lv), np.nan)
    for t in range(21 + least + embargo, len(lv)):
        rows = np.arange(21, t - embargo)
        b, *_ = np.linalg.lstsq(x[rows], lv[rows + 1], rcond=None)
        out[t] = x[t] @ b
    return out


def analog_forecast(features: np.ndarray, target: np.ndarray, k: int = 10, embargo: int = 5) -> np.ndarray:
    """The targets of the ``k`` nearest earlier rows (standardised distance), [row, k]; NaN where fewer are known."""
    n = len(features)
    out = np.full((n, k), np.nan)
    for t in range(n):
        lib = features[: max(t - embargo, 0)]
        ok = np.flatnonzero(np.isfinite(lib).all(1) & np.isfinite(target[: len(lib)])) if len(lib) else []
        if len(ok) >= k and np.isfinite(features[t]).all():
            sd = lib[ok].std(0)
            d = (((lib[ok] - features[t]) / np.where(sd > 0, sd, 1)) ** 2).sum(1)
            out[t] = target[ok[np.argsort(d, kind="stable")[:k]]]
    return out


def crps(sample: np.ndarray, value: float) -> float:
    """Continuous ranked probability score of a sample."""
    return float(np.abs(sample - value).mean() - 0.5 * np.abs(sample[:, None] - sample[None]).mean())


def markov_cross_entropy(train: np.ndarray, test: np.ndarray, letters: int, alpha: float = 0.5, order: int = 1) -> float:
    """Mean negative log probability of ``test`` under a chain that looks ``order`` letters back, with additive smoothing."""

    def pairs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x) - order
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        context = np.zeros(n, dtype=np.int64)
        for k in range(order):
            context = context * letters + x[k : k + n]
        return context, np.asarray(x[order:], dtype=np.int64)

    (c0, n0), (c1, n1) = pairs(train), pairs(test)
    if not len(n1):
        return np.nan
    contexts = letters**order
    both = np.bincount(c0 * letters + n0, minlength=contexts * letters).reshape(contexts, letters)
    p = np.log((both + alpha) / (both.sum(1, keepdims=True) + alpha * letters))
    return float(-p[c1, n1].mean())


def risk_neutral_density(params: np.ndarray, strikes: np.ndarray) -> np.ndarray:
    """Density of the log of price over forward implied by an SVI smile, from its total variance and derivatives in log strike."""
    k, h = np.asarray(strikes, float), 1e-4
    w = svi_variance(params, k)
    up, down = svi_variance(params, k + h), svi_variance(params, k - h)
    d1, d2 = (up - down) / (2 * h), (up - 2 * w + down) / h**2
    g = (1 - k * d1 / (2 * w)) ** 2 - d1**2 / 4 * (1 / w + 0.25) + d2 / 2
    return g / np.sqrt(2 * np.pi * w) * np.exp(-((-k / np.sqrt(w) - np.sqrt(w) / 2) ** 2) / 2)


# -- sequential rules -----------------------------------------------------------------------
def thinned(when: np.ndarray, gap: float) -> np.ndarray:
    """Mask of events kept greedily at least ``gap`` after the last kept one."""
    keep, last = np.zeros(len(when), dtype=bool), -np.inf
    for i, t in enumerate(when):
        if t - last >= gap:
            keep[i], last = True, t
    return keep


def causal_mad(r: np.ndarray, window: int = 60, least: int = 20) -> np.ndarray:
    """1.4826 times the median absolute deviation of up to ``window`` earlier defined values."""
    out = np.full(len(r), np.nan)
    for i in range(len(r)):
        x = r[max(i - window, 0) : i]
        x = x[np.isfinite(x)]
        if len(x) >= least:
            out[i] = 1.4826 * np.median(np.abs(x - np.median(x)))
    return out
