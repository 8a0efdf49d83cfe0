"""NumPy helpers for Arrow batches: the leading axis is always the window (or chunk).

Spark decides which windows exist, ships them in batches and aggregates the answers;
these helpers only turn a matrix of windows into a matrix of results, looping over time
steps, never over rows of the table.
"""

from __future__ import annotations

from functools import lru_cache

from functools import lru_cache

import numpy as np


# ---------------------------------------------------------------- linear filters
@lru_cache(maxsize=64)
def butterworth(order: int, low: float | None, high: float, fs: float):
    """Digital Butterworth (b, a) by pre-warped bilinear transform; band-pass when ``low`` is given."""
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if low is None:
        p, zeros, gain = poles * warp(high), np.zeros(0), warp(high) ** order
    else:
        w1, w2 = warp(low), warp(high)
        half, centre = poles * (w2 - w1) / 2, w1 * w2
        root = np.sqrt(half * half - centre)
        p, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order), (w2 - w1) ** order
    pd = (2 * fs + p) / (2 * fs - p)
    zd = np.concatenate([(2 * fs + zeros) / (2 * fs - zeros), -np.ones(len(p) - len(zeros))])
    k = gain * np.real(np.prod(2 * fs - zeros) / np.prod(2 * fs - p))
    return np.real(k * np.poly(zd)), np.real(np.poly(pd))


def _run_filter(b, a, x, start):
    """Direct form II transposed over the first (time) axis of ``x``; ``start`` scales the steady state."""
    n = len(a) - 1
    # steady-state response to a unit step, so that a constant input starts without transient
    companion = np.zeros((n, n))
    companion[0, :] = -a[1:]
    companion[1:, :-1] = np.eye(n - 1)
    unit = np.linalg.solve(np.eye(n) - companion.T, b[1:] - a[1:] * b[0])
    z = unit[:, None] * start[None, :]
    y = np.empty_like(x)
    bb, aa = b[1:, None], a[1:, None]
    for t in range(len(x)):
        y[t] = b[0] * x[t] + z[0]
        z[:-1] = z[1:]
        z[-1] = 0.0
        z += bb * x[t] - aa * y[t]
    return y


def _stack_ragged(rows) -> np.ndarray:
    out = np.zeros((max(len(r) for r in rows), len(rows)))
    for i, r in enumerate(rows):
        out[: len(r), i] = r
    return out


def zero_phase_rows(rows: list, b, a) -> list:
    """Forward-backward filter of signals of any lengths in one time loop.

    Each signal is extended by odd reflection of 3 * filter length. The recursion is causal, so
    zeros behind a shorter signal cannot reach it; for the backward run every signal is
    reversed to start at step 0 again. Too short signals only lose their mean.
    """
    pad = 3 * max(len(a), len(b))
    out = [r - r.mean() if len(r) else r for r in rows]
    long = [i for i, r in enumerate(rows) if len(r) > pad]
    if not long:
        return out
    ext = [np.concatenate([2 * rows[i][0] - rows[i][pad:0:-1], rows[i], 2 * rows[i][-1] - rows[i][-2:-pad - 2:-1]]) for i in long]
    x = _stack_ragged(ext)
    fwd = _run_filter(b, a, x, x[0])
    x = _stack_ragged([fwd[: len(e), k][::-1] for k, e in enumerate(ext)])
    back = _run_filter(b, a, x, x[0])
    for k, i in enumerate(long):
        n = len(rows[i]) + 2 * pad
        out[i] = back[:n, k][::-1][pad:n - pad]
    return out


def zero_phase(x: np.ndarray, b, a) -> np.ndarray:
    return np.stack(zero_phase_rows(list(x), b, a))


@lru_cache(maxsize=16)
def resample_taps(up: int, down: int) -> np.ndarray:
    """Low-pass FIR for rational resampling: Kaiser (beta 5), ten periods of the slower rate each side."""
    top = max(up, down)
    half = 10 * top
    n = np.arange(-half, half + 1)
    h = np.sinc(n / top) / top * np.kaiser(2 * half + 1, 5.0)
    return h / h.sum() * up


# ---------------------------------------------------------------- spectra
def spectrum(x: np.ndarray, nfft: int = 8192) -> np.ndarray:
    """One-sided amplitude of the zero-padded signal, non-DC bins doubled."""
    amp = np.abs(np.fft.rfft(x, nfft, axis=1))[:, : nfft // 2] / x.shape[1]
    amp[:, 1:] *= 2.0
    return amp


def peak_mask(amp: np.ndarray, fs: float, percent: float, nfft: int = 8192, low_hz: float = 0.7, high_hz: float = 4.0) -> np.ndarray:
    """Local maxima inside the band (edges in 1-based bins, open) above ``percent`` of the band's best."""
    mid = amp[:, 1:-1]
    top = np.zeros(amp.shape, bool)
    top[:, 1:-1] = (mid > amp[:, :-2]) & (mid > amp[:, 2:])
    one_based = np.arange(amp.shape[1]) + 1
    top &= (one_based > low_hz * nfft / fs + 1) & (one_based < high_hz * nfft / fs)
    best = np.where(top, amp, 0.0).max(axis=1, keepdims=True)
    return top & (amp > best * percent)


def ranked_peaks(x, penalty, fs, percent=0.3, weight=0.2, width=0.2, nfft=8192):
    """Per row the peak frequencies by penalised amplitude, descending; ``penalty`` may be None."""
    amp = spectrum(x, nfft)
    keep = peak_mask(amp, fs, percent, nfft)
    freq = fs * np.arange(amp.shape[1]) / nfft
    score = amp.copy()
    if penalty is not None:
        ref = spectrum(penalty, nfft)
        ref_keep = peak_mask(ref, fs, percent, nfft)
        has = ref_keep.any(axis=1)
        motion = freq[np.where(ref_keep, ref, -1.0).argmax(axis=1)]
        near = (np.abs(freq - motion[:, None]) < width) | (np.abs(freq - 2 * motion[:, None]) < width)
        score[near & has[:, None]] *= weight
    out = []
    for s, k in zip(score, keep):
        at = np.flatnonzero(k)
        out.append(freq[at[np.argsort(-s[at], kind="stable")]])
    return out


def low_band_ratio(x, fs, nfft=1024):
    """Energy in 0-1 Hz over 1-3 Hz of the standardised signal."""
    amp = spectrum(zscore(x), nfft)
    lo, hi = int(nfft / fs), int(3 * nfft / fs)
    a, b = (amp[:, :lo] ** 2).sum(axis=1), (amp[:, lo:hi] ** 2).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return a / b


def welch_features(x, fs):
    """dominant non-DC frequency, spectral entropy, spectral flatness of the mean periodogram."""
    n = min(x.shape[1], 256)
    hop = n - n // 2
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    starts = range(0, x.shape[1] - n + 1, hop)
    psd = 0.0
    for s in starts:
        seg = x[:, s:s + n]
        psd = psd + np.abs(np.fft.rfft((seg - seg.mean(axis=1, keepdims=True)) * win, axis=1)) ** 2
    psd = psd / (len(starts) * fs * (win ** 2).sum())
    psd[:, 1:(-1 if n % 2 == 0 else None)] *= 2
    freq = np.fft.rfftfreq(n, 1 / fs)
    total = psd.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = psd / total[:, None]
        entropy = -np.where(p > 0, p * np.log(p), 0.0).sum(axis=1)
        pos = psd > 0
        cnt = pos.sum(axis=1)
        flat = np.exp(np.where(pos, np.log(psd), 0.0).sum(axis=1) / cnt) / (psd.sum(axis=1) / cnt)
    dom = np.where(psd[:, 1:].max(axis=1) > 0, freq[1:][psd[:, 1:].argmax(axis=1)], 0.0)
    dead = total == 0
    return np.where(dead, 0.0, dom), np.where(dead, 0.0, entropy), np.where(dead, 0.0, np.nan_to_num(flat))


# ---------------------------------------------------------------- lag correlation
def _window_sums(v, n):
    total = np.pad(np.cumsum(v, axis=1), ((0, 0), (1, 0)))
    return total[:, n:] - total[:, :-n]


def lag_correlation(x: np.ndarray, padded: np.ndarray, partial: bool = False) -> np.ndarray:
    """Pearson of each window with every shift of its padded reference.

    A shift that meets NaN padding is 0, or with ``partial`` taken over the overlap (4 samples at least).
    """
    n = x.shape[1]
    view = np.lib.stride_tricks.sliding_window_view(padded, n, axis=1)
    if partial and np.isnan(padded).any():
        ok = ~np.isnan(view)
        cnt = ok.sum(axis=2, keepdims=True).clip(1)
        xs = np.where(ok, x[:, None, :], 0.0)
        ys = np.where(ok, view, 0.0)
        xc = np.where(ok, xs - xs.sum(axis=2, keepdims=True) / cnt, 0.0)
        yc = np.where(ok, ys - ys.sum(axis=2, keepdims=True) / cnt, 0.0)
        den = np.sqrt((xc * xc).sum(axis=2) * (yc * yc).sum(axis=2))
        with np.errstate(divide="ignore", invalid="ignore"):
            c = (xc * yc).sum(axis=2) / den
        return np.where(np.isfinite(c) & (den > 0) & (cnt[:, :, 0] >= 4), c, 0.0)
    # sums over sliding windows instead of centred copies of every shift
    gap = np.isnan(padded)
    level = np.nanmean(padded, axis=1, keepdims=True)
    y = np.where(gap, 0.0, padded - level)
    slide = lambda v: _window_sums(v, n)
    xc = x - x.mean(axis=1, keepdims=True)
    num = np.einsum("bn,bln->bl", xc, np.lib.stride_tricks.sliding_window_view(y, n, axis=1))
    var = slide(y * y) - slide(y) ** 2 / n
    floor = n * (1e-12 * np.nanmax(np.abs(padded), axis=1, keepdims=True)) ** 2
    ok = (slide(gap.astype(float)) == 0) & (var > floor)
    den = np.sqrt((xc * xc).sum(axis=1)[:, None] * np.where(ok, var, 1.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        c = num / den
    return np.where(ok & np.isfinite(c) & (den > 0), c, 0.0)


# ---------------------------------------------------------------- adaptive filters
def zscore(x: np.ndarray) -> np.ndarray:
    c = x - x.mean(axis=1, keepdims=True)
    sd = x.std(axis=1, ddof=1, keepdims=True)
    return np.where((sd > 1e-12) & np.isfinite(sd), c / np.where(sd > 1e-12, sd, 1.0), c)


def _taps(u, m, k):
    """taps[b, t] = u[b, t + k], ..., u[b, t - m + 1] for every t with a full tap vector (t >= m - 1)."""
    return np.lib.stride_tricks.sliding_window_view(u, m + k, axis=1)[:, :, ::-1]


def lms(u, d, m, k, mu):
    """Linear LMS on standardised signals from zero weights; output is k samples shorter than ``u``."""
    u, d = zscore(u), zscore(d)
    e = np.zeros((u.shape[0], max(u.shape[1] - k, 0)))
    if u.shape[1] < m + k:
        return e
    x, w = _taps(u, m, k), np.zeros((u.shape[0], m + k))
    gain = 2.0 * mu[:, None]
    for i in range(x.shape[1]):
        xi = x[:, i]
        err = d[:, i + m - 1] - (w * xi).sum(axis=1)
        e[:, i + m - 1] = err
        w += gain * xi * err[:, None]
    return e


def kernel_lms(u, d, m, k, mu, sigma=1.0, epsilon=0.1):
    """Gaussian-kernel LMS with a quantised dictionary (squared distance against ``epsilon``)."""
    u, d = zscore(u), zscore(d)
    e = np.zeros(u.shape)
    if u.shape[1] < m + k:
        return e
    x = _taps(u, m, k)
    steps = x.shape[1]
    rows = np.arange(len(u))
    centres = np.zeros((len(u), steps, m + k))
    weight = np.zeros((len(u), steps))
    used = np.zeros(len(u), int)
    for i in range(steps):
        top = max(int(used.max()), 1)
        dist = ((centres[:, :top] - x[:, i:i + 1]) ** 2).sum(axis=2)
        dist[np.arange(top)[None, :] >= used[:, None]] = np.inf
        kern = np.exp(-dist / (2 * sigma ** 2)) if sigma > 0 else (dist == 0).astype(float)
        err = d[:, i + m - 1] - (weight[:, :top] * kern).sum(axis=1)
        e[:, i + m - 1] = err
        near = dist.argmin(axis=1)
        merge = dist[rows, near] <= epsilon
        at = np.where(merge, near, used)
        weight[rows, at] += mu * err
        new = ~merge
        centres[rows[new], used[new]] = x[new, i]
        used = used + new
    return e


def volterra_lms(u, d, m, m2, k, mu):
    """Linear taps plus the distinct products of ``m2`` quadratic taps; ``m2`` = 0 is plain LMS."""
    out = np.zeros(u.shape)
    if m2 == 0:
        e = lms(u, d, m, k, mu)
        out[:, : e.shape[1]] = e
        return out
    u, d = zscore(u), zscore(d)
    first, l2 = max(m, m2), m2 + k
    if u.shape[1] < first + k:
        return out
    lin, quad = _taps(u, m, k)[:, first - m:], _taps(u, m2, k)[:, first - m2:]
    i1, i2 = np.tril_indices(l2)
    w = np.zeros((u.shape[0], m + k + len(i1)))
    gain = 2.0 * mu[:, None]
    for i in range(lin.shape[1]):
        q = quad[:, i]
        xi = np.concatenate([lin[:, i], q[:, i1] * q[:, i2]], axis=1)
        err = d[:, i + first - 1] - (w * xi).sum(axis=1)
        out[:, i + first - 1] = err
        w += gain * xi * err[:, None]
    return out


def _forward_span(u, d, m, k):
    n = min(u.shape[1], d.shape[1])
    u, d = zscore(u)[:, :n], zscore(d)[:, :n]
    first = max(k, m - 1)
    x = _taps(u, m, k)[:, first - (m - 1):] if n >= m + k else np.zeros((len(u), 0, m + k))
    return d, first, x


def noncausal_lms(u, d, m, k, mu):
    """Normalised LMS with ``k`` forward taps; keeps the length."""
    d, first, x = _forward_span(u, d, m, k)
    out, w = d.copy(), np.zeros((len(d), m + k))
    step = np.maximum(mu, 1e-12)
    for i in range(x.shape[1]):
        xi = x[:, i]
        err = d[:, first + i] - (w * xi).sum(axis=1)
        out[:, first + i] = err
        w += (step * err / ((xi * xi).sum(axis=1) + 1e-9))[:, None] * xi
    return np.nan_to_num(out, nan=0.0, posinf=0.0, neginf=0.0)


# The draws of random Fourier features as published (Rahimi and Recht, 2007): directions from a normal
# distribution of standard deviation 1 / sigma, phases uniform over a full turn, in this order from one generator.
@lru_cache(maxsize=64)
def fourier_features(size: int, span: int, sigma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, span) directions and (size,) phases."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, 1.0 / sigma, (size, span)), rng.uniform(0.0, 2.0 * np.pi, size)


def fourier_lms(u, d, m, k, mu, size=100, sigma=1.0, seed=42):
    """LMS on cosine features of the tap vector (``fourier_features``); keeps the length."""
    d, first, x = _forward_span(u, d, m, k)
    directions, phases = fourier_features(size, m + k, sigma, seed)
    out, theta = d.copy(), np.zeros((len(d), size))
    scale = np.sqrt(2.0 / size)
    for i in range(x.shape[1]):
        z = scale * np.cos(x[:, i] @ directions.T + phases)
        err = d[:, first + i] - (theta * z).sum(axis=1)
        out[:, first + i] = err
        theta += mu[:, None] * err[:, None] * z
    return np.nan_to_num(out, nan=0.0, posinf=0.0, neginf=0.0)


def amplitude_preserving(d, u, order, mu):
    """Normalised LMS around the median, keeping level and amplitude of ``d``; ``order`` per row.

    Rows with different orders share one loop: taps beyond a row's order are masked and its
    updates start when its tap vector is full. Order 0 leaves a row unchanged.
    """
    base = np.median(d, axis=1, keepdims=True)
    centred = d - base
    uc = u - u.mean(axis=1, keepdims=True)
    sd = uc.std(axis=1, ddof=1, keepdims=True)
    live = (sd[:, 0] > 1e-12) & np.isfinite(sd[:, 0]) & (order > 0) & (d.shape[1] >= order + 1)
    top = max(int(order.max()), 1)
    norm = np.pad(uc / np.where(sd > 1e-12, sd, 1.0), ((0, 0), (top - 1, 0)))
    mask = np.arange(top)[None, :] < order[:, None]
    x = _taps(norm, top, 0)
    out, w = centred.copy(), np.zeros((len(d), top))
    for i in range(d.shape[1]):
        on = i >= order - 1
        xi = x[:, i] * mask
        err = np.where(on, centred[:, i] - (w * xi).sum(axis=1), 0.0)
        out[:, i] = np.where(on, err, out[:, i])
        w += (2 * mu * err / (1e-9 + (xi * xi).sum(axis=1)))[:, None] * xi
    clean = out + base
    clean += np.median(d, axis=1, keepdims=True) - np.median(clean, axis=1, keepdims=True)
    return np.where(live[:, None], clean, d)


def band_candidates(amp, step, motion, low, high, percent, weight, width):
    """Peaks of ready spectra inside (low, high) Hz, penalised around the motion frequency first."""
    freq = step * np.arange(amp.shape[1])
    near = (np.abs(freq - motion[:, None]) < width) | (np.abs(freq - 2 * motion[:, None]) < width)
    amp = np.where(near, amp * weight, amp)
    band = np.flatnonzero((freq > low) & (freq < high))
    a = amp[:, band]
    top = np.zeros(a.shape, bool)
    top[:, 1:-1] = (a[:, 1:-1] > a[:, :-2]) & (a[:, 1:-1] > a[:, 2:])
    top &= a > np.where(top, a, 0.0).max(axis=1, keepdims=True) * percent
    return [freq[band[k]][np.argsort(-v[k], kind="stable")] for v, k in zip(a, top)]


# ---------------------------------------------------------------- beats
def local_maxima(x: np.ndarray, distance: int) -> np.ndarray:
    """Peaks of one short window at least ``distance`` apart, higher ones first; plateaus at their middle."""
    edge = np.flatnonzero(np.diff(x) != 0)
    left, right = np.r_[0, edge + 1], np.r_[edge, len(x) - 1]
    lvl = x[left]
    top = np.flatnonzero((lvl[1:-1] > lvl[:-2]) & (lvl[1:-1] > lvl[2:])) + 1 if len(lvl) > 2 else np.zeros(0, int)
    at = (left[top] + right[top]) // 2
    keep = np.ones(len(at), bool)
    for i in np.argsort(x[at], kind="stable")[::-1]:
        if keep[i]:
            near = np.abs(at - at[i]) < distance
            near[i] = False
            keep &= ~near
    return at[keep]
