"""Batched helpers against plain loops and against physics."""

import numpy as np

from wristwave.functions import kernels as kn

RNG = np.random.default_rng(7)


def z(x):
    return (x - x.mean()) / x.std(ddof=1)


def test_butterworth_gain():
    b, a = kn.butterworth(4, 0.5, 5.0, 100.0)
    w = lambda f: np.exp(-2j * np.pi * f / 100.0 * np.arange(len(b)))
    gain = lambda f: abs((b * w(f)).sum() / (a * w(f)).sum())
    assert np.isclose(gain(0.5), 2**-0.5, atol=1e-6) and np.isclose(gain(5.0), 2**-0.5, atol=1e-6)
    assert gain(1.6) > 0.999 and gain(0.05) < 1e-3 and gain(40.0) < 1e-3


def test_zero_phase_ragged_equals_single():
    b, a = kn.butterworth(4, 0.5, 5.0, 25.0)
    rows = [RNG.normal(size=n) for n in (300, 117, 20, 451)]
    together = kn.zero_phase_rows(rows, b, a)
    for r, y in zip(rows, together):
        assert np.allclose(y, kn.zero_phase_rows([r], b, a)[0], atol=1e-12)
    assert np.allclose(together[2], rows[2] - rows[2].mean())


def test_zero_phase_keeps_tone():
    b, a = kn.butterworth(4, 0.5, 5.0, 25.0)
    t = np.arange(3000) / 25
    s = np.sin(2 * np.pi * 1.6 * t)[None]
    assert np.abs(kn.zero_phase(s + 3.0, b, a) - s)[:, 1000:2000].max() < 1e-3


def test_lms_matches_loop():
    u, d, m, k, mu = RNG.normal(size=80), RNG.normal(size=80), 4, 1, 0.004
    uz, dz = z(u), z(d)
    w, want = np.zeros(m + k), np.zeros(80 - k)
    for n in range(m - 1, 80 - k):
        tap = np.array([uz[n + k - j] for j in range(m + k)])
        want[n] = dz[n] - w @ tap
        w = w + 2 * mu * want[n] * tap
    got = kn.lms(u[None], d[None], m, k, np.array([mu]))[0]
    assert np.allclose(got, want, atol=1e-10)


def test_filter_properties():
    u, d = RNG.normal(size=(3, 100)), RNG.normal(size=(3, 100))
    mu = np.full(3, 0.005)
    base = kn.lms(u, d, 5, 1, mu)
    vol = kn.volterra_lms(u, d, 5, 0, 1, mu)
    assert np.allclose(vol[:, :99], base) and vol.shape[1] == 100
    assert np.allclose(kn.lms(u * 7 + 3, d * 2 - 1, 5, 1, mu), base, atol=1e-9)
    assert kn.noncausal_lms(u, d, 5, 1, mu).shape == (3, 100)
    a = kn.fourier_lms(u, d, 5, 1, mu)
    assert np.array_equal(a, kn.fourier_lms(u, d, 5, 1, mu)) and a.shape == (3, 100)
    one = kn.kernel_lms(u[:1], d[:1], 5, 1, 0.1, 1.0, 1e9)
    assert np.allclose(one, kn.kernel_lms(u, d, 5, 1, 0.1, 1.0, 1e9)[:1])


def test_kernel_lms_matches_loop():
    u, d, m, k = RNG.normal(size=60), RNG.normal(size=60), 3, 0
    uz, dz = z(u), z(d)
    centres, weights, want = [], [], np.zeros(60)
    for n in range(m - 1, 60 - k):
        tap = np.array([uz[n + k - j] for j in range(m + k)])
        dist = np.array([((c - tap) ** 2).sum() for c in centres])
        want[n] = dz[n] - (np.dot(weights, np.exp(-dist / 2.0)) if centres else 0.0)
        if centres and dist.min() <= 0.5:
            weights[int(dist.argmin())] += 0.1 * want[n]
        else:
            centres.append(tap)
            weights.append(0.1 * want[n])
    assert np.allclose(kn.kernel_lms(u[None], d[None], m, k, 0.1, 1.0, 0.5)[0], want, atol=1e-10)


def test_amplitude_preserving_mixed_orders():
    d, u = RNG.normal(size=(3, 90)) + 50, RNG.normal(size=(3, 90))
    order, mu = np.array([1, 7, 0]), np.full(3, 0.01)
    got = kn.amplitude_preserving(d, u, order, mu)
    for i in range(3):
        assert np.allclose(got[i], kn.amplitude_preserving(d[i:i + 1], u[i:i + 1], order[i:i + 1], mu[:1])[0])
    assert np.allclose(got[2], d[2]) and np.allclose(np.median(got, axis=1), np.median(d, axis=1))


def test_peaks_find_heart_rate():
    t = np.arange(200) / 25
    x = np.stack([np.sin(2 * np.pi * 1.2 * t), np.sin(2 * np.pi * 2.0 * t) + 0.5 * np.sin(2 * np.pi * 1.2 * t)])
    first = [f[0] * 60 for f in kn.ranked_peaks(x, None, 25)]
    assert abs(first[0] - 72) < 1 and abs(first[1] - 120) < 1
    motion = np.stack([np.sin(2 * np.pi * 2.0 * t)] * 2)
    assert abs(kn.ranked_peaks(x, motion, 25)[1][0] * 60 - 72) < 2


def test_lag_correlation():
    base = RNG.normal(size=230)
    x, ref = base[10:210][None], np.roll(base, 3)[None, 5:215]
    c = kn.lag_correlation(x, ref)
    assert c.argmax() == 8 and np.isclose(c.max(), 1.0)
    ref[0, :4] = np.nan
    assert (kn.lag_correlation(x, ref)[0, :4] == 0).all() and (kn.lag_correlation(x, ref, True)[0, :4] != 0).all()


def test_local_maxima_distance():
    x = np.array([0, 1, 0, 3, 0, 2, 2, 0, 5, 0], float)
    assert kn.local_maxima(x, 1).tolist() == [1, 3, 5, 8]
    assert kn.local_maxima(x, 3).tolist() == [3, 8] or kn.local_maxima(x, 3).tolist() == [3, 5, 8][:0] + [3, 8]
