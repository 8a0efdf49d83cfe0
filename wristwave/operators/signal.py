"""Signal operators: DataFrame in, DataFrame out.

Samples are cut into bounded frames or windows by Spark; Arrow UDFs receive batches of
those arrays, stack equal shapes into matrices and run one NumPy helper per matrix.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wristwave.functions import kernels as kn
from wristwave.functions.scalars import numeric
from wristwave.operators.chunked import CHUNK, chunk_col, with_halo, with_totals
from wristwave.operators.clean import fill_linear_nearest
from wristwave.session import ship

KEYS = ["recording"]
IDX = "sample_idx"
FRAME = 4096


# ---------------------------------------------------------------- batching
#: Rows of a matrix at most; of one with long rows (spectra, all shifts of a reference) at most.
ROWS, WIDE_ROWS = 1024, 256


def _pieces(groups: dict, most: int = ROWS):
    """(shape, rows) with at most ``most`` rows, so that a matrix is bounded whatever a batch holds."""
    for shape, rows in groups.items():
        for at in range(0, len(rows), most):
            yield shape, rows[at : at + most]


def _by_shape(*cols, most: int = ROWS):
    """Row positions grouped by the array lengths of ``cols``, in pieces."""
    groups = defaultdict(list)
    for i, shape in enumerate(zip(*[[-1 if v is None else len(v) for v in c] for c in cols])):
        groups[shape].append(i)
    return _pieces(groups, most)


def _stack(col, rows) -> np.ndarray:
    return np.stack([np.asarray(col.iloc[i], dtype=float) for i in rows])


def _rows_udf(fn):
    """Array column -> array column for helpers that take arrays of different lengths at once."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        out = [None] * len(x)
        for _, rows in _pieces({(): [i for i, v in enumerate(x) if v is not None]}, WIDE_ROWS):
            for i, y in zip(rows, fn([np.asarray(x.iloc[i], dtype=float) for i in rows])):
                out[i] = y
        return pd.Series(out)

    return run


# ---------------------------------------------------------------- frames of samples
def sample_frames(df: DataFrame, cols: list[str], size: int, halo: int, keys=KEYS, order=IDX) -> DataFrame:
    """keys, _chunk, _from (offset of the core), _take (core length) and one array per column."""
    packed = F.struct(F.col(order).alias("_i"), *cols)
    rows = (
        with_halo(df.select(*keys, order, *cols), order, size, halo, halo)
        .groupBy(*keys, "_chunk")
        .agg(F.sort_array(F.collect_list(packed)).alias("_r"), F.count_if("_core").cast("int").alias("_take"))
        .filter("_take > 0")
    )
    first = F.element_at("_r", 1)["_i"]
    return rows.select(
        *keys, "_chunk", "_take", (F.col("_chunk") * size - first).cast("int").alias("_from"),
        *[F.col("_r")[c].alias(c) for c in cols],
    )


def _unframe(fr: DataFrame, cols: list[str], size: int, keys, order) -> DataFrame:
    core = [F.slice(c, F.col("_from") + 1, F.col("_take")).alias(c) for c in cols]
    cut = fr.select(*keys, "_chunk", *core).select(*keys, "_chunk", F.posexplode(F.arrays_zip(*cols)).alias("_p", "_v"))
    return cut.select(*keys, (F.col("_chunk") * size + F.col("_p")).alias(order), *[F.col("_v")[c].alias(c) for c in cols])


def band_pass(
    df: DataFrame, cols: list[str], fs: float, low: float | None = 0.5, high: float = 5.0, filter_order: int = 4,
    halo_s: float = 40.0, keys=KEYS, order=IDX,
) -> DataFrame:
    """G1: zero-phase Butterworth per recording and channel.

    Long recordings run in frames with ``halo_s`` seconds on both sides, beyond which the
    impulse response is below double precision's interest; only true ends see the
    reflection padding. Too short recordings fall back to mean removal.
    """
    b, a = kn.butterworth(filter_order, low, high, float(fs))
    size = max(FRAME, int(8 * halo_s * fs))
    run = _rows_udf(lambda rows: kn.zero_phase_rows(rows, b, a))
    fr = sample_frames(df, cols, size, int(halo_s * fs), keys, order)
    return _unframe(fr.withColumns({c: run(c) for c in cols}), cols, size, keys, order)


def resample(df: DataFrame, cols: list[str], up: int, down: int, keys=KEYS, order=IDX) -> DataFrame:
    """Rational resampling; output sample k sits at input position k * down / up.

    Zero padding outside the recording, like a plain polyphase FIR.
    """
    if up == down:
        return df.select(*keys, order, *cols)
    g = int(np.gcd(up, down))
    up, down = up // g, down // g
    taps = kn.resample_taps(up, down)
    half = (len(taps) - 1) // 2
    reach = half // up + 1
    size = FRAME // down * down  # frame starts fall on output samples
    size = size // np.lcm(up, down) * np.lcm(up, down) if size >= np.lcm(up, down) else int(np.lcm(up, down))
    fr = sample_frames(df, cols, int(size), reach, keys, order)

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, start: pd.Series, take: pd.Series) -> pd.Series:
        out = [None] * len(x)
        groups = defaultdict(list)
        for i, key in enumerate(zip(x.map(len), start, take)):
            groups[key].append(i)
        for (n, s, k), rows in groups.items():
            count = -(-k * up // down)
            pos = s * up + np.arange(count) * down          # positions on the up-sampled axis
            src = np.arange(n) * up
            weight = np.zeros((n, count))
            off = pos[None, :] - src[:, None] + half
            ok = (off >= 0) & (off < len(taps))
            weight[ok] = taps[off[ok]]
            for i, y in zip(rows, _stack(x, rows) @ weight):
                out[i] = y
        return pd.Series(out)

    done = fr.select(*keys, "_chunk", *[run(c, "_from", "_take").alias(c) for c in cols])
    flat = done.select(*keys, "_chunk", F.posexplode(F.arrays_zip(*cols)).alias("_p", "_v"))
    base = F.col("_chunk") * int(size * up // down)
    return flat.select(*keys, (base + F.col("_p")).alias(order), *[F.col("_v")[c].alias(c) for c in cols])


# ---------------------------------------------------------------- per-window columns
def tapered(x: Column | str, n: Column | int) -> Column:
    """Mean removed, symmetric Hamming."""
    x = F.col(x) if isinstance(x, str) else x
    n = F.lit(n) if isinstance(n, int) else n
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    return F.transform(x, lambda v, i: (v - mean) * (F.lit(0.54) - F.lit(0.46) * F.cos(i * (2 * np.pi) / (n - 1))))


def amplitude_spectrum(nfft: int = 8192, bins: int | None = None):
    """G4, or its first ``bins``. A spectrum is longer than its window, so what a batch gives leaves in pieces."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            for at in range(0, len(batch), WIDE_ROWS):
                x = batch.iloc[at : at + WIDE_ROWS]
                out = [None] * len(x)
                for (n,), rows in _by_shape(x):
                    if n > 0:
                        for i, y in zip(rows, kn.spectrum(_stack(x, rows), nfft)[:, :bins]):
                            out[i] = y
                yield pd.Series(out, dtype=object)

    return run


def spectral_peaks(fs: float, percent: float = 0.3, nfft: int = 8192):
    """array<struct<f, a>> in frequency order."""

    @F.pandas_udf("array<struct<f:double,a:double>>")
    def run(x: pd.Series) -> pd.Series:
        out = [[] for _ in range(len(x))]
        freq = fs * np.arange(nfft // 2) / nfft
        for (n,), rows in _by_shape(x, most=WIDE_ROWS):
            if n > 0:
                amp = kn.spectrum(_stack(x, rows), nfft)
                keep = kn.peak_mask(amp, fs, percent, nfft)
                for i, a, k in zip(rows, amp, keep):
                    out[i] = [{"f": float(f), "a": float(v)} for f, v in zip(freq[k], a[k])]
        return pd.Series(out)

    return run


def penalised(peaks: Column, motion_hz: Column, weight: float = 0.2, width: float = 0.2) -> Column:
    """Peaks near the motion frequency or its double are scaled by ``weight``."""
    def one(p):
        near = (F.abs(p["f"] - motion_hz) < width) | (F.abs(p["f"] - motion_hz * 2) < width)
        return F.struct(p["f"].alias("f"), F.when(motion_hz.isNotNull() & near, p["a"] * weight).otherwise(p["a"]).alias("a"))
    return F.transform(peaks, one)


def peak_frequencies(fs: float, weight: float = 0.2, width: float = 0.2, percent: float = 0.3, penalise: bool = True):
    """Signal and motion reference -> candidate frequencies by penalised amplitude (G4-G6, O1 fused)."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, ref: pd.Series) -> pd.Series:
        out = [[] for _ in range(len(x))]
        for (n, m), rows in _by_shape(x, ref, most=WIDE_ROWS):
            if n > 0:
                pen = _stack(ref, rows) if penalise and m > 0 else None
                for i, f in zip(rows, kn.ranked_peaks(_stack(x, rows), pen, fs, percent, weight, width)):
                    out[i] = f
        return pd.Series(out)

    return run


def low_band_ratio(fs: float):
    """G7"""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        for (n,), rows in _by_shape(x):
            out[rows] = kn.low_band_ratio(_stack(x, rows), fs)
        return pd.Series(out)

    return run


def welch_features(fs: float):
    """struct(dominant_freq, spectral_entropy, spectral_flatness)."""

    @F.pandas_udf("dominant_freq double, spectral_entropy double, spectral_flatness double")
    def run(x: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(x), 3))
        for (n,), rows in _by_shape(x):
            if n > 1:
                out[rows] = np.column_stack(kn.welch_features(_stack(x, rows), fs))
        return pd.DataFrame(out, columns=["dominant_freq", "spectral_entropy", "spectral_flatness"])

    return run


def lag_correlation(pad: int, partial: bool = False):
    """G9 for window arrays: window, padded reference, samples really present on its left -> 2 * pad + 1 values.

    Shifts that leave the recording are 0, or use the overlap when ``partial``. NULL windows stay NULL.
    """

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, ref: pd.Series, left: pd.Series) -> pd.Series:
        out = [None] * len(x)
        for (n,), rows in _by_shape(x, most=WIDE_ROWS):
            if n > 0:
                wide = np.full((len(rows), n + 2 * pad), np.nan)
                for j, i in enumerate(rows):
                    at = pad - int(left.iloc[i])
                    wide[j, at:at + len(ref.iloc[i])] = ref.iloc[i]
                for i, c in zip(rows, kn.lag_correlation(_stack(x, rows), wide, partial)):
                    out[i] = c
        return pd.Series(out)

    return run


def _residuals(kinds, d, u, corr, m, k, mu_base: float, options: dict) -> list:
    """One residual a row; rows of the same filter, lengths and taps run as one matrix."""
    out, groups = [None] * len(d), defaultdict(list)
    for i, (name, x, y, mm, kk) in enumerate(zip(kinds, d, u, m, k)):
        if name is not None and x is not None and y is not None:
            groups[(name, len(x), len(y), int(mm), int(kk))].append(i)
    for (name, _, _, mm, kk), rows in _pieces(groups):
        for i, e in zip(rows, _filter(name)(name, _stack(u, rows), _stack(d, rows), mm, kk, mu_base, corr.to_numpy(float)[rows], options)):
            out[i] = e
    return out


def adaptive_filter(kind: str, mu_base: float = 0.01, **options):
    """G12-G16 as a column function: (d, u, corr, m, k) -> array. For SQL see ``register_functions``."""
    _check(options)

    @F.pandas_udf("array<double>")
    def run(d: pd.Series, u: pd.Series, corr: pd.Series, m: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(_residuals([kind] * len(d), d, u, corr, m, k, mu_base, options))

    return run


def filter_by_type(mu_base: float = 0.01, **options):
    """G12-G16 with the filter as data: (filter_type, d, u, corr, m, k) -> array; rows of a batch are grouped by their filter."""
    _check(options)

    @F.pandas_udf("array<double>")
    def run(kind: pd.Series, d: pd.Series, u: pd.Series, corr: pd.Series, m: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(_residuals(kind, d, u, corr, m, k, mu_base, options))

    return run


def _check(options: dict) -> None:
    if options.get("rff_size", 1) < 1 or options.get("rff_sigma", 1.0) <= 0:
        raise ValueError("random features need rff_size of at least 1 and rff_sigma above 0")


def register_functions(spark, fs: float, mu_base: float = 0.01, **options) -> None:
    """Window functions by name for SQL text, for windows of ``fs`` samples a second.

    adaptive_filter(filter_type, d, u, corr, m, k), amplitude_spectrum(x), spectral_peaks(x), ppg_beats(red, ir): arrays
    or structs of arrays, to be unfolded by LATERAL VIEW. A filter added by ``register_filter`` before is known by its name.
    """
    ship(spark)
    for name, fn in {
        "adaptive_filter": filter_by_type(mu_base, **options), "amplitude_spectrum": amplitude_spectrum(), "spectral_peaks": spectral_peaks(fs), "ppg_beats": segment_beats(fs),
    }.items():
        spark.udf.register(name, fn)


def _filter(name: str):
    if name not in _FILTERS:
        raise ValueError(f"no adaptive filter is registered as {name!r}; there are {sorted(_FILTERS)}")
    return _FILTERS[name]


def register_filter(name: str, fn) -> None:
    """Extension point: ``fn(name, u, d, m, k, mu_base, corr, options)`` over matrices (windows first)."""
    _FILTERS[name] = fn


def _step(mu_base, corr):
    return mu_base - corr / 100.0


#: Filters by name; each takes its own step rule and options.
_FILTERS: dict = {
    "klms": lambda _, u, d, m, k, mu, c, o: kn.kernel_lms(u, d, m, k, o.get("klms_step", 0.1), o.get("klms_sigma", 1.0), o.get("klms_epsilon", 0.1)),
    "lms": lambda _, u, d, m, k, mu, c, o: kn.lms(u, d, m, k, _step(mu, c)),
    "noncausal_lms": lambda _, u, d, m, k, mu, c, o: kn.noncausal_lms(u, d, m, k, np.maximum(o.get("mu_min", 1e-6), _step(mu, c))),
    "rff_lms": lambda _, u, d, m, k, mu, c, o: kn.fourier_lms(
        u, d, m, k, np.maximum(o.get("mu_min", 1e-6), _step(mu, c)), o.get("rff_size", 100), o.get("rff_sigma", 1.0), o.get("rff_seed", 42)),
    "volterra": lambda _, u, d, m, k, mu, c, o: kn.volterra_lms(u, d, m, o.get("volterra_order", 3), k, _step(mu, c)),
}


def _cascaded(stage, kind: str, mu_base: float, options: dict, d, refs, corr, k, m):
    """(rows, residuals) of windows after all stages in rank order, in pieces."""
    groups = defaultdict(list)
    for i, (x, kk, mm) in enumerate(zip(d, k, m)):
        if x is not None:
            groups[(len(x), tuple(int(v) for v in kk), int(mm))].append(i)
    for (_, ks, mm), rows in _pieces(groups):
        cur = _stack(d, rows)
        for j, kk in enumerate(ks):
            u = np.stack([np.asarray(refs.iloc[i][j], dtype=float) for i in rows])
            c = np.array([float(corr.iloc[i][j]) for i in rows])
            cur = stage(kind, u[:, : cur.shape[1] + kk], cur, mm, kk, mu_base, c, options)
        yield rows, cur


def cascade(kind: str, mu_base: float = 0.01, **options):
    """(ppg, ranked references, their corr, their k, m) -> residual after all stages in rank order."""
    stage = _filter(kind)

    @F.pandas_udf("array<double>")
    def run(d: pd.Series, refs: pd.Series, corr: pd.Series, k: pd.Series, m: pd.Series) -> pd.Series:
        out = [None] * len(d)
        for rows, residuals in _cascaded(stage, kind, mu_base, options, d, refs, corr, k, m):
            for i, y in zip(rows, residuals):
                out[i] = y
        return pd.Series(out)

    return run


def cascade_peaks(kind: str, fs: float, mu_base: float = 0.01, weight: float = 0.2, width: float = 0.2, percent: float = 0.3, penalise: bool = True, **options):
    """``cascade``, then ``peak_frequencies`` of the residual against the first reference: residuals stay in the worker."""
    stage = _filter(kind)

    @F.pandas_udf("array<double>")
    def run(d: pd.Series, refs: pd.Series, corr: pd.Series, k: pd.Series, m: pd.Series) -> pd.Series:
        out = [[] for _ in range(len(d))]
        for rows, residuals in _cascaded(stage, kind, mu_base, options, d, refs, corr, k, m):
            first = pd.Series([refs.iloc[i][0] if len(refs.iloc[i]) else None for i in rows], dtype=object)
            for (n,), some in _by_shape(first, most=WIDE_ROWS):
                pen = _stack(first, some) if penalise and n > 0 else None
                if residuals.shape[1] > 0:
                    for j, f in zip(some, kn.ranked_peaks(residuals[some], pen, fs, percent, weight, width)):
                        out[rows[j]] = f
        return pd.Series(out)

    return run


def clean_red_ir(mu_base: float = 0.01, mu_min: float = 1e-6):
    """Red and IR through the same ranked stages; (red, ir, refs, corr, orders) -> struct of arrays."""

    @F.pandas_udf("red array<double>, ir array<double>")
    def run(red: pd.Series, ir: pd.Series, refs: pd.Series, corr: pd.Series, orders: pd.Series) -> pd.DataFrame:
        r, q = [None] * len(red), [None] * len(red)
        for (n, m), rows in _by_shape(red, ir):
            if n <= 0:
                continue
            both = np.concatenate([_stack(red, rows), _stack(ir, rows)])
            for j in range(max((len(orders.iloc[i]) for i in rows), default=0)):
                has = [j < len(orders.iloc[i]) for i in rows]
                o = np.array([int(orders.iloc[i][j]) if h else 0 for i, h in zip(rows, has)])
                c = np.array([abs(float(corr.iloc[i][j])) if h else 0.0 for i, h in zip(rows, has)])
                u = np.stack([np.asarray(refs.iloc[i][j], dtype=float) if h else np.zeros(n) for i, h in zip(rows, has)])
                c = np.where(c > 1.0, c / 100.0, c)
                mu = np.maximum(mu_min, mu_base - c / 100.0)
                both = kn.amplitude_preserving(both, np.concatenate([u, u]), np.concatenate([o, o]), np.concatenate([mu, mu]))
            for pos, i in enumerate(rows):
                r[i], q[i] = both[pos], both[len(rows) + pos]
        return pd.DataFrame({"red": r, "ir": q})

    return run


_BEAT_FIELDS = ("beat_idx", "v1_ir", "p_ir", "v2_ir", "v1_red", "p_red", "v2_red")
BEAT = f"array<struct<{','.join(f'{n}:int' for n in _BEAT_FIELDS)}>>"


def segment_beats(fs: float, min_interval_s=0.40, valley_s=0.12, peak_s=0.16, smooth_s=0.06, low=0.5, high=5.0, lp=8.0, filter_order=3):
    """(red, ir) window -> beats (landmark indices) and the low-passed signals they are measured on."""
    dist = max(1, int(round(min_interval_s * fs)))
    vh, ph = max(1, int(round(valley_s * fs))), max(1, int(round(peak_s * fs)))
    width = max(1, int(round(smooth_s * fs)))
    high, lp = min(high, 0.45 * fs), min(lp, 0.45 * fs)

    def extreme(x, first, last):
        """Place of the maximum of each row between two columns, and whether there is a column between them."""
        at = np.arange(x.shape[1])
        inside = (at >= first[:, None]) & (at <= last[:, None])
        return np.where(inside, x, -np.inf).argmax(axis=1), first <= last

    def beats(red, ir):
        """All beats of a stack of windows at once: (row, landmarks) columns of those that hold together."""
        valleys = [kn.local_maxima(-x, dist) for x in ir]
        row = np.repeat(np.arange(len(ir)), [max(0, len(v) - 1) for v in valleys])
        begin, end = (np.concatenate([v[cut] for v in valleys]).astype(int) for cut in (slice(None, -1), slice(1, None)))
        number = np.concatenate([np.arange(max(0, len(v) - 1)) for v in valleys]).astype(int)
        crest, _ = extreme(ir[row], begin, end)
        left, has_left = extreme(-red[row], np.maximum(0, begin - vh), np.minimum(crest - 1, begin + vh))
        right, has_right = extreme(-red[row], np.maximum(crest + 1, end - vh), np.minimum(red.shape[1] - 1, end + vh))
        near, far = np.maximum(left + 1, crest - ph), np.minimum(right - 1, crest + ph)
        thin = far <= near  # no room around the infrared crest: anywhere between the valleys
        top, _ = extreme(red[row], np.where(thin, left + 1, near), np.where(thin, right - 1, far))
        whole = (end > begin + 2) & (begin < crest) & (crest < end) & has_left & has_right & (right > left + 2) & (left < top) & (top < right)
        return row[whole], np.stack([number, begin, crest, end, left, top, right], axis=1)[whole]

    @F.pandas_udf(f"beats {BEAT}, red array<double>, ir array<double>")
    def run(red: pd.Series, ir: pd.Series) -> pd.DataFrame:
        out, lo_r, lo_i = [[] for _ in range(len(red))], [[] for _ in range(len(red))], [[] for _ in range(len(red))]
        bp = kn.butterworth(filter_order, low, high, float(fs))
        lpf = kn.butterworth(filter_order, None, lp, float(fs))
        box = np.ones(width) / width
        for (n, _), rows in _by_shape(red, ir):
            if n < max(8, 2 * dist):
                continue
            both = np.concatenate([_stack(red, rows), _stack(ir, rows)])
            det, adc = kn.zero_phase(both, *bp), kn.zero_phase(both, *lpf)
            if width > 1:
                det = np.apply_along_axis(np.convolve, 1, det, box, "same")
            k = len(rows)
            for j, marks in zip(*beats(det[:k], det[k:])):
                out[rows[j]].append(dict(zip(_BEAT_FIELDS, marks.tolist())))
            for j, i in enumerate(rows):
                lo_r[i], lo_i[i] = adc[j], adc[k + j]
        return pd.DataFrame({"beats": out, "red": lo_r, "ir": lo_i})

    return run


def beat_ratio(df: DataFrame, r_min: float = 0.05, r_max: float = 3.0) -> DataFrame:
    """AC over the valley line and DC at the peak for both colours; r = (AC/DC red) / (AC/DC IR).
    Expects y-values ``<c>_v1/_p/_v2`` and indices ``v1_/p_/v2_<c>`` for c in red, ir."""
    out = df
    for c in ("red", "ir"):
        w = (F.col(f"p_{c}") - F.col(f"v1_{c}")) / (F.col(f"v2_{c}") - F.col(f"v1_{c}"))
        out = out.withColumn(f"dc_{c}", F.col(f"{c}_v1") + (F.col(f"{c}_v2") - F.col(f"{c}_v1")) * w)
        out = out.withColumn(f"ac_{c}", F.abs(F.col(f"{c}_p") - F.col(f"dc_{c}")))
    small = F.lit(1e-4)
    live = (F.col("ac_ir") > small) & (F.col("ac_red") > small) & (F.col("dc_ir") > small) & (F.col("dc_red") > small)
    r = F.when(live, (F.col("ac_red") / F.col("dc_red")) / (F.col("ac_ir") / F.col("dc_ir")))
    return out.withColumn("r", r).filter((F.col("r") > r_min) & (F.col("r") < r_max))


def polynomial_residual(df: DataFrame, cols: list[str], degree: int, n: int | None = None, keys=KEYS, order=IDX) -> DataFrame:
    """Residual of a least-squares polynomial over whole recordings, or over a grid of ``n`` samples.

    Orthogonal (Gram) polynomials come from their three-term recurrence as expressions of the sample and the recording's
    length, and their norms from the same coefficients, so the fit is ``degree + 1`` sums a channel: summed per chunk, then
    over the chunks. Missing samples are interpolated first (ends held), as orthogonality needs every sample; their residual is
    that of the interpolated value.
    """
    chunk = chunk_col(order, CHUNK)
    base = fill_linear_nearest(df, {c: numeric(F.col(c)) for c in cols}, keys, order)
    if n is None:
        base = with_totals(base, keys, chunk, {"_len": F.max(order) + 1}, {"_len": F.max("_len")})
    size = (F.lit(n) if n is not None else F.col("_len")).cast("double")
    x = F.col(order) - (size - 1) / 2.0
    basis, norms = [F.lit(1.0), x], [size]
    for k in range(1, degree + 1):
        beta = k * k * (size * size - k * k) / (4.0 * (4 * k * k - 1))
        norms.append(norms[-1] * beta)
        basis.append(x * basis[k] - basis[k - 1] * beta)
    base = base.withColumns({f"_p{k}": basis[k] for k in range(degree + 1)})
    names = [(c, k, f"_{c}_{k}") for c in cols for k in range(degree + 1)]
    out = with_totals(base, keys, chunk, {name: F.sum(F.col(c) * F.col(f"_p{k}")) for c, k, name in names}, {name: F.sum(name) for _, _, name in names})
    # a recording of no more samples than degrees is met exactly by the first of them
    share = lambda k, name: F.when(norms[k] > 0, F.col(name) / norms[k]).otherwise(F.lit(0.0)) * F.col(f"_p{k}")
    res = {f"{c}_res": reduce(lambda left, k: left - share(k, f"_{c}_{k}"), range(degree + 1), F.col(c)) for c in cols}
    return out.withColumns(res).drop("_len", *[f"_p{k}" for k in range(degree + 1)], *[name for *_, name in names])


def quality_check(df: DataFrame, a: str, b: str, n: int, profile: str, keys=KEYS, order=IDX) -> DataFrame:
    """A9 (``single``: degree 4, all reasons) and A10 (``dual``: degree 6, first reason) on the first ``n`` samples."""
    degree = 4 if profile == "single" else 6
    head = df.filter(F.col(order) < n)  # pushed to the scan; n rows per recording
    res = polynomial_residual(head, [a, b], degree, n, keys, order)
    sd = res.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop(f"{a}_res").alias("std_a"), F.stddev_pop(f"{b}_res").alias("std_b"))
    far = lambda c, s: F.count_if(F.abs(f"{c}_res") > F.col(s) * 3.0)
    out = res.join(sd, keys).groupBy(*keys, "n", "std_a", "std_b").agg(far(a, "std_a").alias("out_a"), far(b, "std_b").alias("out_b"))
    live = lambda c, s: F.when(F.col(s) > 1e-9, F.col(c)).otherwise(F.lit(0))
    if profile == "single":
        out = out.withColumns({"out_a": live("out_a", "std_a"), "out_b": live("out_b", "std_b")})
        ra, rb = F.col("out_a") / F.col("n"), F.col("out_b") / F.col("n")
        ratio = F.greatest("std_a", "std_b") / (F.least("std_a", "std_b") + 1e-12)
        balance = F.greatest(ra, rb) / (F.least(ra, rb) + 1e-12)
        reasons = F.concat_ws(
            "; ",
            F.when((F.col("std_a") > 2.5) | (F.col("std_b") > 2.5), "STD > 2.5 mV"),
            F.when(ratio > 3.0, "STD ratio > 3"),
            F.when(~((ra < 0.03) & (rb < 0.03)) & (balance > 3.0), "outlier proportion ratio > 3 with at least one channel >= 3%"),
        )
        reason = F.when(F.col("n") < n, "fewer than 10 seconds of samples").when(F.length(reasons) > 0, reasons).otherwise("ok")
    else:
        ratio = F.greatest("std_a", "std_b") / (F.least("std_a", "std_b") + 1e-9)
        balance = F.greatest("out_a", "out_b") / (F.least("out_a", "out_b") + 1.0)
        reason = (
            F.when(F.col("n") < n, "fewer than 10 seconds of samples")
            .when((F.col("std_a") > 5.0) | (F.col("std_b") > 5.0), "STD too large")
            .when(ratio > 3.0, "STD differs").when(balance > 4.0, "outliers unbalanced").otherwise("ok")
        )
    return out.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "ok", "good").otherwise("bad"))


def fuse_spectra(df: DataFrame, bins: list[str], weights: list[Column], keys: list[str]) -> DataFrame:
    """Sum of weight * amplitude per (window, bin); arrays stay in their row."""
    z = F.arrays_zip(*bins)
    def one(v, i):
        tot = F.lit(0.0)
        for b, wt in zip(bins, weights):
            tot = tot + v[b] * wt
        return tot
    return df.withColumn("fused", F.transform(z, one))


def band_candidates(step: float, low: float = 1.0, high: float = 4.0, percent: float = 0.3, weight=0.2, width=0.2):
    """G23 front for long spectra: (amplitudes, motion frequency) -> candidate frequencies."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, motion: pd.Series) -> pd.Series:
        out = [[] for _ in range(len(x))]
        mf = motion.fillna(-1e9).to_numpy(float)
        for (n,), rows in _by_shape(x, most=WIDE_ROWS):
            if n > 0:
                for i, f in zip(rows, kn.band_candidates(_stack(x, rows), step, mf[rows], low, high, percent, weight, width)):
                    out[i] = f
        return pd.Series(out)

    return run


def band_peaks(
    df: DataFrame, amps: str, out: str, freq_step: float, low: float = 1.0, high: float = 4.0, percent: float = 0.3,
    motion_hz: str | None = None, weight=0.2, width=0.2,
) -> DataFrame:
    """G23 front: penalty on bins, local maxima inside (low, high), above ``percent`` of the best,
    frequencies by amplitude. Stepwise columns, so no lambda evaluates another one again."""
    freq = lambda i: i * F.lit(freq_step)
    bins = F.transform(amps, lambda a, i: F.struct(freq(i).alias("f"), a.alias("a")))
    if motion_hz is not None:
        bins = penalised(bins, F.col(motion_hz), weight, width)
    step = df.withColumn("_band", F.filter(bins, lambda p: (p["f"] > low) & (p["f"] < high)))
    last = F.size("_band") - 1
    tops = F.transform("_band", lambda p, i: F.when(
        (i > 0) & (i < last) & (p["a"] > F.get("_band", i - 1)["a"]) & (p["a"] > F.get("_band", i + 1)["a"]),
        F.struct((-p["a"]).alias("n"), p["f"].alias("f"))))
    step = step.withColumn("_tops", F.array_sort(F.array_compact(tops)))
    step = step.withColumn("_best", -F.get("_tops", F.lit(0))["n"] * percent)
    return step.withColumn(out, F.transform(F.filter("_tops", lambda p: -p["n"] > F.col("_best")), lambda p: p["f"])).drop("_band", "_tops", "_best")
