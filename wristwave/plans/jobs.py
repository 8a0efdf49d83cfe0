"""End-to-end jobs: heart rate (dual and single path), SpO2, quality, batch, sweep, studies.

Shape of every heart-rate job: condition samples in bounded frames, cut windows, filter and
transform windows in parallel, fold the small peak table per recording, smooth and score.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wristwave.functions.scalars import GROUP_CHANNELS, magnitude, order_from_delay, spo2_from_r
from wristwave.operators import clean, signal as sg, stats as st, windows as w
from wristwave.operators.align import interpolate, shifted
from wristwave.operators.chunked import CHUNK, chunk_col, join_group, longest_run, rolling
from wristwave.operators.delay import delay_profile, window_delays, with_lags
from wristwave.operators.sampling import sampled_grid
from wristwave.operators.tracking import fold, post_motion_slew, post_recovery_blend, tracked, tracked_move
from wristwave.session import drop_tables, made_tables, materialise
from wristwave.sources.published import publish, published
from wristwave.sources.reports import batch_tables, optimise_tables

ACC = ["accx", "accy", "accz"]


@dataclass(frozen=True)
class HrParams:
    """Defaults of the dual-path job; ``SINGLE`` holds those of the single-path job.

    Fixed values: the published defaults, so that results can be compared.
    """

    fs_origin: int = 100
    fs_target: int = 25
    max_order: int = 16
    time_start: float = 1.0
    time_buffer: float = 10.0
    calib_time: float = 30.0
    motion_th_scale: float = 2.5
    penalty_enable: bool = True
    penalty_weight: float = 0.2
    penalty_width: float = 0.2
    hr_range_hz: float = 25.0 / 60.0
    slew_limit_bpm: float = 10.0
    slew_step_bpm: float = 7.0
    hr_range_rest: float = 30.0 / 60.0
    slew_limit_rest: float = 6.0
    slew_step_rest: float = 4.0
    smooth_win_len: int = 7
    time_bias: float = 5.0
    max_missing_ratio: float = 0.20
    max_gap_s: float = 1.0
    repair: bool = True
    hf_channels: int = 2
    acc_channels: int = 3
    mu_base: float = 0.01
    mu_min: float = 1e-6
    bp_low_hz: float = 0.5
    bp_high_hz: float = 5.0
    bp_order: int = 4
    adaptive_filter: str = "lms"
    ppg_mode: str = "ppg_green"
    scope: str = "full"
    pre_motion_s: float = 30.0
    post_motion_s: float = 10.0
    recovery_trigger_bpm: float = 20.0
    delay_search: str = "adaptive"
    reference_groups: tuple = ("HF",)
    options: tuple = ()

    def opts(self) -> dict:
        return {"mu_min": self.mu_min, **dict(self.options)}


SINGLE = HrParams(adaptive_filter="noncausal_lms", penalty_weight=0.4)


class HrResult(NamedTuple):
    windows: DataFrame
    errors: DataFrame


# ---------------------------------------------------------------- shared stages
def condition(samples: DataFrame, cols: list[str], p: HrParams, keys: list[str]) -> DataFrame:
    """Gaps, outliers, resampling and band-pass; stored once because several stages read it.

    Channels don't meet here, so several optical ones share a pass. Tables of the steps go once the result is stored.
    """
    spark = samples.sparkSession
    before = set(made_tables(spark))
    # stored: totals and carries read it again
    whole = materialise(clean.clean_signal(samples.select(*keys, "sample_idx", *cols), cols, p.fs_origin, keys), "cleaned")
    ready = clean.mean_outliers_previous(whole, [c for c in cols if c.startswith("ppg")], keys=keys)
    if p.fs_origin != p.fs_target:
        ready = sg.resample(ready, cols, p.fs_target, p.fs_origin, keys=keys)
    out = materialise(sg.band_pass(ready, cols, p.fs_target, p.bp_low_hz, p.bp_high_hz, p.bp_order, keys=keys), "conditioned")
    drop_tables(spark, [t for t in made_tables(spark) if t not in before], keep_for=out)
    return out


def source_motion(samples: DataFrame, cond: DataFrame, p: HrParams, keys: list[str]) -> DataFrame:
    """W5 at the source rate: keys, window_idx, std, threshold, motion."""
    acc = cond if p.fs_origin == p.fs_target else sg.band_pass(
        clean.clean_signal(samples.select(*keys, "sample_idx", *ACC), ACC, p.fs_origin, keys), ACC, p.fs_origin, p.bp_low_hz, p.bp_high_hz, p.bp_order, keys=keys
    )
    fs = p.fs_origin
    return w.motion_flags(acc, magnitude(*[F.col(c) for c in ACC]), 8 * fs, fs, int(round(p.calib_time * fs)), p.motion_th_scale,
                          start=int(round(p.time_start * fs)), keys=keys)


def window_plan(cond: DataFrame, flags: DataFrame, p: HrParams, keys: list[str], *groups: DataFrame) -> DataFrame:
    """The per-window table that decides what is computed: flags, buffer rule and per-recording values.

    It is stored: it is small, and it is joined to the window arrays and read again later.
    """
    out = cond.groupBy(*keys).agg((F.max("sample_idx") + 1).alias("_n"))
    for g in groups:
        out = out.join(g, keys, "left")
    table = join_group(flags, out, keys, chunk_col("window_idx", CHUNK))
    start = F.col("window_idx") * p.fs_target + int(round(p.time_start * p.fs_target))
    last = F.col("_n") - int(round(p.time_buffer * p.fs_target))
    return materialise(table.filter((F.col("window_idx") == 0) | (start <= last)).drop("_n"), "windows")


def hr_windows(cond: DataFrame, refs: list[str], p: HrParams, keys: list[str], plan: DataFrame, lead: int = 1, optical: tuple[str, ...] = ("ppg",)) -> tuple[DataFrame, int, int]:
    """Window arrays starting one sample early (the delay search does), references padded by 0.2 s."""
    fs, win = p.fs_target, 8 * p.fs_target
    pad, start = round(0.2 * fs), int(round(p.time_start * fs))
    wins = w.window_arrays(cond, [*optical, *refs], win + lead, fs, start - lead, pad, tuple(refs), keys=keys, plan=plan)
    return wins.withColumn("start_idx", F.col("start_idx") + lead), win, pad


def _core(c: str, win: int, lead: int = 1, padded: bool = True) -> Column:
    at = F.col("pad_left") if padded else F.lit(0)
    return F.slice(c, at + 1 + lead, F.lit(win))


def fft_candidates(wins: DataFrame, win: int, p: HrParams, penalty: str = "accz") -> Column:
    """Candidate frequencies of the plain spectrum; the taper is a column expression."""
    taper = sg.tapered(_core("ppg", win, padded=False), win)
    return sg.peak_frequencies(p.fs_target, p.penalty_weight, p.penalty_width, penalise=p.penalty_enable)(taper, _core(penalty, win))


def adaptive_candidates(p: HrParams, win: int, active: Column, stages: str, m: Column) -> Column:
    """Candidate frequencies of the residual after the ranked references, in active windows."""
    find = sg.cascade_peaks(p.adaptive_filter, p.fs_target, p.mu_base, p.penalty_weight, p.penalty_width, penalise=p.penalty_enable, **p.opts())
    return find(F.when(active, _core("ppg", win, padded=False)), *[F.when(active, F.col(f"{stages}.{c}")) for c in ("signal", "corr", "k")], m)


def track_paths(df: DataFrame, keys: list[str], paths: list[str], active: str, params: dict[str, Column], mode: Column | None = None, size: int = 256) -> DataFrame:
    """FFT chain and adaptive chains in one fold: an adaptive chain follows FFT at rest and restarts
    from its strongest peak when motion begins. Columns ``f_fft``, ``f_<path>`` hold candidates."""
    payload = {"_m": F.col(active), "_fft": F.col("f_fft"), **{f"_{q}": F.col(f"f_{q}") for q in paths}, **params}
    if mode is not None:
        payload["_mode"] = mode
    state = "struct<fft:double," + ",".join(f"{q}:double" for q in paths) + ("," if paths else "") + "m:boolean>"

    def step(prev, r):
        raw = lambda c: F.coalesce(F.get(r[c], F.lit(0)), F.lit(0.0))
        md = r["_mode"] if mode is not None else None
        fft = F.when(prev.isNull(), raw("_fft")).otherwise(
            tracked(r["_fft"], prev["fft"], md, r["range_rest"], r["limit_rest"] / 60, r["step_rest"] / 60)
        )
        out = [fft.alias("fft")]
        for q in paths:
            begin = prev.isNull() | ~prev["m"]
            est = F.when(begin, raw(f"_{q}")).otherwise(tracked(r[f"_{q}"], prev[q], None, r["range_hz"], r["limit_bpm"] / 60, r["step_bpm"] / 60))
            out.append(F.when(r["_m"], est).otherwise(fft).alias(q))
        return F.struct(*out, r["_m"].alias("m")).cast(state)

    raw = lambda r, c: F.coalesce(F.get(r[c], F.lit(0)), F.lit(0.0))
    # the FFT chain, then each path: in motion it tracks its own peaks, from the strongest one on; at rest it copies the first
    moves = [lambda _, r: tracked_move(r["_fft"], r["_mode"] if mode is not None else None, r["range_rest"], r["limit_rest"] / 60, r["step_rest"] / 60, raw(r, "_fft"))]
    for q in paths:
        moves.append(lambda b, r, c=f"_{q}": F.when(r["_m"], tracked_move(
            r[c], None, r["range_hz"], r["limit_bpm"] / 60, r["step_bpm"] / 60, raw(r, c), ~F.coalesce(b["_m"], F.lit(False)))))
    entry = lambda rates, before: F.struct(*[F.get(rates, F.lit(k)).alias(n) for k, n in enumerate(["fft", *paths])], before["_m"].alias("m"))
    done = fold(df, keys, "window_idx", payload, step, "_s", moves, state=state, size=size, entry=entry)
    return done.select(*keys, "window_idx", F.col("_m").alias(active), F.col("_s.fft").alias("fft"), *[F.col(f"_s.{q}").alias(q) for q in paths])


def tracking_columns(p: HrParams) -> dict[str, Column]:
    return {n: F.lit(float(v)) for n, v in {
        "range_rest": p.hr_range_rest, "limit_rest": p.slew_limit_rest, "step_rest": p.slew_step_rest,
        "range_hz": p.hr_range_hz, "limit_bpm": p.slew_limit_bpm, "step_bpm": p.slew_step_bpm}.items()}


def quality_of(samples: DataFrame, p: HrParams, keys: list[str]) -> DataFrame:
    fs = p.fs_origin
    return w.window_quality(samples, F.col("valid"), 8 * fs, fs, fs, int(round(p.time_start * fs)), p.max_missing_ratio, p.max_gap_s, keys=keys)


def reference_at(df: DataFrame, ref: DataFrame, keys: list[str], time: str, out: str, missing: float | None = 0.0) -> DataFrame:
    """Reference series is per recording; a key with more parts (mode) sees the same series. ``missing`` where it has under two points."""
    if keys != ["recording"]:
        ref = ref.join(df.select(*keys).distinct(), "recording")
    q = df.withColumn("_t", F.col(time))
    return interpolate(q.withColumnRenamed("_t", "t_s"), ref, keys, "t_s", "bpm", out, 3600.0, missing).drop("t_s")


def _reindexed(df: DataFrame, keys: list[str]) -> DataFrame:
    df = materialise(df, "scored")
    first = df.groupBy(*keys).agg(F.min("window_idx").alias("_w0"))
    out = join_group(df, first, keys, chunk_col("window_idx", CHUNK))
    return out.withColumn("row_idx", F.col("window_idx") - F.col("_w0")).drop("_w0")


def score(df: DataFrame, methods: list[str], keys: list[str], biases: list[float], which: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Reference shifted by the time bias, error statistics. ``which``: the place of a row's own bias among several."""
    at = shifted(materialise(_reindexed(df, keys), "rated"), "ref", biases, keys, "row_idx")
    at = materialise(at.withColumn("ref_aligned", F.get("_at", F.lit(0) if which is None else which)["v"]).drop("_at"), "aligned")
    err = st.error_stats(at.withColumns({m: F.col(m) * 60 for m in methods}).withColumn("_r", F.col("ref_aligned") * 60), methods, "_r", "motion", "reliable_i", keys)
    return at, err


# ---------------------------------------------------------------- E1
def peak_table_dual(samples: DataFrame, p: HrParams, keys: list[str], orders: list[int] | None = None) -> DataFrame:
    """Windows with candidate frequencies of FFT, HF and ACC paths; the expensive, fully parallel part.

    ``orders``: several limits instead of ``p.max_order``, in rising order; f_hf and f_acc are then arrays of a candidate
    list for each. A window is filtered again only for limits that change its number of taps.
    """
    most = p.max_order if orders is None else orders[-1]
    refs = ["ut1", "ut2", *(["uc1", "uc2"] if p.hf_channels == 4 else [])]
    cols = ["ppg", *refs, *ACC]
    src = samples.withColumn("ppg", F.col(p.ppg_mode))
    cond = condition(src, cols, p, keys)
    flags = materialise(source_motion(src, cond, p, keys), "motion")
    win, pad = 8 * p.fs_target, round(0.2 * p.fs_target)
    groups = []
    lo = {"HF": F.lit(-pad), "ACC": F.lit(-pad)}
    hi = {"HF": F.lit(pad), "ACC": F.lit(pad)}
    if p.delay_search == "adaptive":
        mag = cond.withColumn("_mag", magnitude(*[F.col(c) for c in ACC]))
        th = flags.groupBy(*keys).agg(F.max("threshold").alias("threshold"))
        prof = delay_profile(mag, "ppg", {"HF": refs, "ACC": ACC}, "_mag", p.fs_target, win, p.fs_target, int(round(p.time_start * p.fs_target)), th, keys)
        wide = prof.groupBy(*keys).agg(*[
            F.max(F.when(F.col("group") == g, F.col(c))).alias(f"_{c}_{g}") for g in ("HF", "ACC") for c in ("min_lag", "max_lag")
        ])
        groups.append(wide)
        for g in lo:
            a, b = F.greatest(F.lit(-pad), F.col(f"_min_lag_{g}")), F.least(F.lit(pad), F.col(f"_max_lag_{g}"))
            bad = F.coalesce(a > b, F.lit(True))
            lo[g], hi[g] = F.when(bad, -pad).otherwise(a), F.when(bad, pad).otherwise(b)
    plan = window_plan(cond, flags, p, keys, *groups)
    out, win, pad = hr_windows(cond, [*refs, *ACC], p, keys, plan)
    out = with_lags(out, "ppg", [*refs, *ACC], pad, win, F.col("motion"))
    for g, chans, k, scale, top in (("HF", refs, 0, 1.0, p.hf_channels), ("ACC", ACC, 1, 1.5, p.acc_channels)):
        tag = g.lower()
        out = window_delays(out, "ppg", chans, pad, win, {c: k for c in chans}, most, top, lo[g], hi[g], scale,
                            f"st_{tag}", f"m_{tag}", f"delay_{tag}", lead=1, active=F.col("motion"), ready=True)
    # both cascades and the plain spectrum side by side: one worker a task holds their batch
    found = {f"f_{q}": adaptive_candidates(p, win, F.col("motion"), f"st_{q}", F.col(f"m_{q}")) for q in ("hf", "acc")}
    less = {}
    for q in ("hf", "acc") if orders else ():
        for o in orders[:-1]:
            less[f"f_{q}_{o}"] = adaptive_candidates(p, win, F.col("motion") & (F.col(f"m_{q}") > o), f"st_{q}", F.lit(o))
    out = out.withColumns(found | less | {"f_fft": fft_candidates(out, win, p)})
    if orders:
        each = lambda q: F.array(*[F.when(F.col(f"m_{q}") > o, F.col(f"f_{q}_{o}")).otherwise(F.col(f"f_{q}")) for o in orders[:-1]], F.col(f"f_{q}"))
        out = out.withColumns({f"f_{q}": each(q) for q in ("hf", "acc")})
    return out.select(*keys, "window_idx", "motion", "f_fft", "f_hf", "f_acc", "delay_hf", "delay_acc")


PATHS = ["hf", "acc"]
METHODS = ["lms_hf", "lms_acc", "fft", "fusion_hf", "fusion_acc"]


def finish_dual(tracks: DataFrame, samples: DataFrame, ref: DataFrame, p: HrParams, keys: list[str], own: dict[int, HrParams] | None = None, methods: list[str] = METHODS, paths: list[str] = PATHS) -> HrResult:
    """Reference, smoothing, repair and scores of tracked windows.

    ``own``: the settings of each number in the key ``trial``, which differ from ``p`` in what is smoothed and shifted by only.
    """
    t = tracks.withColumn("t_s0", F.col("window_idx") + F.lit(p.time_start)).withColumn("motion", F.col("motion").cast("int"))
    t = materialise(t, "tracks")  # window tables are small; storing them keeps the plans below flat
    # reference and quality belong to the recording, whatever else the keys tell apart
    one = ["recording"]
    known = t.select(*one, "window_idx", (F.col("t_s0") + 4.0).alias("_c"))
    known = reference_at(known if keys == one else known.distinct(), ref, one, "_c", "ref_bpm")
    q = quality_of(samples, p, one).select(*one, "window_idx", "missing_ratio", "reliable")
    known = known.select(*one, "window_idx", (F.col("ref_bpm") / 60).alias("ref")).join(q, [*one, "window_idx"], "left")
    t = t.join(materialise(known, "known"), [*one, "window_idx"], "left").withColumn("reliable", F.coalesce("reliable", F.lit(True)))
    if p.scope == "motion":
        t = w.analysis_scope(t, "motion", "t_s0", p.pre_motion_s, keys=keys)
    t, which, biases = materialise(t, "scoped"), None, [p.time_bias]
    if own is None:
        t = smooth_and_fuse(t, p.smooth_win_len, keys, paths)
    else:
        biases = sorted({s.time_bias for s in own.values()})
        which = F.create_map(*[F.lit(x) for i, s in own.items() for x in (i, biases.index(s.time_bias))])[F.col("trial")]
        width = lambda n: F.col("trial").isin([i for i, s in own.items() if s.smooth_win_len == n])
        t = reduce(DataFrame.unionByName, [smooth_and_fuse(t.filter(width(n)), n, keys, paths) for n in sorted({s.smooth_win_len for s in own.values()})])
    t = materialise(t, "fused")
    if p.repair:
        t = clean.repair_unreliable(t, methods, "t_s0", F.col("reliable"), keys)
    t = t.withColumn("reliable_i", F.col("reliable").cast("int"))
    at, err = score(t, methods, keys, biases, which)
    rows = at.select(*keys, "window_idx", F.col("t_s0").alias("start_s"), (F.col("t_s0") + 4.0).alias("center_s"), "ref", "ref_aligned", *methods, "motion", "reliable")
    return HrResult(rows, err)


def smooth_and_fuse(t: DataFrame, width: int, keys: list[str], paths: list[str] = PATHS) -> DataFrame:
    """W8 then W20 in one chunked pass: medians, motion switch, median of three."""
    med = lambda c: (lambda fr: F.percentile(F.col(c), 0.5).over(fr.ordered.rowsBetween(-(width // 2), (width - 1) // 2)))
    m = F.col("motion") == 1
    mix = lambda c: (lambda fr: F.when(m, F.col(c)).otherwise(F.col("_fft")))
    three = lambda c: (lambda fr: F.percentile(F.col(c), 0.5).over(fr.ordered.rowsBetween(-1, 1)))
    reach = width // 2 + 1
    out = rolling(t, keys, "window_idx", [
        {f"_{q}": med(q) for q in (*paths, "fft")},
        {f"_m_{q}": mix(f"_{q}") for q in paths},
        {f"fusion_{q}": three(f"_m_{q}") for q in paths},
    ], reach, reach)
    return out.drop(*paths, "fft", *[f"_m_{q}" for q in paths]).withColumnsRenamed({f"_{q}": f"lms_{q}" for q in paths} | {"_fft": "fft"})


def estimate_hr_dual(samples: DataFrame, ref: DataFrame, p: HrParams = HrParams(), keys: list[str] | None = None) -> HrResult:
    """HF and ACC cascades beside plain FFT; frequencies in Hz, errors in BPM."""
    keys = keys or ["recording"]
    peaks = peak_table_dual(samples, p, keys)
    tracks = track_paths(peaks, keys, ["hf", "acc"], "motion", tracking_columns(p))
    return finish_dual(tracks, samples, ref, p, keys)


# ---------------------------------------------------------------- E2
def estimate_hr_single(samples: DataFrame, ref: DataFrame, p: HrParams = SINGLE, keys: list[str] | None = None, modes: list[str] | None = None) -> HrResult:
    """One cascade over the ordered reference groups; frequencies in BPM.

    ``modes``: optical channels that are estimated side by side instead of ``p.ppg_mode``; results have the further key ``mode``.
    What doesn't depend on them (cleaning of the references, motion, quality, reference rates) is done once a recording.
    """
    one = keys or ["recording"]
    keys = one if modes is None else [*one, "mode"]
    each = lambda df: df if modes is None else df.withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    optical = ("ppg",) if modes is None else tuple(f"ppg_{i}" for i in range(len(modes)))
    fs, win = p.fs_target, 8 * p.fs_target
    told = {"ppg": F.col(p.ppg_mode)} if modes is None else {c: F.col(m) for c, m in zip(optical, modes, strict=True)}
    src = samples.withColumns(told).withColumns({"hf1": F.col("ut1"), "hf2": F.col("ut2")})
    if "CF" in p.reference_groups:
        bridge = clean.clean_numeric(src, {c: F.col(c) for c in ("uc1", "uc2", "ut1", "ut2")}, one)
        src = clean.cold_film_ratios(bridge, {f"cf{i}": (f"uc{i}", f"ut{i}") for i in (1, 2)}, one)
    refs = [c for g in p.reference_groups for c in GROUP_CHANNELS[g]]
    cols = [*optical, *dict.fromkeys([*refs, *ACC])]
    cond = condition(src, cols, p, one)
    flags = source_motion(src, cond, p, one)
    mag = magnitude(*[F.col(c) for c in ACC])
    seg_flags = w.motion_flags(cond, mag, win, fs, max(2, int(round(p.calib_time * fs))), p.motion_th_scale, relative_floor=0.05, keys=one)
    run = longest_run(seg_flags, one, "window_idx", F.col("motion"))
    seg = materialise(run.select(*one, (F.col("run_start") + 4.0).alias("start_s"), (F.col("run_end") + 4.0).alias("end_s")), "segment")
    plan = window_plan(cond, flags, p, one, seg)
    wins, win, pad = hr_windows(cond, list(dict.fromkeys([*refs, *ACC])), p, one, plan, optical=optical)
    if modes is not None:  # where the windows are cut: nothing is shuffled once a mode
        others = [c for c in wins.columns if c not in optical]
        wins = wins.select(*others, F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(c).alias("ppg")) for c, m in zip(optical, modes, strict=True)])).alias("_m")).select(*others, "_m.*")
    wins = wins.withColumn("center_s", F.col("start_idx") / fs + 4.0)
    wins = wins.withColumn("adaptive", F.coalesce(F.col("center_s") >= F.col("start_s"), F.lit(False)) if refs else F.lit(False))
    out = wins
    if refs:
        forward = {c: (1 if c in ACC else 0) for c in refs}
        out = window_delays(out, "ppg", refs, pad, win, forward, p.max_order, lead=1, active=F.col("adaptive"))
        out = out.withColumns({"f_ad": adaptive_candidates(p, win, F.col("adaptive"), "stages", F.col("m")), "f_fft": fft_candidates(out, win, p)})
    else:
        taper = sg.tapered(_core("ppg", win, padded=False), win)
        strongest = sg.peak_frequencies(fs, percent=0.2, penalise=False)(taper, F.lit(None).cast("array<double>"))
        out = out.withColumns({"f_fft": F.slice(strongest, 1, 1), "f_ad": F.array().cast("array<double>")})
    kept = [F.col("motion").alias("is_motion"), "adaptive", "f_fft", "f_ad"]
    stage_cols = [F.transform("stages", lambda s: F.struct(s["channel"].alias("channel"), s["corr"].alias("corr"), s["k"].alias("k"))).alias("adaptive_stages")] if refs else []
    table = materialise(out.select(*keys, "window_idx", "center_s", *kept, *stage_cols), "peaks")
    params = tracking_columns(p)
    if not refs:  # no reference: follow the strongest peak with the slew limit only
        params |= {"range_rest": F.lit(1e9), "limit_rest": F.lit(float(p.slew_limit_bpm)), "step_rest": F.lit(float(p.slew_step_bpm))}
    tr = track_paths(table, keys, ["ad"], "adaptive", params)
    side = table.select(*keys, "window_idx", "center_s", "is_motion", *(["adaptive_stages"] if refs else []))
    t = tr.drop("adaptive").join(side, [*keys, "window_idx"])
    t = w.moving_median(t, {"ad": "ad", "fft": "fft"}, p.smooth_win_len, keys)
    t = materialise(t.withColumns({"ad": F.col("ad") * 60, "fft": F.col("fft") * 60}), "smoothed")
    t = w.fuse_v2(t, "ad", "fft", each(seg) if refs else each(seg).filter("false"), "center_s", p.post_motion_s if p.scope == "full" else 0.0, p.recovery_trigger_bpm, keys)
    # quality and reference rates belong to the recording's windows
    q = quality_of(samples, p, one).select(*one, "window_idx", "missing_count", "missing_ratio", "max_gap", "reliable")
    known = plan.select(*one, "window_idx", ((F.col("window_idx") * fs + int(round(p.time_start * fs))) / fs + 4.0).alias("_c"))
    known = reference_at(known, ref, one, "_c", "ref_bpm", missing=None).drop("_c").join(q, [*one, "window_idx"], "left")
    t = t.join(known, [*one, "window_idx"], "left").withColumn("reliable", F.coalesce("reliable", F.lit(True)))
    if p.repair:
        t = clean.repair_unreliable(materialise(t, "referenced"), ["fft", "final"], "center_s", F.col("reliable"), keys)
    t = materialise(join_group(t, each(seg), keys, chunk_col("window_idx", CHUNK)), "repaired")
    c = F.col("center_s")
    inside = F.lit(True) if p.scope == "full" else F.coalesce((c >= F.greatest(F.lit(0.0), F.col("start_s") - p.pre_motion_s)) & (c <= F.col("end_s")), F.lit(True))
    t = t.withColumn("in_analysis_scope", inside).withColumns({"reliable_i": F.col("reliable").cast("int"), "motion": F.col("is_motion").cast("int"), "ref": F.col("ref_bpm") / 60})
    rated = t.filter("in_analysis_scope").withColumns({"fft_hz": F.col("fft") / 60, "final_hz": F.col("final") / 60})
    _, err = score(rated, ["fft_hz", "final_hz"], keys, [p.time_bias])
    rows = t.select(
        *keys, "window_idx", (c - 4.0).alias("start_s"), "center_s", F.col("ref_bpm").alias("ref_hr_bpm"), F.col("fft").alias("fft_hr_bpm"), F.col("final").alias("final_hr_bpm"),
        "in_analysis_scope", "is_motion", "used_adaptive", "missing_count", "missing_ratio", "max_gap", "reliable",
        *(["adaptive_stages"] if refs else []),
    )
    return HrResult(rows, err.select(*keys, F.regexp_replace("method", "_hz$", "").alias("method"), "aae_all"))


# ---------------------------------------------------------------- E3
SPO2_REFS = ["hf1", "hf2", "cf1", "cf2", *ACC]


@dataclass(frozen=True)
class Spo2Params:
    window_s: float = 4.0
    step_s: float = 1.0
    delay_samples: int = 20
    max_order: int = 20
    min_order: int = 1
    mu_base: float = 0.01
    mu_min: float = 1e-6
    adaptive: bool = True
    rest_threshold: float = 0.02
    smooth_s: float = 7.0
    r_min: float = 0.05
    r_max: float = 3.0
    reference_groups: tuple = ("HF", "CF", "ACC")


def spo2_windows(samples: DataFrame, fs: int, p: Spo2Params = Spo2Params(), keys: list[str] | None = None) -> DataFrame:
    """Windows of red and IR with their cleaned versions (``clean``), stages and motion score."""
    keys = keys or ["recording"]
    win, step = int(round(p.window_s * fs)), int(round(p.step_s * fs))
    names = {"red": "ppg_red", "ir": "ppg_ir", "hf1": "ut1", "hf2": "ut2", "uc1": "uc1", "uc2": "uc2", **{c: c for c in ACC}}
    s = clean.clean_numeric(samples, {n: F.col(c) for n, c in names.items()}, keys)
    if "CF" in p.reference_groups:
        s = clean.cold_film_ratios(s, {f"cf{i}": (f"uc{i}", f"hf{i}") for i in (1, 2)}, keys)
    refs = [c for g in p.reference_groups for c in GROUP_CHANNELS[g]]
    s = s.withColumn("mag", magnitude(*[F.col(c) for c in ACC])).withColumn("miss", (~F.col("valid")).cast("double"))
    s = materialise(s.select(*keys, "sample_idx", "red", "ir", *refs, "mag", "miss"), "spo2-clean")
    moments = w.window_moments(s, {"mag": F.col("mag"), "miss": F.col("miss")}, win, step, keys=keys)
    moments = moments.select(*keys, "window_idx", w.sample_std("mag").alias("motion_score"), F.col("miss_mean").alias("missing_ratio"))
    wins = w.window_arrays(s, ["red", "ir", *refs], win, step, 0, p.delay_samples, tuple(refs), keys=keys, plan=moments)
    wins = wins.withColumn("adaptive_applied", F.col("motion_score") > p.rest_threshold)
    active = F.col("adaptive_applied") & F.lit(p.adaptive)
    wins = window_delays(wins, "ir", refs, p.delay_samples, win, {c: 0 for c in refs}, p.max_order, active=active, partial=True)
    # the lag of each stage sets its order: recover it from the ranking kept in ``stages``
    wins = _stage_orders(wins, refs, p, win, active)
    red = F.when(active, F.col("red"))
    ir = F.when(active, F.col("ir"))
    got = sg.clean_red_ir(p.mu_base, p.mu_min)(red, ir, "stages.signal", "stages.corr", "stages.order")
    out = wins.withColumn("clean", got)
    pick = lambda c: F.coalesce(F.col("clean")[c], F.col(c)).alias(c)
    return out.select(
        *keys, "window_idx", "start_idx", "red", "ir", "motion_score", "missing_ratio", "adaptive_applied",
        F.coalesce("stages", F.array().cast("array<struct<channel:string,corr:double,order:int,signal:array<double>>>")).alias("stages"),
        F.struct(pick("red"), pick("ir")).alias("clean"),
    )


def _stage_orders(wins: DataFrame, refs: list[str], p: Spo2Params, win: int, active: Column) -> DataFrame:
    order = lambda s: F.struct(s["channel"].alias("channel"), s["corr"].alias("corr"), order_from_delay(s["lag"], p.min_order, p.max_order).alias("order"), s["signal"].alias("signal"))
    used = F.filter(F.transform("stages", order), lambda s: s["corr"] > 1e-12)
    return wins.withColumn("stages", used)


class Spo2Result(NamedTuple):
    windows: DataFrame
    beats: DataFrame
    waveforms: DataFrame


def beat_table(wins: DataFrame, red: str, ir: str, scheme: str, fs: int, p: Spo2Params, keys: list[str]) -> DataFrame:
    seg = wins.select(*keys, "window_idx", sg.segment_beats(fs)(red, ir).alias("s"))
    b = seg.select(*keys, "window_idx", "s.red", "s.ir", F.explode("s.beats").alias("b")).select(*keys, "window_idx", "red", "ir", "b.*")
    at = {f"{c}_{e}": F.get(c, F.col(f"{e}_{c}")) for c in ("red", "ir") for e in ("v1", "p", "v2")}
    b = sg.beat_ratio(b.withColumns(at), p.r_min, p.r_max)
    return b.drop("red", "ir", *at).withColumn("scheme", F.lit(scheme))


def estimate_spo2(samples: DataFrame, fs: int = 100, p: Spo2Params = Spo2Params(), keys: list[str] | None = None) -> Spo2Result:
    """Raw and cleaned SpO2 per window, the beat table and the overlap-added waveforms."""
    keys = keys or ["recording"]
    wins = materialise(spo2_windows(samples, fs, p, keys), "spo2")
    wins = wins.withColumns({"red_c": F.col("clean.red"), "ir_c": F.col("clean.ir")})
    beats = beat_table(wins, "red", "ir", "raw", fs, p, keys).unionByName(beat_table(wins, "red_c", "ir_c", "adaptive", fs, p, keys))
    per = beats.groupBy(*keys, "window_idx").agg(*[
        f(F.when(F.col("scheme") == s, F.col("r"))).alias(f"{s}_{n}") for s in ("raw", "adaptive") for n, f in (("r_median", lambda c: F.percentile(c, 0.5)), ("valid_beat_count", F.count))
    ])
    t = wins.select(*keys, "window_idx", (F.col("start_idx") / fs).alias("start_s"), (F.col("start_idx") / fs + p.window_s / 2).alias("center_s"), "motion_score", "missing_ratio", "adaptive_applied")
    t = t.join(per, [*keys, "window_idx"], "left").fillna(0, ["raw_valid_beat_count", "adaptive_valid_beat_count"])
    t = t.withColumns({f"{s}_spo2": spo2_from_r(F.col(f"{s}_r_median")) for s in ("raw", "adaptive")})
    t = t.withColumns({f"{s}_spo2": F.when(F.col(f"{s}_r_median").isNotNull(), F.col(f"{s}_spo2")) for s in ("raw", "adaptive")})
    t = clean.carry_forward(materialise(t, "spo2-windows"), ["raw_spo2", "adaptive_spo2"], keys, "window_idx")
    t = t.withColumnRenamed("raw_spo2_carried", "raw_carried_forward").withColumnRenamed("adaptive_spo2_carried", "adaptive_carried_forward")
    t = t.withColumn("reliable", (F.col("missing_ratio") <= 0.20) & (F.col("adaptive_valid_beat_count") > 0))
    width = max(1, int(round(p.smooth_s / p.step_s)))
    width += 1 - width % 2
    t = t.withColumns({f"{s}_spo2_unsmoothed": F.col(f"{s}_spo2") for s in ("raw", "adaptive")})
    t = w.moving_mean(t, {"raw_spo2": "raw_spo2_unsmoothed", "adaptive_spo2": "adaptive_spo2_unsmoothed"}, width, keys)
    t = w.rest_policy(t, p.rest_threshold)
    acc_mag = F.sqrt(F.col("accx") ** 2 + F.col("accy") ** 2 + F.col("accz") ** 2)
    orig = samples.select(*keys, "sample_idx", (F.col("sample_idx") / fs).alias("time_s"), F.col("ppg_red").alias("red_c"), F.col("ppg_ir").alias("ir_c"), acc_mag.alias("acc_mag"))
    flat = wins.select(*keys, "start_idx", F.posexplode(F.arrays_zip("red_c", "ir_c")).alias("_p", "_v"))
    flat = flat.select(*keys, (F.col("start_idx") + F.col("_p")).alias("sample_idx"), "_v.*")
    mean = flat.groupBy(*keys, "sample_idx").agg(F.avg("red_c").alias("_r"), F.avg("ir_c").alias("_i"))
    wave = orig.join(mean, [*keys, "sample_idx"], "left").select(
        *keys, "sample_idx", "time_s", F.col("red_c").alias("red_raw"), F.col("ir_c").alias("ir_raw"), F.coalesce("_r", "red_c").alias("red_clean"), F.coalesce("_i", "ir_c").alias("ir_clean"), "acc_mag"
    )
    return Spo2Result(t, beats, wave)


# ---------------------------------------------------------------- E4, E5
def quality_scan(samples: DataFrame, fs: int, profile: str = "single") -> DataFrame:
    """First ten seconds, both bridge voltages; short recordings are bad."""
    return sg.quality_check(samples.select("recording", "sample_idx", "ut1", "ut2"), "ut1", "ut2", int(round(10 * fs)), profile)


def batch_estimate(samples: DataFrame, ref: DataFrame, p: HrParams = SINGLE, modes: list[str] = ("ppg_green", "ppg_red", "ppg_ir"), qc: DataFrame | None = None) -> DataFrame:
    """E5: every recording in every optical mode, with its quality row; bad quality is recorded, not blocking.

    Recordings without a reference are estimated too; their status is ``no_reference`` and their errors are missing.
    ``qc``: the quality scan, where it is there already.
    """
    qc = (quality_scan(samples, p.fs_origin) if qc is None else qc).select("recording", "status", "reason")
    res = estimate_hr_single(samples, ref, p, modes=list(modes))
    wide = res.errors.groupBy("recording", "mode").pivot("method", ["fft", "final"]).agg(F.first("aae_all"))
    every = samples.select("recording").distinct().select("recording", F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    known = ref.select("recording").distinct().withColumn("_ref", F.lit(True))
    out = every.join(wide, ["recording", "mode"], "left").join(qc, "recording", "left").join(known, "recording", "left")
    bare = F.col("_ref").isNull()
    return out.select(
        "recording", "mode", F.when(bare, "no_reference").otherwise(F.col("status")).alias("status"), "reason",
        F.when(~bare, F.col("fft")).alias("fft_aae_bpm"), F.when(~bare, F.col("final")).alias("final_aae_bpm"))


def batch_report(path: str, samples: DataFrame, ref: DataFrame, p: HrParams = SINGLE, modes: list[str] = ("ppg_green", "ppg_red", "ppg_ir")) -> dict[str, DataFrame]:
    """E5 with its sinks: the summary of every (recording, mode) and the quality table (S16), published together at ``path``.

    A run without a reference or without an estimate has a row that says so; bad quality is recorded, not blocking.
    """
    qc = materialise(quality_scan(samples, p.fs_origin), "quality")
    res = materialise(batch_estimate(samples, ref, p, modes, qc), "batch")
    status = F.when(F.col("status") == "no_reference", "no_reference").when(F.col("final_aae_bpm").isNull(), "no_estimate").otherwise("ok")
    est = res.select("recording", "mode", status.alias("status"), F.col("final_aae_bpm").alias("best_error"))
    qc = qc.withColumnRenamed("status", "qc_status")
    order_key = F.lit("-".join(p.reference_groups))
    publish(path, "batch", batch_tables(est, qc, F.lit(p.adaptive_filter), F.lit(p.scope), order_key))
    return published(samples.sparkSession, path, "batch")


# ---------------------------------------------------------------- E6
#: Fields of HrParams that candidates don't depend on: those of the tracking fold, and those of what follows it.
_TRACKING = {"hr_range_rest", "slew_limit_rest", "slew_step_rest", "hr_range_hz", "slew_limit_bpm", "slew_step_bpm"}
_FINISH = {"smooth_win_len", "time_bias", "repair", "scope", "pre_motion_s", "post_motion_s", "recovery_trigger_bpm", "max_missing_ratio", "max_gap_s"}


def _grouped(spec: list[HrParams], names) -> list[list[int]]:
    parts: dict[tuple, list[int]] = {}
    for i, s in enumerate(spec):
        parts.setdefault(tuple(getattr(s, n) for n in names), []).append(i)
    return list(parts.values())


def parameter_sweep(samples: DataFrame, ref: DataFrame, base: HrParams, grid: list[dict], scope_column: str = "aae_all") -> DataFrame:
    """Every parameter set for every recording; a set's errors are those that E1 has for it.

    Candidates are computed once for each distinct combination of the fields they depend on; the tracking
    fields expand the small peak table, and sets are finished together whatever they smooth and shift by.
    """
    parts = swept(samples, ref, [replace(base, **g) for g in grid], ["fusion_hf", "fusion_acc"])
    return reduce(DataFrame.unionByName, [r.errors for r in parts]).withColumn("value", F.col(scope_column))


def swept(samples: DataFrame, ref: DataFrame, spec: list[HrParams], methods: list[str], paths: list[str] = PATHS) -> list[HrResult]:
    """E1 for several settings side by side; results have the further key ``trial``, a setting's place in ``spec``."""
    keys = ["recording", "trial"]
    tables = []
    for ids in _grouped(spec, [f.name for f in fields(HrParams) if f.name not in _TRACKING | _FINISH | {"max_order"}]):
        orders = sorted({spec[i].max_order for i in ids})
        peaks = peak_table_dual(samples, spec[ids[0]], ["recording"], orders)
        sets = F.array(*[F.struct(F.lit(i).alias("trial"), F.lit(orders.index(spec[i].max_order)).alias("_o"), *[c.alias(n) for n, c in tracking_columns(spec[i]).items()]) for i in ids])
        tables.append(peaks.withColumn("_s", F.explode(sets)).select("recording", "window_idx", "motion", "f_fft", *[F.get(f"f_{q}", F.col("_s._o")).alias(f"f_{q}") for q in paths], "_s.*").drop("_o"))
    table = materialise(reduce(DataFrame.unionByName, tables), "sweep")
    tracks = materialise(track_paths(table, keys, paths, "motion", {n: F.col(n) for n in tracking_columns(spec[0])}), "sweep-tracks")
    parts = []
    for ids in _grouped(spec, sorted((_FINISH | {"time_start", "fs_origin"}) - {"smooth_win_len", "time_bias"})):
        mine = tracks.filter(F.col("trial").isin(ids))
        parts.append(finish_dual(mine, samples, ref, spec[ids[0]], keys, {i: spec[i] for i in ids}, methods, paths))
    return parts


def sweep_history(trials: DataFrame, method: str = "fusion_hf") -> tuple[DataFrame, DataFrame]:
    """Best trial per recording and the running best over trials."""
    one = trials.filter(F.col("method") == method)
    best = st.best_trial(one, ["recording"], "value", ["trial"], ["trial"], failed=F.col("value").isNull())
    hist = w.running_best(one.withColumn("repeat", F.lit(0)), "value", "trial", ["recording"], ["recording", "repeat"])
    return best, hist.select("recording", "trial", "value", "best_overall")


#: The published choices of the search, so that studies can be compared.
SEARCH_SPACE = {
    "max_order": [12, 16, 20],
    "penalty_width": [0.1, 0.2, 0.3],
    "hr_range_hz": [15 / 60, 20 / 60, 25 / 60, 30 / 60, 35 / 60, 40 / 60],
    "slew_limit_bpm": [8, 9, 10, 11, 12, 13, 14, 15],
    "slew_step_bpm": [5, 7, 9],
    "hr_range_rest": [20 / 60, 25 / 60, 30 / 60, 35 / 60, 40 / 60, 50 / 60],
    "slew_limit_rest": [5, 6, 7, 8],
    "slew_step_rest": [3, 4, 5],
    "smooth_win_len": [5, 7, 9],
    "time_bias": [4, 5, 6],
}


def optimise(samples: DataFrame, ref: DataFrame, base: HrParams, space: dict[str, list], trials: int = 75, repeats: int = 3, scope_column: str = "aae_all") -> dict[str, DataFrame]:
    """E6 as a study: an even sample of the grid, every trial for every recording, in one sweep; the tables of S9.

    Both paths are rounds of the same trials. ``trials`` x ``repeats`` settings are drawn and reach the driver, as
    the sweep's plan names them; their errors don't. Importance comes from the study's own trials. Fields of the
    tracking fold cost one row a window and trial; others (max_order, penalty_width) filter anew for each choice.
    """
    grid = materialise(sampled_grid(samples.sparkSession, space, trials, repeats), "grid")
    kinds = {n: type(getattr(base, n)) for n in space}
    spec = [{n: kinds[n](r[n]) for n in space} for r in sorted(grid.collect(), key=lambda r: r.trial)]
    errors = parameter_sweep(samples, ref, base, spec, scope_column)
    path = lambda m: F.max(F.when(F.col("method") == m, F.col("value")))
    wide = errors.groupBy("recording", "trial").agg(path("fusion_hf").alias("hf"), path("fusion_acc").alias("acc"))
    wide = materialise(wide.join(F.broadcast(grid), "trial"), "study-trials")  # trials * repeats rows
    fixed = {n: F.lit(getattr(base, n)) for n in ("adaptive_filter", "ppg_mode")} | {"analysis_scope": F.lit(base.scope)}
    return {"trials": wide, **optimise_tables(wide, "recording", "hf", "acc", "trial", space, fixed)}


# ---------------------------------------------------------------- E7
def rest_tracking_study(samples: DataFrame, ref: DataFrame, base: HrParams, grid: list[dict], biases: list[float]) -> DataFrame:
    """Tracking modes x rest parameters x time offsets, judged on the rest segments.

    ``grid`` items: mode, range_bpm, limit_bpm, step_bpm, smooth. Offsets are scanned from
    bounded frames (A6), so a trial costs one pass over the window table.
    """
    keys = ["recording", "trial"]
    peaks = peak_table_dual(samples, base, ["recording"]).select("recording", "window_idx", "motion", "f_fft", "f_hf")
    par = tracking_columns(base)
    sets = F.array(*[
        F.struct(
            F.lit(i).alias("trial"), F.lit(g["mode"]).alias("mode"), F.lit(g["range_bpm"] / 60.0).alias("range_rest"), F.lit(float(g["limit_bpm"])).alias("limit_rest"),
            F.lit(float(g["step_bpm"])).alias("step_rest"), *[par[n].alias(n) for n in ("range_hz", "limit_bpm", "step_bpm")]
        ) for i, g in enumerate(grid)
    ])
    table = materialise(peaks.withColumn("_s", F.explode(sets)).select("recording", "window_idx", "motion", "f_fft", "f_hf", "_s.*"), "study")
    tr = track_paths(table, keys, ["hf"], "motion", {n: F.col(n) for n in par}, mode=F.col("mode"))
    q = quality_of(samples, base, ["recording"]).select("recording", "window_idx", F.col("reliable").cast("int").alias("reliable_i"))
    tr = tr.join(q, ["recording", "window_idx"], "left").fillna(1, ["reliable_i"]).withColumn("_c", F.col("window_idx") + F.lit(base.time_start + 4.0))
    tr = materialise(reference_at(materialise(tr, "study-tracks"), ref, keys, "_c", "ref_bpm").drop("_c"), "study-referenced")
    results = []
    for width in sorted({g["smooth"] for g in grid}):
        ids = [i for i, g in enumerate(grid) if g["smooth"] == width]
        t = tr.filter(F.col("trial").isin(ids))
        t = w.moving_median(t, {"hf": "hf", "fft": "fft"}, width, keys)
        t = materialise(w.fuse_v1(t.withColumn("m", F.col("motion").cast("int")), "hf", "fft", "m", "final", keys), "study-fused")
        for mode in sorted({grid[i]["mode"] for i in ids} & {"post_motion_slew", "post_recovery_blend"}):
            mine = [i for i in ids if grid[i]["mode"] == mode]
            part, rest = t.filter(F.col("trial").isin(mine)), t.filter(~F.col("trial").isin(mine))
            if mode == "post_motion_slew":
                adj = None  # every trial by its own step
                for step in sorted({grid[i]["step_bpm"] for i in mine}):
                    own = part.filter(F.col("trial").isin([i for i in mine if grid[i]["step_bpm"] == step]))
                    one = post_motion_slew(own, "fft", F.col("motion"), step / 60.0 or 0.5 / 60.0, max(1, width), keys)
                    adj = one if adj is None else adj.unionByName(one)
            else:
                adj = post_recovery_blend(part, "fft", F.col("motion"), keys=keys)
            part = part.drop("fft").join(adj.select(*keys, "window_idx", "fft"), [*keys, "window_idx"])
            part = part.withColumn("final", F.when(F.col("motion"), F.col("final")).otherwise(F.col("fft")))
            t = rest.unionByName(part.select(rest.columns))
        t = materialise(t.withColumns({"final": F.col("final") * 60, "fft": F.col("fft") * 60}), "study-final")
        t = materialise(w.segment_labels(t, F.col("motion"), keys), "study-labels")
        results.append(st.time_bias_scan(t, "final", "fft", "ref_bpm", "reliable_i", biases, keys))
    out = results[0]
    for x in results[1:]:
        out = out.unionByName(x)
    names = F.array(*[F.lit(g["mode"]) for g in grid])
    accepted = (F.col("rest_all_mae") < 1.5) & (F.col("pre_rest_mae") < 1.5) & (F.col("post_rest_mae") < 1.5)
    return out.withColumn("mode", F.get(names, F.col("trial"))).withColumn("accepted", F.coalesce(accepted, F.lit(False)))


# ---------------------------------------------------------------- E9, E10
def multi_motion_fusion(samples: DataFrame, ref: DataFrame, shares: DataFrame, experts: dict[str, HrParams]) -> tuple[DataFrame, DataFrame]:
    """One estimate per expert parameter set, mixed by class probability per window. Experts share what their settings don't change.

    ``shares``: recording, window_idx, class, p. Classes without an estimate are left out and the
    rest renormalised. Returns the mixed windows and the errors of mixed, uniform and each expert.
    """
    name = F.element_at(F.array(*map(F.lit, experts)), F.col("trial") + 1)
    each = reduce(DataFrame.unionByName, [r.windows for r in swept(samples, ref, list(experts.values()), ["fusion_hf"], ["hf"])])
    parts = materialise(each.select("recording", "window_idx", "motion", "ref", F.col("fusion_hf").alias("hr"), name.alias("class")), "experts")
    mixed = weighted_rate(parts, shares)
    single = parts.groupBy("recording", "window_idx").pivot("class", list(experts)).agg(F.first("hr"))
    wide = mixed.join(single, ["recording", "window_idx"]).withColumn("reliable_i", F.lit(1))
    methods = ["weighted", "uniform", *experts]
    err = st.error_stats(wide.withColumns({m: F.col(m) * 60 for m in methods}).withColumn("_r", F.col("ref") * 60), methods, "_r", "motion", "reliable_i")
    return wide.drop("reliable_i"), err


def weighted_rate(parts: DataFrame, shares: DataFrame) -> DataFrame:
    """Sum of p * hr over the classes present, and their plain mean."""
    j = parts.join(shares, ["recording", "window_idx", "class"], "left").withColumn("p", F.greatest(F.lit(0.0), F.coalesce("p", F.lit(0.0))))
    g = j.groupBy("recording", "window_idx").agg(
        F.first("ref").alias("ref"), F.first("motion").alias("motion"), F.avg("hr").alias("uniform"), F.sum("p").alias("_p"), F.sum(F.col("p") * F.col("hr")).alias("_w"),
    )
    return g.withColumn("weighted", F.when(F.col("_p") > 0, F.col("_w") / F.col("_p")).otherwise(F.col("uniform"))).drop("_p", "_w")


def expert_spectrum_fusion(samples: DataFrame, shares: DataFrame, experts: dict[str, HrParams], base: HrParams, nfft: int = 8192) -> DataFrame:
    """K filter passes per motion window, spectra mixed by class weight, then penalty, peaks and tracking.

    ``shares``: recording, window_idx and one weight column ``w_<expert>`` per expert.
    """
    keys = ["recording"]
    refs = ["ut1", "ut2"]
    cols = ["ppg", *refs, *ACC]
    src = samples.withColumn("ppg", F.col(base.ppg_mode))
    cond = condition(src, cols, base, keys)
    flags = source_motion(src, cond, base, keys)
    weighted = flags.join(shares, ["recording", "window_idx"], "left").fillna(1.0 / len(experts), [f"w_{e}" for e in experts])
    plan = window_plan(cond, weighted, base, keys)
    out, win, pad = hr_windows(cond, [*refs, *ACC], base, keys, plan)
    hz = base.fs_target / nfft
    spec = sg.amplitude_spectrum(nfft, int(4.0 / hz) + 2)  # candidates lie below 4 Hz
    out = with_lags(out, "ppg", refs, pad, win, F.col("motion"))
    out = window_delays(out, "ppg", refs, pad, win, {c: 0 for c in refs}, max(p.max_order for p in experts.values()), lead=1, active=F.col("motion"), ready=True)
    # a window is filtered and transformed again only for experts that give it another filter or number of taps
    done: list[tuple[tuple, int, str]] = []
    for e, p in sorted(experts.items(), key=lambda x: -x[1].max_order):
        how = (p.adaptive_filter, p.mu_base, tuple(sorted(p.opts().items())))
        same = next(((o, s) for h, o, s in done if h == how), None)
        needed = F.col("motion") if same is None else F.col("motion") & (F.least("m", F.lit(same[0])) > p.max_order)
        res = sg.cascade(p.adaptive_filter, p.mu_base, **p.opts())(F.when(needed, _core("ppg", win, padded=False)), *[F.when(needed, F.col(f"stages.{c}")) for c in ("signal", "corr", "k")], F.least("m", F.lit(p.max_order)))
        out = out.withColumn(f"o_{e}", spec(res))
        out = out.withColumn(f"s_{e}", F.col(f"o_{e}") if same is None else F.when(needed, F.col(f"o_{e}")).otherwise(F.col(same[1])))
        done.insert(0, (how, p.max_order, f"s_{e}"))
    out = sg.fuse_spectra(out, [f"s_{e}" for e in experts], [F.col(f"w_{e}") for e in experts], keys)
    # motion frequency of the best reference channel, shared by all experts
    ref_peak = sg.peak_frequencies(base.fs_target, penalise=False)(F.get("stages.signal", F.lit(0)), F.lit(None).cast("array<double>"))
    out = out.withColumn("_mf", F.get(ref_peak, F.lit(0)))
    mixed = F.when(F.col("motion"), F.col("fused"))
    out = out.withColumn("f_hf", sg.band_candidates(hz, weight=base.penalty_weight, width=base.penalty_width)(mixed, "_mf"))
    out = out.withColumn("f_fft", fft_candidates(out, win, base))
    table = out.select("recording", "window_idx", "motion", "f_fft", "f_hf")
    tr = track_paths(table, keys, ["hf"], "motion", tracking_columns(base))
    return tr.select("recording", "window_idx", "motion", (F.col("fft") * 60).alias("fft_bpm"), F.when(F.col("motion"), F.col("hf") * 60).otherwise(F.col("fft") * 60).alias("fused_bpm"))


# ---------------------------------------------------------------- E11
def re_evaluate(samples: DataFrame, ref: DataFrame, reports: DataFrame, base: HrParams) -> tuple[DataFrame, DataFrame]:
    """Recompute each case (HF_best, ACC_best) with all its stored parameters.

    ``reports``: recording, case_name and any fields of HrParams (NULL = default; tracking fields also under
    their column names). The distinct settings of the other fields reach the driver, which runs each one on
    the recordings that have it; tracking fields override the defaults per row (J13).
    """
    keys = ["recording", "case_name"]
    par = tracking_columns(base)
    own = dict(zip(par, ("hr_range_rest", "slew_limit_rest", "slew_step_rest", "hr_range_hz", "slew_limit_bpm", "slew_step_bpm"), strict=True))
    has = lambda n: F.col(n) if n in reports.columns else F.lit(None)
    other = [f.name for f in fields(HrParams) if f.name in reports.columns and f.name not in _TRACKING and f.name not in ("options", "reference_groups")]
    rep = materialise(reports.select(*keys, *other, *[F.coalesce(has(n), has(own[n]), par[n]).cast("double").alias(f"_{n}") for n in par]), "reports")
    windows, errors = [], []
    for told in [r.asDict() for r in rep.select(*other).distinct().collect()] if other else [{}]:
        p = replace(base, **{n: type(getattr(base, n))(v) for n, v in told.items() if v is not None})
        mine = rep
        for n, v in told.items():
            mine = mine.filter(F.col(n).eqNullSafe(F.lit(v)))
        mine = mine.select(*keys, *[F.col(f"_{n}").alias(n) for n in par])
        some = samples
        if told:
            asked = mine.select("recording").distinct().withColumn("_in", F.lit(True))
            some = join_group(samples, asked, ["recording"], chunk_col("sample_idx", CHUNK), "inner").drop("_in")
        table = materialise(join_cases(materialise(peak_table_dual(some, p, ["recording"]), "candidates"), mine), "cases")
        done = finish_dual(track_paths(table, keys, ["hf", "acc"], "motion", {n: F.col(n) for n in par}), some, ref, p, keys)
        windows.append(done.windows)
        errors.append(done.errors)
    return HrResult(reduce(DataFrame.unionByName, windows), reduce(DataFrame.unionByName, errors))


def join_cases(peaks: DataFrame, rep: DataFrame) -> DataFrame:
    """All cases of a recording as one small array, attached through chunks and expanded."""
    cols = [c for c in rep.columns if c != "recording"]
    packed = rep.groupBy("recording").agg(F.collect_list(F.struct(*cols)).alias("_cases"))
    out = join_group(peaks, packed, ["recording"], chunk_col("window_idx", CHUNK), "inner")
    return out.withColumn("_c", F.explode("_cases")).select("recording", "window_idx", "motion", "f_fft", "f_hf", "f_acc", "_c.*")
