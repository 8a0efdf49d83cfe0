"""Sliding windows, motion flags, segments and fusion over window tables.

Window statistics are built from per-second slots (map-side combined), so the shuffle
carries slots, not eight copies of every sample. Window arrays are cut out of bounded
frames of many windows, which duplicates about one sample in ten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wristwave.operators.chunked import (
    CHUNK, Carry, carried, chunk_col, join_group, longest_run, rolling, with_totals,
)

KEYS = ["recording"]
IDX = "sample_idx"
BLOCK = 64  # windows per frame


# ---------------------------------------------------------------- statistics by slot
def window_moments(
    df: DataFrame, cols: dict[str, Column], win: int, step: int, start: int = 0, keys=KEYS, order=IDX
) -> DataFrame:
    """keys, window_idx, ``<c>_n/_mean/_m2`` of every full window; ``win`` a multiple of ``step``."""
    if win % step:
        raise ValueError("window length must be a multiple of the step")
    k = win // step
    first = next(iter(cols))
    aggs = []
    for n, c in cols.items():
        aggs += [F.count(c).cast("double").alias(f"{n}_n"), F.avg(c).alias(f"{n}_mean"), (F.var_pop(c) * F.count(c)).alias(f"{n}_m2")]
    slots = (
        df.filter(F.col(order) >= start)
        .withColumn("_slot", F.floor((F.col(order) - start) / F.lit(step)).cast("bigint"))
        .groupBy(*keys, "_slot").agg(F.count("*").alias("_rows"), *aggs)
    )
    spread = slots.withColumn(
        "window_idx", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_slot") - (k - 1)), F.col("_slot")))
    )
    merged = []
    for n in cols:
        cnt, mean, m2 = F.col(f"{n}_n"), F.col(f"{n}_mean"), F.col(f"{n}_m2")
        tot = F.sum(cnt)
        mu = F.sum(cnt * mean) / tot
        merged += [
            tot.alias(f"{n}_n"), mu.alias(f"{n}_mean"),
            F.greatest(F.lit(0.0), F.sum(m2 + cnt * mean * mean) - tot * mu * mu).alias(f"{n}_m2"),
        ]
    out = spread.groupBy(*keys, "window_idx").agg(F.sum("_rows").alias("_rows"), *merged)
    return out.filter(F.col("_rows") == win).drop("_rows")


def sample_std(name: str) -> Column:
    return F.sqrt(F.col(f"{name}_m2") / (F.col(f"{name}_n") - 1))


def population_std(name: str) -> Column:
    return F.sqrt(F.col(f"{name}_m2") / F.col(f"{name}_n"))


# ---------------------------------------------------------------- arrays by frame
def frames(
    df: DataFrame, cols: list[str], win: int, step: int, start: int = 0, pad: int = 0, keys=KEYS, order=IDX, block: int = BLOCK
) -> DataFrame:
    """Bounded runs of samples holding ``block`` windows (and ``pad`` samples each side)."""
    span = block * step
    shifted = F.col(order) - start
    lo = F.greatest(F.lit(0), F.floor((shifted - (win - step) - pad) / F.lit(span)).cast("bigint"))
    hi = F.floor((shifted + pad) / F.lit(span)).cast("bigint")
    packed = F.struct(F.col(order).alias("_i"), *cols)
    rows = (
        df.select(*keys, order, *cols)
        .filter(shifted >= -pad)
        .withColumn("_block", F.explode(F.sequence(lo, hi)))
        .groupBy(*keys, "_block")
        .agg(F.sort_array(F.collect_list(packed)).alias("_r"))
    )
    return rows.select(
        *keys, "_block", F.element_at("_r", 1)["_i"].alias("_first"), F.size("_r").alias("_len"),
        *[F.col("_r")[c].alias(c) for c in cols],
    )


def window_arrays(
    df: DataFrame, cols: list[str], win: int, step: int, start: int = 0, pad: int = 0, padded: tuple[str, ...] = (),
    keys=KEYS, order=IDX, block: int = BLOCK, plan: DataFrame | None = None,
) -> DataFrame:
    """keys, window_idx, start_idx and one array per column for every full window.

    Columns in ``padded`` also carry up to ``pad`` samples on both sides; ``pad_left``
    tells how many of them precede the window. ``plan``: the windows that are wanted, with columns of their own (keys,
    window_idx, ...). It meets the frames, of which there is one for ``block`` windows, so no window array is shuffled.
    """
    fr = frames(df, cols, win, step, start, pad, keys, order, block)
    own = []
    if plan is None:
        wins = fr.withColumn("_w", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
        wins = wins.withColumn("window_idx", F.col("_block") * block + F.col("_w"))
    else:
        own = [c for c in plan.columns if c not in (*keys, "window_idx")]
        wanted = plan.groupBy(*keys, chunk_col("window_idx", block).alias("_block")).agg(F.collect_list(F.struct("window_idx", *own)).alias("_wanted"))
        wins = fr.join(wanted, [*keys, "_block"]).withColumn("_p", F.explode("_wanted")).drop("_wanted")
        wins = wins.withColumns({c: F.col("_p")[c] for c in ("window_idx", *own)}).drop("_p")
    wins = wins.withColumn("start_idx", F.col("window_idx") * step + start)
    at = (F.col("start_idx") - F.col("_first")).cast("int")
    wins = wins.withColumn("_at", at).filter((F.col("_at") >= 0) & (F.col("_at") + win <= F.col("_len")))
    left = F.least(F.lit(pad), F.col("_at"))
    out = []
    for c in cols:
        if c in padded:
            right = F.least(F.lit(pad), F.col("_len") - F.col("_at") - win)
            out.append(F.slice(c, F.col("_at") - left + 1, left + win + right).alias(c))
        else:
            out.append(F.slice(c, F.col("_at") + 1, F.lit(win)).alias(c))
    extra = [left.alias("pad_left")] if pad else []
    return wins.select(*keys, "window_idx", "start_idx", *extra, *out, *own)


def clip_to_buffer(windows: DataFrame, samples: DataFrame, win: int, fs: int, buffer_s: float, keys=KEYS) -> DataFrame:
    """W1 stop rule: a window may not start later than recording length - buffer (the first always counts)."""
    lengths = samples.groupBy(*keys).agg((F.max(IDX) + 1).alias("_n"))
    out = join_group(windows, lengths, keys, chunk_col("window_idx", CHUNK))
    keep = (F.col("window_idx") == 0) | (F.col("start_idx") <= F.col("_n") - int(round(buffer_s * fs)))
    return out.filter(keep).drop("_n")


def window_times(windows: DataFrame, win: int, fs: int) -> DataFrame:
    s = F.col("start_idx") / fs
    return windows.withColumns({"start_s": s, "center_s": s + win / fs / 2, "end_s": s + win / fs})


# ---------------------------------------------------------------- motion flags
def baseline_std(df: DataFrame, cols: dict[str, Column], calib: int, keys=KEYS, order=IDX) -> DataFrame:
    """Sample sd of the first ``calib`` samples per recording (bounded rows per group)."""
    head = df.filter(F.col(order) < calib)
    return head.groupBy(*keys).agg(*[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{n}_base") for n, c in cols.items()])


def motion_flags(
    df: DataFrame, mag: Column, win: int, step: int, calib: int, scale: float, start: int = 0,
    relative_floor: float = 0.0, keys=KEYS,
) -> DataFrame:
    """W5 (``relative_floor`` 0) and W6: window sd above max(scale * baseline, floor * max sd)."""
    wins = window_moments(df, {"mag": mag}, win, step, start, keys).withColumn("std", sample_std("mag"))
    base = baseline_std(df, {"mag": mag}, calib, keys)
    if relative_floor:
        base = base.join(wins.groupBy(*keys).agg(F.max("std").alias("_mx")), keys)
        th = F.greatest(F.col("mag_base") * scale, F.col("_mx") * relative_floor)
    else:
        th = F.col("mag_base") * scale
    base = base.select(*keys, th.alias("threshold"))
    out = join_group(wins.select(*keys, "window_idx", "std"), base, keys, chunk_col("window_idx", CHUNK))
    return out.withColumn("motion", F.col("std") > F.col("threshold"))


def motion_flags_two(df: DataFrame, acc: Column, gyro: Column, win: int, step: int, calib: int, scale: float, keys=KEYS) -> DataFrame:
    """The larger of the two sd ratios to baseline."""
    cols = {"acc": acc, "gyro": gyro}
    wins = window_moments(df, cols, win, step, keys=keys)
    wins = wins.select(*keys, "window_idx", sample_std("acc").alias("acc_std"), sample_std("gyro").alias("gyro_std"))
    out = join_group(wins, baseline_std(df, cols, calib, keys), keys, chunk_col("window_idx", CHUNK))
    ratio = F.greatest(F.try_divide("acc_std", "acc_base"), F.try_divide("gyro_std", "gyro_base"))
    return out.withColumn("ratio", ratio).withColumn("motion", F.coalesce(ratio > scale, F.lit(False)))


def motion_segment(df: DataFrame, mag: Column, win: int, step: int, calib: int, scale: float, fs: int, keys=KEYS) -> DataFrame:
    """The minimum slice: longest motion run per recording, with window counts; left-joined so that
    every recording has a row."""
    flags = motion_flags(df, mag, win, step, calib, scale, keys=keys)
    run = longest_run(flags, keys, "window_idx", F.col("motion"))
    every = flags.groupBy(*keys).agg(F.count("*").alias("windows"), F.count_if("motion").alias("motion_windows"))
    half = win / fs / 2
    return every.join(run, keys, "left").select(
        *keys, "windows", "motion_windows", F.col("run_start").alias("first_window"), F.col("run_end").alias("last_window"),
        (F.col("run_start") * (step / fs) + half).alias("start_s"), (F.col("run_end") * (step / fs) + half).alias("end_s"),
    )


# ---------------------------------------------------------------- window quality
def window_quality(
    df: DataFrame, valid: Column, win: int, step: int, fs: int, start: int = 0, max_ratio: float = 0.20, max_gap_s: float = 1.0, keys=KEYS
) -> DataFrame:
    """Missing count and ratio, longest missing run, reliable flag."""
    marked = df.withColumn("_v", F.when(valid, "1").otherwise("0"))
    wins = window_arrays(marked, ["_v"], win, step, start, keys=keys)
    text = F.array_join("_v", "")
    out = wins.select(*keys, "window_idx", text.alias("_t"))
    gap_limit = int(round(max_gap_s * fs))
    out = out.select(
        *keys, "window_idx",
        F.length(F.replace("_t", F.lit("1"))).alias("missing_count"),
        F.array_max(F.transform(F.split("_t", "1"), F.length)).alias("max_gap"),
    )
    ratio = F.col("missing_count") / win
    return out.withColumns({
        "missing_ratio": ratio,
        "reliable": (ratio <= max_ratio) & (F.col("max_gap") <= gap_limit),
    })


# ---------------------------------------------------------------- moving frames
def moving_median(df, cols: dict[str, str], width: int, keys=KEYS, order="window_idx") -> DataFrame:
    """``{out: in}``, centred, shrinking ends (even widths reach further back)."""
    p = {o: (lambda c: lambda w: F.percentile(F.col(c), 0.5).over(w.frame))(i) for o, i in cols.items()}
    if width <= 1:
        return df.withColumns({o: F.col(i).cast("double") for o, i in cols.items()})
    return rolling(df, keys, order, [p], width // 2, (width - 1) // 2)


def moving_mean(df, cols: dict[str, str], width: int, keys=KEYS, order="window_idx") -> DataFrame:
    """Centred mean of the values present."""
    half = width // 2
    p = {o: (lambda c: lambda w: F.avg(F.col(c)).over(w.frame))(i) for o, i in cols.items()}
    return rolling(df, keys, order, [p], half, half)


def moving_average_same(df, cols: dict[str, str], width: int, keys=KEYS, order=IDX) -> DataFrame:
    """Zero-padded convolution with a box; recordings shorter than the box stay as they are."""
    p = {o: (lambda c: lambda w: F.sum(F.col(c)).over(w.frame) / width)(i) for o, i in cols.items()}
    sized = with_totals(df, keys, chunk_col(order, CHUNK), {"_n": F.count("*")}, {"_n": F.sum("_n")})
    out = rolling(sized, keys, order, [p], width // 2, (width - 1) // 2)
    return out.withColumns({o: F.when(F.col("_n") < width, F.col(i)).otherwise(F.col(o)) for o, i in cols.items()}).drop("_n")


def transition(df, flag: Column, keys=KEYS, order="window_idx") -> DataFrame:
    """Rest -> motion; the first row counts when it is in motion."""
    base = df.withColumn("_f", flag)
    p = {"_prev": lambda w: F.lag("_f").over(w.ordered)}
    out = rolling(base, keys, order, [p], 1, 0)
    return out.withColumn("enters", F.col("_f") & ~F.coalesce(F.col("_prev"), F.lit(False))).drop("_f", "_prev")


def onset(df, flag: Column, seconds_per_state: float = 8.0, default_s: float = 30.0, keys=KEYS, order="window_idx") -> DataFrame:
    """First five rest states followed by five motion states; segment +10 .. +25 s."""
    base = df.withColumn("_f", flag.cast("int"))
    p = {
        "_a": lambda w: F.sum("_f").over(w.ordered.rowsBetween(0, 4)),
        "_b": lambda w: F.sum("_f").over(w.ordered.rowsBetween(5, 9)),
        "_n": lambda w: F.count("_f").over(w.ordered.rowsBetween(0, 9)),
    }
    hit = (F.col("_a") == 0) & (F.col("_b") == 5) & (F.col("_n") == 10)
    out = rolling(base, keys, order, [p], 0, 9)
    first = out.groupBy(*keys).agg(F.min(F.when(hit, F.col(order) + 5)).alias("onset_idx"))
    t = F.coalesce(F.col("onset_idx") * seconds_per_state, F.lit(default_s))
    return first.withColumns({"onset_s": t, "segment_start_s": t + 10, "segment_end_s": t + 25})


def overlap_add(windows: DataFrame, original: DataFrame, col: str, out: str, keys=KEYS, order=IDX) -> DataFrame:
    """Mean of overlapping window arrays per sample; uncovered samples keep the original."""
    flat = windows.select(*keys, "start_idx", F.posexplode(col).alias("_p", "_y"))
    flat = flat.select(*keys, (F.col("start_idx") + F.col("_p")).alias(order), "_y")
    mean = flat.groupBy(*keys, order).agg(F.avg("_y").alias(out))
    return original.join(mean, [*keys, order], "left").withColumn(out, F.coalesce(out, col))


# ---------------------------------------------------------------- segments and scope
def segment_labels(df, flag: Column, keys=KEYS, order="window_idx") -> DataFrame:
    """Motion / other_motion / pre_rest / post_rest around the longest run."""
    base = df.withColumn("_f", flag)
    run = longest_run(base, keys, order, F.col("_f")).select(*keys, "run_start", "run_end")
    out = join_group(base, run, keys, chunk_col(order, CHUNK))
    i = F.col(order)
    label = (
        F.when(F.col("run_start").isNull(), "pre_rest")
        .when((i >= F.col("run_start")) & (i <= F.col("run_end")), "motion")
        .when(F.col("_f"), "other_motion").when(i < F.col("run_start"), "pre_rest").otherwise("post_rest")
    )
    return out.withColumn("segment", label).drop("_f", "run_start", "run_end")


def analysis_scope(df, motion: str, time: str, pre_s: float = 30.0, clear_flags: bool = True, keys=KEYS, order="window_idx") -> DataFrame:
    """P12 (``clear_flags``) and P13: from ``pre_s`` before the longest run to its end."""
    run = longest_run(df, keys, order, F.col(motion) == 1).select(*keys, "run_start", "run_end")
    bounds = df.groupBy(*keys).agg(F.min_by(time, order).alias("_t0"))
    # run edges are few per recording: read their times by an equi-join on the order key
    edge = df.select(*keys, F.col(order).alias("run_start"), F.col(time).alias("_ts"))
    last = df.select(*keys, F.col(order).alias("run_end"), F.col(time).alias("_te"))
    run = run.join(edge, [*keys, "run_start"]).join(last, [*keys, "run_end"]).select(*keys, "_ts", "_te")
    run = bounds.join(run, keys, "left")
    out = join_group(df, run, keys, chunk_col(order, CHUNK))
    t, eps = F.col(time), 1e-9
    lo = F.greatest(F.col("_t0"), F.col("_ts") - pre_s)
    inside = F.col("_ts").isNull() | ((t >= lo - eps) & (t <= F.col("_te") + eps))
    out = out.filter(inside)
    if clear_flags:
        keep = F.col("_ts").isNull() | (t >= F.col("_ts") - eps)
        out = out.withColumn(motion, F.when(keep, F.col(motion)).otherwise(F.lit(0)))
    return out.drop("_t0", "_ts", "_te")


def recovery(df, adaptive: str, fft: str, run: DataFrame, trigger_bpm: float = 20.0, tail: int = 5, keys=KEYS, order="window_idx") -> DataFrame:
    """W17, W18 per recording: does the adaptive curve overshoot at the end of motion, and where
    does FFT catch up. ``run`` holds ``end_idx`` (last window at or before the motion end)."""
    out = join_group(df, run, keys, chunk_col(order, CHUNK), "inner")
    i = F.col(order)
    in_tail = (i > F.col("end_idx") - tail) & (i <= F.col("end_idx"))
    caught = (i > F.col("end_idx")) & (F.col(fft) >= F.col(adaptive))
    g = out.groupBy(*keys).agg(
        (F.avg(F.when(in_tail, F.col(adaptive))) - F.avg(F.when(in_tail, F.col(fft)))).alias("overshoot"),
        F.coalesce(F.min(F.when(caught, i)), F.max(i)).alias("crossover_idx"),
    )
    return g.withColumn("recovers", F.coalesce(F.col("overshoot") > trigger_bpm, F.lit(False)))


def fuse_v2(df, adaptive: str, fft: str, segment: DataFrame, time: str, post_s: float = 10.0, trigger_bpm: float = 20.0, keys=KEYS, order="window_idx") -> DataFrame:
    """Adaptive between the segment start and the crossover (or end + ``post_s``), else FFT, median of 3.
    ``segment``: start_s, end_s per recording (recordings without one use FFT)."""
    chunk = chunk_col(order, CHUNK)
    with_seg = join_group(df, segment.select(*keys, "start_s", "end_s"), keys, chunk)
    i, t, eps = F.col(order), F.col(time), 1e-9
    edges = with_seg.filter(F.col("start_s").isNotNull()).groupBy(*keys).agg(
        F.coalesce(F.max(F.when(t <= F.col("start_s") + eps, i)), F.lit(0)).alias("first_idx"),
        F.max(F.when(t <= F.col("end_s") + eps, i)).alias("end_idx"),
        F.max(F.when(t <= F.col("end_s") + post_s + eps, i)).alias("late_idx"),
    )
    rec = recovery(df, adaptive, fft, edges.filter(F.col("end_idx").isNotNull()).select(*keys, "end_idx"), trigger_bpm, keys=keys, order=order)
    stop = F.when(F.coalesce(F.col("recovers"), F.lit(False)), F.col("crossover_idx")).otherwise(F.col("late_idx"))
    plan = edges.join(rec, keys, "left").select(*keys, "first_idx", stop.alias("stop_idx"))
    out = join_group(df, plan, keys, chunk)
    used = F.coalesce((i >= F.col("first_idx")) & (i <= F.col("stop_idx")), F.lit(False))
    out = out.withColumn("used_adaptive", used).withColumn("_mix", F.when(F.col("used_adaptive"), F.col(adaptive)).otherwise(F.col(fft)))
    smooth = moving_median(out, {"_med": "_mix"}, 3, keys, order)
    final = F.when(F.col("first_idx").isNull(), F.col(fft)).otherwise(F.col("_med"))
    return smooth.withColumn("final", final).drop("_mix", "_med", "first_idx", "stop_idx")


def fuse_v1(df, adaptive: str, fft: str, motion: str, out: str, keys=KEYS, order="window_idx") -> DataFrame:
    """W20"""
    mixed = df.withColumn("_mix", F.when(F.col(motion) == 1, F.col(adaptive)).otherwise(F.col(fft)))
    return moving_median(mixed, {out: "_mix"}, 3, keys, order).drop("_mix")


def rest_policy(df, threshold: float = 0.02) -> DataFrame:
    """Rest windows take the raw values and recompute ``reliable``."""
    applied = F.coalesce(F.col("motion_score") > threshold, F.lit(False))
    pick = lambda a, b: F.when(applied, F.col(a)).otherwise(F.col(b))
    return df.withColumns({
        "adaptive_applied": applied,
        "spo2": pick("adaptive_spo2", "raw_spo2"),
        "adaptive_spo2": pick("adaptive_spo2", "raw_spo2"),
        "adaptive_r_median": pick("adaptive_r_median", "raw_r_median"),
        "adaptive_valid_beat_count": pick("adaptive_valid_beat_count", "raw_valid_beat_count"),
        "adaptive_carried_forward": pick("adaptive_carried_forward", "raw_carried_forward"),
        "reliable": F.when(applied, F.col("reliable")).otherwise(
            (F.col("missing_ratio") <= 0.20) & (F.col("raw_valid_beat_count") > 0)
        ),
    })


def running_best(df, value: str, order: str, outer: list[str], inner: list[str], size: float = CHUNK) -> DataFrame:
    """Best so far within the repeat and over the whole study."""
    chunk = chunk_col(order, size)
    out = carried(df, inner, [order], chunk, [Carry("best_in_repeat", F.col(value), "min")])
    return carried(out, outer, [order], chunk, [Carry("best_overall", F.col(value), "min")])


def positions(df, keys: list[str], order: str, out: str, size: float = CHUNK) -> DataFrame:
    """0-based rank of the rows of a filtered table, through per-chunk counts."""
    ranked = carried(df, keys, [order], chunk_col(order, size), [Carry(out, F.lit(1), "sum", exclusive=True)])
    return ranked.withColumn(out, F.col(out).cast("bigint"))


def evenly_spaced(df, n: int, keys=KEYS, order="window_idx") -> DataFrame:
    """The rows at round-half-even(linspace(0, rows - 1, n)); all rows when there are at most n."""
    sized = with_totals(df, keys, chunk_col(order, CHUNK), {"_n": F.count("*")}, {"_n": F.sum("_n")})
    ranked = positions(sized, keys, order, "_pos")
    picks = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.bround(k * ((F.col("_n") - 1) / F.lit(max(n - 1, 1)))).cast("bigint")
    )
    return ranked.filter((F.col("_n") <= n) | F.array_contains(picks, F.col("_pos"))).drop("_n", "_pos")


def exemplar_windows(df, motion: Column, score: str, n: int = 4, keys=KEYS, order="window_idx") -> DataFrame:
    """Last rest window before motion, ``n`` motion windows, first rest window after."""
    base = df.withColumn("_f", motion)
    bounds = base.groupBy(*keys).agg(
        F.min(F.when(F.col("_f"), F.col(order))).alias("_a"), F.max(F.when(F.col("_f"), F.col(order))).alias("_b"),
        F.min_by(order, F.struct(score, order)).alias("_calm"),
    )
    out = join_group(base, bounds, keys, chunk_col(order, CHUNK))
    i = F.col(order)
    rest = out.filter(~F.col("_f"))
    pre = rest.filter(i < F.col("_a")).groupBy(*keys).agg(F.max(order).alias(order)).withColumn("part", F.lit("pre_rest"))
    post = rest.filter(i > F.col("_b")).groupBy(*keys).agg(F.min(order).alias(order)).withColumn("part", F.lit("post_rest"))
    calm = bounds.filter("_a is null").select(*keys, F.col("_calm").alias(order), F.lit("pre_rest").alias("part"))
    mot = evenly_spaced(out.filter("_f").select(*keys, order), n, keys, order).withColumn("part", F.lit("motion"))
    return pre.unionByName(post).unionByName(calm).unionByName(mot)
