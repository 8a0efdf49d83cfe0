"""Gap filling and outlier repair over (recording, sample_idx) tables.

All fills read the nearest valid neighbours through per-chunk carries, so a recording of
any length is cleaned by many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wristwave.functions.scalars import bridge_ratio, drop_negative, numeric
from wristwave.operators.chunked import CHUNK, Carry, carried, chunk_col, exact_percentiles, with_halo, with_totals
from wristwave.session import materialise

KEYS = ["recording"]
IDX = "sample_idx"
#: Samples of a recording that are judged for outliers together.
FRAME = 4096


def neighbours(
    df: DataFrame, cols: dict[str, Column], keys=KEYS, order: str = IDX, size: float = CHUNK
) -> DataFrame:
    """For each name add ``<name>_p`` / ``<name>_n``: nearest valid (i, v) at or before / after."""
    specs = []
    for name, c in cols.items():
        pair = F.when(c.isNotNull(), F.struct(F.col(order).alias("i"), c.alias("v")))
        specs += [Carry(f"{name}_p", pair, "last"), Carry(f"{name}_n", pair, "first")]
    return carried(df, keys, [order], chunk_col(order, size), specs)


def nearest_of(c: Column, order: Column, p: Column, n: Column) -> Column:
    """Nearest neighbour; a tie takes the next one."""
    take_next = p.isNull() | (n.isNotNull() & ((n["i"] - order) <= (order - p["i"])))
    return F.coalesce(c, F.when(take_next, n["v"]).otherwise(p["v"]))


def linear_of(c: Column, order: Column, p: Column, n: Column) -> Column:
    w = (order - p["i"]) / (n["i"] - p["i"])
    return F.coalesce(c, p["v"] + (n["v"] - p["v"]) * w)


def _fill(df: DataFrame, exprs: dict[str, Column], rule, keys, order, size) -> DataFrame:
    temp = df.withColumns({f"_f_{n}": c for n, c in exprs.items()})
    near = neighbours(temp, {f"_f_{n}": F.col(f"_f_{n}") for n in exprs}, keys, order, size)
    out = near.withColumns(
        {n: rule(F.col(f"_f_{n}"), F.col(order), F.col(f"_f_{n}_p"), F.col(f"_f_{n}_n")) for n in exprs}
    )
    return out.drop(*[f"_f_{n}{s}" for n in exprs for s in ("", "_p", "_n")])


def fill_nearest(df, exprs, keys=KEYS, order=IDX, size=CHUNK):
    """C1"""
    return _fill(df, exprs, nearest_of, keys, order, size)


def fill_linear(df, exprs, keys=KEYS, order=IDX, size=CHUNK):
    """Interior gaps only."""
    return _fill(df, exprs, linear_of, keys, order, size)


def fill_linear_nearest(df, exprs, keys=KEYS, order=IDX, size=CHUNK):
    """C2 then C1 in one pass: interior gaps linear, edges held."""
    rule = lambda c, o, p, n: F.coalesce(linear_of(c, o, p, n), nearest_of(c, o, p, n))
    return _fill(df, exprs, rule, keys, order, size)


def outliers(before: int, after: int, threshold: float):
    """Array of a frame's samples -> which of them lie more than ``threshold`` * 1.4826 * MAD from the moving median.

    Both medians come from sorted windows of the whole frame at once; missing samples and those beyond an end of the
    recording are left out of them.
    """

    def medians(x: np.ndarray) -> np.ndarray:
        wide = np.full(len(x) + before + after, np.inf)
        wide[before : before + len(x)] = np.where(np.isnan(x), np.inf, x)
        rows = np.sort(np.lib.stride_tricks.sliding_window_view(wide, before + after + 1), axis=1)
        n = np.isfinite(rows).sum(axis=1)
        at = np.arange(len(x))
        low, high = rows[at, np.maximum(n - 1, 0) // 2], rows[at, np.minimum(n // 2, before + after)]
        return np.where(n > 0, 0.5 * low + 0.5 * high, np.nan)

    @F.pandas_udf("array<boolean>")
    def run(frames: pd.Series) -> pd.Series:
        out = []
        for f in frames:
            x = np.asarray(f, dtype=np.float64)
            with np.errstate(invalid="ignore"):
                d = np.abs(x - medians(x))
                mad = medians(d) * 1.4826
                out.append((mad > 0) & (d > mad * threshold))
        return pd.Series(out)

    return run


def moving_median_outliers(df, cols: list[str], window: int, threshold: float = 3.0, keys=KEYS, order=IDX) -> DataFrame:
    """|x - med| > threshold * 1.4826 * MAD over a centred frame, then refill; ``<col>_replaced`` marks them.

    Frames of samples with as many neighbours on both sides as two windows reach carry all columns as arrays, so every
    channel is judged in one pass over Arrow batches.
    """
    before, after = window // 2, (window - 1) // 2
    bad = outliers(before, after, threshold)
    every = [order, *[c for c in df.columns if c not in (*keys, order)]]
    packed = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(every)])
    frames = (
        with_halo(df, order, FRAME, 2 * before, 2 * after).withColumn("_p", F.struct(packed.alias("v"), F.col("_core").alias("core")))
        .groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list("_p")).alias("_r"), F.max("_core").alias("_any")).filter("_any")
    )
    channel = lambda c: F.col("_r.v")[f"_{every.index(c)}"].cast("array<double>")
    marks = {f"_bad{i}": bad(channel(c)) for i, c in enumerate(cols)}
    rows = frames.select(*keys, "_r", *[m.alias(n) for n, m in marks.items()])
    flat = rows.select(*keys, F.explode(F.arrays_zip("_r", *marks)).alias("_s")).filter("_s._r.core")
    out = flat.select(*keys, *[F.col(f"_s._r.v._{i}").alias(c) for i, c in enumerate(every)], *[F.col(f"_s._bad{i}").alias(f"{c}_replaced") for i, c in enumerate(cols)])
    out = materialise(out, "outliers")  # a fill reads its input twice, the medians are taken once
    return fill_linear_nearest(out, {c: F.when(~F.col(f"{c}_replaced"), F.col(c)) for c in cols}, keys, order)


def mean_outliers_previous(df, cols: list[str], threshold: float = 3.0, keys=KEYS, order=IDX) -> DataFrame:
    """C4: outside mean +- threshold * sd -> previous good value; leading outliers stay."""
    chunk = chunk_col(order, CHUNK)
    partials, totals = {}, {}
    for c in cols:
        n, m, v = f"_n_{c}", f"_mean_{c}", f"_m2_{c}"
        partials[n] = F.count(c).cast("double")
        partials[m] = F.avg(c)
        partials[v] = F.var_pop(c) * F.count(c)
        totals |= {n: F.sum(n), f"_a_{c}": F.sum(F.col(n) * F.col(m)), f"_b_{c}": F.sum(F.col(v) + F.col(n) * F.col(m) * F.col(m))}
    # totals are window aggregates, so each must be one aggregate call
    tot = with_totals(df, keys, chunk, partials, totals)
    good = {}
    for c in cols:
        n, mean = F.col(f"_n_{c}"), F.col(f"_a_{c}") / F.col(f"_n_{c}")
        sd = F.sqrt(F.greatest(F.lit(0.0), F.col(f"_b_{c}") - n * mean * mean) / (n - 1))
        out_of = (sd > 0) & (F.abs(F.col(c) - mean) > sd * threshold)
        tot = tot.withColumn(f"_good_{c}", F.when(~F.coalesce(out_of, F.lit(False)), F.col(c)))
        good[c] = Carry(f"_last_{c}", F.col(f"_good_{c}"), "last")
    out = carried(tot, keys, [order], chunk, list(good.values()))
    out = out.withColumns({c: F.coalesce(f"_good_{c}", f"_last_{c}", c) for c in cols})
    drop = [f"_{p}_{c}" for c in cols for p in ("n", "a", "b", "good", "last")]
    return out.drop(*drop)


def clean_signal(df, cols: list[str], fs: int, keys=KEYS, order=IDX) -> DataFrame:
    """Nearest fill, drop negative PPG and refill, moving-median outliers (window = fs).

    What a fill returns is stored before the next one, as each reads its input twice.
    """
    out = fill_nearest(df, {c: F.col(c) for c in cols}, keys, order)
    optical = [c for c in cols if c.startswith("ppg")]
    if optical:
        out = fill_linear_nearest(materialise(out, "filled"), {c: drop_negative(F.col(c)) for c in optical}, keys, order)
    return moving_median_outliers(out, cols, fs, keys=keys, order=order)


def clean_numeric(df, exprs: dict[str, Column], keys=KEYS, order=IDX) -> DataFrame:
    """Coerce, linear inside, hold at the edges, zero when nothing is valid."""
    out = fill_linear_nearest(df, {n: numeric(c) for n, c in exprs.items()}, keys, order)
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in exprs})


def cold_film_ratios(df, pairs: dict[str, tuple[str, str]], keys=KEYS, order=IDX) -> DataFrame:
    """P5: ``{out: (uc, ut)}``; vanishing denominators are filled like gaps, 0 when nothing is valid."""
    filled = fill_linear_nearest(df, {o: bridge_ratio(F.col(uc), F.col(ut)) for o, (uc, ut) in pairs.items()}, keys, order)
    return filled.withColumns({o: F.coalesce(F.col(o), F.lit(0.0)) for o in pairs})


def repair_unreliable(df, cols: list[str], time: str, reliable: Column, keys=KEYS, size: float = CHUNK) -> DataFrame:
    """Values of unreliable windows interpolated on time from reliable ones, edges held."""
    base = df.withColumn("_rel", reliable)
    src = {f"_r_{c}": F.when(F.col("_rel"), numeric(F.col(c))) for c in cols}
    near = neighbours(base, src, keys, time, size)
    fixed = {}
    for c in cols:
        p, n, t = F.col(f"_r_{c}_p"), F.col(f"_r_{c}_n"), F.col(time)
        est = F.coalesce(p["v"] + (n["v"] - p["v"]) * (t - p["i"]) / F.nullif(n["i"] - p["i"], F.lit(0)), p["v"], n["v"])
        fixed[c] = F.when(F.col("_rel"), F.col(c)).otherwise(F.coalesce(est, F.col(c)))
    out = near.withColumns(fixed).withColumn("interpolated", ~F.col("_rel"))
    return out.drop("_rel", *[f"_r_{c}_{s}" for c in cols for s in "pn"])


def carry_forward(df, cols: list[str], keys=KEYS, order=IDX, size=CHUNK) -> DataFrame:
    """Missing -> last valid value; ``<col>_carried`` marks them."""
    specs = [Carry(f"_l_{c}", numeric(F.col(c)), "last") for c in cols]
    out = carried(df, keys, [order], chunk_col(order, size), specs)
    marks = {f"{c}_carried": numeric(F.col(c)).isNull() & F.col(f"_l_{c}").isNotNull() for c in cols}
    out = out.withColumns(marks)
    return out.withColumns({c: F.coalesce(numeric(F.col(c)), F.col(f"_l_{c}")) for c in cols}).drop(
        *[f"_l_{c}" for c in cols]
    )


def impute_median(df, cols: list[str]) -> DataFrame:
    """Non-finite feature values -> the column's exact median, else 0.

    Columns without a gap need no median and are not searched for one. All medians come from one pass over a long table; the
    driver sees two numbers per column.
    """
    out = df.withColumns({c: numeric(F.col(c)) for c in cols})
    gaps = out.agg(*[F.count_if(F.col(c).isNull()) for c in cols]).first()
    cells = [F.struct(F.lit(i).alias("_which"), F.col(c).alias("_x")) for i, c in enumerate(cols) if gaps[i]]
    if not cells:
        return out
    found = exact_percentiles(out.select(F.inline(F.array(*cells))), ["_which"], "_x", [0.5])
    medians = {r[0]: r[1] for r in found.select("_which", F.get("q", F.lit(0))).collect()}
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(medians.get(i)).cast("double"), F.lit(0.0)) for i, c in enumerate(cols) if gaps[i]})
