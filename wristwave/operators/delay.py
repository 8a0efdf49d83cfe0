"""Delay estimation between the optical signal and its motion references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wristwave.functions.scalars import taps_from_delay
from wristwave.operators.signal import lag_correlation
from wristwave.operators.stats import lag_bounds
from wristwave.operators.windows import sample_std, window_arrays, window_moments

# fixed values: search tiers (seconds, representative windows)
TIERS = [(0.2, 5), (0.4, 10), (0.6, 15), (0.8, 20)]


def with_lags(wins: DataFrame, target: str, refs: list[str], pad: int, win: int, on: Column, partial: bool = False) -> DataFrame:
    """Correlations of all shifts of all references in one pass over Arrow batches: ``_c_<reference>``."""
    corr = lag_correlation(pad, partial)
    seek = lambda c: F.when(on, F.slice(c, F.lit(1), F.least(F.size(c), F.col("pad_left") + win + pad)))
    return wins.withColumns({f"_c_{c}": corr(F.when(on, F.slice(target, F.lit(1), F.lit(win))), seek(c), "pad_left") for c in refs})


def window_delays(
    wins: DataFrame, target: str, refs: list[str], pad: int, win: int, forward: dict[str, int], max_order: int,
    top: int | None = None, lo=None, hi=None, scale: float = 1.0, name: str = "stages", m: str = "m", delay: str = "delay",
    lead: int = 0, active=None, partial: bool = False, ready: bool = False,
) -> DataFrame:
    """G10 + O4 per window: ``stages`` = references by max |corr| (signal, corr, k), tap count and delay.

    The delay is the best channel's first lag of maximal |corr| inside [lo, hi]. References
    in ``wins`` carry ``pad`` samples on both sides. With ``lead`` the arrays start that many
    samples before the window and the delay is searched from there. Windows where ``active``
    is false skip the search (NULL stages). ``ready``: ``with_lags`` has been here, and its columns stay.
    """
    on = F.lit(True) if active is None else active
    out = wins if ready else with_lags(wins, target, refs, pad, win, on, partial)
    lo = F.lit(-pad) if lo is None else lo
    hi = F.lit(pad) if hi is None else hi
    cand = []
    for c in refs:
        best = F.array_min(F.filter(
            F.transform(f"_c_{c}", lambda v, i: F.struct((-F.abs(v)).alias("n"), (i - pad).alias("lag"))),
            lambda p: (p["lag"] >= lo) & (p["lag"] <= hi),
        ))
        cand.append(F.struct(best["n"].alias("n"), F.lit(refs.index(c)).alias("o"), F.lit(c).alias("channel"), best["lag"].alias("lag"), F.lit(forward[c]).alias("k")))
    out = out.withColumn("_rank", F.sort_array(F.array(*cand)))
    out = out if ready else out.drop(*[f"_c_{c}" for c in refs])
    if top is not None:
        out = out.withColumn("_rank", F.slice("_rank", 1, top))
    signal = None
    for c in refs:
        core = lambda c=c: F.slice(c, F.col("pad_left") + 1 + lead, F.lit(win))
        signal = (lambda prev, c, core: lambda ch: F.when(ch == c, core()).otherwise(prev(ch) if prev else F.lit(None)))(signal, c, core)
    stages = F.transform("_rank", lambda s: F.struct(s["channel"].alias("channel"), s["lag"].alias("lag"), (-s["n"]).alias("corr"), s["k"].alias("k"), signal(s["channel"]).alias("signal")))
    first = F.get("_rank", F.lit(0))["lag"]
    stages = F.when(on, stages)
    return out.withColumns({name: stages, delay: first, m: taps_from_delay(first, max_order, scale)}).drop("_rank")


def delay_profile(
    df: DataFrame, target: str, groups: dict[str, list[str]], mag: str, fs: int, win: int, step: int, start: int,
    threshold: DataFrame | None, keys=("recording",), buffer_idx: DataFrame | None = None,
) -> DataFrame:
    """Lag bounds per (recording, group) from the first tier acceptable for all groups, else the last tier.

    Every tier is computed at once from the windows of the widest tier (at most twenty per
    recording); correlations are taken once at the widest lag range.
    """
    keys = list(keys)
    pad = round(TIERS[-1][0] * fs)
    refs = [c for g in groups.values() for c in g]
    scores = window_moments(df, {"s": F.col(mag)}, win, step, start, keys).select(*keys, "window_idx", sample_std("s").alias("score"))
    if threshold is not None:
        few = scores.join(threshold, keys).groupBy(*keys).agg(F.count_if(F.col("score") > F.col("threshold")).alias("_m"), F.max("threshold").alias("threshold"))
        scores = scores.join(few, keys).filter("_m < 2 or score > threshold")
    best = W.partitionBy(*keys).orderBy(F.desc("score"), "window_idx")
    rep = scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= TIERS[-1][1]).select(*keys, "window_idx", "rank")
    # the search starts one sample before the window
    wins = window_arrays(df, [target, *refs], win, step, start - 1, pad, tuple(refs), keys=keys, plan=rep)
    corr = lag_correlation(pad)
    lags = wins.select(*keys, "window_idx", "rank", *[corr(target, c, "pad_left").alias(c) for c in refs])
    tier = F.array(*[F.struct(F.lit(i).alias("tier"), F.lit(round(s * fs)).alias("lim"), F.lit(n).alias("n")) for i, (s, n) in enumerate(TIERS)])
    rows = lags.withColumn("_t", F.explode(tier)).filter(F.col("rank") <= F.col("_t.n"))
    best_of = lambda c, o: F.array_min(F.filter(
        F.transform(c, lambda v, i: F.struct((-F.abs(v)).alias("n"), F.lit(o).alias("o"), (i - pad).alias("lag"))), lambda p: F.abs(p["lag"]) <= F.col("_t.lim")
    ))
    per = F.array(*[
        F.struct(F.lit(g).alias("group"), F.array_min(F.array(*[best_of(c, o) for o, c in enumerate(cs)])).alias("b")) for g, cs in groups.items()
    ])
    flat = rows.select(*keys, "_t.tier", "_t.lim", F.explode(per).alias("_g")).select(
        *keys, "tier", "lim", "_g.group", F.col("_g.b.lag").alias("lag"), (-F.col("_g.b.n")).alias("corr")
    )
    b = lag_bounds(flat, [*keys, "tier", "group", "lim"], "lag", "corr", -F.col("lim"), F.col("lim"))
    width = F.col("max_lag") - F.col("min_lag")
    ok = (~F.col("fallback")) & (width >= 6) & (F.col("min_lag") != -F.col("lim")) & (F.col("max_lag") != F.col("lim")) & (width / (F.col("lim") * 2) <= 0.7)
    b = b.withColumn("_ok", ok)
    tiers = b.groupBy(*keys, "tier").agg(F.min("_ok").alias("_all"))
    pick = tiers.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_all"), F.col("tier"))), F.max("tier")).alias("tier"))
    return b.join(pick, [*keys, "tier"]).drop("_ok", "lim")
