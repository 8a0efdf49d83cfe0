"""Time alignment: as-of, interpolation, interval, lag and priority joins.

All of them are equi-joins or carries over (key, time bucket); none pairs every row of a
recording with every other.
"""

from __future__ import annotations

import math
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wristwave.operators.chunked import CHUNK, Carry, carried, chunk_col, join_group, rolling


def _annotated(points: DataFrame, keys, time, value, width) -> DataFrame:
    """Each point with the one before and after it (for extrapolation)."""
    pair = F.struct(F.col(time).alias("t"), F.col(value).alias("v"))
    out = carried(
        points.select(*keys, time, value), keys, [time], chunk_col(time, width),
        [Carry("_prev", pair, "last", exclusive=True), Carry("_next", pair, "first", exclusive=True)],
    )
    return out.select(
        *keys, time,
        F.struct(F.col(time).alias("t"), F.col(value).alias("v"), F.col("_prev.t").alias("pt"), F.col("_prev.v").alias("pv"),
                 F.col("_next.t").alias("nt"), F.col("_next.v").alias("nv")).alias("_pt"),
    )


def asof_neighbours(queries: DataFrame, points: DataFrame, keys: list[str], time: str, value: str, width: float) -> DataFrame:
    """queries + ``_l`` (last point at or before) and ``_r`` (first point after), each with its own neighbours."""
    pts = _annotated(points, keys, time, value, width).withColumn("_side", F.lit(0))
    both = pts.unionByName(queries.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    out = carried(both, keys, [time, "_side"], chunk_col(time, width), [Carry("_l", F.col("_pt"), "last"), Carry("_r", F.col("_pt"), "first", exclusive=True)])
    return out.filter("_side = 1").drop("_side", "_pt")


def interpolate(queries: DataFrame, points: DataFrame, keys: list[str], time: str, value: str, out: str, width: float, missing: float | None = 0.0) -> DataFrame:
    """Linear inside, linear extrapolation outside; ``missing`` when a key has fewer than two points."""
    near = asof_neighbours(queries, points, keys, time, value, width)
    q, a, b = F.col(time), F.col("_l"), F.col("_r")
    inside = a["v"] + (b["v"] - a["v"]) * ((q - a["t"]) / (b["t"] - a["t"]))
    after = a["v"] + (a["v"] - a["pv"]) * ((q - a["t"]) / F.nullif(a["t"] - a["pt"], F.lit(0.0)))
    before = b["v"] + (b["nv"] - b["v"]) * ((q - b["t"]) / F.nullif(b["nt"] - b["t"], F.lit(0.0)))
    est = F.when(a.isNotNull() & b.isNotNull(), inside).when(a.isNotNull(), after).otherwise(before)
    return near.withColumn(out, est if missing is None else F.coalesce(est, F.lit(missing))).drop("_l", "_r")


def nearest(queries: DataFrame, points: DataFrame, keys: list[str], time: str, value: str, out: str, width: float) -> DataFrame:
    """Value of the nearest point, tie -> the earlier one; queries outside the points' range are cut."""
    near = asof_neighbours(queries, points, keys, time, value, width)
    q, a, b = F.col(time), F.col("_l"), F.col("_r")
    near = near.filter(a.isNotNull() & (b.isNotNull() | (a["t"] >= q)))
    left = b.isNull() | ((q - a["t"]) <= (b["t"] - q))
    return near.withColumn(out, F.when(left, a["v"]).otherwise(b["v"])).drop("_l", "_r")


def _shift_frames(df: DataFrame, value: str, biases: list[float], keys, order, step_s: float) -> tuple[DataFrame, Column, Callable[[Column], Column], list[str]]:
    """What J3 needs: rows with their neighbours, an array of offsets, the value at an offset, and the columns to drop.

    Neighbours come from leads and lags inside bounded chunks, so no offset costs a shuffle. The ends of a series come from
    one aggregate (the last row but one is the last of its parity), so no sample meets another in a join.
    """
    steps = [b / step_s for b in biases]
    floors = [math.floor(s) for s in steps]
    first, after = min(floors), max(floors) + 1
    i, x = F.col(order), F.struct(F.col(value).alias("v"))
    last = lambda rest: F.max_by(F.struct(i.alias("i"), F.col(value).alias("v")), F.when(i % 2 == rest, i))
    edge = df.groupBy(*keys).agg(
        (F.max(order) + 1).alias("_n"),
        F.min_by(value, order).alias("_v0"), F.max_by(value, order).alias("_vn"),
        F.max_by(value, F.when(i == 1, i)).alias("_v1"), last(0).alias("_even"), last(1).alias("_odd"),
    )
    pen = F.when(F.col("_n") % 2 == 0, F.col("_even")).otherwise(F.col("_odd"))
    edge = edge.select(*keys, "_n", "_v0", "_vn", "_v1", F.when(pen["i"] == F.col("_n") - 2, pen["v"]).alias("_vm"))
    take = lambda k: lambda w: (F.lead(value, k) if k > 0 else F.lag(value, -k)).over(w.ordered) if k else F.col(value)
    near = {f"_near{k - first}": take(k) for k in range(first, after + 1)}
    out = join_group(rolling(df, keys, order, [near], max(0, -first), max(0, after)), edge, keys, chunk_col(order, CHUNK))
    out = out.withColumn("_near", F.array(*near)).drop(*near)
    offsets = F.array(*[F.struct(F.lit(float(b)).alias("bias"), F.lit(float(s)).alias("step"), F.lit(k).alias("k")) for b, s, k in zip(biases, steps, floors)])

    def value_at(o: Column) -> Column:
        pos = i + o["step"]
        a, b = F.get("_near", o["k"] - first), F.get("_near", o["k"] - first + 1)
        return (
            F.when(F.col("_n") < 2, F.lit(None))
            .when(pos < 0, F.col("_v0") + (F.col("_v1") - F.col("_v0")) * pos)
            .when(pos > F.col("_n") - 1, F.col("_vn") + (F.col("_vn") - F.col("_vm")) * (pos - (F.col("_n") - 1)))
            .when(F.floor(pos) == F.col("_n") - 1, F.col("_vn"))
            .otherwise(a + (b - a) * (pos - (i + o["k"])))
        )

    return out, offsets, value_at, ["_near", "_n", "_v0", "_vn", "_v1", "_vm"]


def shifted(df: DataFrame, value: str, biases: list[float], keys=["recording"], order="window_idx", step_s: float = 1.0) -> DataFrame:
    """J3 for many offsets at once: the series' own value at t + bias on its dense grid. Adds ``_at``: array<struct<bias, v>>."""
    out, offsets, value_at, drop = _shift_frames(df, value, biases, keys, order, step_s)
    return out.withColumn("_at", F.transform(offsets, lambda o: F.struct(o["bias"].alias("bias"), value_at(o).alias("v")))).drop(*drop)


def shifted_rows(df: DataFrame, value: str, biases: list[float], keys=["recording"], order="window_idx", step_s: float = 1.0) -> DataFrame:
    """J3 with a row for each offset: adds ``bias`` and ``v``. Offsets are expanded first, so one compiled expression serves all."""
    out, offsets, value_at, drop = _shift_frames(df, value, biases, keys, order, step_s)
    long = out.withColumn("_o", F.explode(offsets))
    return long.withColumns({"bias": F.col("_o.bias"), "v": value_at(F.col("_o"))}).drop("_o", *drop)


def grid(df: DataFrame, keys: list[str], count: Column, out: str, block: int = CHUNK) -> DataFrame:
    """``count`` rows 0.. per key; a long grid is first split into blocks over many tasks.

    The tasks are asked for by number: adaptive execution goes by the size of the blocks' rows and would expand all in one.
    """
    blocks = df.withColumn("_n", count.cast("bigint")).filter("_n > 0").withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / block).cast("bigint")))
    )
    spread = blocks.repartition(16 * df.sparkSession.sparkContext.defaultParallelism, *keys, "_b")
    inner = F.sequence(F.col("_b") * block, F.least(F.col("_n"), (F.col("_b") + 1) * block) - 1)
    return spread.withColumn(out, F.explode(inner)).drop("_n", "_b")


def common_grid(series: DataFrame, keys: list[str], member: str, time: str, step: float) -> DataFrame:
    """Overlap of all member series per key as (keys, k, time)."""
    ends = series.groupBy(*keys, member).agg(F.min(time).alias("a"), F.max(time).alias("b"))
    ov = ends.groupBy(*keys).agg(F.max("a").alias("_a"), F.min("b").alias("_b2"))
    n = F.ceil((F.col("_b2") + step - F.col("_a")) / step)
    return grid(ov, keys, n, "k").withColumn(time, F.col("_a") + F.col("k") * step).drop("_a", "_b2")


def interval_join(anchors: DataFrame, points: DataFrame, keys: list[str], anchor: str, time: str, width: float, bucket: str = "_bucket") -> DataFrame:
    """Pairs with anchor <= time < anchor + width through time buckets (two copies of each anchor)."""
    b = chunk_col(anchor, width)
    left = anchors.withColumn(bucket, F.explode(F.array(b, b + 1)))
    right = points.withColumn(bucket, chunk_col(time, width))
    on = left.join(right, [*keys, bucket])
    return on.filter((F.col(time) >= F.col(anchor)) & (F.col(time) < F.col(anchor) + width)).drop(bucket)


def aligned_shares(shares: DataFrame, queries: DataFrame, keys: list[str], member: str, time: str, value: str, width: float, members: list[str]) -> DataFrame:
    """Member probabilities on another grid, clipped at 0 and renormalised (a zero row stays zero)."""
    q = queries.withColumn(member, F.explode(F.array(*[F.lit(m) for m in members])))
    est = interpolate(q, shares, [*keys, member], time, value, "_p", width, missing=0.0)
    est = est.withColumn("_p", F.greatest(F.lit(0.0), F.col("_p")))
    totals = est.groupBy(*keys, "k").agg(F.sum("_p").alias("_t"))
    out = est.join(totals, [*keys, "k"])
    return out.withColumn("p", F.col("_p") / F.when(F.col("_t") == 0, F.lit(1.0)).otherwise(F.col("_t"))).drop("_p", "_t")


def lag_correlations(
    df: DataFrame, target: str, refs: list[str], lags: list[int], win: int, step: int, start: int = 0, keys=["recording"], order="sample_idx"
) -> DataFrame:
    """Pearson of each window with every lagged reference; 0 when undefined.

    Lagged copies come from a bounded frame, moments are summed per slot, and slots are
    combined into windows: the only shuffle of samples is the chunking itself.
    """
    k = win // step
    back, ahead = max(0, -min(lags)), max(0, max(lags))
    take = {}
    for c in refs:
        for l in lags:
            name = f"_{c}_{l}"
            if l == 0:
                take[name] = (lambda c: lambda w: F.col(c))(c)
            else:
                take[name] = (lambda c, l: lambda w: (F.lead(c, l) if l > 0 else F.lag(c, -l)).over(w.ordered))(c, l)
    wide = rolling(df.select(*keys, order, target, *refs), keys, order, [take], back, ahead)
    x = F.col(target)
    pairs = F.array(*[
        F.struct(F.lit(c).alias("channel"), F.lit(l).alias("lag"), F.col(f"_{c}_{l}").alias("y")) for c in refs for l in lags
    ])
    slot = F.floor((F.col(order) - start) / F.lit(step)).cast("bigint")
    # moments for every (channel, lag) side by side: one row per slot, no row explosion
    aggs = [F.count("*").alias("_rows"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx")]
    for c in refs:
        for l in lags:
            y = F.col(f"_{c}_{l}")
            aggs.append(F.struct(F.count(y).cast("double"), F.sum(y), F.sum(y * y), F.sum(x * y)).cast("struct<n:double,y:double,yy:double,xy:double>").alias(f"m_{c}_{l}"))
    slots = wide.filter(F.col(order) >= start).groupBy(*keys, slot.alias("_slot")).agg(*aggs)
    spread = slots.withColumn("window_idx", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_slot") - (k - 1)), F.col("_slot"))))
    tot = [F.sum("_rows").alias("_rows"), F.sum("sx").alias("sx"), F.sum("sxx").alias("sxx")]
    for c in refs:
        for l in lags:
            m = F.col(f"m_{c}_{l}")
            tot.append(F.struct(F.sum(m["n"]), F.sum(m["y"]), F.sum(m["yy"]), F.sum(m["xy"])).cast("struct<n:double,y:double,yy:double,xy:double>").alias(f"m_{c}_{l}"))
    wins = spread.groupBy(*keys, "window_idx").agg(*tot).filter(F.col("_rows") == win)
    packed = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(l).alias("lag"), F.col(f"m_{c}_{l}").alias("m")) for c in refs for l in lags])
    long = wins.select(*keys, "window_idx", "sx", "sxx", F.explode(packed).alias("_e")).select(*keys, "window_idx", "sx", "sxx", "_e.channel", "_e.lag", "_e.m")
    n = F.lit(float(win))
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("m.yy") - F.col("m.y") * F.col("m.y") / n
    cov = F.col("m.xy") - F.col("sx") * F.col("m.y") / n
    tiny = 1e-12
    ok = (F.col("m.n") == win) & (vx > F.col("sxx") * tiny) & (vy > F.col("m.yy") * tiny)
    return long.select(*keys, "window_idx", "channel", "lag", F.when(ok, cov / F.sqrt(vx * vy)).otherwise(F.lit(0.0)).alias("corr"))


def pair_references(files: DataFrame, suffixes: list[str] = ("_ref", "_HR_ref")) -> DataFrame:
    """Stem -> reference stem by suffix priority; ``reference`` NULL when none exists."""
    is_ref = F.lit(False)
    for s in suffixes:
        is_ref = is_ref | F.endswith("stem", F.lit(s))
    sensors = files.filter(~is_ref)
    opts = sensors.withColumn("_o", F.explode(F.array(*[F.struct(F.lit(i).alias("p"), F.concat("stem", F.lit(s)).alias("r")) for i, s in enumerate(suffixes)])))
    refs = files.filter(is_ref).select(F.col("stem").alias("_r"))
    hit = opts.join(refs, F.col("_o.r") == F.col("_r"), "left")
    return hit.groupBy("stem").agg(F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col("_o.p"))).alias("reference"))


def override(base: DataFrame, best: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Known fields of the best parameters replace the base ones."""
    b = best.select(*key, *[F.col(f).alias(f"_b_{f}") for f in fields])
    out = base.join(b, key, "left")
    return out.withColumns({f: F.coalesce(f"_b_{f}", f) for f in fields}).drop(*[f"_b_{f}" for f in fields])


def replay(stored: DataFrame, computed: DataFrame, key: list[str], a: str, b: str, tolerance: float = 0.5) -> DataFrame:
    """J14"""
    d = stored.join(computed, key)
    return d.withColumn("delta", F.col(b) - F.col(a)).withColumn("passed", F.abs(F.col("delta")) <= tolerance)
