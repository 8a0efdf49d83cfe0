"""Sequential estimates along a recording, computed chunk-parallel.

A tracker needs the previous estimate. One step takes a fixed value or moves the one before by a fixed amount, so a
whole chunk is a map of few pieces from the rate that enters it to the one that leaves (``functions.moves``). Maps
of chunks are made at once and composed by pointer doubling: a chunk's map is joined with that of the chunk just before
what it covers, so after k rounds it covers 2 ** k chunks; those that became constant wait. That gives every chunk its
entry in a number of rounds that grows with the logarithm of the chunks, even for a tracker that never accepts a peak.

Then all chunks are walked from their entries. Entries are checked against the exits of that walk, and where repeated
moves were rounded otherwise the walk's own value is taken, so the result is exactly the sequential one; a recording
of any length never becomes one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wristwave.functions import moves as mv
from wristwave.functions.scalars import slew
from wristwave.operators.chunked import CHUNK, chunk_col, join_group, rolling, runs
from wristwave.operators.windows import segment_labels
from wristwave.session import materialise, ship

FOLD_CHUNK = 256
BATCH = 16  # chunks that a worker has as Python objects
# The names of the tracking modes.
MODES = [
    "current", "raw_peak", "fallback_slew_to_raw_peak", "all_peaks_near_prev",
    "all_peaks_with_raw_fallback", "post_motion_slew", "post_recovery_blend",
]


def fold(
    df: DataFrame, keys: list[str], order: str, payload: dict[str, Column], step: Callable[[Column, Column], Column],
    out: str, moves: list[Callable[[Column, Column], Column]], state: str = "double", size: int = FOLD_CHUNK,
    entry: Callable[[Column, Column], Column] = lambda rates, before: F.get(rates, F.lit(0)),
) -> DataFrame:
    """Rows of ``keys, order, payload`` with ``out`` = step(previous out, row); NULL before the first row.

    ``moves``: for each rate in the state, (row before, row) to a ``move``, or NULL where it copies the first rate;
    they say what ``step`` does. ``entry``: the state made of the rates and the row before.
    """
    packed = F.struct(F.col(order).alias("_i"), *[c.alias(n) for n, c in payload.items()])
    chunks = (
        df.withColumn("_p", packed)
        .groupBy(*keys, chunk_col(order, size).alias("_chunk"))
        .agg(F.sort_array(F.collect_list("_p")).alias("_rows"))
    )
    chunks = materialise(chunks, "fold")
    entries = _settle(chunks, keys, _entries(chunks, keys, moves, state, entry), step)
    ready = chunks.join(entries, [*keys, "_chunk"])
    states = F.aggregate(
        "_rows", F.array("_entry"), lambda acc, r: F.concat(acc, F.array(step(F.element_at(acc, -1), r)))
    )
    flat = ready.select(*keys, "_rows", states.alias("_s")).select(*keys, "_s", F.posexplode("_rows").alias("_k", "_r"))
    return flat.select(
        *keys, F.col("_r._i").alias(order), *[F.col("_r")[n].alias(n) for n in payload],
        F.get("_s", F.col("_k") + 1).alias(out),
    )


_STEP = "struct<set:boolean,value:double,start:double,pool:array<double>,fall:double,reach:double,limit:double,step:double>"
_MAPS = pa.list_(pa.struct([("src", pa.int32()), ("nothing", pa.float64()), ("cuts", pa.list_(pa.float64())), ("moves", pa.list_(pa.bool_())), ("by", pa.list_(pa.float64()))]))
_MAP = "struct<src:int,nothing:double,cuts:array<double>,moves:array<boolean>,by:array<double>>"


def move(pool: Column, start: Column, limit: Column, step: Column, reach: Column | None = None, fall: Column | None = None, set_: Column | None = None, value: Column | None = None) -> Column:
    """What one window does to a rate: see ``functions.moves.Step``; NULL stands for no rate, no reach for any distance."""
    nan = F.lit(float("nan"))
    known = lambda c: nan if c is None else F.coalesce(c.cast("double"), nan)
    fields = {
        "set": F.lit(False) if set_ is None else F.coalesce(set_, F.lit(False)), "value": known(value), "start": known(start),
        "pool": F.coalesce(F.filter(pool, lambda f: f.isNotNull()), F.array().cast("array<double>")), "fall": known(fall),
        "reach": F.lit(float("inf")) if reach is None else reach, "limit": limit, "step": step,
    }
    return F.struct(*[c.alias(n) for n, c in fields.items()]).cast(_STEP)


def _unpacked(row) -> list[mv.Map]:
    return [mv.Map(m["src"], m["nothing"], m["cuts"], list(zip(m["moves"], m["by"]))) for m in row]


def _packed(maps: list[mv.Map]) -> list[dict]:
    return [{"src": m.src, "nothing": m.nothing, "cuts": m.cuts, "moves": [p[0] for p in m.pieces], "by": [p[1] for p in m.pieces]} for m in maps]


def _entries(chunks: DataFrame, keys: list[str], moves, state: str, entry) -> DataFrame:
    """The state that enters each chunk, up to the rounding of repeated moves, by composing the chunks' maps."""
    ordered = W.partitionBy(*keys).orderBy("_chunk")  # one row a chunk
    table = chunks.withColumns({"_before": F.lag(F.element_at("_rows", -1)).over(ordered), "_at": F.row_number().over(ordered) - 1, "_more": F.lead("_chunk").over(ordered).isNotNull()})
    row_before = lambda i: F.when(i > 0, F.get("_rows", i - 1)).otherwise(F.col("_before"))
    steps = F.transform("_rows", lambda r, i: F.array(*[m(row_before(i), r) for m in moves]))
    # nobody enters from the last chunk, so it has no map; a short recording has that chunk only
    table = materialise(table.select(*keys, "_chunk", "_at", "_before", F.when(F.col("_more"), steps).alias("_steps")), "fold-steps")
    schema = table.select(*keys, "_at", F.col("_at").alias("_from"), F.lit(None).cast(f"array<{_MAP}>").alias("_maps"), F.lit(True).alias("_done")).schema
    ship(chunks.sparkSession)

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of few chunks, as their steps and maps become Python objects."""
        return (batch.slice(at, BATCH) for batch in batches for at in range(0, len(batch), BATCH))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            rows = batch.column("_steps").to_pylist()
            maps = [mv.chunk_maps([[s and tuple(s.values()) for s in row] for row in chunk]) for chunk in rows]
            yield told(batch, maps, batch.column("_at"))

    def doubled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            both = zip(batch.column("_maps").to_pylist(), batch.column("_earlier").to_pylist())
            yield told(batch, [mv.joined(_unpacked(a), _unpacked(b)) for a, b in both], batch.column("_begin"))

    def told(batch: pa.RecordBatch, maps: list[list[mv.Map]], begins: pa.Array) -> pa.RecordBatch:
        done = [at == 0 or all(m.constant for m in ms) for at, ms in zip(begins.to_pylist(), maps)]
        cols = [*(batch.column(k) for k in keys), batch.column("_at"), begins, pa.array([_packed(ms) for ms in maps], _MAPS), pa.array(done, pa.bool_())]
        return pa.RecordBatch.from_arrays(cols, [*keys, "_at", "_from", "_maps", "_done"])

    # the first chunk is entered by nothing, a constant map needs no entry
    maps = materialise(table.filter("_steps is not null").select(*keys, "_at", "_steps").mapInArrow(made, schema), "fold-maps")
    while maps.filter("not _done").limit(1).count():
        open_ = maps.filter("not _done").withColumn("_to", F.col("_from") - 1)
        earlier = maps.select(*keys, F.col("_at").alias("_to"), F.col("_from").alias("_begin"), F.col("_maps").alias("_earlier"))
        met = open_.join(earlier, [*keys, "_to"]).select(*keys, "_at", "_maps", "_earlier", "_begin")
        maps = materialise(maps.filter("_done").unionByName(met.mapInArrow(doubled, schema)), "fold-maps")
    rates = maps.select(*keys, (F.col("_at") + 1).alias("_at"), F.transform("_maps", lambda m: F.nanvl(m["nothing"], F.lit(None).cast("double"))).alias("_rates"))
    known = table.select(*keys, "_chunk", "_at", "_before").join(rates, [*keys, "_at"], "left")
    made_ = F.when(F.col("_at") > 0, entry(F.col("_rates"), F.col("_before"))).cast(state)
    return materialise(known.select(*keys, "_chunk", made_.alias("_entry")), "fold-entries")


def _settle(chunks: DataFrame, keys: list[str], entries: DataFrame, step) -> DataFrame:
    """Entry state of every chunk: the exit of the chunk before, where the walk from the given entries tells otherwise."""
    exit_of = lambda: F.aggregate("_rows", F.col("_entry"), step)
    state = chunks.join(entries, [*keys, "_chunk"]).select(*keys, "_chunk", "_entry", exit_of().alias("_exit"))
    state = materialise(state, "fold-state")
    w = W.partitionBy(*keys).orderBy("_chunk")
    while True:
        moved = state.withColumn("_new", F.lag("_exit").over(w)).withColumn("_same", F.col("_new").eqNullSafe(F.col("_entry")))
        redo = (
            moved.filter(~F.col("_same")).select(*keys, "_chunk", F.col("_new").alias("_entry"))
            .join(chunks, [*keys, "_chunk"]).select(*keys, "_chunk", "_entry", exit_of().alias("_exit"))
        )
        redo = materialise(redo, "fold-redo")
        if not redo.limit(1).count():
            return state.select(*keys, "_chunk", "_entry")
        kept = moved.filter("_same").select(*keys, "_chunk", "_entry", "_exit")
        state = materialise(kept.unionByName(redo), "fold-state")


def near_previous(freqs: Column, prev: Column, range_hz, top: int | None = 5) -> Column:
    """O2 (first of the top five) and O3 (``top`` None: strongest of all) inside an open interval."""
    pool = freqs if top is None else F.slice(freqs, 1, top)
    return F.get(F.filter(pool, lambda f: (f - prev < range_hz) & (f - prev > -range_hz)), F.lit(0))


def tracked(freqs: Column, prev: Column, mode: Column | None, range_hz, limit_hz, step_hz) -> Column:
    """One tracker update; ``freqs`` sorted by amplitude descending; ``mode`` NULL means current."""
    raw = F.coalesce(F.get(freqs, F.lit(0)), F.lit(0.0))
    top5 = near_previous(freqs, prev, range_hz)
    if mode is None:
        return slew(F.coalesce(top5, prev), prev, limit_hz, step_hz)
    strongest = near_previous(freqs, prev, range_hz, None)
    target = (
        F.when(mode == "fallback_slew_to_raw_peak", F.coalesce(top5, raw))
        .when(mode.isin("all_peaks_near_prev", "post_recovery_blend"), F.coalesce(strongest, prev))
        .when(mode == "all_peaks_with_raw_fallback", F.coalesce(strongest, raw))
        .otherwise(F.coalesce(top5, prev))
    )
    est = F.when(mode == "raw_peak", raw).otherwise(slew(target, prev, limit_hz, step_hz))
    return F.when(F.size(freqs) == 0, prev).otherwise(est)


def tracked_move(freqs: Column, mode: Column | None, range_hz, limit_hz, step_hz, start: Column, reset: Column | None = None) -> Column:
    """What ``tracked`` does to the rate, as a move; ``start`` where there is none or at a reset."""
    top5, raw = F.slice(freqs, 1, 5), F.coalesce(F.get(freqs, F.lit(0)), F.lit(0.0))
    at = F.lit(False) if reset is None else reset
    if mode is None:
        return move(top5, start, limit_hz, step_hz, range_hz, set_=at, value=start)
    empty = F.size(freqs) == 0
    pool = F.when(mode.isin("all_peaks_near_prev", "post_recovery_blend", "all_peaks_with_raw_fallback"), freqs).otherwise(top5)
    fall = F.when(mode.isin("fallback_slew_to_raw_peak", "all_peaks_with_raw_fallback") & ~empty, raw)
    return move(pool, start, limit_hz, step_hz, range_hz, fall, at | ((mode == "raw_peak") & ~empty), F.when(at, start).otherwise(raw))


def track(
    df: DataFrame, keys: list[str], order: str, freqs: str, range_hz, limit_bpm, step_bpm, out: str = "hr",
    reset: Column | None = None, mode: Column | None = None, size: int = FOLD_CHUNK,
) -> DataFrame:
    """W9. ``range_hz``, ``limit_bpm``, ``step_bpm`` may be numbers or column names."""
    col = lambda v: F.col(v) if isinstance(v, str) else F.lit(float(v))
    payload = {"_f": F.col(freqs), "_range": col(range_hz), "_lim": col(limit_bpm) / 60, "_step": col(step_bpm) / 60,
               "_reset": reset if reset is not None else F.lit(False)}
    if mode is not None:
        payload["_mode"] = mode

    def step(prev: Column, r: Column) -> Column:
        raw = F.coalesce(F.get(r["_f"], F.lit(0)), F.lit(0.0))
        nxt = tracked(r["_f"], prev, r["_mode"] if mode is not None else None, r["_range"], r["_lim"], r["_step"])
        return F.when(prev.isNull() | r["_reset"], raw).otherwise(nxt)

    raw = lambda r: F.coalesce(F.get(r["_f"], F.lit(0)), F.lit(0.0))
    moves = [lambda _, r: tracked_move(r["_f"], r["_mode"] if mode is not None else None, r["_range"], r["_lim"], r["_step"], raw(r), r["_reset"])]
    return fold(df, keys, order, payload, step, out, moves, size=size).select(*keys, order, out)


def sorted_peaks(peaks: DataFrame, keys: list[str], freq="freq", amp="amp", tie="peak_idx", **more: Column) -> DataFrame:
    """O1 as one array per window: frequencies by amplitude, descending and stable (few peaks per window); ``more``: further aggregates."""
    s = F.struct((-F.col(amp)).alias("a"), F.col(tie).alias("t"), F.col(freq).alias("f"))
    return peaks.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(s)), lambda x: x["f"]).alias("freqs"), *[c.alias(n) for n, c in more.items()])


def post_motion_slew(df: DataFrame, value: str, motion: Column, step_hz: float, lookback: int, keys=["recording"], order="window_idx", size: int = FOLD_CHUNK) -> DataFrame:
    """Forward rate limit over every post-motion rest run, from the maximum of the last ``lookback`` values."""
    lab = segment_labels(df, motion, keys, order)
    seen = rolling(
        lab, keys, order,
        [{"_hist": lambda w: F.max(value).over(w.ordered.rowsBetween(-lookback, -1)), "_before": lambda w: F.lag(value).over(w.ordered)}],
        lookback, 0,
    )
    payload = {"_v": F.col(value), "_post": F.col("segment") == "post_rest", "_init": F.coalesce("_hist", "_before", value), "segment": F.col("segment")}

    def step(prev, r):
        p = F.coalesce(prev, r["_init"])
        lim = F.coalesce(slew(r["_v"], p, F.lit(step_hz), F.lit(step_hz)), p)
        return F.when(r["_post"], lim)

    begin = lambda r: F.coalesce(slew(r["_v"], r["_init"], F.lit(step_hz), F.lit(step_hz)), r["_init"])
    held = lambda _, r: move(F.array(r["_v"]), begin(r), F.lit(step_hz), F.lit(step_hz), set_=~r["_post"])
    out = fold(seen, keys, order, payload, step, "_adj", [held], size=size)
    return out.select(*keys, order, "segment", F.coalesce("_adj", "_v").alias(value))


def post_recovery_blend(df: DataFrame, value: str, motion: Column, blend: float = 0.25, tau: float = 40.0, keys=["recording"], order="window_idx") -> DataFrame:
    """Blend post-motion rest runs with an exponential return from an anchor to the pre-rest level."""
    lab = segment_labels(df, motion, keys, order).select(*keys, order, value, "segment")
    newest = W.partitionBy(*keys).orderBy(F.col(order).desc())
    pre = (
        lab.filter((F.col("segment") == "pre_rest") & F.col(value).isNotNull())
        .withColumn("_rn", F.row_number().over(newest)).filter("_rn <= 15")
        .groupBy(*keys).agg(F.percentile(value, 0.75).alias("_base"))
    )
    post = runs(lab, keys, order, F.col("segment") == "post_rest")
    around = post.withColumn(order, F.explode(F.sequence(F.greatest(F.lit(0), F.col("run_start") - 20), F.least("run_end", F.col("run_start") + 7))))
    anchor = (
        around.join(lab.select(*keys, order, value), [*keys, order])
        .groupBy(*keys, "run_start", "run_end").agg(F.percentile(value, 0.9).alias("_anchor"))
    )
    model = anchor.join(pre, keys).filter("_anchor > _base")
    rows = model.withColumn(order, F.explode(F.sequence("run_start", "run_end")))
    k = F.col(order) - F.col("run_start")
    curve = F.col("_base") + (F.col("_anchor") - F.col("_base")) * F.exp(-k / F.lit(tau))
    rows = rows.select(*keys, order, curve.alias("_model"))
    out = lab.join(rows, [*keys, order], "left")
    return out.withColumn(value, F.coalesce(F.col("_model") * blend + F.col(value) * (1 - blend), F.col(value))).drop("_model")
