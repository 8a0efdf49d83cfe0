"""Sequence operators that never put one whole recording into one task.

A recording may hold a third of all rows, so ``Window.partitionBy(recording)`` over
samples is not an option. Every recording is cut into bounded chunks of its order
axis instead:

* frame operators (moving median, moving mean) read a chunk plus a halo of neighbours;
* carry operators (last valid value, running minimum, row numbers) run inside a chunk
  and add one carried value taken from a table with a single row per chunk;
* run detection keeps the runs that touch a chunk edge and merges only those.

The per-chunk tables are thousands of times smaller than the samples, and they are the
only place where a window spans a whole recording.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wristwave.session import materialise

CHUNK = 4096


def held(small: DataFrame) -> DataFrame:
    """The side of a join that tasks hold part by part, a row a chunk.

    Sizes of stored tables are those of their compressed files, by which Spark would send samples to the driver to broadcast them.
    """
    return small.hint("shuffle_hash")


def chunk_col(order: str | Column, size: float) -> Column:
    c = F.col(order) if isinstance(order, str) else order
    return F.floor(c / F.lit(size)).cast("bigint")


# ---------------------------------------------------------------- row numbers
def number_rows(df: DataFrame, key: str, order_cols: list[str], out: str, label: str, keep: list[str] | None = None) -> DataFrame:
    """0-based position of each row inside ``key``, for keys of any size.

    Rows are range-partitioned on key and order columns (a large key spreads over many partitions), sorted and
    counted in their partition, and stored with that count (``keep``: with these columns only). Only the first key of a
    partition can have rows in earlier ones, so what is missing is one number a partition and no row moves twice.
    """
    ranged = df.repartitionByRange(key, *order_cols).sortWithinPartitions(key, *order_cols)
    placed = ranged.withColumns({"_part": F.spark_partition_id(), "_in": _place_in_run(F.col(key))})
    stored = materialise(placed.select(*(df.columns if keep is None else [key, *keep]), "_part", "_in"), label)
    before = W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = stored.groupBy(F.col(key).alias("_key"), "_part").agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.withColumn("_before", F.sum("_c").over(before)).filter("_before > 0")
    starts = materialise(starts.select("_key", F.col("_part").alias("_at"), "_before"), f"{label}-starts")
    found = stored.join(F.broadcast(starts), (F.col("_part") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    at = (F.col("_in") + F.coalesce("_before", F.lit(0))).cast("bigint")
    return found.withColumn(out, at).drop("_part", "_in", "_key", "_at", "_before")


def _place_in_run(key: Column) -> Column:
    """0-based place of each row in its run of equal keys, over all batches of a partition."""

    @F.arrow_udf("long")
    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        last, n = None, 0
        for keys in batches:
            if not len(keys):
                yield pa.array([], pa.int64())
                continue
            ends = pc.run_end_encode(keys).run_ends.to_numpy()
            size = np.diff(ends, prepend=0)
            at = np.arange(len(keys), dtype=np.int64) - np.repeat(ends - size, size)
            if last is not None and keys[0].equals(last):
                at[: ends[0]] += n
            last, n = keys[-1], int(at[-1]) + 1
            yield pa.array(at)

    return place.asNondeterministic()(key)


# ---------------------------------------------------------------- halo frames
def with_halo(df: DataFrame, order: str, size: int, before: int, after: int) -> DataFrame:
    """Give each row to every chunk that needs it; ``_core`` marks the owner."""
    own = chunk_col(order, size)
    first = F.greatest(F.lit(0), F.floor((F.col(order) - after) / F.lit(size)).cast("bigint"))
    last = F.floor((F.col(order) + before) / F.lit(size)).cast("bigint")
    return (
        df.withColumn("_own", own)
        .withColumn("_chunk", F.explode(F.sequence(first, last)))
        .withColumn("_core", F.col("_own") == F.col("_chunk"))
        .drop("_own")
    )


@dataclass(frozen=True)
class Frames:
    frame: object
    ordered: object


def rolling(
    df: DataFrame,
    keys: list[str],
    order: str,
    passes: list[dict[str, Callable[[object], Column]]],
    before: int,
    after: int,
    size: int = CHUNK,
) -> DataFrame:
    """Row-frame expressions over a dense integer order axis.

    ``passes`` are applied in turn (a later pass may read an earlier result); each
    maps an output name to ``fn(frames) -> Column`` with ``frames.frame`` the window of
    ``before`` rows to ``after`` rows and ``frames.ordered`` the unframed window.
    """
    n = len(passes)
    out = with_halo(df, order, size, before * n, after * n)
    ordered = W.partitionBy(*keys, "_chunk").orderBy(order)
    frames = Frames(ordered.rowsBetween(-before, after), ordered)
    for step in passes:
        out = out.withColumns({name: fn(frames) for name, fn in step.items()})
    return out.filter("_core").drop("_chunk", "_core")


# ---------------------------------------------------------------- carries
@dataclass(frozen=True)
class Carry:
    """``kind``: last, first (skip nulls; backward for first), min, max, sum (prefix)."""

    out: str
    expr: Column
    kind: str
    exclusive: bool = False


def carried(
    df: DataFrame,
    keys: list[str],
    order_cols: list[str],
    chunk: Column,
    specs: list[Carry],
) -> DataFrame:
    """Whole-recording prefix and suffix values through per-chunk carries."""
    temps = {f"_x{i}": s.expr for i, s in enumerate(specs)}
    base = df.withColumns({"_chunk": chunk, **temps})
    order = F.struct(*order_cols) if len(order_cols) > 1 else F.col(order_cols[0])

    # Backward values run over a descending order: a frame that starts at the current row would be
    # re-aggregated for every row.
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order_cols)
    across = W.partitionBy(*keys).orderBy("_chunk")
    inside_back = W.partitionBy(*keys, "_chunk").orderBy(*[F.col(c).desc() for c in order_cols])
    across_back = W.partitionBy(*keys).orderBy(F.col("_chunk").desc())
    chunk_aggs, carries, within = [], {}, {}
    for i, s in enumerate(specs):
        x = F.col(f"_x{i}")
        back = s.kind == "first"
        edge = -1 if s.exclusive else 0
        frame = (inside_back if back else inside).rowsBetween(W.unboundedPreceding, edge)
        outer = (across_back if back else across).rowsBetween(W.unboundedPreceding, -1)
        valid_order = F.when(x.isNotNull(), order)
        agg, local, carry = {
            "last": (F.max_by(x, valid_order), F.last(x, True), F.last(f"_a{i}", True)),
            "first": (F.min_by(x, valid_order), F.last(x, True), F.last(f"_a{i}", True)),
            "min": (F.min(x), F.min(x), F.min(f"_a{i}")),
            "max": (F.max(x), F.max(x), F.max(f"_a{i}")),
            "sum": (F.sum(x), F.sum(x), F.sum(f"_a{i}")),
        }[s.kind]
        chunk_aggs.append(agg.alias(f"_a{i}"))
        carries[f"_c{i}"] = carry.over(outer)
        within[f"_w{i}"] = local.over(frame)

    summary = base.groupBy(*keys, "_chunk").agg(*chunk_aggs).withColumns(carries)
    summary = summary.drop(*[f"_a{i}" for i in range(len(specs))])
    joined = base.withColumns(within).join(held(summary), [*keys, "_chunk"])

    result = {}
    for i, s in enumerate(specs):
        a, c = F.col(f"_w{i}"), F.col(f"_c{i}")
        result[s.out] = {
            "min": F.least(a, c),
            "max": F.greatest(a, c),
            "sum": F.coalesce(a, F.lit(0)) + F.coalesce(c, F.lit(0)),
        }.get(s.kind, F.coalesce(a, c))
    drop = ["_chunk"] + [f"_{p}{i}" for i in range(len(specs)) for p in "xwc"]
    return joined.withColumns(result).drop(*drop)


def with_totals(
    df: DataFrame, keys: list[str], chunk: Column, partials: dict[str, Column], totals: dict[str, Column]
) -> DataFrame:
    """Attach whole-group aggregates to every row without a join on the (hot) group key.

    ``partials`` are per-chunk aggregates, ``totals`` combine them (as window
    aggregates over the group's chunk rows); the join back is on (group, chunk).
    """
    base = df.withColumn("_chunk", chunk)
    w = W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    summary = (
        base.groupBy(*keys, "_chunk")
        .agg(*[c.alias(n) for n, c in partials.items()])
        .select(*keys, "_chunk", *[c.over(w).alias(n) for n, c in totals.items()])
    )
    return base.join(held(summary), [*keys, "_chunk"]).drop("_chunk")


def join_group(df: DataFrame, group: DataFrame, keys: list[str], chunk: Column, how: str = "left") -> DataFrame:
    """Attach one row per group to every row of the group without a join on the group key.

    The group row is first spread over the group's chunks (a small table), so a group
    with a third of all rows still joins in many tasks.
    """
    base = df.withColumn("_chunk", chunk)
    spread = base.select(*keys, "_chunk").distinct().join(held(group), keys, how)
    return base.join(held(spread), [*keys, "_chunk"]).drop("_chunk")


# ---------------------------------------------------------------- runs of true
def runs(df: DataFrame, keys: list[str], order: str, flag: Column, size: int = CHUNK) -> DataFrame:
    """Maximal runs of true flags: ``(keys, run_start, run_end, run_len)``; dense order axis."""
    base = df.select(*keys, F.col(order).alias("_i"), chunk_col(order, size).alias("_chunk")).where(flag)
    island = W.partitionBy(*keys, "_chunk").orderBy("_i")
    pieces = (
        base.withColumn("_g", F.col("_i") - F.row_number().over(island))
        .groupBy(*keys, "_chunk", "_g")
        .agg(F.min("_i").alias("run_start"), F.max("_i").alias("run_end"))
        .drop("_g")
    )
    return merge_pieces(pieces, keys, size)


def merge_pieces(pieces: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Join pieces that continue over a chunk edge; inner pieces pass through untouched."""
    touches = ((F.col("run_start") == F.col("_chunk") * size) & (F.col("_chunk") > 0)) | (
        F.col("run_end") == (F.col("_chunk") + 1) * size - 1
    )
    cols = [*keys, "run_start", "run_end"]
    inner = pieces.filter(~touches).select(*cols)
    w = W.partitionBy(*keys).orderBy("run_start")
    merged = (
        pieces.filter(touches)
        .withColumn("_new", F.coalesce(F.col("run_start") != F.lag("run_end").over(w) + 1, F.lit(True)).cast("int"))
        .withColumn("_id", F.sum("_new").over(w))
        .groupBy(*keys, "_id")
        .agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"))
        .select(*cols)
    )
    return inner.unionByName(merged).withColumn("run_len", F.col("run_end") - F.col("run_start") + 1)


def longest_run(df: DataFrame, keys: list[str], order: str, flag: Column, size: int = CHUNK) -> DataFrame:
    """The longest run per key, first one on ties. Aggregates with map-side combine."""
    best = F.min_by(
        F.struct("run_start", "run_end", "run_len"),
        F.struct((-F.col("run_len")).alias("a"), F.col("run_start").alias("b")),
    )
    return (
        runs(df, keys, order, flag, size)
        .groupBy(*keys)
        .agg(best.alias("_b"))
        .select(*keys, "_b.run_start", "_b.run_end", "_b.run_len")
    )


# ---------------------------------------------------------------- exact percentiles
def sortable(value: Column) -> Column:
    """A long in the order of the doubles: the sign bit stays, other bits of negative numbers are turned round."""

    @F.pandas_udf("long")
    def bits(v: pd.Series) -> pd.Series:
        b = (v.to_numpy(dtype=np.float64) + 0.0).view(np.int64)  # -0.0 becomes 0.0
        return pd.Series(np.where(b < 0, b ^ np.int64(2**63 - 1), b))

    return bits(value.cast("double"))


def unsorted(key: Column) -> Column:
    """The double of a ``sortable`` long."""

    @F.pandas_udf("double")
    def value(k: pd.Series) -> pd.Series:
        b = k.to_numpy(dtype=np.int64)
        return pd.Series(np.where(b < 0, b ^ np.int64(2**63 - 1), b).view(np.float64))

    return value(key)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: list[float], bits: int = 16) -> DataFrame:
    """Exact linear-interpolation percentiles for groups of any size, by radix selection.

    Doubles become longs of the same order, stored once. A pass counts the rows of each group by their leading digit
    (``bits`` bits; counted in the tasks first), running sums tell which digit holds a sought rank, and the next
    pass counts the following digit of the rows that share it. After 64 / ``bits`` passes the digits are the value. A
    group never has more than 2 ** ``bits`` counts a rank, and no row is moved or ranked. NULLs are left out, NaN is the
    largest value. Output: keys, ``q`` (array aligned with ``probs``), ``n``.
    """
    k = keys or ["_all"]
    data = df.filter(F.col(value).isNotNull()).withColumns({} if keys else {"_all": F.lit(1)})
    data = materialise(data.select(*k, sortable(F.col(value)).alias("_k")), "percentile-keys")
    lead = lambda i: F.shiftright("_k", 64 - bits * i)

    def found(counts: DataFrame, sought: DataFrame, on: list[str], label: str) -> DataFrame:
        """The digits that hold the sought ranks, and the ranks inside them."""
        upto = F.sum("_c").over(W.partitionBy(*on).orderBy("_digits"))
        placed = counts.withColumn("_upto", upto).withColumn("_lo", F.col("_upto") - F.col("_c"))
        met = sought.join(placed, on).filter((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_upto")))
        return materialise(met.select(*k, "n", "_j", "_side", (F.col("_rank") - F.col("_lo")).alias("_rank"), F.col("_digits").alias("_p")), label)

    counts = materialise(data.groupBy(*k, lead(1).alias("_digits")).agg(F.count(F.lit(1)).alias("_c")), "percentile-counts")
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = F.array(*[F.struct(F.lit(j).alias("_j"), F.lit(side).alias("_side"), cut(place(p)).cast("long").alias("_rank"))
                      for j, p in enumerate(probs) for side, cut in enumerate((F.floor, F.ceil))])
    sought = counts.groupBy(*k).agg(F.sum("_c").alias("n")).select(*k, "n", F.explode(ranks).alias("_r")).select(*k, "n", "_r.*")
    sought = found(counts, sought, k, "percentile-digits")
    for i in range(2, 64 // bits + 1):
        open_ = sought.select(*k, "_p").distinct()
        held = data.withColumn("_p", lead(i - 1)).join(open_, [*k, "_p"])
        counts = held.groupBy(*k, "_p", lead(i).alias("_digits")).agg(F.count(F.lit(1)).alias("_c"))
        sought = found(counts, sought, [*k, "_p"], "percentile-digits")
    ends = sought.groupBy(*k, "n", "_j").agg(F.max(F.when(F.col("_side") == 0, F.col("_p"))).alias("_a"), F.max(F.when(F.col("_side") == 1, F.col("_p"))).alias("_b"))
    ends = ends.withColumns({"_a": unsorted(F.col("_a")), "_b": unsorted(F.col("_b"))})
    h = F.element_at(F.array(*[place(p) for p in probs]), F.col("_j") + 1)
    between = F.col("_a") + (F.col("_b") - F.col("_a")) * (h - F.floor(h))
    q = ends.select(*k, "n", "_j", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(between).alias("_q"))
    return q.groupBy(*k, "n").agg(F.array_sort(F.collect_list(F.struct("_j", "_q"))).alias("_s")).select(*keys, F.expr("transform(_s, s -> s._q)").alias("q"), "n")
