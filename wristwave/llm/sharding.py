"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Every input partition draws, exactly and without rejection, how many of its rows go to each block of each
shard (multivariate hypergeometric rows of a matrix whose margins are the partition and block sizes).
Rows are permuted inside their partition, cut by the matrix row, exchanged by block and permuted again
inside the block. Every order of all rows is then equally likely, up to the pseudo-random generator, and
shard sizes differ by one row at most.

Only the row counts of partitions reach the driver (at most ``PARTS`` of them); the matrix has at most
``PARTS`` x ``BLOCKS`` integers whatever the input. Shards are cut into blocks so that no task sorts a
whole shard. Texts move once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wristwave.llm.common import fresh_name, materialise, ship

PARTS, BLOCKS, BLOCK_ROWS = 1024, 4096, 20_000


def even(total: int, n: int) -> list[int]:
    return [total // n + (i < total % n) for i in range(n)]


def matrix(parts: list[int], blocks: list[int], seed: int) -> np.ndarray:
    """Rows of each part that go to each block; margins are exact."""
    rng, left = np.random.default_rng([seed, 0]), np.array(blocks, dtype=np.int64)
    out = np.zeros((len(parts), len(blocks)), dtype=np.int64)
    for i, n in enumerate(parts):
        out[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
        left -= out[i]
    return out


@lru_cache(maxsize=4)
def order(seed: int, part: int, n: int) -> np.ndarray:
    return np.random.default_rng([seed, 1, part]).permutation(n)


def shuffle(docs: DataFrame, shards: int, seed: int = 7, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Every row and column of the table, with its shard (0 to shards - 1) and place in it (gapless from 0).

    Values are never looked at: nulls, repeated rows, ties and long texts are rows like any other. Fewer
    rows than shards leave some shards empty; an empty table gives an empty result. A column that is called
    like ``shard`` or ``slot`` is replaced. The result depends on the seed and on how the table is partitioned.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in (shard.lower(), slot.lower())])
    part, place, block, number, before = (fresh_name(docs, c) for c in ("in_part", "in_place", "to_block", "part_number", "rows_before"))
    # part and place are stored with the rows, so a task that runs again gives them the same fate
    marked = docs.withColumn(place, F.monotonically_increasing_id())
    stored = materialise(marked, "shard_rows")
    scan, within = F.shiftrightunsigned(F.col(place), 33).cast("int"), F.col(place).bitwiseAND((1 << 33) - 1)
    # scan partitions that hold rows are numbered without gaps; those of one residue count through one another
    top = stored.groupBy(scan.alias("s")).agg((F.max(within) + 1).alias("n"))
    nth = F.row_number().over(Window.orderBy("s")) - 1  # one row a partition
    begin = Window.partitionBy("p").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    top = materialise(top.withColumn("p", (nth % PARTS).cast("long")).withColumn("b", F.coalesce(F.sum("n").over(begin), F.lit(0))), "shard_parts")
    sizes = {r[0]: r[1] for r in top.groupBy("p").agg(F.sum("n")).collect()}  # at most PARTS rows
    if not sizes:
        return stored.select(*docs.columns, F.lit(0).alias(shard), F.lit(0).cast("long").alias(slot)).limit(0)
    stored = stored.withColumn(part, scan).join(top.select(F.col("s").alias(part), F.col("p").alias(number), F.col("b").alias(before)), part)
    stored = stored.withColumn(place, F.col(number) * (1 << 33) + within + F.col(before)).drop(part, number, before)
    parts = sorted(sizes)
    total = sum(sizes.values())
    per = min(max(1, BLOCKS // shards), max(1, round(total / shards / BLOCK_ROWS)))
    blocks = [n for s in even(total, shards) for n in even(s, per)]
    cuts = matrix([sizes[p] for p in parts], blocks, seed).cumsum(axis=1)
    starts = np.array(blocks).reshape(shards, per).cumsum(axis=1) - np.array(blocks).reshape(shards, per)
    sent = spark.sparkContext.broadcast((parts, [sizes[p] for p in parts], cuts))

    def deal(places: Iterator[pd.Series]) -> Iterator[pd.Series]:
        parts, sizes, cuts = sent.value
        for batch in places:
            x = batch.to_numpy()
            p, i, out = x >> 33, x & ((1 << 33) - 1), np.empty(len(x), dtype=np.int32)
            for k in np.unique(p):
                row, mine = parts.index(k), p == k
                out[mine] = np.searchsorted(cuts[row], order(seed, int(k), sizes[row])[i[mine]], side="right")
            yield pd.Series(out)

    dealt = stored.withColumn(block, F.pandas_udf(deal, "int")(F.col(place)))
    again = Window.partitionBy(block).orderBy(F.xxhash64(F.lit(seed), F.col(place)), F.col(place))
    begins = F.element_at(F.array(*[F.lit(int(b)) for b in starts.ravel()]), F.col(block) + 1) if per > 1 else F.lit(0)
    out = dealt.withColumn(slot, (F.row_number().over(again) - 1 + begins).cast("long"))
    return out.select(*docs.columns, F.floor(F.col(block) / per).cast("int").alias(shard), slot)
