"""Importance resampling towards a target distribution.

Hashed word runs are counted over all documents and over the target texts; an array holds each bucket's gain, the
scaled log of how much likelier the target is to show it. A document's weight is the mean gain of its features,
and adding Gumbel noise of its key to the weight turns "the highest scores" into a draw without replacement.

The draw never sorts the table. Distributed quickselect finds the last key that is still drawn: random pivot keys
are counted against all rows left (before, equal, after), the interval that holds the sought place is kept, and
the next pivots come from it, until a pivot is the key itself. Keys are (score down, document key, place), so no two
are equal. Only rows up to that key are dealt out by range, sorted and ranked; ranks are places within a range plus
the sizes of the ranges before.

Buckets of all features are stored as small integers, one array a document: texts are cut once, and scoring is a
lookup of arrays in an array.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from wristwave.llm.common import alnum_words, fresh_name, let, materialise, ship

BUCKETS = 10_000
LEAST_WORDS = 20
SCALE = 1000
#: Pivot keys a round, the only rows that reach the driver; they set the number of rounds, not the result.
PIVOTS = 24


def features(words: Column, most: int) -> Column:
    """All runs of 1 to ``most`` consecutive words, each joined by one space, repeats included."""
    if most == 1:
        return words

    def runs(w: Column) -> Column:
        cut = lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        longer = [F.when(F.size(w) >= n, cut(n)).otherwise(F.array().cast("array<string>")) for n in range(2, most + 1)]
        return F.concat(w, *longer)

    return let(words, runs)


def _bucketed(texts: DataFrame, text: str, words: str, out: str, most: int, buckets: int) -> DataFrame:
    """The table with the number of words and the bucket of each feature in place of the text's words."""
    place = lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int")
    cut = texts.withColumn(out, alnum_words(F.col(text)))
    return cut.withColumn(words, F.size(out).cast("long")).withColumn(out, F.transform(features(F.col(out), most), place))


def histogram(rows: DataFrame, column: str, buckets: int) -> list[int]:
    """How often each bucket occurs: counted in the tasks first, ``buckets`` numbers reach the driver."""
    out = [0] * buckets
    for k, n in rows.select(F.explode(column).alias("k")).groupBy("k").count().collect():
        out[k] = n
    return out


def gains(raw: list[int], target: list[int]) -> list[int]:
    """Scaled log ratio of each bucket's smoothed share in the target to that in the raw texts, floored."""
    n = len(raw)
    s, t = sum(raw) + n, sum(target) + n
    return [math.floor(SCALE * math.log(float((b + 1) * s) / float((a + 1) * t))) for a, b in zip(raw, target, strict=True)]


def gumbel(key: Column, seed: int) -> Column:
    """Scaled Gumbel noise from 32 bits of a digest of ``seed:key``; a null key is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def mean_gain(rows: DataFrame, buckets: str, out: str, gain: list[int]) -> DataFrame:
    """The table with the floored mean gain of its buckets (0 for none) in place of the buckets."""
    ship(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(np.array(gain, dtype=np.int64))
    kept = [c for c in rows.columns if c != buckets]
    schema = rows.select(*kept, F.lit(0).cast("long").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(buckets))
            ends = lists.offsets.to_numpy()
            sums = np.concatenate([[0], np.cumsum(gain[lists.values.to_numpy()[: ends[-1]]])])
            n = ends[1:] - ends[:-1]
            weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(weight)], [*kept, out])

    return rows.mapInArrow(run, schema)


def kth(rows: DataFrame, order: list[str], k: int, seed: int = 0) -> Row | None:
    """The k-th row (from 1) of the columns ``order``, which hold no nulls and no two equal rows; none beyond the last.

    Each round takes ``PIVOTS`` random keys of the rows left and counts, in one pass, the rows before and equal to each.
    """
    at, types = F.struct(*order), dict(rows.dtypes)

    def lit(p: Row) -> Column:
        return F.struct(*[F.lit(p[c]).cast(types[c]).alias(c) for c in order])

    low, high = None, None
    while True:
        left = rows.select(*order)
        left = left if low is None else left.filter(at > lit(low))
        left = left if high is None else left.filter(at < lit(high))
        pivots = sorted(left.orderBy(F.xxhash64(F.lit(seed), *order), *order).limit(PIVOTS).collect())
        if not pivots:
            return None
        counts = left.agg(*[F.count_if(at < lit(p)) for p in pivots], *[F.count_if(at == lit(p)) for p in pivots]).first()
        passed = 0
        for p, before, equal in zip(pivots, counts, counts[len(pivots) :], strict=False):
            if before < k <= before + equal:
                return p
            if k <= before:
                high = p
                break
            low, passed = p, before + equal
        k, seed = k - passed, seed + 1


def ranked(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """The table with each row's place (from 1) in the order of the columns, which no two rows share.

    Rows are dealt out by range and sorted in their tasks; sizes of the ranges, a row each, are summed up.
    """
    at, before = fresh_name(rows, "rank_at"), fresh_name(rows, "rank_before")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialise(dealt.withColumn(at, F.monotonically_increasing_id()), "resample_ranges")
    part, within = F.shiftrightunsigned(F.col(at), 33), F.col(at).bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(part.alias(before)).agg((F.max(within) + 1).alias("n")).collect()  # one row a range
    begins, total = {}, 0
    for r in sorted(sizes):
        begins[r[0]], total = total, total + r[1]
    if not begins:
        return dealt.withColumn(at, F.lit(None).cast("long")).withColumnRenamed(at, out)
    offset = rows.sparkSession.createDataFrame(list(begins.items()), f"{before} long, {out} long")
    met = dealt.withColumn(before, part).join(F.broadcast(offset), before)
    return met.select(*rows.columns, (F.col(out) + within + 1).alias(out))


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, percent: int = 10,
    least_words: int = LEAST_WORDS, most: int = 1, buckets: int = BUCKETS, seed: int = 2024,
) -> DataFrame:
    """One row per row of ``docs``: its columns (or those in ``keep``) and a struct ``resample`` of n_features, weight, score, rank.

    Of the documents with at least ``least_words`` words the floor of ``percent`` hundredths with the highest scores is
    drawn and ranked from 1; rank is null for the rest. ``target``: texts in a column called like ``text``. Ties go to the
    smaller key, null keys last, then to the place in the table, so repeated rows are documents of their own. Null, empty
    and wordless texts have no features and weight 0; long texts are scored whole. An empty table gives an empty result,
    an empty target makes rare features gain. A column called ``resample`` is replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != "resample"]
    inner = [f"k{i}" for i in range(len(kept))]
    narrow = docs.select(*[F.col(c).alias(i) for c, i in zip(kept, inner, strict=True)], F.col(text).alias("t"), F.col(key).alias("key"))
    cut = _bucketed(narrow, "t", "n_words", "buckets", most, buckets)
    n = F.size("buckets").cast("long")
    cut = cut.select(*inner, "key", "n_words", n.alias("n_features"), F.col("buckets"), F.monotonically_increasing_id().alias("place"))
    cut = materialise(cut, "resample_buckets")
    wanted = _bucketed(target.select(F.col(text).alias("t")), "t", "n_words", "buckets", most, buckets)
    gain = gains(histogram(cut, "buckets", buckets), histogram(wanted, "buckets", buckets))
    scored = mean_gain(cut, "buckets", "weight", gain).withColumn("score", F.col("weight") + gumbel(F.col("key"), seed))
    # what the order is by, without nulls: score down, null keys last, key, place
    order = ["down", "keyless", "id", "place"]
    whole = dict(cut.dtypes)["key"] in ("tinyint", "smallint", "int", "bigint")
    id_ = F.coalesce(F.col("key").cast("long" if whole else "string"), F.lit(0 if whole else ""))
    scored = materialise(scored.withColumns({"down": -F.col("score"), "keyless": F.col("key").isNull(), "id": id_}), "resample_scores")
    entrants = scored.filter(F.col("n_words") >= least_words)
    k = entrants.count() * percent // 100
    last = kth(entrants, order, k) if k else None
    told = [*inner, "n_features", "weight", "score"]
    if last is None:
        drawn, rest = scored.limit(0).withColumn("rank", F.lit(None).cast("long")), scored
    else:
        types = dict(scored.dtypes)
        upto = F.struct(*order) <= F.struct(*[F.lit(last[c]).cast(types[c]).alias(c) for c in order])
        wins = (F.col("n_words") >= least_words) & upto
        drawn, rest = ranked(scored.filter(wins).select(*told, *order), order, "rank"), scored.filter(~wins)
    both = drawn.select(*told, "rank").unionByName(rest.select(*told, F.lit(None).cast("long").alias("rank")))
    return both.select(*[F.col(i).alias(c) for i, c in zip(inner, kept, strict=True)], F.struct("n_features", "weight", "score", "rank").alias("resample"))
