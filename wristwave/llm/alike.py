"""Near-duplicates by the Jaccard likeness of word shingles.

Candidates share a MinHash band: ``BANDS`` keys of ``ROWS`` minima each, so a pair that is 0.8 alike is met with
a probability of 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.9995, a pair that is 0.9 alike practically always. Every link is verified by
the exact likeness of the whole shingle sets; bands alone link nothing.

Texts with equal sets collapse first. Every member of a band is verified against the band's first one in a join,
which settles dense groups in linear work. Bands of three or more texts that this leaves in several components
are walked by one task each: members are compared with all that are not in their component yet, so components are
those that all pairs of the band would give. Such a task holds the sets of one band, eight bytes a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wristwave.llm.common import fresh_name, materialise, ship, split_rows
from wristwave.llm.components import connect
from wristwave.llm.line_dedup import may_be_in

SEED, SIZE = 42, 5
#: Texts are near from this likeness on: a fraction, so that it is compared in whole numbers.
LIKE, OF = 4, 5
BANDS, ROWS = 25, 6
BLOCK = 1 << 10

_RNG = np.random.default_rng(SEED)
_TIMES, _PLUS = (_RNG.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle, one without words has none."""
    w = (text or "").encode().lower().split()  # ASCII only, in both
    if not w:
        return np.zeros(0, dtype=np.uint64)
    ends, digest, joined = np.cumsum([len(x) + 1 for x in w]), xxhash.xxh64_intdigest, b" ".join(w)
    starts, stops = [0, *ends[:-1].tolist()], (ends - 1)[min(size, len(w)) - 1 :].tolist()
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=False)), dtype=np.uint64))


def bands(h: np.ndarray) -> list[int]:
    """One signed key per band of minima; none for an empty set."""
    if not len(h):
        return []
    low = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(h), BLOCK):
        low = np.minimum(low, (_TIMES * h[at : at + BLOCK] + _PLUS).min(axis=1))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(low.reshape(BANDS, ROWS))]
    return np.array(keys, dtype=np.uint64).astype(np.int64).tolist()


def _marks(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        out = []
        for t in batch:
            h = shingles(t)
            both = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), dtype=np.int64)
            out.append((int(both[0]), int(both[1]), bands(h)))
        yield pd.DataFrame(out, columns=["d1", "d2", "bands"])


def _sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([shingles(t).astype(np.int64) for t in batch])


def alike(a: Column, b: Column) -> Column:
    """Whether two sets are near by their exact likeness."""
    n, m, met = F.size(a), F.size(b), F.size(F.array_intersect(a, b))
    far = F.least(n, m) * OF < F.greatest(n, m) * LIKE
    return F.when(far, False).otherwise(met * (OF + LIKE) >= (n + m) * LIKE)


def band_links(comp: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (places in the band) that join the components of a band as all its pairs would."""
    out, left = [], np.arange(len(comp))
    while len(left):
        inside = comp[left] == comp[left[0]]
        ahead, left = left[inside].tolist(), left[~inside]
        while ahead and len(left):
            x = ahead.pop()
            size = np.array([len(sets[i]) for i in left])
            met = np.isin(np.concatenate([sets[i] for i in left]), sets[x])
            met = np.add.reduceat(met, np.cumsum(size) - size)
            hit = left[met * (OF + LIKE) >= (size + len(sets[x])) * LIKE]
            if len(hit):
                out += [(x, int(i)) for i in hit]
                with_hit = np.isin(comp[left], comp[hit])
                ahead, left = ahead + left[with_hit].tolist(), left[~with_hit]
    return out


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, comp, node, set) sorted by key to links."""
    now, comp, node, sets = None, [], [], []

    def found() -> pa.RecordBatch:
        got = band_links(np.array(comp), sets)
        return pa.RecordBatch.from_arrays([pa.array([node[p[i]] for p in got], pa.int64()) for i in range(2)], ["src", "dst"])

    for batch in batches:
        held = batch.column(3)
        ends, flat = held.offsets.to_numpy(), held.values.to_numpy()
        for i, (key, c, n) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
            if key != now and node:
                yield found()
                comp, node, sets = [], [], []
            now = key
            comp.append(c), node.append(n), sets.append(flat[ends[i] : ends[i + 1]].copy())
    if node:
        yield found()


def links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(src, dst) links that connect nodes as all near pairs with a common band would.

    ``nodes``: (node, bands), one row per distinct set; ``texts``: (node, text) of these at least.
    """
    ship(nodes.sparkSession)
    band = Window.partitionBy("key")
    met = nodes.select("node", F.explode("bands").alias("key")).withColumns({"lead": F.min("node").over(band), "n": F.count(F.lit(1)).over(band)})
    met = materialise(met.filter("n > 1"), "alike_bands")
    ids = met.select("node").distinct().withColumn("h", F.xxhash64("node"))
    some = may_be_in(texts.select(F.col("node").alias("at"), "text").withColumn("h", F.xxhash64("at")), ids, "h").drop("h")
    sets = some.join(ids.drop("h"), F.col("at") == F.col("node"))  # a semi-join would be pushed below the bitmap
    sets = materialise(sets.select("node", F.pandas_udf(_sets, "array<long>")("text").alias("s")), "alike_sets")
    pairs = met.filter("node != lead").select("node", "lead").distinct()
    both = pairs.join(sets, "node").join(sets.select(F.col("node").alias("lead"), F.col("s").alias("t")), "lead")
    first = materialise(both.filter(alike(F.col("s"), F.col("t"))).select(F.col("node").alias("src"), F.col("lead").alias("dst")), "alike_links")
    # bands of three or more in which that left several components; of bands with the same members one
    named = met.filter("n > 2").select("key", "node").join(connect(first), "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    named = materialise(named, "alike_named")
    per = named.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.bit_xor(F.xxhash64("node")).alias("who"), F.count(F.lit(1)).alias("n"))
    still = per.filter("a != b").groupBy("who", "n").agg(F.min("key").alias("key")).select("key")
    rows = named.join(still, "key").join(sets, "node").select("key", "comp", "node", "s")
    rest = rows.repartition("key").sortWithinPartitions("key", "comp", "node").mapInArrow(_walk, "src long, dst long")
    return materialise(first.unionByName(rest.distinct()), "alike_links")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The table with one row of each component of near texts: the least (key, place in the table), null keys last.

    Columns are those of the table, whatever they are called. Null, empty and wordless texts are one group; of
    identical rows one stays. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    mark, row = fresh_name(docs, "alike"), fresh_name(docs, "row_place")
    marks = F.pandas_udf(_marks, "d1 long, d2 long, bands array<long>")(F.col(text))
    stored = materialise(docs.withColumn(mark, marks).withColumn(row, F.monotonically_increasing_id()), "alike_docs")
    first = F.min(F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), F.col(row).alias("place")))
    nodes = stored.groupBy(F.col(f"{mark}.d1").alias("d1"), F.col(f"{mark}.d2").alias("d2")).agg(first.alias("first"), F.first(f"{mark}.bands").alias("bands"))
    nodes = materialise(nodes.select(F.col("first.place").alias("node"), "first", "bands"), "alike_nodes")
    parts = connect(links(nodes.select("node", "bands"), stored.select(F.col(row).alias("node"), F.col(text).alias("text"))))
    named = nodes.select("node", "first").join(parts, "node", "left").groupBy(F.coalesce("component", "node").alias("c"))
    keep = named.agg(F.min("first").alias("first")).select(F.col("first.place").alias("place"))
    place = fresh_name(docs, "gone_place")
    gone = materialise(stored.select(F.col(row).alias(place)).join(keep, F.col(place) == F.col("place"), "left_anti"), "alike_gone")
    # texts stay where they are but for those that may have to go
    may, rest = split_rows(stored, gone.select(F.xxhash64(place).alias("h")), F.col(row))
    return may.join(gone, may[row] == gone[place], "left_anti").unionByName(rest).drop(mark, row)
