"""Near-duplicates by SimHash with deletion-variant signatures.

Two fingerprints within ``radius`` bits, cut into ``radius // 2 + 1`` segments, agree in some segment up to
one bit (pigeonhole). Every fingerprint is indexed once for each segment and each masked bit of it: equal
signatures mean at most one differing bit there. Rows with equal signatures are verified by XOR.

Texts with equal fingerprints collapse first. The index is dealt out by signature and sorted, and tasks walk
over it bucket by bucket. Components need no list of all pairs: a large bucket is searched from one member to
the next, and whoever is reached is not looked at again, so a dense group costs one pass and gives one link a
member. What a task holds is one Arrow batch or the fingerprints of one bucket, eight bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wristwave.llm.common import fresh_name, materialise, ship, split_rows
from wristwave.llm.components import connect

SEED = 42
BLOCK = 1 << 16
#: Runs up to this length are compared in whole arrays.
SHORT = 32


def simhash(text: str | None, size: int = 4) -> int:
    """Unsigned 64-bit fingerprint: a bit is set if it is in over half of the shingle hashes."""
    w = (text or "").encode().lower().split()  # ASCII only, in both
    if not w:
        return 0
    joined, n = b" ".join(w), max(1, len(w) - size + 1)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1)[min(size, len(w)) - 1 :].tolist()
    votes, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + BLOCK)], stops[at : at + BLOCK], strict=False)), dtype=">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", size: int = 4) -> DataFrame:
    """The table with a signed 64-bit fingerprint of each whole text; null or wordless text: zero."""
    ship(docs.sparkSession)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([simhash(t, size) for t in batch], dtype=np.uint64).astype(np.int64))

    return docs.withColumn(out, F.pandas_udf(run, "long")(F.col(text)))


def signatures(fp: Column, radius: int) -> Column:
    """One long per segment and masked bit: the segment's bits without that bit, below a number for the pair."""
    n = radius // 2 + 1
    edges = [64 * k // n for k in range(n + 1)]
    out, kind = [], 0
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = F.shiftrightunsigned(fp, lo).bitwiseAND((1 << (hi - lo)) - 1) if hi - lo < 64 else fp
        for bit in range(hi - lo):
            masked = part.bitwiseAND(~(1 << bit))
            out.append(F.lit(kind << 57).bitwiseOR(masked) if hi - lo <= 56 else F.xxhash64(F.lit(kind), masked))
            kind += 1
    return F.array(*out)


def differing(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers it counts the absolute value's bits


def reach(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect the fingerprints as all pairs within the radius would, one for each that is reached."""
    out = []
    while len(fps) > 1:
        ahead, fps = [fps[0]], fps[1:]
        while ahead and len(fps):
            x = ahead.pop()
            near = differing(fps, x) <= radius
            if near.any():
                hit, fps = fps[near], fps[~near]
                out.append((np.full(len(hit), x), hit))
                ahead.extend(hit)
    return out


def bucket_links(sig: np.ndarray, fp: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links inside the runs of equal signatures: short runs at once, shifted against themselves, long ones by reach()."""
    edge = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    size = np.diff(np.append(edge, len(sig)))
    out = []
    for a, n in zip(edge[size > SHORT], size[size > SHORT], strict=True):
        out += reach(fp[a : a + n], radius)
    few = np.repeat((size > 1) & (size <= SHORT), size)
    sig, fp = sig[few], fp[few]
    for d in range(1, min(SHORT, len(sig))):
        same = sig[d:] == sig[:-d]
        if not same.any():
            break
        near = same & (differing(fp[d:], fp[:-d]) <= radius)
        out.append((fp[:-d][near], fp[d:][near]))
    return out


def links(fps: DataFrame, radius: int) -> DataFrame:
    """(src, dst) links that connect distinct fingerprints exactly as all pairs within the radius would."""
    ship(fps.sparkSession)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the bucket that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if held and held[0][0][0] == sig[-1]:
                held.append((sig, fp))
                continue
            last = int(np.searchsorted(sig, sig[-1]))
            yield found([*held, (sig[:last], fp[:last])])
            held = [(sig[last:], fp[last:])]
        if held:
            yield found(held)

    def found(parts) -> pa.RecordBatch:
        got = bucket_links(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), radius)
        ends = [np.concatenate([g[i] for g in got]) if got else np.zeros(0, dtype=np.int64) for i in range(2)]
        return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], ["src", "dst"])

    index = fps.select(F.explode(signatures(F.col("fp"), radius)).alias("sig"), "fp")
    dealt = index.repartition("sig").sortWithinPartitions("sig", "fp")
    return materialise(dealt.mapInArrow(walk, "src long, dst long").distinct(), "sim_links")


def labelled(rows: DataFrame, radius: int) -> DataFrame:
    """Rows (key, fp, ...) with the component of each: the least key reachable."""
    fps = rows.groupBy("fp").agg(F.min("key").alias("least"))
    parts = connect(links(fps.select("fp"), radius))
    named = fps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    names = named.groupBy("c").agg(F.min("least").alias("component"))
    labels = materialise(named.select("fp", "c").join(names, "c").select("fp", "c", "component"), "sim_labels")
    return rows.join(labels, "fp")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4, size: int = 4) -> DataFrame:
    """One row per row of the table: key, fp, component (least key reachable).

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows and rows with
    equal keys get one component each by their fingerprint. A component whose keys are all null is called
    null. An empty table gives an empty result; other columns are not looked at.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = materialise(fingerprints(narrow, "text", "fp", size).select("key", "fp"), "sim_fps")
    return labelled(rows, radius).select(F.col("key").alias(key), "fp", "component")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4, size: int = 4) -> DataFrame:
    """The table with one row of each component: the least (key, fingerprint, place in the table), null keys last.

    Columns are those of the table, whatever they are called. Of identical rows one stays.
    """
    fp, row = fresh_name(docs, "simhash"), fresh_name(docs, "row_place")
    stored = materialise(fingerprints(docs, text, fp, size).withColumn(row, F.monotonically_increasing_id()), "sim_docs")
    rows = stored.select(F.col(key).alias("key"), F.col(fp).alias("fp"), F.col(row).alias("place"))
    first = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "fp", "place")).alias("first")
    keep = labelled(rows, radius).groupBy("c").agg(first).select(F.col("first.place").alias("place"))
    place = fresh_name(docs, "gone_place")
    gone = materialise(stored.select(F.col(row).alias(place)).join(keep, F.col(place) == F.col("place"), "left_anti"), "sim_gone")
    # texts stay where they are but for those that may have to go
    may, rest = split_rows(stored, gone.select(F.xxhash64(place).alias("h")), F.col(row))
    return may.join(gone, may[row] == gone[place], "left_anti").unionByName(rest).drop(fp, row)
