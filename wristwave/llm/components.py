"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wristwave.llm.common import materialise


def connect(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of a link; component is the least node reachable.

    Alternating star contraction: each round hangs a node's larger neighbours on its least one, then a node's
    smaller neighbours likewise, until no link changes; rounds grow with the logarithm of the longest path.
    Minima are combined before the shuffle and every round is a table in the shared folder. Only the count
    of links and a checksum reach the driver. Null ends are ignored, repeated links and loops too.
    """
    pairs = links.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null and u != v")
    edges = materialise(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = materialise(small.select("e.u", "e.v").filter("u != v").distinct(), "cc")
        now = _state(new)
        edges = new
        if now == state:
            break
        state = now
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1] or 0
