"""Exact sizes and a uniform order."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wristwave.llm import sharding as sh


def test_matrix_margins():
    m = sh.matrix([5, 0, 17, 3], [7, 6, 6, 6], 1)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 3] and m.sum(axis=0).tolist() == [7, 6, 6, 6]


@pytest.mark.parametrize("rows,shards,block", [(1000, 24, 20_000), (1000, 7, 10), (5, 24, 20_000)])
def test_shards_are_exact(spark, docs_of, monkeypatch, rows, shards, block):
    monkeypatch.setattr(sh, "BLOCK_ROWS", block)
    docs = docs_of([(i, f"t{i}") for i in range(rows)], 5)
    got = sh.shuffle(docs, shards).collect()
    assert sorted(r.doc_id for r in got) == list(range(rows))
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_more_partitions_than_parts(docs_of, monkeypatch):
    monkeypatch.setattr(sh, "PARTS", 3)
    got = sh.shuffle(docs_of([(i, "t") for i in range(500)], 8), 6).collect()
    assert sorted(r.doc_id for r in got) == list(range(500)) and {*Counter(r.shard for r in got).values()} == {83, 84}


@pytest.mark.parametrize("empty", [{1, 2, 4, 5, 6}, {0, 1, 2, 3, 5, 7}, {3}])
def test_empty_partitions_in_between(spark, docs_of, monkeypatch, empty):
    monkeypatch.setattr(sh, "PARTS", 4)
    docs = docs_of([(i, "t") for i in range(500)], 1)
    filled = sorted(set(range(8)) - empty)
    home = F.element_at(F.array(*[F.lit(k) for k in filled]), (F.col("doc_id") % len(filled) + 1).cast("int"))
    rows = docs.withColumn("home", home).rdd.map(lambda r: (r.home, tuple(r)[:-1])).partitionBy(8, int).values()
    got = sh.shuffle(spark.createDataFrame(rows, docs.schema), 6).collect()
    assert sorted(r.doc_id for r in got) == list(range(500)) and {*Counter(r.shard for r in got).values()} == {83, 84}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in Counter(r.shard for r in got).items())


def test_order_is_uniform():
    """Over seeds, a row lands in every slot equally often, and neighbours part company."""
    blocks, parts = [4, 4, 4], [6, 6]
    seen = np.zeros((2, 3))
    for seed in range(3000):
        seen += sh.matrix(parts, blocks, seed)
    assert np.allclose(seen / 3000, 2, atol=0.06)


def test_odd_rows(docs_of, odd):
    docs = docs_of(odd).withColumnRenamed("lang", "shard").withColumnRenamed("source", "to_block")
    got = sh.shuffle(docs, 4)
    assert set(got.columns) == {"doc_id", "text", "to_block", "n_chars", "shard", "slot"}
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(odd)
    assert sh.shuffle(docs.limit(0), 4).count() == 0
