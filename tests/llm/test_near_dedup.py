"""Components against all pairs."""

import random

import numpy as np
import xxhash

from wristwave.llm import near_dedup as nd
from wristwave.llm.components import connect


def brute_fp(text, size=4):
    words = []
    for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" "):
        if w:
            words.append(w)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def same_partition(a, b):
    return len({*zip(a, b)}) == len({*a}) == len({*b})


def test_fingerprint_by_hand(odd):
    rng = random.Random(1)
    texts = [t for _, t in odd] + ["".join(rng.choice("aB \n É.") for _ in range(rng.randrange(200))) for _ in range(50)]
    for t in texts:
        assert nd.simhash(t) == brute_fp(t)


def test_blocks_of_shingles_add_up(monkeypatch):
    text = " ".join(f"w{i % 37}x{i % 11}" for i in range(500))
    whole = nd.simhash(text)
    monkeypatch.setattr(nd, "BLOCK", 7)
    assert nd.simhash(text) == whole


def test_links_connect_like_all_pairs(spark):
    """Dense balls, chains and strangers."""
    rng = np.random.default_rng(4)
    fps = set()
    for _ in range(6):
        centre = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(2))
        for _ in range(60):
            bits = rng.choice(64, size=rng.integers(0, 8), replace=False)
            fps.add(centre ^ sum(1 << int(b) for b in bits))
    chain = 0
    for i in range(16):  # each step flips the four next bits, so only neighbours link
        fps.add(chain)
        chain ^= 15 << (4 * i)
    fps |= {int(x) for x in rng.integers(0, 2**63, 200)}
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    for radius in (2, 4, 5):
        label = {r.node: r.component for r in connect(nd.links(table, radius)).collect()}
        assert same_partition([label.get(x, x) for x in signed], brute_components(fps, radius))


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fp(r.text) for r in rows]
    parts = brute_components(fps, 4)
    least = {}
    for r, p in zip(rows, parts):
        least[p] = min(least.get(p, r.doc_id), r.doc_id)
    want = {r.doc_id: (f, least[p]) for r, f, p in zip(rows, fps, parts)}
    got = {r.doc_id: (r.fp % 2**64, r.component) for r in nd.components(docs).collect()}
    assert got == want
    kept = nd.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_odd_rows(docs_of, odd):
    docs = docs_of(odd).withColumnRenamed("lang", "simhash").withColumnRenamed("source", "fp")
    found = nd.components(docs).collect()
    assert len(found) == len(odd)
    empty = {r.component for r in found if r.fp == 0}
    assert empty == {2}  # null, empty and blank texts are one group, named by its least key
    kept = nd.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({brute_fp(t) for _, t in odd})
    assert nd.components(docs.limit(0)).count() == 0 and nd.one_of_each(docs.limit(0)).count() == 0
