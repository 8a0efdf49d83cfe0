"""Fingerprints and searches against plain loops."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from wristwave.llm import fingerprints as fp


def brute_edit(rows):
    """rows by descending key; (key, edited text, index of the next row)"""
    out = []
    for i, (k, t) in enumerate(rows):
        j = (i + 1) % len(rows)
        n, t = len(t or "") // 3, t or ""
        out.append((k, t[: len(t) - n] + (rows[j][1] or "")[:n], j))
    return out


@pytest.mark.parametrize("step", [1, 40, 10**12])
def test_edits_and_neighbours(spark, docs_of, step):
    rng = random.Random(step)
    rows = [(i * step + (i % 3), "".join(rng.choice("ab é🙂\n") for _ in range(rng.randrange(40)))) for i in range(1500)]
    rows[5] = (rows[5][0], None)
    rows.sort(key=lambda r: -r[0])
    docs = docs_of(rows, 5).withColumnRenamed("lang", "row").withColumnRenamed("source", "k")
    got = {r.doc_id: r for r in fp.compare_with_edits(docs).collect()}
    assert len(got) == len(rows)
    by_text = {}
    for (k, e, j), (_, t) in zip(brute_edit(rows), rows):
        r = got[k]
        assert r.n_chars == len(t or "") and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        nxt = got[rows[j][0]]
        assert by_text.setdefault(t or "", r.fingerprint) == r.fingerprint and by_text.setdefault(e, r.edited_fingerprint) == r.edited_fingerprint
        like = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128
        assert r.near_edited == like(r.fingerprint, r.edited_fingerprint) and r.near_next == like(r.fingerprint, nxt.fingerprint)
        if k % 100 == 0:
            near = sum(bin(int(r.fingerprint, 16) ^ int(x.fingerprint, 16)).count("1") <= 3 for x in got.values()) - 1
            assert r.n_near == near
        else:
            assert r.n_near is None


def test_votes_by_hand(spark, monkeypatch):
    text = " ".join(f"w{'o' * (i % 15)}{i % 7}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "one"), (5, "one")], "k int, text string")
    whole = {r.k: (r.f0, r.f1) for r in fp.fingerprints(df, ["k"]).collect()}
    terms = df.filter("k = 1").select(F.explode(fp.terms(F.col("text"))).alias("t")).select("t", F.xxhash64("t", F.lit(0)).alias("a"), F.xxhash64("t", F.lit(1)).alias("b")).collect()
    total = sum((r.t & 3) + 1 for r in terms)
    for k, name in enumerate("ab"):
        want = sum(1 << b for b in range(64) if 2 * sum((r.t & 3) + 1 for r in terms if r[name] >> b & 1) > total)
        assert whole[1][k] % 2**64 == want
    assert whole[2] == whole[3] == (0, 0) and whole[4] == whole[5]
    monkeypatch.setattr(fp, "CHUNK", 7)
    assert {r.k: (r.f0, r.f1) for r in fp.fingerprints(df, ["k"]).collect()} == whole


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_search_finds_all(spark, radius):
    rng = random.Random(radius)
    near = []
    for _ in range(10):
        centre = rng.getrandbits(128)
        near += [centre ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(10))) for _ in range(25)]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    rows = spark.createDataFrame([(signed(x % 2**64), signed(x >> 64)) for x in near], "f0 long, f1 long")
    got = {(r.q0, r.q1): r.near for r in fp.within(rows, rows, radius).collect()}
    for x in near:
        assert got[signed(x % 2**64), signed(x >> 64)] == sum(bin(x ^ y).count("1") <= radius for y in near)


def test_odd_rows(docs_of, odd):
    docs = docs_of(odd)
    rows = fp.compare_with_edits(docs).collect()
    assert len(rows) == len(odd) and sum(r.n_chars == 0 for r in rows) == 3
    one = fp.compare_with_edits(docs_of([(100, "abc abc")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].n_near == 0
    assert fp.compare_with_edits(docs.limit(0)).count() == 0
