"""The draw against a plain loop, and quickselect against sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wristwave.llm import resampling as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text, most):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=10, least=20, most=1, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    raw, want = (Counter(bucket(f) for t in texts for f in cut(t, most)[1]) for texts in ([t for _, t in docs], target))
    S, T = sum(raw.values()), sum(want.values())
    gain = {b: math.floor(1000 * math.log((want[b] + 1) * (S + buckets) / ((raw[b] + 1) * (T + buckets)))) for b in raw}
    out = []
    for place, (key, text) in enumerate(docs):
        n, f = cut(text, most)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n, place])
    entrants = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6]))
    for k, r in enumerate(entrants[: len(entrants) * percent // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def order(rows):
    return sorted((tuple(-1 if v is None else v for v in r) for r in rows))


@pytest.mark.parametrize("most, percent, least", [(1, 10, 20), (3, 50, 1)])
def test_draw_by_hand(spark, docs_of, odd, most, percent, least):
    rng = random.Random(3)
    rows = odd + [(100 + i, " ".join(rng.choice(["Alpha", "beta-2", "x", "é", "gamma"]) for _ in range(rng.randrange(60)))) for i in range(120)]
    rows += [(7, "one and the same text, " * 8)] * 5 + [(None, "no key " * 20)] * 3
    target = ["beta 2 gamma beta", None, "é", "unheard of"]
    docs, want = docs_of(rows, parts=4), spark.createDataFrame([(t,) for t in target], "text string")
    got = rs.resample(docs, want, percent=percent, least_words=least, most=most)
    assert got.columns == [*docs.columns, "resample"]
    got = [(r.doc_id, r.resample.n_features, r.resample.weight, r.resample.score, r.resample.rank) for r in got.collect()]
    assert order(got) == order(brute(rows, target, percent, least, most))


def test_clashing_columns_and_empty_tables(spark, docs_of, odd):
    docs = docs_of(odd * 3)
    for c in ("buckets", "place", "key", "down", "rank", "t", "k0", "resample"):
        docs = docs.withColumn(c, F.lit("mine"))
    got = rs.resample(docs, docs, least_words=1, percent=50)
    assert got.columns == docs.columns and got.filter("rank = 'mine' and k0 = 'mine'").count() == docs.count()
    n = sum(cut(t, 1)[0] >= 1 for _, t in odd * 3)
    assert sorted(r[0] for r in got.filter("resample.rank is not null").select("resample.rank").collect()) == list(range(1, n // 2 + 1))
    assert rs.resample(docs.limit(0), docs).count() == 0
    assert rs.resample(docs, docs.limit(0), keep=["doc_id"]).count() == docs.count()


def test_text_keys(spark):
    docs = spark.createDataFrame([(k, "w " * 30) for k in ("b", "a", None, "c", "a")], "id string, text string")
    got = rs.resample(docs, docs, key="id", percent=100).collect()
    assert sorted(r.resample.rank for r in got) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("pivots", [1, 2, 24])
def test_quickselect(spark, monkeypatch, pivots):
    monkeypatch.setattr(rs, "PIVOTS", pivots)
    rng = random.Random(pivots)
    rows = [(rng.randrange(5), i) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5).cache()
    rows.sort()
    for k in (1, 2, 30, 59, 60):
        assert tuple(rs.kth(df, ["a", "b"], k)) == rows[k - 1]
    assert rs.kth(df, ["a", "b"], 61) is None
