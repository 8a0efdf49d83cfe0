"""Variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from wristwave.llm import spelling as sp

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(rows, one_in=97):
    out = []
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            at = h % len(run)
            out.append(run[:at] + run[at + 1 :] if h % one_in == 0 else run)
    return Counter(w for w in out if len(w) >= 5)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n, times=2):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= times * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w, ""), root(w), n[w], len(near[w]), n[form[w]] if w in form else 0) for w in n)


def told(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def words_of(spark, n, parts):
    return spark.createDataFrame(list(n.items()), "word string, n long").repartition(parts)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_all_pairs(spark, parts):
    """Few letters, so runs of equal ones, shared prefixes over many parts and several edits to one word occur."""
    rng = random.Random(parts)
    n = {"".join(rng.choice("aabcé") for _ in range(rng.randrange(1, 8))): rng.choice([1, 1, 2, 3, 5, 9, 40, 100]) for _ in range(260)}
    n |= {"x" * 300: 2, "x" * 301: 4, "x" * 150 + "y" + "x" * 149: 9, "漢字漢字": 3, "漢字漢": 7, "🙂🙂": 1, "🙂": 2, "ä": 5}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert told(sp.variants(words_of(spark, n, parts))) == brute_variants(n)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_small_steps(spark, monkeypatch):
    monkeypatch.setattr(sp, "STEP", 7)
    n = {w: i + 1 for i, w in enumerate(["abcde", "abcd", "abcdef", "abxde", "zbcde", "abccde", "abde"])}
    assert told(sp.variants(words_of(spark, n, 2))) == brute_variants(n)


def test_long_ways(spark):
    n = {"a" * k: 2**k for k in range(1, 40)}
    assert told(sp.variants(words_of(spark, n, 4))) == brute_variants(n)


def test_documents(spark, docs_of, odd):
    rng = random.Random(2)
    words = ["Coffee", "coffees", "cofee", "tea-time", "Übung", "übung", "x1y", "straße", "HELLO", "hellos"]
    rows = odd + [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(100)] + [(7, "y" * 3_000)] * 3
    assert told(sp.group(docs_of(rows))) == brute_variants({w: k for w, k in brute_words(rows).items() if k >= 3})
    slips = sp.with_slips(sp.runs(docs_of(rows)), one_in=2).collect()
    assert Counter(r.word for r in slips if len(r.word) >= 5) == brute_words(rows, 2)


def test_empty_tables(spark, docs_of):
    assert sp.group(docs_of([(1, "no word here")])).collect() == []
    assert sp.group(docs_of([])).columns == ["word", "form", "root", "n", "n_near", "form_n"]
