"""Near-dedup of the pipeline: recall on planted pairs, exact verification, components against all pairs."""

import random

import corpus_pipeline as cp
import numpy as np
from wristwave.llm import alike as al


def shingle_set(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def likeness(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def planted(rng, at):
    """A text and a copy with words changed as long as the likeness stays at least ``at``."""
    a = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(150, 400))]
    b = list(a)
    while True:
        c = list(b)
        c[rng.randrange(len(c))] = f"v{rng.randrange(10**6)}"
        if likeness(" ".join(a), " ".join(c)) < at:
            return " ".join(a), " ".join(b)
        b = c


def test_stage_finds_planted_pairs(spark, sf, docs_of):
    rng, rows = random.Random(3), []
    levels = {0.8: [], 0.9: [], 0.95: []}
    for at, ids in levels.items():
        for _ in range(60):
            a, b = planted(rng, at)
            assert at <= likeness(a, b) < at + 0.06
            ids.append(len(rows) // 2)
            rows += [(len(rows), a), (len(rows) + 1, b)]
    kept = {r.doc_id for r in cp.near_duplicates(spark, docs_of(rows), sf).collect()}
    assert kept >= set(range(0, len(rows), 2))
    for at, ids in levels.items():
        assert sum(2 * i + 1 not in kept for i in ids) >= 60 - (at == 0.8), at


def test_below_the_likeness_all_stay(spark, sf, docs_of):
    rng, rows = random.Random(4), []
    for _ in range(60):
        a, b = planted(rng, 0.7)
        if likeness(a, b) < 0.8:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    assert len(rows) > 100 and cp.near_duplicates(spark, docs_of(rows), sf).count() == len(rows)


def test_components_are_those_of_all_pairs(spark, docs_of):
    """Chains, dense groups and texts with a common passage."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(25):  # half alike, linked by nothing
        texts.append(" ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(40)]))
    for at in range(0, 40, 2):  # a chain, only close ones are near
        texts.append(" ".join(f"c{i}" for i in range(at, at + 60)))
    dense = [f"d{i}" for i in range(200)]
    for i in range(30):
        texts.append(" ".join(dense[:i] + [f"x{i}"] + dense[i + 1 :]))
    texts += [texts[0], texts[30].upper(), "short", "Short", "", None]
    sets = [al.shingles(t) for t in texts]
    near = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near(sets[i], sets[j]):
                old, new = sorted((parent[i], parent[j]))[::-1]
                parent = [new if p == old else p for p in parent]
    got = {r.doc_id for r in al.one_of_each(docs_of(list(enumerate(texts)))).collect()}
    assert got == set(parent)


def test_walk_joins_what_first_members_do_not():
    """b and c are near each other, but not near the first of their band."""
    a, b, c, d = np.arange(100), np.arange(30, 130), np.arange(40, 140), np.arange(500, 600)
    assert al.band_links(np.array([0, 1, 2, 3]), [a, b, c, d]) == [(1, 2)]
    assert al.band_links(np.array([0, 0, 2, 3]), [a, b, c, d]) == [(1, 2)]


def test_odd_rows(docs_of, odd):
    docs = docs_of(odd).withColumnRenamed("lang", "alike").withColumnRenamed("source", "row_place")
    kept = al.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({frozenset(shingle_set(t)) if (t or "").split() else None for _, t in odd})
    assert al.one_of_each(docs.limit(0)).count() == 0
