"""Phrase and proximity matches against plain loops."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wristwave.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def cut_windows(items, size):
    out = {}
    for item, text in items:
        w = cut(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            out.setdefault(tuple(w[i : i + size]), set()).add(item)
    return out


def brute(docs, items, size=10):
    windows, out = cut_windows(items, size), []
    for key, text in docs:
        w, hit, ids = cut(text), set(), set()
        for win, held in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    ids |= held - {None}
        out.append((key, len(w), len(hit), tuple(sorted(ids))))
    return sorted(out, key=repr)


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def got_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in df.collect()), key=repr)


ITEMS = [(1, "One two, three"), (2, "word " * 12), (3, None), (4, " ,; "), (5, "one TWO three"), (None, "same"), (6, "a b"), (7, "漢字"), (10, "b"), (6, "a b")]


@pytest.mark.parametrize("size", [1, 2, 4, 10])
def test_phrases_by_hand(spark, docs_of, odd, size):
    rng = random.Random(size)
    some = lambda n: " ".join(rng.choice("a b c d e ee f Ff".split()) for _ in range(n))
    rows = odd + [(100 + i, some(rng.randrange(60))) for i in range(60)]
    items = ITEMS + [(20 + i, some(rng.randrange(1, 15))) for i in range(8)] + [(40, rows[-1][1]), (41, "nowhere to be found " + rows[-2][1])]
    got = dc.contamination(docs_of(rows, parts=4), items_of(spark, items), size=size)
    assert got_of(got) == brute(rows, items, size)


def test_large_tables_meet_in_a_shuffle(spark, docs_of, odd, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    rows = odd + [(50, "x y one two three z")] * 3
    assert got_of(dc.contamination(docs_of(rows), items_of(spark, ITEMS))) == brute(rows, ITEMS)


def test_empty_tables_and_clashing_columns(spark, docs_of, odd):
    docs, items = docs_of(odd), items_of(spark, ITEMS)
    for c in ("row", "pos", "term", "all", "w", "item"):
        docs, items = docs.withColumn(c, F.lit("mine")), items.withColumn(c, F.lit(1))
    assert got_of(dc.contamination(docs, items)) == brute(odd, ITEMS)
    assert dc.contamination(docs.limit(0), items).count() == 0
    assert got_of(dc.contamination(docs, items.limit(0))) == brute(odd, [])


def test_proximity_by_hand(spark, docs_of):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("a b c d e f g h".split() + ["the"] * 6) for _ in range(rng.randrange(80)))) for i in range(40)]
    items = [(1, "a b c the"), (2, "d the e"), (3, "h"), (4, "the the g f"), (5, "a never seen")]
    windows, held = dc.item_windows(items_of(spark, items))
    terms = dc.vocabulary(windows)
    index = dc.build_index(docs_of(rows), terms)
    ranked = dc.by_rarity(index, terms, windows)
    keys = {r.row: r.key for r in index.filter("term = 0").collect()}
    names = {r.id: r.window for r in ranked.collect()}
    got = {(names[r.id], keys[r.row], r["first"], r["last"]) for r in dc.near(index, ranked, 3, 6).collect()}
    seen = Counter(w for _, t in rows for w in cut(t))
    order = {r.word: r.term for r in terms.collect()}
    want = set()
    for win in cut_windows(items, 10):
        rare = sorted({(seen[w], order[w], w) for w in win})[:3]
        for key, text in rows:
            w = cut(text)
            for at in range(len(w)):
                if w[at] == rare[0][2]:
                    spans = [(j - i, i, j) for i in range(max(0, at - 5), at + 1) for j in range(at, min(len(w), i + 6)) if {x[2] for x in rare} <= set(w[i : j + 1])]
                    if spans:
                        want.add((" ".join(win), key, *min(spans)[1:]))
    assert got == want and len(want) > 20
