"""Measures against plain loops; fences reject what stands out."""

import random
import re

from pyspark.sql import functions as F

from wristwave.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + o for i, g in enumerate(grams) if grams.count(g) > 1 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_measures(spark, docs_of, odd):
    rng = random.Random(6)
    texts = [t for _, t in odd if len(t or "") < 1000] + ["".join(rng.choice("ab \n\t#é🙂") for _ in range(rng.randrange(120))) for _ in range(150)] + ["a a a a", "a b c a b c a"]
    got = docs_of(list(enumerate(texts))).select("doc_id", q.measures(F.col("text")).alias("m")).collect()
    for r in got:
        assert tuple(r.m)[:5] == brute(texts[r.doc_id]), texts[r.doc_id]


def test_junk_goes_and_prose_stays(docs_of):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    rows = [(i, "\n".join(prose(rng.randrange(8, 30)) for _ in range(rng.randrange(6, 30)))) for i in range(200)]
    junk = [(500, re.sub(r"(\w+)", r"\1###", prose(100))), (501, prose(100).upper()), (502, "buy now " * 100), (503, " | ".join(prose(3) for _ in range(60))), (504, "few words")]
    got = {r.doc_id: r.quality_rules for r in q.judge(docs_of(rows + junk)).collect()}
    assert all(got[k].kept for k, _ in rows)
    assert not any(got[k].kept for k, _ in junk)


def test_odd_rows(docs_of, odd):
    docs = docs_of(odd).withColumn("measured", F.lit(1)).withColumn("g_lang", F.lit(1)).withColumn("source", F.lit(None).cast("string"))
    got = q.judge(docs)
    assert got.columns == [*docs.columns, "quality_rules"] and got.count() == len(odd)
    rows = [r.quality_rules for r in got.collect() if r.text is None]
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in rows)
    assert q.judge(docs.limit(0)).count() == 0
