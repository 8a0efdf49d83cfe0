"""Stages on the small tables: columns, effects, and the whole run against its parts; SQL twins."""

import hashlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline as cp
from tools.check_oracle import compare, duck
from wristwave.llm import catalog

NUMBERS = [6, 9, 10, 7, 2]


def test_contract():
    names = {int(n[2:].split("_")[0]) for n in catalog.QUERIES}
    assert names == set(range(1, 14)) and len(cp.STAGES) == len(NUMBERS)
    assert {*catalog.QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql_twins(spark, sf, name):
    status, _, _, a, b = compare(spark, duck(sf), sf, name, entry.queries()[name], entry.oracle_sql()[name])
    assert status == "ok", (status, a, b)


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, f in cp.STAGES:
        kept = f(spark, docs, sf)
        rows = kept.collect()
        out.append((docs, kept.columns, rows))
        docs = spark.createDataFrame(rows, kept.schema)
    return out


def test_columns_and_effects(stages, spark, sf):
    for docs, columns, _ in stages[:-1]:
        assert columns == docs.columns
    (d0, _, quality), (_, _, lines), (_, _, near), (_, _, mixed), (_, _, tokens) = stages
    verdicts = {r.doc_id: r.kept for r in catalog.op6_quality_rules(spark, sf).collect()}
    assert sorted(r.doc_id for r in quality) == sorted(k for k, v in verdicts.items() if v)
    seen = [x for r in lines for x in r.text.split("\n") if x.strip(" \t\r\v\f")]
    assert len(seen) == len(set(seen)) and all(r.n_chars == len(r.text) for r in lines)
    assert {x for r in quality for x in r.text.split("\n")} >= set(seen)
    texts = {r.doc_id: r.text for r in near}
    assert len(texts) == len(near) and set(texts) <= {r.doc_id for r in lines}
    assert all(texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in mixed)
    assert len(tokens) == len(mixed)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(r.decoded_sha256 for r in tokens) == sorted(digest(r.text) for r in mixed)


def test_run_is_its_stages(stages, spark, sf):
    whole = sorted(tuple(r) for r in cp.run(spark, sf).collect())
    assert whole == sorted(tuple(r) for r in stages[-1][2])


def test_odd_documents(spark, sf, docs_of, odd):
    docs = docs_of(odd)
    for _, f in cp.STAGES[:-1]:
        out = f(spark, docs, sf)
        assert out.columns == docs.columns
        assert f(spark, docs.limit(0), sf).count() == 0
        out.collect()
    assert cp.tokenise(spark, docs, sf).count() == len(odd)


def test_near_duplicates_by_simhash(spark, sf, docs_of):
    """what operator 10 links goes, also where shingles are under 0.8 alike; what the words link still goes too."""
    import random

    from wristwave.llm import alike
    from wristwave.llm import near_dedup as nd

    def pair(wanted):
        for seed in range(2000):
            draw = random.Random(seed)
            a = [f"w{draw.randrange(10**6)}" for _ in range(300)]
            b = list(a)
            for i in draw.sample(range(300), 9):
                b[i] = f"x{i}"
            x, y = (alike.shingles(" ".join(t)) for t in (a, b))
            met = len(set(x.tolist()) & set(y.tolist()))
            bits = (nd.simhash(" ".join(a)) ^ nd.simhash(" ".join(b))).bit_count()
            if wanted(met / (len(x) + len(y) - met), bits):
                return [" ".join(a), " ".join(b)]

    texts = pair(lambda j, bits: j < 0.8 and bits <= 4) + pair(lambda j, bits: j >= 0.8 and bits > 4) + ["another text that nothing is near to"]
    assert cp.near_duplicates(spark, docs_of(list(enumerate(texts))), sf).count() == 3
