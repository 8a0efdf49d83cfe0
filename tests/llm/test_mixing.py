"""Targets against the iterative rule, budgets, and sampling shares."""

import random

import pytest
from pyspark.sql import functions as F

from wristwave.llm import mixing as mx


def mixed(docs, *args, **kw):
    """The mix with its struct's fields as columns."""
    got = mx.mix(docs, *args, **kw)
    return got.select(*[c for c in got.columns if c not in ("mix", "size")], "mix.*")


def brute_targets(totals):
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = sum(totals.values()), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * totals[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * totals[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    totals = {rng.choice([f"s{i}", f"é{i}", ""]): rng.choice([0, 1, 10, 1000, 10**6]) for i in range(rng.randrange(1, 12))} | {None: 5}
    got = {r.source: r.target for r in mx.targets(spark.createDataFrame(list(totals.items()), "source string, total long")).collect()}
    want = brute_targets(totals)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


@pytest.mark.parametrize("rows", [4096, 20])
def test_budgets(docs_of, monkeypatch, rows):
    monkeypatch.setattr(mx, "BUCKET_ROWS", rows)
    rng = random.Random(rows)
    docs = docs_of([(i, "w " * rng.randrange(60), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)], 4)
    size = F.size(F.array_remove(F.split("text", " "), ""))
    runs = [mixed(docs, size, F.lit(1.0)).collect() for _ in range(2)]
    taken = lambda r: r.epochs * r.size + r.part
    assert sorted((r.doc_id, taken(r)) for r in runs[0]) == sorted((r.doc_id, taken(r)) for r in runs[1])
    for s in ("a", "b", "c", None):
        mine = [r for r in runs[0] if r.source == s]
        assert len({(r.source_size, r.target) for r in mine}) == 1 and mine[0].source_size == sum(r.size for r in mine)
        assert abs(sum(map(taken, mine)) - mine[0].target) <= 1
        assert all(0 <= r.part <= r.size and taken(r) <= 3 * r.size for r in mine)
        assert sum(0 < r.part < r.size for r in mine) <= 1
        assert len({r.epochs for r in mine if r.size}) <= 1
    assert sum(r.target for r in {(r.source, r.target): r for r in runs[0]}.values()) == pytest.approx(sum(r.size for r in runs[0]))


def test_heavier_documents_come_first(docs_of):
    docs = docs_of([(i, "w", "a") for i in range(4000)] + [(5000 + i, "w", "b") for i in range(4000)])
    got = mixed(docs, F.lit(1), F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)).filter("source = 'b'").collect()
    share = [sum(r.part for r in got if r.doc_id % 2 == k) for k in (0, 1)]
    assert sum(share) == round(got[0].target) - 4000 * got[0].epochs
    assert share[0] > 1.5 * share[1]


def test_first_words(spark):
    text = "  one two\n\tthree  four "
    df = spark.createDataFrame([(text, n) for n in range(1, 7)] + [("a b", 1), ("x", 1), ("", 2)], "t string, n long")
    got = [r[0] for r in df.select(mx.first_words(F.col("t"), F.col("n"))).collect()]
    assert got == ["  one", "  one two", "  one two\n\tthree", "  one two\n\tthree  four", "  one two\n\tthree  four", "  one two\n\tthree  four", "a", "x", ""]


def test_odd_rows(docs_of, odd):
    docs = docs_of(odd).withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "mix_key")
    size = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), " "), ""))
    got = mx.mix(docs, size, F.lit(None).cast("double"))
    assert got.count() == len(odd)
    assert mx.mix(docs.limit(0), size, F.lit(1.0)).count() == 0
    blank = mixed(docs_of([(1, None), (2, "")]), F.lit(0), F.lit(1.0)).collect()
    assert [(r.epochs, r.part, r.target) for r in blank] == [(0, 0, 0.0)] * 2


def test_clashing_names(spark, docs_of, odd, sf):
    """Columns called like anything inside come through unchanged, in mix and in the pipeline's stage."""
    import corpus_pipeline as cp

    docs = docs_of(odd + [(20 + i, "w " * i, "abc"[i % 3]) for i in range(40)])
    names = ["s", "es", "budget", "before", "ends", "cut", "weight", "part", "size", "target", "source_size", "epochs", "at", "end_at", "last", "plan", "mix_mark", "mix_plan", "mix_source", "u", "row", "mix"]
    for c in names:
        docs = docs.withColumn(c, F.lit(f"my {c}"))
    got = mx.mix(docs, F.length("text"), F.lit(1.0), out="told")
    assert got.columns == [*docs.columns, "told"] and got.count() == docs.count()
    staged = cp.mix_sources(spark, docs, sf)
    assert staged.columns == docs.columns
    for df in (got, staged):
        assert df.select(*names).distinct().collect() == [tuple(f"my {c}" for c in names)]


@pytest.mark.parametrize("sources", [0, 10])
def test_many_sources_and_keyless_rows(docs_of, monkeypatch, sources):
    """Plans that are not broadcast, and null keys that don't share a draw."""
    monkeypatch.setattr(mx, "SOURCES", sources)
    monkeypatch.setattr(mx, "BUCKET_ROWS", 16)
    docs = docs_of([(None if i % 2 else 7, "w w w", "a" if i % 3 else None) for i in range(600)], 4)
    got = mixed(docs, F.lit(3), F.lit(1.0)).collect()
    for s in ("a", None):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.epochs * r.size + r.part for r in mine) - mine[0].target) <= 1
    assert len(got) == 600
