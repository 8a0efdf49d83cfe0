"""Held-out accuracy, the corrected risk, and odd rows."""

import random

from wristwave.llm import toxicity as tx

SLURS = ["vile", "rotten", "filthy", "grubby", "wretched"]


def corpus(n, seed, toxic):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rt", "sting", "lly")]
    out = []
    for _ in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 400))]
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                w[rng.randrange(len(w))] = rng.choice(SLURS) + rng.choice(["", "", ",", "."])
        out.append(" ".join(w))
    return out


def test_learns_without_negatives():
    unlabelled = corpus(900, 1, False) + corpus(100, 2, True)
    model = tx.train(corpus(200, 3, True), unlabelled, 0.1)
    bad, good = corpus(200, 4, True), corpus(400, 5, False)
    assert sum(model.score(t) >= 0.7 for t in bad) > 190
    assert sum(model.score(t) >= 0.7 for t in good) < 8
    assert model.score(None) == model.score("") < 0.5
    assert model.score(" ".join(good[:200]) + " vile rotten") >= 0.7  # a few words in a long text


def test_nothing_to_learn_from():
    assert tx.train([], ["a"], 0.2).score("a") == tx.train(["a"], [], 0.2).score(None)
    assert abs(tx.train([], [], 0.2).score("x") - 0.2) < 1e-9


def test_fit_and_score_tables(spark, docs_of, odd):
    texts = corpus(150, 6, False) + corpus(60, 7, True)
    docs = docs_of([(100 + i, t) for i, t in enumerate(texts)] + odd)
    confirmed = spark.createDataFrame([(250 + i,) for i in range(40)] + [(None,), (250,)], "doc_id long")
    model = tx.fit(docs, confirmed, 0.25)
    got = tx.score(docs.withColumnRenamed("lang", "score"), model).collect()
    assert len(got) == len(texts) + len(odd) and all(0 <= r.score <= 1 for r in got)
    held = [r.score for r in got if r.doc_id is not None and r.doc_id >= 290]
    assert sum(s >= 0.7 for s in held) >= 18
    assert tx.score(docs.limit(0), model).count() == 0
    assert tx.fit(docs.limit(0), confirmed, 0.25).weights == {}


def test_held_out_documents():
    """The shipped labels, as the registered query splits them."""
    import zlib

    import pyarrow.parquet as pq

    at = "/root/testdata/sf0.1"
    text = dict(zip(*[pq.read_table(f"{at}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text")], strict=True))
    toxic = dict(zip(*[pq.read_table(f"{at}/labels.parquet")[c].to_pylist() for c in ("doc_id", "toxic")], strict=True))
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    learn = [k for k in toxic if not held(k)]
    sure = [text[k] for k in learn if toxic[k] == 1]
    rest = [t for k, t in text.items() if not held(k) and toxic.get(k) != 1][:3000]
    model = tx.train(sure, rest, len(sure) / len(learn))
    bad = [model.score(text[k]) >= 0.7 for k in toxic if held(k) and toxic[k] == 1]
    good = [model.score(text[k]) >= 0.7 for k in toxic if held(k) and toxic[k] == 0]
    # about a tenth of the texts labelled toxic here are junk that holds no slur
    assert sum(bad) / len(bad) > 0.85 and sum(good) / len(good) < 0.03


def test_long_texts_are_learned(spark, docs_of):
    """Confirmed texts of over 100,000 characters; keys without a text don't use up the sample."""
    filler = " plain filler words" * 5500
    bad, good = corpus(40, 8, True), corpus(300, 9, False)
    docs = docs_of([(i, t + filler) for i, t in enumerate(bad)] + [(1000 + i, t + filler * (i % 3 == 0)) for i, t in enumerate(good)])
    confirmed = spark.createDataFrame([(i,) for i in range(40)] + [(10**6 + i,) for i in range(200)], "doc_id long")
    was, tx.POSITIVES = tx.POSITIVES, 40
    try:
        model = tx.fit(docs, confirmed, 0.15)
    finally:
        tx.POSITIVES = was
    assert any(f in SLURS for f in model.weights)
    assert all(model.score(t) >= 0.7 for t in corpus(30, 10, True)) and not any(model.score(t) >= 0.7 for t in corpus(60, 11, False))


def test_fit_equals_training_in_one_process(spark, docs_of):
    bad, good = corpus(60, 12, True), corpus(200, 13, False) + corpus(20, 14, True)
    rows = [(i, t) for i, t in enumerate(bad + good)]
    docs = docs_of(rows + rows[:5] + rows[-5:] + [(None, good[0])])  # repeated rows count once
    confirmed = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    got, plain = tx.fit(docs, confirmed, 0.2), tx.train(bad, good + [good[0]], 0.2)
    assert set(got.weights) == set(plain.weights) and got.weights
    assert all(abs(w - plain.weights[f]) < 1e-6 for f, w in got.weights.items()) and abs(got.bias - plain.bias) < 1e-6
