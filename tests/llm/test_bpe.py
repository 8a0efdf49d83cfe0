"""Encoding against the tokenizers library, and exact round trips."""

import hashlib
import random
import sys

import pytest

from wristwave.llm import bpe
from wristwave.llm.common import table


@pytest.fixture(scope="module")
def theirs():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def ours():
    return bpe.tokenizer(bpe.vocabulary("byte_bpe_50k.json"))


def test_every_code_point_in_context(theirs, ours):
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 5000):
        text = "".join(f" {c}a {c}{c}1\t{c} " for c in points[at : at + 5000])
        assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids, at


def test_odd_texts(theirs, ours):
    rng = random.Random(3)
    texts = [
        "", " ", "\n\n", "it's we'll I'D 'S", "a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endof", "x" * 5000, "-=" * 700, "漢" * 900,
        "  leading and trailing  ", "a b c\x1cd\x85e", "tab\t\t\tend", "﻿é́", "1234567890" * 60,
        *["".join(rng.choice("ab \n\t.,'sé漢🙂1<|>") for _ in range(rng.randrange(400))) for _ in range(200)],
    ]
    for t in texts:
        want = theirs.encode(t, add_special_tokens=False).ids
        assert ours.encode(t) == want
        assert ours.decode(want) == theirs.decode(want, skip_special_tokens=False) == t


def test_scan_and_heap_agree(ours):
    rng = random.Random(5)
    for _ in range(300):
        data = bytes(rng.choice(b"theaniso -=x\xc3\xa9") for _ in range(rng.randrange(1, 80)))
        assert ours.scan(data) == ours.heap(data)


def test_documents(spark, sf, theirs):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    got = {r[0]: tuple(r)[1:] for r in bpe.round_trip(docs).collect()}
    for r in docs.collect():
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[r.doc_id] == (len(ids), digest(",".join(map(str, ids))), digest(theirs.decode(ids, skip_special_tokens=False)))


def test_odd_rows(docs_of, odd):
    docs = docs_of(odd).withColumnRenamed("lang", "ids").withColumnRenamed("source", "n_tokens")
    rows = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.decoded) for r in rows) == sorted((k is None, k or 0, t or "") for k, t in odd)
    assert bpe.round_trip(docs).count() == len(odd)
    assert bpe.round_trip(docs.limit(0)).count() == 0
