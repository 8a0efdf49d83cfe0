"""Edit join and dedup against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from wristwave.llm import line_dedup as ld


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutate(rng, s, edits, alphabet="abcdé🙂 "):
    for _ in range(edits):
        at = rng.randrange(len(s) + 1)
        kind = rng.randrange(3)
        s = s[:at] + ("" if kind == 0 else rng.choice(alphabet)) + s[at + (kind != 1) :]
    return s


@pytest.mark.parametrize("threshold", [1, 2, 3, 5])
def test_verification(spark, threshold):
    rng, pairs = random.Random(threshold), []
    for _ in range(600):
        a = "".join(rng.choice("abcdé🙂 ") for _ in range(rng.randrange(0, 40)))
        pairs.append((a, mutate(rng, a, rng.randrange(0, threshold + 3))))
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("near", ld.within(F.col("a"), F.col("b"), threshold))
    for r in df.collect():
        assert r.near == (levenshtein(r.a, r.b) <= threshold), (r.a, r.b)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_keys_miss_no_pair(spark, threshold):
    rng, pairs = random.Random(threshold), []
    for _ in range(400):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 30)))
        b = mutate(rng, a, rng.randrange(0, threshold + 1), "abc")
        pairs.append((a, b) if len(a) <= len(b) else (b, a))
    df = spark.createDataFrame(pairs, "a string, b string")
    df = df.select("a", "b", ld.entries(F.col("a"), threshold, True).alias("x"), ld.entries(F.col("b"), threshold, True).alias("y"))
    for r in df.collect():
        own = {e.sig: e.rest for e in r.x if e["index"]}
        shared = [(own[e.sig], e.rest) for e in r.y if e.sig in own]
        # not only a shared key: what is left without the segment is within the threshold too
        assert any(levenshtein(p, q) <= threshold for p, q in shared), (r.a, r.b)


def near_set(lines, rank, threshold):
    order = sorted(lines, key=rank)
    return {y for i, y in enumerate(order) if any(abs(len(x) - len(y)) <= threshold and levenshtein(x, y) <= threshold for x in order[:i])}


@pytest.mark.parametrize("threshold,levels", [(1, 3), (2, 3), (2, 0)])
def test_dedup(spark, docs_of, monkeypatch, threshold, levels):
    monkeypatch.setattr(ld, "LEAST_CHARS", 12)
    monkeypatch.setattr(ld, "LEVELS", levels)
    rng = random.Random(9)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(14, 30))) for _ in range(6)]
    # many variants of few lines, templates that share a half without being near, short and exact repeats
    pool = [mutate(rng, rng.choice(base), rng.randrange(0, 4), "abcd ") for _ in range(120)]
    pool += [f"one template for all, number {rng.randrange(10**4):04d} of them" for _ in range(40)] + ["}", "short", "", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(120)]
    rows += [(None, rows[3][1]), (200, None), (201, ""), (5, rows[5][1])]
    docs = docs_of(rows)
    got = ld.dedup(docs, threshold=threshold).collect()
    assert len(got) == len(rows)
    seen = {}
    for r in spark.createDataFrame([(x,) for x in {line for _, t in rows for line in (t or "").split("\n")}], "line string").select("line", F.xxhash64("line").alias("h")).collect():
        seen[r.line] = r.h
    worded = lambda s: s.strip(" \t\r\v\f") != ""
    count = {}
    for _, t in rows:
        for line in (t or "").split("\n"):
            if worded(line):
                count[line] = count.get(line, 0) + 1
    near = near_set([x for x in count if len(x) >= 12], lambda x: (-count[x], seen[x]), threshold)
    first, want = set(), {}
    for k, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        keep, repeated, variants, lines = [], 0, 0, 0
        for line in (t or "").split("\n"):
            lines += worded(line)
            if not worded(line) or (line not in near and line not in first):
                keep.append(line)
            elif line in near:
                variants += 1
            else:
                repeated += 1
            if worded(line):
                first.add(line)
        want[k, t] = (lines, repeated, variants, None if t is None else "\n".join(keep))
    for r in got:
        assert tuple(r.line_dedup) == want[r.doc_id, r.text], r
    assert near


def test_odd_rows(docs_of, odd):
    docs = docs_of(odd).withColumnRenamed("lang", "h1").withColumnRenamed("source", "gone")
    got = ld.dedup(docs)
    assert got.columns == [*docs.columns, "line_dedup"] and got.count() == len(odd)
    assert {r.line_dedup.text for r in got.collect() if r.doc_id == 5} == {"same", "other text of the same key"}
    assert ld.dedup(docs.limit(0)).count() == 0


def test_long_lines_may_differ_more(docs_of, spark):
    """two edits make a variant of a line of 64 code points and more, one edit of a shorter one; also across that border."""
    rng, lines = random.Random(22), []
    for size in (40, 61, 62, 63, 64, 65, 66, 90, 250):
        base = "".join(rng.choice("abcdefgh ijkl") for _ in range(size - 1)) + "."
        lines += [base] * 3 + [mutate(rng, base, edits) for edits in (1, 1, 2, 2, 2, 3, 3)]
    rows = [(i, x) for i, x in enumerate(lines)]
    got = {r.doc_id: r.line_dedup for r in ld.dedup(docs_of(rows)).collect()}
    hashes = {r.line: r.h for r in spark.createDataFrame([(x,) for x in set(lines)], "line string").select("line", F.xxhash64("line").alias("h")).collect()}
    order = sorted(set(lines), key=lambda x: (-lines.count(x), hashes[x]))
    near = {y for i, y in enumerate(order) if any(levenshtein(x, y) <= (1 if len(y) < 64 else 2) for x in order[:i])}
    assert {x for i, x in rows if got[i].n_near} == near
    assert any(min(levenshtein(x, y) for x in order[:i]) == 2 for i, y in enumerate(order) if y in near)


def test_short_lines_are_compared_too(docs_of, spark):
    """one edit makes a variant of a line of any length from two code points on; lines of one character are compared exactly."""
    rng = random.Random(19)
    lines = ["{", "}", "}", "ab", "ab", "ac", "xyz", "xyz", "xz", "xyzzy", "pq", "rs", "Ende.", "Ende.", "Ende", "Ende!"]
    for size in (3, 5, 7, 8, 12, 15, 16, 17, 24, 30, 31, 32, 33):
        base = "".join(rng.choice("abcdefgh ijklmnop") for _ in range(size - 1)) + "."
        lines += [base] * 2 + [mutate(rng, base, edits, "abcdéf ") for edits in (1, 1, 1, 2, 2)]
    lines = [x for x in lines if x.strip()]
    rows = list(enumerate(lines))
    got = {r.doc_id: r.line_dedup for r in ld.dedup(docs_of(rows)).collect()}
    hashes = {r.line: r.h for r in spark.createDataFrame([(x,) for x in set(lines)], "line string").select("line", F.xxhash64("line").alias("h")).collect()}
    near = near_set([x for x in set(lines) if len(x) > 1], lambda x: (-lines.count(x), hashes[x]), 1)
    assert {x for i, x in rows if got[i].n_near} == near
    assert {"ac", "xz"} <= near and sum(len(x) < 32 for x in near) > 20


def test_a_line_is_no_variant_of_itself(docs_of):
    """Lines that repeat one character hold equal segments at several places."""
    rows = [(i, c * n) for i, (c, n) in enumerate([("-", 70), ("=", 150), ("é", 64), ("#", 9), ("*", 40)])]
    got = ld.dedup(docs_of(rows)).collect()
    assert all(r.line_dedup.n_near == 0 and r.line_dedup.text == r.text for r in got)


@pytest.mark.parametrize("threshold,most", [(1, 4), (2, 8)])
def test_few_keys(spark, threshold, most):
    """threshold two asks for at most two sets of four keys, and mostly for one."""
    sizes = list(range(64, 400))
    df = spark.createDataFrame([("".join(chr(97 + (i * i + n) % 26) for i in range(n)),) for n in sizes], "line string")
    n = [r.n for r in df.select(F.size(ld.entries(F.col("line"), threshold, False)).alias("n")).collect()]
    assert max(n) <= most and sum(n) / len(n) < 0.65 * most
