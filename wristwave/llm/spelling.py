"""Spelling variants: words one edit apart, found through pairs of trie nodes.

The vocabulary is sorted by range twice, by words and by reversed words. A task walks its part of the sorted words and
numbers the nodes of their trie: a word opens a node for every prefix that it doesn't share with the word before it.
What the first words of a part share with the last word of the part before is settled from one row a part, the
numbers of that last word's nodes. So every prefix and every suffix of a word is one integer, and no prefix is ever a
string: a word of n letters costs n numbers however long it is.

A word is the pair (prefix node, suffix node) at each of its gaps; with one position skipped it is a pair as well. Equal
pairs tell neighbours exactly: two words that skip into one pair differ in that position, and a word whose gap is the
pair that another skips into lacks that letter. A pair is held by one whole word and at most as many skipping words as
there are letters, so groups are small by nature. In a run of equal letters only the last skip meets whole words,
hence every pair of neighbours meets once.

Each word points to its near word of largest count if that has twice its own; counts grow along the way, so pointers
are followed by doubling.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wristwave.llm.common import LOWER, UPPER, materialise, ship

NOT_LETTERS = "[^A-Za-z\\u00C0-\\u00FF]+"
LEAST_CHARS, LEAST_COUNT, TIMES = 5, 3, 2
#: Letters whose pairs are made at once.
STEP = 1 << 18


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, run): all maximal runs of letters, with A-Z in lower case."""
    every = docs.select(F.col(key).alias("key"), F.explode(F.split(F.coalesce(F.col(text), F.lit("")), NOT_LETTERS)).alias("run")).filter("run != ''")
    return every.select("key", F.translate("run", UPPER, LOWER).alias("run"))


def with_slips(words: DataFrame, one_in: int = 97) -> DataFrame:
    """(word): the runs, with a letter left out of those whose digest ``one_in`` divides; a null key is written as nothing."""
    h = F.crc32(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return words.withColumn("h", h).select(F.when(F.col("h") % one_in == 0, without).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return words.filter(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


# ---------------------------------------------------------------- numbered tries
def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of ``word`` get ``part``, ``place`` in it and ``nodes``: the number of each non-empty prefix."""
    part, fresh, place, before, nodes = TaskContext.get().partitionId(), 1, 0, "", []
    for batch in batches:
        out = []
        for word in batch["word"]:
            kept = len(commonprefix([before, word]))
            opened = len(word) - kept
            nodes = nodes[:kept] + list(range((part << 40) + fresh, (part << 40) + fresh + opened))
            fresh, before = fresh + opened, word
            out.append(nodes)
        yield batch.assign(part=part, place=range(place, place + len(batch)), nodes=out)
        place += len(batch)


def numbered(words: DataFrame, label: str) -> tuple[DataFrame, dict[int, int]]:
    """The table (word, ...) with part, place, nodes, and the numbers that stand for nodes of an earlier part.

    The first word of a part opens the nodes 1, 2, ... of that part, so what it shares with the last word before the part
    is known from both words and the last word's nodes: a row each a part.
    """
    sorted_ = words.repartitionByRange("word").sortWithinPartitions("word")
    schema = words.select("*", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("place"), F.array(F.lit(0).cast("long")).alias("nodes")).schema
    table = materialise(sorted_.mapInPandas(_numbered, schema), label)
    ends = table.groupBy("part").agg(F.min("word").alias("first"), F.max("word").alias("last"), F.max_by("nodes", "word").alias("nodes"))
    same, last, above = {}, "", []
    for r in sorted(ends.collect(), key=lambda r: r["first"]):  # one row a part
        kept = len(commonprefix([last, r["first"]]))
        own = [(r["part"] << 40) + k + 1 for k in range(kept)]
        same |= dict(zip(own, above[:kept], strict=True))
        last, above = r["last"], [same.get(x, x) for x in r["nodes"]]
    return table, same


def pairs(words: DataFrame, same: dict[int, int]) -> DataFrame:
    """(p, s, id, n, kind) of words (id, n, word, down, up; up and down: nodes of prefixes and of suffixes).

    kind 0: the whole word, cut at a gap; 1: a position skipped; 2: skipped, and the next letter is another one.
    """
    ship(words.sparkSession)
    names = np.array(sorted(same), dtype=np.int64)
    sent = words.sparkSession.sparkContext.broadcast((names, np.array([same[k] for k in names.tolist()], dtype=np.int64)))

    def real(x: np.ndarray) -> np.ndarray:
        names, nodes = sent.value
        if not len(names):
            return x
        at = np.minimum(np.searchsorted(names, x), len(names) - 1)
        return np.where(names[at] == x, nodes[at], x)

    def made(ids, ns, texts, down, up) -> pa.RecordBatch:
        size = np.array([len(t) for t in texts])
        flat = [np.append(real(np.concatenate(rows)), 0) for rows in (down, up)]  # one more, so that an empty word has a place
        letters = np.append(np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32), 0)
        begin = np.cumsum(size) - size
        cols = []
        for skipped in (0, 1):
            n = size + 1 - skipped
            word = np.repeat(np.arange(len(size)), n)
            i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            left, right = i, size[word] - i - skipped  # lengths of prefix and suffix
            p, s = (np.where(k > 0, f[begin[word] + np.maximum(k, 1) - 1], 0) for k, f in ((left, flat[0]), (right, flat[1])))
            kind = np.zeros(len(word), dtype=np.int8)
            if skipped:
                at = begin[word] + i
                other = (right == 0) | (letters[at] != letters[at + 1])
                kind = np.where(other, 2, 1).astype(np.int8)
            cols.append((p, s, ids[word], ns[word], kind))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*cols, strict=True)], ["p", "s", "id", "n", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns = (batch.column(k).to_numpy() for k in (0, 1))
            texts, down, up = (batch.column(k) for k in (2, 3, 4))
            at, end = 0, 0
            ends = down.offsets.to_numpy()
            while at < len(batch):
                end = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP, side="right")) - 1)
                n = end - at
                yield made(ids[at:end], ns[at:end], texts.slice(at, n).to_pylist(), *(x.slice(at, n).to_numpy(zero_copy_only=False) for x in (down, up)))
                at = end

    return words.select("id", "n", "word", "down", "up").mapInArrow(run, "p long, s long, id long, n long, kind byte")


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n, word, n_near, near_id, near_n) for words (word, n): the number of near words and the one of largest count.

    Ids rise with the words in code point order. Of equal counts the first word is the one; without near words it is null.
    """
    ship(words.sparkSession)
    forth, same = numbered(words.select("word", "n"), "spell_forth")
    id_ = F.shiftleft("part", 40).bitwiseOR(F.col("place"))
    forth = forth.select(id_.alias("id"), "n", "word", F.col("nodes").alias("down"))
    back, too = numbered(forth.select(F.reverse("word").alias("word"), "id"), "spell_back")
    both = forth.join(back.select("id", F.col("nodes").alias("up")), "id")
    apart = 1 << 62  # nodes of the two tries are told apart
    back_only = {k + apart: v + apart for k, v in too.items()}
    both = both.withColumn("up", F.transform("up", lambda x: x + apart))
    met = pairs(both, same | back_only).groupBy("p", "s").agg(F.collect_list(F.struct("n", (-F.col("id")).alias("id"), "kind")).alias("m")).filter("size(m) > 1")

    def beside(x: Column) -> Column:
        near = lambda y: (y["id"] != x["id"]) & F.when((x["kind"] > 0) & (y["kind"] > 0), True).otherwise(x["kind"] + y["kind"] == 2)
        return F.transform(F.filter("m", near), lambda y: F.struct(y["n"].alias("n"), y["id"].alias("id")))

    each = met.select(F.explode(F.transform("m", lambda x: F.struct(x["id"].alias("id"), beside(x).alias("near")))).alias("x")).filter("size(x.near) > 0")
    each = each.select((-F.col("x.id")).alias("id"), F.size("x.near").alias("k"), F.array_max("x.near").alias("best"))
    found = each.groupBy("id").agg(F.sum("k").alias("k"), F.max("best").alias("best"))
    out = forth.select("id", "n", "word").join(found, "id", "left")
    return materialise(out.select("id", "n", "word", F.coalesce("k", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.id")).alias("near_id"), F.col("best.n").alias("near_n")), "spell_near")


def roots(links: DataFrame) -> DataFrame:
    """(id, root) for links (id, to) without circles: the last id on the way, itself where ``to`` is null. Ways double each round."""
    now = materialise(links.filter("to is not null").select("id", F.col("to").alias("root")), "spell_ways")
    while True:
        # who already stands at an end has no way on and stays
        on = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        met = now.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        met = materialise(met, "spell_ways")
        if not met.filter("moved").limit(1).count():
            break
        now = met.select("id", "root")
    return links.select("id").join(now, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """One row per word of (word, n): word, form, root, n, n_near, form_n.

    form is the near word of largest count (ties: the first in code point order) if it has at least ``times`` the word's
    count, else null; root is where forms lead to, the word itself if it has none. Words are distinct and not null; an
    empty table gives an empty result. Words may be of any length.
    """
    near = neighbours(words)
    told = near.withColumn("to", F.when(F.col("near_n") >= times * F.col("n"), F.col("near_id")))
    ends = roots(told.select("id", "to"))
    name = lambda c: near.select(F.col("id").alias(f"{c}_id"), F.col("word").alias(c))
    out = told.join(ends.select("id", F.col("root").alias("root_id")), "id").withColumnRenamed("to", "form_id")
    out = out.join(name("form"), "form_id", "left").join(name("root"), "root_id")
    return out.select("word", "form", "root", "n", "n_near", F.when(F.col("form").isNotNull(), F.col("near_n")).alias("form_n"))


def group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``variants`` of the words of a table's whole texts, slips included. Null texts have none; other columns are not looked at."""
    return variants(materialise(vocabulary(with_slips(runs(docs, key, text))), "spell_words"))
