"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores a posting (term, row, pos) for every training token that is a word of the test items, and for
every document an end mark (term 0 at the position after its last word, with the document's key). Each task
sorts its part by term and writes it as a segment: lists lie together, a reader of some terms skips the rest by the
files' statistics, no token crosses the network, and a frequent term's list is spread over all segments.

A test window is looked up from its rarest terms: postings of the rarest, less the term's offset, are the
starts that are possible; the list of the next rarest is intersected with them after the same adjustment, and what
is left has to be in the lists of all other terms. Terms are whole words, so this is the exact phrase match and no
text is read again. ``near`` returns proximity matches: all of a window's rarest terms within a span of words,
in any order.

Windows with equal words are looked up once, however many items hold them. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wristwave.llm.common import alnum_words, materialise
from wristwave.llm.line_dedup import may_be_in

WINDOW = 10
#: Test vocabularies and window tables up to this many rows are broadcast; larger ones meet the index in a shuffle.
BROADCAST_ROWS = 1 << 17
#: A proximity match takes this many of a window's rarest terms within this many consecutive words.
NEAR_TERMS, NEAR_SPAN = 3, 20


def _small(df: DataFrame) -> DataFrame:
    """The table, marked for a broadcast if its counted size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, term): the distinct words of an array column ``w``, numbered from 1 without order."""
    distinct = words.select(F.explode("w").alias("word")).distinct()
    return materialise(distinct.withColumn("term", F.monotonically_increasing_id() + 1), "contam_terms")


def item_windows(items: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(window, w) for every distinct window of ``size`` words, and (window, item) for the items that hold it.

    An item of fewer words, but not none, is one window. Windows are named by their words.
    """
    cut = items.select(F.col(item).alias("item"), alnum_words(F.col(text)).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - (size - 1)))
    every = cut.select("item", "all", F.explode(starts).alias("at")).select("item", F.slice("all", F.col("at"), F.lit(size)).alias("w"))
    every = every.withColumn("window", F.array_join("w", " ")).distinct()
    every = materialise(every, "contam_windows")
    return every.select("window", "w").distinct(), every.select("window", "item")


def build_index(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (term, row, pos, key) of the words in ``terms`` (word, term) and an end mark for every row of the table.

    row is the place of the row in the table, stored with the postings; key is null but on end marks.
    """
    # the last entry, an empty word, is the end mark; no real word is empty
    cut = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), F.array_append(alnum_words(F.col(text)), F.lit("")).alias("all"))
    tokens = cut.select("key", "row", F.posexplode("all").alias("pos", "word"))
    known = terms.select("word", "term").unionByName(docs.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(0).cast("long").alias("term")))
    met = tokens.join(_small(known), "word")
    made = met.select("term", "row", "pos", F.when(F.col("term") == 0, F.col("key")).alias("key"))
    return materialise(made.sortWithinPartitions("term", "row", "pos"), "contam_index")


def by_rarity(index: DataFrame, terms: DataFrame, windows: DataFrame) -> DataFrame:
    """(window, length, t): the window's (offset, term) in rising order of the term's number of postings."""
    counts = terms.join(index.filter("term > 0").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term", "left")
    flat = windows.select("window", F.size("w").alias("length"), F.posexplode("w").alias("offset", "word"))
    met = flat.join(counts.select("word", "term", F.coalesce("n", F.lit(0)).alias("n")), "word")
    ranked = met.groupBy("window", "length").agg(F.sort_array(F.collect_list(F.struct("n", "term", "offset"))).alias("t"))
    return materialise(ranked.withColumn("id", F.monotonically_increasing_id()), "contam_ranked")


def _starts(index: DataFrame, lookup: DataFrame) -> DataFrame:
    """(id, row, start) of the postings that ``lookup`` (id, term, offset) asks for, less the offset."""
    met = index.join(_small(lookup), "term")
    return met.select("id", "row", (F.col("pos") - F.col("offset")).alias("start")).filter("start >= 0")


def phrases(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """(id, row, start, length) of every occurrence of the windows that ``by_rarity`` returned."""
    words = index.filter("term > 0").select("term", "row", "pos")
    alone = ranked.filter("get(t, 0).n > 0")  # a word without postings ends its windows
    nth = lambda k: alone.filter(F.size("t") > k).select("id", F.get("t", F.lit(k))["term"].alias("term"), F.get("t", F.lit(k))["offset"].alias("offset"))
    found = materialise(_starts(words, nth(0)), "contam_starts")
    # the second list, adjusted by its offset, intersected with the first; other rows' postings are left out by a bitmap
    may = lambda rows, ids: may_be_in(rows.withColumn("h", F.xxhash64("row")), ids.select("row").distinct().withColumn("h", F.xxhash64("row")), "h").drop("h")
    second = _starts(may(words, found), nth(1))
    both = found.join(second, ["id", "row", "start"], "left_semi")
    single = alone.filter(F.size("t") == 1).select("id")
    both = materialise(both.unionByName(found.join(_small(single), "id", "left_semi")), "contam_pairs")
    # the rest at once: a start stays if every other list, adjusted, holds it
    size = ranked.select("id", "length", F.slice("t", F.lit(3), F.greatest(F.lit(0), F.size("t") - 2)).alias("t"))
    open_ = both.join(_small(size), "id")
    asked = open_.select("id", "row", "start", "length", F.explode("t").alias("x"))
    asked = asked.select("id", "row", "start", "length", F.col("x.term").alias("term"), (F.col("start") + F.col("x.offset")).alias("pos"))
    met = asked.join(may(words, both), ["row", "pos", "term"]).groupBy("id", "row", "start", "length").count()
    whole = met.filter(F.col("count") == F.col("length") - 2).select("id", "row", "start", "length")
    return whole.unionByName(open_.filter("length <= 2").select("id", "row", "start", "length"))


def near(index: DataFrame, ranked: DataFrame, terms: int = NEAR_TERMS, span: int = NEAR_SPAN) -> DataFrame:
    """(id, row, first, last): spans of at most ``span`` consecutive words that hold the ``terms`` rarest different words of a window.

    Windows of fewer different words need them all. Each posting of the rarest word gives its shortest span, the
    earliest of equal ones; the other lists join by blocks of ``span`` positions, so a posting meets at most 2 * span - 1
    others of a list.
    """
    words = index.filter("term > 0").select("term", "row", "pos")
    # one entry a different term
    once = ranked.select("id", F.array_distinct(F.transform("t", lambda x: F.struct(x["n"].alias("n"), x["term"].alias("term")))).alias("t"))
    once = once.filter("get(t, 0).n > 0")
    first = once.select("id", F.get("t", F.lit(0))["term"].alias("term"), F.lit(0).alias("offset"))
    held = _starts(words, first).select("id", "row", F.col("start").alias("at"), F.col("start").alias("first"), F.col("start").alias("last"))
    for k in range(1, terms):
        more = once.filter(F.size("t") > k).select("id", F.get("t", F.lit(k))["term"].alias("term"))
        block = F.floor(F.col("pos") / span)
        beside = words.withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
        asked = held.join(_small(more), "id").withColumn("block", F.floor(F.col("at") / span))
        met = asked.join(beside, ["term", "row", "block"])
        met = met.select("id", "row", "at", F.least("first", "pos").alias("first"), F.greatest("last", "pos").alias("last")).filter(F.col("last") - F.col("first") < span)
        full = once.filter(F.size("t") <= k).select("id")
        held = materialise(met.distinct().unionByName(held.join(_small(full), "id", "left_semi")), "contam_near")
    best = F.min(F.struct((F.col("last") - F.col("first")).alias("n"), "first", "last"))
    return held.groupBy("id", "row", "at").agg(best.alias("b")).select("id", "row", "b.first", "b.last").distinct()


def covered(spans: DataFrame) -> DataFrame:
    """(row, n): positions of each row inside any of its spans (start, length)."""
    so_far = Window.partitionBy("row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(so_far), F.lit(0))))
    return spans.select("row", "start", "length").distinct().select("row", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").alias("n"))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_hit (words inside a window's occurrence), items (array of the items found).

    Null and wordless texts have no words and hold no item; texts are looked up whole. Repeated rows and equal keys are rows
    of their own. Items with equal texts are found together, items without words never, a null item id is left out of ``items``
    but its words count as hit. Empty tables give no rows or no hits. Other columns are not looked at.
    """
    windows, held_by = item_windows(items, item, item_text, size)
    terms = vocabulary(windows)
    index = build_index(docs, terms, key, text)
    ranked = by_rarity(index, terms, windows)
    found = materialise(phrases(index, ranked), "contam_found")
    ids = ranked.select("id", "window").join(held_by, "window").select("id", "item").filter("item is not null")
    who = found.select("row", "id").distinct().join(_small(ids), "id").groupBy("row").agg(F.collect_set("item").alias("items"))
    hits = covered(found).join(who, "row", "left")
    ends = index.filter("term = 0").select("row", F.col("key").alias(key), F.col("pos").cast("long").alias("n_words"))
    none = F.array().cast(dict(who.dtypes)["items"])
    return ends.join(hits, "row", "left").select(key, "n_words", F.coalesce("n", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


def joined(items: Column) -> Column:
    """Ids sorted as strings, comma-joined."""
    return F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ",")
