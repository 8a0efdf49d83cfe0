"""Line dedup by a segment-partition edit join.

Lines of all documents are counted by a 128-bit hash. They stand in one order: more frequent first, then by
hash. A line is dropped where an earlier one is within ``threshold`` edits, one more for lines of ``LONG_CHARS`` code
points and more; every other line stays once, at its first occurrence. Lines under ``LEAST_CHARS`` code points, which
share nothing with what one edit makes of them, are compared exactly only. Both classes have keys of their own; lines at
their border have both kinds.

Join: lengths are rounded down to three or four leading bits. For each rounded length that a line within the threshold
may have as well, threshold + 1 segments of one width are laid out, the first half from the line's start, the others from
its end. Two lines within the threshold share one of them unchanged, with i edits before the i-th (pigeonhole), so it is
displaced by at most as many places as edits fit between it and the end that it is counted from. What is compared is
that many code points shorter, at every place inside the segment: a displaced one meets the other line's last place.
Only keys that two lines share go on. In each bucket of a key the
first line is verified against all others, which settles the variants of one line in linear work. What it
does not settle is segmented again, without the segment that is known to be equal, ``LEVELS`` times; the last
buckets are compared in full. Keys are ranked without their texts, which meet only keys that are still open. Verification strips
the common prefix and suffix and takes the bounded edit distance of the rest, which ends as soon as it is exceeded.

No list of a bucket's members is ever built. Occurrences meet the decisions of their lines in a join whose
lines with over a thousandth of all occurrences (a thousand at most) are broadcast. Only DataFrame
functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wristwave.llm.common import fresh_name, let, materialise

THRESHOLD = 1
LEAST_CHARS = 2
LONG_CHARS = 64
LEVELS = 3
HOT = 1000
WORDS = 1 << 18


def entries(line: Column, threshold: int, with_rest: bool) -> Column:
    """Keys of a line: (sig, index, rest); rest is the line without what the key holds.

    All keys are both offered and looked up, so index is always true. Strings too short to cut have one key per rounded
    length. The loops are over the threshold, so they are unrolled here.
    """
    # the lengths are taken once: inside conditions Spark would count them for every mention
    sizes = let(F.length(line), lambda n: F.struct(n.alias("n"), *[_rounded(n - more).alias(f"b{more}") for more in range(threshold + 1)]))
    return let(sizes, lambda at: F.array_distinct(F.filter(F.array(*_candidates(line, at, threshold, with_rest)), lambda e: e["sig"].isNotNull())))


def _rounded(size: Column) -> Column:
    """A length without all but its three or four leading bits; null below zero."""
    bits = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(size, F.lit(1)))) - 3).cast("int")
    return F.when(size >= 0, size - size % F.call_function("shiftleft", F.lit(1), bits))


def _candidates(line: Column, at: Column, threshold: int, with_rest: bool) -> list[Column]:
    n, out = at["n"], []
    for more in range(threshold + 1):
        base = at[f"b{more}"]
        new = base.isNotNull() if more == 0 else base.isNotNull() & (base != at[f"b{more - 1}"])
        width = F.call_function("div", base, F.lit(threshold + 1)).cast("int")
        cut = width > threshold // 2
        for i in range(threshold + 1):
            reach = min(i, threshold - i)
            first = i * width if i <= threshold - i else n - (threshold - i + 1) * width
            for off in range(reach + 1):
                q, size = first + off, width - reach
                sig = F.when(new & cut, F.xxhash64(base, F.lit(i), F.lit(threshold), F.substring(line, q + 1, size)))
                if i == 0:
                    sig = F.when(new & ~cut, F.xxhash64(base, F.lit(threshold))).otherwise(sig)
                row = [sig.alias("sig"), F.lit(True).alias("index")]
                if with_rest:
                    rest = F.concat(F.substring(line, F.lit(1), q), F.substring(line, q + size + 1, n))
                    row.append(F.when(cut, rest).otherwise(line).alias("rest"))
                out.append(F.struct(*row))
    return out


def packed_keys(line: Column, threshold: int) -> Column:
    """The keys of a line without rests."""
    return F.transform(entries(line, threshold, False), lambda e: e["sig"])


def classes(line: Column, threshold: int) -> list[tuple[int, Column]]:
    """The thresholds, and which lines have keys for each: those that it is for and those that can be an earlier line of one."""
    return [(threshold, F.length(line) < LONG_CHARS + threshold), (threshold + 1, F.length(line) >= LONG_CHARS - threshold - 1)]


def all_keys(line: Column, threshold: int) -> Column:
    """The keys of a line for the classes it is in."""
    return F.concat(*[F.when(mine, packed_keys(line, t)).otherwise(F.array().cast("array<bigint>")) for t, mine in classes(line, threshold)])


def variant(line: Column, earlier: Column, threshold: int) -> Column:
    """Whether a line is within what its length allows of an earlier one."""
    return F.when(F.length(line) < LONG_CHARS, within(line, earlier, threshold)).otherwise(within(line, earlier, threshold + 1))


def _common(a: Column, b: Column, most: Column, backwards: bool = False, start: Column | None = None) -> Column:
    """Length of the common prefix or suffix, up to ``most``, by doubling steps from large to small."""
    at = lambda s, done, step: F.substring(s, F.length(s) - done - step + 1, step) if backwards else F.substring(s, done + 1, step)
    steps = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda done, step: F.when((done + step <= most) & (at(a, done, step) == at(b, done, step)), done + step).otherwise(done))


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether two strings are within ``threshold`` edits."""
    def stripped(s):
        head = _common(s["a"], s["b"], F.length(s["b"]))
        return let(head, lambda p: let(_common(s["a"], s["b"], F.length(s["b"]) - p, backwards=True), lambda q: F.struct(
            F.substring(s["a"], p + 1, F.length(s["a"]) - p - q).alias("a"), F.substring(s["b"], p + 1, F.length(s["b"]) - p - q).alias("b"))))

    def verdict(s):
        return F.when(F.length(s["a"]) <= threshold, True).when(F.length(s["b"]) == 0, False).otherwise(F.levenshtein(s["a"], s["b"], threshold) >= 0)

    swap = F.length(a) < F.length(b)
    ordered = F.struct(F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b"))
    far = F.abs(F.length(a) - F.length(b)) > threshold
    return F.when(far, False).otherwise(let(ordered, lambda s: let(stripped(s), verdict)))


def occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, th, pos, line, h1, h2) of lines with a word; th tells texts of one key apart."""
    cells = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    return cells.filter(F.col("line").rlike("[^\\x20\\x09-\\x0D]")).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def may_be_in(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key (a hash) may be among the ids, by a bitmap of 64 * ``WORDS`` bits: most others stay where they are.

    The bitmap is at most ``WORDS`` rows, so it may be broadcast; where ids fill it, it keeps all rows.
    """
    word, bit = F.shiftrightunsigned(key, 6).bitwiseAND(WORDS - 1), F.col(key).bitwiseAND(63).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bits = ids.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    met = rows.withColumn("word", word).join(F.broadcast(bits), "word")
    return met.filter(F.col("mask").bitwiseAND(mask) != 0).drop("word", "mask")


def near_lines(lines: DataFrame, texts_of, threshold: int) -> DataFrame:
    """(h1, h2) of lines that have an earlier line within the threshold that their length allows.

    ``lines``: h1, n, sigs; ``texts_of(ids)``: (h1, h2, n, line) of those h1.
    """
    keys = lines.select("h1", "n", F.explode("sigs").alias("sig"))
    first = Window.partitionBy("sig").orderBy(F.col("n").desc(), "h1")
    rows = keys.withColumns({"rank": F.row_number().over(first), "after": F.lead("h1").over(first), "x_h1": F.first("h1").over(first)})
    rows = materialise(rows.filter("rank > 1 or after is not null").drop("after", "n"), "line_keys")
    texts = materialise(texts_of(rows.select("h1").distinct()), "line_texts")
    as_lead = texts.select(*[F.col(c).alias(f"x_{c}") for c in ("h1", "h2", "line")])
    near = lambda pairs: pairs.filter(variant(F.col("line"), F.col("x_line"), threshold)).select("h1", "h2")
    pairs = rows.filter("rank > 1").select("h1", "x_h1").distinct()
    done = materialise(near(pairs.join(texts, "h1").join(as_lead, "x_h1").filter("h1 != x_h1 or h2 != x_h2")).distinct(), "line_done")
    # buckets where a line has earlier ones and is not settled
    left = rows.join(rows.filter("rank > 2").join(done, "h1", "left_anti").select("sig").distinct(), "sig", "left_semi")
    asked = texts.join(left.groupBy("h1").agg(F.collect_set("sig").alias("open")), "h1")
    kinds = classes(F.col("line"), threshold)
    level = reduce(DataFrame.unionByName, [asked.filter(mine).select("h1", "h2", "n", F.lit(t).alias("t"), "open", F.inline(entries(F.col("line"), t, True))) for t, mine in kinds])
    level = materialise(level.filter(F.array_contains("open", F.col("sig"))).drop("open", "index"), "line_level")
    by_class = lambda f: F.when(F.col("t") == threshold, f(threshold)).otherwise(f(threshold + 1))
    for _ in range(LEVELS):
        finer = level.select("h1", "h2", "n", F.col("sig").alias("up"), F.explode(by_class(lambda t: packed_keys(F.col("rest"), t))).alias("sig"))
        finer = finer.withColumn("sig", F.xxhash64("up", "sig"))
        ranked = Window.partitionBy("sig").orderBy(F.col("n").desc(), "h1", "h2")
        finer = finer.withColumns({"rank": F.row_number().over(ranked), "after": F.lead("h1").over(ranked)} | {f"x_{c}": F.first(c).over(ranked) for c in ("h1", "h2")})
        finer = materialise(finer.filter("rank > 1 or after is not null").drop("after", "n"), "line_finer")
        pairs = finer.filter("rank > 1 and (h1 != x_h1 or h2 != x_h2)").select("h1", "h2", "x_h1", "x_h2").distinct()
        hits = near(pairs.join(texts, ["h1", "h2"]).join(as_lead, ["x_h1", "x_h2"]))
        done = materialise(done.unionByName(hits).distinct(), "line_done")
        left = finer.join(finer.filter("rank > 2").join(done, ["h1", "h2"], "left_anti").select("sig").distinct(), "sig", "left_semi")
        asked = level.withColumnRenamed("sig", "up").join(left.groupBy("h1", "h2", "up").agg(F.collect_set("sig").alias("open")), ["h1", "h2", "up"])
        level = asked.select("h1", "h2", "n", "t", "open", "up", F.inline(by_class(lambda t: entries(F.col("rest"), t, True))))
        level = level.withColumn("sig", F.xxhash64("up", "sig")).filter(F.array_contains("open", F.col("sig")))
        level = materialise(level.drop("open", "up", "index"), "line_level")
    order = lambda p: F.struct((-F.col(f"{p}n")).alias("n"), F.col(f"{p}h1").alias("h1"), F.col(f"{p}h2").alias("h2"))
    level = materialise(level.select("h1", "h2", "sig").distinct().join(texts, ["h1", "h2"]), "line_last")
    late = level.join(done, ["h1", "h2"], "left_anti")
    early = level.select("sig", *[F.col(c).alias(f"x_{c}") for c in ("h1", "h2", "n", "line")])
    rest = near(late.join(early, "sig").filter(order("x_") < order("")))
    return materialise(done.unionByName(rest).distinct(), "line_near")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, out: str = "line_dedup") -> DataFrame:
    """Every row and column of the table and a struct ``out``: n_lines, n_repeated, n_near, text (what is kept).

    n_lines counts lines with a word; n_repeated those dropped as exact repeats, n_near as variants of an earlier
    line. Lines without a word stay. Null text stays null. Rows of one key with equal texts are one document and
    treated alike; null keys are a key. An empty table gives an empty result. A column called ``out`` is replaced.
    """
    docs = docs.drop(out)
    occ = occurrences(docs, key, text)
    long = F.length("line") >= LEAST_CHARS
    sigs = F.when(long, all_keys(F.col("line"), threshold))
    seen = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "th", "pos")).alias("first")
    lines = occ.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), seen, F.first(sigs).alias("sigs"))
    lines = materialise(lines, "lines")

    def texts_of(ids):
        some = may_be_in(occ.filter(long).select("h1", "h2", "line"), ids, "h1")
        wanted = some.join(ids, "h1")  # a semi-join would be pushed below the bitmap
        return wanted.groupBy("h1", "h2", "line").agg(F.count(F.lit(1)).alias("n"))

    near = near_lines(lines.filter("sigs is not null"), texts_of, threshold)
    total = lines.agg(F.sum("n")).first()[0] or 0
    bad = lines.select("h1", "h2", "n", "first").join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").filter("near or n > 1")
    bad = materialise(bad.withColumn("near", F.coalesce("near", F.lit(False))), "line_bad")
    busy = F.col("n") * HOT > total
    hot = bad.filter(busy).select("h1", "h2", F.col("first").alias("hot_first"), F.col("near").alias("hot_near"))
    cold = bad.filter(~busy).select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "first", "near")
    met = occ.select("key", "th", "pos", "h1", "h2").join(F.broadcast(hot), ["h1", "h2"], "left")
    spread = F.when(F.col("hot_near").isNull(), F.col("h1")).otherwise(F.xxhash64("key", "th", "pos"))
    met = met.withColumn("h1", spread).join(cold, F.col("hot_near").isNull() & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    met = met.select("key", "th", "pos", F.coalesce("hot_first", "first").alias("first"), F.coalesce("hot_near", "near").alias("near"))
    mine = F.struct(F.col("key").isNull().alias("none"), "key", "th", "pos")
    drop = F.when(F.col("near").isNull(), False).otherwise(F.col("near") | ~F.col("first").eqNullSafe(mine))  # null: a line met once
    gk, gt, g = (fresh_name(docs, c) for c in ("line_key", "line_th", "line_gone"))
    places = lambda c: F.collect_set(F.when(c, F.col("pos")))  # noqa: E731  identical rows count once
    per = F.struct(F.size(places(F.lit(True))).alias("n_lines"), F.size(places(F.col("near"))).alias("n_near"), places(drop).alias("at"))
    gone = met.groupBy(F.col("key").alias(gk), F.col("th").alias(gt)).agg(per.alias(g))
    cut = docs.join(gone, docs[key].eqNullSafe(F.col(gk)) & (F.xxhash64(docs[text]) == F.col(gt)), "left")
    whole = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    dropped, near_ones = whole(F.size(f"{g}.at")), whole(F.col(f"{g}.n_near"))
    kept = let(F.split(docs[text], "\n"), lambda a: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col(f"{g}.at")), lambda i: F.get(a, i)), "\n"))
    cleaned = F.struct(whole(F.col(f"{g}.n_lines")).alias("n_lines"), (dropped - near_ones).alias("n_repeated"), near_ones.alias("n_near"), F.when(dropped > 0, kept).otherwise(docs[text]).alias("text"))
    return cut.select(*[docs[c] for c in docs.columns], cleaned.alias(out))
