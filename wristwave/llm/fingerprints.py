"""SimHash fingerprints of 128 bits, and the search for all within a Hamming radius.

Terms are pairs of neighbouring words (the last word pairs with nothing). A term's weight grows with the
length of its first word; its two 64-bit hashes vote with that weight for every bit they set and against
every bit they don't. Votes are packed, four 16-bit counters to a long, so that one row of sums does it all
inside generated code; chunks of ``CHUNK`` terms keep the counters from overflowing in texts of any length.

Search tables: radius + 1 blocks, and a table per block with that block moved to the front as key. Within the
radius some block is equal, so an equality join on the tables misses nothing; a pair counts only in the table
of its first equal block. Equal fingerprints collapse to one row with a count before tables are built.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wristwave.llm.common import let, materialise, utf8_hex, words

CHUNK = 8000
NEIGHBOURS = 9
FEW = 10_000
_SPREAD, _LANES = (1 << 45) | (1 << 30) | (1 << 15) | 1, (1 << 48) | (1 << 32) | (1 << 16) | 1


def terms(text: Column) -> Column:
    """Array of term hashes; the two lowest bits hold the weight less one."""
    def term(w, x, i):
        heavy = F.least(F.lit(3), F.shiftright(F.length(x), 2)).cast("long")
        return F.xxhash64(x, F.get(w, i + 1)).bitwiseAND(-4).bitwiseOR(heavy)

    return let(words(text), lambda w: F.transform(w, lambda x, i: term(w, x, i)))


def votes(term: Column) -> list[Column]:
    """32 aggregates: weight sums of the bits of two hashes, four to a long, and last the total weight."""
    weight, out = term.bitwiseAND(3) + 1, []
    for k in range(2):
        h = F.xxhash64(term, F.lit(k))
        for j in range(16):
            four = F.shiftrightunsigned(h, 4 * j).bitwiseAND(15) * F.lit(_SPREAD)
            out.append(F.sum(four.bitwiseAND(_LANES) * weight).alias(f"v{16 * k + j}"))
    return [*out, F.sum(weight).alias("weight")]


def fingerprint_longs(packed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, chunk, v0..v31, weight) to (keys, f0, f1)."""
    lane = lambda v, k: F.shiftrightunsigned(F.col(v), 16 * k).bitwiseAND(0xFFFF)
    wide = [F.sum(lane(f"v{j}", k)).alias(f"s{4 * j + k}") for j in range(32) for k in range(4)]
    long = packed.filter("chunks > 1").groupBy(*keys).agg(F.sum("weight").alias("weight"), *wide)
    bit = lambda value, weight, at: F.when(2 * value > weight, F.lit(1 << at if at < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long"))

    def gather(values):
        out = []
        for k in range(2):
            bits = [bit(values[64 * k + i], F.col("weight"), i) for i in range(64)]
            while len(bits) > 1:
                bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
            out.append(bits[0].alias(f"f{k}"))
        return out

    short = packed.filter("chunks <= 1").select(*keys, *gather([lane(f"v{j}", k) for j in range(32) for k in range(4)]))
    return short.unionByName(long.select(*keys, *gather([F.col(f"s{i}") for i in range(128)])))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, f0, f1) for rows with unique keys. Null, empty and wordless texts have fingerprint zero."""
    rows = texts.select(*keys, terms(F.col(text)).alias("terms"))
    chunks = F.greatest(F.lit(1), F.ceil(F.size("terms") / CHUNK)).alias("chunks")
    cells = rows.select(*keys, chunks, F.posexplode_outer("terms").alias("at", "term"))
    by = [*keys, "chunks", F.floor(F.coalesce("at", F.lit(0)) / CHUNK).alias("chunk")]
    packed = cells.groupBy(*by).agg(*votes(F.col("term")))
    return fingerprint_longs(packed.fillna(0, [f"v{j}" for j in range(32)] + ["weight"]), keys)


def hex_of(f0: Column, f1: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f0), 16, "0"), F.lpad(F.hex(f1), 16, "0")))


def differing(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def likeness(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return 1 - differing(a0, a1, b0, b1) / F.lit(128.0)


def block(f0: Column, f1: Column, k: int, n: int) -> Column:
    """The k-th of n nearly equal blocks of the 128 bits."""
    lo, hi = 128 * k // n, 128 * (k + 1) // n
    take = lambda f, a, b: F.shiftrightunsigned(f, a).bitwiseAND((1 << (b - a)) - 1) if b - a < 64 else f
    if hi <= 64:
        return take(f0, lo, hi)
    return take(f1, lo - 64, hi - 64) if lo >= 64 else take(f0, lo, 64).bitwiseOR(F.shiftleft(take(f1, 0, hi - 64), 64 - lo))


def within(queries: DataFrame, all_rows: DataFrame, radius: int = 3) -> DataFrame:
    """For each distinct fingerprint of ``queries`` (f0, f1): how many rows of ``all_rows`` are within the radius."""
    n = radius + 1

    def tables(rows, a, b, *more):
        entry = [F.struct(F.lit(k).alias("no"), block(F.col(a), F.col(b), k, n).alias("front")) for k in range(n)]
        return rows.select(a, b, *more, F.inline(F.array(*entry)))

    left = tables(queries.select(F.col("f0").alias("q0"), F.col("f1").alias("q1")).distinct(), "q0", "q1")
    right = tables(all_rows.groupBy("f0", "f1").agg(F.count(F.lit(1)).alias("n")), "f0", "f1", "n")
    q, f = (F.col("q0"), F.col("q1")), (F.col("f0"), F.col("f1"))
    first = F.coalesce(*[F.when(block(*q, k, n) == block(*f, k, n), k) for k in range(n)])
    met = left.join(right.withColumnsRenamed({"no": "fno", "front": "ffront"}), (F.col("no") == F.col("fno")) & (F.col("front") == F.col("ffront")) & (differing(*q, *f) <= radius) & (first == F.col("no")))
    return met.groupBy("q0", "q1").agg(F.sum("n").alias("near"))


def next_lower(keys: DataFrame) -> DataFrame:
    """(k, next) for distinct longs: the next lower key; the lowest meets the highest.

    Keys are ordered inside blocks of 2^``NEIGHBOURS`` neighbouring values, block ends in blocks of blocks, up to
    a level of at most ``FEW`` possible values. Level bounds are the only thing the driver sees.
    """
    low, high = keys.agg(F.min("k"), F.max("k")).first()
    order = Window.orderBy(F.col("k").desc())
    if low is None or (high - low) <= FEW:
        return keys.select("k", F.coalesce(F.lead("k").over(order), F.max("k").over(Window.partitionBy(F.lit(1)))).alias("next"))
    cell = keys.select("k", F.shiftright("k", NEIGHBOURS).alias("cell"))
    inner = materialise(cell.select("k", "cell", F.lead("k").over(Window.partitionBy("cell").orderBy(F.col("k").desc())).alias("next")), "fp_order")
    heads = inner.groupBy("cell").agg(F.max("k").alias("head"))
    after = next_lower(heads.select(F.col("cell").alias("k"))).join(heads.withColumnRenamed("cell", "next"), "next").select(F.col("k").alias("cell"), "head")
    ends = inner.filter("next is null").join(after, "cell").select("k", F.col("head").alias("next"))
    return inner.filter("next is not null").select("k", "next").unionByName(ends)


def beside_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row, text, next_row, next_text) with the next row by descending key; after the last comes the first.

    Rows of equal keys follow one another by hash of their text, then place; null keys come last. Texts are
    dealt out once, by blocks of neighbouring keys. Each block also gets the first row of the one after it,
    a copy that only its last row sees.
    """
    order_key = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(key).alias("key"), order_key.alias("k"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("cell", F.shiftright("k", NEIGHBOURS))
    order = [F.col("k").desc(), F.xxhash64("text"), F.col("row")]
    cells = materialise(docs.select(F.shiftright(order_key, NEIGHBOURS).alias("k")).distinct(), "fp_cells")
    after = next_lower(cells).select(F.col("k").alias("to"), F.col("next").alias("cell"))
    heads = rows.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy(*order))).filter("rank = 1").drop("rank")
    guests = materialise(heads.join(after, "cell").select("key", "k", "text", "row", F.col("to").alias("cell")), "fp_heads")
    all_rows = rows.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    w = Window.partitionBy("cell").orderBy("guest", *order)
    met = all_rows.select("key", "row", "text", "guest", F.lead("row").over(w).alias("next_row"), F.lead("text").over(w).alias("next_text"))
    return met.filter(~F.col("guest")).drop("guest")


def edited(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by as many first ones (or all) of the following text."""
    t, n = F.coalesce(text, F.lit("")), F.length(F.coalesce(text, F.lit("")))
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(t, F.lit(1), n - third), F.substring(F.coalesce(following, F.lit("")), F.lit(1), third))


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """One row per row of the table: fingerprints of its text and of its edited text, their likeness, that of the
    next row's fingerprint, and for rows whose key is a multiple of 100 the number of other rows within the radius.

    Null texts count as empty; repeated rows are rows of their own; one row alone is its own next row; an empty
    table gives an empty result. Other columns are not looked at.
    """
    pairs = beside_next(docs, key, text)
    both = pairs.select("row", F.col("key"), "next_row", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), edited(F.col("text"), F.col("next_text")).alias("e"), "text")
    both = both.select("row", "key", "next_row", "n_chars", utf8_hex(F.col("e")).alias("sha"), F.inline(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("e").alias("t")))))
    marks = fingerprints(both, ["row", "key", "next_row", "n_chars", "sha", "kind"], "t")
    own = lambda kind, f: F.max(F.when(F.col("kind") == kind, F.col(f)))
    rows = marks.groupBy("row", "key", "next_row", "n_chars", "sha").agg(own(0, "f0").alias("f0"), own(0, "f1").alias("f1"), own(1, "f0").alias("e0"), own(1, "f1").alias("e1"))
    rows = materialise(rows, "fingerprints")
    follow = rows.select(F.col("row").alias("nr"), F.col("f0").alias("n0"), F.col("f1").alias("n1"))
    asked = rows.filter(F.col("key") % 100 == 0)
    found = within(asked, rows, radius)
    out = rows.join(follow, F.col("next_row") == F.col("nr")).join(found, (F.col("key") % 100 == 0) & (F.col("f0") == F.col("q0")) & (F.col("f1") == F.col("q1")), "left")
    f, e, n = (F.col("f0"), F.col("f1")), (F.col("e0"), F.col("e1")), (F.col("n0"), F.col("n1"))
    return out.select(
        F.col("key").alias(key), "n_chars", F.col("sha").alias("edited_sha256"), hex_of(*f).alias("fingerprint"), hex_of(*e).alias("edited_fingerprint"),
        likeness(*f, *e).alias("near_edited"), likeness(*f, *n).alias("near_next"), (F.col("near") - 1).alias("n_near"))
