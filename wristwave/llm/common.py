"""What several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wristwave.session import drop_tables, made_tables, materialise, ship  # noqa: F401  general helpers

#: Separators of words: space and the control characters from tab to carriage return.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


#: What separates words of letters and digits; everything outside ASCII counts as a letter. For texts in lower case.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """The text with A-Z in lower case, other letters as they are; empty for null."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def alnum_words(text: Column) -> Column:
    """The words of letters and digits of a text in lower case; none for null."""
    return F.array_remove(F.split(lower_ascii(text), NOT_ALNUM), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row.

    A projection would not do: Catalyst may inline it into a lambda, which then computes it for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def utf8_hex(data: Column) -> Column:
    return F.sha2(F.coalesce(data, F.lit("")).cast("binary"), 256)


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have, whatever columns it came with."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


#: Longs of a bitmap that tells which rows may meet a table.
BITMAP_WORDS = 1 << 18


def split_rows(rows: DataFrame, ids: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that may meet ``ids``, the rest) by a bitmap of ``h`` = xxhash64 of the key; no row moves.

    Only the first part needs the join. The bitmap is at most ``BITMAP_WORDS`` rows, so it may be broadcast; where
    ids fill it, no rows are left for the second part.
    """
    word_of = lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(BITMAP_WORDS - 1)
    bit_of = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    word, mask, hash_ = (fresh_name(rows, c) for c in ("bitmap_word", "bitmap_mask", "bitmap_hash"))
    bits = ids.select(word_of(F.col("h")).alias(word), bit_of(F.col("h")).alias(mask)).groupBy(word).agg(F.bit_or(mask).alias(mask))
    bits = F.broadcast(materialise(bits, "bitmap"))
    marked = rows.withColumn(hash_, F.xxhash64(key)).withColumn(word, word_of(F.col(hash_))).join(bits, word, "left")
    may = F.coalesce(F.col(mask).bitwiseAND(bit_of(F.col(hash_))) != 0, F.lit(False))
    return tuple(marked.filter(c).select(*rows.columns) for c in (may, ~may))
