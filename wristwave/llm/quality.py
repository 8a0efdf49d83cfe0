"""Quality rules with thresholds that adapt to each language and source.

Every document is measured once with array functions. Quantile sketches of the measures, mergeable, so built
in every task and combined, give each (language, source) group its fences: a measure may lie ``REACH``
quartile ranges beyond the quartiles, where a range counts at least its floor (else a group without any
symbols would reject a single one). Documents then meet the fences of their group in a join; the fences are a
stored table, so Spark knows its size when it picks the join, and splits a large group where it shuffles.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wristwave.llm.common import WORD_GAP, fresh_name, let, materialise, words

#: Floors of the quartile range, by measure.
FLOORS = {"symbol_share": 0.015, "upper_share": 0.1, "word_length": 0.5, "repeat_share": 0.1, "dup_line_share": 0.15}
REACH = 3.0
ACCURACY = 10_000
LEAST_WORDS = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(w: Column) -> Column:
    """Number of words in three-word windows that the array holds twice or more."""
    n = F.size(w)
    windows = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("h"), i.alias("i")))
    hash_at = lambda s, j: F.get(s, j)["h"]

    def covered(s):
        twice = F.filter(s, lambda x, j: (hash_at(s, j + 1) == x["h"]) | ((j > 0) & (hash_at(s, F.greatest(j - 1, F.lit(0))) == x["h"])))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    return F.when(n < 3, 0).otherwise(let(F.sort_array(windows), covered)).cast("long")


def measures(text: Column) -> Column:
    """Struct of the counts of a text; null counts as empty. Also lines with a word, and upper-case letters."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_replace(x, WORD_GAP, "") != "")
    packed = F.regexp_replace(t, WORD_GAP, "")
    return let(F.struct(words(t).alias("w"), lines.alias("l"), packed.alias("p")), lambda s: F.struct(
        F.size(s["w"]).cast("long").alias("n_words"),
        F.length(s["p"]).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(s["p"], "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(s["l"]) - F.size(F.array_distinct(s["l"]))).cast("long").alias("n_dup_lines"),
        repeated_words(s["w"]).alias("n_repeat_words"),
        F.size(s["l"]).cast("long").alias("n_lines"),
        F.length(F.regexp_replace(s["p"], "\\P{Lu}+", "")).cast("long").alias("n_upper"),
    ))


def failed_base(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < LEAST_WORDS) | (100 * n_repeat > 50 * n_words)


def shares(m: str) -> dict[str, Column]:
    c = lambda x: F.col(f"{m}.{x}")
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return {
        "symbol_share": safe(c("n_symbols"), c("word_chars")), "upper_share": safe(c("n_upper"), c("word_chars")),
        "word_length": safe(c("word_chars"), c("n_words")), "repeat_share": safe(c("n_repeat_words"), c("n_words")),
        "dup_line_share": safe(c("n_dup_lines"), c("n_lines")),
    }


def fences(measured: DataFrame, m: str, lang: str, source: str, reach: float = REACH) -> DataFrame:
    """(lang, source, low and high of each measure) from sketches over the documents that pass the base rules."""
    sound = measured.filter(~failed_base(F.col(f"{m}.n_words"), F.col(f"{m}.n_repeat_words")))
    rows = sound.select(F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), *[v.alias(k) for k, v in shares(m).items()])
    sketch = rows.groupBy("g_lang", "g_source").agg(*[F.percentile_approx(k, [0.25, 0.75], ACCURACY).alias(k) for k in FLOORS])
    out = []
    for k, floor in FLOORS.items():
        a, b = F.col(k)[0], F.col(k)[1]
        room = reach * F.greatest(b - a, F.lit(floor))
        out += [(a - room).alias(f"{k}_low"), (b + room).alias(f"{k}_high")]
    return sketch.select("g_lang", "g_source", *out)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", out: str = "quality_rules") -> DataFrame:
    """Every row and column of the table and a struct ``out``: the counts, base_failed, kept.

    Null text counts as empty and fails the base rules; null languages and sources are groups of their own.
    Repeated rows are judged each; an empty table gives an empty result.
    """
    docs = docs.drop(out)
    m = fresh_name(docs, "measured")
    measured = materialise(docs.withColumn(m, measures(F.col(text))), "quality_measures")
    limits = materialise(fences(measured, m, lang, source), "quality_fences")
    met = measured.join(limits, measured[lang].eqNullSafe(limits["g_lang"]) & measured[source].eqNullSafe(limits["g_source"]), "left")
    inside = F.lit(True)
    for k, v in shares(m).items():
        inside = inside & v.between(limits[f"{k}_low"], limits[f"{k}_high"])
    base = failed_base(F.col(f"{m}.n_words"), F.col(f"{m}.n_repeat_words"))
    verdict = F.struct(*[F.col(f"{m}.{c}").alias(c) for c in COUNTS], base.alias("base_failed"), (~base & F.coalesce(inside, F.lit(False))).alias("kept"))
    return met.select(*[measured[c] for c in docs.columns], verdict.alias(out))
