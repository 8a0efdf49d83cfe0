"""A training corpus from raw documents: quality rules, line dedup, near-dedup, source mix, token ids.

Every stage reads the table that the one before wrote and returns the columns of ``documents``, the last one a
row of token digests per document of the mix. Tables that a stage stored for itself go when the next one begins.

For every stage: null, empty and very long texts are rows like any other; rows of equal ids, or without one, are
documents of their own; an empty table gives an empty result; further columns come through unchanged, whatever
they are called, up to the last stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wristwave.llm import alike, bpe, line_dedup, mixing, near_dedup, quality
from wristwave.llm.common import drop_tables, fresh_name, made_tables, table, word_count
from wristwave.session import shared_path


#: By application and stage, the tables that the stage has stored for itself.
_LEFT: dict[tuple[str, str], list[str]] = {}


def stage(f):
    """A stage that first drops what the other stages stored, unless its own input still reads it."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        for key, left in _LEFT.items():
            if key[0] == app and key[1] != f.__name__:
                drop_tables(spark, left, keep_for=docs)
                left[:] = [p for p in left if p in made_tables(spark)]
        before = set(made_tables(spark))
        out = f(spark, docs, sf_dir)
        _LEFT.setdefault((app, f.__name__), []).extend(p for p in made_tables(spark) if p not in before)
        return out

    return run


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """The table with another text and its length."""
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    mark = fresh_name(docs, "quality_rules")
    return quality.judge(docs, out=mark).filter(f"{mark}.kept").drop(mark)


@stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every line once over the corpus; documents that have no line left go."""
    mark = fresh_name(docs, "line_dedup")
    done = line_dedup.dedup(docs, out=mark).filter(f"{mark}.n_lines = 0 or {mark}.n_lines > {mark}.n_repeated + {mark}.n_near")
    return with_text(done, F.col(f"{mark}.text")).drop(mark)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (operator 10), then of each group whose shingles of five words are at least 0.8 alike.

    The second step finds what is near by its words but over four bits apart; it sees what the first one kept.
    """
    return alike.one_of_each(near_dedup.one_of_each(docs))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every time the mix takes a document; one document of a source may be cut to its first words."""
    weight, mark = fresh_name(docs, "mix_weight"), fresh_name(docs, "mix")
    weighed = mixing.quality_weight(docs, table(spark, sf_dir, "labels"), weight=weight)
    mixed = mixing.mix(weighed, word_count(F.col("text")), F.col(weight), out=mark)
    part, size = F.col(f"{mark}.part"), F.col(f"{mark}.size")
    last = F.when(part == size, F.col("text")).otherwise(mixing.first_words(F.col("text"), part))
    copies = F.concat(F.array_repeat("text", F.col(f"{mark}.epochs").cast("int")), F.when(part > 0, F.array(last)).otherwise(F.array().cast("array<string>")))
    taken = mixed.withColumn("text", F.explode(copies))
    return with_text(taken, F.col("text")).select(*docs.columns)


@stage
def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("near-dedup", near_duplicates),
    ("mixing", mix_sources),
    ("BPE", tokenise),
]

#: XXH64 fingerprints and token ids have no SQL twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), None
    for number, (_, f) in enumerate(STAGES):
        path = shared_path(spark, f"pipeline-{number}")
        f(spark, docs, sf_dir).write.parquet(path)
        if read:
            drop_tables(spark, [read])
        docs, read = spark.read.parquet(path), path
    return docs
