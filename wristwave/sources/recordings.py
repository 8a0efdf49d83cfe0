"""Recording readers: sensor CSV, reference HR CSV, discovery, quality metadata."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wristwave.functions.scalars import SENSOR_COLUMNS, clock_seconds, layout_kind, numeric, valid_mask
from wristwave.operators.align import pair_references
from wristwave.sources.tables import sensor

FLAGS = ["SampleIndex", "Seq", "ValidFlag", "InterpFlag", "GapLen", "MissingBefore"]
STANDARD_HEADER = ["Time(s)", *[SENSOR_COLUMNS[c] for c in (
    "uc1", "uc2", "ut1", "ut2", "accx", "accy", "accz", "gyrox", "gyroy", "gyroz", "ppg_green", "ppg_red", "ppg_ir")]]


def from_sensor(spark: SparkSession, sf: str) -> DataFrame:
    """The 13-channel recording table derived from the sensor view (25 Hz)."""
    s = sensor(spark, sf)
    x, y, z = F.col("accx"), F.col("accy"), F.col("accz")
    return s.select(
        "recording", "sample_idx", "t_s",
        (F.col("ppg") / 1000 + 900).alias("ppg_green"), (F.col("ppg") / 1000 * (1 - y) + 900).alias("ppg_red"),
        (F.col("ppg") / 1000 * (1 + z) + 800).alias("ppg_ir"),
        (x / 100 + 1).alias("uc1"), (x / 90 + 1.1).alias("uc2"), (x / 50 + 5).alias("ut1"), (y * 10 + 5.5).alias("ut2"),
        (x / 25 - 1).alias("accx"), (y * 10 - 0.5).alias("accy"), (z * 10).alias("accz"),
        (x * 3).alias("gyrox"), (y * 300).alias("gyroy"), (z * 300).alias("gyroz"),
        ((F.col("rf") != "N") | (F.col("ls") == "O")).alias("valid"),
    )


# ---------------------------------------------------------------- numbering of text rows
def _file_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value, header): lines of many files with their number and the file's first line; no line is moved.

    A task reads each of its splits from end to end, so it counts lines as they come. What earlier splits of a file hold is looked
    up for files of several splits only: a row a split, so the table stays far smaller than one task's input.
    """
    raw = spark.read.options(recursiveFileLookup=True).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.col("_metadata.file_size").alias("_size"))
    # splits are never shorter than this, so shorter files are not read for it
    least = min(_bytes(spark.conf.get(f"spark.sql.files.{name}")) for name in ("openCostInBytes", "maxPartitionBytes"))
    parts = raw.filter(F.col("_size") > F.lit(least))
    parts = parts.groupBy("file", "_at").agg(F.count(F.lit(1)).alias("_c"), F.first("value").alias("_first"))
    before = W.partitionBy("file").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumns({"_before": F.sum("_c").over(before), "_head": F.first("_first").over(before)}).filter("_at > 0")
    parts = parts.select(F.col("file").alias("_file"), F.col("_at").alias("_from"), "_before", "_head")
    placed = raw.withColumn("_in", _in_split(F.col("value"), F.xxhash64("file", "_at")))
    met = placed.join(F.broadcast(parts), (F.col("file") == F.col("_file")) & (F.col("_at") == F.col("_from")), "left")
    return met.select("file", (F.col("_in.line") + F.coalesce("_before", F.lit(0))).alias("line"), "value", F.coalesce("_head", "_in.first").alias("header"))


def _bytes(text: str) -> int:
    """Bytes of a size as Spark writes it (4194304, 4MB, 512k, 100b)."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", text.strip().lower()).groups()
    return int(number) * 1024 ** (" kmgt".index(unit[0]) if unit and unit[0] in "kmgt" else 0)


def _in_split(value: Column, split: Column) -> Column:
    """Number of each line in its split, from 0, and the split's first line, over all batches of a task."""

    @F.arrow_udf("struct<line:bigint,first:string>")
    def place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, n, first = None, 0, None
        for values, keys in batches:
            k = keys.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, dtype=np.int64)
            size = np.diff(np.append(starts, len(k)))
            line = np.arange(len(k), dtype=np.int64) - np.repeat(starts, size)
            heads = values.take(pa.array(starts)).to_pylist()
            if len(k) and k[0] == last:
                line[: size[0]] += n
                heads[0] = first
            if len(k):
                last, n, first = k[-1], int(line[-1]) + 1, heads[-1]
            told = pa.array(heads, pa.string()).take(pa.array(np.repeat(np.arange(len(starts)), size)))
            yield pa.StructArray.from_arrays([pa.array(line), told], ["line", "first"])

    # else Spark would filter lines by their text before they are counted
    return place.asNondeterministic()(value, split)


def stem_of(path: Column) -> Column:
    """Recording name: a ``recording=`` / ``stem=`` folder if there is one, else the file name."""
    folder = F.regexp_extract(path, r"(?:recording|stem)=([^/]+)/", 1)
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.csv$", "")
    return F.when(folder != "", folder).otherwise(name)


def scan_sensor(spark: SparkSession, path: str, columns: list[str] | None = None, fs: int = 100) -> DataFrame:
    """samples(recording, sample_idx, t_s, channels, valid, gap_len, kind).

    Header names decide the position of each channel per file; an unknown column name in the
    request raises at once, a channel missing in a file raises when that file is read.
    """
    cols = list(SENSOR_COLUMNS) if columns is None else list(columns)
    unknown = [c for c in cols if c not in SENSOR_COLUMNS]
    if unknown:
        raise KeyError(f"unknown sensor columns: {unknown}")
    lines = _file_rows(spark, path).filter("line > 0")
    rows = lines.withColumns({"_names": F.transform(F.split("header", ","), F.trim), "_cells": F.split("value", ",")})

    def cell(name: str, required: bool = False) -> Column:
        at = F.array_position("_names", name)
        v = F.get("_cells", (at - 1).cast("int"))
        if required:
            return F.when(at > 0, v).otherwise(F.raise_error(F.concat(F.lit(f"column {name} missing in "), F.col("file"))))
        return F.when(at > 0, v)

    has_flag = F.array_contains("_names", "ValidFlag")
    values = {c: numeric(cell(SENSOR_COLUMNS[c], True)) for c in cols}
    ok = valid_mask([cell(SENSOR_COLUMNS[c]) for c in cols])
    ok = ok & (~has_flag | F.coalesce(numeric(cell("ValidFlag")) > 0, F.lit(False)))
    # a stored index lets a recording span several files; otherwise the row's place in its file
    idx = F.coalesce(numeric(cell("SampleIndex")), F.col("line") - 1).cast("bigint")
    return rows.select(
        stem_of(F.col("file")).alias("recording"), idx.alias("sample_idx"),
        F.coalesce(numeric(cell("Time(s)")), idx / fs).alias("t_s"),
        *[v.alias(c) for c, v in values.items()],
        ok.alias("valid"), numeric(cell("GapLen")).alias("gap_len"), layout_kind(F.col("header")).alias("kind"),
    )


def scan_polar(spark: SparkSession, path: str) -> DataFrame:
    """S3: reference HR with three lead lines; time in the 2nd and BPM in the 3rd column."""
    rows = _file_rows(spark, path).filter("line >= 3").withColumn("_c", F.split("value", ","))
    out = rows.select(
        stem_of(F.col("file")).alias("reference"), "line",
        clock_seconds(F.get("_c", F.lit(1))).alias("t_s"), numeric(F.get("_c", F.lit(2))).alias("bpm"),
    )
    return out.filter("t_s is not null and bpm is not null")


def scan_hr_reference(spark: SparkSession, path: str) -> DataFrame:
    """``elapsed_seconds, hr_bpm`` files with a header."""
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    missing = [c for c in ("elapsed_seconds", "hr_bpm") if c not in raw.columns]
    if missing:
        raise ValueError(f"reference files lack {missing}; found {raw.columns}")
    out = raw.select(
        stem_of(F.col("_metadata.file_path")).alias("reference"), numeric(F.col("elapsed_seconds")).alias("t_s"), numeric(F.col("hr_bpm")).alias("bpm")
    )
    return out.filter("t_s is not null and bpm is not null")


def discover(spark: SparkSession, path: str, suffixes: list[str] = ("_ref", "_HR_ref")) -> DataFrame:
    """S5 + J1: recordings in a folder with their reference stem (NULL when none exists)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(path)
    return pair_references(files.select(stem_of(F.col("path")).alias("stem")).distinct(), suffixes)


def quality_metadata(samples: DataFrame) -> DataFrame:
    """S6"""
    return samples.groupBy("recording").agg(
        F.first("kind").alias("kind"), F.count_if("valid").alias("valid_count"), F.count_if(~F.col("valid")).alias("missing_count"),
        F.max(F.coalesce(F.col("gap_len"), F.lit(0.0))).alias("max_gap_samples"),
    )


def preview(samples: DataFrame, seconds: float, fs: int) -> DataFrame:
    """Only the first seconds; ``complete`` is false for short recordings."""
    n = int(round(seconds * fs))
    head = samples.filter(F.col("sample_idx") < n)
    return head.groupBy("recording").agg(F.count("*").alias("rows")).withColumn("complete", F.col("rows") >= n)
