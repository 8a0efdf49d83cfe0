"""Writers and their readers: recordings, reports, result tables.

Every writer keeps the partitioning it is given (no coalesce to one file); large keys are
spread with range partitioning before a partitioned write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wristwave.functions.scalars import SENSOR_COLUMNS

SCHEMA_VERSION = "v2"
SPO2_SCHEMA_VERSION = "v2_spo2"


def write_sensor_csv(samples: DataFrame, path: str, timeline: bool = True) -> str:
    """S1's layout, one folder per recording; ``timeline`` adds the index and flag columns."""
    cols = [F.col(c).alias(n) for c, n in SENSOR_COLUMNS.items() if c in samples.columns]
    extra = [F.col("sample_idx").alias("SampleIndex")]
    if timeline:
        extra += [F.col("valid").cast("int").alias("ValidFlag"), (~F.col("valid")).cast("int").alias("InterpFlag"), F.when(F.col("valid"), 0).otherwise(1).alias("GapLen")]
    out = samples.repartitionByRange("recording", "sample_idx").sortWithinPartitions("recording", "sample_idx")
    out.select("recording", F.col("t_s").alias("Time(s)"), *cols, *extra).write.partitionBy("recording").option("header", True).csv(path)
    return path


def write_polar(ref: DataFrame, path: str) -> str:
    """S3's layout, one file per (recording, 30-day session): three lead lines, then ``,seconds,bpm``."""
    body = ref.select("recording", F.floor(F.col("t_s") / (30 * 86400.0)).cast("int").alias("session"), F.col("t_s"), F.col("bpm"))
    lead = body.select("recording", "session").distinct().select(
        "recording", "session", F.posexplode(F.array(F.lit("Name,Sport,Date"), F.lit("wristwave,test,2024-01-01"), F.lit("Sample rate,Time,HR (bpm)"))).alias("k", "value")
    ).select("recording", "session", (F.col("k") - 3).cast("double").alias("at"), "value")
    rows = body.select("recording", "session", F.col("t_s").alias("at"), F.concat_ws(",", F.lit("1"), F.col("t_s").cast("string"), F.col("bpm").cast("string")).alias("value"))
    both = lead.unionByName(rows).repartition("recording", "session").sortWithinPartitions("recording", "session", "at")
    both.select("recording", "session", "value").write.partitionBy("recording", "session").text(path)
    return path


def write_hr_reference(ref: DataFrame, path: str) -> str:
    ref.select("recording", F.col("t_s").alias("elapsed_seconds"), F.col("bpm").alias("hr_bpm")).repartitionByRange("recording", "elapsed_seconds").write.partitionBy("recording").option("header", True).csv(path)
    return path


def many_files(df: DataFrame, by: str) -> DataFrame:
    """Rows dealt out for a write with a folder for each value: a number of tasks is asked for, as short rows
    would be merged into one, and it is files that take the time."""
    return df.repartitionByRange(4 * df.sparkSession.sparkContext.defaultParallelism, by)


# ---------------------------------------------------------------- reports (written and read by ``published``)
def scan_best_params(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``multi_<name><n>-<mode>-<filter>-best_params.json``; other names are dropped."""
    pattern = r"(multi_[a-z]+\d+)-(\w+)-(\w+)-best_params\.json"
    raw = spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), pattern, 0)
    part = lambda i: F.regexp_extract("_name", pattern, i)
    out = raw.withColumn("_name", name).filter(F.col("_name") != "")
    return out.select(part(1).alias("stem"), part(2).alias("ppg_mode"), part(3).alias("adaptive_filter"), *raw.columns)


# ---------------------------------------------------------------- result tables
def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    w = df.write.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def hr_table_dual(df: DataFrame, case_name: str) -> DataFrame:
    """Twelve columns, Hz -> BPM, with the case."""
    bpm = lambda c, n: (F.col(c) * 60).alias(n)
    return df.select(
        F.lit(case_name).alias("case"), "recording", F.col("t_s").alias("t_center_s"), (F.col("t_s") + F.col("time_bias")).alias("t_pred_s"),
        bpm("ref", "ref_hr_center_bpm"), bpm("ref_aligned", "ref_hr_aligned_bpm"), bpm("lms_hf", "lms_hf_bpm"), bpm("lms_acc", "lms_acc_bpm"),
        bpm("fft", "pure_fft_bpm"), bpm("fusion_hf", "fusion_hf_bpm"), bpm("fusion_acc", "fusion_acc_bpm"),
        F.col("motion").cast("int").alias("motion_acc"), F.col("motion").cast("int").alias("motion_hf"),
    )


def hr_table_single(df: DataFrame, time_bias: float) -> DataFrame:
    """Six columns with the time shifted by the bias."""
    return df.select("recording", (F.col("t_s") + time_bias).alias("time_s"), "ref_bpm", "fft_bpm", "final_bpm", F.col("is_motion").cast("int"), F.col("used_adaptive").cast("int"))


def hr_matrix(df: DataFrame) -> DataFrame:
    """The matrix in Hz as the solver holds it."""
    return df.select("recording", "t_s", "ref", "lms_hf", "lms_acc", "fft", "fusion_hf", "fusion_acc", F.col("motion").cast("double").alias("motion_acc"), F.col("motion").cast("double").alias("motion_hf"))


def error_table(detailed: DataFrame, case_name: str) -> DataFrame:
    """S14"""
    return detailed.withColumn("case", F.lit(case_name))


def param_comparison(df: DataFrame, key: list[str], case: str, fields: list[str]) -> DataFrame:
    """Long ``metric, hf_best_case, acc_best_case``."""
    long = df.unpivot([*key, case], fields, "metric", "value")
    return long.groupBy(*key, "metric").agg(
        F.first(F.when(F.col(case) == "HF_best", F.col("value")), True).alias("hf_best_case"),
        F.first(F.when(F.col(case) == "ACC_best", F.col("value")), True).alias("acc_best_case"),
    )
