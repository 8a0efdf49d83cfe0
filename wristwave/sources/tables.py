"""Sensor-shaped views over the driver's star-schema tables.

Every view is a plain function of the whole table: no subsets, no caps. ``sensor`` is
numbered once per session and folder and stored in the shared folder, because all
sequence operators start from it (the tables carry no sample index of their own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wristwave.operators.chunked import number_rows

FS = 25  # samples per second of the sensor view

_LINE_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]

_stored: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def _once(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _stored:
        _stored[key] = build()
    return _stored[key]


def sensor(spark: SparkSession, sf: str) -> DataFrame:
    """recording, sample_idx, t_s, ppg, accx, accy, accz, rf, ls (one row per lineitem)."""

    def build() -> DataFrame:
        kept = ["l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
        numbered = number_rows(table(spark, sf, "lineitem").select(*_LINE_ORDER, "l_suppkey"), "l_suppkey", _LINE_ORDER, "sample_idx", "sensor", kept)
        return numbered.select(
            F.col("l_suppkey").alias("recording"),
            "sample_idx",
            F.col("l_extendedprice").alias("ppg"),
            F.col("l_quantity").alias("accx"),
            F.col("l_discount").alias("accy"),
            F.col("l_tax").alias("accz"),
            F.col("l_returnflag").alias("rf"),
            F.col("l_linestatus").alias("ls"),
        )

    return _once(spark, sf, "sensor", build).withColumn("t_s", F.col("sample_idx") / FS)


def hr_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A result table: one window per sample row, five estimates against a reference (BPM)."""
    return sensor(spark, sf).select(
        "recording",
        F.col("sample_idx").alias("window_idx"),
        (F.col("accx") + 60).alias("ref_bpm"),
        (F.col("ppg") / 1500 + 50).alias("fft_bpm"),
        (F.col("accx") + 60 + (F.col("accy") - 0.05) * 200).alias("lms_hf_bpm"),
        (F.col("accx") + 60 + (F.col("accz") - 0.04) * 300).alias("lms_acc_bpm"),
        F.when(F.col("rf") == "R", F.col("accx") + 60 + (F.col("accy") - 0.05) * 200)
        .otherwise(F.col("ppg") / 1500 + 50).alias("fusion_hf_bpm"),
        F.when(F.col("rf") == "R", F.col("accx") + 60 + (F.col("accz") - 0.04) * 300)
        .otherwise(F.col("ppg") / 1500 + 50).alias("fusion_acc_bpm"),
        (F.col("rf") == "R").cast("int").alias("motion"),
        (F.col("accy") < 0.085).cast("int").alias("reliable"),
    )


def ref_hr(spark: SparkSession, sf: str) -> DataFrame:
    """recording, t_s (seconds from 2024-01-01), bpm, channel; irregular series."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("recording"),
        (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))") / 1e6).alias("t_s"),
        F.col("value").alias("bpm"),
        F.col("event_type").alias("channel"),
        "event_id",
    )


def peaks(spark: SparkSession, sf: str) -> DataFrame:
    """recording, window_idx, freq, amp, rank order column; five spectral peaks per window."""
    return sensor(spark, sf).select(
        "recording",
        F.expr("sample_idx div 5").alias("window_idx"),
        F.expr("sample_idx % 5").alias("peak_idx"),
        (F.col("accx") / 15 + 0.7).alias("freq"),
        F.col("ppg").alias("amp"),
        "rf",
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("bigint").alias("label")
    )


def trials(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("study"),
        F.col("o_orderkey").alias("trial"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderpriority").alias("strategy"),
        F.col("o_orderstatus").alias("status"),
    )


# ----------------------------------------------------------------------------------
# The same views for the DuckDB oracle.
# ----------------------------------------------------------------------------------
SQL_VIEWS = {
    "sensor": """sensor AS (SELECT l_suppkey AS recording, row_number() OVER (PARTITION BY l_suppkey
  ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax,
           l_returnflag, l_linestatus, l_shipdate) - 1 AS sample_idx,
  l_extendedprice AS ppg, l_quantity AS accx, l_discount AS accy, l_tax AS accz,
  l_returnflag AS rf, l_linestatus AS ls,
  (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity,
           l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1) / 25.0::DOUBLE AS t_s
  FROM lineitem)""",
    "hr": """hr AS (SELECT recording, sample_idx AS window_idx, accx + 60 AS ref_bpm, ppg / 1500 + 50 AS fft_bpm,
  accx + 60 + (accy - 0.05::DOUBLE) * 200 AS lms_hf_bpm, accx + 60 + (accz - 0.04::DOUBLE) * 300 AS lms_acc_bpm,
  CASE WHEN rf = 'R' THEN accx + 60 + (accy - 0.05::DOUBLE) * 200 ELSE ppg / 1500 + 50 END AS fusion_hf_bpm,
  CASE WHEN rf = 'R' THEN accx + 60 + (accz - 0.04::DOUBLE) * 300 ELSE ppg / 1500 + 50 END AS fusion_acc_bpm,
  CASE WHEN rf = 'R' THEN 1 ELSE 0 END AS motion, CASE WHEN accy < 0.085::DOUBLE THEN 1 ELSE 0 END AS reliable
  FROM sensor)""",
    "ref_hr": """ref_hr AS (SELECT user_id AS recording,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6::DOUBLE AS t_s,
  value AS bpm, event_type AS channel, event_id FROM events)""",
    "peaks": """peaks AS (SELECT recording, sample_idx // 5 AS window_idx, sample_idx % 5 AS peak_idx,
  accx / 15 + 0.7::DOUBLE AS freq, ppg AS amp, rf FROM sensor)""",
    "vectors": "vectors AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x, label::BIGINT AS label FROM embeddings)",
    "trials": """trials AS (SELECT o_custkey AS study, o_orderkey AS trial, o_totalprice AS value,
  o_orderpriority AS strategy, o_orderstatus AS status FROM orders)""",
}
_NEEDS = {"hr": ("sensor",), "peaks": ("sensor",)}


def sql(body: str, *views: str) -> str:
    """Prefix ``body`` with the views it uses. ``body`` may start with its own CTE list."""
    names: list[str] = []
    for v in views:
        for n in (*_NEEDS.get(v, ()), v):
            if n not in names:
                names.append(n)
    ctes = ",\n".join(SQL_VIEWS[n] for n in names)
    text = body.strip()
    recursive = "RECURSIVE " if text.upper().startswith("WITH RECURSIVE") else ""
    if text.upper().startswith("WITH"):
        rest = text[len("WITH RECURSIVE"):] if recursive else text[len("WITH"):]
        return f"WITH {recursive}{ctes},\n{rest.strip()}" if ctes else text
    return f"WITH {ctes}\n{text}" if ctes else text
