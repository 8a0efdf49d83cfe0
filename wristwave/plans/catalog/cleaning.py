"""C1-C10 over the sensor view."""

from pyspark.sql import functions as F

from wristwave.operators import clean
from wristwave.operators.chunked import exact_percentiles
from wristwave.plans.registry import query, r, rq
from wristwave.sources import tables as t


def gappy():
    return F.when(F.col("rf") != "R", F.col("ppg"))


_IDS = ["recording", "sample_idx"]

_NEAR_CTE = """n AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN sample_idx END IGNORE NULLS) OVER p AS pi,
  last_value(x IGNORE NULLS) OVER p AS pv,
  first_value(CASE WHEN x IS NOT NULL THEN sample_idx END IGNORE NULLS) OVER f AS ni,
  first_value(x IGNORE NULLS) OVER f AS nv FROM g
  WINDOW p AS (PARTITION BY recording ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         f AS (PARTITION BY recording ORDER BY sample_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
_NEAR = "g AS (SELECT *, CASE WHEN rf <> 'R' THEN ppg END AS x FROM sensor),\n" + _NEAR_CTE
_NEAREST = "CASE WHEN x IS NOT NULL THEN x WHEN pi IS NULL OR (ni IS NOT NULL AND ni - sample_idx <= sample_idx - pi) THEN nv ELSE pv END"
_LINEAR = "CASE WHEN x IS NOT NULL THEN x ELSE pv + (nv - pv) * ((sample_idx - pi)::DOUBLE / (ni - pi)) END"


@query("c1_fill_nearest", f"WITH {_NEAR} SELECT recording, sample_idx, {_NEAREST} AS value FROM n", ("sensor",))
def c1(spark, sf):
    out = clean.fill_nearest(t.sensor(spark, sf), {"value": gappy()})
    return out.select(*_IDS, "value")


@query("c2_fill_linear", f"WITH {_NEAR} SELECT recording, sample_idx, {_LINEAR} AS value FROM n", ("sensor",))
def c2(spark, sf):
    out = clean.fill_linear(t.sensor(spark, sf), {"value": gappy()})
    return out.select(*_IDS, "value")


def _outlier_sql(col, window):
    b, a = window // 2, (window - 1) // 2
    return f"""WITH m AS (SELECT *, quantile_cont({col}, 0.5) OVER w AS med FROM sensor
  WINDOW w AS (PARTITION BY recording ORDER BY sample_idx ROWS BETWEEN {b} PRECEDING AND {a} FOLLOWING)),
d AS (SELECT *, abs({col} - med) AS dev FROM m),
s AS (SELECT *, quantile_cont(dev, 0.5) OVER w * 1.4826::DOUBLE AS mad FROM d
  WINDOW w AS (PARTITION BY recording ORDER BY sample_idx ROWS BETWEEN {b} PRECEDING AND {a} FOLLOWING)),
g AS (SELECT recording, sample_idx, CASE WHEN mad > 0 AND dev > mad * 3.0::DOUBLE THEN NULL ELSE {col} END AS x FROM s),
""" + _NEAR_CTE + f"""
SELECT recording, sample_idx, {rq(f'coalesce({_LINEAR}, {_NEAREST})')} AS value, (x IS NULL)::INT AS replaced FROM n"""


@query("c3_moving_median_outliers", _outlier_sql("(accx * accx * accx)", 9), ("sensor",))
def c3(spark, sf):
    src = t.sensor(spark, sf).withColumn("value", F.col("accx") * F.col("accx") * F.col("accx"))
    out = clean.moving_median_outliers(src, ["value"], 9)
    return out.select(*_IDS, r("value").alias("value"), F.col("value_replaced").cast("int").alias("replaced"))


@query(
    "c4_mean_outliers_previous",
    f"""WITH e AS (SELECT *, exp(accx / 5) AS x FROM sensor),
s AS (SELECT *, avg(x) OVER (PARTITION BY recording) AS mu, stddev_samp(x) OVER (PARTITION BY recording) AS sd FROM e),
g AS (SELECT *, CASE WHEN sd > 0 AND abs(x - mu) > 2.0::DOUBLE * sd THEN NULL ELSE x END AS ok FROM s)
SELECT recording, sample_idx, {rq("""coalesce(ok, last_value(ok IGNORE NULLS) OVER (PARTITION BY recording ORDER BY sample_idx
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x)""", 3)} AS value FROM g""",
    ("sensor",),
)
def c4(spark, sf):
    src = t.sensor(spark, sf).withColumn("value", F.exp(F.col("accx") / 5))
    out = clean.mean_outliers_previous(src, ["value"], threshold=2.0)
    return out.select(*_IDS, r("value", 3).alias("value"))


_C5 = """WITH g AS (SELECT *, CASE WHEN rf <> 'R' THEN ppg - 20000 END AS x FROM sensor),
""" + _NEAR_CTE + f""",
g2 AS (SELECT recording, sample_idx, CASE WHEN {_NEAREST} >= 0 THEN {_NEAREST} END AS x FROM n),
""" + _NEAR_CTE.replace("n AS (", "n2 AS (", 1).replace("FROM g\n", "FROM g2\n") + f""",
f AS (SELECT recording, sample_idx, coalesce({_LINEAR}, {_NEAREST}) AS y FROM n2),
m AS (SELECT *, quantile_cont(y, 0.5) OVER w AS med FROM f
  WINDOW w AS (PARTITION BY recording ORDER BY sample_idx ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
d AS (SELECT *, abs(y - med) AS dev FROM m),
s AS (SELECT *, quantile_cont(dev, 0.5) OVER w * 1.4826::DOUBLE AS mad FROM d
  WINDOW w AS (PARTITION BY recording ORDER BY sample_idx ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
g3 AS (SELECT recording, sample_idx, CASE WHEN mad > 0 AND dev > mad * 3.0::DOUBLE THEN NULL ELSE y END AS x FROM s),
""" + _NEAR_CTE.replace("n AS (", "n3 AS (", 1).replace("FROM g\n", "FROM g3\n") + f"""
SELECT recording, sample_idx, {rq(f"coalesce({_LINEAR}, {_NEAREST})")} AS ppg FROM n3"""


@query("c5_clean_signal", _C5, ("sensor",))
def c5(spark, sf):
    src = t.sensor(spark, sf).withColumn("ppg", F.when(F.col("rf") != "R", F.col("ppg") - 20000))
    return clean.clean_signal(src, ["ppg"], fs=25).select(*_IDS, r("ppg").alias("ppg"))


def _text():
    return F.when(F.col("rf") == "N", F.lit("n/a")).when(F.col("accz") == 0, F.lit("Infinity")).otherwise(F.col("accx").cast("string"))


_TEXT_SQL = "g AS (SELECT *, CASE WHEN rf = 'N' OR accz = 0 THEN NULL ELSE accx END AS x FROM sensor)"


@query(
    "c6_clean_numeric",
    f"WITH {_TEXT_SQL},\n{_NEAR_CTE} SELECT recording, sample_idx, coalesce({_LINEAR}, {_NEAREST}, 0.0) AS value FROM n",
    ("sensor",),
)
def c6(spark, sf):
    return clean.clean_numeric(t.sensor(spark, sf), {"value": _text()}).select(*_IDS, "value")


@query(
    "c7_clean_numeric_edge_hold",
    f"""WITH g AS (SELECT *, CASE WHEN ppg > 30000 AND recording > 0 THEN ppg END AS x FROM sensor),
{_NEAR_CTE} SELECT recording, sample_idx, coalesce({_LINEAR}, nv, pv, 0.0) AS value FROM n""",
    ("sensor",),
)
def c7(spark, sf):
    x = F.when((F.col("ppg") > 30000) & (F.col("recording") > 0), F.col("ppg"))
    return clean.clean_numeric(t.sensor(spark, sf), {"value": x}).select(*_IDS, "value")


@query(
    "c8_repair_unreliable",
    f"""WITH g AS (SELECT *, CASE WHEN reliable = 1 AND motion = 0 THEN fft_bpm END AS x, window_idx AS sample_idx FROM hr),
{_NEAR_CTE} SELECT recording, window_idx,
CASE WHEN reliable = 1 AND motion = 0 THEN fft_bpm ELSE coalesce(pv + (nv - pv) * (sample_idx - pi) / nullif(ni - pi, 0), pv, nv, fft_bpm) END AS fft_bpm,
(NOT (reliable = 1 AND motion = 0)) AS interpolated FROM n""",
    ("hr",),
)
def c8(spark, sf):
    rel = (F.col("reliable") == 1) & (F.col("motion") == 0)
    out = clean.repair_unreliable(t.hr_rows(spark, sf), ["fft_bpm"], "window_idx", rel)
    return out.select("recording", "window_idx", "fft_bpm", "interpolated")


@query(
    "c9_carry_forward",
    """WITH g AS (SELECT *, CASE WHEN rf <> 'R' THEN ppg END AS x FROM sensor)
SELECT recording, sample_idx, last_value(x IGNORE NULLS) OVER w AS spo2,
  (x IS NULL AND last_value(x IGNORE NULLS) OVER w IS NOT NULL) AS spo2_carried FROM g
WINDOW w AS (PARTITION BY recording ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    ("sensor",),
)
def c9(spark, sf):
    src = t.sensor(spark, sf).withColumn("spo2", gappy())
    return clean.carry_forward(src, ["spo2"]).select(*_IDS, "spo2", "spo2_carried")


@query(
    "c10_impute_median",
    """WITH g AS (SELECT *, CASE WHEN rf <> 'R' THEN ppg END AS x FROM sensor)
SELECT recording, sample_idx, coalesce(x, (SELECT quantile_cont(x, 0.5) FROM g), 0.0) AS ppg FROM g""",
    ("sensor",),
)
def c10(spark, sf):
    src = t.sensor(spark, sf).withColumn("ppg", gappy())
    return clean.impute_median(src, ["ppg"]).select(*_IDS, "ppg")


@query(
    "p5_cold_film_ratio",
    f"""WITH g AS (SELECT *, CASE WHEN abs((accx / 100 + accy) - accx / 100) >= 1e-9 THEN (accx / 100) / ((accx / 100 + accy) - accx / 100) END AS x FROM sensor),
{_NEAR_CTE} SELECT recording, sample_idx, {rq(f"coalesce({_LINEAR}, {_NEAREST}, 0.0)")} AS cf FROM n""",
    ("sensor",),
)
def p5(spark, sf):
    src = t.sensor(spark, sf).withColumns({"uc": F.col("accx") / 100, "ut": F.col("accx") / 100 + F.col("accy")})
    return clean.cold_film_ratios(src, {"cf": ("uc", "ut")}).select(*_IDS, r("cf").alias("cf"))
