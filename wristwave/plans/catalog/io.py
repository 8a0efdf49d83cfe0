"""Every reader and writer as a round trip through the shared folder."""

import math

from pyspark.sql import functions as F

from wristwave.functions.scalars import decode_option
from wristwave.operators import stats as st
from wristwave.plans.catalog.sequences import mag
from wristwave.plans.catalog.statistics import _A3
from wristwave.plans.jobs import Spo2Result
from wristwave.plans.registry import query, r, rq
from wristwave.session import shared_path
from wristwave.sources import recordings as rec
from wristwave.sources import reports
from wristwave.sources import sinks as sk
from wristwave.sources import tables as t
from wristwave.sources.published import publish, published


def _name():
    return F.concat(F.lit("r"), F.col("recording").cast("string")).alias("recording")


def _rec(spark, sf):
    s = rec.from_sensor(spark, sf)
    return s.select(_name(), *[c for c in s.columns if c != "recording"])


def _csv(spark, sf):
    return t._once(spark, sf, "csv", lambda: sk.write_sensor_csv(_rec(spark, sf), shared_path(spark, "csv")))


@query(
    "s1_sensor_scan",
    """SELECT 'r' || recording AS recording, sample_idx, t_s, accx / 50 + 5 AS ut1, ppg / 1000 + 900 AS ppg_green, accy * 10 - 0.5 AS accy, (rf <> 'N' OR ls = 'O') AS valid FROM sensor""",
    ("sensor",),
)
def s1(spark, sf):
    out = rec.scan_sensor(spark, _csv(spark, sf), ["ut1", "ppg_green", "accy"], fs=25)
    return out.select("recording", "sample_idx", "t_s", "ut1", "ppg_green", "accy", "valid")


def _polar(spark, sf):
    named = t.ref_hr(spark, sf).select(_name(), "t_s", "bpm")
    return t._once(spark, sf, "polar", lambda: sk.write_polar(named, shared_path(spark, "polar")))


@query("s3_polar_reference_scan", "SELECT 'r' || recording AS reference, t_s, bpm FROM ref_hr", ("ref_hr",))
def s3(spark, sf):
    return rec.scan_polar(spark, _polar(spark, sf)).select("reference", "t_s", "bpm")


@query("s4_hr_reference_scan", "SELECT 'r' || recording AS reference, t_s, bpm FROM ref_hr", ("ref_hr",))
def s4(spark, sf):
    named = t.ref_hr(spark, sf).select(_name(), "t_s", "bpm")
    return rec.scan_hr_reference(spark, sk.write_hr_reference(named, shared_path(spark, "hrref")))


_SUP_SQL = """f AS (SELECT 'rec' || s_suppkey AS stem FROM supplier UNION ALL SELECT 'rec' || s_suppkey || '_ref' FROM supplier WHERE s_nationkey % 2 = 0
UNION ALL SELECT 'rec' || s_suppkey || '_HR_ref' FROM supplier WHERE s_nationkey % 3 = 0)"""


@query(
    "s5_recording_discovery",
    f"""WITH {_SUP_SQL} SELECT s.stem, coalesce(a.stem, b.stem) AS reference FROM f s LEFT JOIN f a ON a.stem = s.stem || '_ref' LEFT JOIN f b ON b.stem = s.stem || '_HR_ref'
WHERE s.stem NOT LIKE '%\\_ref' ESCAPE '\\'""",
)
def s5(spark, sf):
    path = shared_path(spark, "files")
    base = F.concat(F.lit("rec"), F.col("s_suppkey").cast("string"))
    nation = F.col("s_nationkey")
    names = F.array_compact(F.array(base, F.when(nation % 2 == 0, F.concat(base, F.lit("_ref"))), F.when(nation % 3 == 0, F.concat(base, F.lit("_HR_ref")))))
    stems = t.table(spark, sf, "supplier").select(F.explode(names).alias("stem"))
    sk.many_files(stems.withColumn("x", F.lit("1")), "stem").write.partitionBy("stem").csv(path)
    return rec.discover(spark, path)


@query(
    "s6_quality_metadata",
    """SELECT 'r' || recording AS recording, 'timeline_csv' AS kind, count(*) FILTER (WHERE rf <> 'N' OR ls = 'O') AS valid_count, count(*) FILTER (WHERE rf = 'N' AND ls <> 'O') AS missing_count,
max(CASE WHEN rf = 'N' AND ls <> 'O' THEN 1.0 ELSE 0.0 END)::DOUBLE AS max_gap_samples FROM sensor GROUP BY 1""",
    ("sensor",),
)
def s6(spark, sf):
    return rec.quality_metadata(rec.scan_sensor(spark, _csv(spark, sf), ["ut1"], fs=25))


@query("s7_quality_preview", "SELECT recording, count(*) AS rows, count(*) >= 250 AS complete FROM sensor WHERE sample_idx < 250 GROUP BY 1", ("sensor",))
def s7(spark, sf):
    return rec.preview(t.sensor(spark, sf), 10, 25)


def _meta(spark, sf):
    return t.hr_rows(spark, sf).groupBy("recording").agg(F.lit("lms").alias("adaptive_filter"), F.lit(5.0).alias("time_bias"), F.count("*").alias("n_windows"))


@query(
    "s8_single_path_report",
    "SELECT recording, 'lms' AS adaptive_filter, 5.0::DOUBLE AS time_bias, count(*) AS n_windows, count(*) AS stored_windows, sum(motion)::BIGINT AS motion_windows FROM hr GROUP BY 1",
    ("hr",),
)
def s8(spark, sf):
    win = t.hr_rows(spark, sf).select("recording", "window_idx", "fft_bpm", "motion")
    path = shared_path(spark, "report")
    publish(path, sk.SCHEMA_VERSION, {"metadata": _meta(spark, sf), "window_table": win})
    got = published(spark, path, sk.SCHEMA_VERSION)
    per = got["window_table"].groupBy("recording").agg(F.count("*").alias("stored_windows"), F.sum("motion").alias("motion_windows"))
    return got["metadata"].join(per, "recording")


#: Grid of the report query; a trial's number tells its choices.
_SPACE = {"fs_target": [25.0, 50.0, 100.0], "time_bias": [4.0, 5.0, 6.0, 7.0]}


def _decoded_trials(spark, sf):
    n = F.col("trial")
    at = {"fs_target": n % 3, "time_bias": F.floor(n / 3) % 4}
    hf = F.col("status") == "F"
    return t.trials(spark, sf).select(
        F.col("study").alias("recording"), "trial", F.when(hf, F.col("value")).alias("hf"), F.when(~hf, F.col("value")).alias("acc"), *[decode_option(c, at[p]).alias(p) for p, c in _SPACE.items()])


_EFFECTS = ", ".join(
    f"{rq(f"max(share) FILTER (WHERE path = '{path}' AND parameter = '{p}')")} AS {path}_importance_{p}" for path in ("hf", "acc") for p in _SPACE)


@query(
    "s9_optimise_report",
    f"""WITH d AS (SELECT study AS recording, trial, value, CASE WHEN status = 'F' THEN 'hf' ELSE 'acc' END AS path, ([25, 50, 100]::DOUBLE[])[1 + trial % 3] AS fs_target, ([4, 5, 6, 7]::DOUBLE[])[1 + (trial // 3) % 4] AS time_bias FROM trials),
long AS (SELECT recording, path, value, 'fs_target' AS parameter, fs_target AS choice FROM d UNION ALL SELECT recording, path, value, 'time_bias', time_bias FROM d),
per AS (SELECT recording, path, parameter, choice, count(*) AS n, avg(value) AS m, var_pop(value) AS s FROM long GROUP BY ALL),
tot AS (SELECT recording, path, parameter, sum(n) AS t, sum(n * m) / sum(n) AS mean, sum(n * s) AS within FROM per GROUP BY ALL),
bet AS (SELECT recording, path, parameter, any_value(t) AS t, any_value(within) AS within, sum(n * (m - mean) * (m - mean)) AS between FROM per JOIN tot USING (recording, path, parameter) GROUP BY ALL),
eff AS (SELECT recording, path, parameter, CASE WHEN t > 1 AND between + within > 0 THEN between / (between + within) END AS share FROM bet),
wide AS (SELECT recording, {_EFFECTS} FROM eff GROUP BY 1),
best AS (SELECT recording, 'lms' AS adaptive_filter, count(*) AS n, min(value) FILTER (WHERE path = 'hf') AS min_err_hf, min(value) FILTER (WHERE path = 'acc') AS min_err_acc,
  {", ".join(f"first({c} ORDER BY value, trial) FILTER (WHERE path = '{path}') AS {path}_{c}" for path in ("hf", "acc") for c in ("trial", *_SPACE))} FROM d GROUP BY 1)
SELECT *, 12 AS grid_size FROM best JOIN wide USING (recording)""",
    ("trials",),
)
def s9(spark, sf):
    path = shared_path(spark, "optimise")
    publish(path, "v1", reports.optimise_tables(_decoded_trials(spark, sf), "recording", "hf", "acc", "trial", _SPACE, {"adaptive_filter": F.lit("lms")}))
    got = published(spark, path, "v1")
    sizes = got["search_space"].groupBy("parameter").count().select("count").collect()  # one row a parameter
    told = lambda p: [F.col(f"best_para_{p}.{c}").alias(f"{p}_{c}") for c in ("trial", *_SPACE)]
    share = lambda p, c: F.max(F.when((F.col("path") == p) & (F.col("parameter") == c), F.col("importance")))
    wide = got["importance"].groupBy("recording").agg(*[r(share(p, c)).alias(f"{p}_importance_{c}") for p in ("hf", "acc") for c in _SPACE])
    best = got["best"].select("recording", "adaptive_filter", "n", "min_err_hf", "min_err_acc", *told("hf"), *told("acc"))
    return best.join(wide, "recording").withColumn("grid_size", F.lit(math.prod(x["count"] for x in sizes)))


@query(
    "s10_spo2_report",
    f"""SELECT recording, count(*) AS windows, count(*) FILTER (WHERE accy * 40 > 0.05::DOUBLE AND accy * 40 < 3) AS beats, count(*) AS samples, max(t_s) AS last_s,
{rq('avg(ppg)')} AS red_raw, {rq('avg(ppg * 0.5::DOUBLE)')} AS red_clean, {rq('avg(sqrt(accx*accx + accy*accy + accz*accz))')} AS acc_mag FROM sensor GROUP BY 1""",
    ("sensor",),
)
def s10(spark, sf):
    s = t.sensor(spark, sf)
    beats = s.filter((F.col("accy") * 40 > 0.05) & (F.col("accy") * 40 < 3)).select("recording", F.col("sample_idx").alias("window_idx"), (F.col("accy") * 40).alias("r"))
    spo2 = s.select("recording", F.col("sample_idx").alias("window_idx"), (F.col("accx") + 50).alias("spo2"))
    wave = s.select("recording", "sample_idx", F.col("t_s").alias("time_s"), F.col("ppg").alias("red_raw"), F.col("accx").alias("ir_raw"), (F.col("ppg") * 0.5).alias("red_clean"), (F.col("accx") * 0.5).alias("ir_clean"), mag().alias("acc_mag"))
    path = shared_path(spark, "spo2")
    publish(path, sk.SPO2_SCHEMA_VERSION, reports.spo2_tables(Spo2Result(spo2, beats, wave), {"fs": F.lit(25), "max_order": F.lit(20)}))
    got = published(spark, path, sk.SPO2_SCHEMA_VERSION)
    a = got["metadata"].select("recording", F.col("n_windows").alias("windows"))
    b = got["beat_table"].groupBy("recording").agg(F.count("*").alias("beats"))
    c = got["waveforms"].groupBy("recording").agg(F.count("*").alias("samples"), F.max("time_s").alias("last_s"), *[r(F.avg(x)).alias(x) for x in ("red_raw", "red_clean", "acc_mag")])
    return a.join(b, "recording", "left").fillna(0, ["beats"]).join(c, "recording")


def _hz(spark, sf):
    h = t.hr_rows(spark, sf)
    z = lambda c: F.col(c) / 60
    return h.select(
        "recording", F.col("window_idx").cast("double").alias("t_s"), F.lit(5.0).alias("time_bias"), z("ref_bpm").alias("ref"), z("ref_bpm").alias("ref_aligned"), z("lms_hf_bpm").alias("lms_hf"),
        z("lms_acc_bpm").alias("lms_acc"), z("fft_bpm").alias("fft"), z("fusion_hf_bpm").alias("fusion_hf"), z("fusion_acc_bpm").alias("fusion_acc"), "motion",
    )


@query(
    "s11_hr_table_dual",
    """SELECT 'HF_best' AS "case", recording, window_idx::DOUBLE AS t_center_s, window_idx + 5.0::DOUBLE AS t_pred_s, ref_bpm / 60 * 60 AS ref_hr_center_bpm, ref_bpm / 60 * 60 AS ref_hr_aligned_bpm, lms_hf_bpm / 60 * 60 AS lms_hf_bpm,
lms_acc_bpm / 60 * 60 AS lms_acc_bpm, fft_bpm / 60 * 60 AS pure_fft_bpm, fusion_hf_bpm / 60 * 60 AS fusion_hf_bpm, fusion_acc_bpm / 60 * 60 AS fusion_acc_bpm, motion AS motion_acc, motion AS motion_hf FROM hr""",
    ("hr",),
)
def s11(spark, sf):
    df = sk.hr_table_dual(_hz(spark, sf), "HF_best")
    return sk.read_csv(spark, sk.write_csv(df, shared_path(spark, "hr1")), df.schema.simpleString()[7:-1].replace(":", " "))


@query(
    "s12_hr_table_single",
    "SELECT recording, window_idx + 5.0::DOUBLE AS time_s, ref_bpm, fft_bpm, fusion_hf_bpm AS final_bpm, motion AS is_motion, reliable AS used_adaptive FROM hr",
    ("hr",),
)
def s12(spark, sf):
    h = t.hr_rows(spark, sf).select("recording", F.col("window_idx").alias("t_s"), "ref_bpm", "fft_bpm", F.col("fusion_hf_bpm").alias("final_bpm"), F.col("motion").alias("is_motion"), F.col("reliable").alias("used_adaptive"))
    df = sk.hr_table_single(h, 5.0)
    return sk.read_csv(spark, sk.write_csv(df, shared_path(spark, "hr2")), df.schema.simpleString()[7:-1].replace(":", " "))


@query(
    "s13_hr_matrix",
    """SELECT recording, window_idx::DOUBLE AS t_s, ref_bpm / 60 AS ref, lms_hf_bpm / 60 AS lms_hf, lms_acc_bpm / 60 AS lms_acc, fft_bpm / 60 AS fft, fusion_hf_bpm / 60 AS fusion_hf, fusion_acc_bpm / 60 AS fusion_acc,
motion::DOUBLE AS motion_acc, motion::DOUBLE AS motion_hf FROM hr""",
    ("hr",),
)
def s13(spark, sf):
    df = sk.hr_matrix(_hz(spark, sf))
    return sk.read_csv(spark, sk.write_csv(df, shared_path(spark, "matrix")), df.schema.simpleString()[7:-1].replace(":", " "))


@query("s14_error_table", _A3.replace("SELECT recording, method,", "SELECT 'HF_best' AS \"case\", recording, method,").replace("GROUP BY 1, 2", "GROUP BY recording, method"), ("hr",))
def s14(spark, sf):
    df = sk.error_table(st.detailed_stats(t.hr_rows(spark, sf)), "HF_best")
    got = sk.read_csv(spark, sk.write_csv(df, shared_path(spark, "errors")), df.schema.simpleString()[7:-1].replace(":", " "))
    return got.select("case", "recording", "method", *[r(c).alias(c) for c in got.columns if c not in ("case", "recording", "method")])


@query(
    "s15_param_comparison",
    """WITH b AS (SELECT study, min(value) FILTER (WHERE status = 'F') AS h, min(value) FILTER (WHERE status <> 'F') AS a, max(trial) FILTER (WHERE status = 'F')::DOUBLE AS ht, max(trial) FILTER (WHERE status <> 'F')::DOUBLE AS alast FROM trials GROUP BY 1)
SELECT study, 'target_aae' AS metric, h AS hf_best_case, a AS acc_best_case FROM b UNION ALL SELECT study, 'last_trial', ht, alast FROM b""",
    ("trials",),
)
def s15(spark, sf):
    tr = t.trials(spark, sf).withColumn("case", F.when(F.col("status") == "F", "HF_best").otherwise("ACC_best"))
    b = tr.groupBy("study", "case").agg(F.min("value").alias("target_aae"), F.max("trial").cast("double").alias("last_trial"))
    df = sk.param_comparison(b, ["study"], "case", ["target_aae", "last_trial"])
    return sk.read_csv(spark, sk.write_csv(df, shared_path(spark, "params")), df.schema.simpleString()[7:-1].replace(":", " "))


@query(
    "s16_batch_summary",
    """WITH q AS (SELECT o_custkey AS sample, count(*) AS runs, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 'bad' ELSE 'good' END AS qc_status FROM orders GROUP BY 1)
SELECT o_custkey AS sample, o_orderstatus AS ppg_mode, 'klms' AS adaptive_filter, 'full' AS analysis_scope, 'HF-ACC' AS reference_order_key, any_value(q.qc_status) AS qc_status,
CASE WHEN count(*) > 1 THEN 'ok' ELSE 'too_short' END AS status, CASE WHEN count(*) > 1 THEN min(o_totalprice) END AS best_error, CASE WHEN count(*) > 1 THEN NULL ELSE 'no estimate: too_short' END AS error,
o_custkey || '-' || o_orderstatus || '-klms-full-HF-ACC' AS report, any_value(q.runs) AS qc_runs FROM orders JOIN q ON o_custkey = q.sample GROUP BY o_custkey, o_orderstatus""",
)
def s16(spark, sf):
    o = t.table(spark, sf, "orders")
    many = F.count("*") > 1
    est = o.groupBy(F.col("o_custkey").alias("recording"), F.col("o_orderstatus").alias("mode")).agg(
        F.when(many, "ok").otherwise("too_short").alias("status"), F.when(many, F.min("o_totalprice")).alias("best_error"))
    bad = F.count_if(F.col("o_orderstatus") == "P") > 0
    qc = o.groupBy(F.col("o_custkey").alias("recording")).agg(F.count("*").alias("runs"), F.when(bad, "bad").otherwise("good").alias("qc_status"))
    path = shared_path(spark, "summary")
    publish(path, "batch", reports.batch_tables(est, qc, F.lit("klms"), F.lit("full"), F.lit("HF-ACC")), {"summary": ["ppg_mode"]})
    got = published(spark, path, "batch")
    return got["summary"].join(got["qc"].select(F.col("recording").alias("sample"), F.col("runs").alias("qc_runs")), "sample")


def _study(spark, sf):
    """Trials of every study with the best of each, and the windows of every recording as curves."""

    def build():
        path = shared_path(spark, "study")
        curve = t.hr_rows(spark, sf).select("recording", "window_idx", "ref_bpm", "fft_bpm", F.col("fusion_hf_bpm").alias("final_bpm"), "motion")
        trials = t.trials(spark, sf).select("strategy", F.col("study").alias("recording"), "trial", "value", "status")
        publish(path, "study", reports.study_tables(trials, "recording", "value", "trial", ["strategy", "status"], F.col("value") < 100000, curve), {"trials": ["strategy"]})
        return path

    return published(spark, t._once(spark, sf, "study", build), "study")


@query("s17_trials_and_curves", "SELECT strategy, study, trial, value, value < 100000 AS passed FROM trials", ("trials",))
def s17(spark, sf):
    return _study(spark, sf)["trials"].select("strategy", F.col("recording").alias("study"), "trial", "value", "passed")


@query(
    "s17_per_file_metrics",
    """SELECT study, min(value) AS objective, first(trial ORDER BY value, trial) AS trial_idx, first(strategy ORDER BY value, trial) AS strategy, first(status ORDER BY value, trial) AS status, min(value) < 100000 AS passed FROM trials GROUP BY 1""",
    ("trials",),
)
def s17_metrics(spark, sf):
    return _study(spark, sf)["per_file_metrics"].withColumnRenamed("recording", "study")


@query("s17_curves", "SELECT recording, window_idx, ref_bpm, fft_bpm, fusion_hf_bpm AS final_bpm, motion FROM hr", ("hr",))
def s17_curves(spark, sf):
    return _study(spark, sf)["curves"]


@query(
    "s18_best_params_corpus",
    """SELECT 'multi_bobi' || s_suppkey AS stem, 'green' AS ppg_mode, 'lms' AS adaptive_filter, s_acctbal AS min_err_hf FROM supplier WHERE s_nationkey > 3""",
)
def s18(spark, sf):
    path = shared_path(spark, "corpus")
    p = t.table(spark, sf, "supplier").select(
        F.concat(F.when(F.col("s_nationkey") <= 3, "other").otherwise("multi_bobi"), F.col("s_suppkey").cast("string"), F.lit("-green-lms-best_params.json")).alias("report"), F.col("s_acctbal").alias("min_err_hf"))
    sk.many_files(p, "report").write.partitionBy("report").json(path)
    return sk.scan_best_params(spark, path, "min_err_hf double")


@query(
    "s19_feature_table",
    f"SELECT rf AS exercise, recording, sample_idx // 50 AS window_idx, count(*) AS n, {rq('avg(sqrt(accx*accx + accy*accy + accz*accz))')} AS acc_mag_mean FROM sensor GROUP BY 1, 2, 3",
    ("sensor",),
)
def s19(spark, sf):
    f = t.sensor(spark, sf).groupBy(F.col("rf").alias("exercise"), "recording", F.expr("sample_idx div 50").alias("window_idx")).agg(F.count("*").alias("n"), F.avg(mag()).alias("acc_mag_mean"))
    path = shared_path(spark, "features")
    f.write.partitionBy("exercise").parquet(path)
    return spark.read.schema("recording bigint, window_idx bigint, n bigint, acc_mag_mean double, exercise string").parquet(path).withColumn("acc_mag_mean", r("acc_mag_mean"))
