"""W1-W33 and the scope predicates that depend on runs."""

from pyspark.sql import functions as F

from wristwave.functions import scalars as sc
from wristwave.operators import windows as w
from wristwave.operators.chunked import CHUNK, chunk_col, join_group, longest_run
from wristwave.plans.registry import query, r, rq
from wristwave.sources import tables as t

WIN, STEP, FS = 200, 25, t.FS


def mag():
    return F.sqrt(F.col("accx") * F.col("accx") + F.col("accy") * F.col("accy") + F.col("accz") * F.col("accz"))


MAG_SQL = "sqrt(accx*accx + accy*accy + accz*accz)"


def _win_sql(win, step, start=0, buffer=None, extra="", short=False):
    """wins(recording, k, s): starts of full windows, optionally clipped to length - buffer."""
    clip = f"AND (k = 0 OR k * {step} + {start} <= n - {buffer})" if buffer is not None else ""
    return f"""len AS (SELECT recording, count(*) AS n FROM sensor GROUP BY recording),
ks AS (SELECT recording, n, unnest(range(0, greatest(0, (n - {start} - {win}) // {step} + 1))) AS k FROM len WHERE n >= {start + win}),
wins AS (SELECT recording, k, k * {step} + {start} AS s FROM ks WHERE true {clip})"""


@query(
    "w1_sliding_windows",
    f"""WITH {_win_sql(WIN, STEP, 25, 250)} SELECT x.recording, k AS window_idx, min(s) / 25.0::DOUBLE AS start_s, min(s) / 25.0::DOUBLE + 4.0 AS center_s,
min(s) / 25.0::DOUBLE + 8.0 AS end_s, count(*)::INT AS n, arg_min(ppg, sample_idx) AS first_ppg, arg_max(ppg, sample_idx) AS last_ppg, {rq('sum(ppg)', 2)} AS sum_ppg
FROM wins x JOIN sensor y ON x.recording = y.recording AND y.sample_idx >= s AND y.sample_idx < s + {WIN} GROUP BY 1, 2""",
    ("sensor",),
)
def w1(spark, sf):
    s = t.sensor(spark, sf)
    wins = w.window_arrays(s, ["ppg"], WIN, STEP, start=25)
    wins = w.window_times(w.clip_to_buffer(wins, s, WIN, FS, 10.0), WIN, FS)
    total = F.aggregate("ppg", F.lit(0.0), lambda a, x: a + x)
    return wins.select(
        "recording", "window_idx", "start_s", "center_s", "end_s", F.size("ppg").alias("n"),
        F.get("ppg", F.lit(0)).alias("first_ppg"), F.element_at("ppg", -1).alias("last_ppg"), r(total, 2).alias("sum_ppg"),
    )


@query(
    "w2_spo2_windows",
    f"""WITH {_win_sql(100, 25)} SELECT x.recording, k AS window_idx, count(*)::INT AS n, arg_min(ppg, sample_idx) AS first_ppg, arg_max(ppg, sample_idx) AS last_ppg
FROM wins x JOIN sensor y ON x.recording = y.recording AND y.sample_idx >= s AND y.sample_idx < s + 100 GROUP BY 1, 2""",
    ("sensor",),
)
def w2(spark, sf):
    wins = w.window_arrays(t.sensor(spark, sf), ["ppg"], 100, 25)
    return wins.select("recording", "window_idx", F.size("ppg").alias("n"), F.get("ppg", F.lit(0)).alias("first_ppg"), F.element_at("ppg", -1).alias("last_ppg"))


@query(
    "w3_feature_windows",
    f"""WITH {_win_sql(WIN, STEP, 25)} SELECT x.recording, k AS window_idx, {rq('avg(accx)')} AS mean_x, {rq('stddev_pop(accx)')} AS std_x
FROM wins x JOIN sensor y ON x.recording = y.recording AND y.sample_idx >= s AND y.sample_idx < s + {WIN} JOIN len ON len.recording = x.recording WHERE s + {WIN} <= n - 250 GROUP BY 1, 2""",
    ("sensor",),
)
def w3(spark, sf):
    s = t.sensor(spark, sf)
    return feature_moments(s).select("recording", "window_idx", r("x_mean").alias("mean_x"), r(w.population_std("x")).alias("std_x"))


def feature_moments(s):
    """Head of 1 s and tail of 10 s dropped before windowing."""
    lengths = s.groupBy("recording").agg((F.max("sample_idx") + 1).alias("_n"))
    body = join_group(s, lengths, ["recording"], chunk_col("sample_idx", CHUNK)).filter(F.col("sample_idx") < F.col("_n") - 250)
    return w.window_moments(body, {"x": F.col("accx"), "mag": mag()}, WIN, STEP, 25)


@query(
    "w4_tumbling_windows",
    f"SELECT recording, sample_idx // 200 AS window_idx, count(*) AS n, {rq('stddev_samp(ppg)', 2)} AS std FROM sensor GROUP BY 1, 2 HAVING count(*) = 200",
    ("sensor",),
)
def w4(spark, sf):
    m = w.window_moments(t.sensor(spark, sf), {"ppg": F.col("ppg")}, 200, 200)
    return m.select("recording", "window_idx", F.col("ppg_n").cast("bigint").alias("n"), r(w.sample_std("ppg"), 2).alias("std"))


_FLAGS = lambda th: f"""{_win_sql(WIN, STEP)},
sd AS (SELECT x.recording, k AS window_idx, stddev_samp({MAG_SQL}) AS std FROM wins x JOIN sensor y ON x.recording = y.recording
  AND y.sample_idx >= s AND y.sample_idx < s + {WIN} GROUP BY 1, 2),
base AS (SELECT recording, stddev_samp({MAG_SQL}) AS b FROM sensor WHERE sample_idx < 100 GROUP BY 1),
flags AS (SELECT sd.recording, window_idx, std, {th} AS threshold, std > {th} AS motion FROM sd JOIN base USING (recording)
  JOIN (SELECT recording, max(std) AS mx FROM sd GROUP BY 1) USING (recording))"""
_FLAGS1 = _FLAGS("b")
RUNS_SQL = lambda src, flag, idx: f"""isl AS (SELECT recording, {idx} AS i, {idx} - row_number() OVER (PARTITION BY recording ORDER BY {idx}) AS g FROM {src} WHERE {flag}),
rn AS (SELECT recording, min(i) AS a, max(i) AS b, count(*) AS n FROM isl GROUP BY recording, g),
best AS (SELECT recording, a, b, n FROM rn QUALIFY row_number() OVER (PARTITION BY recording ORDER BY n DESC, a) = 1)"""


@query(
    "motion_segment",
    f"""WITH {_FLAGS1}, {RUNS_SQL('flags', 'motion', 'window_idx')}
SELECT recording, windows, motion_windows, a AS first_window, b AS last_window, a + 4.0::DOUBLE AS start_s, b + 4.0::DOUBLE AS end_s
FROM (SELECT recording, count(*) AS windows, count(*) FILTER (WHERE motion) AS motion_windows FROM flags GROUP BY 1) LEFT JOIN best USING (recording)""",
    ("sensor",),
)
def motion_segment(spark, sf):
    return w.motion_segment(t.sensor(spark, sf), mag(), WIN, STEP, calib=100, scale=1.0, fs=FS)


def flags_v1(spark, sf):
    return w.motion_flags(t.sensor(spark, sf), mag(), WIN, STEP, calib=100, scale=1.0)


@query("w5_motion_flag_baseline", f"WITH {_FLAGS1} SELECT recording, window_idx, {rq('std')} AS std, {rq('threshold')} AS threshold, motion FROM flags", ("sensor",))
def w5(spark, sf):
    return flags_v1(spark, sf).select("recording", "window_idx", r("std").alias("std"), r("threshold").alias("threshold"), "motion")


@query("w6_motion_flag_relative", f"WITH {_FLAGS('greatest(b * 0.9::DOUBLE, mx * 0.97::DOUBLE)')} SELECT recording, window_idx, motion FROM flags", ("sensor",))
def w6(spark, sf):
    f = w.motion_flags(t.sensor(spark, sf), mag(), WIN, STEP, calib=100, scale=0.9, relative_floor=0.97)
    return f.select("recording", "window_idx", "motion")


@query(
    "w7_motion_flag_six_axis",
    f"""WITH {_win_sql(WIN, STEP)}, base AS (SELECT recording, stddev_samp({MAG_SQL}) AS b1, stddev_samp(ppg) AS b2 FROM sensor WHERE sample_idx < 100 GROUP BY 1)
SELECT x.recording, k AS window_idx, {rq('greatest(stddev_samp(' + MAG_SQL + ') / min(b1), stddev_samp(ppg) / min(b2))')} AS ratio,
greatest(stddev_samp({MAG_SQL}) / min(b1), stddev_samp(ppg) / min(b2)) > 1.02::DOUBLE AS motion
FROM wins x JOIN sensor y ON x.recording = y.recording AND y.sample_idx >= s AND y.sample_idx < s + {WIN} JOIN base ON base.recording = x.recording GROUP BY 1, 2""",
    ("sensor",),
)
def w7(spark, sf):
    f = w.motion_flags_two(t.sensor(spark, sf), mag(), F.col("ppg"), WIN, STEP, calib=100, scale=1.02)
    return f.select("recording", "window_idx", r("ratio").alias("ratio"), "motion")


def _frame(b, a, name="w"):
    return f"WINDOW {name} AS (PARTITION BY recording ORDER BY window_idx ROWS BETWEEN {b} PRECEDING AND {a} FOLLOWING)"


@query(
    "w8_moving_median",
    """SELECT recording, window_idx, quantile_cont(fft_bpm, 0.5) OVER a AS med3, quantile_cont(fft_bpm, 0.5) OVER b AS med7 FROM hr
WINDOW a AS (PARTITION BY recording ORDER BY window_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), b AS (PARTITION BY recording ORDER BY window_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
    ("hr",),
)
def w8(spark, sf):
    out = w.moving_median(t.hr_rows(spark, sf), {"med3": "fft_bpm"}, 3)
    out = w.moving_median(out, {"med7": "fft_bpm"}, 7)
    return out.select("recording", "window_idx", "med3", "med7")


@query(
    "w10_longest_run",
    f"WITH {RUNS_SQL('sensor', chr(39) + 'R' + chr(39) + ' = rf', 'sample_idx')} SELECT recording, a AS run_start, b AS run_end, n AS run_len FROM best",
    ("sensor",),
)
def w10(spark, sf):
    # a small chunk so that runs over chunk edges occur in the check
    return longest_run(t.sensor(spark, sf), ["recording"], "sample_idx", F.col("rf") == "R", size=64)


_QUAL = f"""WITH {_win_sql(WIN, STEP)}, v AS (SELECT x.recording, k, s, y.sample_idx AS i, accz <> 0 AND accy <> 0.05::DOUBLE AS ok FROM wins x JOIN sensor y
  ON x.recording = y.recording AND y.sample_idx >= s AND y.sample_idx < s + {WIN}),
isl AS (SELECT recording, k, i - row_number() OVER (PARTITION BY recording, k ORDER BY i) AS g FROM v WHERE NOT ok),
gap AS (SELECT recording, k, max(n) AS max_gap FROM (SELECT recording, k, g, count(*) AS n FROM isl GROUP BY 1,2,3) GROUP BY 1,2),
q AS (SELECT recording, k AS window_idx, count(*) FILTER (WHERE NOT ok) AS missing_count FROM v GROUP BY 1,2)
SELECT q.recording, window_idx, missing_count::INT AS missing_count, coalesce(max_gap, 0)::INT AS max_gap, missing_count / 200.0::DOUBLE AS missing_ratio,
(missing_count / 200.0::DOUBLE <= 0.20::DOUBLE AND coalesce(max_gap, 0) <= 3) AS reliable FROM q LEFT JOIN gap ON q.recording = gap.recording AND q.window_idx = gap.k"""


def quality(spark, sf):
    ok = (F.col("accz") != 0) & (F.col("accy") != 0.05)
    return w.window_quality(t.sensor(spark, sf), ok, WIN, STEP, FS, max_gap_s=0.12)


@query("w11_max_missing_run", _QUAL[: _QUAL.index("SELECT q.recording")] + """SELECT q.recording, window_idx, coalesce(max_gap, 0)::INT AS max_gap
FROM q LEFT JOIN gap ON q.recording = gap.recording AND q.window_idx = gap.k""", ("sensor",))
def w11(spark, sf):
    return quality(spark, sf).select("recording", "window_idx", "max_gap")


@query("w12_window_quality", _QUAL, ("sensor",))
def w12(spark, sf):
    return quality(spark, sf)


@query(
    "w13_transition_flag",
    "SELECT recording, window_idx, (motion = 1 AND coalesce(lag(motion) OVER (PARTITION BY recording ORDER BY window_idx), 0) = 0) AS enters FROM hr",
    ("hr",),
)
def w13(spark, sf):
    return w.transition(t.hr_rows(spark, sf), F.col("motion") == 1).select("recording", "window_idx", "enters")


_HR_RUN = RUNS_SQL("hr", "motion = 1", "window_idx")


@query(
    "w14_segment_labels",
    f"""WITH {_HR_RUN} SELECT hr.recording, window_idx, CASE WHEN a IS NULL THEN 'pre_rest' WHEN window_idx BETWEEN a AND b THEN 'motion'
WHEN motion = 1 THEN 'other_motion' WHEN window_idx < a THEN 'pre_rest' ELSE 'post_rest' END AS segment FROM hr LEFT JOIN best USING (recording)""",
    ("hr",),
)
def w14(spark, sf):
    return w.segment_labels(t.hr_rows(spark, sf), F.col("motion") == 1).select("recording", "window_idx", "segment")


@query(
    "w15_motion_onset",
    """WITH f AS (SELECT recording, window_idx, sum(motion) OVER a AS x, sum(motion) OVER b AS y, count(*) OVER c AS n FROM hr
WINDOW a AS (PARTITION BY recording ORDER BY window_idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), b AS (PARTITION BY recording ORDER BY window_idx ROWS BETWEEN 5 FOLLOWING AND 9 FOLLOWING),
c AS (PARTITION BY recording ORDER BY window_idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
o AS (SELECT recording, min(window_idx + 5) FILTER (WHERE x = 0 AND y = 5 AND n = 10) AS onset_idx FROM f GROUP BY 1)
SELECT recording, onset_idx, coalesce(onset_idx * 8.0::DOUBLE, 30) AS onset_s, coalesce(onset_idx * 8.0::DOUBLE, 30) + 10 AS segment_start_s,
coalesce(onset_idx * 8.0::DOUBLE, 30) + 25 AS segment_end_s FROM o""",
    ("hr",),
)
def w15(spark, sf):
    return w.onset(t.hr_rows(spark, sf), F.col("motion") == 1)


@query(
    "w16_adaptive_range",
    f"WITH {_HR_RUN} SELECT hr.recording, window_idx, coalesce(window_idx >= a, false) AS in_range FROM hr LEFT JOIN best USING (recording)",
    ("hr",),
)
def w16(spark, sf):
    h = t.hr_rows(spark, sf)
    run = longest_run(h, ["recording"], "window_idx", F.col("motion") == 1).select("recording", "run_start")
    out = join_group(h, run, ["recording"], chunk_col("window_idx", CHUNK))
    return out.select("recording", "window_idx", F.coalesce(F.col("window_idx") >= F.col("run_start"), F.lit(False)).alias("in_range"))


def _segment(h):
    run = longest_run(h, ["recording"], "window_idx", F.col("motion") == 1)
    return run.select("recording", F.col("run_start").cast("double").alias("start_s"), F.col("run_end").cast("double").alias("end_s"), F.col("run_end").alias("end_idx"))


_REC = f"""{_HR_RUN}, rec AS (SELECT hr.recording, avg(lms_hf_bpm) FILTER (WHERE window_idx > b - 5 AND window_idx <= b) - avg(fft_bpm) FILTER (WHERE window_idx > b - 5 AND window_idx <= b) AS overshoot,
coalesce(min(window_idx) FILTER (WHERE window_idx > b AND fft_bpm >= lms_hf_bpm), max(window_idx)) AS crossover_idx FROM hr JOIN best USING (recording) GROUP BY 1)"""


@query("w17_recovery_trigger", f"WITH {_REC} SELECT recording, {rq('overshoot')} AS overshoot, overshoot > 5 AS recovers FROM rec", ("hr",))
def w17(spark, sf):
    h = t.hr_rows(spark, sf)
    out = w.recovery(h, "lms_hf_bpm", "fft_bpm", _segment(h).select("recording", "end_idx"), trigger_bpm=5.0)
    return out.select("recording", r("overshoot").alias("overshoot"), "recovers")


@query("w18_crossover_index", f"WITH {_REC} SELECT recording, crossover_idx FROM rec", ("hr",))
def w18(spark, sf):
    h = t.hr_rows(spark, sf)
    return w.recovery(h, "lms_hf_bpm", "fft_bpm", _segment(h).select("recording", "end_idx")).select("recording", "crossover_idx")


@query(
    "w19_fusion_single_path",
    f"""WITH {_REC}, mx AS (SELECT recording, max(window_idx) AS m FROM hr GROUP BY 1),
u AS (SELECT hr.recording, window_idx, fft_bpm, lms_hf_bpm, a, coalesce(window_idx >= a AND window_idx <= CASE WHEN overshoot > 5 THEN crossover_idx ELSE least(b + 10, m) END, false) AS used
  FROM hr LEFT JOIN best USING (recording) LEFT JOIN rec USING (recording) JOIN mx USING (recording)),
x AS (SELECT *, CASE WHEN used THEN lms_hf_bpm ELSE fft_bpm END AS mix FROM u)
SELECT recording, window_idx, used AS used_adaptive, CASE WHEN a IS NULL THEN fft_bpm ELSE quantile_cont(mix, 0.5) OVER w END AS final FROM x {_frame(1, 1)}""",
    ("hr",),
)
def w19(spark, sf):
    h = t.hr_rows(spark, sf).withColumn("t", F.col("window_idx").cast("double"))
    out = w.fuse_v2(h, "lms_hf_bpm", "fft_bpm", _segment(h), "t", post_s=10.0, trigger_bpm=5.0)
    return out.select("recording", "window_idx", "used_adaptive", "final")


@query(
    "w20_fusion_dual_path",
    f"""WITH x AS (SELECT *, CASE WHEN motion = 1 THEN lms_hf_bpm ELSE fft_bpm END AS mh, CASE WHEN motion = 1 THEN lms_acc_bpm ELSE fft_bpm END AS ma FROM hr)
SELECT recording, window_idx, quantile_cont(mh, 0.5) OVER w AS fusion_hf, quantile_cont(ma, 0.5) OVER w AS fusion_acc FROM x {_frame(1, 1)}""",
    ("hr",),
)
def w20(spark, sf):
    out = w.fuse_v1(t.hr_rows(spark, sf), "lms_hf_bpm", "fft_bpm", "motion", "fusion_hf")
    return w.fuse_v1(out, "lms_acc_bpm", "fft_bpm", "motion", "fusion_acc").select("recording", "window_idx", "fusion_hf", "fusion_acc")


@query(
    "w21_finite_moving_average",
    f"SELECT recording, window_idx, {rq('avg(CASE WHEN motion = 0 THEN fft_bpm END) OVER w')} AS smooth FROM hr {_frame(3, 3)}",
    ("hr",),
)
def w21(spark, sf):
    h = t.hr_rows(spark, sf).withColumn("x", F.when(F.col("motion") == 0, F.col("fft_bpm")))
    return w.moving_mean(h, {"smooth": "x"}, 7).select("recording", "window_idx", r("smooth").alias("smooth"))


@query("w22_moving_average_same", f"SELECT recording, window_idx AS sample_idx, {rq('sum(fft_bpm) OVER w / 6')} AS smooth FROM hr {_frame(3, 2)}", ("hr",))
def w22(spark, sf):
    h = t.hr_rows(spark, sf).withColumnRenamed("window_idx", "sample_idx")
    return w.moving_average_same(h, {"smooth": "fft_bpm"}, 6).select("recording", "sample_idx", r("smooth").alias("smooth"))


@query("w23_rolling_mean_three", f"SELECT recording, window_idx, {rq('avg(fft_bpm) OVER w')} AS smooth FROM hr {_frame(1, 1)}", ("hr",))
def w23(spark, sf):
    return w.moving_mean(t.hr_rows(spark, sf), {"smooth": "fft_bpm"}, 3).select("recording", "window_idx", r("smooth").alias("smooth"))


@query(
    "w24_overlap_add",
    f"""WITH {_win_sql(100, 25)}, c AS (SELECT x.recording, k, y.sample_idx, ppg - avg(ppg) OVER (PARTITION BY x.recording, k) AS v FROM wins x JOIN sensor y
ON x.recording = y.recording AND y.sample_idx >= s AND y.sample_idx < s + 100), m AS (SELECT recording, sample_idx, avg(v) AS v FROM c GROUP BY 1, 2)
SELECT sensor.recording, sensor.sample_idx, {rq('coalesce(m.v, ppg)', 3)} AS clean FROM sensor LEFT JOIN m ON sensor.recording = m.recording AND sensor.sample_idx = m.sample_idx""",
    ("sensor",),
)
def w24(spark, sf):
    s = t.sensor(spark, sf).select("recording", "sample_idx", "ppg")
    wins = w.window_arrays(s, ["ppg"], 100, 25)
    mean = F.aggregate("ppg", F.lit(0.0), lambda a, x: a + x, lambda a: a / 100)
    wins = wins.withColumn("_m", mean).withColumn("ppg", F.transform("ppg", lambda x: x - F.col("_m")))
    return w.overlap_add(wins, s, "ppg", "clean").select("recording", "sample_idx", r("clean", 3).alias("clean"))


def _spo2():
    return {
        "motion_score": F.col("accy"), "raw_spo2": F.col("accx") + 50, "adaptive_spo2": F.col("accx") + 49, "raw_r_median": F.col("accz"),
        "adaptive_r_median": F.col("accz") + 1, "raw_valid_beat_count": (F.col("accx") % 3).cast("int"), "adaptive_valid_beat_count": (F.col("accx") % 5).cast("int"),
        "raw_carried_forward": F.col("rf") == "R", "adaptive_carried_forward": F.col("rf") == "A", "missing_ratio": F.col("accz") * 4,
        "reliable": F.col("ls") == "F",
    }


@query(
    "w25_rest_policy",
    """SELECT recording, sample_idx, accy > 0.02::DOUBLE AS adaptive_applied, CASE WHEN accy > 0.02::DOUBLE THEN accx + 49 ELSE accx + 50 END AS spo2,
CASE WHEN accy > 0.02::DOUBLE THEN accz + 1 ELSE accz END AS adaptive_r_median, CASE WHEN accy > 0.02::DOUBLE THEN (accx % 5)::INT ELSE (accx % 3)::INT END AS adaptive_valid_beat_count,
CASE WHEN accy > 0.02::DOUBLE THEN rf = 'A' ELSE rf = 'R' END AS adaptive_carried_forward,
CASE WHEN accy > 0.02::DOUBLE THEN ls = 'F' ELSE accz * 4 <= 0.20::DOUBLE AND (accx % 3)::INT > 0 END AS reliable FROM sensor""",
    ("sensor",),
)
def w25(spark, sf):
    out = w.rest_policy(t.sensor(spark, sf).withColumns(_spo2()))
    return out.select("recording", "sample_idx", "adaptive_applied", "spo2", "adaptive_r_median", "adaptive_valid_beat_count", "adaptive_carried_forward", "reliable")


@query(
    "w28_running_best",
    "SELECT study, trial, min(value) OVER (PARTITION BY study, strategy ORDER BY trial) AS best_in_repeat, min(value) OVER (PARTITION BY study ORDER BY trial) AS best_overall FROM trials",
    ("trials",),
)
def w28(spark, sf):
    out = w.running_best(t.trials(spark, sf), "value", "trial", ["study"], ["study", "strategy"])
    return out.select("study", "trial", "best_in_repeat", "best_overall")


_EVEN = """e AS (SELECT recording, window_idx, row_number() OVER (PARTITION BY recording ORDER BY window_idx) - 1 AS pos, count(*) OVER (PARTITION BY recording) AS n FROM hr WHERE motion = 1),
pk AS (SELECT DISTINCT recording, n, round_even(k * ((n - 1) / (4 - 1)::DOUBLE), 0)::BIGINT AS pos FROM (SELECT DISTINCT recording, n FROM e), range(0, 4) AS g(k))"""
_EVEN_ROWS = "SELECT e.recording, window_idx FROM e WHERE n <= 4 OR EXISTS (SELECT 1 FROM pk WHERE pk.recording = e.recording AND pk.pos = e.pos)"


@query("w29_evenly_spaced_rows", f"WITH {_EVEN} {_EVEN_ROWS}", ("hr",))
def w29(spark, sf):
    m = t.hr_rows(spark, sf).filter("motion = 1").select("recording", "window_idx")
    return w.evenly_spaced(m, 4)


@query(
    "w30_exemplar_windows",
    f"""WITH {_EVEN}, ev AS ({_EVEN_ROWS}), bd AS (SELECT recording, min(window_idx) FILTER (WHERE motion = 1) AS a, max(window_idx) FILTER (WHERE motion = 1) AS b,
arg_min(window_idx, (fft_bpm, window_idx)) AS calm FROM hr GROUP BY 1)
SELECT recording, max(window_idx) AS window_idx, 'pre_rest' AS part FROM hr JOIN bd USING (recording) WHERE motion = 0 AND window_idx < a GROUP BY 1 UNION ALL
SELECT recording, min(window_idx), 'post_rest' FROM hr JOIN bd USING (recording) WHERE motion = 0 AND window_idx > b GROUP BY 1 UNION ALL
SELECT recording, calm, 'pre_rest' FROM bd WHERE a IS NULL UNION ALL SELECT recording, window_idx, 'motion' FROM ev""",
    ("hr",),
)
def w30(spark, sf):
    return w.exemplar_windows(t.hr_rows(spark, sf), F.col("motion") == 1, "fft_bpm", 4)


_SD = lambda fn, win, step, start, th: f"""WITH {_win_sql(win, step, start)} SELECT x.recording, k AS window_idx, {rq(fn + '(' + MAG_SQL + ')')} AS score,
{fn}({MAG_SQL}) > {th}::DOUBLE AS motion FROM wins x JOIN sensor y ON x.recording = y.recording AND y.sample_idx >= s AND y.sample_idx < s + {win} GROUP BY 1, 2"""


@query("w32_spo2_motion_score", _SD("stddev_samp", 100, 25, 0, 14.5), ("sensor",))
def w32(spark, sf):
    m = w.window_moments(t.sensor(spark, sf), {"mag": mag()}, 100, 25)
    return m.select("recording", "window_idx", r(w.sample_std("mag")).alias("score"), (w.sample_std("mag") > 14.5).alias("motion"))


@query("w33_feature_motion_flag", _SD("stddev_pop", 50, 25, 25, 14.5), ("sensor",))
def w33(spark, sf):
    m = w.window_moments(t.sensor(spark, sf), {"mag": mag()}, 50, 25, 25)
    return m.select("recording", "window_idx", r(w.population_std("mag")).alias("score"), (w.population_std("mag") > 14.5).alias("motion"))


_SCOPE = f"""{_HR_RUN}, sc AS (SELECT hr.*, a, b FROM hr LEFT JOIN best USING (recording) WHERE a IS NULL OR (window_idx >= a - 30 AND window_idx <= b))"""


@query("p12_analysis_scope_dual", f"WITH {_SCOPE} SELECT recording, window_idx, CASE WHEN a IS NULL OR window_idx >= a THEN motion ELSE 0 END AS motion FROM sc", ("hr",))
def p12(spark, sf):
    h = t.hr_rows(spark, sf).withColumn("t", F.col("window_idx").cast("double"))
    return w.analysis_scope(h, "motion", "t").select("recording", "window_idx", "motion")


@query("p13_analysis_scope_single", f"WITH {_SCOPE} SELECT recording, window_idx, motion FROM sc", ("hr",))
def p13(spark, sf):
    h = t.hr_rows(spark, sf).withColumn("t", F.col("window_idx").cast("double"))
    return w.analysis_scope(h, "motion", "t", clear_flags=False).select("recording", "window_idx", "motion")
