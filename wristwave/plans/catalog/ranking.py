"""O1-O7, W9, W26, W27."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wristwave.operators import tracking as tr
from wristwave.plans.catalog.alignment import LAG_SQL, lag_table
from wristwave.plans.catalog.statistics import _LAB
from wristwave.plans.registry import query, r, rq
from wristwave.sources import tables as t

_ARR = "pk AS (SELECT recording, window_idx, list(freq ORDER BY amp DESC, peak_idx) AS f FROM peaks GROUP BY 1, 2)"
KEYS = ["recording", "window_idx"]


@query("o1_peaks_by_amplitude", f"WITH {_ARR} SELECT recording, window_idx, array_to_string(list_transform(f, lambda v: (v * 1000)::BIGINT), ',') AS freqs FROM pk", ("peaks",))
def o1(spark, sf):
    s = tr.sorted_peaks(t.peaks(spark, sf), KEYS)
    return s.select(*KEYS, F.array_join(F.transform("freqs", lambda f: F.bround(f * 1000).cast("bigint")), ",").alias("freqs"))


@query("o2_near_previous_top_five", f"WITH {_ARR} SELECT recording, window_idx, coalesce(list_filter(f[1:5], lambda v: v - 2.0 < 0.25 AND v - 2.0 > -0.25)[1], 2.0)::DOUBLE AS hr FROM pk", ("peaks",))
def o2(spark, sf):
    s = tr.sorted_peaks(t.peaks(spark, sf), KEYS)
    return s.select(*KEYS, F.coalesce(tr.near_previous(F.col("freqs"), F.lit(2.0), 0.25), F.lit(2.0)).alias("hr"))


_MODE_SQL = """md AS (SELECT *, f[1] AS raw, 1.5::DOUBLE AS p, list_filter(f, lambda v: v - 1.5 < 0.4 AND v - 1.5 > -0.4)[1] AS near FROM pk),
tg AS (SELECT recording, window_idx, raw, p, 'raw_peak' AS mode, raw AS v FROM md UNION ALL SELECT recording, window_idx, raw, p, 'fallback_slew_to_raw_peak', coalesce(near, raw) FROM md UNION ALL
SELECT recording, window_idx, raw, p, 'all_peaks_near_prev', coalesce(near, p) FROM md UNION ALL SELECT recording, window_idx, raw, p, 'all_peaks_with_raw_fallback', coalesce(near, raw) FROM md UNION ALL
SELECT recording, window_idx, raw, p, 'current', coalesce(near, p) FROM md)"""


@query(
    "o3_tracking_modes",
    f"WITH {_ARR}, {_MODE_SQL} SELECT recording, window_idx, mode, CASE WHEN mode = 'raw_peak' THEN raw WHEN v - p > 6.0::DOUBLE/60 THEN p + 4.0::DOUBLE/60 WHEN v - p < -(6.0::DOUBLE/60) THEN p - 4.0::DOUBLE/60 ELSE v END AS hr FROM tg",
    ("peaks",),
)
def o3(spark, sf):
    s = tr.sorted_peaks(t.peaks(spark, sf), KEYS)
    s = s.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in tr.MODES[:5]])))
    est = tr.tracked(F.col("freqs"), F.lit(1.5), F.col("mode"), 0.4, F.lit(6.0) / 60, F.lit(4.0) / 60)
    return s.select(*KEYS, "mode", est.alias("hr"))


_RANK = """bst AS (SELECT recording, window_idx, channel, max(abs(c)) AS m, arg_min(lag, (-abs(c), lag)) AS delay FROM co GROUP BY 1, 2, 3)"""


def ranked_channels(lags, keys=("recording", "window_idx")):
    """Per window, channels by max |corr|, delay = first lag reaching it (few channels per window)."""
    a = F.abs("corr")
    best = lags.groupBy(*keys, "channel").agg(F.max(a).alias("max_corr"), F.min_by("lag", F.struct((-a).alias("a"), F.col("lag").alias("l"))).alias("delay"))
    w = W.partitionBy(*keys).orderBy(F.desc("max_corr"), "channel")
    return best.withColumn("rank", F.row_number().over(w))


@query("o4_rank_channels", f"WITH {LAG_SQL}, {_RANK} SELECT recording, window_idx, channel, {rq('m', 5)} AS max_corr, delay::INT AS delay, row_number() OVER (PARTITION BY recording, window_idx ORDER BY m DESC, channel)::INT AS rank FROM bst", ("sensor",))
def o4(spark, sf):
    return ranked_channels(lag_table(spark, sf)).withColumn("max_corr", r("max_corr", 5))


@query(
    "o5_representative_windows",
    """WITH c AS (SELECT recording, window_idx, fft_bpm, motion, sum(motion) OVER (PARTITION BY recording) AS nm FROM hr)
SELECT recording, window_idx FROM c WHERE nm < 2 OR motion = 1 QUALIFY row_number() OVER (PARTITION BY recording ORDER BY fft_bpm DESC, window_idx) <= 20""",
    ("hr",),
)
def o5(spark, sf):
    return representative(t.hr_rows(spark, sf), "fft_bpm", F.col("motion") == 1, 20).select("recording", "window_idx")


def representative(df, score, motion, n, keys=("recording",), order="window_idx"):
    """Top ``n`` by score among motion windows, among all when fewer than two move.

    ``row_number() <= n`` prunes map-side (window group limit), so no group is sorted whole.
    """
    top = lambda d: d.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), order))).filter(F.col("_rn") <= n)
    few = df.groupBy(*keys).agg(F.count_if(motion).alias("_m"))
    moving = top(df.filter(motion)).join(few.filter("_m >= 2"), list(keys), "left_semi")
    rest = top(df).join(few.filter("_m < 2"), list(keys), "left_semi")
    return moving.unionByName(rest)


@query(
    "o6_union_of_cases",
    "SELECT 'HF_best' AS case_name, recording, window_idx, fusion_hf_bpm AS bpm FROM hr UNION ALL SELECT 'ACC_best', recording, window_idx, fusion_acc_bpm FROM hr",
    ("hr",),
)
def o6(spark, sf):
    h = t.hr_rows(spark, sf)
    one = lambda c, v: h.select(F.lit(c).alias("case_name"), *KEYS, F.col(v).alias("bpm"))
    return one("HF_best", "fusion_hf_bpm").unionByName(one("ACC_best", "fusion_acc_bpm"))


@query("o7_distinct_markers", "SELECT DISTINCT recording, (sample_idx + accx::BIGINT % 5) AS marker FROM sensor WHERE rf = 'R'", ("sensor",))
def o7(spark, sf):
    s = t.sensor(spark, sf).filter("rf = 'R'")
    return s.select("recording", (F.col("sample_idx") + F.col("accx").cast("bigint") % 5).alias("marker")).dropDuplicates()


_TRACK = """RECURSIVE {arr}, mot AS (SELECT recording, window_idx, bool_or(rf = 'R' AND peak_idx = 0) AS m FROM peaks GROUP BY 1, 2),
src AS (SELECT pk.*, coalesce(m AND NOT lag(m) OVER (PARTITION BY recording ORDER BY window_idx), false) AS reset FROM pk JOIN mot USING (recording, window_idx)),
tr AS (SELECT recording, window_idx, f[1] AS hr FROM src WHERE window_idx = 0 UNION ALL
SELECT s.recording, s.window_idx, CASE WHEN s.reset THEN s.f[1] ELSE CASE WHEN v - tr.hr > 10.0::DOUBLE/60 THEN tr.hr + 7.0::DOUBLE/60 WHEN v - tr.hr < -(10.0::DOUBLE/60) THEN tr.hr - 7.0::DOUBLE/60 ELSE v END END
FROM tr JOIN (SELECT * FROM src) s ON s.recording = tr.recording AND s.window_idx = tr.window_idx + 1,
LATERAL (SELECT coalesce(list_filter(s.f[1:5], lambda z: z - tr.hr < 25.0::DOUBLE/60 AND z - tr.hr > -(25.0::DOUBLE/60))[1], tr.hr) AS v))
SELECT recording, window_idx, {hr} AS hr FROM tr"""


@query("w9_peak_tracking", "WITH " + _TRACK.format(arr=_ARR, hr=rq("hr", 8)), ("peaks",))
def w9(spark, sf):
    from wristwave.operators.windows import transition

    src = tr.sorted_peaks(t.peaks(spark, sf), KEYS)
    m = t.peaks(spark, sf).groupBy(*KEYS).agg(F.max((F.col("rf") == "R") & (F.col("peak_idx") == 0)).alias("m"))
    s = transition(src.join(m, KEYS), F.col("m"))
    s = s.withColumn("enters", F.col("enters") & (F.col("window_idx") > 0))
    # small chunks so that the settling rounds are exercised on short recordings
    out = tr.track(s, ["recording"], "window_idx", "freqs", 25 / 60, 10.0, 7.0, reset=F.col("enters"), size=32)
    return out.select(*KEYS, r("hr", 8).alias("hr"))


_SLEW = """RECURSIVE {lab}, h AS (SELECT recording, window_idx, fft_bpm / 60 AS v, segment, coalesce(max(fft_bpm / 60) OVER (PARTITION BY recording ORDER BY window_idx ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), fft_bpm / 60) AS init,
 lag(segment) OVER (PARTITION BY recording ORDER BY window_idx) AS pseg FROM lab),
tr AS (SELECT recording, window_idx, v, segment FROM h WHERE window_idx = 0 UNION ALL
SELECT s.recording, s.window_idx, CASE WHEN s.segment <> 'post_rest' THEN s.v WHEN s.v > p + 4.0::DOUBLE/60 THEN p + 4.0::DOUBLE/60 WHEN s.v < p - 4.0::DOUBLE/60 THEN p - 4.0::DOUBLE/60 ELSE s.v END, s.segment
FROM tr JOIN (SELECT * FROM h) s ON s.recording = tr.recording AND s.window_idx = tr.window_idx + 1, LATERAL (SELECT CASE WHEN s.pseg = 'post_rest' THEN tr.v ELSE s.init END AS p))
SELECT recording, window_idx, segment, {hr} AS v FROM tr"""


@query("w26_post_motion_slew", "WITH " + _SLEW.format(lab=_LAB, hr=rq("v", 8)), ("hr",))
def w26(spark, sf):
    h = t.hr_rows(spark, sf).withColumn("v", F.col("fft_bpm") / 60)
    out = tr.post_motion_slew(h, "v", F.col("motion") == 1, 4.0 / 60, 7)
    return out.select(*KEYS, "segment", r("v", 8).alias("v"))


@query(
    "w27_post_recovery_blend",
    f"""WITH {_LAB}, pre AS (SELECT recording, quantile_cont(fft_bpm, 0.75) AS base FROM (SELECT * FROM lab WHERE segment = 'pre_rest' QUALIFY row_number() OVER (PARTITION BY recording ORDER BY window_idx DESC) <= 15) GROUP BY 1),
pi AS (SELECT recording, window_idx, window_idx - row_number() OVER (PARTITION BY recording ORDER BY window_idx) AS g FROM lab WHERE segment = 'post_rest'),
pr AS (SELECT recording, min(window_idx) AS s, max(window_idx) AS e FROM pi GROUP BY recording, g),
an AS (SELECT pr.recording, s, e, quantile_cont(fft_bpm, 0.9) AS anchor FROM pr JOIN lab ON lab.recording = pr.recording AND window_idx BETWEEN s - 20 AND least(e, s + 7) GROUP BY 1, 2, 3),
md AS (SELECT an.*, base FROM an JOIN pre USING (recording) WHERE anchor > base)
SELECT lab.recording, window_idx, segment, {rq('CASE WHEN md.s IS NULL THEN fft_bpm ELSE 0.25 * (base + (anchor - base) * exp(-(window_idx - s) / 40.0::DOUBLE)) + 0.75 * fft_bpm END', 6)} AS v
FROM lab LEFT JOIN md ON md.recording = lab.recording AND window_idx BETWEEN md.s AND md.e""",
    ("hr",),
)
def w27(spark, sf):
    out = tr.post_recovery_blend(t.hr_rows(spark, sf).withColumn("v", F.col("fft_bpm")), "v", F.col("motion") == 1)
    return out.select(*KEYS, "segment", r("v", 6).alias("v"))
