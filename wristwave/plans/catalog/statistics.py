"""A1-A25."""

from pyspark.sql import functions as F

from wristwave.operators import stats as st
from wristwave.operators.windows import analysis_scope
from wristwave.plans.registry import query, r, rq
from wristwave.plans.catalog.scalars import exercise_dim
from wristwave.plans.catalog.sequences import RUNS_SQL
from wristwave.sources import tables as t

_LONG = """lng AS (SELECT recording, window_idx, motion, reliable, method, abs(v - ref_bpm) AS e FROM
(SELECT recording, window_idx, motion, reliable, ref_bpm, unnest(['lms_hf_bpm','lms_acc_bpm','fft_bpm','fusion_hf_bpm','fusion_acc_bpm']) AS method,
 unnest([lms_hf_bpm, lms_acc_bpm, fft_bpm, fusion_hf_bpm, fusion_acc_bpm]) AS v FROM hr))"""


def _rounded(df, keep, digits=4):
    return df.select(*keep, *[r(c, digits).alias(c) for c in df.columns if c not in keep])


@query(
    "a1_error_stats_dual",
    f"""WITH {_LONG} SELECT recording, method, {rq('avg(e) FILTER (WHERE reliable=1)')} AS aae_all, {rq('avg(e) FILTER (WHERE reliable=1 AND motion=0)')} AS aae_rest,
{rq('avg(e) FILTER (WHERE reliable=1 AND motion=1)')} AS aae_motion FROM lng GROUP BY 1, 2""",
    ("hr",),
)
def a1(spark, sf):
    return _rounded(st.error_stats(t.hr_rows(spark, sf)), ["recording", "method"])


_RUN = RUNS_SQL("hr", "motion = 1", "window_idx")


@query(
    "a2_error_stats_single",
    f"""WITH {_RUN}, {_LONG} SELECT lng.recording, method, {rq('avg(e)')} AS aae_all FROM lng LEFT JOIN best ON best.recording = lng.recording
WHERE method IN ('fft_bpm','fusion_hf_bpm') AND reliable = 1 AND (a IS NULL OR window_idx BETWEEN a - 30 AND b) GROUP BY 1, 2""",
    ("hr",),
)
def a2(spark, sf):
    h = t.hr_rows(spark, sf).withColumn("t", F.col("window_idx").cast("double"))
    scope = analysis_scope(h, "motion", "t", clear_flags=False)
    out = st.error_stats(scope, ["fft_bpm", "fusion_hf_bpm"]).filter("aae_all is not null")
    return _rounded(out.select("recording", "method", "aae_all"), ["recording", "method"])


_A3 = f"""WITH {_LONG} SELECT recording, method, {rq('avg(e)')} AS total_aae, {rq('avg((e <= 5)::INT)')} AS total_hit_rate_5bpm,
{rq('avg(e) FILTER (WHERE motion=0)')} AS rest_aae, {rq('avg((e <= 5)::INT) FILTER (WHERE motion=0)')} AS rest_hit_rate_5bpm,
{rq('avg(e) FILTER (WHERE motion=1)')} AS motion_aae, {rq('avg((e <= 5)::INT) FILTER (WHERE motion=1)')} AS motion_hit_rate_5bpm FROM lng GROUP BY 1, 2"""


@query("a3_detailed_stats_hit_rate", _A3, ("hr",))
def a3(spark, sf):
    return _rounded(st.detailed_stats(t.hr_rows(spark, sf)), ["recording", "method"])


_LAB = f"""{_RUN}, lab AS (SELECT hr.*, CASE WHEN a IS NULL THEN 'pre_rest' WHEN window_idx BETWEEN a AND b THEN 'motion'
WHEN motion = 1 THEN 'other_motion' WHEN window_idx < a THEN 'pre_rest' ELSE 'post_rest' END AS segment FROM hr LEFT JOIN best USING (recording))"""


def _seg(ref):
    out = []
    for tag, col in (("", "fusion_hf_bpm"), ("pure_fft_", "fft_bpm")):
        for n, c in (("rest_all", "segment IN ('pre_rest','post_rest')"), ("pre_rest", "segment = 'pre_rest'"), ("post_rest", "segment = 'post_rest'")):
            out.append((f"{tag}{n}_mae", f"avg(abs({col} - {ref})) FILTER (WHERE reliable = 1 AND {c})"))
    return out


_SEGN = ", ".join(f"count(*) FILTER (WHERE reliable = 1 AND {c}) AS n_{n}" for n, c in
                  (("rest_all", "segment IN ('pre_rest','post_rest')"), ("pre_rest", "segment = 'pre_rest'"), ("post_rest", "segment = 'post_rest'")))
_OBJ = "CASE WHEN rest_all_mae IS NULL OR pre_rest_mae IS NULL OR post_rest_mae IS NULL THEN 'inf'::DOUBLE ELSE greatest(rest_all_mae, pre_rest_mae, post_rest_mae) END"


def metrics(spark, sf):
    return st.segment_metrics(st.labelled(t.hr_rows(spark, sf)), "fusion_hf_bpm", "fft_bpm", "ref_bpm", "reliable")


@query(
    "a4_segment_metrics",
    f"WITH {_LAB} SELECT recording, " + ", ".join(f"{rq(e)} AS {n}" for n, e in _seg("ref_bpm")) + f", {_SEGN} FROM lab GROUP BY 1",
    ("hr",),
)
def a4(spark, sf):
    m = metrics(spark, sf)
    return _rounded(m, [c for c in m.columns if not c.endswith("_mae")])


@query(
    "a5_worst_segment_objective",
    f"WITH {_LAB}, m AS (SELECT recording, " + ", ".join(f"{e} AS {n}" for n, e in _seg("ref_bpm")[:3]) + f" FROM lab GROUP BY 1) SELECT recording, CASE WHEN isinf({_OBJ}) THEN 999999.0 ELSE {rq(_OBJ)} END AS objective FROM m",
    ("hr",),
)
def a5(spark, sf):
    o = st.worst_segment(metrics(spark, sf))
    return o.select("recording", F.when(F.col("objective") == float("inf"), 999999.0).otherwise(r("objective")).alias("objective"))


BIASES = [x * 0.5 for x in range(-20, 41)]
_SHIFT = """ends AS (SELECT recording, max(window_idx) + 1 AS n FROM hr GROUP BY 1),
q AS (SELECT hr.recording, window_idx, n, bias, window_idx + bias AS pos, greatest(0, least(n - 2, floor(window_idx + bias)))::BIGINT AS i0
  FROM hr JOIN ends USING (recording), (SELECT unnest(generate_series(-20, 40)) / 2.0::DOUBLE AS bias) WHERE n >= 2),
sh AS (SELECT q.recording, q.window_idx, bias, a.ref_bpm + (b.ref_bpm - a.ref_bpm) * (pos - i0) AS v FROM q
  JOIN hr a ON a.recording = q.recording AND a.window_idx = i0 JOIN hr b ON b.recording = q.recording AND b.window_idx = i0 + 1)"""


@query(
    "a6_time_bias_scan",
    f"WITH {_LAB}, {_SHIFT}, m AS (SELECT lab.recording, bias, " + ", ".join(f"{e} AS {n}" for n, e in _seg("sh.v"))
    + f" FROM lab JOIN sh ON sh.recording = lab.recording AND sh.window_idx = lab.window_idx GROUP BY 1, 2), o AS (SELECT *, {_OBJ} AS objective FROM m) "
    + f"SELECT recording, bias AS time_bias_s, CASE WHEN isinf(objective) THEN 999999.0 ELSE {rq('objective')} END AS objective, {rq('rest_all_mae')} AS rest_all_mae FROM o QUALIFY row_number() OVER (PARTITION BY recording ORDER BY objective, bias) = 1",
    ("hr",),
)
def a6(spark, sf):
    best = st.time_bias_scan(st.labelled(t.hr_rows(spark, sf)), "fusion_hf_bpm", "fft_bpm", "ref_bpm", "reliable", BIASES)
    obj = F.when(F.col("objective") == float("inf"), 999999.0).otherwise(r("objective"))
    return best.select("recording", "time_bias_s", obj.alias("objective"), r("rest_all_mae").alias("rest_all_mae"))


@query(
    "a7_best_trial",
    """SELECT study, v AS best_value, strategy, trial FROM (SELECT *, CASE WHEN status = 'P' THEN 999999.0 ELSE value END AS v FROM trials)
QUALIFY row_number() OVER (PARTITION BY study ORDER BY v, strategy, trial) = 1""",
    ("trials",),
)
def a7(spark, sf):
    return st.best_trial(t.trials(spark, sf), ["study"], "value", ["strategy", "trial"], ["strategy", "trial"], 999999.0, F.col("status") == "P")


@query(
    "a8_lag_bounds",
    """WITH s AS (SELECT recording, sample_idx % 40 AS g, accx::INT - 25 AS lag, accy * 2 AS c FROM sensor),
n AS (SELECT recording, g, count(*) FILTER (WHERE abs(c) >= 0.15::DOUBLE) AS confident, quantile_cont(lag, 0.25) FILTER (WHERE abs(c) >= 0.15::DOUBLE) AS q25,
 quantile_cont(lag, 0.5) FILTER (WHERE abs(c) >= 0.15::DOUBLE) AS med, quantile_cont(lag, 0.75) FILTER (WHERE abs(c) >= 0.15::DOUBLE) AS q75 FROM s GROUP BY 1, 2),
b AS (SELECT *, floor(q25)::INT - 2 AS a1, ceil(q75)::INT + 2 AS b1, round_even(med, 0)::INT AS c FROM n),
d AS (SELECT *, greatest(-20, CASE WHEN b1 - a1 < 6 THEN c - 3 ELSE a1 END) AS lo, least(20, CASE WHEN b1 - a1 < 6 THEN c + 3 ELSE b1 END) AS hi FROM b)
SELECT recording, g, confident, CASE WHEN confident < 2 OR lo > hi THEN -20 ELSE lo END AS min_lag, CASE WHEN confident < 2 OR lo > hi THEN 20 ELSE hi END AS max_lag,
CASE WHEN confident < 2 OR lo > hi THEN 0.0 ELSE med END AS median_lag, (confident < 2 OR lo > hi) AS fallback,
CASE WHEN confident < 2 THEN 'insufficient confident windows' WHEN lo > hi THEN 'aggregated bounds outside default range' ELSE 'ok' END AS reason FROM d""",
    ("sensor",),
)
def a8(spark, sf):
    s = t.sensor(spark, sf).select("recording", (F.col("sample_idx") % 40).alias("g"), (F.col("accx").cast("int") - 25).alias("lag"), (F.col("accy") * 2).alias("c"))
    return st.lag_bounds(s, ["recording", "g"], "lag", "c", F.lit(-20), F.lit(20))


_A11 = lambda x, n: ", ".join([
    f"{rq(f'avg({x})')} AS {n}_mean", f"{rq(f'stddev_pop({x})')} AS {n}_std", f"min({x}) AS {n}_min", f"max({x}) AS {n}_max", f"{rq(f'max({x}) - min({x})')} AS {n}_range",
    f"{rq(f'avg({x}*{x})')} AS {n}_energy", f"{rq(f'sum(z)::DOUBLE / (count(*) - 1)')} AS {n}_zcr",
    f"{rq(f'CASE WHEN max({x}) = min({x}) THEN 0.0 ELSE (avg({x}*{x}*{x}) - 3*avg({x})*avg({x}*{x}) + 2*avg({x})*avg({x})*avg({x})) / pow(var_pop({x}), 1.5) END')} AS {n}_skewness",
    f"{rq(f'CASE WHEN max({x}) = min({x}) THEN 0.0 ELSE kurtosis_pop({x}) END')} AS {n}_kurtosis",
])


@query(
    "a11_time_features",
    f"""WITH s AS (SELECT recording, sample_idx // 50 AS win, sample_idx, accx - 25 AS x FROM sensor),
z AS (SELECT *, (sign(x) <> lag(sign(x)) OVER (PARTITION BY recording, win ORDER BY sample_idx))::INT AS z FROM s)
SELECT recording, win, {_A11('x', 'x')} FROM z GROUP BY 1, 2 HAVING count(*) = 50""",
    ("sensor",),
)
def a11(spark, sf):
    s = t.sensor(spark, sf).select("recording", F.expr("sample_idx div 50").alias("win"), "sample_idx", (F.col("accx") - 25).alias("x"))
    full = s.groupBy("recording", "win").agg(F.count("*").alias("_n")).filter("_n = 50").select("recording", "win")
    f = st.time_features(s.join(full, ["recording", "win"]), {"x": "x"}, ["recording", "win"], "sample_idx")
    keep = ["recording", "win", "x_min", "x_max"]
    return _rounded(f, keep)


_PAIRS = [("ppg", "accx"), ("accx", "accy"), ("accx", "accz"), ("accy", "accz"), ("ppg", "accy"), ("ppg", "accz"), ("accx", "rfn")]


@query(
    "a12_channel_correlations",
    "WITH s AS (SELECT *, CASE rf WHEN 'R' THEN 1.0 ELSE 0.0 END AS rfn, sample_idx // 200 AS win FROM sensor) SELECT recording, win, "
    + ", ".join(f"{rq(f'CASE WHEN max({a})=min({a}) OR max({b})=min({b}) THEN 0.0 ELSE corr({a},{b}) END')} AS corr_{a}_{b}" for a, b in _PAIRS) + " FROM s GROUP BY 1, 2",
    ("sensor",),
)
def a12(spark, sf):
    s = t.sensor(spark, sf).withColumn("rfn", F.when(F.col("rf") == "R", 1.0).otherwise(0.0)).withColumn("win", F.expr("sample_idx div 200"))
    return _rounded(st.channel_correlations(s, _PAIRS, ["recording", "win"]), ["recording", "win"])


@query("a15_counts_by_class", "SELECT rf, count(*) FILTER (WHERE ls='F') AS rest, count(*) FILTER (WHERE ls='O') AS motion FROM sensor GROUP BY 1", ("sensor",))
def a15(spark, sf):
    p = t.sensor(spark, sf).groupBy("rf").pivot("ls", ["F", "O"]).count().fillna(0)
    return p.select("rf", F.col("F").alias("rest"), F.col("O").alias("motion"))


_DAY = 86400.0


@query(
    "a16_short_to_long_probability",
    f"""WITH b AS (SELECT recording, min(t_s) AS t0, max(t_s) AS t1 FROM ref_hr GROUP BY 1),
x AS (SELECT recording, channel, bpm, t_s - t0 AS x, ceil((t1 - 8*86400.0::DOUBLE + 86400 - t0) / 86400)::BIGINT - 1 AS lst FROM ref_hr JOIN b USING (recording)),
e AS (SELECT recording, channel, bpm, unnest(range(greatest(0, floor((x - 8*86400.0::DOUBLE) / 86400)::BIGINT + 1), least(floor(x / 86400)::BIGINT, lst) + 1)) AS anchor FROM x)
SELECT recording, anchor, channel, {rq('avg(bpm)')} AS p, count(*) AS n_short FROM e GROUP BY 1, 2, 3""",
    ("ref_hr",),
)
def a16(spark, sf):
    out = st.short_to_long(t.ref_hr(spark, sf), ["recording"], "t_s", "channel", "bpm", 8 * _DAY, _DAY)
    return out.select("recording", "anchor", "channel", r("p").alias("p"), "n_short")


_PRED = "p AS (SELECT *, rf AS a, CASE WHEN accx > 34 THEN 'R' WHEN accx > 17 THEN 'A' ELSE 'N' END AS b, CASE WHEN ppg > 70000 THEN 'R' WHEN ppg > 35000 THEN 'A' ELSE 'N' END AS c FROM sensor)"


@query("a17_classifier_agreement", f"WITH {_PRED} SELECT {rq('avg((a=b)::INT)', 6)} AS a_b, {rq('avg((a=c)::INT)', 6)} AS a_c, {rq('avg((b=c)::INT)', 6)} AS b_c FROM p", ("sensor",))
def a17(spark, sf):
    s = t.sensor(spark, sf)
    cut = lambda c, hi, lo: F.when(F.col(c) > hi, "R").when(F.col(c) > lo, "A").otherwise("N")
    a, b, c = F.col("rf"), cut("accx", 34, 17), cut("ppg", 70000, 35000)
    same = lambda x, y: r(F.avg((x == y).cast("double")), 6)
    return s.agg(same(a, b).alias("a_b"), same(a, c).alias("a_c"), same(b, c).alias("b_c"))


@query(
    "a18_method_ranking",
    f"WITH {_LONG}, g AS (SELECT method, avg(e) AS x, avg(e) FILTER (WHERE motion=0) AS y, avg(e) FILTER (WHERE motion=1) AS z FROM lng GROUP BY 1) SELECT method, row_number() OVER (ORDER BY x, method)::INT AS rank, {rq('x')} AS aae_all, {rq('y')} AS aae_rest, {rq('z')} AS aae_motion FROM g",
    ("hr",),
)
def a18(spark, sf):
    from pyspark.sql import Window as W

    m = st.error_stats(t.hr_rows(spark, sf), keys=[], honour_reliability=False)
    ranked = m.withColumn("rank", F.row_number().over(W.orderBy("aae_all", "method")))  # five rows
    return _rounded(ranked.orderBy("rank"), ["method", "rank"])


@query(
    "a19_error_quartiles",
    f"WITH {_LONG} SELECT method, motion, count(*) AS n, {rq('quantile_cont(e, 0.25)')} AS q25, {rq('quantile_cont(e, 0.5)')} AS q50, {rq('quantile_cont(e, 0.75)')} AS q75 FROM lng GROUP BY 1, 2",
    ("hr",),
)
def a19(spark, sf):
    rows = st.error_rows(t.hr_rows(spark, sf), st.METHODS, "ref_bpm", ["motion"])
    return _rounded(st.error_quartiles(rows, ["method", "motion"]), ["method", "motion", "n"])


_PAIRED = "d AS (SELECT recording, abs(lms_hf_bpm - ref_bpm) AS a, abs(lms_acc_bpm - ref_bpm) AS b FROM hr)"


def _paired(spark, sf):
    return t.hr_rows(spark, sf).select("recording", F.abs(F.col("lms_hf_bpm") - F.col("ref_bpm")).alias("a"), F.abs(F.col("lms_acc_bpm") - F.col("ref_bpm")).alias("b"))


@query(
    "a20_signed_rank",
    f"""WITH {_PAIRED}, z AS (SELECT recording, a - b AS d FROM d WHERE a <> b), c AS (SELECT recording, abs(d) AS m, count(*) AS c, count(*) FILTER (WHERE d > 0) AS pos FROM z GROUP BY 1, 2),
k AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY recording ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2.0::DOUBLE AS rk FROM c),
g AS (SELECT recording, sum(c)::BIGINT AS n, sum(pos * rk)::DOUBLE AS wp, sum((c - pos) * rk)::DOUBLE AS wm, sum(c::DOUBLE*c*c - c) AS ties FROM k GROUP BY 1)
SELECT recording, n, wp AS w_plus, wm AS w_minus, least(wp, wm) AS statistic, {rq('(least(wp, wm) - n*(n+1)/4.0::DOUBLE) / sqrt(n::DOUBLE*(n+1)*(2*n+1)/24.0::DOUBLE - ties/48.0::DOUBLE)')} AS z FROM g""",
    ("hr",),
)
def a20(spark, sf):
    out = st.signed_rank(_paired(spark, sf), "a", "b", ["recording"])
    return out.select("recording", "n", "w_plus", "w_minus", "statistic", r("z").alias("z"))


@query(
    "a20_exact_signed_rank",
    f"""WITH RECURSIVE d AS (SELECT recording, window_idx // 30 AS block, abs(lms_hf_bpm - ref_bpm) - abs(lms_acc_bpm - ref_bpm) AS d FROM hr),
c AS (SELECT recording, block, abs(d) AS m, count(*) AS c, count(*) FILTER (WHERE d > 0) AS pos FROM d WHERE d <> 0 GROUP BY 1, 2, 3),
k AS (SELECT *, sum(c) OVER (PARTITION BY recording, block ORDER BY m) - (c - 1) / 2.0::DOUBLE AS rk FROM c),
g AS (SELECT recording, block, sum(c)::BIGINT AS n, max(c) AS most, sum(pos * rk)::DOUBLE AS wp, sum((c - pos) * rk)::DOUBLE AS wm FROM k GROUP BY 1, 2),
ways AS (SELECT 0 AS n, 0 AS s, 1.0::DOUBLE AS w UNION ALL SELECT n + 1, s, sum(w) FROM (SELECT n, s, w FROM ways WHERE n < 50 UNION ALL SELECT n, s + n + 1, w FROM ways WHERE n < 50) GROUP BY 1, 2),
tails AS (SELECT n, s, sum(w) OVER (PARTITION BY n ORDER BY s) / pow(2, n) AS t FROM ways)
SELECT g.recording, block, g.n, least(wp, wm) AS statistic, {rq('CASE WHEN most = 1 AND t IS NOT NULL THEN least(1, 2 * t) END', 8)} AS p_exact FROM g LEFT JOIN tails ON tails.n = g.n AND tails.s = least(wp, wm)""",
    ("hr",),
)
def a20_exact(spark, sf):
    rows = t.hr_rows(spark, sf)
    d = rows.select("recording", F.expr("window_idx div 30").alias("block"), F.abs(F.col("lms_hf_bpm") - F.col("ref_bpm")).alias("a"), F.abs(F.col("lms_acc_bpm") - F.col("ref_bpm")).alias("b"))
    return st.signed_rank_test(d, "a", "b", ["recording", "block"]).select("recording", "block", "n", "statistic", r("p_exact", 8).alias("p_exact"))


@query("a21_paired_effect", f"WITH {_PAIRED} SELECT recording, {rq('(avg(a) - avg(b)) / stddev_pop(a - b)', 6)} AS cohens_d FROM d GROUP BY 1", ("hr",))
def a21(spark, sf):
    return _rounded(st.paired_effect(_paired(spark, sf), "a", "b", ["recording"]), ["recording"], 6)


@query(
    "a22_distribution_ablation",
    f"""WITH h AS (SELECT hr.*, s.accx / (s.accx + s.accy * 100 + s.accz * 100) AS p1, s.accy * 100 / (s.accx + s.accy * 100 + s.accz * 100) AS p2, s.accz * 100 / (s.accx + s.accy * 100 + s.accz * 100) AS p3
 FROM hr JOIN sensor s ON s.recording = hr.recording AND s.sample_idx = hr.window_idx), g AS (SELECT recording, avg(p1) AS g1, avg(p2) AS g2, avg(p3) AS g3 FROM h GROUP BY 1)
SELECT h.recording, {rq('avg(abs(p1*lms_hf_bpm + p2*lms_acc_bpm + p3*fft_bpm - ref_bpm))')} AS window_level, {rq('avg(abs(g1*lms_hf_bpm + g2*lms_acc_bpm + g3*fft_bpm - ref_bpm))')} AS global_level,
{rq('avg(abs((lms_hf_bpm + lms_acc_bpm + fft_bpm)/3 - ref_bpm))')} AS uniform FROM h JOIN g ON g.recording = h.recording GROUP BY 1""",
    ("hr",),
)
def a22(spark, sf):
    from wristwave.operators.chunked import CHUNK, chunk_col, join_group

    s = t.sensor(spark, sf).select("recording", F.col("sample_idx").alias("window_idx"), "accx", "accy", "accz")
    total = F.col("accx") + F.col("accy") * 100 + F.col("accz") * 100
    p = s.select("recording", "window_idx", (F.col("accx") / total).alias("p1"), (F.col("accy") * 100 / total).alias("p2"), (F.col("accz") * 100 / total).alias("p3"))
    h = t.hr_rows(spark, sf).join(p, ["recording", "window_idx"])
    g = p.groupBy("recording").agg(F.avg("p1").alias("g1"), F.avg("p2").alias("g2"), F.avg("p3").alias("g3"))
    j = join_group(h, g, ["recording"], chunk_col("window_idx", CHUNK))
    mix = lambda a: F.col(f"{a}1") * F.col("lms_hf_bpm") + F.col(f"{a}2") * F.col("lms_acc_bpm") + F.col(f"{a}3") * F.col("fft_bpm")
    err = lambda e: r(F.avg(F.abs(e - F.col("ref_bpm"))))
    uni = (F.col("lms_hf_bpm") + F.col("lms_acc_bpm") + F.col("fft_bpm")) / 3
    return j.groupBy("recording").agg(err(mix("p")).alias("window_level"), err(mix("g")).alias("global_level"), err(uni).alias("uniform"))


_EX = "ex(exercise, p_type) AS (VALUES ('jump_rope','SMALL'),('arm_curl','MEDIUM'),('push_up','LARGE'),('jumping_jack','PROMO'),('burpee','NONE'))"


def _reports(spark, sf):
    kinds = F.create_map(*[F.lit(x) for kv in [("SMALL", "jump_rope"), ("MEDIUM", "arm_curl"), ("LARGE", "push_up"), ("PROMO", "jumping_jack")] for x in kv])
    p = t.table(spark, sf, "part")
    return p.select(kinds[F.col("p_type")].alias("exercise"), F.col("p_partkey").alias("report"), F.col("p_retailprice").alias("min_err_hf"), F.col("p_brand").alias("sample"))


@query(
    "a23_best_report_per_exercise",
    f"""WITH {_EX} SELECT exercise, p_partkey AS report, p_retailprice AS best_value FROM ex LEFT JOIN (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) = 1) USING (p_type)""",
)
def a23(spark, sf):
    best = st.best_trial(_reports(spark, sf).filter("exercise is not null"), ["exercise"], "min_err_hf", ["report"], ["report"])
    missing = exercise_dim(spark).select("exercise").join(best, "exercise", "left_anti")
    return best.select("exercise", "report", "best_value").unionByName(missing, allowMissingColumns=True)


@query(
    "a24_rollup_by_exercise",
    f"WITH {_EX} SELECT exercise, p_brand AS sample, count(*) AS n, {rq('avg(p_retailprice)')} AS mean_err FROM part JOIN ex USING (p_type) GROUP BY ROLLUP (exercise, p_brand)",
)
def a24(spark, sf):
    rep = _reports(spark, sf).filter("exercise is not null")
    return rep.rollup("exercise", "sample").agg(F.count("*").alias("n"), r(F.avg("min_err_hf")).alias("mean_err"))


@query(
    "a25_beat_window_summary",
    """WITH b AS (SELECT recording, sample_idx // 10 AS window_idx, accz, CASE WHEN accy * 40 > 0.05::DOUBLE AND accy * 40 < 3 THEN accy * 40 END AS r FROM sensor)
SELECT recording, window_idx, quantile_cont(r, 0.5) AS r_median, count(r) AS valid_beat_count, (avg((accz = 0)::INT) <= 0.20::DOUBLE AND count(r) > 0) AS reliable FROM b GROUP BY 1, 2""",
    ("sensor",),
)
def a25(spark, sf):
    b = t.sensor(spark, sf).select("recording", F.expr("sample_idx div 10").alias("window_idx"), (F.col("accy") * 40).alias("r"), (F.col("accz") == 0).cast("double").alias("miss"))
    return beat_summary(b, "miss")


def beat_summary(beats, miss):
    ok = F.when((F.col("r") > 0.05) & (F.col("r") < 3.0), F.col("r"))
    g = beats.groupBy("recording", "window_idx").agg(F.percentile(ok, 0.5).alias("r_median"), F.count(ok).alias("valid_beat_count"), F.avg(miss).alias("_m"))
    return g.withColumn("reliable", (F.col("_m") <= 0.20) & (F.col("valid_beat_count") > 0)).drop("_m")
