"""J1-J14 and the crop predicates P28 / O8."""

from pyspark.sql import functions as F

from wristwave.operators import align as al
from wristwave.operators.chunked import CHUNK, chunk_col, join_group
from wristwave.plans.catalog.scalars import STEMS_SQL, report_stems
from wristwave.plans.catalog.statistics import _SHIFT
from wristwave.plans.registry import query, r, rq
from wristwave.sources import tables as t

HOUR, DAY = 3600.0, 86400.0

_FILES_SQL = """f AS (SELECT 'rec' || p_partkey AS stem FROM part UNION ALL SELECT 'rec' || p_partkey || '_ref' FROM part WHERE p_size % 2 = 0
UNION ALL SELECT 'rec' || p_partkey || '_HR_ref' FROM part WHERE p_size % 3 = 0)"""


def _files(spark, sf):
    base = F.concat(F.lit("rec"), F.col("p_partkey").cast("string"))
    names = F.array_compact(F.array(base, F.when(F.col("p_size") % 2 == 0, F.concat(base, F.lit("_ref"))), F.when(F.col("p_size") % 3 == 0, F.concat(base, F.lit("_HR_ref")))))
    return t.table(spark, sf, "part").select(F.explode(names).alias("stem"))


@query(
    "j1_reference_pairing",
    f"""WITH {_FILES_SQL} SELECT s.stem, coalesce(a.stem, b.stem) AS reference FROM f s LEFT JOIN f a ON a.stem = s.stem || '_ref' LEFT JOIN f b ON b.stem = s.stem || '_HR_ref'
WHERE s.stem NOT LIKE '%\\_ref' ESCAPE '\\'""",
)
def j1(spark, sf):
    return al.pair_references(_files(spark, sf))


_PTS = """pts AS (SELECT recording, t_s, bpm, lag(t_s) OVER w AS pt, lag(bpm) OVER w AS pv, lead(t_s) OVER w AS nt, lead(bpm) OVER w AS nv FROM ref_hr
 WINDOW w AS (PARTITION BY recording ORDER BY t_s))"""
_GRIDQ = f"""b AS (SELECT recording, min(t_s) AS a, max(t_s) AS z FROM ref_hr GROUP BY 1),
q AS (SELECT recording, k, a - 3600 + k * 3600.0::DOUBLE AS t_s FROM (SELECT *, unnest(range(0, ceil((z - a) / 3600)::BIGINT + 3)) AS k FROM b))"""
_NEAR = """l AS (SELECT q.recording, q.k, q.t_s, p.t_s AS lt, p.bpm AS lv, p.pt, p.pv FROM q ASOF LEFT JOIN pts p ON q.recording = p.recording AND q.t_s >= p.t_s),
n AS (SELECT l.*, p.t_s AS rt, p.bpm AS rv, p.nt, p.nv FROM l ASOF LEFT JOIN pts p ON l.recording = p.recording AND l.t_s < p.t_s)"""
_INTERP = """CASE WHEN lt IS NOT NULL AND rt IS NOT NULL THEN lv + (rv - lv) * ((t_s - lt) / (rt - lt)) WHEN lt IS NOT NULL THEN lv + (lv - pv) * ((t_s - lt) / (lt - pt))
ELSE rv + (nv - rv) * ((t_s - rt) / (nt - rt)) END"""


def hourly(spark, sf):
    ref = t.ref_hr(spark, sf)
    b = ref.groupBy("recording").agg(F.min("t_s").alias("a"), F.max("t_s").alias("z"))
    g = al.grid(b, ["recording"], F.ceil((F.col("z") - F.col("a")) / 3600) + 3, "k")
    return g.select("recording", "k", (F.col("a") - 3600 + F.col("k") * 3600.0).alias("t_s"))


@query("j2_linear_interpolation", f"WITH {_PTS}, {_GRIDQ}, {_NEAR} SELECT recording, k, {rq(f'coalesce({_INTERP}, 0.0)', 3)} AS bpm FROM n", ("ref_hr",))
def j2(spark, sf):
    out = al.interpolate(hourly(spark, sf), t.ref_hr(spark, sf), ["recording"], "t_s", "bpm", "bpm", DAY)
    return out.select("recording", "k", r("bpm", 3).alias("bpm"))


@query("j3_self_shift", f"WITH {_SHIFT} SELECT recording, window_idx, bias, v FROM sh WHERE bias IN (-2.5, 5)", ("hr",))
def j3(spark, sf):
    hr = t.hr_rows(spark, sf).select("recording", "window_idx", "ref_bpm")
    return al.shifted_rows(hr, "ref_bpm", [-2.5, 5.0]).select("recording", "window_idx", "bias", "v")


@query(
    "j4_nearest_time",
    f"WITH {_PTS}, {_GRIDQ}, {_NEAR} SELECT recording, k, CASE WHEN rt IS NULL OR t_s - lt <= rt - t_s THEN lv ELSE rv END AS bpm FROM n WHERE lt IS NOT NULL AND (rt IS NOT NULL OR lt >= t_s)",
    ("ref_hr",),
)
def j4(spark, sf):
    out = al.nearest(hourly(spark, sf), t.ref_hr(spark, sf), ["recording"], "t_s", "bpm", "bpm", DAY)
    return out.select("recording", "k", "bpm")


@query(
    "j5_window_key_join",
    """SELECT hr.recording, window_idx, fft_bpm, n_missing, n_missing <= 1 AS reliable_window FROM hr JOIN (SELECT recording, sample_idx // 5 AS w, count(*) FILTER (WHERE accz = 0) AS n_missing FROM sensor GROUP BY 1, 2) q
ON q.recording = hr.recording AND q.w = hr.window_idx""",
    ("hr",),
)
def j5(spark, sf):
    q = t.sensor(spark, sf).groupBy("recording", F.expr("sample_idx div 5").alias("window_idx")).agg(F.count_if(F.col("accz") == 0).alias("n_missing"))
    j = t.hr_rows(spark, sf).select("recording", "window_idx", "fft_bpm").join(q, ["recording", "window_idx"])
    return j.withColumn("reliable_window", F.col("n_missing") <= 1)


@query(
    "j6_interval_join",
    """SELECT a.recording, a.event_id, count(*) AS n, sum(p.bpm > 100)::BIGINT AS n_high FROM ref_hr a JOIN ref_hr p ON a.recording = p.recording AND p.t_s >= a.t_s AND p.t_s < a.t_s + 86400 GROUP BY 1, 2""",
    ("ref_hr",),
)
def j6(spark, sf):
    ref = t.ref_hr(spark, sf)
    anchors = ref.select("recording", "event_id", F.col("t_s").alias("anchor_s"))
    pairs = al.interval_join(anchors, ref.select("recording", "t_s", "bpm"), ["recording"], "anchor_s", "t_s", DAY)
    return pairs.groupBy("recording", "event_id").agg(F.count("*").alias("n"), F.count_if(F.col("bpm") > 100).alias("n_high"))


@query(
    "j7_beat_sample_lookup",
    "SELECT b.recording, b.sample_idx AS beat, s.sample_idx, s.ppg FROM sensor b JOIN sensor s ON s.recording = b.recording AND s.sample_idx = b.sample_idx + b.accx::BIGINT % 7 WHERE b.rf = 'R'",
    ("sensor",),
)
def j7(spark, sf):
    s = t.sensor(spark, sf)
    beats = s.filter("rf = 'R'").select("recording", F.col("sample_idx").alias("beat"), (F.col("sample_idx") + F.col("accx").cast("bigint") % 7).alias("sample_idx"))
    return beats.join(s.select("recording", "sample_idx", "ppg"), ["recording", "sample_idx"])


@query(
    "j8_recordings_params_modes",
    """SELECT recording, m.mode, p.fs AS fs_target, p.o AS max_order FROM (SELECT DISTINCT l_suppkey AS recording FROM lineitem), (VALUES ('green'),('red'),('ir')) m(mode), (VALUES (25,12),(50,16),(100,20)) p(fs,o)""",
)
def j8(spark, sf):
    recs = t.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("recording")).distinct()
    return fan_out(recs, ["green", "red", "ir"], [(25, 12), (50, 16), (100, 20)])


def fan_out(recs, modes, params):
    """Every mode and parameter set per recording, as two narrow expansions of literal arrays."""
    sets = F.array(*[F.struct(F.lit(a).alias("fs_target"), F.lit(b).alias("max_order")) for a, b in params])
    out = recs.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes]))).withColumn("_p", F.explode(sets))
    return out.select("recording", "mode", "_p.*")


@query(
    "j9_report_data_matching",
    f"""WITH {STEMS_SQL}, data AS (SELECT replace(p_name, ' ', '_') || CASE WHEN p_size % 3 = 0 THEN '-green' ELSE '' END AS stem, 'd' || p_partkey || '.csv' AS path FROM part)
SELECT p_partkey, arg_min(path, (pos, path)) AS path FROM cands JOIN data ON data.stem = cands.cand GROUP BY 1""",
)
def j9(spark, sf):
    p = t.table(spark, sf, "part")
    data = p.select(
        F.concat(F.regexp_replace("p_name", " ", "_"), F.when(F.col("p_size") % 3 == 0, "-green").otherwise("")).alias("cand"),
        F.concat(F.lit("d"), F.col("p_partkey").cast("string"), F.lit(".csv")).alias("path"),
    )
    # one path per stem first, so that popular stems do not multiply
    first = data.groupBy("cand").agg(F.min("path").alias("path"))
    j = report_stems(spark, sf).join(first, "cand")
    return j.groupBy("p_partkey").agg(F.min_by("path", F.struct("pos", "path")).alias("path"))


_GRID2 = """e AS (SELECT recording, channel, min(t_s) AS a, max(t_s) AS b FROM ref_hr GROUP BY 1, 2), ov AS (SELECT recording, max(a) AS a, min(b) AS b FROM e GROUP BY 1),
g AS (SELECT recording, k, a + k * 86400.0::DOUBLE AS t_s FROM (SELECT *, unnest(range(0, greatest(0, ceil((b + 86400 - a) / 86400)::BIGINT))) AS k FROM ov)),
pts AS (SELECT recording, channel, t_s, bpm, lag(t_s) OVER w AS pt, lag(bpm) OVER w AS pv, lead(t_s) OVER w AS nt, lead(bpm) OVER w AS nv FROM ref_hr WINDOW w AS (PARTITION BY recording, channel ORDER BY t_s)),
q AS (SELECT recording, k, t_s, unnest(['view','signup','error','purchase','click']) AS channel FROM g),
l AS (SELECT q.*, p.t_s AS lt, p.bpm AS lv, p.pt, p.pv FROM q ASOF LEFT JOIN pts p ON q.recording = p.recording AND q.channel = p.channel AND q.t_s >= p.t_s),
n AS (SELECT l.*, p.t_s AS rt, p.bpm AS rv, p.nt, p.nv FROM l ASOF LEFT JOIN pts p ON l.recording = p.recording AND l.channel = p.channel AND l.t_s < p.t_s)"""
CHANNELS = ["view", "signup", "error", "purchase", "click"]


def daily(spark, sf):
    return al.common_grid(t.ref_hr(spark, sf), ["recording"], "channel", "t_s", DAY)


@query("j10_common_grid", f"WITH {_GRID2} SELECT recording, channel, k, {rq(f'coalesce({_INTERP}, 0.0)', 3)} AS bpm FROM n", ("ref_hr",))
def j10(spark, sf):
    q = daily(spark, sf).withColumn("channel", F.explode(F.array(*[F.lit(c) for c in CHANNELS])))
    out = al.interpolate(q, t.ref_hr(spark, sf), ["recording", "channel"], "t_s", "bpm", "bpm", DAY)
    return out.select("recording", "channel", "k", r("bpm", 3).alias("bpm"))


@query(
    "j11_probability_alignment",
    f"""WITH {_GRID2}, p AS (SELECT recording, channel, k, greatest(0.0, coalesce({_INTERP}, 0.0)) AS p FROM n)
SELECT recording, channel, k, {rq('p / CASE WHEN sum(p) OVER (PARTITION BY recording, k) = 0 THEN 1 ELSE sum(p) OVER (PARTITION BY recording, k) END', 5)} AS p FROM p""",
    ("ref_hr",),
)
def j11(spark, sf):
    out = al.aligned_shares(t.ref_hr(spark, sf), daily(spark, sf), ["recording"], "channel", "t_s", "bpm", DAY, CHANNELS)
    return out.select("recording", "channel", "k", r("p", 5).alias("p"))


LAG_SQL = """len AS (SELECT recording, count(*) AS n FROM sensor GROUP BY 1),
wins AS (SELECT recording, k, k * 25 + 24 AS s FROM (SELECT *, unnest(range(0, greatest(0, (n - 224) // 25 + 1))) AS k FROM len WHERE n >= 224)),
chn AS (SELECT recording, sample_idx, 'accx' AS channel, accx AS y FROM sensor UNION ALL SELECT recording, sample_idx, 'accy', accy FROM sensor UNION ALL SELECT recording, sample_idx, 'accz', accz FROM sensor),
lg AS (SELECT unnest(range(-5, 6)) AS lag),
pr AS (SELECT w.recording, w.k, lag, channel, x.ppg AS x, c.y FROM wins w JOIN sensor x ON x.recording = w.recording AND x.sample_idx >= s AND x.sample_idx < s + 200
 CROSS JOIN lg JOIN chn c ON c.recording = w.recording AND c.sample_idx = x.sample_idx + lag),
co AS (SELECT recording, k AS window_idx, channel, lag, CASE WHEN count(*) = 200 AND max(y) > min(y) THEN corr(x, y) ELSE 0.0 END AS c FROM pr GROUP BY 1, 2, 3, 4)"""


def lag_table(spark, sf):
    return al.lag_correlations(t.sensor(spark, sf), "ppg", ["accx", "accy", "accz"], list(range(-5, 6)), 200, 25, start=24)


@query("j12_lag_join", f"WITH {LAG_SQL} SELECT recording, window_idx, channel, lag::INT AS lag, {rq('c', 5)} AS corr FROM co", ("sensor",))
def j12(spark, sf):
    return lag_table(spark, sf).select("recording", "window_idx", "channel", "lag", r("corr", 5).alias("corr"))


@query(
    "j13_best_param_override",
    "SELECT o_orderkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_acctbal END, o_totalprice) AS value FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
)
def j13(spark, sf):
    base = t.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("value"))
    best = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")).alias("value"))
    return al.override(base, best, ["k"], ["value"]).select("o_orderkey", "value")


@query(
    "j14_replay_comparison",
    """SELECT recording, window_idx, b - a AS delta, abs(b - a) <= 0.5 AS passed FROM (SELECT recording, window_idx, lms_hf_bpm AS a, lms_acc_bpm AS b FROM hr)""",
    ("hr",),
)
def j14(spark, sf):
    h = t.hr_rows(spark, sf)
    key = ["recording", "window_idx"]
    return al.replay(h.select(*key, F.col("lms_hf_bpm").alias("a")), h.select(*key, F.col("lms_acc_bpm").alias("b")), key, "a", "b").select(*key, "delta", "passed")


_OVER = """pb AS (SELECT user_id AS recording, (min(epoch_us(ts)) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6::DOUBLE AS a, (max(epoch_us(ts)) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6::DOUBLE AS b FROM events WHERE event_type = 'purchase' GROUP BY 1)"""


def _crop(spark, sf, keep_all):
    ref = t.ref_hr(spark, sf)
    other = ref.filter("channel = 'purchase'").groupBy("recording").agg(F.min("t_s").alias("a"), F.max("t_s").alias("b"))
    view = ref.filter("channel = 'click'")
    out = join_group(view, other, ["recording"], chunk_col("t_s", DAY))
    inside = F.coalesce((F.col("t_s") >= F.col("a")) & (F.col("t_s") <= F.col("b")), F.lit(False))
    if not keep_all:
        return out.filter(inside)
    some = out.groupBy("recording").agg(F.max(inside).alias("_any"))
    return join_group(out.withColumn("_in", inside), some, ["recording"], chunk_col("t_s", DAY)).filter("_in or not _any")


@query(
    "p28_evaluation_crop",
    f"WITH {_OVER}, v AS (SELECT r.*, coalesce(t_s >= a AND t_s <= b, false) AS ins FROM ref_hr r LEFT JOIN pb ON pb.recording = r.recording WHERE channel = 'click') SELECT recording, event_id FROM v QUALIFY ins OR NOT bool_or(ins) OVER (PARTITION BY recording)",
    ("ref_hr",),
)
def p28(spark, sf):
    return _crop(spark, sf, True).select("recording", "event_id")


@query("o8_visible_time", f"WITH {_OVER} SELECT r.recording, event_id FROM ref_hr r JOIN pb ON pb.recording = r.recording WHERE channel = 'click' AND t_s >= a AND t_s <= b", ("ref_hr",))
def o8(spark, sf):
    return _crop(spark, sf, False).select("recording", "event_id")
