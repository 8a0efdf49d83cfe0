"""G1-G23, W31, A9, A10, A13, A14."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wristwave.operators import signal as sg
from wristwave.operators import stats as st
from wristwave.operators import tracking as tr
from wristwave.operators import windows as w
from wristwave.operators.delay import delay_profile, window_delays
from wristwave.plans.catalog.alignment import LAG_SQL, lag_table
from wristwave.plans.catalog.ranking import ranked_channels
from wristwave.plans.catalog.sequences import FS, MAG_SQL, STEP, WIN, mag
from wristwave.plans.registry import query, r, rq
from wristwave.sources import tables as t

CHANS = ["ppg", "accx", "accy", "accz"]


@query("g1_band_pass")
def g1(spark, sf):
    return sg.band_pass(t.sensor(spark, sf), CHANS, FS)


@query("g2_resample")
def g2(spark, sf):
    return sg.resample(t.sensor(spark, sf), ["ppg", "accx"], 1, 4)


@query(
    "g3_demean_taper",
    f"""WITH e AS (SELECT vec_id, unnest(x) AS v, unnest(range(0, 64)) AS i, list_sum(x) / 64 AS m FROM vectors)
SELECT vec_id, i::INT AS i, {rq('(v - m) * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * i / 63))', 6)} AS v FROM e""",
    ("vectors",),
)
def g3(spark, sf):
    out = t.vectors(spark, sf).select("vec_id", F.posexplode(sg.tapered("x", 64)).alias("i", "v"))
    return out.select("vec_id", "i", r("v", 6).alias("v"))


@query(
    "g4_amplitude_spectrum",
    f"""WITH e AS (SELECT vec_id, unnest(x) AS v, unnest(range(0, 64)) AS n FROM vectors), k AS (SELECT unnest(range(0, 32)) AS k),
s AS (SELECT vec_id, k, sum(v * cos(2 * pi() * k * n / 64)) AS c, sum(v * sin(2 * pi() * k * n / 64)) AS s FROM e, k GROUP BY 1, 2)
SELECT vec_id, k::INT AS k, {rq('sqrt(c*c + s*s) / 64 * CASE WHEN k = 0 THEN 1 ELSE 2 END', 5)} AS amp FROM s""",
    ("vectors",),
)
def g4(spark, sf):
    spec = sg.amplitude_spectrum(64)
    out = t.vectors(spark, sf).select("vec_id", F.posexplode(spec("x")).alias("k", "amp"))
    return out.select("vec_id", "k", r("amp", 5).alias("amp"))


def _wins(spark, sf, cols=("ppg", "accx", "accy", "accz"), pad=0, padded=(), start=25):
    return w.window_arrays(t.sensor(spark, sf), list(cols), WIN, STEP, start, pad, padded)


@query("g5_spectral_peaks")
def g5(spark, sf):
    p = _wins(spark, sf, ["ppg"]).withColumn("ppg", sg.tapered("ppg", WIN))
    return p.select("recording", "window_idx", F.posexplode(sg.spectral_peaks(FS)("ppg")).alias("rank", "p")).select("recording", "window_idx", "rank", "p.f", "p.a")


@query(
    "g6_spectral_penalty",
    """SELECT recording, window_idx, peak_idx::INT AS peak_idx, freq AS f, CASE WHEN abs(freq - 1.5) < 0.2::DOUBLE OR abs(freq - 3.0) < 0.2::DOUBLE THEN amp * 0.2::DOUBLE ELSE amp END AS a FROM peaks""",
    ("peaks",),
)
def g6(spark, sf):
    p = t.peaks(spark, sf).groupBy("recording", "window_idx").agg(
        F.sort_array(F.collect_list(F.struct("peak_idx", F.col("freq").alias("f"), F.col("amp").alias("a")))).alias("p")
    )
    out = p.select("recording", "window_idx", F.posexplode(sg.penalised(F.col("p"), F.lit(1.5))).alias("peak_idx", "e"))
    return out.select("recording", "window_idx", "peak_idx", "e.f", "e.a")


@query("g7_low_band_ratio")
def g7(spark, sf):
    return _wins(spark, sf, ["ppg"]).select("recording", "window_idx", sg.low_band_ratio(FS)("ppg").alias("ratio"))


@query("g8_welch_features")
def g8(spark, sf):
    return _wins(spark, sf, ["accx"]).select("recording", "window_idx", sg.welch_features(FS)("accx").alias("f")).select("recording", "window_idx", "f.*")


@query("g9_lag_correlation", f"WITH {LAG_SQL} SELECT recording, window_idx, channel, lag::INT AS lag, {rq('c', 5)} AS corr FROM co", ("sensor",))
def g9(spark, sf):
    axes = ["accx", "accy", "accz"]
    wins = w.window_arrays(t.sensor(spark, sf), ["ppg", *axes], WIN, STEP, 24, 5, tuple(axes))
    corr = sg.lag_correlation(5)
    wide = wins.select("recording", "window_idx", *[corr("ppg", c, "pad_left").alias(c) for c in axes])
    both = wide.unpivot(["recording", "window_idx"], axes, "channel", "cs")
    out = both.select("recording", "window_idx", "channel", F.posexplode("cs").alias("p", "corr"))
    return out.select("recording", "window_idx", "channel", (F.col("p") - 5).alias("lag"), r("corr", 5).alias("corr"))


_BEST = """bst AS (SELECT recording, window_idx, channel, max(abs(c)) AS m, arg_min(lag, (-abs(c), lag)) AS delay FROM co GROUP BY 1, 2, 3),
top AS (SELECT * FROM bst QUALIFY row_number() OVER (PARTITION BY recording, window_idx ORDER BY m DESC, channel) = 1)"""


@query("g10_delay_estimate", f"WITH {LAG_SQL}, {_BEST} SELECT recording, window_idx, channel, {rq('m', 5)} AS max_corr, delay::INT AS delay FROM top", ("sensor",))
def g10(spark, sf):
    best = ranked_channels(lag_table(spark, sf)).filter("rank = 1")
    return best.select("recording", "window_idx", "channel", r("max_corr", 5).alias("max_corr"), "delay")


_LAG20 = LAG_SQL.replace("range(-5, 6)", "range(-20, 21)").replace("pr AS (SELECT w.recording", f"""sd AS (SELECT w.recording, w.k, stddev_samp({MAG_SQL}) AS sd FROM wins w JOIN sensor x ON x.recording = w.recording AND x.sample_idx > s AND x.sample_idx <= s + 200 GROUP BY 1, 2 HAVING count(*) = 200),
rep AS (SELECT recording, k, row_number() OVER (PARTITION BY recording ORDER BY sd DESC, k) AS rk FROM sd), pr AS (SELECT w.recording""").replace("FROM wins w JOIN sensor x ON x.recording = w.recording AND x.sample_idx >= s", "FROM wins w JOIN rep ON rep.recording = w.recording AND rep.k = w.k AND rk <= 20 JOIN sensor x ON x.recording = w.recording AND x.sample_idx >= s")


@query(
    "g11_tiered_delay_profile",
    f"""WITH {_LAG20}, tiers(tier, lim, nwin) AS (VALUES (0, 5, 5), (1, 10, 10), (2, 15, 15), (3, 20, 20)),
pc AS (SELECT co.recording, co.window_idx, CASE channel WHEN 'accx' THEN 'HF' ELSE 'ACC' END AS g, tier, lim, max(abs(c)) AS m, arg_min(lag, (-abs(c), channel, lag)) AS delay FROM co JOIN rep ON rep.recording = co.recording AND rep.k = co.window_idx JOIN tiers ON rk <= nwin AND abs(lag) <= lim GROUP BY 1, 2, 3, 4, 5),
grp AS (SELECT * FROM pc), st AS (SELECT recording, tier, g, lim, count(*) FILTER (WHERE m >= 0.15::DOUBLE) AS confident, quantile_cont(delay, 0.25) FILTER (WHERE m >= 0.15::DOUBLE) AS q25,
 quantile_cont(delay, 0.5) FILTER (WHERE m >= 0.15::DOUBLE) AS med, quantile_cont(delay, 0.75) FILTER (WHERE m >= 0.15::DOUBLE) AS q75 FROM grp GROUP BY 1, 2, 3, 4),
bb AS (SELECT *, floor(q25)::INT - 2 AS a1, ceil(q75)::INT + 2 AS b1, round_even(med, 0)::INT AS c FROM st),
dd AS (SELECT *, greatest(-lim, CASE WHEN b1 - a1 < 6 THEN c - 3 ELSE a1 END) AS lo, least(lim, CASE WHEN b1 - a1 < 6 THEN c + 3 ELSE b1 END) AS hi FROM bb),
ff AS (SELECT recording, tier, g, lim, confident, confident < 2 OR lo > hi AS fallback, CASE WHEN confident < 2 OR lo > hi THEN -lim ELSE lo END AS min_lag, CASE WHEN confident < 2 OR lo > hi THEN lim ELSE hi END AS max_lag FROM dd),
ok AS (SELECT recording, tier, bool_and(NOT fallback AND max_lag - min_lag >= 6 AND min_lag <> -lim AND max_lag <> lim AND (max_lag - min_lag) / (2.0::DOUBLE * lim) <= 0.7::DOUBLE) AS ok FROM ff GROUP BY 1, 2),
pick AS (SELECT recording, coalesce(min(tier) FILTER (WHERE ok), max(tier)) AS tier FROM ok GROUP BY 1)
SELECT ff.recording, ff.tier, g AS "group", confident, fallback, min_lag::INT AS min_lag, max_lag::INT AS max_lag FROM ff JOIN pick ON pick.recording = ff.recording AND pick.tier = ff.tier""",
    ("sensor",),
)
def g11(spark, sf):
    s = t.sensor(spark, sf).withColumn("_mag", mag())
    prof = delay_profile(s, "ppg", {"HF": ["accx"], "ACC": ["accy", "accz"]}, "_mag", FS, win=WIN, step=STEP, start=25, threshold=None)
    return prof.select("recording", "tier", "group", "confident", "fallback", "min_lag", "max_lag")


def _filtered(wins, kind, m=5, k=1, first=0, length=None):
    """Residual of every sample of a window, numbered from 0."""
    e = sg.adaptive_filter(kind)("ppg", "accx", F.lit(0.5), F.lit(m), F.lit(k))
    wins = wins.select("recording", "window_idx", e.alias("e")).withColumn("e", F.slice("e", first + 1, length) if length else F.col("e"))
    return wins.select("recording", "window_idx", F.posexplode("e").alias("i", "e")).select("recording", "window_idx", "i", r("e", 6).alias("e"))


def _filter_sql(x, size, first, gain, out, n=WIN, start=25, cut=0):
    """A recursion over the steps of all windows at once: ``x`` are the taps of step i + 1, ``gain`` what they are weighted with."""
    k0, k1 = f"(sample_idx - {start} - {n - 1} + {STEP - 1}) // {STEP}", f"(sample_idx - {start}) // {STEP} + 1"
    z = lambda c: f"CASE WHEN list_stddev_samp({c}) > 1e-12 THEN list_transform({c}, lambda v: (v - list_avg({c})) / list_stddev_samp({c})) ELSE list_transform({c}, lambda v: v - list_avg({c})) END"
    return f"""WITH RECURSIVE cut AS (SELECT recording, sample_idx, ppg, accx, unnest(range(greatest(0, {k0})::BIGINT, ({k1})::BIGINT)) AS window_idx FROM sensor WHERE sample_idx >= {start}),
win AS (SELECT recording, window_idx, list(ppg ORDER BY sample_idx) AS ppg, list(accx::DOUBLE ORDER BY sample_idx) AS accx FROM cut GROUP BY 1, 2 HAVING count(*) = {n}),
z AS MATERIALIZED (SELECT recording, window_idx, {z('ppg')} AS d, {z('accx')} AS u FROM win),
st AS (SELECT recording, window_idx, -1 AS i, list_transform(range({size}), lambda q: 0.0::DOUBLE) AS w, 0.0::DOUBLE AS err FROM z UNION ALL
 SELECT recording, window_idx, i + 1, list_transform(range({size}), lambda q: w[q + 1] + g * x[q + 1]), err FROM (SELECT *, {gain} AS g FROM (SELECT *, d[i + {first + 2}] - list_dot_product(w, x) AS err FROM (
  SELECT st.recording, st.window_idx, st.i, st.w, z.d, {x} AS x FROM st JOIN z ON z.recording = st.recording AND z.window_idx = st.window_idx WHERE st.i + 2 + 5 <= {n})))),
told AS (SELECT recording, window_idx, unnest(range({n})) AS i, d FROM z)
SELECT told.recording, told.window_idx, (told.i - {cut})::INT AS i, {rq(out, 6)} AS e FROM told LEFT JOIN st ON st.recording = told.recording AND st.window_idx = told.window_idx AND st.i >= 0 AND st.i + {first} = told.i WHERE told.i >= {cut}"""


_TAPS = "list_reverse(z.u[st.i + 2:st.i + 7])"  # m + k = 6 of them
_QUAD = "list_reverse(z.u[st.i + 4:st.i + 7])"  # of four taps all products
_PRODUCTS = f"list_concat({_TAPS}, [" + ", ".join(f"({_QUAD})[{a + 1}] * ({_QUAD})[{b + 1}]" for a in range(4) for b in range(a + 1)) + "])"
_LMS = _filter_sql(_TAPS, 6, 4, "0.01::DOUBLE * err", "coalesce(err, 0)").replace("WHERE told.i >= 0", "WHERE told.i < 199")
_NLMS = "0.005::DOUBLE * err / (list_dot_product(x, x) + 1e-9)"


_FILTER_SQL = {
    "g12_linear_lms": _LMS,
    "g14_volterra_lms": _filter_sql(_PRODUCTS, 16, 4, "0.01::DOUBLE * err", "coalesce(err, 0)"),
    "g15_noncausal_lms": _filter_sql(_TAPS, 6, 4, _NLMS, "coalesce(err, told.d[told.i + 1])"),
}
for _name, _kind in [("g12_linear_lms", "lms"), ("g13_kernel_lms", "klms"), ("g14_volterra_lms", "volterra"), ("g15_noncausal_lms", "noncausal_lms"), ("g16_fourier_lms", "rff_lms")]:
    query(_name, _FILTER_SQL.get(_name), ("sensor",))(lambda spark, sf, _k=_kind: _filtered(_wins(spark, sf, ["ppg", "accx"]), _k))


@query("g17_adaptive_cascade")
def g17(spark, sf):
    wins = _wins(spark, sf, pad=5, padded=("accx", "accy", "accz"))
    told = ["recording", "window_idx", "delay", "m"]
    out = window_delays(wins, "ppg", ["accx", "accy", "accz"], 5, WIN, {"accx": 0, "accy": 1, "accz": 1}, 16)
    e = sg.cascade("lms")("ppg", "stages.signal", "stages.corr", "stages.k", "m")
    out = out.select(*told, F.array_join("stages.channel", "+").alias("channels"), F.posexplode(e).alias("i", "e"))
    return out.select(*told, "channels", "i", r("e", 6).alias("e"))


@query("g18_amplitude_preserving_clean")
def g18(spark, sf):
    from wristwave.plans.jobs import spo2_windows
    from wristwave.sources.recordings import from_sensor

    out = spo2_windows(from_sensor(spark, sf), FS)
    return out.select("recording", "window_idx", "adaptive_applied", F.size("clean.red").alias("n"), F.size("stages").alias("n_stages"))


def _gram_sql(deg):
    """Orthogonal polynomials of sample i on a grid of n."""
    more = [f"(i - (n - 1) / 2.0::DOUBLE) * p{k} - {k * k} * (n * n - {k * k}) / {4.0 * (4 * k * k - 1)}::DOUBLE * p{k - 1} AS p{k + 1}" for k in range(1, deg)]
    return ", ".join(["i - (n - 1) / 2.0::DOUBLE AS p1, 1.0::DOUBLE AS p0", *more])


def _poly_sql(deg, cols):
    cf = ", ".join(f"sum({c} * p{k}) / sum(p{k} * p{k}) AS {c}_{k}" for c in cols for k in range(deg + 1))
    fit = lambda c: " - ".join([c] + [f"{c}_{k} * p{k}" for k in range(deg + 1)])
    return f"""pb AS (SELECT recording, sample_idx AS i, {', '.join(cols)}, {_gram_sql(deg)} FROM hd),
cf AS (SELECT recording, {cf} FROM pb GROUP BY 1), rs AS (SELECT pb.recording, i, {', '.join(f'{fit(c)} AS {c}_res' for c in cols)} FROM pb JOIN cf USING (recording))"""


@query("g19_polynomial_detrend", f"WITH hd AS (SELECT recording, sample_idx, accx, count(*) OVER (PARTITION BY recording) AS n FROM sensor), {_poly_sql(4, ['accx'])} SELECT recording, i AS sample_idx, {rq('accx_res')} AS residual FROM rs", ("sensor",))
def g19(spark, sf):
    s = t.sensor(spark, sf).select("recording", "sample_idx", "accx")
    return sg.polynomial_residual(s, ["accx"], 4).select("recording", "sample_idx", r("accx_res").alias("residual"))


def _qc_sql(deg, body):
    return f"""WITH hd AS (SELECT recording, sample_idx, accx / 8 AS a, accy * 40 AS b, 250 AS n FROM sensor WHERE sample_idx < 250), {_poly_sql(deg, ['a', 'b'])},
sd AS (SELECT recording, count(*) AS n, stddev_pop(a_res) AS sa, stddev_pop(b_res) AS sb FROM rs GROUP BY 1),
o AS (SELECT sd.recording, n, sa, sb, count(*) FILTER (WHERE abs(a_res) > sa * 3) AS oa, count(*) FILTER (WHERE abs(b_res) > sb * 3) AS ob FROM sd JOIN rs ON rs.recording = sd.recording GROUP BY 1, 2, 3, 4)
{body}"""


_QC_SINGLE = _qc_sql(4, f"""SELECT recording, {rq('sa')} AS std_a, {rq('sb')} AS std_b, oa AS out_a, ob AS out_b, CASE WHEN n < 250 THEN 'fewer than 10 seconds of samples' WHEN length(rr) > 0 THEN rr ELSE 'ok' END AS reason
FROM (SELECT *, concat_ws('; ', CASE WHEN sa > 2.5 OR sb > 2.5 THEN 'STD > 2.5 mV' END, CASE WHEN greatest(sa, sb) / (least(sa, sb) + 1e-12) > 3 THEN 'STD ratio > 3' END,
 CASE WHEN NOT (oa / n::DOUBLE < 0.03 AND ob / n::DOUBLE < 0.03) AND greatest(oa, ob) / n::DOUBLE / (least(oa, ob) / n::DOUBLE + 1e-12) > 3 THEN 'outlier proportion ratio > 3 with at least one channel >= 3%' END) AS rr FROM o)""")
_QC_DUAL = _qc_sql(6, f"""SELECT recording, {rq('sa')} AS std_a, {rq('sb')} AS std_b, oa AS out_a, ob AS out_b, CASE WHEN n < 250 THEN 'fewer than 10 seconds of samples' WHEN sa > 5 OR sb > 5 THEN 'STD too large'
WHEN greatest(sa, sb) / (least(sa, sb) + 1e-9) > 3 THEN 'STD differs' WHEN greatest(oa, ob) / (least(oa, ob) + 1.0::DOUBLE) > 4 THEN 'outliers unbalanced' ELSE 'ok' END AS reason FROM o""")


def qc(spark, sf, profile):
    s = t.sensor(spark, sf).select("recording", "sample_idx", (F.col("accx") / 8).alias("a"), (F.col("accy") * 40).alias("b"))
    q = sg.quality_check(s, "a", "b", 250, profile)
    return q.select("recording", r("std_a").alias("std_a"), r("std_b").alias("std_b"), "out_a", "out_b", "reason")


@query("a9_quality_single", _QC_SINGLE, ("sensor",))
def a9(spark, sf):
    return qc(spark, sf, "single")


@query("a10_quality_dual", _QC_DUAL, ("sensor",))
def a10(spark, sf):
    return qc(spark, sf, "dual")


@query("g20_beat_segmentation")
def g20(spark, sf):
    wins = w.window_arrays(_two_colours(spark, sf), ["red", "ir"], 100, 25)
    seg = wins.withColumn("s", sg.segment_beats(FS)("red", "ir"))
    return seg.select("recording", "window_idx", F.explode("s.beats").alias("b")).select("recording", "window_idx", "b.*")


def _two_colours(spark, sf):
    return t.sensor(spark, sf).select("recording", "sample_idx", (F.col("ppg") * (1 - F.col("accy"))).alias("red"), (F.col("ppg") * (1 + F.col("accz"))).alias("ir"))


_G21 = """WITH b AS (SELECT recording, sample_idx, 0 AS v1, (accx::BIGINT % 5 + 1) AS p, 7 AS v2, ppg AS i1, ppg + accx * 100 AS ip, ppg * (1 + accy / 100) AS i2, ppg AS r1, ppg + accx * 100 * accz * 20 AS rp, ppg AS r2 FROM sensor),
d AS (SELECT *, i1 + (i2 - i1) * (p / v2::DOUBLE) AS dci, r1 + (r2 - r1) * (p / v2::DOUBLE) AS dcr FROM b),
a AS (SELECT *, abs(ip - dci) AS aci, abs(rp - dcr) AS acr FROM d), x AS (SELECT *, CASE WHEN aci > 1e-4 AND acr > 1e-4 AND dci > 1e-4 AND dcr > 1e-4 THEN (acr / dcr) / (aci / dci) END AS r FROM a)
SELECT recording, sample_idx, {r} AS r FROM x WHERE r > 0.05::DOUBLE AND r < 3""".replace("{r}", rq("r", 6))


@query("g21_beat_ratio", _G21, ("sensor",))
def g21(spark, sf):
    s = t.sensor(spark, sf)
    p = (F.col("accx").cast("bigint") % 5 + 1).alias("p_ir")
    b = s.select(
        "recording", "sample_idx", F.lit(0).alias("v1_ir"), p, F.lit(7).alias("v2_ir"), F.lit(0).alias("v1_red"), p.alias("p_red"), F.lit(7).alias("v2_red"),
        F.col("ppg").alias("ir_v1"), (F.col("ppg") + F.col("accx") * 100).alias("ir_p"), (F.col("ppg") * (1 + F.col("accy") / 100)).alias("ir_v2"),
        F.col("ppg").alias("red_v1"), (F.col("ppg") + F.col("accx") * 100 * F.col("accz") * 20).alias("red_p"), F.col("ppg").alias("red_v2"),
    )
    return sg.beat_ratio(b).select("recording", "sample_idx", r("r", 6).alias("r"))


@query(
    "g22_weighted_spectrum_fusion",
    f"""WITH e AS (SELECT vec_id, label, unnest(x) AS a, unnest(list_reverse(x)) AS b, unnest(range(0, 64)) AS k FROM vectors)
SELECT vec_id, k::INT AS k, {rq('a * (label / 10.0::DOUBLE) + b * (1 - label / 10.0::DOUBLE)', 6)} AS amp FROM e""",
    ("vectors",),
)
def g22(spark, sf):
    v = t.vectors(spark, sf).withColumn("y", F.reverse("x"))
    f = sg.fuse_spectra(v, ["x", "y"], [F.col("label") / 10, 1 - F.col("label") / 10], ["vec_id"])
    return f.select("vec_id", F.posexplode("fused").alias("k", "amp")).select("vec_id", "k", r("amp", 6).alias("amp"))


_G23 = """WITH RECURSIVE e AS (SELECT vec_id, label, unnest(x) AS a0, unnest(range(0, 64)) AS k FROM vectors),
b AS (SELECT vec_id, label, k, k * 0.0625::DOUBLE AS f, abs(a0) * CASE WHEN abs(k * 0.0625::DOUBLE - 1.5) < 0.2::DOUBLE OR abs(k * 0.0625::DOUBLE - 3.0) < 0.2::DOUBLE THEN 0.2::DOUBLE ELSE 1 END AS a FROM e WHERE k * 0.0625::DOUBLE > 1 AND k * 0.0625::DOUBLE < 4),
l AS (SELECT *, lag(a) OVER w AS p, lead(a) OVER w AS n FROM b WINDOW w AS (PARTITION BY vec_id ORDER BY k)), m AS (SELECT vec_id, label, f, a FROM l WHERE a > p AND a > n),
z AS (SELECT * FROM m QUALIFY a > 0.3::DOUBLE * max(a) OVER (PARTITION BY vec_id)), s AS (SELECT vec_id, label, list(f ORDER BY a DESC, f) AS f FROM z GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM s),
tr AS (SELECT label, vec_id, i, f[1] AS hr FROM o WHERE i = 1 UNION ALL SELECT o.label, o.vec_id, o.i, CASE WHEN v - hr > 10.0::DOUBLE/60 THEN hr + 7.0::DOUBLE/60 WHEN v - hr < -(10.0::DOUBLE/60) THEN hr - 7.0::DOUBLE/60 ELSE v END
FROM tr JOIN (SELECT * FROM o) o ON o.label = tr.label AND o.i = tr.i + 1, LATERAL (SELECT coalesce(list_filter(o.f[1:5], lambda q: q - tr.hr < 25.0::DOUBLE/60 AND q - tr.hr > -(25.0::DOUBLE/60))[1], tr.hr) AS v))
SELECT label, vec_id, {r} AS hr FROM tr""".replace("{r}", rq("hr", 8))


@query("g23_merged_spectrum_tracking", _G23, ("vectors",))
def g23(spark, sf):
    v = t.vectors(spark, sf)
    v = v.withColumn("amps", F.transform("x", lambda a: F.abs(a))).withColumn("mf", F.lit(1.5))
    v = sg.band_peaks(v, "amps", "freqs", 0.0625, motion_hz="mf")
    out = tr.track(v, ["label"], "vec_id", "freqs", 25 / 60, 10.0, 7.0)
    return out.select("label", "vec_id", r("hr", 8).alias("hr"))


@query("w31_prewarm_window", _filter_sql(_TAPS, 6, 4, _NLMS, "coalesce(err, told.d[told.i + 1])", WIN + 100, 0, 100), ("sensor",))
def w31(spark, sf):
    """Filter four extra seconds before each window, keep the last eight; design from the target only."""
    pre = 100
    return _filtered(w.window_arrays(t.sensor(spark, sf), ["ppg", "accx"], WIN + pre, STEP), "noncausal_lms", first=pre, length=WIN)


@query("a13_magnitude_features")
def a13(spark, sf):
    wins = w.window_arrays(t.sensor(spark, sf).withColumn("mag", mag()), ["mag"], WIN, STEP, 25)
    m = wins.select("recording", "window_idx", "mag", sg.welch_features(FS)("mag").alias("f"))
    mean = F.aggregate("mag", F.lit(0.0), lambda a, x: a + x) / WIN
    energy = F.aggregate("mag", F.lit(0.0), lambda a, x: a + x * x) / WIN
    return m.select("recording", "window_idx", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), energy - mean * mean)).alias("std"), energy.alias("energy"), "f.dominant_freq")


@query("a14_window_features")
def a14(spark, sf):
    from wristwave.operators.learn import window_features
    from wristwave.sources.recordings import from_sensor

    return window_features(from_sensor(spark, sf), FS, WIN, STEP, start=25)
