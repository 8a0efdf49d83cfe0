"""Column expressions over whole tables."""

from pyspark.sql import functions as F

from wristwave.functions import scalars as sc
from wristwave.operators.chunked import CHUNK, chunk_col, with_totals
from wristwave.plans.registry import query, r, rq
from wristwave.sources import tables as t

_IDS = ["recording", "sample_idx"]


@query(
    "p1_numeric_coercion",
    """SELECT page_id, tok, CASE WHEN isfinite(TRY_CAST(tok AS DOUBLE)) THEN TRY_CAST(tok AS DOUBLE) END AS value
FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'Infinity' WHEN page_id % 7 = 1 THEN 'NaN' ELSE regexp_replace(url, '^.*/', '') END AS tok FROM pages)""",
)
def p1(spark, sf):
    tok = (
        F.when(F.col("page_id") % 7 == 0, "Infinity").when(F.col("page_id") % 7 == 1, "NaN")
        .otherwise(F.regexp_replace("url", "^.*/", ""))
    )
    return t.table(spark, sf, "pages").select("page_id", tok.alias("tok")).withColumn("value", sc.numeric(F.col("tok")))


@query(
    "p2_valid_mask",
    "SELECT recording, sample_idx, (accz <> 0 AND accy <> 0.05::DOUBLE AND rf <> 'N') AS valid FROM sensor",
    ("sensor",),
)
def p2(spark, sf):
    s = t.sensor(spark, sf)
    chans = [F.when(F.col("accz") != 0, F.col("accz")), F.when(F.col("accy") != 0.05, F.col("accy")).otherwise(float("nan")), F.col("ppg")]
    flag = F.when(F.col("rf") != "N", 1).otherwise(0)
    return s.select(*_IDS, sc.valid_mask(chans, flag).alias("valid"))


@query("p3_negative_ppg", "SELECT recording, sample_idx, CASE WHEN ppg - 20000 >= 0 THEN ppg - 20000 END AS ppg FROM sensor", ("sensor",))
def p3(spark, sf):
    return t.sensor(spark, sf).select(*_IDS, sc.drop_negative(F.col("ppg") - 20000).alias("ppg"))


@query(
    "p4_time_axis",
    """WITH g AS (SELECT *, CASE WHEN ppg >= 950 THEN t_s + 0.5::DOUBLE END AS raw FROM sensor)
SELECT recording, sample_idx, CASE WHEN count(raw) OVER (PARTITION BY recording) = count(*) OVER (PARTITION BY recording) THEN raw ELSE sample_idx / 25.0::DOUBLE END AS time_s FROM g""",
    ("sensor",),
)
def p4(spark, sf):
    src = t.sensor(spark, sf).withColumn("raw", F.when(F.col("ppg") >= 950, F.col("t_s") + 0.5))
    return time_axis(src, "raw", 25).select(*_IDS, "time_s")


def time_axis(df, col, fs):
    """Recorded time where the whole recording has it, else index / fs."""
    parts = {"_miss": F.count_if(sc.numeric(F.col(col)).isNull())}
    out = with_totals(df, ["recording"], chunk_col("sample_idx", CHUNK), parts, {"_miss": F.sum("_miss")})
    return out.withColumn("time_s", F.when(F.col("_miss") == 0, F.col(col)).otherwise(F.col("sample_idx") / fs))


@query("p6_bridge_ratio_eps", "SELECT recording, sample_idx, accx / (accx + accy - accx + 1e-9::DOUBLE) AS ratio FROM sensor", ("sensor",))
def p6(spark, sf):
    s = t.sensor(spark, sf)
    return s.select(*_IDS, sc.bridge_ratio_eps(F.col("accx"), F.col("accx") + F.col("accy")).alias("ratio"))


@query("p7_magnitude", f"SELECT recording, sample_idx, {rq('sqrt(accx*accx + accy*accy + accz*accz)', 6)} AS mag FROM sensor", ("sensor",))
def p7(spark, sf):
    return t.sensor(spark, sf).select(*_IDS, r(sc.magnitude(F.col("accx"), F.col("accy"), F.col("accz")), 6).alias("mag"))


@query(
    "p8_ppg_modes",
    """SELECT recording, sample_idx, 'green' AS mode, ppg AS value FROM sensor UNION ALL
SELECT recording, sample_idx, 'red', ppg * (1 - accy) FROM sensor UNION ALL
SELECT recording, sample_idx, 'ir', ppg * (1 + accz) FROM sensor""",
    ("sensor",),
)
def p8(spark, sf):
    s = t.sensor(spark, sf)
    wide = s.select(*_IDS, F.col("ppg").alias("green"), (F.col("ppg") * (1 - F.col("accy"))).alias("red"), (F.col("ppg") * (1 + F.col("accz"))).alias("ir"))
    return wide.unpivot(_IDS, ["green", "red", "ir"], "mode", "value")


@query(
    "p9_hf_channels",
    """SELECT p_partkey, unnest(CASE WHEN p_size % 2 = 0 THEN ['ut1','ut2'] ELSE ['ut1','ut2','uc1','uc2'] END) AS channel FROM part""",
)
def p9(spark, sf):
    n = F.when(F.col("p_size") % 2 == 0, 2).otherwise(4)
    return t.table(spark, sf, "part").select("p_partkey", F.explode(sc.hf_channels(n)).alias("channel"))


def _raw_groups():
    pick = lambda m, v: F.when(F.col("p_size") % m == 0, v)
    return F.filter(F.array(pick(2, " hf"), pick(3, "ACC"), pick(5, "cf "), pick(4, "HF")), lambda g: g.isNotNull())


_GROUPS_SQL = """g AS (SELECT p_partkey, p_size, p_type, list_filter([CASE WHEN p_size % 2 = 0 THEN 'HF' END,
  CASE WHEN p_size % 3 = 0 THEN 'ACC' END, CASE WHEN p_size % 5 = 0 THEN 'CF' END], lambda v: v IS NOT NULL) AS o FROM part)"""


@query(
    "p10_group_order",
    f"""WITH {_GROUPS_SQL} SELECT p_partkey, CASE WHEN len(o) = 0 THEN 'FFT' ELSE array_to_string(o, '+') END AS group_key, len(o)::BIGINT AS n FROM g""",
)
def p10(spark, sf):
    p = t.table(spark, sf, "part").select("p_partkey", sc.group_order(_raw_groups()).alias("o"))
    return p.select("p_partkey", sc.group_key(F.col("o")).alias("group_key"), F.size("o").cast("bigint").alias("n"))


@query(
    "p11_method_label",
    f"""WITH {_GROUPS_SQL} SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'LMS' WHEN 'MEDIUM' THEN 'K-LMS' WHEN 'LARGE' THEN 'V-LMS'
WHEN 'PROMO' THEN 'NC-LMS' WHEN 'ECONOMY' THEN 'RFF-LMS' ELSE 'LMS' END ||
CASE WHEN len(o) = 0 THEN '' ELSE '+' || array_to_string(list_transform(o, lambda v: v[1:1]), '') END AS label FROM g""",
)
def p11(spark, sf):
    kinds = F.create_map(*[F.lit(x) for kv in [("SMALL", "lms"), ("MEDIUM", "klms"), ("LARGE", " volterra"), ("PROMO", "noncausal_lms"), ("ECONOMY", "RFF_LMS")] for x in kv])
    p = t.table(spark, sf, "part")
    return p.select("p_partkey", sc.method_label(F.coalesce(kinds[F.col("p_type")], F.lit("?")), sc.group_order(_raw_groups())).alias("label"))


@query("p14_hz_bpm", f"SELECT recording, sample_idx, (accx / 15 + 0.7::DOUBLE) * 60 AS bpm, ((accx / 15 + 0.7::DOUBLE) * 60) / 60 AS hz FROM sensor", ("sensor",))
def p14(spark, sf):
    bpm = (F.col("accx") / 15 + 0.7) * 60
    return t.sensor(spark, sf).select(*_IDS, bpm.alias("bpm"), (bpm / 60).alias("hz"))


@query(
    "p15_clock_seconds",
    """SELECT event_id, CASE WHEN event_type IN ('view','click') THEN (hour(ts)*3600 + minute(ts)*60 + second(ts))::DOUBLE
WHEN event_type = 'error' THEN value END AS seconds FROM events""",
)
def p15(spark, sf):
    ts = F.col("ts").cast("timestamp_ntz")
    clock = F.format_string("%02d:%02d:%02d", F.hour(ts), F.minute(ts), F.second(ts))
    text = F.when(F.col("event_type").isin("view", "click"), clock).when(F.col("event_type") == "error", F.col("value").cast("string")).otherwise("--")
    return t.table(spark, sf, "events").select("event_id", sc.clock_seconds(text).alias("seconds"))


@query(
    "p16_spo2_from_r",
    f"SELECT recording, sample_idx, {rq('least(100.0::DOUBLE, greatest(0.0::DOUBLE, x*x*1.5958422::DOUBLE + x*(-34.6596622::DOUBLE) + 112.6898759::DOUBLE))', 6)} AS spo2 FROM (SELECT *, accx / 14 AS x FROM sensor)",
    ("sensor",),
)
def p16(spark, sf):
    return t.sensor(spark, sf).select(*_IDS, r(sc.spo2_from_r(F.col("accx") / 14), 6).alias("spo2"))


@query(
    "p17_adaptive_step",
    """SELECT recording, sample_idx, 0.01::DOUBLE - accx / 50 / 100.0::DOUBLE AS mu_plain, greatest(1e-6::DOUBLE, 0.01::DOUBLE - accx / 50 / 100.0::DOUBLE) AS mu_clamped,
greatest(1e-6::DOUBLE, 0.01::DOUBLE - (CASE WHEN accx / 25 > 1 THEN accx / 25 / 100.0::DOUBLE ELSE accx / 25 END) / 100.0::DOUBLE) AS mu_spo2 FROM sensor""",
    ("sensor",),
)
def p17(spark, sf):
    c = F.col("accx") / 50
    return t.sensor(spark, sf).select(
        *_IDS, sc.adaptive_step(c, 0.01).alias("mu_plain"), sc.adaptive_step(c, 0.01, 1e-6).alias("mu_clamped"),
        sc.adaptive_step(F.col("accx") / 25, 0.01, 1e-6, percent=True).alias("mu_spo2"),
    )


def _delay():
    return F.col("accx").cast("int") - 25


@query(
    "p18_taps_from_delay",
    """WITH d AS (SELECT *, accx::INT - 25 AS d FROM sensor) SELECT recording, sample_idx,
least(16, greatest(1, CASE WHEN d < 0 THEN floor(abs(d))::INT ELSE 1 END)) AS m_hf,
least(16, greatest(1, CASE WHEN d < 0 THEN floor(abs(d) * 1.5)::INT ELSE 1 END)) AS m_acc FROM d""",
    ("sensor",),
)
def p18(spark, sf):
    return t.sensor(spark, sf).select(*_IDS, sc.taps_from_delay(_delay(), 16).alias("m_hf"), sc.taps_from_delay(_delay(), 16, 1.5).alias("m_acc"))


@query(
    "p19_delay_design",
    """WITH d AS (SELECT *, accx::INT - 25 AS d FROM sensor) SELECT recording, sample_idx,
CASE WHEN d > 0 THEN least(greatest(1, abs(d)), 16) ELSE 1 END AS m, CASE WHEN d < 0 THEN least(12, abs(d)) ELSE 0 END AS k,
CASE WHEN d > 0 THEN 'causal' WHEN d < 0 THEN 'noncausal' ELSE 'zero_delay' END AS mode FROM d""",
    ("sensor",),
)
def p19(spark, sf):
    return t.sensor(spark, sf).select(*_IDS, sc.delay_design(_delay(), 16, k_max=12).alias("d")).select(*_IDS, "d.m", "d.k", "d.mode")


@query("p20_order_from_delay", "SELECT recording, sample_idx, greatest(1, least(20, abs(accx::INT - 25))) AS taps FROM sensor", ("sensor",))
def p20(spark, sf):
    return t.sensor(spark, sf).select(*_IDS, sc.order_from_delay(_delay(), 1, 20).alias("taps"))


def _names():
    return F.concat(
        F.lit("multi_"),
        F.create_map(*[F.lit(x) for kv in [("SMALL", "tiaosheng"), ("MEDIUM", "wanju"), ("LARGE", "fuwo"), ("PROMO", "kaihe"), ("ECONOMY", "bobi"), ("STANDARD", "unknown")] for x in kv])[F.col("p_type")],
        F.col("p_size").cast("string"),
    )


_NAMES_SQL = """'multi_' || CASE p_type WHEN 'SMALL' THEN 'tiaosheng' WHEN 'MEDIUM' THEN 'wanju' WHEN 'LARGE' THEN 'fuwo'
WHEN 'PROMO' THEN 'kaihe' WHEN 'ECONOMY' THEN 'bobi' ELSE 'unknown' END || p_size"""


def exercise_dim(spark):
    return spark.createDataFrame(sc.EXERCISES, "prefix string, exercise string, complexity string")


@query(
    "p21_exercise_label",
    f"""WITH n AS (SELECT p_partkey, {_NAMES_SQL} AS name FROM part), d(prefix, exercise, complexity) AS (VALUES
('tiaosheng','jump_rope','simple'),('wanju','arm_curl','simple'),('fuwo','push_up','simple'),('kaihe','jumping_jack','simple'),('bobi','burpee','complex'))
SELECT p_partkey, name, exercise, complexity FROM n JOIN d ON regexp_extract(name, 'multi_([a-z]+)', 1) = prefix""",
)
def p21(spark, sf):
    names = t.table(spark, sf, "part").select("p_partkey", _names().alias("name"))
    dim = F.broadcast(exercise_dim(spark))  # five fixed rows
    return names.withColumn("prefix", sc.exercise_prefix(F.col("name"))).join(dim, "prefix").drop("prefix")


@query(
    "p22_decode_params",
    """SELECT study, trial, [25.0::DOUBLE, 50.0, 100.0][(trial % 3 + 1)] AS fs_target, [12.0::DOUBLE, 16.0, 20.0][(trial % 2 + 1)] AS max_order FROM trials""",
    ("trials",),
)
def p22(spark, sf):
    tr = t.trials(spark, sf)
    return tr.select(
        "study", "trial",
        sc.decode_option([25, 50, 100], (F.col("trial") % 3).cast("int")).alias("fs_target"),
        sc.decode_option([12, 16, 20], (F.col("trial") % 2).cast("int")).alias("max_order"),
    )


@query(
    "p23_safe_prefix",
    """SELECT p_partkey, CASE WHEN length(c) > 0 THEN c ELSE 'v2-run' END AS prefix FROM (SELECT p_partkey,
regexp_replace(regexp_replace(concat_ws('-', p_name, p_brand, lower(p_type), '.'), '[^A-Za-z0-9_.+-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS c FROM part)""",
)
def p23(spark, sf):
    p = t.table(spark, sf, "part")
    return p.select("p_partkey", sc.safe_prefix(F.col("p_name"), F.col("p_brand"), F.lower("p_type"), F.lit(".")).alias("prefix"))


def _reports():
    return F.concat(
        F.when(F.col("p_size") % 2 == 0, "Best_Params_Result_").otherwise(""), F.regexp_replace("p_name", " ", "_"),
        F.when(F.col("p_size") % 3 == 0, "-green").otherwise(""), F.when(F.col("p_size") % 5 == 0, "-lms").otherwise("-x"),
        F.when(F.col("p_size") % 7 == 0, "-full").otherwise(""), F.when(F.col("p_size") % 4 == 0, "-best_params").otherwise(""),
    )


_REPORTS_SQL = """CASE WHEN p_size % 2 = 0 THEN 'Best_Params_Result_' ELSE '' END || replace(p_name, ' ', '_') ||
CASE WHEN p_size % 3 = 0 THEN '-green' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN '-lms' ELSE '-x' END ||
CASE WHEN p_size % 7 = 0 THEN '-full' ELSE '' END || CASE WHEN p_size % 4 = 0 THEN '-best_params' ELSE '' END"""
STEMS_SQL = f"""rep AS (SELECT p_partkey, p_size, {_REPORTS_SQL} AS report FROM part),
st AS (SELECT *, regexp_replace(regexp_replace(report, '^Best_Params_Result_', ''), '-best_params$', '') AS stem FROM rep),
w AS (SELECT p_partkey, p_size, report, stem, string_split(stem, '-') AS parts FROM st),
steps AS (SELECT p_partkey, 0 AS pos, stem AS cand FROM w UNION ALL
  SELECT p_partkey, k, array_to_string(parts[1:len(parts)-k], '-') FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM w)
  WHERE len(list_filter(parts[len(parts)-k+1:], lambda v: v NOT IN ('full','motion','lms','klms','volterra','green','red','ir','hf2','hf4'))) = 0 UNION ALL
  SELECT p_partkey, 100, left(stem, length(stem) - 5) FROM w WHERE stem LIKE '%-full' UNION ALL
  SELECT p_partkey, 101, left(stem, length(stem) - 7) FROM w WHERE stem LIKE '%-motion'),
cands AS (SELECT p_partkey, cand, row_number() OVER (PARTITION BY p_partkey ORDER BY min(pos)) - 1 AS pos FROM steps GROUP BY p_partkey, cand)"""


def report_stems(spark, sf):
    p = t.table(spark, sf, "part").select("p_partkey", "p_size", _reports().alias("report"))
    return p.select("p_partkey", "p_size", "report", F.posexplode(sc.candidate_stems(F.col("report"))).alias("pos", "cand"))


@query("p24_candidate_stems", f"WITH {STEMS_SQL} SELECT p_partkey, pos::INT AS pos, cand FROM cands")
def p24(spark, sf):
    return report_stems(spark, sf).select("p_partkey", "pos", "cand")


@query(
    "p25_slew_limit",
    """SELECT recording, sample_idx, CASE WHEN v - p > 10.0::DOUBLE/60 THEN p + 7.0::DOUBLE/60 WHEN v - p < -(10.0::DOUBLE/60) THEN p - 7.0::DOUBLE/60 ELSE v END AS hr
FROM (SELECT *, accx / 15 AS p, ppg / 30000 AS v FROM sensor)""",
    ("sensor",),
)
def p25(spark, sf):
    out = sc.slew(F.col("ppg") / 30000, F.col("accx") / 15, F.lit(10.0 / 60), F.lit(7.0 / 60))
    return t.sensor(spark, sf).select(*_IDS, out.alias("hr"))


@query("p26_relative_improvement", "SELECT recording, sample_idx, CASE WHEN accz > 0 THEN (accz - accy) / accz * 100 END AS pct FROM sensor", ("sensor",))
def p26(spark, sf):
    return t.sensor(spark, sf).select(*_IDS, sc.relative_improvement(F.col("accy"), F.col("accz")).alias("pct"))


@query(
    "p27_acceptance",
    "SELECT recording, sample_idx, (rf <> 'N' AND accx < 1.5 * 20 AND accy * 20 < 1.5 AND accz * 20 < 1.5) AS passed FROM sensor",
    ("sensor",),
)
def p27(spark, sf):
    vals = [F.when(F.col("rf") != "N", F.col("accx") / 20).otherwise(float("nan")), F.col("accy") * 20, F.col("accz") * 20]
    return t.sensor(spark, sf).select(*_IDS, sc.accepted(vals).alias("passed"))


@query(
    "s2_layout_detection",
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'timeline_csv' WHEN p_type = 'SMALL' AND p_size % 5 <> 0 THEN 'compact_raw_csv' ELSE 'legacy_csv' END AS kind FROM part""",
)
def s2(spark, sf):
    add = lambda cond, text: F.when(cond, F.lit(text))
    header = F.concat_ws(
        ",", F.lit("PPG_Green"), add(F.col("p_type") == "SMALL", "Time(s)"), add(F.col("p_size") % 5 != 0, "MissingBefore"),
        add(F.col("p_size") % 2 == 0, "ValidFlag"), add(F.col("p_size") % 3 == 0, "InterpFlag,GapLen"),
    )
    return t.table(spark, sf, "part").select("p_partkey", sc.layout_kind(header).alias("kind"))
