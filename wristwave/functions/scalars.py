"""Column expressions: coercion, masks, ratios, labels, delays and limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values of the domain (must equal the published ones) ----
SENSOR_COLUMNS = {
    "uc1": "Uc1(mV)", "uc2": "Uc2(mV)", "ut1": "Ut1(mV)", "ut2": "Ut2(mV)",
    "accx": "AccX(g)", "accy": "AccY(g)", "accz": "AccZ(g)",
    "gyrox": "GyroX(dps)", "gyroy": "GyroY(dps)", "gyroz": "GyroZ(dps)",
    "ppg_green": "PPG_Green", "ppg_red": "PPG_Red", "ppg_ir": "PPG_IR",
}
REFERENCE_GROUPS = ["HF", "CF", "ACC"]
GROUP_CHANNELS = {"HF": ["hf1", "hf2"], "CF": ["cf1", "cf2"], "ACC": ["accx", "accy", "accz"]}
FILTER_LABELS = {"lms": "LMS", "klms": "K-LMS", "volterra": "V-LMS", "noncausal_lms": "NC-LMS", "rff_lms": "RFF-LMS"}
REPORT_TOKENS = ["full", "motion", "lms", "klms", "volterra", "green", "red", "ir", "hf2", "hf4"]
EXERCISES = [
    ("tiaosheng", "jump_rope", "simple"), ("wanju", "arm_curl", "simple"), ("fuwo", "push_up", "simple"),
    ("kaihe", "jumping_jack", "simple"), ("bobi", "burpee", "complex"),
]
SPO2_COEFFICIENTS = (1.5958422, -34.6596622, 112.6898759)
# --------------------------------------------------------------------


def numeric(c: Column) -> Column:
    """Unparsable and non-finite values become NULL."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def valid_mask(channels: list[Column], flag: Column | None = None) -> Column:
    ok = F.lit(True)
    for c in channels:
        ok = ok & numeric(c).isNotNull()
    return ok if flag is None else ok & F.coalesce(numeric(flag) > 0, F.lit(False))


def drop_negative(c: Column) -> Column:
    return F.when(c >= 0, c)


def bridge_ratio_eps(uc: Column, ut: Column) -> Column:
    return uc / (ut - uc + F.lit(1e-9))


def bridge_ratio(uc: Column, ut: Column) -> Column:
    """Cold-film ratio, missing where the denominator vanishes."""
    d = ut - uc
    return F.when(F.abs(d) >= 1e-9, uc / d)


def magnitude(*axes: Column) -> Column:
    total = axes[0] * axes[0]
    for a in axes[1:]:
        total = total + a * a
    return F.sqrt(total)


def ppg_mode(mode: Column, green: Column, red: Column, ir: Column) -> Column:
    m = F.lower(F.trim(mode))
    return (
        F.when(m == "green", green).when(m == "red", red).when(m.isin("ir", "infrared"), ir)
        .otherwise(F.raise_error(F.concat(F.lit("unsupported ppg mode: "), mode)))
    )


def hf_channels(count: Column) -> Column:
    two = F.array(F.lit("ut1"), F.lit("ut2"))
    four = F.array(F.lit("ut1"), F.lit("ut2"), F.lit("uc1"), F.lit("uc2"))
    return F.when(count == 2, two).when(count == 4, four).otherwise(
        F.raise_error(F.lit("cascade channel count must be 2 or 4"))
    )


def group_order(raw: Column) -> Column:
    known = F.array(*[F.lit(g) for g in REFERENCE_GROUPS])
    norm = F.transform(raw, lambda g: F.upper(F.trim(g)))
    bad = F.filter(norm, lambda g: ~F.array_contains(known, g))
    return F.when(F.size(bad) == 0, F.array_distinct(norm)).otherwise(
        F.raise_error(F.lit("unsupported reference group"))
    )


def group_key(order: Column) -> Column:
    return F.when(F.size(order) > 0, F.array_join(order, "+")).otherwise(F.lit("FFT"))


def method_label(filter_type: Column, order: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in FILTER_LABELS.items() for x in kv])
    algo = F.coalesce(names[F.lower(F.trim(filter_type))], F.lit("LMS"))
    initials = F.array_join(F.transform(order, lambda g: F.substring(g, 1, 1)), "")
    return F.when(F.size(order) > 0, F.concat(algo, F.lit("+"), initials)).otherwise(algo)


def clock_seconds(text: Column) -> Column:
    """``HH:MM:SS`` or a plain number of seconds, else NULL."""
    t = F.trim(text)
    parts = F.split(t, ":")
    at = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    clock = at(0) * 3600 + at(1) * 60 + at(2)
    return F.coalesce(F.when(F.size(parts) == 3, clock), numeric(t))


def spo2_from_r(r: Column) -> Column:
    a, b, c = SPO2_COEFFICIENTS
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), r * r * a + r * b + c))


def adaptive_step(corr: Column, mu_base: float, mu_min: float | None = None, percent: bool = False) -> Column:
    """``mu_base - corr/100``; clamped when ``mu_min`` is given; ``percent`` rescales corr > 1."""
    c = F.when(corr > 1.0, corr / 100.0).otherwise(corr) if percent else corr
    mu = F.lit(mu_base) - c / 100.0
    return mu if mu_min is None else F.greatest(F.lit(mu_min), mu)


def taps_from_delay(delay: Column, max_order: int, scale: float = 1.0) -> Column:
    m = F.when(delay < 0, F.floor(F.abs(delay) * scale)).otherwise(F.lit(1)).cast("int")
    return F.least(F.lit(max_order), F.greatest(F.lit(1), m))


def delay_design(delay: Column, max_order: int, m_base: int = 1, c_scale: float = 1.0, k_max: int | None = None) -> Column:
    """Struct (m, k, mode) of a delay in samples."""
    k_cap = max_order if k_max is None else k_max
    span = F.floor(F.abs(delay) * c_scale).cast("int")
    base = F.lit(max(1, m_base))
    return F.struct(
        F.when(delay > 0, F.least(F.greatest(F.lit(1), span), F.lit(max_order))).otherwise(base).alias("m"),
        F.when(delay < 0, F.least(F.lit(k_cap), span)).otherwise(F.lit(0)).alias("k"),
        F.when(delay > 0, F.lit("causal")).when(delay < 0, F.lit("noncausal")).otherwise(F.lit("zero_delay")).alias("mode"),
    )


def order_from_delay(delay: Column, min_order: int, max_order: int) -> Column:
    return F.greatest(F.lit(min_order), F.least(F.lit(max_order), F.abs(delay))).cast("int")


def exercise_prefix(name: Column) -> Column:
    return F.regexp_extract(name, r"multi_([a-z]+)", 1)


def decode_option(options: list[float], idx: Column) -> Column:
    arr = F.array(*[F.lit(float(o)) for o in options])
    return F.when((idx >= 0) & (idx < len(options)), F.get(arr, idx)).otherwise(
        F.raise_error(F.lit("parameter index out of range"))
    )


def safe_prefix(*parts: Column) -> Column:
    raw = F.concat_ws("-", *parts)
    clean = F.regexp_replace(raw, r"[^A-Za-z0-9_.+-]+", "_")
    clean = F.regexp_replace(clean, r"^[._-]+|[._-]+$", "")
    return F.when(F.length(clean) > 0, clean).otherwise(F.lit("v2-run"))


def candidate_stems(report: Column) -> Column:
    """Ordered unique data stems a report name may belong to."""
    stem = F.regexp_replace(F.regexp_replace(report, "^Best_Params_Result_", ""), "-best_params$", "")
    known = F.array(*[F.lit(t) for t in REPORT_TOKENS])
    parts = F.split(stem, "-")
    last_other = F.array_max(
        F.transform(parts, lambda t, i: F.when(F.array_contains(known, t), F.lit(0)).otherwise(i + 1))
    )
    keep = F.reverse(F.sequence(F.greatest(last_other, F.lit(1)), F.size(parts)))
    shorter = F.transform(keep, lambda k: F.array_join(F.slice(parts, F.lit(1), k), "-"))
    cut = lambda s: F.when(F.endswith(stem, F.lit(s)), F.array(F.substring(stem, F.lit(1), F.length(stem) - len(s))))
    empty = F.array().cast("array<string>")
    return F.array_distinct(
        F.concat(F.array(stem), shorter, F.coalesce(cut("-full"), empty), F.coalesce(cut("-motion"), empty))
    )


def slew(value: Column, prev: Column, limit: Column, step: Column) -> Column:
    return (
        F.when(value - prev > limit, prev + step).when(value - prev < -limit, prev - step).otherwise(value)
    )


def relative_improvement(hf: Column, acc: Column) -> Column:
    return F.when(acc > 0, (acc - hf) / acc * 100)


def accepted(values: list[Column], threshold: float = 1.5) -> Column:
    ok = F.lit(True)
    for v in values:
        ok = ok & F.coalesce(numeric(v) < threshold, F.lit(False))
    return ok


def layout_kind(header: Column) -> Column:
    names = F.transform(F.split(header, ","), lambda x: F.trim(x))
    has = lambda *cols: F.size(F.array_intersect(names, F.array(*[F.lit(c) for c in cols]))) == len(cols)
    return (
        F.when(has("ValidFlag", "InterpFlag", "GapLen"), "timeline_csv")
        .when(has("Time(s)", "MissingBefore"), "compact_raw_csv")
        .otherwise("legacy_csv")
    )
