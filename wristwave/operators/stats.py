"""Error statistics, trial selection, delay aggregation and significance tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wristwave.operators.align import shifted_rows
from wristwave.operators.chunked import exact_percentiles
from wristwave.operators.windows import segment_labels
from wristwave.session import materialise

METHODS = ["lms_hf_bpm", "lms_acc_bpm", "fft_bpm", "fusion_hf_bpm", "fusion_acc_bpm"]


def error_rows(df: DataFrame, methods: list[str], ref: str, ids: list[str]) -> DataFrame:
    """Long form: ids, method, abs_err (one narrow expansion, no shuffle)."""
    items = F.array(*[F.struct(F.lit(m).alias("method"), F.abs(F.col(m) - F.col(ref)).alias("abs_err")) for m in methods])
    return df.select(*ids, F.explode(items).alias("_e")).select(*ids, "_e.method", "_e.abs_err")


def error_stats(df: DataFrame, methods=METHODS, ref="ref_bpm", motion="motion", reliable="reliable", keys=["recording"], honour_reliability=True) -> DataFrame:
    """A1 / A2: mean absolute error over all, rest and motion windows; reliable ones where any exist."""
    rows = error_rows(df, methods, ref, [*keys, motion, reliable])
    e, m, ok = F.col("abs_err"), F.col(motion) == 1, F.col(reliable) == 1
    parts = {"all": F.lit(True), "rest": ~m, "motion": m}
    aggs = [F.count_if(ok).alias("_any")]
    for n, c in parts.items():
        aggs += [F.avg(F.when(c & ok, e)).alias(f"_r_{n}"), F.avg(F.when(c, e)).alias(f"_a_{n}")]
    out = rows.groupBy(*keys, "method").agg(*aggs)
    use = (F.col("_any") > 0) if honour_reliability else F.lit(False)
    return out.select(*keys, "method", *[F.when(use, F.col(f"_r_{n}")).otherwise(F.col(f"_a_{n}")).alias(f"aae_{n}") for n in parts])


def detailed_stats(df: DataFrame, methods=METHODS, ref="ref_bpm", motion="motion", keys=["recording"], hit_bpm: float = 5.0) -> DataFrame:
    """A3: error and share within ``hit_bpm`` (inclusive), long over segments."""
    rows = error_rows(df, methods, ref, [*keys, motion])
    e, m = F.col("abs_err"), F.col(motion) == 1
    hit = F.when(e.isNotNull(), (e <= hit_bpm).cast("double"))
    aggs = []
    for n, c in {"total": F.lit(True), "rest": ~m, "motion": m}.items():
        aggs += [F.avg(F.when(c, e)).alias(f"{n}_aae"), F.avg(F.when(c, hit)).alias(f"{n}_hit_rate_5bpm")]
    return rows.groupBy(*keys, "method").agg(*aggs)


def segment_metrics(df: DataFrame, final: str, fft: str, ref: str, reliable: str, keys=["recording"], label="segment") -> DataFrame:
    """A4 on labelled windows."""
    lab, ok = F.col(label), F.col(reliable) == 1
    segs = {"rest_all": lab.isin("pre_rest", "post_rest", "other_rest"), "pre_rest": lab == "pre_rest", "post_rest": lab == "post_rest"}
    aggs = [F.count_if(ok).alias("_any")]
    for n, c in segs.items():
        for tag, col in (("", final), ("pure_fft_", fft)):
            err = F.abs(F.col(col) - F.col(ref))
            aggs += [F.avg(F.when(c & ok, err)).alias(f"_r_{tag}{n}"), F.avg(F.when(c, err)).alias(f"_a_{tag}{n}")]
        aggs += [F.count_if(c & ok).alias(f"_rn_{n}"), F.count_if(c).alias(f"_an_{n}")]
    g = df.groupBy(*keys).agg(*aggs)
    pick = lambda a, b: F.when(F.col("_any") > 0, F.col(a)).otherwise(F.col(b))
    cols = [pick(f"_r_{t}{n}", f"_a_{t}{n}").alias(f"{t}{n}_mae") for t in ("", "pure_fft_") for n in segs]
    return g.select(*keys, *cols, *[pick(f"_rn_{n}", f"_an_{n}").alias(f"n_{n}") for n in segs])


def worst_segment(df: DataFrame) -> DataFrame:
    """A5: the largest of the three rest errors, infinite when one is missing."""
    cols = [F.col("rest_all_mae"), F.col("pre_rest_mae"), F.col("post_rest_mae")]
    missing = cols[0].isNull() | cols[1].isNull() | cols[2].isNull()
    return df.withColumn("objective", F.when(missing, F.lit(float("inf"))).otherwise(F.greatest(*cols)))


def time_bias_scan(df: DataFrame, final: str, fft: str, ref: str, reliable: str, biases: list[float], keys=["recording"], order="window_idx", label="segment") -> DataFrame:
    """Metrics for every offset, best offset per key (first one on ties)."""
    slim = df.select(*keys, order, final, fft, ref, reliable, label)
    rows = shifted_rows(slim, ref, biases, keys, order).withColumnsRenamed({"v": "_ref", "bias": "time_bias_s"})
    m = worst_segment(segment_metrics(rows, final, fft, "_ref", reliable, [*keys, "time_bias_s"], label))
    best = F.min_by(F.struct(*[c for c in m.columns if c not in keys]), F.struct("objective", "time_bias_s"))
    return m.groupBy(*keys).agg(best.alias("_x")).select(*keys, "_x.*")


def best_trial(df: DataFrame, keys: list[str], value: str, order: list[str], fields: list[str], penalty: float = 999.0, failed: Column | None = None) -> DataFrame:
    """Argmin, the first trial on ties; failures count as ``penalty``."""
    v = F.col(value) if failed is None else F.when(failed, F.lit(penalty)).otherwise(F.coalesce(F.col(value), F.lit(penalty)))
    best = F.min_by(F.struct(v.alias("best_value"), *fields), F.struct(v, *order))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def lag_bounds(df: DataFrame, keys: list[str], lag: str, corr: str, lo: Column, hi: Column, min_corr=0.15, margin=2, min_span=6) -> DataFrame:
    """A8. Lags are small integers, so a count per lag value replaces the raw group (any group size)."""
    good = df.withColumn("_ok", F.abs(F.col(corr)) >= min_corr)
    n = good.groupBy(*keys).agg(F.max(lo).alias("_lo"), F.max(hi).alias("_hi"), F.count_if("_ok").alias("confident"))
    hist = good.filter("_ok").groupBy(*keys, lag).agg(F.count("*").alias("_c"))
    q = hist.groupBy(*keys).agg(F.percentile(F.col(lag).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("_c")).alias("_q"))
    out = n.join(q, keys, "left")
    q25, med, q75 = F.get("_q", F.lit(0)), F.get("_q", F.lit(1)), F.get("_q", F.lit(2))
    a, b = (F.floor(q25) - margin).cast("int"), (F.ceil(q75) + margin).cast("int")
    half = (min_span + 1) // 2
    centre = F.bround(med).cast("int")
    a2 = F.when(b - a < min_span, centre - half).otherwise(a)
    b2 = F.when(b - a < min_span, centre + half).otherwise(b)
    a3, b3 = F.greatest(F.col("_lo"), a2), F.least(F.col("_hi"), b2)
    fallback = (F.col("confident") < 2) | (a3 > b3)
    return out.select(
        *keys, "confident",
        F.when(fallback, F.col("_lo")).otherwise(a3).alias("min_lag"), F.when(fallback, F.col("_hi")).otherwise(b3).alias("max_lag"),
        F.when(fallback, F.lit(0.0)).otherwise(med).alias("median_lag"), fallback.alias("fallback"),
        F.when(F.col("confident") < 2, "insufficient confident windows").when(a3 > b3, "aggregated bounds outside default range").otherwise("ok").alias("reason"),
    )


def signed_rank(df: DataFrame, a: str, b: str, keys: list[str], ties: str | None = None) -> DataFrame:
    """Wilcoxon signed-rank, average ranks, zero differences dropped, normal approximation with tie correction.

    Ranks come from a count per distinct |difference| and a running total over those counts.
    """
    d = df.select(*keys, (F.col(a) - F.col(b)).alias("_d")).filter("_d <> 0 and _d is not null")
    per = d.groupBy(*keys, F.abs("_d").alias("_m")).agg(F.count("*").alias("_c"), F.count_if(F.col("_d") > 0).alias("_pos"))
    from wristwave.operators.chunked import Carry, carried

    bucket = F.floor(F.log1p("_m") * 1024).cast("bigint")
    ranked = carried(per, keys, ["_m"], bucket, [Carry("_before", F.col("_c"), "sum", exclusive=True)])
    rank = F.col("_before") + (F.col("_c") + 1) / 2
    c = F.col("_c").cast("double")
    g = ranked.groupBy(*keys).agg(
        F.sum("_c").alias("n"), F.sum(F.col("_pos") * rank).alias("w_plus"),
        F.sum((F.col("_c") - F.col("_pos")) * rank).alias("w_minus"), F.sum(c * c * c - c).alias("_ties"),
    )
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    out = g.withColumn("statistic", F.least("w_plus", "w_minus")).withColumn("z", (F.col("statistic") - n * (n + 1) / 4) / F.sqrt(var))
    return out.withColumnRenamed("_ties", ties) if ties else out.drop("_ties")


#: Up to so many differences without ties the exact distribution is taken.
EXACT = 50


def rank_sum_tails(sizes: DataFrame) -> DataFrame:
    """(n, tails) for rows of n up to ``EXACT``: tails[s] is the share of sign choices over ranks 1..n whose positive sum is at most s.

    The number of ways to reach each sum is folded over the ranks: a rank is left out, or shifts all sums by itself.
    """
    none = lambda k: F.array_repeat(F.lit(0.0), k)
    ways = F.aggregate(
        F.sequence(F.lit(1), F.col("n").cast("int")), F.array(F.lit(1.0)),
        lambda acc, r: F.zip_with(F.concat(acc, none(r)), F.concat(none(r), acc), lambda x, y: x + y),
    )
    running = F.aggregate("_w", F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + x)))
    few = sizes.filter(F.col("n").between(1, EXACT)).select("n").distinct()  # EXACT rows at most
    return few.withColumn("_w", ways).select("n", F.transform(running, lambda x: x / F.pow(F.lit(2.0), "n")).alias("tails"))


def signed_rank_test(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """A20 with ``p_exact``, the two-sided probability for up to ``EXACT`` differences without ties, else NULL; z is the normal form."""
    found = materialise(signed_rank(df, a, b, keys, ties="ties"), "signed-rank")
    tails = rank_sum_tails(found.filter("ties = 0"))
    met = found.join(F.broadcast(tails), "n", "left")
    p = F.least(F.lit(1.0), 2 * F.get("tails", F.col("statistic").cast("int")))
    return met.select(*found.drop("ties").columns, F.when((F.col("ties") == 0) & F.col("tails").isNotNull(), p).alias("p_exact"))


def paired_effect(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """A21"""
    d = F.col(a) - F.col(b)
    return df.groupBy(*keys).agg(((F.avg(a) - F.avg(b)) / F.stddev_pop(d)).alias("cohens_d"))


def error_quartiles(rows: DataFrame, keys: list[str], value: str = "abs_err") -> DataFrame:
    """Exact quartiles for groups of any size."""
    q = exact_percentiles(rows, keys, value, [0.25, 0.5, 0.75])
    return q.select(*keys, "n", F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(1)).alias("q50"), F.get("q", F.lit(2)).alias("q75"))


def time_features(df: DataFrame, cols: dict[str, str], keys: list[str], order: str) -> DataFrame:
    """A11 over rows already assigned to (bounded) windows: moments, range, energy, zero crossings."""
    w = W.partitionBy(*keys).orderBy(order)
    marked = df.withColumns({f"_z_{n}": (F.signum(c) != F.lag(F.signum(c)).over(w)).cast("int") for n, c in cols.items()})
    aggs = []
    for n, c in cols.items():
        x = F.col(c)
        aggs += [
            F.avg(x).alias(f"{n}_mean"), F.stddev_pop(x).alias(f"{n}_std"), F.min(x).alias(f"{n}_min"), F.max(x).alias(f"{n}_max"),
            (F.max(x) - F.min(x)).alias(f"{n}_range"), F.avg(x * x).alias(f"{n}_energy"),
            (F.sum(f"_z_{n}") / (F.count("*") - 1)).alias(f"{n}_zcr"),
            F.coalesce(F.skewness(x), F.lit(0.0)).alias(f"{n}_skewness"), F.coalesce(F.kurtosis(x), F.lit(0.0)).alias(f"{n}_kurtosis"),
        ]
    return marked.groupBy(*keys).agg(*aggs)


def channel_correlations(df: DataFrame, pairs: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """Pearson, 0 when a side is constant."""
    def c(a, b):
        const = (F.max(a) == F.min(a)) | (F.max(b) == F.min(b))
        spread = F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
        return F.when(const, F.lit(0.0)).otherwise(F.coalesce(F.covar_pop(a, b) / spread, F.lit(0.0)))
    return df.groupBy(*keys).agg(*[c(a, b).alias(f"corr_{a}_{b}") for a, b in pairs])


def short_to_long(df: DataFrame, keys: list[str], time: str, cls: str, p: str, width: float, step: float) -> DataFrame:
    """Mean class probability of short windows in [T, T + width), anchors every ``step`` from the first one."""
    t0 = df.groupBy(*keys).agg(F.min(time).alias("_t0"), F.max(time).alias("_t1"))
    from wristwave.operators.chunked import join_group, chunk_col

    rel = join_group(df, t0, keys, chunk_col(time, width * 64))
    x = F.col(time) - F.col("_t0")
    last = F.ceil((F.col("_t1") - width + step - F.col("_t0")) / step) - 1
    lo = F.greatest(F.lit(0), F.floor((x - width) / step) + 1)
    hi = F.least(F.floor(x / step), last)
    sp = rel.withColumn("_lo", lo.cast("bigint")).withColumn("_hi", hi.cast("bigint")).filter("_hi >= _lo")
    sp = sp.withColumn("anchor", F.explode(F.sequence("_lo", "_hi")))
    return sp.groupBy(*keys, "anchor", cls).agg(F.avg(p).alias("p"), F.count("*").alias("n_short"))


def labelled(df: DataFrame, motion: str = "motion") -> DataFrame:
    return segment_labels(df, F.col(motion) == 1)
