"""Chunk invariance, skew-shaped inputs and end-to-end physics."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wristwave.operators import align as al
from wristwave.operators import chunked as ck
from wristwave.operators import clean, signal as sg, tracking as tr, windows as w
from wristwave.plans import jobs as j


def series(n=1000, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    return pd.DataFrame({"recording": "a", "sample_idx": np.arange(n), "x": x, "flag": rng.random(n) > 0.2, "gap": np.where(rng.random(n) < 0.4, np.nan, x)})


def col(df, name, order="sample_idx"):
    return df.toPandas().sort_values(order)[name].to_numpy()


@pytest.mark.parametrize("size", [7, 64, 5000])
def test_fill_is_chunk_invariant(spark, size):
    pdf = series()
    df = spark.createDataFrame(pdf).withColumn("g", F.when(~F.isnan("gap"), F.col("gap")))
    got = col(clean.fill_linear_nearest(df, {"g": F.col("g")}, size=size), "g")
    ok = ~np.isnan(pdf["gap"].to_numpy())
    want = np.interp(pdf["sample_idx"], pdf["sample_idx"][ok], pdf["gap"][ok])
    assert np.allclose(got, want)


@pytest.mark.parametrize("size", [5, 33, 5000])
def test_runs_are_chunk_invariant(spark, size):
    pdf = series()
    f = pdf["flag"].to_numpy()
    edges = np.flatnonzero(np.diff(np.r_[0, f.astype(int), 0]))
    want = sorted(zip(edges[::2], edges[1::2] - 1))
    got = ck.runs(spark.createDataFrame(pdf), ["recording"], "sample_idx", F.col("flag"), size).toPandas()
    assert sorted(zip(got["run_start"], got["run_end"])) == want


def test_number_rows(spark):
    pdf = pd.DataFrame({"k": [1] * 500 + [2] * 20, "o": list(range(500))[::-1] + list(range(20))})
    got = ck.number_rows(spark.createDataFrame(pdf).repartition(4), "k", ["o"], "i", "t").toPandas()
    assert (got["i"] == got["o"]).all() and len(got) == 520


def test_number_rows_moves_rows_once(spark):
    """Keys over many partitions and batches, a key in the middle of one, missing keys; sorted rows meet one number a partition only."""
    rows = [(k, o) for k, n in ((1, 3000), (2, 1), (3, 9000), (None, 700)) for o in range(n)]
    df = spark.createDataFrame(rows, "k long, o long").withColumn("v", F.col("o") * 2).repartition(7, "o")
    got = ck.number_rows(df, "k", ["o"], "i", "t", ["v"])
    assert got.columns == ["k", "v", "i"]
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(((r.k is None, r.k or 0), r.i, r.v) for r in got.collect()) == sorted(((k is None, k or 0), o, 2 * o) for k, o in rows)


def test_grid_is_expanded_by_many_tasks(spark):
    """Few short rows that become many: every task expands its share only."""
    got = al.grid(spark.range(300).withColumnRenamed("id", "recording"), ["recording"], F.lit(700), "k").withColumn("task", F.spark_partition_id())
    per = got.groupBy("task").count().collect()
    assert sum(r["count"] for r in per) == 300 * 700 and max(r["count"] for r in per) < 300 * 700 / spark.sparkContext.defaultParallelism
    assert got.select("recording", "k").distinct().count() == 300 * 700


@pytest.mark.parametrize("bits", [8, 16])
def test_exact_percentiles(spark, bits):
    """Duplicates, one and two rows, both zeros, signs, infinities and values of every size."""
    rng = np.random.default_rng(1)
    groups = {
        "a": np.round(rng.normal(size=5000), 2), "b": np.arange(7.0), "c": [3.5], "d": [-1.0, 2.0], "e": [0.0, -0.0, 0.0, -0.0],
        "f": np.r_[rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), np.full(200, -7e-310)], "g": np.r_[np.inf, -np.inf, np.arange(9.0)], "h": np.full(1000, 1 / 3),
    }
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    pdf = pd.DataFrame([(g, float(x)) for g, v in groups.items() for x in v], columns=["g", "v"])
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([("a", None)], "g string, v double"))
    got = {r.g: r for r in ck.exact_percentiles(df.repartition(4), ["g"], "v", probs, bits).collect()}
    for g, v in groups.items():
        x, want = sorted(map(float, v)), []
        for p in probs:
            h = p * (len(x) - 1)
            a, b = x[int(np.floor(h))], x[int(np.ceil(h))]
            want.append(a if a == b else a + (b - a) * (h - np.floor(h)))
        assert got[g].n == len(v) and np.allclose(got[g].q, want, rtol=1e-12, atol=0)
    whole = ck.exact_percentiles(df.filter("g in ('a', 'b')"), [], "v", [0.5]).first()
    assert whole.n == 5007 and whole.q == [np.median(np.r_[groups["a"], groups["b"]])]
    assert ck.exact_percentiles(df.limit(0), ["g"], "v", probs).count() == 0


def test_tracker_settles_like_one_pass(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"recording": "a", "window_idx": np.arange(300), "freqs": [list(rng.uniform(0.8, 3.0, size=3)) for _ in range(300)]})
    df = spark.createDataFrame(pdf)
    one = col(tr.track(df, ["recording"], "window_idx", "freqs", 0.3, 6.0, 4.0, size=1000), "hr", "window_idx")
    many = col(tr.track(df, ["recording"], "window_idx", "freqs", 0.3, 6.0, 4.0, size=16), "hr", "window_idx")
    assert np.array_equal(one, many)


def test_band_pass_frames_match_whole(spark):
    pdf = series(6000)
    df = spark.createDataFrame(pdf[["recording", "sample_idx", "x"]])
    whole = col(sg.band_pass(df, ["x"], 25, halo_s=40.0), "x")
    old, sg.FRAME = sg.FRAME, 1500
    try:
        parts = sg._unframe(
            sg.sample_frames(df, ["x"], 1500, 1000).withColumn("x", sg._rows_udf(_filter)("x")), ["x"], 1500, ["recording"], "sample_idx")
        assert np.abs(col(parts, "x") - whole).max() < 1e-6
    finally:
        sg.FRAME = old


def _filter(rows):
    from wristwave.functions import kernels as kn

    return kn.zero_phase_rows(rows, *kn.butterworth(4, 0.5, 5.0, 25.0))


def test_resample_keeps_tone(spark):
    t = np.arange(2000) / 100
    df = spark.createDataFrame(pd.DataFrame({"recording": "a", "sample_idx": np.arange(2000), "x": np.sin(2 * np.pi * 1.2 * t)}))
    got = col(sg.resample(df, ["x"], 25, 100), "x")
    assert len(got) == 500 and np.abs(got - np.sin(2 * np.pi * 1.2 * np.arange(500) / 25))[50:-50].max() < 5e-3


def recording(n=8000):
    """72 BPM with a motion stretch at 1.5 Hz between 35 s and 55 s, 100 Hz."""
    t = np.arange(n) / 100
    acc = np.where((t >= 35) & (t <= 55), 0.8 * np.sin(2 * np.pi * 1.5 * t), 0.0)
    ppg = 1000 + 20 * np.sin(2 * np.pi * 1.2 * t)
    return pd.DataFrame({
        "recording": "a", "sample_idx": np.arange(n), "ppg_green": ppg + 10 * acc, "ppg_red": ppg, "ppg_ir": ppg,
        "uc1": 1 + 0.01 * np.sin(t), "uc2": 1.1 + 0.01 * np.cos(t), "ut1": 5 + 0.2 * acc, "ut2": 5.5 + 0.1 * acc,
        "accx": acc, "accy": 0.0, "accz": 1.0, "gyrox": 0.0, "gyroy": 0.0, "gyroz": 0.0, "valid": True,
    })


def test_heart_rate_dual(spark):
    ref = spark.createDataFrame(pd.DataFrame({"recording": "a", "t_s": np.arange(0.0, 90.0), "bpm": 72.0}))
    res = j.estimate_hr_dual(spark.createDataFrame(recording()), ref)
    out = res.windows.toPandas().sort_values("window_idx")
    assert len(out) == 70 and out["motion"].sum() > 10
    assert np.allclose(out["ref"] * 60, 72.0)
    rest = out[out["motion"] == 0]
    assert (np.abs(rest["fft"] * 60 - 72) < 2).mean() > 0.9
    err = res.errors.toPandas().set_index("method")
    assert err.loc["fusion_hf", "aae_all"] < 6


def test_heart_rate_single_rest_only_falls_back(spark):
    pdf = recording()
    pdf[["accx", "accy", "accz"]] = 0.0
    pdf["ppg_green"] = pdf["ppg_red"]
    ref = spark.createDataFrame(pd.DataFrame({"recording": "a", "t_s": np.arange(0.0, 90.0), "bpm": 72.0}))
    out = j.estimate_hr_single(spark.createDataFrame(pdf), ref).windows.toPandas()
    assert len(out) == 70 and not out["used_adaptive"].any() and np.abs(out["final_hr_bpm"] - 72).max() < 2


def test_spo2_ratio(spark):
    t = np.arange(3000) / 100
    pdf = recording(3000)
    pdf["ppg_red"], pdf["ppg_ir"] = 900 + 9 * np.sin(2 * np.pi * 1.2 * t), 800 + 16 * np.sin(2 * np.pi * 1.2 * t)
    pdf[["accx", "accy"]], pdf["accz"] = 0.0, 1.0
    res = j.estimate_spo2(spark.createDataFrame(pdf), 100)
    out = res.windows.toPandas()
    assert len(out) == 27 and not out["adaptive_applied"].any() and out["reliable"].all()
    r = out["raw_r_median"].dropna()
    assert np.abs(r - (9 / 900) / (16 / 800)).median() < 0.05
    assert ((out["spo2"] > 90) & (out["spo2"] <= 100)).all()
    wave = res.waveforms.toPandas()
    assert len(wave) == 3000 and np.allclose(wave["red_raw"], wave["red_clean"])
