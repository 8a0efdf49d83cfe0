"""Jobs on recordings with gaps, sweeps against single runs, stored reports, missing references."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from tests.test_operators import recording
from wristwave.plans import jobs as j


@pytest.fixture(scope="module")
def ref(spark):
    return spark.createDataFrame(pd.DataFrame({"recording": "a", "t_s": np.arange(0.0, 90.0), "bpm": 72.0}))


def gappy():
    pdf = recording()
    channels = [c for c in pdf.columns if c not in ("recording", "sample_idx", "valid")]
    pdf.loc[40:44, channels] = np.nan
    pdf.loc[40:44, "valid"] = False
    return pdf


def gaps_as_null(spark, pdf):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pdf)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def test_short_gap_changes_nothing(spark, ref):
    whole = j.estimate_hr_dual(spark.createDataFrame(recording()), ref).windows.toPandas().sort_values("window_idx")
    holed = j.estimate_hr_dual(gaps_as_null(spark, gappy()), ref).windows.toPandas().sort_values("window_idx")
    assert holed["motion"].tolist() == whole["motion"].tolist() and holed["motion"].sum() > 10
    assert np.abs(holed["fusion_hf"] - whole["fusion_hf"]).max() * 60 < 2


def test_sweep_is_single_runs(spark, ref):
    samples = spark.createDataFrame(recording())
    grid = [{"penalty_enable": False, "acc_channels": 1}, {"repair": False, "smooth_win_len": 5, "time_bias": 3.0}]
    got = j.parameter_sweep(samples, ref, j.HrParams(), grid).toPandas()
    for i, g in enumerate(grid):
        want = j.estimate_hr_dual(samples, ref, replace(j.HrParams(), **g)).errors.toPandas().set_index("method")["aae_all"]
        mine = got[got["trial"] == i].set_index("method")["aae_all"]
        assert mine["fusion_hf"] == pytest.approx(want["fusion_hf"]) and mine["fusion_acc"] == pytest.approx(want["fusion_acc"])


def test_reports_keep_every_field(spark, ref):
    samples = spark.createDataFrame(recording())
    stored = {"HF_best": {"smooth_win_len": 5, "penalty_weight": 0.9, "hr_range_hz": 0.4}, "ACC_best": {"max_order": 8}}
    rows = [{"recording": "a", "case_name": c, **{n: s.get(n) for n in ("smooth_win_len", "penalty_weight", "hr_range_hz", "max_order")}} for c, s in stored.items()]
    reports = spark.createDataFrame(rows, "recording string, case_name string, smooth_win_len int, penalty_weight double, hr_range_hz double, max_order int")
    got = j.re_evaluate(samples, ref, reports, j.HrParams()).errors.toPandas()
    for case, s in stored.items():
        want = j.estimate_hr_dual(samples, ref, replace(j.HrParams(), **s)).errors.toPandas().set_index("method")["aae_all"]
        mine = got[got["case_name"] == case].set_index("method")["aae_all"]
        assert mine["fusion_hf"] == pytest.approx(want["fusion_hf"])


def test_no_reference_is_missing(spark, ref):
    samples = spark.createDataFrame(recording())
    none = ref.filter("false")
    rows = j.estimate_hr_single(samples, none).windows.toPandas()
    assert len(rows) == 70 and rows["ref_hr_bpm"].isna().all()
    batch = j.batch_estimate(samples, none, modes=["ppg_green"]).toPandas()
    assert batch["status"].tolist() == ["no_reference"] and batch["final_aae_bpm"].isna().all()


def test_modes_share_conditioning(spark, ref, monkeypatch):
    """a batch cleans a recording once for all modes, keeps no table of a cleaning step, and gives each mode's own run."""
    from wristwave.session import made_tables

    asked, before, clean = [], set(made_tables(spark)), j.clean.clean_signal
    monkeypatch.setattr(j.clean, "clean_signal", lambda df, cols, fs, keys: asked.append((list(keys), list(cols))) or clean(df, cols, fs, keys))
    samples, modes = spark.createDataFrame(recording()), ["ppg_green", "ppg_red"]
    got = j.batch_estimate(samples, ref, modes=modes).toPandas().set_index("mode")
    optical = [keys for keys, cols in asked if any(c.startswith("ppg") for c in cols)]
    assert optical == [["recording"]]
    kept = {t.rsplit("/", 1)[1].split("-")[0] for t in made_tables(spark) if t not in before}
    assert "conditioned" in kept and not kept & {"filled", "cleaned"}
    for m in modes:
        want = j.estimate_hr_single(samples, ref, replace(j.SINGLE, ppg_mode=m)).errors.toPandas().set_index("method")["aae_all"]
        assert got.loc[m, "fft_aae_bpm"] == pytest.approx(want["fft"]) and got.loc[m, "final_aae_bpm"] == pytest.approx(want["final"])


def test_sweep_finishes_trials_together(spark, ref, monkeypatch):
    """whatever trials smooth and shift by, reference and quality are asked once a recording, and errors are each trial's own."""
    asked, at = [], j.reference_at
    monkeypatch.setattr(j, "reference_at", lambda df, ref, keys, *more: asked.append(list(keys)) or at(df, ref, keys, *more))
    samples = spark.createDataFrame(recording())
    grid = [{"smooth_win_len": s, "time_bias": b, "hr_range_hz": 0.4} for s, b in ((5, 3.0), (9, 3.0), (5, 4.5))]
    got = j.parameter_sweep(samples, ref, j.HrParams(), grid).toPandas()
    assert asked == [["recording"]] and len(got) == 6
    want = j.estimate_hr_dual(samples, ref, replace(j.HrParams(), **grid[2])).errors.toPandas().set_index("method")["aae_all"]
    mine = got[got["trial"] == 2].set_index("method")["aae_all"]
    assert mine["fusion_hf"] == pytest.approx(want["fusion_hf"]) and mine["fusion_acc"] == pytest.approx(want["fusion_acc"])


def test_experts_share_conditioning(spark, ref, monkeypatch):
    """experts that differ in taps, tracking and smoothing clean a recording once, and each has its own run's estimate."""
    from pyspark.sql import functions as F

    asked, clean = [], j.clean.clean_signal
    monkeypatch.setattr(j.clean, "clean_signal", lambda df, cols, fs, keys: asked.append(list(cols)) or clean(df, cols, fs, keys))
    pdf = recording()
    pdf["ut1"] = 5 + 0.2 * np.roll(pdf["accx"], -14)  # ahead of the optical signal, so taps are several
    pdf["ut2"] = 5.5 + 0.1 * np.roll(pdf["accx"], -10)
    samples = spark.createDataFrame(pdf)
    experts = {"one": j.HrParams(), "two": replace(j.HrParams(), max_order=1, smooth_win_len=9, hr_range_hz=0.3)}
    shares = samples.select("recording", (F.col("sample_idx") / 100).cast("long").alias("window_idx")).distinct().select(
        "recording", "window_idx", F.explode(F.array(*[F.struct(F.lit(e).alias("class"), F.lit(p).alias("p")) for e, p in zip(experts, (0.5, 0.2))])).alias("e")).select("recording", "window_idx", "e.*")
    got = j.multi_motion_fusion(samples, ref, shares, experts)[0].toPandas().sort_values("window_idx")
    assert sum(any(c.startswith("ppg") for c in cols) for cols in asked) == 1
    want = j.estimate_hr_dual(samples, ref, experts["two"]).windows.toPandas().sort_values("window_idx")
    assert got["two"].tolist() == pytest.approx(want["fusion_hf"].tolist(), abs=1e-9) and got["motion"].tolist() == want["motion"].tolist()
    assert (got["one"] != got["two"]).any()


def test_sweep_filters_again_for_other_tap_limits_only(spark, ref):
    """a sweep over tap limits has the candidates of each limit's own run, on both paths."""
    pdf = recording()
    pdf["ut1"] = 5 + 0.2 * np.roll(pdf["accx"], -14)
    samples = spark.createDataFrame(pdf)
    peaks = j.peak_table_dual(samples, j.HrParams(), ["recording"], [1, 16]).toPandas().sort_values("window_idx")
    want = j.peak_table_dual(samples, replace(j.HrParams(), max_order=1), ["recording"]).toPandas().sort_values("window_idx")
    for c in ("f_hf", "f_acc"):
        assert [list(x[0]) for x in peaks[c]] == [list(x) for x in want[c]]
    assert any(list(x[0]) != list(x[1]) for x in peaks["f_hf"])


def test_expert_spectra_share_the_delay_search(spark, monkeypatch):
    """F16: the references are ranked once for all experts, and an expert of fewer taps has the spectra of its own run."""
    from pyspark.sql import functions as F

    asked, search = [], j.window_delays
    monkeypatch.setattr(j, "window_delays", lambda *a, **o: asked.append(1) or search(*a, **o))
    pdf = recording()
    pdf["ut1"] = 5 + 0.2 * np.roll(pdf["accx"], -14)
    samples, base = spark.createDataFrame(pdf), j.HrParams()
    few = replace(base, max_order=1)
    shares = samples.select("recording", (F.col("sample_idx") / 100).cast("long").alias("window_idx"), F.lit(0.0).alias("w_all"), F.lit(1.0).alias("w_few")).distinct()
    both = j.expert_spectrum_fusion(samples, shares, {"all": base, "few": few}, base).toPandas().sort_values("window_idx")
    assert len(asked) == 1
    alone = j.expert_spectrum_fusion(samples, shares.drop("w_all"), {"few": few}, base).toPandas().sort_values("window_idx")
    assert both["fused_bpm"].tolist() == pytest.approx(alone["fused_bpm"].tolist(), abs=1e-9) and both["motion"].sum() > 10
