"""Low-discrepancy samples of a grid, and the study that is run on one."""

from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.test_jobs import recording, ref  # noqa: F401  fixtures
from wristwave.operators.sampling import primes, radical_inverse, sampled_grid
from wristwave.plans import jobs as j


def mirrored(i, base):
    out, scale = 0.0, 1.0 / base
    while i:
        out, i, scale = out + i % base * scale, i // base, scale / base
    return out


@pytest.mark.parametrize("base", primes(13))
def test_radical_inverse_against_a_loop(spark, base):
    got = spark.range(200).select("id", radical_inverse(F.col("id"), base, 200).alias("u")).collect()
    assert all(r.u == pytest.approx(mirrored(r.id, base), abs=1e-12) for r in got)


def test_every_choice_turns_up_evenly(spark):
    rows = sampled_grid(spark, j.SEARCH_SPACE, 75, 3).orderBy("trial").collect()
    assert [r.trial for r in rows] == list(range(225)) and Counter(r.repeat for r in rows) == {0: 75, 1: 75, 2: 75}
    for p, choices in j.SEARCH_SPACE.items():
        n = Counter(r[p] for r in rows)
        assert set(n) == set(map(float, choices)) and min(n.values()) > 225 / len(choices) * 0.6
    assert len({tuple(r)[2:] for r in rows}) > 215
    assert rows == sampled_grid(spark, j.SEARCH_SPACE, 75, 3).orderBy("trial").collect()
    assert rows != sampled_grid(spark, j.SEARCH_SPACE, 75, 3, seed=1).orderBy("trial").collect()


def test_study_trials_are_single_runs(spark, ref):  # noqa: F811
    samples = spark.createDataFrame(recording())
    space = {"slew_limit_bpm": [8, 12], "smooth_win_len": [5, 9], "time_bias": [4, 5, 6]}
    got = j.optimise(samples, ref, j.HrParams(), space, 3, 1)
    trials = got["trials"].toPandas().sort_values("trial")
    assert len(trials) == 3
    one = trials.iloc[1]
    own = replace(j.HrParams(), slew_limit_bpm=one["slew_limit_bpm"], smooth_win_len=int(one["smooth_win_len"]), time_bias=one["time_bias"])
    want = j.estimate_hr_dual(samples, ref, own).errors.toPandas().set_index("method")["aae_all"]
    assert one["hf"] == pytest.approx(want["fusion_hf"]) and one["acc"] == pytest.approx(want["fusion_acc"])
    best = got["best"].first()
    assert best.min_err_hf == pytest.approx(trials["hf"].min()) and best.min_err_acc == pytest.approx(trials["acc"].min()) and best.n == 3
    assert got["search_space"].count() == 7 and {r.parameter for r in got["importance"].collect()} == set(space)
