"""Composed chunk maps against one walk."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wristwave.functions import moves as mv
from wristwave.operators import tracking as tr
from wristwave.plans import jobs as j


def walk(steps, x):
    for s in map(lambda s: mv.Step(*s), steps):
        if s.set:
            x = s.value
        elif math.isnan(x):
            x = s.start
        else:
            moves, by = s._piece(x)
            x = x + by if moves else by
    return x


def test_maps_by_walking():
    rng = random.Random(1)
    for _ in range(150):
        steps = []
        for _ in range(rng.randrange(2, 60)):
            pool = [rng.uniform(0, 4) for _ in range(rng.randrange(5))]
            steps.append((rng.random() < 0.02, rng.choice([1.0, math.nan]), 2.0, pool, rng.choice([math.nan, math.nan, 1.5]), rng.choice([0.3, math.inf]), 0.1, 0.07))
        k = rng.randrange(1, len(steps))
        whole, (head, tail) = mv.chunk_maps([[s] for s in steps])[0], (mv.chunk_maps([[s] for s in part]) for part in (steps[:k], steps[k:]))
        for x in [math.nan, *(rng.uniform(-1, 5) for _ in range(20))]:
            want = walk(steps, x)
            for got in (whole.at(x), mv.joined(tail, head)[0].at(x)):
                assert got == pytest.approx(want, abs=1e-9, nan_ok=True)


def col(df, name):
    return df.orderBy("window_idx").toPandas()[name].to_numpy()


def frame(spark, freqs, **more):
    return spark.createDataFrame(pd.DataFrame({"recording": "a", "window_idx": np.arange(len(freqs)), "freqs": freqs, **more}))


def rounds(monkeypatch, label):
    """Counts the tables of a label that are stored."""
    made, store = [], tr.materialise

    def counted(df, name, *args):
        made.append(name)
        return store(df, name, *args)

    monkeypatch.setattr(tr, "materialise", counted)
    return lambda: made.count(label)


def test_rounds_grow_with_the_logarithm_of_chunks(spark, monkeypatch):
    """A tracker whose peaks are never accepted depends on its first rate for ever."""
    rng = np.random.default_rng(0)
    df = frame(spark, [[1.0]] + [[float(x)] for x in rng.uniform(2.0, 3.0, 511)])
    count, redone = rounds(monkeypatch, "fold-maps"), rounds(monkeypatch, "fold-redo")
    got = col(tr.track(df, ["recording"], "window_idx", "freqs", 0.3, 6.0, 4.0, size=4), "hr")
    assert (got == 1.0).all() and count() <= 9 and redone() == 1


def test_moves_that_never_arrive(spark):
    """Peaks that run away keep the tracker moving over many chunks; its sums are those of one walk."""
    freqs = [[1.0]] + [[1.0 + 0.2 + 0.05 * i] for i in range(200)]
    df = frame(spark, freqs)
    one, many = (col(tr.track(df, ["recording"], "window_idx", "freqs", 90.0, 6.0, 2.7, size=s), "hr") for s in (1000, 8))
    assert np.array_equal(one, many) and one[-1] > 9


@pytest.mark.parametrize("mode", [m for m in tr.MODES])
def test_modes_resets_and_empty_windows(spark, mode):
    rng = np.random.default_rng(len(mode))
    freqs = [list(rng.uniform(0.8, 3.0, size=rng.integers(0, 8))) for _ in range(300)]
    df = frame(spark, freqs, reset=rng.random(300) < 0.01).withColumn("mode", F.lit(mode))
    one, many = (col(tr.track(df, ["recording"], "window_idx", "freqs", 0.3, 6.0, 4.0, reset=F.col("reset"), mode=F.col("mode"), size=s), "hr") for s in (1000, 8))
    assert np.array_equal(one, many)


def test_rate_limit_is_chunk_invariant(spark):
    rng = np.random.default_rng(5)
    motion = (np.arange(300) // 20 % 3 == 1).astype(int)
    values = np.where(rng.random(300) < 0.1, np.nan, rng.uniform(1, 3, 300))
    df = spark.createDataFrame(pd.DataFrame({"recording": "a", "window_idx": np.arange(300), "v": values, "motion": motion})).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    one, many = (col(tr.post_motion_slew(df, "v", F.col("motion") == 1, 4.0 / 60, 7, size=s), "v") for s in (1000, 8))
    assert np.array_equal(one, many, equal_nan=True)


def test_paths_copy_and_restart(spark):
    rng = np.random.default_rng(8)
    some = lambda: [list(rng.uniform(0.8, 3.0, size=rng.integers(0, 6))) for _ in range(240)]
    df = spark.createDataFrame(pd.DataFrame({"recording": "a", "window_idx": np.arange(240), "active": np.arange(240) // 30 % 2 == 1, "f_fft": some(), "f_hf": some(), "f_acc": some()}))
    params = j.tracking_columns(j.HrParams())
    one, many = (j.track_paths(df, ["recording"], ["hf", "acc"], "active", params, size=s).orderBy("window_idx").toPandas() for s in (1000, 8))
    assert one.equals(many)


def test_short_recordings_have_no_maps(spark, monkeypatch):
    """only chunks that another one follows are composed; recordings of one chunk are just walked."""
    from wristwave.operators import tracking as tr

    made, store = [], tr.materialise
    monkeypatch.setattr(tr, "materialise", lambda df, label: made.append((label, store(df, label))) or made[-1][1])
    rows = [(k, w, [1.0 + (w * 7 + k) % 5 / 10]) for k in range(6) for w in range(9 if k else 30)]
    df = spark.createDataFrame(rows, "recording long, window_idx long, freqs array<double>")
    got = {(r.recording, r.window_idx): r.hr for r in tr.track(df, ["recording"], "window_idx", "freqs", 0.3, 6.0, 3.0, size=10).collect()}
    maps = [df.select("recording", "_at").distinct().collect() for label, df in made if label == "fold-maps"]
    assert sorted(map(tuple, maps[0])) == [(0, 0), (0, 1)]  # the third chunk of 0 and the only ones of the others: none
    hr = None
    for w in range(30):
        f = 1.0 + w * 7 % 5 / 10
        goal = f if hr is None or abs(f - hr) < 0.3 else hr
        hr = goal if hr is None or abs(goal - hr) <= 0.1 else hr + (0.05 if goal > hr else -0.05)
        assert got[0, w] == pytest.approx(hr)
