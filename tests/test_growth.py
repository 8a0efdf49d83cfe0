"""Plans and batches whose size must not grow with the tables."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wristwave.operators import align as al, stats as st
from wristwave.session import materialise


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rates(spark, n=50):
    x = np.random.default_rng(3).normal(70, 5, n)
    pdf = pd.DataFrame({"recording": "a", "window_idx": np.arange(n), "ref": x})
    more = pd.DataFrame({"recording": ["b", "b", "c"], "window_idx": [0, 1, 0], "ref": [60.0, 62.0, 50.0]})
    return x, materialise(spark.createDataFrame(pd.concat([pdf, more])), "rates")


def want_at(x, pos):
    n, i = len(x), int(np.floor(pos))
    if pos < 0:
        return x[0] + (x[1] - x[0]) * pos
    if pos > n - 1:
        return x[-1] + (x[-1] - x[-2]) * (pos - (n - 1))
    return x[i] if i == n - 1 else x[i] + (x[i + 1] - x[i]) * (pos - i)


def test_shift_broadcasts_no_samples(spark):
    """stored samples are small files, but not small tables."""
    _, df = rates(spark)
    assert "BroadcastExchange" not in plan_of(al.shifted_rows(df, "ref", [-2.5, 5.0]))
    assert "BroadcastExchange" not in plan_of(al.shifted(df, "ref", [-2.5, 5.0]))


def test_offsets_are_rows_of_one_compiled_expression(spark):
    """a row an offset, no lambda; values inside and beyond both ends, series of two and of one sample."""
    x, df = rates(spark)
    biases = [-2.5, -1.0, 0.0, 0.5, 5.0]
    out = al.shifted_rows(df, "ref", biases)
    assert "lambda" not in plan_of(out)
    for r in out.collect():
        series = {"a": x, "b": [60.0, 62.0]}.get(r.recording)
        assert (r.v is None) if series is None else np.isclose(r.v, want_at(series, r.window_idx + r.bias))
    arrays = al.shifted(df, "ref", biases).select("recording", "window_idx", F.inline("_at"))
    key = lambda rows: sorted((r.recording, r.window_idx, r.bias, r.v) for r in rows if r.v is not None)
    assert key(arrays.collect()) == key(out.select("recording", "window_idx", "bias", "v").collect())


def test_bias_scan_expands_without_lambdas(spark):
    x, df = rates(spark)
    t = df.withColumns({"segment": F.lit("pre_rest"), "reliable": F.lit(1), "final": F.col("ref"), "fft": F.col("ref") + 1})
    scan = st.time_bias_scan(t, "final", "fft", "ref", "reliable", [-1.0, 0.0, 1.0])
    assert "lambda" not in plan_of(scan) and "BroadcastExchange" not in plan_of(scan)
    assert {r.recording for r in scan.collect()} == {"a", "b", "c"}


def test_walks_hold_few_chunks(spark):
    """maps of many chunks come from bounded slices of a batch, and the walk is the sequential one."""
    from wristwave.operators import tracking as tr

    rows = [(k, i, [1.0 + (i * 7 + k) % 5 / 10, 1.3]) for k in range(3 * tr.BATCH) for i in range(4)]
    df = spark.createDataFrame(rows, "recording long, window_idx long, freqs array<double>").coalesce(1)
    got = {(r.recording, r.window_idx): r.hr for r in tr.track(df, ["recording"], "window_idx", "freqs", 0.5, 6.0, 4.0, size=2).collect()}
    for k in range(3 * tr.BATCH):
        hr = None
        for i in range(4):
            freqs = rows[4 * k + i][2]
            if hr is None:
                hr = freqs[0]
            else:
                goal = next((f for f in freqs if abs(f - hr) < 0.5), hr)
                hr = hr + 4 / 60 if goal - hr > 6 / 60 else hr - 4 / 60 if goal - hr < -6 / 60 else goal
            assert np.isclose(got[k, i], hr)


def test_matrices_are_bounded(spark):
    """a batch of any size is worked in pieces; spectra leave in pieces too; batches are bounded by bytes."""
    from wristwave.operators import signal as sg

    x = pd.Series([np.zeros(4)] * 3000 + [None])
    sizes = [len(rows) for _, rows in sg._by_shape(x)]
    assert max(sizes) <= sg.ROWS and sum(sizes) == 3001
    pieces = list(sg.amplitude_spectrum(64, 5).func(iter([pd.Series([np.ones(8)] * 1000)])))
    assert [len(p) for p in pieces] == [256, 256, 256, 232] and len(pieces[0].iloc[0]) == 5
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"


def test_cascade_and_peaks_share_a_worker(spark):
    """residuals stay in the worker; peaks are those of the two steps apart."""
    from wristwave.operators import signal as sg

    rng = np.random.default_rng(5)
    win = lambda n=200: [float(v) for v in np.sin(np.arange(n) / 3) + rng.normal(size=n)]
    rows = [(i, win(), [win(), win()], [0.5, 0.4], [0, 0], 4) for i in range(6)] + [(6, None, [win()], [0.1], [0], 4)]
    df = spark.createDataFrame(rows, "i int, d array<double>, refs array<array<double>>, corr array<double>, k array<int>, m int")
    args = ("d", "refs", "corr", "k", "m")
    both = df.withColumn("a", sg.cascade_peaks("lms", 25)(*args)).withColumn("b", sg.peak_frequencies(25)(sg.cascade("lms")(*args), F.get("refs", F.lit(0))))
    got = both.select("i", "a", "b").collect()
    assert all(r.a == r.b for r in got) and any(r.a for r in got)


def test_forests_grow_on_all_cores(spark, monkeypatch):
    """F16: a small table packed into one file is dealt out before a forest grows on it, in folds too; no row is lost."""
    from types import SimpleNamespace

    from pyspark.ml.linalg import Vectors

    from wristwave.operators import learn as ml

    seen = []
    monkeypatch.setattr(ml.RandomForestClassifier, "fit", lambda self, df: seen.append(df))
    monkeypatch.setattr(ml.CrossValidator, "fit", lambda self, df: seen.append(df) or SimpleNamespace(avgMetrics=[0.0], stdMetrics=[0.0]))
    rows = spark.createDataFrame([(Vectors.dense([float(i), 1.0]), float(i % 2), i % 5) for i in range(500)], ["features", "label", "fold"]).coalesce(1)
    ml.forest(rows, "features", "label")
    ml.cross_validated(rows, "features", "label", "fold")
    for df in seen:
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and df.count() == 500
