"""The registered cascade against its stages one by one."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wristwave.functions import kernels as kn
from wristwave.sources import tables as t


def test_residual_of_all_stages_comes_out(spark, sf):
    """what every stage leaves is in the result, sample by sample, not only how long it is."""
    got = entry.queries()["g17_adaptive_cascade"](spark, sf).toPandas()
    of = t.sensor(spark, sf).select("recording", "sample_idx", "ppg", "accx", "accy", "accz").orderBy("recording", "sample_idx").toPandas()
    of = {k: v.set_index("sample_idx") for k, v in of.groupby("recording")}
    windows = got.groupby(["recording", "window_idx"])
    assert len(windows) > 20
    for (rec, idx), rows in windows:
        at = 25 + 25 * idx
        win = {c: of[rec].loc[at : at + 199, c].to_numpy(float) for c in ("ppg", "accx", "accy", "accz")}
        left = win["ppg"]
        for c in rows["channels"].iloc[0].split("+"):
            k = 0 if c == "accx" else 1
            corr = max(abs(np.corrcoef(win["ppg"], of[rec].loc[at + lag : at + lag + 199, c].to_numpy(float))[0, 1]) for lag in range(-5, 6) if at + lag + 199 in of[rec].index)
            left = kn.lms(win[c][None, : len(left) + k], left[None], int(rows["m"].iloc[0]), k, np.array([0.01 - corr / 100]))[0]
        e = rows.sort_values("i")["e"].to_numpy()
        assert len(e) == len(left) and np.abs(e - left).max() < 1e-5, (rec, idx)
