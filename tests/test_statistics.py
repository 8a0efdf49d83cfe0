"""Exact signed ranks by counting, folds, filters by name."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wristwave.operators import learn as ml
from wristwave.operators import signal as sg
from wristwave.operators import stats as st


def test_exact_signed_rank_by_all_sign_choices(spark):
    rng = np.random.default_rng(2)
    groups = {n: rng.choice(np.arange(1, 200), size=n, replace=False) * rng.choice([-1, 1], size=n) for n in (1, 2, 5, 9, 11)}
    groups[99] = np.array([1, 1, -2, 3])  # ties
    groups[60] = rng.choice(np.arange(1, 500), size=60, replace=False)  # too many
    rows = [(int(g), float(d), 0.0) for g, ds in groups.items() for d in [*ds, 0]]
    got = {r.g: r for r in st.signed_rank_test(spark.createDataFrame(rows, "g int, a double, b double"), "a", "b", ["g"]).collect()}
    assert got[99].p_exact is None and got[60].p_exact is None and got[60].n == 60
    for n in (1, 2, 5, 9, 11):
        ranks = np.argsort(np.argsort(np.abs(groups[n]))) + 1
        plus = ranks[groups[n] > 0].sum()
        low = min(plus, n * (n + 1) // 2 - plus)
        sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
        assert got[n].statistic == low and got[n].p_exact == pytest.approx(min(1.0, 2 * sum(s <= low for s in sums) / len(sums)), rel=1e-12)


def test_all_windows_of_a_file_share_a_fold(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 97).alias("file")).withColumn("fold", ml.group_fold(F.col("file"), 5))
    assert df.groupBy("file").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    assert {r[0] for r in df.select("fold").distinct().collect()} == set(range(5))


def test_filter_type_is_data(spark):
    """A batch of several filters, one of them added by name, gives what each gives alone; rows without a type or signal none."""
    from pyspark.ml.functions import array_to_vector  # noqa: F401  the session has to have loaded the library

    rng = np.random.default_rng(1)
    rows = [(i, kind, rng.normal(size=60).tolist(), rng.normal(size=60).tolist()) for i, kind in enumerate(["lms", "volterra", "rff_lms", "klms", "noncausal_lms"] * 4)]
    rows += [(100, None, rows[0][2], rows[0][3]), (101, "lms", None, rows[0][3])]
    df = spark.createDataFrame(rows, "i int, kind string, d array<double>, u array<double>")
    sg.register_functions(spark, 25)
    df.createOrReplaceTempView("typed_filters")
    got = {r.i: r.e for r in spark.sql("SELECT i, adaptive_filter(kind, d, u, 0.3D, 4, 1) AS e FROM typed_filters").collect()}
    for kind in ("lms", "volterra", "rff_lms", "klms", "noncausal_lms"):
        alone = df.filter(F.col("kind") == kind).filter("d is not null").select("i", sg.adaptive_filter(kind)("d", "u", F.lit(0.3), F.lit(4), F.lit(1)).alias("e"))
        assert all(got[r.i] == r.e for r in alone.collect())
    assert got[100] is None and got[101] is None
    with pytest.raises(ValueError):
        sg.adaptive_filter("rff_lms", rff_sigma=0.0)


def test_beats_in_sql_are_those_of_the_operator(spark, sf):
    import __spark_entry__ as entry

    queries = entry.queries()
    rows = lambda name: sorted(map(tuple, queries[name](spark, sf).collect()))
    assert rows("u3_sql_beats") == rows("g20_beat_segmentation")


def test_detrend_of_a_whole_recording_with_gaps(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=9000) + np.linspace(0, 5, 9000) ** 2
    gap = rng.random(9000) < 0.2
    gap[:3] = True
    pdf = pd.DataFrame({"recording": "a", "sample_idx": np.arange(9000), "x": np.where(gap, np.nan, x)})
    got = sg.polynomial_residual(spark.createDataFrame(pdf), ["x"], 4).orderBy("sample_idx").toPandas()["x_res"].to_numpy()
    filled = np.interp(np.arange(9000), np.flatnonzero(~gap), x[~gap])
    t = np.linspace(-1, 1, 9000)
    assert np.abs(got - (filled - np.polyval(np.polyfit(t, filled, 4), t))).max() < 1e-8
