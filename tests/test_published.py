"""Reports of several tables: round trips, failed and repeated runs, other kinds, and the tables of S9, S16 and S17."""

import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_operators import recording
from wristwave.plans import jobs as j
from wristwave.session import shared_path
from wristwave.sources import reports
from wristwave.sources.published import publish, published, replaced_runs


def numbers(spark, lo, hi):
    return spark.range(lo, hi).select(
        "id", (F.col("id") / 3).alias("x y"), F.array(F.col("id"), F.lit(None)).alias("list"), F.struct(F.lit("a,b\n").alias("s"), F.lit(True).alias("b")).alias("nested"),
        F.when(F.col("id") % 2 == 0, "even").alias("part"))


def test_round_trip_of_every_column(spark):
    path = shared_path(spark, "test-report")
    df = numbers(spark, 0, 50)
    publish(path, "k", {"one": df, "none": df.limit(0), "cut": df}, {"cut": ["part"]})
    got = published(spark, path, "k")
    assert set(got) == {"one", "none", "cut"}
    for name in ("one", "cut"):
        assert got[name].columns == df.columns and sorted(got[name].collect(), key=lambda r: r.id) == df.orderBy("id").collect()
    assert got["none"].count() == 0 and got["none"].dtypes == df.dtypes
    with pytest.raises(ValueError):
        published(spark, path, "other")


def test_failed_run_shows_nothing_and_reruns_replace(spark):
    path = shared_path(spark, "test-report")
    good, broken = numbers(spark, 0, 5), spark.range(5).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(FileNotFoundError):
        published(spark, path, "k")
    with pytest.raises(Exception, match="lost"):
        publish(path, "k", {"a": good, "b": broken})
    with pytest.raises(FileNotFoundError):
        published(spark, path, "k")
    first = publish(path, "k", {"a": good, "b": good})
    with pytest.raises(Exception, match="lost"):
        publish(path, "k", {"a": numbers(spark, 10, 20), "b": broken})
    assert published(spark, path, "k")["a"].count() == 5
    publish(path, "k", {"a": numbers(spark, 10, 20)})
    got = published(spark, path, "k")
    assert set(got) == {"a"} and got["a"].agg(F.min("id")).first()[0] == 10
    assert [(r.run, r.folder) for r in replaced_runs(spark, path).collect()] == [(first, f"{path}/runs/{first}")]


def test_main_effects_against_a_loop(spark):
    rows = [(s, t, float((t * 7 + s) % 11) if t % 5 else None, float(t % 3), float(t // 3 % 2)) for s in (1, 2) for t in range(30)] + [(3, 0, 4.0, 1.0, 1.0)]
    got = {(r.study, r.parameter): r.importance for r in reports.main_effects(spark.createDataFrame(rows, "study int, t int, v double, a double, b double"), "study", "v", ["a", "b"]).collect()}
    assert got.pop((3, "a")) is None and got.pop((3, "b")) is None and len(got) == 4
    for (s, p), share in got.items():
        own = [(r[2], r[3 if p == "a" else 4]) for r in rows if r[0] == s and r[2] is not None]
        mean = statistics.fmean(v for v, _ in own)
        groups = {c: [v for v, d in own if d == c] for _, c in own}
        between = sum(len(g) * (statistics.fmean(g) - mean) ** 2 for g in groups.values())
        assert share == pytest.approx(between / sum((v - mean) ** 2 for v, _ in own))


def test_best_of_ties_and_missing_values(spark):
    trials = spark.createDataFrame([(1, 2, 5.0, None, 1.0), (1, 1, 5.0, None, 2.0), (1, 3, None, 9.0, 3.0), (2, 1, None, None, 1.0)], "recording int, trial int, hf double, acc double, p double")
    best = {r.recording: r for r in reports.optimise_tables(trials, "recording", "hf", "acc", "trial", {"p": [1.0, 2.0, 3.0]}, {"mode": F.lit("green")})["best"].collect()}
    assert best[1].min_err_hf == 5.0 and best[1].best_para_hf.asDict() == {"trial": 1, "p": 2.0} and best[1].best_para_acc.p == 3.0 and best[1].n == 3
    assert best[2].min_err_hf is None and best[2].best_para_hf is None and best[2].mode == "green"
    told = reports.study_tables(trials, "recording", "hf", "trial", ["p"], F.col("hf") < 6, trials)
    assert [tuple(r) for r in told["per_file_metrics"].collect()] == [(1, 5.0, 1, 2.0, True)]
    assert told["trials"].filter("passed").count() == 2 and told["trials"].count() == 4


def test_batch_rows(spark):
    est = spark.createDataFrame([("a b", "green", "ok", 1.5), ("c", "red", "no_reference", None)], "recording string, mode string, status string, best_error double")
    qc = spark.createDataFrame([("a b", "bad", "flat")], "recording string, qc_status string, reason string")
    rows = {r.sample: r for r in reports.batch_tables(est, qc, F.lit("lms"), F.lit("full"), F.lit("HF"))["summary"].collect()}
    assert rows["a b"].qc_status == "bad" and rows["a b"].error is None and rows["a b"].report == "a_b-green-lms-full-HF"
    assert rows["c"].qc_status == "not_run" and rows["c"].error == "no estimate: no_reference" and rows["c"].best_error is None


def test_batch_job_publishes_summary_and_quality(spark):
    samples = spark.createDataFrame(pd.concat([recording(), recording().assign(recording="b")]))
    ref = spark.createDataFrame(pd.DataFrame({"recording": "a", "t_s": [float(t) for t in range(90)], "bpm": 72.0}))
    got = j.batch_report(shared_path(spark, "test-batch"), samples, ref, modes=["ppg_green"])
    rows = {r["sample"]: r for r in got["summary"].collect()}
    assert rows["a"].status == "ok" and rows["a"].best_error is not None and rows["a"].ppg_mode == "ppg_green"
    assert rows["b"].status == "no_reference" and rows["b"].best_error is None and rows["b"].error == "no estimate: no_reference"
    assert {r.recording: r.qc_status for r in got["qc"].collect()} == {k: r.qc_status for k, r in rows.items()}


def test_many_files_takes_many_tasks(spark, tmp_path):
    """Short rows with a folder each are written by as many tasks as asked for; adaptive execution would merge them into one."""
    from wristwave.sources.sinks import many_files

    df = spark.range(400).select(F.format_string("f%03d", "id").alias("stem"), F.lit(1).alias("x"))
    writers = many_files(df, "stem").withColumn("task", F.spark_partition_id())
    writers.write.partitionBy("stem").csv(str(tmp_path / "files"))
    got = spark.read.schema("x int, task int, stem string").csv(str(tmp_path / "files"))
    assert got.count() == 400 and got.select("task").distinct().count() >= spark.sparkContext.defaultParallelism


def test_lines_of_many_files_stay_where_they_are(spark, tmp_path):
    """Files of one split and of several, each with its own order of columns: numbers and headers without a shuffle of lines."""
    from wristwave.sources import recordings as rec

    for name, n, head in (("a", 40000, "x,y"), ("b", 5, "y,x"), ("c", 0, "x")):
        (tmp_path / f"{name}.csv").write_text("\n".join([head, *[f"{name}{i}," + "z" * 20 for i in range(n)]]) + "\n")
    sizes = {"spark.sql.files.maxPartitionBytes": "100000", "spark.sql.files.openCostInBytes": "1000"}
    old = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        rows = rec._file_rows(spark, str(tmp_path))
        got = rows.select(F.regexp_extract("file", r"(\w)\.csv", 1).alias("f"), "line", F.substring_index("value", ",", 1).alias("v"), "header").collect()
        some = [r.line for r in rows.filter(F.col("value").startswith("b") & F.col("value").contains("z")).collect()]
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(some) == [1, 2, 3, 4, 5]  # a filter on the text doesn't change the count
    heads = {"a": "x,y", "b": "y,x", "c": "x"}
    assert len(got) == 40001 + 6 + 1 and all(r.header == heads[r.f] for r in got)
    assert all(r.v == f"{r.f}{r.line - 1}" for r in got if r.line > 0) and sorted((r.f, r.line) for r in got) == sorted((f, i) for f, n in (("a", 40001), ("b", 6), ("c", 1)) for i in range(n))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
