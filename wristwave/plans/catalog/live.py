"""ST1-ST3: streams of several triggers with late rows, compared with a batch rule for what is dropped.

A row comes with the trigger of its time, some up to three triggers late. What a trigger accepts is younger than the watermark
that the trigger before it worked with: the newest time of the triggers before that one, less the delay.
"""

from pyspark.sql import functions as F

from wristwave.operators import tracking as tr
from wristwave.operators.windows import transition
from wristwave.plans.catalog.ranking import KEYS
from wristwave.plans.catalog.sequences import mag, MAG_SQL
from wristwave.plans.registry import query, r, rq
from wristwave.session import shared_path
from wristwave.sources import tables as t
from wristwave.streaming import live

BATCHES = 6


def _arrival(at: str, number: str) -> str:
    """Six seconds a trigger; three rows in forty come one, two or three triggers late."""
    late = f"CASE ({number} * 7 + recording * 3) % 40 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END"
    return f"CAST(least({BATCHES - 1}, floor({at} / 6) + {late}) AS INT)"


# wm: the watermark, in seconds, that rows of a trigger have to be above; lim: the last one
_ARRIVED = """came AS (SELECT *, {arrival} AS b FROM {rows}), newest AS (SELECT b, max({at}) AS m FROM came GROUP BY b),
marks AS (SELECT b, (SELECT floor(max(m) * 1000) / 1000 - 2 FROM newest y WHERE y.b <= x.b - 2) AS wm FROM newest x), lim AS (SELECT floor(max({at}) * 1000) / 1000 - 2 AS last FROM came)"""
_CLOSED = _ARRIVED.format(arrival=_arrival("t_s", "sample_idx"), rows="sensor", at="t_s") + """,
wk AS (SELECT * FROM (SELECT came.*, unnest(range(floor(t_s)::BIGINT - 7, floor(t_s)::BIGINT + 1)) AS w0 FROM came) JOIN marks USING (b) WHERE wm IS NULL OR w0 + 8 > wm)"""


def _stream(spark, sf):
    src = live.with_event_time(t.sensor(spark, sf))
    came = src.select("recording", "ts", "accx", "accy", "accz", "t_s", "sample_idx")
    return live.file_stream(spark, came, shared_path(spark, "stream-in"), F.expr(_arrival("t_s", "sample_idx")), BATCHES)


def _second(c):
    return (F.unix_micros(c) - F.unix_micros(F.lit(live.EPOCH).cast("timestamp"))) / 1000000


@query(
    "st1_live_motion_score",
    f"WITH {_CLOSED} SELECT recording, w0::DOUBLE AS start_s, {rq(f'stddev_samp({MAG_SQL})')} AS score, count(*) AS n FROM wk, lim WHERE w0 + 8 <= last GROUP BY 1, 2",
    ("sensor",),
)
def st1(spark, sf):
    out = live.motion_scores(_stream(spark, sf), mag())
    got = spark.read.schema(out.schema).parquet(live.run_to_files(out, shared_path(spark, "st1")))
    return got.select("recording", _second(F.col("window_start")).alias("start_s"), r("score").alias("score"), "n")


@query(
    "st2_live_window_quality",
    f"WITH {_CLOSED} SELECT recording, w0::DOUBLE AS start_s, count(*) AS n, 200 - count(*) FILTER (WHERE accz <> 0) AS missing_count, (200 - count(*) FILTER (WHERE accz <> 0)) / 200.0::DOUBLE <= 0.20::DOUBLE AS reliable FROM wk, lim WHERE w0 + 8 <= last GROUP BY 1, 2",
    ("sensor",),
)
def st2(spark, sf):
    out = live.window_quality(_stream(spark, sf), F.col("accz") != 0, 200)
    got = spark.read.schema(out.schema).parquet(live.run_to_files(out, shared_path(spark, "st2")))
    return got.select("recording", _second(F.col("window_start")).alias("start_s"), "n", "missing_count", "reliable")


_LATE_TRACK = "RECURSIVE " + _ARRIVED.format(arrival=_arrival("window_idx", "window_idx"), rows="(SELECT recording, window_idx, list(freq ORDER BY amp DESC, peak_idx) AS f, bool_or(rf = 'R' AND peak_idx = 0) AS m FROM peaks GROUP BY 1, 2)", at="window_idx") + f""",
rs AS (SELECT *, coalesce(m AND NOT lag(m) OVER (PARTITION BY recording ORDER BY window_idx), false) AS reset FROM came),
src AS (SELECT recording, window_idx, f, reset, row_number() OVER (PARTITION BY recording ORDER BY window_idx) AS i FROM rs JOIN marks USING (b), lim WHERE (wm IS NULL OR window_idx > wm) AND window_idx <= last),
tr AS (SELECT recording, window_idx, f[1] AS hr, i FROM src WHERE i = 1 UNION ALL
SELECT s.recording, s.window_idx, CASE WHEN s.reset THEN s.f[1] ELSE CASE WHEN v - tr.hr > 10.0::DOUBLE/60 THEN tr.hr + 7.0::DOUBLE/60 WHEN v - tr.hr < -(10.0::DOUBLE/60) THEN tr.hr - 7.0::DOUBLE/60 ELSE v END END, s.i
FROM tr JOIN (SELECT * FROM src) s ON s.recording = tr.recording AND s.i = tr.i + 1,
LATERAL (SELECT coalesce(list_filter(s.f[1:5], lambda z: z - tr.hr < 25.0::DOUBLE/60 AND z - tr.hr > -(25.0::DOUBLE/60))[1], tr.hr) AS v))
SELECT recording, window_idx, {rq("hr", 8)} AS hr FROM tr"""


@query("st3_live_tracker", "WITH " + _LATE_TRACK, ("peaks",))
def st3(spark, sf):
    src = tr.sorted_peaks(t.peaks(spark, sf), KEYS, m=F.max((F.col("rf") == "R") & (F.col("peak_idx") == 0)))
    s = transition(src, F.col("m"))
    s = s.select(*KEYS, "freqs", (F.col("enters") & (F.col("window_idx") > 0)).alias("reset"))
    s = live.with_event_time(s, "window_idx")
    stream = live.file_stream(spark, s, shared_path(spark, "st3-in"), F.expr(_arrival("window_idx", "window_idx")), BATCHES)
    out = live.tracker(stream, 25 / 60, 10.0, 7.0)
    with live.on_disk(spark):
        path = live.run_to_files(out, shared_path(spark, "st3"))
    return spark.read.schema(out.schema).parquet(path).select(*KEYS, r("hr", 8).alias("hr"))
