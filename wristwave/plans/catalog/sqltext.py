"""The window functions in SQL text: filters as data, spectra, and beats unfolded by LATERAL VIEW."""

from wristwave.operators import signal as sg
from wristwave.operators import windows as w
from wristwave.plans.catalog.sequences import FS
from wristwave.plans.catalog.signals import _FILTER_SQL, _two_colours, _wins
from wristwave.plans.registry import query, rq
from wristwave.sources import tables as t


def _ready(spark, df, view):
    sg.register_functions(spark, FS)
    df.createOrReplaceTempView(view)


# each window is filtered as its number says
_KINDS = ("lms", "volterra", "noncausal_lms")
_BY_TYPE = " UNION ALL ".join(
    f"SELECT recording, window_idx, '{kind}' AS filter_type, i, e FROM ({_FILTER_SQL[name]}) WHERE window_idx % 3 = {n}"
    for n, (kind, name) in enumerate(zip(_KINDS, ("g12_linear_lms", "g14_volterra_lms", "g15_noncausal_lms")))
)


@query("u1_sql_filter_by_type", "SELECT * FROM (" + _BY_TYPE + ")", ("sensor",))
def u1(spark, sf):
    _ready(spark, _wins(spark, sf, ["ppg", "accx"]), "filter_windows")
    return spark.sql("""
        WITH typed AS (SELECT *, CASE window_idx % 3 WHEN 0 THEN 'lms' WHEN 1 THEN 'volterra' ELSE 'noncausal_lms' END AS filter_type FROM filter_windows),
        cleaned AS (SELECT recording, window_idx, filter_type, adaptive_filter(filter_type, ppg, accx, 0.5D, 5, 1) AS residual FROM typed)
        SELECT recording, window_idx, filter_type, x.i, floor(x.e * 1000000 + 0.5137D) / 1000000.0D AS e FROM cleaned LATERAL VIEW posexplode(residual) x AS i, e""")


_SPECTRUM = f"""WITH e AS (SELECT vec_id, unnest(x) AS v, unnest(range(0, 64)) AS n FROM vectors), k AS (SELECT unnest(range(0, 5)) * 128 AS k),
s AS (SELECT vec_id, k, sum(v * cos(2 * pi() * k * n / 8192)) AS c, sum(v * sin(2 * pi() * k * n / 8192)) AS s FROM e, k GROUP BY 1, 2)
SELECT vec_id, k::INT AS bin, {rq('sqrt(c*c + s*s) / 64 * CASE WHEN k = 0 THEN 1 ELSE 2 END', 5)} AS amp FROM s"""


@query("u2_sql_spectrum", _SPECTRUM, ("vectors",))
def u2(spark, sf):
    _ready(spark, t.vectors(spark, sf), "spectrum_vectors")
    return spark.sql("""
        SELECT vec_id, b.bin, floor(b.amp * 100000 + 0.5137D) / 100000.0D AS amp
        FROM (SELECT vec_id, amplitude_spectrum(x) AS a FROM spectrum_vectors) LATERAL VIEW posexplode(a) b AS bin, amp WHERE b.bin % 128 = 0 AND b.bin < 640""")


@query("u3_sql_beats")
def u3(spark, sf):
    _ready(spark, w.window_arrays(_two_colours(spark, sf), ["red", "ir"], 100, 25), "beat_windows")
    return spark.sql("""
        SELECT recording, window_idx, b.* FROM (SELECT recording, window_idx, ppg_beats(red, ir) AS s FROM beat_windows)
        LATERAL VIEW inline(s.beats) b AS beat_idx, v1_ir, p_ir, v2_ir, v1_red, p_red, v2_red""")
