"""Queries of event extraction and signal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import signal as O

from . import fixtures as X
from .fixtures import PEAKS, PULSES, SIZE, TRACE, r6
from .register import query

CLIPS = f"""
SELECT p.file, p.peak, p.signal, p.baseline, p.duration, coalesce(c.y, []::DOUBLE[]) AS clip FROM ({PEAKS}) p LEFT JOIN (
  SELECT p.file, p.peak, list(t.y ORDER BY t.idx) AS y FROM ({PEAKS}) p JOIN ({TRACE}) t ON p.file = t.file
    AND t.idx >= greatest(p.start - 1 - p.duration // 2, 0) AND t.idx < p."end" + 1 + p.duration // 2 GROUP BY 1, 2 HAVING count(*) > 1) c
ON p.file = c.file AND p.peak = c.peak
"""


@query("e1_clip_events", f"SELECT file, peak, len(clip) AS n, round(list_sum(clip), 6) AS total, round(clip[1], 6) AS first FROM ({CLIPS})")
def e1(spark, d):
    c = O.clip_events(X.peaks(spark, d), X.trace(spark, d))
    total = F.when(F.size("clip") > 0, F.aggregate("clip", F.lit(0.0), lambda s, v: s + v))
    return c.select("file", "peak", F.size("clip").cast("long").alias("n"), r6(total).alias("total"), r6(F.get("clip", F.lit(0))).alias("first"))


@query("j9_clip_points", f"SELECT file, peak, unnest(range(len(clip)))::INTEGER AS i, round(unnest(clip), 6) AS y FROM ({CLIPS})")
def j9(spark, d):
    c = O.clip_events(X.peaks(spark, d), X.trace(spark, d))
    return c.select("file", "peak", F.posexplode("clip").alias("i", "y")).withColumn("y", r6("y"))


_X = "u * len(clip) / 13.0::DOUBLE"
_LO, _HI = f"least(floor({_X})::BIGINT, len(clip) - 1)", f"least(ceil({_X})::BIGINT, len(clip) - 1)"
_POINT = f"CASE WHEN len(clip) > 1 THEN clip[{_LO} + 1] + (clip[{_HI} + 1] - clip[{_LO} + 1]) * ({_X} - {_LO}) ELSE 0.0 END"


@query("e2_resample_wave", f"SELECT file, peak, u::INTEGER AS u, round({_POINT}, 6) AS y FROM ({CLIPS}), (SELECT unnest(range(12)) AS u)")
def e2(spark, d):
    c = O.clip_events(X.peaks(spark, d), X.trace(spark, d))
    return c.select("file", "peak", F.posexplode(O.resample_wave(F.col("clip"))).alias("u", "y")).withColumn("y", r6("y"))


_BY = "CASE WHEN signal = 0 THEN 1e-12 ELSE signal END"


@query("e3_scale_wave", f"SELECT file, peak, round(sum(({_POINT} * 1000 - baseline) / {_BY}), 3) AS total FROM ({CLIPS}), (SELECT unnest(range(12)) AS u) GROUP BY 1, 2")
def e3(spark, d):
    c = O.clip_events(X.peaks(spark, d), X.trace(spark, d))
    wave = O.scale_wave(O.resample_wave(F.col("clip")), F.col("baseline"), F.col("signal"))
    return c.select("file", "peak", F.round(F.aggregate(wave, F.lit(0.0), lambda s, v: s + v), 3).alias("total"))


@query("e4_to_long", f"SELECT file || ':' || peak AS id, unnest(range(len(clip)))::INTEGER AS time, round((unnest(clip) * 1000 - baseline) / {_BY}, 4) AS value FROM ({CLIPS})")
def e4(spark, d):
    c = O.clip_events(X.peaks(spark, d), X.trace(spark, d)).withColumn("id", F.concat_ws(":", "file", F.col("peak").cast("string")))
    return O.to_long(c, "id").withColumn("value", F.round("value", 4))


@query("e5_assign_event_ids", f"SELECT file, peak, row_number() OVER (ORDER BY file, peak) + 99 AS event_id FROM ({PEAKS})")
def e5(spark, d):
    return O.assign_event_ids(X.peaks(spark, d).select("file", "peak"), ["file", "peak"], 100)


@query("e6_collect_events", f"SELECT file, peak, row_number() OVER (ORDER BY file, peak) - 1 AS event_id, 12 AS n_wave FROM ({PEAKS}) WHERE duration > 10 AND file <> 'view'")
def e6(spark, d):
    t = X.trace(spark, d)
    quality = t.select("file").distinct().withColumn("code", F.when(F.col("file") == "view", 3).otherwise(1))
    return O.collect_events(X.peaks(spark, d), t, quality).select("file", "peak", "event_id", F.size("wave").alias("n_wave"))


@query("e7_detect_pulses", PULSES + """
SELECT file, start, "end", round(peak, 6) AS peak, round(mean, 6) AS mean, round(area, 6) AS area, round(baseline, 6) AS baseline, round(threshold, 6) AS threshold,
  round(("end" - start + 1) * 1e-4, 6) AS width FROM p WHERE ("end" - start + 1) * 1e-4 >= 0.0002
""")
def e7(spark, d):
    return X.pulses(spark, d).select("file", "start", "end", *[r6(c).alias(c) for c in ("peak", "mean", "area", "baseline", "threshold", "width")])


@query("e12_pulse_peak", PULSES + """SELECT file, start, peak_idx, round(peak, 6) AS peak FROM p WHERE ("end" - start + 1) * 1e-4 >= 0.0002""")
def e12(spark, d):
    return X.pulses(spark, d).select("file", "start", "peak_idx", r6("peak").alias("peak"))


@query("e8_chunk_trace", f"SELECT file, idx // {SIZE} AS chunk, count(*) AS n, round(sum(y), 4) AS total FROM ({TRACE}) GROUP BY 1, 2")
def e8(spark, d):
    return O.chunk_trace(X.trace(spark, d), SIZE).groupBy("file", "chunk").agg(F.count("*").alias("n"), F.round(F.sum("y"), 4).alias("total"))


@query("e9_savgol", f"""
WITH t AS (SELECT file, idx, y, idx // {SIZE} AS chunk FROM ({TRACE})),
w AS (SELECT *, row_number() OVER (PARTITION BY file, chunk ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY file, chunk) AS n FROM t),
x AS (SELECT (x - 25)::DOUBLE AS x FROM range(51) r(x)), m AS (SELECT sum(x ** 2) AS s2, sum(x ** 4) AS s4 FROM x),
p AS (SELECT x, x ** 2 - s2 / 51 AS q, x ** 3 - s4 / s2 * x AS c FROM x, m), k AS (SELECT sum(x * x) AS nx, sum(q * q) AS nq, sum(c * c) AS nc FROM p),
h AS (SELECT a.x AS at, b.x AS x, 1.0 / 51 + a.x * b.x / nx + a.q * b.q / nq + a.c * b.c / nc AS h FROM p a, p b, k),
f AS (SELECT *, greatest(least(i, n - 26), 25) AS mid FROM w WHERE n >= 51),
s AS (SELECT f.file, f.idx, sum(h * v.y) AS smooth FROM f JOIN w v ON v.file = f.file AND v.chunk = f.chunk AND v.i BETWEEN mid - 25 AND mid + 25 JOIN h ON h.at = f.i - mid AND h.x = v.i - mid GROUP BY 1, 2)
SELECT w.file, w.idx, round(coalesce(smooth, y), 6) AS smooth FROM w LEFT JOIN s ON s.file = w.file AND s.idx = w.idx
""")
def e9(spark, d):
    return O.savgol(X.trace(spark, d), 51, 3, SIZE).select("file", "idx", r6("smooth").alias("smooth"))


_BASE = f"""
WITH t AS (SELECT file, idx, y, idx // {SIZE} AS chunk FROM ({TRACE})),
w AS (SELECT *, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY file, chunk) AS n, sum(y) OVER (o ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS s,
  first_value(y) OVER o AS f, last_value(y) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM t WINDOW o AS (PARTITION BY file, chunk ORDER BY idx)),
b AS (SELECT file, idx, chunk, (s + greatest(25 - i, 0) * f + greatest(25 - (n - 1 - i), 0) * l) / 51 AS base FROM w)
"""


@query("e10_moving_baseline", _BASE + "SELECT file, idx, round(base, 6) AS base FROM b")
def e10(spark, d):
    return O.moving_baseline(X.trace(spark, d), 50, SIZE).select("file", "idx", r6("base").alias("base"))


@query("e11_local_threshold", _BASE + f"""
, s AS (SELECT c.file, c.chunk, stddev_pop(t.y) AS sd FROM (SELECT DISTINCT file, chunk FROM t) c JOIN t ON c.file = t.file AND t.idx >= c.chunk * {SIZE} - 100 AND t.idx < (c.chunk + 1) * {SIZE} + 100 GROUP BY 1, 2)
SELECT file, idx, round(base + 3 * sd, 6) AS threshold FROM b JOIN s USING (file, chunk)
""")
def e11(spark, d):
    return O.local_threshold(X.trace(spark, d), 3.0, 51, SIZE, 100).select("file", "idx", r6("threshold").alias("threshold"))
