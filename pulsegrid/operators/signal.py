"""Event extraction and signal operators on chunked traces.

A trace is (file, idx, y). Windows run within a chunk of a file, never over a whole trace; what an operator needs from
beyond a chunk's border is copied there first (``halo``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 50_000
CLIP_CHUNK = 512


def chunk_trace(trace: DataFrame, size: int = CHUNK) -> DataFrame:
    return trace.withColumn("chunk", F.floor(F.col("idx") / size))


def halo(trace: DataFrame, size: int, reach: int) -> DataFrame:
    """Rows with the chunk they are needed in: their own, and a neighbour's where they lie within ``reach`` of it (own = false)."""
    first, last = F.floor((F.col("idx") - reach) / size), F.floor((F.col("idx") + reach) / size)
    spread = trace.withColumn("chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return spread.withColumn("own", F.col("chunk") == F.floor(F.col("idx") / size))


def clip_events(peaks: DataFrame, trace: DataFrame, chunk: int = CLIP_CHUNK) -> DataFrame:
    """Interval join: peaks(file, peak, start, end, duration, ...) with the samples of [start-1-m, end+1+m), m = duration div 2.

    Both sides meet on (file, chunk); an event is copied only to the chunks that it covers, equal windows of a file once.
    clip: samples in order; empty where the window holds at most one sample. Repeated peak rows get a clip each.
    """
    m = F.floor(F.col("duration") / 2)
    lo, hi = F.greatest(F.col("start") - 1 - m, F.lit(0)), F.col("end") + 1 + m
    events = peaks.select("*", lo.alias("lo"), hi.alias("hi"))
    covered = events.where("hi > lo").select("file", "lo", "hi").distinct().withColumn("chunk", F.explode(F.sequence(F.floor(F.col("lo") / chunk), F.floor((F.col("hi") - 1) / chunk))))
    points = trace.select("file", F.floor(F.col("idx") / chunk).alias("chunk"), "idx", "y")
    met = covered.join(points, ["file", "chunk"]).where("idx >= lo and idx < hi")
    clips = met.groupBy("file", "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("idx", "y"))).alias("_c"))
    joined = events.join(clips, ["file", "lo", "hi"], "left").select(*events.columns, "_c")
    y = F.transform("_c", lambda s: s["y"])
    return joined.withColumn("clip", F.when(F.size("_c") > 1, y).otherwise(F.array().cast("array<double>"))).drop("_c")


def resample_wave(clip: Column, n: int = 13) -> Column:
    """n - 1 points at u * length / n, linear between neighbours; zeros for an empty clip."""
    length = F.size(clip)

    def point(u: Column) -> Column:
        x = u * length / F.lit(float(n))
        lo = F.least(F.floor(x).cast("int"), length - 1)
        hi = F.least(F.ceil(x).cast("int"), length - 1)
        a, b = F.get(clip, lo), F.get(clip, hi)
        return a + (b - a) * (x - lo)

    return F.when(length > 1, F.transform(F.sequence(F.lit(0), F.lit(n - 2)), point)).otherwise(F.array_repeat(F.lit(0.0), n - 1))


def scale_wave(wave: Column, baseline: Column, signal: Column, digits: int | None = None) -> Column:
    """(y * 1000 - baseline) / signal; a zero signal counts as 1e-12."""
    by = F.when(signal == 0, 1e-12).otherwise(signal)
    scaled = lambda y: (y * 1000 - baseline) / by
    return F.transform(wave, scaled if digits is None else lambda y: F.round(scaled(y), digits))


def to_long(events: DataFrame, id_col: str, clip: str = "clip") -> DataFrame:
    """(id, time, value): the scaled clip at full resolution."""
    scaled = scale_wave(F.col(clip), F.col("baseline"), F.col("signal"))
    return events.select(F.col(id_col).cast("string").alias("id"), F.posexplode(scaled).alias("time", "value"))


def detect_pulses(trace: DataFrame, dt: float = 1e-4, k: float = 6.0, min_ms: float = 0.2, size: int = CHUNK) -> DataFrame:
    """Runs above median + k * population deviation of their chunk, at least ``min_ms`` long; an open run ends with the chunk.

    peak_idx is the first position of the largest value of the run.
    """
    chunked = chunk_trace(trace, size)
    base = chunked.groupBy("file", "chunk").agg(F.median("y").alias("baseline"), F.stddev_pop("y").alias("sd"))
    rows = chunked.join(base, ["file", "chunk"]).withColumn("threshold", F.col("baseline") + k * F.col("sd"))
    rows = rows.withColumn("above", F.col("y") > F.col("threshold"))
    w = Window.partitionBy("file", "chunk").orderBy("idx")
    new = F.when(F.lag("above").over(w).eqNullSafe(F.col("above")), 0).otherwise(1)
    runs = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).where("above")
    pulses = runs.groupBy("file", "chunk", "run").agg(
        F.min("idx").alias("start"),
        F.max("idx").alias("end"),
        F.max("y").alias("peak"),
        F.min_by("idx", F.struct(-F.col("y"), F.col("idx"))).alias("peak_idx"),
        F.avg("y").alias("mean"),
        (F.sum(F.col("y") - F.col("baseline")) * dt).alias("area"),
        F.first("baseline").alias("baseline"),
        F.first("threshold").alias("threshold"),
    )
    width = (F.col("end") - F.col("start") + 1) * dt
    return pulses.withColumns({"t_start": F.col("start") * F.lit(dt), "t_end": F.col("end") * F.lit(dt), "width": width}).where(width >= min_ms / 1000)


def savgol_coefficients(width: int = 51, degree: int = 3) -> np.ndarray:
    """(width, width) matrix: row i gives the value at position i of the polynomial fitted to ``width`` samples."""
    x = np.arange(width) - width // 2
    a = np.vander(x, degree + 1, increasing=True).astype(float)
    return a @ np.linalg.pinv(a)


def savgol(trace: DataFrame, width: int = 51, degree: int = 3, size: int = CHUNK) -> DataFrame:
    """Adds smooth, per chunk: the fitted value at the centre; the first and last half windows use the polynomial of the edge window.

    A chunk is one array, which the coefficients are moved along: one exchange, no join. Chunks shorter than the window keep
    their samples; further columns of the trace stay.
    """
    if width % 2 == 0:
        raise ValueError("the window must be odd")
    half = width // 2
    rows = F.array(*[F.array(*[F.lit(float(c)) for c in row]) for row in savgol_coefficients(width, degree)])
    chunked = chunk_trace(trace, size)
    points = chunked.groupBy("file", "chunk").agg(F.array_sort(F.collect_list(F.struct("idx", F.struct(*trace.columns).alias("row")))).alias("_p"))
    points = points.withColumns({"_y": F.transform("_p", lambda p: p["row"]["y"].cast("double")), "_n": F.size("_p")})

    def fitted(i):
        start = F.least(F.greatest(i - half, F.lit(0)), F.col("_n") - width)  # of the frame: edge samples take the nearest whole one
        return F.aggregate(F.zip_with(F.get(rows, i - start), F.slice("_y", start + 1, F.lit(width)), lambda c, y: c * y), F.lit(0.0), lambda s, v: s + v)

    smooth = F.when(F.col("_n") >= width, F.transform(F.sequence(F.lit(0), F.col("_n") - 1), fitted)).otherwise(F.col("_y"))
    out = points.select("chunk", F.explode(F.arrays_zip(F.col("_p").alias("p"), smooth.alias("smooth"))).alias("_z"))
    return out.select("_z.p.row.*", "chunk", "_z.smooth")


def moving_baseline(trace: DataFrame, width: int = 501, size: int = CHUNK) -> DataFrame:
    """Adds base: the centred mean of ``width`` (made odd) samples of the chunk, its edge values repeated beyond the edges.

    A width below three gives the chunk's mean.
    """
    chunked = chunk_trace(trace, size)
    every = Window.partitionBy("file", "chunk")
    if width < 3:
        return chunked.withColumn("base", F.avg("y").over(every))
    width += 1 - width % 2
    half = width // 2
    w = every.orderBy("idx")
    i, n = F.row_number().over(w) - 1, F.count("*").over(every)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = chunked.withColumns({"_i": i, "_n": n, "_first": F.first("y").over(whole), "_last": F.last("y").over(whole), "_s": F.sum("y").over(w.rowsBetween(-half, half))})
    left = F.greatest(F.lit(half) - F.col("_i"), F.lit(0))
    right = F.greatest(F.lit(half) - (F.col("_n") - 1 - F.col("_i")), F.lit(0))
    return rows.withColumn("base", (F.col("_s") + left * F.col("_first") + right * F.col("_last")) / width).drop("_i", "_n", "_first", "_last", "_s")


def local_threshold(trace: DataFrame, k: float = 6.0, width: int = 501, size: int = CHUNK, reach: int = 500) -> DataFrame:
    """moving_baseline plus k times the population deviation of the chunk and ``reach`` samples to either side."""
    spread = halo(trace, size, reach).groupBy("file", "chunk").agg(F.stddev_pop("y").alias("sd"))
    return moving_baseline(trace, width, size).join(spread, ["file", "chunk"]).withColumn("threshold", F.col("base") + k * F.col("sd"))


def assign_event_ids(events: DataFrame, order: list[str], start: int = 0, out: str = "event_id") -> DataFrame:
    """Consecutive ids by ``order``, whose first column is the file: numbers within a file plus the counts of files before.

    The second column of ``order`` is a position; files are numbered in stretches of ``CHUNK`` positions, none as a whole.
    """
    from .windows import running_id

    file = order[0]
    counts = events.groupBy(file).agg(F.count("*").alias("_c"))
    before = counts.select(file, (F.sum("_c").over(Window.orderBy(file)) - F.col("_c")).alias("_files"))
    numbered = running_id(events, [file], order[1:], F.floor(F.col(order[1]) / CHUNK), "_in_file")
    return numbered.join(before, file).withColumn(out, F.col("_files") + F.col("_in_file") + start).drop("_files", "_in_file")


def collect_events(peaks: DataFrame, trace: DataFrame, quality: DataFrame, start: int = 0) -> DataFrame:
    """Events of all files of quality 1: clips, waves of 12 points, ids."""
    good = peaks.join(quality.where("code = 1").select("file"), "file", "left_semi").where("duration > 10")
    clips = clip_events(good, trace)
    wave = scale_wave(resample_wave(F.col("clip")), F.col("baseline"), F.col("signal"), 5)
    return assign_event_ids(clips.withColumn("wave", wave), ["file", "peak"], start)
