"""Packing of documents into fixed windows by non-negative least squares.

Whole windows of long documents fill sequences of their own. What is left of each document has a length below the
window; lengths are counted in bins. Shallow combinations of bins that fill a window (at most ``PARTS`` pieces) are the
columns of a matrix; least squares with non-negative counts fits them to the histogram. Counts are rounded down, a greedy
pass uses up what combinations can still take, and documents that no combination takes are laid end to end and cut at
window borders. Only the histogram (as many entries as bins) reaches the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table
from .tokens import BYTE_BPE, in_batches, token_table, unpack

WINDOW = 2048
GRAIN = 8
PARTS = 3
#: Rows are ordered in runs of 2 ** 10 consecutive keys.
RUN_BITS = 10


# ---------------------------------------------------------------- the fit, on the histogram


def combinations(present: np.ndarray, full: int, parts: int = PARTS, slack: int = 1) -> list[tuple[int, ...]]:
    """Non-increasing tuples of present bins whose sum lies within ``slack`` below ``full``."""
    bins = sorted(int(b) for b in present)
    found: list[tuple[int, ...]] = []

    def grow(chosen: tuple[int, ...], left: int) -> None:
        if chosen and left <= slack:
            found.append(chosen)
        if len(chosen) == parts or left < bins[0]:
            return
        top = min(left, chosen[-1] if chosen else full)
        depth = parts - len(chosen)
        for b in reversed(bins):
            if b <= top:
                if b * depth < left - slack:
                    break
                grow((*chosen, b), left - b)

    if bins:
        grow((), full)
    return found


def nnls(a: np.ndarray, h: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Non-negative least squares by an active set: minimise |a x - h| over x >= 0.

    Warns where it has not converged after ``rounds`` exchanges (default: ten for each row and column that can be active).
    """
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ h).max(initial=0)))
    gram, moment = a.T @ a if n <= 4000 else None, a.T @ h
    for _ in range(10 * sum(a.shape) if rounds is None else rounds):
        gradient = a.T @ (h - a @ x)
        gradient[passive] = -np.inf
        best = int(np.argmax(gradient)) if n else 0
        if not n or gradient[best] <= tolerance:
            return x
        passive[best] = True
        while True:
            on = np.flatnonzero(passive)
            part = a[:, on]
            solved = np.linalg.lstsq(gram[np.ix_(on, on)] if gram is not None else part.T @ part, moment[on], rcond=None)[0]
            if (solved > 0).all():
                x[:] = 0
                x[on] = solved
                break
            bad = solved <= 0
            step = np.min(x[on][bad] / np.maximum(x[on][bad] - solved[bad], 1e-300))
            x[on] += step * (solved - x[on])
            drop = on[bad & (x[on] <= 1e-12)]
            if not len(drop):
                drop = on[bad][:1]
            passive[drop] = False
            x[drop] = 0
            if not passive.any():
                break
    warnings.warn("the fit of the histogram has not converged; the greedy pass takes up what it leaves", stacklevel=2)
    return x


def solve(histogram: dict[int, int], full: int, parts: int = PARTS) -> list[tuple[tuple[int, ...], int]]:
    """(combination, times) that never takes more pieces of a bin than there are."""
    present = np.array(sorted(b for b, n in histogram.items() if n > 0), int)
    combos = combinations(present, full, parts)
    if not combos:
        return []
    row = {int(b): k for k, b in enumerate(present)}
    a = np.zeros((len(present), len(combos)))
    for k, combo in enumerate(combos):
        for b in combo:
            a[row[b], k] += 1
    left = {int(b): histogram[int(b)] for b in present}
    fitted = nnls(a, np.array([histogram[int(b)] for b in present], float))
    taken = [0] * len(combos)

    def take(k: int, most: int) -> None:
        need: dict[int, int] = {}
        for b in combos[k]:
            need[b] = need.get(b, 0) + 1
        times = min(most, *(left[b] // c for b, c in need.items()))
        if times > 0:
            taken[k] += times
            for b, c in need.items():
                left[b] -= c * times

    for k in np.argsort(-fitted):
        if fitted[k] >= 1:
            take(int(k), int(fitted[k]))
    for k in sorted(range(len(combos)), key=lambda k: (-sum(combos[k]), len(combos[k]), combos[k])):
        take(k, 1 << 62)
    return [(c, t) for c, t in zip(combos, taken, strict=True) if t]


def _slots(plan: list[tuple[tuple[int, ...], int]]):
    """Per bin: from which rank on a slot of a combination is filled, the sequence it begins with and its slot number."""
    spans: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for combo, times in plan:
        for slot, b in enumerate(combo):
            spans.setdefault(b, []).append((used.get(b, 0), base, slot))
            used[b] = used.get(b, 0) + times
        base += times
    return {b: tuple(np.array(s, np.int64).T) for b, s in spans.items()}, used, base


def _assign(spans, used):
    """Adds sequence (-1: none) and slot for bin and rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, ranks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5))
            seq, slot = np.full(len(bins), -1, np.int64), np.zeros(len(bins), np.int64)
            for b in np.unique(bins):
                if int(b) in spans:
                    at = np.flatnonzero((bins == b) & (ranks < used[int(b)]))
                    start, first, number = spans[int(b)]
                    k = np.searchsorted(start, ranks[at], side="right") - 1
                    seq[at], slot[at] = first[k] + ranks[at] - start[k], number[k]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(4)), pa.array(seq), pa.array(slot)], ["key", "part", "whole", "rest", "seq", "slot"]
            )

    return run


# ---------------------------------------------------------------- pieces


def _before(value: str, within: str | None, order: tuple[str, ...]):
    """Sum of ``value`` over the rows ahead in the order."""
    w = Window.partitionBy(within).orderBy(*order) if within else Window.orderBy(*order)
    return F.sum(value).over(w) - F.col(value)


_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
)


def _piece_batches(window: int, stream_base: int, whole_base: int):
    def rows(batches):
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc, packed, whole, seq, offset, run_at, whole_at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = unpack(packed, press).astype("<u4")
                n = len(ids)
                cuts = [(k * window, window, whole_base + whole_at + k, 0) for k in range(whole)]
                at = whole * window
                if at < n and seq >= 0:
                    cuts.append((at, n - at, seq, offset))
                elif at < n:
                    while at < n:
                        long = min(n - at, window - run_at % window)
                        cuts.append((at, long, stream_base + run_at // window, run_at % window))
                        at, run_at = at + long, run_at + long
                for start, length, sequence, place in cuts:
                    yield doc, start, length, n, sequence, place, ids[start : start + length].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(rows(batches), _PIECES, lambda r: len(r[6]))

    return run


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = BYTE_BPE, window: int = WINDOW, end_id: int = 1, grain: int = GRAIN, parts: int = PARTS
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian uint32 bytes).

    Defined cases: null and empty texts are the end id alone; repeated rows and ids are packed each on its own; a null
    id stays null; texts longer than a window are cut at multiples of it; an empty table gives no piece; columns other
    than id and text are not read. Every id lies in exactly one piece. Padding: at most ``grain`` tokens a piece and
    the last sequence of the end-to-end run.

    Rows are ordered only within runs of ``2 ** RUN_BITS`` keys. Ranks within a bin and places in the end-to-end run come
    from sums over runs, and over writing partitions, so no bin or partition, however large, is ordered in one task.
    """
    tokens = token_table(docs, id_col, text_col, tokenizer, end_id)
    rest = F.pmod("n", F.lit(window))
    lengths = tokens.select(
        "key", F.shiftright("key", 33).alias("part"), F.shiftright("key", RUN_BITS).alias("run_no"), F.expr(f"n div {window}").alias("whole"),
        rest.alias("rest"), F.ceil(rest / grain).cast("long").alias("bin"),
    )
    counts = lengths.groupBy("bin", "part", "run_no").agg(F.count("*").alias("c"))
    ahead = stored(counts.select("bin", "part", "run_no", "c", _before("c", "bin", ("part", "run_no")).alias("ahead")), "bins")
    histogram = {r.bin: r.n for r in ahead.groupBy("bin").agg(F.sum("c").alias("n")).collect() if r.bin}
    spans, used, n_mixed = _slots(solve(histogram, window // grain, parts))

    place = F.row_number().over(Window.partitionBy("run_no", "bin").orderBy("key")) - 1
    ranked = lengths.withColumn("k", place).join(ahead.select("bin", "run_no", "ahead"), ["run_no", "bin"])
    ranked = ranked.select("key", "run_no", "whole", "rest", "bin", (F.col("ahead") + F.col("k")).alias("rank"))
    placed = stored(ranked.mapInArrow(_assign(spans, used), "key long, run_no long, whole long, rest long, seq long, slot long"), "placed")

    loose = F.when(F.col("seq") < 0, F.col("rest")).otherwise(0)
    sums = placed.groupBy("run_no").agg(F.sum(loose).alias("run"), F.sum("whole").alias("wholes")).withColumn("part", F.shiftright("run_no", 33 - RUN_BITS))
    totals = sums.groupBy("part").agg(F.sum("run").alias("run"), F.sum("wholes").alias("wholes"))
    totals = stored(totals.select("part", "run", _before("run", None, ("part",)).alias("run0"), _before("wholes", None, ("part",)).alias("whole0")), "parts")
    total = totals.agg(F.coalesce(F.sum("run"), F.lit(0))).first()[0]
    stream_base, whole_base = n_mixed, n_mixed + -(-total // window)
    runs_at = sums.select("part", "run_no", _before("run", "part", ("run_no",)).alias("run1"), _before("wholes", "part", ("run_no",)).alias("whole1"))
    runs_at = runs_at.join(totals, "part").select("run_no", (F.col("run0") + F.col("run1")).alias("run0"), (F.col("whole0") + F.col("whole1")).alias("whole0"))

    own = Window.partitionBy("run_no").orderBy("key")
    at = placed.select(
        "key", "run_no", "whole", "rest", "seq", "slot",
        (F.sum(loose).over(own) - loose).alias("run2"), (F.sum("whole").over(own) - F.col("whole")).alias("whole2"),
    ).join(runs_at, "run_no")
    at = at.select("key", "whole", "seq", "slot", "rest", (F.col("run0") + F.col("run2")).alias("run_at"), (F.col("whole0") + F.col("whole2")).alias("whole_at"))
    inside = F.sum("rest").over(Window.partitionBy("seq").orderBy("slot")) - F.col("rest")
    mixed = at.where("seq >= 0").withColumn("offset", inside)
    alone = at.where("seq < 0").withColumn("offset", F.lit(0).cast("long"))
    where = mixed.unionByName(alone)
    joined = tokens.select("key", "doc_id", "packed").join(where, "key").select("doc_id", "packed", "whole", "seq", "offset", "run_at", "whole_at")
    return joined.mapInArrow(
        _piece_batches(window, stream_base, whole_base), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )


def op6_query(spark, sf_dir):
    pieces = pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
