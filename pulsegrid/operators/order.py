"""Order statistics over counts of values: cumulated counts, and the percentiles and ranks that follow from them.

Counts of (part, value) are dealt out by range, so partitions grow in number with the data and neither a part nor a common
value is ordered in one task: a value is one row however often it occurs. Each partition adds up its own counts; the sums
of whole partitions shift the rest. The counts with their local sums are written once, and every percentile, rank and
number of a plan reads that table: its source is scanned once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.sources.shared import stored

#: Parts whose totals are broadcast; with more the join is left to the planner.
FEW = 100_000


def _changes(column: pa.Array, before) -> np.ndarray:
    """True where a value differs from the one before it; null equals null. ``before``: one-element array ahead of the first, or None."""
    whole = column if before is None else pa.concat_arrays([before, column])
    here, there = whole.slice(1), whole.slice(0, len(whole) - 1)
    differs = pc.fill_null(pc.not_equal(here, there), False)
    null = pc.xor(pc.is_null(here), pc.is_null(there))
    out = np.asarray(pc.or_(differs, null))
    return np.append(True, out) if before is None else out


def _running_sums(n_parts: int):
    """Adds the sum of the column before the last since the part began; the parts are the first ``n_parts`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, last = 0, [None] * n_parts
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.zeros(len(n), bool)
            for k in range(n_parts):
                new |= _changes(batch.column(k), last[k])
                last[k] = batch.column(k).slice(len(n) - 1)
            sums = np.cumsum(n) + carried
            starts = np.flatnonzero(new)
            if len(starts):
                base = np.append(0, sums[starts] - n[starts])[np.searchsorted(starts, np.arange(len(n)), side="right")]
                sums = sums - base
            carried = int(sums[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums)], [*batch.schema.names, "_local"])

    return run


def cumulated(counts: DataFrame, part: list[str], col: str, n: str, desc: bool = False, name: str = "counts") -> DataFrame:
    """``counts`` with ``_upto``, the sum of ``n`` up to and with a row in the order of ``col`` in its part (NULL last), and
    ``_total``, the sum over the part. Rows of equal value are in any order."""
    order = F.col(col).desc_nulls_last() if desc else F.col(col).asc_nulls_last()
    rest = [c for c in counts.columns if c not in (*part, n)]
    keys = [F.col(c) for c in part]
    dealt = counts.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order).select(*part, *rest, F.col(n).cast("long").alias(n), F.spark_partition_id().alias("_range"))
    schema = T.StructType([*dealt.schema.fields, T.StructField("_local", T.LongType())])
    rows = stored(dealt.mapInArrow(_running_sums(len(part)), schema), name)
    sums = stored(rows.groupBy(*part, "_range").agg(F.max("_local").alias("_sum")), f"{name}-sums")
    ahead = F.sum("_sum").over(Window.partitionBy(*part).orderBy("_range")) - F.col("_sum")
    # a part goes on from one range to the next only as the first of a range, so there is one row a range at most
    shifts = sums.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(part)], F.col("_range").alias("_at"), ahead.alias("_ahead")).where("_ahead > 0")
    own = F.col("_range") == F.col("_at")
    for i, c in enumerate(part):
        own = own & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out = rows.join(F.broadcast(shifts), own, "left").withColumn("_upto", F.col("_local") + F.coalesce("_ahead", F.lit(0)))
    totals = sums.groupBy(*part).agg(F.sum("_sum").alias("_total"))
    totals = totals.select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(part)], "_total")
    if totals.count() <= FEW:
        totals = F.broadcast(totals)
    same = F.lit(True)
    for i, c in enumerate(part):
        same = same & F.col(c).eqNullSafe(F.col(f"_t{i}"))
    out = out.join(totals, same) if part else out.crossJoin(totals)
    return out.select(*counts.columns, "_upto", "_total")


def percentiles_of(rows: DataFrame, col: str, part: list[str], shares: dict[str, float], below: Column | None = None, total: Column | None = None, *more: Column) -> DataFrame:
    """Per part of ``cumulated`` rows the percentiles {name: share}, linear between neighbours, and the aggregates ``more``.

    below, total: where the values wanted begin in the order and how many they are; all of a part if not given.
    """
    total = F.col("_total") if total is None else total
    picks, out = [], []
    for name, share in shares.items():
        at = (total - 1) * F.lit(share)
        low, high = F.floor(at), F.ceil(at)
        if below is not None:
            low, high = low + below, high + below
        picks += [F.min(F.when(F.col("_upto") > low, F.col(col))).alias(f"_lo_{name}"), F.min(F.when(F.col("_upto") > high, F.col(col))).alias(f"_hi_{name}"), F.first(at - F.floor(at)).alias(f"_w_{name}")]
        out.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * F.col(f"_w_{name}")).alias(name))
    found = rows.groupBy(*part).agg(*picks, *more)
    return found.select(*part, *out, *[c for c in found.columns[len(part) + len(picks) :]])


def exact_percentiles(counts: DataFrame, col: str, n: str, part: list[str], shares: dict[str, float]) -> DataFrame:
    """Per ``part`` the percentiles {name: share} of numeric values with multiplicities."""
    return percentiles_of(cumulated(counts.where(F.col(col).isNotNull()), part, col, n), col, part, shares)


def tie_ranks(counts: DataFrame, part: list[str], col: str, n: str, desc: bool = False) -> DataFrame:
    """(part, col, n, _rank): the average rank of the rows of each distinct value. ``counts`` has one row a value."""
    rows = cumulated(counts.select(*part, col, n), part, col, n, desc, "ties")
    return rows.select(*part, col, n, (F.col("_upto") - (F.col(n) - 1) / 2).alias("_rank"))
