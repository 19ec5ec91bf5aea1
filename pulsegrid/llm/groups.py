"""Whole groups out of sorted Arrow batches, and pairs of blocks for groups too large for one block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(batch, bounds): rows sorted by the first ``n_keys`` integer columns, cut so that groups stay whole.

    The last group of a batch waits for the next one, so memory holds a batch and one group.
    """
    rest: list[pa.RecordBatch] = []

    def starts(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in range(n_keys):
            x = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([*rest, batch]).combine_chunks().to_batches()[0] if rest else batch
        at = starts(whole)
        if at[-1]:
            yield whole.slice(0, at[-1]), at
        rest = [whole.slice(at[-1])]
    if rest:
        yield rest[0], np.append(starts(rest[0]), rest[0].num_rows)


def block_pairs(own: Column, n_blocks: Column) -> Column:
    """Array of (x, y, side) for a row of block ``own``: one for each pair of blocks that it takes part in."""
    return F.transform(
        F.sequence(F.lit(0), n_blocks - 1),
        lambda k: F.struct(F.least(k, own).alias("x"), F.greatest(k, own).alias("y"), (k < own).cast("int").alias("side")),
    )
