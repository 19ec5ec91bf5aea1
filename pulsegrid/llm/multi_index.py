"""Embedding near-dedup with an inverted multi-index.

Vectors are scaled to unit length and cut into halves. Each half has a codebook of its own (k-means on a bounded sample);
the pairs of codewords form a grid of cells. A vector is stored in the cell of its nearest codewords. To find its links it
visits cells in order of growing distance, by a traversal of the two sorted codeword lists, and stops after as many cells
as reach the target recall; what lies in those cells is verified by the cosine in double precision.

How many cells that is, is measured: sampled vectors are turned by exactly the angle of the threshold, in random
directions, and the rank of the turned vector's cell in the traversal is recorded. Links above the threshold rank lower.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import same, stored, table
from .components import connected_components, forest
from .groups import block_pairs, sorted_groups

MIN_COSINE = 0.98
TARGET_RECALL = 0.999
#: Vectors that the index is fitted on at most; a codebook has a quarter as many words at most.
MAX_SAMPLE = 20_000
#: Vectors that a cell holds on average; the codebooks grow with the square root of the table.
CELL_ROWS = 128
BLOCK = 1024


# ---------------------------------------------------------------- codebooks and traversal


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([distances(x[at : at + 2048], centres).argmin(axis=1) for at in range(0, len(x), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        sizes = np.bincount(near, minlength=k)
        full = sizes > 0
        centres[full] = sums[full] / sizes[full, None]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1))


def multi_sequence(d1: np.ndarray, d2: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (n, many) in both codebooks of the ``many`` cells of smallest d1[i] + d2[j], in that order, for n vectors.

    The traversal of two sorted lists, for all vectors in step: each row of the grid keeps how far it has been visited, the
    nearest of the rows' next cells is visited, and a row joins once the one before it has been entered.
    """
    many = min(many, d1.shape[1] * d2.shape[1])
    o1, o2 = (np.argsort(d, axis=1, kind="stable")[:, :many] for d in (d1, d2))
    s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
    n, rows, width = len(d1), s1.shape[1], s2.shape[1]
    s2 = np.hstack([s2, np.full((n, 1), np.inf)])
    every = np.arange(n)
    upto = np.zeros((n, rows), np.int64)
    front = np.full((n, rows), np.inf)
    front[:, 0] = s1[:, 0] + s2[:, 0]
    a, b = np.empty((n, many), np.int64), np.empty((n, many), np.int64)
    for step in range(many):
        row = front.argmin(axis=1)
        col = upto[every, row]
        a[:, step], b[:, step] = row, col
        upto[every, row] = col + 1
        front[every, row] = s1[every, row] + s2[every, np.minimum(col + 1, width)]
        new = np.flatnonzero((col == 0) & (row + 1 < rows))
        front[new, row[new] + 1] = s1[new, row[new] + 1] + s2[new, 0]
    return np.take_along_axis(o1, a, 1), np.take_along_axis(o2, b, 1)


def nearest_cells(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], many: int) -> np.ndarray:
    """(n, many) cell numbers in the order of the traversal, its first one the vector's own cell."""
    half = books[0].shape[1]
    i, j = multi_sequence(distances(x[:, :half], books[0]), distances(x[:, half:], books[1]), many)
    return i * len(books[1]) + j


def calibrate(sample: np.ndarray, books: tuple[np.ndarray, np.ndarray], cosine: float, recall: float, seed: int = 11) -> int:
    """Cells to visit so that a vector turned by the threshold's angle is met with probability ``recall``."""
    if recall >= 1:
        return len(books[0]) * len(books[1])
    rng = np.random.default_rng(seed)
    x = sample[rng.integers(0, len(sample), 4000)]
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(axis=1)[:, None] * x
    aside /= np.maximum(np.linalg.norm(aside, axis=1), 1e-12)[:, None]
    turned = cosine * x + np.sqrt(1 - cosine * cosine) * aside
    home = nearest_cells(turned, books, 1)
    many, grid = 128, len(books[0]) * len(books[1])
    while True:
        met = np.concatenate([nearest_cells(x[at : at + 500], books, many) == home[at : at + 500] for at in range(0, len(x), 500)])
        cells = int(np.quantile(np.where(met.any(axis=1), met.argmax(axis=1), many), recall, method="higher")) + 1
        if cells <= many or many >= grid:
            return min(cells, grid)
        many *= 4


# ---------------------------------------------------------------- Arrow jobs


def _unit(rows) -> np.ndarray:
    """Unit vectors; by the largest component first, so that no square vanishes or overflows."""
    x = np.array(rows, np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _cell_batches(books, cells: int, kind: str):
    """Each vector once as a member of its own cell and once as a visitor of each later one of its nearest cells.

    Two linked vectors meet in the higher of their two cells, where the vector of the lower one visits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                node, label, copies = (part.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                vectors = np.array(part.column(3).to_pylist(), kind)
                near = nearest_cells(_unit(vectors), books, cells)
                who, rank = np.nonzero(near >= near[:, :1])
                raw = [v.tobytes() for v in vectors]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label[who]), pa.array(near[who, rank]), pa.array((rank > 0).astype(np.int32)), pa.array(node[who]), pa.array(copies[who]), pa.array([raw[w] for w in who], pa.binary())],
                    ["label", "cell", "visitor", "node", "copies", "x"],
                )

    return run


def _link_batches(cosine: float, kind: str):
    """Per group: weighted links of each vector, and edges to the smallest vector it is joined with."""

    def one(side, visitor, copies, raw):
        x = _unit(np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        within = not len(right)
        if within:
            left, right = np.flatnonzero(visitor == 0), np.arange(len(side))
        close = x[left] @ x[right].T >= cosine
        close &= (visitor[left] == 0)[:, None] | (visitor[right] == 0)
        if within:
            close &= left[:, None] != right
        a, b = np.nonzero(close)
        counts = np.zeros(len(side), np.int64)
        counts[left] += close @ copies[right]
        other = close.T @ copies[left]
        counts[right] += other if not within else np.where(visitor[right] == 1, other, 0)
        return counts, forest(len(side), left[a], right[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in sorted_groups(batches, 4):
            side, visitor, node, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5, 6, 7))
            raw = batch.column(8).to_pylist()
            nodes, links, roots = [], [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a > 1 and not visitor[a:b].all():
                    counts, root = one(side[a:b], visitor[a:b], copies[a:b], raw[a:b])
                    some = np.flatnonzero(counts)
                    nodes.append(node[a:b][some])
                    links.append(counts[some])
                    roots.append(node[a:b][root[some]])
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (nodes, links, roots)], ["node", "links", "root"])

    return run


# ---------------------------------------------------------------- operator


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = MIN_COSINE,
                    recall: float = TARGET_RECALL, max_sample: int = MAX_SAMPLE, cell_rows: int = CELL_ROWS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row.

    Only vectors of the same label and length are compared. Defined cases: vectors that are null, empty, zero
    or hold null or non-finite components, and those with a null label, link with nothing; equal vectors of a label
    are one node with a multiplicity, each other copy counts as a link; repeated ids are rows of their own and name a
    component together; a null id is never kept unless it is alone; an empty table gives an empty table; other columns are not read.

    Cells that hold more than ``block`` vectors are cut into blocks and each pair of blocks is one group.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.col("v").isNotNull() & F.col("label").isNotNull() & finite
    usable = F.coalesce(whole & F.exists("v", lambda x: x != 0), F.lit(False))
    keyed = rows.select("id", "label", "v", usable.alias("ok"), F.xxhash64("v").alias("a"), F.xxhash64(F.lit("second"), "v").alias("b"))
    good = keyed.where("ok").groupBy("label", "a", "b").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
    nodes = stored(good.select(F.monotonically_increasing_id().alias("node"), "*"), "vectors")

    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    partial = None
    for r in nodes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect():
        own = nodes.where(F.size("v") == r.d)
        sample = _unit([x.v for x in own.orderBy(F.xxhash64("a", "label"), "node").select("v").limit(max_sample).collect()])
        k = int(np.clip(np.sqrt(r.n / cell_rows), 1, max(1, len(sample) // 4)))
        half = max(1, r.d // 2)
        books = (k_means(sample[:, :half], k), k_means(sample[:, half:], k) if r.d > 1 else np.zeros((1, 0)))
        cells = calibrate(sample, books, cosine, recall)
        found = _found(own.select("node", "label", "copies", "v"), books, cells, cosine, block, kind).withColumn("label", F.lit(0))
        partial = found if partial is None else partial.union(found)

    if partial is None:
        named = nodes.select("label", "a", "b", F.lit(0).cast("long").alias("links"), F.col("least").alias("component_id"), "copies")
    else:
        partial = stored(partial.drop("label"), "links")
        counts = partial.groupBy("node").agg(F.sum("links").alias("links"))
        roots = connected_components(partial.select(F.col("node").alias("u"), F.col("root").alias("v")))
        placed = stored(
            nodes.select("node", "label", "a", "b", "least", "copies").join(counts, "node", "left").join(roots, "node", "left")
            .select("label", "a", "b", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), "placed"
        )
        names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
        named = placed.join(names, "root").select("label", "a", "b", "links", "component_id", "copies")
    left = keyed.select("id", F.when(F.col("ok"), F.col("label")).alias("l"), F.when(F.col("ok"), F.col("a")).alias("ha"), "b")
    out = left.join(named, (F.col("l") == F.col("label")) & (F.col("ha") == F.col("a")) & (left["b"] == named["b"]), "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        same(F.col("id"), component).alias("kept"),
    )


def _found(nodes: DataFrame, books, cells: int, cosine: float, block: int, kind: str) -> DataFrame:
    """Vectors travel as they are given (``kind``: their number type) and are scaled to unit length in doubles where they meet."""
    placed = nodes.mapInArrow(_cell_batches(books, cells, kind), "label long, cell long, visitor int, node long, copies long, x binary")
    sizes = nodes.mapInArrow(_cell_batches(books, cells, kind), "label long, cell long, visitor int, node long, copies long, x binary")
    sizes = sizes.groupBy("label", "cell").agg(F.count("*").alias("n"), F.min("visitor").alias("lone")).where("n > 1 and lone = 0")
    cut = placed.join(sizes.withColumn("s", F.ceil(F.col("n") / block).cast("int")), ["label", "cell"])
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("s")).cast("int"))
    tiles = cut.select("label", "cell", F.explode(block_pairs(F.col("own"), F.col("s"))).alias("t"), "visitor", "node", "copies", "x")
    grouped = tiles.select("label", "cell", "t.x", "t.y", "t.side", "visitor", "node", "copies", F.col("x").alias("v"))
    grouped = grouped.repartition("label", "cell", "x", "y").sortWithinPartitions("label", "cell", "x", "y")
    return grouped.mapInArrow(_link_batches(cosine, kind), "node long, links long, root long")


def op2_query(spark, sf_dir):
    return embedding_links(table(spark, sf_dir, "embeddings"))
