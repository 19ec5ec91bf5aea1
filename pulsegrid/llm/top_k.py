"""Exact top-k search by inner product: tiles of queries against shards of candidates.

Queries and candidates become blocks, each one row with its ids and its matrix. A shard is a bounded number of candidate
blocks; it is sent once, and every block of queries once to each shard, where an equi-join lets all of them meet. A task
multiplies two matrices, selects the best of the tile and merges them into the list it keeps per query block. Lists of different tasks merge in two more levels by ranking
windows, whose group limit works before each shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

QUERY_BLOCK = 4096
SHARD_ROWS = 8192
TILE_ROWS = 256
#: Candidate blocks of a shard at most: what a task holds while the query blocks pass.
SHARD_BLOCKS = 64


def _narrow(x: np.ndarray) -> tuple[str, bytes]:
    top = float(np.abs(x).max(initial=0))
    kind = "<i1" if top < 2**7 else "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
    return kind, x.astype(kind).tobytes()


#: Kind of a block with components that overflow when scaled: they are kept as they are and scaled as whole numbers.
RAW = "raw"


def _matrix(data: bytes, kind: str, rows: int, dim: int, factor: float) -> np.ndarray:
    """Doubles of whole numbers, or Python's integers for a raw block."""
    if kind != RAW:
        return np.frombuffer(data, kind).astype(np.float64).reshape(rows, dim)
    whole = [math.floor(Fraction(factor) * Fraction(v)) for v in np.frombuffer(data, "<f8").tolist()]
    return np.array(whole, object).reshape(rows, dim)


_BLOCK_SQL = "dim long, ids binary, kind string, x binary"


def _block_batches(factor: float, rows: int):
    """Vectors with finite components as blocks of floor(factor * component), one dimension to a block."""

    def pack(dim: int, ids: list, vectors: list):
        x = np.array(vectors, np.float64).reshape(len(ids), dim)
        with np.errstate(over="ignore"):
            scaled = np.floor(factor * x)
        kind, data = _narrow(scaled) if np.isfinite(scaled).all() else (RAW, x.astype("<f8").tobytes())
        return [[dim], [np.array(ids, "<i8").tobytes()], [kind], [data]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def out(dim):
            ids, vectors = held.pop(dim)
            types = (pa.int64(), pa.binary(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(pack(dim, ids, vectors), types, strict=True)], ["dim", "ids", "kind", "x"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) == rows:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return run


def best_of(scores: np.ndarray, taken: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the k highest scores (int64) of each row, ties to the smaller id; entries not ``taken`` are left out.

    Scores and ids become one key per entry where they fit 63 bits together; else rows are sorted one by one.
    """
    order = np.argsort(ids, kind="stable")
    n = len(ids)
    shift = max(1, int(n - 1).bit_length()) if n else 1
    top = max(abs(int(scores.max(initial=0))), abs(int(scores.min(initial=0))))
    if top < 2 ** (61 - shift):
        key = scores[:, order] * (1 << shift) + (n - 1 - np.arange(n))
        key[~taken[:, order]] = np.iinfo(np.int64).min
        if n > k:
            part = np.argpartition(key, n - k, axis=1)[:, n - k :]
        else:
            part = np.broadcast_to(np.arange(n), (len(scores), n))
        row = np.repeat(np.arange(len(scores)), part.shape[1])
        col = order[part.ravel()]
    else:
        picks = []
        for r in range(len(scores)):
            own = order[taken[r, order]]
            picks.append(own[np.argsort(~scores[r, own], kind="stable")[:k]])  # ~s falls as s rises, without overflow
        row = np.repeat(np.arange(len(scores)), [len(p) for p in picks])
        col = np.concatenate(picks) if picks else np.zeros(0, int)
    some = taken[row, col]
    return row[some], ids[col[some]], scores[row[some], col[some]]


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products as int64: in doubles while sums stay below 2^53, in int64 below 2^63, else in Python's integers.

    What lies beyond int64 becomes the nearest int64.
    """
    high = lambda v: float(np.abs(v).max(initial=0))
    bound = math.inf if object in (q.dtype, x.dtype) else high(q) * high(x) * q.shape[1]
    if bound < 2.0**53:
        return (q @ x.T).astype(np.int64)
    if bound < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    exact = np.vectorize(int, otypes=[object])
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    return np.clip(exact(q) @ exact(x).T, least, most).astype(np.int64)


def _tile_batches(k: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def merge(number, found):
            if number in lists:
                found = [np.concatenate([a, b]) for a, b in zip(lists[number], found, strict=True)]
            q, c, s = found
            order = np.lexsort((c, ~s, q))
            q, c, s = q[order], c[order], s[order]
            start = np.flatnonzero(np.diff(q, prepend=q[0] - 1)) if len(q) else np.zeros(0, int)
            rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
            lists[number] = (q[rank < k], c[rank < k], s[rank < k])

        for batch in batches:
            for number, dim, qids, qkind, qx, cids, ckind, cx in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q_ids, c_ids = np.frombuffer(qids, "<i8"), np.frombuffer(cids, "<i8")
                q, x = _matrix(qx, qkind, len(q_ids), dim, factor), _matrix(cx, ckind, len(c_ids), dim, factor)
                found = []
                for at in range(0, len(q_ids), TILE_ROWS):
                    own = q_ids[at : at + TILE_ROWS]
                    scores = _product(q[at : at + TILE_ROWS], x)
                    row, ids, best = best_of(scores, own[:, None] != c_ids[None, :], c_ids, k)
                    found.append((own[row], ids, best))
                merge(number, [np.concatenate(c) for c in zip(*found, strict=True)])
        for q, c, s in lists.values():
            for at in range(0, len(q), 50_000):
                part = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(q[part]), pa.array(c[part]), pa.array(s[part])], ["query_id", "vec_id", "score"])

    return run


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, factor: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding",
                query_block: int = QUERY_BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank from 1, vec_id, score long): for each query the k candidates of highest integer inner product.

    Components become floor(factor * x). A candidate whose id is the query's is left out; ties go to the smaller id.
    Defined cases: vectors that are null or hold null or non-finite components, and rows without id, take no part; only
    vectors of equal length are compared; a query id that occurs more than once is asked once, with its least vector;
    repeated candidate rows count each; fewer than k candidates give shorter lists; empty tables give an empty table; a score
    beyond long's range counts as the nearest long.

    What is shuffled: the candidates once, and the queries once per shard. The work is the product of both tables by
    definition; a task holds the blocks of one shard and one block of queries at a time.
    """

    def usable(df):
        finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(
            F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")
        )

    asked = usable(queries).groupBy("id").agg(F.min("v").alias("v"))
    q_blocks = stored(asked.mapInArrow(_block_batches(factor, query_block), _BLOCK_SQL), "query-blocks")
    c_blocks = stored(usable(candidates).mapInArrow(_block_batches(factor, shard_rows), _BLOCK_SQL), "shards")
    q_rows = q_blocks.select(F.monotonically_increasing_id().alias("number"), F.col("dim"), F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("x").alias("q_x"))
    q_rows = stored(q_rows, "queries")
    blocks = max(1, c_blocks.count())
    shards = max(-(-blocks // SHARD_BLOCKS), min(blocks, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    spread = q_rows.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = c_blocks.withColumn("shard", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(shards)).cast("int"))
    dealt = dealt.select("shard", "dim", F.col("ids").alias("c_ids"), F.col("kind").alias("c_kind"), F.col("x").alias("c_x"))
    met = spread.hint("shuffle_merge").join(dealt, ["shard", "dim"])
    met = met.select("number", "dim", "q_ids", "q_kind", "q_x", "c_ids", "c_kind", "c_x")
    lists = met.mapInArrow(_tile_batches(k, factor), "query_id long, vec_id long, score long")

    def merged(df, *keys):
        place = F.row_number().over(Window.partitionBy("query_id", *keys).orderBy(F.desc("score"), "vec_id"))
        return df.withColumn("rank", place).where(F.col("rank") <= k)

    half = merged(lists.withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(8))), "branch").drop("rank", "branch")
    return merged(half).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_query(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return exact_top_k(rows.where("vec_id % 20 = 0"), rows)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 20
"""
