"""Token files: canonical length-limited Huffman codes over token ids.

Format of a folder: ``codebook`` has one row (symbol, length) for each id that occurs; the code words follow canonically
(by length, then symbol). ``blocks`` has rows in ascending document order: shard, block, first (ids before it in its
shard), docs and counts (the documents in it), bits (the code words, first bit highest), marks (bit position of every
``STEP``-th id, little-endian uint64). A block decodes without its neighbours, and from any mark on. Both are Parquet
tables, so any store that Spark reaches can hold them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import passing, shared_dir, table
from .tokens import BYTE_BPE, in_batches, token_table, unpack

MAX_LENGTH = 20
STEP = 128
BLOCK_IDS = 65536

# ---------------------------------------------------------------- code


def code_lengths(weights: np.ndarray, limit: int = MAX_LENGTH) -> np.ndarray:
    """Optimal code word lengths of at most ``limit`` bits (package-merge); weights are positive."""
    n = len(weights)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need code words of more than {limit} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(weights, kind="stable")
    leaves = weights[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        is_leaf.append(rank < n)
    depth, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        own = int(flags[:take].sum())
        depth[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = depth
    return out


def canonical(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, lengths, code words) by length and symbol."""
    order = np.lexsort((symbols, lengths))
    s, ln = symbols[order], lengths[order]
    top = int(ln[-1]) if len(ln) else 0
    steps = np.left_shift(np.int64(1), top - ln)
    return s, ln, (np.cumsum(steps) - steps) >> (top - ln)


def encode_bits(codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code words end to end, first bit highest, and the bit position of each."""
    ends = np.cumsum(lengths)
    at = ends - lengths
    if not len(at):
        return b"", at
    word, room = at >> 6, 64 - (at & 63) - lengths
    value = codes.astype(np.uint64)
    fits = room >= 0
    here = np.where(fits, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
    out = np.zeros(int(ends[-1] + 63) // 64 + 1, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(here, first)
    over = np.flatnonzero(~fits)
    out[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: int(ends[-1] + 7) // 8], at


class Decoder:
    """One table of 2^longest entries gives symbol and length for the next bits; all marks of many blocks advance together."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        s, ln, _ = canonical(symbols, lengths)
        self.top = int(ln[-1]) if len(ln) else 1
        spread = np.left_shift(1, self.top - ln)
        self.symbol = np.repeat(s, spread).astype(np.uint32)
        self.length = np.repeat(ln, spread).astype(np.int64)
        if len(self.symbol) < 1 << self.top:  # a lone symbol fills half the table
            self.symbol = np.resize(self.symbol, 1 << self.top)
            self.length = np.resize(self.length, 1 << self.top)

    def __call__(self, blocks: list[tuple[bytes, np.ndarray, int]]) -> list[np.ndarray]:
        """blocks of (bits, marks, number of ids) -> ids of each."""
        total = sum(n for _, _, n in blocks)
        if not total:
            return [np.zeros(0, np.uint32) for _ in blocks]
        base = np.cumsum([0] + [len(b) for b, _, _ in blocks])
        raw = np.frombuffer(b"".join([b for b, _, _ in blocks] + [b"\0" * 8]), np.uint8).astype(np.uint32)
        ahead = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        start = np.cumsum([0] + [n for _, _, n in blocks])
        at = np.concatenate([m.astype(np.int64) + 8 * base[k] for k, (_, m, _) in enumerate(blocks)])
        to = np.concatenate([start[k] + STEP * np.arange(len(m)) for k, (_, m, _) in enumerate(blocks)])
        many = np.concatenate([np.minimum(STEP, n - STEP * np.arange(len(m))) for _, m, n in blocks])
        order = np.argsort(-many, kind="stable")
        at, to, many = at[order], to[order], many[order]
        out = np.empty(total, np.uint32)
        shift, mask = 32 - self.top, (1 << self.top) - 1
        live = len(at)
        for step in range(STEP):
            if live and many[live - 1] <= step:
                live = int(np.searchsorted(-many, -step, side="left"))
            if not live:
                break
            now = at[:live]
            peek = (ahead[now >> 3] >> (shift - (now & 7)).astype(np.uint32)) & mask
            out[to[:live] + step] = self.symbol[peek]
            now += self.length[peek]
        return [out[a:b] for a, b in zip(start, start[1:], strict=False)]


# ---------------------------------------------------------------- files

_BLOCKS = pa.schema(
    [("shard", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("bits", pa.binary()), ("marks", pa.binary())]
)
_BLOCKS_SQL = "shard long, block long, first long, n long, docs array<bigint>, counts array<bigint>, bits binary, marks binary"
_IDS = pa.schema([("doc_id", pa.int64()), ("shard", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press, sums = zstandard.ZstdDecompressor(), np.zeros(0, np.int64)
    for batch in batches:
        ids = [unpack(p, press) for p in batch.column(0).to_pylist()]
        if ids:
            more = np.bincount(np.concatenate(ids))
            if len(more) > len(sums):
                sums = np.concatenate([sums, np.zeros(len(more) - len(sums), np.int64)])
            sums[: len(more)] += more
    some = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["symbol", "n"])


def _block_batches(symbols: np.ndarray, lengths: np.ndarray):
    s, ln, codes = canonical(symbols, lengths)
    size = int(s.max()) + 1 if len(s) else 0
    code_of, length_of = np.zeros(size, np.uint32), np.zeros(size, np.uint8)
    code_of[s], length_of[s] = codes, ln

    def rows(batches):
        press, shard = zstandard.ZstdDecompressor(), TaskContext.get().partitionId()
        docs, held, size, block, first = [], [], 0, 0, 0

        def close():
            ids = np.concatenate(held)
            bits, at = encode_bits(code_of[ids], length_of[ids].astype(np.int64))
            return shard, block, first, len(ids), docs, [len(h) for h in held], bits, at[::STEP].astype("<u8").tobytes()

        for batch in batches:
            for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append(doc)
                held.append(unpack(packed, press))
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    yield close()
                    docs, held, size, block, first = [], [], 0, block + 1, first + size
        if docs:
            yield close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(rows(batches), _BLOCKS, lambda r: len(r[6]) + len(r[7]) + 16 * len(r[4]))

    return run


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = BYTE_BPE, end_id: int | None = 2) -> None:
    """Encodes every text, codes all ids by their global counts and writes the folder ``path`` in ascending id order.

    Defined cases: null and empty texts are the end id alone; null ids come first; rows that share an id keep any one
    order; an empty table writes empty tables; other columns are not read. The driver sees the counts of the vocabulary
    only.
    """
    tokens = token_table(docs, id_col, text_col, tokenizer, end_id)
    spark = docs.sparkSession
    counts = tokens.select("packed").mapInArrow(_count_batches, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    symbols = np.array([r.symbol for r in counts], np.int64)
    lengths = code_lengths(np.array([r.n for r in counts], np.int64))
    book = [(int(a), int(b)) for a, b in zip(symbols, lengths, strict=True)]
    spark.createDataFrame(book, "symbol long, length long").coalesce(1).write.parquet(f"{path}/codebook")
    sorted_tokens = tokens.select("doc_id", "packed").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    sorted_tokens.mapInArrow(_block_batches(symbols, lengths), _BLOCKS_SQL).write.parquet(f"{path}/blocks")


def _decode_batches(symbols: np.ndarray, lengths: np.ndarray):
    def rows(batches):
        decode = Decoder(symbols, lengths)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                shards, firsts, counts, docs, lists, bits, marks = (c.to_pylist() for c in batch.slice(at, 16).columns)
                found = decode([(b, np.frombuffer(m, "<u8"), n) for b, m, n in zip(bits, marks, counts, strict=True)])
                for shard, first, own, sizes, ids in zip(shards, firsts, docs, lists, found, strict=True):
                    here = 0
                    for doc, n in zip(own, sizes, strict=True):
                        yield doc, shard, first + here, n, ids[here : here + n].tobytes()
                        here += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(rows(batches), _IDS, lambda r: len(r[4]))

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before; ids are little-endian uint32 bytes."""
    book = spark.read.parquet(f"{path}/codebook").collect()
    symbols = np.array([r.symbol for r in book], np.int64)
    lengths = np.array([r.length for r in book], np.int64)
    blocks = spark.read.schema(_BLOCKS_SQL).parquet(f"{path}/blocks")
    sums = blocks.groupBy("shard").agg(F.sum("n").alias("n"))
    base = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    ids = blocks.select("shard", "first", "n", "docs", "counts", "bits", "marks").mapInArrow(
        _decode_batches(symbols, lengths), "doc_id long, shard long, inside long, n_tokens long, ids binary"
    )
    return ids.join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids")


def op9_query(spark, sf_dir):
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path)
    passing(spark, path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
