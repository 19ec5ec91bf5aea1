"""SimHash near-dedup with Golay-code fuzzy keys.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits. The binary Golay code of length 23 is
perfect: each vector lies within distance 3 of exactly one codeword. The keys of a segment are the indices of the
codewords nearest to the vectors within one flip of it; that is one key, or six where the segment itself lies three
flips from its codeword. Two segments that differ in at most two bits share a key, because some vector lies within
one flip of both.

Pigeonhole for at most three differing bits over three segments:
* some segment s is equal and the next one (cyclically) differs in at most two bits: keys (s equal, Golay key of next);
* else each segment differs in exactly one bit: of the two halves of each segment one is equal: keys of three halves.

Equal keys give candidates, which are verified by their true distance. Only distinct fingerprints take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_firsts, stored, table
from .components import connected_components, forest
from .groups import block_pairs, sorted_groups

SEED = 42
MAX_BITS = 3
#: Fingerprints of one key that are compared in one block; larger groups are cut into pairs of such blocks.
BLOCK = 1024

_SEGMENTS = ((0, 22), (22, 21), (43, 21))
_GENERATOR = 0b110001110101  # fixed value: generator polynomial of the binary Golay code of length 23


# ---------------------------------------------------------------- fingerprints


def fingerprint(data: bytes, shingle: int = 3, seed: int = SEED) -> int:
    """SimHash of UTF-8 text: ASCII letters lower-cased, words between ASCII white space, majority of each hash bit."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(r, seed) for r in runs), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        bits = np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprint_batches(shingle: int, seeds: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            found = [pa.array(np.fromiter((fingerprint(t or b"", shingle, s) for t in texts), np.uint64, len(texts)).view(np.int64)) for s in seeds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *found], ["id", "hash", *_names(len(seeds))])

    return run


def _names(n: int) -> list[str]:
    return ["fp", *[f"fp{k}" for k in range(1, n)]]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """(id, hash of the text, fp long, and fp1, ... for further seeds): one row per input row; null and empty texts have fingerprint 0."""
    schema = ", ".join(["id long", "hash long", *[f"{n} long" for n in _names(len(seeds))]])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    return rows.mapInArrow(_fingerprint_batches(shingle, seeds), schema)


# ---------------------------------------------------------------- Golay keys


def _syndromes() -> np.ndarray:
    """Remainder of each single bit of a 23-bit vector by the generator polynomial."""
    out = []
    for bit in range(23):
        r = 1 << bit
        for k in range(bit, 10, -1):
            if r >> k & 1:
                r ^= _GENERATOR << (k - 11)
        out.append(r)
    return np.array(out, np.int64)


def _correction(bits: np.ndarray) -> np.ndarray:
    """Error of weight at most three for each of the 2048 remainders."""
    table = np.full(2048, -1, np.int64)
    table[0] = 0
    for a in range(23):
        table[bits[a]] = 1 << a
        for b in range(a):
            table[bits[a] ^ bits[b]] = 1 << a | 1 << b
            for c in range(b):
                table[bits[a] ^ bits[b] ^ bits[c]] = 1 << a | 1 << b | 1 << c
    return table


_BITS = _syndromes()
_FIX = _correction(_BITS)


def golay_keys(values: np.ndarray, width: int) -> np.ndarray:
    """(n, 6) codeword indices of each ``width``-bit segment; where a segment has one key it is repeated."""
    v = values.astype(np.int64)
    s = np.zeros(len(v), np.int64)
    for bit in range(width):
        s ^= np.where(v >> bit & 1, _BITS[bit], 0)
    near = np.empty((len(v), width + 1), np.int64)
    near[:, width] = (v ^ _FIX[s]) >> 11
    for bit in range(width):
        near[:, bit] = (v ^ (1 << bit) ^ _FIX[s ^ _BITS[bit]]) >> 11
    near.sort(axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    rank = new.cumsum(axis=1) - 1
    out = np.repeat(near[:, :1], 6, axis=1)
    rows = np.broadcast_to(np.arange(len(v))[:, None], near.shape)
    out[rows[new], rank[new]] = near[new]
    return out


def candidate_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key): every pair within three bits shares a key."""
    seg = [(fps >> np.uint64(at)).astype(np.int64) & ((1 << w) - 1) for at, w in _SEGMENTS]
    who, keys = [], []
    index = np.arange(len(fps))
    for i in range(3):
        j = (i + 1) % 3
        near = golay_keys(seg[j], _SEGMENTS[j][1])
        fresh = np.ones(near.shape, bool)
        fresh[:, 1:] = near[:, 1:] != near[:, :1]
        key = (seg[i][:, None] << 12 | near) << 4 | i
        keys.append(key[fresh])
        who.append(np.broadcast_to(index[:, None], near.shape)[fresh])
    halves = [(s & 0x7FF, s >> 11) for s in seg]
    for mask in range(8):
        part = [halves[k][mask >> k & 1] for k in range(3)]
        keys.append((part[0] << 22 | part[1] << 11 | part[2]) << 4 | (8 + mask))
        who.append(index)
    return np.concatenate(who), np.concatenate(keys)


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), 20_000):
            part = fps[at : at + 20_000]
            who, keys = candidate_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(part[who].view(np.int64)), pa.array(keys)], ["fp", "key"])


# ---------------------------------------------------------------- verified links


def _links(left: np.ndarray, right: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= limit)


def _group_edges(side: np.ndarray, fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest linked member) that join what is linked within one block or across two."""
    left, right = fps[side == 0], fps[side == 1]
    if len(right):
        a, b = _links(left, right, limit)
        b = b + len(left)
        nodes = np.concatenate([left, right])
    else:
        a, b = _links(left, left, limit)
        nodes = left
    root = forest(len(nodes), a, b)
    at = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[at], nodes[root[at]]


def _edge_batches(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in sorted_groups(batches, 3):
            side, fps = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
            start, size = bounds[:-1], np.diff(bounds)
            two = start[size == 2]
            close = np.bitwise_count(fps[two] ^ fps[two + 1]) <= limit
            us, vs = [fps[two][close]], [fps[two + 1][close]]
            for at, n in zip(start[size > 2], size[size > 2], strict=True):
                u, v = _group_edges(side[at : at + n], fps[at : at + n], limit)
                us.append(u)
                vs.append(v)
            u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def fingerprint_links(distinct: DataFrame, limit: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """distinct(fp) -> edges (u, v) that connect exactly what pairs within ``limit`` (at most 3) bits connect.

    A key held by more than ``block`` fingerprints is cut into blocks by hash, and each pair of blocks is one group:
    no group grows with the corpus, and no candidate is left out. A group yields at most one edge a member.
    """
    if not 0 <= limit <= MAX_BITS:
        raise ValueError("the keys find pairs of at most 3 differing bits")
    keyed = distinct.select("fp").mapInArrow(_key_batches, "fp long, key long")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    cuts = F.ceil(F.col("n") / block).cast("int")
    rows = keyed.join(shared, "key").select("key", "fp", cuts.alias("s"))
    mine = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
    spread = rows.withColumn("b", mine).select("key", "fp", F.explode(block_pairs(F.col("b"), F.col("s"))).alias("t"))
    grouped = spread.select("key", "t.x", "t.y", "t.side", "fp").repartition("key", "x", "y")
    return grouped.sortWithinPartitions("key", "x", "y").mapInArrow(_edge_batches(limit), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, limit: int = MAX_BITS, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """(id, hash, fp long, component_id): one row per input row; component_id is the smallest id reachable by links.

    With several seeds a document has as many fingerprints, and two documents link where those of any one seed do; that
    finds more of the pairs whose texts are alike without more differing bits, at the cost of a pass of keys per seed.

    Defined cases: null and empty texts have fingerprint 0 and link like any other; a null id takes part, never
    names a component unless all ids of it are null (then component_id is null); repeated rows stay; an empty
    table gives an empty table; other columns of ``docs`` are not read.
    """
    found = stored(fingerprints(docs, id_col, text_col, shingle, seeds), "fingerprints")
    if len(seeds) == 1:
        distinct = found.groupBy("fp").agg(F.min("id").alias("least"))
        roots = connected_components(fingerprint_links(distinct, limit)).withColumnRenamed("node", "fp")
        nodes = stored(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "nodes")
        key = ["fp"]
    else:
        key = _names(len(seeds))
        tuples = stored(found.groupBy(*key).agg(F.min("id").alias("least")).select(F.monotonically_increasing_id().alias("node"), "*"), "tuples")
        roots = connected_components(_seed_links(tuples, key, limit))
        nodes = stored(tuples.join(roots, "node", "left").select(*key, "least", F.coalesce("root", "node").alias("root")), "nodes")
    names = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(names, "root").select(*key, "component_id")
    return found.join(named, key).select("id", "hash", "fp", "component_id")


def _seed_links(tuples: DataFrame, key: list[str], limit: int) -> DataFrame:
    """Edges between nodes: each with the first node of its fingerprint of each seed, and first nodes whose fingerprints link."""
    out = None
    for name in key:
        first = tuples.groupBy(F.col(name).alias("fp")).agg(F.min("node").alias("first"))
        same = tuples.join(first, tuples[name] == first["fp"]).select(F.col("node").alias("u"), F.col("first").alias("v"))
        links = fingerprint_links(first, limit)
        a, b = first.select(F.col("fp").alias("u"), F.col("first").alias("nu")), first.select(F.col("fp").alias("v"), F.col("first").alias("nv"))
        near = links.join(a, "u").join(b, "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"))
        both = same.union(near)
        out = both if out is None else out.union(both)
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, limit: int = MAX_BITS, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """The rows of ``docs`` that name their component, as ``keep_firsts`` tells them; columns stay, whatever they are called."""
    return keep_firsts(docs, near_duplicates(docs, id_col, text_col, shingle, limit, seeds), id_col, text_col)


def op5_query(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


