"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8 link.

Candidates come from SimHash (Golay keys, several seeds) and, as three differing bits of 64 find few pairs near 0.8, from
MinHash bands: 30 keys of five minima each, of which two texts at exactly 0.8 share none with a chance of 7e-6. Every
candidate is verified on the shingle sets of the two texts. Groups of one key are compared with their first member; what
is in different components after that is compared in pairs of blocks on the same sets; a pair of blocks yields a forest of its
links, so a large group of copies stays linear in rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_firsts, same, stored
from .components import connected_components, forest
from .golay_simhash import MAX_BITS, _names, _seed_links, fingerprint
from .groups import block_pairs, sorted_groups

SHINGLE = 5
#: Links have 5 * common >= 4 * union, which is similarity 0.8 without rounding.
SHARE = (4, 5)
BANDS, ROWS = 30, 5
#: Texts and shingles of a block, about.
BLOCK, BLOCK_SHINGLES = 512, 500_000
#: Texts that one task compares with the same first text.
SLOT = 256

_RNG = np.random.default_rng(80)
_MUL = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(data: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes; words as in ``fingerprint``. A shorter text is one shingle, an empty one has none."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    runs = [b" ".join(words)] if len(words) < n else map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64, max(1, len(words) - n + 1)))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = sorted((len(a), len(b)))
    if SHARE[1] * small < SHARE[0] * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return SHARE[1] * common >= SHARE[0] * (len(a) + len(b) - common)


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 2048):
        part = _MUL[:, None] * hashes[None, at : at + 2048] + _ADD[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> list[int]:
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, ROWS))]


def _sketch_batches(seeds: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.large_binary()).to_pylist()]
            own, bands, sizes = [], [], []
            for t in texts:
                found = shingles(t)
                own.append(xxhash.xxh3_128_digest(found.tobytes()))
                bands.append(band_keys(minima(found)) if len(found) else [])
                sizes.append(len(found))
            fps = [pa.array(np.fromiter((fingerprint(t, seed=s) for t in texts), np.uint64, len(texts)).view(np.int64)) for s in seeds]
            cols = [batch.column(0), batch.column(1), pa.array(own, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), *fps]
            yield pa.RecordBatch.from_arrays(cols, ["id", "h", "own", "bands", "size", *_names(len(seeds))])

    return run


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group, the group's first text before the others."""
    first = None
    for batch in batches:
        us, vs = [], []
        for u, side, node, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), batch.column(4).cast(pa.large_binary()).to_pylist(), strict=True):
            found = shingles(text or b"")
            if side == 0:
                first = found
            elif alike(first, found):
                us.append(u)
                vs.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs(u, v) whose texts are alike; texts(node, text) has each node once."""
    tidy = pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    tidy = stored(tidy, "pairs")
    slots = tidy.groupBy("u").agg(F.ceil(F.count("*") / SLOT).cast("int").alias("s"))
    dealt = tidy.join(slots, "u").select("u", F.pmod(F.xxhash64("v"), F.col("s")).cast("int").alias("slot"), "v")
    right = dealt.join(texts.withColumnRenamed("node", "v"), "v").select("u", "slot", F.lit(1).alias("side"), F.col("v").alias("node"), "text")
    left = slots.join(texts.withColumnRenamed("node", "u"), "u")
    left = left.select("u", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("slot"), F.lit(0).alias("side"), F.col("u").alias("node"), "text")
    rows = left.union(right).repartition("u", "slot").sortWithinPartitions("u", "slot", "side")
    return rows.mapInArrow(_verify_batches, "u long, v long")


def tile_edges(side: np.ndarray, root: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, first member joined with it) over all pairs of one block or across two that are alike and apart yet.

    Sets hold distinct hashes and are not empty. One member's hashes are marked and counted in all sets at once.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(known), np.int32)
    place, across = np.arange(len(sets)), bool(side.any())
    us, vs = [], []
    for i in np.flatnonzero(side == 0):
        own = flat[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[flat], starts).astype(np.int64)
        mark[own] = 0
        near = (SHARE[1] * common >= SHARE[0] * (sizes + sizes[i] - common)) & (root != root[i])
        near &= side == 1 if across else place > i
        vs.append(np.flatnonzero(near))
        us.append(np.full(len(vs[-1]), i))
    if not us:
        return place[:0], place[:0]
    first = forest(len(sets), np.concatenate(us), np.concatenate(vs))
    moved = np.flatnonzero(first != place)
    return moved, first[moved]


def _tile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, bounds in sorted_groups(batches, 3):
        side, node, root = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo == 1 or (root[lo:hi] == root[lo]).all():
                continue
            texts = batch.column(6).slice(lo, hi - lo).cast(pa.large_binary()).to_pylist()
            u, v = tile_edges(side[lo:hi], root[lo:hi], [shingles(t) for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(node[lo + u], pa.int64()), pa.array(node[lo + v], pa.int64())], ["u", "v"])


def _across(members: DataFrame, roots: DataFrame, nodes: DataFrame, texts: DataFrame, block: int) -> DataFrame:
    """Edges (u, v) that join what is alike among the members(key, node) of a key and not connected yet.

    A key is cut into blocks of about ``block`` texts and BLOCK_SHINGLES shingles, each pair of blocks is one group, and a
    group yields at most one edge a member.
    """
    placed = members.join(roots, "node", "left").join(nodes.select("node", "size"), "node")
    placed = placed.select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("m"), F.min("root").alias("low"), F.max("root").alias("high"))
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("m") / BLOCK_SHINGLES)).cast("int")
    mixed = mixed.where("low <> high").select("key", blocks.alias("s"))
    mine = F.pmod(F.xxhash64("node"), F.col("s")).cast("int")
    rows = placed.join(mixed, "key").join(texts, "node").withColumn("b", mine)
    spread = rows.select("key", "node", "root", "text", F.explode(block_pairs(F.col("b"), F.col("s"))).alias("t"))
    grouped = spread.select("key", "t.x", "t.y", "t.side", "node", "root", "text").repartition("key", "x", "y")
    return grouped.sortWithinPartitions("key", "x", "y").mapInArrow(_tile_batches, "u long, v long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: tuple[int, ...] = (42,), block: int = BLOCK) -> DataFrame:
    """(id, hash of the text, component_id): one row per input row; component_id is the smallest id reachable by links.

    Defined cases: null and empty texts are alike; a null id takes part, never names a component unless all ids of it are
    null; repeated rows stay; an empty table gives an empty table; other columns of ``docs`` are not read.
    """
    fps = _names(len(seeds))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    schema = ", ".join(["id long, h long, own binary, bands array<long>, size long", *[f"{n} long" for n in fps]])
    found = stored(source.mapInArrow(_sketch_batches(seeds), schema), "sketches")
    chosen = F.min_by(F.struct("id", "h", "bands", "size", *fps), F.struct("id", "h")).alias("one")
    distinct = found.groupBy("own").agg(F.min("id").alias("least"), chosen)
    nodes = stored(distinct.select(F.monotonically_increasing_id().alias("node"), "own", "least", "one.*"), "nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    members = stored(keyed.join(shared, "key").select("key", "node", "n", "first"), "members")
    pairs = stored(members.select(F.col("first").alias("u"), F.col("node").alias("v")).union(_seed_links(nodes, fps, MAX_BITS)).where("u <> v").distinct(), "candidates")
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    wanted = wanted.join(nodes.select("node", F.col("id").alias("i"), F.col("h").alias("k")), "node")
    texts = source.join(wanted, same(F.col("id"), F.col("i")) & (F.col("h") == F.col("k"))).select("node", "text").dropDuplicates(["node"])
    texts = stored(texts, "texts")
    links = stored(verified(pairs, texts), "links")
    roots = connected_components(links)
    more = stored(_across(members.where("n > 2").select("key", "node"), roots, nodes, texts, block), "links")
    if not more.isEmpty():
        roots = connected_components(links.union(more))
    rooted = stored(nodes.join(roots, "node", "left").select("own", "least", F.coalesce("root", "node").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("own", "component_id")
    return found.select("id", F.col("h").alias("hash"), "own").join(named, "own").select("id", "hash", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """The rows of ``docs`` that name their component, as ``keep_firsts`` tells them; columns stay, whatever they are called."""
    return keep_firsts(docs, near_copies(docs, id_col, text_col, seeds), id_col, text_col)
