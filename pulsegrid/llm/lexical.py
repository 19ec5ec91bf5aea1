"""Ranked lexical search: an inverted index in shards and Block-Max MaxScore over it, integer scores throughout.

A shard is one row: up to ``SHARD_DOCS`` documents, their lengths, and for each asked term a posting list in blocks of 128
entries, each block packed on its own with what bounds it (largest frequency, shortest documents). Collection statistics
are sums over the shards. A task searches shard after shard and keeps the best list of each query, so the score to beat
rises as it goes: lists whose global bounds together cannot reach it are non-essential, and a candidate from the essential
lists is looked up there only while its block maxima can still lift it high enough; blocks without such a candidate are
never unpacked. The lists of all tasks merge in two levels of ranking windows.

The queries are a stated set: blocks of at most ``QUERIES`` items, each block against all shards.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

SHARD_DOCS = 8192
BLOCK = 128
QUERIES = 1024

# UTF-8 bytes: every byte of a character beyond ASCII belongs to a term, and bytes.lower() changes A-Z only
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_SHARD_SQL = "n_docs long, n_terms long, ids binary, lengths binary, terms array<int>, df array<int>, first_block array<int>, last_doc binary, max_tf binary, min_once binary, min_more binary, starts binary, payload binary"
_FAR = np.iinfo(np.int64).max // 4


def terms_of(text: str | None) -> list[bytes]:
    return _TERM.findall(text.encode().lower()) if text else []


def _pack(x: np.ndarray) -> bytes:
    """Width byte, then the values in one, two or four bytes."""
    width = 1 if x.max() < 1 << 8 else 2 if x.max() < 1 << 16 else 4
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _unpack(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    width = data[at]
    return np.frombuffer(data, f"<u{width}", n, at + 1).astype(np.int64), at + 1 + width * n


class _Shard:
    """Collects documents and becomes one row."""

    def __init__(self):
        self.ids, self.lengths, self.hits, self.n_terms, self.n_docs = [], [], [], 0, 0

    def add(self, doc_id: int, n: int, hits: list[tuple[int, int]]) -> None:
        self.n_terms += n
        self.n_docs += n > 0
        if hits:
            at = len(self.ids)
            self.ids.append(doc_id)
            self.lengths.append(n)
            self.hits += [(term, at, tf) for term, tf in hits]

    def row(self) -> pa.RecordBatch:
        lengths = np.array(self.lengths, np.int64)
        term, doc, tf = np.array(self.hits, np.int64).reshape(-1, 3).T
        order = np.argsort(term, kind="stable")  # documents of a term stay in order
        term, doc, tf = term[order], doc[order], tf[order]
        at = np.flatnonzero(np.diff(term, prepend=-1))
        df = np.diff(np.append(at, len(term)))
        n_blocks = -(-df // BLOCK)
        first = np.cumsum(n_blocks) - n_blocks
        starts = np.repeat(at, n_blocks) + BLOCK * (np.arange(n_blocks.sum()) - np.repeat(first, n_blocks))
        ends = np.append(starts, len(term))[1:]
        packed, offsets = [], [0]
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            packed.append(_pack(np.diff(doc[s:e], prepend=0)) + _pack(tf[s:e]))
            offsets.append(offsets[-1] + len(packed[-1]))
        some = len(starts) > 0
        least = lambda n: np.minimum.reduceat(n, starts) if some else starts
        of = lengths[doc]
        columns = [
            doc[ends - 1] if some else starts, np.maximum.reduceat(tf, starts) if some else starts,
            least(np.where(tf == 1, of, _FAR)), least(np.where(tf > 1, of, _FAR)), np.array(offsets),
        ]
        binary = [x.astype("<i8").tobytes() for x in columns]
        lists = [term[at].tolist(), df.tolist(), first.tolist()]
        values = [self.n_docs, self.n_terms, np.array(self.ids, "<i8").tobytes(), lengths.astype("<i8").tobytes(), *lists, *binary, b"".join(packed)]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.list_(pa.int32())] * 3, *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [c.split()[0] for c in _SHARD_SQL.split(", ")])


def build_index(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Shards of ``docs`` with the posting lists of ``terms`` (a term's number is its place in the list), as a stored table.

    Collection counts are over all terms of all texts. Rows without id take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(terms)}
        shard = _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = Counter(terms_of(text))
                shard.add(doc_id, found.total(), [(number[t], found[t]) for t in found.keys() & number.keys()])
                if len(shard.ids) == shard_docs:
                    yield shard.row()
                    shard = _Shard()
        yield shard.row()

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_col)
    return stored(rows.mapInArrow(run, _SHARD_SQL), "shards")


class _Weigher:
    """tf * weight parts that depend on the collection: impact(tf, m) and m of a length, in 64-bit integers."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, max(1, n_terms)

    def m(self, n: np.ndarray) -> np.ndarray:
        if len(n) and int(n.max()) * 90 * self.n_docs >= 2**63:  # beyond 64 bits: Python's integers, far lengths included
            return np.array([10 + (90 * int(x) * self.n_docs) // self.n_terms if x < _FAR else _FAR // 1000 for x in n], object).clip(max=2**50).astype(np.int64)
        return 10 + (90 * n * self.n_docs) // self.n_terms

    @staticmethod
    def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)

    def bound(self, max_tf: np.ndarray, min_once: np.ndarray, min_more: np.ndarray) -> np.ndarray:
        """No entry of a block has a larger impact: of entries met once the shortest text counts, of others also the largest tf."""
        once = np.where(min_once < _FAR, self.impact(np.ones_like(max_tf), self.m(np.where(min_once < _FAR, min_once, 0))), 0)
        more = np.where(min_more < _FAR, self.impact(max_tf, self.m(np.where(min_more < _FAR, min_more, 0))), 0)
        return np.maximum(once, more)


class _Lists:
    """Posting lists of one shard; a block is unpacked when it is first needed."""

    def __init__(self, row: dict, weigher: _Weigher, weights: np.ndarray):
        long = lambda c: np.frombuffer(row[c], "<i8")
        self.ids, self.payload, self.offsets, self.last_doc = long("ids"), row["payload"], long("starts"), long("last_doc")
        self.m = weigher.m(long("lengths"))
        self.weights, self.unpacked = weights, {}
        self.bounds = weigher.bound(long("max_tf"), long("min_once"), long("min_more"))
        ends = [*row["first_block"], len(self.last_doc)][1:]
        self.blocks = {t: (a, b) for t, a, b in zip(row["terms"], row["first_block"], ends, strict=True)}
        self.df = dict(zip(row["terms"], row["df"], strict=True))

    def block(self, term: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k-th block of the shard, which belongs to ``term``."""
        if k not in self.unpacked:
            a, b = self.blocks[term]
            n = BLOCK if k < b - 1 else self.df[term] - BLOCK * (b - 1 - a)
            doc, at = _unpack(self.payload, int(self.offsets[k]), n)
            tf, _ = _unpack(self.payload, at, n)
            doc = np.cumsum(doc)
            self.unpacked[k] = doc, self.weights[term] * _Weigher.impact(tf, self.m[doc])
        return self.unpacked[k]


def search_shard(lists: _Lists, terms: list[int], most: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, blocks unpacked for non-essential lists): all documents of the shard that can be among the best k.

    ``most`` bounds each term's score anywhere; documents that cannot reach ``floor`` may be left out.
    """
    own = sorted((t for t in terms if t in lists.blocks), key=lambda t: (most[t], t))
    reach = np.cumsum([most[t] for t in own])  # of the lists up to each
    split = int(np.searchsorted(reach, floor)) if floor > 0 else 0  # lists before it cannot reach the floor together
    total, looked = np.zeros(len(lists.ids), np.int64), 0
    met = np.zeros(len(lists.ids), bool)
    for t in own[split:]:
        a, b = lists.blocks[t]
        for block in range(a, b):
            doc, score = lists.block(t, block)
            total[doc] += score
            met[doc] = True
    found = np.flatnonzero(met)
    for i in range(split - 1, -1, -1):
        if not len(found):
            break
        if len(found) > k:
            floor = max(floor, int(np.partition(total[found], len(found) - k)[len(found) - k]))
        found = found[total[found] + reach[i] >= floor]
        t, below = own[i], reach[i - 1] if i else 0
        a, b = lists.blocks[t]
        at = a + np.searchsorted(lists.last_doc[a:b], found)
        top = np.where(at < b, lists.weights[t] * lists.bounds[np.minimum(at, b - 1)], 0)
        likely = total[found] + top + below >= floor
        found, at = found[likely], at[likely]
        for block in np.unique(at[at < b]):
            doc, score = lists.block(t, int(block))
            here = found[at == block]
            place = np.minimum(np.searchsorted(doc, here), len(doc) - 1)
            hit = doc[place] == here
            total[here[hit]] += score[place[hit]]
            looked += 1
    return found, total[found], looked


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _search_batches(asked: list[tuple[int, list[int]]], weights: np.ndarray, most: np.ndarray, weigher: _Weigher, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = {item: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for item, _ in asked}
        for batch in batches:
            for row in batch.to_pylist():
                lists = _Lists(row, weigher, weights)
                for item, terms in asked:
                    ids, scores = heaps[item]
                    floor = int(scores[-1]) if len(scores) == k else 0
                    doc, score, _ = search_shard(lists, terms, most, k, floor)
                    some = score > 0
                    if some.any():
                        heaps[item] = _best(np.concatenate([ids, lists.ids[doc[some]]]), np.concatenate([scores, score[some]]), k)
        for item, (ids, scores) in heaps.items():
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids), pa.array(scores)], ["item_id", "doc_id", "score"])

    return run


def _search_block(docs: DataFrame, items: list[tuple[int, str | None]], k: int, id_col: str, text_col: str, shard_docs: int) -> DataFrame:
    asked = [(i, sorted(set(terms_of(t)))) for i, t in items]
    terms = sorted({t for _, ts in asked for t in ts})
    number = {t: i for i, t in enumerate(terms)}
    index = build_index(docs, terms, id_col, text_col, shard_docs)
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    weigher = _Weigher(n_docs, n_terms)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["terms"]:
                    bound = weigher.bound(*(np.frombuffer(row[c], "<i8") for c in ("max_tf", "min_once", "min_more")))
                    most = np.maximum.reduceat(bound, row["first_block"])
                    yield pa.RecordBatch.from_arrays([pa.array(row["terms"], pa.int32()), pa.array(row["df"], pa.int64()), pa.array(most)], ["term", "df", "most"])

    lists = index.select("terms", "df", "first_block", "max_tf", "min_once", "min_more")
    df, most = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
    for t, n, top in lists.mapInArrow(tops, "term int, df long, most long").groupBy("term").agg(F.sum("df"), F.max("most")).collect():
        df[t], most[t] = n, top
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64).clip(min=0)
    run = _search_batches([(i, [number[t] for t in ts]) for i, ts in asked], weights, weights * most, weigher, k)
    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def lexical_search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id",
                   query_text: str = "text", query_block: int = QUERIES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(item_id, rank int from 1, doc_id, score): for each item the k documents of highest score above 0, ties to the smaller id.

    Terms are maximal runs of digits, letters and characters beyond ASCII, A-Z in lower case. Weight and score are the
    integers of the module's contract: floor(1000 ln((2N + 2)/(2 df + 1))) times (10^9 tf) div (1000 tf + 8 m), with
    m = 10 + (90 n N) div L, over an item's distinct terms.

    Defined cases: null and empty texts have no terms and count in none of the statistics; rows and items without id take
    no part; an item id met more than once is asked once, with its least text; repeated document rows count each and rank
    each; an item without known terms has no rows; empty tables give an empty table; other columns are not read. The driver
    holds one block of items and two numbers for each of its terms, never anything of all documents.
    """
    spark = docs.sparkSession
    asked = queries.where(F.col(query_id).isNotNull()).groupBy(F.col(query_id).cast("long").alias("item")).agg(F.min(query_text).alias("text"))
    asked = stored(asked, "items")
    blocks = max(1, -(-asked.count() // query_block))
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for b in range(blocks):
        items = [tuple(r) for r in asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()]
        if items:
            out = out.union(_search_block(docs, items, k, id_col, text_col, shard_docs))

    def merged(df, *keys):
        place = F.row_number().over(Window.partitionBy("item_id", *keys).orderBy(F.desc("score"), "doc_id"))
        return df.withColumn("rank", place).where(F.col("rank") <= k)

    half = merged(out.withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(16))), "branch").drop("rank", "branch")
    return merged(half).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_query(spark, sf_dir):
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents WHERE doc_id IS NOT NULL
), c AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
p AS (SELECT row_id, doc_id, len(terms)::BIGINT AS n, term, count(*) AS tf FROM (SELECT *, unnest(terms) AS term FROM d) GROUP BY ALL),
i AS (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY 1),
q AS (
  SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM i)
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY term
), s AS (
  SELECT item_id, row_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
