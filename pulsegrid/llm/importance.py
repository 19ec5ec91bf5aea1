"""Target-distribution importance resampling: hashed word features, gains per bucket, and an exact draw of the best keys.

Words are counted per bucket in each task, so one row per bucket and task is shuffled. The gains are one array whose length
is a parameter (``buckets``); every document is scored by looking its features up in it. Which documents are drawn is found
by a distributed quickselect over the composite key (score, id, row): some random pivots a round, exact counts of the keys
below and at each pivot, and only the rows between the two nearest pivots go on. Only the winners are sorted and ranked.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

BUCKETS = 10_000
SEED = 2024
#: Pivots of a round, and how many rows may be left for the last selection.
PIVOTS, LAST = 15, 1000
#: Distinct features whose bucket a worker keeps; beyond that it starts anew.
KNOWN = 1_000_000

# UTF-8 bytes: every byte of a character beyond ASCII belongs to a word, and bytes.lower() changes A-Z only
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode().lower()) if text else []


def features_of(words: list[bytes], grams: int) -> list[bytes]:
    """All runs of 1 to ``grams`` consecutive words."""
    if grams == 1:
        return words
    return [b" ".join(words[i : i + n]) for n in range(1, grams + 1) for i in range(len(words) - n + 1)]


class _Known(dict):
    """value by feature, made on first sight"""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, feature):
        if len(self) >= KNOWN:
            self.clear()
        self[feature] = value = self.make(feature)
        return value


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, grams: int = 1) -> np.ndarray:
    """Features of all texts per bucket; what comes to the driver is at most ``buckets`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, known = np.zeros(buckets, np.int64), _Known(lambda f: zlib.crc32(f) % buckets)
        for batch in batches:
            seen = Counter(chain.from_iterable(features_of(words_of(t), grams) for t in batch.column(0).to_pylist()))
            np.add.at(counts, np.fromiter((known[f] for f in seen), np.int64, len(seen)), np.fromiter(seen.values(), np.int64, len(seen)))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    found = texts.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.collect():
        out[bucket] = n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets."""
    b, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    return [math.floor(1000 * math.log((float(t) + 1) * (all_source + b) / ((float(s) + 1) * (all_target + b)))) for s, t in zip(source, target, strict=True)]


def weighted(docs: DataFrame, gains: list[int], id_col: str = "doc_id", text_col: str = "text", grams: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of a row's features, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(lambda f: gains[zlib.crc32(f) % len(gains)])
        for batch in batches:
            n_words, n_features, weights = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                features = features_of(words, grams)
                n_words.append(len(words))
                n_features.append(len(features))
                weights.append(sum(map(known.__getitem__, features)) // len(features) if features else 0)
            counted = [pa.array(x, pa.int64()) for x in (n_words, n_features, weights)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counted], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of sha256("seed:id")."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def kth_key(rows: DataFrame, k: int, keys: list[str], seed: int = SEED, pivots: int = PIVOTS, last: int = LAST) -> tuple | None:
    """The k-th smallest tuple of ``keys`` (columns without nulls whose tuples all differ); None for k < 1 or k beyond the rows.

    Each round takes ``pivots`` random rows, counts exactly how many keys lie below each, and keeps the rows strictly
    between the two pivots around the k-th. A pivot that is the k-th ends the search. Counts and pivots alone reach the
    driver, and at the end at most ``last`` keys.
    """
    key = F.struct(*keys)
    lit = lambda p: F.struct(*[F.lit(x).alias(c) for x, c in zip(p, keys, strict=True)])
    n = rows.count()
    if not 1 <= k <= n:
        return None
    now = rows.select(*keys)
    for turn in range(1000):
        if n <= last:
            return tuple(now.orderBy(*keys).limit(k).collect()[k - 1])
        tried = sorted(tuple(r) for r in now.orderBy(F.xxhash64(F.lit(seed + turn), *keys)).limit(pivots).collect())
        below = now.agg(*[F.count(F.when(key < lit(p), 1)).alias(f"b{i}") for i, p in enumerate(tried)]).first()
        low, high, under = None, None, 0
        for p, b in zip(tried, below, strict=True):
            if b == k - 1:
                return p
            if b < k - 1:
                low, under = p, b + 1  # the pivot itself is under the k-th as well
            elif high is None:
                high, n_high = p, b
        part = now
        if low is not None:
            part = part.where(key > lit(low))
        if high is not None:
            part = part.where(key < lit(high))
        n = (n_high if high is not None else n) - under
        k -= under
        now = stored(part, "between-pivots")
    raise RuntimeError("the selection did not end")


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3 ... in the order of ``keys``: ranges, sorted apart, and the counts of the ranges before."""
    spark = rows.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    numbered = stored(ordered.select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "winners")
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return numbered.join(sizes.select("part", before.alias("before")), "part").withColumn("rank", F.col("before") + F.col("place") + 1).drop("part", "place", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, buckets: int = BUCKETS, grams: int = 1, seed: int = SEED,
             id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): every row of ``docs`` once, drawn rows with their rank from 1.

    Of the N rows with an id and at least ``min_words`` words the floor(percent * N / 100) of highest score are drawn, ties
    to the smaller id. Defined cases: null texts have no words; rows without id count in the corpus and are returned with
    score and rank null; repeated rows count each and are drawn each; rows of equal id and score are drawn in any order
    (they differ in nothing but their texts); an empty target gives gains from the source alone; empty tables give an empty
    table; other columns are not read.
    """
    source = bucket_counts(docs, text_col, buckets, grams)
    gains = gains_of(source, bucket_counts(target, target_col, buckets, grams))
    scored = weighted(docs, gains, id_col, text_col, grams).withColumn("score", F.col("weight") + noise("doc_id", seed))
    rows = stored(scored.select("*", (-F.col("score")).alias("_down"), F.monotonically_increasing_id().alias("_row")), "scored")
    keys = ["_down", "doc_id", "_row"]
    may = F.col("doc_id").isNotNull() & (F.col("n_words") >= min_words)
    eligible = rows.where(may)
    k = percent * eligible.count() // 100
    last = kth_key(eligible, k, keys, seed)
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    if last is None:
        return rows.select(*names, F.lit(None).cast("long").alias("rank"))
    drawn = may & (F.struct(*keys) <= F.struct(*[F.lit(x).alias(c) for x, c in zip(last, keys, strict=True)]))
    winners = ranked(rows.where(drawn), keys)
    return winners.select(*names, "rank").union(rows.where(~F.coalesce(drawn, F.lit(False))).select(*names, F.lit(None).cast("long")))


def op13_query(spark, sf_dir):
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = """
WITH tab AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM range(256) t(i)
), d AS (
  SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), b AS (
  SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark
), dw AS (SELECT row_id, unnest(words) AS word FROM d), bw AS (SELECT unnest(words) AS word FROM b),
vocabulary AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
hexed AS (SELECT word, hex(encode(word)) AS h FROM vocabulary),
bytes AS (SELECT word, list_transform(range(len(h) // 2), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1) AS bs FROM hexed),
crc AS (SELECT word, xor(list_reduce(list_concat([4294967295], bs), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, tab),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN crc USING (word) GROUP BY 1),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT count(*) FROM dw)::DOUBLE + 10000) / ((s::DOUBLE + 1) * ((SELECT count(*) FROM bw)::DOUBLE + 10000))))::BIGINT AS g
  FROM s LEFT JOIN t USING (bucket)
), w AS (
  SELECT row_id, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY 1
), x AS (
  SELECT doc_id, row_id, coalesce(len(words), 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score
  FROM d LEFT JOIN w USING (row_id)
), r AS (
  SELECT row_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_features >= 20 AND doc_id IS NOT NULL
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM r) THEN rank END AS rank FROM x LEFT JOIN r USING (row_id)
"""
