import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import importance as I

from .test_packing import SF

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, target, percent=10, least=20, buckets=10_000, grams=1):
    """The contract, word by word, over lists."""

    def features(text):
        words = WORD.findall((text or "").translate(LOWER))
        return len(words), [" ".join(words[i : i + n]) for n in range(1, grams + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text)[1]) for texts in ([d[1] for d in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets))))
    rows = []
    for doc_id, text in docs:
        n, own = features(text)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(own), weight, score, None, n])
    may = sorted((r for r in rows if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def drawn(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_query_against_sql_and_brute_force(spark):
    con = duckdb.connect()
    for n in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    got = drawn(I.op13_query(spark, SF))
    assert got == sorted(con.execute(I.OP13_SQL).fetchall(), key=str)
    docs = con.execute("SELECT doc_id, text FROM documents").fetchall()
    assert got == sorted(brute(docs, [t for (t,) in con.execute("SELECT text FROM benchmark").fetchall()]), key=str)


def test_defined_cases(spark):
    long = "A bé C9 _x " * 12
    docs = [(1, None), (2, ""), (3, long), (3, long), (3, long + " more"), (None, long), (4, "two words"), (5, "\x7f[]{}"), (6, "日本語 " * 25), (7, "x" * 200_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("s"), "rank": F.lit(None), "n": F.lit(1)}).repartition(3)
    target = spark.createDataFrame([("bé bé c9",), (None,), ("",)], "text string")
    for grams in (1, 2):
        got = drawn(I.resample(df, target, percent=60, grams=grams))
        assert got == sorted(brute(docs, ["bé bé c9", None, ""], percent=60, grams=grams), key=str)
    none = df.where(F.lit(False))
    assert I.resample(none, target).count() == 0
    assert drawn(I.resample(df, target.where(F.lit(False)), percent=100)) == sorted(brute(docs, [], percent=100), key=str)


@pytest.mark.parametrize("k", [0, 1, 2, 777, 2500, 2999, 3000, 3001])
def test_selection_narrows_to_the_exact_key(spark, k):
    rng = np.random.default_rng(k)
    rows = [(int(s), i) for i, s in enumerate(np.where(rng.random(3000) < 0.4, 5, rng.integers(-20, 20, 3000)))]  # a score that 40 % share
    df = spark.createDataFrame(rows, "s long, i long").repartition(4)
    want = sorted(rows)[k - 1] if 1 <= k <= 3000 else None
    assert I.kth_key(df, k, ["s", "i"], pivots=5, last=10) == want


def test_ranks_over_many_ranges(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("s"), F.col("id").alias("i")).repartition(4)
    got = [(r.s, r.i) for r in I.ranked(df, ["s", "i"]).orderBy("rank").collect()]
    assert got == sorted((i % 7, i) for i in range(5000))
    assert [r.rank for r in I.ranked(df, ["s", "i"]).orderBy("rank").select("rank").collect()] == list(range(1, 5001))
