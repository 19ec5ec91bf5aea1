import math
import re
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import lexical as X

from .test_packing import SF

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10):
    """The contract over plain lists: every document scored for every item."""
    own = [(i, Counter(t.translate(LOWER) for t in TERM.findall(text or ""))) for i, text in docs if i is not None]
    n_docs, n_terms = sum(c.total() > 0 for _, c in own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for i, text in items:
        if i is not None:
            asked.setdefault(i, []).append(text)
    out = []
    for item, texts in asked.items():
        terms = {t.translate(LOWER) for t in TERM.findall(min((t for t in texts if t is not None), default=""))}
        scored = []
        for doc_id, c in own:
            score = 0
            for t in terms & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (10 + (90 * c.total() * n_docs) // n_terms)))
            if score > 0:
                scored.append((-score, doc_id))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.collect()))


def test_query_against_sql_and_brute_force(spark):
    con = duckdb.connect()
    for n in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    got = found(X.op12_query(spark, SF))
    assert got == sorted(con.execute(X.OP12_SQL).fetchall())
    assert got == brute(con.execute("SELECT doc_id, text FROM documents").fetchall(), con.execute("SELECT item_id, text FROM benchmark").fetchall())


def many(n, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    p = 1 / np.arange(1, 301)
    texts = [" ".join(rng.choice(words, rng.integers(1, 60), p=p / p.sum())) for _ in range(n)]
    return [(i, texts[i] if rng.random() > 0.2 else texts[0]) for i in range(n)]  # copies: equal scores in plenty


def test_small_shards_query_blocks_and_ties(spark):
    docs, items = many(900), [(i, t) for i, (_, t) in enumerate(many(12, 5))]
    df, qs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for shard, block in ((8192, 1024), (50, 5)):
        assert found(X.lexical_search(df, qs, k=7, shard_docs=shard, query_block=block)) == brute(docs, items, 7)


def test_defined_cases(spark):
    docs = [(1, None), (2, ""), (3, "Alpha beta"), (3, "Alpha beta"), (None, "alpha"), (4, "ALPHA é_É alpha"), (5, "日本 gamma-gamma"), (6, "alpha " * 50_000)]
    items = [(1, "alpha"), (1, "beta"), (2, None), (3, ""), (None, "alpha"), (4, "unknown"), (5, "É É gamma"), (6, "alpha alpha beta")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"rank": F.lit("x"), "score": F.lit(None), "item_id": F.lit(0)})
    qs = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(9), "score": F.lit("s")})
    assert found(X.lexical_search(df, qs)) == brute(docs, items)
    none = F.lit(False)
    assert X.lexical_search(df.where(none), qs).count() == 0 and X.lexical_search(df, qs.where(none)).count() == 0


def test_blocks_without_a_candidate_stay_packed(spark):
    rng = np.random.default_rng(3)
    docs = [(i, "common " * int(rng.integers(1, 4)) + "pad " * int(rng.integers(5, 60)) + ("rare " * 3 if i % 997 == 5 else "")) for i in range(6000)]
    index = X.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), [b"common", b"rare"])
    (row,) = [r.asDict() for r in index.collect()]
    weigher = X._Weigher(6000, row["n_terms"])
    weights = np.array([math.floor(1000 * math.log((2 * 6000 + 2) / (2 * df + 1))) for df in row["df"]], np.int64)
    lists = X._Lists(row, weigher, weights)
    most = np.array([int((weights[t] * lists.bounds[slice(*lists.blocks[t])]).max()) for t in (0, 1)])
    doc, score, looked = X.search_shard(lists, [0, 1], most, 3, int(most[0]) + 1)
    assert 0 < looked <= 7 < len(lists.last_doc) // 2 and len(lists.unpacked) < len(lists.last_doc) // 2  # 48 blocks of the common term
    top = sorted(zip(-score, lists.ids[doc], strict=True))[:3]
    assert [(1, r + 1, int(d), -int(s)) for r, (s, d) in enumerate(top)] == brute(docs, [(1, "common rare")], 3)


def test_impacts_beyond_64_bits(spark):
    weigher = X._Weigher(10**13, 10**15)
    n = np.array([0, 5, 10**6])
    assert weigher.m(n).tolist() == [10 + (90 * int(x) * 10**13) // 10**15 for x in n]
