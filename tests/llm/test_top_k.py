import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import top_k as K

from .test_packing import SF


def brute(rows, ask, k, factor=64, most=lambda s: s):
    ok = [(i, [math.floor(factor * Fraction(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if ask(i)}):
        own = min(v for i, v in ok if i == q)
        scored = sorted((-most(sum(a * b for a, b in zip(own, v, strict=True))), i) for i, v in ok if i != q and len(v) == len(own))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, K.op8_query(spark, SF).collect())) == brute(rows, lambda i: i % 20 == 0, 20)


def test_ties_small_blocks_and_hot_vector(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(120)] + [(i, [1.0, 1.0, 1.0]) for i in range(120, 220)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    for blocks in ((7, 13), (4096, 8192)):
        got = K.exact_top_k(df.where("vec_id % 10 = 0"), df, k=5, query_block=blocks[0], shard_rows=blocks[1])
        assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0, 5)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 3.0]), (1, [2.0, 2.0]), (1, [2.0, 2.0]), (2, None), (20, [nan, 1.0]), (21, [inf, 1.0]), (22, [None, 1.0]), (None, [1.0, 1.0]), (40, [1.0]), (60, []), (80, [1e12, -1e12])]
    rows += [(100, [1e308, 0.0]), (101, [-1.7e308, 3.0]), (120, [0.5, 1e308])]  # 64 times these is beyond doubles
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "rank": F.lit("x"), "number": F.lit(None)})
    got = K.exact_top_k(df.where("vec_id % 20 = 0"), df)
    most = lambda s: max(-(2**63), min(2**63 - 1, s))
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 20 == 0, 20, most=most)
    none = df.where(F.lit(False))
    assert K.exact_top_k(none, df).count() == 0 and K.exact_top_k(df.where("vec_id % 20 = 0"), none).count() == 0


def test_large_integers_stay_exact(spark):
    big = float(2**40 + 1)
    rows = [(0, [big, 1.0]), (1, [big, 1.0]), (2, [big, 2.0]), (3, [-big, 0.0]), (4, [2.0**27, 3.0]), (5, [2.0**27, 4.0]), (6, [1e300, 1.0]), (7, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in K.exact_top_k(df, df, k=7, factor=1.0).collect()]
    want = []
    for q, a in rows:
        scores = [(max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(a, b, strict=True)))), i) for i, b in rows if i != q]
        want += [(q, k + 1, i, s) for k, (s, i) in enumerate(sorted(scores, key=lambda r: (-r[0], r[1])))]
    assert sorted(got) == sorted(want)
