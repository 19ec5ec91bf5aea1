"""Order statistics, exact tests: brute force over small tables, ranges in many partitions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import hypothesis as N
from pulsegrid.operators import order as R


@pytest.fixture
def many_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def table(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(["a", "b", None][int(g)], None if rng.random() < 0.05 else float(v), int(c)) for g, v, c in zip(rng.integers(0, 3, n) * (rng.random(n) < 0.7), rng.integers(-40, 40, n), rng.integers(1, 5, n), strict=True)]
    return rows, spark.createDataFrame(rows, "g string, v double, c int").repartition(5)


@pytest.mark.parametrize("desc", [False, True])
def test_cumulated_counts_over_many_ranges(spark, many_ranges, desc):
    rows, df = table(spark)
    got = R.cumulated(df.groupBy("g", "v").agg(F.sum("c").alias("c")), ["g"], "v", "c", desc).collect()
    key = lambda v: (v is None, 0 if v is None else -v if desc else v)
    for r in got:
        same = [(v, c) for g, v, c in rows if g == r.g]
        assert r._total == sum(c for _, c in same) and r._upto == sum(c for v, c in same if key(v) <= key(r.v))
    assert len(got) == len({(g, v) for g, v, _ in rows})
    whole = R.cumulated(df.groupBy("v").agg(F.sum("c").alias("c")), [], "v", "c", desc).collect()
    for r in whole:
        assert r._total == sum(c for *_, c in rows) and r._upto == sum(c for _, v, c in rows if key(v) <= key(r.v))
    assert R.cumulated(df.where("false"), ["g"], "v", "c").count() == 0


def test_one_hot_value_and_part_are_cut(spark, many_ranges):
    df = spark.range(20_000).select(F.lit("x").alias("g"), F.col("id").cast("double").alias("v"), F.when(F.col("id") == 7, 10**9).otherwise(1).alias("c"))
    rows = R.cumulated(df, ["g"], "v", "c")
    assert rows.where("_upto <> v + 1 + if(v >= 7, 999999999, 0)").count() == 0
    p = R.percentiles_of(rows, "v", ["g"], {"mid": 0.5}).first()
    assert p.mid == 7


def test_percentiles_and_tie_ranks(spark, many_ranges):
    rows, df = table(spark, seed=3)
    counts = df.groupBy("g", "v").agg(F.sum("c").alias("c"))
    got = {r.g: r for r in R.exact_percentiles(counts, "v", "c", ["g"], {"q": 0.25, "m": 0.5, "e": 0.995, "lo": 0.0, "hi": 1.0}).collect()}
    for g in ("a", "b", None):
        v = np.repeat([v for h, v, c in rows if h == g and v is not None], [c for h, v, c in rows if h == g and v is not None])
        assert [got[g].q, got[g].m, got[g].e, got[g].lo, got[g].hi] == pytest.approx(list(np.percentile(v, [25, 50, 99.5, 0, 100])))
    for r in R.tie_ranks(counts, ["g"], "v", "c").where("v is not null").collect():
        less, same = (sum(c for h, v, c in rows if h == r.g and v is not None and f(v)) for f in (lambda v: v < r.v, lambda v: v == r.v))
        assert r._rank == less + (same + 1) / 2


def exact(a, b, c, d):
    """All tables of the same margins, with whole-number probabilities."""
    row, column, n = a + b, a + c, a + b + c + d
    ways = lambda x: math.comb(row, x) * math.comb(n - row, column - x)
    return sum(ways(x) for x in range(max(0, row + column - n), min(row, column) + 1) if ways(x) <= ways(a)) / math.comb(n, column)


def test_fisher_against_enumerated_tables():
    for t in itertools.product(range(0, 7), repeat=4):
        if sum(t):
            assert N.fisher_p(*t) == pytest.approx(exact(*t), rel=1e-9), t
    for t in ((30, 2, 11, 40), (200, 180, 150, 260), (0, 500, 3, 900), (1000, 1000, 1000, 1000), (3, 1, 1, 3)):
        assert N.fisher_p(*t) == pytest.approx(exact(*t), rel=1e-8), t
    assert N.fisher_p(3, 1, 1, 3) == pytest.approx(0.4857142857)  # the lady tasting tea
    assert 0 < N.fisher_p(500_000_000, 499_900_000, 499_900_000, 500_000_000) < 1e-3 and N.fisher_p(10**9, 10**9, 10**9, 10**9) == 1


def test_selection_uses_both_tests(spark):
    rng = np.random.default_rng(2)
    rows = [(str(i % 3), float((i % 3 == 0) ^ (rng.random() < 0.1)), float(rng.random() < 0.5), float(rng.normal() + (i % 3)), float(rng.normal()), 5.0) for i in range(300)]
    df = spark.createDataFrame(rows, "label string, flag double, coin double, level double, noise double, flat double")
    names = ["flag", "coin", "level", "noise", "flat"]
    p = {(r.feature, r.label): (r.test, r.p) for r in N.relevance(df, names).collect()}
    for k in range(3):
        for f, at in (("flag", 1), ("coin", 2)):
            a, b = (sum(r[at] == v and r[0] == str(k) for r in rows) for v in (1, 0))
            c, d = (sum(r[at] == v and r[0] != str(k) for r in rows) for v in (1, 0))
            assert p[f, str(k)] == ("fisher", pytest.approx(exact(a, b, c, d)))
        own, rest = ([r[3] for r in rows if (r[0] == str(k)) == same] for same in (True, False))
        u = sum((x > y) + 0.5 * (x == y) for x in own for y in rest)
        z = (u - len(own) * len(rest) / 2) / math.sqrt(len(own) * len(rest) * 301 / 12)
        assert p["level", str(k)] == ("mann_whitney", pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-6))
        assert p["flat", str(k)] == ("mann_whitney", 1.0)
    got = {r.feature: r for r in N.select_features(df, names).collect()}
    assert set(got) == {"flag", "level"} and got["flag"].test == "fisher" and got["level"].n_classes >= 2


def test_ranks_of_a_value_that_is_computed_anew_each_time(spark):
    import random

    from pulsegrid.operators import windows as W

    anew = F.udf(lambda k: k + random.random() / 2, "double").asNondeterministic()
    got = W.avg_rank(spark.range(20).withColumn("v", anew("id")), "v", desc=False).collect()
    assert sorted((r.id, r.rank) for r in got) == [(k, k + 1.0) for k in range(20)]


def test_value_counts_are_not_dealt_out_by_feature(spark):
    # without size estimates the planner would join by feature alone, so all values of one feature would meet in one task
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(f, "ab"[v % 2], float(v), 1) for f, n in (("two", 2), ("many", 50)) for v in range(n)]
        tables = N.binary_tables(spark.createDataFrame(rows, "feature string, label string, value double, c long"))
        assert "SortMergeJoin" not in tables._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in tables.collect()) == [("two", "a", 0, 1, 1, 0), ("two", "b", 1, 0, 0, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
