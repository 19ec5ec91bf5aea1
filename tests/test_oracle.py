"""Every query with SQL against DuckDB at the smallest size, rounded alike on both sides."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from pulsegrid.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted((tuple(norm(r[i]) for i in order) for r in cur.fetchall()), key=str)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(sorted(df.columns)).collect()), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for a, b in zip(g, w, strict=True):
            assert a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-5 * max(1, abs(a)), (g, w)


def rows_of(spark, name):
    return QUERIES[name](spark, SF)


def test_file_queries(spark):
    listed = rows_of(spark, "s2_list_files").collect()
    assert listed and all(r[0] for r in listed)
    assert rows_of(spark, "a24_source_fingerprint").collect() == rows_of(spark, "a24_source_fingerprint").collect() != []


@pytest.mark.parametrize("name", ["t24_curated", "t24_efficient"])
def test_presets_agree_with_plain_aggregates(spark, name):
    from pulsegrid.plans import fixtures as X

    plain = {r.id: r for r in X.waves(spark, SF).groupBy("id").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.max("value").alias("top"), F.sum(F.col("value") * F.col("value")).alias("e")).collect()}
    got = rows_of(spark, name).collect()
    assert {r.id for r in got} == set(plain)
    for r in got:
        p = plain[r.id]
        assert (r.value__mean, r.value__maximum, r.value__abs_energy) == pytest.approx((p.m, p.top, p.e))
        # the bins of the spectrum that belong to the mean, and the energy by Parseval's theorem
        assert r.value__fft_coefficient__coeff_0__attr_real == pytest.approx(p.m * p.n)
        if name == "t24_efficient" and p.n % 2 == 0:
            f = [r[f"value__fft_coefficient__coeff_{k}__attr_abs"] ** 2 for k in range(p.n // 2 + 1)]
            assert (2 * sum(f) - f[0] - f[-1]) / p.n == pytest.approx(p.e)


def test_complexity_and_regression_queries_stay_in_their_ranges(spark):
    for r in rows_of(spark, "t36_complexity").collect():
        for d in range(3, 8):
            e = r[f"value__permutation_entropy__tau_1__dimension_{d}"]
            assert e is None or 0 <= e <= math.log(math.factorial(d)) + 1e-9
        assert 0 < r.value__lempel_ziv_complexity__bins_2 <= 1 and 0 <= r.value__binned_entropy__max_bins_10 <= math.log(10) + 1e-9
    tested = [r for r in rows_of(spark, "t37_unit_root").collect() if r.value__augmented_dickey_fuller__attr_pvalue is not None]
    assert tested and all(0 <= r.value__augmented_dickey_fuller__attr_pvalue <= 1 for r in tested)
    phi = {r.id: r for r in rows_of(spark, "t35_ar_model").collect()}
    both = [r for r in tested if r.id in phi]
    assert both and all([phi[r.id].intercept, *phi[r.id].phi] == pytest.approx([r[f"value__ar_coefficient__coeff_{k}__k_10"] for k in range(11)], rel=1e-4, abs=1e-4) for r in both)
    assert all(0 <= r[1] <= 40 and 0 <= r[2] <= 40 for r in rows_of(spark, "t11_number_cwt_peaks").collect())
    assert rows_of(spark, "t23_spectral").count() == len(rows_of(spark, "t36_complexity").collect())


def test_embeddings_of_series(spark):
    got = rows_of(spark, "t28_embed_series").collect()
    assert got and all(len(r.emb) == 8 and all(map(math.isfinite, r.emb)) for r in got)


def test_selected_features_pass_their_bound(spark):
    every = {r.feature for r in rows_of(spark, "n3_p_values").collect()}
    got = rows_of(spark, "n4_select_features").collect()
    assert {r.feature for r in got} <= every and all(r.p <= 0.05 and r.n_classes >= 1 for r in got)


def test_components_are_centred_and_uncorrelated(spark):
    import numpy as np

    p = np.array([(r.pc1, r.pc2) for r in rows_of(spark, "l13_pca_2d").collect()])
    c = np.cov(p.T)
    assert np.abs(p.mean(0)).max() < 1e-6 and abs(c[0, 1]) < 1e-6 * c[0, 0] and c[0, 0] >= c[1, 1]
    raw = np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()], float)
    z = (raw - raw.mean(0)) / raw.std(0)
    assert np.linalg.eigvalsh(np.cov(z.T))[::-1][:2] == pytest.approx([c[0, 0], c[1, 1]], rel=1e-6)
    over = rows_of(spark, "l14_projection_overlay").collect()
    assert len(over) == len(p) and all(r.correct == (r.label == r.pred) for r in over)


def test_patience_query_keeps_fewer_trees_than_allowed(spark):
    got = rows_of(spark, "l4_patience").collect()
    assert got and all(1 <= r.trees <= 8 for r in got)
