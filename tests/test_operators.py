"""Hand-computed cases of the edge rules, and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.operators import aggregates as A
from pulsegrid.operators import attribution as H
from pulsegrid.operators import features as T
from pulsegrid.operators import filters as O
from pulsegrid.operators import hypothesis as N
from pulsegrid.operators import joins as J
from pulsegrid.operators import models as L
from pulsegrid.operators import signal as E
from pulsegrid.operators import windows as W
from pulsegrid.sources import tables as S
from pulsegrid.streaming import merge as I


def test_names_and_keys(spark):
    df = spark.createDataFrame([("P_10k_Sample#001", "20260501_1444 AN#3Pex1n1_Ph-Shanli"), ("abc", "x")], "sample_name string, ex_id string")
    a, b = C.derive_keys(df).collect()
    assert (a.file_number, a.machine_no, a.measured_at.strftime("%Y-%m-%d %H:%M")) == (1, 3, "2026-05-01 14:44")
    assert b.file_number is None and b.machine_no is None and b.measured_at is None
    row = spark.createDataFrame([("abc D_x", "abcd")], "a string, b string").select(C.sample_name(F.col("a")), C.sample_name(F.col("b"))).first()
    assert tuple(row) == ("abc", "abc")
    plan = C.normalise_file_name(spark.createDataFrame([("AB@1234_5678_9012_ID01xxx.tdms",), ("bad",)], "name string")).collect()
    assert [(r.new_name, r.skipped) for r in plan] == [("AB@1234_5678_9012_ID01xxx.tdms", False), (None, True)]


def test_filters(spark):
    df = spark.createDataFrame([(10, -299.5, 5.0), (11, -299.0, 5.0), (5, 0.0, 5.0), (6, 0.0, None)], "duration int, baseline double, signal double")
    assert [r.duration for r in O.min_duration(df).collect()] == [11]
    assert [r.duration for r in O.range_filter(df).collect()] == [11]
    spec = {"duration": {"min": 6}, "signal": {"max": 9}, "nothing": {"min": 1}}
    with pytest.warns(UserWarning):
        assert O.apply_conditions(df, spec).count() == 2
    flat = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("a", 50.0), ("a", None)], "g string, v double")
    flags = {r.v: r.outlier for r in O.split_outliers(flat.union(flat).where("v <> 50 or v is null").union(flat.where("v = 50")), "v", ["g"]).collect()}
    assert flags == {5.0: False, 50.0: True, None: False}


def test_clip_and_wave(spark):
    trace = spark.createDataFrame([("f", i, float(i)) for i in range(40)], "file string, idx long, y double")
    peaks = spark.createDataFrame([("f", 0, 0, 3, 4, 1.0, 0.0), ("f", 1, 38, 60, 2, 0.0, 0.0), ("f", 2, 90, 95, 0, 1.0, 0.0)], "file string, peak int, start long, end long, duration int, signal double, baseline double")
    clips = {r.peak: r.clip for r in E.clip_events(peaks, trace, 8).collect()}
    assert clips == {0: [float(i) for i in range(6)], 1: [36.0, 37.0, 38.0, 39.0], 2: []}
    waves = E.clip_events(peaks, trace, 8).select("peak", E.resample_wave(F.col("clip")).alias("w")).collect()
    for r in waves:
        c = clips[r.peak]
        want = [np.interp(u * len(c) / 13, range(len(c)), c) for u in range(12)] if c else [0.0] * 12
        assert np.allclose(r.w, want)
    zero = E.clip_events(peaks, trace, 8).where("peak = 1").select(E.scale_wave(F.col("clip"), F.col("baseline"), F.col("signal")).alias("w")).first().w
    assert zero[0] == 36.0 * 1000 / 1e-12


def test_pulses(spark):
    y = [0.0] * 100
    y[10:12], y[30:31], y[97:100] = [9.0, 9.0], [9.0], [9.0] * 3
    trace = spark.createDataFrame([("f", i, v) for i, v in enumerate(y)], "file string, idx long, y double")
    got = sorted((r.start, r.end, r.peak_idx) for r in E.detect_pulses(trace, k=2.0, size=100).collect())
    assert got == [(10, 11, 10), (97, 99, 97)]


def test_savgol_keeps_cubics_and_short_chunks(spark):
    cubic = lambda i: 1 + i - 0.1 * i**2 + 0.001 * i**3
    trace = spark.createDataFrame([("f", i, float(cubic(i))) for i in range(120)] + [("g", i, float(i % 3)) for i in range(20)], "file string, idx long, y double")
    for r in E.savgol(trace, size=1000).collect():
        assert abs(r.smooth - (cubic(r.idx) if r.file == "f" else r.idx % 3)) < 1e-6


def test_ids_cross_files(spark):
    df = spark.createDataFrame([("b", 5), ("a", 9), ("a", 2)], "file string, peak int")
    assert sorted((r.event_id, r.file, r.peak) for r in E.assign_event_ids(df, ["file", "peak"], 7).collect()) == [(7, "a", 2), (8, "a", 9), (9, "b", 5)]


def test_features_of_constant_and_short_series(spark):
    s = spark.createDataFrame([("c", i, 2.0) for i in range(6)] + [("s", 0, 1.0)], "id string, time int, value double")
    out = {r.id: r for r in T.extract_features(s, "efficient").collect()}
    assert out["c"].value__autocorrelation__lag_1 is None and out["c"].value__longest_strike_above_mean == 0 and out["s"].value__skewness is None
    assert out["s"].value__c3__lag_1 == 0 and out["s"].value__fft_coefficient__coeff_1__attr_abs is None
    assert T.cwt_peaks(np.sin(np.linspace(0, 6 * np.pi, 100)), 5) >= 3
    T.CALCULATORS["range"] = lambda: F.max("_x") - F.min("_x")
    assert T.extract_features(s, {"range": [{}]}).where("id = 'c'").first().value__range == 0
    a = T.series_to_array(s)
    assert [r.id for r in a.collect()] == ["c"] and len(T.embed_series(a).first().emb) == 8


def test_quantile_ranks(spark):
    rng = np.random.default_rng(0)
    v = [float(x) for x in rng.integers(0, 500, 2000)] + [None, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id int, v double")
    got = {r.id: r.rank for r in W.avg_rank(df, "v", desc=False).collect()}
    order = sorted(x for x in v if x is not None)
    import bisect

    for i, x in enumerate(v):
        want = 2001.5 if x is None else (bisect.bisect_left(order, x) + bisect.bisect_right(order, x) + 1) / 2
        assert got[i] == want


def test_tails():
    assert abs(N.f_tail(4.0, 2, 10) - 1.8**-5) < 1e-12
    assert abs(N.chi2_tail(5.991464547, 2) - 0.05) < 1e-9
    assert abs(N.t_tail(2.228138852, 10) - 0.05) < 1e-8
    assert abs(N.normal_tail(1.959963985) - 0.05) < 1e-9
    assert N.f_tail(0, 1, 1) == 1 and N.chi2_tail(0, 3) == 1


def test_selection_finds_the_telling_feature(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i % 2), float(rng.normal() + 3 * (i % 2)), float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "label string, good double, noise double")
    assert [r.feature for r in N.select_features(df, ["good", "noise"]).collect()] == ["good"]


def test_mixture_keeps_files_without_confident_events(spark):
    p = spark.createDataFrame([("a", [0.9, 0.1]), ("a", [0.5, 0.5]), ("b", [0.6, 0.4])], "file string, prob array<double>")
    out = {r.file: r for r in A.mixture_ratio(p, "file", ("x", "y"), only_confident=True).collect()}
    assert (out["b"]["count"], out["b"].pct_x, out["b"].mean_pmax, out["b"].count_excluded) == (0, 0.0, None, 1)
    assert (out["a"]["count"], out["a"].pct_x) == (1, 100.0)
    every = A.mixture_ratio(p, "file", ("x", "y")).where("file = 'a'").first()
    assert (every.pct_x, every.mean_pmax, every.pct_confident) == (100.0, 0.7, 50.0)


def test_histograms_hold_all_in_range(spark):
    df = spark.createDataFrame([("a", float(i), 1.0) for i in range(1, 400)] + [("b", 0.5, 1.0)], "label string, x double, flat double")
    h = A.histogram_stats(df, ["x", "flat"])
    ranges = {r.feature: r for r in A.value_ranges(A.value_counts(df, ["x", "flat"])).collect()}
    for r in h.groupBy("feature").agg(F.sum("count").alias("n")).collect():
        assert r.n == ranges[r.feature].n
    empty = spark.createDataFrame([], "value double")
    edges = [r.edge for r in A.bin_edges(empty, "value").orderBy("k").collect()]
    assert abs(edges[0] + 0.1) < 1e-9 and abs(edges[-1] - 3.4) < 1e-9
    assert A.confidence_ellipse(df.where("label = 'b'"), "x", "flat").count() == 0
    with pytest.raises(ValueError):
        A.class_counts(df.where("label = 'a'"))


def test_joins(spark):
    files = spark.createDataFrame([("src10_en",), ("zzz",)], "stem string")
    counts = spark.createDataFrame([("src1", 2, 5), ("src10", 1, 7), ("src1", 3, 9)], "name string, position int, count int")
    assert {(r.stem, r["count"]) for r in J.match_counts(files, counts).collect()} == {("src10_en", 7), ("zzz", 0)}
    with pytest.raises(ValueError):
        J.schema_guard({"a": files.withColumn("value__x", F.lit(1)), "b": files})


def test_merge_is_idempotent(spark):
    schema = "event_id long, file string, peak_pos int"
    stored = spark.createDataFrame([(0, "a", 1), (1, "a", 2)], schema)
    new = spark.createDataFrame([(0, "a", 2), (1, "a", 3), (2, "a", 3), (3, "b", 1)], schema)
    first = I.merge_new_events(stored, new)
    assert tuple(first.counts.first()) == (2, 2)
    assert sorted(r.event_id for r in first.added.collect()) == [3, 5]
    assert I.merge_new_events(first.events, new).counts.first().n_added == 0


def test_stream_equals_batch(spark, tmp_path):
    schema = "event_id long, file string, peak_pos int"
    src, target, check = (str(tmp_path / n) for n in ("src", "target", "check"))
    rows = [(i, f"f{i % 3}", i % 7) for i in range(30)]
    a, b = spark.createDataFrame(rows[:15], schema), spark.createDataFrame(rows[15:], schema)
    S.append_events(a.coalesce(1), src)
    I.ingest_stream(spark, src, schema, target, check).awaitTermination()
    assert spark.read.parquet(target).count() == len({(r[1], r[2]) for r in rows[:15]})
    S.append_events(b.coalesce(1), src)
    I.ingest_stream(spark, src, schema, target, check).awaitTermination()
    I.ingest_stream(spark, src, schema, target, check).awaitTermination()
    got = spark.read.parquet(target)
    assert got.count() == got.select("file", "peak_pos").distinct().count() == len({(r[1], r[2]) for r in rows})
    assert got.count() == got.select("event_id").distinct().count()


def test_stream_with_watermark(spark, tmp_path):
    schema = "event_id long, file string, peak_pos int, measured_at timestamp"
    src, target, check = (str(tmp_path / n) for n in ("src", "target", "check"))
    df = spark.createDataFrame([(0, "a", 1), (1, "a", 1), (2, "b", 1)], "event_id long, file string, peak_pos int").withColumn("measured_at", F.to_timestamp(F.lit("2026-01-01")))
    S.append_events(df, src)
    I.ingest_stream(spark, src, schema, target, check, watermark=("measured_at", "1 day")).awaitTermination()
    assert spark.read.parquet(target).count() == 2


def test_feature_store(spark, tmp_path):
    store, calls = I.FeatureStore(spark, str(tmp_path / "store")), []

    def compute():
        calls.append(1)
        return spark.createDataFrame([(1, 2.0)], "id int, x double")

    for _ in range(2):
        assert store.get("s", "fp", {"a": [{}]}, compute).first().x == 2.0
    assert len(calls) == 1 and I.preset_hash({"a": [{}]}) != I.preset_hash({"b": [{}]})
    keys = spark.createDataFrame([("s", "fp", I.preset_hash({"a": [{}]})), ("t", "fp", "x")], "sample string, fingerprint string, preset string")
    assert [r["sample"] for r in store.missing(keys).collect()] == ["t"]
    store.clear("s", "fp", {"a": [{}]})
    store.get("s", "fp", {"a": [{}]}, compute)
    assert len(calls) == 2


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("srv1", 1), ("srv2", 2)], "server string, n int")
    for ts in ("t1", "t2"):
        S.write_snapshot(df, str(tmp_path / "snap"), ts, "server")
    assert spark.read.parquet(str(tmp_path / "snap/history")).count() == 4 and spark.read.parquet(str(tmp_path / "snap/latest")).count() == 2
    S.write_result(df, str(tmp_path / "out.csv"), "csv")
    assert S.read_table(spark, str(tmp_path / "out")).count() == 2
    assert S.list_files(spark, str(tmp_path / "snap"), "*.parquet").count() >= 4
    m = S.run_manifest(spark, {"a": 1}, {"both": 3}, {"both": 0.5}).first()
    assert m.n_features == {"both": 3} and m.macro_f1 == {"both": 0.5}
    t = spark.createDataFrame([("f", 0, 1.0), ("f", 1, 2.0), ("g", 0, 1.0)], "file string, idx long, y double")
    assert {r.file for r in S.export_clip(t, 0.0, 0.0001, 1e-4).collect()} == {"f"}


@pytest.fixture(scope="module")
def trained(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "abc"[i % 3], float(rng.normal() + (i % 3)), float(rng.normal()), i % 5) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, label string, x double, noise double, file int").persist()
    return df, L.train_boosted(df, ["x", "noise"], rounds=3, depth=3, eta=0.3)


def test_attributions_add_up_to_the_margin(spark, trained):
    df, model = trained
    phi, bases = H.tree_attributions(model, df.limit(20), "id")
    sums = {(r.id, r["class"]): r.s for r in phi.groupBy("id", "class").agg(F.sum("phi").alias("s")).collect()}
    import pandas as pd

    x = pd.DataFrame([(r.id, r.x, r.noise) for r in df.limit(20).collect()], columns=["id", "x", "noise"])
    for c, m in zip(model.classes, model.models, strict=True):
        margin = 2 * sum(w * np.array([t.predict(__import__("pyspark").ml.linalg.Vectors.dense([a, b])) for a, b in zip(x.x, x.noise, strict=True)]) for t, w in zip(m.trees, m.treeWeights, strict=True))
        for i, want in zip(x.id, margin, strict=True):
            assert math.isclose(bases[c] + sums[i, c], want, abs_tol=1e-9)
    assert H.mirror_binary(phi.where("class = 'a'"), ("n", "p")).agg(F.sum("phi")).first()[0] == pytest.approx(0)


def test_model_round_trip_and_importance(spark, trained, tmp_path):
    df, model = trained
    L.save_model(model, str(tmp_path / "m"), "v1", "fp1", spark)
    loaded, version = L.load_model(str(tmp_path / "m"), spark, "fp1")
    assert version == "v1" and L.load_model(str(tmp_path / "m"), spark, "other") is None and L.load_model(str(tmp_path / "none"), spark) is None
    key = lambda m: sorted((r.id, r.pred) for r in m.transform(df).select("id", "pred").collect())
    assert key(loaded) == key(model)
    all_rows, confident = L.predict_mixture(model, df, "file")
    assert all_rows.count() == confident.count() == 5
    assert all(abs(r.pct_a + r.pct_b + r.pct_c - 100) < 0.05 for r in all_rows.collect())
    gain = {r.feature: r for r in L.gain_importance(model, spark).collect()}
    assert gain["x"].gain > gain["noise"].gain and gain["x"].splits > 0
    perm = {r.feature: r.importance_mean for r in L.permutation_importance(model, df, "id", repeats=1).collect()}
    assert perm["x"] > perm["noise"]
    losses = [r.loss for r in L.learning_curve(model, df).where("class = 'a'").orderBy("round").collect()]
    assert losses == sorted(losses, reverse=True)
    with pytest.raises(ValueError):
        model.transform(df.drop("x"))
    with pytest.raises(ValueError):
        L.train_boosted(df.where("label = 'a'"), ["x"])


CURATED_CATEGORIES = {"current level": 11, "waveform asymmetry": 2, "frequency content": 19, "peak count": 5, "rise / fall": 11, "local variation": 5, "autocorrelation": 10}


def test_presets_and_their_categories(spark):
    rows = [(k, t, float((t * 7 + k * 3) % 11)) for k in range(3) for t in range(30)]
    series = spark.createDataFrame(rows, "id int, time int, value double")
    out = T.extract_features(series, "curated")
    names = out.columns[1:]
    assert len(names) == 63 and len(T.extract_features(series, "efficient").columns) > 63 + 60
    cats = spark.createDataFrame([(n,) for n in names], "f string").groupBy(C.feature_category(F.col("f")).alias("c")).count().collect()
    assert {r.c: r["count"] for r in cats} == CURATED_CATEGORIES
    got = {r.id: r for r in out.collect()}
    x = np.array([v for k, t, v in rows if k == 1])
    a = np.abs(np.fft.rfft(x))
    assert got[1]["value__fft_aggregated__aggtype_centroid"] == pytest.approx((np.arange(16) * a).sum() / a.sum())
    assert got[1]["value__number_cwt_peaks__n_1"] == T.cwt_peaks(x, 1)
    slow = {r.id: r for r in T.fft_aggregated(series).collect()}
    for k in range(3):
        for n in ("centroid", "variance", "skew", "kurtosis"):
            assert got[k][f"value__fft_aggregated__aggtype_{n}"] == pytest.approx(slow[k][n])
    assert T.extract_features(series.where("time < 2"), "efficient").count() == 3


def test_spectral_calculators():
    rng = np.random.default_rng(5)
    e = rng.normal(size=4000)
    x = np.zeros(4000)
    for t in range(1, 4000):
        x[t] = 0.7 * x[t - 1] + e[t]
    assert abs(T.partial_autocorrelation(x, 1) - 0.7) < 0.05 and abs(T.partial_autocorrelation(x, 2)) < 0.05
    wave = np.sin(2 * np.pi * 5 * np.arange(256) / 256)
    density = [T.welch_density(wave, k) for k in range(12)]
    assert int(np.argmax(density)) == 5 and T.welch_density(wave[:4], 5) is None
    assert T.agg_autocorrelation(np.ones(10), "mean", 40) == 0.0 and T.cwt_coefficient(wave, 300, 2) is None


def test_repeated_peaks_keep_their_clips(spark):
    trace = spark.createDataFrame([("f", i, float(i)) for i in range(40)], "file string, idx long, y double")
    peaks = spark.createDataFrame([("f", 5, 4, 9, 2, 1.0, 0.0)] * 2 + [("f", 5, 4, 6, 2, 1.0, 0.0)], "file string, peak int, start long, end long, duration int, signal double, baseline double")
    assert sorted(len(r.clip) for r in E.clip_events(peaks, trace, 8).collect()) == [6, 9, 9]


def test_string_classes_pass_through_the_attribution_tables(spark):
    phi = spark.createDataFrame([(1, "click", "a", 2.0), (1, "view", "a", -2.0), (2, "error", "a", 1.0)], "id int, class string, feature string, phi double")
    assert tuple(H.dominant_class(phi).first()) == ("click", 2.0)


def test_exact_percentiles(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g, size in (("a", 1), ("b", 2), ("c", 501)) for v in rng.integers(0, 90, size)] + [("c", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in W.exact_percentiles(df.groupBy("g", "v").count(), "v", "count", ["g"], {"x": 0.25, "y": 0.995}).collect()}
    for g in "abc":
        values = [v for k, v in rows if k == g and v is not None]
        assert got[g].x == pytest.approx(np.percentile(values, 25)) and got[g].y == pytest.approx(np.percentile(values, 99.5))
    assert "d" not in got
