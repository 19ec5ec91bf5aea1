"""Queries of splits, models and attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import attribution as H
from pulsegrid.operators import models as L
from pulsegrid.sources.shared import stored

from . import fixtures as X
from .fixtures import ATTRIBUTIONS, r6
from .q_features import r6 as n6
from .q_stats import rn
from .register import query

_RANK = "SELECT event_id, event_type AS label, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_id), event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events"


def _events(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    return X.table(spark, d, "events").select("event_id", F.col("event_type").alias("label"), "value", k.alias("k"), (F.col("value") * 0.1 + F.when(F.col("event_type") == "click", 30.0).otherwise(0.0) + k / 10).alias("mixed"))


@query("l1_stratified_split", f"SELECT event_id, label, CASE WHEN r < floor(n * 0.2::DOUBLE) THEN 'test' WHEN r < floor(n * 0.2::DOUBLE) + floor((n - floor(n * 0.2::DOUBLE)) * 0.15::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM ({_RANK})")
def l1(spark, d):
    return L.stratified_split(_events(spark, d), "event_id").select("event_id", "label", "split")


@query("l2_undersample", f"SELECT event_id, label FROM ({_RANK}) WHERE r < (SELECT min(n) FROM ({_RANK}))")
def l2(spark, d):
    return L.undersample(_events(spark, d), "event_id").select("event_id", "label")


@query("l3_scale", f"WITH f AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events WHERE event_id % 4 <> 0) SELECT event_id, {rn('(value - m) / CASE WHEN s = 0 THEN 1 ELSE s END')} AS value FROM events, f")
def l3(spark, d):
    e = _events(spark, d).select("event_id", "value")
    return L.scale(e, ["value"], e.where("event_id % 4 <> 0")).withColumn("value", n6("value"))


@query("h8_explain_sample", f"SELECT event_id, label FROM ({_RANK}) WHERE (SELECT count(*) FROM events) <= 500 OR r < ceil(n * 500 / (SELECT count(*) FROM events))")
def h8(spark, d):
    return L.explain_sample(_events(spark, d), "event_id", 500).select("event_id", "label")


def _model(spark, d, **options):
    return L.train_boosted(_events(spark, d), ["value", "k", "mixed"], rounds=2, depth=3, eta=0.3, **options)


@query("l4_train_boosted")
def l4(spark, d):
    return _model(spark, d).transform(_events(spark, d)).groupBy("label", "said").agg(F.count("*").alias("n"))


@query("l5_train_leafwise")
def l5(spark, d):
    m = L.train_leafwise(_events(spark, d), ["value", "mixed"], rounds=1)
    return m.transform(_events(spark, d)).groupBy("label", "said").agg(F.count("*").alias("n"))


@query("l6_grid_search")
def l6(spark, d):
    e = _events(spark, d).withColumn("y", (F.col("label") == "click").cast("int"))
    return L.grid_search(e, ["value", "mixed"], "y", {"maxDepth": [2, 3], "stepSize": [0.1, 0.5], "maxIter": [2]}, folds=3)


def _split_events(spark, d):
    """Training and validation rows of the stratified split, with a column that tells them apart."""
    return L.stratified_split(_events(spark, d), "event_id").where("split <> 'test'").withColumn("held", F.col("split") == "val")


@query("l4_patience")
def l4_patience(spark, d):
    """Early stopping on the validation rows of the split: trees that each class keeps of the rounds allowed."""
    m = L.train_boosted(_split_events(spark, d), ["value", "k", "mixed"], rounds=8, depth=3, eta=1.0, validation="held", patience=2)
    return spark.createDataFrame([(c, len(x.trees)) for c, x in zip(m.classes, m.models, strict=True)], "class string, trees int")


@query("l7_learning_curve")
def l7(spark, d):
    """The trainer's own settings: up to 500 rounds of depth 6, stopped by the validation rows; the rounds of patience are shown too."""
    e = stored(_split_events(spark, d), "split")  # trained on and judged
    return L.learning_curve(L.train_boosted(e, ["value", "k", "mixed"], validation="held", past_best=True), e, validation="held")


@query("l8_gain_importance")
def l8(spark, d):
    return L.gain_importance(_model(spark, d), spark)


@query("l9_compare_feature_sets")
def l9(spark, d):
    return L.compare_feature_sets(_events(spark, d), {"meta": ["value", "k"], "both": ["value", "k", "mixed"]}, "event_id", rounds=3, depth=3)


@query("l10_permutation_importance")
def l10(spark, d):
    return L.permutation_importance(_model(spark, d), _events(spark, d), "event_id", repeats=3)


@query("l12_predict_mixture")
def l12(spark, d):
    e = _events(spark, d).withColumn("file", F.col("event_id") % 50)
    return L.predict_mixture(_model(spark, d), e, "file")[0]


def _components(spark, d, key):
    e = X.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias(key), *[F.get("embedding", F.lit(k)).cast("double").alias(f"e{k}") for k in range(64)]), [f"e{k}" for k in range(64)]


@query("l13_pca_2d")
def l13(spark, d):
    e, names = _components(spark, d, "vec_id")
    return L.pca_2d(e, names, "vec_id", n=None)[0].select("vec_id", "pc1", "pc2")


@query("l14_projection_overlay")
def l14(spark, d):
    phi = X.attributions(spark, d)
    e, names = _components(spark, d, "id")
    return L.projection_overlay(L.pca_2d(e, names, "id", n=None)[0], phi.select("id", "label", "pred").distinct(), phi)


@query("l11_model_round_trip")
def l11(spark, d):
    """Saved, loaded by its fingerprint, and used."""
    path = X.scratch(spark, "model")
    L.load_or_train(path, "v1", "fp", lambda: _model(spark, d), spark)
    model, _, _ = L.load_or_train(path, "v2", "fp", lambda: _model(spark, d), spark)
    return model.transform(_events(spark, d)).groupBy("label", "said").agg(F.count("*").alias("n"))


@query("h1_attribution_tables")
def h1_tables(spark, d):
    """Attributions of a model through the tables made from them: mean |phi| by class, with the dominant class beside."""
    phi, _ = H.tree_attributions(_model(spark, d), L.explain_sample(_events(spark, d), "event_id", 2000), "event_id")
    return H.mean_abs_by_class(phi).crossJoin(F.broadcast(H.dominant_class(phi).withColumnRenamed("class", "dominant")))


@query("h1_tree_attributions")
def h1(spark, d):
    phi, _ = H.tree_attributions(_model(spark, d), L.explain_sample(_events(spark, d), "event_id", 2000), "event_id")  # the sample is part of the operator (H8)
    return phi


@query("h2_mean_abs_by_class", f"SELECT feature, class, {rn('avg(abs(phi))')} AS mean_abs FROM ({ATTRIBUTIONS}) GROUP BY 1, 2")
def h2(spark, d):
    return H.mean_abs_by_class(X.attributions(spark, d)).withColumn("mean_abs", n6("mean_abs"))


def _avg_rank(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (ORDER BY {c} DESC NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE END"


@query("h3_importance_comparison", f"""
WITH g AS (SELECT 'f' || d AS feature, max(x) AS gain, CASE WHEN avg(x) > 0 THEN var_pop(x) END AS h FROM ({X.COMPONENTS}) GROUP BY d),
a AS (SELECT feature, avg(abs(phi)) AS mean_abs FROM ({ATTRIBUTIONS}) GROUP BY 1),
r AS (SELECT feature, {_avg_rank('gain')} AS rg, {_avg_rank('mean_abs')} AS ra, {_avg_rank('h')} AS rh FROM g LEFT JOIN a USING (feature))
SELECT feature, rg AS rank_gain, ra AS rank_mean_abs, rh AS rank_h, rg - ra AS gain_vs_attribution, rh - ra AS test_vs_attribution FROM r
""")
def h3(spark, d):
    e = X.table(spark, d, "embeddings").select(F.posexplode("embedding").alias("d", "x")).withColumn("x", F.col("x").cast("double"))
    base = e.groupBy("d").agg(F.max("x").alias("gain"), F.when(F.avg("x") > 0, F.var_pop("x")).alias("h"))
    base = base.withColumn("feature", F.concat(F.lit("f"), F.col("d").cast("string")))
    means = X.attributions(spark, d).groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))
    out = H.importance_comparison(base.select("feature", "gain"), means, base.where("h is not null").select("feature", "h"))
    return out.select("feature", "rank_gain", "rank_mean_abs", "rank_h", "gain_vs_attribution", "test_vs_attribution")


@query("h4_dominant_class", f"SELECT arg_max(class, total) AS class, round(max(total), 4) AS total FROM (SELECT class, sum(abs(phi)) AS total FROM ({ATTRIBUTIONS}) GROUP BY 1)")
def h4(spark, d):
    return H.dominant_class(X.attributions(spark, d)).withColumn("total", F.round("total", 4))


@query("h5_misclassification_gap", f"SELECT feature, {rn('avg(phi) FILTER (label = pred)')} AS \"right\", {rn('avg(phi) FILTER (label <> pred)')} AS wrong, {rn('avg(phi) FILTER (label <> pred) - avg(phi) FILTER (label = pred)')} AS gap FROM ({ATTRIBUTIONS}) WHERE class = pred GROUP BY 1")
def h5(spark, d):
    return H.misclassification_gap(X.attributions(spark, d)).select("feature", n6("right").alias("right"), n6("wrong").alias("wrong"), n6("gap").alias("gap"))


@query("h6_waterfall_rows", f"""
WITH p AS ({ATTRIBUTIONS}), i AS (SELECT DISTINCT id FROM p WHERE label <> pred ORDER BY id LIMIT 20)
SELECT id, feature, {rn('phi')} AS phi, (row_number() OVER (PARTITION BY id ORDER BY abs(phi) DESC, feature))::INTEGER AS place FROM p WHERE class = pred AND id IN (SELECT id FROM i)
""")
def h6(spark, d):
    return H.waterfall_rows(X.attributions(spark, d), 20).select("id", "feature", n6("phi").alias("phi"), "place")


@query("h7_dependence_rows", f"SELECT vec_id AS id, feature, round(embedding[1]::DOUBLE, 6) AS value, {rn('phi')} AS phi FROM ({ATTRIBUTIONS}) p JOIN embeddings ON id = vec_id WHERE feature = 'f0' AND class = 1")
def h7(spark, d):
    values = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("f0").alias("feature"), F.get("embedding", F.lit(0)).cast("double").alias("value"))
    return H.dependence_rows(X.attributions(spark, d), values, ["f0", "f1"], 1).select("id", "feature", r6("value").alias("value"), n6("phi").alias("phi"))


