"""Early stopping, learning curves, model reuse, substring matching."""

import numpy as np
import pytest

from pulsegrid.operators import joins as J
from pulsegrid.operators import models as L


def test_best_round_by_patience():
    assert L.best_round([5, 4, 3, 3, 4, 2], 2) == (3, True)  # the later gain is out of patience
    assert L.best_round([5, 4, 3, 3, 4, 2], 3) == (6, False)
    assert L.best_round([1.0], 5) == (1, False) and L.best_round([2, 2, 2], 2) == (1, True)


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "ab"[int(rng.random() < (0.8 if x > 0 else 0.2))], float(x), float(rng.normal()), bool(i % 3 == 0)) for i, x in enumerate(rng.normal(size=400))]
    return spark.createDataFrame(rows, "id int, label string, x double, noise double, held boolean").persist()


def test_boosting_stops_at_the_best_validation_round(spark, noisy):
    m = L.train_boosted(noisy, ["x", "noise"], rounds=12, depth=4, eta=0.8, validation="held", patience=2)
    whole = L.train_boosted(noisy.where("not held"), ["x", "noise"], rounds=8, depth=4, eta=0.8)
    curve = L.learning_curve(whole, noisy, validation="held")
    for c, short in zip(m.classes, m.models, strict=True):
        loss = [r.loss for r in curve.where(f"rows = 'validation' and class = '{c}'").orderBy("round").collect()]
        best, stops = L.best_round(loss, 2)
        assert stops and len(short.trees) == best < 8  # noise is learned soon, so boosting ends early
        train = [r.loss for r in curve.where(f"rows = 'train' and class = '{c}'").orderBy("round").collect()]
        assert len(train) == 8 and train[-1] < train[0]
        kept = L.learning_curve(m, noisy, validation="held").where(f"rows = 'validation' and class = '{c}'").orderBy("round").collect()
        assert [r.loss for r in kept] == pytest.approx(loss[:best])
    scored = m.transform(noisy)
    assert scored.where("pred between 0 and 1").count() == 400


def test_models_are_reused_unless_forced(spark, noisy, tmp_path):
    calls = []

    def train():
        calls.append(1)
        return L.train_boosted(noisy, ["x"], rounds=1, depth=2)

    use = lambda version, fp, **o: L.load_or_train(str(tmp_path / "m"), version, fp, train, spark, **o)[1:]
    assert use("v1", "a") == ("v1", False) and use("v2", "a") == ("v1", True) and use("v3", "b") == ("v3", False) and use("v4", "b", force=True) == ("v4", False)
    model, version, reused = L.load_or_train(str(tmp_path / "m"), "v5", "b", train, spark)
    assert (version, reused) == ("v4", True) and len(calls) == 3
    out = L.predict_mixture(model, noisy.withColumn("file", noisy.id % 3), "file", version=version)[0]
    assert {r.model_version for r in out.collect()} == {"v4"}


def test_substring_matches_by_grams(spark):
    rng = np.random.default_rng(0)
    word = lambda n: "".join(rng.choice(list("abcé"), n))
    stems = [word(int(n)) for n in rng.integers(0, 14, 150)] + ["aaaaaaaa", None]
    names = list({word(int(n)) for n in rng.integers(1, 8, 60)}) + ["zz", "abz", None]
    counts = [(n, int(p), i) for i, (n, p) in enumerate(zip(names, rng.permutation(len(names)), strict=True))] + [(names[0], 1000, 77)]
    files = spark.createDataFrame([(s, i) for i, s in enumerate(stems)], "stem string, row int")
    for extra in ([], [("", 10**6, 5)]):
        want = []
        for i, s in enumerate(stems):
            hits = [(p, c) for n, p, c in counts + extra if n is not None and s is not None and n in s]
            want.append((i, min(hits)[1] if hits else 0))
        got = J.match_counts(files, spark.createDataFrame(counts + extra, "name string, position int, count int"))
        assert sorted((r.row, r["count"]) for r in got.collect()) == want
    plan = J.match_counts(files, spark.createDataFrame(counts, "name string, position int, count int"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and plan.lower().count("join cross") == 0


def test_equal_rows_are_trained_and_judged_once(spark, noisy):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    twice = noisy.withColumn("x", F.round("x", 1)).drop("noise").withColumn("copy", F.explode(F.sequence(F.lit(1), 1 + F.col("id") % 3)))
    calls = spark.sparkContext.accumulator(0)

    def seen(v):
        calls.add(1)
        return v

    counted = twice.withColumn("x", F.udf(seen, "double").asNondeterministic()("x"))
    m = L.train_boosted(counted, ["x"], rounds=4, depth=3, eta=0.5, validation="held", patience=2)
    assert calls.value == twice.count()  # every row is computed once, however many passes the fits take
    curve = L.learning_curve(m, counted, validation="held")
    assert calls.value == 2 * twice.count()
    for held, name in ((True, "validation"), (False, "train")):  # as Spark's own evaluation of all the rows, one by one
        rows = VectorAssembler(inputCols=["x"], outputCol="_x").transform(twice.where(F.col("held") == held))
        for c, model in zip(m.classes, m.models, strict=True):
            want = model.copy({model.featuresCol: "_x", model.labelCol: "_y"}).evaluateEachIteration(rows.withColumns({"_y": (F.col("label") == c).cast("double"), "_w": F.lit(1.0)}))
            got = [r.loss for r in curve.where(f"rows = '{name}' and class = '{c}'").orderBy("round").collect()]
            assert got == pytest.approx(want)
    plain = L.train_boosted(twice, ["x"], rounds=3, depth=3, eta=0.5)
    rows = VectorAssembler(inputCols=["x"], outputCol="_x").transform(twice).withColumn("_y", (F.col("label") == "b").cast("double"))
    one = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=3, maxDepth=3, stepSize=0.5, featureSubsetStrategy="all", seed=42).fit(rows)
    tests = lambda model: [line for line in model.trees[0].toDebugString.split("\n") if "If" in line]
    assert tests(plain.models[1]) == tests(one)


def test_rounds_of_patience_are_kept_for_a_learning_curve(spark, noisy):
    short = L.train_boosted(noisy, ["x", "noise"], rounds=12, depth=4, eta=0.8, validation="held", patience=2)
    m = L.train_boosted(noisy, ["x", "noise"], rounds=12, depth=4, eta=0.8, validation="held", patience=2, past_best=True)
    curve = L.learning_curve(m, noisy, validation="held").where("rows = 'validation'")
    for c, up, to in zip(m.classes, m.models, short.models, strict=True):
        loss = [r.loss for r in curve.where(f"class = '{c}'").orderBy("round").collect()]
        assert len(loss) == len(up.trees) == len(to.trees) + 2 and L.best_round(loss, 2) == (len(to.trees), True)
    assert spark.sparkContext.getCheckpointDir()  # long runs are cut off every tenth round


def test_learning_curve_query_trains_with_the_full_settings(spark, monkeypatch):
    import inspect

    from pulsegrid.plans import q_models

    asked, train = {}, L.train_boosted

    def briefly(df, features, **options):
        asked.update(options)
        return train(df, features, **{"rounds": 3, "depth": 2, "patience": 1} | options)

    monkeypatch.setattr(L, "train_boosted", briefly)
    curve = q_models.l7(spark, "/root/testdata/sf0.001")
    assert not {"rounds", "depth", "eta", "subsample", "colsample", "patience"} & set(asked) and asked["validation"] == "held"
    own = inspect.signature(train).parameters
    assert (own["rounds"].default, own["depth"].default, own["eta"].default, own["patience"].default) == (500, 6, 0.1, 20)
    assert {r.rows for r in curve.collect()} == {"train", "validation"}
