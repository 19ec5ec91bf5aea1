"""Training and evaluation on Spark ML: splits, boosted trees, searches, importances, mixtures, projections."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from pulsegrid.sources.shared import scratch, stored

from .aggregates import confusion, f1, mixture_ratio, zscore
from .windows import running_id


#: Rows of a class that are ordered together.
BUCKET_ROWS = 200_000


def _hash(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string")))


def hash_rank(df: DataFrame, key: str, part: list[str], seed: int, out: str = "_rank") -> DataFrame:
    """Rank from 0 in a fixed random order within ``part``; hash prefixes are the buckets, so no class is ordered in one task.

    The prefix grows with the largest class: about ``BUCKET_ROWS`` rows of it share one.
    """
    tagged = df.withColumn("_hash", _hash(seed, key))
    largest = df.groupBy(*part).count().agg(F.max("count")).first()[0] or 0
    digits = max(2, math.ceil(math.log(max(1, largest / BUCKET_ROWS), 16)))
    return running_id(tagged, part, ["_hash", key], F.left("_hash", F.lit(digits)), out).drop("_hash")


def stratified_split(df: DataFrame, key: str, label: str = "label", test: float = 0.2, val: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds split: of each class the share ``test``, of its rest the share ``val``, else 'train'. Deterministic."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    ranked = hash_rank(df, key, [label], seed).join(F.broadcast(counts), label)
    n_test = F.floor(F.col("_n") * test)
    n_val = F.floor((F.col("_n") - n_test) * val)
    split = F.when(F.col("_rank") < n_test, "test").when(F.col("_rank") < n_test + n_val, "val").otherwise("train")
    return ranked.withColumn("split", split).drop("_rank", "_n")


def undersample(df: DataFrame, key: str, label: str = "label", seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest."""
    least = df.groupBy(label).agg(F.count("*").alias("c")).agg(F.min("c").alias("_least"))
    return hash_rank(df, key, [label], seed).crossJoin(F.broadcast(least)).where("_rank < _least").drop("_rank", "_least")


def scale(df: DataFrame, features: list[str], fit_on: DataFrame) -> DataFrame:
    return zscore(df, features, fit_on)


def explain_sample(df: DataFrame, key: str, n: int = 2000, label: str = "label", seed: int = 42) -> DataFrame:
    """Stratified sub-sample of about ``n`` rows; all rows where there are no more."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    ranked = hash_rank(df, key, [label], seed).join(F.broadcast(counts), label).crossJoin(F.broadcast(total))
    return ranked.where((F.col("_all") <= n) | (F.col("_rank") < F.ceil(F.col("_n") * n / F.col("_all")))).drop("_rank", "_n", "_all")


# ---------------------------------------------------------------- boosted trees


@dataclass
class Boosted:
    """One binary boosted model per class; probabilities are the softmax of their margins."""

    models: list[GBTClassificationModel]
    classes: list[str]
    features: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prob (array over classes), pred (class number) and said (class)."""
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ValueError(f"missing feature columns: {missing}")
        out = VectorAssembler(inputCols=self.features, outputCol="_x", handleInvalid="keep").transform(df)
        for k, m in enumerate(self.models):
            m = m.copy().setFeaturesCol("_x").setRawPredictionCol(f"_r{k}").setProbabilityCol(f"_p{k}").setPredictionCol(f"_y{k}")
            out = m.transform(out).withColumn(f"_m{k}", vector_to_array(f"_r{k}")[1]).drop(f"_r{k}", f"_p{k}", f"_y{k}")
        e = [F.exp(F.col(f"_m{k}")) for k in range(len(self.models))]
        out = out.withColumn("prob", F.array(*[x / sum(e[1:], e[0]) for x in e])).drop("_x", *[f"_m{k}" for k in range(len(self.models))])
        pred = (F.array_position("prob", F.array_max("prob")) - 1).cast("int")
        return out.withColumn("pred", pred).withColumn("said", F.get(F.array(*[F.lit(c) for c in self.classes]), F.col("pred")))


def best_round(losses: list[float], patience: int) -> tuple[int, bool]:
    """(round of least loss, whether boosting stops there): the loss has not fallen for ``patience`` rounds after it."""
    best = 0
    for k, v in enumerate(losses):
        if v < losses[best]:
            best = k
        elif k - best >= patience:
            return best + 1, True
    return best + 1, False


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The same model with its first ``n`` trees."""
    java, jvm = model._java_obj, SparkSession.active()._jvm
    gateway = SparkSession.active().sparkContext._gateway
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(jvm.double, n)
    for k, (tree, weight) in enumerate(zip(java.trees()[:n], model.treeWeights[:n], strict=True)):
        trees[k], weights[k] = tree, float(weight)
    cut = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), trees, weights, model.numFeatures, model.numClasses))
    return cut.copy({p: v for p, v in model.extractParamMap().items() if cut.hasParam(p.name)})


def _leaf_values(model: GBTClassificationModel) -> list[np.ndarray]:
    """Per tree what each leaf adds to the margin, in the order of Spark's leaf numbers (from left to right)."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        leaves = []
        _nodes(tree._call_java("rootNode"), lambda n, to=leaves: to.append(float(n.prediction())) if n.numDescendants() == 0 else None)
        out.append(weight * np.array(leaves))
    return out


def _losses(model: GBTClassificationModel, rows: DataFrame) -> dict[bool, list[float]]:
    """Mean log loss after each round of the rows (_x, _y, _w: how many rows one stands for) by ``_held``, in one pass.

    Spark's ``evaluateEachIteration`` takes no notice of weights.
    """
    values = _leaf_values(model)
    leaves = model.copy().setFeaturesCol("_x").setLeafCol("_leaf").transform(rows.select("_x", "_y", "_w", "_held")).select("_held", "_y", "_w", vector_to_array("_leaf").alias("leaf"))

    def run(parts):
        import pandas as pd

        for pdf in parts:
            if not len(pdf):
                continue
            at = np.stack(pdf["leaf"]).astype(int)
            margin = np.cumsum([v[at[:, k]] for k, v in enumerate(values)], axis=0)
            loss = 2 * np.logaddexp(0, -2 * (2 * pdf["_y"].to_numpy() - 1) * margin)
            held, w = pdf["_held"].to_numpy(bool), pdf["_w"].to_numpy()
            for side in np.unique(held):
                yield pd.DataFrame({"held": side, "round": np.arange(len(values)), "loss": loss[:, held == side] @ w[held == side], "w": w[held == side].sum()})

    sums = leaves.mapInPandas(run, "held boolean, round int, loss double, w double").groupBy("held", "round").agg((F.sum("loss") / F.sum("w")).alias("loss")).collect()
    return {side: [r["loss"] for r in sorted(sums, key=lambda r: r["round"]) if r["held"] == side] for side in {r["held"] for r in sums}}


def _training_rows(df: DataFrame, features: list[str], label: str, validation: str | None, alike: bool = True) -> DataFrame:
    """(label, features, _held, _w) written once, so that no pass of a fit computes ``df`` again. Equal rows are one with the weight
    of their number, which is the same to a tree; not so where rows are drawn one by one (``alike`` false)."""
    held = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    rows = df.select(label, *dict.fromkeys(features), held.alias("_held"))
    if alike:
        rows = rows.groupBy(*rows.columns).agg(F.count("*").cast("double").alias("_w"))
    else:
        rows = rows.withColumn("_w", F.lit(1.0))
    return stored(rows, "training-rows")


def _fit_patiently(gbt: GBTClassifier, train: DataFrame, held: DataFrame, rounds: int, patience: int, past_best: bool = False) -> GBTClassificationModel:
    """Boosts until the loss on ``held`` has not fallen for ``patience`` rounds, and keeps the trees up to its best round, with
    ``past_best`` those of the rounds of patience too.

    Trees of a longer run begin with those of a shorter one, so runs are made four times as long until one stops: no class
    trains all the rounds that are allowed where few do, and one that needs them all trains less than half of them again.
    """
    tried = min(rounds, 2 * patience)
    while True:
        model = gbt.copy({gbt.maxIter: tried}).fit(train)
        best, stops = best_round(_losses(model, held)[True], patience)
        if stops or tried >= rounds:
            return first_trees(model, min(tried, best + patience) if past_best else best)
        tried = min(rounds, 4 * tried)


def train_boosted(df: DataFrame, features: list[str], label: str = "label", rounds: int = 500, depth: int = 6, eta: float = 0.1, subsample: float = 1.0, colsample: float = 1.0,
                  validation: str | None = None, patience: int = 20, past_best: bool = False, parallelism: int = 3, seed: int = 42) -> Boosted:
    """Gradient-boosted trees, one against the rest; ``parallelism`` classes are trained at a time.

    validation: boolean column of the rows that stop the boosting of each class: it ends when their loss has not fallen for
    ``patience`` rounds, and the model keeps the trees up to the best round, with ``past_best`` all up to the end (as a
    learning curve shows them). Without it all rounds are kept.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():  # each round builds on the one before; Spark ML cuts that off every tenth round where it may write
        context.setCheckpointDir(scratch(df.sparkSession, "boosting"))
    x = _training_rows(df, features, label, validation, subsample >= 1)
    classes = [r[0] for r in x.select(label).distinct().orderBy(label).collect()]
    if len(classes) < 2:
        raise ValueError("training needs two classes at least")
    x = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(x).select(label, "_x", "_held", "_w").persist()
    strategy = "all" if colsample >= 1 else str(colsample)

    def fit(c) -> GBTClassificationModel:
        gbt = GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=rounds, maxDepth=depth, stepSize=eta, subsamplingRate=subsample, featureSubsetStrategy=strategy, seed=seed)
        rows = x.withColumn("_y", (F.col(label) == c).cast("double"))
        if validation:
            return _fit_patiently(gbt, rows.where("not _held"), rows.where("_held"), rounds, patience, past_best)
        return gbt.fit(rows)

    with ThreadPool(min(parallelism, len(classes))) as pool:
        models = pool.map(inheritable_thread_target(df.sparkSession)(fit), classes)
    x.unpersist()
    return Boosted(models, classes, features)


def train_leafwise(df: DataFrame, features: list[str], label: str = "label", rounds: int = 500, **options) -> Boosted:
    """The other trainer's settings: small steps, sub-sampled rows and columns; depth 6 stands for 63 leaves."""
    options = {"patience": 30} | options
    return train_boosted(df, features, label, rounds=rounds, depth=6, eta=0.05, subsample=0.8, colsample=0.8, **options)


GRID = {"maxDepth": [3, 6, 10, 20], "stepSize": [0.1, 0.3, 0.5, 0.7, 1.0], "maxIter": [50, 100, 200]}


def grid_search(df: DataFrame, features: list[str], target: str, grid: dict = GRID, folds: int = 3, parallelism: int = 2, seed: int = 42) -> DataFrame:
    """Accuracy of each setting over the folds, for a 0/1 target."""
    x = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(df).withColumn("_y", F.col(target).cast("double"))
    gbt = GBTClassifier(featuresCol="_x", labelCol="_y", seed=seed)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(gbt.getParam(name), values)
    maps = builder.build()
    score = MulticlassClassificationEvaluator(labelCol="_y", metricName="accuracy")
    cv = CrossValidator(estimator=gbt, estimatorParamMaps=maps, evaluator=score, numFolds=folds, parallelism=parallelism, seed=seed).fit(x)
    rows = [({p.name: float(v) for p, v in m.items()}, float(a)) for m, a in zip(maps, cv.avgMetrics, strict=True)]
    return df.sparkSession.createDataFrame(rows, "setting map<string,double>, accuracy double").orderBy(F.desc("accuracy"))


def learning_curve(model: Boosted, df: DataFrame, label: str = "label", validation: str | None = None) -> DataFrame:
    """(rows, class, round, loss) of every round; rows is 'train' or, where the boolean column ``validation`` holds, 'validation'."""
    x = VectorAssembler(inputCols=model.features, outputCol="_x", handleInvalid="keep").transform(_training_rows(df, model.features, label, validation)).persist()
    rows = []
    for c, m in zip(model.classes, model.models, strict=True):
        losses = _losses(m, x.withColumn("_y", (F.col(label) == c).cast("double")))
        for held in sorted(losses):
            rows += [("validation" if held else "train", str(c), k + 1, v) for k, v in enumerate(losses[held])]
    x.unpersist()
    return df.sparkSession.createDataFrame(rows, "rows string, class string, round int, loss double")


def _nodes(node, visit) -> None:
    visit(node)
    if node.numDescendants() > 0:
        _nodes(node.leftChild(), visit)
        _nodes(node.rightChild(), visit)


def gain_importance(model: Boosted, spark: SparkSession) -> DataFrame:
    """(feature, gain, splits): mean gain share over the class models and the number of nodes that split on the feature."""
    gains = np.mean([m.featureImportances.toArray() for m in model.models], axis=0)
    splits = np.zeros(len(model.features), int)

    def count(node) -> None:
        if node.numDescendants() > 0:
            splits[node.split().featureIndex()] += 1

    for m in model.models:
        for t in m.trees:
            _nodes(t._call_java("rootNode"), count)
    return spark.createDataFrame([(f, float(g), int(s)) for f, g, s in zip(model.features, gains, splits, strict=True)], "feature string, gain double, splits int")


def compare_feature_sets(df: DataFrame, sets: dict[str, list[str]], key: str, label: str = "label", seed: int = 42, trainer=train_boosted, **options) -> DataFrame:
    """Trains on each set of features (balanced rows, scaled on train) and reports F1 of the held-out rows: macro and per class."""
    split = stored(stratified_split(df, key, label, seed=seed), "split")
    out = None
    for name, features in sets.items():
        train = split.where("split = 'train'")
        model = trainer(undersample(scale(train, features, train), key, label, seed), features, label, **options)
        cm = confusion(model.transform(scale(split.where("split = 'test'"), features, train)), label, "said")
        one = f1(cm, "macro", "class").select(F.lit(name).alias("features"), "name", "f1")
        out = one if out is None else out.union(one)
    return out


def _macro_f1(said: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys..., f1): macro F1 over the classes that stand as label or prediction in a group of rows."""
    cells = said.groupBy(*keys, F.col(label).alias("_truth"), F.col("said").alias("_said")).agg(F.count("*").alias("_c"))
    hit = F.when(F.col("_truth").eqNullSafe(F.col("_said")), F.col("_c")).otherwise(0)
    sides = F.explode(F.array(F.struct(F.col("_truth").alias("cls"), F.col("_c").alias("support"), F.lit(0).cast("long").alias("told"), hit.alias("hit")),
                              F.struct(F.col("_said").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("_c").alias("told"), F.lit(0).cast("long").alias("hit"))))
    each = cells.select(*keys, sides.alias("_s")).groupBy(*keys, "_s.cls").agg(F.sum("_s.support").alias("s"), F.sum("_s.told").alias("t"), F.sum("_s.hit").alias("h"))
    return each.groupBy(*keys).agg(F.avg(2 * F.col("h") / (F.col("s") + F.col("t"))).alias("f1"))


def permutation_importance(model: Boosted, df: DataFrame, key: str, label: str = "label", repeats: int = 10, n: int | None = 3000, seed: int = 42) -> DataFrame:
    """(feature, importance_mean, importance_std): drop of macro F1 when a feature takes the value of another row.

    The other row is the next one in a fixed random order, another order in each repeat. Every row of the sub-sample is copied
    for each feature and repeat, all copies are scored at once, and F1 is grouped by feature and repeat: one plan, no loop of jobs.
    """
    rows = (explain_sample(df, key, n, label, seed) if n else df).select(key, label, *model.features)
    total = rows.agg(F.count("*").alias("_all"))
    pairs = None
    for r in range(repeats):
        mine = hash_rank(rows.withColumn("_one", F.lit(1)), key, ["_one"], seed + r, "_i").crossJoin(F.broadcast(total))
        other = mine.select(((F.col("_i") + 1) % F.col("_all")).alias("_i"), F.struct(*model.features).alias("_o"))
        one = mine.join(other, "_i").withColumn("repeat", F.lit(r))
        pairs = one if pairs is None else pairs.unionByName(one)
    swapped = lambda f: [F.col(f"_o.{g}" if g == f else g).alias(g) for g in model.features]
    copies = [F.struct(F.lit(f).alias("feature"), *swapped(f)) for f in model.features]
    plain = F.struct(F.lit("").alias("feature"), *swapped(None))
    wide = pairs.select(label, "repeat", F.explode(F.array(plain, *copies)).alias("c")).select(label, "repeat", "c.*")
    scores = _macro_f1(model.transform(wide), ["feature", "repeat"], label)
    base = scores.where("feature = ''").agg(F.max("f1").alias("base"))
    drops = scores.where("feature <> ''").crossJoin(F.broadcast(base)).withColumn("drop", F.col("base") - F.col("f1"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std")).orderBy(F.desc("importance_mean"))


# ---------------------------------------------------------------- storing, mixtures, projections


def save_model(model: Boosted, path: str, version: str, fingerprint: str, spark: SparkSession) -> None:
    """A folder per version and a manifest row; the last row is the latest."""
    for k, m in enumerate(model.models):
        m.write().overwrite().save(f"{path}/versions/{version}/class{k}")
    row = (version, fingerprint, [str(c) for c in model.classes], model.features)
    spark.createDataFrame([row], "version string, fingerprint string, classes array<string>, features array<string>").withColumn("saved", F.current_timestamp()).write.mode("append").parquet(f"{path}/manifest")


def load_model(path: str, spark: SparkSession, fingerprint: str | None = None) -> tuple[Boosted, str] | None:
    """The latest version, or None where there is none or its fingerprint differs (then: train again)."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    last = spark.read.parquet(f"{path}/manifest").orderBy(F.desc("saved")).first()
    if fingerprint is not None and last.fingerprint != fingerprint:
        return None
    models = [GBTClassificationModel.load(f"{path}/versions/{last.version}/class{k}") for k in range(len(last.classes))]
    return Boosted(models, list(last.classes), list(last.features)), last.version


def load_or_train(path: str, version: str, fingerprint: str, train: Callable[[], Boosted], spark: SparkSession, force: bool = False) -> tuple[Boosted, str, bool]:
    """(model, its version, whether it was reused): the latest stored model where its fingerprint is the data's and training is
    not forced; else ``train()`` gives a new one, which is stored as ``version``."""
    found = None if force else load_model(path, spark, fingerprint)
    if found:
        return *found, True
    model = train()
    save_model(model, path, version, fingerprint, spark)
    return model, version, False


def predict_mixture(model: Boosted, df: DataFrame, by: str, train: DataFrame | None = None, threshold: float = 0.8, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Ratios per file over all rows and over confident ones; features are scaled as on ``train``. version: recorded beside the ratios."""
    scored = model.transform(scale(df, model.features, train) if train is not None else df).select(by, "prob")
    names = tuple(str(c) for c in model.classes)
    mark = lambda r: r.withColumn("model_version", F.lit(version)) if version else r
    return mark(mixture_ratio(scored, by, names, threshold)), mark(mixture_ratio(scored, by, names, threshold, True))


def pca_2d(df: DataFrame, features: list[str], key: str, n: int | None = 20_000, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """Two principal components of the standardised features of at most ``n`` rows (random by hash), and the explained shares."""
    rows = df.orderBy(_hash(seed, key), key).limit(n) if n else df
    x = VectorAssembler(inputCols=features, outputCol="_x").transform(zscore(rows, features))
    fitted = PCA(k=2, inputCol="_x", outputCol="_p").fit(x)
    p = vector_to_array("_p")
    return fitted.transform(x).withColumns({"pc1": p[0], "pc2": p[1]}).drop("_x", "_p"), [float(v) for v in fitted.explainedVariance]


def projection_overlay(points: DataFrame, predictions: DataFrame, attributions: DataFrame, key: str = "id", n_top: int = 20) -> DataFrame:
    """Coordinates with the class, whether it was hit, and the sum of |phi| of the ``n_top`` largest features for the predicted class."""
    from .attribution import mean_abs_by_class

    top = mean_abs_by_class(attributions).groupBy("feature").agg(F.avg("mean_abs").alias("m")).orderBy(F.desc("m"), "feature").limit(n_top).select("feature")
    strength = attributions.join(F.broadcast(top), "feature").where(F.col("class") == F.col("pred")).groupBy(key).agg(F.sum(F.abs("phi")).alias("intensity"))
    return points.select(key, "pc1", "pc2").join(predictions.select(key, "label", "pred"), key).join(strength, key, "left").withColumn("correct", F.col("label") == F.col("pred"))
