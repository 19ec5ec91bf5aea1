"""Attributions of tree models (Shapley values along paths) and the tables made from them."""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import avg_rank, rank_diff

# ---------------------------------------------------------------- tree attributions


def tree_paths(tree) -> list[tuple[float, float, list[tuple[int, list[tuple[float, bool]], float]]]]:
    """Leaves of a Spark tree as (value, share of rows, per feature on the path: (feature, [(threshold, goes left)], product of row shares))."""
    out = []

    def walk(node, steps: list, share: float) -> None:
        if node.numDescendants() == 0:
            held: dict[int, list] = {}
            for f, t, left, part in steps:
                held.setdefault(f, [[], 1.0])
                held[f][0].append((t, left))
                held[f][1] *= part
            out.append((float(node.prediction()), share, [(f, tests, part) for f, (tests, part) in held.items()]))
            return
        split = node.split()
        n, nl = float(node.impurityStats().count()), float(node.leftChild().impurityStats().count())
        f, t = int(split.featureIndex()), float(split.threshold())
        walk(node.leftChild(), [*steps, (f, t, True, nl / n)], share * nl / n)
        walk(node.rightChild(), [*steps, (f, t, False, 1 - nl / n)], share * (1 - nl / n))

    walk(tree._call_java("rootNode"), [], 1.0)
    return out


def path_shapley(paths, x: np.ndarray) -> tuple[np.ndarray, float]:
    """(rows x features contributions, base value) of one tree.

    A leaf pays out value * prod(o or z): o says whether a row meets the feature's tests on the path, z is the share of
    training rows that do. The Shapley value of a feature weighs all coalitions of the others by size; their sum by size
    is the polynomial prod(z + o y) without the feature.
    """
    phi, base = np.zeros(x.shape), 0.0
    for value, share, steps in paths:
        base += value * share
        met = []
        for f, tests, z in steps:
            o = np.ones(len(x))
            for t, left in tests:
                o *= (x[:, f] <= t) if left else (x[:, f] > t)
            met.append((f, o, z))
        d = len(met)
        weights = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
        for i, (f, o, z) in enumerate(met):
            poly = np.zeros((d, len(x)))
            poly[0] = 1
            for j, (_, oj, zj) in enumerate(met):
                if j != i:
                    poly[1:] = poly[1:] * zj + poly[:-1] * oj
                    poly[0] *= zj
            phi[:, f] += value * (o - z) * (weights @ poly)
    return phi, base


def tree_attributions(model, df: DataFrame, key: str) -> tuple[DataFrame, dict[str, float]]:
    """Long (key, class, feature, phi) of a Boosted model's margins, and the base value per class: base + sum of phi = margin."""
    packed = [[(2 * w, tree_paths(t)) for t, w in zip(m.trees, m.treeWeights, strict=True)] for m in model.models]
    bases = {str(c): float(sum(w * sum(v * s for v, s, _ in p) for w, p in trees)) for c, trees in zip(model.classes, packed, strict=True)}
    features, classes = model.features, [str(c) for c in model.classes]

    def run(parts: Iterator) -> Iterator:
        import pandas as pd

        for pdf in parts:
            x = pdf[features].to_numpy(float)
            for c, trees in zip(classes, packed, strict=True):
                phi = np.zeros(x.shape)
                for w, p in trees:
                    phi += w * path_shapley(p, x)[0]
                yield pd.DataFrame({"id": np.repeat(pdf[key].to_numpy(), len(features)), "class": c, "feature": np.tile(features, len(x)), "phi": phi.ravel()})

    kind = dict(df.dtypes)[key]
    return df.select(key, *features).mapInPandas(run, f"id {kind}, class string, feature string, phi double"), bases


def mirror_binary(phi: DataFrame, classes: tuple) -> DataFrame:
    """Both classes from the attributions of the second one: those of the first are their negatives."""
    first = phi.withColumns({"class": F.lit(classes[0]), "phi": -F.col("phi")})
    return phi.withColumn("class", F.lit(classes[1])).unionByName(first)


# ---------------------------------------------------------------- tables


def mean_abs_by_class(phi: DataFrame) -> DataFrame:
    return phi.groupBy("feature", "class").agg(F.avg(F.abs("phi")).alias("mean_abs"))


def importance_comparison(gain: DataFrame, attribution: DataFrame, tests: DataFrame) -> DataFrame:
    """feature with gain, mean |phi| and H, their ranks (largest first) and rank differences; missing statistics are NULL."""
    joined = gain.join(attribution, "feature", "left").join(tests, "feature", "left")
    for col in ("gain", "mean_abs", "h"):
        joined = avg_rank(joined, col, out=f"rank_{col}")
        joined = joined.withColumn(f"rank_{col}", F.when(F.col(col).isNotNull(), F.col(f"rank_{col}")))
    return rank_diff(rank_diff(joined, "rank_gain", "rank_mean_abs", "gain_vs_attribution"), "rank_h", "rank_mean_abs", "test_vs_attribution")


def dominant_class(phi: DataFrame) -> DataFrame:
    """Class of the largest sum of |phi| (the first by name on ties)."""
    sums = phi.groupBy("class").agg(F.sum(F.abs("phi")).alias("total"))
    first = sums.agg(F.min(F.struct((-F.col("total")).alias("less"), "class")).alias("one"))
    return first.select("one.class", (-F.col("one.less")).alias("total"))


def misclassification_gap(phi: DataFrame) -> DataFrame:
    """Per feature the mean phi of the predicted class over right and over wrong rows, and the gap, widest first."""
    own = phi.where(F.col("class") == F.col("pred"))
    right = F.col("label") == F.col("pred")
    out = own.groupBy("feature").agg(F.avg(F.when(right, F.col("phi"))).alias("right"), F.avg(F.when(~right, F.col("phi"))).alias("wrong"))
    return out.withColumn("gap", F.col("wrong") - F.col("right")).orderBy(F.desc(F.abs("gap")), "feature")


def waterfall_rows(phi: DataFrame, n: int) -> DataFrame:
    """Contributions of the first ``n`` misclassified events for their predicted class, largest first."""
    ids = phi.where(F.col("label") != F.col("pred")).select("id").distinct().orderBy("id").limit(n)
    own = phi.where(F.col("class") == F.col("pred")).join(F.broadcast(ids), "id", "left_semi")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.abs("phi")), "feature"))
    return own.withColumn("place", place)


def dependence_rows(phi: DataFrame, values: DataFrame, features: list[str], cls) -> DataFrame:
    """(id, feature, value, phi) of one class for the features asked for; values: long (id, feature, value)."""
    asked = phi.where((F.col("class") == cls) & F.col("feature").isin(features)).select("id", "feature", "phi")
    return values.join(asked, ["id", "feature"])
