"""Quality by regularised quadratic discriminant analysis over document statistics.

Each class (label 0 and 1) is a Gaussian over transformed statistics. Its covariance is shrunk towards the pooled one and
towards a multiple of the identity; the Cholesky factor and log determinant are computed once at the fit. The score is the
posterior of label 1: the logistic of the difference of log densities (half Mahalanobis distances and log determinants)
plus that of the log priors.

The fit uses at most ``max_labelled`` labelled rows (by hash order of the id) whose ids are not held out; scoring covers
all rows and whole texts. Ids, labels, languages and sources are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty

MAX_LABELLED = 20_000
HELD_OUT_MOD = 5
THRESHOLD = 0.3
SHRINK = 0.05
RIDGE = 0.02

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SPACE = np.array([b in (9, 10, 11, 12, 13, 32) for b in range(256)])
_STOP = np.array([b in b".,;:'\"-" for b in range(256)])
_SYMBOL = ~(_LETTER | _DIGIT | _SPACE | _STOP)
N_STATS = 10


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one text; rates are logarithms of one plus a multiple, so that rare traces count."""
    n = max(1, len(text))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    m = max(1, len(words))
    letters = max(1, int(counts[_LETTER].sum()))
    lines = [x for x in text.split(b"\n") if x.strip()]
    rate = lambda x: float(np.log1p(100 * x))
    return [
        rate(counts[_SYMBOL].sum() / n),
        rate(counts[_UPPER].sum() / letters),
        rate(counts[124] / n),
        rate(counts[33] / n),
        rate(counts[_DIGIT].sum() / n),
        rate(counts[_STOP].sum() / n),
        rate(sum(map(eq, words, words[1:])) / m),
        float(np.log((len(set(words)) + 1) / (m + 1) ** 0.8)),
        float(np.log1p(len(text) / m)),
        rate(1 - (len(set(lines)) + 1) / (len(lines) + 1)),
    ]


def fit_qda(x: np.ndarray, y: np.ndarray, shrink: float = SHRINK, ridge: float = RIDGE) -> dict:
    """Means, inverse Cholesky factors, log determinants and log priors of both classes, over standardised columns."""
    if len(x) < 2 or len(set(y.tolist())) < 2:
        prior = (y.sum() + 1) / (len(y) + 2)
        return {"prior": float(prior)}
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - centre) / scale
    groups = [z[y == k] for k in (0, 1)]
    covariance = [np.cov(g, rowvar=False, bias=True) if len(g) > 1 else np.zeros((x.shape[1],) * 2) for g in groups]
    pooled = sum(len(g) * c for g, c in zip(groups, covariance, strict=True)) / len(z)
    classes = []
    for g, c in zip(groups, covariance, strict=True):
        shrunk = (1 - shrink) * c + shrink * pooled
        shrunk = (1 - ridge) * shrunk + ridge * np.eye(len(c))
        factor = np.linalg.cholesky(shrunk)
        classes.append((g.mean(axis=0), np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(len(g) / len(z))))
    return {"centre": centre, "scale": scale, "classes": classes}


def score_qda(x: np.ndarray, model: dict) -> np.ndarray:
    if "prior" in model:
        return np.full(len(x), model["prior"])
    z = (x - model["centre"]) / model["scale"]
    density = [lp - 0.5 * (ld + (((z - mean) @ inverse.T) ** 2).sum(axis=1)) for mean, inverse, ld, lp in model["classes"]]
    return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -50, 50)))


def _stat_rows(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t or b"") for t in texts.cast(pa.large_binary()).to_pylist()]).reshape(len(texts), N_STATS)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_MOD == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> dict:
    """Labels without id or mark, ids with both marks, and held-out ids do not count; of an id's several texts the one of
    least hash does, so at most ``max_labelled`` texts are read."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id"))
    agreed = usable.agg(F.min("quality").alias("y"), F.max("quality").alias("_most")).where(F.col("y") == F.col("_most"))
    chosen = agreed.select("_id", F.col("y").cast("int").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("_doc"), text_or_empty(text_col).alias("text")).join(
        F.broadcast(chosen), F.col("_doc") == F.col("_id")
    ).select("_id", "y", "text")
    texts = texts.groupBy("_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = pa.array(list(_stat_rows(part.column(2))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), rows], ["_id", "y", "x"])

    rows = sorted(texts.mapInArrow(batches, "_id long, y int, x array<double>").collect(), key=lambda r: (r._id, r.x))
    return fit_qda(np.array([r.x for r in rows]).reshape(len(rows), N_STATS), np.array([r.y for r in rows], int))


def score_quality(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per input row.

    Defined cases: null and empty texts are scored by the statistics of the empty text; repeated rows and ids are scored
    each; a null id stays null and counts as not held out; an empty table gives an empty table; labels of one class only
    give every text that class's share; other columns are not read.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score_qda(_stat_rows(part.column(1)), model))], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(batches, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
