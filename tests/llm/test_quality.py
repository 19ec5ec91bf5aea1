import zlib

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import quality as Q


def test_scores_are_the_posterior_of_two_gaussians():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(200, 3)), 2 + 0.5 * rng.normal(size=(300, 3))])
    y = np.repeat([0, 1], [200, 300])
    model = Q.fit_qda(x, y, shrink=0.0, ridge=0.0)
    dens = []
    for k in (0, 1):
        g = x[y == k]
        c = np.cov(g, rowvar=False, bias=True)
        d = x - g.mean(axis=0)
        dens.append(np.log(len(g) / 500) - 0.5 * np.log(np.linalg.det(c)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(Q.score_qda(x, model), 1 / (1 + np.exp(dens[0] - dens[1])), atol=1e-9)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = Q.op7_query(spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("doc_id", "score", "predicted", "quality").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    order = np.argsort(np.argsort(np.array(good + bad)))
    auc = (order[: len(good)].sum() - len(good) * (len(good) - 1) / 2) / (len(good) * len(bad))
    right = np.mean([r.predicted == r.quality for r in rows])
    kept = np.mean([r.predicted for r in rows if r.quality == 1])
    print("held out", len(rows), "auc", auc, "accuracy", right, "clean kept", kept)
    assert auc > 0.97 and right > 0.95 and kept > 0.98


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 30000), (None, "a b"), (1, "good text here"), (4, "$$$ ###")], "doc_id long, text string")
    docs = docs.withColumns({"score": F.lit(1), "quality": F.lit("x"), "y": F.lit(None)})
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (3, None), (2, 1), (2, 0)], "doc_id long, quality int")
    rows = Q.score_quality(docs, Q.fit_quality(docs, labels)).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert Q.score_quality(docs.where(F.lit(False)), Q.fit_quality(docs, labels.where(F.lit(False)))).count() == 0
    import inspect

    assert "lang" not in inspect.getsource(Q.statistics) and "source" not in inspect.getsource(Q.statistics)


def slow_scores(rows, marks):
    """rows: (id, text), marks: {id: quality} of distinct ids; densities from the shrunken covariances themselves."""
    fit = [(Q.statistics((t or "").encode()), marks[i]) for i, t in rows if i in marks and zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([f for f, _ in fit]), np.array([m for _, m in fit])
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale <= 1e-9] = 1
    z = (x - centre) / scale
    cov = [sum(np.outer(v - z[y == k].mean(axis=0), v - z[y == k].mean(axis=0)) for v in z[y == k]) / (y == k).sum() for k in (0, 1)]
    pooled = ((y == 0).sum() * cov[0] + (y == 1).sum() * cov[1]) / len(y)
    out = {}
    for i, t in rows:
        v = (np.array(Q.statistics((t or "").encode())) - centre) / scale
        log = []
        for k in (0, 1):
            c = (1 - Q.RIDGE) * ((1 - Q.SHRINK) * cov[k] + Q.SHRINK * pooled) + Q.RIDGE * np.eye(len(centre))
            d = v - z[y == k].mean(axis=0)
            log.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * d @ np.linalg.solve(c, d))
        out[i] = 1 / (1 + np.exp(-np.clip(log[1] - log[0], -50, 50)))
    return out


def test_query_against_plain_densities(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}
    want = slow_scores(rows, marks)
    got = Q.op7_query(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-6
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
