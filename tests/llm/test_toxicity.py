import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import toxicity as X


def test_newton_finds_the_ridge_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(float)
    w = X.fit_logistic(x, y)
    a = np.hstack([x, np.ones((300, 1))])
    gradient = a.T @ (1 / (1 + np.exp(-a @ w)) - y) + np.append(w[:4], 1e-6 * w[4])
    assert np.abs(gradient).max() < 1e-4


def test_chain_trains_on_out_of_fold_predictions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    labels = (x @ rng.normal(size=(3, 2)) > 0).astype(float)
    folds = np.arange(200) % 5
    views = [x + 0.1 * f for f in range(5)]
    models, seen = X.fit_chain(views, x, labels, folds)
    assert [len(m) for m in models] == [4, 5]
    own = X.predict_logistic(views[2][folds == 2], X.fit_logistic(views[2][folds != 2], labels[folds != 2, 0]))
    assert np.allclose(seen[folds == 2, 0], own)
    assert np.allclose(models[1], X.fit_logistic(np.hstack([x, seen[:, :1]]), labels[:, 1]))


def slow_fit(rows, folds=5):
    """rows: (id, text, lang, toxic) -> terms, models, out-of-fold probabilities; plain loops over all words of all rows."""
    rows = sorted(rows)
    words = [X.words_of(t.encode()) for _, t, _, _ in rows]
    held = [Counter(t for w in ws if len(w) >= 3 for t in X.beginnings(w)) for ws in words]
    toxic = np.array([bool(r[3]) for r in rows])
    fold = np.array([r[0] % folds for r in rows])

    def odds(t, rs):
        n1, n0 = sum(toxic[r] for r in rs), sum(not toxic[r] for r in rs)
        a, b = sum(t in held[r] for r in rs if toxic[r]), sum(t in held[r] for r in rs if not toxic[r])
        return a, ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))

    sets = [[r for r in range(len(rows)) if fold[r] != f] for f in range(-1, folds)]
    every = sorted({t for r in range(len(rows)) if toxic[r] for t in held[r]})
    names = [t for t in every if any(a >= X.MIN_TEXTS and o >= X.MIN_ODDS for a, o in (odds(t, rs) for rs in sets))]

    def view(rs):
        inside = np.isin(np.arange(len(rows)), rs)
        open_, picked = [r for r in rs if toxic[r]], []
        clean = [r for r in rs if not toxic[r]]
        score = lambda t, some: X.log_ratio(np.array([sum(t in held[r] for r in some)], float), np.array([sum(t in held[r] for r in clean)], float), len(some), len(clean))[0]
        while len(open_) >= X.MIN_TEXTS:
            g = [score(t, open_) if sum(t in held[r] for r in open_) >= X.MIN_TEXTS else 0 for t in names]
            if not g or max(g) < X.MIN_G:
                break
            picked.append(names[int(np.argmax(g))])
            open_ = [r for r in open_ if picked[-1] not in held[r]]
        all_toxic = [r for r in rs if toxic[r]]
        g = [score(t, all_toxic) if sum(t in held[r] for r in all_toxic) >= max(X.MIN_TEXTS, X.COMMON_SHARE * len(all_toxic)) else 0 for t in names]
        for k in sorted(range(len(names)), key=lambda k: -g[k]):
            if g[k] >= X.MIN_G and not any(X._akin(names[k], p) for p in picked):
                picked.append(names[k])
        assert inside.sum() == len(rs)
        return picked, np.array([X.feature_row({k: h[t] for k, t in enumerate(picked) if t in h}, len(ws), len(picked)) for h, ws in zip(held, words, strict=True)])

    langs = [r[2] for r in rows]
    main = max(sorted(set(langs)), key=langs.count)
    inside = np.array([x == main for x in langs])
    labels = np.column_stack([toxic & inside, toxic & ~inside, toxic]).astype(float)
    views, seen, models = [view(rs) for rs in sets], np.zeros((len(rows), 0)), []
    for k in range(3):
        models.append(X.fit_logistic(np.hstack([views[0][1], seen]), labels[:, k]))
        out = np.zeros(len(rows))
        for f in range(folds):
            full = np.hstack([views[f + 1][1], seen])
            out[fold == f] = X.predict_logistic(full[fold == f], X.fit_logistic(full[fold != f], labels[fold != f, k]))
        seen = np.hstack([seen, out[:, None]])
    return views[0][0], models, seen


def test_fit_and_scores_against_plain_loops(spark):
    rng = random.Random(3)
    pools = {"en": ["scum", "moron", "trashy"], "fr": ["ordure", "crétin"]}
    rows = []
    for k in range(160):
        lang, toxic = ("en" if k % 3 else "fr"), k % 4 == 0
        words = [f"{lang}{rng.randrange(60)}" for _ in range(rng.randint(5, 30))]
        if toxic:
            words += rng.sample(pools[lang], rng.randint(1, 2)) * rng.randint(1, 3)
        rng.shuffle(words)
        rows.append((k, " ".join(words), lang, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = X.fit_toxicity(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    terms, models, seen = slow_fit(rows)
    assert model["terms"] == terms and len(terms) >= 4
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(model["models"], models, strict=True))
    assert model["threshold"] == pytest.approx(X.best_threshold(seen[:, -1], np.array([r[3] for r in rows], float)))
    got = {r.doc_id: (r.p_main, r.p_other, r.p_toxic) for r in X.score_toxicity(docs, model).collect()}
    for k, text, _, _ in rows:
        held = Counter(t for w in X.words_of(text.encode()) if len(w) >= 3 for t in X.beginnings(w))
        row = X.feature_row({j: held[t] for j, t in enumerate(terms) if t in held}, len(text.split()), len(terms))
        want = []
        for w in models:
            want.append(float(X.predict_logistic(np.append(row, want)[None], w)[0]))
        assert got[k] == pytest.approx(tuple(want), abs=1e-5)


def test_given_categories_and_single_flag(spark):
    rows = [(k, f"words {'vile' if k % 2 else 'kind'} {'threat' if k % 4 == 1 else 'rose'} {k}", k % 2, int(k % 4 == 1)) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, threat int")
    model = X.fit_toxicity(docs.select("doc_id", "text"), docs.drop("text"), categories=("threat",))
    out = {r.doc_id: r for r in X.score_toxicity(docs, model).collect()}
    assert out[1].p_threat > 0.5 > out[3].p_threat and out[3].rejected and not out[2].rejected
    alone = X.fit_toxicity(docs.select("doc_id", "text"), docs.drop("text"), by=None)
    assert X.score_toxicity(docs, alone).columns == ["doc_id", "p_toxic", "rejected"]


def test_rejects_the_toxic_and_keeps_the_clean(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learn = labels.where("doc_id % 3 <> 0")
    out = X.score_toxicity(docs, X.fit_toxicity(docs, learn))
    held = out.join(labels.where("doc_id % 3 = 0"), "doc_id").groupBy("toxic", "rejected").count().collect()
    counts = {(r.toxic, r.rejected): r["count"] for r in held}
    assert counts.get((0, True), 0) <= 0.01 * (counts.get((0, True), 0) + counts.get((0, False), 0))
    assert counts.get((1, True), 0) >= 0.7 * (counts.get((1, True), 0) + counts.get((1, False), 0))
    row = X.op3_query(spark, sf)
    assert row.columns == ["doc_id", "p_main", "p_other", "p_toxic", "rejected"] and row.count() == docs.count()


def test_defined_cases(spark):
    texts = [(k, f"some {'vile' if k % 2 else 'kind'} thing {k}") for k in range(40)] + [(50, None), (51, ""), (52, "vile " * 30000), (None, "vile"), (0, "some kind thing 0")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"toxic": F.lit(1), "_id": F.lit("x"), "rejected": F.lit(None)})
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (41, None), (2, 0), (2, 1)], "doc_id long, toxic int")
    model = X.fit_toxicity(docs, labels)
    out = {(r.doc_id, r.rejected) for r in X.score_toxicity(docs, model).collect()}
    assert {(1, True), (0, False), (50, False), (51, False), (52, True), (None, True)} <= out
    kept = X.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 23
    assert X.drop_toxic(docs, labels.where(F.lit(False))).count() == docs.count()
    assert X.drop_toxic(docs.where(F.lit(False)), labels).count() == 0


def test_texts_without_a_term_are_not_rejected(spark):
    """Few labelled texts without a telling term: rejecting all of them would be the cut of largest F1."""
    docs = spark.createDataFrame([(i, f"plain words number {i}", "en") for i in range(12)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(12)], "doc_id long, toxic int")
    assert X.drop_toxic(docs, labels).count() == 12
    assert X.score_toxicity(docs, X.fit_toxicity(docs, labels)).where("rejected").count() == 0
