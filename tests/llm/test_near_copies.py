import random

import corpus_pipeline as C
import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import near_copies as N


def slow_sets(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def slow_components(rows):
    sets, root = [slow_sets(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), name), name)
    return {(name, least[find(i)]) for i, (name, _) in enumerate(rows)}


def family(rng, n, changed, size):
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = [base]
    for _ in range(n):
        copy = list(base)
        for at in rng.sample(range(size), changed):
            copy[at] = f"x{rng.randrange(10**6)}"
        out.append(copy)
    return [" ".join(x) for x in out]


def corpus():
    rng = random.Random(5)
    texts = [t for k in range(40) for t in family(rng, 1, 2 + k % 5, 200)]
    texts += family(rng, 60, 2, 200) + family(rng, 30, 6, 200)
    texts += ["a b", "A  b", "", "a b c", texts[0].upper()]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_every_pair_of_similarity_08_links(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_components(rows)
    assert {(r.id, r.component_id) for r in N.near_copies(docs, seeds=(42, 1), block=8).collect()} == want
    kept = C.near_dedup_stage(spark, docs.select("*", *[F.lit(None).alias(c) for c in ("lang", "source", "n_chars")]), "")
    assert {r.doc_id for r in kept.collect()} == {i for i, c in want if i == c}


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "one two three four"), (5, "one two three four"), (6, "x " * 30000), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.id or 0), r.component_id or 0) for r in N.near_copies(docs).collect())
    assert out == [(0, 0), (0, 5), (1, 1), (2, 1), (2, 1), (5, 5), (6, 6)]
    assert sorted((r.doc_id or 0) for r in N.drop_near_copies(docs).collect()) == [0, 0, 1, 5, 6]
    assert N.near_copies(docs.where(F.lit(False))).count() == 0


def test_a_group_yields_a_forest_of_its_links():
    rng = np.random.default_rng(3)
    base = rng.choice(10**6, 300, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(300)[:k]], rng.choice(10**6, 30).astype(np.uint64)])) for k in rng.integers(200, 300, 40)]
    root = np.arange(40) // 2
    for side in (np.zeros(40, int), np.arange(40) % 2):
        u, v = N.tile_edges(side, root, sets)
        assert len(u) < 40
        pairs = [(i, j) for i in range(40) for j in range(i) if root[i] != root[j] and N.alike(sets[i], sets[j]) and (side[i] != side[j] or not side.any())]
        assert pairs
        a, b = map(np.array, zip(*pairs, strict=True))
        assert np.array_equal(N.forest(40, u, v), N.forest(40, a, b))
