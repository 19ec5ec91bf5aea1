import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import multi_index as M

from .test_packing import SF


def brute(rows, cosine=0.98):
    ok = {}
    for k, (_, v, label) in enumerate(rows):
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[k] = np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))
    links = {k: set() for k in range(len(rows))}
    keys = sorted(ok)
    for a in keys:
        for b in keys:
            if a < b and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine:
                links[a].add(b)
                links[b].add(a)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        name = min(ids) if ids else None
        out.append((i, len(links[k]), name, i == name))
    return sorted(out, key=str)


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in M.op2_query(spark, SF).collect()), key=str)
    assert got == brute(rows)


def test_traversal_order():
    rng = np.random.default_rng(0)
    books = (rng.normal(size=(9, 4)), rng.normal(size=(7, 4)))
    x = rng.normal(size=(50, 8))
    for many in (1, 5, 20, 63):
        cells = M.nearest_cells(x, books, many)
        assert cells.shape == (50, many)
        for row, v in zip(cells, x, strict=True):
            d1, d2 = M.distances(v[None, :4], books[0])[0], M.distances(v[None, 4:], books[1])[0]
            every = sorted((d1[i] + d2[j], i * 7 + j) for i in range(9) for j in range(7))
            assert row.tolist() == [c for _, c in every[:many]]


def test_recall_over_many_cells(spark):
    """Planted neighbours at and above the threshold among 6,000 vectors, in a grid of 6 by 6 cells and production settings."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(5000, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    aside = rng.normal(size=(1000, 64))
    aside -= (aside * base[:1000]).sum(axis=1)[:, None] * base[:1000]
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    cosine = rng.uniform(0.98, 0.9999, 1000)[:, None]
    x = np.vstack([base, cosine * base[:1000] + np.sqrt(1 - cosine**2) * aside]) * rng.uniform(1e-200, 1e200, (6000, 1))
    df = spark.createDataFrame([(i, [float(t) for t in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in M.embedding_links(df).collect()}
    unit = M._unit(x.tolist())
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert np.sqrt(6000 / M.CELL_ROWS) >= 6 and want.sum() >= 1990
    assert sum(got.values()) >= 0.995 * want.sum() and all(got[i] <= want[i] for i in got)


def test_small_cells_and_blocks(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    x = base[rng.integers(0, 30, 400)] + rng.normal(size=(400, 16)) * rng.choice([0.0, 0.05, 0.15], (400, 1))
    rows = [(int(i), [float(t) for t in v], int(i % 2)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for cell_rows, block in ((20, 1024), (20, 8), (400, 16)):
        got = M.embedding_links(df, cell_rows=cell_rows, block=block, recall=1.0)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    some = {(r.vec_id): r.n_links for r in M.embedding_links(df, cell_rows=20).collect()}
    want = {r[0]: r[1] for r in brute(rows)}
    assert sum(some.values()) >= 0.95 * sum(want.values()) and all(some[k] <= want[k] for k in want)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.01], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1)]
    rows += [(7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [1.0, 0.0], None), (11, [1.0, 0.0, 0.0], 1), (None, [0.0, 1.0], 1), (12, [], 1), (13, [3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"node": F.lit("x"), "links": F.lit(None)})
    got = sorted((tuple(r) for r in M.embedding_links(df).collect()), key=str)
    want = [(i, n, c, True if i is None else k) for i, n, c, k in brute(rows)]
    assert got == sorted(want, key=str)
    assert M.embedding_links(df.where(F.lit(False))).count() == 0
