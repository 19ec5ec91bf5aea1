import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import packing as P

from .test_tokens import T

SF = "/root/testdata/sf0.001"


def ids_of(rows, end):
    lib = T.load_tokenizer(T.BYTE_BPE)
    return [np.array(lib.encode(t or "", add_special_tokens=False).ids + [end], "<u4") for t in rows]


def check_layout(pieces, window=2048):
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    used = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
        used += at
    return used, len(by_sequence) * window


def test_query_holds_every_id_once(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], ids_of([r.text for r in rows], 1), strict=True))
    pieces = P.op6_query(spark, SF).collect()
    used, room = check_layout(pieces)
    assert used == sum(map(len, want.values()))
    assert room - used <= 2048 + 8 * len(pieces)
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    assert by_doc.keys() == want.keys()
    for doc, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[doc])
            assert p.ids_crc32 == zlib.crc32(want[doc][at : at + p.length].tobytes())
            at += p.length
        assert at == len(want[doc])


def test_fit_is_non_negative_and_near_the_best():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 3, (12, 40)).astype(float)
    truth = np.maximum(rng.normal(size=40), 0)
    x = P.nnls(a, a @ truth)
    assert (x >= 0).all() and np.linalg.norm(a @ x - a @ truth) < 1e-6
    for size in (12, 30):
        a, h = rng.integers(0, 3, (size, 40)).astype(float), rng.normal(size=size) * 5
        y = P.nnls(a, h)
        gradient = a.T @ (h - a @ y)  # optimal: no column improves the fit, those in use are balanced
        assert (y >= 0).all() and gradient.max() < 1e-6 and np.abs(gradient[y > 0]).max(initial=0) < 1e-6


def test_unfinished_fit_is_reported():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 3, (12, 40)).astype(float)
    with pytest.warns(UserWarning, match="not converged"):
        P.nnls(a, a @ np.ones(40), rounds=2)


def test_plan_never_takes_more_than_there_is():
    histogram = {100: 7, 156: 9, 50: 3, 206: 2, 256: 1, 30: 11}
    plan = P.solve(histogram, 256)
    taken = defaultdict(int)
    for combo, times in plan:
        assert 255 <= sum(combo) <= 256 and len(combo) <= 3
        for b in combo:
            taken[b] += times
    assert all(taken[b] <= histogram[b] for b in taken)
    assert taken[256] == 1 and taken[206] == taken[50] == 2 and taken[100] == 7 == taken[156]  # all that can fill a window


def test_defined_cases(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "word " * 9000), (3, "short one"), (4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "key": F.lit("k"), "offset": F.lit(None)})
    pieces = P.pack_documents(docs).collect()
    check_layout(pieces)
    assert sum(p.length for p in pieces) == sum(map(len, ids_of([t for _, t in rows], 1)))
    assert P.pack_documents(docs.where(F.lit(False))).collect() == []


def test_many_runs_and_partitions(spark, monkeypatch):
    """Runs of four rows give the same layout rules as one run."""
    monkeypatch.setattr(P, "RUN_BITS", 2)
    rows = [(k, "word " * (1 + (k * 37) % 900)) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    pieces = P.pack_documents(docs, window=256).collect()
    used, room = check_layout(pieces, 256)
    assert used == sum(map(len, ids_of([t for _, t in rows], 1)))
    assert room - used <= 256 + 8 * len(pieces)
