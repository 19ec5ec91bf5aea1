import uuid
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.llm import huffman as H

from .test_packing import SF, ids_of


@given(st.lists(st.integers(1, 10**6), min_size=2, max_size=60), st.integers(6, 12))
@settings(max_examples=60, deadline=None)
def test_lengths_are_a_full_code_within_the_limit(weights, limit):
    lengths = H.code_lengths(np.array(weights), limit)
    assert lengths.max() <= limit and lengths.min() >= 1
    assert sum(2.0 ** -int(x) for x in lengths) == 1.0
    order = np.argsort(weights, kind="stable")
    assert all(lengths[a] >= lengths[b] for a, b in zip(order, order[1:], strict=False) if weights[a] < weights[b])


def test_lengths_match_huffman_when_the_limit_is_wide():
    import heapq

    rng = np.random.default_rng(5)
    weights = rng.integers(1, 1000, 200)
    heap, cost = weights.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert int((H.code_lengths(weights, 30) * weights).sum()) == cost


@given(st.lists(st.lists(st.integers(0, 300), max_size=700), min_size=1, max_size=4))
@settings(max_examples=40, deadline=None)
def test_round_trip(lists):
    flat = np.array([x for part in lists for x in part], np.int64)
    symbols, counts = np.unique(np.concatenate([flat, [7]]), return_counts=True)
    lengths = H.code_lengths(counts)
    s, ln, codes = H.canonical(symbols, lengths)
    code_of, length_of = dict(zip(s.tolist(), codes.tolist(), strict=True)), dict(zip(s.tolist(), ln.tolist(), strict=True))
    blocks = []
    for part in lists:
        bits, at = H.encode_bits(np.array([code_of[x] for x in part], np.int64), np.array([length_of[x] for x in part], np.int64))
        text = "".join(format(code_of[x], f"0{length_of[x]}b") for x in part)
        assert bits == int(text.ljust(-(-len(text) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(text) // 8), "big")
        blocks.append((bits, at[:: H.STEP].astype("<u8"), len(part)))
    assert [x.tolist() for x in H.Decoder(symbols, lengths)(blocks)] == lists


def test_query_against_the_library(spark):
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want, start = [], 0
    for r, ids in zip(rows, ids_of([r.text for r in rows], 2), strict=True):
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in H.op9_query(spark, SF).collect()) == want


def test_defined_cases(spark, tmp_path):
    rows = [(3, None), (1, "b b b"), (1, "b b b"), (None, ""), (2, "long " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "n": F.lit("k"), "shard": F.lit(None)})
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    H.write_token_files(docs, path)
    got = sorted(H.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 3]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == [x.tolist() for x in ids_of(["", "b b b", "b b b", "long " * 30000, ""], 2)]
    H.write_token_files(docs.where(F.lit(False)), path + "e")
    assert H.read_token_files(spark, path + "e").collect() == []
