import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import word_bpe as B

from .test_packing import SF


def library_rows(pairs):
    lib = B.load_tokenizer(B.WORD_BPE)
    out = []
    for i, text in pairs:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return out


def digest(rows):
    return [(r.doc_id, len(r.ids) // 4, hashlib.sha256(bytes(r.ids)).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in rows]


def test_query_against_the_library(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, B.op10_query(spark, SF).collect())) == sorted(library_rows((r.doc_id, r.text) for r in rows))


def test_odd_texts(spark):
    rng = random.Random(6)
    latin = [chr(c) for c in range(1, 256)]
    texts = [None, "", " \n", "Don't 12'S <|endoftext|>x<|startoftext|>", "é ΣΑΣ İx ſ", "日本語 text", "a\x1cb\x85c\xa0d", "w " * 30000, "q" * 20000, "'''s!'s'll"]
    texts += ["".join(rng.choice(latin) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    texts += ["".join(rng.choice("aéÀ Σς'’́ﬁ1²\n-") for _ in range(30)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    docs = docs.withColumns({"ids": F.lit(1), "block": F.lit("k"), "bucket": F.lit(None)})
    got = sorted(digest(B.word_bpe(docs).collect()))
    for mine, want in zip(got, sorted(library_rows(enumerate(texts))), strict=True):
        assert mine == want, repr(texts[mine[0]])


def test_repeated_null_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted(digest(B.word_bpe(docs).collect()), key=str) == sorted(library_rows([(1, "a b"), (1, "a b"), (None, "c")]), key=str)
    assert B.word_bpe(docs.where(F.lit(False))).collect() == []
