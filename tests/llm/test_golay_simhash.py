import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pulsegrid.llm import golay_simhash as G
from pulsegrid.llm import near_copies


def slow_fingerprint(text, seed=42):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps, limit=3):
    """fps: one fingerprint a row, or a tuple of them."""
    fps = [f if isinstance(f, tuple) else (f,) for f in fps]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if any((a ^ b).bit_count() <= limit for a, b in zip(fps[i], fps[j], strict=True)):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {(ids[i], least[find(i)]) for i in range(len(ids))}


def test_each_vector_has_a_codeword_within_three_flips():
    assert (G._FIX >= 0).all()
    assert len(set(G._FIX.tolist())) == 2048


def test_two_flips_share_a_key():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 22, 300)
    keys = [set(k) for k in G.golay_keys(v, 22).tolist()]
    for a in range(22):
        for b in range(a + 1):
            other = G.golay_keys(v ^ (1 << a) ^ ((1 << b) if b != a else 0), 22)
            assert all(k & set(o) for k, o in zip(keys, other.tolist(), strict=True))


def test_pairs_within_three_bits_share_a_candidate_key():
    rng = random.Random(2)
    for _ in range(400):
        v = rng.getrandbits(64)
        w = v
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            w ^= 1 << bit
        who, keys = G.candidate_keys(np.array([v, w], np.uint64))
        assert set(keys[who == 0].tolist()) & set(keys[who == 1].tolist())


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = {r.doc_id: slow_fingerprint(r.text) for r in rows}
    out = G.op5_query(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in out} == fps
    assert {(r.doc_id, r.component_id) for r in out} == slow_components(list(fps), list(fps.values()))


def test_blocks_and_dense_groups(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 120:
        v = base
        for bit in rng.sample(range(64), rng.randint(1, 6)):
            v ^= 1 << bit
        fps.add(v)
    fps |= {rng.getrandbits(64) for _ in range(60)}
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    edges = {(r.u, r.v) for r in G.fingerprint_links(df, block=8).collect()}
    from pulsegrid.llm.components import connected_components

    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(list(edges), "u long, v long")).collect()}
    got = {}
    for s in signed:
        got.setdefault(roots.get(s, s), set()).add(s)
    want = {}
    for i, r in slow_components(signed, fps):
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_several_seeds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    seeds = (42, 1, 2)
    want = slow_components([r.doc_id for r in rows], [tuple(slow_fingerprint(r.text, s) for s in seeds) for r in rows])
    assert {(r.id, r.component_id) for r in G.near_duplicates(docs, seeds=seeds).collect()} == want


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "one two three four"), (5, "one two three four"), (6, "x " * 30000)]
    docs = spark.createDataFrame([(i, t, "c", 0) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    out = {(r.id, r.component_id) for r in G.near_duplicates(docs).collect()}
    assert out == {(1, 1), (2, 1), (None, 5), (5, 5), (6, 6)}
    kept = G.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 5, 6]
    assert G.near_duplicates(docs.where(F.lit(False))).count() == 0


CLASHES = ("id", "hash", "_id", "_hash", "_kept", "row", "t", "doc", "fp", "own", "node", "least", "a b.c")


def test_only_copies_go(spark):
    """One id over two texts, an equal row of the same id, a copy under a larger id, and every internal name as a column."""
    rows = [(5, "an apple fell from the old tree"), (5, "quite another matter of state"), (5, "quite another matter of state"), (9, "an apple fell from the old tree"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in CLASHES})
    for kept in (G.drop_near_duplicates(docs), near_copies.drop_near_copies(docs)):
        assert kept.columns == docs.columns
        out = kept.collect()
        assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, "alone"), (5, "an apple fell from the old tree"), (5, "quite another matter of state")]
        assert all(r[c] == c for r in out for c in CLASHES)
