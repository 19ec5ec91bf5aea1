import random

from pyspark.sql import functions as F

from pulsegrid.llm import line_dedup as D

SF = "/root/testdata/sf0.01"


def slow_lines(rows, width=3):
    """(id, text) -> [(id, lines, removed, text)]; equal rows are one document, null ids come first."""
    windows, cut = {}, {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, D_HASH.get(r[1], 0))):
        lines = [] if text is None else text.split("\n")
        for k in range(len(lines) - width + 1):
            w = tuple(lines[k : k + width])
            if not any(x.strip(" ") for x in w):
                continue
            if w in windows:
                cut.setdefault((i, text), set()).update(range(k, k + width))
            else:
                windows[w] = (i, k)
    out = []
    for i, text in rows:
        gone = cut.get((i, text), set())
        lines = [] if text is None else text.split("\n")
        left = None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out.append((i, len(lines), len(gone), left))
    return out


D_HASH = {}


def check(spark, rows, docs=None):
    docs = docs if docs is not None else spark.createDataFrame(rows, "doc_id long, text string")
    D_HASH.update({r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()})
    got = [(r.doc_id, r.n_lines, r.n_removed, r.text) for r in D.line_dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(slow_lines(rows), key=str)
    return got


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    for r in rows:
        D_HASH[r[1]] = 0
    got = [(r.doc_id, r.n_lines, r.n_removed, r.text) for r in D.op1_query(spark, SF).collect()]
    assert sorted(got) == sorted(slow_lines(rows)) and sum(r[2] for r in got) > 0


def test_random_lines(spark):
    rng = random.Random(6)
    rows = [(k, "\n".join(rng.choice(["a", "b", "", "  ", "é"]) for _ in range(rng.randint(0, 12)))) for k in range(200)]
    check(spark, rows)


def test_nulls_repeats_and_short_texts(spark):
    block = "one\ntwo\nthree"
    rows = [(1, None), (1, None), (2, ""), (3, "one\ntwo"), (4, block), (4, block), (5, block + "\nfour"), (None, block + "\nnull id"), (6, "\n\n\n"), (7, "\n\n\n"), (4, "same id\n" + block)]
    got = check(spark, rows)
    assert [r for r in got if r[0] is None] == [(None, 4, 0, block + "\nnull id")]
    assert (5, 4, 3, "four") in got and got.count((4, 3, 3, "")) == 2


def test_long_text(spark):
    long = "\n".join(f"line {k % 5000}" for k in range(30000))
    rows = [(1, long), (2, "x" * 2_000_000), (3, "\n" * 5000 + "end")]
    got = {r[0]: r for r in check(spark, rows)}
    assert got[1][2] > 20000 and got[2][3] == "x" * 2_000_000


def test_empty_table_and_clashing_names(spark):
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc")]
    names = ("_doc", "_text", "_cdoc", "_ctext", "_later", "_first", "_h", "doc", "hash", "row", "t", "pos", "a", "b", "w", "a b.c")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in names}).withColumn("n_removed", F.lit("mine"))
    out = D.line_dedup(docs)
    assert out.columns == ["doc_id", "text", *names, "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text, r.n_removed) for r in out.collect()) == [(1, "a\nb\nc", 0), (2, "", 3)]
    assert all(r[c] == c for r in out.collect() for c in names)
    assert D.line_dedup(docs.where(F.lit(False))).count() == 0
