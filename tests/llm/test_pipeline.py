import corpus_pipeline as C
from pulsegrid.llm import toxicity

from .test_near_copies import slow_components
from .test_packing import SF, check_layout, ids_of
from .test_pii import slow_sanitised


def slow_lines(rows):
    windows, cut = {}, set()
    for i, text in sorted(rows):
        lines = text.split("\n")
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if not any(x.strip(" ") for x in w):
                continue
            if w in windows:
                cut |= {(i, k), (i, k + 1), (i, k + 2)}
            else:
                windows[w] = (i, k)
    return [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in cut)) for i, t in rows]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        before = sorted((r.doc_id, r.text) for r in docs.collect())
        out = stage(spark, docs, SF)
        assert out.columns == list(C.COLUMNS)
        docs = C.stored(out, name)
        after = sorted((r.doc_id, r.text) for r in docs.collect())
        assert all(r.n_chars == len(r.text) for r in docs.where("text is not null").collect()) or name in ("toxicity", "simhash_near_dedup")
        if name == "toxicity":
            model = toxicity.fit_toxicity(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
            p = toxicity.run_chain(toxicity.features([t.encode() for _, t in before], model["terms"]), model["models"])[:, -1]
            want = [r for r, x in zip(before, p, strict=True) if x < model["threshold"]]
            assert len(want) < len(before)
        elif name == "line_dedup":
            want = slow_lines(before)
        elif name == "simhash_near_dedup":
            named = slow_components(before)
            want = [(i, t) for i, t in before if (i, i) in named]
        else:
            want = slow_sanitised(before)
        assert after == want, name
    pieces = C.packing_stage(spark, docs, SF).collect()
    used, _ = check_layout(pieces)
    assert used == sum(map(len, ids_of([t for _, t in after], 1)))
    final = C.run(spark, SF)
    assert final.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sum(r.length for r in final.collect()) == used


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Null, empty, very long and repeated texts, null ids, clashing columns; then empty tables."""
    whole = spark.read.parquet(f"{SF}/documents.parquet").limit(40).select("doc_id", "text", "lang", "source", "n_chars")
    long = "A line of its own, number one\n" + "word " * 60_000
    odd = [(9001, None, "en", "s", None), (9002, "", None, None, 0), (9003, long, "en", "s", len(long)), (9003, long, "en", "s", len(long)), (9004, "mail me at jo@odd.example", "en", "s", 24), (None, "no id but a text", "en", "s", 16)]
    rows = spark.createDataFrame(odd, whole.schema)
    docs = whole.union(rows).selectExpr("*", "1 AS hash", "'x' AS t", "doc_id AS node", "'y' AS `a.b`")
    sf = str(tmp_path / "sf")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet").select(*C.COLUMNS)
    for name, stage in C.STAGES[:-1]:
        now = C.stored(stage(spark, now, sf), f"odd-{name}")
        assert now.columns == list(C.COLUMNS)
    text = {r.doc_id: r.text for r in now.collect()}
    kept = [r.doc_id for r in now.collect()]
    assert text[9004] == "mail me at [EMAIL]" and kept.count(9003) == 1 and text[None] == "no id but a text"
    assert sum(i in (9001, 9002) for i in kept) == 1  # null and empty are alike
    pieces = C.packing_stage(spark, now, sf).collect()
    assert sum(r.length for r in pieces) == sum(map(len, ids_of([r.text for r in now.collect()], 1)))
    final = C.run(spark, sf)
    assert sum(r.length for r in final.collect()) == sum(r.length for r in pieces)
    none = str(tmp_path / "none")
    docs.where("false").write.parquet(f"{none}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").where("false").write.parquet(f"{none}/labels.parquet")
    assert C.run(spark, none).count() == 0
