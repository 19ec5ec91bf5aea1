import hashlib
import math
import random
import re
from collections import defaultdict

import regex
from pyspark.sql import functions as F

from pulsegrid.llm import pii as P

from .test_packing import SF

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in enumerate((EMAIL, IP, CARD, PHONE)):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (
                kind == 0
                or kind == 1 and all(int(p) <= 255 for p in m[0].split("."))
                or kind == 2 and 13 <= len(digits) <= 19 and luhn(digits)
                or kind == 3 and 9 <= len(digits) <= 15
            )
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out)


def words(text):
    found = [(m[0].lower(), m.start(), m.end()) for m in regex.finditer(r"[\p{L}\p{N}]{2,}", text)]
    return [(w, a, b) for w, a, b in found if b - a <= 64]


def slow_terms(rows, levels=P.LEVELS, smooth=P.SMOOTH, common=P.COMMON):
    """-> {(id, text): {(start, end): level}} of all terms that no base span holds; texts are the events, copies are one."""
    docs = sorted(set(rows), key=str)
    texts = {d[1] or "" for d in docs}
    n, n_t, n_c, best = len({d[1] for d in docs}), defaultdict(set), defaultdict(set), {}
    for t in texts:
        for w, _, _ in words(t):
            n_t[w].add(t)
        for kind, a, b in base_spans(t):
            n_c[kind, t[a:b].lower() if kind < 2 else re.sub("[^0-9]", "", t[a:b])].add(t)
    for (kind, name), owners in n_c.items():
        c = len(owners)
        parts = {w for w, _, _ in words(name.split("@")[0])} if kind == 0 else set()
        for w in {w for t in owners for w, _, _ in words(t)}:
            n_ct, own = len(n_t[w] & owners), int(w in parts)
            p = (n_ct + own + smooth * c / n) / (len(n_t[w]) + own + smooth)
            if n_ct + own > 1 and c <= common * n and p >= 2 ** -max(levels):
                best[w] = max(best.get(w, 0), p)
    level = {w: sum(-math.log2(p) <= bits for bits in levels) for w, p in best.items()}
    out = defaultdict(dict)
    for d in docs:
        base = base_spans(d[1] or "")
        for w, a, b in words(d[1] or ""):
            if level.get(w) and not any(x <= a and b <= y for _, x, y in base):
                out[d][a, b] = level[w]
    return out


def slow_sanitised(rows):
    terms, out = slow_terms(rows), []
    for i, text in rows:
        if text is None:
            out.append((i, None))
            continue
        spans = [(a, -b, k, f"[{P.KINDS[k].upper()}]") for k, a, b in base_spans(text)]
        spans += [(a, -b, 4, {1: text[a] + "***", 2: "[TERM]", 3: ""}[v]) for (a, b), v in terms.get((i, text), {}).items()]
        new, at = "", 0
        for a, b, _, tag in sorted(spans):
            if a >= at:
                new += text[at:a] + tag
            at = max(at, -b)
        out.append((i, new + text[at:]))
    return out


def expected(rows):
    terms = slow_terms(rows)
    out = []
    for i, text in rows:
        base = base_spans(text)
        show = [f"{P.KINDS[k]}:{a}:{b}" for k, a, b in base]
        extra = [f"term:{a}:{b}" for a, b in sorted(terms.get((i, text), {}))]
        counts = [sum(k == j for k, _, _ in base) for j in range(4)]
        out.append((i, *counts, hashlib.sha256(",".join(show).encode()).hexdigest(), ",".join(show + extra), len(extra)))
    return out


def test_query_against_brute_force(spark):
    sf = SF.replace("0.001", "0.01")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted(expected(rows))
    assert sorted(map(tuple, P.op4_query(spark, sf).collect())) == want
    assert sum(r[-1] for r in want) > 0  # entities of this corpus stand in one text each, nearly all


def noise(rng):
    parts = ["a@b.co", "x.y+z@d-e.f.g", "1.2.3.4", "300.1.2.3.4", "4111 1111 1111 1111", "+1 (555) 010-9999", "5500-0000-0000-0004", "é", "😀", " ", "\n", ".", "+", "@", "7", "12", "secretname", "Ordinary", "_x@q.w_y@e.r", "1.2.3.4.5.6.7.8", "+1+2 3456789"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))


def odd_rows():
    rng = random.Random(8)
    rows = [(k, noise(rng)) for k in range(300)]
    rows += [(1000 + k, f"Filler words here number {k} Bertholdine wrote from jan@host.example about thing{k}") for k in range(5)]
    rows += [(2000 + k, f"Filler words here number {k} wrote from no one") for k in range(40)]
    rows += [(3000, None), (3001, ""), (3001, ""), (3002, "1" * 9000), (3003, "a" * 9000), (3004, "a@b" + ".c" * 5000), (3005, "+1" + " 2" * 5000)]
    rows += [(4000, "😀 é " * 700 + " jan@host.example " + "é" * 64 + " " + "é" * 65 + " word😀 " * 400 + "Bertholdine")]
    return rows


def test_odd_texts_and_terms(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("doc", "hash", "spans", "cuts", "row", "t", "_rdoc", "levels", "a b.c")})
    got = sorted(map(tuple, P.find_pii(docs).collect()), key=str)
    want = sorted(expected(rows), key=str)
    for g, w in zip(got, want, strict=True):
        assert g == w
    assert any(r[-1] for r in got)
    out = P.sanitise(docs)
    assert out.columns == docs.columns
    clean = out.collect()
    assert sorted(((r.doc_id, r.text) for r in clean), key=str) == sorted(slow_sanitised(rows), key=str)
    assert all(r.cuts == "cuts" and r.hash == "hash" and r["a b.c"] == "a b.c" for r in clean)
    text = {r.doc_id: r.text for r in clean}
    assert text[1000].count("[EMAIL]") == 1 and "Bertholdine" not in text[1000] and "Filler words here number 0" in text[1000]
    assert text[2000] == "Filler words here number 0 wrote from no one" and text[3000] is None and text[3001] == ""


def test_repeated_rows_change_nothing(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = {tuple(r) for r in P.find_pii(docs).collect()}
    thrice = P.find_pii(docs.union(docs).union(docs)).collect()
    assert {tuple(r) for r in thrice} == once and len(thrice) == 3 * len(rows)


def test_empty_and_null_id(spark):
    docs = spark.createDataFrame([(None, "call +44 20 7946 0958 now"), (None, "x")], "doc_id long, text string")
    assert sorted(r.n_phone for r in P.find_pii(docs).collect()) == [0, 1]
    assert P.find_pii(docs.where(F.lit(False))).count() == 0 and P.sanitise(docs.where(F.lit(False))).count() == 0


def test_levels_follow_the_evidence(spark):
    """A name met once stays, unless it is in the address itself; one of two texts keeps its first letter, one of four becomes
    a tag, one of sixteen goes; wherever they stand. Copies of a text are one text."""
    rows = [(k, f"Filler words number {k} stand in this document without any person") for k in range(400)]
    far = "filler words " * 200
    rows += [(1000, f"Alone wrote kim@other.example {far} alone"), (1001, f"Rosalind wrote ann.rosalind@else.example {far}")]
    rows += [(1002 + k, f"Copied wrote bo@copied.example {far} copied") for k in range(3)]
    rows += [(1010 + k, f"Number {k} Bothwise at jan@host.example {far} BOTHWISE, \U0001f600 Bothwises{k}") for k in range(2)]
    rows += [(1020 + k, f"Number {k} Fourfold and +44 20 7946 0958 {far} fourfold") for k in range(4)]
    rows += [(1040 + k, f"Number {k} Manyfold and +1 555 010 9999 {far} Manyfold") for k in range(16)]
    rows += [(2000, "Manyfold")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in P.sanitise(docs).collect()}
    assert clean == dict(slow_sanitised(rows))
    assert clean[1000].startswith("Alone wrote [EMAIL]") and clean[1001].startswith("R*** wrote [EMAIL]") and clean[1003].startswith("Copied wrote [EMAIL]")
    assert clean[1010].startswith("Number 0 B*** ") and clean[1010].endswith("B***, \U0001f600 Bothwises0")
    assert clean[1020].startswith("Number 0 [TERM] ") and clean[1020].endswith("[TERM]")
    assert "anyfold" not in clean[1040] and clean[2000] == ""
    assert clean[0] == rows[0][1]


def test_rare_words_are_no_evidence(spark):
    """Of words that stand in one text only none is flagged but parts of addresses; names that go with an entity are found."""
    rng = random.Random(1)
    common = [f"word{k}" for k in range(200)]
    rows, planted = [], set()
    for k in range(600):
        text = [*rng.choices(common, k=30), f"rare{k}x"]
        if k % 3 == 0:
            text.append(f"user{k}@mail.example")
        if k % 60 < 3:
            planted.add(f"person{k // 60}")
            text += [f"person{k // 60}", f"id{k // 60}@club.example"]
        rng.shuffle(text)
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = P.pii_spans(docs).where("kind = 4").join(docs, F.col("doc") == F.col("doc_id")).collect()
    marked = {r.text[r.start : r.end] for r in spans}
    assert marked == planted
