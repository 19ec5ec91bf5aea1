"""Personal data: patterns, then information-theoretic sanitisation of what gives the same entities away.

Only DataFrame functions are used. Emails, addresses, card and phone numbers are found by pattern; each valid match is a
mention of a protected entity. Other terms of the corpus may reveal an entity as well as its number does. Distinct texts
are the events: an entity c that stands in n_c of n texts has log2(n / n_c) bits of information, and a term t reveals
PMI(c, t) of them. What stays hidden, log2(n / n_c) - PMI(c, t) = -log2 P(c | t), is compared with thresholds in bits. The
probability is smoothed towards P(c) as if the term stood in ``SMOOTH`` more texts: P(c | t) = (n_ct + s P(c)) / (n_t + s).
One text that holds both is therefore no evidence, whatever else is in it, and copies of a text are one text; more texts
give stronger levels. A term that is a part of the entity's own address (``bothwise`` of ``jan.bothwise@host``) has one more
observation for it, so such a term can pass where it stands once.

With at most 1 bit hidden a term is generalised to its first letter, with at most 0.6 to ``[TERM]``, with at most 0.35 it is
removed. An entity in more than a share of ``COMMON`` of the texts tells nobody apart and is left out. A term over a threshold is marked wherever it stands, in any document. A term is a run of 2 to 64 letters and
digits, lower-cased; longer runs are no terms.

Pairs are formed among the texts that hold an entity of several texts, and a term keeps its best entity only. What cannot
pass there goes before the corpus is searched, so the corpus is cut into words once and gives postings of candidates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, same, small_side, stored, table, text_or_empty

KINDS = ("email", "ip", "card", "phone", "term")
#: Bits of an entity that a term may leave hidden: kept by its first letter, replaced by a tag, removed.
LEVELS = (1.0, 0.6, 0.35)
SMOOTH = 2.0
COMMON = 0.25
LONGEST = 64
#: Code points that are searched for terms together.
PIECE = 1024

# The contract's patterns with possessive quantifiers, which find the same matches: what follows a run never starts with
# a character of the run. A match may start where the last one ended, or where no character of the run comes before.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TERM = r"[\p{L}\p{N}]{2,}+"


def _luhn(digits: Column) -> Column:
    """For strings of 13 to 19 digits."""
    turned = F.reverse(digits)
    values = F.transform(
        F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(turned, i, F.lit(1)).cast("int") * (F.lit(2) - F.pmod(i, F.lit(2)))
    )
    total = F.aggregate(values, F.lit(0), lambda s, v: s + v - F.when(v > 9, 9).otherwise(0))
    return total % 10 == 0


def _matches(text: Column, kind: int, pattern: str, hint: str | None) -> Column:
    """Array of (kind, place, gap before, match) of all matches of one kind."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if hint:
        found = F.when(F.contains(text, F.lit(hint)), found).otherwise(F.array().cast("array<string>"))
    parts = F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))
    # both are bound to names by a struct, so that each pattern runs twice a text, not once a match
    return F.transform(
        F.array(F.struct(found.alias("m"), parts.alias("p"))),
        lambda s: F.transform(s["m"], lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), F.length(F.get(s["p"], i)).alias("gap"), m.alias("match"))),
    )[0]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("hash"), text_or_empty(text_col).alias("t"))


def private_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, hash, t, found) of the documents with any match, written once."""
    t = F.col("t")
    found = F.concat(_matches(t, 0, _EMAIL, "@"), _matches(t, 1, _IP, "."), _matches(t, 2, _CARD, None), _matches(t, 3, _PHONE, "+"))
    # a generated column is not computed again by the filter
    rows = _source(docs, id_col, text_col).select("doc", "hash", "t", F.explode(F.array(found)).alias("found"))
    return stored(rows.where(F.size("found") > 0), "private")


def mentions(private: DataFrame) -> DataFrame:
    """(doc, hash, kind, start, end, entity): valid matches, one row each; equal (id, text) rows count once."""
    rows = private.select("doc", "hash", F.explode("found").alias("m")).select("doc", "hash", "m.*").distinct()
    upto = F.sum(F.col("gap") + F.length("match")).over(Window.partitionBy("doc", "hash", "kind").orderBy("place"))
    digits = F.regexp_replace("match", "[^0-9]", "")
    card = F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    valid = (
        F.when(F.col("kind") == 0, True)
        .when(F.col("kind") == 1, F.col("match").rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
        .when(F.col("kind") == 2, card)
        .otherwise(F.length(digits).between(9, 15))
    )
    entity = F.concat_ws(":", "kind", F.when(F.col("kind") < 2, F.lower("match")).otherwise(digits))
    placed = rows.withColumn("end", upto).withColumn("start", F.col("end") - F.length("match")).where(valid)
    return placed.select("doc", "hash", "kind", "start", "end", entity.alias("entity"))


# ---------------------------------------------------------------- disclosing terms


def _terms(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(_TERM), F.lit(0))
    return F.array_distinct(F.transform(F.filter(runs, lambda w: F.length(w) <= LONGEST), lambda w: F.lower(w)))


def _on_document(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joins on document and text hash, null ids being equal; the keys of ``left`` stay."""
    r = right.withColumnsRenamed({"doc": "_rdoc", "hash": "_rhash"})
    return left.join(r, same(F.col("doc"), F.col("_rdoc")) & (F.col("hash") == F.col("_rhash")), how).drop("_rdoc", "_rhash")


def owners(found: DataFrame) -> DataFrame:
    """(entity, hash, n_c): in which texts an entity stands, and in how many."""
    counts = found.groupBy("entity").agg(F.count_distinct("hash").alias("n_c"))
    return stored(found.select("entity", "hash").distinct().join(counts, "entity"), "owners")


def name_parts(owned: DataFrame) -> DataFrame:
    """(term, n_c): the terms in the local part of each email address, which all texts of the address hold."""
    local = owned.where(F.startswith("entity", F.lit("0:"))).select("entity", "n_c").distinct()
    return local.select(F.explode(_terms(F.substring_index(F.expr("substring(entity, 3)"), "@", 1))).alias("term"), "n_c")


def candidate_terms(private: DataFrame, owned: DataFrame, n: int, levels: tuple[float, ...], smooth: float) -> DataFrame:
    """(term, met, named): terms that can pass at all, with the largest numerator of P(entity, given the term) over the
    entities that the term meets in two texts at least (met), and over those whose address it is a part of (named).

    The denominator is the same for all entities of a term, so its best one decides.
    """
    texts = stored(private.select("hash", "t").dropDuplicates(["hash"]).select("hash", F.explode(_terms(F.col("t"))).alias("term")), "private-terms")
    prior = smooth * F.col("n_c") / n
    met = texts.join(owned.where("n_c > 1").select("entity", "hash", "n_c"), "hash").groupBy("entity", "term").agg(F.count("*").alias("n_ct"), F.first("n_c").alias("n_c")).where("n_ct > 1")
    no = F.lit(None).cast("double")
    rows = texts.select("term", F.lit(1).alias("k"), no.alias("met"), no.alias("named"))
    rows = rows.unionByName(met.select("term", F.lit(0).alias("k"), (F.col("n_ct") + prior).alias("met"), no.alias("named")))
    rows = rows.unionByName(name_parts(owned).select("term", F.lit(0).alias("k"), no.alias("met"), (F.col("n_c") + 1 + prior).alias("named")))
    best = rows.groupBy("term").agg(F.sum("k").alias("n_t"), F.max("met").alias("met"), F.max("named").alias("named"))
    return stored(best.where(_share(smooth) >= 2.0 ** -max(levels)).select("term", "met", "named"), "candidates")


def _share(smooth: float) -> Column:
    """P(entity, given the term) of the best entity, from n_t; it falls as n_t grows."""
    return F.greatest(F.col("met") / (F.col("n_t") + smooth), F.col("named") / (F.col("n_t") + 1 + smooth))


def disclosing_terms(candidates: DataFrame, n_t: DataFrame, levels: tuple[float, ...] = LEVELS, smooth: float = SMOOTH) -> DataFrame:
    """(term, level): terms over a threshold, with their level from 1."""
    rated = candidates.join(n_t, "term").withColumn("p", _share(smooth)).where(F.col("p") >= 2.0 ** -max(levels))
    return rated.select("term", sum(((-F.log2("p") <= bits).cast("int") for bits in levels), F.lit(0)).alias("level"))


def _places(rows: DataFrame, n_levels: int) -> DataFrame:
    """rows(doc, hash, t, levels: arrays of terms by level) -> (doc, hash, start, end, level).

    A text is searched in pieces that reach one code point back and a longest term ahead, so that work grows with the
    text and its terms, not with their product.
    """
    chunks = F.regexp_extract_all("t", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    bound = rows.select("doc", "hash", "levels", F.explode(F.array(chunks)).alias("c"))
    wide = F.transform(
        "c",
        lambda x, i: F.struct(
            i.alias("i"), (i > 0).cast("int").alias("before"), F.length(x).alias("own"),
            F.concat(F.when(i > 0, F.right(F.get("c", i - 1), F.lit(1))).otherwise(""), x, F.left(F.coalesce(F.get("c", i + 1), F.lit("")), F.lit(LONGEST + 1))).alias("x"),
        ),
    )
    pieces = bound.select("doc", "hash", "levels", F.explode(wide).alias("p")).select("doc", "hash", "levels", "p.*")
    words = F.regexp_extract_all("x", F.lit(_TERM), F.lit(0))
    gaps = F.transform(F.split("x", _TERM, -1), lambda g: F.length(g))
    cut = pieces.select("doc", "hash", "levels", "i", "before", "own", F.explode(F.array(F.struct(words.alias("w"), gaps.alias("g")))).alias("s"))
    folded = F.transform("s.w", lambda w: F.struct(F.lower(w).alias("w"), F.length(w).alias("n")))
    cut = cut.select("doc", "hash", "levels", "i", "before", "own", F.col("s.g").alias("g"), F.explode(F.array(folded)).alias("f"))
    own = lambda k: F.array_intersect(F.transform("f", lambda y: y["w"]), F.get("levels", F.lit(k)))
    cut = cut.select("doc", "hash", "i", "before", "own", "g", "f", F.explode(F.array(F.array(*[own(k) for k in range(n_levels)]))).alias("h"))
    level = lambda w: sum((F.when(F.array_contains(F.get("h", F.lit(k)), w), k + 1).otherwise(0) for k in range(n_levels)), F.lit(0))
    hit = F.filter(F.transform("f", lambda y, k: F.struct(k.alias("k"), y["n"].alias("n"), level(y["w"]).alias("level"))), lambda y: (y["level"] > 0) & (y["n"] <= LONGEST))
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)
    start = lambda y: total(F.slice("g", 1, y["k"] + 1)) + total(F.transform(F.slice("f", 1, y["k"]), lambda z: z["n"]))
    spots = cut.where(F.exists("h", lambda x: F.size(x) > 0)).select("doc", "hash", "i", "before", "own", F.explode(F.transform(hit, lambda y: F.struct(start(y).alias("at"), y["n"].alias("n"), y["level"].alias("level")))).alias("y"))
    at = F.col("i").cast("long") * PIECE + F.col("y.at") - F.col("before")
    mine = (F.col("y.at") >= F.col("before")) & (F.col("y.at") < F.col("before") + F.col("own"))
    return spots.where(mine).select("doc", "hash", at.alias("start"), (at + F.col("y.n")).alias("end"), F.col("y.level").alias("level"))


def term_spans(docs: DataFrame, private: DataFrame, found: DataFrame, id_col: str, text_col: str, levels: tuple[float, ...], smooth: float, common: float) -> DataFrame:
    """(doc, hash, start, end, level): every place of every disclosing term."""
    source = _source(docs, id_col, text_col)
    n = max(1, source.select("hash").distinct().count())
    owned = owners(found).where(F.col("n_c") <= common * n)
    candidates = candidate_terms(private, owned, n, levels, smooth)
    sought = small_side(candidates.select("term"), F.octet_length("term"))
    words = source.select("doc", "hash", F.explode(_terms(F.col("t"))).alias("term"))
    postings = stored(words.join(sought, "term", "left_semi").distinct(), "postings")
    n_t = postings.groupBy("term").agg(F.count_distinct("hash").alias("n_t"))
    hits = postings.join(disclosing_terms(candidates, n_t, levels, smooth), "term")
    listed = hits.groupBy("doc", "hash").agg(F.array(*[F.collect_set(F.when(F.col("level") == k + 1, F.col("term"))) for k in range(len(levels))]).alias("levels"))
    listed = stored(listed, "listed")
    size = F.aggregate(F.flatten("levels"), F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x) + 16)
    return _places(_on_document(source, small_side(listed, size)), len(levels))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: tuple[float, ...] = LEVELS, smooth: float = SMOOTH, common: float = COMMON) -> DataFrame:
    """(doc, hash, kind, start, end, level): base spans (level 0) and those of disclosing terms that no base span holds.

    Equal (id, text) rows count as one document and share their spans. ``hash`` is the text's. Joins are on term, entity
    or document, so a very common entity is many small keys; counts are pre-aggregated before each shuffle.
    """
    private = private_documents(docs, id_col, text_col)
    found = stored(mentions(private), "mentions")
    terms = term_spans(docs, private, found, id_col, text_col, levels, smooth, common).distinct()
    base = found.select("doc", "hash", "kind", "start", "end", F.lit(0).alias("level"))
    spans = base.unionByName(terms.withColumn("kind", F.lit(4)))
    order = Window.partitionBy("doc", "hash").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    covered = F.max(F.when(F.col("kind") < 4, F.col("end"))).over(order)
    spans = spans.withColumn("covered", covered).where("kind < 4 or covered is null or covered < end")
    return spans.select("doc", "hash", "kind", "start", "end", "level")


# ---------------------------------------------------------------- results


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms): one row per input row.

    Defined cases: null and empty texts have no spans; repeated rows stay and change no count; a null id is a document of
    its own text; an empty table gives an empty table; other columns are not read; offsets are code points, ends exclusive.
    """
    spans = pii_spans(docs, id_col, text_col, **options)
    grouped = spans.groupBy("doc", "hash").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("all"))
    joined = _on_document(docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("hash")), grouped, "left")
    every = F.coalesce(F.col("all"), F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))
    base = F.filter(every, lambda s: s["kind"] < 4)
    counts = [_count(every, k).alias(f"n_{KINDS[k]}" + "s" * (k == 4)) for k in range(5)]
    return joined.select(F.col("doc").alias("doc_id"), *counts[:4], F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(every).alias("spans"), counts[4])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span replaced: base spans by ``[KIND]``; terms by their first letter and ``***`` (level 1), by
    ``[TERM]`` (2) or by nothing (the last level).

    Overlapping spans merge and are replaced as the first of them. Rows and columns stay, whatever they are called; null
    texts stay null. Further cases as in ``find_pii``.
    """
    spans = pii_spans(docs, id_col, text_col, **options)
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    top = len(options.get("levels", LEVELS))
    tag = F.when(F.col("level") == 1, F.lit(None)).when(F.col("level") == top, "").otherwise(F.get(tags, F.col("kind")))
    order = Window.partitionBy("doc", "hash").orderBy("start", F.desc("end"), "kind")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") < reached, 0).otherwise(1)
    marked = spans.select("doc", "hash", "start", "end", "kind", tag.alias("tag"), fresh.alias("fresh"))
    islands = marked.withColumn("island", F.sum("fresh").over(order)).groupBy("doc", "hash", "island")
    islands = islands.agg(F.min("start").alias("s"), F.max("end").alias("e"), F.max(F.when(F.col("fresh") == 1, F.col("tag"))).alias("tag"))
    cuts = islands.groupBy("doc", "hash").agg(F.array_sort(F.collect_list(F.struct("s", "e", "tag"))).alias("cuts"))
    joined = _on_document(boxed(docs, id_col, text_col), cuts, "left")
    text = F.col("t")
    piece = lambda start, end: F.substring(text, start.cast("int") + 1, (end - start).cast("int"))
    ends = lambda i: F.when(i == 0, 0).otherwise(F.get(F.col("cuts"), i - 1)["e"])
    pieces = F.transform("cuts", lambda c, i: F.concat(piece(ends(i), c["s"]), F.coalesce(c["tag"], F.concat(piece(c["s"], c["s"] + 1), F.lit("***")))))
    tail = F.substring(text, F.element_at("cuts", -1)["e"].cast("int") + 1, F.length(text))
    clean = F.when(F.col("cuts").isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return joined.select(*[(clean if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op4_query(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents"))
