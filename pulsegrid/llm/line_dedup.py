"""Line dedup: repeated windows of three consecutive lines, found over the whole corpus.

Only DataFrame functions are used. Every document is split at line feeds; each run of three
consecutive lines becomes a 128-bit key. A key that occurs more than once keeps its first occurrence
(smallest id, then text hash, then position); all lines covered by any later occurrence go.
Overlapping later windows merge because a line goes once however many of them cover it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, same

WINDOW = 3


def _windows(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """One row per window: document, position of its first line and two independent 64-bit hashes.

    Windows of blank lines only say nothing about copying and are left out.
    """
    lines = docs.select(
        F.col(id_col).alias("_doc"),
        F.xxhash64(text_col).alias("_text"),
        F.split(F.col(text_col), "\n", -1).alias("_lines"),
    ).where(F.size("_lines") >= width)
    hashed = lines.select(
        "_doc",
        "_text",
        F.transform("_lines", lambda x: F.xxhash64(x)).alias("_a"),
        F.transform("_lines", lambda x: F.xxhash64(F.lit("second"), x)).alias("_b"),
        F.transform("_lines", lambda x: F.trim(x) == "").alias("_blank"),
    )
    starts = F.sequence(F.lit(0), F.size("_a") - width)
    at = hashed.select(
        "_doc",
        "_text",
        F.explode(
            F.transform(
                starts,
                lambda i: F.struct(
                    i.alias("pos"),
                    F.xxhash64(*[F.get("_a", i + k) for k in range(width)]).alias("a"),
                    F.xxhash64(*[F.get("_b", i + k) for k in range(width)]).alias("b"),
                    F.forall(F.slice("_blank", i + 1, width), lambda x: x).alias("blank"),
                ),
            )
        ).alias("w"),
    )
    return at.where(~F.col("w.blank")).select("_doc", "_text", "w.pos", "w.a", "w.b")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """All rows and columns of ``docs`` with ``text_col`` cut down, plus ``n_lines`` and ``n_removed`` (long).

    Defined cases: a null text stays null with 0 lines; an empty text has one empty line; texts of fewer than
    ``width`` lines stay whole; a null id sorts first; equal (id, text) rows count as one document and are cut alike;
    an empty table gives an empty table; input columns named ``n_lines`` or ``n_removed`` are replaced, all others
    stay, whatever they are called.

    Plan: windows are pre-aggregated per key before the shuffle (a window held by a third of the corpus is one row
    per task); the join that finds later occurrences has plain equi keys, so adaptive execution may split a hot key.
    """
    windows = _windows(docs, id_col, text_col, width)
    place = F.struct("_doc", "_text", "pos")
    repeated = (
        windows.groupBy("a", "b")
        .agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
        .where(F.col("_first") != F.col("_last"))
        .select("a", "b", "_first")
    )
    later = windows.join(repeated, ["a", "b"]).where(~place.eqNullSafe(F.col("_first")))
    cut = (
        later.groupBy(F.col("_doc").alias("_cdoc"), F.col("_text").alias("_ctext"))
        .agg(F.collect_set("pos").alias("_later"))
    )
    # the user's columns travel as one struct, so none of their names can meet a name used here
    joined = boxed(docs, id_col, text_col).join(cut, same(F.col("doc"), F.col("_cdoc")) & (F.col("hash") == F.col("_ctext")), "left")
    lines = F.split(F.col("t"), "\n", -1)
    covered = F.flatten(F.transform("_later", lambda p: F.sequence(p, p + (width - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    text = F.when(F.col("_later").isNull(), F.col("t")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    total = F.when(F.col("t").isNull(), 0).otherwise(F.size(lines)).cast("long")
    gone = F.when(F.col("_later").isNull(), 0).otherwise(F.size(F.array_distinct(covered))).cast("long")
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(
        *[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in others],
        total.alias("n_lines"),
        gone.alias("n_removed"),
    )


def op1_query(spark, sf_dir):
    from .common import table

    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


OP1_SQL = """
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), windows AS (
  SELECT doc_id, i AS pos, l[i + 1] || chr(10) || l[i + 2] || chr(10) || l[i + 3] AS w
  FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS i FROM lines WHERE len(l) >= 3)
  WHERE trim(l[i + 1]) <> '' OR trim(l[i + 2]) <> '' OR trim(l[i + 3]) <> ''
), later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM windows)
  WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, pos + d AS line FROM later, (VALUES (0), (1), (2)) v(d)
), numbered AS (
  SELECT doc_id, unnest(l) AS line_text, unnest(range(0, len(l))) AS line FROM lines
), kept AS (
  SELECT n.doc_id, string_agg(n.line_text, chr(10) ORDER BY n.line) AS text
  FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.line = g.line
  WHERE g.line IS NULL GROUP BY n.doc_id
), removed AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
       coalesce(r.n, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN removed r ON d.doc_id = r.doc_id
"""
