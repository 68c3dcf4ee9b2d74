"""Line dedup by overlapping three-line windows, in DataFrame functions only.

Every three consecutive lines of a document are one window (compared exactly, by the MD5 of
the three lines joined by newlines).  The first occurrence of a window, by (doc_id, line),
stays; the lines of every later occurrence are removed, overlapping windows merged.

Defined results: a null text has no lines and stays null; an empty text is one empty line;
documents of fewer than three lines have no window and stay whole; a null doc_id sorts first;
rows with the same doc_id and the same text are one document and get the same result; extra
columns pass through untouched (one named like a result is replaced); an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.inputs import table

#: Parts that the rows of one window are dealt to, so that a window of a third of all
#: documents does not meet in one task.
SALTS = 16

RESULTS = ("kept_text", "n_lines", "n_removed", "n_spans")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def repeated_starts(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc, digest, starts): for each document the windows that are later occurrences.

    ``docs`` has (doc_id, text).  Counts and first places are combined before the shuffle; the
    first places then go back to the windows by a join dealt on (window, salt).
    """
    here = docs.select("doc_id", F.md5("text").alias("digest"), _lines(F.col("text")).alias("lines"))
    here = here.filter(F.size("lines") >= width)
    windows = here.select(
        "doc_id", "digest",
        F.posexplode(F.transform(
            F.sequence(F.lit(1), F.size("lines") - (width - 1)),
            lambda i: F.unhex(F.md5(F.array_join(F.slice("lines", i, width), "\n"))))
        ).alias("line", "window"))
    place = F.struct("doc_id", "digest", "line")
    first = (windows.groupBy("window")
             .agg(F.min(place).alias("first"), F.max(place).alias("last"))
             .filter(~F.col("first").eqNullSafe(F.col("last")))
             .select("window", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    salted = windows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SALTS)).cast("int"))
    later = (salted.join(first, ["window", "salt"])
             .filter(~F.col("first").eqNullSafe(place)))
    return later.groupBy("doc_id", "digest").agg(F.collect_set("line").alias("starts"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                width: int = 3) -> DataFrame:
    """All columns of ``df`` plus kept_text, n_lines, n_removed (lines), n_spans (removed runs)."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    starts = repeated_starts(docs, width).select(
        F.struct("doc_id", "digest").alias("__doc"), F.col("starts").alias("__starts"))
    # A struct key compares nulls as equal, so rows without an id find their lines too.
    keyed = df.withColumn("__doc", F.struct(F.col(id_col).alias("doc_id"),
                                           F.md5(text_col).alias("digest")))
    joined = keyed.join(starts, keyed["__doc"].eqNullSafe(starts["__doc"]), "left").drop("__doc")
    gone = F.array_distinct(F.flatten(F.transform(
        "__starts", lambda s: F.sequence(s, s + (width - 1)))))
    joined = joined.withColumn("__gone", F.when(F.col("__starts").isNotNull(), F.array_sort(gone)))
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in RESULTS],
        F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(
            F.filter(_lines(F.col(text_col)), lambda x, i: ~F.array_contains("__gone", i)),
            "\n")).alias("kept_text"),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(_lines(F.col(text_col))))
        .cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size(F.filter("__gone", lambda x: ~F.array_contains("__gone", x - 1))), F.lit(0))
        .cast("long").alias("n_spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table: doc_id, n_lines, n_removed, n_spans, kept_text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "n_spans", "kept_text")


SQL = """
WITH lines AS (
  SELECT doc_id, t.line - 1 AS line, t.l AS l
  FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(l, line)
), windows AS (
  SELECT doc_id, line, l || chr(10) || lead(l, 1) OVER w || chr(10) || lead(l, 2) OVER w AS win
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line)
), ranked AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY win ORDER BY doc_id, line) AS nth
  FROM windows WHERE win IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, line + k AS line
  FROM ranked, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1
), marked AS (
  SELECT l.doc_id, l.line, l.l, g.line IS NOT NULL AS cut
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line
), runs AS (
  SELECT *, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY line), false) AS opens
  FROM marked
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (cut) AS BIGINT) AS n_removed,
       CAST(count(*) FILTER (opens) AS BIGINT) AS n_spans,
       coalesce(string_agg(l, chr(10) ORDER BY line) FILTER (NOT cut), '') AS kept_text
FROM runs GROUP BY doc_id
"""
