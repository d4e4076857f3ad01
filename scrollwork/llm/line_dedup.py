"""Lines that repeat across documents. DataFrame functions only.

Lines are exploded with their position, normalised and hashed. Distinct documents are counted per hash: a first
aggregation on (hash, document) removes repeats inside documents and spreads a line that stands everywhere over
all tasks, a second one counts. Hashes over the threshold are joined back to the narrow (hash, document,
position) rows; the join's other side has one row per hash, so a hot hash is split by AQE, and it is also
salted by document here. Texts move once, when the dropped positions of a document meet it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scrollwork.functions.text import hold
from scrollwork.llm.common import BLANKS, UPPER, ascii_lower, query, table, written

SALTS = 32


def line_key(c: Column) -> Column:
    return ascii_lower(F.btrim(c, F.lit(BLANKS)))


def dropped_positions(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """Per ``doc_id`` and ``version`` of ``rows`` the array ``dropped`` of positions of lines to drop."""
    lines = rows.select("doc_id", "version", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = hold(lines.where(F.length("line") >= min_chars).select("doc_id", "version", "pos", "line"), {"key": line_key(F.col("line"))})
    occurrences = keyed.where(F.length("key") >= min_chars).select(F.unhex(F.md5("key")).alias("hash"), "doc_id", "version", "pos")
    repeated = occurrences.groupBy("hash").agg(F.countDistinct("doc_id").alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= min_docs)
    repeated = written(repeated.select("hash", "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "lines")
    return (
        occurrences.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        .join(repeated, ["hash", "salt"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "version")
        .agg(F.collect_set("pos").alias("dropped"))
    )


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per input row: ``doc_id``, ``text`` (kept lines, joined), ``n_lines``, ``n_dropped``, and ``row`` (the other columns of the input).

    A line whose key has ``min_chars`` code points or more and stands in ``min_docs`` different documents or more is
    dropped from all but the document with the largest id. A null or empty text is one empty line. Repeated lines of
    one document count once, and all of them go or stay. Rows that repeat id and text count as one document and get
    equal results. A null id is no document: it is not counted, but its lines are dropped. Other columns have no
    effect; their names may clash with those used here.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*[c for c in df.columns if c != text_col]).alias("row"))
    rows = rows.withColumn("version", F.xxhash64("text"))
    dropped = dropped_positions(rows, min_chars, min_docs)
    both = rows.alias("a").join(dropped.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.version") == F.col("b.version")), "left")
    both = hold(both.select("a.doc_id", "text", "row", "dropped"), {"lines": F.split("text", "\n")})
    # array_except works by hashing, so a long document with many dropped lines stays linear
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    joined = F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    return both.select(
        "doc_id",
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(joined).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        "row",
    )


#: DuckDB statement of the operator over a table ``documents``; used by the query and by the pipeline's SQL.
LINES_SQL = f"""
WITH split_lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key FROM split_lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, pos, line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""


@query(f"SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM ({LINES_SQL})")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
