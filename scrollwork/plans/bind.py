"""How the driver's tables play the roles of pages, segments, chunks and logs.

Every binding is one narrow projection, so filters and column pruning reach the scan.
The ``*_SQL`` strings state the same projections for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scrollwork.functions import ordered, text as T
from scrollwork.plans.registry import table
from scrollwork.session import spread


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source`` is the document, ``doc_id`` the page number."""
    return spread(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), "doc_id").select(
        F.col("source").alias("doc_id"), F.col("doc_id").alias("page_num"), "text"
    )


DOC_PAGES_SQL = "(SELECT source AS doc_id, doc_id AS page_num, text FROM documents)"

INTENT_OF_LANG = [("en", "mechanics"), ("fr", "setting"), ("de", "equipment"), ("es", "narrative")]


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document row is a segment of its source; the title is its first five words."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    return d.select(
        F.col("source").alias("doc_id"),
        F.col("doc_id").alias("seg_no"),
        F.array_join(F.slice(T.word_array(F.col("text")), 1, 5), " ").alias("title"),
        F.col("text").alias("content"),
        T.word_count(F.col("text")).alias("word_count"),
        T.first_in(F.col("lang"), INTENT_OF_LANG, "unknown").alias("intent"),
    )


SEGMENTS_SQL = r"""(SELECT source AS doc_id, doc_id AS seg_no,
    array_to_string(regexp_extract_all(text, '\S+')[1:5], ' ') AS title, text AS content,
    len(regexp_extract_all(text, '\S+'))::INTEGER AS word_count,
    CASE lang WHEN 'en' THEN 'mechanics' WHEN 'fr' THEN 'setting' WHEN 'de' THEN 'equipment'
              WHEN 'es' THEN 'narrative' ELSE 'unknown' END AS intent FROM documents)"""


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host is the document; the page's ``h1`` becomes a heading line, deeper for addressed parts."""
    p = table(spark, sf_dir, "pages")
    mark = F.when(F.col("url").rlike(r"[?#]"), "## ").otherwise("# ")
    title = F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1)
    body = F.array_join(F.regexp_extract_all("html", F.lit(r"<p>([^<]*)"), 1), "\n\n")
    return p.select(
        F.regexp_extract("url", r"//([^/]+)", 1).alias("doc_id"),
        F.col("page_id").alias("page_num"),
        F.concat(mark, title, F.lit("\n\n"), body).alias("text"),
    )


WEB_PAGES_SQL = r"""(SELECT regexp_extract(url, '//([^/]+)', 1) AS doc_id, page_id AS page_num,
    CASE WHEN regexp_matches(url, '[?#]') THEN '## ' ELSE '# ' END || regexp_extract(html, '<h1>([^<]*)</h1>', 1)
    || chr(10) || chr(10) || array_to_string(regexp_extract_all(html, '<p>([^<]*)', 1), chr(10) || chr(10)) AS text
    FROM pages)"""

WS = " \t\n\r\x0b\x0c"
STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def sql_strip(x: str) -> str:
    return f"trim({x}, {STRIP})"


def sql_words(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\S+'))"


def sql_ascii(x: str) -> str:
    """Letters outside ASCII become ``x``, so that ASCII word boundaries fall where Unicode ones do."""
    return rf"regexp_replace({x}, '[^\x00-\x7F]', 'x', 'g')"


def sql_hits(x: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"regexp_matches({x}, {quote(p)})::INTEGER" for p in patterns) + ")"


def sql_total(x: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({x}, {quote(p)}))" for p in patterns) + ")"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_case(x: str, pairs: list[tuple[str, object]], default: str = "NULL") -> str:
    val = lambda v: quote(v) if isinstance(v, str) else str(v)
    return f"CASE {x} " + " ".join(f"WHEN {quote(k)} THEN {val(v)}" for k, v in pairs) + f" ELSE {default} END"


def sql_list(values: list[str]) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def sql_slug(x: str) -> str:
    return (
        rf"coalesce(nullif(trim(regexp_replace(regexp_replace(trim(lower({x})), '[^a-z0-9\s_-]', '', 'g'), "
        rf"'[\s_-]+', '_', 'g'), '_'), ''), 'untitled')"
    )


# --- the event log: user is the campaign, an event is one turn ---


def log_span() -> Column:
    return ordered.hours("ts", 24)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``error`` is a failed action, ``purchase`` a success, the rest are no actions.

    The delta is the whole part of ``value`` over 50, negative for errors and views.
    """
    e = table(spark, sf_dir, "events")
    sign = F.when(F.col("event_type").isin("error", "view"), -1).otherwise(1)
    return e.select(
        F.col("user_id").alias("campaign_id"), "ts", "event_id", "event_type", "value", "props",
        (F.floor(F.col("value") / 50) * sign).cast("bigint").alias("delta"),
    )


LOG_SQL = """(SELECT user_id AS campaign_id, ts, event_id, event_type, value, props,
    (floor(value / 50) * CASE WHEN event_type IN ('error', 'view') THEN -1 ELSE 1 END)::BIGINT AS delta FROM events)"""
