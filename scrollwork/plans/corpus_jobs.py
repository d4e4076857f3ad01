"""Corpus jobs: pages, structure, segments, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrollwork.functions import fixed, ordered, text as T
from scrollwork.operators import classify, pages, segments, structure
from scrollwork.plans import bind
from scrollwork.plans.bind import sql_ascii, sql_case, sql_hits, sql_strip, sql_total, sql_words
from scrollwork.plans.registry import job

P, S, WP = bind.DOC_PAGES_SQL, bind.SEGMENTS_SQL, bind.WEB_PAGES_SQL


# ---- pages ----

@job(f"""
SELECT doc_id, page_num, length({sql_strip('text')})::BIGINT AS char_count,
       count(*) OVER (PARTITION BY doc_id) AS pages,
       sum(length({sql_strip('text')})) OVER (PARTITION BY doc_id)::BIGINT AS doc_chars,
       max(length({sql_strip('text')})) OVER (PARTITION BY doc_id)::BIGINT AS max_chars
FROM {P}""")
def page_stats(spark, sf):
    return pages.page_stats(bind.doc_pages(spark, sf))


SAMPLE = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_num) - 1 AS pos,
       count(*) OVER (PARTITION BY doc_id) AS n FROM {P}),
sampled AS (SELECT * FROM numbered WHERE pos % greatest(1, n // 10) = 0 AND pos // greatest(1, n // 10) < 10)"""


@job(f"WITH {SAMPLE} SELECT doc_id, page_num, n AS n_pages FROM sampled")
def sample_pages(spark, sf):
    return pages.sample_pages(bind.doc_pages(spark, sf).select("doc_id", "page_num"))


REPEATED = f"""{SAMPLE},
full_lines AS (SELECT doc_id, page_num, n, list_filter(list_transform(string_split(text, chr(10)),
       lambda x: {sql_strip('x')}), lambda x: x <> '') AS f FROM sampled WHERE n > 4),
edges AS (SELECT doc_id, page_num, 'head' AS side, unnest(f[1:2]) AS l FROM full_lines
          UNION ALL SELECT doc_id, page_num, 'foot', unnest(f[-2:]) FROM full_lines),
cleaned AS (SELECT doc_id, side, {sql_strip("regexp_replace(l, '\\s*[0-9]+\\s*$', '')")} AS line FROM edges),
counted AS (SELECT doc_id, line, count(*) FILTER (side = 'head') AS h, count(*) FILTER (side = 'foot') AS t
            FROM cleaned WHERE length(line) > 3 GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS sample FROM full_lines GROUP BY ALL),
repeated AS (SELECT doc_id, line, CASE WHEN t > 0 THEN t ELSE h END AS times, sample
             FROM counted JOIN sizes USING (doc_id) WHERE CASE WHEN t > 0 THEN t ELSE h END >= sample * {{share}})"""


@job(f"WITH {REPEATED.format(share=0.1)} SELECT doc_id, line, times, sample FROM repeated")
def repeated_lines(spark, sf):
    # prose without running heads: a lower share than the default, so that lines qualify
    return pages.repeated_lines(bind.doc_pages(spark, sf), share=0.1)


@job(f"""WITH {REPEATED.format(share=0.1)},
noise AS (SELECT doc_id, list(line) AS bad FROM repeated GROUP BY doc_id),
kept AS (SELECT p.doc_id, page_num, text, list_filter(string_split(text, chr(10)), lambda x:
    NOT regexp_matches({sql_strip('x')}, '^[0-9]+$') AND NOT list_contains(coalesce(bad, []),
    {sql_strip("regexp_replace(" + sql_strip('x') + ", '\\s*[0-9]+\\s*$', '')")})) AS k
    FROM {P} p LEFT JOIN noise USING (doc_id))
SELECT doc_id, page_num, array_to_string(k, chr(10)) AS text,
       length(text)::INTEGER - length(array_to_string(k, chr(10)))::INTEGER AS removed_chars FROM kept""")
def strip_lines(spark, sf):
    p = bind.doc_pages(spark, sf)
    out = pages.strip_lines(p.withColumn("full", F.length("text")), pages.repeated_lines(p, share=0.1))
    return out.withColumn("removed_chars", F.col("full") - F.length("text")).drop("full")


# ---- structure ----

TITLE_SQL = r"array_to_string(list_transform(regexp_extract_all({x}, '\p{{L}}+|[^\p{{L}}]+'), lambda q: upper(q[1]) || lower(q[2:])), '')"
NUMBERED = r"^(?i:chapter\s+)?([0-9]+)[.:\s]+\s*([A-Za-z].{2,60})$"


@job(rf"""WITH l AS (SELECT doc_id, page_num, unnest(string_split(text, chr(10))) AS raw,
       unnest(range(len(string_split(text, chr(10))))) AS line_no FROM {P}),
s AS (SELECT doc_id, page_num, line_no::INTEGER AS line_no, {sql_strip('raw')} AS s FROM l),
k AS (SELECT *, CASE WHEN regexp_matches(s, '^#{{1,3}}\s+.+$') THEN 'markdown'
    WHEN regexp_matches(s, '\p{{Lu}}') AND NOT regexp_matches(s, '\p{{Ll}}') AND length(s) > 3 AND length(s) < 80
         AND s[1] <> '•' AND NOT regexp_matches(s, '^[0-9]+\.\s') THEN 'allcaps'
    WHEN regexp_matches(s, '{NUMBERED}') THEN 'numbered' END AS source FROM s WHERE length(s) >= 3)
SELECT doc_id, page_num, line_no, source,
    CASE source WHEN 'markdown' THEN {sql_strip("regexp_extract(s, '^#{1,3}\\s+(.+)$', 1)")}
    WHEN 'allcaps' THEN {TITLE_SQL.format(x='s')} ELSE {sql_strip(f"regexp_extract(s, '{NUMBERED}', 2)")} END AS title,
    CASE WHEN source = 'markdown' THEN length(regexp_extract(s, '^(#+)', 1)) ELSE 1 END::INTEGER AS level
FROM k WHERE source IS NOT NULL""")
def text_headings(spark, sf):
    return structure.text_headings(bind.doc_pages(spark, sf))


HEADS = rf"""wp AS (SELECT * FROM {WP}),
l AS (SELECT doc_id, page_num, unnest(string_split(text, chr(10))) AS raw,
       unnest(range(len(string_split(text, chr(10))))) AS line_no FROM wp),
hd AS (SELECT doc_id, page_num, line_no, {sql_strip("regexp_extract(" + sql_strip('raw') + ", '^#{1,3}\\s+(.+)$', 1)")} AS title,
       length(regexp_extract({sql_strip('raw')}, '^(#+)', 1)) AS level
       FROM l WHERE regexp_matches({sql_strip('raw')}, '^#{{1,3}}\s+.+$')),
sec AS (SELECT doc_id, page_num, line_no, title, level::INTEGER AS level, page_num AS page_start,
    greatest(page_num, coalesce(lead(page_num) OVER (PARTITION BY doc_id ORDER BY page_num, line_no) - 1,
        (SELECT max(page_num) FROM wp w WHERE w.doc_id = hd.doc_id))) AS page_end,
    page_num || ':' || line_no AS section_id FROM hd)"""


def _md_headings(p):
    return structure.text_headings(p).filter(F.col("source") == "markdown")


def _sections(spark, sf):
    p = bind.web_pages(spark, sf)
    return structure.section_ranges(_md_headings(p), p)


@job(f"WITH {HEADS} SELECT doc_id, section_id, title, level, page_start, page_end FROM sec")
def section_ranges(spark, sf):
    return _sections(spark, sf).select("doc_id", "section_id", "title", "level", "page_start", "page_end")


@job(f"""WITH {HEADS} SELECT s.doc_id, section_id, count(*) AS pages, sum({sql_words('text')})::BIGINT AS words
FROM sec s JOIN wp ON wp.doc_id = s.doc_id AND wp.page_num BETWEEN page_start AND page_end GROUP BY ALL""")
def section_words(spark, sf):
    p = bind.web_pages(spark, sf)
    sized = p.select("doc_id", "page_num", T.word_count(F.col("text")).alias("w"))
    return structure.section_pages(_sections(spark, sf), sized).groupBy("doc_id", "section_id").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("w").cast("bigint").alias("words")
    )


@job(f"""WITH {HEADS}, body AS (SELECT s.doc_id, section_id, string_agg(text, chr(10) || chr(10) ORDER BY wp.page_num) AS content
FROM sec s JOIN wp ON wp.doc_id = s.doc_id AND wp.page_num BETWEEN page_start AND page_end GROUP BY ALL)
SELECT doc_id, section_id, page_start, page_end, length(content)::INTEGER AS chars, md5(content) AS digest
FROM sec JOIN body USING (doc_id, section_id)""")
def build_sections(spark, sf):
    p = bind.web_pages(spark, sf)
    return structure.build_sections(_md_headings(p), p).select(
        "doc_id", "section_id", "page_start", "page_end", F.length("content").alias("chars"), F.md5("content").alias("digest")
    )


NEST = f"""{HEADS}, nest AS (SELECT *, CASE WHEN level > 1 THEN last_value(CASE WHEN level <= 1 THEN section_id END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY page_num, line_no ROWS UNBOUNDED PRECEDING) END AS parent_id FROM sec)"""


@job(f"WITH {NEST} SELECT doc_id, section_id, level, parent_id FROM nest")
def nest_sections(spark, sf):
    return structure.nest_sections(_sections(spark, sf)).select("doc_id", "section_id", "level", "parent_id")


def intent_sql(title: str) -> str:
    x = sql_ascii(f"lower({title})")
    scores = {n: sql_hits(x, [p.replace("[ãa]", "[xa]") for p in pats]) for n, pats in fixed.INTENT_PATTERNS}
    top = "greatest(" + ", ".join(scores.values()) + ")"
    arms = " ".join(f"WHEN {s} = {top} THEN '{n}'" for n, s in scores.items())
    return (
        f"CASE WHEN {scores['meta']} > 0 AND {sql_words(title)} <= 5 THEN 'meta' "
        f"WHEN {top} = 0 THEN 'unknown' {arms} END"
    )


NAMES_SQL = """(SELECT s_suppkey AS k, s_name || ' of the world' AS t FROM supplier UNION ALL
    SELECT p_partkey, p_name || ' ' || CASE p_type WHEN 'ECONOMY' THEN 'combat rules and magic items' WHEN 'SMALL' THEN 'credits'
    WHEN 'STANDARD' THEN 'table of contents and an introduction to the story' ELSE 'history of factions' END FROM part UNION ALL
    SELECT p_partkey, p_name || ' ' || lower(p_type) || ' spirits, weapons and traits, blank page' FROM part)"""


@job(f"SELECT t AS title, {intent_sql('t')} AS intent, count(*) AS n FROM {NAMES_SQL} GROUP BY ALL")
def classify_intent(spark, sf):
    part, sup = bind.table(spark, sf, "part"), bind.table(spark, sf, "supplier")
    tail = T.first_in(
        F.col("p_type"),
        [("ECONOMY", "combat rules and magic items"), ("SMALL", "credits"),
         ("STANDARD", "table of contents and an introduction to the story")],
        "history of factions",
    )
    titles = sup.select(F.concat("s_name", F.lit(" of the world")).alias("title"))
    titles = titles.unionAll(part.select(F.concat_ws(" ", "p_name", tail)))
    titles = titles.unionAll(
        part.select(F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit(" spirits, weapons and traits, blank page")))
    )
    counted = titles.groupBy("title").agg(F.count(F.lit(1)).alias("n"))
    return structure.classify_intent(counted)


TOWN = "regexp_replace(title, 'u', 'world', 'g')"


@job(f"""WITH {NEST}, own AS (SELECT *, {intent_sql("regexp_replace(title, '[aeiou] ', ' magic ')")} AS own FROM nest)
SELECT c.doc_id, c.section_id, CASE WHEN c.own = 'unknown' THEN coalesce(p.own, c.own) ELSE c.own END AS intent
FROM own c LEFT JOIN own p ON p.doc_id = c.doc_id AND p.section_id = c.parent_id""")
def inherit_intent(spark, sf):
    s = structure.nest_sections(_sections(spark, sf))
    s = s.withColumn("title", F.regexp_replace("title", r"^(.*?)[aeiou] ", "$1 magic "))
    return structure.inherit_intent(structure.classify_intent(s)).select("doc_id", "section_id", "intent")


@job(f"""WITH {HEADS}, f AS (SELECT doc_id, arg_min(list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}),
    lambda x: x <> '')[1], page_num) AS line FROM wp GROUP BY doc_id),
h AS (SELECT doc_id, arg_min(title, (page_num, line_no)) AS head FROM sec GROUP BY doc_id)
SELECT doc_id, coalesce(CASE WHEN length(line) < 40 THEN line END, head, 'Untitled Document') AS title FROM f LEFT JOIN h USING (doc_id)""")
def document_title(spark, sf):
    return structure.document_title(bind.web_pages(spark, sf), _sections(spark, sf), longest=40)


@job(f"""SELECT doc_id, 'Document' AS title, 1 AS level, min(page_num) AS page_start, max(page_num) AS page_end,
sum({sql_words('text')})::BIGINT AS words FROM {WP} GROUP BY doc_id""")
def whole_document(spark, sf):
    return structure.whole_document(bind.web_pages(spark, sf))


# ---- layout, fonts, contents pages: an order is a page, its lines are blocks and spans ----

BAND = "CASE l_partkey % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'full' END"


@job(f"""WITH b AS (SELECT l_orderkey, l_linenumber AS n, l_quantity AS y, {BAND} AS band, 'b' || l_linenumber AS t FROM lineitem),
p AS (SELECT l_orderkey, count(*) AS c, min(y) FILTER (band <> 'full') AS top, max(y) FILTER (band <> 'full') AS low, bool_or(band = 'left') AND bool_or(band = 'right') AS two FROM b GROUP BY ALL),
q AS (SELECT l_orderkey, t, CASE band WHEN 'left' THEN 1 WHEN 'right' THEN 2 ELSE CASE WHEN y < top THEN 0 WHEN y > low THEN 3 END END AS k, y, n FROM b JOIN p USING (l_orderkey)),
s AS (SELECT l_orderkey, string_agg(t, chr(10) || chr(10) ORDER BY k, y, n) AS text FROM q WHERE k IS NOT NULL GROUP BY ALL)
SELECT l_orderkey AS page_num, CASE WHEN c >= 4 AND two THEN text END AS text FROM p LEFT JOIN s USING (l_orderkey)""")
def reorder_columns(spark, sf):
    li = bind.table(spark, sf, "lineitem")
    m = F.col("l_partkey") % 3
    b = li.select(
        F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("page_num"), F.col("l_linenumber").alias("ord"), F.when(m == 1, 320.0).otherwise(20.0).alias("x0"),
        F.col("l_quantity").alias("y0"), F.when(m == 0, 280.0).otherwise(580.0).alias("x1"), F.concat(F.lit("b"), "l_linenumber").alias("text"), F.lit(600.0).alias("page_width"),
    )
    return pages.reorder_columns(b).select("page_num", "text")


FONT = """sp AS (SELECT l_suppkey AS doc_id, l_orderkey AS page_num, l_linenumber AS line_no, 't' || (l_partkey + 100) AS title, 8 + round(l_discount * 100) AS size FROM lineitem),
sz AS (SELECT doc_id, size, count(*) AS n, min((page_num, line_no)) AS f FROM sp GROUP BY ALL),
bd AS (SELECT doc_id, arg_max(size, (n, -f[1], -f[2])) AS body FROM sz GROUP BY ALL),
fh AS (SELECT sp.doc_id, page_num, line_no, title, CASE WHEN size >= body * 1.5 THEN 1 ELSE 2 END AS level, 'font' AS source FROM sp JOIN sz USING (doc_id, size) JOIN bd ON bd.doc_id = sp.doc_id WHERE size > body AND n <= 50)"""


def _spans(spark, sf):
    return bind.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("page_num"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("t"), F.col("l_partkey") + 100).alias("text"),
        (8 + F.round(F.col("l_discount") * 100)).alias("size"),
    )


@job(f"WITH {FONT.replace('min((page_num, line_no)) AS f', 'min(page_num * 10 + line_no) AS f').replace('-f[1], -f[2]', '-f')} SELECT * FROM fh")
def font_headings(spark, sf):
    return structure.font_headings(_spans(spark, sf))


TOC_SQL = """(SELECT o_custkey AS doc_id, o_orderkey AS page_num, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Table of Contents' || chr(10) || 'Part ' || o_orderstatus || ' ..... ' || year(o_orderdate) || chr(10)
|| '    Page of the order  ' || '  ' || o_orderkey || chr(10) || CASE WHEN o_orderstatus = 'F' THEN 'More' || ' .... 7' || chr(10) ELSE '' END || 'no entry' ELSE 'HEAD ' || upper(o_orderstatus) || 'X' || chr(10) || 'plain' END AS text FROM orders)"""


def _toc_pages(spark, sf):
    o = bind.table(spark, sf, "orders")
    text = F.expr("""CASE WHEN o_orderpriority = '1-URGENT' THEN 'Table of Contents\\nPart ' || o_orderstatus || ' ..... ' || year(o_orderdate) || '\\n    Page of the order    ' || o_orderkey || '\\n'
        || CASE WHEN o_orderstatus = 'F' THEN 'More .... 7\\n' ELSE '' END || 'no entry' ELSE 'HEAD ' || upper(o_orderstatus) || 'X\\nplain' END""")
    return o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page_num"), text.alias("text"), "o_orderstatus", "o_orderpriority", "o_orderdate")


TOC = """pg AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
ct AS (SELECT o_custkey AS doc_id, min(o_orderkey) AS k FROM pg WHERE r <= 10 AND o_orderpriority = '1-URGENT' GROUP BY ALL),
te AS (SELECT doc_id, year(o_orderdate)::BIGINT AS page_num, 1 AS line_no, 'Part ' || o_orderstatus AS title, 1 AS level, 'toc' AS source FROM ct JOIN orders ON o_orderkey = k
UNION ALL SELECT doc_id, k, 2, 'Page of the order', 2, 'toc' FROM ct UNION ALL SELECT doc_id, 7, 3, 'More', 1, 'toc' FROM ct JOIN orders ON o_orderkey = k WHERE o_orderstatus = 'F')"""


@job(f"WITH {TOC} SELECT * FROM te")
def toc_entries(spark, sf):
    return structure.toc_entries(_toc_pages(spark, sf))


@job(f"""WITH {TOC}, fn AS (SELECT o_custkey AS doc_id, o_orderkey AS page_num, 0 AS line_no, 'font ' || o_orderkey AS title, 1 AS level, 'font' AS source FROM orders WHERE o_totalprice > 450000),
tx AS (SELECT o_custkey AS doc_id, o_orderkey AS page_num, 0 AS line_no, 'Head ' || o_orderstatus || 'x' AS title, 1 AS level, 'allcaps' AS source FROM orders WHERE o_orderpriority <> '1-URGENT'),
al AS (SELECT *, source AS g FROM te UNION ALL SELECT *, source FROM fn UNION ALL SELECT *, 'txt' FROM tx),
pk AS (SELECT doc_id, CASE WHEN count(*) FILTER (g = 'toc') >= 3 THEN 'toc' WHEN count(*) FILTER (g = 'font') > 0 THEN 'font' WHEN count(*) FILTER (g = 'txt') > 0 THEN 'txt' ELSE 'toc' END AS g FROM al GROUP BY ALL)
SELECT al.doc_id, page_num, line_no, title, level, source FROM al JOIN pk USING (doc_id, g)""")
def choose_headings(spark, sf):
    p = _toc_pages(spark, sf)
    font = bind.table(spark, sf, "orders").filter("o_totalprice > 450000").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page_num"), F.lit(0).alias("line_no"), F.concat(F.lit("font "), "o_orderkey").alias("title"), F.lit(1).alias("level"), F.lit("font").alias("source")
    )
    return structure.choose_headings(font, structure.text_headings(p), structure.toc_entries(p))


NR = """pg AS (SELECT o_custkey AS d, o_orderkey AS p, o_orderpriority = '1-URGENT' AS f1, o_orderpriority = '2-HIGH' AS f2, o_orderpriority IN ('1-URGENT', '3-MEDIUM') AS l1, o_orderpriority IN ('2-HIGH', '3-MEDIUM', '5-LOW') AS l2,
    o_orderpriority IN ('3-MEDIUM', '5-LOW') AS l3 FROM orders),
fr AS (SELECT d, 'Forces' AS name, min(p) AS s FROM pg WHERE f1 GROUP BY d UNION ALL SELECT d, 'Mind', min(p) FROM pg WHERE f2 GROUP BY d),
a1 AS (SELECT * FROM fr UNION ALL SELECT d, 'Forces', min(p) FROM pg WHERE l1 AND NOT EXISTS (SELECT 1 FROM fr WHERE fr.d = pg.d AND (name = 'Forces' OR s = p)) GROUP BY d),
a2 AS (SELECT * FROM a1 UNION ALL SELECT d, 'Mind', min(p) FROM pg WHERE l2 AND NOT EXISTS (SELECT 1 FROM a1 WHERE a1.d = pg.d AND (name = 'Mind' OR s = p)) GROUP BY d),
a3 AS (SELECT * FROM a2 UNION ALL SELECT d, 'Prime', min(p) FROM pg WHERE l3 AND NOT EXISTS (SELECT 1 FROM a2 WHERE a2.d = pg.d AND (name = 'Prime' OR s = p)) GROUP BY d)"""


@job(f"WITH {NR} SELECT d AS doc_id, name, s AS page_start, coalesce(lead(s) OVER (PARTITION BY d ORDER BY s), s + 10) AS page_end FROM a3")
def named_ranges(spark, sf):
    text = [
        ("1-URGENT", "Forces\n\nSpecialties: fire\n\n• One"), ("2-HIGH", "intro\n Mind \n• Two ranks"), ("3-MEDIUM", "of Forces, Mind and Prime\n• • Rank\n• Three"), ("5-LOW", "the Mind or Prime\n•  Four"),
    ]
    o = bind.table(spark, sf, "orders")
    p = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page_num"), T.first_in(F.col("o_orderpriority"), text, "Prime without ranks").alias("text"))
    return structure.named_ranges(p, ["Forces", "Mind", "Prime"])
