"""Corpus jobs: segmentation, classification, entities, guidance."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrollwork.functions import fixed, ordered, text as T
from scrollwork.operators import classify, entities, guidance, segments, structure
from scrollwork.plans import bind
from scrollwork.plans.bind import quote, sql_ascii, sql_case, sql_hits, sql_list, sql_slug, sql_strip, sql_total, sql_words
from scrollwork.plans.corpus_jobs import NEST, _sections, intent_sql
from scrollwork.plans.registry import job, table
from scrollwork.session import cut_lineage

S = bind.SEGMENTS_SQL
SPAN = lambda: ordered.steps("seg_no")


# ---- segmentation ----

@job(rf"""WITH {NEST}, own AS (SELECT *, {intent_sql("regexp_replace(title, 'on ', ' credits ')")} AS intent FROM nest)
SELECT doc_id, section_id, intent FROM own c WHERE intent <> 'meta' AND NOT EXISTS
  (SELECT 1 FROM own p WHERE p.doc_id = c.doc_id AND p.section_id = c.parent_id AND p.intent = 'meta')""")
def drop_meta(spark, sf):
    s = structure.nest_sections(_sections(spark, sf))
    s = structure.classify_intent(s.withColumn("title", F.regexp_replace("title", r"^(.*?)on ", "$1 credits ")))
    return segments.drop_meta(s).select("doc_id", "section_id", "intent")


HEADED_SQL = r"""(SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title, url,
    list_filter(regexp_extract_all(html, '<p>([^<]*)', 1), lambda x: x <> '') AS ps FROM pages)"""


def headed(spark, sf):
    """Pages as files: an H1, then every paragraph under an H2 of its first letters, with an H3 note."""
    p = table(spark, sf, "pages")
    ps = F.filter(F.regexp_extract_all("html", F.lit(r"<p>([^<]*)"), 1), lambda x: x != "")
    title = F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1)
    part = lambda x: F.concat(
        F.lit("## "), F.substring(x, 1, 20), F.lit("\n"), x, F.lit("\n### note\n"), F.substring(x, 1, 10)
    )
    return p.select(
        "page_id", "url", title.alias("title"),
        F.concat(F.lit("# "), title, F.lit("\n"), F.array_join(F.transform(ps, part), "\n")).alias("content"),
    )


@job(rf"""WITH p AS (SELECT page_id, title, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM {HEADED_SQL}),
parts AS (SELECT page_id, 2 * i + 1 AS part_no, {sql_strip('left(p, 20)')} AS seg_title, {sql_strip('p')} AS seg_text FROM p
UNION ALL SELECT page_id, 2 * i + 2, 'note', {sql_strip('left(p, 10)')} FROM p
UNION ALL SELECT page_id, 0, title || CASE WHEN len(ps) = 0 THEN '' ELSE ' (Part 1)' END, {sql_strip("'# ' || title")} FROM {HEADED_SQL})
SELECT page_id, part_no::INTEGER AS part_no, seg_title, md5(seg_text) AS digest, {sql_words('seg_text')}::INTEGER AS word_count FROM parts""")
def split_headers(spark, sf):
    out = segments.split_headers(headed(spark, sf))
    return out.select("page_id", "part_no", "seg_title", F.md5("seg_text").alias("digest"), "word_count")


UNITS = rf"""u AS (SELECT doc_id, seg_no, list_filter(list_transform(string_split(content, chr(10)), lambda x: {sql_strip('x')}),
    lambda x: x <> '') AS us FROM {S}),
w AS (SELECT doc_id, seg_no, us, list_transform(us, lambda x: len(regexp_extract_all(x, '\S+'))) AS ws FROM u WHERE len(us) > 0)"""


@job(f"""WITH RECURSIVE {UNITS},
walk AS (SELECT doc_id, seg_no, us, ws, 1 AS i, ws[1] AS cur, 0 AS part FROM w
  UNION ALL SELECT doc_id, seg_no, us, ws, i + 1, CASE WHEN cur + ws[i + 1] > 60 THEN ws[i + 1] ELSE cur + ws[i + 1] END,
    CASE WHEN cur + ws[i + 1] > 60 THEN part + 1 ELSE part END FROM walk WHERE i < len(ws))
SELECT doc_id, seg_no, part AS part_no, md5(string_agg(us[i], chr(10) ORDER BY i)) AS digest, sum(ws[i])::INTEGER AS part_words
FROM walk GROUP BY ALL""")
def pack_units(spark, sf):
    out = segments.pack_units(bind.segments(spark, sf), 60, separator="\n", glue="\n")
    return out.select("doc_id", "seg_no", "part_no", F.md5("part_text").alias("digest"), "part_words")


@job(rf"""WITH w AS (SELECT seg_no, regexp_extract_all(content, '\S+') AS ws FROM {S}),
p AS (SELECT seg_no, ws, unnest(range(0, len(ws), 40)) AS pos FROM w)
SELECT seg_no, (pos // 40)::INTEGER AS part_no, len(ws[pos + 1:pos + 40])::INTEGER AS part_words,
       md5(array_to_string(ws[pos + 1:pos + 40], ' ')) AS digest FROM p""")
def slice_words(spark, sf):
    out = segments.slice_words(bind.segments(spark, sf), 40)
    return out.select("seg_no", "part_no", "part_words", F.md5("part_text").alias("digest"))


LEGAL = [r"\blicensed\b", r"\bpublic\s+license\b", r"\bversion\s+\d+", r"\btoken\b", r"\bgeneral\b", *fixed.BOILERPLATE_PATTERNS]


@job(f"""WITH h AS (SELECT doc_id, seg_no, word_count, {sql_strip('content')} AS body,
    {sql_hits(sql_ascii('lower(content)'), [p.replace('[ãa]', '[xa]') for p in LEGAL])} AS hits FROM {S})
SELECT doc_id, seg_no, hits::INTEGER AS hits, (length(body) < 100 AND NOT regexp_matches(body, '\\p{{Ll}}')
    AND regexp_matches(replace(body, ' ', ''), '^\\pL+$')) OR hits >= 2 OR (hits >= 1 AND word_count < 50) AS dropped FROM h""")
def boilerplate_flags(spark, sf):
    s = bind.segments(spark, sf)
    return s.select(
        "doc_id", "seg_no", segments.boilerplate_hits(T.strip(F.col("content")), LEGAL).alias("hits"),
        segments.is_boilerplate(F.col("content"), F.col("word_count"), LEGAL).alias("dropped"),
    )


@job(f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg_no) AS rn,
    lead(word_count) OVER (PARTITION BY doc_id ORDER BY seg_no) AS next_words,
    lead(content) OVER (PARTITION BY doc_id ORDER BY seg_no) AS next_content FROM {S}),
walk AS (SELECT * FROM n WHERE rn = 1 UNION ALL SELECT n.* FROM walk JOIN n ON n.doc_id = walk.doc_id
    AND n.rn = walk.rn + CASE WHEN walk.word_count < 100 AND walk.next_words IS NOT NULL THEN 2 ELSE 1 END),
m AS (SELECT doc_id, seg_no, CASE WHEN word_count < 100 AND next_words IS NOT NULL THEN 2 ELSE 1 END AS merged,
    CASE WHEN word_count < 100 AND next_words IS NOT NULL THEN word_count + next_words ELSE word_count END AS words,
    CASE WHEN word_count < 100 AND next_words IS NOT NULL THEN content || chr(10) || chr(10) || next_content ELSE content END AS text FROM walk),
over AS (SELECT *, regexp_extract_all(text, '\\S+') AS ws FROM m WHERE merged = 1 AND words > 450),
cut AS (SELECT doc_id, seg_no, ws, unnest(range(0, len(ws), 300)) AS pos FROM over)
SELECT doc_id, seg_no, merged::INTEGER AS merged, NULL::INTEGER AS part_no, words::INTEGER AS word_count, md5(text) AS digest FROM m
WHERE NOT (merged = 1 AND words > 450)
UNION ALL SELECT doc_id, seg_no, 1, (pos // 300)::INTEGER, len(ws[pos + 1:pos + 300])::INTEGER, md5(array_to_string(ws[pos + 1:pos + 300], ' ')) FROM cut""")
def enforce_sizes(spark, sf):
    out = segments.enforce_sizes(bind.segments(spark, sf), lo=100, hi=300)
    return out.select("doc_id", "seg_no", "merged", "part_no", "word_count", F.md5("content").alias("digest"))


@job(f"""SELECT doc_id, seg_no, 'seg_' || CASE WHEN length((row_number() OVER w - 1)::VARCHAR) < 4
    THEN lpad((row_number() OVER w - 1)::VARCHAR, 4, '0') ELSE (row_number() OVER w - 1)::VARCHAR END AS seg_id
FROM {S} WINDOW w AS (PARTITION BY doc_id ORDER BY seg_no)""")
def number_segments(spark, sf):
    return segments.number_segments(bind.segments(spark, sf).select("doc_id", "seg_no"), ["seg_no"], SPAN())


@job(f"""SELECT doc_id, count(*) FILTER (word_count >= 20) AS segments, sum(word_count) FILTER (word_count >= 20)::BIGINT AS total_words,
    (sum(word_count) FILTER (word_count >= 20) // count(*) FILTER (word_count >= 20))::BIGINT AS avg_words,
    count(*) FILTER (word_count < 20) AS filtered FROM {S} GROUP BY doc_id""")
def segment_summary(spark, sf):
    s = bind.segments(spark, sf)
    return segments.segment_summary(s.filter("word_count >= 20"), s.filter("word_count < 20"))


# ---- classification ----

# The prose of these tables is invented, so beside the default rules the jobs count words it does use.
LOCAL_TYPES = [
    ("location", [r"\bthe\b", r"\ble\b", r"\bdans\b"]), ("npc", [r"\bund\b", r"\bder\b", r"\bein\w*"]),
    ("faction", [r"\bque\b", r"\blos\b", r"\bcon\b"]), ("culture", [r"\band\b", r"\bsur\b"]),
    ("item", [r"\btoken\b", r"\blicensed\b", r"\bversion\b"]), ("rules", [r"\b\d+\b", r"\bof\s+the\b"]),
    ("table", [r"\bin\b.*\bto\b"]),
]
TYPES = [(n, p + dict(LOCAL_TYPES)[n]) for n, p in fixed.TYPE_PATTERNS]
DENSE = [*fixed.DENSITY_PATTERNS, r"\b\d+\.\d+", r"\bversion\s+\d", r"\b[0-9a-f]{16,}\b", r"@\w+"]
TXT = sql_ascii("lower(content)")
DENSITY_SQL = f"len(regexp_extract_all({TXT}, {quote('(?i)' + '|'.join(DENSE))})) / greatest(word_count, 1) * 100"


def _scored(order_types):
    score = {n: f"{sql_total(TXT, p)}::DOUBLE" for n, p in order_types}
    return ", ".join(f"{s} AS s_{n}" for n, s in score.items())


HINT = {n: [i for i, ts in fixed.TYPE_HINTS if n in ts] for n in fixed.TYPE_ORDER}
HINTED = ", ".join(
    f"({'s_' + n if n != 'history' else '0.0'} + CASE WHEN intent IN {sql_list(HINT[n])} THEN 2.0 ELSE 0.0 END)::DOUBLE AS h_{n}"
    if HINT[n] else f"s_{n} AS h_{n}" for n in fixed.TYPE_ORDER
)
TOP = "greatest(" + ", ".join(f"h_{n}" for n in fixed.TYPE_ORDER) + ")"
CLASSED = f"""sc AS (SELECT *, {DENSITY_SQL} AS density, {_scored(TYPES)} FROM {S}),
hi AS (SELECT *, {HINTED} FROM sc),
ty AS (SELECT *, CASE WHEN {TOP} <= 0 THEN 'general' {' '.join(f"WHEN h_{n} = {TOP} THEN '{n}'" for n in fixed.TYPE_ORDER)} END AS content_type,
    CASE WHEN {TOP} <= 0 THEN 0.3 ELSE least({TOP} / 5.0, 0.95) END AS conf,
    density + {sql_case('intent', fixed.ROUTE_BIAS, '0.0')} AS adj FROM hi),
cl AS (SELECT doc_id, seg_no, title, content, word_count, intent, density, content_type,
    (CASE WHEN adj > 2 THEN greatest(conf, 0.6) ELSE conf END)::DOUBLE AS confidence,
    CASE WHEN adj > 2 AND content_type IN ('rules', 'table') THEN 'systems' WHEN adj > 0.5 THEN 'both'
         WHEN intent = 'mechanics' THEN 'both' ELSE 'lore' END AS route FROM ty)"""


def classified(spark, sf):
    s = bind.segments(spark, sf)
    d = T.hold(s, {"density": classify.density(F.lower("content"), F.col("word_count"), DENSE)})
    d = classify.apply_hints(classify.type_scores(d, TYPES))
    return classify.route(classify.best_type(d)).drop(*[f"s_{n}" for n in fixed.TYPE_ORDER])


@job(f"SELECT doc_id, seg_no, round({DENSITY_SQL}, 6) AS density FROM {S}")
def pattern_density(spark, sf):
    s = bind.segments(spark, sf)
    return s.select("doc_id", "seg_no", F.round(classify.density(F.lower("content"), F.col("word_count"), DENSE), 6).alias("density"))


@job(f"SELECT seg_no, {_scored(TYPES)} FROM {S}")
def type_scores(spark, sf):
    return classify.type_scores(bind.segments(spark, sf), TYPES).select("seg_no", *[f"s_{n}" for n, _ in TYPES])


@job(f"WITH {CLASSED} SELECT doc_id, seg_no, content_type, round(confidence, 6) AS confidence, route FROM cl")
def classify_segments(spark, sf):
    return classified(spark, sf).select("doc_id", "seg_no", "content_type", F.round("confidence", 6).alias("confidence"), "route")


@job(f"WITH {CLASSED} SELECT doc_id, content_type, route, count(*) AS segments FROM cl GROUP BY ALL")
def route_counts(spark, sf):
    return classify.route_counts(classified(spark, sf))


DEFAULT_CLASSED = CLASSED.replace(DENSITY_SQL, DENSITY_SQL.replace("|".join(DENSE).replace("'", "''"), "|".join(fixed.DENSITY_PATTERNS).replace("'", "''"))).replace(
    _scored(TYPES), _scored(fixed.TYPE_PATTERNS))


@job(f"WITH {DEFAULT_CLASSED} SELECT doc_id, seg_no, content_type, round(confidence, 6) AS confidence, route FROM cl")
def classify_default_rules(spark, sf):
    return classify.classify(bind.segments(spark, sf)).select(
        "doc_id", "seg_no", "content_type", F.round("confidence", 6).alias("confidence"), "route"
    )


@job(f"""WITH {CLASSED} SELECT doc_id, seg_no, (row_number() OVER (PARTITION BY doc_id ORDER BY seg_no) - 1) // 10 AS batch_no,
left(content, 500) AS preview FROM cl WHERE confidence < 0.7""")
def review_queue(spark, sf):
    q = classify.review_queue(classified(spark, sf), ["seg_no"], SPAN())
    return q.select("doc_id", "seg_no", "batch_no", "preview")


VERDICT_SQL = """(SELECT doc_id AS seg_no, CASE quality WHEN 1 THEN 'history' ELSE 'nonsense' END AS content_type,
CASE toxic WHEN 1 THEN 'systems' ELSE 'none' END AS route, CASE WHEN quality = 1 AND toxic = 1 THEN 0.9 END AS confidence FROM labels)"""


@job(f"""WITH {CLASSED}, v AS (SELECT * FROM {VERDICT_SQL}) SELECT cl.seg_no,
CASE WHEN v.content_type IN {sql_list(fixed.CONTENT_TYPES)} THEN v.content_type ELSE cl.content_type END AS content_type,
CASE WHEN v.route IN {sql_list(fixed.ROUTES)} THEN v.route ELSE cl.route END AS route,
round(CASE WHEN v.seg_no IS NOT NULL THEN coalesce(v.confidence, 0.8) ELSE cl.confidence END, 6)::DOUBLE AS confidence
FROM cl LEFT JOIN v USING (seg_no)""")
def apply_verdicts(spark, sf):
    v = table(spark, sf, "labels").select(
        F.col("doc_id").alias("seg_no"),
        F.when(F.col("quality") == 1, "history").otherwise("nonsense").alias("content_type"),
        F.when(F.col("toxic") == 1, "systems").otherwise("none").alias("route"),
        F.when((F.col("quality") == 1) & (F.col("toxic") == 1), 0.9).alias("confidence"),
    )
    return classify.apply_verdicts(classified(spark, sf), v, ["seg_no"]).select(
        "seg_no", "content_type", "route", F.round("confidence", 6).alias("confidence")
    )


# ---- entities ----

ENT = f"""{CLASSED}, en AS (SELECT doc_id, {sql_slug('title')} AS entity_id, title AS name, seg_no,
    CASE WHEN content_type IN ('npc', 'location', 'faction', 'item') THEN {sql_case('content_type', fixed.TYPE_TO_FILE, "'general'")}
    ELSE {sql_case('intent', fixed.INTENT_TO_ENTITY, "'general'")} END AS entity_type FROM cl
    WHERE route IN ('lore', 'both') AND (content_type IN ('npc', 'location', 'faction', 'item')
    OR intent IN {sql_list([i for i, _ in fixed.INTENT_TO_ENTITY])})),
uniq AS (SELECT doc_id, entity_id, arg_min(name, seg_no) AS name, arg_min(entity_type, seg_no) AS entity_type,
    min(seg_no) AS seg_no, count(*) AS mentions FROM en GROUP BY doc_id, entity_id)"""


def found_entities(spark, sf):
    return entities.entities_from_segments(entities.lore_segments(classified(spark, sf)))


@job(f"WITH {ENT} SELECT * FROM en")
def entities_from_segments(spark, sf):
    return found_entities(spark, sf)


@job(f"WITH {ENT} SELECT * FROM uniq")
def dedupe_entities(spark, sf):
    return entities.dedupe_entities(found_entities(spark, sf))


@job(f"WITH {ENT} SELECT doc_id, entity_type, count(*) AS entities FROM uniq GROUP BY ALL")
def entities_by_type(spark, sf):
    return entities.entities_by_type(entities.dedupe_entities(found_entities(spark, sf)))


@job(f"""WITH {ENT}, r AS (SELECT doc_id, entity_id, [entity_type, 'kin_' || left(entity_id, 3)] ||
    CASE WHEN mentions > 1 THEN [entity_id] ELSE [] END AS related FROM uniq)
SELECT cl.doc_id, cl.seg_no, array_to_string(CASE WHEN related IS NULL THEN [] WHEN list_contains(related, entity_id) THEN related
    ELSE [entity_id] || related END, ',') AS entity_refs
FROM cl LEFT JOIN r ON r.doc_id = cl.doc_id AND r.entity_id = {sql_slug('title')}""")
def attach_refs(spark, sf):
    # both sides of the join read the classified segments: written once, without their texts
    c = cut_lineage(classified(spark, sf).select("doc_id", "seg_no", "title", "content_type", "intent", "route"))
    e = entities.dedupe_entities(entities.entities_from_segments(entities.lore_segments(c)))
    rel = F.array("entity_type", F.concat(F.lit("kin_"), F.substring("entity_id", 1, 3)))
    e = e.withColumn("related", F.when(F.col("mentions") > 1, F.concat(rel, F.array("entity_id"))).otherwise(rel))
    return entities.attach_refs(c, e).select("doc_id", "seg_no", F.array_join("entity_refs", ",").alias("entity_refs"))


@job(f"SELECT seg_no, CASE WHEN word_count < 50 THEN 'small' WHEN word_count > 3000 THEN 'large' ELSE 'ok' END AS size_flag FROM {S}")
def size_flags(spark, sf):
    return entities.size_flags(bind.segments(spark, sf)).select("seg_no", "size_flag")


@job(f"""SELECT seg_no, array_to_string(list_sort(list_distinct([s.intent, s.doc_id] ||
    CASE WHEN quality IS NULL THEN [] ELSE ['q' || quality, s.intent] END)), ',') AS tags
FROM {S} s LEFT JOIN labels l ON l.doc_id = s.seg_no""")
def merge_tags(spark, sf):
    s = bind.segments(spark, sf)
    files = s.select("seg_no", "intent", F.array("intent", "doc_id").alias("tags"))
    back = files.join(table(spark, sf, "labels").withColumnRenamed("doc_id", "seg_no"), "seg_no").select(
        "seg_no", F.array(F.concat(F.lit("q"), "quality"), "intent").alias("tags")
    )
    return entities.merge_tags(files, back, ["seg_no"]).select("seg_no", F.array_join("tags", ",").alias("tags"))


@job(f"""SELECT doc_id, seg_no, (row_number() OVER (PARTITION BY doc_id ORDER BY seg_no) - 1) // 20 AS batch_no FROM {S}""")
def annotation_batches(spark, sf):
    s = bind.segments(spark, sf).select("doc_id", "seg_no")
    return entities.annotation_batches(s, ["seg_no"], SPAN())


FILES = f"""{CLASSED}, fl AS (SELECT doc_id, seg_no, title, {sql_case('content_type', fixed.TYPE_TO_FILE, "'general'")} AS file_type,
    confidence, word_count FROM cl WHERE route IN ('lore', 'both')),
placed AS (SELECT *, {sql_case('file_type', fixed.FILE_DIRS, "'culture'")} AS dir FROM fl)"""


def files(spark, sf):
    f = entities.lore_segments(classified(spark, sf))
    return f.withColumn("file_type", T.first_in(F.col("content_type"), fixed.TYPE_TO_FILE, "general"))


@job(f"""WITH {FILES} SELECT doc_id, dir || '/' || {sql_slug('title')} || '.md' AS path, max(seg_no) AS seg_no, count(*) AS written
FROM placed GROUP BY ALL""")
def place_files(spark, sf):
    return entities.place_files(files(spark, sf)).select("doc_id", "path", "seg_no", "written")


@job(f"""WITH {FILES} SELECT doc_id, dir, count(*) AS files, count(*) FILTER (confidence < 0.5) AS low_confidence FROM placed GROUP BY ALL""")
def review_summary(spark, sf):
    return entities.review_summary(files(spark, sf))


@job(f"WITH {FILES} SELECT doc_id, title, file_type, round(confidence, 6) AS confidence FROM fl WHERE confidence < 0.5")
def low_confidence_files(spark, sf):
    return entities.low_confidence(files(spark, sf)).withColumn("confidence", F.round("confidence", 6))


# parts are entities; an order is a file that refers to the parts on its lines
PART_ENT_SQL = """(SELECT 'part_' || p_partkey AS entity_id, p_name AS name,
    CASE p_type WHEN 'ECONOMY' THEN 'npc' WHEN 'SMALL' THEN 'location' WHEN 'STANDARD' THEN 'faction' ELSE 'general' END AS entity_type FROM part)"""
ORDER_FILE_SQL = """(SELECT l_orderkey AS file_no, 'part_' || l_partkey AS ref, sum(l_quantity) OVER (PARTITION BY l_orderkey)::BIGINT AS word_count FROM lineitem)"""


def part_entities(spark, sf):
    kinds = [("ECONOMY", "npc"), ("SMALL", "location"), ("STANDARD", "faction")]
    return table(spark, sf, "part").select(
        F.lit("catalog").alias("doc_id"), F.concat(F.lit("part_"), "p_partkey").alias("entity_id"),
        F.col("p_name").alias("name"), T.first_in(F.col("p_type"), kinds, "general").alias("entity_type"),
        F.concat_ws(" ", "p_brand", "p_type").alias("description"),
    )


def order_files(spark, sf):
    """Lines per order are a handful, so an order's references fit one row."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("file_no")).agg(
        F.collect_set(F.concat(F.lit("part_"), "l_partkey")).alias("entity_refs"),
        F.sum("l_quantity").cast("bigint").alias("word_count"),
    )
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("file_no"), F.concat(F.lit("part_"), "o_orderkey").alias("entity_id")
    )
    d = li.join(o, "file_no", "left").withColumn("entity_id", F.coalesce("entity_id", F.lit("")))
    return d.withColumn("doc_id", F.lit("catalog"))


@job(f"SELECT ref AS entity_id, count(DISTINCT file_no) AS files, min(file_no) AS first_file FROM {ORDER_FILE_SQL} GROUP BY ALL")
def ref_index(spark, sf):
    return entities.ref_index(order_files(spark, sf)).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("files"), F.min("file_no").alias("first_file")
    )


PROMOTED = f"""pr AS (SELECT entity_id, name, entity_type, count(*) AS excerpts, sum(word_count)::BIGINT AS words, min(file_no) AS first_file
FROM {PART_ENT_SQL} JOIN (SELECT DISTINCT file_no, ref, word_count FROM {ORDER_FILE_SQL}) ON ref = entity_id
WHERE entity_type IN ('npc', 'location', 'faction', 'item') AND entity_id NOT IN (SELECT 'part_' || o_orderkey FROM orders
    JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P')
GROUP BY ALL HAVING sum(word_count) >= 1000)"""


@job(f"WITH {PROMOTED} SELECT * FROM pr")
def promoted_entities(spark, sf):
    return entities.promoted_entities(part_entities(spark, sf), order_files(spark, sf), least=1000).drop("doc_id", "description")


@job(f"""WITH {PROMOTED} SELECT entity_id, -1::BIGINT AS file_no, p_brand || ' ' || p_type AS body FROM pr JOIN part ON entity_id = 'part_' || p_partkey
UNION ALL SELECT DISTINCT entity_id, file_no, 'order of ' || word_count FROM pr JOIN {ORDER_FILE_SQL} f ON f.ref = pr.entity_id""")
def promoted_excerpts(spark, sf):
    f = order_files(spark, sf).withColumn("body", F.concat(F.lit("order of "), "word_count"))
    p = entities.promoted_entities(part_entities(spark, sf), f, least=1000)
    return entities.promoted_excerpts(p, f).select("entity_id", "file_no", "body")


# ---- guidance ----

PHRASES = ["the ", "und ", "que ", *fixed.GUIDANCE_PHRASES]
RULES = [
    (r"\b(licensed|license)\b", "license_line", 0.8), (r"\b(the|and)\s+(of|in|to)\b", "filler", 0.5),
    (r"\b(der|die|und)\b", "german", 0.6), (r"\b(los|que|con)\b", "spanish", 0.6), *fixed.GUIDANCE_RULES,
]
GENERAL = [r"\bof\s+the\b", r"\bto\s+the\b", *fixed.UNIVERSAL_PATTERNS]
SPECIAL = [r"\bin\s+the\b", r"\d{4,}", *fixed.SPECIFIC_PATTERNS]
PARA_ASCII = sql_ascii("para")
_conf = [
    f"CASE WHEN len(regexp_extract_all({PARA_ASCII}, {quote('(?i)' + p)})) > 0 THEN round(least({b}::DOUBLE + "
    f"len(regexp_extract_all({PARA_ASCII}, {quote('(?i)' + p)})) * 0.05::DOUBLE, 0.95), 4) ELSE 0.0 END::DOUBLE"
    for p, _, b in RULES
]
GUIDE = f"""{CLASSED}, gs AS (SELECT * FROM cl WHERE route <> 'systems' AND (
    {' OR '.join(f"contains(lower(title), {quote(p)})" for p in PHRASES)})),
pa AS (SELECT doc_id, seg_no, unnest(range(len(string_split(content, chr(10)))))::INTEGER AS para_no,
    unnest(string_split(content, chr(10))) AS raw FROM gs),
ps AS (SELECT doc_id, seg_no, para_no, {sql_strip('raw')} AS para FROM pa),
pc AS (SELECT *, [{', '.join(_conf)}] AS c FROM ps WHERE length(para) >= 50),
gc AS (SELECT doc_id, seg_no, para_no, para, list_max(c) AS confidence,
    {'[' + ', '.join(quote(m) for _, m, _ in RULES) + ']'}[list_position(c, list_max(c))] AS category,
    {sql_hits(sql_ascii('lower(para)'), GENERAL)} AS g, {sql_hits(sql_ascii('lower(para)'), SPECIAL)} AS s
    FROM pc WHERE list_max(c) >= 0.5)"""


def guide(spark, sf):
    segs = classified(spark, sf).withColumn("source_section", F.col("doc_id"))
    ch = guidance.guidance_chunks(guidance.guidance_segments(segs, PHRASES), RULES, separator="\n")
    return guidance.universal_flag(ch, general=GENERAL, special=SPECIAL)


@job(f"WITH {GUIDE} SELECT seg_no, route FROM gs")
def guidance_segments(spark, sf):
    segs = classified(spark, sf).withColumn("source_section", F.col("doc_id"))
    return guidance.guidance_segments(segs, PHRASES).select("seg_no", "route")


@job(f"WITH {GUIDE} SELECT seg_no, para_no, category, confidence, g > s AND g > 0 AS is_universal FROM gc")
def guidance_chunks(spark, sf):
    return guide(spark, sf).select("seg_no", "para_no", "category", "confidence", "is_universal")


@job(f"""WITH {GUIDE} SELECT doc_id, category, seg_no, para_no,
row_number() OVER (PARTITION BY doc_id, category ORDER BY confidence DESC, seg_no, para_no) AS place FROM gc""")
def guidance_by_category(spark, sf):
    return guidance.guidance_by_category(guide(spark, sf)).select("doc_id", "category", "seg_no", "para_no", "place")


@job(f"""WITH {GUIDE} SELECT category, g > s AND g > 0 AS is_universal, count(*) AS chunks, max(confidence) AS best_confidence FROM gc GROUP BY ALL""")
def guidance_counts(spark, sf):
    return guidance.guidance_counts(guide(spark, sf))
