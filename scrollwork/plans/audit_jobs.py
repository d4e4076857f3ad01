"""Evaluation, audit and probe jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrollwork.functions import fixed, text as T
from scrollwork.operators import annotate, audit, chunks, evaluation, retrieval
from scrollwork.plans import bind
from scrollwork.plans.bind import quote, sql_ascii, sql_case, sql_hits, sql_list, sql_strip, sql_words
from scrollwork.plans.log_jobs import conv, k
from scrollwork.plans.registry import job, table
from scrollwork.session import scratch, spread
from scrollwork.plans.retrieval_jobs import TOKENS, doc_chunks, order_chunks, web_files
from scrollwork.plans.segment_jobs import HEADED_SQL, LEGAL

# ---- evaluation ----


def turn_rows(spark, sf):
    c = conv(spark, sf)
    return c.withColumn("proposed", T.filled_lines(F.col("final_text"))).withColumn(
        "outcomes", F.when(F.col("role") == "user", F.array(F.lit("mixed"), F.lit("success"))).otherwise(F.array(F.col("role")))
    )


contains = lambda ws: "(" + " OR ".join(f"contains(lower(text), {quote(w)})" for w in ws) + ")"


@job(f"""SELECT conv_id AS campaign_id, turn AS turn_no, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> ''))::INTEGER AS actions_proposed,
CASE role WHEN 'user' THEN 2 ELSE 1 END::INTEGER AS roll_count, length(text)::INTEGER AS narrative_length, regexp_matches(text, '["'']') AS has_dialogue,
{contains(fixed.DESCRIPTION_WORDS)} AS has_description, {contains(fixed.CONSEQUENCE_WORDS)} AS has_consequence FROM conversations""")
def turn_metrics(spark, sf):
    m = evaluation.turn_metrics(turn_rows(spark, sf))
    return m.select("campaign_id", "turn_no", "actions_proposed", "roll_count", "narrative_length", "has_dialogue", "has_description", "has_consequence")


def metric_rows(spark, sf):
    m = evaluation.turn_metrics(turn_rows(spark, sf))
    return m.withColumn("total_ms", F.length("final_text") * 1.5).withColumn("clarification_needed", F.col("role") == "system")


@job("""SELECT conv_id AS campaign_id, count(*) AS turns, round_even(avg(length(text) * 1.5), 2)::DOUBLE AS avg_latency_ms,
round_even(avg((role = 'system')::INTEGER), 2)::DOUBLE AS clarification_rate, round_even(avg(length(text)), 0)::DOUBLE AS avg_narrative_length FROM conversations GROUP BY ALL""")
def metrics_summary(spark, sf):
    return evaluation.metrics_summary(metric_rows(spark, sf))


@job("SELECT conv_id AS campaign_id, o AS outcome, count(*) AS n FROM (SELECT conv_id, unnest(CASE role WHEN 'user' THEN ['mixed', 'success'] ELSE [role] END) AS o FROM conversations) GROUP BY ALL")
def outcome_counts(spark, sf):
    return evaluation.outcome_counts(turn_rows(spark, sf))


FEED_SQL = """(SELECT source AS campaign_id, l.doc_id AS turn_no, CASE quality WHEN 1 THEN 'thumbs_up' ELSE 'thumbs_down' END AS feedback_type, 'v' AS value FROM labels l JOIN documents d ON d.doc_id = l.doc_id
UNION ALL SELECT source, l.doc_id, 'flag_issue', lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE toxic = 1)"""


def feedback(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    j = table(spark, sf, "labels").join(d, "doc_id")
    key = [F.col("source").alias("campaign_id"), F.col("doc_id").alias("turn_no")]
    vote = j.select(*key, F.when(F.col("quality") == 1, "thumbs_up").otherwise("thumbs_down").alias("feedback_type"), F.lit("v").alias("value"))
    return vote.unionAll(j.filter("toxic = 1").select(*key, F.lit("flag_issue"), "lang"))


@job(f"""WITH g AS (SELECT campaign_id, count(*) AS total, count(*) FILTER (feedback_type = 'thumbs_up') AS positive, count(*) FILTER (feedback_type = 'thumbs_down') AS negative FROM {FEED_SQL} GROUP BY ALL)
SELECT *, round_even(positive / (positive + negative), 2)::DOUBLE AS ratio FROM g""")
def feedback_summary(spark, sf):
    return evaluation.feedback_summary(feedback(spark, sf))


@job(f"SELECT campaign_id, feedback_type, count(*) AS n, max(turn_no) AS last_turn FROM {FEED_SQL} GROUP BY ALL")
def feedback_by_type(spark, sf):
    return evaluation.feedback_by_type(feedback(spark, sf))


@job(f"""WITH i AS (SELECT campaign_id, turn_no, 0 AS o, 'flagged: ' || value AS issue FROM {FEED_SQL} WHERE feedback_type = 'flag_issue'
UNION ALL SELECT campaign_id, turn_no, 1, 'thumbs_down' FROM {FEED_SQL} WHERE feedback_type = 'thumbs_down' UNION ALL SELECT source, doc_id, 2, 'needed_clarification' FROM documents WHERE n_chars < 200)
SELECT campaign_id, turn_no, string_agg(issue, '; ' ORDER BY o, issue) AS issues FROM i GROUP BY ALL""")
def problem_turns(spark, sf):
    d = table(spark, sf, "documents")
    m = d.select(F.col("source").alias("campaign_id"), F.col("doc_id").alias("turn_no"), (F.col("n_chars") < 200).alias("clarification_needed"))
    return evaluation.problem_turns(feedback(spark, sf), m).withColumn("issues", F.array_join("issues", "; "))


def rerun(spark, sf):
    c = conv(spark, sf)
    text = F.when(F.col("role") == "user", F.col("final_text")).otherwise(F.concat(F.substring("final_text", 1, 250), F.lit(" end")))
    return c.withColumn("final_text", text).withColumn("latency_ms", F.length("final_text"))


RERUN = "CASE role WHEN 'user' THEN text ELSE left(text, 250) || ' end' END"


@job(f"""SELECT conv_id AS campaign_id, turn AS turn_no, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS original,
CASE WHEN length({RERUN}) > 200 THEN left({RERUN}, 200) || '...' ELSE {RERUN} END AS replay, text = {RERUN} AS matches, length({RERUN})::INTEGER AS latency_ms FROM conversations""")
def compare_runs(spark, sf):
    return evaluation.compare_runs(conv(spark, sf), rerun(spark, sf))


@job(f"SELECT conv_id AS campaign_id, turn AS turn_no, text AS output_a, {RERUN} AS output_b FROM conversations WHERE role <> 'system'")
def ab_pairs(spark, sf):
    return evaluation.ab_pairs(conv(spark, sf), rerun(spark, sf).filter("role <> 'system'"))


# ---- audit ----

DIRS = [("en", "locations"), ("fr", "npcs"), ("de", "culture"), ("es", "factions")]


def audit_files(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    return d.select(
        F.col("source").alias("doc_id"), F.col("doc_id").alias("file_no"), T.first_in(F.col("lang"), DIRS).alias("dir"), F.col("text").alias("body"),
        T.word_count(F.col("text")).alias("words"), F.col("lang").alias("file_type"),
    )


FILE_SQL = f"(SELECT source AS doc_id, doc_id AS file_no, {sql_case('lang', DIRS)} AS dir, text AS body, {sql_words('text')} AS words, lang AS file_type FROM documents)"


@job(f"""WITH a AS (SELECT source AS doc_id, count(*) AS pages, sum({sql_words('text')})::BIGINT AS source_words, count(*) FILTER ({sql_words('text')} >= 50) AS segments,
coalesce(sum({sql_words('text')}) FILTER ({sql_words('text')} >= 50), 0)::BIGINT AS segment_words FROM documents GROUP BY ALL),
c AS (SELECT doc_id, count(*) AS files, sum(words)::BIGINT AS corpus_words FROM {FILE_SQL} GROUP BY ALL)
SELECT a.*, coalesce(files, 0) AS files, coalesce(corpus_words, 0) AS corpus_words, round(segments / pages, 4) AS segments_per_page, round(coalesce(corpus_words, 0) / source_words * 100, 4) AS retention_pct FROM a LEFT JOIN c USING (doc_id)""")
def audit_totals(spark, sf):
    p = table(spark, sf, "documents").select(F.col("source").alias("doc_id"), T.word_count(F.col("text")).alias("words"))
    return audit.audit_totals(p, p.filter("words >= 50"), audit_files(spark, sf))


CONC = f"cn AS (SELECT doc_id, dir, count(*) AS files, round(count(*) / sum(count(*)) OVER (PARTITION BY doc_id) * 100, 4) AS share_pct FROM {FILE_SQL} GROUP BY doc_id, dir)"


@job(f"WITH {CONC} SELECT *, share_pct > 50 AS concentrated FROM cn")
def concentration(spark, sf):
    return audit.concentration(audit_files(spark, sf), 50.0)


@job("""SELECT 'c' || c_custkey AS entity_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_orderkey // 10 FROM orders WHERE o_orderstatus = 'F')""")
def orphans(spark, sf):
    e = table(spark, sf, "customer").select(F.lit("all").alias("doc_id"), F.concat(F.lit("c"), "c_custkey").alias("entity_id"))
    f = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        F.lit("all").alias("doc_id"), F.array(F.concat(F.lit("c"), "o_custkey")).alias("entity_refs"), F.concat(F.lit("c"), F.floor(F.col("o_orderkey") / 10)).alias("entity_id")
    )
    return audit.orphans(e, f).select("entity_id")


@job(f"""SELECT DISTINCT f.doc_id, d AS dir FROM {FILE_SQL} f, unnest({'[' + ', '.join(quote(d) for d in fixed.EXPECTED_DIRS) + ']'}) t(d)
WHERE NOT EXISTS (SELECT 1 FROM {FILE_SQL} g WHERE g.doc_id = f.doc_id AND g.dir = d)""")
def missing_dirs(spark, sf):
    return audit.missing_dirs(audit_files(spark, sf))


@job(f"""SELECT file_no, strlen(body)::INTEGER AS bytes, CASE WHEN strlen(body) < 500 THEN 'stub' WHEN {sql_hits(sql_ascii('body'), ['(?i)' + p for p in LEGAL])} > 0 THEN 'non_content' ELSE 'ok' END AS flag FROM {FILE_SQL}""".replace("[ãa]", "[xa]"))
def content_flags(spark, sf):
    return audit.content_flags(audit_files(spark, sf), patterns=LEGAL).select("file_no", "bytes", "flag")


TERM_SQL = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"
SPOT = rf"""sp AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS r FROM documents),
tm AS (SELECT source, doc_id, list_filter(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '{TERM_SQL}', 1), lambda x: length(x) > 5) AS ts FROM sp WHERE r <= 25),
tl AS (SELECT source, doc_id, list_filter(ts, lambda x, i: list_position(ts, x) = i)[1:10] AS ts FROM tm),
tx AS (SELECT source, doc_id, unnest(ts) AS term FROM tl),
fo AS (SELECT DISTINCT source, term FROM tx t WHERE EXISTS (SELECT 1 FROM {FILE_SQL} f WHERE f.doc_id = t.source AND contains(lower(f.body), lower(term)))),
sc AS (SELECT tl.source AS doc_id, tl.doc_id AS page_num, count(tx.term) AS terms, count(fo.term) AS found FROM tl LEFT JOIN tx ON tx.doc_id = tl.doc_id LEFT JOIN fo ON fo.source = tl.source AND fo.term = tx.term GROUP BY ALL)"""


def spots(spark, sf):
    return audit.spot_check(audit.spot_terms(bind.doc_pages(spark, sf), 25), audit_files(spark, sf))


@job(f"WITH {SPOT} SELECT *, CASE WHEN terms > 0 THEN round(found / terms * 100, 4) ELSE 0.0 END::DOUBLE AS coverage_pct FROM sc")
def spot_check(spark, sf):
    # the report samples pages at random; the sample here is the lowest hashes, as the operator defines it
    return spots(spark, sf)


@job(f"""WITH {CONC}, s AS (SELECT doc_id, max(share_pct) AS top FROM cn GROUP BY ALL),
f AS (SELECT doc_id, count(*) FILTER (strlen(body) < 500) AS stubs, sum(words) AS w FROM {FILE_SQL} GROUP BY ALL),
a AS (SELECT source AS doc_id, sum({sql_words('text')}) AS sw, count(*) FILTER ({sql_words('text')} >= 500) / count(*) AS spp FROM documents GROUP BY ALL),
r AS (SELECT doc_id, round(coalesce(w, 0) / sw * 100, 4) AS ret, coalesce(stubs, 0) AS stubs, coalesce(top, 0) AS top, round(spp, 4) AS spp FROM a LEFT JOIN f USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT doc_id, 'low_retention' AS issue, ret::DOUBLE AS value FROM r WHERE ret > 0 AND ret < 30 UNION ALL SELECT doc_id, 'concentration', top FROM r WHERE top > 60
UNION ALL SELECT doc_id, 'many_stubs', stubs::DOUBLE FROM r WHERE stubs > 5 UNION ALL SELECT doc_id, 'low_density', spp FROM r WHERE spp > 0 AND spp < 0.3
UNION ALL SELECT doc_id, 'empty_directories', {len(set(fixed.EXPECTED_DIRS) - {d for _, d in DIRS})} FROM r""")
def audit_issues(spark, sf):
    p = table(spark, sf, "documents").select(F.col("source").alias("doc_id"), T.word_count(F.col("text")).alias("words"))
    f = audit_files(spark, sf)
    tot = audit.audit_totals(p, p.filter("words >= 500"), f)
    top = audit.concentration(f).groupBy("doc_id").agg(F.max("share_pct").alias("top_share_pct"))
    stubs = audit.content_flags(f).groupBy("doc_id").agg(F.count(F.when(F.col("flag") == "stub", 1)).alias("stubs"))
    gone = audit.missing_dirs(f).groupBy("doc_id").agg(F.count(F.lit(1)).alias("empty_dirs"))
    r = tot.join(top, "doc_id", "left").join(stubs, "doc_id", "left").join(gone, "doc_id", "left").fillna(0)
    r = r.withColumns({"orphans": F.lit(0), "non_content": F.lit(0), "spot_coverage": F.lit(0.0)})
    return audit.audit_issues(r)


@job("""WITH m AS (SELECT c_custkey AS p, CASE WHEN c_acctbal > 0 THEN 'x' ELSE '' END AS id, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END AS name FROM customer)
SELECT p AS pack_id, 'manifest_without_id' AS issue, 1::BIGINT AS n FROM m WHERE id = '' UNION ALL SELECT p, 'manifest_without_name', 1 FROM m WHERE name IS NULL
UNION ALL SELECT o_custkey, 'front_matter_not_a_map', count(*) FROM orders WHERE o_orderstatus <> 'O' AND o_totalprice < 100000 GROUP BY o_custkey
UNION ALL SELECT o_custkey, 'missing_title', count(*) FROM orders WHERE o_orderstatus <> 'O' AND o_totalprice >= 100000 AND o_orderpriority = '5-LOW' GROUP BY o_custkey
UNION ALL SELECT p, 'no_files', 1 FROM m WHERE p NOT IN (SELECT o_custkey FROM orders)""")
def validate_corpus(spark, sf):
    m = table(spark, sf, "customer").select(F.col("c_custkey").alias("pack_id"), F.when(F.col("c_acctbal") > 0, "x").otherwise("").alias("id"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).alias("name"))
    f = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("pack_id"), (F.col("o_orderstatus") != "O").alias("has_front"), (F.col("o_totalprice") >= 100000).alias("front_is_map"),
        F.when(F.col("o_orderpriority") != "5-LOW", "t").otherwise("").alias("title"),
    )
    return audit.validate_corpus(f, m)


@job(rf"""WITH t AS (SELECT source, doc_id, regexp_extract_all(text, '\S+')[2:4] AS ws, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
q AS (SELECT source, source || '#' || r AS qid, unnest(ws) AS w FROM t WHERE r <= 3),
p AS (SELECT DISTINCT source, qid, trim(regexp_replace(lower(w), '[^\pL\pN]+', ' ', 'g')) AS ph FROM q WHERE regexp_matches(w, '[\pL\pN]')),
d AS (SELECT source, ' ' || trim(regexp_replace(lower(text), '[^\pL\pN]+', ' ', 'g')) || ' ' AS n FROM documents)
SELECT t.source AS pack_id, count(*) AS queries, count(*) FILTER (EXISTS (SELECT 1 FROM p JOIN d ON d.source = p.source AND contains(n, ' ' || ph || ' ') WHERE p.qid = t.source || '#' || r)) AS with_results
FROM t WHERE r <= 3 GROUP BY ALL""")
def retrieval_check(spark, sf):
    d = doc_chunks(spark, sf)
    files = d.select("pack_id", F.col("chunk_id").alias("path"), F.array_join(F.slice(T.word_array(F.col("content")), 2, 3), " ").alias("title"))
    q = audit.title_queries(files)
    hits = retrieval.keyword_search(q, d, 15, within=["pack_id"])
    return audit.retrieval_check(q, hits)


@job(f"""SELECT 'file' AS kind, lang AS type, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'chunk', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 'entity', c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment""")
def distribution(spark, sf):
    return audit.distribution(
        table(spark, sf, "documents").select(F.col("lang").alias("file_type")), table(spark, sf, "orders").select(F.col("o_orderpriority").alias("chunk_type")),
        table(spark, sf, "customer").select(F.col("c_mktsegment").alias("entity_type")),
    )


@job("""WITH r AS (SELECT c_custkey, c_mktsegment, c_name, count(o_orderkey) AS refs, coalesce(sum(floor(o_totalprice / 1000)::BIGINT), 0)::BIGINT AS tokens FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY refs DESC, 'c' || c_custkey) AS place FROM r)
SELECT 'c' || c_custkey AS entity_id, c_mktsegment AS entity_type, refs, place::INTEGER AS place, refs AS chunk_count, tokens,
(SELECT array_to_string(list_sort(list_distinct(list(t)))[1:4], ',') FROM (SELECT unnest([o_orderpriority, o_orderstatus]) AS t FROM orders WHERE o_custkey = c_custkey)) AS tags, 'a,b' AS related FROM p WHERE place <= 3""")
def entity_samples(spark, sf):
    e = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("entity_type"), F.array(*[F.lit(x) for x in "abc"]).alias("related"))
    o = table(spark, sf, "orders")
    c = order_chunks(spark, sf).join(o.select(F.concat(F.lit("o"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("chunk_id"), F.array("o_orderpriority", "o_orderstatus").alias("tags"), F.floor(F.col("o_totalprice") / 1000).alias("token_estimate")), "chunk_id")
    s = audit.entity_samples(e, c, tags=4, related=2)
    return s.select("entity_id", "entity_type", "refs", "place", "chunk_count", "tokens", F.array_join("tags", ",").alias("tags"), F.array_join("related", ",").alias("related"))


# ---- probes ----

SPOKEN = [("en", "the"), ("fr", "le"), ("de", "der"), ("es", "los")]


def probe_side(spark, sf):
    c = doc_chunks(spark, sf).withColumn("entity_refs", F.array("lang")).withColumn("tags", F.array(F.lit("general"), F.col("pack_id")))
    e = c.select(F.col("lang").alias("entity_id")).distinct().withColumn("name", T.first_in(F.col("entity_id"), SPOKEN)).withColumn("entity_type", F.col("entity_id"))
    q = audit.probe_queries(e, c)
    hits = retrieval.keyword_search(q, c, 20)
    kept = retrieval.budget_cap(retrieval.merge_candidates(hits).join(c.select("chunk_id", "token_estimate"), "chunk_id"), 2000, 10)
    return c, e, q, kept


PROBE = rf"""{TOKENS}, q AS (SELECT 'e:' || lang AS qid, {sql_case('lang', SPOKEN)} AS term FROM (SELECT DISTINCT lang FROM documents)
UNION ALL SELECT 't:' || source, source FROM (SELECT source, count(*) AS n FROM documents GROUP BY ALL ORDER BY n DESC, source LIMIT 5)),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM ps WHERE term IN (SELECT term FROM q) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM tk),
df AS (SELECT term, greatest(ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 1e-6::DOUBLE) AS idf FROM tf, st GROUP BY term, n),
sc AS (SELECT qid, doc_id, round(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)), 6) AS score FROM q JOIN df USING (term) JOIN tf USING (term), st),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS place FROM sc),
us AS (SELECT qid, doc_id, place, tok, sum(tok) OVER (PARTITION BY qid ORDER BY place ROWS UNBOUNDED PRECEDING) AS used FROM rk
  JOIN (SELECT doc_id, floor({sql_words('text')} * 1.33::DOUBLE)::INTEGER AS tok FROM documents) USING (doc_id) WHERE place <= 10),
kept AS (SELECT * FROM us WHERE place = 1 OR used <= 2000),
pr AS (SELECT q.qid, count(k.doc_id) AS chunks_found, coalesce(sum(tok), 0)::BIGINT AS tokens FROM q LEFT JOIN kept k USING (qid) GROUP BY q.qid)"""


@job(f"WITH {PROBE} SELECT qid AS query_id, chunks_found, tokens, chunks_found > 0 AS passed FROM pr")
def probes(spark, sf):
    c, e, q, kept = probe_side(spark, sf)
    return audit.probe_results(q, kept)


PSTAT = f"{PROBE}, ps2 AS (SELECT count(*) AS probes, round(avg((chunks_found > 0)::INTEGER), 4)::DOUBLE AS hit_rate, round((SELECT count(DISTINCT doc_id) FROM kept) / (SELECT count(*) FROM documents), 6)::DOUBLE AS coverage FROM pr)"


@job(f"WITH {PSTAT} SELECT * FROM ps2")
def probe_stats(spark, sf):
    c, e, q, kept = probe_side(spark, sf)
    return audit.probe_stats(audit.probe_results(q, kept), kept, c)


@job(f"""WITH {PSTAT}, r AS (SELECT DISTINCT 'type_without_files' AS issue, lang AS subject, 1::BIGINT AS n FROM documents WHERE lang NOT IN (SELECT file_type FROM {FILE_SQL}) UNION ALL SELECT 'chunks_without_refs', NULL, count(*) FROM documents WHERE lang = 'de'
UNION ALL SELECT 'small_files', NULL, count(*) FROM {FILE_SQL} WHERE words < 50 UNION ALL SELECT 'large_files', NULL, count(*) FROM {FILE_SQL} WHERE words > 3000
UNION ALL SELECT 'low_coverage', NULL, CASE WHEN coverage < 0.2 THEN floor(coverage * 100)::BIGINT + 1 ELSE 0 END FROM ps2 UNION ALL SELECT 'probes_without_hits', NULL, round((1 - hit_rate) * probes)::BIGINT FROM ps2)
SELECT * FROM r WHERE n > 0""")
def corpus_issues(spark, sf):
    c, e, q, kept = probe_side(spark, sf)
    stats = audit.probe_stats(audit.probe_results(q, kept), kept, c)
    bare = c.withColumn("entity_refs", F.when(F.col("lang") == "de", F.array().cast("array<string>")).otherwise(F.col("entity_refs")))
    return audit.corpus_issues(audit_files(spark, sf), bare, e, stats)


@job("SELECT p_partkey FROM part WHERE replace(lower(p_name), ' ', '') = CASE WHEN p_type = 'SMALL' THEN replace(p_name, ' ', '') ELSE p_brand END")
def name_is_id(spark, sf):
    p = table(spark, sf, "part")
    m = p.select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_type") == "SMALL", F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.col("p_brand")).alias("pack_id"))
    return audit.name_is_id(m).select("p_partkey")


@job("""WITH c AS (SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'O') AS op, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'P') AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_custkey AS campaign_id, 'no_player' AS issue, 0::DOUBLE AS value FROM c WHERE p = 0 UNION ALL SELECT c_custkey, 'no_scene', 0 FROM c WHERE f = 0
UNION ALL SELECT c_custkey, 'too_few_counters', n FROM c WHERE n < 8 UNION ALL SELECT c_custkey, 'no_open_thread', 0 FROM c WHERE op = 0""")
def check_state(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "campaign_id")
    ents = o.select("campaign_id", F.when(F.col("o_orderstatus") == "P", "player").otherwise("other").alias("entity_id"))
    th = o.select("campaign_id", F.when(F.col("o_orderstatus") == "O", "active").otherwise("closed").alias("status"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("campaign_id"))
    return audit.check_state(c, ents, o.filter("o_orderstatus = 'F'"), o, th, 8)


@job("""SELECT event_id, CASE event_type WHEN 'view' THEN 'not json' WHEN 'error' THEN 'k is not number' WHEN 'purchase' THEN 'missing k' WHEN 'signup' THEN 'kind not allowed' END AS problem FROM events""")
def check_json(spark, sf):
    e = table(spark, sf, "events")
    t = F.col("event_type")
    fence = F.concat(F.lit("Here:\n```json\n"), F.replace("props", F.lit("}"), F.lit(', "kind": "a"}')), F.lit("\n```\nDone."))
    text = (
        F.when(t == "view", "no braces at all").when(t == "error", '{"k": "x", "kind": "a"}').when(t == "purchase", 'so {"z": 1, "kind": "b"} it is')
        .when(t == "signup", F.replace("props", F.lit("}"), F.lit(', "kind": "q"}'))).otherwise(fence)
    )
    return audit.check_json(e.select("event_id", text.alias("raw")), "raw", {"k": "number", "kind": "string"}, {"kind": ["a", "b"]}).select("event_id", "problem")


# ---- verdicts of a user's function ----

_REFUSED = set()


def _length_verdicts(batch):
    """Stands in for a model: refuses a batch on the first call of a process, then answers."""
    first = (batch["doc_id"].iloc[0], len(batch))
    if first not in _REFUSED:
        _REFUSED.add(first)
        raise RuntimeError("not now")
    text = batch["text"].fillna("")
    return batch[[]].assign(size_class=(text.str.len() > 2000).map({True: "long", False: "short"}), es=text.str.count("e").astype("int64"))


@job("""SELECT doc_id, CASE WHEN length(coalesce(text, '')) > 2000 THEN 'long' ELSE 'short' END AS size_class,
(length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')))::BIGINT AS es, NULL::VARCHAR AS failed FROM documents""")
def annotated_verdicts(spark, sf):
    # a first run over the English texts is replayed by the run over all
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    path = scratch(spark, "verdicts")
    annotate.annotate(d.filter("lang = 'en'"), "doc_id", _length_verdicts, "size_class string, es bigint", path)
    return annotate.annotate(d, "doc_id", _length_verdicts, "size_class string, es bigint", path)
