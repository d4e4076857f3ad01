"""Chunking, index and retrieval jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrollwork.functions import fixed, text as T
from scrollwork.operators import chunks, lore_cache, retrieval, vector_index
from scrollwork.plans import bind
from scrollwork.plans.bind import quote, sql_case, sql_list, sql_slug, sql_strip, sql_words
from scrollwork.plans.registry import job, table
from scrollwork.session import scratch, spread
from scrollwork.plans.segment_jobs import HEADED_SQL, headed

# ---- chunks ----


def web_files(spark, sf):
    h = headed(spark, sf)
    return h.select(
        F.regexp_extract("url", r"//([^/]+)", 1).alias("pack_id"),
        F.concat(F.lit("page_"), F.lpad(F.col("page_id").cast("string"), 12, "0")).alias("path"),
        F.lit("general").alias("file_type"),
        "title",
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Entity "), "page_id")).alias("entity_id"),
        F.col("content").alias("body"),
        F.array(F.lit("web"), F.lit("general")).alias("tags"),
        F.array(F.regexp_extract("url", r"//([^/]+)", 1)).alias("entity_refs"),
    )


CHUNKS = f"""ck AS (SELECT regexp_extract(url, '//([^/]+)', 1) AS pack_id, 'page_' || lpad(page_id::VARCHAR, 12, '0') AS path, title,
    CASE WHEN page_id % 2 = 0 THEN 'Entity ' || page_id END AS entity_id, unnest(ps) AS p, unnest(range(len(ps)))::INTEGER + 1 AS part_no FROM {HEADED_SQL}),
cc AS (SELECT *, {sql_strip('left(p, 20)')} AS section, {sql_strip("p || chr(10) || '### note' || chr(10) || left(p, 10)")} AS content FROM ck),
ci AS (SELECT *, pack_id || ':' || {sql_slug('coalesce(entity_id, title)')} || ':' || {sql_slug('section')} AS chunk_id FROM cc),
ch AS (SELECT pack_id, chunk_id, arg_max(path, (path, part_no)) AS file_path, arg_max(section, (path, part_no)) AS section_title,
    arg_max(content, (path, part_no)) AS content, arg_max(entity_id, (path, part_no)) AS entity_id,
    count(*) AS n FROM ci GROUP BY pack_id, chunk_id),
cf AS (SELECT *, floor({sql_words('content')} * 1.33::DOUBLE)::INTEGER AS token_estimate FROM ch)"""


@job(f"""WITH {CHUNKS} SELECT pack_id, chunk_id, file_path, section_title, md5(content) AS digest, token_estimate,
CASE WHEN (SELECT page_id % 2 = 0 FROM pages WHERE 'page_' || lpad(page_id::VARCHAR, 12, '0') = file_path) THEN pack_id || ',Entity ' ||
  CAST(substr(file_path, 6) AS BIGINT) ELSE pack_id END AS refs, 'web,general' AS tags FROM cf""")
def chunk_files(spark, sf):
    c = chunks.chunk(web_files(spark, sf))
    return c.select(
        "pack_id", "chunk_id", "file_path", "section_title", F.md5("content").alias("digest"), "token_estimate",
        F.array_join("entity_refs", ",").alias("refs"), F.array_join("tags", ",").alias("tags"),
    )


@job(f"""SELECT doc_id, {sql_words('text')}::INTEGER AS words, floor({sql_words('text')} * 1.33::DOUBLE)::INTEGER AS tokens FROM documents""")
def chunk_tokens(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.word_count(F.col("text")).alias("words"), T.token_estimate(F.col("text")).alias("tokens"))


@job(f"SELECT page_id, {sql_slug('url')} AS slug, {sql_slug('left(html, 0)')} AS nothing FROM pages")
def slugify(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", T.slugify(F.col("url")).alias("slug"), T.slugify(F.lit("  ")).alias("nothing"))


@job(f"""WITH {CHUNKS} SELECT h AS pack_id, pages_seen, coalesce(n, 0) AS chunk_count FROM
(SELECT regexp_extract(url, '//([^/]+)', 1) AS h, count(*) AS pages_seen FROM pages GROUP BY ALL)
LEFT JOIN (SELECT pack_id, count(*) AS n FROM cf GROUP BY ALL) ON h = pack_id""")
def register_packs(spark, sf):
    packs = web_files(spark, sf).groupBy("pack_id").agg(F.count(F.lit(1)).alias("pages_seen"))
    return chunks.register_packs(chunks.chunk(web_files(spark, sf)), packs)


@job(f"""WITH {CHUNKS} SELECT pack_id, count(*) AS chunks, sum(token_estimate)::BIGINT AS tokens, 1::BIGINT AS types FROM cf GROUP BY ALL""")
def index_stats(spark, sf):
    return chunks.index_stats(chunks.chunk(web_files(spark, sf)))


TOKENS = r"""tk AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\pL\pN]+'), lambda x: x <> '') AS ts FROM documents),
ps AS (SELECT doc_id, len(ts) AS length, unnest(ts) AS term FROM tk)"""


@job(f"WITH {TOKENS} SELECT term, count(DISTINCT doc_id) AS doc_freq, count(*) AS total_freq FROM ps GROUP BY term")
def postings_stats(spark, sf):
    return chunks.postings_stats(chunks.build_postings(spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text"))


@job(f"WITH {TOKENS} SELECT doc_id, length::INTEGER AS length, term, count(*) AS tf FROM ps GROUP BY ALL")
def build_postings(spark, sf):
    return chunks.build_postings(spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text")


@job(f"""WITH {TOKENS} SELECT source AS pack_id, count(*) AS postings, sum(n)::BIGINT AS terms FROM
(SELECT doc_id, term, count(*) AS n FROM ps GROUP BY ALL) JOIN documents USING (doc_id) WHERE source <> 'src1' GROUP BY ALL
UNION ALL SELECT 'src1', count(*), sum(n)::BIGINT FROM (SELECT doc_id, term, count(*) * 10 AS n FROM ps GROUP BY ALL)
JOIN documents USING (doc_id) WHERE source = 'src1'""")
def reindex(spark, sf):
    d = table(spark, sf, "documents")
    index = chunks.build_postings(d, "doc_id", "text").join(d.select("doc_id", F.col("source").alias("pack_id")), "doc_id")
    fresh = index.filter("pack_id = 'src1'").withColumn("tf", F.col("tf") * 10)
    out = chunks.reindex(index, ["src1"], fresh)
    return out.groupBy("pack_id").agg(F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("terms"))


# ---- queries ----

KEYWORDS_SQL = rf"""(SELECT item_id AS query_id, list_filter(regexp_extract_all(lower(text), '\S+'),
    lambda w: w NOT IN {sql_list(fixed.INPUT_STOP_WORDS)} AND length(w) > 2)[1:5] AS keywords FROM benchmark)"""


def benchmark_queries(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), retrieval.input_keywords(F.col("text")).alias("keywords"))


def doc_chunks(spark, sf):
    d = spread(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    return d.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("pack_id"), F.col("text").alias("content"),
        T.token_estimate(F.col("text")).alias("token_estimate"), "lang",
    )


# a scene: a nation, its people, its suppliers' names as threads, one event as input
@job(rf"""WITH e AS (SELECT s_nationkey AS k, list(s_name ORDER BY s_suppkey) AS names, list('s' || s_suppkey ORDER BY s_suppkey) AS ids FROM supplier GROUP BY ALL),
t AS (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS titles, list('n' || n_nationkey ORDER BY n_nationkey) AS ids FROM nation GROUP BY ALL),
q AS (SELECT n_nationkey AS campaign_id, CASE WHEN n_nationkey % 5 = 0 THEN 'unknown' ELSE 'old_town-' || n_nationkey END AS loc,
    coalesce(names, []) AS names, coalesce(e.ids, []) AS eids, titles, t.ids AS tids, b.text,
    coalesce(list_filter(regexp_extract_all(lower(b.text), '\S+'), lambda w: w NOT IN {sql_list(fixed.INPUT_STOP_WORDS)} AND length(w) > 2)[1:5], []) AS words
    FROM nation n LEFT JOIN e ON k = n_nationkey JOIN t USING (n_regionkey) LEFT JOIN benchmark b ON item_id = n_nationkey),
u AS (SELECT campaign_id, text, loc, names, CASE WHEN loc = 'unknown' THEN [] ELSE [regexp_replace(loc, '[-_]', ' ', 'g')] END || names || titles || words AS kw,
    CASE WHEN loc = 'unknown' THEN [] ELSE [loc] END || eids || tids AS ids FROM q)
SELECT campaign_id, array_to_string(list_filter(kw, lambda x, i: list_position(kw, x) = i), '|') AS keywords,
    array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i), '|') AS entity_ids,
    array_to_string([replace(loc, '_', ' ')] || names[1:3] || CASE WHEN coalesce(text, '') <> '' THEN [text] ELSE [] END, ' ') AS semantic_text FROM u""")
def build_queries(spark, sf):
    n, s, b = (table(spark, sf, t) for t in ("nation", "supplier", "benchmark"))
    place = F.when(F.col("n_nationkey") % 5 == 0, "unknown").otherwise(F.concat(F.lit("old_town-"), "n_nationkey"))
    scenes = n.select(F.col("n_nationkey").alias("campaign_id"), place.alias("location_id"))
    ents = s.select(
        F.col("s_nationkey").alias("campaign_id"), F.col("s_suppkey").alias("ord"),
        F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"),
    )
    other = n.select(F.col("n_regionkey"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("title"),
                     F.array(F.concat(F.lit("n"), "n_nationkey")).alias("related_ids"))
    threads = n.select(F.col("n_nationkey").alias("campaign_id"), "n_regionkey").join(other, "n_regionkey").drop("n_regionkey")
    inputs = b.select(F.col("item_id").cast("int").alias("campaign_id"), "text")
    q = retrieval.build_queries(scenes, ents, threads, inputs)
    return q.select("campaign_id", F.array_join("keywords", "|").alias("keywords"), F.array_join("entity_ids", "|").alias("entity_ids"), "semantic_text")


BM25 = rf"""{TOKENS}, kw AS (SELECT query_id, unnest(keywords) AS k FROM {KEYWORDS_SQL}),
ph AS (SELECT DISTINCT query_id, trim(regexp_replace(k, '[^\pL\pN]+', ' ', 'g')) AS term FROM kw WHERE regexp_matches(k, '[\pL\pN]')),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM ps WHERE term IN (SELECT term FROM ph) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM tk),
df AS (SELECT term, greatest(ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 1e-6::DOUBLE) AS idf FROM tf, st GROUP BY term, n),
sc AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score
    FROM ph JOIN df USING (term) JOIN tf USING (term), st GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)"""


@job(f"WITH {BM25} SELECT query_id, doc_id AS chunk_id, score, rank::INTEGER AS rank FROM bm WHERE rank <= 10")
def bm25_topk(spark, sf):
    return retrieval.keyword_search(benchmark_queries(spark, sf), doc_chunks(spark, sf), 10)


@job(f"""WITH {BM25.replace('FROM documents)', "FROM documents WHERE lang = 'en')")} SELECT query_id, doc_id AS chunk_id, score, rank::INTEGER AS rank FROM bm WHERE rank <= 10""")
def bm25_filtered(spark, sf):
    # the corpus filter reaches the scan before anything is ranked
    return retrieval.keyword_search(benchmark_queries(spark, sf), doc_chunks(spark, sf).filter("lang = 'en'"), 10)


# customers are entities, orders are chunks that refer to them; a query asks for one nation's region head
ORDER_CHUNK_SQL = """(SELECT 'o' || lpad(o_orderkey::VARCHAR, 10, '0') AS chunk_id, o_orderpriority AS file_path, o_orderstatus AS pack_id,
    'c' || o_custkey AS ref, (o_totalprice / 1000)::BIGINT AS tokens FROM orders)"""
REF_QUERY_SQL = """(SELECT s_suppkey AS query_id, ['c' || (s_suppkey * 3), 'c' || (s_suppkey * 3 + 1), 'c' || s_suppkey] AS ids,
    CASE WHEN s_acctbal > 0 THEN ['O', 'P'] ELSE ['F'] END AS packs FROM supplier)"""


def order_chunks(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.concat(F.lit("o"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("chunk_id"),
        F.col("o_orderpriority").alias("file_path"), F.col("o_orderstatus").alias("pack_id"),
        F.array(F.concat(F.lit("c"), "o_custkey")).alias("entity_refs"),
    )


def ref_queries(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("query_id"),
        F.array(F.concat(F.lit("c"), k * 3), F.concat(F.lit("c"), k * 3 + 1), F.concat(F.lit("c"), k)).alias("entity_ids"),
        F.when(F.col("s_acctbal") > 0, F.array(F.lit("O"), F.lit("P"))).otherwise(F.array(F.lit("F"))).alias("pack_ids"),
    )


def customer_ids(spark, sf):
    return table(spark, sf, "customer").filter("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("entity_id"))


MANIFEST = f"mf AS (SELECT ref AS entity_id, chunk_id FROM {ORDER_CHUNK_SQL} WHERE ref IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 0))"


@job(f"WITH {MANIFEST} SELECT * FROM mf")
def build_manifest(spark, sf):
    return retrieval.build_manifest(customer_ids(spark, sf), order_chunks(spark, sf))


MAN_HITS = f"""{MANIFEST}, mq AS (SELECT query_id, unnest(ids) AS entity_id, unnest(range(len(ids))) AS pos FROM {REF_QUERY_SQL}),
mh AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY min(pos), chunk_id) AS rank FROM mq JOIN mf USING (entity_id) GROUP BY query_id, chunk_id),
rh AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY file_path, chunk_id) AS rank FROM
    (SELECT DISTINCT query_id, chunk_id, file_path FROM {REF_QUERY_SQL} q JOIN {ORDER_CHUNK_SQL} c ON list_contains(packs, pack_id) AND list_contains(ids, ref)))"""


@job(f"WITH {MAN_HITS} SELECT query_id, chunk_id, rank::INTEGER AS rank FROM mh WHERE rank <= 15")
def manifest_lookup(spark, sf):
    m = retrieval.build_manifest(customer_ids(spark, sf), order_chunks(spark, sf))
    return retrieval.manifest_lookup(ref_queries(spark, sf), m)


@job(f"WITH {MAN_HITS} SELECT query_id, chunk_id, rank::INTEGER AS rank FROM rh WHERE rank <= 15")
def ref_search(spark, sf):
    return retrieval.ref_search(ref_queries(spark, sf), order_chunks(spark, sf))


@job(f"""WITH {MAN_HITS}, un AS (SELECT query_id, chunk_id, 0 AS stage, rank FROM mh WHERE rank <= 15 UNION ALL SELECT query_id, chunk_id, 1, rank FROM rh WHERE rank <= 15)
SELECT query_id, chunk_id, min(stage)::INTEGER AS stage, arg_min(rank, stage)::INTEGER AS rank FROM un GROUP BY ALL""")
def merge_candidates(spark, sf):
    m = retrieval.build_manifest(customer_ids(spark, sf), order_chunks(spark, sf))
    q = ref_queries(spark, sf)
    return retrieval.merge_candidates(retrieval.manifest_lookup(q, m), retrieval.ref_search(q, order_chunks(spark, sf)))


BUDGET = f"""{BM25}, tok AS (SELECT doc_id, lang, source, floor({sql_words('text')} * 1.33::DOUBLE)::INTEGER AS token_estimate FROM documents),
pl AS (SELECT query_id, doc_id, token_estimate, lang, source, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM bm JOIN tok USING (doc_id) WHERE rank <= 30),
us AS (SELECT *, sum(token_estimate) OVER (PARTITION BY query_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS used FROM pl WHERE place <= 15),
kept AS (SELECT * FROM us WHERE place = 1 OR used <= 2000)"""


@job(f"WITH {BUDGET} SELECT query_id, doc_id AS chunk_id, place::INTEGER AS place, token_estimate, used::BIGINT AS tokens_used FROM kept")
def budgeted_retrieval(spark, sf):
    out = retrieval.retrieve_for_scene(benchmark_queries(spark, sf), doc_chunks(spark, sf))
    return out.select("query_id", "chunk_id", "place", "token_estimate", "tokens_used")


@job(r"""WITH tk AS (SELECT doc_id, source, list_filter(string_split_regex(lower(text), '[^\pL\pN]+'), lambda x: x <> '') AS ts,
    floor(len(regexp_extract_all(text, '\S+')) * 1.33::DOUBLE)::INTEGER AS tok FROM documents),
q AS (SELECT DISTINCT lower(regexp_extract(text, '^([a-zA-Z]+)', 1)) AS term FROM benchmark WHERE regexp_matches(text, '^[a-zA-Z]+')),
ps AS (SELECT doc_id, len(ts) AS length, unnest(ts) AS term FROM tk),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM ps WHERE term IN (SELECT term FROM q) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM tk),
df AS (SELECT term, greatest(ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 1e-6::DOUBLE) AS idf FROM tf, st GROUP BY term, n),
sc AS (SELECT term, doc_id, round(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)), 6) AS score FROM df JOIN tf USING (term), st),
rk AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, doc_id) AS place FROM sc),
us AS (SELECT term, doc_id, place, sum(tok) OVER (PARTITION BY term ORDER BY place ROWS UNBOUNDED PRECEDING) AS used FROM rk JOIN tk USING (doc_id) WHERE place <= 5)
SELECT term AS query_id, doc_id AS chunk_id, place::INTEGER AS place, used::BIGINT AS tokens_used FROM us WHERE place = 1 OR used <= 800""")
def entity_retrieval(spark, sf):
    b = table(spark, sf, "benchmark")
    e = b.select(F.lower(F.regexp_extract("text", r"^([a-zA-Z]+)", 1)).alias("entity_id")).filter("entity_id <> ''").distinct()
    out = retrieval.retrieve_for_entity(e, doc_chunks(spark, sf))
    return out.select("query_id", "chunk_id", "place", "tokens_used")


COSINE = """WITH q AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY label),
s AS (SELECT q.label::BIGINT AS query_id, e.label::VARCHAR AS collection, vec_id AS item_id,
    round(list_cosine_similarity(q.v, embedding::DOUBLE[]), 6) AS similarity FROM q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY similarity DESC, item_id) AS rank FROM s)
SELECT query_id, collection, item_id, similarity, rank::INTEGER AS rank FROM r WHERE rank <= 10"""


def vectors(spark, sf):
    # the query of a collection is its first vector; every collection is searched whole
    e = table(spark, sf, "embeddings")
    q = e.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    return q, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), F.col("label").alias("collection"))


@job(COSINE)
def cosine_topk(spark, sf):
    return retrieval.vector_search(*vectors(spark, sf), 10)


def _indexed(spark, sf, **how):
    q, items = vectors(spark, sf)
    path = scratch(spark, "vectors")
    vector_index.write_index(items, path)
    return vector_index.search_index(q, path, 10, **how)


@job(COSINE)
def vector_index_complete(spark, sf):
    return _indexed(spark, sf, complete=True)


@job()
def vector_index_topk(spark, sf):
    """Cells chosen by nearness, so a few of the ten may be missed; recall is measured in the tests."""
    return _indexed(spark, sf)


# ---- materialised results ----

KINDS = [("en", "location"), ("fr", "npc"), ("de", "faction"), ("es", "item")]


def kept_chunks(spark, sf):
    d = doc_chunks(spark, sf)
    k = retrieval.retrieve_for_scene(benchmark_queries(spark, sf), d)
    meta = d.select("chunk_id", T.first_in(F.col("lang"), KINDS).alias("chunk_type"), F.col("pack_id").alias("section_title"),
                    F.array("pack_id").alias("entity_refs"))
    return k.select("query_id", "place", "chunk_id").join(meta, "chunk_id")


MAT = f"""{BUDGET}, mt AS (SELECT query_id, place, doc_id, source, {sql_case('lang', [(k, dict(fixed.LORE_CATEGORIES)[v]) for k, v in KINDS])} AS category FROM kept),
mk AS (SELECT *, CASE WHEN category = 'npc_briefings' THEN source END AS key FROM mt)"""


@job(f"WITH {MAT} SELECT query_id, category, key, count(*)::INTEGER AS entries, string_agg(doc_id::VARCHAR, ',' ORDER BY place) AS ids FROM mk GROUP BY ALL")
def materialize(spark, sf):
    m = lore_cache.materialize(kept_chunks(spark, sf))
    ids = F.transform("entries", lambda x: x["chunk_id"].cast("string"))
    return m.select("query_id", "category", "key", F.size("entries").alias("entries"), F.array_join(ids, ",").alias("ids"))


@job(f"""WITH {MAT}, en AS (SELECT query_id, max(place) AS e FROM mk GROUP BY ALL),
ex AS (SELECT query_id + 1 AS query_id, place, doc_id, source FROM kept WHERE place <= 2)
SELECT query_id, category, key, place::INTEGER AS place, doc_id AS chunk_id FROM mk
UNION ALL SELECT query_id, 'npc_briefings', source, (place + e)::INTEGER, doc_id FROM ex JOIN en USING (query_id)""")
def append_entity(spark, sf):
    k = kept_chunks(spark, sf)
    extra = k.filter("place <= 2").withColumn("query_id", F.col("query_id") + 1)
    return lore_cache.append_entity(lore_cache.categorise(k), extra).select("query_id", "category", "key", "place", "chunk_id")


def order_cache(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("campaign_id"), F.col("o_orderpriority").alias("scene_id"), F.col("o_orderdate").alias("created_at"),
                    F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))


@job("""SELECT o_custkey AS campaign_id, o_orderpriority AS scene_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id,
arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders GROUP BY ALL""")
def latest_cache(spark, sf):
    return lore_cache.latest_cache(order_cache(spark, sf), ["campaign_id", "scene_id"]).select("campaign_id", "scene_id", "id", "price")


@job("SELECT c_custkey AS campaign_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def cache_misses(spark, sf):
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("campaign_id"))
    return lore_cache.cache_misses(wanted, order_cache(spark, sf).filter("scene_id = '1-URGENT'"), ["campaign_id"])


@job("""SELECT o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def invalidate(spark, sf):
    gone = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("campaign_id"))
    return lore_cache.invalidate(order_cache(spark, sf), gone, ["campaign_id"]).select("id")
