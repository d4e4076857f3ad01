"""Corpus audit, validation and probes. Reports are rows; thresholds are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scrollwork.functions import fixed, text as T
from scrollwork.operators.retrieval import BROADCAST_ROWS, small_enough


def audit_totals(pages: DataFrame, segs: DataFrame, files: DataFrame) -> DataFrame:
    """Source, segment and corpus sizes per document, density and retention."""
    a = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("words").cast("bigint").alias("source_words"))
    b = segs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("segments"), F.sum("words").cast("bigint").alias("segment_words"))
    c = files.groupBy("doc_id").agg(F.count(F.lit(1)).alias("files"), F.sum("words").cast("bigint").alias("corpus_words"))
    j = a.join(b, "doc_id", "left").join(c, "doc_id", "left").fillna(0)
    return j.withColumn("segments_per_page", F.round(F.col("segments") / F.col("pages"), 4)).withColumn(
        "retention_pct", F.when(F.col("source_words") > 0, F.round(F.col("corpus_words") / F.col("source_words") * 100, 4)).otherwise(0.0)
    )


def concentration(files: DataFrame, over: float = 60.0) -> DataFrame:
    """Files per directory with their share; the share is taken over the counts, not the files."""
    n = files.groupBy("doc_id", "dir").agg(F.count(F.lit(1)).alias("files"))
    share = F.col("files") / F.sum("files").over(W.partitionBy("doc_id")) * 100
    return n.withColumn("share_pct", F.round(share, 4)).withColumn("concentrated", F.col("share_pct") > over)


def orphans(entities: DataFrame, files: DataFrame) -> DataFrame:
    """Registry ids that no file carries or refers to."""
    ids = files.select("doc_id", F.explode(F.concat("entity_refs", F.array("entity_id"))).alias("entity_id"))
    return entities.select("doc_id", "entity_id").join(ids, ["doc_id", "entity_id"], "left_anti")


def missing_dirs(files: DataFrame, expected=fixed.EXPECTED_DIRS) -> DataFrame:
    docs = files.select("doc_id").distinct()
    want = docs.select("doc_id", F.explode(F.array(*[F.lit(d) for d in expected])).alias("dir"))
    return want.join(files.select("doc_id", "dir").distinct(), ["doc_id", "dir"], "left_anti")


def content_flags(files: DataFrame, stub: int = 500, patterns=fixed.NON_CONTENT_PATTERNS) -> DataFrame:
    """Stub files by bytes; among the others, files with text that is not content."""
    d = T.hold(files, {"bytes": F.octet_length("body"), "__hits": T.patterns_hit(F.col("body"), patterns)})
    flag = F.when(F.col("bytes") < stub, "stub").when(F.col("__hits") > 0, "non_content").otherwise("ok")
    return d.withColumn("flag", flag).drop("__hits")


TERM = r"(?U)\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"


def spot_terms(pages: DataFrame, n: int, seed: int = 7, most: int = 10) -> DataFrame:
    """Distinctive terms of ``n`` sampled pages per document: the pages with the lowest hash."""
    h = F.md5(F.concat_ws(":", F.lit(seed), "page_num"))
    w = W.partitionBy("doc_id").orderBy("__h", "page_num")
    pick = pages.select("doc_id", "page_num", h.alias("__h")).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
    sampled = pages.join(pick.select("doc_id", "page_num"), ["doc_id", "page_num"], "left_semi")
    return page_terms(sampled, most)


def page_terms(pages: DataFrame, most: int = 10, pattern: str = TERM) -> DataFrame:
    found = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 1)), lambda t: F.length(t) > 5)
    return pages.select("doc_id", "page_num", F.slice(found, 1, most).alias("terms"))


def spot_check(terms: DataFrame, files: DataFrame, per_page: bool = True) -> DataFrame:
    """Share of the sampled terms found in the document's corpus text.

    The distinct terms are a small sample; each is looked for in every file body of its
    document, inside the scanning task where their number is known to be bounded.
    """
    rows = terms.select("doc_id", "page_num", F.explode_outer("terms").alias("term"))
    wanted = rows.filter(F.col("term").isNotNull()).select("doc_id", "term").distinct()
    by_doc = wanted.groupBy("doc_id").agg(F.collect_set("term").alias("__terms"))
    if small_enough(wanted, BROADCAST_ROWS):
        by_doc = F.broadcast(by_doc)
    low = F.lower("body")
    hits = files.join(by_doc, "doc_id").select("doc_id", F.explode(F.filter("__terms", lambda t: F.contains(low, F.lower(t)))).alias("term")).distinct()
    j = rows.join(hits.withColumn("__hit", F.lit(1)), ["doc_id", "term"], "left")
    g = j.groupBy("doc_id", "page_num").agg(F.count("term").alias("terms"), F.count("__hit").alias("found"))
    return g.withColumn("coverage_pct", F.when(F.col("terms") > 0, F.round(F.col("found") / F.col("terms") * 100, 4)).otherwise(0.0))


def audit_issues(report: DataFrame) -> DataFrame:
    """One row per broken threshold.

    ``report``: ``doc_id, retention_pct, empty_dirs, top_share_pct, stubs, segments_per_page,
    orphans, non_content, spot_coverage``.
    """
    rules = [
        ("low_retention", (F.col("retention_pct") > 0) & (F.col("retention_pct") < 30), F.col("retention_pct")),
        ("empty_directories", F.col("empty_dirs") > 0, F.col("empty_dirs")),
        ("concentration", F.col("top_share_pct") > 60, F.col("top_share_pct")),
        ("many_stubs", F.col("stubs") > 5, F.col("stubs")),
        ("low_density", (F.col("segments_per_page") > 0) & (F.col("segments_per_page") < 0.3), F.col("segments_per_page")),
        ("orphaned_entities", F.col("orphans") > 0, F.col("orphans")),
        ("non_content", F.col("non_content") > 0, F.col("non_content")),
        ("low_spot_coverage", (F.col("spot_coverage") > 0) & (F.col("spot_coverage") < 50), F.col("spot_coverage")),
    ]
    return issue_rows(report, ["doc_id"], rules)


def issue_rows(df: DataFrame, keys: list[str], rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """Turn rules ``(name, broken, value)`` into issue rows in one pass."""
    items = F.array(*[F.struct(F.lit(n).alias("issue"), F.coalesce(bad, F.lit(False)).alias("bad"), v.cast("double").alias("value")) for n, bad, v in rules])
    rows = df.select(*keys, F.inline(F.filter(items, lambda x: x["bad"])))
    return rows.drop("bad")


def validate_corpus(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Structural issues: manifest without id or name, front matter that is no map, missing title."""
    m = issue_rows(manifests, ["pack_id"], [
        ("manifest_without_id", F.coalesce("id", F.lit("")) == "", F.lit(1)), ("manifest_without_name", F.coalesce("name", F.lit("")) == "", F.lit(1)),
    ])
    f = issue_rows(files, ["pack_id"], [
        ("front_matter_not_a_map", F.col("has_front") & ~F.col("front_is_map"), F.lit(1)),
        ("missing_title", F.col("has_front") & F.col("front_is_map") & (F.coalesce("title", F.lit("")) == ""), F.lit(1)),
    ])
    none = manifests.join(files.select("pack_id").distinct(), "pack_id", "left_anti").select("pack_id", F.lit("no_files").alias("issue"), F.lit(1.0).alias("value"))
    every = m.unionByName(f).unionByName(none)
    return every.groupBy("pack_id", "issue").agg(F.count(F.lit(1)).alias("n"))


def title_queries(files: DataFrame, n: int = 3, words: int = 3) -> DataFrame:
    """Queries for the retrieval check: the first titles of a corpus, three words each."""
    w = W.partitionBy("pack_id").orderBy("path")
    top = files.select("pack_id", "path", "title").withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
    return top.select(F.concat_ws("#", "pack_id", "__r").alias("query_id"), "pack_id", F.slice(T.word_array(F.col("title")), 1, words).alias("keywords"))


def retrieval_check(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries run and queries with a hit, per corpus."""
    got = hits.select("query_id").distinct().withColumn("__hit", F.lit(1))
    j = queries.join(got, "query_id", "left")
    return j.groupBy("pack_id").agg(F.count(F.lit(1)).alias("queries"), F.count("__hit").alias("with_results"))


def distribution(files: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """Files, chunks and entities by type: one aggregation over (kind, type)."""
    a = files.select(F.lit("file").alias("kind"), F.col("file_type").alias("type"))
    b = chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_type").alias("type"))
    c = entities.select(F.lit("entity").alias("kind"), F.col("entity_type").alias("type"))
    return a.unionByName(b).unionByName(c).groupBy("kind", "type").agg(F.count(F.lit(1)).alias("n"))


def ref_counts(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.explode(F.array_distinct("entity_refs")).alias("entity_id")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("refs"))


def entity_samples(entities: DataFrame, chunks: DataFrame, per_type: int = 3, tags: int = 10, related: int = 5) -> DataFrame:
    """Most referred-to entities of every type, with the size and tags of their chunks.

    Counts come first, so chunk contents are gathered for the chosen few only, as sets of tags.
    """
    e = entities.join(ref_counts(chunks), "entity_id", "left").fillna(0, ["refs"])
    w = W.partitionBy("entity_type").orderBy(F.desc("refs"), F.asc("entity_id"))
    top = e.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= per_type)
    link = chunks.select(F.explode(F.array_distinct("entity_refs")).alias("entity_id"), "chunk_id", "tags", "token_estimate")
    mine = link.join(top.select("entity_id"), "entity_id", "left_semi")
    size = mine.groupBy("entity_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum("token_estimate").cast("bigint").alias("tokens"))
    # a distinct first, so that no task holds more than the distinct tags of an entity
    tag = mine.select("entity_id", F.explode("tags").alias("tag")).distinct()
    wt = W.partitionBy("entity_id").orderBy("tag")
    tag = tag.withColumn("__r", F.row_number().over(wt)).filter(F.col("__r") <= tags)
    tag = tag.groupBy("entity_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    out = top.join(size, "entity_id", "left").join(tag, "entity_id", "left")
    return out.withColumn("related", F.slice("related", 1, related)).fillna(0, ["chunk_count", "tokens"])


def probe_queries(entities: DataFrame, chunks: DataFrame, n_entities: int = 8, n_tags: int = 5, not_tags: list[str] = ("general", "location", "npc", "faction", "culture", "item")) -> DataFrame:
    """Probes: the most referred-to entities by name, and the most frequent tags."""
    e = entities.join(ref_counts(chunks), "entity_id", "left").fillna(0, ["refs"])
    e = e.orderBy(F.desc("refs"), F.asc("entity_id")).limit(n_entities)
    a = e.select(F.concat(F.lit("e:"), "entity_id").alias("query_id"), F.array("name").alias("keywords"))
    t = chunks.select(F.explode("tags").alias("tag")).filter(~F.col("tag").isin(list(not_tags))).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    t = t.orderBy(F.desc("n"), F.asc("tag")).limit(n_tags)
    return a.unionByName(t.select(F.concat(F.lit("t:"), "tag").alias("query_id"), F.array("tag").alias("keywords")))


def probe_results(queries: DataFrame, kept: DataFrame) -> DataFrame:
    g = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks_found"), F.sum("token_estimate").cast("bigint").alias("tokens"))
    j = queries.select("query_id").join(g, "query_id", "left").fillna(0)
    return j.withColumn("passed", F.col("chunks_found") > 0)


def probe_stats(results: DataFrame, kept: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hit rate, and the share of chunks any probe reached."""
    seen = kept.agg(F.countDistinct("chunk_id").alias("s"))
    total = chunks.agg(F.count(F.lit(1)).alias("t"))
    r = results.agg(F.count(F.lit(1)).alias("probes"), F.avg(F.col("passed").cast("int")).alias("hit_rate"))
    cover = F.try_divide(seen.select("s").scalar(), total.select("t").scalar())
    return r.withColumn("hit_rate", F.round("hit_rate", 4)).withColumn("coverage", F.round(F.coalesce(cover, F.lit(0.0)), 6))


def corpus_issues(files: DataFrame, chunks: DataFrame, entities: DataFrame, stats: DataFrame, small: int = 50, large: int = 3000, least: float = 0.2) -> DataFrame:
    """Issue rows for a whole corpus: ``issue, subject, n``."""
    types = entities.groupBy(F.col("entity_type").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    have = files.select(F.col("file_type").alias("t")).distinct()
    a = types.join(have, "t", "left_anti").select(F.lit("type_without_files").alias("issue"), F.col("t").alias("subject"), "n")
    none = F.lit(None).cast("string").alias("subject")
    b = chunks.filter(F.size("entity_refs") == 0).agg(F.count(F.lit(1)).alias("n")).select(F.lit("chunks_without_refs").alias("issue"), none, "n")
    c = files.agg(F.count(F.when(F.col("words") < small, 1)).alias("s"), F.count(F.when(F.col("words") > large, 1)).alias("l"))
    c = c.select(F.inline(F.array(
        F.struct(F.lit("small_files").alias("issue"), F.lit(None).cast("string").alias("subject"), F.col("s").alias("n")),
        F.struct(F.lit("large_files").alias("issue"), F.lit(None).cast("string").alias("subject"), F.col("l").alias("n")),
    )))
    d = stats.select(F.lit("low_coverage").alias("issue"), none, F.when(F.col("coverage") < least, F.floor(F.col("coverage") * 100) + 1).otherwise(0).cast("bigint").alias("n"))
    e = stats.select(F.lit("probes_without_hits").alias("issue"), none, F.round((1 - F.col("hit_rate")) * F.col("probes")).cast("bigint").alias("n"))
    return a.unionByName(b).unionByName(c).unionByName(d).unionByName(e).filter(F.col("n") > 0)


def name_is_id(manifests: DataFrame) -> DataFrame:
    """Corpora whose display name is just their id."""
    return manifests.filter(F.replace(F.lower("name"), F.lit(" "), F.lit("")) == F.replace(F.lower("pack_id"), F.lit("_"), F.lit("")))


def check_state(campaigns: DataFrame, entities: DataFrame, scenes: DataFrame, counters: DataFrame, threads: DataFrame, expected: int) -> DataFrame:
    """Setup issues of every campaign: no player, no scene, too few counters, no open thread."""
    one = lambda df, n: df.groupBy("campaign_id").agg(F.count(F.lit(1)).alias(n))
    j = campaigns.select("campaign_id")
    j = j.join(one(entities.filter("entity_id = 'player'"), "players"), "campaign_id", "left")
    j = j.join(one(scenes, "scenes"), "campaign_id", "left").join(one(counters, "counters"), "campaign_id", "left")
    j = j.join(one(threads.filter("status = 'active'"), "open_threads"), "campaign_id", "left").fillna(0)
    return issue_rows(j, ["campaign_id"], [
        ("no_player", F.col("players") == 0, F.col("players")), ("no_scene", F.col("scenes") == 0, F.col("scenes")),
        ("too_few_counters", F.col("counters") < expected, F.col("counters")), ("no_open_thread", F.col("open_threads") == 0, F.col("open_threads")),
    ])


def json_text(c: Column) -> Column:
    """JSON out of a fenced block, else the text from its first brace to its last."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    bare = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(bare != "", bare).otherwise(c)


def check_json(df: DataFrame, col: str, required: dict[str, str], enums: dict[str, list[str]] = {}) -> DataFrame:
    """First problem of every recorded JSON document, null if it is fine.

    ``required`` maps top-level keys to ``string``, ``number``, ``boolean``, ``array`` or ``object``.
    """
    shape = {"string": r"^STRING", "number": r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": r"^BOOLEAN", "array": r"^ARRAY", "object": r"^OBJECT"}
    d = T.hold(df, {"__v": F.try_parse_json(json_text(F.col(col)))})
    why = F.when(F.col("__v").isNull(), "not json")
    for key, kind in required.items():
        got = F.try_variant_get("__v", f"$.{key}", "variant")
        why = why.when(got.isNull(), f"missing {key}").when(~F.schema_of_variant(got).rlike(shape[kind]), f"{key} is not {kind}")
    for key, values in enums.items():
        why = why.when(~F.try_variant_get("__v", f"$.{key}", "string").isin(values), f"{key} not allowed")
    return d.withColumn("problem", why).drop("__v")
