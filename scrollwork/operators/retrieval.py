"""Keyword, reference and vector retrieval for many queries at once, under a token budget."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scrollwork.functions import fixed, text as T

# Sides at or under this many rows may be sent to every task; see `small_enough`.
BROADCAST_ROWS = 200_000
VECTOR_QUERY_ROWS = 4_096
VECTOR_ITEM_ROWS = 8_192


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must to know."""
    return df.limit(rows + 1).count() <= rows


def input_keywords(c: Column, k: int = 5, stop=fixed.INPUT_STOP_WORDS) -> Column:
    """First ``k`` words longer than two characters that are not stop words."""
    words = T.word_array(F.lower(c))
    return F.slice(F.filter(words, lambda w: ~w.isin(stop) & (F.length(w) > 2)), 1, k)


def build_queries(scenes: DataFrame, entities: DataFrame, threads: DataFrame, inputs: DataFrame) -> DataFrame:
    """Keywords, entity ids and semantic text of one query per campaign.

    ``scenes(campaign_id, location_id)``, ``entities(campaign_id, ord, id, name)``,
    ``threads(campaign_id, ord, title, related_ids)``, ``inputs(campaign_id, text)``. A scene's
    cast and its open threads are short lists by the context limits.
    """
    ents = entities.groupBy("campaign_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "name"))).alias("e"))
    ths = threads.groupBy("campaign_id").agg(F.array_sort(F.collect_list(F.struct("ord", "title", "related_ids"))).alias("t"))
    j = scenes.join(ents, "campaign_id", "left").join(ths, "campaign_id", "left").join(inputs, "campaign_id", "left")
    none = F.array().cast("array<string>")
    place = F.coalesce("location_id", F.lit(""))
    known = (place != "") & (place != "unknown")
    names = F.coalesce(F.transform("e", lambda x: x["name"]), none)
    ids = F.coalesce(F.transform("e", lambda x: x["id"]), none)
    titles = F.coalesce(F.transform("t", lambda x: x["title"]), none)
    related = F.coalesce(F.flatten(F.transform("t", lambda x: x["related_ids"])), none)
    keep = lambda a: F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != "")))
    words = F.coalesce(input_keywords(F.col("text")), none)
    loc_words = F.when(known, F.array(F.regexp_replace(place, "[-_]", " "))).otherwise(none)
    sem = F.concat(
        F.when(place != "", F.array(F.replace(place, F.lit("_"), F.lit(" ")))).otherwise(none),
        F.slice(names, 1, 3),
        F.when(F.coalesce("text", F.lit("")) != "", F.array("text")).otherwise(none),
    )
    return j.select(
        "campaign_id",
        keep(F.concat(loc_words, names, titles, words)).alias("keywords"),
        keep(F.concat(F.when(known, F.array(place)).otherwise(none), ids, related)).alias("entity_ids"),
        F.array_join(sem, " ").alias("semantic_text"),
    )


# ---- keyword search ----


def query_phrases(queries: DataFrame, within: list[str] = []) -> DataFrame:
    """``query_id, phrase``: every keyword as a phrase of plain terms."""
    p = queries.select("query_id", *within, F.explode("keywords").alias("k"))
    return p.select("query_id", *within, F.array_join(T.terms(F.col("k")), " ").alias("phrase")).filter("phrase <> ''").distinct()


def _grams(tokens: Column, lengths: list[int]) -> Column:
    parts = []
    for n in lengths:
        if n == 1:
            parts.append(tokens)
        else:
            starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(
                F.array().cast("array<int>")
            )
            parts.append(F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " ")))
    return F.concat(*parts)


def phrase_hits(
    phrases: DataFrame, chunks: DataFrame, key: str, col: str, lengths: list[int], within: list[str] = []
) -> DataFrame:
    """``key, length, phrase, tf`` for the wanted phrases only.

    The wanted phrases are few beside the text; when they are known to be, they meet the
    tokens inside the scanning task and only hits are shuffled.
    """
    wanted = phrases.select("phrase").distinct()
    if small_enough(wanted, BROADCAST_ROWS):
        wanted = F.broadcast(wanted)
    toks = chunks.select(key, *within, T.terms(F.col(col)).alias("__t")).withColumn("length", F.size("__t"))
    rows = toks.select(key, *within, "length", F.explode(_grams(F.col("__t"), lengths)).alias("phrase"))
    return rows.join(wanted, "phrase", "left_semi").groupBy(key, *within, "length", "phrase").agg(F.count(F.lit(1)).alias("tf"))


def corpus_size(chunks: DataFrame, col: str) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(T.terms(F.col(col)))).alias("mean_length"))


def keyword_search(
    queries: DataFrame, chunks: DataFrame, k: int = 30, key: str = "chunk_id", col: str = "content",
    lengths: list[int] | None = None, within: list[str] = [],
) -> DataFrame:
    """BM25 over the OR of each query's phrases: the best ``k`` chunks, score then id.

    ``queries(query_id, keywords)``. Filters on ``chunks`` come before ranking; columns in
    ``within`` (such as ``pack_id``) must agree between a query and its chunks.
    """
    phrases = query_phrases(queries, within)
    if lengths is None:
        sizes = phrases.select(F.size(F.split("phrase", " ")).alias("n")).distinct()
        lengths = sorted(r.n for r in sizes.collect()) or [1]
    # by chunk, so that the (query, chunk) sums below need no further shuffle
    hits = phrase_hits(phrases, chunks, key, col, lengths, within).repartition(key)
    freq = hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    return rank_hits(hits, phrases, freq, corpus_size(chunks, col), key, within, k)


def rank_hits(hits: DataFrame, phrases: DataFrame, freq: DataFrame, size: DataFrame, key: str, within: list[str], k: int) -> DataFrame:
    """BM25 of ``hits(phrase, key, within, length, tf)``: the best ``k`` of each query. ``freq(phrase, df)``, ``size(n, mean_length)``: one row."""
    n, mean = size.select("n").scalar(), size.select("mean_length").scalar()
    weights = freq.select("phrase", F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(fixed.IDF_FLOOR)).alias("idf"))
    terms = phrases.join(weights, "phrase")
    if small_enough(phrases, BROADCAST_ROWS):
        terms = F.broadcast(terms)
    k1, b = fixed.BM25_K1, fixed.BM25_B
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    scores = hits.join(terms, ["phrase", *within]).groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# ---- manifest and references ----


def build_manifest(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """``entity_id, chunk_id`` rows: the chunks that refer to a known entity."""
    refs = chunks.select(F.explode("entity_refs").alias("entity_id"), "chunk_id").distinct()
    return refs.join(entities.select("entity_id").distinct(), "entity_id", "left_semi")


def manifest_lookup(queries: DataFrame, manifest: DataFrame, k: int = 15) -> DataFrame:
    """First ``k`` chunks of a query's entities, by entity position and chunk id.

    ``k`` is the number of candidates that can survive the budget, so no more are needed.
    """
    q = queries.select("query_id", F.posexplode("entity_ids").alias("pos", "entity_id"))
    hit = q.join(manifest, "entity_id").groupBy("query_id", "chunk_id").agg(F.min("pos").alias("pos"))
    w = W.partitionBy("query_id").orderBy("pos", "chunk_id")
    return hit.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("pos")


def ref_search(queries: DataFrame, chunks: DataFrame, k: int = 15) -> DataFrame:
    """Chunks of the query's packs whose references meet its entities, by file and id."""
    q = queries.select("query_id", F.explode("pack_ids").alias("pack_id"), "entity_ids")
    q = q.select("query_id", "pack_id", F.explode(F.array_distinct("entity_ids")).alias("entity_id"))
    c = chunks.select("pack_id", "chunk_id", "file_path", F.explode(F.array_distinct("entity_refs")).alias("entity_id"))
    hit = q.join(c, ["pack_id", "entity_id"]).select("query_id", "chunk_id", "file_path").distinct()
    w = W.partitionBy("query_id").orderBy("file_path", "chunk_id")
    return hit.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("file_path")


# ---- vectors ----


def _pack(df: DataFrame, keys: list[str], ident: str, name: str) -> DataFrame:
    """Rows of a hash block, whose size is set by the number of blocks, as two arrays."""
    g = df.groupBy(*keys).agg(F.collect_list(F.struct(ident, "vector")).alias("__p"))
    return g.select(*keys, F.col(f"__p.{ident}").alias(f"{name}_ids"), F.col("__p.vector").alias(f"{name}_vecs"))


def _unit(rows) -> np.ndarray:
    m = np.asarray([list(r) for r in rows], dtype=np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def _best(qids, q, ids, v, coll, n):
    """Rows of the ``n`` best items per query for one block of one collection."""
    sims = np.round(q @ v.T, 6) + 0.0
    out = []
    for i, qid in enumerate(qids):
        order = np.lexsort((ids, -sims[i]))[:n]
        out.append(pd.DataFrame({"query_id": qid, "collection": coll, "item_id": ids[order], "similarity": sims[i][order]}))
    return out


def vector_search(queries: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """Exact cosine top ``n`` per query and collection.

    ``queries(query_id, vector)``, ``items(item_id, vector, collection)``. Each task scores
    its block as one matrix product and emits only its ``n`` best per query. A bounded query
    set is sent to every task; a larger one is packed in hash blocks of bounded size that meet
    every item block once.
    """
    items = items.select("item_id", "vector", F.col("collection").cast("string").alias("collection"))
    hit = f"query_id {dict(queries.dtypes)['query_id']}, collection string, item_id {dict(items.dtypes)['item_id']}, similarity double"
    if small_enough(queries, VECTOR_QUERY_ROWS):
        got = queries.select("query_id", "vector").toPandas()
        send = queries.sparkSession.sparkContext.broadcast((got["query_id"].to_numpy(), _unit(got["vector"]) if len(got) else None))

        def scan(batches):
            qids, q = send.value
            for batch in batches:
                for coll, part in batch.groupby("collection"):
                    if len(qids):
                        yield from _best(qids, q, part["item_id"].to_numpy(), _unit(part["vector"]), coll, n)

        hits = items.mapInPandas(scan, hit)
    else:
        q_blocks = max(1, -(-queries.count() // VECTOR_QUERY_ROWS))
        i_blocks = max(1, -(-items.count() // VECTOR_ITEM_ROWS))
        qb = _pack(queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks))), ["qb"], "query_id", "q")
        ib = _pack(items.withColumn("ib", F.pmod(F.xxhash64("item_id"), F.lit(i_blocks))), ["collection", "ib"], "item_id", "i")
        pairs = ib.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)).cast("array<bigint>"))).join(qb, "qb")

        def score(batches):
            for batch in batches:
                for r in batch.itertuples(index=False):
                    yield from _best(np.asarray(r.q_ids), _unit(r.q_vecs), np.asarray(r.i_ids), _unit(r.i_vecs), r.collection, n)

        hits = pairs.select("collection", "q_ids", "q_vecs", "i_ids", "i_vecs").mapInPandas(score, hit)
    w = W.partitionBy("query_id", "collection").orderBy(F.desc("similarity"), F.asc("item_id"))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


# ---- merging and budget ----


def merge_candidates(*stages: DataFrame) -> DataFrame:
    """Union of ``query_id, chunk_id, rank`` lists; the first stage to name a chunk wins."""
    tagged = [s.select("query_id", "chunk_id", F.lit(i).alias("stage"), "rank") for i, s in enumerate(stages)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    best = every.groupBy("query_id", "chunk_id").agg(F.min(F.struct("stage", "rank")).alias("b"))
    return best.select("query_id", "chunk_id", "b.stage", "b.rank")


def budget_cap(candidates: DataFrame, max_tokens: int = 2000, max_chunks: int = 15) -> DataFrame:
    """Keep the leading candidates while their tokens fit; the first is always kept.

    Input ``query_id, chunk_id, stage, rank, token_estimate``. Only ``max_chunks`` rows per
    query leave a task.
    """
    w = W.partitionBy("query_id").orderBy("stage", "rank", "chunk_id")
    top = candidates.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= max_chunks)
    run = F.sum("token_estimate").over(W.partitionBy("query_id").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    return top.withColumn("tokens_used", run).filter((F.col("place") == 1) | (F.col("tokens_used") <= max_tokens))


def _keyword_stage(queries: DataFrame, chunks: DataFrame, k: int, index: str | None = None) -> DataFrame:
    """Keyword candidates of each query among chunks of its types: its packs one after the other, up to ``k`` chunks each.

    A query without packs searches all of them together; without types all types count.
    """
    def search(side: DataFrame, within: list[str]) -> DataFrame:
        if index is None:
            return keyword_search(side, chunks, k, within=within)
        from scrollwork.operators import text_index

        return text_index.search_index(side, index, k, within)

    given = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    own = queries.select("query_id", "keywords", *[c for c in ("pack_ids", "chunk_types") if c in queries.columns])
    sides = [(own, [])]
    if "chunk_types" in own.columns:
        # a chunk has one type, so it comes once in the ranking over all types of a query
        typed = own.filter(given("chunk_types")).withColumn("chunk_type", F.explode(F.array_distinct("chunk_types")))
        sides = [(own.filter(~given("chunk_types")), []), (typed, ["chunk_type"])]
    found = []
    for side, within in sides:
        if "pack_ids" in own.columns:
            each = side.filter(given("pack_ids")).select("query_id", "keywords", *within, F.posexplode("pack_ids").alias("place", "pack_id"))
            # one search per query and pack, so that ranks and limits are the pack's own
            each = each.select(F.struct("query_id", "place").alias("query_id"), "keywords", "pack_id", *within)
            packed = search(each, ["pack_id", *within])
            found.append(packed.select("query_id.query_id", "chunk_id", (F.col("query_id.place") * k + F.col("rank")).alias("rank")))
            side = side.filter(~given("pack_ids"))
        found.append(search(side, within).select("query_id", "chunk_id", "rank"))
    return reduce(DataFrame.unionByName, found)


def _vector_stage(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    packs = queries.where("vector IS NOT NULL").select("query_id", F.posexplode("pack_ids").alias("place", "collection"))
    found = vector_search(queries.where("vector IS NOT NULL").select("query_id", "vector"), items.join(packs.select("collection").distinct(), "collection", "left_semi"), k)
    return found.join(packs, ["query_id", "collection"]).select("query_id", F.col("item_id").alias("chunk_id"), (F.col("place") * k + F.col("rank")).alias("rank"))


def retrieve(
    queries: DataFrame, chunks: DataFrame, manifest: DataFrame | None = None, vectors: DataFrame | None = None,
    max_tokens: int = 2000, max_chunks: int = 15, index: str | None = None, items: DataFrame | None = None,
) -> DataFrame:
    """All stages: manifest, keywords, references, then vectors, under a budget.

    With ``index`` (a path of ``text_index``) keywords are looked up there and no chunk text is read. Vectors come as an outside
    ranking (``vectors``), or from ``items(item_id, vector, collection)``: each pack that a query declares is a collection of its
    own, searched for ``max_chunks`` chunks, one pack after the other; a query without packs or vector finds none.
    """
    stages = []
    if manifest is not None:
        stages.append(manifest_lookup(queries, manifest, max_chunks))
    stages.append(_keyword_stage(queries, chunks, 2 * max_chunks, index))
    if "pack_ids" in queries.columns:
        stages.append(ref_search(queries, chunks, max_chunks))
    if vectors is not None:
        stages.append(vectors.select("query_id", "chunk_id", "rank"))
    if items is not None:
        stages.append(_vector_stage(queries, items, max_chunks))
    merged = merge_candidates(*stages).join(chunks.select("chunk_id", "token_estimate"), "chunk_id")
    return budget_cap(merged, max_tokens, max_chunks)


def retrieve_for_scene(queries: DataFrame, chunks: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    return retrieve(queries, chunks, manifest, max_tokens=2000, max_chunks=15)


def retrieve_for_entity(entities: DataFrame, chunks: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """One query per entity id, with the id's words as keyword."""
    q = entities.select(
        F.col("entity_id").alias("query_id"),
        F.array(F.regexp_replace("entity_id", "[-_]", " ")).alias("keywords"),
        F.array("entity_id").alias("entity_ids"),
    )
    return retrieve(q, chunks, manifest, max_tokens=800, max_chunks=5)
