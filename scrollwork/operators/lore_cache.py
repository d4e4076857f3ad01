"""Materialised retrieval results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scrollwork.functions import fixed, text as T


def categorise(kept: DataFrame) -> DataFrame:
    """Category and key of every kept chunk; briefings are keyed by the first reference.

    Input ``query_id, place, chunk_id, chunk_type, section_title, entity_refs``.
    """
    cat = T.first_in(F.coalesce("chunk_type", F.lit("general")), fixed.LORE_CATEGORIES, "atmosphere")
    first = F.coalesce(F.get("entity_refs", F.lit(0)), "section_title", F.lit("unknown"))
    return kept.withColumn("category", cat).withColumn("key", F.when(F.col("category") == "npc_briefings", first))


def materialize(kept: DataFrame) -> DataFrame:
    """One row per query, category and key with its entries in order (a query keeps 15 at most)."""
    entry = F.struct("place", "chunk_id", "section_title")
    return categorise(kept).groupBy("query_id", "category", "key").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def append_entity(cache: DataFrame, extra: DataFrame) -> DataFrame:
    """Append an entity's chunks to results that exist; others are left out.

    Both sides are entry rows ``query_id, category, key, place, chunk_id, section_title``.
    """
    cols = ["query_id", "category", "key", "place", "chunk_id", "section_title"]
    first = F.coalesce(F.get("entity_refs", F.lit(0)), "section_title", F.lit("unknown"))
    ends = cache.groupBy("query_id").agg(F.max("place").alias("__end"))
    add = extra.join(ends, "query_id").select(
        "query_id", F.lit("npc_briefings").alias("category"), first.alias("key"),
        (F.col("place") + F.col("__end")).alias("place"), "chunk_id", "section_title",
    )
    return cache.select(*cols).unionByName(add)


def latest_cache(df: DataFrame, keys: list[str], at: str = "created_at", tie: str = "id") -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("l")).select(*keys, "l.*")


def cache_misses(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(cache.select(*keys).distinct(), keys, "left_anti")


def invalidate(cache: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return cache.join(gone.select(*keys).distinct(), keys, "left_anti")
