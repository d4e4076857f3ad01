"""Chunks of corpus files and their keyword index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scrollwork.functions import text as T
from scrollwork.operators.segments import header_parts


def chunk(files: DataFrame) -> DataFrame:
    """Cut files at H1 and H2 lines; deeper headers stay inside. Empty chunks are dropped.

    Input ``pack_id, path, file_type, title, entity_id, body, tags, entity_refs``. On equal
    ids the last chunk wins.
    """
    rows = files.select("*", F.posexplode(header_parts(F.col("body"), 1, 2)).alias("part_no", "p"))
    rows = rows.withColumn("content", T.strip(F.col("p.content"))).filter(F.col("content") != "")
    head = F.nullif(F.col("p.title"), F.lit(""))
    section = F.when(head.isNull(), "overview").otherwise(T.slugify(head))
    stem = T.slugify(F.coalesce(F.nullif(F.col("entity_id"), F.lit("")), "title"))
    none = F.array().cast("array<string>")
    own = F.when(F.col("entity_id").isNotNull() & (F.col("entity_id") != ""), F.array("entity_id")).otherwise(none)
    rows = rows.select(
        "pack_id",
        F.concat_ws(":", F.col("pack_id"), stem, section).alias("chunk_id"),
        F.col("path").alias("file_path"),
        "part_no",
        F.coalesce(head, "title").alias("section_title"),
        "content",
        F.col("file_type").alias("chunk_type"),
        F.array_distinct(F.concat(F.coalesce("entity_refs", none), own)).alias("entity_refs"),
        F.array_distinct(F.concat(F.coalesce("tags", none), F.array("file_type"))).alias("tags"),
        T.token_estimate(F.col("content")).alias("token_estimate"),
    )
    return last_wins(rows, ["pack_id", "chunk_id"], ["file_path", "part_no"])


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__l")).select(*keys, "__l.*")


def register_packs(chunks: DataFrame, manifests: DataFrame) -> DataFrame:
    """Manifests with their chunk count; the newest first is a matter of ``orderBy(desc)`` at the end."""
    n = chunks.groupBy("pack_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return manifests.join(n, "pack_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0).cast("bigint")))


def index_text(df: DataFrame):
    """The text a chunk can be found by: title, body, type, tags and id."""
    return F.concat_ws(" ", "section_title", "content", "chunk_type", F.array_join("tags", " "), "chunk_id")


def build_postings(chunks: DataFrame, key: str = "chunk_id", col: str = "content") -> DataFrame:
    """``key, term, tf, length``: counts are combined inside the task that reads the text."""
    toks = chunks.select(key, T.terms(F.col(col)).alias("__t")).withColumn("length", F.size("__t"))
    rows = toks.select(key, "length", F.explode("__t").alias("term"))
    return rows.groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def postings_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("tf").alias("total_freq"))


def reindex(index: DataFrame, pack: list[str], rows: DataFrame) -> DataFrame:
    """Replace the rows of some packs and keep the rest (on disk: overwrite of those partitions)."""
    return index.filter(~F.col("pack_id").isin(pack)).unionByName(rows)


def index_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("token_estimate").cast("bigint").alias("tokens"),
        F.countDistinct("chunk_type").alias("types"),
    )
