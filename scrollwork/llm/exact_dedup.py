"""Exact duplicates by skew-safe combining. DataFrame functions only.

Every grouping has the whole text in its key, so equal digests of different texts are never merged:

1. each task combines its own rows of a (digest, salt, text) group before the shuffle;
2. the rows of a salted digest group meet. The salt comes from the id, so a text that makes up a third
   of all rows is spread over ``salts`` tasks, and after step 1 each task sends at most one row a salt;
3. the winners of the salts meet by digest.

Winners (without their texts) go to a table in the shared folder. Rows find their winner by digest and salt,
which again spreads hot texts. Where two texts share a digest, the winner keeps its text and rows are
matched on it. With SHA-256 this will not happen; the tests use a weak digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scrollwork.llm.common import docs_of, query, table, written


def sha256(c: Column) -> Column:
    return F.unhex(F.sha2(c, 256))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: ``doc_id``, ``keep_id`` (largest id with this text), ``group_size``, ``kept``.

    Null text equals the empty text. Null ids are counted, and never stay unless the whole group has none (then
    ``keep_id`` is null and ``kept`` true). Rows that repeat id and text share one verdict. An empty table gives no rows.
    Other columns are ignored. ``salts`` is at most 63.
    """
    rows = docs_of(df, id_col, text_col).withColumns({"digest": digest(F.col("text")), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")})
    salted = rows.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    by_text = (
        salted.repartition("digest")
        .groupBy("digest", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("used"))
    )
    shared = F.count("*").over(Window.partitionBy("digest")) > 1
    used = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda i: F.getbit("used", i) == 1)
    winners = written(by_text.withColumn("content", F.when(shared, F.col("text"))).select("digest", F.explode(used).alias("salt"), "keep_id", "group_size", "content"), "winners")

    found = rows.join(winners.where("content IS NULL"), ["digest", "salt"])
    collided = winners.where("content IS NOT NULL")
    if not collided.isEmpty():
        found = found.unionByName(rows.join(collided, ["digest", "salt"]).where("text = content"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


@query("""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
