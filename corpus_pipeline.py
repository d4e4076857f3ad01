"""Corpus pipeline: five filtering and shaping stages over ``documents``, ending in packed training sequences.

Each stage reads all that the one before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from scrollwork.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from scrollwork.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, null texts and texts unlike all languages of the table go. Without any known language
    to learn from, only texts with letters could not be judged, so all rows stay."""
    model = language_id.fit(language_id.training_rows(docs))
    return docs if model is None else language_id.accepted(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, documents stay, with ``n_chars`` of the new text."""
    out = line_dedup.drop_repeated_lines(docs)
    n_chars = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.select(*[F.col("text") if c == "text" else n_chars[c].alias(c) if c in n_chars else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def spare(docs: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened where ``docs`` has such a column (Spark's names do not know case)."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class stays, once even where its row repeats. Different texts under one id are
    documents of their own here, so that none goes that is like no other. Rows without an id are not compared and stay."""
    key, nth, k = spare(docs, "key", "nth", "k")
    keyed = docs.where("doc_id IS NOT NULL").withColumn(key, F.xxhash64("doc_id", "text"))
    classes = near_dedup.near_duplicates(keyed, id_col=key).select(F.col("doc_id").alias(k), "group_id").distinct()
    first = classes.join(keyed.select("doc_id", F.col(key).alias(k)), k).groupBy("group_id").agg(F.min(F.struct("doc_id", k)).alias("first"))
    one = Window.partitionBy(key, "doc_id", "text").orderBy(*[f"`{c}`" for c in docs.columns if c not in ("doc_id", "text")] or [key])
    stay = first.select(F.col(f"first.{k}").alias(key))
    named = keyed.join(stay, key, "left_semi").withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1).drop(nth, key)
    return named.unionByName(docs.where("doc_id IS NULL"))


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item or an edited copy of one go; null texts hold none and stay. Rows are told apart by a 128-bit
    digest of id and text, so rows without an id are judged by their text, and rows that repeat both go or stay together."""
    (key,) = spare(docs, "key")
    id_text = F.to_json(F.struct(F.col("doc_id").cast("string").alias("i"), F.col("text").alias("t")))
    keyed = docs.withColumn(key, F.md5(id_text.cast("binary")))
    found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(found, key, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts are empty and hold the end id only; repeated rows are documents of their own; other columns are ignored."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_copies),
    ("packing", pack_sequences),
]

#: Models, alignments and tokenizers are beyond SQL; tests/llm compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
