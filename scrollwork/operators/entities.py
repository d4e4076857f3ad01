"""Entities, enrichment and file assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scrollwork.functions import fixed, ordered, text as T


def lore_segments(df: DataFrame) -> DataFrame:
    return df.filter(F.col("route").isin("lore", "both"))


def entities_from_segments(df: DataFrame) -> DataFrame:
    """Segments whose type, or else whose intent, names an entity kind."""
    by_type = F.col("content_type").isin("npc", "location", "faction", "item")
    intents = [i for i, _ in fixed.INTENT_TO_ENTITY]
    return df.filter(by_type | F.col("intent").isin(intents)).select(
        "doc_id",
        T.slugify(F.col("title")).alias("entity_id"),
        F.col("title").alias("name"),
        F.when(by_type, T.first_in(F.col("content_type"), fixed.TYPE_TO_FILE, "general"))
        .otherwise(T.first_in(F.col("intent"), fixed.INTENT_TO_ENTITY, "general"))
        .alias("entity_type"),
        "seg_no",
    )


def dedupe_entities(df: DataFrame, keys: list[str] = ["doc_id", "entity_id"], order: str = "seg_no") -> DataFrame:
    """First occurrence of every id, with the number of segments naming it (partial aggregation)."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("f"), F.count(F.lit(1)).alias("mentions"))
    return first.select(*keys, "f.*", "mentions")


def entities_by_type(df: DataFrame) -> DataFrame:
    return df.groupBy("doc_id", "entity_type").agg(F.count(F.lit(1)).alias("entities"))


def attach_refs(segs: DataFrame, entities: DataFrame) -> DataFrame:
    """Related ids of the segment's entity, with its own id first where it is missing."""
    e = entities.select("doc_id", "entity_id", F.col("related").alias("__rel"))
    j = segs.withColumn("entity_id", T.slugify(F.col("title"))).join(e, ["doc_id", "entity_id"], "left")
    own = F.array("entity_id")
    refs = (
        F.when(F.col("__rel").isNull(), F.array().cast("array<string>"))
        .when(F.array_contains("__rel", F.col("entity_id")), F.col("__rel"))
        .otherwise(F.concat(own, "__rel"))
    )
    return j.withColumn("entity_refs", refs).drop("__rel")


def size_flags(df: DataFrame, words: str = "word_count", small: int = 50, large: int = 3000) -> DataFrame:
    return df.withColumn("size_flag", F.when(F.col(words) < small, "small").when(F.col(words) > large, "large").otherwise("ok"))


def annotation_batches(df: DataFrame, order: list[str], span: Column, size: int = 20) -> DataFrame:
    """Number the batches handed to an outside annotator."""
    d = ordered.add_row_number(df, ["doc_id"], order, span, "__rn")
    return d.withColumn("batch_no", F.floor((F.col("__rn") - 1) / size)).drop("__rn")


def merge_tags(df: DataFrame, tags: DataFrame, key: list[str]) -> DataFrame:
    """Union a file's tags with the returned ones; tags are a set, kept sorted."""
    t = tags.select(*key, F.col("tags").alias("__new"))
    j = df.join(t, key, "left")
    return j.withColumn(
        "tags", F.array_sort(F.array_union("tags", F.coalesce("__new", F.array().cast("array<string>"))))
    ).drop("__new")


def file_dir(file_type: Column) -> Column:
    return T.first_in(file_type, fixed.FILE_DIRS, "culture")


def place_files(df: DataFrame, order: str = "seg_no") -> DataFrame:
    """Target path by type and slug; on the same path the last file wins."""
    d = df.withColumn("dir", file_dir(F.col("file_type")))
    d = d.withColumn("path", F.concat(F.col("dir"), F.lit("/"), T.slugify(F.col("title")), F.lit(".md")))
    rest = [c for c in d.columns if c not in ("doc_id", "path")]
    last = d.groupBy("doc_id", "path").agg(F.max_by(F.struct(*rest), order).alias("f"), F.count(F.lit(1)).alias("written"))
    return last.select("doc_id", "path", "f.*", "written")


def ref_index(files: DataFrame) -> DataFrame:
    """Reverse index, one row per reference; no list grows with a popular entity."""
    return files.select("doc_id", F.explode("entity_refs").alias("entity_id"), "file_no")


def promoted_entities(entities: DataFrame, files: DataFrame, least: int = 200) -> DataFrame:
    """Entities without a file of their own whose referencing files hold enough words.

    ``files``: ``doc_id, file_no, entity_id, entity_refs, word_count``.
    """
    fit = entities.filter(F.col("entity_type").isin(fixed.PROMOTABLE))
    primary = files.filter(F.col("entity_id") != "").select("doc_id", "entity_id").distinct()
    fit = fit.join(primary, ["doc_id", "entity_id"], "left_anti")
    sized = files.filter(F.col("word_count") > 0).select(
        "doc_id", F.explode("entity_refs").alias("entity_id"), "file_no", "word_count"
    )
    totals = sized.groupBy("doc_id", "entity_id").agg(
        F.count(F.lit(1)).alias("excerpts"), F.sum("word_count").cast("bigint").alias("words"),
        F.min("file_no").alias("first_file"),
    )
    return fit.join(totals.filter(F.col("words") >= least), ["doc_id", "entity_id"])


def promoted_excerpts(promoted: DataFrame, files: DataFrame) -> DataFrame:
    """The promoted files' text: the description as excerpt -1, then the referencing bodies by file."""
    keys = promoted.select("doc_id", "entity_id", "name", "entity_type", "description")
    bodies = files.filter(F.col("body") != "").select("doc_id", F.explode("entity_refs").alias("entity_id"), "file_no", "body")
    lead = keys.filter(F.col("description") != "").select(
        "doc_id", "entity_id", "name", "entity_type", F.lit(-1).cast("bigint").alias("file_no"), F.col("description").alias("body")
    )
    rest = bodies.join(keys.drop("description"), ["doc_id", "entity_id"])
    return lead.unionByName(rest)


def review_summary(files: DataFrame, below: float = 0.5) -> DataFrame:
    """Files per target directory, and how many of them have low confidence."""
    return files.groupBy("doc_id", file_dir(F.col("file_type")).alias("dir")).agg(
        F.count(F.lit(1)).alias("files"), F.count(F.when(F.col("confidence") < below, 1)).alias("low_confidence")
    )


def low_confidence(files: DataFrame, below: float = 0.5) -> DataFrame:
    return files.filter(F.coalesce("confidence", F.lit(1.0)) < below).select("doc_id", "title", "file_type", "confidence")
