"""Segmentation: header splits, packing, size limits. Text never leaves its row to be cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scrollwork.functions import fixed, ordered, text as T


def drop_meta(sections: DataFrame) -> DataFrame:
    """Drop sections with meta intent, and the children of dropped sections."""
    meta = sections.filter(F.col("intent") == "meta").select("doc_id", F.col("section_id").alias("parent_id"))
    return sections.filter(F.col("intent") != "meta").join(meta, ["doc_id", "parent_id"], "left_anti")


def header_parts(content: Column, lo: int, hi: int) -> Column:
    """Array of ``struct(level, title, content)`` cut at header lines of the given levels."""
    head = rf"#{{{lo},{hi}}}[^\S\n]+[^\n]+"
    raw = F.split(content, rf"(?m)(?=^{head}$)")
    grab = rf"(?s)^(#{{{lo},{hi}}})[^\S\n]+([^\n]+)(?:\n(.*))?$"

    def part(p: Column) -> Column:
        hit = p.rlike(rf"^{head}")
        return F.struct(
            F.when(hit, F.length(F.regexp_extract(p, grab, 1))).otherwise(0).alias("level"),
            F.when(hit, T.strip(F.regexp_extract(p, grab, 2))).otherwise("").alias("title"),
            F.when(hit, F.regexp_extract(p, grab, 3)).otherwise(p).alias("content"),
        )

    return F.transform(raw, part)


def split_headers(df: DataFrame, lo: int = 2, hi: int = 4, col: str = "content", title: str = "title") -> DataFrame:
    """One row per header part; untitled parts are named after the section and their number."""
    parts = df.withColumn("__parts", header_parts(F.col(col), lo, hi)).withColumn("parts", F.size("__parts"))
    rows = parts.select("*", F.posexplode("__parts").alias("part_no", "__p")).drop("__parts")
    own = F.nullif(F.col("__p.title"), F.lit(""))
    named = F.when(F.col("parts") == 1, F.coalesce(own, F.col(title))).otherwise(
        F.coalesce(own, F.concat(F.col(title), F.lit(" (Part "), F.col("part_no") + 1, F.lit(")")))
    )
    return (
        rows.withColumn("seg_title", named)
        .withColumn("seg_text", T.strip(F.col("__p.content")))
        .withColumn("word_count", T.word_count(F.col("seg_text")))
        .drop("__p")
    )


def paragraphs(content: Column, separator: str = r"\n\s*\n") -> Column:
    return F.filter(F.transform(F.split(content, separator), T.strip), lambda x: x != "")


def pack_starts(sizes: Column, most: int) -> Column:
    """1-based start position of every group when units are packed greedily up to ``most`` words."""

    def step(acc: Column, n: Column) -> Column:
        opens = (acc["cur"] == 0) & (acc["i"] == 0) | (acc["cur"] + n > most) & (acc["filled"])
        return F.struct(
            F.when(opens, F.concat(acc["at"], F.array(acc["i"] + 1))).otherwise(acc["at"]).alias("at"),
            F.when(opens, n).otherwise(acc["cur"] + n).alias("cur"),
            (acc["i"] + 1).alias("i"),
            F.lit(True).alias("filled"),
        )

    zero = F.lit(0)
    seed = F.struct(
        F.array().cast("array<int>").alias("at"), zero.alias("cur"), zero.alias("i"), F.lit(False).alias("filled")
    )
    return F.aggregate(sizes, seed, step, lambda acc: acc["at"])


def pack_units(df: DataFrame, max_words: int, col: str = "content", separator: str = r"\n\s*\n", glue: str = "\n\n") -> DataFrame:
    """Greedy paragraph packing; a paragraph longer than the limit stays whole.

    Sequential by nature, so it runs over the array of one section's paragraph sizes.
    """
    d = df.withColumn("__u", paragraphs(F.col(col), separator))
    d = d.withColumn("__at", pack_starts(F.transform("__u", T.word_count), max_words))
    d = d.select("*", F.posexplode("__at").alias("part_no", "__from"))
    to = F.coalesce(F.get("__at", F.col("part_no") + 1), F.size("__u") + 1)
    d = d.withColumn("part_text", F.array_join(F.slice("__u", F.col("__from"), to - F.col("__from")), glue))
    return (
        d.withColumn("parts", F.size("__at"))
        .withColumn("part_words", T.word_count(F.col("part_text")))
        .drop("__u", "__at", "__from")
    )


def slice_words(df: DataFrame, n: int, col: str = "content") -> DataFrame:
    """Fixed slices of ``n`` words."""
    d = df.withColumn("__w", T.word_array(F.col(col))).filter(F.size("__w") > 0)
    d = d.select("*", F.posexplode(F.sequence(F.lit(1), F.size("__w"), F.lit(n))).alias("part_no", "__from"))
    d = d.withColumn("__s", F.slice("__w", F.col("__from"), n))
    return d.withColumn("part_text", F.array_join("__s", " ")).withColumn("part_words", F.size("__s")).drop("__w", "__from", "__s")


def boilerplate_hits(content: Column, patterns=fixed.BOILERPLATE_PATTERNS) -> Column:
    return T.patterns_hit(content, patterns)


def is_boilerplate(content: Column, words: Column, patterns=fixed.BOILERPLATE_PATTERNS) -> Column:
    body = T.strip(content)
    shouting = (F.length(body) < 100) & ~body.rlike(r"\p{Ll}") & F.replace(body, F.lit(" "), F.lit("")).rlike(r"^\p{L}+$")
    hits = boilerplate_hits(body, patterns)
    return shouting | (hits >= 2) | ((hits >= 1) & (words < 50))


def drop_boilerplate(df: DataFrame, col: str = "content", words: str = "word_count") -> DataFrame:
    return df.filter(~is_boilerplate(F.col(col), F.col(words)))


def merge_small(segs: DataFrame, lo: int = 100, span: Column | None = None) -> DataFrame:
    """Give every segment its merge group: a short one swallows the next, which is then skipped.

    Whether a segment is swallowed depends only on how many short segments stand right
    before it: an odd run swallows it. That needs a rank and the last long segment, not a
    walk over the document. ``segs`` carries ``doc_id, seg_no, word_count``.
    """
    sp = ordered.steps("seg_no") if span is None else span
    d = ordered.add_row_number(segs, ["doc_id"], ["seg_no"], sp, "__rn")
    long_at = F.when(F.col("word_count") >= lo, F.col("__rn"))
    d = ordered.add_last_seen(d, ["doc_id"], ["seg_no"], sp, long_at, "__long", strict=True)
    run = F.col("__rn") - 1 - F.coalesce("__long", F.lit(0))
    return d.withColumn("group_no", F.when(run % 2 == 1, F.col("__rn") - 1).otherwise(F.col("__rn"))).drop("__rn", "__long")


def enforce_sizes(segs: DataFrame, lo: int = 100, hi: int = 1500, separator: str = r"\n\s*\n", span: Column | None = None) -> DataFrame:
    """Merge undersized segments with their successor, split oversized ones.

    Input ``doc_id, seg_no, title, content, word_count``. A merge group has one or two rows.
    """
    pair = F.array_sort(F.collect_list(F.struct("seg_no", "title", "content", "word_count")))
    merged = merge_small(segs, lo, span).groupBy("doc_id", "group_no").agg(pair.alias("m"))
    merged = merged.select(
        "doc_id",
        F.col("m")[0]["seg_no"].alias("seg_no"),
        F.col("m")[0]["title"].alias("title"),
        F.array_join(F.transform("m", lambda x: x["content"]), "\n\n").alias("content"),
        F.aggregate("m", F.lit(0), lambda a, x: a + x["word_count"]).alias("word_count"),
        F.size("m").alias("merged"),
    )
    big = (F.col("merged") == 1) & (F.col("word_count") > hi * 1.5)
    fits = merged.filter(~big).withColumn("part_no", F.lit(None).cast("int"))
    over = merged.filter(big)
    many = F.size(F.split("content", separator)) > 1

    def shape(d: DataFrame) -> DataFrame:
        return d.select(
            "doc_id", "seg_no", "title", F.col("part_text").alias("content"), F.col("part_words").alias("word_count"),
            "merged", "part_no",
        )

    return (
        fits.unionByName(shape(pack_units(over.filter(many), hi, separator=separator)))
        .unionByName(shape(slice_words(over.filter(~many), hi)))
    )


def number_segments(df: DataFrame, order: list[str], span: Column) -> DataFrame:
    """Stable ids ``seg_0000`` in document order."""
    d = ordered.add_row_number(df, ["doc_id"], order, span, "__rn")
    n = (F.col("__rn") - 1).cast("string")
    padded = F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n)
    return d.withColumn("seg_id", F.concat(F.lit("seg_"), padded)).drop("__rn")


def segment_summary(segs: DataFrame, filtered: DataFrame | None = None) -> DataFrame:
    """Per document: segments, words, integer mean, and how many were filtered out."""
    out = segs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("segments"), F.sum("word_count").cast("bigint").alias("total_words"))
    out = out.withColumn("avg_words", F.floor(F.col("total_words") / F.col("segments")))
    if filtered is None:
        return out.withColumn("filtered", F.lit(0).cast("bigint"))
    gone = filtered.groupBy("doc_id").agg(F.count(F.lit(1)).alias("filtered"))
    both = out.join(gone, "doc_id", "full_outer")
    return both.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("segments", "total_words", "avg_words", "filtered")])
