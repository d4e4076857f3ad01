"""Guidance segments and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scrollwork.functions import fixed, ordered, text as T


def _mentions(c: Column, phrases: list[str]) -> Column:
    low = F.coalesce(F.lower(c), F.lit(""))
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p))
    return out


def guidance_segments(segs: DataFrame, phrases=fixed.GUIDANCE_PHRASES) -> DataFrame:
    """Segments not routed to rules only, whose section or title holds an indicator phrase."""
    hit = _mentions(F.col("source_section"), phrases) | _mentions(F.col("title"), phrases)
    return segs.filter((F.coalesce("route", F.lit("")) != "systems") & hit)


def guidance_chunks(
    segs: DataFrame, rules=fixed.GUIDANCE_RULES, separator: str = r"\n\s*\n", least: int = 50, floor: float = 0.5
) -> DataFrame:
    """Paragraphs with their best-scoring category; the first rule wins ties."""
    rows = segs.select("doc_id", "seg_no", F.posexplode(F.split("content", separator)).alias("para_no", "para"))
    rows = rows.withColumn("para", T.strip(F.col("para"))).filter(F.length("para") >= least)
    scored = []
    for i, (pat, meaning, base) in enumerate(rules):
        n = T.matches(F.col("para"), T.pattern(pat))
        conf = F.when(n > 0, F.least(F.lit(base) + n * F.lit(0.05), F.lit(0.95))).otherwise(0.0)
        scored.append(F.struct(F.round(conf, 4).alias("c"), F.lit(-i).alias("p"), F.lit(meaning).alias("m")))
    best = T.hold(rows, {"b": F.array_max(F.array(*scored))}).filter((F.col("b.c") > 0) & (F.col("b.c") >= floor))
    return best.select("doc_id", "seg_no", "para_no", "para", F.col("b.m").alias("category"), F.col("b.c").alias("confidence"))


def universal_flag(df: DataFrame, col: str = "para", general=fixed.UNIVERSAL_PATTERNS, special=fixed.SPECIFIC_PATTERNS) -> DataFrame:
    low = F.lower(col)
    g, s = T.patterns_hit(low, general, False), T.patterns_hit(low, special, False)
    return df.withColumn("is_universal", (g > s) & (g > 0))


def guidance_by_category(chunks: DataFrame, width: int = 1000) -> DataFrame:
    """Position of every paragraph within its category, best first."""
    d = chunks.withColumn("__neg", -F.col("confidence"))
    span = F.struct(F.col("__neg"), F.floor(F.col("seg_no") / width))
    return ordered.add_row_number(d, ["doc_id", "category"], ["__neg", "seg_no", "para_no"], span, "place").drop("__neg")


def guidance_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("category", "is_universal").agg(
        F.count(F.lit(1)).alias("chunks"), F.max("confidence").alias("best_confidence")
    )
