"""Content types and routes from pattern counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scrollwork.functions import fixed, ordered, text as T
from scrollwork.session import cut_lineage


def density(low: Column, words: Column, patterns=fixed.DENSITY_PATTERNS) -> Column:
    """Matches of the whole alternation per hundred words; overlaps count once."""
    plain = T.ascii_safe(patterns)
    every = T.alternation([T.lowered(p) for p in patterns])
    hits = T.matches(T.ascii_form(low), every) if plain else T.matches(low, T.pattern(every, False))
    return hits / F.greatest(words, F.lit(1)) * 100


def pattern_density(df: DataFrame, col: str = "content", words: str = "word_count", out: str = "density") -> DataFrame:
    return T.hold(df, {out: density(F.lower(col), F.col(words))})


def type_scores(df: DataFrame, rules=fixed.TYPE_PATTERNS, col: str = "content") -> DataFrame:
    """One ``s_<type>`` column per content type."""
    plain = T.ascii_safe([p for _, pats in rules for p in pats])
    low = T.ascii_form(F.lower(col)) if plain else F.lower(col)
    d = T.hold(df, {"__low": low})
    flags = "" if plain else None
    scores = {f"s_{name}": T.patterns_total(F.col("__low"), pats, False, flags).cast("double") for name, pats in rules}
    return T.hold(d, scores).drop("__low")


def apply_hints(df: DataFrame, hints=fixed.TYPE_HINTS, order=fixed.TYPE_ORDER, intent: str = "intent", bonus: float = 2.0) -> DataFrame:
    added = {}
    for name in order:
        intents = [i for i, types in hints if name in types]
        base = F.col(f"s_{name}") if f"s_{name}" in df.columns else F.lit(0.0)
        gain = F.when(F.col(intent).isin(intents), bonus).otherwise(0.0) if intents else F.lit(0.0)
        added[f"s_{name}"] = base + gain
    return df.withColumns(added)


def best_type(df: DataFrame, order=fixed.TYPE_ORDER) -> DataFrame:
    best = T.best_of([(n, F.col(f"s_{n}")) for n in order if f"s_{n}" in df.columns])
    d = T.hold(df, {"__b": best})
    hit = F.col("__b.score") > 0
    return (
        d.withColumn("content_type", F.when(hit, F.col("__b.name")).otherwise("general"))
        .withColumn("confidence", F.when(hit, F.least(F.col("__b.score") / 5.0, F.lit(0.95))).otherwise(0.3))
        .drop("__b")
    )


def route(df: DataFrame, bias=fixed.ROUTE_BIAS, intent: str = "intent") -> DataFrame:
    d = df.withColumn("__d", F.col("density") + T.first_in(F.col(intent), bias, 0.0))
    high, mid = F.col("__d") > 2.0, F.col("__d") > 0.5
    plain = F.when(high & F.col("content_type").isin("rules", "table"), "systems").when(high | mid, "both").otherwise("lore")
    kept = F.when((F.col(intent) == "mechanics") & (plain == "lore"), "both").otherwise(plain)
    return (
        d.withColumn("route", kept)
        .withColumn("confidence", F.when(high, F.greatest("confidence", F.lit(0.6))).otherwise(F.col("confidence")))
        .drop("__d")
    )


def classify(df: DataFrame, col: str = "content", words: str = "word_count", intent: str = "intent") -> DataFrame:
    """Density, type, confidence and route of every segment: one pass, no shuffle."""
    d = pattern_density(df, col, words)
    d = apply_hints(type_scores(d, col=col), intent=intent)
    d = route(best_type(d), intent=intent)
    return d.drop(*[f"s_{n}" for n in fixed.TYPE_ORDER])


def review_queue(df: DataFrame, order: list[str], span: Column, below: float = 0.7, size: int = 10, preview: int = 500) -> DataFrame:
    """Low-confidence segments of a document in batches, with a text preview.

    Numbering reads its rows twice, so they are written first: texts are classified once and only previews move on.
    """
    low = df.filter(F.col("confidence") < below).withColumn("preview", F.substring("content", 1, preview)).drop("content")
    d = ordered.add_row_number(cut_lineage(low), ["doc_id"], order, span, "__rn")
    return d.withColumn("batch_no", F.floor((F.col("__rn") - 1) / size)).drop("__rn")


def apply_verdicts(df: DataFrame, verdicts: DataFrame, key: list[str]) -> DataFrame:
    """Take an outside verdict's type and route where they are valid values."""
    v = verdicts.select(
        *key, F.col("content_type").alias("__t"), F.col("route").alias("__r"), F.col("confidence").alias("__c"),
        F.lit(True).alias("__hit"),
    )
    j = df.join(v, key, "left")
    return (
        j.withColumn("content_type", F.when(F.col("__t").isin(fixed.CONTENT_TYPES), F.col("__t")).otherwise(F.col("content_type")))
        .withColumn("route", F.when(F.col("__r").isin(fixed.ROUTES), F.col("__r")).otherwise(F.col("route")))
        .withColumn("confidence", F.when(F.col("__hit"), F.coalesce("__c", F.lit(0.8))).otherwise(F.col("confidence")))
        .drop("__t", "__r", "__c", "__hit")
    )


def route_counts(df: DataFrame, keys: list[str] = ["doc_id"]) -> DataFrame:
    return df.groupBy(*keys, "content_type", "route").agg(F.count(F.lit(1)).alias("segments"))
