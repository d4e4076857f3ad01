"""Which texts hold which short strings, without comparing all of them.

A pattern is cut into grams of one size, the largest of ``SIZES`` that fits into it, and can only stand in texts that have all of them.
So it is enough to look where its rarest one occurs: a pattern meets as many texts as its rarest gram has, however many share
its first letters, and none at all when one of its grams is nowhere. Only those candidates are searched. Of the texts, only grams of
sizes that some pattern has are made.

How many grams a text has is not in Spark's estimates, so grams are joined by sorting and never broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scrollwork.session import deal_wide

#: grams of three characters are shared by many patterns once there are many, so longer patterns have longer ones
SIZES = (1, 2, 3, 4, 6, 8)


def _windows(c: Column, k: Column) -> Column:
    starts = F.when(F.length(c) >= k, F.sequence(F.lit(1), F.length(c) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(c, i, k))


def gram_size(c: Column) -> Column:
    """The size of a pattern's grams."""
    return F.greatest(*[F.when(F.length(c) >= k, F.lit(k)) for k in SIZES])


def grams(c: Column, sizes: Column) -> Column:
    """Distinct substrings of the given sizes."""
    return F.array_distinct(F.flatten(F.transform(sizes, lambda k: _windows(c, k))))


def pattern_grams(c: Column) -> Column:
    """Distinct grams of a pattern that is not empty."""
    return F.array_distinct(_windows(c, gram_size(c)))


def rarest(patterns: DataFrame, text_grams: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``pattern``, ``g``: the gram that the fewest texts of the key hold, for patterns whose grams all occur."""
    counts = text_grams.groupBy(*keys, "g").agg(F.count(F.lit(1)).alias("n"))
    own = patterns.select(*keys, "pattern", F.size(pattern_grams(F.col("pattern"))).alias("all"), F.explode(pattern_grams(F.col("pattern"))).alias("g"))
    found = own.hint("merge").join(counts, [*keys, "g"]).groupBy(*keys, "pattern", "all").agg(F.count(F.lit(1)).alias("met"), F.min(F.struct("n", "g")).alias("least"))
    return found.where("met = all").select(*keys, "pattern", F.col("least.g").alias("g"))


def candidates(texts: DataFrame, patterns: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``text``, ``pattern`` pairs that share the pattern's rarest gram."""
    texts = texts.select(*keys, "text", F.xxhash64("text").alias("t")).distinct()
    patterns = patterns.select(*keys, "pattern").where("pattern <> ''").distinct()
    sizes = patterns.agg(F.collect_set(gram_size(F.col("pattern"))).alias("sizes"))  # one row of at most len(SIZES) numbers
    dealt = deal_wide(texts, *keys, "t").crossJoin(F.broadcast(sizes))
    text_grams = dealt.select(*keys, "t", F.explode(grams(F.col("text"), F.col("sizes"))).alias("g"))
    pairs = rarest(patterns, text_grams, keys).join(text_grams.hint("merge"), [*keys, "g"])
    # two texts that share a hash would meet twice
    return pairs.select(*keys, "t", "pattern").distinct().join(texts, [*keys, "t"]).select(*keys, "text", "pattern")


def containing(texts: DataFrame, patterns: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``text``, ``pattern`` where the text holds the pattern. ``texts(keys, text)``, ``patterns(keys, pattern)``;
    null and empty patterns stand nowhere, and null keys meet nothing."""
    return candidates(texts, patterns, keys).where(F.contains("text", "pattern"))
