"""Connected components as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from scrollwork.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``v`` and ``root`` (smallest vertex of its component) for every vertex of ``edges(a, b)``.

    Large-star and small-star steps alternate; each round is written to the shared folder, and the number of rounds grows
    with the logarithm of the component's size. A vertex with very many edges is a hot key of one join only, whose other
    side has one row for it, so skewed partitions are split at run time. Loops and repeated edges do no harm; rows with a
    null are left out.
    """
    now, mark = _kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("m")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("m").alias("u"), F.col("u").alias("m")))
        lowest = both.groupBy("u").agg(F.least(F.min("m"), F.col("u")).alias("low"))
        large = both.join(lowest, "u").where("m > u").select(F.col("m").alias("u"), F.col("low").alias("m"))
        lowest = large.groupBy("u").agg(F.min("m").alias("low"))
        pair = F.array(F.struct("u", F.col("low").alias("m")), F.struct(F.col("m").alias("u"), F.col("low").alias("m")))
        small = large.join(lowest, "u").select(F.explode(pair).alias("e")).select("e.u", "e.m").where("u <> m").distinct()
        now, after = _kept(small)
        if after == mark:
            break
        mark = after
    return now.select(F.col("u").alias("v"), F.col("m").alias("root")).unionByName(now.select(F.col("m").alias("v"), F.col("m").alias("root")).distinct())


def _kept(edges: DataFrame) -> tuple[DataFrame, dict]:
    """Written edges, and their count and hash, observed while they are written."""
    seen = Observation()
    out = written(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "m")).alias("h")), "edges")
    return out, seen.get
