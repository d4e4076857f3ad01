"""Page cleaning. Input: ``doc_id, page_num, text`` (one row per page)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scrollwork.functions import ordered, text as T


def page_stats(pages: DataFrame) -> DataFrame:
    """Characters per page after stripping, with the document's totals alongside."""
    chars = pages.select("doc_id", "page_num", F.length(T.strip(F.col("text"))).cast("bigint").alias("char_count"))
    totals = chars.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("char_count").alias("doc_chars"), F.max("char_count").alias("max_chars")
    )
    return chars.join(totals, "doc_id")


def _span(span: Column | None) -> Column:
    return ordered.steps("page_num") if span is None else span


def sample_pages(pages: DataFrame, k: int = 10, span: Column | None = None) -> DataFrame:
    """Every step-th page of a document, ``step = max(1, n div k)``, at most ``k`` of them."""
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    numbered = ordered.add_row_number(pages, ["doc_id"], ["page_num"], _span(span), "__pos").join(counts, "doc_id")
    step = F.greatest(F.lit(1), F.floor(F.col("n_pages") / k))
    at = F.col("__pos") - 1
    return numbered.filter((at % step == 0) & (at / step < k)).drop("__pos")


def _edge(line: Column) -> Column:
    """A header or footer line without its trailing page number."""
    return T.strip(F.regexp_replace(line, r"\s*\d+\s*$", ""))


def repeated_lines(
    pages: DataFrame, k: int = 10, share: float = 0.5, more_than: int = 4, span: Column | None = None
) -> DataFrame:
    """Header and footer lines found on at least ``share`` of the sampled pages."""
    full = T.filled_lines(F.col("text"))
    edges = pages.select(
        "doc_id",
        "page_num",
        F.slice(full, 1, 2).alias("head"),
        F.slice(full, F.greatest(F.size(full) - 1, F.lit(1)), 2).alias("foot"),
    )
    sampled = sample_pages(edges, k, span).filter(F.col("n_pages") > more_than)
    sizes = sampled.groupBy("doc_id").agg(F.countDistinct("page_num").alias("sample"))
    sides = sampled.select(
        "doc_id",
        F.explode(
            F.concat(
                F.transform("head", lambda x: F.struct(F.lit("head").alias("side"), _edge(x).alias("line"))),
                F.transform("foot", lambda x: F.struct(F.lit("foot").alias("side"), _edge(x).alias("line"))),
            )
        ).alias("e"),
    ).select("doc_id", "e.side", "e.line")
    counts = sides.filter(F.length("line") > 3).groupBy("doc_id", "line").agg(
        F.count(F.when(F.col("side") == "head", 1)).alias("heads"),
        F.count(F.when(F.col("side") == "foot", 1)).alias("feet"),
    )
    # a line seen on both sides is judged by its footer count
    seen = F.when(F.col("feet") > 0, F.col("feet")).otherwise(F.col("heads"))
    return (
        counts.withColumn("times", seen)
        .join(sizes, "doc_id")
        .filter(F.col("times") >= F.col("sample") * share)
        .select("doc_id", "line", "times", "sample")
    )


def strip_lines(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """Remove repeated lines and pure page-number lines.

    A document has at most a handful of repeated lines (two positions, each on half of
    ten sampled pages), so they travel as one small array per document.
    """
    noise = repeated.groupBy("doc_id").agg(F.collect_set("line").alias("__noise"))
    joined = pages.join(noise, "doc_id", "left")
    nothing = F.array().cast("array<string>")
    kept = F.filter(
        T.lines(F.col("text")),
        lambda x: ~T.strip(x).rlike(r"^\d+$")
        & ~F.array_contains(F.coalesce(F.col("__noise"), nothing), _edge(T.strip(x))),
    )
    return joined.withColumn("text", F.array_join(kept, "\n")).drop("__noise")


def reorder_columns(blocks: DataFrame) -> DataFrame:
    """Reading order of two-column pages from text blocks.

    Input ``doc_id, page_num, ord, x0, y0, x1, text, page_width``; output one row per page
    with ``text`` set only where two columns were found. Groups are single pages.
    """
    mid = F.col("page_width") / 2
    band = (
        F.when(F.col("x1") - F.col("x0") > F.col("page_width") * 0.7, "full")
        .when(F.col("x1") <= mid + 20, "left")
        .when(F.col("x0") >= mid - 20, "right")
        .otherwise("full")
    )
    item = F.struct("y0", "ord", band.alias("band"), T.strip(F.col("text")).alias("text"))
    page = blocks.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(item)).alias("b"))

    def of(name: str) -> Column:
        return F.filter("b", lambda x: x["band"] == name)

    page = page.select("doc_id", "page_num", "b", of("left").alias("l"), of("right").alias("r"), of("full").alias("f"))
    top = F.least(F.get("l", F.lit(0))["y0"], F.get("r", F.lit(0))["y0"])
    low = F.greatest(F.get("l", F.size("l") - 1)["y0"], F.get("r", F.size("r") - 1)["y0"])
    page = page.withColumn("top", top).withColumn("low", low)
    parts = F.concat(
        F.filter("f", lambda x: x["y0"] < F.col("top")), F.col("l"), F.col("r"),
        F.filter("f", lambda x: x["y0"] > F.col("low")),
    )
    two = (F.size("b") >= 4) & (F.size("l") > 0) & (F.size("r") > 0)
    return page.select(
        "doc_id", "page_num", F.when(two, F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n")).alias("text")
    )


def first_pages(pages: DataFrame, k: int) -> DataFrame:
    """The first ``k`` page numbers of every document (a group-limited rank: few rows shuffle)."""
    w = W.partitionBy("doc_id").orderBy("page_num")
    return pages.select("doc_id", "page_num").withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")
