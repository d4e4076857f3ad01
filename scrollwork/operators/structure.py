"""Headings, sections and intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scrollwork.functions import fixed, ordered, text as T
from scrollwork.operators.pages import first_pages


def text_headings(pages: DataFrame) -> DataFrame:
    """Headings found line by line: markdown, then ALL-CAPS, then numbered titles."""
    found = pages.select("doc_id", "page_num", F.posexplode(T.lines(F.col("text"))).alias("line_no", "raw"))
    s = T.strip(F.col("raw"))
    found = found.withColumn("s", s).filter(F.length("s") >= 3)
    md, num = r"(?U)^(#{1,3})\s+(.+)$", r"(?iU)^(?:Chapter\s+)?(\d+)[.:\s]+\s*([A-Z].{2,60})$"
    line = F.col("s")
    caps = (
        T.is_upper(line) & (F.length(line) > 3) & (F.length(line) < 80)
        & ~line.startswith("•") & ~line.rlike(r"^\d+\.\s")
    )
    kind = F.when(line.rlike(md), "markdown").when(caps, "allcaps").when(line.rlike(num), "numbered")
    found = T.hold(found, {"source": kind}).filter(F.col("source").isNotNull())
    title = (
        F.when(F.col("source") == "markdown", T.strip(F.regexp_extract(line, md, 2)))
        .when(F.col("source") == "allcaps", T.title_case(line))
        .otherwise(T.strip(F.regexp_extract(line, num, 2)))
    )
    level = F.when(F.col("source") == "markdown", F.length(F.regexp_extract(line, md, 1))).otherwise(1)
    return found.select("doc_id", "page_num", "line_no", title.alias("title"), level.cast("int").alias("level"), "source")


def font_headings(spans: DataFrame, most: int = 50) -> DataFrame:
    """Headings from font sizes: larger than body text and not too frequent.

    Input ``doc_id, page_num, ord, text, size``.
    """
    clean = spans.withColumn("text", T.strip(F.col("text"))).withColumn("size", F.bround("size", 1))
    clean = clean.filter(F.length("text") > 2)
    sizes = clean.groupBy("doc_id", "size").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("page_num", "ord")).alias("first")
    )
    body = sizes.groupBy("doc_id").agg(
        F.max_by("size", F.struct(F.col("n"), -F.col("first.page_num"), -F.col("first.ord"))).alias("body")
    )
    heads = sizes.join(body, "doc_id").filter((F.col("size") > F.col("body")) & (F.col("n") <= most))
    level = F.when(F.col("size") >= F.col("body") * 1.5, 1).otherwise(2)
    return clean.join(heads.select("doc_id", "size", level.alias("level")), ["doc_id", "size"]).select(
        "doc_id", "page_num", F.col("ord").alias("line_no"), F.col("text").alias("title"), "level", F.lit("font").alias("source")
    )


def toc_entries(pages: DataFrame, within: int = 10) -> DataFrame:
    """Entries of the first contents page among a document's first pages."""
    low = F.lower("text")
    marked = pages.filter(F.contains(low, F.lit("table of contents")) | T.strip(low).startswith("contents"))
    early = marked.join(first_pages(pages, within), ["doc_id", "page_num"], "left_semi")
    toc = early.groupBy("doc_id").agg(F.min_by("text", "page_num").alias("text"))
    entry = r"(?U)^(\s*)(.*?)\s*[.·…\s]{3,}\s*(\d+)\s*$"
    rows = toc.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line")).filter(F.col("line").rlike(entry))
    title = T.strip(F.regexp_extract("line", entry, 2))
    level = F.when(F.length(F.regexp_extract("line", entry, 1)) < 4, 1).otherwise(2)
    return rows.select(
        "doc_id", F.regexp_extract("line", entry, 3).try_cast("bigint").alias("page_num"), "line_no",
        title.alias("title"), level.alias("level"), F.lit("toc").alias("source"),
    ).filter(F.length("title") > 2)


def choose_headings(font: DataFrame, text: DataFrame, toc: DataFrame, enough: int = 3) -> DataFrame:
    """One heading source per document: a good contents list, else fonts, else text, else the list."""
    every = font.unionByName(text).unionByName(toc)
    n = every.groupBy("doc_id").agg(
        *[F.count(F.when(F.col("source") == s, 1)).alias(s) for s in ("font", "toc")],
        F.count(F.when(~F.col("source").isin("font", "toc"), 1)).alias("txt"),
    )
    pick = (
        F.when(F.col("toc") >= enough, "toc").when(F.col("font") > 0, "font").when(F.col("txt") > 0, "txt").otherwise("toc")
    )
    chosen = n.select("doc_id", pick.alias("pick"))
    group = F.when(F.col("source").isin("font", "toc"), F.col("source")).otherwise("txt")
    return every.withColumn("pick", group).join(chosen, ["doc_id", "pick"], "left_semi").drop("pick")


def section_ranges(headings: DataFrame, pages: DataFrame, span: Column | None = None) -> DataFrame:
    """Page range of every heading: up to the page before the next one, never empty."""
    ends = pages.groupBy("doc_id").agg(F.max("page_num").alias("__last"))
    nxt = ordered.add_next(
        headings, ["doc_id"], ["page_num", "line_no"], ordered.steps("page_num") if span is None else span,
        "page_num", "__next",
    )
    end = F.greatest(F.col("page_num"), F.coalesce(F.col("__next") - 1, F.col("__last")))
    return nxt.join(ends, "doc_id").select(
        "doc_id", "page_num", "line_no", "title", "level", F.col("page_num").alias("page_start"), end.alias("page_end"),
        F.concat_ws(":", F.col("page_num"), F.col("line_no")).alias("section_id"),
    )


def section_pages(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages of every section, as rows: the range becomes an equi-join on page number."""
    wanted = sections.select(
        "doc_id", "section_id", F.explode(F.sequence("page_start", "page_end")).alias("page_num")
    )
    return wanted.join(pages, ["doc_id", "page_num"])


def build_sections(headings: DataFrame, pages: DataFrame, span: Column | None = None) -> DataFrame:
    """Sections with the text of their pages, in page order."""
    ranges = section_ranges(headings, pages, span)
    body = section_pages(ranges, pages).groupBy("doc_id", "section_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("page_num", "text"))), lambda x: x["text"]), "\n\n"
        ).alias("content")
    )
    return ranges.join(body, ["doc_id", "section_id"], "left")


def nest_sections(sections: DataFrame, span: Column | None = None) -> DataFrame:
    """Put every deeper section under the latest level-1 section before it."""
    top = F.when(F.col("level") <= 1, F.col("section_id"))
    seen = ordered.add_last_seen(
        sections, ["doc_id"], ["page_num", "line_no"], ordered.steps("page_num") if span is None else span, top, "__top"
    )
    return seen.withColumn("parent_id", F.when(F.col("level") > 1, F.col("__top"))).drop("__top")


def classify_intent(df: DataFrame, col: str = "title", out: str = "intent", patterns=fixed.INTENT_PATTERNS) -> DataFrame:
    """Intent with the most matching patterns; a short title with any meta pattern is meta."""
    low = F.lower(F.col(col))
    d = T.hold(df, {f"__i_{n}": T.patterns_hit(low, pats, ignore_case=False) for n, pats in patterns})
    d = T.hold(d, {"__best": T.best_of([(n, F.col(f"__i_{n}")) for n, _ in patterns])})
    intent = (
        F.when((F.col("__i_meta") > 0) & (T.word_count(low) <= 5), "meta")
        .when(F.col("__best.score") > 0, F.col("__best.name"))
        .otherwise("unknown")
    )
    return d.withColumn(out, intent).drop("__best", *[f"__i_{n}" for n, _ in patterns])


def inherit_intent(sections: DataFrame) -> DataFrame:
    """A child without an intent of its own takes its parent's."""
    parents = sections.select("doc_id", F.col("section_id").alias("parent_id"), F.col("intent").alias("__from"))
    return (
        sections.join(parents, ["doc_id", "parent_id"], "left")
        .withColumn("intent", F.when(F.col("intent") == "unknown", F.coalesce("__from", "intent")).otherwise(F.col("intent")))
        .drop("__from")
    )


def document_title(pages: DataFrame, sections: DataFrame, longest: int = 100) -> DataFrame:
    """First line of the first page if short enough, else the first section, else a constant."""
    first = pages.groupBy("doc_id").agg(F.min_by(F.get(T.filled_lines(F.col("text")), F.lit(0)), "page_num").alias("line"))
    head = sections.groupBy("doc_id").agg(F.min_by("title", F.struct("page_num", "line_no")).alias("head"))
    line = F.when(F.length("line") < longest, F.col("line"))
    return first.join(head, "doc_id", "left").select(
        "doc_id", F.coalesce(line, "head", F.lit("Untitled Document")).alias("title")
    )


def whole_document(pages: DataFrame) -> DataFrame:
    """One section over all pages, for documents without headings.

    The text stays on the page rows; ``section_pages`` relates the two.
    """
    return pages.groupBy("doc_id").agg(
        F.lit("Document").alias("title"), F.lit(1).alias("level"), F.min("page_num").alias("page_start"),
        F.max("page_num").alias("page_end"), F.sum(T.word_count(F.col("text"))).cast("bigint").alias("words"),
    )


def named_ranges(pages: DataFrame, names: list[str], tail: int = 10) -> DataFrame:
    """Page ranges of sections known by name.

    A page opens a section when the name heads a specialties line, or stands alone on a page
    with ranked bullets; names without such a page take, in list order, the first bulleted
    page that mentions them and opens no other section. The name list is short and fixed.
    """
    bullets = F.col("text").rlike(r"(?m)^• +[A-Z]")
    rules = []
    for i, name in enumerate(names):
        strong = F.col("text").rlike(rf"{name}\s*\n\s*\nSpecialties:")
        alone = F.col("text").rlike(rf"(?m)^\s*{name}\s*$") & bullets
        loose = F.contains(F.col("text"), F.lit(name)) & bullets
        rules.append(
            F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"), (strong | alone).alias("opens"), loose.alias("loose"))
        )
    hits = pages.select("doc_id", "page_num", F.explode(F.array(*rules)).alias("r")).select("doc_id", "page_num", "r.*")
    hits = hits.filter("opens or loose")
    firm = hits.filter("opens").groupBy("doc_id", "i", "name").agg(F.min("page_num").alias("page_start"))
    open_names = hits.join(firm, ["doc_id", "i"], "left_anti")
    free = open_names.join(firm.select("doc_id", F.col("page_start").alias("page_num")), ["doc_id", "page_num"], "left_anti")
    # at most len(names) pages can be taken before a name, so its len(names) earliest pages suffice
    few = free.groupBy("doc_id", "i", "name").agg(F.slice(F.array_sort(F.collect_set("page_num")), 1, len(names)).alias("p"))
    queue = few.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "name", "p"))).alias("q"))
    kind = "array<struct<i:int,name:string,page_start:bigint>>"

    def take(acc: Column, it: Column) -> Column:
        got = F.get(F.filter(it["p"], lambda x: ~F.exists(acc, lambda t: t["page_start"] == x)), F.lit(0))
        row = F.struct(it["i"].alias("i"), it["name"].alias("name"), got.cast("bigint").alias("page_start"))
        return F.when(got.isNotNull(), F.concat(acc, F.array(row))).otherwise(acc)

    late = queue.select("doc_id", F.inline(F.aggregate("q", F.array().cast(kind), take)))
    starts = firm.unionByName(late)
    # at most len(names) rows per document from here on
    after = F.lead("page_start").over(W.partitionBy("doc_id").orderBy("page_start", "i"))
    return starts.select(
        "doc_id", "name", "page_start", F.coalesce(after, F.col("page_start") + tail).alias("page_end")
    )
