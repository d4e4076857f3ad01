"""Rule-text extraction into one long table.

Input ``doc_id, part_no, text``: a document's rule pages as rows. Every pattern runs over
whole parts inside the JVM; counts and first hits are then combined per document by partial
aggregation, so a long document is never one string. Output rows:
``doc_id, extractor, field, part_no, ord, name, value``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scrollwork.functions import fixed, ordered, text as T
from scrollwork.operators.cycles import cycle_members
from scrollwork.operators.substrings import containing
from scrollwork.session import cut_lineage, deal_wide

ITEM = "array<struct<extractor:string,field:string,ord:int,name:string,value:string>>"


def mechanics_pages(segs: DataFrame, pages: DataFrame) -> DataFrame:
    """Raw pages in the union of the page ranges of segments routed to rules."""
    want = segs.filter(F.col("route").isin("systems", "both")).select(
        "doc_id", F.explode(F.sequence("page_start", "page_end")).alias("page_num")
    )
    return pages.join(want.distinct(), ["doc_id", "page_num"], "left_semi")


def valid_term(c: Column, least: int = 3, stop=fixed.STOP_WORDS) -> Column:
    """Long enough, alphabetic and no stop word."""
    return (F.length(c) >= least) & ~F.lower(c).isin(stop) & c.rlike(r"^\p{L}+$")


def _by_alphabet(c: Column, pattern: str, run: Callable[[str], Column]) -> Column:
    """``run(pattern)``, on ASCII text without the ``U`` flag: there its classes match the same characters, several times faster."""
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    if not flags or "U" not in flags[1] or not T.ascii_safe([pattern]):
        return run(pattern)
    rest = flags[1].replace("U", "")
    plain = (f"(?{rest})" if rest else "") + pattern[flags.end():]
    return F.when(F.octet_length(c) == F.length(c), run(plain)).otherwise(run(pattern))


def found_in(c: Column, pattern: str) -> Column:
    return _by_alphabet(c, pattern, c.rlike)


def all_of(c: Column, pattern: str, group: int = 1) -> Column:
    return _by_alphabet(c, pattern, lambda p: F.regexp_extract_all(c, F.lit(p), group))


def groups(c: Column, pattern: str, n: int) -> Column:
    """All matches as ``array<struct<g1, g2, …>>``."""
    return _by_alphabet(c, pattern, lambda p: F.arrays_zip(*[F.regexp_extract_all(c, F.lit(p), i).alias(f"g{i}") for i in range(1, n + 1)]))


def _single(values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(v.alias("g1")))


def _g(z: Column, i: int) -> Column:
    return T.strip(z[f"g{i}"])


def _items(extractor: str, field: str, found: Column, name, value=None) -> Column:
    """Items from zipped groups; ``name`` and ``value`` map a match to a column."""
    empty = F.lit(None).cast("string")
    return F.transform(
        found,
        lambda z, i: F.struct(
            F.lit(extractor).alias("extractor"), F.lit(field).alias("field"), i.alias("ord"),
            name(z).cast("string").alias("name"), (value(z).cast("string") if value else empty).alias("value"),
        ),
    ).cast(ITEM)


def _one(extractor: str, field: str, value: Column) -> Column:
    """At most one item, when ``value`` is not null."""
    row = F.struct(F.lit(extractor).alias("extractor"), F.lit(field).alias("field"), F.lit(0).alias("ord"), F.lit(None).cast("string").alias("name"), value.cast("string").alias("value"))
    return F.when(value.isNotNull(), F.array(row)).otherwise(F.array().cast(ITEM)).cast(ITEM)


def _flag(extractor: str, field: str, test: Column) -> Column:
    return _one(extractor, field, F.when(test, F.lit("true")))


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(T.strip(_by_alphabet(c, pattern, lambda p: F.regexp_extract(c, p, group))), F.lit(""))


def _ranked(extractor: str, field: str, choices: list[Column]) -> Column:
    """The first choice that is not null; ``ord`` is its rank, so that the best rule of all parts can win."""
    rank = F.coalesce(*[F.when(c.isNotNull(), F.lit(i)) for i, c in enumerate(choices)])
    value = F.coalesce(*choices)
    row = F.struct(F.lit(extractor).alias("extractor"), F.lit(field).alias("field"), rank.alias("ord"), F.lit(None).cast("string").alias("name"), value.cast("string").alias("value"))
    return F.when(rank.isNotNull(), F.array(row)).otherwise(F.array().cast(ITEM)).cast(ITEM)


def _cases(low: Column, rules: list[tuple[str, str]]) -> list[Column]:
    return [F.when(found_in(low, pattern), F.lit(name)) for pattern, name in rules]


def _rows(texts: DataFrame, items: list[Column]) -> DataFrame:
    # held, because Catalyst infers filters on the size of what is inlined and would make the items twice or thrice
    return T.hold(texts, {"__items": F.concat(*items)}).select("doc_id", "part_no", F.inline("__items"))


def _each(d: DataFrame, found: Column, name: str) -> DataFrame:
    return T.hold(d, {"__found": found}).select("doc_id", F.explode("__found").alias(name))


def _low(texts: DataFrame) -> tuple[DataFrame, Column, Column]:
    d = T.hold(texts.select("doc_id", "part_no", "text"), {"low": F.lower("text")})
    return d, F.col("text"), F.col("low")


# ---- windows across pages ----

#: what stands between two pages of one text
PAGE_BREAK = "\n\n---\n\n"
#: the longest window behind a heading
WINDOW = 1000
#: pages whose heads meet in one row
BLOCK = 1024
#: put into the head words of a tail, so that no match begins there; taken out of what a window has caught
MARK = "\x01"
TAIL_WORDS = r"(?i)(attribut|trai|sta|talen|skil|knowledg|proficienc|abilit|clas|tie|typ|leve)"


def with_tails(texts: DataFrame, width: int = WINDOW) -> DataFrame:
    """``doc_id, part_no, text, tail``: the first ``width`` characters of what follows a page, page breaks included; null on a last page.

    Heads of pages meet in blocks of ``BLOCK`` pages, with those of the pages behind a block that can reach into it: every page
    adds at least its break, so their number is bounded. Texts stay out of the blocks.
    """
    reach = -(-width // len(PAGE_BREAK))
    heads = texts.select("doc_id", "part_no", F.left(F.coalesce("text", F.lit("")), F.lit(width)).alias("head"))
    n = ordered.add_row_number(heads, ["doc_id"], ["part_no"], ordered.steps("part_no"), "rn")
    # the first pages of a block also stand at the end of the block before it; one block is at least as long as the reach
    size = max(BLOCK, reach)
    block = F.floor((F.col("rn") - 1) / size)
    place = (F.col("rn") - 1) % size
    near = n.select("doc_id", "rn", "part_no", "head", F.explode(F.when((place < reach) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))).alias("block"))
    met = deal_wide(near, "doc_id", "block").groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(F.struct("rn", "part_no", "head"))).alias("p"))
    behind = F.transform("p", lambda x: F.concat(F.lit(PAGE_BREAK), x["head"]))
    met = T.hold(met, {"b": behind})

    def tail(i: Column) -> Column:
        """Few pages fill most windows; only where they do not, more are put together."""
        some = [F.array_join(F.slice("b", i + 2, k), "") for k in (2, 8, 32) if k < reach]
        out = F.array_join(F.slice("b", i + 2, reach), "")
        for c in reversed(some):
            out = F.when(F.length(c) >= width, c).otherwise(out)
        return F.when(i + 1 < F.size("b"), F.left(out, F.lit(width)))

    rows = F.transform("p", lambda x, i: F.struct(F.floor((x["rn"] - 1) / size).alias("own"), x["part_no"].alias("part_no"), tail(i).alias("tail")))
    # of rows that repeat a page the first one's tail comes last, which counts where the last of equal places is taken
    tails = met.select("doc_id", "block", F.inline(F.reverse(rows))).filter("own = block AND tail IS NOT NULL").drop("own", "block")
    # a tail is as long as a page, which its type doesn't tell Spark: estimated, all tails together would seem small enough to be broadcast
    key = ["doc_id", "part_no"]
    return deal_wide(texts.select(*key, "text"), *key).join(deal_wide(tails, *key).hint("merge"), key, "left")


def _across(texts: DataFrame) -> tuple[DataFrame, Column, Column, Column]:
    """As ``_low``, with the text and its tail: matches begin on the page, windows go on behind it."""
    marked = F.regexp_replace(F.replace("tail", F.lit("+"), F.lit(MARK + "+")), TAIL_WORDS, "$1" + MARK)
    d = T.hold(with_tails(texts), {"low": F.lower("text"), "full": F.concat("text", F.coalesce(marked, F.lit("")))})
    return d, F.col("text"), F.col("low"), F.col("full")


def _window(c: Column, n: int) -> Column:
    """The first ``n`` characters of a caught window, without the marks of a tail."""
    return F.left(F.replace(c, F.lit(MARK), F.lit("")), F.lit(n))


def first_hits(rows: DataFrame) -> DataFrame:
    """One value per document and field: that of the first rule that matches anywhere, at its earliest part."""
    best = F.min_by(F.struct("part_no", F.lit(0).alias("ord"), "name", "value"), F.struct("ord", "part_no"))
    g = rows.groupBy("doc_id", "extractor", "field").agg(best.alias("f"))
    return g.select("doc_id", "extractor", "field", "f.*")


def counted(rows: DataFrame, least: int, top: int | None = None) -> DataFrame:
    """Names that occur often enough, the most frequent first."""
    g = rows.groupBy("doc_id", "extractor", "field", "name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    if top is not None:
        w = W.partitionBy("doc_id", "extractor", "field").orderBy(F.desc("n"), F.asc("name"))
        g = g.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= top).drop("__r")
    return g.select("doc_id", "extractor", "field", F.lit(0).cast("bigint").alias("part_no"), F.lit(0).alias("ord"), "name", F.col("n").cast("string").alias("value"))


def last_by_name(rows: DataFrame) -> DataFrame:
    g = rows.groupBy("doc_id", "extractor", "field", "name").agg(F.max_by(F.struct("part_no", "ord", "value"), F.struct("part_no", "ord")).alias("l"))
    return g.select("doc_id", "extractor", "field", "l.part_no", "l.ord", "name", "l.value")


def extract_resolution(texts: DataFrame) -> DataFrame:
    d, t, low = _low(texts)
    x = "resolution"
    dice = F.filter(all_of(t, r"(?iU)\b(\d*)d(\d+)\b", 2), lambda v: v != "")
    pool = []
    for p in fixed.POOL_PATTERNS:
        p = "(?U)" + p
        both = F.concat(T.title_case(F.regexp_extract(low, p, 1)), F.lit(" + "), T.title_case(F.regexp_extract(low, p, 2)))
        pool.append(F.when(found_in(low, p), both))
    scale1 = groups(t, rf"(?iU)(?:difficulty\s+)?(\d+)\s*[-–:]\s*({fixed.DIFFICULTY_LABELS})", 2)
    scale2 = groups(t, r"(?iU)(easy|routine|standard|challenging|difficult|hard|trivial)\s*[:\(]\s*(\d+)", 2)
    bands = groups(t, r"(?iU)(\d+)\s*[-–]\s*(\d+)\s*[:=]\s*(.+?)(?:\n|$)|(\d+)\s*\+\s*[:=]\s*(.+?)(?:\n|$)", 5)
    ranged = lambda z: F.when(_g(z, 1) != "", F.concat(_g(z, 1), F.lit("-"), _g(z, 2))).otherwise(F.concat(_g(z, 4), F.lit("+")))
    label = lambda z: F.when(_g(z, 1) != "", _g(z, 3)).otherwise(_g(z, 5))
    firsts = [
        _ranked(x, "method", _cases(low, fixed.RESOLUTION_METHODS)), _ranked(x, "pool_composition", pool),
        _one(x, "default_difficulty", _first(low, r"(?U)(?:default\s+)?difficulty\s*(?:of|is|:)?\s*(\d+)")),
        _flag(x, "ones_cancel", low.rlike(fixed.ONES_CANCEL_PATTERN)), _flag(x, "botch", low.rlike(fixed.BOTCH_PATTERN)),
        *[_one(x, f"threshold_{n}", _first(low, p)) for n, p in fixed.OUTCOME_THRESHOLD_PATTERNS],
        _one(x, "threshold_failure", F.when(low.rlike(fixed.NO_SUCCESS_PATTERN), F.lit("0"))),
        _flag(x, "willpower", low.rlike(fixed.WILLPOWER_PATTERN)), _flag(x, "specialties", low.rlike(fixed.SPECIALTY_PATTERN)),
        _flag(x, "automatic_success", low.rlike(fixed.AUTO_SUCCESS_PATTERN)),
    ]
    lists = [
        _items(x, "difficulty_scale", scale1, lambda z: _g(z, 2), lambda z: _g(z, 1)),
        _items(x, "difficulty_scale", scale2, lambda z: _g(z, 1), lambda z: _g(z, 2)),
        _items(x, "outcome_bands", bands, ranged, label),
    ]
    die = _each(d, dice, "die").groupBy("doc_id", "die").agg(F.count(F.lit(1)).alias("n"))
    die = die.groupBy("doc_id").agg(F.max_by("die", F.struct(F.col("n"), -F.col("die").cast("int"))).alias("value"))
    die = die.select("doc_id", F.lit(x).alias("extractor"), F.lit("die_type").alias("field"), F.lit(0).cast("bigint").alias("part_no"), F.lit(0).alias("ord"), F.lit(None).cast("string").alias("name"), "value")
    return first_hits(_rows(d, firsts)).unionByName(_rows(d, lists)).unionByName(die)


def extract_stats(texts: DataFrame) -> DataFrame:
    """Categories with the names that follow them, ability groups, ranges, pools, backgrounds, allocation and costs. Lists may go on on the next pages."""
    d, t, low, full = _across(texts)
    x = "stat_schema"
    # a word is tried from its beginning only (or from where the match before ended), and is not given back letter by letter
    cats = F.filter(groups(full, r"(?iU)(?:\G|(?<!\w))(\w++)\s++(?:attributes?|traits?|stats?)\s*[:\n](?=([\s\S]{0,1200}))", 2), lambda z: valid_term(_g(z, 1), 4))
    names = lambda z: F.slice(F.filter(F.transform(F.regexp_extract_all(_window(z["g2"], 500), F.lit(r"\b([A-Z][a-z]+)\b"), 1), F.lower), lambda v: valid_term(v, 4)), 1, 5)
    cats = F.filter(cats, lambda z: F.size(names(z)) > 0)
    met = F.array(*[F.when(found_in(low, rf"(?U)\b{a}\b"), F.struct(F.lit(f"{cat}.{a}").alias("g1"))) for cat, attrs in fixed.COMMON_ATTRIBUTES for a in attrs])
    met = F.filter(met, lambda z: z.isNotNull())
    skills = groups(full, r"(?iU)(talents?|skills?|knowledges?|proficiencies?|abilities?)\s*[:\n](?=([\s\S]{0,1500}))", 2)
    listed = lambda z: F.slice(F.filter(F.transform(F.regexp_extract_all(_window(z["g2"], 1000), F.lit(r"(?:^|\n)\s*(?:•|[-*])?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"), 1), F.lower), lambda v: valid_term(v, 4)), 1, 15)
    skills = F.filter(skills, lambda z: F.size(listed(z)) > 0)
    span = F.filter(
        groups(t, r"(?iU)(?:\G|(?<!\w))(\w++)\s++(?:rating|score|pool)?\s*(?:ranges?\s+from|is\s+rated)?\s*(\d+)\s*(?:to|-|–)\s*(\d+)", 3), lambda z: valid_term(_g(z, 1), 4)
    )
    alloc = F.transform(F.array(*[F.regexp_extract(low, r"(\d+)\s*/\s*(\d+)\s*/\s*(\d+)", i) for i in (1, 2, 3)]), lambda v: v.try_cast("int"))
    costs = F.filter(groups(t, r"(?iU)(\w+)\s*[:=]?\s*(\d+)\s*(?:per\s+dot|points?|xp|experience)", 2), lambda z: F.lower(_g(z, 1)).isin(fixed.COST_TRAITS))
    # the end of the list is sought in lower-case text, where a capital never ends it, and the heading belongs to the list
    section = F.regexp_extract(t, r"(?s)(?i:backgrounds?|advantages?|merits?)\s*[:\n].+?(?:\n\n|\z)", 0)
    back = F.filter(F.slice(F.regexp_extract_all(section, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b"), 1), 1, 20), lambda v: valid_term(v, 4))
    pools = F.filter(all_of(low, r"(?U)(?:\G|(?<!\w))(\w++)\s++(?:points?|pool)"), lambda v: valid_term(v, 4))
    rows = _rows(d, [
        _items(x, "attributes", cats, lambda z: F.lower(_g(z, 1)), lambda z: F.array_join(names(z), ",")),
        _items(x, "abilities", skills, lambda z: F.regexp_replace(F.lower(_g(z, 1)), "s+$", ""), lambda z: F.array_join(listed(z), ",")),
        _items(x, "special_traits", span, lambda z: F.lower(_g(z, 1)), lambda z: F.concat(_g(z, 2), F.lit("-"), _g(z, 3))),
        _items(x, "advancement_costs", costs, lambda z: F.lower(_g(z, 1)), lambda z: _g(z, 2)),
        _items(x, "trait_pools", _single(pools), lambda z: z["g1"]),
        _one(x, "point_allocation", F.when(F.get(alloc, F.lit(0)).isNotNull(), F.array_join(F.reverse(F.array_sort(alloc)), "/"))),
        _items(x, "__seen", met, lambda z: z["g1"]),
    ])
    # one pass over the texts; the last, the first and the number of each name are what all fields are made of
    place = F.struct("part_no", "ord")
    g = rows.groupBy("doc_id", "extractor", "field", "name").agg(
        F.max_by(F.struct("part_no", "ord", "value"), place).alias("l"), F.min_by(F.struct("part_no", "ord", "value"), place).alias("f"), F.count(F.lit(1)).alias("n"),
    )
    g = cut_lineage(g)
    columns = ["doc_id", "extractor", "field", "part_no", "ord", "name", "value"]
    found = g.filter(F.col("field").isin("attributes", "abilities", "special_traits", "advancement_costs")).select("doc_id", "extractor", "field", "l.part_no", "l.ord", "name", "l.value")
    nowhere = [F.lit(0).cast("bigint").alias("part_no"), F.lit(0).alias("ord")]
    # two names of a list anywhere in the document are enough
    seen = g.filter("field = '__seen'").groupBy("doc_id").agg(F.collect_set("name").alias("s"))
    common = []
    for cat, attrs in fixed.COMMON_ATTRIBUTES:
        both = F.filter(F.array(*[F.when(F.array_contains("s", f"{cat}.{a}"), F.lit(a)) for a in attrs]), lambda v: v.isNotNull())
        common.append(F.when(F.size(both) >= 2, F.struct(F.lit(cat).alias("name"), F.array_join(both, ",").alias("value"))))
    basic = seen.select("doc_id", F.inline(F.filter(F.array(*common), lambda v: v.isNotNull())))
    basic = basic.select("doc_id", F.lit(x).alias("extractor"), F.lit("attributes").alias("field"), *nowhere, "name", "value")
    basic = basic.join(found.filter("field = 'attributes'").select("doc_id", "name"), ["doc_id", "name"], "left_anti").select(*columns)
    pool = g.filter("field = 'trait_pools' AND n >= 3").select("doc_id", "extractor", "field", *nowhere, "name", F.col("n").cast("string").alias("value"))
    pool = pool.join(found.filter("field = 'special_traits'").select("doc_id", "name"), ["doc_id", "name"], "left_anti").select(*columns)
    firsts = g.filter("field = 'point_allocation'").select("doc_id", "extractor", "field", "f.part_no", F.lit(0).alias("ord"), "name", "f.value")
    lists = _rows(texts.select("doc_id", "part_no", "text"), [_items(x, "backgrounds", _single(back), lambda z: z["g1"])])
    return found.unionByName(basic).unionByName(pool).unionByName(firsts).unionByName(lists)


def extract_health(texts: DataFrame) -> DataFrame:
    """Track type, penalty ladder (three layouts, first spelling of a name wins), damage types, soak."""
    d, t, low = _low(texts)
    x = "health"
    one = F.filter(groups(t, r"(?m)^([A-Z][a-z]+(?:[^\S\n]+[A-Z][a-z]+)?)\s*[:(\[]\s*(-\d+)\s*[)\]]?", 2), lambda z: valid_term(_g(z, 1)))
    two = F.filter(groups(t, r"(?m)^([A-Z][a-z]+(?:[^\S\n]+[A-Z][a-z]+)?)\s{2,}(0|-\d+)\b", 2), lambda z: valid_term(_g(z, 1)))
    # first word of a stretch without digits or dashes that ends in a penalty; the possessive form
    # reads every stretch once, where a plain one would rescan it from each of its words
    stretch = r"(?i)(?:\G|(?<=[-\d]))(?:[^-\da-z]|[a-z](?![a-z]))*+([a-z]{2,}+)[^-\d]*+(-\d+|0)\s*(?:penalty|dice)?"
    three = F.filter(groups(t, stretch, 2), lambda z: valid_term(_g(z, 1), 4))
    nm, val = (lambda z: _g(z, 1)), (lambda z: _g(z, 2))
    rows = _rows(d, [
        _items(x, "layout_1", one, nm, val), _items(x, "layout_2", two, nm, val), _items(x, "layout_3", three, lambda z: T.title_case(_g(z, 1)), val),
    ])
    rows = rows.withColumn("value", F.col("value").try_cast("int")).filter(F.col("value").isNotNull())
    # the third layout counts only where it forms a ladder that starts at 0 or -1
    ladder = rows.filter("field = 'layout_3'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("k"), F.min("value").alias("lo"))
    ladder = ladder.filter("n >= 3 and k >= 3 and lo >= -1").select("doc_id")
    use = rows.filter("field <> 'layout_3'").unionByName(rows.filter("field = 'layout_3'").join(ladder, "doc_id", "left_semi"))
    first = use.groupBy("doc_id", F.lower("name").alias("k")).agg(F.min_by(F.struct("name", "value", "part_no", "ord"), F.struct("field", "part_no", "ord")).alias("f"))
    levels = first.select("doc_id", F.lit(x).alias("extractor"), F.lit("health_levels").alias("field"), "f.part_no", "f.ord", "f.name", F.col("f.value").cast("string").alias("value"))
    kinds = F.filter(all_of(low, r"(?U)\b(\w+)\s+damage\b"), lambda v: ~v.isin(fixed.NOT_DAMAGE_TYPES) & valid_term(v, 4))
    damage = counted(_rows(d, [_items(x, "damage_types", _single(kinds), lambda z: z["g1"])]), 2, 5)
    soaks = F.lit(False)
    for p in fixed.SOAK_PATTERNS:
        soaks = soaks | low.rlike(p)
    firsts = first_hits(_rows(d, [
        _ranked(x, "health_track_type", _cases(low, fixed.HEALTH_TRACKS)), _one(x, "soak", F.when(soaks, F.lit("unknown"))),
        _one(x, "soak_stat", _first(low, fixed.SOAK_STAT_PATTERN)),
    ]))
    # soak and its stat are two facts of the document and may stand in different parts
    stat = firsts.filter("field = 'soak_stat'").select("doc_id", F.lit("soak").alias("field"), F.col("value").alias("stat"))
    firsts = firsts.filter("field <> 'soak_stat'").join(stat, ["doc_id", "field"], "left").withColumn("value", F.coalesce("stat", "value")).select(*levels.columns)
    return levels.unionByName(damage).unionByName(firsts)


def extract_equipment(texts: DataFrame) -> DataFrame:
    """Names followed by stat lines, seen through the array of a part's filled lines."""
    d, t, low, full = _across(texts)
    x = "equipment"
    d = d.withColumn("__l", T.filled_lines(t))
    at = F.when(F.size("__l") > 0, F.sequence(F.lit(1), F.size("__l"))).otherwise(F.array().cast("array<int>"))
    numeric = lambda s: F.get(F.split(s, r"\s+"), F.lit(0)).rlike(r"(?i)^(\d+|\d+d\d+.*|\d+[-–]\d+|n/a|na|-|—)$")
    line = lambda i: F.get(F.col("__l"), i - 1)
    named = lambda s: (
        s.rlike(r"^[A-Z][a-zA-Z\s,.\-()]+$") & (F.length(s) <= 50) & ~F.lower(s).rlike("|".join(fixed.NOT_ITEM_WORDS)) & ~F.lower(s).isin(fixed.NOT_ITEM_NAMES)
    )

    def run(i):
        """Leading stat lines after line ``i``, at most five."""
        five = F.slice(F.col("__l"), i + 1, 5)
        stop = F.array_position(F.transform(five, numeric), False)
        n = F.when(stop > 0, stop - 1).otherwise(F.size(five)).cast("int")
        return F.transform(F.slice(five, F.lit(1), n), lambda s: F.get(F.split(s, r"\s+"), F.lit(0)))

    ranged = F.filter(at, lambda i: named(line(i)) & (F.size(run(i)) >= 3))
    armour = F.filter(
        at, lambda i: line(i).rlike(r"^[A-Z][a-zA-Z\s]+$") & valid_term(line(i)) & F.coalesce(line(i + 1).rlike(r"^\d+$") & line(i + 2).rlike(r"^-?\d+$"), F.lit(False))
    )
    melee = F.filter(
        groups(full, r"(?m)^([A-Z][a-zA-Z ]+)\n([A-Z][a-z]+)\s*\+\s*(\d+)(?=([\s\S]{0,80}))", 4), lambda z: valid_term(_g(z, 1)) & (F.length(_g(z, 1)) < 40)
    )
    after = lambda z: F.lower(_window(z["g4"], 50))
    harm = lambda z: (
        F.when(F.contains(after(z), F.lit("lethal")) | F.contains(F.substring(after(z), 1, 15), F.lit("\nl")), "lethal")
        .when(F.contains(after(z), F.lit("bashing")) | F.contains(F.substring(after(z), 1, 15), F.lit("\nb")), "bashing").otherwise("unknown")
    )
    tiers = groups(full, r"(?iU)(?:class|tier|type|level)\s*(\w+)\s*\(([^)]+)\)(?=([\s\S]{0,150}))", 3)
    tier = lambda z: T.first_in(F.lower(_g(z, 1)), fixed.ARMOUR_TIERS)
    tiers = F.filter(tiers, lambda z: tier(z).isNotNull())
    nums = lambda z: F.regexp_extract_all(_window(z["g3"], 100), F.lit(r"(-?\d+)"), 1)
    rating = lambda z: F.concat_ws("/", tier(z), F.when(F.size(nums(z)) >= 2, F.get(nums(z), F.lit(0))), F.when(F.size(nums(z)) >= 2, F.get(nums(z), F.lit(1))))
    return _rows(d, [
        _items(x, "ranged_weapons", ranged, line, lambda i: F.array_join(run(i), " ")),
        _items(x, "melee_weapons", melee, lambda z: _g(z, 1), lambda z: F.concat(_g(z, 2), F.lit(" + "), _g(z, 3), F.lit(" "), harm(z))),
        _items(x, "armor", armour, line, lambda i: F.concat(line(i + 1), F.lit("/"), line(i + 2))),
        _items(x, "tiered_armor", tiers, lambda z: F.replace(_g(z, 2), F.lit(MARK), F.lit("")), rating),
    ])


def extract_magic(texts: DataFrame) -> DataFrame:
    d, t, low = _low(texts)
    x = "magic"
    stat = []
    for p in fixed.CASTING_STAT_PATTERNS:
        got = _first(low, "(?U)" + p)
        stat.append(F.when(~got.isin(fixed.NOT_CASTING_STATS), T.title_case(got)))
    mods = [
        (groups(low, r"(?mU)(\w+(?:\s+\w+)?)\s+magic(?:'s)?\s+(?:base\s+)?difficulty\s+(?:is|=)\s+(.+?)(?:\.|$)", 2), 1, 2),
        (groups(low, r"(?mU)([+-]\d+)\s+difficulty\s+(?:for|when|if)\s+(.+?)(?:\.|$)", 2), 2, 1),
        (groups(low, r"(?mU)difficulty\s+modifier\s+(?:of\s+)?([+-]?\d+)\s+(?:for|when|if)\s+(.+?)(?:\.|$)", 2), 2, 1),
    ]
    mod_items = [_items(x, "difficulty_modifiers", m, lambda z, a=a: F.substring(_g(z, a), 1, 100), lambda z, b=b: F.substring(_g(z, b), 1, 100)) for m, a, b in mods]
    w = W.partitionBy("doc_id").orderBy("part_no", "ord", "name", "value")
    modifiers = _rows(d, mod_items).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= 10).drop("__r")
    named = F.concat(*[all_of(low, "(?U)" + p) for p in fixed.SCHOOL_PATTERNS])
    named = F.array_distinct(F.filter(named, lambda v: ~v.isin(fixed.NOT_SCHOOLS) & valid_term(v, 4)))
    schools = _each(d, named, "name").distinct()
    words = _each(d, T.terms(t), "name").groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))
    said = words.join(schools, ["doc_id", "name"]).filter("n >= 3")
    ws = W.partitionBy("doc_id").orderBy(F.desc("n"), F.asc("name"))
    said = said.withColumn("__r", F.row_number().over(ws)).filter(F.col("__r") <= 15)
    said = said.select("doc_id", F.lit(x).alias("extractor"), F.lit("spell_schools").alias("field"), F.lit(0).cast("bigint").alias("part_no"), F.lit(0).alias("ord"), T.title_case(F.col("name")).alias("name"), F.col("n").cast("string").alias("value"))
    pools = F.concat(*[all_of(low, "(?U)" + p) for p in fixed.RESOURCE_PATTERNS])
    pools = F.transform(F.array_distinct(F.filter(pools, lambda v: valid_term(v, 4))), T.title_case)
    will = r"spend\s+(?:a\s+)?(?:point\s+of\s+)?willpower"
    resources = last_by_name(_rows(d, [
        _items(x, "resource_pools", _single(pools), lambda z: z["g1"]),
        _items(x, "resource_pools", F.when(low.rlike(will), _single(F.array(F.lit("Willpower")))).otherwise(_single(F.array().cast("array<string>"))), lambda z: z["g1"]),
    ]))
    foci = found_in(low, r"(?U)\bfoci\b|\bfocus\b|\bcomponent|material\s+component|verbal|somatic")
    firsts = first_hits(_rows(d, [
        _ranked(x, "casting_stat", stat), _ranked(x, "casting_mechanic", _cases(low, fixed.CASTING_MECHANICS)),
        _flag(x, "foci_required", foci & low.rlike(r"require[ds]?\s+(?:a\s+)?(?:focus|foci|component)")),
        _one(x, "foci_exemption", F.when(foci, F.substring(_first(low, r"(?m)(?:without|no\s+longer\s+need)\s+(?:a\s+)?(?:focus|foci|component).*?(?:at|when|if)\s+(.+?)(?:\.|$)"), 1, 100))),
        _flag(x, "supports_rituals", low.rlike(r"ritual|extended\s+cast|longer\s+cast|casting\s+time")),
    ]))
    # the first keyword of the list that occurs anywhere in the document
    hit = F.array(*[F.when(found_in(low, rf"(?U)\b{kw}\b"), F.lit(i)) for i, kw in enumerate(fixed.BACKLASH_WORDS)])
    back = d.groupBy("doc_id").agg(F.min(F.array_min(hit)).alias("i")).filter("i is not null")
    name = F.element_at(F.array(*[F.lit(w_) for w_ in fixed.BACKLASH_WORDS]), F.col("i") + 1)
    back = back.select("doc_id", F.lit(x).alias("extractor"), F.lit("backlash_system").alias("field"), F.lit(0).cast("bigint").alias("part_no"), F.lit(0).alias("ord"), F.lit(None).cast("string").alias("name"), T.title_case(name).alias("value"))
    return firsts.unionByName(modifiers).unionByName(said).unionByName(resources).unionByName(back)


def extract_counters(texts: DataFrame) -> DataFrame:
    """``Name: v/max`` counters, and thresholds where the document has any counter."""
    d, t, low = _low(texts)
    x = "clocks"
    form = r"(?iU)(?:^|\n)\s*(\w[\w\s]*?)\s*(?:clock)?\s*[:=]\s*(\d+)\s*/\s*(\d+)"
    # a counter holds all that its pattern looks at, so the text is passed once and the short matches are taken apart
    found = _by_alphabet(t, form, lambda p: F.transform(F.regexp_extract_all(t, F.lit(p), 0), lambda m: F.struct(*[F.regexp_extract(m, p, i).alias(f"g{i}") for i in (1, 2, 3)])))
    marks = groups(t, r"(?iU)(?:at|when|if)\s+(\d+)\s*[:=]\s*(.+?)(?:\n|$)", 2)
    counters = _rows(d, [_items(x, "clocks", found, lambda z: _g(z, 1), lambda z: F.concat(_g(z, 2), F.lit("/"), _g(z, 3)))])
    triggers = _rows(d, [_items(x, "triggers", marks, lambda z: _g(z, 1), lambda z: _g(z, 2))])
    have = d.filter(found_in(t, form)).select("doc_id").distinct()
    return counters.unionByName(triggers.join(have, "doc_id", "left_semi"))


def _keyword_lines(texts: DataFrame, extractor: str, field: str, words: list[str]) -> DataFrame:
    d, t, low = _low(texts)
    found = groups(t, rf"(?iU)\b({'|'.join(words)})\b\s*[:—–-]\s*(.+?)(?:\n|$)", 2)
    return _rows(d, [_items(extractor, field, found, lambda z: F.lower(_g(z, 1)), lambda z: F.substring(_g(z, 2), 1, 200))])


def extract_conditions(texts: DataFrame, words=fixed.CONDITION_WORDS) -> DataFrame:
    return _keyword_lines(texts, "conditions", "conditions", words)


def extract_actions(texts: DataFrame, words=fixed.ACTION_WORDS) -> DataFrame:
    return _keyword_lines(texts, "action_types", "action_types", words)


def extract_calibration(texts: DataFrame) -> DataFrame:
    d, t, low = _low(texts)
    x = "calibration"
    number = lambda z: T.first_in(F.lower(_g(z, 1)), fixed.NUMBER_WORDS)
    words = "three|four|five|six|seven|eight|nine|ten"
    labels = "easy|routine|standard|straightforward|challenging|difficult|hard"
    return _rows(d, [
        _items(x, "presets", groups(t, rf"(?iU)({fixed.PRESET_LABELS})\s*[:\(]?\s*(\d+)", 2), lambda z: _g(z, 1), lambda z: _g(z, 2)),
        _items(x, "presets", groups(t, rf"(?imU)^({words})\s*$\s*^({labels})", 2), lambda z: _g(z, 2), number),
        _items(x, "success_thresholds", groups(t, rf"(?imU)^(one|two|three|four|five)\s*$\s*^({fixed.DEGREE_LABELS})", 2), lambda z: _g(z, 2), number),
        _items(x, "difficulty_modifiers", groups(t, r"(?iU)([+-]\d+)\s+(?:difficulty|modifier|penalty|bonus).*?(?:for|when|if)\s+(.+?)(?:\n|$)", 2), lambda z: F.substring(_g(z, 2), 1, 100), lambda z: _g(z, 1)),
    ])


EXTRACTORS = {
    "resolution": extract_resolution, "stat_schema": extract_stats, "health": extract_health, "equipment": extract_equipment,
    "magic": extract_magic, "clocks": extract_counters, "conditions": extract_conditions, "calibration": extract_calibration,
    "action_types": extract_actions,
}


def rule_matches(texts: DataFrame, rules=fixed.RULE_TABLE) -> DataFrame:
    """Matches of every rule per document; patterns stay literal, so each is compiled once."""
    counts = F.array(*[F.struct(F.lit(s).alias("rule_set"), F.lit(m).alias("meaning"), T.matches(F.col("text"), r"(?im)" + p).alias("n")) for s, p, m, _ in rules])
    rows = T.hold(texts.select("doc_id", "text"), {"c": counts}).select("doc_id", F.inline("c")).filter("n > 0")
    return rows.groupBy("doc_id", "rule_set", "meaning").agg(F.sum("n").cast("bigint").alias("matches"))


def extraction_confidence(rows: DataFrame, matches: DataFrame | None = None, keys=fixed.KEY_FIELDS, sections=fixed.EXTRACTOR_SECTIONS) -> DataFrame:
    """Confidence per document and extractor from fields found, rule hits and key fields.

    Fields count as the extraction groups them: all of magic is one field, and so are the outcome thresholds; armour by tier is armour.
    """
    top = (
        F.when(F.col("extractor") == "magic", F.lit("magic_system")).when(F.col("field").startswith("threshold_"), F.lit("outcome_thresholds"))
        .when(F.col("field") == "tiered_armor", F.lit("armor")).otherwise(F.col("field"))
    )
    rows = rows.select("doc_id", "extractor", top.alias("field"))
    key = F.lit(False)
    for ext, names in keys:
        key = key | ((F.col("extractor") == ext) & F.col("field").isin(names))
    f = rows.select("doc_id", "extractor", "field").distinct()
    g = f.groupBy("doc_id", "extractor").agg(F.count(F.lit(1)).alias("fields"), F.count(F.when(key, 1)).alias("key_fields"))
    g = g.withColumn("hits", F.lit(0).cast("bigint"))
    if matches is not None:
        ind = matches.filter("rule_set = 'indicator'").groupBy("doc_id").agg(F.sum("matches").alias("__i"))
        ext = F.array().cast("array<string>")
        for e, s in sections:
            ext = F.when(F.col("meaning") == s, F.concat(ext, F.array(F.lit(e)))).otherwise(ext)
        sec = matches.filter("rule_set = 'section'").select("doc_id", "matches", F.explode(ext).alias("extractor")).groupBy("doc_id", "extractor").agg(F.sum("matches").alias("__s"))
        g = g.join(ind, "doc_id", "left").join(sec, ["doc_id", "extractor"], "left")
        g = g.withColumn("hits", (F.coalesce("__i", F.lit(0)) + F.coalesce("__s", F.lit(0))).cast("bigint")).drop("__i", "__s")
    base = F.least(F.lit(0.3) + F.col("fields") * 0.1, F.lit(0.7)) + F.least(F.col("hits") * 0.05, F.lit(0.2)) + F.col("key_fields") * 0.1
    return g.withColumn("confidence", F.round(F.least(base, F.lit(1.0)), 2))


def overlay_known(rows: DataFrame, matches: DataFrame, texts: DataFrame, schools: DataFrame, levels: list[tuple[str, int]]) -> DataFrame:
    """Add names from a rule file: missing schools, and health levels when three of them occur.

    ``schools(doc_id, name)`` are the names a section rule matched.
    """
    have = rows.filter("field = 'spell_schools'").select("doc_id", F.lower("name").alias("k")).distinct()
    new = schools.withColumn("k", F.lower("name")).dropDuplicates(["doc_id", "k"]).join(have, ["doc_id", "k"], "left_anti")
    fill = lambda e, f: [F.lit(e).alias("extractor"), F.lit(f).alias("field"), F.lit(0).cast("bigint").alias("part_no"), F.lit(0).alias("ord")]
    add = new.select("doc_id", *fill("magic", "spell_schools"), "name", F.lit(None).cast("string").alias("value"))
    seen = F.filter(F.array(*[F.when(F.col("text").rlike(rf"(?iU)\b\Q{n}\E\b"), F.struct(F.lit(n).alias("name"), F.lit(str(p)).alias("value"))) for n, p in levels]), lambda v: v.isNotNull())
    hit = texts.select("doc_id", F.inline(seen)).distinct()
    ok = hit.groupBy("doc_id").agg(F.countDistinct("name").alias("n")).filter("n >= 3").select("doc_id")
    ok = ok.join(rows.filter("field = 'health_levels'").select("doc_id").distinct(), "doc_id", "left_anti")
    lv = hit.join(ok, "doc_id", "left_semi").select("doc_id", *fill("health", "health_levels"), "name", "value")
    return rows.unionByName(add).unionByName(lv)


def merge_extractions(a: DataFrame, b: DataFrame) -> DataFrame:
    """The second extraction wins scalar fields; list fields are united without duplicates."""
    scalar = lambda d: d.filter(F.col("name").isNull())
    keys = ["doc_id", "extractor", "field"]
    kept = scalar(a).join(scalar(b).select(*keys).distinct(), keys, "left_anti")
    lists = a.filter(F.col("name").isNotNull()).unionByName(b.filter(F.col("name").isNotNull()))
    return kept.unionByName(scalar(b)).unionByName(lists.dropDuplicates([*keys, "name", "value"]))


def assemble_configs(rows: DataFrame) -> dict[str, DataFrame]:
    """Configuration tables; triggers hold for every counter of their document."""
    value = F.split("value", "/")
    counters = rows.filter("field = 'clocks'").select(
        "doc_id", F.replace(F.lower("name"), F.lit(" "), F.lit("_")).alias("counter"), "name", F.get(value, F.lit(0)).cast("bigint").alias("value"),
        F.get(value, F.lit(1)).cast("bigint").alias("max"), "part_no", "ord",
    )
    last = counters.groupBy("doc_id", "counter").agg(F.max_by(F.struct("name", "value", "max"), F.struct("part_no", "ord")).alias("c")).select("doc_id", "counter", "c.*")
    trig = last_by_name(rows.filter("field = 'triggers'")).select("doc_id", F.col("name").alias("threshold"), F.col("value").alias("effect"))
    pick = lambda f: rows.filter(F.col("field") == f).select("doc_id", "name", "value", "part_no", "ord")
    return {
        "counters": last,
        "triggers": last.select("doc_id", "counter").join(trig, "doc_id"),
        "conditions": last_by_name(rows.filter("field = 'conditions'")).select("doc_id", "name", F.col("value").alias("effect")),
        "presets": pick("presets"), "outcome_bands": pick("outcome_bands"), "action_types": pick("action_types"),
    }


def check_counters(counters: DataFrame, triggers: DataFrame) -> DataFrame:
    """Counters and triggers out of range."""
    from scrollwork.operators.audit import issue_rows

    a = issue_rows(counters, ["doc_id", "counter"], [
        ("max_not_positive", F.col("max") <= 0, F.col("max")), ("negative_value", F.col("value") < 0, F.col("value")), ("value_over_max", F.col("value") > F.col("max"), F.col("value")),
    ])
    t = triggers.join(counters.select("doc_id", "counter", "max"), ["doc_id", "counter"]).withColumn("at", F.col("threshold").try_cast("bigint"))
    b = issue_rows(t, ["doc_id", "counter"], [
        ("threshold_not_a_number", F.col("at").isNull(), F.lit(0)), ("threshold_out_of_range", (F.col("at") < 0) | (F.col("at") > F.col("max")), F.col("at")),
    ])
    return a.unionByName(b)


def band_gaps(bands: DataFrame) -> DataFrame:
    """Gaps between a document's outcome bands (``a-b``, or ``a+`` up to 99). Equal bands count once."""
    r = F.col("range")
    low = F.when(F.contains(r, F.lit("+")), F.replace(r, F.lit("+"), F.lit(""))).otherwise(F.get(F.split(r, "-"), F.lit(0))).try_cast("int")
    high = F.when(F.contains(r, F.lit("+")), F.lit(99)).otherwise(F.get(F.split(r, "-"), F.lit(1)).try_cast("int"))
    b = bands.select("doc_id", low.alias("low"), high.alias("high")).dropna().distinct()
    nxt = F.lead("low").over(W.partitionBy("doc_id").orderBy("low", "high"))
    return b.withColumn("next", nxt).filter(F.col("next") > F.col("high") + 1).select("doc_id", (F.col("high") + 1).alias("gap_from"), (F.col("next") - 1).alias("gap_to"))


def check_templates(templates: DataFrame, conditions: DataFrame, entities: DataFrame) -> DataFrame:
    """Templates without a threat level or a lore entity; conditions without an effect."""
    a = templates.filter(F.coalesce("threat_level", F.lit("")) == "").select("doc_id", F.lit("missing_threat_level").alias("issue"), "name")
    b = conditions.filter(F.coalesce("effect", F.lit("")) == "").select("doc_id", F.lit("missing_effect").alias("issue"), "name")
    slug = F.replace(F.lower("name"), F.lit(" "), F.lit("_"))
    named = templates.filter(F.coalesce("name", F.lit("")) != "").withColumn("entity_id", slug)
    c = named.join(entities.select("doc_id", "entity_id"), ["doc_id", "entity_id"], "left_anti").select("doc_id", F.lit("no_lore_entity").alias("issue"), "name")
    return a.unionByName(b).unionByName(c)


def counter_edges(counters: DataFrame, triggers: DataFrame) -> DataFrame:
    """``a -> b`` where a trigger text of one counter holds another counter's id.

    Texts and ids meet on the id's rarest gram, not as all pairs.
    """
    t = triggers.select("doc_id", F.col("counter").alias("a"), F.lower("effect").alias("text")).distinct()
    held = containing(t, counters.select("doc_id", F.col("counter").alias("pattern")), ["doc_id"])
    edges = t.join(held, ["doc_id", "text"]).select("doc_id", "a", F.col("pattern").alias("b"))
    return edges.filter(F.col("a") != F.col("b")).distinct()


def find_cycles(edges: DataFrame) -> DataFrame:
    """Edges that lie on cycles; a document with any has a circular chain."""
    members = cut_lineage(cycle_members(edges))
    end = lambda c: members.select("doc_id", F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    both = edges.select("doc_id", "a", "b").distinct().join(end("a"), ["doc_id", "a"]).join(end("b"), ["doc_id", "b"])
    return both.filter("c_a = c_b").select("doc_id", "a", "b")


def extraction_report(rows: DataFrame, confidence: DataFrame, below: float = 0.5) -> DataFrame:
    """Items, fields and confidence per document and extractor, and what needs review."""
    n = rows.groupBy("doc_id", "extractor").agg(F.count(F.lit(1)).alias("items"))
    return n.join(confidence, ["doc_id", "extractor"]).withColumn("needs_review", F.col("confidence") < below)
