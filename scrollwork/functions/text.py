"""Column helpers for text. All of them stay inside the JVM.

Patterns are written for Unicode text, so the word classes get the ``(?U)`` flag.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SPACE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def filled_lines(c: Column) -> Column:
    """Stripped, non-blank lines of a text."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def word_array(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def token_estimate(c: Column) -> Column:
    return F.floor(word_count(c) * F.lit(1.33)).cast("int")


def slugify(c: Column) -> Column:
    kept = F.regexp_replace(strip(F.lower(c)), r"(?U)[^a-z0-9\s_-]", "")
    joined = F.btrim(F.regexp_replace(kept, r"(?U)[\s_-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("untitled"))


def title_case(c: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest."""
    parts = F.split(c, r"(?<=\P{L})(?=\p{L})")
    return F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), ""
    )


def is_upper(c: Column) -> Column:
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")


def pattern(p: str, ignore_case: bool = True) -> str:
    return ("(?iU)" if ignore_case else "(?U)") + p


def lowered(p: str) -> str:
    """A pattern for text that is already in lower case; escapes such as ``\\S`` stay."""
    return re.sub(r"(\\.)|([A-Z])", lambda m: m.group(1) or m.group(2).lower(), p)


def matches(c: Column, p: str) -> Column:
    """Number of non-overlapping matches of one literal pattern."""
    return F.regexp_count(c, F.lit(p))


def ascii_form(c: Column) -> Column:
    """Text in which ASCII ``\\b \\w \\d \\s`` match where the Unicode ones match in the original.

    Other letters become ``x``, digits ``0`` and spaces a space, one for one. Text that is
    ASCII already is passed on, and the patterns can then do without the slower Unicode classes.
    """
    other = F.regexp_replace(c, r"[\p{L}\p{M}&&[^\x00-\x7F]]", "x")
    other = F.regexp_replace(other, r"[\p{Nd}&&[^\x00-\x7F]]", "0")
    other = F.regexp_replace(other, r"[\p{Z}\x{85}&&[^\x00-\x7F]]", " ")
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(other)


def ascii_safe(patterns: list[str]) -> bool:
    """No pattern names a letter outside ASCII."""
    return not any(ch.isalpha() and ord(ch) > 127 for p in patterns for ch in p)


def alternation(patterns: list[str]) -> str:
    """One alternation in the given order; neighbours that open at a word boundary share the test
    for it, so the engine passes over the inside of words."""

    def bounded(p: str) -> bool:
        return all(a.startswith(r"\b") for a in re.sub(r"\([^()]*\)", "", p).split("|"))

    out, run = [], []
    for p in [*patterns, None]:
        if p is not None and bounded(p):
            run.append(p.removeprefix(r"\b"))
            continue
        if run:
            out.append(r"\b(?:" + "|".join(run) + ")")
            run = []
        if p is not None:
            out.append(p)
    return "|".join(out)


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def patterns_hit(c: Column, patterns: list[str], ignore_case: bool = True) -> Column:
    """How many of the patterns occur at least once."""
    return total([c.rlike(pattern(p, ignore_case)).cast("int") for p in patterns])


def _plain(p: str) -> str | None:
    """The word of a pattern of the form ``\\bword\\b``; such patterns cannot overlap each other."""
    m = re.fullmatch(r"\\b([a-z]+)\\b", p)
    return m.group(1) if m else None


def patterns_total(c: Column, patterns: list[str], ignore_case: bool = True, flags: str | None = None) -> Column:
    """Matches of all patterns together; plain words share one pass over the text."""
    words = [w for w in map(_plain, patterns) if w]
    other = [p for p in patterns if not _plain(p)]
    merged = [r"\b(?:" + "|".join(words) + r")\b"] if words else []
    return total([matches(c, pattern(p, ignore_case) if flags is None else flags + p) for p in merged + other])


def hold(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add columns that later filters and projections read instead of repeating.

    Catalyst substitutes projected expressions into the filters it pushes down, which would
    run the same patterns over the same text again; it does not look through a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def cut(c: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def normalised(c: Column) -> Column:
    """Lower-case text with one space between words and a space at either end."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def first_in(c: Column, table: list[tuple[str, object]], default=None) -> Column:
    """CASE over a literal lookup table."""
    out = None
    for key, value in table:
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out.otherwise(F.lit(default))


def best_of(scored: list[tuple[str, Column]]) -> Column:
    """``struct(score, name)`` of the highest score; the first listed wins ties."""
    entries = [
        F.struct(score.cast("double").alias("score"), F.lit(-i).alias("prio"), F.lit(name).alias("name"))
        for i, (name, score) in enumerate(scored)
    ]
    return F.array_max(F.array(*entries))
