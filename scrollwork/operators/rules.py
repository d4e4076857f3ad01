"""Rule tables as data: patterns come as rows, so a user replaces a table and no code.

The rules are sent to the tasks in blocks of bounded size. A task compiles a block once. Patterns that are plain ASCII words or phrases,
with or without ``\\b`` at both ends, share one pass over a text; patterns that begin with ``^`` are tried where lines begin; every other
pattern has a pass of its own.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

RULE_BYTES = 4 << 20
FLAGS = re.IGNORECASE | re.MULTILINE | re.ASCII
PLAIN = re.compile(r"(\\b)?([A-Za-z0-9][A-Za-z0-9 _-]*)(\\b)?")
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")
LOWER = {c: c + 32 for c in range(65, 91)}
LINE_END = re.compile("\n")
#: words without ``\\b`` that are sought one by one
LOOSE = 64


class Matcher:
    """Counts matches of a list of patterns; matches of one pattern do not overlap, those of different ones may."""

    def __init__(self, patterns: list[str]):
        self.other, self.heads, words = [], [], {}
        for i, p in enumerate(patterns):
            m = PLAIN.fullmatch(p)
            if m and bool(m[1]) == bool(m[3]) and not (m[1] and not (m[2][-1].lower() in WORD)):
                words.setdefault(m[2].translate(LOWER), []).append((i, bool(m[1])))
            else:
                (self.heads if p.startswith("^") and "|" not in p else self.other).append((i, re.compile(p, FLAGS)))
        # a few words that may stand anywhere are counted one by one, which takes a small share of the shared pass
        loose = [w for w in words if not any(whole for _, whole in words[w])]
        self.loose = [(w.encode(), [i for i, _ in words.pop(w)]) for w in loose] if len(loose) <= LOOSE else []
        self.words = words
        # at every place the longest word that begins there; the shorter ones that also begin there are its prefixes
        self.prefixes = {w: [w[:k] for k in range(1, len(w) + 1) if w[:k] in words] for w in words}
        longest = sorted(words, key=lambda w: (-len(w), w))
        self.any = re.compile("(?=(" + "|".join(map(re.escape, longest)) + "))") if words else None

    def count(self, text: str) -> dict[int, int]:
        found, ends = {}, {}
        if self.loose:
            low = text.encode("utf-8", "surrogatepass").lower()  # of bytes only ASCII letters have a case
            for w, which in self.loose:
                n = low.count(w)
                if n:
                    found.update(dict.fromkeys(which, n))
        if self.any is not None:
            low = text.translate(LOWER)
            for m in self.any.finditer(low):
                at = m.start()
                open_ = at == 0 or low[at - 1] not in WORD
                for w in self.prefixes[m[1]]:
                    end = at + len(w)
                    for i, whole in self.words[w]:
                        if at >= ends.get(i, 0) and (not whole or (open_ and (end == len(low) or low[end] not in WORD))):
                            ends[i] = end
                            found[i] = found.get(i, 0) + 1
        if self.heads:
            lines = [0, *(m.end() for m in LINE_END.finditer(text))]
            for i, p in self.heads:
                n = _at_lines(p, text, lines)
                if n:
                    found[i] = n
        for i, p in self.other:
            n = sum(1 for _ in p.finditer(text))
            if n:
                found[i] = n
        return found


def _at_lines(p: re.Pattern, text: str, lines: list[int]) -> int:
    """Matches of a pattern that begins with ``^``, tried where lines begin only."""
    n = end = 0
    for at in lines:
        m = p.match(text, at) if at >= end else None
        if m:
            if m.end() == at:  # after an empty match another may begin at the same place
                return sum(1 for _ in p.finditer(text))
            n, end = n + 1, m.end()
    return n


def _blocks(patterns: DataFrame) -> list[DataFrame]:
    """The patterns in hash blocks of about ``RULE_BYTES`` or less."""
    size = patterns.agg(F.sum(F.octet_length("pattern") + 64)).first()[0] or 0
    n = max(1, -(-size // RULE_BYTES))
    block = F.pmod(F.xxhash64("pattern"), F.lit(n))
    return [patterns.filter(block == i) for i in range(n)]


def rule_matches(texts: DataFrame, rules: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, rule_set, meaning, matches``: matches of the patterns of ``rules(rule_set, pattern, meaning)`` in the texts of each key.

    Patterns ignore the case of ASCII letters, ``^`` and ``$`` stand at lines, classes such as ``\\b`` and ``\\w`` are ASCII; a pattern
    that does not compile raises and is named. Patterns with one set and meaning add up; repeated rules count once. Rules with a null
    are left out, null texts are empty, keys may be null. Only counts above zero give rows. Every text meets every block of patterns; a
    pattern is sought once, however many rules have it, and its sum over the texts of a key then meets its rules.
    """
    kind = dict(texts.dtypes)[key]
    rules = rules.select("rule_set", "pattern", "meaning").dropna().distinct()
    side = texts.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    parts = []
    for block in _blocks(rules.select("pattern").distinct()):
        got = [r.pattern for r in block.orderBy("pattern").collect()]  # RULE_BYTES at most
        for p in got:
            try:
                re.compile(p, FLAGS)
            except re.error as e:
                raise ValueError(f"rule pattern {p!r}: {e}") from None
        sent = texts.sparkSession.sparkContext.broadcast(got)

        def scan(batches, sent=sent):
            matcher = Matcher(sent.value)
            names = pa.array(sent.value, pa.string())
            for batch in batches:
                # one row per key and pattern of the batch
                keys, which = batch.column("key"), range(batch.num_rows)
                if not pa.types.is_nested(keys.type):
                    coded = keys.dictionary_encode(null_encoding="encode")
                    keys, which = coded.dictionary, coded.indices.to_pylist()
                found: dict[tuple[int, int], int] = {}
                for k, t in zip(which, batch.column("text")):
                    for j, n in matcher.count(t.as_py()).items():
                        found[k, j] = found.get((k, j), 0) + n
                at, rule = (pa.array([x[i] for x in found], pa.int64()) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([keys.take(at), names.take(rule), pa.array(found.values(), pa.int64())], ["key", "pattern", "n"])

        if got:
            parts.append(side.mapInArrow(scan, f"key {kind}, pattern string, n bigint"))
    if not parts:
        parts = [side.select("key", F.lit("").alias("pattern"), F.lit(0).cast("bigint").alias("n")).filter(F.lit(False))]
    hits = reduce(DataFrame.unionByName, parts).groupBy("key", "pattern").agg(F.sum("n").alias("n"))
    return hits.join(rules, "pattern").groupBy(F.col("key").alias(key), "rule_set", "meaning").agg(F.sum("n").alias("matches"))
