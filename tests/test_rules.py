"""Rule tables against one regular expression at a time."""
import random
import re

import pytest

from scrollwork.operators import rules

RULE = "rule_set string, pattern string, meaning string"


@pytest.mark.parametrize("loose", [0, 64])
def test_every_way_of_counting_equals_single_patterns(monkeypatch, loose):
    monkeypatch.setattr(rules, "LOOSE", loose)
    rng = random.Random(4)
    patterns = ["an", "AN", "a-", "aa", "aaa", r"^a", r"^[a-z]+", r"^a*", r"^(?=a)n*", r"^\s+a", r"^a|n", r"^é", r"^\w+\n+a", r"\ban\b", "na"]
    whole = rules.Matcher(patterns)
    for _ in range(600):
        text = "".join(rng.choice("aAnN -_\né\u212a\r") for _ in range(rng.randrange(40)))
        want = {i: len(list(re.finditer(p, text, rules.FLAGS))) for i, p in enumerate(patterns)}
        assert whole.count(text) == {i: n for i, n in want.items() if n}, text


def test_a_pattern_of_many_rules_is_sought_once(spark, monkeypatch):
    kinds = []
    table = spark.createDataFrame([(s, p, m) for s in "abc" for m in ("x", "y") for p in ("la", "^r[a-z]+")], RULE)
    monkeypatch.setattr(rules, "_blocks", lambda r, plain=rules._blocks: [kinds.append(sorted(x.pattern for x in b.collect())) or b for b in plain(r)])
    df = spark.createDataFrame([(1, "red lamp"), (1, "la\nrun"), (2, "x")], "doc_id long, text string")
    got = {tuple(r) for r in rules.rule_matches(df, table).collect()}
    assert got == {(1, s, m, 4) for s in "abc" for m in ("x", "y")}
    assert kinds == [["^r[a-z]+", "la"]]


def test_shared_pass_equals_single_patterns():
    rng = random.Random(2)
    patterns = ["an", "ana", r"\banana\b", "Aan a", r"\ba\b", "n-a", r"a\w+n", r"^an", r"an$", "aa", r"\ban", r"a_", r"\ba-\b", "é"]
    whole = rules.Matcher(patterns)
    for _ in range(400):
        text = "".join(rng.choice("aAnN -_\né") for _ in range(rng.randrange(40)))
        want = {i: len(list(re.finditer(p, text, rules.FLAGS))) for i, p in enumerate(patterns)}
        assert whole.count(text) == {i: n for i, n in want.items() if n}, text


@pytest.mark.parametrize("size", [1, 4 << 20])
def test_tables_of_rules(spark, monkeypatch, size):
    monkeypatch.setattr(rules, "RULE_BYTES", size * 100 if size == 1 else size)
    texts = [(2**60 + 1, "Red lamp, red LAMP"), (2**60 + 1, "lamp"), (None, "red"), (7, None), (8, "")]
    table = [("a", "red", "colour"), ("a", "red", "colour"), ("a", r"\bblue\b", "colour"), ("b", r"l\wmp", "thing"), ("b", "lamp", "thing"), ("b", None, "thing"), (None, "red", "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {tuple(r) for r in rules.rule_matches(df, spark.createDataFrame(table, RULE)).collect()}
    assert got == {(2**60 + 1, "a", "colour", 2), (2**60 + 1, "b", "thing", 6), (None, "a", "colour", 1)}
    assert rules.rule_matches(df, spark.createDataFrame([], RULE)).collect() == []
    assert rules.rule_matches(df.filter("doc_id = 0"), spark.createDataFrame(table, RULE)).collect() == []
    with pytest.raises(ValueError, match="a\\("):
        rules.rule_matches(df, spark.createDataFrame([("a", "a(", "m")], RULE))
