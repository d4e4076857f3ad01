"""Text windows that go on behind a page, against the pages joined to one text."""
import random
import re

import pytest

from scrollwork.operators import mechanics


def pages(spark, docs):
    return spark.createDataFrame([(d, n, t) for d, ts in docs.items() for n, t in enumerate(ts)], "doc_id string, part_no long, text string")


def test_tails(spark):
    rnd = random.Random(3)
    docs = {f"d{k}": ["".join(rnd.choice("ab ") for _ in range(rnd.choice([0, 0, 1, 5, 40, 400]))) for _ in range(rnd.randint(1, 40))] for k in range(12)}
    docs["null"] = ["x", None, "y"]
    got = {(r.doc_id, r.part_no): r.tail for r in mechanics.with_tails(pages(spark, docs), 100).collect()}
    for d, ts in docs.items():
        for n in range(len(ts)):
            rest = "".join(mechanics.PAGE_BREAK + (t or "") for t in ts[n + 1 :])
            assert (got[d, n] or "")[:100] == rest[:100]
    assert got["null", 2] is None


def test_lists_on_the_next_page(spark):
    docs = {
        "a": ["Physical Attributes:", "Strength and\nStamina here\n", "Mental traits\nWits, Cunning"],
        "b": ["Skills:\n", "- Archery\n* Brawling\nSkills", "Climbing\n" + "x" * 1200 + "\nFar"],
        "c": ["Social Stats: Charm", "Attributes: none"],
    }
    got = {(r.doc_id, r.field, r.name): r.value for r in mechanics.extract_stats(pages(spark, docs)).collect()}
    assert got["a", "attributes", "physical"] == "strength,stamina,mental,wits,cunning"
    assert got["a", "attributes", "mental"] == "wits,cunning"
    assert got["b", "abilities", "skill"] == "climbing"  # the last group of a name counts; its window ends after 1 000 characters
    assert got["c", "attributes", "social"] == "charm,attributes"


def test_matches_begin_on_their_page(spark):
    """No match is found twice, whichever page sees it in its tail."""
    line = "Blade\nStrength + 2\n"
    docs = {"a": [line + "class two (thick", "coat)", "7 and -2 lethal\nclass one (thin)", line, "lethal", "class 3 (plate)\n5, -1"]}
    rows = mechanics.extract_equipment(pages(spark, docs)).collect()
    assert sorted((r.part_no, r.field, re.sub(r"\s*---\s*", " ", r.name.replace("\n", " ")), r.value) for r in rows if r.field != "ranged_weapons") == [
        (0, "melee_weapons", "Blade", "Strength + 2 unknown"), (0, "tiered_armor", "thick coat", "2/7/-2"), (2, "tiered_armor", "thin", "1/2/3"),
        (3, "melee_weapons", "Blade", "Strength + 2 lethal"), (5, "tiered_armor", "plate", "3/5/-1"),
    ]


@pytest.mark.parametrize("extract", [mechanics.with_tails, mechanics.extract_equipment])
def test_tails_are_never_broadcast(spark, tmp_path, extract):
    """Their length is not in Spark's estimate, so the tails of many short pages would go to the driver whole."""
    pages(spark, {"d": ["x", "y", "z"]}).write.parquet(f"{tmp_path}/pages")
    plan = extract(spark.read.parquet(f"{tmp_path}/pages"))._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "LeftOuter" in line]
    assert joins and all("SortMergeJoin" in line for line in joins), joins


def test_tails_of_a_repeated_page(spark):
    """Of equal places the tail of the first one counts, as it did when tails were broadcast."""
    rows = [("d", 1, "Grade Attributes:"), ("d", 1, "Grade Attributes:"), ("d", 2, "Plate Bolt")]
    texts = spark.createDataFrame(rows, "doc_id string, part_no long, text string")
    got = {r.name: r.value for r in mechanics.extract_stats(texts).collect() if r.field == "attributes"}
    assert got == {"grade": "grade,attributes,plate,bolt"}
