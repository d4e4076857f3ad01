"""Rare-gram joins against all pairs."""
import random

from scrollwork.operators import actions, substrings


def frames(spark, texts, patterns):
    return spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(patterns, "k long, pattern string")


def test_all_pairs(spark):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, n)))
    texts = [(rnd.choice([1, 1, 2]), word(30)) for _ in range(200)] + [(1, None), (None, "abc")]
    patterns = [(rnd.choice([1, 1, 2]), word(5)) for _ in range(150)] + [(1, None), (1, ""), (None, "a"), (3, "a")]
    got = substrings.containing(*frames(spark, texts, patterns), ["k"]).collect()
    want = {(k, t, p) for k, t in texts for j, p in patterns if k is not None and k == j and t is not None and p and p in t}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100


def test_shared_beginnings_are_no_candidates(spark):
    """All names begin alike; references begin as all names do."""
    names = [(1, f"supplier#{n:09d}") for n in range(2000)]
    wanted = [(1, f"supplier#{n:09d}"[: 9 + 9]) for n in range(0, 2000, 10)] + [(1, f"supplier{n}") for n in range(200)]
    texts, patterns = frames(spark, names, wanted)
    assert substrings.candidates(texts, patterns, ["k"]).count() < 0.05 * len(names) * len(wanted)
    assert substrings.containing(texts, patterns, ["k"]).count() == 200


def test_targets(spark):
    entities = spark.createDataFrame([(1, "e1", "Old Tower", 0), (1, "e2", "The old tower", 1), (1, "e3", "Tower", 2), (2, "e4", "Old", 0)], "campaign_id long, entity_id string, name string, ord long")
    acts = spark.createDataFrame([(1, 0, "e3"), (1, 1, "TOWER"), (1, 2, "ld tow"), (1, 3, "he"), (1, 4, "nobody"), (2, 5, "tower"), (1, 6, None), (1, 7, "")], "campaign_id long, ord long, target string")
    got = {r.ord: r.target_id for r in actions.resolve_targets(acts, entities).collect()}
    assert got == {0: "e3", 1: "e3", 2: "e1", 3: "e2", 4: "nobody", 5: "tower", 6: None, 7: ""}


def test_grams_are_never_broadcast(spark, tmp_path):
    """Their number is not in Spark's estimate, so the grams of many short texts would go to the driver whole."""
    texts, patterns = frames(spark, [(1, "raise abc")], [(1, "abc")])
    texts.write.parquet(f"{tmp_path}/t"), patterns.write.parquet(f"{tmp_path}/p")
    plan = substrings.containing(spark.read.parquet(f"{tmp_path}/t"), spark.read.parquet(f"{tmp_path}/p"), ["k"])._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "g#" in line]
    assert len(joins) == 2 and all("SortMergeJoin" in line for line in joins), joins


def test_long_patterns_meet_by_long_grams(spark):
    """Numbers share their groups of three digits with a share of all others."""
    names = [(1, f"raise s{n}. and s{2 * n}.") for n in range(100_000, 103_000)]
    texts, patterns = frames(spark, names, [(1, f"s{n}.") for n in range(100_000, 103_000, 3)])
    assert substrings.candidates(texts, patterns, ["k"]).count() < 2 * 1000
    assert substrings.containing(texts, patterns, ["k"]).count() == 1000
