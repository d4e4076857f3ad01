import math
import random

import pytest

from scrollwork.operators import retrieval


@pytest.fixture(scope="module")
def corpus(spark):
    texts = ["red lamp in the old town", "the old town hall", "a red red door", "town of old", "nothing here"]
    return spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")


def test_phrases_and_bm25(spark, corpus):
    q = spark.createDataFrame([("a", ["old town"]), ("b", ["red", "nothing!"])], "query_id string, keywords array<string>")
    hits = retrieval.keyword_search(q, corpus, 10)
    got = [(r.query_id, r.chunk_id, r.score) for r in hits.orderBy("query_id", "rank").collect()]
    assert [(g[0], g[1]) for g in got] == [("a", 1), ("a", 0), ("b", 4), ("b", 2), ("b", 0)]
    idf, mean = math.log((5 - 1 + 0.5) / 1.5), (6 + 4 + 4 + 3 + 2) / 5
    assert got[2][2] == round(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / mean)), 6)


@pytest.mark.parametrize("bound", [0, 4096])
def test_vector_search_both_ways(spark, monkeypatch, bound):
    monkeypatch.setattr(retrieval, "VECTOR_QUERY_ROWS", bound or 7)
    monkeypatch.setattr(retrieval, "VECTOR_ITEM_ROWS", 16)
    rng = random.Random(1)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    items = [(i, vec(), i % 2) for i in range(60)]
    queries = [(i, vec()) for i in range(20)]
    got = retrieval.vector_search(
        spark.createDataFrame(queries, "query_id long, vector array<double>"), spark.createDataFrame(items, "item_id long, vector array<double>, collection int"), 3
    ).collect()
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = set()
    for qid, q in queries:
        for c in (0, 1):
            best = sorted((-round(cos(q, v), 6), i) for i, v, k in items if k == c)[:3]
            want |= {(qid, str(c), i, r + 1) for r, (_, i) in enumerate(best)}
    assert {(r.query_id, r.collection, r.item_id, r["rank"]) for r in got} == want


def test_budget_keeps_the_first_and_a_prefix(spark):
    rows = [("q", 1, 0, 1, 3000), ("q", 2, 0, 2, 10), ("r", 3, 0, 1, 900), ("r", 4, 0, 2, 900), ("r", 5, 0, 3, 900), ("r", 6, 0, 4, 1)]
    c = spark.createDataFrame(rows, "query_id string, chunk_id long, stage int, rank int, token_estimate int")
    assert sorted(r.chunk_id for r in retrieval.budget_cap(c).collect()) == [1, 3, 4]


def test_retrieve_keeps_to_the_packs_and_types_of_a_query(spark):
    rows = [(i, p, k, "red lamp", [], f"f{i}", 5) for i, (p, k) in enumerate([("p", "lore"), ("z", "lore"), ("p", "rule"), ("y", "lore")])]
    chunks = spark.createDataFrame(rows, "chunk_id long, pack_id string, chunk_type string, content string, entity_refs array<string>, file_path string, token_estimate int")
    q = [("one", ["red"], [], ["p"], None), ("two", ["red"], [], ["y", "p"], ["lore"]), ("all", ["lamp"], [], None, ["lore"])]
    queries = spark.createDataFrame(q, "query_id string, keywords array<string>, entity_ids array<string>, pack_ids array<string>, chunk_types array<string>")
    got = {}
    for r in retrieval.retrieve(queries, chunks).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {"one": [0, 2], "two": [3, 0], "all": [0, 1, 3]}


def test_types_are_filtered_before_the_limit(spark):
    rows = [(f"c{k:03}", "p", "dragon " * (1 + k % 3), f"f{k}", "lore", [], 10) for k in range(80)]
    rows += [(f"d{k}", "p", "a dragon far away in a long sentence about many other things " * 3, f"g{k}", "npc", [], 10) for k in range(3)] + [("e0", "q", "one dragon of many words here", "h", "item", [], 10)]
    chunks = spark.createDataFrame(rows, "chunk_id string, pack_id string, content string, file_path string, chunk_type string, entity_refs array<string>, token_estimate int")
    q = [("packs", ["dragon"], [], ["p"], ["npc"]), ("all", ["dragon"], [], [], ["npc", "item", "npc"]), ("any", ["dragon"], [], ["q"], [])]
    queries = spark.createDataFrame(q, "query_id string, keywords array<string>, entity_ids array<string>, pack_ids array<string>, chunk_types array<string>")
    got = {}
    for r in retrieval.retrieve(queries, chunks, max_chunks=5).collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert {k: sorted(v) for k, v in got.items()} == {"packs": ["d0", "d1", "d2"], "all": ["d0", "d1", "d2", "e0"], "any": ["e0"]}
