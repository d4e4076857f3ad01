"""Stems against published pairs, and the written index against the scan."""
import random

import pytest
from pyspark.sql import functions as F

from scrollwork.functions.stem import stem
from scrollwork.operators import retrieval, text_index

#: pairs from the paper
PAIRS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile
analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal
sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust
dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
probate probat rate rate cease ceas controll control roll roll investigate investig investigating investig""".split()


def test_published_stems():
    assert {w: stem(w) for w in PAIRS[::2]} == dict(zip(PAIRS[::2], PAIRS[1::2]))
    assert [stem(w) for w in ("", "a", "is", "été", "x9s", "yyyy")] == ["", "a", "is", "été", "x9s", "yyyi"]


def chunks(spark, rows):
    cols = "chunk_id string, pack_id string, section_title string, content string, chunk_type string, tags array<string>, entity_refs array<string>, file_path string, token_estimate int"
    return spark.createDataFrame([(c, p, t, x, k, tags, [], c, 5) for c, p, t, x, k, tags in rows], cols)


ROWS = [
    ("007:bar", "007", "The Bar", "A cyberpunk bar with neon lights. Red red red lamp", "location", ["place"]),
    ("007:viktor", "007", "Viktor", "Viktor is investigating the old town hall; red lamp", "npc", []),
    ("p2:club", "p2", "Club", "A neon club of the old", "location", ["town"]),
    ("p2:empty", "p2", None, None, "item", None),
    ("p2:note", "p2", "investigation", "nothing", "general", ["red"]),
]


def ask(spark, path, keywords, within=[], **more):
    q = spark.createDataFrame([(1, keywords, *more.values())], ", ".join(["query_id long", "keywords array<string>", *[f"{k} string" for k in more]]))
    return [r.chunk_id for r in text_index.search_index(q, path, 10, within).orderBy("rank").collect()]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}"
    text_index.write_index(chunks(spark, ROWS), path, text_index.chunk_fields(), carry=["chunk_type"], stemmed=True, buckets=2)
    return path


def test_searches(spark, index):
    assert set(ask(spark, index, ["investigate"])) == {"007:viktor", "p2:note"}  # a body and a title
    assert ask(spark, index, ["neon"], ["pack_id"], pack_id="007") == ["007:bar"]
    assert ask(spark, index, ["neon"], ["pack_id", "chunk_type"], pack_id="p2", chunk_type="location") == ["p2:club"]
    assert ask(spark, index, ["item"]) == ["p2:empty"]  # by type alone
    assert set(ask(spark, index, ["old town"])) == {"007:viktor"}  # no phrase across body and tags
    assert set(ask(spark, index, ["p2"])) == {"p2:club", "p2:empty", "p2:note"}  # a word of the id
    assert ask(spark, index, ["absent words", "!"]) == []


def test_places_of_phrases(spark, index):
    phrases = spark.createDataFrame([("red red",), ("red lamp",), ("red",)], "phrase string")
    hits, freq = text_index.index_hits(spark, index, phrases)
    assert sorted((r.phrase, r.chunk_id, r.tf) for r in hits.collect()) == [("red", "007:bar", 3), ("red", "007:viktor", 1), ("red", "p2:note", 1), ("red lamp", "007:bar", 1), ("red lamp", "007:viktor", 1), ("red red", "007:bar", 2)]
    assert sorted(map(tuple, freq.collect())) == [("red", 3), ("red lamp", 2), ("red red", 1)]


def test_no_text_is_read(spark, index):
    q = spark.createDataFrame([(1, ["neon", "old town"])], "query_id long, keywords array<string>")
    plan = text_index.search_index(q, index, 10)._jdf.queryExecution().toString()
    assert "content" not in plan and "section_title" not in plan
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan


def test_index_equals_scan(spark, tmp_path):
    rnd = random.Random(5)
    words = ["old", "town", "hall", "red", "lamp", "é", "x9", "neon"]
    rows = [(f"c{k}", f"p{k % 3}", "", " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))), "t", []) for k in range(200)]
    df = chunks(spark, rows)
    text_index.write_index(df, f"file://{tmp_path}/i", [F.col("content")], buckets=2)
    queries = spark.createDataFrame([(k, rnd.sample(words, 2) + [" ".join(rnd.choice(words) for _ in range(rnd.randint(2, 3)))]) for k in range(20)], "query_id long, keywords array<string>")
    want = sorted(map(tuple, retrieval.keyword_search(queries, df, 10).collect()))
    assert sorted(map(tuple, text_index.search_index(queries, f"file://{tmp_path}/i", 10).collect())) == want


def test_packs_are_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    df = chunks(spark, ROWS)
    text_index.write_index(df, path, text_index.chunk_fields(), buckets=1)
    new = chunks(spark, [("007:new", "007", "", "one neon sign", "location", [])])
    text_index.reindex_packs(new, path, text_index.chunk_fields(), spark.createDataFrame([("007",), ("gone",)], "pack_id string"))
    assert set(ask(spark, path, ["neon"])) == {"007:new", "p2:club"} and ask(spark, path, ["lamp"]) == []
    # frequencies and sizes are those of the new state, as if the index were made anew
    again = f"file://{tmp_path}/j"
    text_index.write_index(df.where("pack_id <> '007'").unionByName(new), again, text_index.chunk_fields(), buckets=1)
    q = spark.createDataFrame([(1, ["neon", "old"])], "query_id long, keywords array<string>")
    assert text_index.search_index(q, path, 9).collect() == text_index.search_index(q, again, 9).collect()


def test_retrieve_with_every_stage(spark, tmp_path):
    path, df = f"file://{tmp_path}/i", chunks(spark, ROWS)
    text_index.write_index(df, path, text_index.chunk_fields(), carry=["chunk_type"])
    items = spark.createDataFrame([("007:bar", [1.0, 0.0], "007"), ("007:viktor", [0.9, 0.1], "007"), ("p2:note", [1.0, 0.0], "p2"), ("p2:empty", [0.0, 1.0], "p2")], "item_id string, vector array<double>, collection string")
    manifest = spark.createDataFrame([("e", "p2:club")], "entity_id string, chunk_id string")
    q = spark.createDataFrame([("a", ["viktor"], ["e"], ["p2", "007"], None, [1.0, 0.0]), ("b", ["neon"], [], ["007"], ["location"], None)], "query_id string, keywords array<string>, entity_ids array<string>, pack_ids array<string>, chunk_types array<string>, vector array<double>")
    got = {}
    for r in retrieval.retrieve(q, df, manifest, items=items, index=path).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.stage))
    assert got == {"a": [("p2:club", 0), ("007:viktor", 1), ("p2:note", 3), ("p2:empty", 3), ("007:bar", 3)], "b": [("007:bar", 1)]}
    scan = retrieval.retrieve(q, df, manifest, items=items).select("query_id", "chunk_id", "place")
    assert {r.query_id for r in scan.collect()} == {"a", "b"}


def test_phrases_meet_once_a_chunk(spark, tmp_path):
    """Phrases that share words do not bring their postings once each, and a chunk may go over the end of a batch."""
    rnd = random.Random(8)
    words = ["old", "town", "hall", "red"]
    texts = {f"c{k}": [rnd.choice(words) for _ in range(rnd.randint(0, 25))] for k in range(60)}
    rows = [(c, f"p{int(c[1:]) % 2}", "", " ".join(ts), "t", []) for c, ts in texts.items()]
    text_index.write_index(chunks(spark, rows), f"file://{tmp_path}/i", [F.col("content")], buckets=2)
    phrases = [("old", "town"), ("old", "town", "old"), ("red", "red"), ("hall", "red", "old", "town"), ("town", "lamp")]
    sent = spark.createDataFrame([(" ".join(p),) for p in phrases], "phrase string")
    want = sorted((" ".join(p), c, len(ts), n) for p in phrases for c, ts in texts.items() if (n := sum(tuple(ts[i : i + len(p)]) == p for i in range(len(ts)))))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        hits, freq = text_index.index_hits(spark, f"file://{tmp_path}/i", sent)
        assert "collect_list" not in hits._jdf.queryExecution().toString()
        assert sorted((r.phrase, r.chunk_id, r.length, r.tf) for r in hits.collect()) == want
        assert dict(map(tuple, freq.collect())) == {p: sum(w[0] == p for w in want) for p in {w[0] for w in want}}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_named_packs_are_not_dealt_by_pack(spark, index):
    """One pack may hold most rows: a few named packs are a filter, and the rows of a pack's run share a row of the index."""
    packs = spark.createDataFrame([("007",)], "pack_id string")
    stored = text_index._read(spark, f"{index}/postings")
    assert text_index._named(packs) == ["007"] and text_index._named(spark.range(1001).select(F.col("id").cast("string").alias("pack_id"))) is None
    few = text_index._of_packs(stored, packs, ["007"])
    assert "Join" not in few._jdf.queryExecution().toString()
    assert sorted(map(tuple, few.where("term <> ''").select("term", "chunks", "tokens").collect())) == sorted(map(tuple, text_index._of_packs(stored, packs, None).where("term <> ''").select("term", "chunks", "tokens").collect()))
    assert stored.where("term = 'red'").groupBy("pack_id").agg(F.sum("chunks"), F.sum("tokens")).orderBy("pack_id").collect() == [("007", 2, 4), ("p2", 1, 1)]


def test_equal_queries_are_ranked_once(spark, index):
    rows = [(1, "007", ["lamp", "bar"]), (2, "007", ["Bar", "lamp", "lamp"]), (None, "007", ["bar", "lamp"]), (3, "p2", ["neon"]), (4, "007", ["bar"]), (5, "p2", ["!"])]
    q = spark.createDataFrame(rows, "query_id long, pack_id string, keywords array<string>")
    of, asks = text_index.same_asked(retrieval.query_phrases(q, ["pack_id"]), ["pack_id"])
    assert sorted((r.query_id or 0, r.ask.query_id or 0) for r in of.collect()) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4)]
    assert sorted((r.query_id[0] or 0, r.phrase) for r in asks.collect()) == [(0, "bar"), (0, "lamp"), (3, "neon"), (4, "bar")]
    got = sorted((r.query_id or 0, r["rank"], r.chunk_id) for r in text_index.search_index(q, index, 10, ["pack_id"]).collect())
    one = [(1, "007:bar"), (2, "007:viktor")]
    assert got == [(i, *r) for i in (0, 1, 2) for r in one] + [(3, 1, "p2:club"), (4, 1, "007:bar")]
