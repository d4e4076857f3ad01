"""The vector index against exact search."""
import numpy as np
from pyspark.sql import functions as F

from scrollwork.operators import retrieval, vector_index
from scrollwork.session import scratch

FORM = "vector array<double>"


def frames(spark, rng, n=1500, dim=24, groups=40):
    around = rng.normal(size=(groups, dim))
    vec = lambda i: (around[i % groups] + 0.45 * rng.normal(size=dim)).tolist()
    items = [(f"i{i:05d}", vec(i), "hot" if i % 3 else f"c{i % 4}") for i in range(n)]
    items += [items[1]] * 5 + [("zero", [0.0] * dim, "hot"), ("none", None, "hot"), (None, vec(0), "hot")]
    return (spark.createDataFrame([(i, vec(i * 7)) for i in range(30)] + [(90, [0.0] * dim), (91, None)], "query_id long, " + FORM),
            spark.createDataFrame(items, "item_id string, " + FORM + ", collection string"))


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "collection", "rank", "item_id", "similarity").collect())


def test_recall_and_complete_answers(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_BYTES", 64 * 8 * 24)
    queries, items = frames(spark, np.random.default_rng(3))
    path = scratch(spark, "vectors")
    vector_index.write_index(items, path, sample_rows=400)
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.agg(F.sum(F.size("ids"))).first()[0] == 1506
    want = rows(retrieval.vector_search(queries.dropna(), items.dropna(), 10))
    assert rows(vector_index.search_index(queries, path, 10, probes=2, complete=True)) == want
    wanted = {r[:2] + r[3:4] for r in want if r[0] != 90}
    recall = {}
    for probes in (8, None):
        found = {r[:2] + r[3:4] for r in rows(vector_index.search_index(queries, path, 10, probes=probes))}
        recall[probes] = len(found & wanted) / len(wanted)
    print("recall at 10 with 8 probes and with the index's own number:", recall)
    assert recall[None] >= 0.9
    one = rows(vector_index.search_index(queries, path, 10, probes=2, collections=["c3"], complete=True))
    assert one == [r for r in want if r[1] == "c3"] and one


def test_an_empty_index_finds_nothing(spark):
    queries, items = frames(spark, np.random.default_rng(3), n=3)
    path = scratch(spark, "vectors")
    vector_index.write_index(items.filter("item_id = 'none'"), path)
    assert rows(vector_index.search_index(queries, path)) == []
