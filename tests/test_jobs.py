"""Registered jobs against their SQL statements at the smallest scale."""
import os

import pytest

from scrollwork.plans import jobs

SF = "/root/testdata/sf0.001"
SOME = [
    "repeated_lines", "section_ranges", "pack_units", "classify_segments", "dedupe_entities", "chunk_files", "bm25_topk", "budgeted_retrieval", "cosine_topk", "counter_steps", "inventory_fold",
    "state_as_of", "failure_streak", "thread_progress", "resolve_targets", "situation_intervals", "running_streak", "problem_turns", "entity_samples", "spot_check", "check_json", "upsert_fields", "stream_type_counts",
]


def test_every_statement_has_a_job():
    assert set(jobs.ORACLES) <= set(jobs.QUERIES)
    assert len(jobs.QUERIES) > 150


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", SOME)
def test_job(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    rel = con.sql(jobs.ORACLES[name])
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)
    df = jobs.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert cols == [rel.columns[i] for i in order]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want
