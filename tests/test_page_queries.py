"""Hosts that are no single term match nothing, as the SQL of the job states."""
import duckdb

from scrollwork.plans import jobs


def test_hosts_with_a_hyphen(spark, tmp_path):
    hosts = ["free-bets.example.net", "adult-x.example.com", "blog.example.org"]
    rows = ", ".join(f"({i}, 'http://{hosts[i // 20 % 3]}/en/{i}', '<h1>Free bets {i}</h1><p>adult x blog number {i % 7} with free bets</p><p>blog other {i}</p>')" for i in range(0, 1200, 20))
    con = duckdb.connect()
    con.execute(f"CREATE TABLE pages AS SELECT * FROM (VALUES {rows}) v(page_id, url, html)")
    con.execute(f"COPY (SELECT page_id::BIGINT AS page_id, url, html FROM pages) TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    rel = con.sql(jobs.ORACLES["bm25_five_columns"])
    want = sorted(rel.project("chunk_id, query_id, rank, score").fetchall())
    got = jobs.QUERIES["bm25_five_columns"](spark, str(tmp_path)).select("chunk_id", "query_id", "rank", "score").collect()
    assert want and sorted(map(tuple, got)) == want
