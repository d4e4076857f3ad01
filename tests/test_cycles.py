"""Cycle members against plain reachability, and chains of growing length."""
import random

import pytest

from scrollwork.operators import cycles, mechanics

KIND = "doc_id string, a string, b string"


def brute(edges):
    nodes = {(d, n) for d, a, b in edges for n in (a, b)}
    reach = {n: set() for n in nodes}
    for d, a, b in edges:
        reach[d, a].add((d, b))
    changed = True
    while changed:
        changed = False
        for n in nodes:
            more = set().union(reach[n], *(reach[m] for m in reach[n]))
            changed |= more != reach[n]
            reach[n] = more
    return {(*n, min(m[1] for m in reach[n] if n in reach[m])) for n in nodes if n in reach[n]}


def rows(df):
    got = [tuple(r) for r in df.select("doc_id", "node", "component").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_graphs_of_many_shapes(spark):
    rng, edges = random.Random(5), []
    for doc in range(24):
        n = rng.choice([4, 9, 16])
        for _ in range(int(n * rng.choice([0.8, 1.1, 1.6, 2.5]))):
            edges.append((f"d{doc}", f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}"))
    # two cycles joined by a chain, a cycle that passes one node twice, cliques that share no way back
    edges += [("two", *e) for e in ("ab", "ba", "bp", "pq", "qc", "cd", "dc")]
    edges += [("eight", *e) for e in ("ab", "bc", "ca", "ad", "de", "ea", "aa")]
    edges += [("clique", x + str(k), y + str(k)) for k in (1, 2) for x in "abcd" for y in "abcd" if x != y] + [("clique", "a1", "b2"), ("clique", "c1", "d2")]
    got = rows(cycles.cycle_members(spark.createDataFrame(edges, KIND)))
    assert got == brute(edges)
    on = {(d, n): c for d, n, c in got}
    few = [e for e in edges if e[0] in ("two", "eight")]
    want = {(d, a, b) for d, a, b in few if (d, a) in on and on[d, a] == on.get((d, b))}
    assert {tuple(r) for r in mechanics.find_cycles(spark.createDataFrame(few, KIND)).collect()} == want


def test_nulls_repeats_empty_and_other_columns(spark):
    e = [("d", "a", "b", 1), ("d", "a", "b", 2), ("d", "b", "a", 3), (None, "a", "a", 4), ("d", None, "a", 5), ("x", "z", "z", 6)]
    df = spark.createDataFrame(e, KIND + ", node int")
    assert rows(cycles.cycle_members(df)) == {("d", "a", "a"), ("d", "b", "a"), ("x", "z", "z")}
    assert rows(cycles.cycle_members(df.filter("node < 0"))) == set()


@pytest.mark.parametrize("closed", [False, True])
def test_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch, closed):
    turns = []
    plain = cycles._ways
    monkeypatch.setattr(cycles, "_ways", lambda e: turns.append(1) or plain(e))
    n = 1000
    edges = [("d", f"{i:05d}", f"{i + 1:05d}") for i in range(n)] + ([("d", f"{n:05d}", "00000")] if closed else [])
    got = rows(cycles.cycle_members(spark.createDataFrame(edges, KIND)))
    assert got == ({("d", f"{i:05d}", "00000") for i in range(n + 1)} if closed else set())
    assert len(turns) < 34
