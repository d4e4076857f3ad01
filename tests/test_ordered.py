"""Span-wise ordered functions against plain Python, with one key holding most rows."""
import random

import pytest
from pyspark.sql import functions as F

from scrollwork.functions import ordered


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [("hot" if rng.random() < 0.8 else rng.choice("abc"), n, rng.randint(-4, 4), rng.choice([None, n])) for n in rng.sample(range(5000), 600)]


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def test_rank_sum_next_and_last(spark, rows):
    df = spark.createDataFrame(rows, "k string, n long, d long, v long").repartition(7)
    sp = ordered.steps("n", 300)
    d = ordered.add_row_number(df, ["k"], ["n"], sp)
    d = ordered.add_running_sum(d, ["k"], ["n"], sp, {"total": F.col("d")})
    d = ordered.add_next(d, ["k"], ["n"], sp, "n", "after")
    d = ordered.add_last_seen(d, ["k"], ["n"], sp, F.col("v"), "seen")
    d = ordered.add_last_seen(d, ["k"], ["n"], sp, F.col("v"), "before", strict=True)
    got = {(r.k, r.n): (r.rn, r.total, r.after, r.seen, r.before) for r in d.collect()}
    want = {}
    for k, rs in by_key(rows).items():
        total, seen = 0, None
        for i, r in enumerate(rs):
            before = seen
            total += r[2]
            seen = r[3] if r[3] is not None else seen
            want[k, r[1]] = (i + 1, total, rs[i + 1][1] if i + 1 < len(rs) else None, seen, before)
    assert got == want


@pytest.mark.parametrize("block", [3, 512])
def test_clamped_fold_and_scan(spark, rows, monkeypatch, block):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", block)
    df = spark.createDataFrame([(k, n, d if v is None else None, v and v % 12) for k, n, d, v in rows], "k string, n long, d long, v long")
    df = df.withColumn("law", ordered.step_law(F.col("d"), F.col("v"), F.lit(0), F.lit(9)))
    steps = {(r.k, r.n): (r.old_value, r.new_value) for r in ordered.scan_laws(df, ["k"], ["n"], ordered.steps("n", 400), F.lit(5), []).collect()}
    laws = ordered.fold_laws(df, ["k"], ["n"], ordered.steps("n", 400))
    ends = {r.k: r.v for r in laws.select("k", ordered.apply_law(F.lit(5), F.col("law")).alias("v")).collect()}
    for k, rs in by_key(rows).items():
        x = 5
        for _, n, d, v in rs:
            old = x
            if v is None:
                x = max(0, min(9, x + d)) if d else x
            else:
                x = max(0, min(9, v % 12))
            assert steps[k, n] == (old, x)
        assert ends[k] == x
