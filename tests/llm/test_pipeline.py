"""The pipeline stage by stage against brute force, over odd rows too."""
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scrollwork.llm.common import table
from scrollwork.llm.decontaminate import align
from scrollwork.llm.words import words
from tests.llm.test_near import near_brute

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def docs(spark, odd_rows):
    more = spark.createDataFrame([(None if i is None else i + 10**6, t, "en", "odd", len(t or "")) for i, t in odd_rows], "doc_id long, text string, lang string, source string, n_chars long")
    return table(spark, SF, "documents").unionByName(more)


def test_stages(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, SF)
    assert kept.schema == docs.schema or kept.columns == docs.columns
    have = Counter(rows_of(docs))
    gone = have - Counter(rows_of(kept))
    assert all(not any(c.isalpha() for c in t or "") or (i or 10**6) >= 10**6 for i, t in gone)

    kept = kept.persist()
    lines = stages["line_dedup"](spark, kept, SF).persist()
    assert lines.columns == docs.columns and lines.count() == kept.count()
    docs_of = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, t in rows_of(kept):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20 and i is not None:
                docs_of[key(x)].add(i)
    want = Counter((i, "\n".join(x for x in (t or "").split("\n") if len(docs_of[key(x)]) < 3 or i == max(docs_of[key(x)]))) for i, t in rows_of(kept))
    assert Counter(rows_of(lines)) == want
    assert lines.where("n_chars <> length(text)").count() == 0

    near = stages["near_dedup"](spark, lines, SF).persist()
    classes = near_brute(rows_of(lines))
    nulls = Counter(t for i, t in rows_of(lines) if i is None)
    assert sorted(i for i, _ in rows_of(near) if i is not None) == sorted(set(classes.values()))
    assert Counter(t for i, t in rows_of(near) if i is None) == nulls

    clean = stages["decontamination"](spark, near, SF).persist()
    items = [words([r.text.lower().encode()])[0] for r in table(spark, SF, "benchmark").collect()]
    bad = set()
    for i, t in rows_of(near):
        h = words([(t or "").lower().encode()])[0]
        if len(h):
            best, _ = align(items, [h] * len(items))
            if (best >= 0.5 * 2 * np.array([len(x) for x in items])).any():
                bad.add((i, t))
    assert bad and Counter(rows_of(clean)) == Counter(r for r in rows_of(near) if r not in bad)
    assert clean.columns == docs.columns

    out = stages["packing"](spark, clean, SF)
    assert out.where("piece = 0").count() == clean.count()
    used = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert used.where("n > 2048 OR n <> end").count() == 0


def test_near_duplicates_keep_other_texts_of_an_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(3, a), (5, a + " more"), (5, b), (5, b), (7, b + " more"), (8, c), (8, "short"), (2, c), (6, None), (6, "x y"), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(rows_of(corpus_pipeline.drop_near_duplicates(spark, docs, SF)))
    assert got == Counter([(3, a), (5, b), (8, "short"), (2, c), (6, None), (6, "x y"), (None, a)])


def test_clashing_columns(spark, docs):
    names = ["found", "stays", "k", "K_", "key", "nth", "group_id", "__key", "__nth", "first", "h", "row", "a b"]
    more = docs.withColumns({c: F.lit(i) for i, c in enumerate(names)})
    for _, stage in corpus_pipeline.STAGES[:4]:
        got, want = stage(spark, more, SF), stage(spark, docs, SF)
        assert got.columns == more.columns
        assert Counter(rows_of(got)) == Counter(rows_of(want))
        assert got.where(" OR ".join(f"`{c}` <> {i}" for i, c in enumerate(names))).count() == 0


def test_empty(spark, docs):
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).where("piece = 0").count() > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
