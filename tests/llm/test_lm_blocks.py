"""Blocks of the language model: weights first, texts behind them in batches, failure arcs followed by a join."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from scrollwork.llm import lm_score
from tests.llm.conftest import frame


def test_texts_of_a_block_are_not_gathered(odd, odd_rows, monkeypatch):
    learn = F.coalesce(F.col("doc_id") % 3 != 1, F.lit(False))
    results = []
    for size in (lm_score.BLOCK_BYTES, 1):
        monkeypatch.setattr(lm_score, "BLOCK_BYTES", size)
        out = lm_score.lm_scores(odd, learn)
        assert "CoGroup" not in out._jdf.queryExecution().toString()
        results.append(sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score, 4)) for r in out.collect()))
    assert results[0] == results[1] and len(results[0]) == len(odd_rows)


@pytest.mark.parametrize("texts", [["the cat sat", "the cat", "a mat", ""], []])
def test_failed_transitions_cost_as_much_as_the_walk(spark, texts):
    docs = lm_score.with_blocks(frame(spark, list(enumerate(texts))), F.lit(True), "doc_id", "text")
    model = lm_score.build(lm_score.block_keys(docs, (6,)).groupBy("key").agg(F.sum("n").alias("n")))
    known = model.toPandas()
    machine = lm_score.Automaton(*(known[c].to_numpy() for c in ("kind", "key", "logp", "bow")))
    asked = [b"\n\n\n\n\nt", b"the ma", b"xyz ca", b"zzzzzz", b"e cat\n", b"qthe \xff"]
    arcs = {k for k, n in zip(known["key"], known["kind"]) if n == 6}
    keys = [k for k in (int.from_bytes(a, "big") for a in asked) if k not in arcs]
    got = {r.key: r.logp for r in lm_score.failed(model, spark.createDataFrame([(k,) for k in keys], "key long")).collect()}
    codes = np.array(keys, np.uint64)
    _, want = machine.step(machine.state(codes >> np.uint64(8), np.full(len(codes), 5)), codes & np.uint64(255))
    assert len(got) == len(keys) >= 4
    assert [got[k] for k in keys] == pytest.approx(want.tolist())
