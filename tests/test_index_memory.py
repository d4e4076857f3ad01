"""Bounded working sets of the tasks that index."""
import pyarrow as pa

from scrollwork.operators import text_index


def test_a_batch_is_indexed_in_runs_of_rows(monkeypatch):
    monkeypatch.setattr(text_index, "PIECE", 5)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([["a"] * 2, ["b"] * 4, [], ["c"] * 20, ["d"], []])], ["k", "t"])
    for given in (batch, batch.slice(1, 4), batch.slice(0, 0)):
        parts = text_index.pieces(given, 1)
        assert [x for p in parts for x in p.column(0).to_pylist()] == given.column(0).to_pylist()
        assert [x for p in parts for x in p.column(1).to_pylist()] == given.column(1).to_pylist()
    assert len(text_index.pieces(batch, 1)) == 3
