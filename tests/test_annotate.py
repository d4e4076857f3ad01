"""The annotator hook: failures, replays and changed rows."""
import os
import tempfile

import pytest

from scrollwork.operators import annotate
from scrollwork.session import scratch

SEEN = tempfile.mkdtemp(prefix="annotator-")


def counting(mode):
    """Says how long a text is; writes one file per call. ``once`` fails on its first call, ``always`` whenever a text holds 'bad'."""

    def fn(batch):
        first = not any(f.startswith(mode) for f in os.listdir(SEEN))
        tempfile.mkstemp(prefix=mode, dir=SEEN)
        if mode == "once" and first or mode == "always" and batch["text"].str.contains("bad", na=False).any():
            raise RuntimeError("no answer")
        known = batch[batch["text"].notna()]
        return known["text"].str.len().astype("int64").to_frame("size")

    return fn


def calls(mode):
    return sum(f.startswith(mode) for f in os.listdir(SEEN))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_failed_call_is_tried_again_and_answers_are_replayed(spark):
    path = scratch(spark, "verdicts")
    data = [(2**60 + 1, "abc"), (2, ""), (2, ""), (3, None), (3, "four"), (None, "seven77"), (2**60 + 2, "")]
    df = spark.createDataFrame(data, "id long, text string").coalesce(1)
    want = sorted([(2**60 + 1, 3, None), (2, 0, None), (3, None, None), (3, 4, None), (None, 7, None), (2**60 + 2, 0, None)], key=repr)
    assert rows(annotate.annotate(df, "id", counting("once"), "size long", path)) == want
    n = calls("once")
    assert n >= 2
    assert rows(annotate.annotate(df, "id", counting("once"), "size long", path)) == want and calls("once") == n
    more = spark.createDataFrame([(2, "changed"), (9, "x")], "id long, text string").coalesce(1)
    assert rows(annotate.annotate(more, "id", counting("once"), "size long", path)) == [(2, 7, None), (9, 1, None)] and calls("once") > n


def test_a_batch_that_keeps_failing_is_kept_with_its_error(spark, monkeypatch):
    path = scratch(spark, "verdicts")
    df = spark.createDataFrame([(1, "bad")], "id long, text string")
    got = rows(annotate.annotate(df, "id", counting("always"), "size long", path))
    assert got == [(1, None, "RuntimeError: no answer")]
    assert rows(annotate.annotate(df, "id", counting("fine"), "size long", path)) == [(1, 3, None)]
    assert rows(annotate.annotate(df.filter("id = 0"), "id", counting("fine"), "size long", path)) == []
    with pytest.raises(ValueError, match="text"):
        annotate.annotate(df, "id", counting("fine"), "text string", path)
