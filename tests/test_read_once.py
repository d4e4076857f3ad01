"""Texts are classified once, however often the result is read."""
import pytest

from __spark_entry__ import queries


@pytest.mark.parametrize("name", ["review_queue", "attach_refs"])
def test_no_text_in_what_is_left(spark, name):
    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "content#" not in plan
