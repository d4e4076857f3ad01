"""Ids come back as they are, beside a null in the same batch and whatever their type."""
import numpy as np
from pyspark.sql import functions as F

from scrollwork.llm.decontaminate import contaminated
from scrollwork.llm.lm_score import lm_scores
from scrollwork.llm.quality import classify

BIG = 2**60 + 1
ITEM = "eleven plain words make up this short test item right here"


def rows(spark, kind="long"):
    values = [(BIG, ITEM), (None, "x " + ITEM), (3, "nothing of the kind")]
    return spark.createDataFrame(values, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).coalesce(1)


def test_long_ids_beside_a_null(spark):
    docs = rows(spark)
    assert {r.doc_id for r in classify(docs, np.zeros(64), 0.0).collect()} == {BIG, None, 3}
    assert {r.doc_id for r in lm_scores(docs, F.lit(True)).collect()} == {BIG, None, 3}
    items = spark.createDataFrame([(BIG + 2, ITEM), (None, ITEM)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()} == {(a, b) for a in (BIG, None) for b in (BIG + 2, None)}


def test_ids_of_text(spark):
    items = spark.createDataFrame([("suite/1", ITEM)], "item_id string, text string")
    found = contaminated(rows(spark, "string"), items)
    assert found.schema["item_id"].dataType.simpleString() == "string" and {(r.doc_id, r.item_id) for r in found.collect()} == {(str(BIG), "suite/1"), (None, "suite/1")}
    assert {r.doc_id for r in classify(rows(spark, "string"), np.zeros(64), 0.0).collect()} == {str(BIG), None, "3"}
