"""The worked cases of the event log."""
from pyspark.sql import functions as F

from scrollwork.functions import ordered
from scrollwork.operators import log


def span():
    return ordered.steps("turn_no")


def fold(spark, start, top, changes):
    init = spark.createDataFrame([("g", "heat", start, top)], "campaign_id string, counter string, value long, max long")
    ch = spark.createDataFrame([("g", "heat", i, d, v) for i, (d, v) in enumerate(changes)], "campaign_id string, counter string, turn_no long, delta long, set_value long")
    return log.counter_steps(init, ch, ["turn_no"], span())


def test_clamp(spark):
    assert [r.new_value for r in fold(spark, 2, 8, [(None, 100), (-5, None), (-9, None)]).orderBy("turn_no").collect()] == [8, 3, 0]


def test_crossings(spark):
    trig = spark.createDataFrame([("heat", 4), ("heat", 6)], "counter string, threshold long")
    hit = lambda d: sorted(r.threshold for r in log.crossings(fold(spark, 2, 8, [(d, None)]), trig).collect())
    assert hit(3) == [4]
    assert hit(5) == [4, 6]
    assert hit(-1) == []


def test_inventory_floor(spark):
    rows = [("a", 1, 10), ("a", 2, 5), ("b", 1, 5), ("b", 2, -5), ("c", 1, -3), ("c", 2, 4)]
    df = spark.createDataFrame(rows, "item_id string, turn_no long, delta long")
    assert {r.item_id: r.qty for r in log.fold_inventory(df, ["turn_no"], span(), ["item_id"]).collect()} == {"a": 15, "c": 4}


def test_relationships_clamp_first_only(spark):
    init = spark.createDataFrame([("g", "p", "x", "trust", 1)], "campaign_id string, a_id string, b_id string, rel_type string, intensity long")
    ch = spark.createDataFrame([("g", "p", "x", "trust", 2, 1), ("g", "p", "y", "trust", 15, 1), ("g", "p", "y", "trust", 4, 2)], "campaign_id string, a_id string, b_id string, rel_type string, delta long, turn_no long")
    assert {r.b_id: r.intensity for r in log.fold_relationships(init, ch, ["turn_no"]).collect()} == {"x": 3, "y": 14}


def test_diff_rows_in_application_order(spark):
    diff = '{"clocks":[{"id":"heat","delta":2}],"facts_add":[{"id":"f","subject_id":"s","predicate":"p","object":"o"}],"threads_update":[{"id":"t","status":"done"}]}'
    df = spark.createDataFrame([("g", 1, diff)], "campaign_id string, turn_no long, state_diff string")
    got = [(r.seq, r.kind) for r in log.explode_diffs(df).orderBy("seq").collect()]
    assert got == [(0, "counter"), (1, "fact_add"), (2, "thread")]


def test_update_before_insert_is_ignored(spark):
    rows = [("g", 1, 0, "fact_update", "f", "known"), ("g", 2, 0, "fact_add", "f", "world"), ("g", 3, 0, "fact_update", "f", None)]
    df = spark.createDataFrame(rows, "campaign_id string, turn_no long, seq int, kind string, id string, visibility string")
    for c in ("subject_id", "predicate", "object", "discovery_method"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    df = df.withColumn("tags", F.array().cast("array<string>"))
    (r,) = log.fold_facts(df).collect()
    assert r.visibility == "world" and r.discovered_turn is None
