"""Rule sheets: the work is shared out, texts are passed once, results stay as they were."""
from pyspark.sql import functions as F

from scrollwork.operators import mechanics
from scrollwork.plans import mechanics_jobs


def test_sheets_of_one_row_group_are_shared_out(spark, tmp_path):
    spark.range(100).select(
        F.col("id").alias("p_partkey"), F.lit("hot bolt").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("SMALL").alias("p_type"), F.lit(3).alias("p_size"),
    ).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    sheets = mechanics_jobs.sheets(spark, str(tmp_path))
    filled = sheets.select(F.spark_partition_id().alias("p")).distinct().count()
    assert filled > spark.sparkContext.defaultParallelism


def test_ascii_and_other_texts_give_the_same_items(spark):
    words = "Social Attributes: Charm, Wit\npointsman points pool\nroll 3d10\nlarge bolt clock: 3/50\nat 3: rises\nhonour rating 1-5x 7 to 9\nspend mana at a ritual"
    d = spark.createDataFrame([("a", 1, words), ("b", 1, words + " é")], "doc_id string, part_no long, text string")
    for extract in (mechanics.extract_stats, mechanics.extract_counters, mechanics.extract_resolution, mechanics.extract_magic):
        rows = {"a": set(), "b": set()}
        for r in extract(d).collect():
            rows[r.doc_id].add((r.field, r.name, r.value))
        assert rows["a"] == rows["b"] and rows["a"]


def test_tails_reach_over_short_pages_and_blocks(spark):
    n = mechanics.BLOCK + 300
    d = spark.createDataFrame([("d", i, None if i % 7 == 0 else "x" * (i % 5)) for i in range(n)], "doc_id string, part_no long, text string")
    text = lambda i: "" if i % 7 == 0 else "x" * (i % 5)
    found = {r.part_no: r.tail for r in mechanics.with_tails(d).collect()}
    for i in (0, 5, mechanics.BLOCK - 150, mechanics.BLOCK - 1, mechanics.BLOCK, n - 3, n - 2):
        assert found[i] == "".join(mechanics.PAGE_BREAK + text(j) for j in range(i + 1, n))[: mechanics.WINDOW]
    assert found[n - 1] is None and len(found) == n
