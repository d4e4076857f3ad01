"""Clue facts of threads."""
from scrollwork.operators import views


def test_facts_that_share_an_id_count_each_and_a_fact_reached_twice_once(spark):
    threads = spark.createDataFrame([(1, "7", "t", "active", ["scene", "o7", "o7"])], "campaign_id int, thread_id string, title string, status string, related_ids array<string>")
    facts = spark.createDataFrame([
        (1, "7:1", "o7", ["clue"], "known", 3), (1, "7:1", "o7", ["clue"], "known", 3),  # one id, two rows
        (1, "7:2", "scene", ["clue", "7", "7"], "world", 4),  # by its tag and by the related id
        (1, "7:3", "scene", ["clue", None], "world", 5),  # by the related id only
    ], "campaign_id int, id string, subject_id string, tags array<string>, visibility string, discovered_turn int")
    row = views.thread_progress(threads, facts).first()
    assert (row.clues_found, row.clues_total, row.last_clue_turn) == (2, 4, 3)
