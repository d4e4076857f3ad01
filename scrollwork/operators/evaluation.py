"""Evaluation summaries over recorded turns, feedback and replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scrollwork.functions import fixed, text as T


def _any(low: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def turn_metrics(turns: DataFrame) -> DataFrame:
    """Sizes and text features of every turn.

    Array columns ``proposed``, ``allowed``, ``blocked``, ``entities``, ``facts`` and ``outcomes``
    are counted where present; ``final_text`` is examined.
    """
    low = F.lower("final_text")
    sizes = {
        "actions_proposed": "proposed", "actions_allowed": "allowed", "actions_blocked": "blocked",
        "entities_in_context": "entities", "facts_in_context": "facts", "roll_count": "outcomes",
    }
    cols = {n: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)) for n, c in sizes.items() if c in turns.columns}
    return turns.withColumns(
        {
            **cols,
            "narrative_length": F.length("final_text"),
            "has_dialogue": F.col("final_text").rlike("[\"']"),
            "has_description": _any(low, fixed.DESCRIPTION_WORDS),
            "has_consequence": _any(low, fixed.CONSEQUENCE_WORDS),
        }
    )


def metrics_summary(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("turns"),
        F.bround(F.avg("total_ms"), 2).alias("avg_latency_ms"),
        F.bround(F.avg(F.col("clarification_needed").cast("int")), 2).alias("clarification_rate"),
        F.bround(F.avg("narrative_length"), 0).alias("avg_narrative_length"),
    )


def outcome_counts(metrics: DataFrame) -> DataFrame:
    rows = metrics.select("campaign_id", F.explode("outcomes").alias("outcome"))
    return rows.groupBy("campaign_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """Votes and their ratio; null where nobody voted. ``feedback_by_type`` has the lists as rows."""
    up, down = F.count(F.when(F.col("feedback_type") == "thumbs_up", 1)), F.count(F.when(F.col("feedback_type") == "thumbs_down", 1))
    g = feedback.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("total"), up.alias("positive"), down.alias("negative"))
    votes = F.col("positive") + F.col("negative")
    return g.withColumn("ratio", F.when(votes > 0, F.bround(F.try_divide(F.col("positive"), votes), 2)))


def feedback_by_type(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("campaign_id", "feedback_type").agg(F.count(F.lit(1)).alias("n"), F.max("turn_no").alias("last_turn"))


def problem_turns(feedback: DataFrame, metrics: DataFrame) -> DataFrame:
    """Turns flagged, voted down or in need of clarification, with the issues found.

    Flags are listed in order, then the vote, then the clarification, each of those once.
    """
    f = feedback.select("campaign_id", "turn_no", "feedback_type", "value")
    flags = f.filter("feedback_type = 'flag_issue'").select("campaign_id", "turn_no", F.lit(0).alias("o"), F.concat(F.lit("flagged: "), "value").alias("issue"))
    down = f.filter("feedback_type = 'thumbs_down'").select("campaign_id", "turn_no", F.lit(1).alias("o"), F.lit("thumbs_down").alias("issue")).distinct()
    ask = metrics.filter("clarification_needed").select("campaign_id", "turn_no", F.lit(2).alias("o"), F.lit("needed_clarification").alias("issue")).distinct()
    every = flags.unionByName(down).unionByName(ask)
    g = every.groupBy("campaign_id", "turn_no").agg(F.array_sort(F.collect_list(F.struct("o", "issue"))).alias("i"))
    return g.select("campaign_id", "turn_no", F.transform("i", lambda x: x["issue"]).alias("issues"))


def compare_runs(original: DataFrame, rerun: DataFrame, cut: int = 200) -> DataFrame:
    """Turns of two recorded runs side by side."""
    r = rerun.select("campaign_id", "turn_no", F.col("final_text").alias("__r"), "latency_ms")
    j = original.join(r, ["campaign_id", "turn_no"])
    return j.select(
        "campaign_id", "turn_no", T.cut(F.col("final_text"), cut).alias("original"), T.cut(F.col("__r"), cut).alias("replay"),
        (F.col("final_text") == F.col("__r")).alias("matches"), "latency_ms",
    )


def ab_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("campaign_id", "turn_no", F.col("final_text").alias("output_a"))
    return left.join(b.select("campaign_id", "turn_no", F.col("final_text").alias("output_b")), ["campaign_id", "turn_no"])
