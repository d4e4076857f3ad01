"""Table scans, upserts and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A table's added columns over time: older files simply lack them.
STATE_TABLES = {
    "campaigns": "campaign_id string, name string, created_at timestamp, updated_at timestamp, calibration string, system string, genre_rules string, current_turn bigint, pack_ids array<string>, lore_manifest map<string,array<string>>",
    "entities": "campaign_id string, entity_id string, type string, name string, attrs string, tags array<string>, origin string, pack_id string, pack_entity_id string",
    "facts": "campaign_id string, id string, subject_id string, predicate string, object string, visibility string, confidence double, tags array<string>, discovered_turn bigint, discovery_method string",
    "scene": "campaign_id string, location_id string, present_entity_ids array<string>, time map<string,string>, constraints map<string,string>, visibility_conditions string, noise_level string, obscured_entities array<string>",
    "threads": "campaign_id string, id string, title string, status string, stakes map<string,string>, related_entity_ids array<string>, tags array<string>",
    "clocks": "campaign_id string, counter string, name string, value bigint, max bigint, triggers map<string,string>, tags array<string>",
    "inventory": "campaign_id string, owner_id string, item_id string, qty bigint, flags map<string,string>",
    "relationships": "campaign_id string, a_id string, b_id string, rel_type string, intensity bigint, notes map<string,string>",
    "events": "id string, campaign_id string, turn_no bigint, player_input string, context_packet string, pass_outputs string, engine_events string, state_diff string, final_text string, prompt_versions string",
    "summaries": "id string, campaign_id string, turn_range_start bigint, turn_range_end bigint, text string",
    "sessions": "id string, campaign_id string, started_at timestamp, ended_at timestamp, turn_range_start bigint, turn_range_end bigint, recap_text string",
    "content_packs": "pack_id string, name string, version string, description string, layer string, author string, path string, chunk_count bigint, installed_at timestamp, metadata map<string,string>",
    "pack_chunks": "pack_id string, chunk_id string, file_path string, section_title string, content string, chunk_type string, entity_refs array<string>, tags array<string>, metadata map<string,string>, token_estimate int",
    "scene_lore": "id string, campaign_id string, scene_id string, session_id string, lore string, chunk_ids array<string>, created_at timestamp",
    "eval_metrics": "id string, campaign_id string, turn_no bigint, metrics string, created_at timestamp",
    "eval_feedback": "id string, campaign_id string, turn_no bigint, feedback_type string, value string, created_at timestamp",
    "eval_self": "id string, campaign_id string, turn_no bigint, scores string, created_at timestamp",
    "eval_ab_tests": "id string, campaign_id string, turn_no bigint, variant_a string, variant_b string, winner string, created_at timestamp",
}


def read_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """State tables from parquet under their declared schemas; columns a file lacks are null."""
    return {n: spark.read.schema(STATE_TABLES[n]).parquet(f"{folder}/{n}") for n in names or STATE_TABLES}


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], merge: str, order: list[str], value: str | None = None) -> DataFrame:
    """Apply keyed changes to a table.

    ``replace`` keeps the latest whole row, ``add`` sums ``value`` (other columns from the
    latest row), ``fields`` takes the latest non-null value of every column. All three are
    partial aggregations over both sides; nothing is sorted per key.
    """
    cols = [c for c in base.columns if c not in keys]
    seq = F.struct(F.lit(1).alias("side"), *[F.col(c) for c in order])
    first = F.struct(F.lit(0).alias("side"), *[F.lit(None).cast(dict(changes.dtypes)[c]).alias(c) for c in order])
    every = base.withColumn("__at", first).unionByName(changes.select(*[c for c in changes.columns if c in base.columns], seq.alias("__at")), allowMissingColumns=True)
    g = every.groupBy(*keys)
    if merge == "fields":
        out = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__at"))).alias(c) for c in cols]
    elif merge == "add":
        out = [F.sum(c).alias(c) if c == value else F.max_by(c, "__at").alias(c) for c in cols]
    elif merge == "replace":
        out = [F.max_by(c, "__at").alias(c) for c in cols]
    else:
        raise ValueError(merge)
    return g.agg(*out).select(*base.columns)


def stage_metrics(df: DataFrame, name: str, keys: list[str], **sums: Column) -> DataFrame:
    """Counts of a stage as one JSON document per key."""
    aggs = [F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in sums.items()]]
    g = df.groupBy(*keys).agg(*aggs)
    return g.select(*keys, F.lit(name).alias("stage"), F.to_json(F.struct("rows", *sums)).alias("metrics"))


def write_corpus(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Corpus files by type; a type's rows are spread over as many tasks as they fill."""
    df.write.mode(mode).partitionBy("file_type").parquet(path)


def write_postings(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings by corpus and term bucket. Re-indexing overwrites the partitions it writes, no others."""
    b = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    b.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pack_id", "bucket").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


EVAL_KINDS = ["metrics", "feedback", "self", "ab_tests"]
FEEDBACK_TYPES = ["thumbs_up", "thumbs_down", "flag_issue", "comment", "rating"]


def append_eval(df: DataFrame, folder: str, kind: str) -> None:
    """Append evaluation records of one kind, by campaign; feedback of an unknown type goes to ``eval_rejected``."""
    if kind not in EVAL_KINDS:
        raise ValueError(kind)
    if kind == "feedback":
        known = F.coalesce(F.col("feedback_type").isin(FEEDBACK_TYPES), F.lit(False))
        df.filter(~known).write.mode("append").partitionBy("campaign_id").parquet(f"{folder}/eval_rejected")
        df = df.filter(known)
    df.write.mode("append").partitionBy("campaign_id").parquet(f"{folder}/eval_{kind}")
