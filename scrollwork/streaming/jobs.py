"""Structured Streaming jobs over the event log: ingest, windows and sinks. Folds with state by key are in ``keyed``.

Windowed counts and de-duplication use Spark's own state with watermarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scrollwork.operators import log


def read_log(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def ingest(events: DataFrame, ts: str, event_id: str, required: list[str], late: str = "1 day") -> tuple[DataFrame, DataFrame]:
    """Complete events, once per id within the watermark; and the incomplete ones."""
    good, bad = log.append_events(events, required)
    return good.withWatermark(ts, late).dropDuplicatesWithinWatermark([event_id]), bad


# ---- windows and latest state ----


def session_windows(events: DataFrame, ts: str, gap: str, late: str = "1 day") -> DataFrame:
    """Sessions by inactivity gap, emitted once the watermark has passed them."""
    g = events.withWatermark(ts, late).groupBy("campaign_id", F.session_window(ts, gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("events")).select("campaign_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def type_counts(events: DataFrame, ts: str, width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Events by type in tumbling or sliding windows; only partial counts meet per window."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = events.withWatermark(ts, late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    return g.select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "event_type", "events")


def upsert_changes(rows: DataFrame, path: str, mode: str = "update"):
    """Write what each micro-batch has changed, and nothing else, to a folder of its own; a batch that is run again writes the same one."""

    def run(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/changes/batch={n:012d}")

    return rows.writeStream.outputMode(mode).foreachBatch(run).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def read_changes(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of every key."""
    every = spark.read.option("basePath", f"{path}/out/changes").parquet(f"{path}/out/changes")
    rest = [c for c in every.columns if c not in (*keys, "batch")]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("l")).select(*keys, "l.*")


def append_to(rows: DataFrame, path: str, partition: list[str] = []):
    """Append a stream to parquet."""
    w = rows.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out/rows").option("checkpointLocation", f"{path}/checkpoint")
    return (w.partitionBy(*partition) if partition else w).trigger(availableNow=True).start()
