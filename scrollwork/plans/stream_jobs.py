"""The log as a stream; every job's result equals a batch statement.

Folds with state get the log in several deliveries. For each one the query is started again and goes on from its checkpoint, so
there are at least as many micro-batches.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scrollwork.operators import log
from scrollwork.plans.log_jobs import ORDER, TRIGGERS_SQL, WALK, counters, k, triggers
from scrollwork.plans.registry import job, table
from scrollwork.session import scratch
from scrollwork.streaming import jobs as S, keyed


def stream(spark, sf):
    """The events file as a file stream (the glob makes the source watch for that name)."""
    schema = table(spark, sf, "events").schema
    return S.read_log(spark, f"{sf}/event[s].parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def finish(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


DELIVERIES = 3


def delivery(spark, sf, n):
    """Equal stretches of the log's time."""
    lo, hi = table(spark, sf, "events").select(F.min("ts").cast("timestamp").alias("lo"), F.max("ts").cast("timestamp").alias("hi")).select(F.unix_micros("lo"), F.unix_micros("hi")).first()
    return F.expr(f"(unix_micros(cast(ts as timestamp)) - {lo or 0}) * {n} div {(hi or 0) - (lo or 0) + 1}")


def in_deliveries(spark, sf, name, start, arrival=None, n=DELIVERIES):
    """Write one delivery after the other and run ``start(stream, path)`` on what has come; returns the path."""
    events, folder, path = table(spark, sf, "events"), scratch(spark, f"{name}-in"), scratch(spark, name)
    when = delivery(spark, sf, n) if arrival is None else arrival
    for i in range(n):
        events.where(when == i).write.mode("append").parquet(folder)
        finish(start(S.read_log(spark, folder, events.schema).withColumn("ts", F.col("ts").cast("timestamp")), path))
    return path


def keyed_append(rows, path):
    spark = rows.sparkSession
    return keyed.append_to(rows, path, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def as_log(e):
    sign = F.when(F.col("event_type").isin("error", "view"), -1).otherwise(1)
    delta = (F.floor(F.col("value") / 50) * sign).cast("bigint")
    return e.select(
        F.col("user_id").alias("campaign_id"), "ts", "event_id", "event_type", F.concat(F.lit("c"), F.floor(k() / 25)).alias("counter"),
        F.when(F.col("event_type") != "signup", delta).alias("delta"), F.when(F.col("event_type") == "signup", F.floor(k() / 10)).alias("set_value"),
    )


@job("SELECT event_id, user_id, event_type FROM events WHERE props IS NOT NULL")
def stream_ingest(spark, sf):
    twice = stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    good, bad = S.ingest(twice, "ts", "event_id", ["event_id", "ts", "user_id", "props"])
    path = scratch(spark, "ingest")
    finish(S.append_to(good.select("event_id", "user_id", "event_type", "ts"), path))
    return spark.read.parquet(f"{path}/out/rows").drop("ts")


@job("SELECT event_id, user_id, count(*) AS copies FROM events, range(2) WHERE event_type = 'error' GROUP BY ALL")
def stream_rejected(spark, sf):
    """The incomplete events of a stream, every copy, in a sink of their own."""
    twice = stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("props", F.when(F.col("event_type") != "error", F.col("props")))
    good, bad = S.ingest(twice, "ts", "event_id", ["event_id", "ts", "user_id", "props"])
    path = scratch(spark, "rejected")
    finish(S.append_to(bad.select("event_id", "user_id"), path))
    return spark.read.parquet(f"{path}/out/rows").groupBy("event_id", "user_id").agg(F.count(F.lit(1)).alias("copies"))


@job(f"WITH RECURSIVE {WALK} SELECT campaign_id, counter, event_id, threshold FROM st JOIN {TRIGGERS_SQL} USING (counter) WHERE old_value < threshold AND threshold <= new_value")
def stream_counters(spark, sf):
    path = in_deliveries(spark, sf, "counters", lambda e, p: keyed_append(keyed.counters(as_log(e), counters(spark, sf), ORDER), p))
    return log.crossings(spark.read.parquet(f"{path}/out/rows"), triggers(spark, sf)).select("campaign_id", "counter", "event_id", "threshold")


@job("""WITH g AS (SELECT user_id, event_id, ts, event_type, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
s AS (SELECT user_id, event_id, event_type, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, b ORDER BY ts, event_id) AS streak FROM g)
SELECT user_id AS campaign_id, event_id, streak, CASE WHEN streak >= 3 THEN 'threat_resolved' WHEN streak = 2 THEN 'warning' END AS alert FROM s WHERE event_type = 'error'""")
def stream_streaks(spark, sf):
    out = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "purchase", "success")
    rows = lambda e: e.select(F.col("user_id").alias("campaign_id"), "ts", "event_id", out.alias("outcome"))
    path = in_deliveries(spark, sf, "streaks", lambda e, p: keyed_append(keyed.streaks(rows(e), ORDER), p))
    return spark.read.parquet(f"{path}/out/rows").select("campaign_id", "event_id", "streak", "alert")


def exposures(e):
    """An error fails to sneak, a purchase hides."""
    err = F.col("event_type") == "error"
    return e.filter(F.col("event_type").isin("error", "purchase")).select(
        F.col("user_id").alias("campaign_id"), F.when(err, "sneak").otherwise("hide").alias("action"), F.when(err, "failure").otherwise("success").alias("outcome"),
        F.when(F.col("value") > 100, 2).otherwise(0).alias("tier"), "ts", "event_id",
    )


SIT = """WITH RECURSIVE ev AS (SELECT user_id AS c, epoch_us(ts) AS us, event_id AS o, event_type = 'purchase' AS e, event_type = 'error' AND value > 100 AS sharp,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('error', 'purchase')),
walk AS (SELECT DISTINCT c, 0::BIGINT AS n, NULL::BIGINT AS opened, NULL::BIGINT AS began, FALSE AS hard, NULL::BIGINT AS d_opened, NULL::BIGINT AS d_closed, FALSE AS d_hard, NULL::VARCHAR AS reason FROM ev
  UNION ALL SELECT c, n + 1, CASE WHEN e THEN NULL WHEN fresh THEN o ELSE opened END, CASE WHEN fresh THEN us ELSE began END, CASE WHEN fresh THEN sharp ELSE hard OR sharp END,
    CASE WHEN t OR e THEN opened END, CASE WHEN e AND NOT t THEN o END, hard, CASE WHEN t THEN 'timeout' WHEN e AND opened IS NOT NULL THEN 'cleared' END
  FROM (SELECT *, opened IS NULL OR t AS fresh FROM (SELECT w.*, v.us, v.o, v.e, v.sharp, opened IS NOT NULL AND v.us - began >= {timeout} AS t FROM walk w JOIN ev v ON v.c = w.c AND v.n = w.n + 1))),
done AS (SELECT c AS campaign_id, 'exposed' AS condition, d_opened AS opened, d_closed AS closed, d_hard AS hard, reason FROM walk WHERE reason IS NOT NULL)"""


@job(SIT.format(timeout=1 << 60) + " SELECT campaign_id, condition, opened, closed, hard FROM done")
def stream_situations(spark, sf):
    path = in_deliveries(spark, sf, "situations", lambda e, p: keyed_append(keyed.situations(exposures(e), "ts", "event_id"), p))
    return spark.read.parquet(f"{path}/out/rows").filter("condition = 'exposed'").select("campaign_id", "condition", "opened", "closed", "hard")


@job(SIT.format(timeout=2 * 86_400_000_000) + """ SELECT * FROM done UNION ALL SELECT c, 'exposed', opened, NULL, hard, 'timeout' FROM walk w WHERE opened IS NOT NULL
AND n = (SELECT max(n) FROM ev WHERE ev.c = w.c) AND began + 2 * 86400000000 < 1000 * (SELECT max(us) // 1000 - 86400000 FROM ev)""")
def stream_situation_timeouts(spark, sf):
    """An exposure ends after two days by itself: told by the next row of its key, or by a timer when the watermark has passed it."""
    path = in_deliveries(spark, sf, "timeouts", lambda e, p: keyed_append(keyed.situations(exposures(e), "ts", "event_id", "1 day", 2 * 86_400), p))
    return spark.read.parquet(f"{path}/out/rows").filter("condition = 'exposed'")


@job("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS o FROM events),
s AS (SELECT user_id, ts, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM o),
w AS (SELECT user_id, n, count(*) AS events, max(ts) + INTERVAL 12 HOUR AS ended FROM s GROUP BY ALL)
SELECT user_id AS campaign_id, events, count(*) AS sessions FROM w WHERE ended <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL""")
def stream_sessions(spark, sf):
    e = stream(spark, sf).select(F.col("user_id").alias("campaign_id"), "ts")
    path = scratch(spark, "sessions")
    finish(S.append_to(S.session_windows(e, "ts", "12 hours"), path))
    return spark.read.parquet(f"{path}/out/rows").groupBy("campaign_id", "events").agg(F.count(F.lit(1)).alias("sessions"))


@job("SELECT date_diff('day', TIMESTAMP '1970-01-01', ts)::BIGINT AS day, event_type, count(*) AS events FROM events GROUP BY ALL")
def stream_type_counts(spark, sf):
    path = in_deliveries(spark, sf, "counts", lambda e, p: S.upsert_changes(S.type_counts(e, "ts", "1 day"), p))
    return S.read_changes(spark, path, ["started", "ended", "event_type"]).select(F.unix_date(F.col("started").cast("date")).cast("bigint").alias("day"), "event_type", "events")


@job("""WITH w AS (SELECT time_bucket(INTERVAL 12 HOUR, ts) AS b, event_type FROM events)
SELECT (epoch(s) // 3600)::BIGINT AS start_hour, event_type, count(*) AS events FROM (SELECT unnest([b, b - INTERVAL 12 HOUR]) AS s, event_type FROM w) GROUP BY ALL""")
def stream_sliding_counts(spark, sf):
    path = in_deliveries(spark, sf, "sliding", lambda e, p: S.upsert_changes(S.type_counts(e, "ts", "1 day", "12 hours"), p))
    return S.read_changes(spark, path, ["started", "ended", "event_type"]).select(F.floor(F.unix_seconds("started") / 3600).alias("start_hour"), "event_type", "events")


@job("SELECT user_id AS campaign_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def stream_latest_state(spark, sf):
    rows = lambda e: e.select(F.col("user_id").alias("campaign_id"), "event_type", "ts", "event_id", "value")
    path = in_deliveries(spark, sf, "latest", lambda e, p: keyed_append(keyed.latest(rows(e), ["campaign_id", "event_type"], ORDER), p))
    return keyed.newest(spark.read.parquet(f"{path}/out/rows"), ["campaign_id", "event_type"], ORDER).drop("ts")


# ---- rows that come late: some a delivery late, some two ----

LATE_SQL = """WITH sp AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events),
a AS (SELECT event_id, user_id, epoch_us(ts) AS us, least(3, (epoch_us(ts) - lo) * 4 // (hi - lo + 1) + (event_id % 7 = 0)::INTEGER + (event_id % 21 = 0)::INTEGER) AS arrival FROM events, sp),
m AS (SELECT p, 1000 * ((SELECT max(us) // 1000 FROM a WHERE arrival < p) - 3 * 86400000) AS mark FROM range(5) t(p)),
j AS (SELECT a.*, coalesce(us < mark, FALSE) AS late FROM a JOIN m ON p = arrival),
r AS (SELECT j.*, coalesce(us < (SELECT max(b.us) FROM j b WHERE b.user_id = j.user_id AND b.arrival < j.arrival AND NOT b.late), FALSE) AS behind FROM j)"""


@job(f"""{LATE_SQL} SELECT user_id AS campaign_id, event_id, 'rejected' AS part, NULL::BIGINT AS place, FALSE AS reordered FROM r WHERE late
UNION ALL SELECT user_id, event_id, 'released', row_number() OVER (PARTITION BY user_id ORDER BY us, event_id), behind FROM r WHERE NOT late AND us < (SELECT mark FROM m WHERE p = 4)""")
def stream_late_rows(spark, sf):
    """What a campaign's log gives out in order, what came too late, and by omission what still waits."""
    lag = F.expr("if(event_id % 7 = 0, 1, 0) + if(event_id % 21 = 0, 1, 0)")
    arrival = F.least(F.lit(3), delivery(spark, sf, 4) + lag)
    rows = lambda e: e.select(F.col("user_id").alias("campaign_id"), "event_id", "ts")
    path = in_deliveries(spark, sf, "late", lambda e, p: keyed_append(keyed.release(rows(e), "ts", "3 days", ["event_id"]), p), arrival, 4)
    return spark.read.parquet(f"{path}/out/rows").select("campaign_id", "event_id", "part", "place", "reordered")
