"""Event-log jobs: folds, crossings, time, sessions, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrollwork.functions import fixed, ordered, text as T
from scrollwork.operators import log, views
from scrollwork.plans import bind
from scrollwork.plans.bind import sql_list
from scrollwork.plans.registry import job, table

SPAN = bind.log_span
ORDER = ["ts", "event_id"]

# Counter of an event: its property k in four bands; a sign-up sets the counter, the rest move it.
CHANGES_SQL = f"""(SELECT campaign_id, ts, event_id, event_type, 'c' || (regexp_extract(props, '([0-9]+)', 1)::INTEGER // 25) AS counter,
    CASE WHEN event_type <> 'signup' THEN delta END AS delta,
    CASE WHEN event_type = 'signup' THEN (regexp_extract(props, '([0-9]+)', 1)::BIGINT // 10) END AS set_value FROM {bind.LOG_SQL})"""


def k():
    return F.get_json_object("props", "$.k").cast("int")


def changes(spark, sf):
    e = bind.log(spark, sf)
    return e.select(
        "campaign_id", "ts", "event_id", "event_type", F.concat(F.lit("c"), F.floor(k() / 25)).alias("counter"),
        F.when(F.col("event_type") != "signup", F.col("delta")).alias("delta"),
        F.when(F.col("event_type") == "signup", F.floor(k() / 10)).alias("set_value"),
        F.when(F.col("event_type") == "view", "cost").otherwise("action").alias("source"),
    )


def counters(spark, sf):
    """Every user has four counters; start and maximum follow from the user id."""
    u = table(spark, sf, "events").select(F.col("user_id").alias("campaign_id")).distinct()
    u = u.select("campaign_id", F.explode(F.array(*[F.lit(f"c{i}") for i in range(4)])).alias("counter"))
    return u.select("campaign_id", "counter", (F.col("campaign_id") % 5).cast("bigint").alias("value"), (F.col("campaign_id") % 7 + 6).cast("bigint").alias("max"))


WALK = f"""init AS (SELECT DISTINCT user_id AS campaign_id, 'c' || i AS counter, user_id % 5 AS value, user_id % 7 + 6 AS mx FROM events, range(4) t(i)),
num AS (SELECT *, row_number() OVER (PARTITION BY campaign_id, counter ORDER BY ts, event_id) AS i FROM {CHANGES_SQL}),
walk AS (SELECT campaign_id, counter, 0::BIGINT AS i, value AS old, value AS v, mx FROM init
  UNION ALL SELECT w.campaign_id, w.counter, w.i + 1, w.v, CASE WHEN coalesce(delta, 0) <> 0 THEN greatest(0, least(mx, w.v + delta))
      WHEN set_value IS NOT NULL THEN greatest(0, least(mx, set_value)) ELSE w.v END, mx
  FROM walk w JOIN num n ON n.campaign_id = w.campaign_id AND n.counter = w.counter AND n.i = w.i + 1),
st AS (SELECT campaign_id, counter, ts, event_id, event_type, old AS old_value, v AS new_value FROM walk JOIN num USING (campaign_id, counter, i))"""


@job(f"WITH RECURSIVE {WALK} SELECT campaign_id, counter, arg_max(v, i)::BIGINT AS value, max(mx)::BIGINT AS max FROM walk GROUP BY campaign_id, counter")
def counter_fold(spark, sf):
    return log.fold_counters(counters(spark, sf), changes(spark, sf), ORDER, SPAN())


@job(f"WITH RECURSIVE {WALK} SELECT campaign_id, counter, event_id, old_value, new_value FROM st")
def counter_steps(spark, sf):
    return log.counter_steps(counters(spark, sf), changes(spark, sf), ORDER, SPAN()).drop("ts")


TRIGGERS_SQL = "(SELECT 'c' || i AS counter, t AS threshold FROM range(4) a(i), (VALUES (2), (4), (6)) b(t))"


def triggers(spark, sf):
    t = spark.range(4).select(F.concat(F.lit("c"), "id").alias("counter"))
    return t.select("counter", F.explode(F.array(*[F.lit(x) for x in (2, 4, 6)])).alias("threshold"))


@job(f"WITH RECURSIVE {WALK} SELECT campaign_id, counter, event_id, threshold FROM st JOIN {TRIGGERS_SQL} USING (counter) WHERE old_value < threshold AND threshold <= new_value")
def threshold_crossings(spark, sf):
    s = log.counter_steps(counters(spark, sf), changes(spark, sf), ORDER, SPAN())
    return log.crossings(s, triggers(spark, sf)).select("campaign_id", "counter", "event_id", "threshold")


@job(f"""WITH RECURSIVE {WALK} SELECT campaign_id, counter, event_id, threshold FROM st JOIN {TRIGGERS_SQL} USING (counter)
WHERE (old_value < threshold AND threshold <= new_value) OR (new_value < threshold AND threshold <= old_value)""")
def crossings_both_ways(spark, sf):
    s = log.counter_steps(counters(spark, sf), changes(spark, sf), ORDER, SPAN())
    return log.crossings(s, triggers(spark, sf), "both").select("campaign_id", "counter", "event_id", "threshold")


@job(f"""WITH RECURSIVE {WALK}, d AS (SELECT campaign_id, counter, date_diff('day', TIMESTAMP '1970-01-01', ts)::BIGINT AS turn_no,
arg_min(old_value, (ts, event_id)) AS old, arg_max(new_value, (ts, event_id)) AS new, bool_or(event_type <> 'view') AS consequence FROM st GROUP BY ALL)
SELECT campaign_id, counter, turn_no, old, new, consequence FROM d WHERE old <> new""")
def counter_deltas(spark, sf):
    c = changes(spark, sf)
    s = log.counter_steps(counters(spark, sf), c, ORDER, SPAN(), carry=["source"])
    s = s.withColumn("turn_no", F.unix_date(F.col("ts").cast("date")).cast("bigint")).withColumn("ord", F.struct("ts", "event_id"))
    return log.counter_deltas(s)


@job("""WITH r AS (SELECT o_orderkey, o_custkey % 25 AS campaign_id, CASE WHEN o_orderkey % 3 = 0 THEN 'n' || (o_custkey % 25)
    WHEN o_orderkey % 3 = 1 THEN lower(n_name) ELSE 'nobody' END AS ref FROM orders JOIN nation ON n_nationkey = o_custkey % 25)
SELECT o_orderkey, ref, coalesce((SELECT 'n' || n_nationkey FROM nation WHERE 'n' || n_nationkey = ref AND n_nationkey = campaign_id),
    (SELECT min('n' || n_nationkey) FROM nation WHERE lower(n_name) = lower(ref) AND n_nationkey = campaign_id)) AS counter FROM r""")
def resolve_counter(spark, sf):
    n = table(spark, sf, "nation")
    c = n.select(F.col("n_nationkey").cast("bigint").alias("campaign_id"), F.concat(F.lit("n"), "n_nationkey").alias("counter"), F.col("n_name").alias("name"))
    o = table(spark, sf, "orders").withColumn("campaign_id", F.col("o_custkey") % 25).join(c, "campaign_id")
    ref = F.when(F.col("o_orderkey") % 3 == 0, F.col("counter")).when(F.col("o_orderkey") % 3 == 1, F.lower("name")).otherwise("nobody")
    return log.resolve_counter(o.select("campaign_id", "o_orderkey", ref.alias("ref")), c).select("o_orderkey", "ref", "counter")


INV = f"""mv AS (SELECT *, row_number() OVER (PARTITION BY campaign_id, counter ORDER BY ts, event_id) AS i FROM {CHANGES_SQL} WHERE delta IS NOT NULL),
run AS (SELECT campaign_id, counter, ts, event_id, i, sum(delta) OVER w AS s FROM mv WINDOW w AS (PARTITION BY campaign_id, counter ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
low AS (SELECT campaign_id, counter, arg_max(s, i) - least(0, min(s)) AS qty FROM run GROUP BY ALL)"""


@job(f"WITH {INV} SELECT campaign_id, counter AS item_id, qty::BIGINT AS qty FROM low WHERE qty > 0")
def inventory_fold(spark, sf):
    c = changes(spark, sf).filter("delta is not null").withColumnRenamed("counter", "item_id")
    return log.fold_inventory(c, ORDER, SPAN(), ["campaign_id", "item_id"])


# ---- diffs: an event is a turn, its diff a JSON document ----

DIFF = r"""'{"clocks":[{"id":"heat","delta":' || delta || ',"source":"' || event_type || '"}],"facts_add":[' || CASE WHEN event_type = 'click'
    THEN '{"id":"f' || (event_id % 7) || '","subject_id":"s' || (event_id % 3) || '","predicate":"seen","object":"o' || event_id || '","visibility":"' ||
    CASE WHEN event_id % 2 = 0 THEN 'known' ELSE 'world' END || '","tags":["t"]}' ELSE '' END || '],"facts_update":[' || CASE WHEN event_type = 'purchase'
    THEN '{"id":"f' || (event_id % 7) || '","visibility":"known"}' ELSE '' END || '],"inventory_changes":[{"owner_id":"player","item_id":"i' || (event_id % 3) ||
    '","delta":' || delta || '}]' || CASE WHEN event_type = 'view' THEN ',"scene_update":{"location_id":"l' || (event_id % 5) || '"}' WHEN event_type = 'signup'
    THEN ',"scene_update":{"present_entity_ids":["player","p' || (event_id % 4) || '"]}' ELSE '' END || ',"threads_update":[{"id":"q' || (event_id % 4) ||
    '","status":"' || event_type || '"}],"relationship_changes":[{"a_id":"player","b_id":"b' || (event_id % 2) || '","delta":' || delta || '}]}'"""


def turns(spark, sf):
    """Events with a JSON diff; turn number is the event id, which grows with time."""
    e = bind.log(spark, sf)
    return e.select("campaign_id", F.col("event_id").alias("turn_no"), F.expr(DIFF).alias("state_diff"))


def diff_rows(spark, sf):
    return log.explode_diffs(turns(spark, sf))


CUT = "(SELECT max(event_id) // 2 FROM events)"
E = bind.LOG_SQL


@job(f"""SELECT kind, count(*) AS n, sum(coalesce(delta, 0))::BIGINT AS deltas, sum(seq)::BIGINT AS seqs FROM (
SELECT 'counter' AS kind, delta, 0 AS seq FROM {E} UNION ALL
SELECT CASE event_type WHEN 'click' THEN 'fact_add' ELSE 'fact_update' END, NULL, 1 FROM {E} WHERE event_type IN ('click', 'purchase') UNION ALL
SELECT 'item', delta, 1 + (event_type IN ('click', 'purchase'))::INTEGER FROM {E} UNION ALL
SELECT 'scene', NULL, 2 FROM {E} WHERE event_type IN ('view', 'signup') UNION ALL
SELECT 'thread', NULL, CASE WHEN event_type = 'error' THEN 2 ELSE 3 END FROM {E} UNION ALL
SELECT 'relation', delta, CASE WHEN event_type = 'error' THEN 3 ELSE 4 END FROM {E}) GROUP BY kind""")
def explode_diffs(spark, sf):
    d = diff_rows(spark, sf)
    return d.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("delta", F.lit(0))).alias("deltas"), F.sum("seq").cast("bigint").alias("seqs")
    )


FACTS = f"""fa AS (SELECT campaign_id, event_id, event_type, 'f' || (event_id % 7) AS id, CASE WHEN event_type = 'click' THEN 'o' || event_id END AS object,
    CASE WHEN event_type = 'click' THEN 's' || (event_id % 3) END AS subject_id,
    CASE WHEN event_type = 'purchase' OR event_id % 2 = 0 THEN 'known' ELSE 'world' END AS visibility FROM {E} WHERE event_type IN ('click', 'purchase')),
fb AS (SELECT campaign_id, id, min(event_id) AS born FROM fa WHERE event_type = 'click' GROUP BY ALL),
fo AS (SELECT campaign_id, id, arg_max(subject_id, event_id) FILTER (subject_id IS NOT NULL) AS subject_id, arg_max(object, event_id) FILTER (object IS NOT NULL) AS object,
    arg_max(visibility, event_id) AS visibility, max(event_id) FILTER (visibility = 'known') AS discovered_turn
    FROM fa JOIN fb USING (campaign_id, id) WHERE event_id >= born GROUP BY campaign_id, id)"""


@job(f"WITH {FACTS} SELECT * FROM fo")
def fold_facts(spark, sf):
    return log.fold_facts(diff_rows(spark, sf)).select("campaign_id", "id", "subject_id", "object", "visibility", "discovered_turn")


@job(f"""SELECT campaign_id, coalesce(max_by('l' || (event_id % 5), event_id) FILTER (event_type = 'view'), 'unknown') AS location_id,
coalesce('player,' || max_by('p' || (event_id % 4), event_id) FILTER (event_type = 'signup'), '') AS present FROM {E} WHERE event_type IN ('view', 'signup') GROUP BY campaign_id""")
def latest_scene(spark, sf):
    return log.latest_scene(diff_rows(spark, sf)).withColumn("present", F.array_join("present", ","))


@job(f"""WITH i AS (SELECT DISTINCT campaign_id, 'q' || t AS id FROM {E}, range(3) r(t))
SELECT i.campaign_id, i.id, coalesce(max_by(event_type, event_id), 'active') AS status FROM i LEFT JOIN {E} e ON e.campaign_id = i.campaign_id AND 'q' || (event_id % 4) = i.id GROUP BY ALL""")
def fold_threads(spark, sf):
    u = bind.log(spark, sf).select("campaign_id").distinct()
    init = u.select("campaign_id", F.explode(F.array(*[F.lit(f"q{i}") for i in range(3)])).alias("id"), F.lit("active").alias("status"), F.expr("cast(null as map<string,string>)").alias("stakes"))
    return log.fold_threads(init, diff_rows(spark, sf)).select("campaign_id", "id", "status")


@job(f"""WITH d AS (SELECT campaign_id, 'b' || (event_id % 2) AS b_id, sum(delta) AS s, arg_min(delta, event_id) AS f FROM {E} GROUP BY ALL)
SELECT campaign_id, b_id, (CASE WHEN b_id = 'b0' AND campaign_id IN (SELECT user_id FROM events WHERE event_type = 'signup') THEN 3 + s ELSE greatest(-10, least(10, f)) + s - f END)::BIGINT AS intensity FROM d
UNION ALL SELECT campaign_id, 'b0', 3 FROM (SELECT DISTINCT campaign_id FROM {E} WHERE event_type = 'signup') u WHERE NOT EXISTS
(SELECT 1 FROM d WHERE d.campaign_id = u.campaign_id AND b_id = 'b0')""")
def fold_relationships(spark, sf):
    u = bind.log(spark, sf).filter("event_type = 'signup'").select("campaign_id").distinct()
    init = u.select("campaign_id", F.lit("player").alias("a_id"), F.lit("b0").alias("b_id"), F.lit("trust").alias("rel_type"), F.lit(3).alias("intensity"))
    rel = diff_rows(spark, sf).filter("kind = 'relation'")
    return log.fold_relationships(init, rel, ["turn_no", "seq"]).select("campaign_id", "b_id", "intensity")


@job("""SELECT l_suppkey AS campaign_id, 'part_' || l_partkey AS entity_id, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS turn_no, count(*) AS mentions
FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY') GROUP BY ALL""")
def introduce_entities(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("campaign_id"), F.concat(F.lit("part_"), "l_partkey").alias("entity_id"), F.col("l_orderkey").alias("turn_no"), "l_linenumber"
    )
    p = table(spark, sf, "part").filter("p_type = 'ECONOMY'").select(F.concat(F.lit("part_"), "p_partkey").alias("entity_id"))
    have = li.select("campaign_id", "entity_id").join(p, "entity_id", "left_semi").distinct()
    return log.introduce_entities(have, li, ["turn_no", "l_linenumber"]).select("campaign_id", "entity_id", "turn_no", "mentions")


@job("SELECT c_custkey AS campaign_id, coalesce(max(turn) + 1, 1) AS next_turn FROM customer LEFT JOIN conversations ON conv_id = c_custkey GROUP BY ALL")
def next_turn(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("campaign_id"), F.col("turn").alias("turn_no"))
    return log.next_turn(c, table(spark, sf, "customer").select(F.col("c_custkey").alias("campaign_id"))).withColumn("next_turn", F.col("next_turn").cast("bigint"))


@job("SELECT conv_id AS campaign_id, turn AS turn_no, length(text)::INTEGER AS chars FROM conversations WHERE turn BETWEEN 1 AND 3")
def events_range(spark, sf):
    return log.events_range(conv(spark, sf), 1, 3).select("campaign_id", "turn_no", F.length("final_text").alias("chars"))


REQ = ["event_id", "ts", "user_id", "sku"]


@job("""SELECT event_type, count(*) FILTER (sku IS NOT NULL) AS kept, count(*) FILTER (sku IS NULL) AS rejected FROM
(SELECT event_type, CASE WHEN value > 100 THEN event_id END AS sku FROM events) GROUP BY event_type""")
def append_events(spark, sf):
    e = table(spark, sf, "events").withColumn("sku", F.when(F.col("value") > 100, F.col("event_id")))
    good, bad = log.append_events(e, REQ)
    both = good.select("event_type", F.lit(1).alias("g")).unionByName(bad.select("event_type", F.lit(0).alias("g")))
    return both.groupBy("event_type").agg(F.sum("g").alias("kept"), F.sum(1 - F.col("g")).alias("rejected"))


# ---- as-of ----

CUTS_SQL = "(SELECT DISTINCT user_id AS campaign_id, TIMESTAMP '2024-01-01' + to_days(5 * i::INTEGER) AS cut FROM events, range(1, 6) r(i))"


def cuts(spark, sf):
    u = table(spark, sf, "events").select(F.col("user_id").alias("campaign_id")).distinct()
    days = F.explode(F.array(*[F.expr(f"timestamp_ntz '2024-01-01' + interval {5 * i} day") for i in range(1, 6)]))
    return u.select("campaign_id", days.alias("cut"))


def ts_span(c):
    return ordered.hours(c, 24)


@job(f"""SELECT c.campaign_id, c.cut, arg_max(event_id, (ts, event_id)) AS last_event FROM {CUTS_SQL} c LEFT JOIN events e ON e.user_id = c.campaign_id AND e.ts <= c.cut GROUP BY ALL""")
def snapshot_at(spark, sf):
    e = bind.log(spark, sf)
    return log.as_of(cuts(spark, sf), e, ["campaign_id"], "cut", "ts", F.col("event_id"), ts_span, "last_event", ["event_id"])


@job(f"""WITH RECURSIVE {WALK}, c AS (SELECT i.campaign_id, i.counter, cut, value FROM init i JOIN {CUTS_SQL} USING (campaign_id))
SELECT c.campaign_id, c.counter, cut, coalesce(arg_max(new_value, (ts, event_id)), any_value(value))::BIGINT AS value FROM c
LEFT JOIN st ON st.campaign_id = c.campaign_id AND st.counter = c.counter AND st.ts < cut GROUP BY ALL""")
def state_as_of(spark, sf):
    s = log.counter_steps(counters(spark, sf), changes(spark, sf), ORDER, SPAN())
    return log.counters_as_of(counters(spark, sf), s, cuts(spark, sf), "ts", ["event_id"], ts_span).select("campaign_id", "counter", "cut", "value")


@job(f"""WITH {FACTS.replace(f'FROM {E} WHERE', f'FROM {E} WHERE event_id < {CUT} AND')}
SELECT 'facts' AS part, count(*) AS n, count(*) FILTER (visibility = 'known') AS m FROM fo
UNION ALL SELECT 'scene', count(DISTINCT campaign_id), count(DISTINCT campaign_id) FILTER (event_type = 'view') FROM {E} WHERE event_id < {CUT} AND event_type IN ('view', 'signup')
UNION ALL SELECT 'relationships', count(DISTINCT (campaign_id, event_id % 2)), sum(delta)::BIGINT FROM
    (SELECT campaign_id, event_id, delta - CASE WHEN row_number() OVER (PARTITION BY campaign_id, event_id % 2 ORDER BY event_id) = 1 THEN delta - greatest(-10, least(10, delta)) ELSE 0 END AS delta FROM {E} WHERE event_id < {CUT})
UNION ALL SELECT 'inventory', count(*), sum(q)::BIGINT FROM (SELECT campaign_id, item, arg_max(s, event_id) - least(0, min(s)) AS q FROM
    (SELECT campaign_id, event_id % 3 AS item, event_id, sum(delta) OVER (PARTITION BY campaign_id, event_id % 3 ORDER BY event_id) AS s FROM {E} WHERE event_id < {CUT}) GROUP BY ALL) WHERE q > 0""")
def state_tables_as_of(spark, sf):
    none = lambda ddl: spark.createDataFrame([], ddl)
    init = {
        "entities": none("campaign_id long, entity_id string"),
        "clocks": none("campaign_id long, counter string, value long, max long"),
        "facts": none("campaign_id long, id string, subject_id string, predicate string, object string, visibility string, tags array<string>"),
        "inventory": none("campaign_id long, owner_id string, item_id string, qty long"),
        "threads": none("campaign_id long, id string, status string, stakes map<string,string>"),
        "relationships": none("campaign_id long, a_id string, b_id string, rel_type string, intensity long"),
    }
    t = turns(spark, sf)
    s = log.state_as_of(init, t, t.agg(F.floor(F.max("turn_no") / 2)).first()[0])
    one = lambda name, m: s[name].agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), m.alias("m"))
    return (
        one("facts", F.count(F.when(F.col("visibility") == "known", 1)))
        .unionByName(one("scene", F.count(F.when(F.col("location_id") != "unknown", 1))))
        .unionByName(one("relationships", F.sum("intensity")))
        .unionByName(one("inventory", F.sum("qty")))
    )


# ---- time and sessions ----

@job(f"""WITH t AS (SELECT campaign_id, event_id, floor(value / 10)::INTEGER AS minutes, ts FROM {E}),
r AS (SELECT *, 480 + sum(minutes) OVER (PARTITION BY campaign_id ORDER BY ts, event_id) AS after FROM t),
h AS (SELECT *, (after // 60) % 24 AS h1, ((after - minutes) // 60) % 24 AS h0 FROM r),
p AS (SELECT *, CASE WHEN h1 >= 5 AND h1 < 6 THEN 'pre_dawn' WHEN h1 >= 6 AND h1 < 8 THEN 'dawn' WHEN h1 >= 8 AND h1 < 12 THEN 'morning' WHEN h1 >= 12 AND h1 < 17 THEN 'afternoon'
    WHEN h1 >= 17 AND h1 < 20 THEN 'evening' ELSE 'night' END AS p1, CASE WHEN h0 >= 5 AND h0 < 6 THEN 'pre_dawn' WHEN h0 >= 6 AND h0 < 8 THEN 'dawn' WHEN h0 >= 8 AND h0 < 12 THEN 'morning'
    WHEN h0 >= 12 AND h0 < 17 THEN 'afternoon' WHEN h0 >= 17 AND h0 < 20 THEN 'evening' ELSE 'night' END AS p0 FROM h)
SELECT campaign_id, event_id, h1::INTEGER AS hour, (after % 60)::INTEGER AS minute, p1 AS period, p1 <> p0 AS period_changed FROM p""")
def scene_time(spark, sf):
    t = bind.log(spark, sf).withColumn("minutes", F.floor(F.col("value") / 10).cast("int"))
    return log.scene_time(t, ORDER, SPAN(), start=480).select("campaign_id", "event_id", "hour", "minute", "period", "period_changed")


def conv(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("campaign_id"), F.col("turn").alias("turn_no"), "role", F.col("text").alias("final_text"))


SESS_SQL = """(SELECT o_custkey AS campaign_id, o_orderkey AS id, o_orderdate AS started_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS ended_at FROM orders)"""


@job(f"SELECT campaign_id, arg_max(id, (started_at, id)) AS id, max(started_at) AS started_at FROM {SESS_SQL} WHERE ended_at IS NULL GROUP BY ALL")
def active_session(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("campaign_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("ended_at"),
    )
    return log.active_session(o).select("campaign_id", "id", "started_at")


@job("""WITH s AS (SELECT user_id AS campaign_id, event_id AS id, event_id AS a, event_id + 400 AS b FROM events WHERE event_type = 'signup'),
n AS (SELECT campaign_id, id, a, least(b, coalesce(lead(a) OVER (PARTITION BY campaign_id ORDER BY a) - 1, b)) AS b FROM s)
SELECT e.event_id AS turn_no, n.id AS session_id FROM events e LEFT JOIN n ON n.campaign_id = e.user_id AND e.event_id BETWEEN n.a AND n.b""")
def assign_sessions(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("campaign_id"), F.col("event_id").alias("turn_no"), "event_type")
    s = e.filter("event_type = 'signup'").select("campaign_id", F.col("turn_no").alias("id"), F.col("turn_no").alias("turn_range_start"), (F.col("turn_no") + 400).alias("turn_range_end"))
    return log.assign_sessions(e, s, lambda c: ordered.steps(c, 100_000)).select("turn_no", "session_id")


@job("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id AS campaign_id, event_id, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session_no FROM g""")
def gap_sessions(spark, sf):
    return log.gap_sessions(bind.log(spark, sf), "ts", "event_id", 12 * 3600, SPAN()).select("campaign_id", "event_id", "session_no")


RECAP = """SELECT conv_id AS campaign_id, string_agg(CASE WHEN length(split_part(text, '.', 1)) + 1 > 120 THEN left(text, 100) || '...' ELSE split_part(text, '.', 1) || '.' END, ' ' ORDER BY turn) AS recap
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM {src} WHERE text <> '') WHERE r <= 10 GROUP BY ALL"""


@job(RECAP.format(src="conversations"))
def session_recap(spark, sf):
    return log.session_recap(conv(spark, sf), ["campaign_id"])


@job(RECAP.format(src="(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z FROM conversations) WHERE z <= 3)"))
def recap_of_last_turns(spark, sf):
    return log.session_recap(log.last_turns(conv(spark, sf), ["campaign_id"], 3), ["campaign_id"])


@job("SELECT o_custkey AS campaign_id, min(o_orderdate) AS created_at FROM orders GROUP BY ALL")
def list_campaigns(spark, sf):
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("campaign_id")).agg(F.min("o_orderdate").alias("created_at"))
    return log.list_campaigns(c)
