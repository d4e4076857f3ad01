"""View and action-rule jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrollwork.functions import fixed, ordered, text as T
from scrollwork.operators import actions, views
from scrollwork.plans import bind
from scrollwork.plans.bind import quote, sql_case, sql_list
from scrollwork.plans.log_jobs import conv, k
from scrollwork.plans.registry import job, table

# ---- scenes: a nation is a campaign, its suppliers and customers are the cast ----

PRES_SQL = "(SELECT s_nationkey AS campaign_id, s_suppkey AS ord, 's' || s_suppkey AS entity_id, s_acctbal < 0 AS obscured FROM supplier)"
CAST_SQL = """(SELECT s_nationkey AS campaign_id, 's' || s_suppkey AS entity_id, s_name AS name, s_suppkey AS ord FROM supplier UNION ALL
SELECT c_nationkey, 'c' || c_custkey, c_name, 1000000 + c_custkey FROM customer)"""


def presence(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(
        F.col("s_nationkey").alias("campaign_id"), F.col("s_suppkey").alias("ord"), F.concat(F.lit("s"), "s_suppkey").alias("entity_id"),
        (F.col("s_acctbal") < 0).alias("obscured"),
    )


def cast(spark, sf):
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    a = s.select(F.col("s_nationkey").alias("campaign_id"), F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord"))
    b = c.select(F.col("c_nationkey"), F.concat(F.lit("c"), "c_custkey"), F.col("c_name"), F.col("c_custkey") + 1000000)
    return a.unionAll(b)


VIS = f"vis AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY ord) AS r FROM {PRES_SQL} WHERE NOT obscured) WHERE r <= 50)"


@job(f"WITH {VIS} SELECT campaign_id, entity_id, s_name AS name FROM vis JOIN supplier ON s_suppkey = ord")
def visible_entities(spark, sf):
    return views.visible_entities(presence(spark, sf), cast(spark, sf).drop("ord")).select("campaign_id", "entity_id", "name")


FACT_SQL = """(SELECT s_nationkey AS campaign_id, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber = 1 THEN 'scene' ELSE 's' || l_suppkey END AS subject_id,
CASE WHEN l_linenumber = 7 THEN 'narrator_established' ELSE 'sold' END AS predicate, CASE WHEN l_returnflag = 'R' THEN 'known' ELSE 'world' END AS visibility,
'part ' || l_partkey AS object FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"""


def line_facts(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    li = table(spark, sf, "lineitem").join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    return li.select(
        F.col("s_nationkey").alias("campaign_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.when(F.col("l_linenumber") == 1, "scene").otherwise(F.concat(F.lit("s"), "l_suppkey")).alias("subject_id"),
        F.when(F.col("l_linenumber") == 7, "narrator_established").otherwise("sold").alias("predicate"),
        F.when(F.col("l_returnflag") == "R", "known").otherwise("world").alias("visibility"),
        F.concat(F.lit("part "), "l_partkey").alias("object"),
    )


@job(f"""WITH {VIS}, f AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY id) AS r FROM {FACT_SQL} x WHERE visibility = 'known' AND
(subject_id = 'scene' OR predicate = 'narrator_established' OR EXISTS (SELECT 1 FROM vis v WHERE v.campaign_id = x.campaign_id AND v.entity_id = x.subject_id)))
SELECT campaign_id, id, subject_id FROM f WHERE r <= 100""")
def visible_facts(spark, sf):
    v = views.visible_entities(presence(spark, sf), cast(spark, sf).drop("ord"))
    return views.visible_facts(line_facts(spark, sf), v).select("campaign_id", "id", "subject_id")


@job("""WITH r AS (SELECT DISTINCT 'o' || (o_custkey % 100) AS a_id, 'c' || o_custkey AS b_id, o_orderstatus AS rel_type FROM orders UNION SELECT DISTINCT 'c' || o_custkey, 'o' || (o_custkey % 7), 'owes' FROM orders),
b AS (SELECT a_id AS entity_id, b_id AS other_id, rel_type FROM r UNION ALL SELECT b_id, a_id, rel_type FROM r)
SELECT entity_id, other_id, rel_type, coalesce(c_name, other_id) AS other_name FROM b LEFT JOIN customer ON other_id = 'c' || c_custkey
WHERE entity_id IN (SELECT 'c' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') OR entity_id = 'o5'""")
def neighbours(spark, sf):
    o = table(spark, sf, "orders")
    one = F.lit(1).alias("campaign_id")
    a = o.select(one, F.concat(F.lit("o"), F.col("o_custkey") % 100).alias("a_id"), F.concat(F.lit("c"), "o_custkey").alias("b_id"), F.col("o_orderstatus").alias("rel_type"))
    b = o.select(one, F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("o"), F.col("o_custkey") % 7), F.lit("owes"))
    rels = a.unionAll(b).distinct().withColumn("intensity", F.lit(0))
    c = table(spark, sf, "customer")
    ents = c.select(one, F.concat(F.lit("c"), "c_custkey").alias("entity_id"), F.col("c_name").alias("name"), "c_mktsegment")
    centre = ents.filter("c_mktsegment = 'BUILDING'").select("campaign_id", "entity_id").unionAll(spark.range(1).select(one, F.lit("o5")))
    return views.neighbours(rels, ents, centre).select("entity_id", "other_id", "rel_type", "other_name")


# attributes as JSON, made of customer columns
ATTR = """'{"agenda":"' || CASE WHEN c_acctbal > 5000 THEN 'sell ' || c_mktsegment ELSE '' END || '"' || CASE WHEN c_nationkey < 10 THEN ',"threat_level":"' ||
CASE c_mktsegment WHEN 'BUILDING' THEN 'high' WHEN 'FURNITURE' THEN 'extreme' WHEN 'MACHINERY' THEN 'moderate' ELSE 'low' END || '"' ELSE '' END ||
CASE WHEN c_acctbal < 0 THEN ',"equipment":"debt","status":"owing"' ELSE '' END || '}'"""
NPC_SQL = f"""(SELECT c_nationkey AS campaign_id, 'c' || c_custkey AS entity_id, c_custkey AS ord, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'item' ELSE 'npc' END AS type,
c_acctbal, c_mktsegment, c_nationkey FROM customer)"""
LEVEL = "CASE c_mktsegment WHEN 'BUILDING' THEN 'high' WHEN 'FURNITURE' THEN 'extreme' WHEN 'MACHINERY' THEN 'moderate' ELSE 'low' END"


def npcs(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("campaign_id"), F.concat(F.lit("c"), "c_custkey").alias("entity_id"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 4 == 0, "item").otherwise("npc").alias("type"), F.expr(ATTR).alias("attrs"),
    )


@job(f"SELECT campaign_id, entity_id, name, 'sell ' || c_mktsegment AS agenda FROM {NPC_SQL} WHERE type = 'npc' AND c_acctbal > 5000")
def agendas(spark, sf):
    return views.agendas(npcs(spark, sf))


@job(f"""SELECT campaign_id, entity_id, name, CASE WHEN c_nationkey < 10 THEN {LEVEL} ELSE 'low' END AS threat_level, '[]' AS capabilities,
CASE WHEN c_acctbal < 0 THEN 'debt' ELSE '[]' END AS equipment, '[]' AS limitations, '{{}}' AS escalation_profile FROM {NPC_SQL} WHERE type = 'npc' AND (c_nationkey < 10 OR c_acctbal < 0)""")
def capabilities(spark, sf):
    return views.capabilities(npcs(spark, sf))


@job("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_shipdate FROM lineitem WHERE l_linestatus = 'O'),
t AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey AS thread_id, count(*) FILTER (l_returnflag = 'R') AS clues_found, count(*) AS clues_total,
max(l_shipdate) FILTER (l_returnflag = 'R') AS last_clue_turn FROM t JOIN f ON l_orderkey = o_orderkey GROUP BY ALL""")
def thread_progress(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    one = F.lit(1).alias("campaign_id")
    th = o.select(
        one, F.col("o_orderkey").cast("string").alias("thread_id"), F.lit("order").alias("title"),
        F.when(F.col("o_orderstatus") == "O", "active").otherwise("closed").alias("status"), F.array(F.concat(F.lit("o"), "o_orderkey")).alias("related_ids"),
    )
    # odd lines are facts about the order, even ones facts of the scene tagged with it
    odd = F.col("l_linenumber") % 2 == 1
    tag = F.when(F.col("l_linestatus") == "O", "clue").otherwise("plain")
    fa = li.select(
        one, F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), F.when(odd, F.concat(F.lit("o"), "l_orderkey")).otherwise("scene").alias("subject_id"),
        F.when(odd, F.array(tag)).otherwise(F.array(tag, F.col("l_orderkey").cast("string"))).alias("tags"),
        F.when(F.col("l_returnflag") == "R", "known").otherwise("world").alias("visibility"), F.col("l_shipdate").alias("discovered_turn"),
    )
    p = views.thread_progress(th, fa)
    return p.select(F.col("thread_id").cast("bigint").alias("thread_id"), "clues_found", "clues_total", "last_clue_turn")


# situations and threats as JSON facts made of orders
def order_facts(spark, sf):
    o = table(spark, sf, "orders")
    odd = F.col("o_orderkey") % 2 == 1
    obj = F.expr("""CASE WHEN o_orderkey % 2 = 1 THEN '{"condition":"' || o_orderpriority || '","active":' || CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END || ',"severity":"hard"}'
        WHEN o_orderkey % 4 = 0 THEN '{"description":"due ' || o_custkey || '","turn_issued":' || o_orderkey || '}' ELSE 'plain words' END""")
    return o.select(
        F.col("o_custkey").alias("campaign_id"), F.col("o_orderkey").alias("id"), F.when(odd, "player").otherwise("scene").alias("subject_id"),
        F.when(odd, "situation").otherwise("pending_threat").alias("predicate"), obj.alias("object"),
        F.when(F.col("o_orderstatus") != "P", "known").otherwise("world").alias("visibility"), F.year("o_orderdate").alias("discovered_turn"),
    )


@job("""SELECT o_custkey AS campaign_id, o_orderkey AS fact_id, CASE WHEN o_orderkey % 4 = 0 THEN 'due ' || o_custkey ELSE 'plain words' END AS description,
CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey ELSE year(o_orderdate) END::BIGINT AS turn_declared, 'soft' AS severity FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus <> 'P'""")
def pending_threats(spark, sf):
    return views.pending_threats(order_facts(spark, sf))


@job("""SELECT o_custkey AS campaign_id, o_orderkey AS fact_id, o_orderpriority AS condition, 'hard' AS severity, '' AS source_action FROM orders WHERE o_orderkey % 2 = 1 AND o_orderstatus = 'O'""")
def active_situations(spark, sf):
    return views.active_situations(order_facts(spark, sf))


# ---- turns with outcomes ----

VERBS = ["look", "attack", "hack", "steal", "sneak", "talk", "persuade", "climb", "shoot", "travel", "fight", "deceive", "hide"]
VERB_SQL = f"([{', '.join(quote(v) for v in VERBS)}])[regexp_extract(props, '([0-9]+)', 1)::INTEGER // 8 + 1]"
ACT_SQL = f"""(SELECT user_id AS campaign_id, ts, event_id AS turn_no, event_type, {VERB_SQL} AS action, value,
CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success' END AS outcome FROM events)"""


def acts(spark, sf):
    e = table(spark, sf, "events")
    verb = F.element_at(F.array(*[F.lit(v) for v in VERBS]), (F.floor(k() / 8) + 1).cast("int"))
    return e.select(
        F.col("user_id").alias("campaign_id"), "ts", F.col("event_id").alias("turn_no"), "event_type", verb.alias("action"), "value",
        F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "purchase", "success").alias("outcome"),
    )


@job(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY ts DESC, turn_no DESC) AS r FROM {ACT_SQL}),
f AS (SELECT *, coalesce(min(r) FILTER (outcome = 'success') OVER (PARTITION BY campaign_id), 99) AS stop FROM r WHERE r <= 10)
SELECT campaign_id, count(*) FILTER (outcome = 'failure' AND r < stop) AS streak,
coalesce(string_agg(action, ',' ORDER BY r) FILTER (outcome = 'failure' AND r < stop), '') AS actions FROM f GROUP BY ALL""")
def failure_streak(spark, sf):
    return views.failure_streak(acts(spark, sf), [F.desc("ts"), F.desc("turn_no")])


@job(f"""WITH p AS (SELECT c_custkey AS campaign_id, 's' || (c_custkey % 150) AS entity_id, c_acctbal <= 0 AS poor FROM customer)
SELECT p.campaign_id, p.entity_id, CASE WHEN poor THEN 'no_scene' WHEN h.obscured THEN 'obscured' WHEN h.obscured IS NOT NULL THEN 'clear'
WHEN s_suppkey IS NOT NULL THEN 'not_present' ELSE 'not_known' END AS perception FROM p
LEFT JOIN (SELECT DISTINCT o_custkey, 's' || (o_orderkey % 150) AS e, bool_or(o_orderstatus = 'F') OVER (PARTITION BY o_custkey, o_orderkey % 150) AS obscured FROM orders) h ON h.o_custkey = p.campaign_id AND h.e = p.entity_id
LEFT JOIN supplier ON 's' || s_suppkey = p.entity_id""")
def perception(spark, sf):
    c = table(spark, sf, "customer")
    pairs = c.select(F.col("c_custkey").alias("campaign_id"), F.concat(F.lit("s"), F.col("c_custkey") % 150).alias("entity_id"))
    here = table(spark, sf, "orders").select(F.col("o_custkey").alias("campaign_id"), F.concat(F.lit("s"), F.col("o_orderkey") % 150).alias("entity_id"), (F.col("o_orderstatus") == "F").alias("obscured"))
    ents = pairs.join(table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id")), "entity_id")
    return views.perception(pairs, here, ents, c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("campaign_id")))


@job("SELECT conv_id AS campaign_id, turn AS turn_no, left(text, 500) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 5")
def recent_events(spark, sf):
    return views.recent_events(conv(spark, sf))


@job("""WITH s AS (SELECT conv_id AS campaign_id, left(arg_max(text, turn), 200) AS scene FROM conversations GROUP BY ALL),
t AS (SELECT c_custkey % 120 AS campaign_id, c_name, row_number() OVER (PARTITION BY c_custkey % 120 ORDER BY c_custkey) AS r FROM customer WHERE c_acctbal > 0)
SELECT campaign_id, scene, coalesce((SELECT 'Active: ' || string_agg(c_name, ', ' ORDER BY r) FROM t WHERE t.campaign_id = s.campaign_id AND r <= 3), '') AS threads FROM s""")
def recent_summary(spark, sf):
    c = table(spark, sf, "customer")
    th = c.select((F.col("c_custkey") % 120).alias("campaign_id"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("title"), F.when(F.col("c_acctbal") > 0, "active").otherwise("closed").alias("status"))
    return views.recent_summary(conv(spark, sf), th)


@job(f"""WITH n AS (SELECT * FROM {NPC_SQL}), t AS (SELECT * FROM n WHERE c_mktsegment = 'BUILDING')
SELECT entity_id, 'status' AS kind, 'owing' AS detail FROM t WHERE c_acctbal < 0
UNION ALL SELECT t.entity_id, 'hidden_fact', o_orderpriority FROM t JOIN orders ON t.entity_id = 'c' || o_custkey WHERE o_orderstatus = 'P'
UNION ALL SELECT t.entity_id, 'item_found', m.name FROM t JOIN orders ON t.entity_id = 'c' || o_custkey JOIN n m ON m.entity_id = 'c' || (o_custkey + 25) AND m.campaign_id = t.campaign_id""")
def discoveries(spark, sf):
    n = npcs(spark, sf)
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    o = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    key = F.concat(F.lit("c"), "o_custkey")
    facts = o.select(F.col("c_nationkey").alias("campaign_id"), key.alias("subject_id"), F.when(F.col("o_orderstatus") == "P", "world").otherwise("known").alias("visibility"), F.col("o_orderpriority").alias("object"))
    inv = o.select(F.col("c_nationkey").alias("campaign_id"), key.alias("owner_id"), F.concat(F.lit("c"), F.col("o_custkey") + 25).alias("item_id"))
    t = c.filter("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("campaign_id"), F.concat(F.lit("c"), "c_custkey").alias("entity_id"))
    return views.discoveries(t, n, facts, inv).select("entity_id", "kind", "detail")


@job(f"""WITH {VIS}, f AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY id) AS r FROM {FACT_SQL} x WHERE visibility = 'known' AND
(subject_id = 'scene' OR predicate = 'narrator_established' OR EXISTS (SELECT 1 FROM vis v WHERE v.campaign_id = x.campaign_id AND v.entity_id = x.subject_id))),
a AS (SELECT campaign_id, count(*) AS n, string_agg(entity_id, ',' ORDER BY ord) AS ids FROM vis GROUP BY ALL),
b AS (SELECT campaign_id, count(*) AS m, min(id) AS lo FROM f WHERE r <= 100 GROUP BY ALL)
SELECT coalesce(a.campaign_id, b.campaign_id) AS campaign_id, coalesce(n, 0)::INTEGER AS entities, coalesce(ids, '') AS ids, coalesce(m, 0)::INTEGER AS facts, lo AS first_fact FROM a FULL JOIN b ON a.campaign_id = b.campaign_id""")
def context_packet(spark, sf):
    v = views.visible_entities(presence(spark, sf), cast(spark, sf).drop("ord"))
    f = views.visible_facts(line_facts(spark, sf), v)
    p = views.context_packet({"e": v.select("campaign_id", "ord", "entity_id"), "f": f.select("campaign_id", "id", "subject_id")}, {"e": "ord", "f": "id"})
    ids = F.array_join(F.transform("e", lambda x: x["entity_id"]), ",")
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return p.select("campaign_id", n("e").alias("entities"), F.coalesce(ids, F.lit("")).alias("ids"), n("f").alias("facts"), F.get("f", F.lit(0))["id"].alias("first_fact"))


# ---- actions ----

PROP_SQL = f"""(SELECT user_id AS campaign_id, date_diff('day', TIMESTAMP '1970-01-01', ts)::BIGINT AS turn_no, event_id AS ord, {VERB_SQL} AS action,
CASE event_id % 5 WHEN 0 THEN 's' || (event_id % 120) WHEN 1 THEN 'SUPPLIER#00000' || lpad((event_id % 100)::VARCHAR, 4, '0') WHEN 2 THEN '#0000' || lpad((event_id % 100)::VARCHAR, 5, '0') WHEN 3 THEN 'scene' ELSE 'ghost' END AS target,
event_type, value, regexp_extract(props, '([0-9]+)', 1)::INTEGER AS k FROM events)"""


def proposals(spark, sf):
    e = table(spark, sf, "events")
    verb = F.element_at(F.array(*[F.lit(v) for v in VERBS]), (F.floor(k() / 8) + 1).cast("int"))
    m = F.col("event_id") % 5
    two = F.col("event_id") % 100
    target = (
        F.when(m == 0, F.concat(F.lit("s"), F.col("event_id") % 120))
        .when(m == 1, F.concat(F.lit("SUPPLIER#00000"), F.lpad(two.cast("string"), 4, "0")))
        .when(m == 2, F.concat(F.lit("#0000"), F.lpad(two.cast("string"), 5, "0")))
        .when(m == 3, "scene").otherwise("ghost")
    )
    return e.select(
        F.col("user_id").alias("campaign_id"), F.unix_date(F.col("ts").cast("date")).cast("bigint").alias("turn_no"), F.col("event_id").alias("ord"), verb.alias("action"),
        target.alias("target"), "event_type", "value", k().alias("k"),
    )


ENT_SQL = "(SELECT s_suppkey % 10 AS campaign_id, 's' || s_suppkey AS entity_id, s_name AS name, s_suppkey AS ord, s_acctbal AS bal FROM supplier)"


def known(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select((F.col("s_suppkey") % 10).alias("campaign_id"), F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord"), F.col("s_acctbal").alias("bal"))


RES = f"""res AS (SELECT a.*, coalesce((SELECT entity_id FROM {ENT_SQL} e WHERE e.campaign_id = a.campaign_id AND e.entity_id = a.target),
 (SELECT arg_min(entity_id, ord) FROM {ENT_SQL} e WHERE e.campaign_id = a.campaign_id AND lower(e.name) = lower(a.target)),
 (SELECT arg_min(entity_id, ord) FROM {ENT_SQL} e WHERE e.campaign_id = a.campaign_id AND contains(lower(e.name), lower(a.target))), target) AS target_id FROM {PROP_SQL} a)"""


@job(f"WITH {RES} SELECT ord, target, target_id FROM res")
def resolve_targets(spark, sf):
    return actions.resolve_targets(proposals(spark, sf), known(spark, sf)).select("ord", "target", "target_id")


@job(f"""WITH {RES}, j AS (SELECT res.*, EXISTS (SELECT 1 FROM {ENT_SQL} e WHERE e.campaign_id = res.campaign_id AND e.entity_id = target_id) AS kn,
  EXISTS (SELECT 1 FROM {ENT_SQL} e WHERE e.campaign_id = res.campaign_id AND e.entity_id = target_id AND e.bal > 3000) AS here,
  EXISTS (SELECT 1 FROM {ENT_SQL} e WHERE e.campaign_id = res.campaign_id AND e.entity_id = target_id AND e.bal < 0) AS held FROM res)
SELECT ord, CASE WHEN lower(target_id) IN {sql_list(fixed.META_TARGETS)} THEN NULL
WHEN NOT kn AND NOT held AND NOT here AND NOT (target_id = 'ghost' AND campaign_id % 4 = 0) AND NOT (contains(target_id, 'ghost') AND campaign_id % 6 = 1) AND action NOT IN {sql_list(fixed.ENVIRONMENT_VERBS)} THEN 'unknown'
WHEN kn AND NOT here AND NOT held THEN 'not present' END AS reason FROM j""")
def check_reach(spark, sf):
    e = known(spark, sf)
    ids = table(spark, sf, "events").select(F.col("user_id").alias("campaign_id")).distinct()
    feats = F.when(F.col("campaign_id") % 4 == 0, F.array(F.lit("Old Ghost House"), F.lit("well"))).otherwise(F.array(F.lit("well")))
    scenes = ids.select("campaign_id", F.lit("town").alias("location_id"), feats.alias("features"))
    stated = ids.filter("campaign_id % 6 = 1").select("campaign_id", F.lit(1).alias("id"), F.lit("A Ghost was seen").alias("object"))
    a = actions.resolve_targets(proposals(spark, sf), e)
    return actions.check_reach(a, e.filter("bal > 3000"), e.filter("bal < 0"), e, scenes, stated).select("ord", "reason")


@job(f"""WITH inv AS (SELECT user_id AS campaign_id, CASE event_type WHEN 'click' THEN 'weapon' WHEN 'view' THEN 'ammo' END AS item_id, count(*) - 10 AS qty FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL)
SELECT a.ord, CASE WHEN action = 'shoot' AND coalesce((SELECT qty FROM inv WHERE inv.campaign_id = a.campaign_id AND item_id = 'weapon'), 0) < 1 THEN 'weapon'
WHEN action = 'shoot' AND coalesce((SELECT qty FROM inv WHERE inv.campaign_id = a.campaign_id AND item_id = 'ammo'), 0) < 1 THEN 'ammo' END AS missing_item FROM {PROP_SQL} a""")
def check_items(spark, sf):
    e = table(spark, sf, "events").filter("event_type in ('click', 'view')")
    inv = e.groupBy(F.col("user_id").alias("campaign_id"), F.when(F.col("event_type") == "click", "weapon").otherwise("ammo").alias("item_id")).agg((F.count(F.lit(1)) - 10).alias("qty"))
    return actions.check_items(proposals(spark, sf), inv).select("ord", "missing_item")


@job(f"""WITH {RES} SELECT ord, CASE WHEN s_acctbal < 2000 AND action IN {sql_list(fixed.INTERACTIVE_VERBS)} THEN 'target is ' || CASE WHEN s_acctbal < 0 THEN 'dead' ELSE 'destroyed' END
WHEN campaign_id % 3 = 0 AND action IN {sql_list(fixed.VIOLENT_VERBS)} THEN 'no violence here' END AS contradiction FROM res LEFT JOIN supplier ON target_id = 's' || s_suppkey AND s_suppkey % 10 = campaign_id""")
def check_contradictions(spark, sf):
    s = table(spark, sf, "supplier").filter("s_acctbal < 2000")
    facts = s.select((F.col("s_suppkey") % 10).alias("campaign_id"), F.concat(F.lit("s"), "s_suppkey").alias("subject_id"), F.lit("status").alias("predicate"), F.when(F.col("s_acctbal") < 0, "dead").otherwise("destroyed").alias("object"))
    cons = table(spark, sf, "events").select(F.col("user_id").alias("campaign_id")).distinct().select("campaign_id", (F.col("campaign_id") % 3 == 0).alias("no_violence"), F.lit(True).alias("no_magic"))
    a = actions.resolve_targets(proposals(spark, sf), known(spark, sf))
    return actions.check_contradictions(a, facts, cons).select("ord", "contradiction")


COST_ROWS = ", ".join(f"({quote(v)}, {quote(c)}, {d})" for v, c, d in fixed.ACTION_COSTS)
COSTS = f"""co AS (SELECT campaign_id, turn_no, ord, counter, (CASE WHEN campaign_id % 3 = 0 THEN trunc(d * 1.5) WHEN campaign_id % 3 = 1 AND counter = 'harm' THEN greatest(0, d - 1) ELSE d END)::BIGINT AS amount
FROM {PROP_SQL} JOIN (VALUES {COST_ROWS}) r(verb, counter, d) ON verb = action)"""


def lethal(spark, sf):
    m = F.col("campaign_id") % 3
    return proposals(spark, sf).withColumn("lethality", F.when(m == 0, "brutal").when(m == 1, "low").otherwise("moderate"))


@job(f"WITH {COSTS} SELECT ord, counter, amount FROM co")
def action_costs(spark, sf):
    return actions.action_costs(lethal(spark, sf)).select("ord", "counter", "amount")


@job(f"WITH {COSTS} SELECT campaign_id, turn_no, counter, sum(CASE WHEN counter = 'time' THEN -amount ELSE amount END)::BIGINT AS amount FROM co GROUP BY ALL")
def turn_costs(spark, sf):
    return actions.apply_direction(actions.turn_costs(actions.action_costs(lethal(spark, sf))))


@job(f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY campaign_id, turn_no, lower(action), lower(target) ORDER BY ord) AS d FROM {PROP_SQL})
SELECT ord, action, target FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id, turn_no ORDER BY ord) AS r FROM f WHERE d = 1) WHERE r <= 2""")
def cap_actions(spark, sf):
    return actions.cap_actions(proposals(spark, sf)).select("ord", "action", "target")


@job(f"""SELECT campaign_id, turn_no, sum(CASE WHEN k BETWEEN 1 AND 40 THEN k ELSE {sql_case('action', fixed.DURATIONS[1:], '5')} END)::BIGINT AS minutes FROM {PROP_SQL} GROUP BY ALL""")
def durations(spark, sf):
    p = proposals(spark, sf).withColumn("estimated_minutes", F.when(F.col("k") <= 40, F.col("k")))
    return actions.durations(p)


@job(f"""SELECT ord, action NOT IN {sql_list(fixed.SAFE_ACTIONS)} OR event_type = 'error' AS needs_roll FROM {PROP_SQL}""")
def needs_roll(spark, sf):
    p = proposals(spark, sf).withColumn("risk_flags", F.when(F.col("event_type") == "error", F.array(F.lit("pursuit"))).otherwise(F.array(F.col("event_type"))))
    return actions.needs_roll(p).select("ord", "needs_roll")


@job(f"""SELECT ord, k % 11 + 2 AS total, CASE WHEN k % 11 + 2 <= 6 THEN 'failure' WHEN k % 11 + 2 <= 9 THEN 'mixed' WHEN k % 11 + 2 = 12 THEN 'critical' ELSE 'success' END AS outcome,
CASE WHEN k % 11 + 2 <= 6 THEN 7 - (k % 11 + 2) WHEN k % 11 + 2 <= 9 THEN 0 ELSE k % 11 - 8 END AS margin FROM {PROP_SQL}""")
def grade_totals(spark, sf):
    return actions.grade_totals(proposals(spark, sf).select("ord", (F.col("k") % 11 + 2).alias("total")))


@job("""WITH p AS (SELECT l_orderkey, list((l_partkey % 10 + 1)::INTEGER) AS dice, (l_orderkey % 6 + 5)::INTEGER AS difficulty FROM lineitem GROUP BY l_orderkey),
c AS (SELECT l_orderkey, difficulty, len(list_filter(dice, lambda d: d >= difficulty)) AS raw, len(list_filter(dice, lambda d: d = 1)) AS ones FROM p),
n AS (SELECT *, greatest(0, greatest(0, raw - ones) - greatest(0, difficulty - 9)) AS s FROM c)
SELECT l_orderkey, difficulty, ones::INTEGER AS ones, s::INTEGER AS successes, CASE WHEN s <= 0 AND ones > 0 AND raw = 0 THEN 'botch' WHEN s <= 0 THEN 'failure' WHEN s >= 4 THEN 'critical' WHEN s >= 2 THEN 'success' ELSE 'mixed' END AS outcome FROM n""")
def grade_pools(spark, sf):
    # dice of an order: one per line, from the part number
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_partkey") % 10 + 1).cast("int")).alias("dice"))
    r = li.withColumn("difficulty", (F.col("l_orderkey") % 6 + 5).cast("int"))
    return actions.grade_pools(r).drop("dice")


STAT_PAIRS = [("sneak", "dexterity", "stealth"), ("attack", "strength", "brawl"), ("talk", "charisma", "wits")]


@job(f"""WITH s AS (SELECT user_id AS campaign_id, CASE event_type WHEN 'click' THEN 'dexterity' WHEN 'view' THEN 'stealth' WHEN 'error' THEN 'strength' WHEN 'purchase' THEN 'wits' ELSE 'charisma' END AS stat, (count(*) % 5)::INTEGER AS v FROM events GROUP BY ALL),
a AS (SELECT campaign_id, ord, {sql_case('action', [(v, x) for v, x, _ in STAT_PAIRS], "'wits'")} AS s1, {sql_case('action', [(v, y) for v, _, y in STAT_PAIRS], "'alertness'")} AS s2 FROM {PROP_SQL})
SELECT ord, s1 || '+' || s2 AS stat_pair, greatest(1, coalesce((SELECT v FROM s WHERE s.campaign_id = a.campaign_id AND stat = s1), 0) + coalesce((SELECT v FROM s WHERE s.campaign_id = a.campaign_id AND stat = s2), 0))::INTEGER AS pool FROM a""")
def pool_size(spark, sf):
    names = [("click", "dexterity"), ("view", "stealth"), ("error", "strength"), ("purchase", "wits")]
    e = table(spark, sf, "events")
    stats = e.groupBy(F.col("user_id").alias("campaign_id"), T.first_in(F.col("event_type"), names, "charisma").alias("stat")).agg((F.count(F.lit(1)) % 5).cast("int").alias("value"))
    return actions.pool_size(proposals(spark, sf), stats, STAT_PAIRS).select("ord", "stat_pair", "pool")


def threat_sides(spark, sf):
    o = order_facts(spark, sf).withColumn("campaign_id", F.col("campaign_id") * 3)
    n = views.capabilities(npcs(spark, sf)).withColumn("campaign_id", (F.col("campaign_id") * 5).cast("bigint"))
    return actions.threatened(n, views.pending_threats(o), views.active_situations(o))


THREAT = f"""thr AS (SELECT DISTINCT o_custkey * 3 AS campaign_id FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus <> 'P'
UNION SELECT o_custkey * 3 FROM orders WHERE o_orderkey % 2 = 1 AND o_orderstatus = 'O'
UNION SELECT c_nationkey::BIGINT * 5 FROM customer WHERE c_custkey % 4 <> 0 AND c_nationkey < 10 AND {LEVEL} IN ('high', 'extreme'))"""
GRADE = "CASE event_type WHEN 'error' THEN CASE WHEN k % 9 = 0 THEN 'botch' ELSE 'failure' END WHEN 'view' THEN 'mixed' WHEN 'signup' THEN 'critical' ELSE 'success' END"
TIERED = f"""{THREAT}, td AS (SELECT p.*, {GRADE} AS outcome, greatest(CASE WHEN t.campaign_id IS NOT NULL THEN 2 WHEN k % 2 = 1 THEN 1 ELSE 0 END, CASE WHEN {GRADE} = 'botch' THEN 2 ELSE 0 END) AS tier
FROM {PROP_SQL} p LEFT JOIN thr t USING (campaign_id))"""


def graded(spark, sf):
    e = F.col("event_type")
    out = F.when(e == "error", F.when(F.col("k") % 9 == 0, "botch").otherwise("failure")).when(e == "view", "mixed").when(e == "signup", "critical").otherwise("success")
    p = proposals(spark, sf).withColumn("outcome", out)
    p = p.withColumn("risk_flags", F.when(F.col("k") % 2 == 1, F.array(F.lit("contested"))).otherwise(F.array().cast("array<string>")))
    m = F.col("campaign_id") % 4
    p = p.withColumn("failure_mode", F.when(m == 0, "forgiving").when(m == 1, "punishing").when(m == 2, "odd").otherwise("consequential"))
    return actions.severity(p, threat_sides(spark, sf))


@job(f"WITH {TIERED} SELECT ord, outcome, tier::INTEGER AS tier FROM td")
def severity(spark, sf):
    return graded(spark, sf).select("ord", "outcome", "tier")


FAIL_ROWS = ", ".join(f"({quote(m)}, {quote(c)}, {quote(x)}, {d})" for m, c, x, d in fixed.FAILURE_EFFECTS)
EFF = f"""{TIERED}, md AS (SELECT *, CASE campaign_id % 4 WHEN 0 THEN 'forgiving' WHEN 1 THEN 'punishing' ELSE 'consequential' END AS mode, action IN {sql_list(fixed.FAILURE_COMBAT_VERBS)} AS fc FROM td),
fe AS (SELECT ord, action, tier, counter, CASE WHEN counter = 'time' THEN -abs(d) ELSE d END AS delta FROM md JOIN (VALUES {FAIL_ROWS}) r(m, cat, counter, d)
  ON m = mode AND cat = CASE WHEN fc AND mode <> 'forgiving' THEN 'combat' ELSE 'default' END WHERE outcome IN ('failure', 'botch'))"""


@job(f"""WITH {EFF} SELECT ord, counter, delta::BIGINT AS delta, 'failure' AS source FROM fe
UNION ALL SELECT ord, 'harm', 1, 'failure' FROM md WHERE outcome IN ('failure', 'botch') AND tier >= 2 AND action IN {sql_list(fixed.TIER2_HARM_VERBS)} AND ord NOT IN (SELECT ord FROM fe WHERE counter = 'harm')
UNION ALL SELECT ord, 'heat', 1, 'failure' FROM md WHERE outcome IN ('failure', 'botch') AND tier >= 2 AND action IN {sql_list(fixed.STEALTH_VERBS)}
UNION ALL SELECT ord, CASE WHEN action IN {sql_list(fixed.COMPLICATION_COMBAT_VERBS)} THEN 'heat' ELSE 'time' END,
 (CASE WHEN mode = 'punishing' THEN 2 ELSE 1 END) * (CASE WHEN action IN {sql_list(fixed.COMPLICATION_COMBAT_VERBS)} THEN 1 ELSE -1 END), 'complication' FROM md WHERE outcome = 'mixed'""")
def effects(spark, sf):
    return actions.effects(graded(spark, sf)).select("ord", "counter", "delta", "source")


@job(f"""WITH {TIERED} SELECT ord, target AS b_id, (CASE WHEN outcome IN ('failure', 'botch') THEN -1 ELSE 1 END)::BIGINT AS delta FROM td WHERE target <> 'scene' AND
CASE WHEN outcome IN ('failure', 'botch') THEN action IN {sql_list(fixed.TRUST_DOWN_VERBS)} ELSE action IN {sql_list(fixed.TRUST_UP_VERBS)} END""")
def trust_changes(spark, sf):
    return actions.trust_changes(graded(spark, sf)).select("ord", "b_id", "delta")


COND_ROWS = ", ".join(f"({quote(v)}, {quote(c)})" for v, c in fixed.CONDITION_OF)
CLEAR_ROWS = ", ".join(f"({quote(x[:-8])}, {quote(c)})" for c, xs in fixed.CLEARED_BY for x in xs if x.endswith("_success"))


@job(f"""WITH RECURSIVE {TIERED}, ev AS (SELECT campaign_id, ord, cond, tier >= 2 AS hard, FALSE AS ends FROM td JOIN (VALUES {COND_ROWS}) r(v, cond) ON v = action WHERE outcome IN ('failure', 'botch')
UNION ALL SELECT campaign_id, ord, cond, FALSE, TRUE FROM td JOIN (VALUES {CLEAR_ROWS}) r(v, cond) ON v = action WHERE outcome NOT IN ('failure', 'botch')),
n AS (SELECT *, row_number() OVER (PARTITION BY campaign_id, cond ORDER BY ord) AS i FROM ev),
w AS (SELECT campaign_id, cond, i, ord, ends, NOT ends AS live, CASE WHEN ends THEN NULL ELSE ord END AS opened, NOT ends AND hard AS sev FROM n WHERE i = 1
 UNION ALL SELECT n.campaign_id, n.cond, n.i, n.ord, n.ends, NOT n.ends, CASE WHEN n.ends THEN w.opened WHEN w.live THEN w.opened ELSE n.ord END,
   CASE WHEN n.ends THEN w.live AND w.sev WHEN w.live THEN w.sev OR n.hard ELSE n.hard END FROM w JOIN n ON n.campaign_id = w.campaign_id AND n.cond = w.cond AND n.i = w.i + 1),
p AS (SELECT *, lag(live) OVER (PARTITION BY campaign_id, cond ORDER BY i) AS was FROM w)
SELECT campaign_id, cond AS condition, opened, max(ord) FILTER (ends AND was) AS closed, bool_or(sev) AS hard FROM p WHERE live OR (ends AND was) GROUP BY campaign_id, cond, opened""")
def situation_intervals(spark, sf):
    out = actions.situation_intervals(graded(spark, sf), ["ord"], ordered.steps("ord"))
    return out.select("campaign_id", "condition", F.col("opened.ord").alias("opened"), F.col("closed.ord").alias("closed"), "hard")


STREAK = f"""nt AS (SELECT campaign_id, turn_no, outcome, row_number() OVER (PARTITION BY campaign_id ORDER BY turn_no) AS rn FROM {ACT_SQL}),
sk AS (SELECT a.campaign_id, a.turn_no, a.outcome, a.rn, (SELECT count(*) FROM nt b WHERE b.campaign_id = a.campaign_id AND b.rn < a.rn AND b.rn >= a.rn - 10 AND b.outcome = 'failure'
  AND b.rn > coalesce((SELECT max(c.rn) FROM nt c WHERE c.campaign_id = a.campaign_id AND c.rn < a.rn AND c.outcome = 'success'), 0)) AS streak_before FROM nt a)"""


def streaks(spark, sf):
    t = acts(spark, sf).select("campaign_id", "turn_no", "outcome")
    return actions.running_streak(t, ["turn_no"], ordered.steps("turn_no", 20_000))


@job(f"WITH {STREAK} SELECT campaign_id, turn_no, streak_before FROM sk")
def running_streak(spark, sf):
    return streaks(spark, sf).select("campaign_id", "turn_no", "streak_before")


@job(f"""WITH {STREAK}, {THREAT} SELECT turn_no, CASE WHEN streak_before + 1 >= 3 THEN 'threat_resolved' ELSE 'warning' END AS alert FROM sk
WHERE outcome = 'failure' AND streak_before >= 1 AND campaign_id IN (SELECT campaign_id FROM thr)""")
def streak_alerts(spark, sf):
    return actions.streak_alerts(streaks(spark, sf), threat_sides(spark, sf)).select("turn_no", "alert")


@job(f"""SELECT campaign_id, arg_min(entity_id, (-CASE {LEVEL} WHEN 'extreme' THEN 4 WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END, ord)) AS entity_id FROM {NPC_SQL} WHERE type = 'npc' GROUP BY ALL""")
def primary_threat(spark, sf):
    kinds = [("BUILDING", "high"), ("FURNITURE", "extreme"), ("MACHINERY", "moderate")]
    n = npcs(spark, sf).filter("type = 'npc'").join(table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("entity_id"), T.first_in(F.col("c_mktsegment"), kinds, "low").alias("threat_level")), "entity_id")
    return actions.primary_threat(n).select("campaign_id", "entity_id")


KW = [("heat", ["the ", "und "]), ("time", ["que", "token"]), ("harm", ["license"])]


@job(f"""SELECT doc_id, CASE {' '.join(f"WHEN {' OR '.join(f'contains(lower(text), {quote(w)})' for w in ws)} THEN {quote(c)}" for c, ws in KW)} END AS counter FROM documents""")
def keyword_counter(spark, sf):
    return actions.keyword_counter(table(spark, sf, "documents"), "text", KW).select("doc_id", "counter")
