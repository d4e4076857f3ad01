"""Source and sink jobs that have an SQL statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrollwork.functions import fixed, text as T
from scrollwork.plans import bind
from scrollwork.plans.bind import sql_words
from scrollwork.plans.registry import job, table
from scrollwork.sources import files, tables


@job("SELECT source AS doc_id, doc_id AS page_num FROM documents WHERE doc_id BETWEEN 10 AND 90 OR doc_id = 5 OR doc_id BETWEEN 700 AND 100000")
def select_pages(spark, sf):
    # the page specification is the feature here
    return files.select_pages(bind.doc_pages(spark, sf), "10-90,5,700-100000").select("doc_id", "page_num")


LINE_SQL = "(SELECT l_orderkey, l_partkey, l_quantity::BIGINT AS qty, l_linenumber, l_shipmode FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem))"


def stock(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").cast("bigint").alias("qty"), F.col("p_brand").alias("label"))


def moves(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("item_id"), F.col("l_quantity").cast("bigint").alias("qty"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("label"), "l_orderkey", "l_linenumber"
    )


MOVES = """mv AS (SELECT l_partkey AS item_id, l_quantity::BIGINT AS qty, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS label, l_orderkey AS o, l_linenumber AS n FROM lineitem),
al AS (SELECT p_partkey AS item_id, p_size::BIGINT AS qty, p_brand AS label, -1 AS o, 0 AS n FROM part UNION ALL SELECT * FROM mv)"""


@job(f"WITH {MOVES}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY o DESC, n DESC) AS r FROM al) SELECT item_id, qty FROM r WHERE r = 1")
def upsert_replace(spark, sf):
    return tables.upsert(stock(spark, sf), moves(spark, sf), ["item_id"], "replace", ["l_orderkey", "l_linenumber"]).select("item_id", "qty")


@job(f"WITH {MOVES} SELECT item_id, sum(qty)::BIGINT AS qty FROM al GROUP BY item_id")
def upsert_add(spark, sf):
    return tables.upsert(stock(spark, sf), moves(spark, sf), ["item_id"], "add", ["l_orderkey", "l_linenumber"], "qty").select("item_id", "qty")


@job(f"WITH {MOVES} SELECT item_id, arg_max(qty, (o, n)) AS qty, arg_max(label, (o, n)) FILTER (label IS NOT NULL) AS label FROM al GROUP BY item_id")
def upsert_fields(spark, sf):
    return tables.upsert(stock(spark, sf), moves(spark, sf), ["item_id"], "fields", ["l_orderkey", "l_linenumber"])


@job(f"""SELECT source AS doc_id, 'classify' AS stage, '{{"rows":' || count(*) || ',"words":' || sum({sql_words('text')}) || '}}' AS metrics FROM documents GROUP BY source""")
def stage_metrics(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("doc_id"), T.word_count(F.col("text")).alias("w"))
    return tables.stage_metrics(d, "classify", ["doc_id"], words=F.sum("w"))


# a customer is a scenario; its orders are clocks, facts, threads and items
def scenarios(spark, sf):
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    arr = lambda c: F.collect_list(c)
    one = o.groupBy(F.col("o_custkey").alias("campaign_id")).agg(
        arr(F.struct(key.alias("id"), F.col("o_orderpriority").alias("name"), (F.col("o_orderkey") % 7).alias("value"), F.lit(8).alias("max"))).alias("clocks"),
        arr(F.struct(F.when(F.col("o_orderpriority") == "1-URGENT", "player").otherwise(key).alias("id"), F.lit("item").alias("type"), key.alias("name"),
                     F.when(F.col("o_orderstatus") == "F", F.array(F.lit("equipped"))).alias("tags"))).alias("entities"),
        arr(F.struct(key.alias("id"), F.lit("scene").alias("subject_id"), F.lit("due").alias("predicate"), F.when(F.col("o_orderstatus") == "O", "known").alias("visibility"))).alias("facts"),
        arr(F.struct(key.alias("id"), F.lit("t").alias("title"), F.when(F.col("o_orderstatus") == "P", "closed").alias("status"))).alias("threads"),
        arr(F.struct(F.lit("player").alias("a_id"), key.alias("b_id"), F.lit("owes").alias("rel_type"))).alias("relationships"),
        F.struct(F.min("o_orderstatus").alias("location_id")).alias("starting_scene"),
    )
    cols = [c for c in one.columns if c != "campaign_id"]
    return one.select("campaign_id", F.to_json(F.struct(*cols)).alias("doc"))


@job("""WITH p AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT 'clocks' AS part, count(*) AS n, count(*) FILTER (o_orderkey % 7 > 3) AS m FROM orders UNION ALL SELECT 'facts', count(*), count(*) FILTER (o_orderstatus <> 'O') FROM orders
UNION ALL SELECT 'threads', count(*), count(*) FILTER (o_orderstatus <> 'P') FROM orders UNION ALL SELECT 'relationships', count(*), count(*) FROM orders
UNION ALL SELECT 'entities', count(*), count(*) FILTER (o_orderpriority = '1-URGENT') FROM orders UNION ALL SELECT 'scene', count(DISTINCT o_custkey), count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'inventory', count(*), count(*) FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM p)""")
def normalize_scenarios(spark, sf):
    s = files.normalize_scenarios(scenarios(spark, sf))
    tests = {
        "clocks": F.col("value") > 3, "facts": F.col("visibility") == "world", "threads": F.col("status") == "active", "relationships": F.col("intensity") == 0,
        "entities": F.col("entity_id") == "player", "scene": F.col("noise_level") == "normal", "inventory": F.col("qty") == 1,
    }
    out = None
    for name, test in tests.items():
        one = s[name].agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.count(F.when(test, 1)).alias("m"))
        out = one if out is None else out.unionByName(one)
    return out


@job("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Front ' || o_custkey WHEN o_orderstatus = 'O' THEN 'Head ' || o_custkey ELSE 'My ' || CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' ELSE 'Order' END || ' File' END AS title,
CASE WHEN o_orderstatus = 'F' THEN 'npc' ELSE 'general' END AS type, CASE WHEN o_orderstatus = 'F' THEN 'e' || o_orderkey ELSE 'my_' || CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' ELSE 'order' END || '-file' END AS entity_id FROM orders""")
def resolve_identity(spark, sf):
    o = table(spark, sf, "orders")
    f = F.col("o_orderstatus") == "F"
    front = F.when(f, F.to_json(F.struct(F.concat(F.lit("Front "), "o_custkey").alias("title"), F.lit("npc").alias("type"), F.concat(F.lit("e"), "o_orderkey").alias("entity_id")))).otherwise("{}")
    body = F.when(F.col("o_orderstatus") == "P", "text\n# not first").otherwise(F.concat(F.lit("# Head "), "o_custkey", F.lit("\nmore")))
    stem = F.when(F.col("o_orderpriority") == "1-URGENT", "my_urgent-file").otherwise("my_order-file")
    d = o.select("o_orderkey", front.alias("front"), body.alias("body"), stem.alias("stem"), F.lit("general").alias("file_type"))
    return files.resolve_identity(d).select("o_orderkey", "title", "type", "entity_id")
