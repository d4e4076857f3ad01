"""Rule-text jobs. The invented prose holds few rules, so rule sheets are written from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrollwork.functions import fixed, text as T
from scrollwork.operators import cycles, mechanics, rules
from scrollwork.plans import bind
from scrollwork.plans.bind import quote, sql_ascii, sql_case, sql_list, sql_slug
from scrollwork.plans.registry import job, table
from scrollwork.session import cut_lineage, deal

# One sheet per part, brand by brand. {a} {b}: the words of its name; {s}: its size; {t}: its type.
LINES = [
    "{a} {b} clock: {s}/50", "at {s}: {t} rises", "{lab}: {s}", "+{m} difficulty for {b}", "stunned: lose {s} points of {b}", "attack - strike {a}",
    "roll {s}d10 or 2d6", "difficulty is {s}", "{b} damage and {a} damage", "Bruised (-1) penalty", "7-9: mixed {a}", "10+: full {b}", "sphere of {a}", "spend {a} to cast", "skill 3 points",
]
LABEL = [("ECONOMY", "Easy"), ("SMALL", "Hard"), ("STANDARD", "Routine")]


def _sql_line(line: str) -> str:
    parts = {"a": "split_part(p_name, ' ', 1)", "b": "split_part(p_name, ' ', 2)", "s": "p_size::VARCHAR", "t": "p_type", "m": "(p_size % 4 + 1)::VARCHAR", "lab": sql_case("p_type", LABEL, "'Trivial'")}
    out, rest = [], line
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        out += ([quote(head)] if head else []) + [parts[name]]
    return " || ".join(out + ([quote(rest)] if rest else []))


SHEET_SQL = "(SELECT p_brand AS doc_id, p_partkey AS part_no, p_name, p_size, p_type, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, " + " || chr(10) || ".join(_sql_line(x) for x in LINES) + " AS text FROM part)"


def parts(spark, sf):
    """Names and sizes are dealt out before the texts are made of them."""
    return deal(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")


def sheets(spark, sf):
    p = parts(spark, sf)
    cols = {
        "a": F.split_part("p_name", F.lit(" "), F.lit(1)), "b": F.split_part("p_name", F.lit(" "), F.lit(2)), "s": F.col("p_size").cast("string"), "t": F.col("p_type"),
        "m": (F.col("p_size") % 4 + 1).cast("string"), "lab": T.first_in(F.col("p_type"), LABEL, "Trivial"),
    }

    def build(line):
        out, rest = [], line
        while "{" in rest:
            head, tail = rest.split("{", 1)
            name, rest = tail.split("}", 1)
            out += ([F.lit(head)] if head else []) + [cols[name]]
        return F.concat(*out, F.lit(rest))

    return p.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("part_no"), F.concat_ws("\n", *[build(x) for x in LINES]).alias("text"))


LAB = sql_case("p_type", LABEL, "'Trivial'")


@job(f"""WITH d AS (SELECT *, {LAB} AS lab FROM {SHEET_SQL}), n AS (SELECT doc_id, p_size::VARCHAR AS v, min(part_no) AS f FROM d GROUP BY ALL)
SELECT doc_id, 'outcome_bands' AS field, '7-9' AS name, 'mixed ' || a AS value, count(*) AS n FROM d GROUP BY ALL UNION ALL SELECT doc_id, 'outcome_bands', '10+', 'full ' || b, count(*) FROM d GROUP BY ALL
UNION ALL SELECT doc_id, 'difficulty_scale', lab, p_size::VARCHAR, count(*) FROM d GROUP BY ALL
UNION ALL SELECT doc_id, 'difficulty_scale', p_type, p_size::VARCHAR, count(*) FROM d WHERE p_type = 'STANDARD' GROUP BY ALL
UNION ALL SELECT doc_id, 'default_difficulty', NULL, arg_min(p_size, part_no)::VARCHAR, 1 FROM d GROUP BY doc_id
UNION ALL SELECT doc_id, 'die_type', NULL, arg_max(v, (c, -v::INTEGER)), 1 FROM (SELECT doc_id, v, count(*) AS c FROM (SELECT doc_id, unnest(['10', '6']) AS v FROM d) GROUP BY ALL) GROUP BY doc_id""")
def extract_resolution(spark, sf):
    r = mechanics.extract_resolution(sheets(spark, sf))
    return r.groupBy("doc_id", "field", "name", "value").agg(F.count(F.lit(1)).alias("n"))


@job(rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '(\w+)\s+(?:points?|pool)', 1)) AS name FROM {SHEET_SQL})
SELECT doc_id, 'trait_pools' AS field, name, count(*)::VARCHAR AS value FROM w WHERE length(name) >= 4 AND regexp_matches(name, '^[a-z]+$') AND name NOT IN {sql_list(fixed.STOP_WORDS)} GROUP BY ALL HAVING count(*) >= 3
UNION ALL SELECT doc_id, 'advancement_costs', 'skill', '3' FROM {SHEET_SQL} GROUP BY doc_id UNION ALL SELECT doc_id, 'special_traits', 'penalty', '7-9' FROM {SHEET_SQL} GROUP BY doc_id""")
def extract_stats(spark, sf):
    return mechanics.extract_stats(sheets(spark, sf)).select("doc_id", "field", "name", "value")


@job(f"""WITH w AS (SELECT doc_id, unnest([b, a]) AS name FROM {SHEET_SQL}), c AS (SELECT doc_id, name, count(*) AS n FROM w WHERE length(name) >= 4 AND name NOT IN {sql_list(fixed.STOP_WORDS + fixed.NOT_DAMAGE_TYPES)} GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, name) AS r FROM c)
SELECT doc_id, 'damage_types' AS field, name, n::VARCHAR AS value FROM r WHERE r <= 5 UNION ALL SELECT doc_id, 'health_levels', 'Bruised', '-1' FROM {SHEET_SQL} GROUP BY doc_id""")
def extract_health(spark, sf):
    return mechanics.extract_health(sheets(spark, sf)).select("doc_id", "field", "name", "value")


def arms(spark, sf):
    p = parts(spark, sf)
    a, b = F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1))), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(2)))
    text = F.concat_ws(
        "\n", F.concat(a, F.lit(" Gun")), F.lit("5"), F.lit("2d6"), F.lit("10-20"), F.concat(F.lit("note "), b), b, F.concat(F.lit("Strength + "), F.col("p_size")), F.lit("lethal"),
        a, F.col("p_size").cast("string"), F.lit("-2"), F.concat(F.lit("class two ("), F.lower(a), F.lit(" coat)")), F.lit("4 and -1"),
    )
    return p.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("part_no"), text.alias("text"))


CAP = lambda i: f"upper(left(split_part(p_name, ' ', {i}), 1)) || lower(substr(split_part(p_name, ' ', {i}), 2))"


@job(f"""WITH p AS (SELECT p_partkey AS part_no, p_size, {CAP(1)} AS a, {CAP(2)} AS b FROM part)
SELECT part_no, 'ranged_weapons' AS field, a || ' Gun' AS name, '5 2d6 10-20' AS value FROM p UNION ALL SELECT part_no, 'melee_weapons', b, 'Strength + ' || p_size || ' lethal' FROM p
WHERE length(b) >= 3 AND lower(b) NOT IN {sql_list(fixed.STOP_WORDS)} UNION ALL SELECT part_no, 'armor', a, p_size || '/-2' FROM p WHERE length(a) >= 3 AND lower(a) NOT IN {sql_list(fixed.STOP_WORDS)}
UNION ALL SELECT part_no, 'tiered_armor', lower(a) || ' coat', '2/4/-1' FROM p""")
def extract_equipment(spark, sf):
    return mechanics.extract_equipment(arms(spark, sf)).select("part_no", "field", "name", "value")


# ---- a heading at the end of a page, its list at the head of the next one ----


def paged(spark, sf, line):
    """One page per part, brand by brand: ``line(a, b, size)``."""
    p = parts(spark, sf)
    a, b = F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1))), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(2)))
    return p.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("part_no"), F.concat(*line(a, b, F.col("p_size").cast("string"))).alias("text"))


@job(f"""WITH p AS (SELECT p_brand AS doc_id, {CAP(1)} AS a, {CAP(2)} AS b, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT doc_id, 'attributes' AS field, 'grade' AS name, array_to_string(list_filter([lower(a), lower(b), 'grade', 'attributes'], lambda x: length(x) >= 4 AND x NOT IN {sql_list(fixed.STOP_WORDS)}), ',') AS value FROM p WHERE r = 1 AND n > 1""")
def stats_across_pages(spark, sf):
    pages = paged(spark, sf, lambda a, b, s: (a, F.lit(" and "), b, F.lit(" open this page\nGrade Attributes:")))
    return mechanics.extract_stats(pages).select("doc_id", "field", "name", "value")


@job(f"""WITH p AS (SELECT p_brand AS doc_id, p_partkey AS part_no, {CAP(2)} AS b, lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS ahead FROM part)
SELECT doc_id, part_no, 'tiered_armor' AS field, lower(b) || ' coat' AS name, '2' || coalesce('/' || ahead || '/-2', '') AS value FROM p""")
def equipment_across_pages(spark, sf):
    pages = paged(spark, sf, lambda a, b, s: (s, F.lit(" and -2 stand here\nclass two ("), F.lower(b), F.lit(" coat)")))
    return mechanics.extract_equipment(pages).select("doc_id", "part_no", "field", "name", "value")


@job(rf"""WITH d AS (SELECT * FROM {SHEET_SQL}), w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM d),
s AS (SELECT DISTINCT doc_id, a FROM d WHERE length(a) >= 4 AND a NOT IN {sql_list(fixed.STOP_WORDS)}), s2 AS (SELECT doc_id, a FROM s UNION SELECT doc_id, b FROM d WHERE length(b) >= 4 AND b NOT IN {sql_list(fixed.STOP_WORDS)}),
n AS (SELECT doc_id, a, count(*) AS n FROM s2 JOIN w USING (doc_id) WHERE t = a GROUP BY ALL HAVING count(*) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, a) AS r FROM n),
m AS (SELECT doc_id, b, p_size % 4 + 1 AS m, row_number() OVER (PARTITION BY doc_id ORDER BY part_no) AS r FROM d)
SELECT doc_id, 'spell_schools' AS field, upper(left(a, 1)) || substr(a, 2) AS name, n::VARCHAR AS value FROM r WHERE r <= 15
UNION ALL SELECT doc_id, 'resource_pools', upper(left(a, 1)) || substr(a, 2), NULL FROM s
UNION ALL SELECT doc_id, 'difficulty_modifiers', b, '+' || m FROM m WHERE r <= 10 UNION ALL SELECT DISTINCT doc_id, 'casting_mechanic', NULL, '2d6 + stat' FROM d""")
def extract_magic(spark, sf):
    return mechanics.extract_magic(sheets(spark, sf)).select("doc_id", "field", "name", "value")


@job(f"""SELECT doc_id, part_no, 'clocks' AS field, p_name AS name, p_size || '/50' AS value FROM {SHEET_SQL} UNION ALL SELECT doc_id, part_no, 'triggers', p_size::VARCHAR, p_type || ' rises' FROM {SHEET_SQL}""")
def extract_counters(spark, sf):
    return mechanics.extract_counters(sheets(spark, sf)).select("doc_id", "part_no", "field", "name", "value")


@job(f"SELECT part_no, 'stunned' AS name, 'lose ' || p_size || ' points of ' || b AS value FROM {SHEET_SQL}")
def extract_conditions(spark, sf):
    return mechanics.extract_conditions(sheets(spark, sf)).select("part_no", "name", "value")


@job(f"SELECT part_no, 'attack' AS name, 'strike ' || a AS value FROM {SHEET_SQL}")
def extract_actions(spark, sf):
    return mechanics.extract_actions(sheets(spark, sf)).select("part_no", "name", "value")


@job(f"""SELECT part_no, 'presets' AS field, {LAB} AS name, p_size::VARCHAR AS value FROM {SHEET_SQL} UNION ALL SELECT part_no, 'difficulty_modifiers', b, '+' || (p_size % 4 + 1) FROM {SHEET_SQL}""")
def extract_calibration(spark, sf):
    return mechanics.extract_calibration(sheets(spark, sf)).select("part_no", "field", "name", "value")


@job(rf"""WITH t AS (SELECT DISTINCT unnest(list_filter(string_split_regex(text, '[^\pL\pN_]+'), lambda x: x <> '')) AS w FROM documents)
SELECT w FROM t WHERE length(w) >= 3 AND lower(w) NOT IN {sql_list(fixed.STOP_WORDS)} AND regexp_matches(w, '^\pL+$')""")
def valid_terms(spark, sf):
    w = table(spark, sf, "documents").select(F.explode(F.split("text", r"[^\p{L}\p{N}_]+")).alias("w")).filter("w <> ''").distinct()
    return w.filter(mechanics.valid_term(F.col("w")))


RULE_SQL = " UNION ALL ".join(
    f"SELECT source AS doc_id, {quote(s)} AS rule_set, {quote(m)} AS meaning, sum(len(regexp_extract_all({sql_ascii('text') if '●' not in p else 'text'}, {quote('(?im)' + p)})))::BIGINT AS matches FROM documents GROUP BY source" for s, p, m, _ in fixed.RULE_TABLE
)


@job(f"SELECT * FROM ({RULE_SQL}) WHERE matches > 0")
def rule_matches(spark, sf):
    return mechanics.rule_matches(table(spark, sf, "documents").select(F.col("source").alias("doc_id"), "text"))


PART_RULES = r"""(SELECT DISTINCT p_type AS rule_set, split_part(p_name, ' ', 2) AS meaning, left(split_part(p_name, ' ', 1), 2) AS pattern FROM part
UNION SELECT DISTINCT p_type, split_part(p_name, ' ', 2), '^' || left(split_part(p_name, ' ', 1), 1) || '[a-z]+' FROM part)"""


@job(f"""SELECT source AS doc_id, rule_set, meaning, sum(len(regexp_extract_all(text, '(?im)' || pattern)))::BIGINT AS matches
FROM documents, {PART_RULES} GROUP BY ALL HAVING matches > 0""")
def rule_matches_from_table(spark, sf):
    # the names of the parts are the rules: beginnings of their words, and lines that begin like them
    p = table(spark, sf, "part").select("p_type", F.split("p_name", " ").alias("w"))
    pattern = F.explode(F.array(F.left(F.col("w")[0], F.lit(2)), F.concat(F.lit("^"), F.left(F.col("w")[0], F.lit(1)), F.lit("[a-z]+"))))
    table_of_rules = p.select(F.col("p_type").alias("rule_set"), F.col("w")[1].alias("meaning"), pattern.alias("pattern")).distinct()
    return rules.rule_matches(table(spark, sf, "documents").select(F.col("source").alias("doc_id"), "text"), table_of_rules)


@job(f"""WITH h AS (SELECT doc_id, sum(len(regexp_extract_all(text, '(?im)[+-][0-9]+\\s*(bonus|penalty|modifier)?')) + len(regexp_extract_all(text, '(?im)\\b[0-9]*d[0-9]+\\b')) +
len(regexp_extract_all(text, '(?im)^[A-Z][a-z]+:\\s*[0-9]+')) + len(regexp_extract_all(text, '(?im)\\b(DC|TN|Difficulty)\\s*[0-9]+')) + len(regexp_extract_all(text, '(?im)\\b(Level|Rank|Tier)\\s*[0-9]+')))::BIGINT AS hits FROM {SHEET_SQL} GROUP BY doc_id)
SELECT doc_id, 'clocks' AS extractor, 2::BIGINT AS fields, 1::BIGINT AS key_fields, hits, round(least(0.5 + least(hits * 0.05, 0.2) + 0.1, 1.0), 2)::DOUBLE AS confidence FROM h
UNION ALL SELECT doc_id, 'conditions', 1, 1, hits, round(least(0.4 + least(hits * 0.05, 0.2) + 0.1, 1.0), 2) FROM h""")
def extraction_confidence(spark, sf):
    s = sheets(spark, sf)
    rows = mechanics.extract_counters(s).unionByName(mechanics.extract_conditions(s))
    return mechanics.extraction_confidence(rows, mechanics.rule_matches(s))


@job(f"""SELECT doc_id, 'clocks' AS extractor, 2 * count(*) AS items, 0.6::DOUBLE AS confidence, FALSE AS needs_review FROM {SHEET_SQL} GROUP BY doc_id
UNION ALL SELECT doc_id, 'action_types', count(*), 0.5, FALSE FROM {SHEET_SQL} GROUP BY doc_id""")
def extraction_report(spark, sf):
    s = sheets(spark, sf)
    rows = cut_lineage(mechanics.extract_counters(s).unionByName(mechanics.extract_actions(s)))
    r = mechanics.extraction_report(rows, mechanics.extraction_confidence(rows))
    return r.select("doc_id", "extractor", "items", "confidence", "needs_review")


@job(f"""SELECT part_no, field, name, value FROM (SELECT part_no, 'conditions' AS field, 'stunned' AS name, 'lose ' || p_size || ' points of ' || b AS value, doc_id FROM {SHEET_SQL})
UNION ALL SELECT 0, 'spell_schools', s, NULL FROM (SELECT DISTINCT doc_id FROM {SHEET_SQL}), (VALUES ('Entropy'), ('Matter')) v(s)
UNION ALL SELECT 0, 'health_levels', n, v FROM (SELECT doc_id FROM {SHEET_SQL} GROUP BY doc_id HAVING bool_or(a = 'red' OR b = 'red') AND bool_or(a = 'small' OR b = 'small')), (VALUES ('Bruised', '-1'), ('Red', '-2'), ('Small', '-3')) l(n, v)""")
def overlay_known(spark, sf):
    s = sheets(spark, sf)
    rows = mechanics.extract_conditions(s)
    sch = s.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.lit(x) for x in ("Entropy", "Matter")])).alias("name"))
    levels = [("Bruised", -1), ("Red", -2), ("Small", -3)]
    return mechanics.overlay_known(rows, None, s, sch, levels).select("part_no", "field", "name", "value")


@job(f"""SELECT doc_id, 'default_difficulty' AS field, NULL AS name, '99' AS value FROM {SHEET_SQL} GROUP BY doc_id
UNION ALL SELECT DISTINCT doc_id, 'conditions', 'stunned', 'lose ' || p_size || ' points of ' || b FROM {SHEET_SQL} UNION ALL SELECT DISTINCT doc_id, 'conditions', 'stunned', 'new' FROM {SHEET_SQL}""")
def merge_extractions(spark, sf):
    s = sheets(spark, sf)
    # both sides are made of the same rows, which are extracted once
    c = cut_lineage(mechanics.extract_conditions(s))
    a = c.unionByName(cut_lineage(mechanics.extract_resolution(s).filter("field = 'default_difficulty'")))
    b = a.withColumn("value", F.when(F.col("name").isNull(), "99").otherwise("new"))
    b = b.unionByName(c)
    return mechanics.merge_extractions(a, b).select("doc_id", "field", "name", "value")


@job(f"""WITH c AS (SELECT doc_id, replace(p_name, ' ', '_') AS counter, arg_max(p_size, part_no)::BIGINT AS value, 50::BIGINT AS max FROM {SHEET_SQL} GROUP BY ALL),
t AS (SELECT doc_id, p_size::VARCHAR AS threshold, arg_max(p_type || ' rises', part_no) AS effect FROM {SHEET_SQL} GROUP BY ALL)
SELECT doc_id, counter, value, max, threshold, effect FROM c JOIN t USING (doc_id)""")
def assemble_configs(spark, sf):
    c = mechanics.assemble_configs(cut_lineage(mechanics.extract_counters(sheets(spark, sf))))
    return c["triggers"].join(c["counters"], ["doc_id", "counter"]).select("doc_id", "counter", "value", "max", "threshold", "effect")


@job("""WITH c AS (SELECT p_brand AS doc_id, 'k' || p_partkey AS counter, (p_size - 5)::BIGINT AS value, (p_size % 9 * 5)::BIGINT AS mx, CASE WHEN p_type = 'SMALL' THEN 'soon' ELSE (p_size - 3)::VARCHAR END AS lim FROM part)
SELECT counter, 'max_not_positive' AS issue, mx::DOUBLE AS value FROM c WHERE mx <= 0 UNION ALL SELECT counter, 'negative_value', value FROM c WHERE value < 0 UNION ALL SELECT counter, 'value_over_max', value FROM c WHERE value > mx
UNION ALL SELECT counter, 'threshold_not_a_number', 0 FROM c WHERE lim = 'soon' UNION ALL SELECT counter, 'threshold_out_of_range', TRY_CAST(lim AS BIGINT) FROM c WHERE TRY_CAST(lim AS BIGINT) < 0 OR TRY_CAST(lim AS BIGINT) > mx""")
def check_counters(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_brand").alias("doc_id"), F.concat(F.lit("k"), "p_partkey").alias("counter"), (F.col("p_size") - 5).cast("bigint").alias("value"), (F.col("p_size") % 9 * 5).cast("bigint").alias("max"),
        F.when(F.col("p_type") == "SMALL", "soon").otherwise((F.col("p_size") - 3).cast("string")).alias("threshold"),
    )
    return mechanics.check_counters(p.drop("threshold"), p.select("doc_id", "counter", "threshold")).select("counter", "issue", "value")


@job("""WITH b AS (SELECT DISTINCT s_nationkey AS doc_id, (s_suppkey % 40)::INTEGER AS low, CASE WHEN s_acctbal > 9000 THEN 99 ELSE (s_suppkey % 40 + 3)::INTEGER END AS high FROM supplier),
n AS (SELECT *, lead(low) OVER (PARTITION BY doc_id ORDER BY low, high) AS nx FROM b) SELECT doc_id, high + 1 AS gap_from, nx - 1 AS gap_to FROM n WHERE nx > high + 1""")
def band_gaps(spark, sf):
    s = table(spark, sf, "supplier")
    low = F.col("s_suppkey") % 40
    r = F.when(F.col("s_acctbal") > 9000, F.concat(low, F.lit("+"))).otherwise(F.concat(low, F.lit("-"), low + 3))
    return mechanics.band_gaps(s.select(F.col("s_nationkey").alias("doc_id"), r.alias("range")))


@job("""SELECT 'missing_threat_level' AS issue, p_name AS name, count(*) AS n FROM part WHERE p_type = 'SMALL' GROUP BY p_name UNION ALL SELECT 'missing_effect', p_brand, count(*) FROM part WHERE p_size > 40 GROUP BY p_brand
UNION ALL SELECT 'no_lore_entity', p_name, count(*) FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_name = p.p_name AND q.p_type = 'ECONOMY') GROUP BY p_name""")
def check_templates(spark, sf):
    p = table(spark, sf, "part")
    doc = F.col("p_brand").alias("doc_id")
    t = p.select(doc, F.col("p_name").alias("name"), F.when(F.col("p_type") != "SMALL", "low").alias("threat_level"))
    c = p.select(doc, F.col("p_brand").alias("name"), F.when(F.col("p_size") <= 40, "x").alias("effect"))
    e = p.filter("p_type = 'ECONOMY'").select(doc, F.replace("p_name", F.lit(" "), F.lit("_")).alias("entity_id")).distinct()
    return mechanics.check_templates(t, c, e).groupBy("issue", "name").agg(F.count(F.lit(1)).alias("n"))


EDGE = """ed AS (SELECT DISTINCT a.s_nationkey % 5 AS doc_id, 's' || a.s_suppkey || '.' AS a, 's' || b.s_suppkey || '.' AS b FROM supplier a JOIN supplier b ON a.s_nationkey % 5 = b.s_nationkey % 5 AND a.s_suppkey <> b.s_suppkey
AND contains('raise S' || (a.s_suppkey + 25) || '. and s' || (a.s_suppkey * 2) || '. and s' || (a.s_suppkey // 3) || '.', 's' || b.s_suppkey || '.') OR
(a.s_nationkey % 5 = b.s_nationkey % 5 AND a.s_suppkey <> b.s_suppkey AND b.s_suppkey = a.s_suppkey + 25))"""


def nets(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    c = s.select((F.col("s_nationkey") % 5).alias("doc_id"), F.concat(F.lit("s"), k, F.lit(".")).alias("counter"))
    eff = F.concat(F.lit("raise S"), k + 25, F.lit(". and s"), k * 2, F.lit(". and s"), F.floor(k / 3), F.lit("."))
    return c, s.select((F.col("s_nationkey") % 5).alias("doc_id"), F.concat(F.lit("s"), k, F.lit(".")).alias("counter"), eff.alias("effect"))


@job(f"WITH {EDGE} SELECT doc_id, a, b FROM ed")
def counter_edges(spark, sf):
    return mechanics.counter_edges(*nets(spark, sf))


@job(f"""WITH RECURSIVE {EDGE}, tc AS (SELECT doc_id, a, b FROM ed UNION SELECT tc.doc_id, tc.a, ed.b FROM tc JOIN ed ON ed.doc_id = tc.doc_id AND ed.a = tc.b)
SELECT DISTINCT doc_id FROM tc WHERE a = b""")
def circular_documents(spark, sf):
    return mechanics.find_cycles(mechanics.counter_edges(*nets(spark, sf))).select("doc_id").distinct()


CLOSURE = f"""WITH RECURSIVE {EDGE}, tc AS (SELECT doc_id, a, b FROM ed UNION SELECT tc.doc_id, tc.a, ed.b FROM tc JOIN ed ON ed.doc_id = tc.doc_id AND ed.a = tc.b)"""


@job(f"{CLOSURE} SELECT x.doc_id, x.a AS node, min(x.b) AS component FROM tc x JOIN tc y ON y.doc_id = x.doc_id AND y.a = x.b AND y.b = x.a GROUP BY x.doc_id, x.a")
def cycle_members(spark, sf):
    return cycles.cycle_members(mechanics.counter_edges(*nets(spark, sf)))


@job(f"{CLOSURE} SELECT e.doc_id, e.a, e.b FROM ed e JOIN tc ON tc.doc_id = e.doc_id AND tc.a = e.b AND tc.b = e.a")
def circular_edges(spark, sf):
    return mechanics.find_cycles(mechanics.counter_edges(*nets(spark, sf)))


@job(f"""SELECT DISTINCT source AS doc_id, doc_id AS page_num FROM documents d WHERE EXISTS (SELECT 1 FROM documents e WHERE e.source = d.source AND e.lang = 'en' AND d.doc_id BETWEEN e.doc_id AND e.doc_id + 3)""")
def mechanics_pages(spark, sf):
    d = table(spark, sf, "documents")
    segs = d.select(F.col("source").alias("doc_id"), F.when(F.col("lang") == "en", "both").otherwise("lore").alias("route"), F.col("doc_id").alias("page_start"), (F.col("doc_id") + 3).alias("page_end"))
    return mechanics.mechanics_pages(segs, bind.doc_pages(spark, sf)).select("doc_id", "page_num")
