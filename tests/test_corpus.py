"""Structure, segmentation and extraction on small documents."""
from pyspark.sql import functions as F

from scrollwork.functions import text as T
from scrollwork.operators import chunks, mechanics, pages, segments, structure


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).collect()[0].v


def test_text_helpers(spark):
    assert one(spark, T.slugify(F.lit("The Neon Bar & Grill"))) == "the_neon_bar_grill"
    assert one(spark, T.slugify(F.lit(" --- "))) == "untitled"
    assert one(spark, T.word_count(F.lit("  a b\n c "))) == 3
    assert one(spark, T.word_count(F.lit(""))) == 0
    assert one(spark, T.title_case(F.lit("HELLO o'neil 3rd élan"))) == "hello o'neil 3rd élan".title()
    assert one(spark, T.token_estimate(F.lit("a " * 100))) == 133
    assert T.lowered(r"\bDC\S+\W") == r"\bdc\S+\W"


def test_ascii_form_keeps_word_boundaries(spark):
    import re

    pats = [r"\bbar\b", r"\b\d+\b", r"a\s+b"]
    for text in ["bar ébar baré, bar", "3 ٣ é3 a\u00a0b", "plain bar 12 a b"]:
        want = sum(len(re.findall(p, text)) for p in pats)
        assert one(spark, T.patterns_total(T.ascii_form(F.lit(text)), pats, False, "")) == want


def test_two_columns(spark):
    rows = [("full", 0, 0.0, 10.0, 590.0), ("L1", 1, 50.0, 20.0, 280.0), ("R1", 2, 40.0, 320.0, 580.0), ("L2", 3, 90.0, 20.0, 280.0), ("foot", 4, 200.0, 10.0, 590.0)]
    b = spark.createDataFrame([("d", 1, o, x0, y, x1, t, 600.0) for t, o, y, x0, x1 in rows], "doc_id string, page_num long, ord int, x0 double, y0 double, x1 double, text string, page_width double")
    assert pages.reorder_columns(b).collect()[0].text == "full\n\nL1\n\nL2\n\nR1\n\nfoot"


def test_repeated_lines_are_found_and_stripped(spark):
    p = spark.createDataFrame([("d", i, f"RUNNING HEAD {i}\nbody {'x' * i}\n{i}\nThe Publisher") for i in range(1, 9)], "doc_id string, page_num long, text string")
    rep = pages.repeated_lines(p)
    assert {"RUNNING HEAD", "The Publisher"} <= {r.line for r in rep.collect()}
    assert pages.strip_lines(p, rep).filter("page_num = 3").collect()[0].text == "body xxx"


def test_headings_to_sections(spark):
    p = spark.createDataFrame([("d", 1, "# One\nintro"), ("d", 2, "## Sub\ntext"), ("d", 3, "more"), ("d", 4, "ALL CAPS TITLE\n1. Numbered Part")], "doc_id string, page_num long, text string")
    s = structure.nest_sections(structure.section_ranges(structure.text_headings(p), p))
    got = [(r.title, r.page_start, r.page_end, r.parent_id) for r in s.orderBy("page_num", "line_no").collect()]
    assert got == [("One", 1, 1, None), ("Sub", 2, 3, "1:0"), ("All Caps Title", 4, 4, None), ("Numbered Part", 4, 4, None)]


def test_packing_keeps_oversized_paragraphs(spark):
    paras = ["a " * 5, "b " * 4, "c " * 30, "d " * 2]
    df = spark.createDataFrame([("\n\n".join(paras),)], "content string")
    assert [r.part_words for r in segments.pack_units(df, 10).orderBy("part_no").collect()] == [9, 30, 2]


def test_small_segments_merge_in_pairs(spark):
    sizes = [10, 20, 500, 30, 40, 50, 60]
    df = spark.createDataFrame([("d", i, "t", "w " * n, n) for i, n in enumerate(sizes)], "doc_id string, seg_no long, title string, content string, word_count int")
    assert [r.word_count for r in segments.enforce_sizes(df, 100, 1000).orderBy("seg_no").collect()] == [30, 500, 70, 110]


def test_chunk_ids_and_headers(spark):
    body = "lead\n# One\na\n### deep\nb\n## Two\n\n## Two\nlast"
    f = spark.createDataFrame([("p", "x.md", "npc", "My File", "e1", body, ["t"], ["e2"])], "pack_id string, path string, file_type string, title string, entity_id string, body string, tags array<string>, entity_refs array<string>")
    got = {r.chunk_id: r.content for r in chunks.chunk(f).collect()}
    assert got == {"p:e1:overview": "lead", "p:e1:one": "a\n### deep\nb", "p:e1:two": "last"}


def test_rule_text(spark):
    text = "Heat clock: 2/8\nat 4: police arrive\nStunned: lose a turn\nRoll 5d10, 3d10 and 1d6. Difficulty is 7. Ones cancel.\nEasy (3)"
    d = spark.createDataFrame([("d", 1, text)], "doc_id string, part_no long, text string")
    got = {(r.field, r.name, r.value) for f in (mechanics.extract_counters, mechanics.extract_conditions, mechanics.extract_resolution) for r in f(d).collect()}
    assert {("clocks", "Heat", "2/8"), ("triggers", "4", "police arrive"), ("conditions", "stunned", "lose a turn"), ("die_type", None, "10"),
            ("default_difficulty", None, "7"), ("ones_cancel", None, "true"), ("difficulty_scale", "Easy", "3")} <= got


def test_cycles(spark):
    e = spark.createDataFrame([("d", "a", "b"), ("d", "b", "c"), ("d", "c", "a"), ("x", "a", "b"), ("x", "b", "c")], "doc_id string, a string, b string")
    assert {r.doc_id for r in mechanics.find_cycles(e).collect()} == {"d"}


def test_penalty_ladder(spark):
    text = "Scraped 0 penalty Shaken then -1 dice Winded so -2\nno number here at all\nHurt (-5)"
    d = spark.createDataFrame([("d", 1, text), ("e", 1, "Shaken by 0 and Winded by -1 only")], "doc_id string, part_no long, text string")
    got = {(r.doc_id, r.name, r.value) for r in mechanics.extract_health(d).filter("field = 'health_levels'").collect()}
    assert got == {("d", "Hurt", "-5")}
    ladder = spark.createDataFrame([("d", 1, "Scraped 0 penalty Shaken then -1 dice Winded so 0 or Fine at -1")], "doc_id string, part_no long, text string")
    assert mechanics.extract_health(ladder).filter("field = 'health_levels'").count() == 0


def test_the_first_rule_wins_over_the_first_part(spark):
    from scrollwork.operators import mechanics

    texts = spark.createDataFrame(
        [("d", 1, "Roll a d20. You have 12 damage points. Roll dice to soak. Strength matters."), ("d", 2, "The dice pool counts successes. Mark a health level. Roll stamina to soak. Dexterity helps.")],
        "doc_id string, part_no long, text string",
    )
    got = {(r.extractor, r.field): r.value for f in (mechanics.extract_resolution, mechanics.extract_health) for r in f(texts).collect() if r.name is None}
    assert got[("resolution", "method")] == "dice_pool"
    assert got[("health", "health_track_type")] == "levels"
    assert got[("health", "soak")] == "stamina"
    stats = {r.name: r.value for r in mechanics.extract_stats(texts).collect() if r.field == "attributes"}
    assert "strength,dexterity,stamina" in stats.values()


def test_backgrounds_keep_their_heading(spark):
    from scrollwork.operators import mechanics

    texts = spark.createDataFrame([("d", 1, "Backgrounds:\nAllies\nContacts\nResources\n\nOther Things")], "doc_id string, part_no long, text string")
    got = [r.name for r in mechanics.extract_stats(texts).collect() if r.field == "backgrounds"]
    assert "Resources" in got and "Other Things" not in got


def test_confidence_counts_grouped_fields(spark):
    from scrollwork.operators import mechanics

    rows = [("magic", "casting_stat"), ("magic", "spell_schools"), ("magic", "resource_pools"), ("resolution", "threshold_a"), ("resolution", "threshold_b"), ("equipment", "armor"), ("equipment", "tiered_armor")]
    found = spark.createDataFrame([("d", e, f) for e, f in rows], "doc_id string, extractor string, field string")
    got = {r.extractor: r.confidence for r in mechanics.extraction_confidence(found).collect()}
    assert got == {"magic": 0.5, "resolution": 0.4, "equipment": 0.5}
