import json

from scrollwork.sources import files, tables


def test_markdown_corpus(spark, tmp_path):
    (tmp_path / "npcs").mkdir()
    (tmp_path / "npcs" / "jin_tanaka.md").write_text("---\ntitle: Jin\ntags: [a, b]\nentity_refs: [x]\n---\nHello")
    (tmp_path / "npcs" / "bad.md").write_text("---\n: [\n---\nBody")
    (tmp_path / "lone-file.md").write_text("text\n# Not first")
    (tmp_path / "README.md").write_text("no")
    d = files.resolve_identity(files.split_frontmatter(files.scan_markdown(spark, str(tmp_path))))
    got = {r.stem: (r.title, r.type, r.entity_id, r.tags, r.body) for r in d.collect()}
    assert got["jin_tanaka"] == ("Jin", "npc", "jin_tanaka", ["a", "b"], "Hello")
    assert got["bad"][0] == "Bad" and got["bad"][4].startswith("---")
    assert got["lone-file"] == ("Lone File", "general", "lone-file", [], "text\n# Not first")


def test_manifests_pages_and_registry(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1" / "pack.yaml").write_text("id: p1\nname: One\nextra: 5\n")
    (tmp_path / "p2").mkdir()
    (tmp_path / "p2" / "pack.yaml").write_text("[broken")
    (m,) = files.scan_manifests(spark, str(tmp_path)).collect()
    assert (m.id, m.version, m.layer, m.metadata) == ("p1", "1.0", "adventure", {"extra": "5"})
    doc = tmp_path / "doc" / "pages"
    doc.mkdir(parents=True)
    for i in (1, 2, 3):
        (doc / f"page_{i:04d}.md").write_text(f"page {i}")
    (tmp_path / "doc" / "page_map.json").write_text(json.dumps({"2": {"char_count": 6, "has_images": True, "ocr_used": False}}))
    p = files.scan_pages(spark, str(tmp_path / "doc" / ".."))
    assert {(r.page_num, r.text, r.has_images) for r in files.select_pages(p, "2-9,1").collect()} == {(1, "page 1", None), (2, "page 2", True), (3, "page 3", None)}
    (tmp_path / "reg.json").write_text(json.dumps({"entities": [{"id": "e", "name": "E", "entity_type": "npc", "related_entities": ["x"]}]}))
    assert files.read_registry(spark, str(tmp_path / "reg.json")).collect()[0].related == ["x"]


def test_scenarios(spark, tmp_path):
    doc = {
        "name": "S", "clocks": [{"id": "c", "name": "Cred", "value": 5, "max": 9}],
        "entities": [{"id": "player", "type": "pc", "name": "P"}, {"id": "knife", "type": "item", "name": "K", "tags": ["equipped"]}],
        "facts": [{"id": "f", "subject_id": "player", "predicate": "is"}], "threads": [{"id": "t", "title": "T"}],
        "starting_scene": {"location_id": "bar", "present_entity_ids": ["player"]},
    }
    (tmp_path / "s.yaml").write_text(json.dumps(doc))
    s = files.normalize_scenarios(files.scan_scenarios(spark, str(tmp_path)))
    assert {r.item_id for r in s["inventory"].collect()} == {"knife", "credstick"}
    (f,) = s["facts"].collect()
    assert (f.visibility, f.confidence) == ("world", 1.0)
    assert s["threads"].collect()[0].status == "active" and s["scene"].collect()[0].location_id == "bar"


def test_tables_and_sinks(spark, tmp_path):
    old = spark.createDataFrame([("c", "player", "knife", 2)], "campaign_id string, owner_id string, item_id string, qty long")
    old.write.parquet(str(tmp_path / "inventory"))
    t = tables.read_tables(spark, str(tmp_path), ["inventory"])["inventory"]
    assert t.collect()[0].flags is None
    post = spark.createDataFrame([("p", "k1", "lamp", 1), ("q", "k2", "lamp", 1)], "pack_id string, chunk_id string, term string, tf long")
    tables.write_postings(post, str(tmp_path / "post"), 4)
    tables.write_postings(post.filter("pack_id = 'p'").selectExpr("pack_id", "chunk_id", "term", "tf + 5 as tf"), str(tmp_path / "post"), 4)
    assert {(r.pack_id, r.tf) for r in tables.read_postings(spark, str(tmp_path / "post")).collect()} == {("p", 6), ("q", 1)}
    fb = spark.createDataFrame([("i", "c", 1, "thumbs_up", "v"), ("j", "c", 1, "nonsense", "v")], "id string, campaign_id string, turn_no long, feedback_type string, value string")
    tables.append_eval(fb, str(tmp_path), "feedback")
    assert spark.read.parquet(str(tmp_path / "eval_feedback")).count() == 1
