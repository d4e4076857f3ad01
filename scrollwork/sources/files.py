"""Markdown corpora, manifests, page folders, registries and scenario documents."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from scrollwork.functions import fixed, text as T


T_YAML = StructType([StructField("status", StringType()), StructField("json", StringType())])


def _load(block: str):
    """YAML; a JSON object is YAML too and needs no parser for it. Without PyYAML anything else raises."""
    try:
        return json.loads(block)
    except ValueError:
        pass
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("front matter in YAML needs the PyYAML package") from e
    return yaml.safe_load(block)


@F.pandas_udf(T_YAML)
def yaml_to_json(blocks: pd.Series) -> pd.DataFrame:
    """``status`` is ``map``, ``other`` (valid, but no map) or ``bad``; one Arrow batch at a time."""
    out = []
    for block in blocks:
        try:
            got = _load(block) if block is not None else None
            got = {} if got is None else got
            out.append(("map" if isinstance(got, dict) else "other", json.dumps(got, default=str)))
        except RuntimeError:
            raise
        except Exception:
            out.append(("bad", None))
    return pd.DataFrame(out, columns=["status", "json"])


def _whole(spark: SparkSession, root: str, glob: str) -> DataFrame:
    d = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return d.select(F.col("_metadata.file_path").alias("path"), "value")


def scan_markdown(spark: SparkSession, root: str) -> DataFrame:
    """``path, stem, file_type, value`` of every markdown file but README.md; the parent folder gives the type."""
    d = _whole(spark, root, "*.md")
    parts = F.split("path", "/")
    d = d.withColumn("name", F.element_at(parts, -1)).withColumn("dir", F.element_at(parts, -2)).filter(F.col("name") != "README.md")
    return d.select(
        "path", F.regexp_replace("name", r"\.md$", "").alias("stem"), T.first_in(F.col("dir"), fixed.DIR_TYPES, "general").alias("file_type"), "value"
    )


FRONT = r"(?s)\A---(.*?)---(.*)\z"


def split_frontmatter(df: DataFrame, col: str = "value") -> DataFrame:
    """Add ``front`` (JSON), ``has_front``, ``front_is_map`` and ``body``.

    Text without a front block, or with a bad one, keeps its whole text as the body.
    """
    has = F.col(col).rlike(FRONT)
    d = df.withColumn("has_front", has).withColumn("__y", yaml_to_json(F.when(has, F.regexp_extract(col, FRONT, 1))))
    fine = F.col("has_front") & (F.col("__y.status") != "bad")
    return (
        d.withColumn("front_is_map", fine & (F.col("__y.status") == "map"))
        .withColumn("front", F.when(F.col("front_is_map"), F.col("__y.json")).otherwise("{}"))
        .withColumn("body", T.strip(F.when(fine, F.regexp_extract(col, FRONT, 2)).otherwise(F.col(col))))
        .drop("__y")
    )


def _str(name: str, col: str = "front") -> Column:
    return F.nullif(F.get_json_object(col, f"$.{name}"), F.lit(""))


def _list(name: str, col: str = "front") -> Column:
    none = F.array().cast("array<string>")
    return F.coalesce(F.from_json(F.get_json_object(col, f"$.{name}"), "array<string>"), none)


def resolve_identity(df: DataFrame) -> DataFrame:
    """Title from front matter, else an H1 on the first line, else the stem; type and id likewise."""
    h1 = F.nullif(T.strip(F.regexp_extract("body", r"\A#[^\S\n]+([^\n]+)", 1)), F.lit(""))
    return df.select(
        "*",
        F.coalesce(_str("title"), h1, T.title_case(F.regexp_replace("stem", "[_-]", " "))).alias("title"),
        F.coalesce(_str("type"), "file_type").alias("type"),
        F.coalesce(_str("entity_id"), F.replace("stem", F.lit(" "), F.lit("_"))).alias("entity_id"),
        _list("tags").alias("tags"),
        _list("entity_refs").alias("entity_refs"),
    )


MANIFEST_KEYS = ["id", "name", "version", "description", "layer", "author", "dependencies", "tags"]


def scan_manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row per readable manifest, with defaults; unknown keys go to ``metadata``."""
    d = _whole(spark, root, "pack.yaml").withColumn("y", yaml_to_json("value")).filter("y.status = 'map'").withColumn("front", F.col("y.json"))
    every = F.from_json("front", "map<string,string>")
    return d.select(
        "path",
        F.coalesce(_str("id"), F.lit("")).alias("id"), F.coalesce(_str("name"), F.lit("")).alias("name"),
        F.coalesce(_str("version"), F.lit("1.0")).alias("version"), F.coalesce(_str("description"), F.lit("")).alias("description"),
        F.coalesce(_str("layer"), F.lit("adventure")).alias("layer"), F.coalesce(_str("author"), F.lit("")).alias("author"),
        _list("dependencies").alias("dependencies"), _list("tags").alias("tags"),
        F.map_filter(every, lambda k, v: ~k.isin(MANIFEST_KEYS)).alias("metadata"),
    )


def scan_pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages of every document folder ``<doc>/pages/page_NNNN.md``, with its page map where there is one."""
    d = _whole(spark, root, "page_*.md")
    pages = d.select(
        F.regexp_extract("path", r"([^/]+)/pages/[^/]+$", 1).alias("doc_id"), F.regexp_extract("path", r"page_(\d+)", 1).cast("bigint").alias("page_num"), F.col("value").alias("text")
    )
    m = _whole(spark, root, "page_map.json")
    entry = "map<string,struct<char_count:bigint,has_images:boolean,ocr_used:boolean>>"
    flags = m.select(F.regexp_extract("path", r"([^/]+)/page_map\.json$", 1).alias("doc_id"), F.explode(F.from_json("value", entry)).alias("n", "f"))
    flags = flags.select("doc_id", F.col("n").cast("bigint").alias("page_num"), "f.*")
    return pages.join(flags, ["doc_id", "page_num"], "left")


def page_ranges(spec: str) -> list[tuple[int, int]] | None:
    """Ranges of a page specification such as ``1-3,7``; ``None`` for ``all``."""
    if spec.strip().lower() == "all":
        return None
    out = []
    for part in spec.split(","):
        lo, _, hi = part.strip().partition("-")
        out.append((int(lo), int(hi or lo)))
    return out


def select_pages(pages: DataFrame, spec: str) -> DataFrame:
    """The pages a specification names. Ranges become a filter that reaches the scan."""
    ranges = page_ranges(spec)
    if ranges is None:
        return pages
    keep = F.lit(False)
    for lo, hi in ranges:
        keep = keep | F.col("page_num").between(lo, hi)
    return pages.filter(keep)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Entities of registry documents ``{"entities": [...]}``."""
    schema = """entities array<struct<id string, name string, entity_type string, description string,
        aliases array<string>, related_entities array<string>, source_segments array<string>>>"""
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    return d.select(F.inline("entities")).withColumnRenamed("id", "entity_id").withColumnRenamed("related_entities", "related")


# ---- scenario documents ----

SCENARIO = """
id string, name string, content_packs array<string>,
clocks array<struct<id string, name string, value bigint, max bigint, triggers map<string,string>, tags array<string>>>,
entities array<struct<id string, type string, name string, attrs string, tags array<string>>>,
facts array<struct<id string, subject_id string, predicate string, object string, visibility string, confidence double, tags array<string>>>,
relationships array<struct<a_id string, b_id string, rel_type string, intensity bigint, notes string>>,
threads array<struct<id string, title string, status string, stakes map<string,string>, related_entity_ids array<string>, tags array<string>>>,
starting_scene struct<location_id string, present_entity_ids array<string>, time map<string,string>, constraints map<string,string>,
    visibility_conditions string, noise_level string, obscured_entities array<string>>
"""


def scan_scenarios(spark: SparkSession, root: str) -> DataFrame:
    """Scenario YAML files as ``campaign_id, doc`` with the document in JSON."""
    d = _whole(spark, root, "*.yaml").withColumn("y", yaml_to_json("value")).filter("y.status = 'map'")
    stem = F.regexp_extract("path", r"([^/]+)\.yaml$", 1)
    return d.select(stem.alias("campaign_id"), F.col("y.json").alias("doc"))


def normalize_scenarios(docs: DataFrame) -> dict[str, DataFrame]:
    """Tables of nested scenario documents ``campaign_id, doc`` (JSON), with defaults filled in."""
    d = docs.select("campaign_id", F.from_json("doc", SCENARIO).alias("s"))
    none = F.array().cast("array<string>")
    rows = lambda name: d.select("campaign_id", F.inline(f"s.{name}"))
    fill = lambda df, **values: df.withColumns({c: F.coalesce(c, v if isinstance(v, Column) else F.lit(v)) for c, v in values.items()})
    entities = fill(rows("entities"), tags=none, attrs="{}").withColumnRenamed("id", "entity_id")
    scene = d.filter("s.starting_scene is not null").select("campaign_id", "s.starting_scene.*")
    scene = fill(scene, location_id="unknown", present_entity_ids=none, visibility_conditions="normal", noise_level="normal", obscured_entities=none)
    player = entities.filter("entity_id = 'player'").select("campaign_id").distinct()
    worn = entities.filter("type = 'item'").filter(F.array_contains("tags", F.lit("equipped")))
    items = worn.select("campaign_id", F.lit("player").alias("owner_id"), F.col("entity_id").alias("item_id"), F.lit(1).alias("qty"))
    clocks = fill(rows("clocks"), tags=none)
    purse = clocks.filter(F.lower("name") == "cred").select("campaign_id", F.lit("player").alias("owner_id"), F.lit("credstick").alias("item_id"), F.lit(1).alias("qty"))
    facts = fill(rows("facts"), object="{}", visibility="world", confidence=1.0, tags=none)
    return {
        "clocks": clocks.withColumnRenamed("id", "counter"),
        "entities": entities,
        "facts": facts.withColumn("id", F.coalesce("id", F.sha2(F.concat_ws("|", "campaign_id", "subject_id", "predicate", "object"), 256))),
        "relationships": fill(rows("relationships"), intensity=0),
        "threads": fill(rows("threads"), status="active", related_entity_ids=none, tags=none),
        "scene": scene,
        "inventory": items.unionByName(purse).join(player, "campaign_id", "left_semi"),
    }
