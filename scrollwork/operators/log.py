"""Event log to state. ``campaign_id`` keys everything; order is ``turn_no`` then position.

Folds are partial aggregations (``max_by``/``min_by``) or compositions of counter laws, so
a campaign that holds a large share of the log is reduced in pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scrollwork.functions import fixed, ordered

DIFF_SCHEMA = """
clocks array<struct<id string, delta bigint, value bigint, source string>>,
facts_add array<struct<id string, subject_id string, predicate string, object string, visibility string,
    tags array<string>, discovery_method string>>,
facts_update array<struct<id string, object string, visibility string, discovery_method string>>,
inventory_changes array<struct<owner_id string, item_id string, delta bigint>>,
scene_update struct<location_id string, present_entity_ids array<string>>,
threads_update array<struct<id string, status string, stakes map<string,string>>>,
relationship_changes array<struct<a_id string, b_id string, rel_type string, delta bigint>>
"""


def append_events(df: DataFrame, required=fixed.REQUIRED_EVENT_FIELDS) -> tuple[DataFrame, DataFrame]:
    """Split records into complete ones and those missing a required field."""
    ok = F.lit(True)
    for name in required:
        ok = ok & (F.col(name).isNotNull() if name in df.columns else F.lit(False))
    return df.filter(ok), df.filter(~ok)


def explode_diffs(events: DataFrame, diff: str = "state_diff") -> DataFrame:
    """One typed row per change, numbered in application order within its turn.

    ``state_diff`` is a JSON string or a struct of that shape. The lists become one array of
    a common struct, so the event row is exploded once.
    """
    parsed = events
    if dict(events.dtypes)[diff] == "string":
        parsed = events.withColumn(diff, F.from_json(diff, DIFF_SCHEMA))
    d = F.col(diff)
    fields = [
        ("id", "string"), ("a_id", "string"), ("b_id", "string"), ("rel_type", "string"), ("delta", "bigint"),
        ("value", "bigint"), ("source", "string"), ("subject_id", "string"), ("predicate", "string"),
        ("object", "string"), ("visibility", "string"), ("tags", "array<string>"), ("discovery_method", "string"),
        ("status", "string"), ("stakes", "map<string,string>"), ("location_id", "string"),
        ("present", "array<string>"),
    ]

    def row(kind: str, **given: Column) -> Column:
        cols = [F.lit(kind).alias("kind")]
        cols += [given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields]
        return F.struct(*cols)

    none = F.array().cast("array<struct<kind:string," + ",".join(f"{n}:{t}" for n, t in fields) + ">>")

    def each(name: str, build) -> Column:
        return F.coalesce(F.transform(d[name], build), none)

    scene = d["scene_update"]
    moved = scene.isNotNull() & (scene["location_id"].isNotNull() | scene["present_entity_ids"].isNotNull())
    every = F.concat(
        each("clocks", lambda x: row("counter", id=x["id"], delta=x["delta"], value=x["value"], source=x["source"])),
        each("facts_add", lambda x: row(
            "fact_add", id=x["id"], subject_id=x["subject_id"], predicate=x["predicate"], object=x["object"],
            visibility=F.coalesce(x["visibility"], F.lit("world")), tags=x["tags"], discovery_method=x["discovery_method"])),
        each("facts_update", lambda x: row(
            "fact_update", id=x["id"], object=x["object"], visibility=x["visibility"], discovery_method=x["discovery_method"])),
        each("inventory_changes", lambda x: row("item", a_id=x["owner_id"], b_id=x["item_id"], delta=x["delta"])),
        F.when(moved, F.array(row("scene", location_id=scene["location_id"], present=scene["present_entity_ids"]))).otherwise(none),
        each("threads_update", lambda x: row("thread", id=x["id"], status=x["status"], stakes=x["stakes"])),
        each("relationship_changes", lambda x: row(
            "relation", a_id=x["a_id"], b_id=x["b_id"], rel_type=F.coalesce(x["rel_type"], F.lit("trust")),
            delta=F.coalesce(x["delta"], F.lit(0)))),
    )
    rows = parsed.select("campaign_id", "turn_no", F.posexplode(every).alias("seq", "c"))
    return rows.select("campaign_id", "turn_no", "seq", "c.*")


# ---- counters ----


def _laws(init: DataFrame, changes: DataFrame, low: int = 0) -> DataFrame:
    j = changes.join(init.select("campaign_id", "counter", F.col("value").alias("start"), "max"), ["campaign_id", "counter"])
    return j.withColumn("law", ordered.step_law(F.col("delta"), F.col("set_value"), F.lit(low), F.col("max")))


def fold_counters(init: DataFrame, changes: DataFrame, order: list[str], span: Column) -> DataFrame:
    """Final value of every counter, clamped to ``[0, max]`` at every step.

    ``init(campaign_id, counter, value, max)``, ``changes(campaign_id, counter, delta, set_value, *order)``.
    """
    laws = ordered.fold_laws(_laws(init, changes), ["campaign_id", "counter"], order, span)
    out = init.join(laws, ["campaign_id", "counter"], "left")
    value = F.when(F.col("law").isNull(), F.col("value")).otherwise(ordered.apply_law(F.col("value"), F.col("law")))
    return out.select("campaign_id", "counter", value.cast("bigint").alias("value"), F.col("max"))


def counter_steps(
    init: DataFrame, changes: DataFrame, order: list[str], span: Column, carry: list[str] = []
) -> DataFrame:
    """Every change with the counter's value before and after it."""
    return ordered.scan_laws(
        _laws(init, changes), ["campaign_id", "counter"], order, span, F.col("start"), carry
    )


def crossings(steps: DataFrame, triggers: DataFrame, direction: str = "up") -> DataFrame:
    """Thresholds passed by a step: ``old < t <= new``; with ``both``, downward ones as well."""
    up = (F.col("old_value") < F.col("threshold")) & (F.col("threshold") <= F.col("new_value"))
    down = (F.col("new_value") < F.col("threshold")) & (F.col("threshold") <= F.col("old_value"))
    hit = up | down if direction == "both" else up
    keys = [k for k in ("campaign_id", "counter") if k in triggers.columns]
    return steps.join(triggers, keys).filter(hit)


def resolve_counter(df: DataFrame, counters: DataFrame, ref: str = "ref") -> DataFrame:
    """Counter by id, else by case-insensitive name (lowest id on equal names): two equi-joins."""
    by_id = counters.select("campaign_id", F.col("counter").alias(ref), F.col("counter").alias("__id"))
    by_name = counters.groupBy("campaign_id", F.lower("name").alias("__low")).agg(F.min("counter").alias("__named"))
    j = df.withColumn("__low", F.lower(ref)).join(by_id, ["campaign_id", ref], "left")
    return j.join(by_name, ["campaign_id", "__low"], "left").withColumn("counter", F.coalesce("__id", "__named")).drop(
        "__id", "__low", "__named"
    )


def counter_deltas(steps: DataFrame, turn: str = "turn_no") -> DataFrame:
    """Per turn: value before and after, and whether anything but a cost moved it."""
    at = F.struct(*[c for c in ("ord", "seq") if c in steps.columns] or [turn])
    g = steps.groupBy("campaign_id", "counter", turn).agg(
        F.min_by("old_value", at).alias("old"), F.max_by("new_value", at).alias("new"),
        F.coalesce(F.bool_or(F.coalesce("source", F.lit("unknown")) != "cost"), F.lit(False)).alias("consequence"),
    )
    return g.filter(F.col("old") != F.col("new"))


# ---- other state ----


def _latest(value: Column | str, at: Column) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.max_by(v, F.when(v.isNotNull(), at))


def fold_facts(changes: DataFrame) -> DataFrame:
    """Facts after inserts and field-wise updates; a null keeps the old value."""
    keys = ["campaign_id", "id"]
    at = F.struct("turn_no", "seq")
    facts = changes.filter(F.col("kind").isin("fact_add", "fact_update"))
    born = facts.filter(F.col("kind") == "fact_add").groupBy(*keys).agg(F.min(at).alias("__born"))
    live = facts.join(born, keys).filter(at >= F.col("__born"))
    known = F.when(F.col("visibility") == "known", F.col("turn_no"))
    return live.groupBy(*keys).agg(
        *[_latest(c, at).alias(c) for c in ("subject_id", "predicate", "object", "visibility", "tags", "discovery_method")],
        _latest(known, at).alias("discovered_turn"),
    )


def fold_inventory(changes: DataFrame, order: list[str], span: Column, keys: list[str]) -> DataFrame:
    """Stock per owner and item: it never falls below zero, and empty stock has no row."""
    top = F.lit(ordered.WIDE)
    laws = changes.withColumn("law", ordered.step_law(F.col("delta"), F.lit(None).cast("bigint"), F.lit(0), top))
    end = ordered.fold_laws(laws, keys, order, span)
    return end.select(*keys, ordered.apply_law(F.lit(0), F.col("law")).cast("bigint").alias("qty")).filter("qty > 0")


def latest_scene(changes: DataFrame) -> DataFrame:
    """Latest location and cast; a field left out of a change keeps its value."""
    at = F.struct("turn_no", "seq")
    return changes.filter("kind = 'scene'").groupBy("campaign_id").agg(
        F.coalesce(_latest("location_id", at), F.lit("unknown")).alias("location_id"),
        F.coalesce(_latest("present", at), F.array().cast("array<string>")).alias("present"),
    )


def fold_threads(init: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest status and stakes of threads that exist; unknown ids are ignored."""
    at = F.struct("turn_no", "seq")
    last = changes.filter("kind = 'thread'").groupBy("campaign_id", "id").agg(
        _latest("status", at).alias("__status"), _latest("stakes", at).alias("__stakes")
    )
    j = init.join(last, ["campaign_id", "id"], "left")
    return (
        j.withColumn("status", F.coalesce("__status", "status"))
        .withColumn("stakes", F.coalesce("__stakes", "stakes"))
        .drop("__status", "__stakes")
    )


def fold_relationships(init: DataFrame, changes: DataFrame, order: list[str], limit: int = 10) -> DataFrame:
    """The first delta of a new edge is clamped, later ones are added as they are."""
    keys = ["campaign_id", "a_id", "b_id", "rel_type"]
    g = changes.groupBy(*keys).agg(
        F.sum("delta").alias("__sum"), F.min_by("delta", F.struct(*order)).alias("__first")
    )
    j = init.select(*keys, F.col("intensity").alias("__old")).join(g, keys, "full_outer")
    clamped = F.least(F.lit(limit), F.greatest(F.lit(-limit), F.col("__first")))
    fresh = clamped + F.col("__sum") - F.col("__first")
    value = F.when(F.col("__old").isNotNull(), F.col("__old") + F.coalesce("__sum", F.lit(0))).otherwise(fresh)
    return j.select(*keys, value.cast("bigint").alias("intensity"))


def introduce_entities(existing: DataFrame, intro: DataFrame, order: list[str]) -> DataFrame:
    """New entities, first mention wins; known ids are left alone. ``mentions`` is the stack count."""
    keys = ["campaign_id", "entity_id"]
    rest = [c for c in intro.columns if c not in keys]
    g = intro.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("f"), F.count(F.lit(1)).alias("mentions"))
    return g.join(existing.select(*keys), keys, "left_anti").select(*keys, "f.*", "mentions")


def next_turn(events: DataFrame, campaigns: DataFrame | None = None) -> DataFrame:
    top = events.groupBy("campaign_id").agg((F.max("turn_no") + 1).alias("next_turn"))
    if campaigns is None:
        return top
    return campaigns.select("campaign_id").join(top, "campaign_id", "left").withColumn("next_turn", F.coalesce("next_turn", F.lit(1)))


def events_range(events: DataFrame, a: int, b: int) -> DataFrame:
    """Turns ``a`` to ``b``; order is a property of the final read, so none is imposed here."""
    return events.filter(F.col("turn_no").between(a, b))


# ---- as-of ----


def as_of(
    points: DataFrame, history: DataFrame, keys: list[str], point: str, time: str, value: Column, span, out: str,
    tie: list[str] = [], inclusive: bool = True,
) -> DataFrame:
    """Latest ``value`` of ``history`` at or before every point.

    Points and history are laid on one axis and the last value is carried forward, so no
    (point, event) pairs are formed. ``span`` maps the axis column name to a span expression.
    """
    side = 1 if inclusive else -1
    h = history.select(*keys, F.col(time).alias("__t"), F.lit(0).alias("__side"), *[F.col(c).alias(f"__o_{c}") for c in tie], value.alias("__v"))
    p = points.withColumn("__p", F.struct(*points.columns))
    p = p.select(*keys, F.col(point).alias("__t"), F.lit(side).alias("__side"), "__p")
    both = h.unionByName(p, allowMissingColumns=True)
    order = ["__t", "__side", *[f"__o_{c}" for c in tie]]
    seen = ordered.add_last_seen(both, keys, order, span("__t"), F.col("__v"), out)
    return seen.filter(F.col("__p").isNotNull()).select("__p.*", out)


def counters_as_of(init: DataFrame, steps: DataFrame, points: DataFrame, time: str, tie: list[str], span) -> DataFrame:
    """Counter values just before each point; untouched counters keep their start value."""
    every = points.join(init, "campaign_id")
    got = as_of(every, steps, ["campaign_id", "counter"], "cut", time, F.col("new_value"), span, "__v", tie, inclusive=False)
    return got.withColumn("value", F.coalesce("__v", F.col("value").cast("bigint"))).drop("__v")


def state_as_of(init: dict[str, DataFrame], events: DataFrame, turn: int, span: Column | None = None) -> dict[str, DataFrame]:
    """All state tables as they stood before ``turn``, from the initial tables and the log."""
    ch = explode_diffs(events.filter(F.col("turn_no") < turn))
    sp = ordered.steps("turn_no") if span is None else span
    order = ["turn_no", "seq"]
    counters = ch.filter("kind = 'counter'").select(
        "campaign_id", F.col("id").alias("counter"), "delta", F.col("value").alias("set_value"), *order
    )
    items = ch.filter("kind = 'item'").select("campaign_id", F.col("a_id").alias("owner_id"), F.col("b_id").alias("item_id"), "delta", *order)
    start = init["inventory"].select(
        "campaign_id", "owner_id", "item_id", F.col("qty").cast("bigint").alias("delta"),
        F.lit(-1).cast(dict(items.dtypes)["turn_no"]).alias("turn_no"), F.lit(0).alias("seq"),
    )
    zero = F.lit(-1).cast(dict(ch.dtypes)["turn_no"])
    old_facts = init["facts"].select(
        "campaign_id", "id", "subject_id", "predicate", "object", "visibility", "tags",
        F.lit("fact_add").alias("kind"), zero.alias("turn_no"), F.lit(0).alias("seq"),
    )
    return {
        "entities": init["entities"],
        "clocks": fold_counters(init["clocks"], counters, order, sp),
        "facts": fold_facts(ch.unionByName(old_facts, allowMissingColumns=True)),
        "inventory": fold_inventory(items.unionByName(start), order, sp, ["campaign_id", "owner_id", "item_id"]),
        "scene": latest_scene(ch),
        "threads": fold_threads(init["threads"], ch),
        "relationships": fold_relationships(init["relationships"], ch.filter("kind = 'relation'"), order),
    }


# ---- time and sessions ----


def scene_time(turns: DataFrame, order: list[str], span: Column, start: int = 0, periods=fixed.DAY_PERIODS) -> DataFrame:
    """Clock after every turn. The value before a turn is the sum without it, so no lag is needed."""
    d = ordered.add_running_sum(turns, ["campaign_id"], order, span, {"__sum": F.greatest(F.col("minutes"), F.lit(0)).cast("bigint")})
    after = F.col("__sum") + start
    before = after - F.greatest(F.col("minutes"), F.lit(0))

    def period(total: Column) -> Column:
        h = F.pmod(F.floor(total / 60), F.lit(24))
        out = None
        for a, b, name in periods:
            c = (h >= a) & (h < b)
            out = F.when(c, name) if out is None else out.when(c, name)
        return out.otherwise("night")

    return (
        d.withColumn("hour", F.pmod(F.floor(after / 60), F.lit(24)).cast("int"))
        .withColumn("minute", F.pmod(after, F.lit(60)).cast("int"))
        .withColumn("period", period(after))
        .withColumn("period_changed", period(after) != period(before))
        .drop("__sum")
    )


def active_session(sessions: DataFrame) -> DataFrame:
    """Latest session without an end, per campaign."""
    rest = [c for c in sessions.columns if c != "campaign_id"]
    g = sessions.filter(F.col("ended_at").isNull()).groupBy("campaign_id")
    return g.agg(F.max_by(F.struct(*rest), F.struct("started_at", "id")).alias("s")).select("campaign_id", "s.*")


def assign_sessions(events: DataFrame, sessions: DataFrame, span) -> DataFrame:
    """Session whose turn range holds the turn. Ranges of a campaign do not overlap, so the
    latest one that starts at or before the turn is the only candidate."""
    value = F.struct(F.col("id").alias("sid"), F.col("turn_range_end").alias("end"))
    got = as_of(events, sessions, ["campaign_id"], "turn_no", "turn_range_start", value, span, "__s")
    fits = F.col("__s.end").isNull() | (F.col("turn_no") <= F.col("__s.end"))
    return got.withColumn("session_id", F.when(fits, F.col("__s.sid"))).drop("__s")


def gap_sessions(events: DataFrame, ts: str, tie: str, gap_seconds: int, span: Column) -> DataFrame:
    """Number runs of events that are no more than a gap apart."""
    d = ordered.add_last_seen(events, ["campaign_id"], [ts, tie], span, F.col(ts), "__prev", strict=True)
    far = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("__prev").cast("timestamp")) > gap_seconds * 1_000_000
    opens = F.when(F.col("__prev").isNull() | far, 1).otherwise(0)
    return ordered.add_running_sum(d.withColumn("__opens", opens), ["campaign_id"], [ts, tie], span, {"session_no": F.col("__opens")}).drop("__prev", "__opens")


def session_recap(events: DataFrame, keys: list[str], first: int = 10) -> DataFrame:
    """First sentences of a session's first ten texts, joined. Only ten rows per session shuffle."""
    said = events.filter(F.coalesce("final_text", F.lit("")) != "")
    w = W.partitionBy(*keys).orderBy("turn_no")
    top = said.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= first)
    head = F.concat(F.substring_index("final_text", ".", 1), F.lit("."))
    part = F.when(F.length(head) > 120, F.concat(F.substring("final_text", 1, 100), F.lit("..."))).otherwise(head)
    rows = F.array_sort(F.collect_list(F.struct("__r", part.alias("p"))))
    return top.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x["p"]), " ").alias("recap"))


def last_turns(events: DataFrame, keys: list[str], n: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc("turn_no"))
    return events.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def list_campaigns(campaigns: DataFrame) -> DataFrame:
    return campaigns.orderBy(F.desc("created_at"), F.asc("campaign_id"))
