"""Rules over recorded actions. Nothing here rolls dice; recorded values are graded.

Rule tables are short literal lists, evaluated inside the row; only data meets data in joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scrollwork.functions import fixed, ordered, text as T
from scrollwork.operators.substrings import containing

KEYS = ["campaign_id", "turn_no", "ord"]
EFFECT = "array<struct<counter:string,delta:bigint>>"


def resolve_targets(actions: DataFrame, entities: DataFrame) -> DataFrame:
    """Target by id, else by name, else by part of a name; unresolved ones stay as they are.

    Each distinct reference is resolved once. The part-of-a-name step compares a reference
    with the names that hold its rarest three letters.
    """
    ref = actions.select("campaign_id", F.col("target").alias("ref")).filter("ref <> ''").distinct()
    ref = ref.withColumn("low", F.lower("ref"))
    ids = entities.select("campaign_id", F.col("entity_id").alias("ref"), F.col("entity_id").alias("__id")).distinct()
    low = F.lower("name")
    named = entities.groupBy("campaign_id", low.alias("low")).agg(F.min_by("entity_id", "ord").alias("__named"))
    r = ref.join(ids, ["campaign_id", "ref"], "left").join(named, ["campaign_id", "low"], "left")
    r = r.withColumn("hit", F.coalesce("__id", "__named")).drop("__id", "__named")
    names = entities.groupBy("campaign_id", low.alias("text")).agg(F.min(F.struct("ord", "entity_id")).alias("first"))
    held = containing(names.select("campaign_id", "text"), r.filter(F.col("hit").isNull()).select("campaign_id", F.col("low").alias("pattern")), ["campaign_id"])
    inside = held.join(names, ["campaign_id", "text"]).groupBy("campaign_id", F.col("pattern").alias("low")).agg(F.min("first")["entity_id"].alias("__part"))
    r = r.join(inside, ["campaign_id", "low"], "left")
    r = r.select("campaign_id", F.col("ref").alias("target"), F.coalesce("hit", "__part").alias("__hit"))
    return actions.join(r, ["campaign_id", "target"], "left").withColumn("target_id", F.coalesce("__hit", "target")).drop("__hit")


def _flag(actions: DataFrame, df: DataFrame, name: str) -> DataFrame:
    ids = df.select("campaign_id", F.col("entity_id").alias("target_id")).distinct().withColumn(name, F.lit(True))
    j = actions.join(ids, ["campaign_id", "target_id"], "left")
    return j.withColumn(name, F.coalesce(name, F.lit(False)))


def check_reach(
    actions: DataFrame, present: DataFrame, carried: DataFrame, entities: DataFrame, scenes: DataFrame, stated: DataFrame,
    context: int = 100,
) -> DataFrame:
    """Reason why an action cannot reach its target; null if it can.

    ``present``, ``carried`` and ``entities`` hold ``campaign_id, entity_id``;
    ``scenes(campaign_id, location_id, features)``; ``stated(campaign_id, id, object)`` are
    narrator facts, of which the context shows the first hundred.
    """
    a = _flag(_flag(_flag(actions, present, "__here"), carried, "__held"), entities, "__known")
    w = W.partitionBy("campaign_id").orderBy("id")
    few = stated.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= context)
    few = few.groupBy("campaign_id").agg(F.collect_list(F.lower("object")).alias("__facts"))
    a = a.join(scenes, "campaign_id", "left").join(few, "campaign_id", "left")
    low = F.replace(F.lower("target_id"), F.lit("unknown_"), F.lit(""))
    none = F.array().cast("array<string>")
    feature = F.exists(F.coalesce("features", none), lambda f: F.contains(F.lower(f), low) | F.contains(low, F.lower(f)))
    told = F.exists(F.coalesce("__facts", none), lambda f: F.contains(f, low))
    at = F.coalesce(F.col("target_id") == F.col("location_id"), F.lit(False))
    free = (F.coalesce("target_id", F.lit("")) == "") | F.lower("target_id").isin(fixed.META_TARGETS)
    known = F.col("__here") | F.col("__held") | F.col("__known") | at
    reason = (
        F.when(free, None)
        .when(~known & ~feature & ~told & ~F.lower("action").isin(fixed.ENVIRONMENT_VERBS), "unknown")
        .when(known & ~F.col("__here") & ~F.col("__held") & ~at, "not present")
    )
    return a.withColumn("reason", reason).drop("__here", "__held", "__known", "__facts", "location_id", "features")


def check_items(actions: DataFrame, inventory: DataFrame, rules=fixed.ITEM_REQUIREMENTS) -> DataFrame:
    """First required item an action lacks. ``inventory(campaign_id, item_id, qty)``."""
    need = None
    for verb in dict.fromkeys(v for v, _, _ in rules):
        items = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(it).alias("item_id"), F.lit(q).alias("need")) for i, (v, it, q) in enumerate(rules) if v == verb])
        need = F.when(F.lower("action") == verb, items) if need is None else need.when(F.lower("action") == verb, items)
    wanted = actions.select(*KEYS, F.inline(need)).join(inventory, ["campaign_id", "item_id"], "left")
    lack = wanted.filter(F.coalesce("qty", F.lit(0)) < F.col("need")).groupBy(*KEYS).agg(F.min_by("item_id", "pos").alias("missing_item"))
    return actions.join(lack, KEYS, "left")


def check_contradictions(actions: DataFrame, facts: DataFrame, constraints: DataFrame) -> DataFrame:
    """Actions at odds with known facts or with the place.

    ``facts(campaign_id, subject_id, predicate, object)``; ``constraints(campaign_id, no_violence, no_magic)``.
    """
    gone = facts.filter((F.col("predicate") == "status") & F.col("object").isin("dead", "destroyed"))
    gone = gone.groupBy("campaign_id", F.col("subject_id").alias("target_id")).agg(F.min("object").alias("__state"))
    a = actions.join(gone, ["campaign_id", "target_id"], "left").join(constraints, "campaign_id", "left")
    verb = F.lower("action")
    why = (
        F.when(F.col("__state").isNotNull() & verb.isin(fixed.INTERACTIVE_VERBS), F.concat(F.lit("target is "), "__state"))
        .when(F.col("no_violence") & verb.isin(fixed.VIOLENT_VERBS), "no violence here")
        .when(F.col("no_magic") & verb.isin(fixed.MAGIC_VERBS), "no magic here")
    )
    return a.withColumn("contradiction", why).drop("__state", "no_violence", "no_magic")


def _effects(rows: list[tuple[str, int]]) -> Column:
    if not rows:
        return F.array().cast(EFFECT)
    return F.array(*[F.struct(F.lit(c).alias("counter"), F.lit(d).cast("bigint").alias("delta")) for c, d in rows]).cast(EFFECT)


def action_costs(
    actions: DataFrame, costs=fixed.ACTION_COSTS, free=fixed.FREE_ACTIONS, enabled=fixed.COUNTERS_ENABLED
) -> DataFrame:
    """Counter costs of every action: ``keys, counter, amount``, adjusted for lethality."""
    verbs = dict.fromkeys([v for v, _, _ in costs] + list(free))
    table = None
    verb = F.lower("action")
    for v in verbs:
        hit = _effects([(c, d) for w, c, d in costs if w == v and c in enabled])
        table = F.when(verb == v, hit) if table is None else table.when(verb == v, hit)
    table = table.otherwise(_effects([(c, d) for w, c, d in costs if w == "_default" and c in enabled]))
    rows = actions.select(*KEYS, "lethality", F.inline(table))
    low = F.when(F.col("counter") == "harm", F.greatest(F.lit(0), F.col("delta") - 1)).otherwise(F.col("delta"))
    hard = (F.col("delta") * 1.5).cast("bigint")
    amount = F.when(F.col("lethality") == "low", low).when(F.col("lethality") == "brutal", hard).otherwise(F.col("delta"))
    return rows.select(*KEYS, "counter", amount.cast("bigint").alias("amount"))


def turn_costs(costs: DataFrame) -> DataFrame:
    return costs.groupBy("campaign_id", "turn_no", "counter").agg(F.sum("amount").alias("amount"))


def directed(counter: Column, delta: Column, down=fixed.DECREMENTING) -> Column:
    return F.when(counter.isin(down), -F.abs(delta)).otherwise(delta)


def apply_direction(df: DataFrame, col: str = "amount", down=fixed.DECREMENTING) -> DataFrame:
    return df.withColumn(col, directed(F.col("counter"), F.col(col), down))


def cap_actions(actions: DataFrame, most: int = 2) -> DataFrame:
    """First action of every verb and target in a turn, and of those the first two."""
    once = actions.groupBy("campaign_id", "turn_no", F.lower("action").alias("__a"), F.lower(F.coalesce("target", F.lit(""))).alias("__t"))
    first = once.agg(F.min("ord").alias("ord"))
    w = W.partitionBy("campaign_id", "turn_no").orderBy("ord")
    top = first.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most)
    return actions.join(top.select(*KEYS), KEYS, "left_semi")


def duration(action: Column, estimate: Column, table=fixed.DURATIONS) -> Column:
    default = dict(table).get("_default", 5)
    return F.when(estimate.between(1, 120), estimate).otherwise(T.first_in(action, table, default)).cast("int")


def durations(actions: DataFrame, table=fixed.DURATIONS) -> DataFrame:
    d = actions.withColumn("minutes", duration(F.col("action"), F.col("estimated_minutes"), table))
    return d.groupBy("campaign_id", "turn_no").agg(F.sum("minutes").cast("bigint").alias("minutes"))


def risky(flags: Column) -> Column:
    return F.arrays_overlap(F.coalesce(flags, F.array().cast("array<string>")), F.array(*[F.lit(f) for f in fixed.RISKY_FLAGS]))


def needs_roll(actions: DataFrame, safe=fixed.SAFE_ACTIONS) -> DataFrame:
    return actions.withColumn("needs_roll", ~F.lower("action").isin(safe) | risky(F.col("risk_flags")))


def grade_totals(rolls: DataFrame, total: str = "total") -> DataFrame:
    t = F.col(total)
    return rolls.withColumn(
        "outcome", F.when(t <= 6, "failure").when(t <= 9, "mixed").when(t == 12, "critical").otherwise("success")
    ).withColumn("margin", F.when(t <= 6, 7 - t).when(t <= 9, 0).otherwise(t - 10))


def grade_pools(
    rolls: DataFrame, ones_cancel: bool = True, past_nine: bool = True, botch: bool = True, marks=fixed.POOL_THRESHOLDS
) -> DataFrame:
    """Grade recorded pools: ``dice array<int>``, ``difficulty``."""
    raw = F.size(F.filter("dice", lambda d: d >= F.col("difficulty")))
    ones = F.size(F.filter("dice", lambda d: d == 1))
    d = rolls.withColumn("__raw", raw).withColumn("ones", ones)
    net = F.greatest(F.lit(0), F.col("__raw") - F.col("ones")) if ones_cancel else F.col("__raw")
    if past_nine:
        net = F.when(F.col("difficulty") > 9, F.greatest(F.lit(0), net - (F.col("difficulty") - 9))).otherwise(net)
    d = d.withColumn("successes", net)
    n = F.col("successes")
    bad = (n <= 0) & (F.col("ones") > 0) & (F.col("__raw") == 0) & F.lit(botch)
    out = (
        F.when(bad, "botch").when(n <= 0, "failure").when(n >= marks["critical"], "critical")
        .when(n >= marks["success"], "success").when(n >= marks["mixed"], "mixed").otherwise("failure")
    )
    return d.withColumn("outcome", out).drop("__raw")


def pool_size(actions: DataFrame, stats: DataFrame, pairs: list[tuple[str, str, str]], default=fixed.DEFAULT_STATS) -> DataFrame:
    """Dice pool of an action: the sum of its two stats, at least one.

    ``stats(campaign_id, stat, value)``; ``pairs`` lists action, attribute, ability.
    """
    verb = F.lower("action")
    a = actions.withColumn("__s1", T.first_in(verb, [(v, x) for v, x, _ in pairs], default[0]))
    a = a.withColumn("__s2", T.first_in(verb, [(v, y) for v, _, y in pairs], default[1]))
    one = stats.select("campaign_id", F.col("stat").alias("__s1"), F.col("value").alias("__v1"))
    two = stats.select("campaign_id", F.col("stat").alias("__s2"), F.col("value").alias("__v2"))
    a = a.join(one, ["campaign_id", "__s1"], "left").join(two, ["campaign_id", "__s2"], "left")
    total = F.coalesce("__v1", F.lit(0)) + F.coalesce("__v2", F.lit(0))
    return (
        a.withColumn("pool", F.greatest(F.lit(1), total).cast("int"))
        .withColumn("stat_pair", F.concat("__s1", F.lit("+"), "__s2"))
        .drop("__s1", "__s2", "__v1", "__v2")
    )


def threatened(npcs: DataFrame, threats: DataFrame, situations: DataFrame) -> DataFrame:
    """Campaigns under an active threat: a pending one, a strong opponent or a hard situation."""
    a = threats.select("campaign_id")
    b = npcs.filter(F.col("threat_level").isin("high", "extreme")).select("campaign_id")
    c = situations.filter(F.col("severity") == "hard").select("campaign_id")
    return a.unionByName(b).unionByName(c).distinct()


def severity(actions: DataFrame, under_threat: DataFrame) -> DataFrame:
    """Tier 2 under threat, 1 with a risky flag, else 0; a botch is at least 2."""
    j = actions.join(under_threat.select("campaign_id").distinct().withColumn("__t", F.lit(True)), "campaign_id", "left")
    tier = F.when(F.col("__t"), 2).when(risky(F.col("risk_flags")), 1).otherwise(0)
    tier = F.when(F.col("outcome") == "botch", F.greatest(tier, F.lit(2))).otherwise(tier)
    return j.withColumn("tier", tier).drop("__t")


def effects(actions: DataFrame, failure=fixed.FAILURE_EFFECTS, complication=fixed.COMPLICATION_EFFECTS) -> DataFrame:
    """Counter effects of graded actions: ``keys, counter, delta, source``.

    Needs ``action, outcome, tier, failure_mode``.
    """
    verb = F.lower("action")
    down = lambda arr: F.transform(arr, lambda e: F.struct(e["counter"].alias("counter"), directed(e["counter"], e["delta"]).alias("delta")))
    modes = list(dict.fromkeys(m for m, _, _, _ in failure))
    mode = F.when(F.col("failure_mode").isin(modes), F.col("failure_mode")).otherwise("consequential")
    table = None
    for m in modes:
        default = _effects([(c, d) for n, k, c, d in failure if n == m and k == "default"])
        combat = [(c, d) for n, k, c, d in failure if n == m and k == "combat"]
        pick = F.when(verb.isin(fixed.FAILURE_COMBAT_VERBS), _effects(combat)).otherwise(default) if combat else default
        table = F.when(mode == m, pick) if table is None else table.when(mode == m, pick)
    base = down(table)
    harm = F.when(
        (F.col("tier") >= 2) & verb.isin(fixed.TIER2_HARM_VERBS) & ~F.exists(base, lambda e: e["counter"] == "harm"), _effects([("harm", 1)])
    ).otherwise(_effects([]))
    heat = F.when((F.col("tier") >= 2) & verb.isin(fixed.STEALTH_VERBS), _effects([("heat", 1)])).otherwise(_effects([]))
    fail = F.concat(base, harm, heat)
    twice = F.when(F.col("failure_mode") == "punishing", 2).otherwise(1)
    cat = F.when(verb.isin(fixed.COMPLICATION_COMBAT_VERBS), _effects([(c, d) for k, c, d in complication if k == "combat"])).otherwise(
        _effects([(c, d) for k, c, d in complication if k == "default"])
    )
    mixed = down(F.transform(cat, lambda e: F.struct(e["counter"].alias("counter"), (e["delta"] * twice).alias("delta"))))
    source = F.when(F.col("outcome") == "mixed", "complication").otherwise("failure")
    rows = F.when(F.col("outcome") == "mixed", mixed).when(F.col("outcome").isin("failure", "botch"), fail).otherwise(_effects([]))
    return actions.withColumn("source", source).select(*KEYS, "source", F.posexplode(rows).alias("pos", "e")).select(
        *KEYS, "pos", "source", "e.counter", "e.delta"
    )


def trust_changes(actions: DataFrame) -> DataFrame:
    """Trust gained or lost with the target."""
    verb, won = F.lower("action"), F.col("outcome").isin("success", "critical", "mixed")
    delta = F.when(won & verb.isin(fixed.TRUST_UP_VERBS), 1).when(~won & verb.isin(fixed.TRUST_DOWN_VERBS), -1)
    d = actions.filter((F.coalesce("target", F.lit("")) != "") & ~F.lower("target").isin(fixed.TRUST_EXEMPT)).withColumn("delta", delta)
    return d.filter(F.col("delta").isNotNull()).select(*KEYS, F.lit("player").alias("a_id"), F.col("target").alias("b_id"), F.lit("trust").alias("rel_type"), F.col("delta").cast("bigint").alias("delta"))


def condition_rows(actions: DataFrame, order: list[str], conditions=fixed.CONDITION_OF, cleared=fixed.CLEARED_BY) -> DataFrame:
    """``campaign_id, *order, __ends, __hard, condition``: what each action opens, raises or ends."""
    verb = F.lower("action")
    good = F.col("outcome").isin("success", "critical", "mixed")
    empty = F.array().cast("array<string>")
    opens = T.first_in(verb, conditions)
    ends = empty
    for v in sorted({c[: -len("_success")] for _, cs in cleared for c in cs if c.endswith("_success")}):
        names = F.array(*[F.lit(n) for n, cs in cleared if f"{v}_success" in cs])
        ends = F.when(verb == v, names).otherwise(ends)
    which = F.when(good, ends).when(F.col("outcome").isin("failure", "botch") & opens.isNotNull(), F.array(opens)).otherwise(empty)
    rows = actions.withColumn("__ends", good).withColumn("__hard", F.col("tier") >= 2)
    return rows.select("campaign_id", *order, "__ends", "__hard", F.explode(which).alias("condition"))


def situation_intervals(actions: DataFrame, order: list[str], span: Column, conditions=fixed.CONDITION_OF, cleared=fixed.CLEARED_BY) -> DataFrame:
    """Intervals during which a condition holds.

    A failed verb opens its condition, a hard failure raises it, a matching success ends it.
    Counting the endings before each row numbers the intervals, so no walk is needed.
    """
    rows = condition_rows(actions, order, conditions, cleared)
    keys = ["campaign_id", "condition"]
    n = ordered.add_running_sum(rows, keys, order, span, {"__n": F.col("__ends").cast("int")})
    n = n.withColumn("interval_no", F.col("__n") - F.col("__ends").cast("int"))
    at = F.struct(*order)
    g = n.groupBy(*keys, "interval_no").agg(
        F.min(F.when(~F.col("__ends"), at)).alias("opened"), F.min(F.when(F.col("__ends"), at)).alias("closed"),
        F.coalesce(F.bool_or(F.when(~F.col("__ends"), F.col("__hard"))), F.lit(False)).alias("hard"),
    )
    return g.filter(F.col("opened").isNotNull())


def running_streak(turns: DataFrame, order: list[str], span: Column, window: int = 10) -> DataFrame:
    """Failed turns in a row before each turn, within the last ten.

    ``turns(campaign_id, *order, outcome)`` as in the streak view. The count is a difference
    of two running sums, looked up at the row where the streak can start.
    """
    keys = ["campaign_id"]
    d = ordered.add_row_number(turns, keys, order, span, "rn")
    failed = (F.col("outcome") == "failure").cast("int")
    d = ordered.add_running_sum(d, keys, order, span, {"__f": F.coalesce(failed, F.lit(0))})
    d = ordered.add_last_seen(d, keys, order, span, F.when(F.col("outcome") == "success", F.col("rn")), "__won", strict=True)
    now = F.coalesce(failed, F.lit(0))
    d = d.withColumn("__from", F.greatest(F.coalesce("__won", F.lit(0)), F.col("rn") - 1 - window, F.lit(0)))
    base = d.select("campaign_id", F.col("rn").alias("__from"), F.col("__f").alias("__base"))
    j = d.join(base, ["campaign_id", "__from"], "left")
    return j.withColumn("streak_before", (F.col("__f") - now - F.coalesce("__base", F.lit(0))).cast("bigint")).drop(
        "__from", "__f", "__won", "__base"
    )


def streak_alerts(streaks: DataFrame, under_threat: DataFrame, threshold: int = 3) -> DataFrame:
    """Alert of a failed turn under threat: resolved at the threshold, a warning one before."""
    j = streaks.join(under_threat.select("campaign_id").distinct(), "campaign_id", "left_semi")
    n = F.col("streak_before") + 1
    alert = F.when(n >= threshold, "threat_resolved").when(n == threshold - 1, "warning")
    return j.filter(F.col("outcome") == "failure").withColumn("alert", alert).filter(F.col("alert").isNotNull())


def primary_threat(npcs: DataFrame) -> DataFrame:
    """Most dangerous opponent; the first on ties. ``npcs(campaign_id, ord, entity_id, name, threat_level)``."""
    rank = T.first_in(F.coalesce("threat_level", F.lit("low")), fixed.THREAT_RANK, 0)
    g = npcs.groupBy("campaign_id").agg(F.min_by(F.struct("entity_id", "name", "threat_level"), F.struct(-rank, "ord")).alias("n"))
    return g.select("campaign_id", "n.*")


def keyword_counter(df: DataFrame, col: str, keywords=fixed.COUNTER_KEYWORDS) -> DataFrame:
    """First counter one of whose keywords occurs in the text."""
    low = F.lower(col)
    out = None
    for counter, words in keywords:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, counter) if out is None else out.when(hit, counter)
    return df.withColumn("counter", out)
