"""Ordered computations inside a key that may hold a large share of all rows.

A plain ``Window.partitionBy(key)`` sends a key to one task. The functions here cut
the order axis of every key into spans by a deterministic expression over the data,
work inside ``(key, span)``, and carry a small per-span summary across spans. The big
side is shuffled once, by ``(key, span)``; only the summaries meet per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SPAN = "__span"
BLOCK_ROWS = 512
WIDE = 1 << 60


def _order(cols: list[str]) -> list[Column]:
    return [F.col(c).asc() for c in cols]


def _before(keys: list[str]):
    return W.partitionBy(*keys).orderBy(SPAN).rowsBetween(W.unboundedPreceding, -1)


def hours(ts: str, width: int = 6) -> Column:
    """Span expression for an event-time axis."""
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(3600 * width))


def steps(n: str, width: int = 10_000) -> Column:
    """Span expression for an integer axis."""
    return F.floor(F.col(n) / F.lit(width))


def add_row_number(df: DataFrame, keys: list[str], order: list[str], span: Column, out: str = "rn") -> DataFrame:
    d = df.withColumn(SPAN, span)
    sizes = d.groupBy(*keys, SPAN).agg(F.count(F.lit(1)).alias("__in_n"))
    sizes = sizes.select(*keys, SPAN, F.coalesce(F.sum("__in_n").over(_before(keys)), F.lit(0)).alias("__in_skip"))
    local = F.row_number().over(W.partitionBy(*keys, SPAN).orderBy(*_order(order)))
    return (
        d.withColumn("__in_rn", local)
        .join(sizes, [*keys, SPAN])
        .withColumn(out, F.col("__in_rn") + F.col("__in_skip"))
        .drop("__in_rn", "__in_skip", SPAN)
    )


def add_running_sum(
    df: DataFrame, keys: list[str], order: list[str], span: Column, values: dict[str, Column]
) -> DataFrame:
    """Add ``name = sum(value)`` over all rows of the key up to and including this one."""
    d = df.withColumn(SPAN, span)
    for name, value in values.items():
        d = d.withColumn(f"__v_{name}", value)
    sums = d.groupBy(*keys, SPAN).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values])
    sums = sums.select(
        *keys, SPAN, *[F.coalesce(F.sum(f"__s_{n}").over(_before(keys)), F.lit(0)).alias(f"__b_{n}") for n in values]
    )
    w = W.partitionBy(*keys, SPAN).orderBy(*_order(order)).rowsBetween(W.unboundedPreceding, 0)
    for name in values:
        d = d.withColumn(f"__l_{name}", F.sum(f"__v_{name}").over(w))
    d = d.join(sums, [*keys, SPAN])
    for name in values:
        d = d.withColumn(name, F.col(f"__l_{name}") + F.col(f"__b_{name}"))
    return d.drop(SPAN, *[f"__{p}_{n}" for n in values for p in ("v", "l", "b")])


def add_next(df: DataFrame, keys: list[str], order: list[str], span: Column, value: str, out: str) -> DataFrame:
    """Add the value of the following row of the key (null on the last one)."""
    d = df.withColumn(SPAN, span)
    heads = d.groupBy(*keys, SPAN).agg(F.min_by(value, F.struct(*order)).alias("__in_head"))
    heads = heads.select(*keys, SPAN, F.lead("__in_head").over(W.partitionBy(*keys).orderBy(SPAN)).alias("__in_after"))
    w = W.partitionBy(*keys, SPAN).orderBy(*_order(order))
    d = d.withColumn("__in_next", F.lead(value).over(w)).withColumn("__in_last", F.lead(F.lit(1)).over(w).isNull())
    return (
        d.join(heads, [*keys, SPAN])
        .withColumn(out, F.when(F.col("__in_last"), F.col("__in_after")).otherwise(F.col("__in_next")))
        .drop(SPAN, "__in_next", "__in_last", "__in_after")
    )


def add_last_seen(
    df: DataFrame, keys: list[str], order: list[str], span: Column, value: Column, out: str, strict: bool = False
) -> DataFrame:
    """Add the latest non-null value at or before this row (before it, if ``strict``)."""
    d = df.withColumn(SPAN, span).withColumn("__in_value", value)
    tails = d.groupBy(*keys, SPAN).agg(
        F.max_by("__in_value", F.when(F.col("__in_value").isNotNull(), F.struct(*order))).alias("__in_tail")
    )
    tails = tails.select(*keys, SPAN, F.last("__in_tail", ignorenulls=True).over(_before(keys)).alias("__in_carry"))
    w = W.partitionBy(*keys, SPAN).orderBy(*_order(order)).rowsBetween(W.unboundedPreceding, -1 if strict else 0)
    return (
        d.withColumn("__in_local", F.last("__in_value", ignorenulls=True).over(w))
        .join(tails, [*keys, SPAN])
        .withColumn(out, F.coalesce("__in_local", "__in_carry"))
        .drop(SPAN, "__in_value", "__in_local", "__in_carry")
    )


# --- bounded counters -------------------------------------------------------------
# One step is the function x -> min(hi, max(lo, x + add)). Such functions compose
# into one of the same form, so a long history is reduced block by block instead of
# being gathered whole: 512 rows make a block, 512 blocks a block of blocks.

_LAW = "struct<add:bigint,lo:bigint,hi:bigint>"


def _then(first: Column, second: Column) -> Column:
    def bound(x: Column) -> Column:
        return F.least(second["hi"], F.greatest(second["lo"], x + second["add"]))

    add = F.greatest(F.lit(-WIDE), F.least(F.lit(WIDE), first["add"] + second["add"]))
    return F.struct(add.alias("add"), bound(first["lo"]).alias("lo"), bound(first["hi"]).alias("hi"))


def apply_law(x: Column, law: Column) -> Column:
    return F.least(law["hi"], F.greatest(law["lo"], x + law["add"]))


def _compose(items: Column) -> Column:
    same = F.lit(0).cast("bigint")
    start = F.struct(same.alias("add"), F.lit(-WIDE).cast("bigint").alias("lo"), F.lit(WIDE).cast("bigint").alias("hi"))
    return F.aggregate(items, start, lambda acc, it: _then(acc, it["law"]))


def step_law(delta: Column, value: Column, low: Column, high: Column) -> Column:
    """A non-zero delta moves the counter; otherwise a given value replaces it."""
    high = high.cast("bigint")
    low = low.cast("bigint")
    placed = F.least(high, F.greatest(low, value.cast("bigint")))
    moves = F.coalesce(delta, F.lit(0)) != 0
    none = F.lit(0).cast("bigint")
    law = (
        F.when(moves, F.struct(delta.cast("bigint").alias("add"), low.alias("lo"), high.alias("hi")))
        .when(value.isNotNull(), F.struct(none.alias("add"), placed.alias("lo"), placed.alias("hi")))
        .otherwise(F.struct(none.alias("add"), F.lit(-WIDE).alias("lo"), F.lit(WIDE).alias("hi")))
    )
    return law.cast(_LAW)


def _blocks(rows: DataFrame, keys: list[str], order: list[str], carry: list[str], span: Column | None) -> DataFrame:
    """Pack consecutive rows of a key into blocks of bounded length."""
    d = rows.withColumn(SPAN, span if span is not None else F.lit(0).cast("bigint"))
    local = F.row_number().over(W.partitionBy(*keys, SPAN).orderBy(*_order(order))) - 1
    d = d.withColumn("__block", F.floor(local / F.lit(BLOCK_ROWS)))
    item = F.struct(*order, "law", *[c for c in carry if c not in order])
    packed = d.groupBy(*keys, SPAN, "__block").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return packed.withColumn("law", _compose(F.col("items")))


def fold_laws(rows: DataFrame, keys: list[str], order: list[str], span: Column) -> DataFrame:
    """One composed law per key: ``keys, law``."""
    level1 = _blocks(rows, keys, order, [], span).withColumnRenamed(SPAN, "__s1").withColumnRenamed("__block", "__b1")
    level2 = _blocks(level1.select(*keys, "__s1", "__b1", "law"), keys, ["__s1", "__b1"], [], None)
    top = level2.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__block", "law"))).alias("items"))
    return top.select(*keys, _compose(F.col("items")).alias("law"))


def _unroll(blocks: DataFrame, keep: list[str], fields: list[str]) -> DataFrame:
    """Run each block from its ``start`` and give every item its value before and after.

    Blocks hold a bounded number of items, so the accumulated array stays small.
    """
    def step(acc: Column, it: Column) -> Column:
        now = apply_law(acc["now"], it["law"])
        return F.struct(now.alias("now"), F.concat(acc["seen"], F.array(now)).alias("seen"))

    seed = F.struct(F.col("start").cast("bigint").alias("now"), F.array().cast("array<bigint>").alias("seen"))
    after = F.aggregate(F.col("items"), seed, step, lambda acc: acc["seen"])
    b = blocks.withColumn("__aft", after).withColumn(
        "__before", F.concat(F.array("start"), F.slice(F.col("__aft"), 1, F.size("__aft") - 1))
    )
    z = b.select(*keep, F.explode(F.arrays_zip("items", "__before", "__aft")).alias("z"))
    return z.select(
        *keep,
        *[F.col("z.items")[f].alias(f) for f in fields],
        F.col("z.__before").alias("old_value"),
        F.col("z.__aft").alias("new_value"),
    )


def scan_laws(
    rows: DataFrame, keys: list[str], order: list[str], span: Column, start: Column, carry: list[str]
) -> DataFrame:
    """Every step with the counter before and after it.

    ``start`` must be constant within a key and be one of the carried columns or a literal.
    """
    level1 = _blocks(rows.withColumn("__start", start.cast("bigint")), keys, order, [*carry, "__start"], span)
    level1 = level1.withColumnRenamed(SPAN, "__s1").withColumnRenamed("__block", "__b1")
    first = F.col("items")[0]["__start"]
    slim = level1.select(*keys, "__s1", "__b1", "law", first.alias("__start"))
    level2 = _blocks(slim, keys, ["__s1", "__b1"], ["__start"], None)
    top = level2.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("__block", "law"))).alias("items"),
        F.min(F.col("items")[0]["__start"]).alias("start"),
    )
    starts2 = _unroll(top, keys, ["__block"]).select(*keys, "__block", F.col("old_value").alias("start"))
    starts1 = _unroll(level2.join(starts2, [*keys, "__block"]), keys, ["__s1", "__b1"])
    starts1 = starts1.select(*keys, "__s1", "__b1", F.col("old_value").alias("start"))
    return _unroll(level1.join(starts1, [*keys, "__s1", "__b1"]), keys, [*order, *[c for c in carry if c not in order]])
