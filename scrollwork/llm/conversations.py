"""Repair of conversations to the form ``(system? (user assistant)+)?`` at the least cost.

Rows become one symbol each: role class and fault. A conversation's symbols are cut into blocks of bounded length; a block's
symbols are its signature. Signatures are sorted from their ends, over all conversations, so those with a common suffix stand
side by side and share the automaton's nodes of that suffix (a word graph minimised from the end). A node holds, for each grammar
state before it, the least cost to go and the ASCII-least edits of that cost. It is computed once; only the path of the first
signature of a task is computed there anew.

The edits of a block end with a row's edit, because inserts stand before a row or at the very end. So among the edits of one
block none is a proper beginning of another, and least edits of blocks put together are least edits of the whole: blocks of a long
conversation are combined as small matrices of costs and ranks, level by level, and no task holds a whole conversation.
"""

from __future__ import annotations

import hashlib
from math import inf

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scrollwork.functions.ordered import add_running_sum
from scrollwork.llm.common import BLANKS, query, table, written

# grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn; END: accepted
EMPTY, SYSTEM, USER, ASSISTANT, END = range(5)
STATES = (EMPTY, SYSTEM, USER, ASSISTANT)
#: the state after one more user or assistant turn
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: symbols: role class s, u, a or o (another); upper case: truncated; X: must go
KEPT = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLOCK = 64
FAN = 64
SPAN = 1024


# --- the automaton --------------------------------------------------------------------


def accept() -> list[tuple[float, str]]:
    """Edits after the last row, by state."""
    return [(0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")]


def reach(state: int) -> list[tuple[float, str]]:
    """The end of a block that another block follows in ``state``."""
    return [(0, "") if q == state else (inf, "") for q in STATES]


def prepend(symbol: str, child: list[tuple[float, str]]) -> list[tuple[float, str]]:
    """The node before ``child`` by one row."""
    extra = TRUNCATED if symbol.isupper() else 0
    out = []
    for q in STATES:
        best, at = (inf, ""), q
        for inserts in range(3):
            lead, cost = "I" * inserts, INSERT * inserts
            best = min(best, (cost + DELETE + child[at][0], lead + "D" + child[at][1]))
            if symbol != "X":
                best = min(best, (cost + REROLE + extra + child[NEXT[at]][0], lead + "R" + child[NEXT[at]][1]))
                if (to := KEPT[symbol.lower()].get(at)) is not None:
                    best = min(best, (cost + extra + child[to][0], lead + "K" + child[to][1]))
            at = NEXT[at]
        out.append(best if best[0] < inf else (inf, ""))
    return out


class Suffixes:
    """The nodes of one signature's suffixes, those of a common ending kept from the signature before it."""

    def __init__(self) -> None:
        self.signature, self.last, self.nodes = "", None, []
        self.built = 0

    def node(self, signature: str, last: bool) -> list[list[tuple[float, str]]]:
        """For each way to end (accepted, or each state that the next block starts in) the node of the whole signature."""
        if last != self.last:
            self.signature, self.last, self.nodes = "", last, [[accept()] if last else [reach(s) for s in STATES]]
        same, shorter = 0, min(len(signature), len(self.signature))
        while same < shorter and signature[-1 - same] == self.signature[-1 - same]:
            same += 1
        del self.nodes[same + 1 :]
        for k in range(same, len(signature)):
            self.nodes.append([prepend(signature[-1 - k], child) for child in self.nodes[-1]])
        self.built += len(signature) - same
        self.signature = signature
        return self.nodes[-1]


def plan(signature: str, state: int, edits: str) -> str:
    """The edits with the roles they give: inserts as u or a, rows as D, K, U or A (rerole to user or assistant)."""
    out, row = [], 0
    for e in edits:
        if e == "I":
            state = NEXT[state]
            out.append("a" if state == ASSISTANT else "u")
            continue
        if e == "K":
            state = KEPT[signature[row].lower()][state]
        elif e == "R":
            state = NEXT[state]
            e = "A" if state == ASSISTANT else "U"
        out.append(e)
        row += 1
    return "".join(out)


SOLVED = "conv string, block long, at int, till int, cost double, edits string, plan string"


def solve(blocks: DataFrame) -> DataFrame:
    """``conv``, ``block``, ``signature``, ``last`` -> for each state ``at`` before and ``till`` after the block (END after a last one)
    the least cost and its edits. First blocks start in state EMPTY only."""

    def walk(batches):
        graph, cached, known = Suffixes(), None, []
        for batch in batches:
            rows = []
            for conv, block, signature, last in zip(*(c.to_pylist() for c in batch.columns)):
                if cached != (signature, last):
                    cached, known = (signature, last), []
                    for till, node in zip((END,) if last else STATES, graph.node(signature, last)):
                        known += [(at, till, float(node[at][0]), node[at][1], plan(signature, at, node[at][1])) for at in STATES if node[at][0] < inf]
                rows += [(conv, block, *x) for x in known if block or x[0] == EMPTY]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string()))], ["conv", "block", "at", "till", "cost", "edits", "plan"])

    dealt = blocks.withColumn("from_end", F.reverse("signature")).repartitionByRange("last", "from_end", "conv", "block")
    return dealt.sortWithinPartitions("last", "from_end").select("conv", "block", "signature", "last").mapInArrow(walk, SOLVED)


# --- long conversations ---------------------------------------------------------------


def _best_paths(children: list[dict], till: int) -> dict:
    """From each state before the first child to ``till``: cost, ranks of the children's entries, states between them."""
    best = {till: (0.0, (), ())}
    for child in reversed(children):
        now: dict = {}
        for (at, to), (cost, rank) in child.items():
            if to in best:
                x = (cost + best[to][0], (rank, *best[to][1]), (to, *best[to][2]))
                if at not in now or x[:2] < now[at][:2]:
                    now[at] = x
        best = now
    return best


def _children(frame: pd.DataFrame) -> list[dict]:
    out: list[dict] = []
    for _, part in frame.sort_values("block").groupby("block", sort=True):
        out.append({(int(a), int(t)): (float(c), int(r)) for a, t, c, r in zip(part["at"], part["till"], part["cost"], part["rank"])})
    return out


def _combined(frame: pd.DataFrame) -> pd.DataFrame:
    children, found = _children(frame), []
    for till in sorted({t for _, t in children[-1]}):
        found += [(at, till, cost, ranks) for at, (cost, ranks, _) in _best_paths(children, till).items()]
    order = {r: k for k, r in enumerate(sorted({x[3] for x in found}))}
    return pd.DataFrame([(frame["conv"].iloc[0], int(frame["parent"].iloc[0]), at, till, cost, order[ranks]) for at, till, cost, ranks in found], columns=["conv", "block", "at", "till", "cost", "rank"])


def _placed(frame: pd.DataFrame) -> pd.DataFrame:
    children, at, till = _children(frame), int(frame["from"].iloc[0]), int(frame["to"].iloc[0])
    path = (at, *_best_paths(children, till)[at][2])
    blocks = sorted(set(frame["block"]))
    return pd.DataFrame({"conv": frame["conv"].iloc[0], "block": blocks, "from": path[:-1], "to": path[1:]})


MATRIX = "conv string, block long, at int, till int, cost double, rank int"


def chosen(solved: DataFrame, most: int, fan: int = FAN) -> DataFrame:
    """``conv``, ``block``, ``at``, ``till`` of each block on the best way through its conversation. ``most``: blocks of the longest one.

    Up: ``fan`` neighbouring matrices become one, until one is left for each conversation. Down: the ends of a matrix fix those of
    its parts. Costs and ranks travel, no texts.
    """
    levels = [written(_ranked(solved), "repair-level")]
    while most > 1:
        parts = levels[-1].withColumn("parent", F.floor(F.col("block") / fan))
        levels.append(written(parts.groupBy("conv", "parent").applyInPandas(_combined, MATRIX), "repair-level"))
        most = -(-most // fan)
    ends = levels[-1].where((F.col("at") == EMPTY) & (F.col("till") == END)).select("conv", "block", F.col("at").alias("from"), F.col("till").alias("to"))
    for level in reversed(levels[:-1]):
        parts = level.withColumn("parent", F.floor(F.col("block") / fan)).join(ends.withColumnRenamed("block", "parent"), ["conv", "parent"])
        ends = written(parts.groupBy("conv", "parent").applyInPandas(_placed, "conv string, block long, from int, to int"), "repair-ends")
    return ends.select("conv", "block", F.col("from").alias("at"), F.col("to").alias("till"))


def _ranked(solved: DataFrame) -> DataFrame:
    def ranks(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(rank=frame["edits"].rank(method="dense").astype("int32") - 1)[["conv", "block", "at", "till", "cost", "rank"]]

    return solved.groupBy("conv", "block").applyInPandas(ranks, MATRIX)


# --- rows -----------------------------------------------------------------------------


def _marked(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows under working names. ``conv`` is never null; ``has`` is 0 and ``t`` 0 for a null turn."""
    text = F.coalesce(F.col(text_col), F.lit(" "))
    rows = df.select(
        F.coalesce(F.concat(F.lit("v"), F.col(conv_col).cast("string")), F.lit("n")).alias("conv"), F.col(conv_col).alias("conv_id"),
        F.col(turn_col).isNotNull().cast("int").alias("has"), F.coalesce(F.col(turn_col), F.lit(0)).cast("long").alias("t"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), text.alias("text"),
    )
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _symbols(rows: DataFrame) -> DataFrame:
    """One row per different row of a conversation and turn: ``copies``, ``blank``, ``cut`` (truncated), ``again`` (seen earlier), ``kind`` (s, u, a, o)."""
    bare = F.btrim(F.col("text"), F.lit(BLANKS))
    first = F.substring("role", 1, 1)
    flagged = rows.select("conv", "has", "t", "role", "digest", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("kind"))
    once = flagged.groupBy("conv", "has", "t", "role", "digest").agg(F.count("*").alias("copies"), F.max("blank").alias("blank"), F.max("cut").alias("cut"), F.max("kind").alias("kind"))
    firsts = flagged.groupBy("conv", "role", "digest").agg(F.min(F.struct("has", "t")).alias("first"))
    firsts = firsts.select("conv", F.col("first.has").alias("has"), F.col("first.t").alias("t"), "role", "digest", F.lit(False).alias("again"))
    return once.join(firsts, ["conv", "has", "t", "role", "digest"], "left").withColumn("again", F.coalesce("again", F.lit(True)))


class Repair:
    """Result of ``repair``: ``conversations``, ``edits`` and ``turns``."""

    def __init__(self, conversations: DataFrame, edits: DataFrame, turns: DataFrame):
        self.conversations, self.edits, self.turns = conversations, edits, turns


def repair(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    block: int = BLOCK, fan: int = FAN,
) -> Repair:
    """Find the faults of each conversation and its cheapest repair.

    A null role or text is one space, a null id a conversation of its own. Rows go by turn, null turns first; rows of one turn by
    role, then by the SHA-256 of their text, equal rows side by side. A role counts by its first character; an empty role, or one that
    does not begin with s, u or a, can't be kept as it is. The first fault of a row counts: blank, duplicate (role and text seen earlier),
    truncated. Costs: Keep 0, Rerole 3, Delete 4 (blank and duplicate rows must go), Insert 3, and 3 for a truncated row that stays.
    Of the cheapest edits the ASCII-least are taken. Very long texts count as any other. Extra columns are ignored, whatever their names.
    An empty table gives no rows. Turns are whole numbers; rows of one turn of one conversation are sorted in one task.

    * ``conversations``: ``conv_id``, ``rows``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``
    * ``edits``: ``conv_id``, ``position``, ``plan`` (inserted roles, then D, K, U or A) for each row in order; a last one may hold inserts only
    * ``turns``: the repaired rows: ``conv_id``, ``position`` (of the row), ``nth`` (from 0 at that position, inserts first), ``role``, ``text``
    """
    rows = _marked(df, conv_col, turn_col, role_col, text_col)
    order = ["has", "t", "role", "digest"]
    span = F.when(F.col("has") == 1, F.floor(F.col("t") / SPAN)).otherwise(F.lit(-(1 << 60)))
    placed = written(add_running_sum(_symbols(rows), ["conv"], order, span, {"end": F.col("copies")}).withColumn("start", F.col("end") - F.col("copies")), "repair-rows")

    # signatures by blocks; a row's copies may fill many blocks
    here = F.greatest(F.col("start"), F.col("block") * block)
    size = (F.least(F.col("end"), (F.col("block") + 1) * block) - here).cast("int")
    lead = F.when(F.col("blank") | F.col("again"), "X").otherwise(F.when(F.col("cut"), F.upper("kind")).otherwise(F.col("kind")))
    cells = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block)))).withColumn("here", here).withColumn("size", size)
    part = F.when(F.col("here") == F.col("start"), F.concat(lead, F.repeat(F.lit("X"), F.col("size") - 1))).otherwise(F.repeat(F.lit("X"), F.col("size")))
    packed = cells.groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("here", part.alias("part"), F.expr("repeat(kind, size)").alias("kinds")))).alias("cells"))
    packed = packed.select("conv", "block", F.array_join("cells.part", "").alias("signature"), F.array_join("cells.kinds", "").alias("kinds"))
    totals = placed.groupBy("conv").agg(
        F.sum("copies").alias("rows"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("copies") - F.when(F.col("again"), 0).otherwise(1)).otherwise(0)).alias("duplicate"),
        F.sum((~F.col("blank") & ~F.col("again") & F.col("cut")).cast("long")).alias("truncated"),
        F.min(F.when(F.col("has") == 1, F.col("t"))).alias("low"), F.max(F.when(F.col("has") == 1, F.col("t"))).alias("high"),
    )
    turns_of = placed.where("has = 1").select("conv", "t").distinct().groupBy("conv").agg(F.count("*").alias("different"))
    totals = written(totals.join(turns_of, "conv", "left").withColumn("gaps", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("different"), F.lit(0))).drop("low", "high", "different"), "repair-totals")
    blocks = packed.join(totals.select("conv", F.floor((F.col("rows") - 1) / block).alias("final")), "conv").withColumn("last", F.col("block") == F.col("final"))
    blocks = written(blocks, "repair-blocks")

    pairs = F.transform(F.sequence(F.lit(1), F.length("kinds")), lambda i: F.col("kinds").substr(i, F.lit(2)))
    wrong = F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin("su", "ua", "au")))
    inside = blocks.select("conv", "block", wrong.alias("wrong"), F.left("kinds", F.lit(1)).alias("first"))
    ahead = blocks.where("not last").select("conv", (F.col("block") + 1).alias("block"), F.right("kinds", F.lit(1)).alias("before"))
    illegal = inside.join(ahead, ["conv", "block"], "left").groupBy("conv").agg(F.sum(F.col("wrong") + F.coalesce((~F.concat("before", "first").isin("su", "ua", "au")).cast("int"), F.lit(0))).alias("illegal"))

    solved = written(solve(blocks.select("conv", "block", "signature", "last")), "repair-solved")
    most = (blocks.agg(F.max("final")).first()[0] or 0) + 1
    best = solved.where((F.col("block") == 0) & (F.col("till") == END))  # all of a conversation of one block
    if most > 1:
        long = solved.join(blocks.where("final > 0").select("conv", "block"), ["conv", "block"])
        best = best.unionByName(long.join(chosen(long, most, fan), ["conv", "block", "at", "till"]).select(*best.columns))
    audits = best.groupBy("conv").agg(F.sum("cost").cast("long").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "edits"))), lambda x: x["edits"]), "").alias("audit"))

    ids = df.select(F.coalesce(F.concat(F.lit("v"), F.col(conv_col).cast("string")), F.lit("n")).alias("conv"), F.col(conv_col).alias("conv_id")).distinct()
    conversations = ids.join(totals.join(illegal, "conv").join(audits, "conv"), "conv").select("conv_id", "rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    steps = F.array_compact(F.concat(F.regexp_extract_all("plan", F.lit("[ua]*[DKUA]"), F.lit(0)), F.array(F.nullif(F.regexp_extract("plan", "[ua]*$", 0), F.lit("")))))
    edits = best.select("conv", "block", F.posexplode(steps).alias("k", "plan")).select("conv", (F.col("block") * block + F.col("k")).alias("position"), "plan")
    named = edits.where(~F.col("plan").like("%D")).join(placed.select("conv", F.col("start").alias("position"), *order), ["conv", "position"], "left")
    # equal rows of one turn are deleted but for one, so any of them gives the text
    texts = rows.groupBy("conv", "conv_id", *order).agg(F.any_value("text").alias("text"))
    kept = named.where("has IS NOT NULL").join(texts, ["conv", *order])
    full = kept.select("conv", "conv_id", "position", "plan", "role", "text").unionByName(named.where("has IS NULL").join(ids, "conv").select("conv", "conv_id", "position", "plan", F.lit("").alias("role"), F.lit("").alias("text")))
    return Repair(conversations, edits.join(ids, "conv").select("conv_id", "position", "plan"), full.select("conv_id", "position", F.posexplode(_items()).alias("nth", "item")).select("conv_id", "position", "nth", "item.role", "item.text"))


def _items() -> Column:
    """Inserted turns of a step, then its row."""
    role = lambda letter: F.when(letter == "u", "user").otherwise("assistant")
    own = F.right("plan", F.lit(1))
    inserted = F.transform(F.filter(F.split("plan", ""), lambda x: x.isin("u", "a")), lambda x: F.struct(role(x).alias("role"), F.lit("").alias("text")))
    row = F.struct(F.when(own == "K", F.col("role")).otherwise(role(F.lower(own))).alias("role"), F.col("text").alias("text"))
    return F.when(own.isin("u", "a"), inserted).otherwise(F.concat(inserted, F.array(row)))


def text_hashes(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``sha256`` of the lines ``role:text`` in order. SHA-256 is a chain over the text, so a conversation's rows pass
    through one task, sorted by Spark; the task holds a batch of rows and one hash state, not the conversation."""

    def chain(batches):
        conv, state, names, hashes = None, None, [], []
        for batch in batches:
            for key, conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or key != conv:
                    if state is not None:
                        hashes.append(state.hexdigest())
                    conv, state = key, hashlib.sha256()
                    names.append(conv_id)
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if len(hashes) > 1:  # the last conversation may go on
                n = len(hashes)
                yield pa.RecordBatch.from_arrays([pa.array(names[:n], kind), pa.array(hashes, pa.string())], ["conv_id", "sha256"])
                names, hashes = names[n:], []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array([*hashes, state.hexdigest()], pa.string())], ["conv_id", "sha256"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(turns.schema["conv_id"].dataType)
    keyed = turns.withColumn("conv", F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")))
    ordered = keyed.repartition("conv").sortWithinPartitions("conv", "position", "nth").select("conv", "conv_id", "role", "text")
    return ordered.mapInArrow(chain, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, sha256 string")


def damage(df: DataFrame) -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) % 20 (nulls: one space): 0 drops, 1 empties the text, 2 removes its ``[.!?]``, 3 repeats the row, 4 sets the role user."""
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    kept = df.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind <> 0")
    return kept.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


@query()
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    fixed = repair(damage(conversations))
    hashes = text_hashes(fixed.turns)
    every = conversations.select("conv_id").distinct()
    a, b = fixed.conversations.withColumnRenamed("conv_id", "c1"), hashes.withColumnRenamed("conv_id", "c2")
    out = every.join(a, F.col("conv_id").eqNullSafe(F.col("c1")) & F.col("rows").isNotNull(), "left").join(b, F.col("conv_id").eqNullSafe(F.col("c2")) & F.col("sha256").isNotNull(), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
