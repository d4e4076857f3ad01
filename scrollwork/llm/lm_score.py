"""Language-model scores from a weighted back-off automaton.

The model spells tokens: a text is its tokens' bytes, a blank after each, and one end. N-grams of up to ``ORDER`` bytes of the
training texts, smoothed by interpolated Kneser-Ney, become the automaton: a state is a context, its arcs are the
n-grams that extend it, and its failure arc leads, at a cost, to the state of the next shorter context. The last
``ORDER - 1`` symbols decide on the state, so all positions of a text take their transitions side by side.

The model grows with the corpus, so none of it is broadcast but n-grams of up to two bytes. Documents form blocks of bounded
size (runs of rows of a file). A block's distinct n-grams and words are counted where they are read, once; counts are
summed by key over all blocks; the model is built by joins, order by order. Transitions that occur in texts but are no arcs
follow their failure arcs by a join too, once per distinct transition. Each block gets back the weights of its own
transitions, which is enough to score it exactly; its texts follow them in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scrollwork.llm.common import fold, query, small_batches, table, written
from scrollwork.llm.words import MIX, PRINTED, words

ORDER = 6
END = 10  # no token holds a line feed
WORD = 7  # kind of a key that is a word; kinds 1 .. ORDER are n-grams
SHORT = 2  # n-grams of so many bytes are few enough to broadcast
BLOCK_BYTES = 32 << 20
UNIFORM = 257
SCALE = 1e7


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, with ``ORDER - 1`` start symbols before each, and where each text begins."""
    raw = np.frombuffer(b"".join(b"\n" * (ORDER - 1) + t + b" \n" for t in texts), np.uint8)
    lengths = np.array([len(t) + ORDER + 1 for t in texts], np.int64)
    starts = np.append(0, np.cumsum(lengths)[:-1])
    printed = PRINTED[raw]
    keep = printed.copy()
    keep[1:] |= printed[:-1]
    out = np.where(printed, raw, np.uint8(32))
    for k in range(ORDER - 1):
        keep[starts + k] = True
        out[starts + k] = END
    ends = starts + lengths - 1
    keep[ends] = True
    out[ends] = END
    many = np.add.reduceat(keep, starts, dtype=np.int64)
    return out[keep], np.cumsum(many) - many


def grams(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Codes of the n-grams of the top order, none of which crosses from one text to the next."""
    two = s[:-1].astype(np.uint16) << np.uint16(8) | s[1:]
    four = two[:-2].astype(np.uint32) << np.uint32(16) | two[2:]
    g = four[:-2].astype(np.uint64) << np.uint64(16) | two[4:]
    ok = np.ones(len(g), bool)
    for k in range(1, ORDER):
        ok[starts[1:] - k] = False
    return g[ok]


def lowered(texts: list[str]) -> Iterator[tuple[list[bytes], list[int]]]:
    """Groups of whole texts with A-Z in lower case."""
    group, owner, size = [], [], 0
    for k, t in enumerate(texts):
        group.append(t.encode("utf-8", "replace").lower())
        owner.append(k)
        size += len(group[-1])
        if size >= 1 << 19:
            yield group, owner
            group, owner, size = [], [], 0
    if group:
        yield group, owner


class Tally:
    """Distinct keys with their sums, merged as they come."""

    def __init__(self):
        self.keys, self.n, self.waiting, self.held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, weight: int) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.waiting.append((k, n * weight))
        self.held += len(k)
        if self.held > max(1 << 20, len(self.keys)):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        n = np.concatenate([self.n, *(n for _, n in self.waiting)])
        self.waiting, self.held = [], 0
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.n = keys[first], np.add.reduceat(n, first) if len(first) else n
        return self.keys, self.n


def block_keys(docs: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
    """``block``, ``kind``, ``key``, ``n`` (occurrences in training texts): distinct n-grams of the top order and words of a block, per task."""

    def emit(block: int, top: Tally, named: Tally) -> Iterator[pa.RecordBatch]:
        codes, n = top.merge()
        for kind in kinds:
            if kind == WORD:
                k, m = named.merge()
            else:
                k, m = codes, n
            for at in range(0, len(k), 1 << 17):
                part = k[at : at + (1 << 17)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), block, np.int64)), pa.array(np.full(len(part), kind, np.int8)), pa.array(part.view(np.int64)), pa.array(m[at : at + (1 << 17)])], ["block", "kind", "key", "n"]
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, top, named = None, Tally(), Tally()
        for batch in batches:
            of, learns = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (learns[1:] != learns[:-1])) + 1
            for at, end in zip([0, *cuts], [*cuts, len(of)]):  # rows of a block follow each other in a file
                if at == end:
                    continue
                if of[at] != block:
                    if block is not None:
                        yield from emit(block, top, named)
                    block, top, named = of[at], Tally(), Tally()
                for k in range(at, end, 256):
                    for group, _ in lowered(batch.column(2).slice(k, min(256, end - k)).to_pylist()):
                        top.add(grams(*symbols(group)), int(learns[at]))
                        if WORD in kinds:
                            named.add(words(group, PRINTED)[0], int(learns[at]))
        if block is not None:
            yield from emit(block, top, named)

    return docs.select("block", "learn", "text").mapInArrow(count, "block long, kind byte, key long, n long")


def build(counts: DataFrame) -> DataFrame:
    """The automaton as rows ``kind``, ``key``, ``logp`` (arc) and ``bow`` (failure cost of the state; null where the n-gram is no context).

    ``counts``: ``key``, ``n`` of the top order. The empty context is the row of kind 0; its ``bow`` includes the uniform
    distribution over all bytes and the end.
    """
    level, levels = counts, {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        level = level.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("key")).agg(F.count("*").alias("n"))
        level = levels[k] = written(level, f"order-{k}")
    stats = {k: v.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first() for k, v in levels.items()}
    below, out = None, []
    for k in range(1, ORDER + 1):
        ones, twos = stats[k]
        discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
        rows = levels[k].withColumns({"context": F.shiftright("key", 8), "suffix": F.col("key").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))})
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), (F.lit(discount) * F.count("*") / F.sum("n")).alias("left"))
        rows = rows.join(contexts, "context")
        if below is None:
            rows = rows.withColumn("rest", F.lit(1.0 / UNIFORM))
        else:
            rows = rows.join(below.select(F.col("key").alias("suffix"), F.col("p").alias("rest")), "suffix")
        p = written(rows.select("key", ((F.col("n") - discount) / F.col("total") + F.col("left") * F.col("rest")).alias("p")), f"p-{k}")
        bow = contexts.select(F.col("context").alias("key"), F.log10("left").alias("bow"))
        if k == 1:
            out.append(bow.select(F.lit(0).cast("byte").alias("kind"), "key", F.lit(None).cast("double").alias("logp"), (F.col("bow") - F.log10(F.lit(float(UNIFORM)))).alias("bow")))
        else:
            out.append(below.join(bow, "key", "full").select(F.lit(k - 1).cast("byte").alias("kind"), "key", F.log10("p").alias("logp"), "bow"))
        below = p
    out.append(below.select(F.lit(ORDER).cast("byte").alias("kind"), "key", F.log10("p").alias("logp"), F.lit(None).cast("double").alias("bow")))
    first, *others = out
    for o in others:
        first = first.unionByName(o)
    return first


class Table:
    """Index of 64-bit keys: open addressing, built and searched for whole arrays."""

    FREE = ~np.uint64(0)

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.slots = np.full(1 << bits, self.FREE), np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        at = self._hash(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.mask
        taken = self.slots >= 0
        self.keys[taken] = keys[self.slots[taken]]

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        h = keys * MIX
        h >>= self.shift
        return h.view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        at = self._hash(keys)
        got = self.slots.take(at)
        todo = np.flatnonzero(self.keys.take(at) != keys)
        got[todo] = -1
        at, wanted = at[todo], keys[todo]
        while len(todo):
            at = (at + 1) & self.mask
            key = self.keys[at]
            hit = key == wanted
            got[todo[hit]] = self.slots[at[hit]]
            on = ~hit & (key != self.FREE)
            todo, at, wanted = todo[on], at[on], wanted[on]
        return got


class Automaton:
    """States and arcs of n-grams that a block can reach. Entry 0 is the empty context."""

    def __init__(self, kind: np.ndarray, key: np.ndarray, logp: np.ndarray, bow: np.ndarray):
        root = np.flatnonzero(kind == 0)
        self.floor = float(bow[root[0]]) if len(root) else -float(np.log10(UNIFORM))
        rest = kind != 0
        length = np.append(0, kind[rest]).astype(np.uint64)
        code = np.append(np.uint64(0), key[rest].view(np.uint64))
        self.logp, self.bow = np.append(logp.dtype.type(0), logp[rest]), np.append(bow.dtype.type(0), bow[rest])
        self.is_arc, is_state = ~np.isnan(self.logp), ~np.isnan(self.bow)
        # the code with its length above it: the arc of state x and symbol c has the label (x << 8 | c) one longer
        self.length, self.code, self.is_state = length, code, is_state
        self.table = Table(self._label(length, code))

    @cached_property
    def fail(self) -> np.ndarray:
        return self.state(self.code, self.length.astype(np.int64) - 1)

    @cached_property
    def next(self) -> np.ndarray:
        return self.state(self.code, np.minimum(self.length.astype(np.int64), ORDER - 1))

    def state(self, code: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The state of the longest context, of at most ``size`` symbols, in which each code ends."""
        out, todo = np.zeros(len(code), np.int32), np.arange(len(code))
        while len(todo):
            todo, size = todo[size > 0], size[size > 0]
            mask = (np.uint64(1) << (np.uint64(8) * size.astype(np.uint64))) - np.uint64(1)
            got = self.table.find(self._label(size.astype(np.uint64), code[todo] & mask))
            ok = (got >= 0) & self.is_state[np.maximum(got, 0)]
            out[todo[ok]] = got[ok]
            todo, size = todo[~ok], size[~ok] - 1
        return out

    @staticmethod
    def _label(length: np.ndarray, code: np.ndarray) -> np.ndarray:
        return (length << np.uint64(56)) | code

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and log probabilities."""
        cost, out = np.zeros(len(state)), np.zeros(len(state), np.int32)
        todo, s, c = np.arange(len(state)), state, symbol.astype(np.uint64)
        while len(todo):
            got = self.table.find(self._label(self.length[s] + np.uint64(1), (self.code[s] << np.uint64(8)) | c))
            ok = (got >= 0) & self.is_arc[np.maximum(got, 0)]
            out[todo[ok]] = self.next[got[ok]]
            cost[todo[ok]] += self.logp[got[ok]]
            todo, s, c = todo[~ok], s[~ok], c[~ok]
            ended = s == 0
            cost[todo[ended]] += self.floor
            cost[todo[~ended]] += self.bow[s[~ended]]
            todo, s, c = todo[~ended], self.fail[s[~ended]], c[~ended]
        return out, cost

    def score(self, s: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log10 probability of each text. Where an arc of the top order is at hand, it is taken; other positions start from their context."""
        codes = grams(s, starts)
        got = self.table.find(self._label(np.uint64(ORDER), codes))
        cost = self.logp.take(got, mode="wrap")
        rest = np.flatnonzero((got < 0) | ~self.is_arc.take(got, mode="wrap"))
        if len(rest):
            of = codes[rest]
            _, cost[rest] = self.step(self.state(of >> np.uint64(8), np.full(len(of), ORDER - 1)), of & np.uint64(255))
        return np.add.reduceat(cost, starts - (ORDER - 1) * np.arange(len(starts)))


def failed(automaton: DataFrame, codes: DataFrame) -> DataFrame:
    """``key`` and ``logp`` of distinct n-grams of the top order that are no arcs: the costs along their failure arcs, and of the arc found there."""

    def part(k: int, arc: bool) -> Column:
        code = F.col("key") if arc else F.shiftright("key", 8)
        return F.struct(F.lit(k).cast("byte").alias("kind"), code.bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("part"), F.lit(arc).alias("arc"))

    def looked_up(kinds: range, model: DataFrame) -> DataFrame:
        asked = codes.select("key", F.explode(F.array(*[part(k, arc) for k in kinds for arc in (True, False) if k or not arc])).alias("at")).select("key", "at.*")
        return asked.join(model.select(F.col("key").alias("part"), "kind", "logp", "bow"), ["part", "kind"], "left")

    short = looked_up(range(SHORT + 1), F.broadcast(automaton.where(F.col("kind") <= SHORT)))
    rows = short.unionByName(looked_up(range(SHORT + 1, ORDER), automaton.where((F.col("kind") > SHORT) & (F.col("kind") < ORDER))))
    bow = F.when(F.col("kind") == 0, F.coalesce("bow", F.lit(-float(np.log10(UNIFORM))))).otherwise(F.col("bow"))
    arc = F.max(F.when(F.col("arc") & F.col("logp").isNotNull(), F.struct("kind", "logp"))).alias("arc")
    # costs of failure by length of the context, so that those of shorter contexts than the arc's can be left out
    costs = [F.coalesce(F.max(F.when(~F.col("arc") & (F.col("kind") == k), bow)), F.lit(0.0)).alias(f"cost{k}") for k in range(ORDER)]
    found = rows.groupBy("key").agg(arc, *costs)
    total = F.coalesce("arc.logp", F.lit(0.0))
    for k in range(ORDER):
        total = total + F.when(F.coalesce("arc.kind", F.lit(0)) <= k, F.col(f"cost{k}")).otherwise(0.0)
    return found.select("key", total.alias("logp"))


def with_blocks(df: DataFrame, learn: Column, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text``, ``learn``, ``block``. A table that is not read from files is written first."""
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        df = written(df.select(id_col, text_col), "texts")
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = df.select(F.avg(F.octet_length(text) + 16)).first()[0] or 1.0
    rows = max(1, int(BLOCK_BYTES / size))
    block = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / rows))
    return df.select(F.col(id_col).alias("doc_id"), text.alias("text"), learn.alias("learn"), block.alias("block"))


def lm_scores(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``learned``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``learn`` says which rows are learned from. ``base_score`` is the sum of log10((c + 1) / (N + V + 1)) over the tokens with their
    counts c, ``score`` the automaton's log10 probability. Null and empty texts are the end token only. Without training rows all
    counts are 0 and the automaton is uniform. Weights of transitions travel with seven decimals. Repeated rows count and are scored as often as they stand; a null id has
    no effect unless ``learn`` says so. An empty table gives no rows. Words are told apart by 64-bit hashes.
    """
    small_batches(df)
    docs = with_blocks(df, learn, id_col, text_col)
    asked = written(block_keys(docs, (ORDER, WORD)), "asked", "zstd")
    sums = written(asked.groupBy("key", "kind").agg(F.sum("n").alias("n")), "counts")
    of_text, learned = F.col("kind") == ORDER, F.col("n") > 0
    n_train = docs.where("learn").count()
    totals = sums.where((F.col("kind") == WORD) & learned).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_tokens, n_words = totals[0] + n_train, totals[1] + (n_train > 0)
    automaton = written(build(sums.where(of_text & learned).select("key", "n")), "automaton")
    weights = automaton.where(of_text).select("key", "logp").unionByName(failed(automaton, sums.where(of_text & ~learned).select("key")))
    weights = weights.select("key", F.lit(ORDER).cast("byte").alias("kind"), F.round(F.col("logp") * SCALE).cast("long").alias("value"))
    model = weights.unionByName(sums.where(F.col("kind") == WORD).select("key", "kind", F.col("n").alias("value")))
    found = asked.select("block", "kind", "key").join(model, ["key", "kind"]).select("block", "kind", "key", "value")

    def tables(held: list[tuple]) -> tuple[Automaton, Table, np.ndarray]:
        kind, code, value = (np.concatenate(c) for c in zip(*held))
        named = kind == WORD
        arcs = ~named
        machine = Automaton(kind[arcs], code[arcs], value[arcs] / SCALE, np.full(int(arcs.sum()), np.nan))
        return machine, Table(code[named].view(np.uint64)), np.append(value[named], 0)

    def scored(mine: pa.RecordBatch, machine: Automaton, of_words: Table, counts: np.ndarray) -> pa.RecordBatch:
        rest = np.log10(n_tokens + n_words + 1.0)
        n, hits, base, score = (np.zeros(len(mine)) for _ in range(4))
        for at in range(0, len(mine), 256):
            for group, owner in lowered(mine.column("text").slice(at, 256).to_pylist()):
                owner = np.array(owner) + at
                h, whose = words(group, PRINTED)
                c = counts[of_words.find(h)]
                n[owner] = np.bincount(whose, minlength=len(group)) + 1
                hits[owner] = np.bincount(whose, c > 0, len(group)) + (n_train > 0)
                base[owner] = np.bincount(whose, np.log10(c + 1) - rest, len(group)) + np.log10(n_train + 1) - rest
                score[owner] = machine.score(*symbols(group))
        numbers = (n.astype(np.int64), hits.astype(np.int64), np.full(len(mine), n_tokens, np.int64), base, score)
        return pa.RecordBatch.from_arrays([mine.column("doc_id"), mine.column("learn"), *map(pa.array, numbers)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a key that several tasks asked for comes several times; that does no harm
        block, held, known = None, [], None
        for batch in batches:
            of, kind, key, value = (batch.column(c).to_numpy() for c in ("at", "kind", "key", "value"))
            cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
            for at, end in zip([0, *cuts], [*cuts, len(of)]):
                if at == end:
                    continue
                if of[at] & 1 == 0:
                    if of[at] != block:
                        block, held, known = of[at], [], None
                    held.append(tuple(c[at:end].copy() for c in (kind, key, value)))
                else:
                    if held:
                        known, held = tables(held), []
                    yield scored(batch.slice(at, end - at), *known)

    names = ["doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    types = [docs.schema["doc_id"].dataType.simpleString(), "boolean", "long", "long", "long", "double", "double"]
    # the weights of a block, then its texts: both come in batches of bounded size, and only the weights stay. Blocks whose
    # numbers differ in the last bit only would share their weights
    nothing = F.lit(0).cast("long")
    texts = docs.select("block", F.lit(0).cast("byte").alias("kind"), nothing.alias("key"), nothing.alias("value"), "doc_id", "learn", "text")
    rows = found.unionByName(texts, allowMissingColumns=True).withColumn("block", F.col("block").bitwiseAND(F.lit(-2)))
    at = F.when(F.col("kind") == 0, F.col("block").bitwiseOR(F.lit(1))).otherwise(F.col("block"))
    rows = rows.repartition("block").withColumn("at", at).sortWithinPartitions("at")
    return rows.select("at", "kind", "key", "value", "doc_id", "learn", "text").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in zip(names, types)))


@query()
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scores(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
