"""Repeated substrings of a minimum length, by interval expansion on a Burrows-Wheeler transform.

A byte goes when a string of ``LENGTH`` bytes over it also starts earlier (smaller id, or same document and smaller offset).
The transform is never built over the whole corpus. Strings that can be equal are brought together first:

1. Each window of ``LENGTH`` bytes has an anchor: the ``ANCHOR`` bytes in it with the smallest hash, the leftmost of equals. Equal
   windows have equal anchors at equal places. Consecutive windows with one anchor form a run (about 35 windows, at most 168
   bytes). Every task combines its own anchors, then anchors meet by hash; runs whose anchor stands nowhere else are done.
2. The other runs are cut from the texts. Equal runs are combined: all but the earliest are covered as a whole.
3. Different runs with the same anchor and the same 34 bytes before or after it meet in batches of bounded size. A
   batch's suffixes are sorted, and intervals are extended backwards, breadth first, on its transform. Level l sets the common
   prefixes of l - 1 bytes; the expansion stops at ``LENGTH``, and boundaries not set by then separate no equal windows.
4. A group of runs too large for a batch (a frequent short passage with ever other neighbours) is compared window by
   window through digests instead; the result is the same.

Texts move twice, compressed: to cut the runs, and to meet the spans to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from scrollwork.llm.common import docs_of, query, table, written
from scrollwork.llm.words import BASE, CODES, mixed

LENGTH, ANCHOR = 100, 32
REACH = LENGTH - ANCHOR + 1
SIDE = 34
PART = 1 << 19
PACKED = 7  # symbols of 9 bits in 63
FLUSH = 32 << 20
GROUP = 20_000
BATCH = 1 << 20
SALTS = 16
PLACE = np.uint64((1 << 20) - 1)


def anchor_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: text, first window, its distance to the anchor, number of windows, anchor hash."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    if len(raw) < LENGTH:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    starts = np.cumsum(lengths) - lengths
    h, size = CODES[raw], 1
    while size < ANCHOR:
        h = h[:-size] * np.uint64(pow(int(BASE), size, 1 << 64)) + h[size:]
        size *= 2
    h = mixed(h)
    key = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    full = -len(key) % REACH
    blocks = np.append(key, np.full(full, ~np.uint64(0))).reshape(-1, REACH)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(raw) - LENGTH + 1
    place = (np.minimum(after[:n], before[REACH - 1 : REACH - 1 + n]) & PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), lengths)
    whole = text[:n] == text[LENGTH - 1 :]
    new = np.append(True, (place[1:] != place[:-1]) | (text[1:n] != text[: n - 1]) | ~whole[:-1]) & whole
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    many = np.bincount(group[whole], minlength=len(first))
    return text[first], first - starts[text[first]], place[first] - first, many, h[place[first]]


def parts_of(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Groups of bounded size: parts, the text of each, and its offset. Parts of a long text overlap by ``LENGTH - 1``, so no window is lost or doubled."""
    group, owner, offset, size = [], [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), PART):
            group.append(t[at : at + PART + LENGTH - 1])
            owner.append(k)
            offset.append(at)
            size += len(group[-1])
            if size >= PART - LENGTH:
                yield group, owner, offset
                group, owner, offset, size = [], [], [], 0
    if group:
        yield group, owner, offset


def find_runs(docs: DataFrame) -> DataFrame:
    """``rid`` and ``runs`` (first window, distance to the anchor, number of windows, packed into a long) of runs whose anchor stands elsewhere too."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        rid, pack, anchor = (np.concatenate(c) for c in zip(*held))
        _, first, inverse, n = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
        known = n[inverse] > 1
        # one row per task and anchor looks for others; further ones are known to repeat and go anywhere
        other = np.ones(len(anchor), bool)
        other[first] = False
        key = np.where(other, mixed(rid.view(np.uint64) + pack.view(np.uint64) * BASE), anchor)
        for at in range(0, len(key), 1 << 17):
            cut = slice(at, at + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(key[cut].view(np.int64)), pa.array(rid[cut]), pa.array(pack[cut]), pa.array(known[cut])], ["key", "rid", "run", "known"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            rids, ids, texts = (batch.column(k).to_pylist() for k in range(3))
            best: dict[str, int] = {}
            for k, t in enumerate(texts):  # of equal texts in a batch the earliest is enough; copies are covered as wholes
                if t not in best or ids[k] < ids[best[t]]:
                    best[t] = k
            chosen = sorted(best.values())
            rid = np.array(rids, np.int64)[chosen]
            for group, owner, offset in parts_of([texts[k].encode() for k in chosen]):
                text, first, left, many, anchor = anchor_runs(group)
                at = first + np.array(offset, np.int64)[text]
                held.append((rid[np.array(owner)[text]], at << 16 | left << 8 | many, anchor))
                size += sum(map(len, group))
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    found = docs.select("rid", "doc_id", "text").mapInArrow(emit, "key long, rid long, run long, known boolean")
    shared = F.count("*").over(Window.partitionBy("key")) > 1  # at most one row per task and key
    return found.withColumn("shared", shared).where("known OR shared").groupBy("rid").agg(F.collect_set("run").alias("runs"))


def train(docs: DataFrame, sample_docs: int = 400, sample_bytes: int = 1 << 14) -> bytes:
    """A zstandard dictionary from at most ``sample_docs`` texts of at most ``sample_bytes`` bytes, the first by hash; it only shortens what is moved."""
    h = F.xxhash64("text", "doc_id")
    rows = docs.where(F.octet_length("text") <= sample_bytes).select(h.alias("h"), "rid").orderBy("h").limit(sample_docs).select("rid").collect()
    texts = sorted(r[0].encode() for r in docs.where(F.col("rid").isin([r[0] for r in rows])).where(F.octet_length("text") <= sample_bytes).select("text").distinct().limit(sample_docs).collect()) if rows else []
    try:
        return zstandard.train_dictionary(1 << 16, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def squeezed(docs: DataFrame, dictionary: bytes) -> DataFrame:
    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=6, dict_data=_dictionary(dictionary))
        for batch in batches:
            z = [c.compress(t.encode()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary())], ["rid", "doc_id", "z"])

    return docs.select("rid", "doc_id", "text").mapInArrow(squeeze, "rid long, doc_id long, z binary")


def cut_runs(rows: DataFrame, dictionary: bytes) -> DataFrame:
    """``rid``, ``doc_id``, ``start``, ``stop``, ``left``, ``run`` (bytes) from ``rid``, ``doc_id``, ``z``, ``runs``.

    A task combines its equal runs: all but the earliest are known to be covered, and their ``run`` is null.
    """

    def flush(best: dict[bytes, tuple], later: list[tuple]) -> Iterator[pa.RecordBatch]:
        out = [(*v, k) for k, v in best.items()] + [(*v, None) for v in later]
        for at in range(0, len(out), 50_000):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 50_000]), kinds)], ["doc_id", "start", "rid", "stop", "left", "run"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        best: dict[bytes, tuple] = {}
        later: list[tuple] = []
        for batch in batches:
            for r, i, data, packs in zip(*(batch.column(k).to_pylist() for k in range(4))):
                text = d.decompress(data)
                for p in packs:
                    start = p >> 16
                    stop = start + (p & 255) + LENGTH - 1
                    run, row = text[start:stop], (i, start, r, stop, p >> 8 & 255)
                    other = best.get(run)
                    if other is None or row[:2] < other[:2]:
                        best[run] = row
                        row = other
                    if row is not None:
                        # the same place again (a repeated row) is not later than itself
                        later.append(row) if row[:2] != best[run][:2] else None
                if len(best) + len(later) > 200_000:
                    yield from flush(best, later)
                    best, later = {}, []
        yield from flush(best, later)

    return rows.select("rid", "doc_id", "z", "runs").mapInArrow(cut, "doc_id long, start long, rid long, stop long, left int, run binary")


def suffix_array(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``length`` symbols at least, the place of each, and of each place: whether its suffix
    shares less than ``PACKED`` symbols with the one before, and whether exactly one less.

    ``codes``: a byte and one, or 0 for the end of a string; ends differ from each other, in the order of the strings. The first
    sort takes ``PACKED`` symbols at once; prefix doubling then sorts only suffixes that are not told apart yet. Suffixes that
    share ``length`` symbols stand together, in any order.
    """
    n, step = len(codes), min(PACKED, length)
    symbols = np.append(codes, np.zeros(step, codes.dtype))
    key, going = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(step):
        key <<= 9
        key |= symbols[k : n + k] * going
        going &= symbols[k : n + k] > 0
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    head = np.append(True, (key[1:] != key[:-1]) | (key[1:] & 511 == 0))[:n]
    key >>= 9
    seed = head & np.append(False, (key[1:] == key[:-1]) & (key[1:] & 511 > 0))[:n]
    rank = np.empty(n, np.int32)  # place of the first suffix that is not told apart from this one
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0))
    at = np.flatnonzero(~(head & np.append(head[1:], True)))  # places of suffixes that are not alone
    while len(at) and step < length:
        of = order[at]
        key = rank[of].astype(np.int64) << 32 | rank[of + step]  # suffixes that are not alone are longer than step
        by = np.argsort(key, kind="stable")
        of, key = of[by], key[by]
        order[at] = of
        first = np.append(True, key[1:] != key[:-1])
        rank[of] = np.maximum.accumulate(np.where(first, at, 0))
        at = at[~(first & np.append(first[1:], True))]
        step *= 2
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    return order, place, head, seed


def equal_windows(strings: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``length`` (at least 2) bytes that stand more than once in ``strings``: string, offset, and class of equal windows.

    Intervals of the suffix array stand for strings; ``open_`` marks boundaries between neighbours whose common
    prefix is not known yet. Level l extends the intervals of the level before by each byte in front of them, and closes
    the boundary behind every interval that still has an open one; only such intervals are extended further. The first
    ``PACKED`` levels are read off the packed symbols.
    """
    raw = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8)
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    ends = np.cumsum(sizes) - 1
    codes = raw.astype(np.int16) + np.int16(1)
    codes[ends] = 0
    sa, isa, head, seed = suffix_array(codes, length)
    n = len(sa)
    front = isa[sa - 1]  # suffix array place of the suffix one longer
    symbol = codes[sa]
    other = np.append(True, (symbol[1:] != symbol[:-1]) | (symbol[1:] == 0))[:n]  # places whose first symbol differs from the one before
    open_ = np.append(~head, False)
    heads = np.append(np.flatnonzero(head), n)
    new = np.append(seed, False)[heads[1:]]
    low, high = heads[:-1][new], heads[1:][new]
    owner = np.full(n, -1, np.int32)
    for _ in range(length - PACKED):
        if not len(low):
            break
        size = high - low
        to = front[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        owner[to] = np.repeat(np.arange(len(low), dtype=np.int32), size)
        got = np.sort(to) if len(to) < n >> 4 else np.flatnonzero(owner >= 0)
        whose = owner[got]
        owner[got] = -1
        cut = np.flatnonzero((np.diff(got) != 1) | (whose[1:] != whose[:-1]) | other[got[1:]]) + 1
        low, high = got[np.append(0, cut)].astype(np.int64), got[np.append(cut - 1, len(got) - 1)].astype(np.int64) + 1
        new = open_[high]
        low, high = low[new], high[new]
        open_[high] = False
    # neighbours with an open boundary share `length` bytes or more
    text = np.searchsorted(ends, sa)
    offset = sa - (ends[text] + 1 - sizes[text])
    klass = np.cumsum(~open_[:n]) - 1
    many = np.bincount(klass, minlength=klass[-1] + 1)[klass] > 1
    long = sizes[text] - 1 - offset >= length
    keep = many & long
    return text[keep], offset[keep], klass[keep]


def covered(batch: list[tuple]) -> list[tuple]:
    """``(rid, start, stop)`` of windows that start earlier elsewhere, from ``(key, rid, doc_id, start, string)``."""
    rid = np.array([b[1] for b in batch], np.int64)
    doc, start = np.array([b[2] for b in batch], np.int64), np.array([b[3] for b in batch], np.int64)
    text, offset, klass = equal_windows([b[4] for b in batch])
    at, d = start[text] + offset, doc[text]
    order = np.lexsort((at, d, klass))
    text, at, d, klass = text[order], at[order], d[order], klass[order]
    head = np.append(True, klass[1:] != klass[:-1])[: len(klass)]
    lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(klass) else np.zeros(0, np.int64)
    later = (at != at[lead]) | (d != d[lead])
    text, at = text[later], at[later]
    order = np.lexsort((at, text))
    text, at = text[order], at[order]
    cut = np.flatnonzero((text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    first, last = np.append(0, cut)[: len(text)], np.append(cut - 1, len(text) - 1)[: len(text)]
    return list(zip(rid[text[first]].tolist(), at[first].tolist(), (at[last] + LENGTH).tolist())) if len(text) else []


def expand(pieces: DataFrame) -> DataFrame:
    """Spans from pieces ``key``, ``rid``, ``doc_id``, ``start``, ``piece``; the rows of a key follow each other."""

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        found = covered(rows) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], [], []))], ["rid", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, size = [], [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if group and row[0] != group[0][0]:
                    if len(group) > 1:
                        held += group
                        size += sum(len(r[4]) for r in group)
                    group = []
                    if size >= BATCH:
                        yield spans(held)
                        held, size = [], 0
                group.append(row)
        if len(group) > 1:
            held += group
        yield spans(held)

    return pieces.sortWithinPartitions("key").select("key", "rid", "doc_id", "start", "piece").mapInArrow(run, "rid long, start long, stop long")


def repeated_spans(docs: DataFrame, dictionary: bytes) -> DataFrame:
    """``rid``, ``start``, ``stop``: bytes to remove, spans may overlap. ``docs``: ``rid``, ``doc_id`` (no nulls), ``text``."""
    named = docs.select("rid", "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("stop")).where(F.col("stop") >= LENGTH)
    salt = F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int").alias("salt")
    all_salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    earliest = named.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first", all_salts)
    copies = named.select("*", salt).join(earliest, ["digest", "salt"]).where("doc_id > first").select("rid", F.lit(0).cast("long").alias("start"), "stop")

    hits = written(find_runs(docs), "runs", "zstd")
    runs = written(cut_runs(squeezed(docs, dictionary).join(hits, "rid"), dictionary), "cut-runs", "zstd")
    known = runs.where("run IS NULL").select("rid", "start", "stop")
    runs = runs.where("run IS NOT NULL")
    # a run comes at most once from each flush of a task, so no list is long; equal runs have equal places of the anchor
    place = F.struct("doc_id", "start", "rid")
    distinct = runs.groupBy("run", "left").agg(F.sort_array(F.collect_list(place)).alias("places"))
    at = F.element_at("places", 1)
    others = F.expr("filter(places, p -> p.doc_id <> places[0].doc_id OR p.start <> places[0].start)")
    distinct = written(distinct.select("run", "left", at["doc_id"].alias("doc_id"), at["start"].alias("start"), at["rid"].alias("rid"), others.alias("others")), "distinct-runs", "zstd")
    again = distinct.select(F.octet_length("run").alias("size"), F.explode("others").alias("o")).select("o.rid", "o.start", (F.col("o.start") + F.col("size")).alias("stop"))

    left, size = F.col("left"), F.octet_length("run")
    skip = F.greatest(left - (SIDE - 1), F.lit(0))
    before = F.struct(F.xxhash64(F.lit("before"), F.expr(f"substring(run, left - {SIDE} + 1, {SIDE + ANCHOR})")).alias("key"), F.lit(0).alias("skip"), F.expr(f"substring(run, 1, left - {SIDE} + {LENGTH})").alias("piece"))
    after = F.struct(F.xxhash64(F.lit("after"), F.expr(f"substring(run, left + 1, {SIDE + ANCHOR})")).alias("key"), skip.alias("skip"), F.expr(f"substring(run, greatest(left - {SIDE - 1}, 0) + 1)").alias("piece"))
    both = F.filter(F.array(F.when(left >= SIDE, before), F.when(size - skip >= LENGTH, after)), lambda p: p.isNotNull())
    pieces = distinct.select("rid", "doc_id", "start", F.explode(both).alias("p")).select(F.col("p.key").alias("key"), "rid", "doc_id", (F.col("start") + F.col("p.skip")).alias("start"), F.col("p.piece").alias("piece"))
    sizes = written(pieces.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "piece-sizes")
    # the window sees to it that the pieces of a key meet in one task, whichever join Spark takes; at most GROUP have one key
    meet = pieces.join(sizes.where(F.col("n") <= GROUP), "key").withColumn("met", F.count("*").over(Window.partitionBy("key")))
    spans = expand(meet.where("met > 1"))
    out = copies.unionByName(known).unionByName(again).unionByName(spans)
    large = sizes.where(F.col("n") > GROUP)
    if not large.isEmpty():
        windows = pieces.join(large, "key").select("rid", "doc_id", "start", "piece", F.explode(F.sequence(F.lit(0), F.octet_length("piece") - LENGTH)).alias("j"))
        windows = windows.select("rid", "doc_id", (F.col("start") + F.col("j")).alias("start"), F.expr(f"unhex(md5(substring(piece, j + 1, {LENGTH})))").alias("digest"), salt)
        first = windows.groupBy("digest").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.count("*").alias("n")).where("n > 1").select("digest", "f", all_salts)
        later = windows.join(first, ["digest", "salt"]).where("doc_id <> f.doc_id OR start <> f.start")
        out = out.unionByName(later.select("rid", "start", (F.col("start") + LENGTH).alias("stop")))
    return out


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, and ``kept`` (bytes left) if ``with_text``.

    Null and empty texts have no bytes; texts under ``LENGTH`` bytes lose nothing. A null id counts as larger than all others. Rows
    that repeat id and text are one document: neither is earlier, both get the same result. An empty table gives no rows. Other
    columns are ignored. Removal works on bytes and may cut a character, so ``kept`` is binary.
    """
    rows = docs_of(df, id_col, text_col)
    last = F.lit((1 << 63) - 1)
    docs = rows.select(F.xxhash64("doc_id", "text").alias("rid"), F.coalesce("doc_id", last).alias("doc_id"), "text")
    dictionary = train(docs)
    spans = written(repeated_spans(docs, dictionary).distinct().groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            out = []
            for doc_id, z, found in zip(*(batch.column(k).to_pylist() for k in range(3))):
                data, kept, at, n = d.decompress(z), [], 0, 0
                for start, stop in sorted((x["start"], x["stop"]) for x in found or ()):
                    if start > at or not n:
                        kept.append(data[at:start])
                        n += 1
                    at = max(at, stop)
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((None if doc_id == (1 << 63) - 1 else doc_id, len(data), len(data) - len(rest), n, hashlib.sha256(rest).hexdigest(), rest if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)][: 6 if with_text else 5], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_text else 5])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return squeezed(docs, dictionary).join(spans, "rid", "left").select("doc_id", "z", "spans").mapInArrow(apply, schema)


@query()
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents"), with_text=False)
