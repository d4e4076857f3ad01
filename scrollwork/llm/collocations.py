"""Collocations: frequent phrases of two to four words whose parts seldom stand apart.

1. Words are counted by language. What of them is frequent, and what is hot, goes to the tasks as two bitmaps of fixed size:
   a bit may be set for a rarer word, too, which costs time and changes nothing.
2. A suffix pointer is a place whose word and next word are frequent; its window is up to four words, ended by the piece or by a word
   that is not frequent. Windows are routed by their leading words: two, or more while they are hot, so that a route holds no more
   than the places of one word that is not hot, or one window of four hot words, which each task combines beforehand.
3. The windows of a route bucket are sorted by multikey three-way quicksort to the depth of four words, all segments of a round at
   once. The size of an equal partition is the count of its phrase. Partitions under the least count are abandoned, except those of
   hot leading words, whose counts are partial until the last sum.
4. Parts, covering phrases and scores are joins on the counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scrollwork.llm.common import query, table, written
from scrollwork.llm.words import mixed

#: ``[.,;:!?\x0A-\x0D]`` ends a piece, blank and tab part words
SEPARATORS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)] = 1
KIND[list(SEPARATORS)] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
DEPTH = 4
SLICE = 1 << 23
BITS = 1 << 22
SPARE = 1 << 16


# --- words of many texts --------------------------------------------------------------


def _slices(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and starts of texts, in runs of about ``size`` bytes. A longer text is cut behind a separator, which no phrase crosses."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    if not offsets[-1] > offsets[0]:
        return
    data = np.frombuffer(texts.buffers()[2], np.uint8, offsets[-1])
    at = int(offsets[0])
    while at < offsets[-1]:
        end = min(at + size, int(offsets[-1]))
        inside = offsets[np.searchsorted(offsets, end, side="right") - 1]
        if inside > at:
            end = int(inside)
        else:  # one long text
            stop = int(offsets[np.searchsorted(offsets, at, side="right")])
            while end < stop:
                found = np.flatnonzero(KIND[data[end : min(end + SPARE, stop)]] == 2)
                if len(found):
                    end += int(found[0]) + 1
                    break
                end = min(end + SPARE, stop)
        starts = offsets[(offsets >= at) & (offsets < end)]
        yield data[at:end], starts - at
        at = end


def words_of(raw: np.ndarray, text_starts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words, each place's word (index), and whether the next place continues its piece."""
    raw = LOWER[raw]
    kind = KIND[raw]
    word = kind == 0
    fresh = np.zeros(len(raw), bool)
    fresh[text_starts] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | fresh[1:]
    last[:-1] &= ~word[1:] | fresh[1:]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    piece = np.cumsum((kind == 2) | fresh, dtype=np.int32)[starts]
    bounds = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=bounds[1:])
    array = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw[word])])
    coded = array.dictionary_encode()
    follows = np.zeros(len(starts), bool)
    follows[:-1] = piece[1:] == piece[:-1]
    return coded.dictionary, coded.indices.to_numpy(), follows


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    langs = batch.column(0)
    for lang in pc.unique(langs).to_pylist():
        yield lang, batch.column(1).filter(pc.equal(langs, lang))


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``n`` over all texts."""

    def count(batches):
        for batch in batches:
            for lang, texts in _by_lang(batch):
                for raw, starts in _slices(texts, SLICE):
                    different, place, _ = words_of(raw, starts)
                    if len(different):
                        n = np.bincount(place, minlength=len(different))
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), different.cast(pa.string()), pa.array(n)], ["lang", "word", "n"])

    return docs.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _slot(lang: Column, word: Column) -> Column:
    return F.crc32(F.concat(lang, F.lit("\0"), word).cast("binary")) % BITS


def bitmap(words: DataFrame, conditions: list[Column]) -> list[np.ndarray]:
    """For each condition the slots of its words as a bitmap; at most ``BITS`` / 64 rows come to the driver."""
    slot = words.withColumn("slot", _slot(F.col("lang"), F.col("word")))
    rows = slot.groupBy(F.floor(F.col("slot") / 64).alias("k")).agg(*[F.bit_or(F.when(c, F.expr("shiftleft(1L, cast(slot % 64 as int))")).otherwise(F.lit(0))).alias(f"m{i}") for i, c in enumerate(conditions)])
    out = [np.zeros(BITS // 64, np.int64) for _ in conditions]
    for r in rows.collect():
        for i, m in enumerate(out):
            m[r.k] = r[i + 1]
    return [np.unpackbits(m.astype("<i8").view(np.uint8), bitorder="little").astype(bool) for m in out]


# --- windows --------------------------------------------------------------------------


def windows(place: np.ndarray, follows: np.ndarray, frequent: np.ndarray) -> list[np.ndarray]:
    """The words (from 1; 0: ended) of each suffix pointer's window, by depth."""
    code = np.where(frequent[place], place + 1, 0)
    joins = follows.copy()
    joins[:-1] &= (code[:-1] > 0) & (code[1:] > 0)
    at = np.flatnonzero(joins)
    columns, going = [code[at]], np.ones(len(at), bool)
    for k in range(1, DEPTH):
        going = going & joins[np.minimum(at + k - 1, len(joins) - 1)]
        columns.append(np.where(going, code[np.minimum(at + k, len(code) - 1)], 0))
    return columns


def combined(columns: list[np.ndarray], weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal windows once, with their counts."""
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    if max(int(c.max()) for c in columns) < 1 << 16:
        packed = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            packed = (packed << np.uint64(16)) | c.astype(np.uint64)
        packed, n = np.unique(packed, return_counts=True)
        return [((packed >> np.uint64(16 * (DEPTH - 1 - k))) & np.uint64(0xFFFF)).astype(np.int32) for k in range(DEPTH)], n
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.diff(np.append(first, len(order)))


def routes(columns: list[np.ndarray], hashes: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each window by its leading words, and whether more than two of them lead (its pair is hot)."""
    h = mixed(hashes[columns[0]] * np.uint64(3) + mixed(hashes[columns[1]]))
    on = opened = hot[columns[0]] & hot[columns[1]]
    for k in range(2, DEPTH):
        h = np.where(on, mixed(h * np.uint64(5) + hashes[columns[k]]), h)
        on = on & hot[columns[k]]
    return (h % np.uint64(buckets)).astype(np.int64), opened


def pack(columns: list[np.ndarray], counts: np.ndarray, words: pa.Array) -> bytes:
    """Windows with their own word list: self-contained, so words are compared as they are, not by hashes."""
    used, place = np.unique(np.concatenate(columns), return_inverse=True)
    text = b"\n".join(words.take(pa.array(used[used > 0] - 1)).to_pylist())  # no word holds a line end
    if not len(used) or used[0] > 0:
        place = place + 1
    body = place.astype("<u4").tobytes() + counts.astype("<i8").tobytes()
    return zstandard.compress(len(counts).to_bytes(8, "little") + len(text).to_bytes(8, "little") + text + body, 1)


def unpack(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    data = zstandard.decompress(blob)
    n, size = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    place = np.frombuffer(data, "<u4", DEPTH * n, 16 + size).reshape(DEPTH, n)
    return data[16 : 16 + size].split(b"\n"), place, np.frombuffer(data, "<i8", n, 16 + size + 4 * DEPTH * n)


# --- multikey quicksort ---------------------------------------------------------------


def phrases(columns: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three-way partition by one word after the other: (length, a window that begins with it, count) of each phrase of two words
    or more that counts ``least`` or more. ``columns``: (DEPTH, n), 0 where a window has ended.

    Every round parts all open segments at once by a pivot of their own; segments that weigh less than ``least`` are abandoned.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.arange(columns.shape[1])
    sizes, depth = np.array([len(order)]), np.zeros(1, np.int64)
    if not len(order) or weights.sum() < least:
        sizes = sizes[:0]
    while len(sizes):
        begin = np.cumsum(sizes) - sizes
        value = columns[np.repeat(depth, sizes), order]
        three = np.sort(np.stack([value[begin], value[begin + sizes // 2], value[begin + sizes - 1]]), axis=0)
        pivot = three[1]
        spread = np.repeat(pivot, sizes)
        side = (value > spread).astype(np.int8) + (value >= spread)
        # stable places: behind the smaller sides of the own segment, then by rank in the own side
        place, ends, weigh = np.empty(len(order), np.int64), [], []
        shift = begin.copy()
        for s in range(3):
            mine = np.flatnonzero(side == s)
            upto = np.searchsorted(mine, np.append(begin, len(order)))
            many = np.diff(upto)
            place[np.repeat(shift - upto[:-1], many) + np.arange(len(mine))] = mine
            w = np.concatenate([[0], np.cumsum(weights[order[mine]])])
            ends.append(many)
            weigh.append(w[upto[1:]] - w[upto[:-1]])
            shift = shift + many
        order = order[place]
        many, weigh = np.stack(ends, axis=1), np.stack(weigh, axis=1)
        equal = many[:, 1] > 0
        phrase = equal & (depth >= 1) & (pivot > 0) & (weigh[:, 1] >= least)
        at = begin + many[:, 0]
        found.append((depth[phrase] + 1, order[at[phrase]], weigh[phrase, 1]))
        keep = (many > 0) & (weigh >= least)
        keep[:, 1] &= (pivot > 0) & (depth + 1 < DEPTH)
        order = order[np.repeat(keep.ravel(), many.ravel())]
        sizes = many[keep]
        depth = (depth[:, None] + np.array([0, 1, 0]))[keep]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def phrase_counts(docs: DataFrame, words: DataFrame, least: int, most: int, per_bucket: int) -> DataFrame:
    """``lang``, ``phrase``, ``a`` of all phrases of two to four words with ``a >= least``."""
    frequent, hot = bitmap(words.where(F.col("n") >= least), [F.lit(True), F.col("n") >= most])
    places = words.where(F.col("n") >= least).agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-places // per_bucket))

    def deal(batches):
        for batch in batches:
            for lang, texts in _by_lang(batch):
                seed = zlib.crc32(lang.encode() + b"\0")
                for raw, starts in _slices(texts, SLICE):
                    different, place, follows = words_of(raw, starts)
                    crc = np.fromiter((zlib.crc32(w, seed) for w in different.to_pylist()), np.int64, len(different))
                    known = frequent[crc % BITS]
                    # only frequent words keep a number, so that most windows fit into 64 bits
                    ids = np.cumsum(known) * known
                    few, crc = different.filter(pa.array(known)), crc[known]
                    columns, counts = combined(windows(ids[place] - 1, follows, np.append(np.ones(len(few), bool), False)))
                    if not len(counts):
                        continue
                    hashes, is_hot = np.append(np.uint64(1), mixed(crc.astype(np.uint64))), np.append(False, hot[crc % BITS])
                    bucket, opened = routes(columns, hashes, is_hot, buckets)
                    part = bucket * 2 + opened
                    order = np.argsort(part, kind="stable")
                    keys, first = np.unique(part[order], return_index=True)
                    blobs = [pack([c[x] for c in columns], counts[x], few) for x in np.split(order, first[1:])]
                    # the words that are hot by this task's bitmap are the same in every task
                    yield pa.RecordBatch.from_arrays([pa.array(keys // 2), pa.array([lang] * len(keys)), pa.array(keys % 2 == 1), pa.array(blobs, pa.binary())], ["bucket", "lang", "opened", "windows"])

    def sort(group: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        for lang, opened in sorted(set(zip(group["lang"].to_pylist(), group["opened"].to_pylist()))):
            rows = group.filter(pc.and_(pc.equal(group["lang"], lang), pc.equal(group["opened"], opened)))
            lists, places, weights = zip(*(unpack(b.as_py()) for b in rows["windows"]))
            coded = pa.array([w for ws in lists for w in ws], pa.binary()).dictionary_encode()
            number, names = coded.indices.to_numpy() + 1, coded.dictionary.to_pylist()
            at = np.cumsum([0] + [len(ws) for ws in lists])
            columns = np.concatenate([np.append(0, number[a:b])[p] for a, b, p in zip(at, at[1:], places)], axis=1)
            length, example, count = phrases(columns, np.concatenate(weights), 1 if opened else least)
            if opened:  # only pairs, and threes of hot words, are still partial
                crc = [zlib.crc32(w, zlib.crc32(lang.encode() + b"\0")) % BITS for w in names]
                third = np.append(False, hot[crc])[columns[2, example]]
                whole = (length == DEPTH) | ((length == 3) & ~third)
                stay = ~whole | (count >= least)
                length, example, count = length[stay], example[stay], count[stay]
            top = columns[:, example].T.tolist()
            out[0] += [lang] * len(length)
            out[1] += [b" ".join(names[c - 1] for c in row[:n]).decode() for row, n in zip(top, length.tolist())]
            out[2] += count.tolist()
        return pa.table({"lang": pa.array(out[0], pa.string()), "phrase": pa.array(out[1], pa.string()), "a": pa.array(out[2], pa.int64())})

    dealt = docs.select("lang", "text").mapInArrow(deal, "bucket long, lang string, opened boolean, windows binary")
    return dealt.groupBy("bucket").applyInArrow(sort, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


# --- scores ---------------------------------------------------------------------------


def _part(first: int | Column, n: int | Column) -> Column:
    return F.array_join(F.slice("words", first, n), " ")


def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def collocations(
    df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, top: int = 2000, cover_percent: int = 80,
    most: int = 1 << 20, per_bucket: int = 1 << 20,
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces, and pieces at blanks and tabs into words. Everything is
    counted by language; a null language is ``und``, a null or empty text has no words. A phrase of two to four words is a candidate
    with a count ``a`` of ``least`` or more, overlaps included. Each cut into a first part (count ``l``) and a rest (``r``) scores
    floor(2 000 000 a / (l + r)); the lowest cut counts, ties to the shortest first part. Candidates inside a longer one that has
    ``cover_percent`` of their count or more are dropped. Ranks go by score, then ``a`` (both falling), then phrase by bytes.
    Repeated rows count as often as they stand; very long texts are counted whole. An empty table gives no rows; other columns
    are ignored, whatever their names. ``most`` and ``per_bucket`` (places of a hot word, of a bucket) change how the work is dealt only.
    """
    docs = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = written(word_counts(docs), "words")
    counts = written(phrase_counts(docs, words, least, most, per_bucket), "phrases")
    cut = counts.withColumn("words", F.split("phrase", " ")).withColumn("size", F.size("words"))

    longer = cut.where("size > 2").select("lang", "a", F.explode(F.when(F.col("size") == 3, F.array(_part(1, 2), _part(2, 2))).otherwise(F.array(_part(1, 2), _part(2, 2), _part(3, 2), _part(1, 3), _part(2, 3)))).alias("phrase"))
    covers = longer.groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    free = cut.join(covers, ["lang", "phrase"], "left").where(F.coalesce(_exact("cover") * 100 < _exact("a") * cover_percent, F.lit(True)))

    parts = words.where(F.col("n") >= least).select("lang", F.col("word").alias("part"), F.col("n").alias("f")).unionByName(counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    cuts = free.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("head"), _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    both = cuts.join(parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    both = both.withColumns({"up": _exact("a") * 2_000_000, "down": _exact("l") + _exact("r")}).withColumn("score", F.expr("up div down"))
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")

    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@query(r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), listed AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), counted AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed), range(1, 5) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND f >= 30
), covers AS (
  SELECT lang, array_to_string(list_slice(w, i, i + s - 1), ' ') AS phrase, max(a) AS cover
  FROM candidates, range(1, 4) p(i), range(2, 4) q(s) WHERE s < k AND i + s - 1 <= k GROUP BY ALL
), free AS (
  SELECT c.* FROM candidates c LEFT JOIN covers v USING (lang, phrase) WHERE cover IS NULL OR 100::HUGEINT * cover < 80::HUGEINT * a
), cuts AS (
  SELECT f.lang, f.phrase, f.a, x.f AS l, y.f AS r, (2000000::HUGEINT * f.a // (x.f + y.f))::BIGINT AS score, c.h
  FROM free f, range(1, 4) c(h), counted x, counted y
  WHERE h < f.k AND x.lang = f.lang AND y.lang = f.lang AND x.phrase = array_to_string(list_slice(f.w, 1, h), ' ') AND y.phrase = array_to_string(list_slice(f.w, h + 1, f.k), ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, h) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM ranked JOIN (SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000
""")
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
