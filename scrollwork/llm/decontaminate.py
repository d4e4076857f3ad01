"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The test items are the stated query set. They are taken in blocks of bounded size, and each block meets all documents:

1. every trigram of an item is a seed. Around each place where a seed stands in a document lies a window that holds any
   alignment of the wanted score through that place;
2. windows whose seeds say nothing go. A seed tells a copy from prose if it is rare relative to the item's
   lower quartile (an item that was copied a thousand times has none that is rare in absolute numbers), or if it stands in the documents clearly more often than its words would meet by chance, as copies make it,
   however many they are. ``SEVERAL`` other seeds on one diagonal tell it too;
3. windows with too few of the item's words, counted with their repetitions, go: no alignment in them reaches the score;
4. the other windows are aligned with the item: words, +2 for an equal word, -1 for another word or a gap. The score is
   divided by that of a full copy, so an item with a fifth of its words replaced has about 0.7.

So an alignment of the wanted score with three equal words in a row is missed only where all such runs are as frequent as
chance makes them. Only items go to tasks, a block at a time; documents never move.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from scrollwork.llm.common import as_text, docs_of, query, table
from scrollwork.llm.words import groups, runs, words

SEED_WORDS = 3
MIN_WORDS = 8
#: seeds of that many words in a row
SEVERAL = MIN_WORDS - SEED_WORDS + 1
BLOCK_BYTES = 4 << 20
ALIGN_CELLS = 1 << 21
WINDOW_WORDS = 1 << 20
#: letters and marks of scripts without blanks between words (Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han), and their punctuation
UNSPACED = re.compile("([\u0e01-\u0e4e\u0e50-\u0e59\u0e81-\u0edf\u0f18-\u0f39\u0f3e-\u0fbc\u1000-\u1049\u1050-\u109f\u1780-\u17d3\u17e0-\u17e9\u3005-\u3007\u3021-\u302f\u3031-\u303c\u3041-\u309f\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])|[\u0f0b-\u0f14\u104a-\u104f\u17d4-\u17da\u3000-\u3003\u3008-\u3020\u3030\u303d\u30a0\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def spaced(text: str) -> str:
    """The text with every character of a script without blanks as a word of its own."""
    try:
        text.encode("latin-1")  # fast, and true of most texts
        return text
    except UnicodeEncodeError:
        return UNSPACED.sub(lambda m: f" {m[1]} " if m[1] else " ", text)


@dataclass
class Block:
    """Items with at least ``MIN_WORDS`` words. Seed ``k`` stands in item ``item[k]`` from word ``first[k]`` to word ``last[k]``; ``keys`` is sorted;
    ``tells`` says whether a seed tells a copy from prose.
    ``bag`` holds item and word of ``vocabulary`` as one number, ``often`` how often the word stands in the item.
    ``short`` has the items with fewer words, by their number: sorted hashes of whole items, and the items' ids."""

    ids: list
    starts: np.ndarray
    tokens: np.ndarray
    keys: np.ndarray
    item: np.ndarray
    first: np.ndarray
    last: np.ndarray
    tells: np.ndarray
    vocabulary: np.ndarray
    bag: np.ndarray
    often: np.ndarray
    short: dict[int, tuple[np.ndarray, list]]
    longest_bytes: int

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)

    def judged(self, counts: "Counts", factor: int = 4, slack: int = 4) -> "Block":
        """Seeds tell in at most ``factor`` times as many documents as the item's lower quartile, plus ``slack``, and
        where they stand more than ``factor`` times as often as words in random order would make them."""
        k = np.searchsorted(np.unique(self.keys), self.keys)
        n = counts.documents[k]
        order = np.lexsort((n, self.item))
        sizes = np.bincount(self.item, minlength=len(self.ids))
        first = np.append(0, np.cumsum(sizes)[:-1])
        limit = np.full(len(self.ids), slack)
        limit[sizes > 0] += n[order][(first + sizes // 4)[sizes > 0]] * factor
        word = np.searchsorted(self.vocabulary, self.tokens)
        start = self.starts[self.item] + self.first
        chance = np.full(len(self.keys), float(counts.total))
        for w in range(SEED_WORDS):
            chance *= counts.words[word[start + w]] / max(1, counts.total)
        return replace(self, tells=(n <= limit[self.item]) | (counts.places[k] > factor * chance))


@dataclass
class Counts:
    """Documents and places of each seed; places of each word of the vocabulary and of all words, in documents with a seed."""

    documents: np.ndarray
    places: np.ndarray
    words: np.ndarray
    total: int


def make_block(rows: list[tuple]) -> Block:
    ids, parts, sizes = [], [], []
    brief: dict[int, list] = {}
    for item_id, text in rows:
        data = spaced(text).lower().encode("utf-8", "replace")
        h, _ = words([data])
        sizes.append(len(data))
        if len(h) >= MIN_WORDS:
            ids.append(item_id)
            parts.append(h)
        elif len(h):
            brief.setdefault(len(h), []).append((runs(h, len(h))[0], item_id))
    brief = {n: sorted(some, key=lambda x: x[0]) for n, some in brief.items()}
    short = {n: (np.array([x[0] for x in some], np.uint64), [x[1] for x in some]) for n, some in brief.items()}
    starts = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64)
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    keys = [runs(p, SEED_WORDS) for p in parts]
    item = np.repeat(np.arange(len(parts)), [len(k) for k in keys])
    at = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.zeros(0, np.int64)
    flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    order = np.lexsort((at, item, flat))
    flat, item, at = flat[order], item[order], at[order]
    fresh = np.append(True, (flat[1:] != flat[:-1]) | (item[1:] != item[:-1]))[: len(flat)]
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(flat))[: len(heads)] - 1
    vocabulary, word = np.unique(tokens, return_inverse=True)
    bag, often = np.unique(np.repeat(np.arange(len(parts)), np.diff(starts)) * len(vocabulary) + word, return_counts=True)
    return Block(ids, starts, tokens, flat[heads], item[heads], at[heads], at[tails], np.ones(len(heads), bool), vocabulary, bag, often, short, max(sizes, default=0))


def blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[Block]:
    rows, size = [], 0
    for r in items.where(F.col(item_text).isNotNull()).select(item_id, item_text).distinct().toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1])
        if size >= BLOCK_BYTES:
            yield make_block(rows)
            rows, size = [], 0
    if rows:
        yield make_block(rows)


def align(items: list[np.ndarray], windows: list[np.ndarray], match: int = 2, other: int = -1, gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair, and the word of the window at which it ends. All pairs advance together, row by row."""
    n, width = len(items), max(map(len, windows))
    a = np.zeros((n, max(map(len, items))), np.uint64)
    b = np.zeros((n, width), np.uint64)
    used_a, used_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for k, (x, y) in enumerate(zip(items, windows)):
        a[k, : len(x)], used_a[k, : len(x)] = x, True
        b[k, : len(y)], used_b[k, : len(y)] = y, True
    ramp = gap * np.arange(width, dtype=np.int32)
    above = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(a.shape[1]):
        equal = (b == a[:, i, None]) & used_b & used_a[:, i, None]
        row = np.maximum(above[:, :-1] + np.where(equal, match, other), above[:, 1:] - gap)
        row = np.maximum.accumulate(np.maximum(row, 0) + ramp, axis=1) - ramp
        row[~used_a[:, i]] = 0
        top = row.max(axis=1)
        better = top > best
        end[better] = row[better].argmax(axis=1)
        best = np.maximum(best, top)
        above[:, 1:] = row
    return best, end


def _hits(h: np.ndarray, owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose n-gram is one of the sorted ``keys``, and the n-grams."""
    if not len(keys) or len(h) < SEED_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = runs(h, SEED_WORDS)
    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
    where = np.flatnonzero((keys[at] == grams) & (owner[: len(grams)] == owner[SEED_WORDS - 1 :]))
    return where, grams[where]


def count_seeds(docs: DataFrame, block: Block) -> Counts:
    keys = np.unique(block.keys)
    sizes = (len(keys), len(keys), len(block.vocabulary), 1)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        documents, places, known, total = (np.zeros(n, np.int64) for n in sizes)
        for f in frames if len(keys) else ():
            for group, owner in groups(list(map(spaced, f["text"]))):
                h, whose = words(group)
                where, grams = _hits(h, whose, keys)
                seed = np.searchsorted(keys, grams)
                documents += np.bincount(np.unique(seed * (len(group) + 1) + whose[where]) // (len(group) + 1), minlength=len(keys))
                places += np.bincount(seed, minlength=len(keys))
                # texts of another kind than those with seeds would make their words look rare
                h = h[np.bincount(whose[where], minlength=len(group))[whose] > 0]
                at = np.minimum(np.searchsorted(block.vocabulary, h), len(block.vocabulary) - 1)
                known += np.bincount(at[block.vocabulary[at] == h], minlength=len(known))
                total += len(h)
        n = np.concatenate([documents, places, known, total])
        yield pd.DataFrame({"k": np.flatnonzero(n), "n": n[n > 0]})

    n = np.zeros(sum(sizes), np.int64)
    for k, x in docs.select("text").mapInPandas(count, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        n[k] = x
    documents, places, known, total = np.split(n, np.cumsum(sizes)[:-1])
    return Counts(documents, places, known, int(total[0]))


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to ``most`` or little more."""
    part = np.cumsum(sizes) // most
    edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(sizes))
    return zip(edges[:-1].tolist(), edges[1:].tolist())


def plausible(block: Block, h: np.ndarray, item: np.ndarray, begin: np.ndarray, stop: np.ndarray, min_score: float) -> np.ndarray:
    """Whether each window has ``min_score`` of its item's words. Only equal words add to a score, two each, so the others cannot reach it."""
    inside = np.cumsum(np.bincount(begin, minlength=len(h) + 1) - np.bincount(stop, minlength=len(h) + 1))[:-1] > 0
    word = np.full(len(h), -1)
    at = np.minimum(np.searchsorted(block.vocabulary, h[inside]), len(block.vocabulary) - 1)
    word[inside] = np.where(block.vocabulary[at] == h[inside], at, -1)
    have = np.zeros(len(item))
    for lo, hi in _slices(stop - begin, WINDOW_WORDS):
        size = (stop - begin)[lo:hi]
        who = np.repeat(np.arange(lo, hi), size)
        w = word[np.arange(len(who)) - np.repeat(np.cumsum(size) - size - begin[lo:hi], size)]
        who, w = who[w >= 0], w[w >= 0]
        code = item[who] * len(block.vocabulary) + w
        at = np.minimum(np.searchsorted(block.bag, code), len(block.bag) - 1)
        hit = block.bag[at] == code
        pairs, n = np.unique(who[hit] * len(block.bag) + at[hit], return_counts=True)
        have += np.bincount(pairs // len(block.bag), np.minimum(n, block.often[pairs % len(block.bag)]), len(item))
    return have >= min_score * block.lengths[item] - 1e-9


def windows_of(block: Block, h: np.ndarray, whose: np.ndarray, bounds: np.ndarray, min_score: float) -> tuple[np.ndarray, ...]:
    """``text``, ``item``, ``begin``, ``stop`` of the windows that can hold an alignment, in this order and without repetition."""
    where, grams = _hits(h, whose, block.keys)
    first = np.searchsorted(block.keys, grams, side="left")
    many = np.searchsorted(block.keys, grams, side="right") - first
    found = [np.zeros((0, 4), np.int64)]
    for lo, hi in _slices(many, WINDOW_WORDS) if len(many) else ():
        m = many[lo:hi]
        seed = np.repeat(first[lo:hi] - np.cumsum(m) + m, m) + np.arange(m.sum())
        if not len(seed):
            continue
        at, item = np.repeat(where[lo:hi], m), block.item[seed]
        text, n = whose[at].astype(np.int64), block.lengths[item]
        # an alignment with more words of its own than this is under the score
        slack = np.maximum(0, (2 * (1 - min_score) * n + 1e-9).astype(np.int64))
        # on a grid, so that the seeds of one place share a window
        grid = np.maximum(1, n // 4)
        begin = (at - block.last[seed] - slack) // grid * grid
        stop = -(-(at - block.first[seed] + n + slack) // grid) * grid
        begin, stop = np.maximum(begin, bounds[text]), np.minimum(stop, bounds[text + 1])
        order = np.lexsort((seed, stop, begin, item, text))
        rows, seed = np.stack([text, item, begin, stop], axis=1)[order], seed[order]
        heads = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
        other = np.append(True, seed[1:] != seed[:-1])
        other[heads] = True
        rows = rows[heads][np.logical_or.reduceat(block.tells[seed], heads) | (np.add.reduceat(other.astype(np.int64), heads) >= SEVERAL)]
        found.append(rows[plausible(block, h, *rows[:, 1:].T, min_score)])
    rows = np.concatenate(found)
    return tuple(rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))].T)


def whole(block: Block, h: np.ndarray, whose: np.ndarray) -> Iterator[tuple[int, object, int]]:
    """Text, item and last word of each text's last place with all words of a short item in a row."""
    for n, (keys, ids) in block.short.items():
        grams = runs(h, n)
        first = np.searchsorted(keys, grams, side="left")
        where = np.flatnonzero((keys[np.minimum(first, len(keys) - 1)] == grams) & (whose[: len(grams)] == whose[n - 1 :]))
        # of equal places of a text the last
        pairs, back = np.unique((whose[where].astype(np.int64) * len(keys) + first[where])[::-1], return_index=True)
        for pair, at in zip(pairs.tolist(), where[::-1][back].tolist()):
            k = pair % len(keys)
            for i in range(k, int(np.searchsorted(keys, keys[k], side="right"))):
                yield pair // len(keys), ids[i], at + n - 1


def find(docs: DataFrame, block: Block, min_score: float) -> DataFrame:
    lengths = block.lengths

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for group, owner in groups(list(map(spaced, f["text"])), overlap=4 * block.longest_bytes + 64):
                h, whose = words(group)
                bounds = np.searchsorted(whose, np.arange(len(group) + 1))
                out += [(f["doc_id"].iloc[owner[t]], i, 1.0, int(e - bounds[t])) for t, i, e in whole(block, h, whose)]
                text, item, begin, stop = windows_of(block, h, whose, bounds, min_score)
                if not len(text):
                    continue
                same = np.append(False, (text[1:] == text[:-1]) & (item[1:] == item[:-1]))
                # windows of one text and item that meet become one: a new one starts where none before reaches
                pair = np.cumsum(~same)
                reach = np.maximum.accumulate(stop + pair * (len(h) + 1)) - pair * (len(h) + 1)
                fresh = ~same
                fresh[1:] |= begin[1:] > reach[:-1]
                heads = np.flatnonzero(fresh)
                tails = np.append(heads[1:], len(fresh)) - 1
                todo = sorted(zip(lengths[item[heads]], reach[tails] - begin[heads], item[heads], text[heads], begin[heads]))
                while todo:
                    size = max(1, ALIGN_CELLS // max(1, int(max(x[1] for x in todo[:512]))))
                    chunk, todo = todo[: min(512, size)], todo[min(512, size) :]
                    best, end = align([block.tokens[block.starts[i] : block.starts[i + 1]] for _, _, i, _, _ in chunk], [h[b : b + w] for _, w, _, _, b in chunk])
                    for (n, _, i, t, b), s, e in zip(chunk, best, end):
                        if s >= min_score * 2 * n:
                            out.append((f["doc_id"].iloc[owner[t]], block.ids[i], s / (2.0 * n), int(b + e - bounds[t])))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "score", "end_word"])

    return docs.mapInPandas(search, FOUND)


FOUND = "doc_id string, item_id string, score double, end_word long"


def contaminated(df: DataFrame, items: DataFrame, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per (``doc_id``, ``item_id``) with an alignment of ``min_score`` or more: ``score``, ``end_word`` (in the text, or in the part of a
    very long one).

    Null and empty texts match nothing. Null items and those without words are not searched. Items with fewer than ``MIN_WORDS``
    words match only as a whole (score 1), wherever all their words stand in a row: an item of common words is found in ordinary text too.
    Scripts without blanks between words count by characters. All different texts under one ``item_id`` (or without one) are
    searched and count as one item. Rows that repeat an id give one row per item. Of equal scores the later place counts. Null
    ids are kept, as one document. Empty tables give no rows. Other columns are ignored.
    """
    ids = {"doc_id": df.schema[id_col].dataType, "item_id": items.schema[item_id].dataType}
    docs = as_text(docs_of(df, id_col, text_col), "doc_id")
    empty = df.sparkSession.createDataFrame([], FOUND)
    # texts of one item can be in several blocks
    found = reduce(DataFrame.unionByName, [find(docs, b.judged(count_seeds(docs, b)), min_score) for b in blocks(as_text(items, item_id), item_id, item_text)], empty)
    found = found.withColumns({c: F.col(c).cast(kind) for c, kind in ids.items()})
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max_by("end_word", F.struct("score", "end_word")).alias("end_word"))


@query()
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
