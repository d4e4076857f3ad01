"""Near duplicates with ProbMinHash.

Documents are weighted sets of five-word shingles (weight: how often a shingle stands in the document). Every shingle is
a Poisson process whose rate is its weight; each register keeps the shingle of its earliest arrival, and a document's
processes stop once they are later than all its registers. Two registers agree with the probability Jaccard similarity J_P,
which is the plain Jaccard similarity where no shingle repeats.

1. Documents with equal weighted sets are one: the smallest id stands for them from here on. Rows of one id with different
   sets are linked.
2. Registers are banded, and documents that share a band meet in a bucket. Each is paired with the bucket's pivot, the member
   that shares the most bands with others: the original of many edited copies shares bands with all of them, while two
   copies may have little in common.
3. Pairs are verified on their whole texts by the exact J_P. Verified links are joined to classes.
4. A bucket that is not one class yet can hide links between members that are not like the pivot. The documents of such
   buckets are banded anew with longer bands, in which pairs under the limit hardly meet, and paired and verified as before.
5. Where a long band's bucket is still not one class, members outside the pivot's class become pivots in turn, 32, then 1 000 per
   bucket and round, until none is left. Pivots meet blocks of the bucket's members as rows of sketches, one byte for each of
   1 024 registers. Only pairs whose sketches agree in nearly the share that the limit asks for leave the block. Two classes
   need one link, so the best pair of any two is verified first, and the other pairs only if the two are still apart.

No step forms all pairs of a bucket. A pair at the limit of 0.8 shares a band with probability 0.997, a long band with 0.99;
at 0.85 the figures are 0.9999 and 0.99999. Sketches lose a pair at the limit with probability 0.0001.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from scrollwork.llm.common import docs_of, query, small_batches, table, written
from scrollwork.llm.components import components
from scrollwork.llm.words import MIX, groups, mixed, runs, words

SHINGLE = 5
ROWS, BANDS = 8, 32
LONG_ROWS, LONG_BANDS = 16, 160
SKETCH = 1024
#: standard deviations that a sketch may fall short of the limit
SLACK = 3.7
BLOCK = 1000
#: pivots of a bucket in the first round, which find its larger classes, and in later ones
FIRST, FURTHER = 32, 1000
SALTS = 16
GROUP_BYTES = 4 << 20


def word_lists(texts: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Word hashes of each text, by groups of whole texts: number of the first text, and one array per text."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < GROUP_BYTES:
            size += len(texts[end])
            end += 1
        found: list[list[np.ndarray]] = [[] for _ in range(end - at)]
        for group, owner in groups(texts[at:end]):
            h, whose = words(group)
            for k, part in zip(owner, np.split(h, np.searchsorted(whose, np.arange(1, len(group))))):
                found[k].append(part)
        yield at, [np.concatenate(p) for p in found]
        at = end


def weighted_set(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles and their counts. A shorter text is one shingle of all its words; a text without words is the empty shingle."""
    grams = runs(h, min(SHINGLE, len(h))) if len(h) else np.zeros(1, np.uint64)
    return np.unique(grams, return_counts=True)


def prob_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two weighted sets."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    # a shingle of one set only counts with its own weight, whatever the ratio
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    upto = np.searchsorted(ratio, ratio, side="right")
    below = np.append(0, np.cumsum(y))[upto]
    above = x.sum() - np.append(0, np.cumsum(x))[upto]
    return float((1 / ((above + only_a) / x + (below + only_b) / y)).sum())


def registers(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """ProbMinHash registers (text, k): the shingle with the earliest arrival."""
    n = len(sets)
    h = np.concatenate([s[0] for s in sets])
    w = np.concatenate([s[1] for s in sets]).astype(np.float64)
    base = np.repeat(np.arange(n, dtype=np.int64) * k, [len(s[0]) for s in sets])
    first, shingle = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
    clock, time, step = h.copy(), np.zeros(len(h)), 0
    while len(h):
        many = int(np.clip(40_000 // len(h), 1, 64))
        draws = np.arange(step + 1, step + many + 1, dtype=np.uint64)[:, None]
        r = mixed(clock[None, :] + draws * MIX)
        step += many
        u = ((r >> np.uint64(11)) + np.uint64(1)) * (1.0 / (1 << 53))
        t = time + np.cumsum(-np.log(u), axis=0) / w
        place = base + (mixed(r ^ MIX) >> np.uint64(32)).astype(np.int64) % k
        p, x = place.ravel(), t.ravel()
        ok = x < first[p]
        p, x = p[ok], x[ok]
        who = np.broadcast_to(h, t.shape).ravel()[ok]
        np.minimum.at(first, p, x)
        won = first[p] == x
        shingle[p[won]] = who[won]
        latest = first.reshape(n, k).max(axis=1)
        time = t[-1]
        going = time < latest[base // k]
        h, w, base, clock, time = h[going], w[going], base[going], clock[going], time[going]
    return shingle.reshape(n, k)


def band_keys(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key per text and band."""
    parts = sig.reshape(len(sig), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * MIX, (len(sig), bands))
    for r in range(rows):
        out = mixed(out + parts[:, :, r])
    return out.view(np.int64)


def sketches(sig: np.ndarray) -> list[bytes]:
    """One byte for each of the first ``SKETCH`` registers of a text."""
    return [row.tobytes() for row in mixed(sig[:, :SKETCH]).astype(np.uint8)]


def signatures(docs: DataFrame, rows: int, bands: int, sketch: bool = False) -> DataFrame:
    """``doc_id``, ``digest`` of the weighted set, ``bands``, and ``sketch`` if asked for."""

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at, lists in word_lists(f["text"].tolist()):
                sets = [weighted_set(h) for h in lists]
                digests = [hashlib.blake2b(a.tobytes() + b.astype("<i8").tobytes(), digest_size=16).digest() for a, b in sets]
                keys, bytes_of = [], []
                for c in range(0, len(sets), 256):
                    sig = registers(sets[c : c + 256], rows * bands)
                    keys.extend(band_keys(sig, rows, bands))
                    bytes_of.extend(sketches(sig) if sketch else ())
                out = {"doc_id": f["doc_id"].iloc[at : at + len(sets)], "digest": digests, "bands": keys}
                yield pd.DataFrame({**out, "sketch": bytes_of} if sketch else out)

    return docs.mapInPandas(sign, "doc_id long, digest binary, bands array<long>" + ", sketch binary" * sketch)


def buckets(signed: DataFrame) -> DataFrame:
    """``key``, ``doc``, ``pivot`` for buckets of two documents or more, from ``doc`` and ``bands``."""
    rows = signed.select("doc", F.explode("bands").alias("key"))
    all_salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    crowded = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", "n", all_salts)
    crowded = written(salted.join(crowded, ["key", "salt"]), "crowded")
    friends = crowded.groupBy("doc").agg(F.sum("n").alias("friends"))
    pivots = crowded.join(friends, "doc").groupBy("key").agg(F.min(F.struct(-F.col("friends"), "doc")).alias("p")).select("key", F.col("p.doc").alias("pivot"), all_salts)
    return written(crowded.join(pivots, ["key", "salt"]).select("key", "doc", "pivot"), "members")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a``, ``b``, ``similarity`` of pairs, from whole texts."""

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = np.zeros(len(f))
            for at in range(0, len(f), 256):
                part = f.iloc[at : at + 256]
                names = pd.unique(np.concatenate([part["ta"].to_numpy(), part["tb"].to_numpy()])).tolist()
                sets = dict(zip(names, (weighted_set(h) for _, lists in word_lists(names) for h in lists)))
                out[at : at + len(part)] = [prob_jaccard(sets[x], sets[y]) for x, y in zip(part["ta"], part["tb"])]
            yield pd.DataFrame({"a": f["a"], "b": f["b"], "similarity": out})

    one, two = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInPandas(compare, "a long, b long, similarity double")


def near_duplicates(df: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with an id: ``doc_id``, ``group_id`` (smallest id of its class), ``kept``.

    A class holds the documents joined by chains of links with J_P of ``similarity`` or more. Null and empty texts, and all others without words,
    are equal; texts under five words are equal or different as wholes. Case and punctuation do not count. Rows that repeat an
    id count as one document, similar to whatever one of its texts is similar to. Rows without an id are left out: they
    cannot be named as the one that stays. An empty table gives no rows. Other columns are ignored.
    """
    small_batches(df)
    docs = docs_of(df, id_col, text_col).where("doc_id IS NOT NULL")
    signed = written(signatures(docs, ROWS, BANDS), "signatures")
    equal = written(signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")), "distinct")
    members = buckets(equal.select(F.col("rep").alias("doc"), "bands"))
    texts = written(docs.join(members.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi"), "candidates")
    links = _linked(_star(members), texts, similarity)
    roots = components(links.unionByName(_one_id(signed, equal)))

    crowd = written(_mixed(members, roots).select(F.col("doc").alias("doc_id")).distinct(), "crowd")
    if not crowd.isEmpty():
        signed_long = written(signatures(texts.join(crowd, "doc_id", "left_semi"), LONG_ROWS, LONG_BANDS, sketch=True), "long-signatures")
        members = buckets(signed_long.select(F.col("doc_id").alias("doc"), "bands"))
        looked = _rooted(_star(members), roots).where("root <> pivot_root").select("doc", "pivot")
        roots = _joined(roots, _linked(looked, texts, similarity))
        roots = _outsiders(members, roots, signed_long.select(F.col("doc_id").alias("doc"), "sketch"), texts, similarity)

    classes = equal.select("digest", "rep").join(roots, F.col("rep") == F.col("v"), "left").select("digest", F.coalesce("root", "rep").alias("group_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    each = signed.select("doc_id", "digest", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    return each.join(classes, ["digest", "salt"]).select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("kept"))


def _one_id(signed: DataFrame, equal: DataFrame) -> DataFrame:
    """Links from each id with different sets to what stands for them."""
    several = signed.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    return signed.select("doc_id", "digest").join(several, "doc_id", "left_semi").join(equal.select("digest", "rep"), "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def _star(members: DataFrame) -> DataFrame:
    return members.where("doc <> pivot").select("doc", "pivot").distinct()


def _linked(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    return written(verified(pairs.select(F.col("doc").alias("a"), F.col("pivot").alias("b")), texts).where(F.col("similarity") >= similarity).select("a", "b"), "links")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the class of ``doc`` (``root``) and of ``pivot`` (``pivot_root``)."""
    for name, out in (("doc", "root"), ("pivot", "pivot_root")):
        rows = rows.join(roots.select(F.col("v").alias(name), F.col("root").alias(out)), name, "left").withColumn(out, F.coalesce(out, name))
    return rows


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of buckets in which two documents besides the pivot can still have a link that joins classes."""
    rows = _rooted(members, roots)
    other = F.col("doc") != F.col("pivot")
    keys = rows.groupBy("key").agg(F.count_if(other).alias("n"), F.count_if(F.col("root") != F.col("pivot_root")).alias("outside")).where("n > 1 AND outside > 0").select("key")
    return rows.join(keys, "key").where(other)


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Classes after further links; the known ones enter as stars, which takes fewer rounds than their links."""
    return components(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(links))


def alike(rows: DataFrame, similarity: float) -> DataFrame:
    """``doc``, ``root``, ``by``, ``by_root``, ``share`` of equal registers for members and pivots (``lead``) of different classes
    that meet in a block (``key``, ``block``) and whose sketches agree as ``similarity`` asks for."""
    need = SKETCH * similarity - SLACK * (SKETCH * similarity * (1 - similarity)) ** 0.5

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, held = None, []
        for f in frames:
            doc, root, lead = (f[c].to_numpy() for c in ("doc", "root", "lead"))
            place = f[["key", "block"]].to_numpy()
            bits = np.frombuffer(b"".join(f["sketch"]), np.uint8).reshape(len(f), SKETCH)
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            out = []
            for s, e in zip([0, *cuts], [*cuts, len(f)]):
                if name != tuple(place[s]):
                    name, held = tuple(place[s]), []
                m = s + int(lead[s:e].sum())
                held += [(doc[k], root[k], bits[k]) for k in range(s, m)]
                for by, by_root, of_by in held if m < e else ():
                    same = np.count_nonzero(bits[m:e] == of_by, axis=1)
                    for k in m + np.flatnonzero((same >= need) & (root[m:e] != by_root)):
                        out.append((doc[k], root[k], by, by_root, same[k - m] / SKETCH))
            yield pd.DataFrame(out, columns=["doc", "root", "by", "by_root", "share"])

    # a block's pivots come before its members
    near = rows.repartition("key", "block").sortWithinPartitions("key", "block", F.desc("lead"))
    return near.select("key", "block", "lead", "doc", "root", "sketch").mapInPandas(meet, "doc long, root long, by long, by_root long, share double")


def _outsiders(members: DataFrame, roots: DataFrame, sketched: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Classes once no bucket can hide a link between two of them."""
    state = written(_mixed(members, roots).select("key", "doc", "pivot", "root", "pivot_root"), "open")
    used, step = None, FIRST
    while True:
        out = state.where("root <> pivot_root").select("key", "doc", "root")
        if used is not None:
            out = out.join(used, ["key", "doc"], "left_anti")
        nth = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("doc"), "doc"))
        chosen = written(out.withColumn("nth", nth).where(F.col("nth") <= step).drop("nth"), "pivots")
        if chosen.isEmpty():
            return roots
        sizes = state.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).join(chosen.select("key").distinct(), "key", "left_semi")
        led = chosen.join(sizes, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "doc", "root", F.lit(True).alias("lead"))
        rows = state.join(sizes, "key").select("key", F.pmod(F.xxhash64("doc"), "blocks").alias("block"), "doc", "root", F.lit(False).alias("lead"))
        pairs = alike(led.unionByName(rows).join(sketched, "doc"), similarity)
        # two pivots of a bucket meet once, not from either side, and so do a pair's buckets
        low, high = F.least("root", "by_root").alias("low"), F.greatest("root", "by_root").alias("high")
        pairs = written(pairs.groupBy(F.greatest("doc", "by").alias("doc"), F.least("doc", "by").alias("pivot"), low, high).agg(F.max("share").alias("share")), "alike")
        best = written(pairs.groupBy("low", "high").agg(F.max(F.struct("share", "doc", "pivot")).alias("p")).select("low", "high", "p.doc", "p.pivot"), "best")
        new = _linked(best, texts, similarity)
        met = best.join(new, (F.col("doc") == F.col("a")) & (F.col("pivot") == F.col("b"))).select("low", "high")
        rest = pairs.join(met, ["low", "high"], "left_anti").join(best, ["doc", "pivot"], "left_anti").select("doc", "pivot")
        new = new.unionByName(_linked(rest, texts, similarity))
        if not new.isEmpty():
            roots = _joined(roots, new)
        used = chosen.select("key", "doc") if used is None else used.unionByName(chosen.select("key", "doc"))
        # only buckets with further outsiders go on
        left = out.join(chosen, ["key", "doc"], "left_anti").select("key").distinct()
        state = written(_rooted(state.select("key", "doc", "pivot").join(left, "key", "left_semi"), roots), "open")
        step = FURTHER


@query()
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups_of = near_duplicates(table(spark, sf_dir, "documents"))
    all_salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    sizes = groups_of.groupBy("group_id").agg(F.count("*").alias("group_size")).select("group_id", "group_size", all_salts)
    salted = groups_of.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(sizes, ["group_id", "salt"]).select("doc_id", "group_id", "group_size", "kept")
