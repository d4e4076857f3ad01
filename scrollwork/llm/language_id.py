"""Language identification with interpolated Kneser-Ney character models.

Texts are reduced to lower-case letters with one space between words. Per language, 4-gram counts are taken from
a bounded sample, and an interpolated Kneser-Ney model (absolute discounts, continuation counts below the top order)
is built. All languages share one sorted array of n-gram hashes per order, with a row of log probabilities and of
back-off weights per n-gram; a text is scored by binary search in it. The language with the lowest cross-entropy per
character wins. A text is rejected when its cross-entropy lies over a limit calibrated per language on documents
that the model has not seen.

Bounds: ``sample_docs`` documents a language are expected in the sample, and the arrays hold about ``max_cells``
numbers, so the model that tasks receive does not grow with the data. Each language has a share of its own in them, never
under ``LEAST_GRAMS`` n-grams. Scoring covers every text in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from scrollwork.llm.common import fold, query, small_batches, table, written

ORDER = 4
#: longer texts are scored in parts of this many characters
PART = 1 << 20
#: characters that are scored together; a position takes about a hundred bytes of working arrays
GROUP = 1 << 18
LEAST_GRAMS = 2000
#: languages with fewer documents in all have none to spare for the limits
SPARE_FROM = 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower-case letter, and whether it is a letter."""
    chars = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x110000)]
    low = [c.lower() for c in chars]
    return np.array([ord(x) if len(x) == 1 else ord(c) for x, c in zip(low, chars)], np.uint32), np.array([c.isalpha() for c in chars])


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each with ``ORDER - 1`` spaces before it, where each text starts, and its number of letters."""
    low, alpha = _tables()
    pad = " " * (ORDER - 1)
    raw = np.frombuffer("".join(f"{pad}{t} " for t in texts).encode("utf-32-le", "replace"), np.uint32)
    starts = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + ORDER for t in texts[:-1]], out=starts[1:])
    is_letter = alpha[raw]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    for k in range(ORDER - 1):
        keep[starts + k] = True
    at = np.cumsum(keep) - 1
    points = np.where(is_letter, low[raw], np.uint32(32))[keep]
    return points, at[starts], np.add.reduceat(is_letter.astype(np.int64), starts)


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each position from ``n - 1`` on."""
    h = np.zeros(max(0, len(points) - n + 1), np.uint64)
    for k in range(n):
        h = (h + points[k : len(points) - n + 1 + k]) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Model:
    langs: list[str]
    hashes: list[np.ndarray]  # by order - 1, sorted
    logp: list[np.ndarray]
    backoff: list[np.ndarray]  # of the n-gram as a context
    floor: float
    limits: dict[str, tuple[float, float]] | None = None

    def position_scores(self, points: np.ndarray) -> np.ndarray:
        """Natural log probability per language of each position from ``ORDER - 1`` on."""
        n = len(points) - ORDER + 1
        out = np.empty((n, len(self.langs)), np.float32)
        todo, weight = np.arange(n), None
        for order in range(ORDER, 0, -1):
            keys = self.hashes[order - 1]
            h = gram_hashes(points, ORDER) if order == ORDER else self._hash_at(points, todo, ORDER - order, order)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            found = self.logp[order - 1][at[hit]]
            out[todo[hit]] = found if weight is None else found + weight[hit]
            todo = todo[~hit]
            if not len(todo):
                return out
            weight = np.zeros((len(todo), len(self.langs)), np.float32) if weight is None else weight[~hit]
            if order > 1:  # the context of the missing n-gram
                c = self._hash_at(points, todo, ORDER - order, order - 1)
                keys = self.hashes[order - 2]
                at = np.minimum(np.searchsorted(keys, c), len(keys) - 1)
                known = keys[at] == c
                weight[known] += self.backoff[order - 2][at[known]]
        out[todo] = weight + self.floor
        return out

    @staticmethod
    def _hash_at(points: np.ndarray, where: np.ndarray, skip: int, n: int) -> np.ndarray:
        h = np.zeros(len(where), np.uint64)
        for k in range(n):
            h = (h + points[where + skip + k]) * MULTIPLIER
            h ^= h >> np.uint64(29)
        return h

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: cross-entropy per character and language, characters, letters."""
        points, starts, n_letters = letters(texts)
        logp = self.position_scores(points)
        # windows that begin in the padding of the next text belong to no text
        ends = np.append(starts[1:], len(points))
        valid = np.ones(len(logp), np.float32)
        for k in range(1, ORDER):
            e = ends[:-1] - k
            valid[e] = 0
        logp *= valid[:, None]
        sums = np.add.reduceat(logp.astype(np.float64), np.minimum(starts, len(logp) - 1), axis=0)
        n = ends - starts - ORDER + 1
        return -sums / np.maximum(n, 1)[:, None], n, n_letters


def build(counts: pd.DataFrame, rare: dict[str, tuple[int, int]] | None = None) -> Model:
    """Kneser-Ney models from columns ``lang``, ``gram`` (``ORDER`` characters), ``n``. ``rare``: how many n-grams stood once and
    twice, for languages of which rare ones are left out."""
    langs = sorted(counts["lang"].unique())
    alphabet = sorted(set("".join(counts["gram"].str.slice(-1, None))))
    floor = -np.log(len(alphabet) + 1.0)
    per_lang: list[list[pd.DataFrame]] = []
    for lang in langs:
        level = counts.loc[counts["lang"] == lang, ["gram", "n"]]
        levels = [level]
        for _ in range(ORDER - 1):  # continuation counts: different characters seen before the shorter n-gram
            level = level.assign(gram=level["gram"].str.slice(1)).groupby("gram", as_index=False).agg(n=("n", "size"))
            levels.append(level)
        levels.reverse()
        lower: pd.Series | None = None
        done = []
        for order, level in enumerate(levels, 1):
            level = level.copy()
            level["context"] = level["gram"].str.slice(0, -1)
            ones, twos = rare[lang] if order == ORDER and rare and lang in rare else ((level["n"] == 1).sum(), (level["n"] == 2).sum())
            discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            total, kinds = level.groupby("context")["n"].transform("sum"), level.groupby("context")["n"].transform("size")
            base = np.exp(floor) if lower is None else level["gram"].str.slice(1).map(lower).to_numpy()
            level["p"] = (level["n"] - discount) / total + discount * kinds / total * base
            level["lambda"] = discount * kinds / total
            lower = level.set_index("gram")["p"]
            done.append(level)
        per_lang.append(done)
    hashes, logp, backoff = [], [], []
    for order in range(1, ORDER + 1):
        grams = sorted(set().union(*(d[order - 1]["gram"] for d in per_lang)))
        p, b = np.zeros((len(grams), len(langs))), np.ones((len(grams), len(langs)))
        for k, d in enumerate(per_lang):
            own = d[order - 1].set_index("gram")["p"].reindex(grams).to_numpy()
            if order > 1:  # unseen here: back off
                contexts = d[order - 1].drop_duplicates("context").set_index("context")["lambda"]
                lam = pd.Series([g[:-1] for g in grams]).map(contexts).fillna(1.0).to_numpy()
                rest = np.exp(pd.Series([g[1:] for g in grams]).map(before).map(lambda i: logp[-1][int(i), k] if i == i else floor).to_numpy(dtype=float))
                own = np.where(np.isnan(own), lam * rest, own)
            else:
                own = np.where(np.isnan(own), discount_floor(d[0]) * np.exp(floor), own)
            p[:, k] = own
            if order < ORDER:
                after = d[order].drop_duplicates("context").set_index("context")["lambda"]
                b[:, k] = pd.Series(grams).map(after).fillna(1.0).to_numpy()
        before = {g: i for i, g in enumerate(grams)}
        h = np.array([gram_hashes(np.frombuffer(g.encode("utf-32-le"), np.uint32), order)[0] for g in grams], np.uint64)
        at = np.argsort(h)
        hashes.append(h[at])
        logp.append(np.log(p))
        backoff.append(np.log(b))
        if order > 1:
            logp[-2], backoff[-2] = logp[-2][order_before].astype(np.float32), backoff[-2][order_before].astype(np.float32)
        order_before = at
    logp[-1], backoff[-1] = logp[-1][order_before].astype(np.float32), backoff[-1][order_before].astype(np.float32)
    return Model(langs, hashes, logp, backoff, float(floor))


def discount_floor(unigrams: pd.DataFrame) -> float:
    return float(unigrams["lambda"].iloc[0])


def parts(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Groups of texts of bounded size with the number of the text each part comes from; longer texts are scored in parts."""
    group, owner, size = [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t)), PART):
            group.append(t[at : at + PART])
            owner.append(k)
            size += len(group[-1])
            if size >= GROUP:
                yield group, owner
                group, owner, size = [], [], 0
    if group:
        yield group, owner


def sample_of(df: DataFrame, sample_docs: int) -> DataFrame:
    """About ``sample_docs`` documents a language, by hash of the id; columns ``doc_id``, ``text``, ``lang``, ``part`` (0..1; 0 for all
    of a language with few documents)."""
    h = F.pmod(F.xxhash64(F.lit("lang-sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = df.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("n"), F.min(h).alias("lowest"))
    share = F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.col("n"))
    few = (F.col("n") < SPARE_FROM) | (F.col("lowest") >= 0.8 * share)
    return df.join(F.broadcast(sizes), df["lang"] == sizes["l"]).withColumn("h", h).where(F.col("h") < share).select("doc_id", "text", "lang", F.when(few, 0.0).otherwise(F.col("h") / share).alias("part"))


def shares(sizes: dict[str, int], most: int) -> dict[str, int]:
    """N-grams of each language in a model of ``most``: small languages keep all, and what they leave is for the larger ones."""
    out, left = {}, most
    for k, lang in enumerate(sorted(sizes, key=lambda x: (sizes[x], x))):
        out[lang] = min(sizes[lang], max(LEAST_GRAMS, left // (len(sizes) - k)))
        left = max(0, left - out[lang])
    return out


def fit(df: DataFrame, sample_docs: int = 4000, max_cells: int = 8_000_000) -> Model | None:
    """Fit on ``doc_id``, ``text``, ``lang`` (no nulls); ``None`` without any letters to learn from.

    Four fifths of the sample are counted, one fifth calibrates the rejection limits; all documents of a language with few are
    counted, and it has no limit. Where the languages have more than ``max_cells / languages / 2`` n-grams together, the most
    frequent ones of each are kept, up to its share.
    """
    small_batches(df)
    sample = sample_of(df, sample_docs)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lang, rows in f.groupby("lang"):
                for group, _ in parts(rows["text"].tolist()):
                    points, starts, n_letters = letters(group)
                    if not n_letters.any():
                        continue
                    ok = np.ones(len(points) - ORDER + 1, bool)
                    for k in range(1, ORDER):
                        ok[starts[1:] - k] = False
                    h, first, n = np.unique(gram_hashes(points, ORDER)[ok], return_index=True, return_counts=True)
                    at = np.flatnonzero(ok)[first]
                    text = points.astype("<u4").tobytes().decode("utf-32-le", "replace")
                    yield pd.DataFrame({"lang": lang, "gram": [text[i : i + ORDER] for i in at], "n": n})

    counted = written(sample.where("part < 0.8").mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    sizes = {r["lang"]: r for r in counted.groupBy("lang").agg(F.count("*").alias("all"), F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect()}
    if not sizes:
        return None
    share = shares({x: r["all"] for x, r in sizes.items()}, max_cells // len(sizes) // 2)
    cut = [x for x in sizes if share[x] < sizes[x]["all"]]
    top = counted.where(~F.col("lang").isin(cut)) if cut else counted
    if cut:
        of_each = counted.sparkSession.createDataFrame([(x, share[x]) for x in cut], "lang string, share long")
        nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
        # the constant bound lets tasks drop rows before they are dealt out
        most = counted.withColumn("nth", nth).where(F.col("nth") <= max(share[x] for x in cut)).join(F.broadcast(of_each), "lang").where("nth <= share")
        top = top.unionByName(most.select("lang", "gram", "n"))
    model = build(top.toPandas(), {x: (sizes[x]["ones"], sizes[x]["twos"]) for x in cut})
    held = classify(sample.where("part >= 0.8"), model, keep=["lang"])
    q = held.where("lang = lang_pred").groupBy("lang").agg(F.avg("adjusted").alias("m"), F.percentile_approx("adjusted", 0.999).alias("q"))
    model.limits = {r["lang"]: (r["m"], r["m"] + 1.5 * (r["q"] - r["m"]) + 0.25) for r in q.collect()}
    return model


def predict(texts: list[str], model: Model | None) -> pd.DataFrame:
    """``lang_pred``, ``score``, ``cross_entropy``, ``adjusted``, ``rejected`` for each text.

    ``und`` (rejected, score 0) for texts without a letter. ``adjusted`` pulls the cross-entropy of short texts, as 40
    characters would, to the usual one of the language; over the language's limit a text is rejected.
    """
    n_langs = len(model.langs) if model else 1
    sums, n_all, letters_all = np.zeros((len(texts), n_langs)), np.zeros(len(texts)), np.zeros(len(texts))
    for group, owner in parts(texts) if model else ():
        entropy, n, n_letters = model.score(group)
        np.add.at(sums, owner, entropy * n[:, None])
        np.add.at(n_all, owner, n)
        np.add.at(letters_all, owner, n_letters)
    entropy = sums / np.maximum(n_all, 1)[:, None]
    best, low = entropy.argmin(axis=1), entropy.min(axis=1)
    gaps = np.exp(-(entropy - low[:, None]) * np.minimum(n_all, 100)[:, None])
    known = letters_all > 0
    usual = np.array([(model.limits or {}).get(x, (np.nan, np.inf)) for x in model.langs]) if model else np.array([[np.nan, np.inf]])
    mean, limit = usual[best, 0], usual[best, 1]
    adjusted = np.where(np.isnan(mean), low, (low * n_all + np.nan_to_num(mean) * 40) / (n_all + 40))
    names = [model.langs[b] if k else "und" for b, k in zip(best, known)]
    return pd.DataFrame({"lang_pred": names, "score": np.where(known, 1 / gaps.sum(axis=1), 0.0), "cross_entropy": low, "adjusted": adjusted, "rejected": ~known | (adjusted > limit)})


def classify(df: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """``doc_id``, ``keep`` columns and the columns of ``predict``, one row per input row.

    Null texts count as empty. Without a model (nothing to learn from) every text is ``und``. Repeated rows, null ids
    and further columns have no effect. An empty table gives no rows.
    """
    small_batches(df)
    keep, fields = keep or [], [f for f in df.schema if f.name in ["doc_id", *(keep or [])]]
    out_schema = T.StructType([*fields, *T.StructType.fromDDL("lang_pred string, score double, cross_entropy double, adjusted double, rejected boolean")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predict([t or "" for t in batch.column("text").to_pylist()], model)
            rest = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, *(pa.array(found[c]) for c in found)], [*rest.schema.names, *found])

    return df.select(*[f.name for f in fields], "text").mapInArrow(run, out_schema)


def accepted(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose text is not rejected."""
    small_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predict([t or "" for t in batch.column(text_col).to_pylist()], model)
            yield batch.filter(pa.array(~found["rejected"].to_numpy(bool)))

    return df.mapInArrow(run, df.schema)


def training_rows(df: DataFrame) -> DataFrame:
    """Rows to learn from: id and language known, fold of the id not 2."""
    return df.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").where(fold(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang")


@query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = classify(docs, fit(training_rows(docs)))
    return out.withColumn("held_out", fold(F.col("doc_id"), 4) == 2).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
