"""Quality classifier: supervised subword embeddings.

A text's features are its words and the character 3- and 4-grams of its words (the blank at either end belongs to
them), as bytes and with their case, hashed into a table of learned vectors. The mean of the vectors goes through a
linear layer and softmax. Vectors and layer are trained together by stochastic gradient descent in numpy.

Training takes about ``sample_docs`` labelled documents (the first by hash of the id); their hashed counts, never more than
``buckets`` per document, go to the driver. Scoring covers every text in full: after training each bucket's vector
adds a fixed amount to the difference of the two outputs, so tasks receive one number per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from scrollwork.llm.common import as_text, docs_of, fold, query, table
from scrollwork.llm.words import MIX, PRINTED, groups, words

BUCKETS = 1 << 16
SIZES = (3, 4)


def features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts and the text each belongs to. Texts are cut at white space, never inside a word."""
    raw = np.frombuffer(b"".join(b" " + t + b" " for t in texts), np.uint8)
    lengths = np.array([len(t) + 2 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    points = np.where(blank, np.uint8(32), raw).astype(np.uint64)
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    found, whose = [], []
    for n in SIZES:
        m = len(raw) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        inner = np.ones(m, bool)
        for k in range(n):
            h = (h ^ points[k : m + k]) * MIX
            h ^= h >> np.uint64(31)
            if 0 < k < n - 1:
                inner &= ~blank[k : m + k]
        found.append((h * MIX >> shift)[inner].astype(np.int64))
        whose.append(owner[:m][inner])
    h, word_owner = words(texts, PRINTED)
    found.append((h * MIX >> shift).astype(np.int64))
    whose.append(word_owner)
    return np.concatenate(found), np.concatenate(whose)


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], classes: int = 2, dim: int = 8, epochs: int = 8, rate: float = 0.5, buckets: int = BUCKETS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Vectors (bucket, dim) and layer (dim + 1, class) from ``(features, counts, label)``; one step per document."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    layer = np.zeros((dim + 1, classes), np.float32)
    steps, total = 0, max(1, epochs * len(samples))
    for _ in range(epochs):
        for k in rng.permutation(len(samples)):
            ids, counts, label = samples[k]
            lr = rate * (1 - steps / total)
            steps += 1
            share = (counts / max(1, counts.sum())).astype(np.float32)
            mean = np.append(share @ vectors[ids], np.float32(1)) if len(ids) else np.append(np.zeros(dim, np.float32), np.float32(1))
            z = mean @ layer
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = layer[:dim] @ p
            layer -= lr * np.outer(mean, p)
            if len(ids):
                # the mean's gradient reaches a feature by its share; scaled by the number of features, as each of them stands for one in n
                vectors[ids] -= lr * (share * len(ids))[:, None] * back[None, :]
    return vectors, layer


def fit(labelled: DataFrame, sample_docs: int = 5000, buckets: int = BUCKETS, **kw) -> tuple[np.ndarray, float]:
    """Bucket weights and bias for class 1, from columns ``text`` and ``label`` (0 or 1) and ``doc_id``.

    Without both classes in the sample the weights are 0 and the bias follows the labels that exist (even without any).
    """
    h = F.pmod(F.xxhash64(F.lit("quality-sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    total = labelled.count()
    sample = labelled.where(h < min(1.0, sample_docs / max(1, total))).select("doc_id", "text", "label")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, n = [t or "" for t in f["text"]], len(f)
            rows: list[np.ndarray] = [np.zeros(0, np.int64)] * n
            for group, owner in groups(texts, lower=False):
                ids, whose = features(group, buckets)
                whose = np.asarray(owner)[whose]
                at = np.argsort(whose, kind="stable")
                bounds = np.searchsorted(whose[at], np.arange(n + 1))
                for k in set(owner):
                    rows[k] = np.append(rows[k], ids[at[bounds[k] : bounds[k + 1]]])
            pairs = [np.unique(r, return_counts=True) for r in rows]
            yield pd.DataFrame({"doc_id": f["doc_id"], "label": f["label"], "ids": [a.astype("<u4").tobytes() for a, _ in pairs], "counts": [b.astype("<u4").tobytes() for _, b in pairs]})

    found = sample.mapInPandas(count, "doc_id long, label int, ids binary, counts binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["ids"])))
    samples = [(np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["counts"], "<u4"), int(r["label"])) for r in found]
    ones = sum(s[2] for s in samples)
    if not 0 < ones < len(samples):
        return np.zeros(buckets, np.float32), 0.0 if not samples else (4.0 if ones else -4.0)
    vectors, layer = train(samples, buckets=buckets, **kw)
    difference = layer[:, 1] - layer[:, 0]
    return vectors @ difference[:-1], float(difference[-1])


def classify(df: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` (probability of class 1). Null and empty texts have no features and get the bias' score.
    Every row is scored by itself: repeated rows, null ids and other columns have no effect. An empty table gives no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sums, n = np.zeros(len(f)), np.zeros(len(f))
            for group, owner in groups(f["text"].tolist(), lower=False):
                ids, whose = features(group, len(weights))
                np.add.at(sums, owner, np.bincount(whose, weights[ids], len(group)))
                np.add.at(n, owner, np.bincount(whose, minlength=len(group)))
            yield pd.DataFrame({"doc_id": f["doc_id"], "score": 1 / (1 + np.exp(-np.clip(sums / np.maximum(n, 1) + bias, -60, 60)))})

    docs = docs_of(df, id_col, text_col)
    return as_text(docs, "doc_id").mapInPandas(run, "doc_id string, score double").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "score")


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with a known quality whose fold is not 1."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(fold(F.col("doc_id"), 3) != 1).select("doc_id", F.col("quality").cast("int").alias("label"))
    return docs.select("doc_id", "text").join(known, "doc_id")


@query()
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights, bias = fit(labelled_rows(docs, table(spark, sf_dir, "labels")))
    return classify(docs, weights, bias).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
