"""Packing of documents into sequences of fixed length.

Bins are filled from a histogram, not row by row: lengths are integers up to the capacity, so the plan for all
pieces depends on the number of pieces per length only. It is made on the driver from at most ``capacity`` counts,
and its size is bounded by the capacity, not by the data. Pieces then look up their place by (length, rank).

* Pieces over a third of the capacity fit at most twice into a bin. From the longest down, each is matched with the
  longest such piece that still fits; what finds no partner stays alone.
* Shorter pieces, from the longest down, go to the smallest gap that takes them, and to new bins when none does.

Runs of bins with equal fill are handled together, so the plan costs the same for a thousand pieces and for 10^12.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from scrollwork.llm.common import docs_of, query, table, written
from scrollwork.llm.token_ids import encoder

RANK_BUCKETS = 256


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``(length, rank, n, per_bin, sequence, offset)``: the pieces of this length with ranks ``rank .. rank + n - 1`` fill bins
    from ``sequence`` on, ``per_bin`` in each, one behind the other from ``offset``."""
    left = {s: n for s, n in counts.items() if n > 0}
    rank: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    out: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def place(size: int, n: int, per_bin: int, first: int, offset: int) -> None:
        out.append((size, rank[size], n, per_bin, first, offset))
        rank[size] += n
        left[size] -= n

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for size in large:
        for other in large:
            if other > size or size + other > capacity:
                continue
            if not left[size]:
                break
            n = left[size] // 2 if other == size else min(left[size], left[other])
            if n:
                place(size, n, 1, bins, 0)
                place(other, n, 1, bins, size)
                gaps[capacity - size - other].append((bins, n))
                bins += n
        if n := left[size]:
            place(size, n, 1, bins, 0)
            gaps[capacity - size].append((bins, n))
            bins += n
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        gap = size
        while left[size]:
            while gap < capacity and not gaps[gap]:
                gap += 1
            per_bin = gap // size
            if gaps[gap]:
                first, n = gaps[gap].pop()
            else:  # no gap is large enough
                first, n = bins, -(-left[size] // per_bin)
                bins += n
            full = min(n, left[size] // per_bin)
            if full:
                place(size, full * per_bin, per_bin, first, capacity - gap)
                gaps[gap - per_bin * size].append((first, full))
            if full < n:
                rest = left[size]  # fewer than per_bin
                if rest:
                    place(size, rest, rest, first + full, capacity - gap)
                    gaps[gap - rest * size].append((first + full, 1))
                    full += 1
                if full < n:
                    gaps[gap].append((first + full, n - full))
    return out


def cut_pieces(df: DataFrame, tokenizer: str, leading_space: bool, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``. Only documents over the capacity are cut."""

    def cut(batches):
        enc = encoder(tokenizer, leading_space)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for doc_id, tokens in zip(ids, enc.encode(batch.column(1).to_pylist())):
                tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(tokens), capacity)):
                    part = tokens[at : at + capacity]
                    rows.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs_of(df, id_col, text_col).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(df: DataFrame, tokenizer: str, leading_space: bool = False, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    Null text is the empty text: one piece with the end id only. Null ids are kept as they are. Rows that repeat an id
    are separate documents. Ties between pieces of one length are broken by a hash of the id. An empty table gives no
    rows. Other columns are ignored.
    """
    pieces = written(cut_pieces(df, tokenizer, leading_space, end_id, capacity, id_col, text_col), "pieces")
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_BUCKETS)).cast("int"))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = sorted(plan_bins(counts, capacity))
    columns = [np.array(c, np.int64) for c in zip(*plan)] if plan else [np.zeros(0, np.int64)] * 6
    key = columns[0] << 44 | columns[1]  # ranks stay below 2^44

    by_bucket = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = by_bucket.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("base"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = pieces.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("inside"))

    def locate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, first_rank, _, per_bin, sequence, offset = columns
        for f in frames:
            at = np.searchsorted(key, f["length"].to_numpy() << 44 | f["rank"].to_numpy(), side="right") - 1
            nth = f["rank"].to_numpy() - first_rank[at]
            f["sequence_id"] = sequence[at] + nth // per_bin[at]
            f["offset"] = offset[at] + nth % per_bin[at] * length[at]
            yield f.drop(columns="rank")

    wanted = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*wanted, "rank").mapInPandas(locate, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


@query()
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
