"""A written vector index: items in cells around learned centres, searched by probing the nearest cells.

Four tables under one path:

* ``blocks``: about a megabyte of vectors of one collection and cell each (``ids`` ascending, ``values`` their vectors end to end),
  ranged and sorted by collection and cell, so that a filter on either skips row groups
* ``sizes``: per collection and cell the number of items and the least cosine to the centre
* ``centres``: at most ``MAX_CELLS`` unit vectors
* ``form``: how many cells a search probes, measured on the sample

Centres are fitted on a bounded sample (``sample_rows``); every item is put into the cell of its nearest centre. A search scores whole
blocks against blocks of queries and keeps the best per query inside the task, so vectors are moved by block and never per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from scrollwork.session import cut_lineage

MAX_CELLS = 4096
#: rows of the sample that the centres are fitted on
SAMPLE_ROWS = 20_000
BLOCK_BYTES = 1 << 20
CELL = ["collection", "cell"]


def _matrix(lists) -> np.ndarray:
    """Unit rows of an Arrow list column; a vector of zeros stays as it is."""
    m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def fit_centres(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means on unit rows; a centre that loses its rows keeps its place."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def probes_for(x: np.ndarray, collections: np.ndarray, centres: np.ndarray, n: int = 10, target: float = 0.95, queries: int = 200, seed: int = 7) -> int:
    """How many nearest cells hold the share ``target`` of the best ``n`` of every collection, by the sample's own rows as queries."""
    pick = np.random.default_rng(seed).choice(len(x), min(queries, len(x)), replace=False)
    place = np.argsort(np.argsort(-(x[pick] @ centres.T), axis=1, kind="stable"), axis=1)
    cells, need = np.argmax(x @ centres.T, axis=1), [np.zeros(1, np.int64)]
    sims = x[pick] @ x.T
    sims[np.arange(len(pick)), pick] = -np.inf  # a query is no find of itself
    for name in np.unique(collections):
        own = np.flatnonzero(collections == name)
        top = np.argsort(-sims[:, own], axis=1)[:, :n]
        real = np.take_along_axis(sims[:, own], top, axis=1) > -np.inf
        need.append(np.take_along_axis(place, cells[own][top], axis=1)[real])
    return int(np.quantile(np.concatenate(need), target, method="higher")) + 1


def write_index(items: DataFrame, path: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, target: float = 0.95) -> None:
    """Index ``items(item_id, vector, collection)``, all rows; without ``cells`` their number is the root of the row count.

    The index also keeps how many cells to probe by default, so that ``target`` of the best ten of a collection are found on the sample;
    vectors that do not lie in clusters need nearly all cells.
    Vectors have one length. Rows with a null in one of the three columns cannot be found and are left out; repeated rows are all kept.
    An empty table gives an index that finds nothing.
    """
    spark = items.sparkSession
    items = items.select("item_id", "vector", F.col("collection").cast("string").alias("collection")).dropna()
    n = items.count()
    cells = min(MAX_CELLS, max(1, cells or round(n**0.5)))
    part = items.select("vector", "collection").sample(min(1.0, 1.2 * sample_rows / max(1, n)), seed=7).limit(sample_rows).toArrow()
    if not part.num_rows:
        part = items.select("vector", "collection").limit(1).toArrow()
    x = _matrix(part["vector"].combine_chunks()) if part.num_rows else np.zeros((0, 0))
    centres = fit_centres(x, cells) if len(x) else x
    probes = probes_for(x, part["collection"].to_numpy(), centres, target=target) if len(x) else 1
    spark.createDataFrame([(probes,)], "probes int").write.parquet(f"{path}/form")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, vector array<double>").coalesce(1).write.parquet(f"{path}/centres")
    sent = spark.sparkContext.broadcast(centres)

    def place(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                near = _matrix(rows.column("vector")) @ sent.value.T
                best = np.argmax(near, axis=1)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(best.astype(np.int32)), pa.array(near[np.arange(len(best)), best])], [*rows.schema.names, "cell", "near"])

    kinds = ", ".join(f"{c} {t}" for c, t in items.dtypes)
    placed = cut_lineage(items.mapInArrow(place, f"{kinds}, cell int, near double"))
    sizes = cut_lineage(placed.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("low")))
    sizes.write.parquet(f"{path}/sizes")
    rows = max(64, BLOCK_BYTES // (8 * max(1, centres.shape[1])))
    # rows are dealt by their place in the written table, so repeated ids and vectors spread as well
    dealt = placed.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())).join(sizes.select(*CELL, F.ceil(F.col("n") / rows).alias("blocks")), CELL)
    packed = dealt.groupBy(*CELL, F.pmod("deal", "blocks").alias("block")).agg(F.sort_array(F.collect_list(F.struct("item_id", "vector"))).alias("p"))
    packed = packed.select(*CELL, "block", F.col("p.item_id").alias("ids"), F.flatten("p.vector").alias("values"))
    packed.repartitionByRange(*CELL).sortWithinPartitions(*CELL).write.parquet(f"{path}/blocks")


def _near_cells(queries: DataFrame, centres: np.ndarray) -> DataFrame:
    """``query_id, cell, cos, place``: every cell for every query, the nearest first. No vectors."""
    sent = queries.sparkSession.sparkContext.broadcast(centres)

    def measure(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                near = np.clip(_matrix(rows.column("vector")) @ sent.value.T, -1, 1)
                order = np.argsort(-near, axis=1, kind="stable").astype(np.int32)
                who = pa.array(np.repeat(np.arange(rows.num_rows), near.shape[1]))
                place = np.tile(np.arange(near.shape[1], dtype=np.int32), rows.num_rows)
                cos = np.take_along_axis(near, order, axis=1).ravel()
                yield pa.RecordBatch.from_arrays([rows.column("query_id").take(who), pa.array(order.ravel()), pa.array(cos), pa.array(place)], ["query_id", "cell", "cos", "place"])

    kind = dict(queries.dtypes)["query_id"]
    return queries.select("query_id", "vector").mapInArrow(measure, f"query_id {kind}, cell int, cos double, place int")


def _score(wanted: DataFrame, queries: DataFrame, blocks: DataFrame, n: int, q_blocks: int) -> DataFrame:
    """The ``n`` best items of every block for the queries that want its cell."""
    side = wanted.select("query_id", *CELL).join(queries, "query_id")
    side = side.groupBy(*CELL, F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).alias("qb")).agg(F.collect_list(F.struct("query_id", "vector")).alias("p"))
    side = side.select(*CELL, F.col("p.query_id").alias("q_ids"), F.flatten("p.vector").alias("q_values"))
    pairs = blocks.join(side, CELL).select("collection", "ids", "values", "q_ids", "q_values")

    def best(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                coll, ids, values, q_ids, q_values = (batch.column(j).slice(i, 1) for j in range(5))
                ids, q_ids = ids.flatten(), q_ids.flatten()
                unit = lambda flat, rows: _matrix(pa.FixedSizeListArray.from_arrays(flat.flatten(), len(flat.flatten()) // rows))
                sims = np.round(unit(q_values, len(q_ids)) @ unit(values, len(ids)).T, 6) + 0.0
                # ids ascend, so a stable order breaks ties by id
                top = np.argsort(-sims, axis=1, kind="stable")[:, :n]
                who = pa.array(np.repeat(np.arange(len(q_ids)), top.shape[1]))
                out = [q_ids.take(who), pa.repeat(coll[0], len(who)), ids.take(pa.array(top.ravel())), pa.array(np.take_along_axis(sims, top, axis=1).ravel())]
                yield pa.RecordBatch.from_arrays(out, ["query_id", "collection", "item_id", "similarity"])

    item = dict(blocks.dtypes)["ids"].removeprefix("array<")[:-1]
    return pairs.mapInArrow(best, f"query_id {dict(queries.dtypes)['query_id']}, collection string, item_id {item}, similarity double")


def _ranked(hits: DataFrame, n: int) -> DataFrame:
    w = W.partitionBy("query_id", "collection").orderBy(F.desc("similarity"), F.asc("item_id"))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def search_index(queries: DataFrame, path: str, n: int = 10, probes: int | None = None, collections: list | None = None, complete: bool = False) -> DataFrame:
    """Cosine top ``n`` per query and collection: ``query_id, collection, item_id, similarity, rank``.

    ``queries(query_id, vector)``, ids distinct; nulls find nothing. Scores are exact, the choice of cells is not: ``probes`` nearest ones
    are read (the index's own number if not given). ``complete`` makes the answer exact: after the probes, every cell is read too that can, by the
    angle between query and centre and the widest angle in the cell, hold an item as good as the ``n``-th found. ``collections`` keeps
    to those with an equal name.
    """
    spark: SparkSession = queries.sparkSession
    queries = queries.select("query_id", "vector").dropna()
    blocks, sizes = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/sizes")
    if collections is not None:
        keep = F.col("collection").isin([str(c) for c in collections])
        blocks, sizes = blocks.filter(keep), sizes.filter(keep)
    got = spark.read.parquet(f"{path}/centres").orderBy("cell").select("vector").toArrow()  # at most MAX_CELLS rows
    centres = _matrix(got["vector"].combine_chunks()) if got.num_rows else np.zeros((0, 0))
    if not len(centres):
        item = dict(blocks.dtypes)["ids"].removeprefix("array<")[:-1]
        none = queries.filter(F.lit(False)).select("query_id", F.lit("").alias("collection"), F.lit(None).cast(item).alias("item_id"), F.lit(0.0).alias("similarity"))
        return _ranked(none, n)
    probes = probes or spark.read.parquet(f"{path}/form").first()[0]
    q_blocks = max(1, -(-queries.count() * 8 * centres.shape[1] // BLOCK_BYTES))
    cells = _near_cells(queries, centres).join(sizes, "cell")
    hits = _ranked(_score(cells.filter(F.col("place") < probes), queries, blocks, n, q_blocks), n)
    if not complete:
        return hits
    hits = cut_lineage(hits)
    last = hits.filter(F.col("rank") == n).select("query_id", "collection", F.col("similarity").alias("last"))
    reach = F.cos(F.greatest(F.lit(0.0), F.acos("cos") - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "low"))) - 1e-6))
    rest = cells.filter(F.col("place") >= probes).join(last, ["query_id", "collection"], "left").filter(F.col("last").isNull() | (reach >= F.col("last") - 2e-6))
    return _ranked(hits.drop("rank").unionByName(_score(rest, queries, blocks, n, q_blocks)), n)
