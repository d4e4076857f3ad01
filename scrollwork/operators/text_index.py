"""A written positional index of chunks, and search that reads nothing else.

Tables under one path, all partitioned by ``pack_id``:

* ``postings`` (also by ``bucket``, a hash of the term): a term, and as arrays the chunks of a run that hold it: their keys, token
  counts, how often the term stands in each, and its places one chunk after the other
* ``terms`` (also by ``bucket``): in how many chunks of the pack a term stands
* ``sizes``: chunks and tokens of a pack
* ``form``: one row, how the index was made

Places count on over the searched columns, with a gap between two columns, so that no phrase crosses them. A search knows its
terms, so it knows their buckets and reads those partitions only. A build deals the chunks in ranges of pack and key; each run of
chunks is put together in its task and written there. Frequencies and sizes are summed from the rows written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from scrollwork.functions import text as T
from scrollwork.functions.stem import stem
from scrollwork.operators import retrieval
from scrollwork.session import small_batches

#: folders of a pack; an index of many packs wants few, one of large packs many
BUCKETS = 8
#: tokens that are indexed together in a task
PIECE = 1 << 18
#: packs that a search may name in a partition filter
NAMED_PACKS = 1000


def chunk_fields() -> list[Column]:
    """The text a chunk can be found by: title, body, type, tags and id."""
    return [F.col("section_title"), F.col("content"), F.col("chunk_type"), F.array_join("tags", " "), F.col("chunk_id")]


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def stemmed_terms(terms: pa.Array) -> pa.Array:
    """The stem of each term; rules run once per distinct term of the array."""
    coded = terms.dictionary_encode()
    return pa.DictionaryArray.from_arrays(coded.indices, pa.array([stem(t) for t in coded.dictionary.to_pylist()], pa.string())).cast(pa.string())


def pieces(batch: pa.RecordBatch, column: int) -> list[pa.RecordBatch]:
    """Runs of rows of about ``PIECE`` tokens, views of the batch: its working arrays take many times the memory of the tokens."""
    before = np.append(0, np.cumsum(np.diff(batch.column(column).offsets.to_numpy())))
    ends = np.flatnonzero(np.diff(before[1:] // PIECE, append=-1)) + 1  # the last row always ends a run
    starts = np.append(0, ends[:-1])
    return [batch.slice(int(a), int(b - a)) for a, b in zip(starts, ends)] if batch.num_rows else []


def positions(chunks: DataFrame, fields: list[Column], key: str = "chunk_id", carry: list[str] = [], stemmed: bool = False) -> DataFrame:
    """``pack_id``, ``term``, ``chunks``, ``tokens``, then as arrays ``key``, ``carry``, ``length``, ``counts``, ``positions``, without a shuffle.

    One row per pack, term and run of rows (of ``PIECE`` tokens): ``chunks`` of the run hold the term, ``tokens`` times in all; the positions of
    a chunk follow those of the chunk before. A row of the empty term, with null arrays, counts all chunks of a run and their tokens.
    Null fields are empty. Rows that repeat a key are chunks of their own.
    """
    parts = [T.terms(F.coalesce(f, F.lit(""))) for f in fields]
    tokens = F.concat(*[x for p in parts for x in (F.array(F.lit("")), p)][1:])  # the empty token is the gap
    rows = chunks.select("pack_id", key, *carry, tokens.alias("__tokens"))
    names = [key, *carry]
    schema = StructType([StructField("pack_id", StringType()), StructField("term", StringType()), StructField("chunks", LongType()), StructField("tokens", LongType())])
    for c in names:
        schema = schema.add(c, ArrayType(rows.schema[c].dataType))
    for c in ("length", "counts", "positions"):
        schema = schema.add(c, ArrayType(IntegerType()))
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def post(batches):
        for batch in (part for whole in batches for part in pieces(whole, 1 + len(names))):
            lists = batch.column(1 + len(names))
            counts = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            row = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
            coded = (stemmed_terms(flat) if stemmed else flat).dictionary_encode()
            word, live = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False) != ""
            keep = live[word] if len(flat) else np.zeros(0, bool)
            row, place, word = row[keep], place[keep], word[keep]
            length = np.bincount(row, minlength=len(counts))
            packs = batch.column(0).dictionary_encode()
            pack = packs.indices.to_numpy()
            n = len(packs.dictionary)
            whole = [packs.dictionary, pa.array([""] * n), pa.array(np.bincount(pack, minlength=n)), pa.array(np.bincount(pack, length, n).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(whole, kinds)] + [pa.nulls(n, k) for k in kinds[4:]], schema.names)
            if not len(row):
                continue
            code = pack[row].astype(np.int64) * len(live) + word
            order = np.argsort(code, kind="stable")  # rows and places stay in order
            row, place, code = row[order], place[order], code[order]
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])))
            row, code, times = row[first], code[first], np.diff(first, append=len(place))
            group = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            ends = pa.array(np.append(group, len(row)), pa.int32())
            spots = pa.array(np.append(first[group], len(place)), pa.int32())
            code = code[group]
            at = pa.array(row)
            columns = [packs.dictionary.take(pa.array(code // len(live))), coded.dictionary.take(pa.array(code % len(live)))]
            columns += [pa.array(np.diff(group, append=len(row))), pa.array(np.add.reduceat(times, group))]
            columns += [pa.ListArray.from_arrays(ends, batch.column(1 + i).take(at)) for i in range(len(names))]
            columns += [pa.ListArray.from_arrays(e, pa.array(v, pa.int32())) for e, v in ((ends, length[row]), (ends, times), (spots, place))]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds)], schema.names)

    small_batches(rows)
    return rows.mapInArrow(post, schema)


def _write(df: DataFrame, path: str, parts: list[str], replace: bool) -> None:
    out = df.write.partitionBy(*parts).mode("overwrite")
    (out.option("partitionOverwriteMode", "dynamic") if replace else out.option("partitionOverwriteMode", "static")).parquet(path)


def _named(packs: DataFrame) -> list[str] | None:
    """The pack ids, unless they are more than ``NAMED_PACKS``."""
    found = [r.pack_id for r in packs.limit(NAMED_PACKS + 1).collect()]
    return found if len(found) <= NAMED_PACKS else None


def _of_packs(df: DataFrame, packs: DataFrame, named: list[str] | None) -> DataFrame:
    """Rows of the packs; a few are named in the filter, so that nothing is dealt by pack, of which one may hold most rows."""
    return df.join(packs, "pack_id", "left_semi") if named is None else df.where(F.col("pack_id").isin(named))


def _store(chunks: DataFrame, path: str, fields: list[Column], key: str, carry: list[str], stemmed: bool, buckets: int, packs: DataFrame, replace: bool) -> None:
    spark = chunks.sparkSession
    text = F.col("pack_id").cast("string").alias("pack_id")
    packs = packs.select(text).where("pack_id IS NOT NULL").distinct()
    named = _named(packs)
    if named is not None:
        packs = spark.createDataFrame([(p,) for p in named], "pack_id string").coalesce(1)
    chunks = chunks.withColumn("pack_id", text)
    if replace:
        chunks = _of_packs(chunks, packs, named)
    # a task holds one pack, or a few small ones, so that the runs of a pack are long; of a large pack many tasks hold a range of keys
    chunks = chunks.repartitionByRange("pack_id", key).sortWithinPartitions("pack_id")
    rows = positions(chunks, fields, key, [c for c in carry if c != "pack_id"], stemmed).withColumn("bucket", _bucket(F.col("term"), buckets))
    if replace:  # one empty row per partition, so that a pack's older partitions are replaced even where it has no term any more
        every = packs.select("pack_id", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit("").alias("term"))
        rows = rows.unionByName(every, allowMissingColumns=True)
    _write(rows, f"{path}/postings", ["pack_id", "bucket"], replace)
    stored = _read(spark, f"{path}/postings")
    if replace:
        stored = _of_packs(stored, packs, named)
    terms = stored.groupBy("pack_id", "bucket", "term").agg(F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("chunks"))
    _write(terms.hint("rebalance", "pack_id", "bucket"), f"{path}/terms", ["pack_id", "bucket"], replace)
    # the rows of the empty term count chunks without a term, too
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sizes = stored.where("term = ''").groupBy("pack_id").agg(whole("chunks").alias("n"), whole("tokens").alias("tokens"))
    _write(sizes, f"{path}/sizes", ["pack_id"], replace)


def write_index(chunks: DataFrame, path: str, fields: list[Column], key: str = "chunk_id", carry: list[str] = [], stemmed: bool = False, buckets: int = BUCKETS) -> None:
    """Index ``chunks`` (``key``, ``pack_id``, the ``carry`` columns that searches may filter on, and what ``fields`` read)."""
    _store(chunks.where("pack_id IS NOT NULL"), path, fields, key, carry, stemmed, buckets, chunks.select("pack_id"), False)
    chunks.sparkSession.createDataFrame([(buckets, stemmed, key)], "buckets int, stemmed boolean, key string").coalesce(1).write.mode("overwrite").parquet(f"{path}/form")


def reindex_packs(chunks: DataFrame, path: str, fields: list[Column], packs: DataFrame, carry: list[str] = []) -> None:
    """Replace the rows of ``packs`` (``pack_id``) by those of ``chunks``, which may hold none for some of them. Other packs are not read or written."""
    form = chunks.sparkSession.read.parquet(f"{path}/form").first()
    _store(chunks, path, fields, form.key, carry, form.stemmed, form.buckets, packs, True)


def _read(spark: SparkSession, path: str) -> DataFrame:
    """Pack ids stay text: a folder name such as ``007`` would otherwise be read as a number."""
    found = spark.read.parquet(path).schema
    return spark.read.schema(StructType([StructField("pack_id", StringType()) if f.name == "pack_id" else f for f in found])).parquet(path)


def _terms_of(phrases: DataFrame, buckets: int) -> DataFrame:
    words = phrases.select("phrase").distinct().withColumn("words", F.split("phrase", " "))
    return words.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("offset", "term")).withColumn("bucket", _bucket(F.col("term"), buckets))


def _by_chunk(postings: DataFrame, own: list[str]) -> DataFrame:
    """``term``, ``own``, ``length``, ``positions``: a row of postings as one row per chunk."""
    kind = lambda c: postings.schema[c].dataType if c == "pack_id" else postings.schema[c].dataType.elementType
    schema = StructType([StructField("term", StringType()), *[StructField(c, kind(c)) for c in own], StructField("length", IntegerType()), StructField("positions", ArrayType(IntegerType()))])

    def unpack(batches):
        for batch in batches:
            of = dict(zip(batch.schema.names, batch.columns))
            at = pa.array(np.repeat(np.arange(batch.num_rows), of["counts"].value_lengths().to_numpy()))
            ends = pa.array(np.append(0, np.cumsum(of["counts"].flatten().to_numpy())), pa.int32())
            columns = [of["term"].take(at), *[of[c].take(at) if c == "pack_id" else of[c].flatten() for c in own]]
            yield pa.RecordBatch.from_arrays([*columns, of["length"].flatten(), pa.ListArray.from_arrays(ends, of["positions"].flatten())], schema.names)

    rows = postings.select("term", *own, "length", "counts", "positions")
    small_batches(rows)
    return rows.mapInArrow(unpack, schema)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values if len(ordered) else np.zeros(len(values), bool)


def _met(rows: DataFrame, own: list[str], phrases: list[tuple[str, list[str]]]) -> DataFrame:
    """``phrase``, ``own``, ``length``, ``tf`` of phrases of several words; a chunk's wanted terms meet once, however many phrases share them."""
    chunk = [*own, "length"]
    words = pa.array(sorted({t for _, ts in phrases for t in ts}), pa.string())
    number = {t: i for i, t in enumerate(words.to_pylist())}
    sought = [(p, [number[t] for t in ts]) for p, ts in phrases]
    schema = StructType([StructField("phrase", StringType()), *[rows.schema[c] for c in chunk], StructField("tf", LongType())])

    def starts(table):
        """Where another chunk begins; rows are in the order of their chunks."""
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for c in chunk:
            codes = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return new

    def meet(table):
        new = starts(table)
        lists = table.column("positions").combine_chunks()
        term = pc.index_in(table.column("term").combine_chunks(), words).to_numpy()
        times = lists.value_lengths().to_numpy()
        # a place among all chunks of the table
        place = np.repeat(np.cumsum(new) - 1, times) << 32 | lists.flatten().to_numpy()
        term = np.repeat(term, times)
        order = np.lexsort((place, term))
        place, term = place[order], term[order]
        bounds = np.searchsorted(term, np.arange(len(words) + 1))
        of = [place[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        head = np.flatnonzero(new)
        names, found, tf = [], [], []
        for i, (_, ts) in enumerate(sought):
            rarest = min(range(len(ts)), key=lambda k: len(of[ts[k]]))
            at = of[ts[rarest]] - rarest
            for k, t in enumerate(ts):
                if len(at) and k != rarest:
                    at = at[_among(at + k, of[t])]
            if len(at):
                which, n = np.unique(np.unique(at) >> 32, return_counts=True)
                names.append(np.full(len(which), i))
                found.append(which)
                tf.append(n)
        if names:
            at = pa.array(head[np.concatenate(found)])
            phrase = pa.array([p for p, _ in sought], pa.string()).take(pa.array(np.concatenate(names)))
            out = pa.table([phrase, *[table.column(c).take(at) for c in chunk], pa.array(np.concatenate(tf), pa.int64())], schema.names)
            yield from out.combine_chunks().to_batches()

    def run(batches):
        held = None  # the last chunk may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            last = int(np.flatnonzero(starts(held))[-1]) if held.num_rows else 0
            if last:
                yield from meet(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from meet(held)

    return rows.repartition(*[F.col(c) for c in chunk]).sortWithinPartitions(*chunk).mapInArrow(run, schema)


def index_hits(spark: SparkSession, path: str, phrases: DataFrame, packs: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(``phrase``, key, ``pack_id``, carried columns, ``length``, ``tf``) and (``phrase``, ``df``) of ``phrases`` (``phrase``: terms with blanks between).

    A phrase of one term reads its stored frequency, and the postings of ``packs`` only. Longer phrases look for the places of their
    terms side by side, in all packs, because their frequency is counted over all. Rows of one key, pack and length count as one chunk there.
    """
    form = spark.read.parquet(f"{path}/form").first()
    wanted = _terms_of(phrases, form.buckets)
    few = retrieval.small_enough(wanted, retrieval.BROADCAST_ROWS)
    sent = F.broadcast(wanted) if few else wanted
    buckets = [r.bucket for r in wanted.select("bucket").distinct().collect()]  # at most form.buckets
    postings = _read(spark, f"{path}/postings").where(F.col("bucket").isin(buckets) & (F.col("term") != ""))
    own = [c for c in postings.columns if c not in ("bucket", "term", "chunks", "tokens", "positions", "counts", "length")]
    here = postings if packs is None else postings.where(F.col("pack_id").isin(packs))
    alone = here.join(sent.where("n = 1").select("phrase", "term"), "term")
    arrays = [c for c in own if c != "pack_id"]
    single = alone.select("phrase", "pack_id", F.inline(F.arrays_zip(*arrays, "length", "counts"))).select("phrase", *own, "length", F.col("counts").cast("long").alias("tf"))
    several = sent.where("n > 1")
    terms = several.select("term").distinct()
    rows = _by_chunk(postings.join(F.broadcast(terms) if few else terms, "term", "left_semi"), own)
    if few:
        listed: dict[str, dict[int, str]] = {}
        for r in wanted.where("n > 1").collect():  # at most BROADCAST_ROWS
            listed.setdefault(r.phrase, {})[r.offset] = r.term
        longer = _met(rows, own, [(p, [ts[k] for k in sorted(ts)]) for p, ts in sorted(listed.items())])
    else:
        moved = rows.join(several.select("phrase", "n", "offset", "term"), "term")
        moved = moved.select("phrase", "n", *own, "length", F.transform("positions", lambda p: p - F.col("offset")).alias("at"))
        met = moved.groupBy("phrase", "n", *own, "length").agg(F.collect_list("at").alias("at")).where(F.size("at") == F.col("n"))  # as many arrays as the phrase has words
        both = F.aggregate(F.slice("at", 2, 1 << 30), F.col("at")[0], lambda a, b: F.array_intersect(a, b))
        longer = met.select("phrase", *own, "length", F.size(both).cast("long").alias("tf")).where("tf > 0")
    stored = _read(spark, f"{path}/terms").where(F.col("bucket").isin(buckets) & (F.col("term") != ""))
    known = stored.join(sent.where("n = 1").select("phrase", "term"), "term").groupBy("phrase").agg(F.sum("chunks").alias("df"))
    return single.unionByName(longer), known.unionByName(longer.groupBy("phrase").agg(F.count("*").alias("df")))


def same_asked(phrases: DataFrame, within: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``query_id``, ``ask``) and the ``phrases`` of each ask: queries with the same phrases and the same ``within`` are one ask.

    They find the same chunks in the same order, and each would shuffle all that it finds. An ask is a struct of its least query's id, which may be null.
    """
    asked = phrases.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct(*within, "phrase"))).alias("asked"))
    asks = asked.groupBy("asked").agg(F.min(F.struct("query_id")).alias("ask"))
    return asked.join(asks, "asked").select("query_id", "ask"), asks.select("ask", F.inline("asked")).withColumnRenamed("ask", "query_id")


def search_index(queries: DataFrame, path: str, k: int = 30, within: list[str] = []) -> DataFrame:
    """As ``retrieval.keyword_search``, from the index: ``query_id``, key, ``score``, ``rank``.

    On a stemmed index the terms of a query are stemmed as well. Columns in ``within`` must agree between a query and its chunks.
    Queries that ask the same are ranked once.
    """
    spark = queries.sparkSession
    form = spark.read.parquet(f"{path}/form").first()
    phrases = retrieval.query_phrases(queries, within)
    if "pack_id" in within:
        phrases = phrases.withColumn("pack_id", F.col("pack_id").cast("string"))
    if form.stemmed:

        def to_stems(batches):
            for batch in batches:
                texts = [" ".join(stem(t) for t in p.split(" ")) for p in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["phrase", "stems"])

        stems = phrases.select("phrase").distinct().mapInArrow(to_stems, "phrase string, stems string")
        phrases = phrases.join(stems, "phrase").select("query_id", *within, F.col("stems").alias("phrase")).distinct()
    packs = None
    if "pack_id" in within:
        found = [r.pack_id for r in phrases.select("pack_id").distinct().limit(NAMED_PACKS + 1).collect()]
        packs = found if len(found) <= NAMED_PACKS else None
    hits, freq = index_hits(spark, path, phrases, packs)
    size = _read(spark, f"{path}/sizes").agg(F.sum("n").alias("n"), (F.sum("tokens") / F.sum("n")).alias("mean_length"))
    of, asks = same_asked(phrases, within)
    found = retrieval.rank_hits(hits, asks, freq, size, form.key, within, k).withColumnRenamed("query_id", "ask")
    return of.join(found, "ask").select("query_id", form.key, "score", "rank")
