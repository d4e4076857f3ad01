"""Token ids in compressed shards with random access.

A shard is one self-contained run of documents in ascending id order::

    b"IDSHARD1"  magic
    u4 n         documents
    u4 nulls     how many of them, at the front, have no id
    u4 width     bytes of a token id (2 or 4)
    u4 body      bytes of all frames
    16 bytes     first half of the SHA-256 of the shared dictionary
    i8[n]        document ids
    u4[n]        ids per document
    u4[n + 1]    offset of each document's frame
    frames       one zstandard frame per document, compressed with the shared dictionary

Files hold shards one after the other, each followed by a line feed, because they are written by Spark's text
writer: it commits tasks, so a lost executor leaves no half file, and it reaches every store that Spark reaches.
The dictionary is trained on serialised arrays of a bounded sample and stands beside the shards.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scrollwork.llm.common import docs_of, query, table, written
from scrollwork.llm.token_ids import encoder
from scrollwork.session import scratch

MAGIC = b"IDSHARD1"
HEAD = struct.Struct("<8sIIII16s")
SHARD_BYTES = 1 << 21
#: shards in a file, which is read back as one value
FILE_SHARDS = 64


def dictionary_hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()[:16]


def _dict(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


class Packer:
    """Builds one shard after the other."""

    def __init__(self, dictionary: bytes, width: int, level: int = 3):
        self.width, self.hash = width, dictionary_hash(dictionary)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=_dict(dictionary))
        self.clear()

    def clear(self) -> None:
        self.ids, self.counts, self.frames, self.size = [], [], [], 0

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        frame = self.compressor.compress(tokens.astype(f"<u{self.width}").tobytes())
        self.ids.append(doc_id)
        self.counts.append(len(tokens))
        self.frames.append(frame)
        self.size += len(frame)

    def shard(self) -> bytes:
        n = len(self.ids)
        offsets = np.zeros(n + 1, "<u4")
        np.cumsum([len(f) for f in self.frames], out=offsets[1:])
        head = HEAD.pack(MAGIC, n, sum(i is None for i in self.ids), self.width, self.size, self.hash)
        out = b"".join([head, np.array([i or 0 for i in self.ids], "<i8").tobytes(), np.array(self.counts, "<u4").tobytes(), offsets.tobytes(), *self.frames])
        self.clear()
        return out


class Shard:
    """Random access to one shard at ``at`` in ``blob``; raises if it was written with another dictionary."""

    def __init__(self, blob: bytes, at: int, dictionary: bytes):
        magic, self.n, self.nulls, self.width, body, digest = HEAD.unpack_from(blob, at)
        if magic != MAGIC:
            raise ValueError("not a shard")
        if digest != dictionary_hash(dictionary):
            raise ValueError("the shard was written with another dictionary")
        n, p = self.n, at + HEAD.size
        self.ids = np.frombuffer(blob, "<i8", n, p)
        self.counts = np.frombuffer(blob, "<u4", n, p + 8 * n)
        self.offsets = np.frombuffer(blob, "<u4", n + 1, p + 12 * n)
        self.blob, self.body = blob, p + 16 * n + 4
        self.end = self.body + body
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_dict(dictionary))

    def doc_id(self, k: int) -> int | None:
        return None if k < self.nulls else int(self.ids[k])

    def tokens(self, k: int) -> np.ndarray:
        """The ids of document ``k``; only its own frame is read."""
        frame = self.blob[self.body + int(self.offsets[k]) : self.body + int(self.offsets[k + 1])]
        return np.frombuffer(self.decompressor.decompress(frame, max_output_size=max(1, int(self.counts[k]) * self.width)), f"<u{self.width}").astype("<u4")


def shards_in(blob: bytes, dictionary: bytes) -> Iterator[Shard]:
    at = 0
    while at < len(blob):
        shard = Shard(blob, at, dictionary)
        yield shard
        at = shard.end + 1


def train_dictionary(docs: DataFrame, tokenizer: str, leading_space: bool, end_id: int, width: int, sample_docs: int = 1000, sample_bytes: int = 1 << 15, dict_bytes: int = 1 << 16) -> bytes:
    """A dictionary from at most ``sample_docs`` documents, the first by hash of their id.

    Arrays over ``sample_bytes`` are left out of the sample: the dictionary is for short documents. At most
    ``sample_docs * sample_bytes`` bytes reach the driver. With too few arrays to train on, the arrays themselves serve
    as the dictionary, and without any there is none (empty bytes).
    """
    ids = [r[0] for r in docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample_docs).collect()]

    def arrays(batches):
        enc = encoder(tokenizer, leading_space)
        for batch in batches:
            out = [np.append(t, np.uint32(end_id)).astype(f"<u{width}").tobytes() for t in enc.encode(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x in out if len(x) <= sample_bytes], pa.binary())})

    samples = sorted(bytes(r[0]) for r in docs.where(F.col("doc_id").isin(ids)).select("text").mapInArrow(arrays, "a binary").collect()) if ids else []
    try:
        return zstandard.train_dictionary(dict_bytes, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:dict_bytes]


def write_shards(df: DataFrame, path: str, tokenizer: str, leading_space: bool, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, end it with ``end_id`` and write shards in ascending id order to ``path/shards``, the dictionary to ``path/dictionary``.

    Null text is the empty text: its document holds the end id only. Rows without an id come first. Rows that repeat an
    id stay separate documents, ordered by a hash of their text, so that a frequent id is shared out too. A file holds at most
    ``FILE_SHARDS`` shards; only a single longer document makes a shard larger than ``SHARD_BYTES``. An empty table gives no shard. Other columns are ignored.
    """
    docs, width = docs_of(df, id_col, text_col), 2 if vocabulary <= 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer, leading_space, end_id, width)

    def encode(batches):
        enc, packer = encoder(tokenizer, leading_space), Packer(dictionary, width)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc_id, tokens in zip(ids, enc.encode(batch.column(1).to_pylist())):
                packer.add(doc_id, np.append(tokens, np.uint32(end_id)))
                if packer.size >= SHARD_BYTES:
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([packer.shard()], pa.binary())})
        if packer.ids:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([packer.shard()], pa.binary())})

    spark = df.sparkSession
    place = ["doc_id", F.xxhash64("text")]
    ordered = docs.repartitionByRange(*place).sortWithinPartitions(*place, "text")
    shards = ordered.mapInArrow(encode, "shard binary").select(F.col("shard").cast("string"))
    shards.write.option("maxRecordsPerFile", FILE_SHARDS).text(f"{path}/shards")
    spark.createDataFrame([(bytearray(dictionary),)], "d binary").coalesce(1).select(F.col("d").cast("string")).write.text(f"{path}/dictionary")


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(f"{path}/dictionary/*.txt").select("content").first()[0])[:-1]


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: ``doc_id``, ``file``, ``at`` (place in the file), ``n_tokens``, ``ids`` (array)."""
    return _read(spark, path, "ids array<int>", lambda tokens: tokens.astype(np.int32), pa.list_(pa.int32()))


def _read(spark: SparkSession, path: str, column: str, value, kind: pa.DataType) -> DataFrame:
    dictionary = read_dictionary(spark, path)
    name = column.split()[0]

    def decode(batches):
        for batch in batches:
            for file, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = 0
                for shard in shards_in(blob, dictionary):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard.doc_id(k) for k in range(shard.n)], pa.int64()),
                            pa.array([file] * shard.n),
                            pa.array(range(at, at + shard.n), pa.int64()),
                            pa.array(shard.counts.astype(np.int64)),
                            pa.array([value(shard.tokens(k)) for k in range(shard.n)], kind),
                        ],
                        ["doc_id", "file", "at", "n_tokens", name],
                    )
                    at += shard.n

    files = spark.read.format("binaryFile").load(f"{path}/shards/*.txt").select("path", "content")
    return files.mapInArrow(decode, f"doc_id long, file string, at long, n_tokens long, {column}")


def file_order(file: Column) -> list[Column]:
    """Numbers of the task and of its file in the name that Spark gave a file: as text, task 100000 would stand before 99999."""
    return [F.regexp_extract(file, p, 1).cast("long") for p in (r"/part-(\d+)-[^/]*$", r"-c(\d+)\.[^/]*$")]


def shard_digests(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    Starts are summed inside each file, then over the files in the order of the task and of the file within it that their names
    tell, as numbers; that is the order of ids. The sum over files has one row per file.
    """
    rows = written(_read(spark, path, "ids_crc32 long", lambda tokens: zlib.crc32(tokens.tobytes()), pa.int64()), "shard-digests")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = files.select("file", (F.sum("total").over(Window.orderBy(*file_order(F.col("file")))) - F.col("total")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("at")) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(F.broadcast(before), "file").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


@query()
def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "id-shards")
    write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), True, 2, 50257)
    return shard_digests(spark, path)
