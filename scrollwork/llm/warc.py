"""WARC archives in the per-record zstandard form: a shared dictionary, one frame per record.

An archive file is::

    skippable frame 0x184D2A5D    the dictionary, if there is one
    one zstandard frame           per record: header lines, empty line, block, two line ends
    skippable frame 0x184D2A50    empty; the separator that Spark's text writer puts after a row

A record whose payload stands in another record too is a ``revisit`` without payload that refers to it. Archives are rows
of bounded size, each written to a file of its own by Spark's text writer, which commits tasks: a lost executor leaves no half
archive, and any store that Spark writes to will do. The reader takes any archive of this form, from other writers too.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from scrollwork.llm.common import query, table, written
from scrollwork.session import scratch

DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
#: an empty skippable frame
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
SALTS = 32
STEP = 1 << 16
HEADER = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*(.*?)[ \t]*")


class Damaged(ValueError):
    """An archive or record that does not hold what its headers say."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def safe(url: str) -> str:
    """A header value must not hold line ends or blanks."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


# --- records --------------------------------------------------------------------------


def record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """A response, or with ``refers_to`` a revisit. Both name length and digest of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = lambda x: f"<urn:page:{'' if x is None else safe(str(x))}>"
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", date),
        *([("WARC-Target-URI", safe(url))] if url is not None else []),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))] if refers_to is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"".join([VERSION, b"\r\n", *[f"{k}: {v}\r\n".encode() for k, v in lines], b"\r\n", block, b"\r\n\r\n"])


def _headers(head: bytes, what: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.split(b"\r\n"):
        m = HEADER.fullmatch(line)
        if not m:
            raise Damaged(f"{what} header line {line[:60]!r}")
        out.setdefault(m[1].decode().lower(), m[2].decode("utf-8", "replace"))
    return out


def _length(headers: dict[str, str], what: str) -> int:
    if not re.fullmatch(r"[0-9]{1,18}", headers.get("content-length", "")):
        raise Damaged(f"{what} length {headers.get('content-length')!r}")
    return int(headers["content-length"])


def parse(data: bytes) -> tuple[dict[str, str], bytes | None, int | None]:
    """Headers, payload (None where the record holds none) and the length of the full payload; raises ``Damaged``."""
    first, _, rest = data.partition(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", first):
        raise Damaged(f"version line {first[:20]!r}")
    head, gap, _ = rest.partition(b"\r\n\r\n")
    if not gap:
        raise Damaged("no end of headers")
    headers = _headers(head, "record")
    if missing := [k for k in REQUIRED if not headers.get(k)]:
        raise Damaged(f"no {missing[0]}")
    at, size = len(first) + 2 + len(head) + 4, _length(headers, "record")
    if len(data) != at + size + 4 or data[-4:] != b"\r\n\r\n":
        raise Damaged(f"block of {len(data) - at - 4} bytes, {size} stated")
    block = data[at : at + size]
    _digest(headers, "warc-block-digest", block)
    if not headers.get("content-type", "").startswith("application/http"):
        return headers, None if headers["warc-type"] == "revisit" else block, None if headers["warc-type"] == "revisit" else size
    http, gap, payload = block.partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise Damaged("no HTTP headers")
    http_headers = _headers(lines, "HTTP") if lines else {}
    full = _length(http_headers, "payload") if "content-length" in http_headers else None
    if headers["warc-type"] == "revisit":
        if payload:
            raise Damaged("a revisit with a payload")
        return headers, None, full
    if full is not None and full != len(payload):
        raise Damaged(f"payload of {len(payload)} bytes, {full} stated")
    _digest(headers, "warc-payload-digest", payload)
    return headers, payload, len(payload)


def _digest(headers: dict[str, str], name: str, data: bytes) -> None:
    """Digests by other methods than SHA-1 are not checked."""
    method, _, value = headers.get(name, "").partition(":")
    if method.lower() == "sha1" and value.upper() != sha1_base32(data):
        raise Damaged(f"{name} {value[:40]}")


# --- archives -------------------------------------------------------------------------


def dictionary_frame(dictionary: bytes) -> bytes:
    return DICTIONARY_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary if dictionary else b""


class Archive:
    """Collects records into one archive of bounded size after the other."""

    def __init__(self, dictionary: bytes, limit: int):
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        self.lead, self.limit = dictionary_frame(dictionary), limit
        self.frames, self.size = [], 0

    def add(self, data: bytes) -> bytes | None:
        """The archive so far, if it is full with this record."""
        self.frames.append(self.compressor.compress(data))
        self.size += len(self.frames[-1])
        return self.done() if self.size >= self.limit else None

    def done(self) -> bytes:
        out = b"".join([self.lead, *self.frames])
        self.frames, self.size = [], 0
        return out


def _leading_dictionary(blob: bytes) -> tuple[bytes, int]:
    """The dictionary, and where the records begin. A dictionary may itself be a compressed frame."""
    if int.from_bytes(blob[:4], "little") != DICTIONARY_MAGIC:
        return b"", 0
    size = int.from_bytes(blob[4:8], "little")
    if len(blob) < 8 + size:
        raise Damaged("the dictionary is cut off")
    dictionary = bytes(blob[8 : 8 + size])
    if int.from_bytes(dictionary[:4], "little") == FRAME_MAGIC:
        dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
    return dictionary, 8 + size


def frames(blob: bytes) -> Iterator[tuple[int, bytes | Damaged]]:
    """Offset and content of each frame, skippable ones left out. What can't be decoded ends the archive with ``Damaged``."""
    try:
        dictionary, at = _leading_dictionary(blob)
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    except (Damaged, zstandard.ZstdError) as e:
        yield 0, Damaged(f"dictionary: {e}")
        return
    view = memoryview(blob)
    while at < len(blob):
        magic = int.from_bytes(blob[at : at + 4], "little")
        if magic in SKIPPABLE:
            if len(blob) < at + 8 or len(blob) < (end := at + 8 + int.from_bytes(blob[at + 4 : at + 8], "little")):
                yield at, Damaged("a skippable frame is cut off")
                return
            at = end
            continue
        one, parts, start = reader.decompressobj(), [], at
        try:
            while not one.eof and at < len(blob):  # in steps: what is left over is copied at each end of a frame
                parts.append(one.decompress(view[at : at + STEP]))
                at = min(len(blob), at + STEP)
        except zstandard.ZstdError as e:
            yield start, Damaged(f"frame: {e}")
            return
        if not one.eof:
            yield start, Damaged("a frame is cut off")
            return
        at -= len(one.unused_data)
        yield start, b"".join(parts)


def records(blob: bytes) -> Iterator[tuple[int, dict[str, str] | None, bytes | None, int | None, str | None]]:
    """Offset, headers, payload, length of the full payload and fault of each record. A record whose headers or lengths are
    wrong has a fault and the reader goes on with the next frame; a broken frame is the last that can be told."""
    for at, data in frames(blob):
        try:
            if isinstance(data, Damaged):
                raise data
            yield (at, *parse(data), None)
        except Damaged as e:
            yield at, None, None, None, str(e)


# --- tables ---------------------------------------------------------------------------


def train_dictionary(rows: DataFrame, sample: int = 256, sample_bytes: int = 1 << 14, dict_bytes: int = 1 << 15) -> bytes:
    """A dictionary from at most ``sample`` payloads of at most ``sample_bytes`` bytes each, picked by hash at a rate that the
    count of rows sets, so about twice ``sample`` rows reach the driver from all tasks together. It only changes sizes.
    Too little to train on: no dictionary (empty bytes)."""
    short = rows.where(F.octet_length("payload").between(1, sample_bytes)).select(F.xxhash64("page_id", "payload").alias("h"), "payload")
    share = -(-(2 * sample << 30) // max(1, short.count()))
    picked = sorted((r.h, bytes(r.payload)) for r in short.where(F.pmod("h", F.lit(1 << 30)) < share).limit(4 * sample).collect())[:sample]
    try:
        return zstandard.train_dictionary(dict_bytes, [record(k, None, p, None, "2000-01-01T00:00:00Z") for k, (_, p) in enumerate(picked)]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def responses(rows: DataFrame, min_bytes: int) -> DataFrame:
    """``rows`` (``page_id``, ``url``, ``payload``) with ``refers_to``: the response that a revisit stands for, else null.

    Equal payloads meet by SHA-256 and length, first by salt, so one payload in a third of all rows is no hot task.
    """
    keyed = rows.withColumns({"digest": F.unhex(F.sha2("payload", 256)), "salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")})
    salted = keyed.where(F.octet_length("payload") >= min_bytes).groupBy("digest", "salt").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    salted = written(salted, "warc-groups")
    groups = salted.groupBy("digest").agg(F.max("top").alias("keep"), F.sum("n").alias("n")).where("n > 1 AND keep IS NOT NULL")
    found = salted.select("digest", "salt").join(groups.select("digest", "keep"), "digest")
    out = keyed.alias("a").join(found.alias("b"), (F.col("a.digest") == F.col("b.digest")) & (F.col("a.salt") == F.col("b.salt")), "left")
    return out.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")).alias("refers_to"))


def write_warc(
    df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0,
    archive_bytes: int = 1 << 25, date: str = "2000-01-01T00:00:00Z",
) -> None:
    """Write one record per row to archives under ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the largest id is the response; the others are
    revisits that refer to it. Smaller payloads are all responses. Null html is the empty payload; a null url has no header.
    A row without an id is never referred to: it is a revisit if its payload has an id elsewhere, else a response. Rows that repeat
    the largest id with its payload are responses each. Very long pages are one record. An empty table writes no archive.
    Other columns are ignored, whatever their names. ``archive_bytes`` bounds a file, but for its last record.
    """
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    dictionary = train_dictionary(rows)

    def pack(batches):
        archive = Archive(dictionary, archive_bytes)
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, payload, refers_to = (c[k].as_py() for c in batch.columns)
                if full := archive.add(record(page_id, url, payload, refers_to, date)):
                    yield pa.RecordBatch.from_pydict({"archive": pa.array([full], pa.binary())})
        if archive.frames:
            yield pa.RecordBatch.from_pydict({"archive": pa.array([archive.done()], pa.binary())})

    out = responses(rows, min_bytes).mapInArrow(pack, "archive binary").select(F.col("archive").cast("string"))
    out.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_warc(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """One row per record of all archives under ``path``: ``file``, ``at`` (offset of its frame), ``record_type``, ``record_id``,
    ``refers_to``, ``target_uri``, ``payload`` (null for revisits), ``payload_bytes``, ``payload_digest`` (of the full payload),
    ``headers`` (names in lower case) and ``fault``.

    Version, header lines, lengths and SHA-1 digests are checked. With ``FAILFAST`` a fault raises; with ``PERMISSIVE`` the record
    is a row that has only ``file``, ``at`` and ``fault``.
    """
    text, whole = pa.string(), pa.int64()
    schema = pa.schema([("file", text), ("at", whole), ("record_type", text), ("record_id", text), ("refers_to", text), ("target_uri", text), ("payload", pa.binary()), ("payload_bytes", whole), ("payload_digest", text), ("headers", pa.map_(text, text)), ("fault", text)])

    def decode(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                file, blob, rows, held = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), [], 0
                for at, headers, payload, full, fault in records(blob):
                    if fault and mode == "FAILFAST":
                        raise Damaged(f"{file} at {at}: {fault}")
                    h = headers or {}
                    digest = h.get("warc-payload-digest", "").partition(":")[2].upper() or (None if payload is None else sha1_base32(payload))
                    rows.append((file, at, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"), payload, full, digest, list(h.items()) if headers else None, fault))
                    held += len(payload or b"")
                    if held >= 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    names = "file string, at long, record_type string, record_id string, refers_to string, target_uri string, payload binary, payload_bytes long, payload_digest string, headers map<string,string>, fault string"
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content").mapInArrow(decode, names)


def page_number(c):
    """The id in ``<urn:page:...>``; null where there is none."""
    return F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit(""))


_B32 = "string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 1 + 5 * (k // 4), 5))::INTEGER) >> (15 - 5 * (k % 4))::INTEGER) & 31), 1), '' ORDER BY k)"


@query(f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep FROM pages),
d AS (SELECT h, {_B32} AS digest FROM (SELECT DISTINCT h FROM p), range(32) r(k) GROUP BY h)
SELECT page_id, octet_length(encode(t)) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM p JOIN d USING (h)
""")
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = table(spark, sf_dir, "pages"), scratch(spark, "warc")
    write_warc(pages, path)
    kind = pages.schema["page_id"].dataType
    back = read_warc(spark, path)
    return back.select(page_number("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_number("refers_to").cast(kind).alias("refers_to"))
