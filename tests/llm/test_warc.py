"""Archives: exact round trip, revisits against brute force, and damaged files."""
import glob
from collections import defaultdict

import pytest
import zstandard

from scrollwork.llm import warc


def pages(spark, rows):
    """With further columns whose names clash with working names."""
    return spark.createDataFrame([(*r, "x", 1, None) for r in rows], "page_id long, url string, html string, digest string, salt int, payload string")


LONG = "".join(chr(0x20 + k * 7919 % 0x3000) for k in range(1_500_000))
ROWS = [(k, f"http://h.example/{k}", f"<p>{'word ' * (k % 9)}é{k % 9}</p>") for k in range(40)]
ROWS += [(100, None, ""), (101, "a b\r\nX: y", None), (102, "u", LONG), (103, "u", "x\r\n\r\nWARC/1.1\r\n"), (104, "", LONG), (2**60 + 1, "u", "same"), (None, "u", "same"), (None, None, "only here"), (None, None, "only here"), (7, "u", "twice"), (7, "u", "twice"), (5, "v", "twice")]


def brute(rows, min_bytes=0):
    groups = defaultdict(list)
    for i, _, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, u, t in rows:
        data, ids = (t or "").encode(), [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids and len(groups[t or ""]) > 1 and len(data) >= min_bytes else i
        out.append((i, len(data), warc.sha1_base32(data), "response" if i == keep else "revisit", None if i == keep else keep))
    return sorted(out, key=repr)


def digests(spark, path):
    back = warc.read_warc(spark, path).select(warc.page_number("record_id").cast("long"), "payload_bytes", "payload_digest", "record_type", warc.page_number("refers_to").cast("long"))
    return sorted(map(tuple, back.collect()), key=repr)


@pytest.mark.parametrize("min_bytes, archive_bytes", [(0, 1 << 25), (5, 300)])
def test_round_trip(spark, tmp_path, min_bytes, archive_bytes):
    path = f"file://{tmp_path}/out"
    warc.write_warc(pages(spark, ROWS), path, min_bytes=min_bytes, archive_bytes=archive_bytes)
    assert digests(spark, path) == brute(ROWS, min_bytes)
    whole = {(r.record_id, bytes(r.payload).decode()) for r in warc.read_warc(spark, path).where("record_type = 'response'").collect()}
    assert whole >= {("<urn:page:103>", "x\r\n\r\nWARC/1.1\r\n"), ("<urn:page:104>", LONG), ("<urn:page:>", "only here")}
    files = glob.glob(f"{tmp_path}/out/part-*")
    assert archive_bytes > 300 or len(files) > 10
    for f in files:  # every file is a whole archive by itself
        assert all(x[4] is None for x in warc.records(open(f, "rb").read()))


def test_urls_cannot_add_headers(spark, tmp_path):
    warc.write_warc(pages(spark, ROWS), f"file://{tmp_path}/out")
    urls = {r.record_id: (r.target_uri, dict(r.headers)) for r in warc.read_warc(spark, f"file://{tmp_path}/out").collect()}
    assert urls["<urn:page:101>"][0] == "a%20b%0D%0AX:%20y" and "x" not in urls["<urn:page:101>"][1]
    assert urls["<urn:page:100>"][0] is None


def test_empty(spark, tmp_path):
    warc.write_warc(pages(spark, []), f"file://{tmp_path}/out")
    assert warc.read_warc(spark, f"file://{tmp_path}/out").count() == 0


def test_dictionary_forms():
    samples = [warc.record(k, f"http://h.example/{k}", b"<p>some page text %d</p>" % k * 9, None, "2000-01-01T00:00:00Z") for k in range(300)]
    trained = zstandard.train_dictionary(4096, samples).as_bytes()
    archive = warc.Archive(trained, 1 << 30)
    for s in samples:
        assert archive.add(s) is None
    blob = archive.done()
    plain = [x[1:] for x in warc.records(blob)]
    assert len(plain) == 300 and all(x[3] is None for x in plain)
    packed = warc.dictionary_frame(zstandard.ZstdCompressor().compress(trained)) + blob[len(warc.dictionary_frame(trained)) :]
    assert [x[1:] for x in warc.records(packed)] == plain
    without = blob[len(warc.dictionary_frame(trained)) :]
    assert [x[4] for x in warc.records(without)][0].startswith("frame")


def one(**change):
    parts = {"version": b"WARC/1.1", "type": b"response", "length": None, "block": b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc", "tail": b"\r\n\r\n", "extra": b""} | change
    length = str(len(parts["block"])).encode() if parts["length"] is None else parts["length"]
    return b"\r\n".join([parts["version"], b"WARC-Type: " + parts["type"], b"WARC-Record-ID: <urn:page:1>", b"WARC-Date: 2000-01-01T00:00:00Z", b"Content-Type: application/http", b"Content-Length: " + length]) + b"\r\n" + parts["extra"] + b"\r\n" + parts["block"] + parts["tail"]


@pytest.mark.parametrize("change, fault", [
    ({}, None),
    ({"version": b"WARC/2.0"}, "version"),
    ({"length": b"5"}, "block of"),
    ({"length": b"-5"}, "record length"),
    ({"tail": b"\r\n"}, "block of"),
    ({"tail": b"\r\n\r\nmore"}, "block of"),
    ({"type": b""}, "no warc-type"),
    ({"extra": b"no colon\r\n"}, "record header"),
    ({"extra": b"WARC-Payload-Digest: sha1:AAAA\r\n"}, "warc-payload-digest"),
    ({"extra": b"WARC-Block-Digest: sha1:AAAA\r\n"}, "warc-block-digest"),
    ({"block": b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\nabc"}, "payload of"),
    ({"block": b"abc"}, "no HTTP"),
    ({"type": b"revisit"}, "a revisit with"),
])
def test_validation(change, fault):
    blob = zstandard.compress(one(**change)) + zstandard.compress(one())
    first, second = warc.records(blob)
    assert (first[4] or "").startswith(fault or "") and bool(first[4]) == bool(fault)
    assert second[2:] == (b"abc", 3, None)


def test_broken_frames(spark, tmp_path):
    good = zstandard.compress(one())
    for blob, fault in ((good[:-3], "a frame is cut off"), (good + b"\x00" * 9, "frame"), (warc.dictionary_frame(b"x" * 99)[:50], "dictionary"), (good + b"P*M\x18\x09\x00\x00\x00", "a skippable")):
        assert list(warc.records(blob))[-1][4].startswith(fault)
    (tmp_path / "a").write_bytes(good + good[:-3])
    rows = warc.read_warc(spark, f"file://{tmp_path}/a", "PERMISSIVE").orderBy("at").collect()
    assert [r.fault for r in rows] == [None, "a frame is cut off"] and rows[0].payload_bytes == 3 and rows[1].record_type is None
    with pytest.raises(Exception, match="cut off"):
        warc.read_warc(spark, f"file://{tmp_path}/a").collect()
