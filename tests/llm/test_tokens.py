"""Token ids, shards and packing: exact round trips and brute force."""
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scrollwork.llm import id_shards
from scrollwork.llm.id_shards import Packer, Shard, read_shards, shard_digests, write_shards
from scrollwork.llm.packing import pack, plan_bins
from scrollwork.llm.token_ids import ChunkEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [" ", "  ", "\n", "\t", " \n", "a", "b's", "'", "é", "é", " ", "　", "\x1c", "\x85", "1", "23", "!", "!!", "<|endoftext|>", "Σ", "İ", "​", "the", "\r\n", "😀", "\x0b"]


@pytest.mark.parametrize("path, leading", [(BYTE, True), (WORD, False)])
def test_chunks_equal_whole_texts(path, leading):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(8000)]
    words = ["the", "The", "THE", "naïve", "x", "don't", "it's", "S", "'s", "End", "a", "antidisestablishmentarianism"]
    texts += [" ".join(rnd.choice(words) + rnd.choice(["", "", ".", ",", "!!", "?!", ":;", "...", ".a", "'s"]) for _ in range(9)) for _ in range(8000)]
    texts += [" ".join(rnd.choice(PARTS) for _ in range(800_000))]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    assert [x.tolist() for x in ChunkEncoder(path, leading, max_chars=2000).encode(texts)] == want


def test_latin_words_are_merged_without_the_splitter():
    """Latin words with marks go to the merge model; every such letter, and what stands behind a word, gives the library's ids."""
    letters = [c for c in map(chr, range(0xAA, 0x250)) if c.isalpha()]
    words = [a + b for a in letters for b in ("", "e", "tés")] + ["x" + c for c in letters] + ["Été", "déjà,", "où...", "à;:"]
    texts = [f"{w} {w}. {w}!? a" for w in words]
    whole, passed = Tokenizer.from_file(BYTE), []

    class Watched:
        model = whole.model

        def encode_batch_fast(self, chunks, add_special_tokens):
            passed.extend(chunks)
            return whole.encode_batch_fast(chunks, add_special_tokens=add_special_tokens)

    enc = ChunkEncoder(BYTE, True)
    enc.tokenizer = Watched()
    assert [x.tolist() for x in enc.encode(texts)] == [x.ids for x in whole.encode_batch_fast(texts, add_special_tokens=False)]
    assert not [c for c in passed if any(map(str.isalpha, c))]


def whole_ids(rows, path, end):
    tok = Tokenizer.from_file(path)
    return [(i, tok.encode(t or "", add_special_tokens=False).ids + [end]) for i, t in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("size, shards", [(1 << 21, 64), (40, 1), (40, 2)])
def test_shards_round_trip(spark, odd, odd_rows, tmp_path, monkeypatch, size, shards):
    monkeypatch.setattr(id_shards, "SHARD_BYTES", size)
    monkeypatch.setattr(id_shards, "FILE_SHARDS", shards)
    path = f"file://{tmp_path}/out"
    write_shards(odd, path, BYTE, True, 2, 50257)
    hashes = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in odd_rows], "t string").selectExpr("t", "xxhash64(t) AS h").collect()}
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1] or ""]))
    start, want = 0, []
    for i, ids in whole_ids(order, BYTE, 2):
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, shard_digests(spark, path).collect()), key=lambda r: r[1]) == want
    back = sorted(((r.doc_id or -1, list(r.ids)) for r in read_shards(spark, path).collect()), key=repr)
    assert back == sorted(((i or -1, ids) for i, ids in whole_ids(odd_rows, BYTE, 2)), key=repr)


def test_files_in_order_of_tasks(spark):
    names = [f"s3a://b/part-7-c9/shards/part-{t}-6f-c1-4a-c{c}.txt" for t in ("00002", "99999", "100000") for c in ("000", "009", "010", "1000")]
    got = spark.createDataFrame([(n,) for n in names], "f string").orderBy(*id_shards.file_order(F.col("f"))).collect()
    assert [r.f for r in got] == names


def test_shards_empty(spark, none, tmp_path):
    write_shards(none, f"file://{tmp_path}/out", BYTE, True, 2, 50257)
    assert shard_digests(spark, f"file://{tmp_path}/out").count() == 0


def test_shard_refuses_another_dictionary():
    p = Packer(b"", 2)
    p.add(1, np.arange(5))
    blob = p.shard()
    assert Shard(blob, 0, b"").tokens(0).tolist() == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        Shard(blob, 0, b"other")


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([10, 64, 2048])
    counts = defaultdict(int)
    for _ in range(rnd.randint(0, 4000)):
        counts[min(cap, max(1, int(rnd.expovariate(3 / cap))))] += rnd.randint(1, 3)
    bins, ranks, large = defaultdict(list), defaultdict(set), defaultdict(int)
    for size, rank, n, per, seq, off in plan_bins(counts, cap):
        for k in range(n):
            assert rank + k not in ranks[size]
            ranks[size].add(rank + k)
            bins[seq + k // per].append((off + k % per * size, size))
            large[seq + k // per] += 3 * size > cap
    assert {s: set(range(n)) for s, n in counts.items()} == dict(ranks)
    for parts in bins.values():
        at = 0
        for off, size in sorted(parts):
            assert off == at
            at += size
        assert at <= cap
    assert all(n <= 2 for n in large.values())
    lower = -(-sum(s * n for s, n in counts.items()) // cap)
    assert len(bins) <= max(lower * 1.03 + 1, sum(n for s, n in counts.items() if 2 * s > cap) * 1.2 + 1)


def test_pack(odd, odd_rows):
    got = pack(odd, WORD, capacity=2048).collect()
    want = []
    for i, ids in whole_ids(odd_rows, WORD, 0):
        want += [(i, k, a, len(ids[a : a + 2048]), crc(ids[a : a + 2048])) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for off, length in sorted(parts):
            assert off == at
            at += length
        assert at <= 2048


def test_pack_empty(none):
    assert pack(none, WORD).count() == 0
