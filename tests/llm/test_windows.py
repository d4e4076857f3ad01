"""Equal windows of a batch: brute force, how much is sorted for them, and that pieces of one key meet."""
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from scrollwork.llm.substring_dedup import drop_repeats, equal_windows
from tests.llm.conftest import frame
from tests.llm.test_near import repeats_brute


@pytest.mark.parametrize("length", [2, 6, 7, 8, 15, 29])
@pytest.mark.parametrize("letters", [b"a", b"ab", b"\0a", bytes(range(256))])
def test_equal_windows_with_ends_and_zero_bytes(letters, length):
    rnd = random.Random(length)
    for _ in range(40):
        base = bytes(rnd.choices(letters, k=80))
        strings = [bytes(rnd.choices(letters, k=rnd.choice([0, 0, 9]))) + base[k : k + rnd.randint(0, 70)] for k in rnd.choices(range(60), k=rnd.randint(1, 8))]
        places, got = defaultdict(list), defaultdict(list)
        for i, s in enumerate(strings):
            for at in range(len(s) - length + 1):
                places[s[at : at + length]].append((i, at))
        for text, at, c in zip(*(v.tolist() for v in equal_windows(strings, length))):
            got[c].append((text, at))
        assert sorted(sorted(g) for g in got.values()) == sorted(p for p in places.values() if len(p) > 1)


def test_suffixes_told_apart_are_not_sorted_again(monkeypatch):
    rnd, sort, sorted_rows = random.Random(5), np.argsort, []
    shared = bytes(rnd.choices(range(97, 123), k=120))
    strings = [bytes(rnd.choices(range(97, 123), k=150)) for _ in range(200)] + [shared, shared]
    monkeypatch.setattr(np, "argsort", lambda a, *args, **kw: sorted_rows.append(len(a)) or sort(a, *args, **kw))
    text, at, _ = equal_windows(strings)
    assert sorted(zip(text.tolist(), at.tolist())) == [(k, j) for k in (200, 201) for j in range(21)]
    assert sum(sorted_rows) < 1.5 * sum(len(s) + 1 for s in strings)


def test_pieces_of_a_key_meet_across_files(spark):
    rnd = random.Random(8)
    some = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    shared = [some(110) for _ in range(60)]
    rows = [(k, some(rnd.randint(40, 90)) + "".join(rnd.choice(shared) + some(50) for _ in range(3))) for k in range(200)]
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")
    try:
        got = drop_repeats(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    finally:
        spark.conf.unset(merge)
    assert Counter(map(tuple, got)) == repeats_brute(rows)
