"""Phrases against plain counting."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from scrollwork.llm import collocations as co


def brute(rows, least, top, percent=80):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for k in range(1, 5):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {s for p in found for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * f[p] >= percent * f[s := p[i : i + k]]}
        scored = []
        for p in found - inside:
            score, k = min((2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n, p.decode(), -a, l, r, totals[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "lang string, text string, word string, n int, a int")


def texts(seed, n=400):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["The", "the", "of", "É", "é", "naïve", "|", "'s", " ", "\x1c"]
    rows = []
    for _ in range(n):
        words = [vocabulary[min(len(vocabulary) - 1, int(rnd.expovariate(0.08)))] for _ in range(rnd.randint(0, 60))]
        if rnd.random() < 0.5:
            words[3:3] = ["In", "no", "case", "at", "all"]
        rows.append((rnd.choice(["en", "en", "fr", None, "und"]), "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n"]) for w in words)))
    return rows + [("en", None), (None, None), ("de", ""), ("de", " . "), ("de", "one"), *[("en", "A third of all rows is this very text of five.")] * 200]


@pytest.mark.parametrize("least, top, most, per_bucket", [(30, 2000, 1 << 20, 1 << 20), (3, 50, 40, 100), (2, 2000, 1, 37)])
def test_against_counting(spark, least, top, most, per_bucket):
    rows = texts(least)
    got = co.collocations(frame(spark, rows), least=least, top=top, most=most, per_bucket=per_bucket).collect()
    want = brute(rows, least, top)
    assert sorted(map(tuple, got)) == want and len(want) > 15


def test_long_texts(spark, monkeypatch):
    monkeypatch.setattr(co, "SLICE", 1000)  # for this process; tasks read the module anew, so the slices are tested below
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [("en", long), ("en", long.replace("w976", "w976.")), ("en", "x" * 3_000_000), ("en", "a b c. " * 30_000)]
    got = co.collocations(frame(spark, rows), least=30, top=100).collect()
    assert sorted(map(tuple, got)) == brute(rows, 30, 100)


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_slices_cut_no_piece(size):
    import pyarrow as pa

    rnd = random.Random(size)
    rows = ["".join(rnd.choice(["a", "bc", " ", ". ", "é", "\n"]) for _ in range(rnd.randint(0, 90))) for _ in range(40)] + ["no end " * 9_000, "", "x."]
    array = pa.array(["skipped", *rows]).slice(1)
    parts = list(co._slices(array, size))
    assert b"".join(p.tobytes() for p, _ in parts) == "".join(rows).encode()

    def seen(cut):
        found = Counter()
        for raw, starts in cut:
            names, place, follows = co.words_of(raw, starts)
            names = names.to_pylist()
            found.update((names[a], names[b]) for a, b, f in zip(place, place[1:], follows) if f)
            found.update((names[a],) for a in place)
        return found

    assert seen(parts) == seen((np.frombuffer(t.encode(), np.uint8), np.array([0])) for t in rows if t)


@pytest.mark.parametrize("seed", range(8))
def test_multikey_quicksort(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 3000))
    columns = rng.zipf(1.5, (4, n)).clip(1, 1 << int(rng.integers(1, 17))).astype(np.int64)
    columns[:, rng.random(n) < 0.2] = 1
    for k in (3, 2):
        columns[k:, rng.random(n) < 0.3] = 0
    weights = rng.integers(1, 5, n)
    for least in (1, 6, 40):
        want = Counter()
        for c, w in zip(columns.T.tolist(), weights.tolist()):
            for k in range(2, 5):
                if c[k - 1]:
                    want[tuple(c[:k])] += w
        length, example, count = co.phrases(columns, weights, least)
        got = [(tuple(columns[:k, e]), c) for k, e, c in zip(length, example, count)]
        assert len(got) == len({p for p, _ in got}) and dict(got) == {p: c for p, c in want.items() if c >= least}


def test_combined_windows():
    rng = np.random.default_rng(1)
    small = [rng.integers(0, 4, 900).astype(np.int64) for _ in range(4)]
    for shift in (0, 1 << 17):  # beyond 16 bits, too
        columns, counts = co.combined([c + shift for c in small])
        assert dict(zip(zip(*(c.tolist() for c in columns)), counts.tolist())) == Counter(zip(*((c + shift).tolist() for c in small)))


def test_scores_are_exact(spark):
    df = spark.sql("SELECT cast(9000000000000000 as bigint) AS a, cast(9000000000000001 as bigint) AS l, cast(9000000000000002 as bigint) AS r")
    up = df.select((co._exact("a") * 2_000_000).alias("up"), (co._exact("l") + co._exact("r")).alias("down")).selectExpr("up div down")
    assert up.first()[0] == 2_000_000 * 9000000000000000 // 18000000000000003


def test_empty(spark):
    assert co.collocations(frame(spark, [])).count() == 0
