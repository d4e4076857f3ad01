"""Near duplicates, repeated substrings and benchmark copies against brute force."""
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from scrollwork.llm import decontaminate, substring_dedup
from scrollwork.llm.components import components
from scrollwork.llm.decontaminate import align, contaminated
from scrollwork.llm.near_dedup import near_duplicates, prob_jaccard, registers, weighted_set, word_lists
from scrollwork.llm.substring_dedup import drop_repeats, equal_windows
from scrollwork.llm.words import runs, words
from tests.llm.conftest import frame


def union(pairs, items):
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in items}


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)] + [(2000, 2000 + i) for i in range(500)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union(edges, {x for e in edges for x in e})
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_prob_jaccard(a, b):
    a, b = (dict(zip(s[0].tolist(), s[1].tolist())) for s in (a, b))
    total = 0.0
    for i in a.keys() & b.keys():
        total += 1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys())
    return total


def test_registers_estimate_similarity():
    rng = np.random.default_rng(5)
    for size in (1, 3, 40, 700):
        a = (np.unique(rng.integers(0, 2**62, size, dtype=np.uint64)), rng.integers(1, 5, size))
        cut = max(1, size * 4 // 5)
        b = (a[0][:cut], np.maximum(1, a[1][:cut] - rng.integers(0, 2, cut)))
        exact = prob_jaccard(a, b)
        assert exact == pytest.approx(plain_prob_jaccard(a, b))
        sig = registers([a, b, a], 2000)
        assert (sig[0] == sig[2]).all()
        assert abs((sig[0] == sig[1]).mean() - exact) < 0.05


def near_rows():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    texts = [[word() for _ in range(rnd.randint(30, 200))] for _ in range(30)]
    out = [" ".join(t) for t in texts]
    for t in texts[:12]:  # copies with ever more edits, about the limit too
        for edits in range(0, 14):
            u = list(t)
            for _ in range(edits):
                u[rnd.randrange(len(u))] = word()
            out.append(" ".join(u) + rnd.choice(["", ".", "!"]))
    ids = rnd.sample(range(10_000), len(out))
    return list(zip(ids, out))


def near_brute(rows):
    rows = [(i, t or "") for i, t in rows if i is not None]
    sets = [weighted_set(h) for _, lists in word_lists([t for _, t in rows]) for h in lists]
    pairs = [(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a) if prob_jaccard(sets[a], sets[b]) >= 0.8]
    return union(pairs, {i for i, _ in rows})


@pytest.mark.parametrize("which", ["odd", "edited"])
def test_near_duplicates(spark, odd_rows, which):
    rows = odd_rows if which == "odd" else near_rows()
    got = near_duplicates(frame(spark, rows)).collect()
    want = near_brute(rows)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows if i is not None)
    wrong = [r for r in got if r.group_id != want[r.doc_id]]
    assert not wrong
    assert all(r.kept == (r.doc_id == r.group_id) for r in got)


def test_near_duplicates_of_ids_with_several_texts(spark):
    rnd = random.Random(13)
    rows = near_rows()
    texts = [t for _, t in rows]
    rows += [(i, rnd.choice(texts)) for i, _ in rnd.sample(rows, 12)] + [(20_000 + k % 4, f"alone {k} " + " ".join(str(rnd.random()) for _ in range(9))) for k in range(12)]
    rows += [(5, texts[0]), (3, texts[0]), (5, "stands nowhere else at all"), (9, "stands nowhere else at all")]
    got = near_duplicates(frame(spark, rows)).collect()
    want = near_brute(rows)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert not [r for r in got if r.group_id != want[r.doc_id] or r.kept != (r.doc_id == r.group_id)]
    assert want[9] == want[3]


def test_near_empty(none):
    assert near_duplicates(none).count() == 0


def repeats_brute(rows):
    last = 1 << 63
    seen, order = {}, sorted({(last if i is None else i, t or "") for i, t in rows})
    for i, t in order:
        b = t.encode()
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            seen[w] = min(seen.get(w, (last + 1, 0)), (i, k))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 99):
            if seen[b[k : k + 100]] < (last if i is None else i, k):
                gone[k : k + 100] = True
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return Counter(out)


def repeat_rows():
    rnd = random.Random(4)
    some = lambda n: "".join(rnd.choice("abcé \n") for _ in range(n))
    shared = [some(n) for n in (60, 99, 100, 101, 140, 300)]
    rows = [(rnd.randrange(500), "".join(rnd.choice(shared) if rnd.random() < 0.5 else some(rnd.randint(1, 120)) for _ in range(rnd.randint(0, 6)))) for _ in range(120)]
    return rows + [(1000, "z" * 350), (1001, "ab" * 150), (1002, shared[5]), (1003, shared[5]), (None, shared[4] + some(30)), (1002, shared[5])]


@pytest.mark.parametrize("group", [1000, 1])
def test_repeats(spark, odd_rows, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    rows = repeat_rows() + [(i if i is None else i + 5000, t) for i, t in odd_rows]
    got = drop_repeats(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == repeats_brute(rows)


def test_repeats_empty(none):
    assert drop_repeats(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_interval_expansion(seed):
    rnd = random.Random(seed)
    strings = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(0, 40))) for _ in range(40)]
    want = defaultdict(set)
    for k, s in enumerate(strings):
        for at in range(len(s) - 5):
            want[s[at : at + 6]].add((k, at))
    got = defaultdict(set)
    for k, at, c in zip(*equal_windows(strings, 6)):
        got[c].add((int(k), int(at)))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def plain_align(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


def test_align():
    rng = np.random.default_rng(0)
    items = [rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64) for _ in range(60)]
    windows = [rng.integers(0, 4, rng.integers(1, 20)).astype(np.uint64) for _ in range(60)]
    assert align(items, windows)[0].tolist() == [plain_align(a, b) for a, b in zip(items, windows)]


def test_contaminated(spark, odd_rows, monkeypatch):
    rnd = random.Random(8)
    word = lambda: rnd.choice(["the", "of", "and"]) if rnd.random() < 0.4 else "".join(rnd.choice("abcdefghijkl") for _ in range(5))
    some = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(some(rnd.randint(10, 40)))) for k in range(30)] + [(90, "too short"), (91, None), (92, "the of and the of and the of and the of")]
    rows, want = list(odd_rows), set()
    for k in range(300):
        body = some(rnd.randint(5, 200))
        if k % 3 == 0:
            i, t = items[k % 30]
            copy = t.split()
            for _ in range(len(copy) // 8):
                at = rnd.randrange(len(copy))
                copy[at : at + 1] = rnd.choice([[word()], [], [copy[at], word()]])
            at = rnd.randrange(len(body))
            body[at:at] = [w.upper() for w in copy] if k % 2 else copy
            want.add((3000 + k, i))
        rows.append((3000 + k, " ".join(body)))
    table = spark.createDataFrame(items, "item_id long, text string")
    for block in (4 << 20, 500):  # the second: many blocks of items
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = contaminated(frame(spark, rows), table)
        pairs = {(r.doc_id, r.item_id) for r in got.collect()}
        assert want <= pairs
        assert {p for p in pairs - want if p[1] != 92} == set()
    assert contaminated(frame(spark, []), table).count() == 0
    assert contaminated(frame(spark, rows), table.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [5, 50, 1000])
def test_contaminated_by_many_equal_edits(spark, copies):
    rnd = random.Random(copies)
    some = lambda n: ["".join(rnd.choice("abcdefghijkl") for _ in range(6)) for _ in range(n)]
    edited, short = some(30), some(30)
    changed = [f"other{k}" if k % 10 == 5 else w for k, w in enumerate(edited)]
    rows = [(k, " ".join(some(4) + (changed if k % 2 else short[:20]) + some(4))) for k in range(2 * copies)] + [(10**6, " ".join(some(60)))]
    items = spark.createDataFrame([(1, " ".join(edited)), (2, " ".join(short))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(frame(spark, rows), items).collect()}
    assert got == pytest.approx({(k, 1 if k % 2 else 2): 0.85 if k % 2 else 20 / 30 for k in range(2 * copies)})


def test_windows_hold_every_alignment():
    rng = np.random.default_rng(6)
    text = lambda h: " ".join(f"w{x}" for x in h)
    for _ in range(40):
        item = rng.integers(0, 12, rng.integers(8, 30))
        copy = [x for w in item for x in ([w] if rng.random() < 0.6 else [[], [99], [w, 98, 97]][rng.integers(0, 3)])]
        doc = np.concatenate([rng.integers(0, 12, rng.integers(0, 60)), copy, rng.integers(0, 12, rng.integers(0, 60))]).astype(int)
        block = decontaminate.make_block([(1, text(item))])
        (h, whose), a = words([text(doc).encode()]), block.tokens
        found = decontaminate.windows_of(block, h, whose, np.array([0, len(h)]), 0.5)
        best = max([int(align([a], [h[b:e]])[0][0]) for _, _, b, e in zip(*found)], default=0)
        whole = plain_align(a.tolist(), h.tolist())
        triple = set(runs(a, 3).tolist()) & set(runs(h, 3).tolist())
        assert best == whole or whole < len(a) or not triple or best >= len(a)


def test_contaminated_by_short_and_unspaced_items(spark):
    rnd = random.Random(9)
    han = "".join(chr(0x4E00 + rnd.randrange(2000)) for _ in range(30))
    thai = "".join(chr(0x0E01 + rnd.randrange(40)) for _ in range(24))
    kana = "\u3072\u3089\u304c\u306a"
    items = [(1, "What is the capital of Peru?"), (2, han), (3, thai), (4, kana), (5, "Peru"), (6, "?!"), (7, "peru"), (8, "")]
    rows = [
        (1, "x what is THE capital, of Peru y"), (2, "what is the capital of old peru"), (3, "peruvian"), (4, "\u4f60" + han + "\u597d"), (5, han[:14] + "\u3002" + han[15:]),
        (6, han[:7]), (7, "abc" + thai[:20] + "def"), (8, f"\u3042{kana}\u3044"), (9, kana[:3]), (10, None), (11, "of peru"), (12, "what is the capital of"),
    ]
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    peru = {(d, i): 1.0 for d in (1, 2, 11) for i in (5, 7)}
    assert got == pytest.approx(peru | {(1, 1): 1.0, (4, 2): 1.0, (5, 2): 57 / 60, (7, 3): 20 / 24, (8, 4): 1.0})


@pytest.mark.parametrize("block", [4 << 20, 1])
def test_contaminated_by_items_with_one_id(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rnd = random.Random(10)
    some = lambda n: " ".join("".join(rnd.choice("abcdefghijkl") for _ in range(6)) for _ in range(n))
    texts = [some(12) for _ in range(6)] + ["brief text"]
    items = [(1, None), (1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[2]), (2, None), (None, texts[3]), (None, texts[4]), (None, None), (3, texts[1]), (3, texts[6])]
    rows = [(k, f"{some(3)} {t} {some(3)}") for k, t in enumerate(texts)] + [(7, f"{texts[0]} {some(2)} {texts[1]} {texts[1][:-8]}")]
    got = [(r.doc_id, r.item_id, r.score) for r in contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert Counter(got) == Counter([(0, 1, 1.0), (1, 1, 1.0), (1, 3, 1.0), (2, 2, 1.0), (3, None, 1.0), (4, None, 1.0), (6, 3, 1.0), (7, 1, 1.0), (7, 3, 1.0)])
