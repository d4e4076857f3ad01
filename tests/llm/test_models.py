"""Language models, language identification and the quality classifier: brute force and held-out accuracy."""
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrollwork.llm import language_id, lm_score, quality
from scrollwork.llm.common import table
from scrollwork.llm.words import ALNUM, PRINTED, runs, words
from tests.llm.conftest import frame

SF = "/root/testdata/sf0.01"


def test_words():
    texts = ["one two  three", "", "two", "a.b c", " x "]
    for inside, split in ((PRINTED, str.split), (ALNUM, lambda t: t.replace(".", " ").split())):
        h, owner = words([t.encode() for t in texts], inside)
        flat = [(k, w) for k, t in enumerate(texts) for w in split(t)]
        assert owner.tolist() == [k for k, _ in flat]
        names = defaultdict(set)
        for x, (_, w) in zip(h.tolist(), flat):
            names[w].add(x)
        assert all(len(v) == 1 for v in names.values()) and len({min(v) for v in names.values()}) == len(names)
    assert len(runs(h, 3)) == len(h) - 2


def spelled(text):
    lower = (text or "").encode().translate(bytes(ord(chr(b).lower()) if 65 <= b <= 90 else b for b in range(256)))
    tokens = lower.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ")
    tokens = [t for t in tokens if t]
    return tokens, b"\n" * 5 + b"".join(t + b" " for t in tokens) + b"\n"


class Plain:
    """Interpolated Kneser-Ney by dictionaries."""

    def __init__(self, sequences):
        self.level = {6: Counter(s[k : k + 6] for s in sequences for k in range(len(s) - 5))}
        for n in range(5, 0, -1):
            self.level[n] = Counter(g[1:] for g in self.level[n + 1])
        self.context, self.discount = {}, {}
        for n, grams in self.level.items():
            ones, twos = sum(v == 1 for v in grams.values()), sum(v == 2 for v in grams.values())
            self.discount[n] = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            self.context[n] = defaultdict(lambda: [0, 0])
            for g, v in grams.items():
                self.context[n][g[:-1]][0] += v
                self.context[n][g[:-1]][1] += 1

    def p(self, gram):
        n = len(gram)
        rest = 1 / 257 if n == 1 else self.p(gram[1:])
        if gram[:-1] not in self.context[n]:
            return rest
        total, kinds = self.context[n][gram[:-1]]
        v = self.level[n].get(gram, 0)
        d = self.discount[n]
        return max(v - d, 0) / total + d * kinds / total * rest if v else d * kinds / total * rest


@pytest.mark.parametrize("learned", ["some", "nothing"])
def test_lm_scores(spark, odd, odd_rows, learned):
    learn = F.coalesce(F.col("doc_id") % 3 != 1, F.lit(False)) if learned == "some" else F.lit(False)
    got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 5)) for r in lm_score.lm_scores(odd, learn).collect())
    train = [spelled(t) for i, t in odd_rows if learned == "some" and i is not None and i % 3 != 1]
    counts = Counter(w for tokens, _ in train for w in tokens)
    n = sum(counts.values()) + len(train)
    v = len(counts) + bool(train)
    model = Plain([s for _, s in train])
    known = {}
    want = []
    for i, t in odd_rows:
        tokens, s = spelled(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens) + math.log10((len(train) + 1) / (n + v + 1))
        if s not in known:
            memo = {}
            known[s] = sum(memo.setdefault(g, math.log10(model.p(g))) for g in (s[k : k + 6] for k in range(len(s) - 5)))
        want.append((i, len(tokens) + 1, sum(counts[w] > 0 for w in tokens) + bool(train), n, base, known[s]))
    for w in want:
        near = [g for g in got if g[:4] == w[:4] and abs(g[4] - w[4]) < 1e-5 + 1e-9 * abs(w[4]) and abs(g[5] - w[5]) < 1e-3 + 1e-7 * abs(w[5])]
        assert near, (w, [g for g in got if g[0] == w[0]])
    assert sum(got.values()) == len(want)


def test_lm_empty(none):
    assert lm_score.lm_scores(none, F.lit(True)).count() == 0


def test_automaton_is_a_distribution(spark):
    rows = [(i, t) for i, t in enumerate(["the cat sat", "the cat", "a mat", ""])]
    model = lm_score.build(lm_score.block_keys(lm_score.with_blocks(frame(spark, rows), F.lit(True), "doc_id", "text"), (6,)).groupBy("key").agg(F.sum("n").alias("n"))).toPandas()
    machine = lm_score.Automaton(*(model[c].to_numpy() for c in ("kind", "key", "logp", "bow")))
    for state in range(len(machine.code)):
        if not np.isnan(machine.bow[state]):
            _, cost = machine.step(np.full(256, state, np.int32), np.arange(256))
            assert (10**cost).sum() == pytest.approx(1, abs=0.01)


def test_language_id(spark, odd, odd_rows, none):
    docs = table(spark, SF, "documents")
    model = language_id.fit(language_id.training_rows(docs))
    out = language_id.classify(docs, model, keep=["lang"]).where(language_id.fold(F.col("doc_id"), 4) == 2).toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.98
    assert out["rejected"].mean() < 0.01
    assert out["score"].between(0, 1).all()
    again = language_id.classify(odd, model).toPandas()
    blank = sum(not any(c.isalpha() for c in t or "") for _, t in odd_rows)
    assert (again["lang_pred"] == "und").sum() == blank and len(again) == len(odd_rows)
    assert language_id.accepted(odd, model).columns == odd.columns
    junk = frame(spark, [(1, "щщъ" * 400), (2, "qzxjkv wqxzj " * 80), (3, docs.where("lang = 'de'").first().text)])
    assert [r.doc_id for r in language_id.accepted(junk, model).collect()] == [3]
    assert language_id.classify(none, model).count() == 0
    assert language_id.classify(odd, None).where("lang_pred <> 'und'").count() == 0
    assert language_id.fit(language_id.training_rows(none.withColumn("lang", F.lit("x")))) is None


def test_every_language_has_its_share(spark):
    rnd = random.Random(12)
    small = lambda c: " ".join("".join(rnd.choice(c) for _ in range(4)) for _ in range(40))
    big = ["".join(chr(0x4E00 + rnd.randrange(300)) for _ in range(400)) for _ in range(60)] * 5
    rows = [(k, t, "big") for k, t in enumerate(big)] + [(1000 + k, small("rstu"), "zz") for k in range(3)] + [(2000 + k, small("abcd"), "aa") for k in range(25)]
    # one document, hashed to the part that calibrates
    h = F.pmod(F.xxhash64(F.lit("lang-sample"), "id"), F.lit(1 << 30))
    last = spark.range(3000, 4000).where(h > 0.9 * (1 << 30)).first().id
    rows.append((last, small("wxyz"), "one"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, max_cells=4 * 2 * 6000)
    assert model.langs == ["aa", "big", "one", "zz"]
    out = {r.doc_id: r.lang_pred for r in language_id.classify(docs, model).collect()}
    assert all(out[i] == lang for i, _, lang in rows)
    assert "one" not in model.limits and "zz" not in model.limits
    assert language_id.shares({"a": 10, "b": 5000, "c": 90_000, "d": 70_000}, 45_010) == {"a": 10, "b": 5000, "d": 20_000, "c": 20_000}
    assert set(language_id.shares({str(k): 5000 for k in range(50)}, 1000).values()) == {language_id.LEAST_GRAMS}


def test_language_model_sums_to_one(spark):
    docs = table(spark, SF, "documents").limit(60)
    model = language_id.fit(language_id.training_rows(docs))
    for text in ("the ", " qu", "xyz"):
        letters = sorted({chr(c) for c in range(97, 123)} | {" ", "é", "ñ", "è", "ä", "ö", "ü", "ß", "ê", "í", "ó", "ù", "à", "â", "ç"})
        points = [np.frombuffer((text[-3:] + c).encode("utf-32-le"), np.uint32) for c in letters]
        p = np.exp(np.concatenate([model.position_scores(x) for x in points])).sum(axis=0)
        assert (p <= 1.2).all() and (p > 0.9).all()  # letters in no model share one floor, which may add a little


def test_quality(spark, odd, odd_rows, none):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    weights, bias = quality.fit(quality.labelled_rows(docs, labels))
    out = quality.classify(docs, weights, bias).where(quality.fold(F.col("doc_id"), 3) == 1).join(labels, "doc_id").toPandas()
    assert ((out["score"] >= 0.5) == (out["quality"] == 1)).mean() > 0.97
    again = quality.classify(odd, weights, bias).toPandas()
    assert len(again) == len(odd_rows) and again["score"].between(0, 1).all()
    assert quality.classify(none, weights, bias).count() == 0
    one = quality.labelled_rows(docs, labels.where("quality = 1"))
    assert quality.classify(odd, *quality.fit(one)).where("score < 0.5").count() == 0
    assert quality.fit(one.limit(0))[1] == 0.0
