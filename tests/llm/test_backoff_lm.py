"""The backoff model against a plain one, its normalisation, and awkward tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import backoff_lm
from cloakframe.llm.backoff_lm import DISCOUNTED, KEPT, discounts, score_texts

_LOWER = {i: i + 32 for i in range(65, 91)}
END = ""


class Plain:
    def __init__(self, texts):
        words, pairs = Counter(), Counter()
        for t in texts:
            words.update(t)
            pairs.update(zip([END, *t], t))
        self.words, self.pairs, self.n = words, pairs, sum(words.values())
        self.d1, self.d2 = (discounts([sum(x == r for x in c.values()) for r in range(1, 7)]) for c in (words, pairs))
        self.contexts = defaultdict(dict)
        for (v, w), c in pairs.items():
            self.contexts[v][w] = c
        self.unknown = 1 - sum(self.first(w) for w in words)

    def first(self, w):
        c = self.words[w]
        return (self.d1[c] if c <= DISCOUNTED else 1) * c / (self.n + KEPT) if c else self.unknown

    def alpha(self, v):
        return (1 - sum(self.second(v, w) for w in self.contexts[v])) / (1 - sum(self.first(w) for w in self.contexts[v]))

    def second(self, v, w):
        if v not in self.contexts:
            return self.first(w)
        c = self.pairs[v, w]
        if not c:
            return self.alpha(v) * self.first(w)
        return (self.d2[c] if c <= DISCOUNTED else 1) * c / (sum(self.contexts[v].values()) + KEPT)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER)) + [END]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


HELD = "crc32(cast(cast(doc_id as string) as binary)) % 10 = 0"


def brute(rows):
    model = Plain([tokens(t) for i, t in rows if not held(i)])
    v = len(model.words)
    out = []
    for i, text in rows:
        ts = tokens(text)
        base = sum(math.log10((model.words[t] + 0.1) / (model.n + 0.1 * (v + 1))) for t in ts)
        score = sum(math.log10(model.second(a, b)) for a, b in zip([END, *ts], ts))
        out.append((i, held(i), len(ts), sum(model.words[t] > 0 for t in ts), model.n, base, score))
    return out


def corpus(seed, n):
    r = random.Random(seed)
    words = ["w%d" % int(r.paretovariate(0.7)) for _ in range(400)] + ["Über", "señor", "the", "The", "x,y"]
    return [(i, r.choice([" ", "\n", "\t "]).join(r.choice(words) for _ in range(r.randrange(0, 60)))) for i in range(n)]


def compared(found, rows):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6), round(r[6], 6))
    got, wanted = sorted((tuple(r) for r in found.collect()), key=key), sorted(brute(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in wanted]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in wanted], rtol=1e-9, atol=1e-9)


AWKWARD = [(1000, None), (1001, ""), (1002, " \n"), (None, "w1 w2"), (None, None), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (1003, "zz " * 3000 + "rare"), (1004, "only-here"), (1019, "never seen before")]


@pytest.mark.parametrize("frequent", [backoff_lm.FREQUENT, 20])
def test_as_plain_model(spark, frequent, monkeypatch):
    monkeypatch.setattr(backoff_lm, "RANGE_TOKENS", 500)
    rows = corpus(1, 250) + AWKWARD
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    compared(score_texts(docs, F.expr(HELD), frequent).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"), rows)


def test_sums_to_one():
    r = random.Random(2)
    texts = [[*("w%d" % int(r.paretovariate(0.6)) for _ in range(30)), END] for _ in range(40)]
    model = Plain(texts)
    words = [*model.words, "never seen"]
    for v in [*list(model.contexts)[:60], "never seen"]:
        assert math.isclose(sum(model.second(v, w) for w in words), 1, abs_tol=1e-9)


def test_discounts():
    assert (discounts([100, 40, 20, 12, 8, 5])[1:] < 1).all()
    for odd in ([0] * 6, [5, 0, 0, 0, 0, 0], [1, 9, 9, 9, 9, 9], [10, 10, 10, 10, 10, 10]):
        d = discounts(odd)
        assert d[0] == 0 and ((d[1:] > 0) & (d[1:] <= 1)).all()


def test_no_training_texts_and_no_rows(spark):
    rows = [(i, "a b") for i in range(200) if held(i)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in score_texts(docs, F.expr(HELD)).collect()} == {(0, 0, 0.0, 0.0)}
    assert score_texts(spark.createDataFrame([], "doc_id long, text string"), F.expr(HELD)).count() == 0


def test_clashing_columns(spark):
    rows = corpus(3, 30)
    docs = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "doc_id long, text string, shard int, held string, score double")
    compared(score_texts(docs, F.expr(HELD)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"), rows)


def test_held_out_texts_gain(spark):
    """Held-out texts that follow learned phrases score better than word by word."""
    r = random.Random(4)
    phrases = [" ".join("w%d" % r.randrange(300) for _ in range(8)) for _ in range(30)]
    rows = [(i, " ".join(r.choice(phrases) for _ in range(6))) for i in range(300)]
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.expr(HELD)).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.6 * got[1]
