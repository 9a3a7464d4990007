"""Ranked search against brute force, its bounds, and awkward tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cloakframe.llm import ranked_search
from cloakframe.llm.ranked_search import Best, Block, bounds, search_block

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return _TERM.findall((text or "").translate(_LOWER))


def brute(documents, items, k):
    docs = [(i, Counter(terms(t)), len(terms(t))) for i, t in documents]
    docs = [d for d in docs if d[2]]
    n, total = len(docs), sum(d[2] for d in docs)
    df = Counter(t for d in docs for t in d[1])
    out = []
    for item, text in items:
        scored = []
        for doc, tf, size in docs:
            m = 10 + 90 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(terms(text)) if tf[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(60)] + ["Über", "señor", "A1"]
    return [(i, " ".join(r.choice(words[: r.choice([5, 20, 63])]) for _ in range(r.randrange(1, 40)))) for i in range(n)]


@pytest.mark.parametrize("k", [1, 10])
def test_ranks_as_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_ROWS", 16)
    documents = corpus(1, 300) + [(400, None), (401, ""), (402, "!?"), (7, "w1 w2 w2"), (7, "w1 w2 w2"), (None, "w1 w2 w2"), (403, "w3 " * 30_000)]
    items = [(i, t) for i, (_, t) in enumerate(corpus(2, 25))] + [(90, None), (91, "..."), (None, "w1 w2"), (3, "w4 W4 w5"), (3, "w4 W4 w5"), (92, "nowhere")]
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    # the same in one pass and in several
    for size in (ranked_search.ITEM_BYTES, 1500):
        found = ranked_search.search(docs, asked, k, item_bytes=size)
        assert sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute(documents, items, k)


def test_extra_columns_and_other_ids(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id int, text string, item_id string, score long")
    asked = spark.createDataFrame([("q", "B", 1)], "item_id string, text string, rank int")
    assert [tuple(r) for r in ranked_search.search(docs, asked).collect()] == [tuple(r) for r in [("q", 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 800)))]]


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    asked, nothing = spark.createDataFrame([(1, "a")], "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert ranked_search.search(docs, nothing).count() == 0
    assert ranked_search.search(none, asked).count() == 0
    assert ranked_search.search(none, nothing).columns == ["item_id", "rank", "doc_id", "score"]


def test_pair_bounds_hold_and_are_tighter():
    r = random.Random(3)
    for _ in range(200):
        n = r.randrange(1, 8)
        docs = [[r.choice([0, 0, r.randrange(1, 50)]) for _ in range(n)] for _ in range(12)]
        most = [max(d[i] for d in docs) for i in range(n)]
        joint = [None] + [max((d[i - 1] + d[i] for d in docs if d[i - 1] and d[i]), default=None) for i in range(1, n)]
        got = bounds(most, joint)
        assert all(got[i] >= max(sum(d[:i]) for d in docs) for i in range(n + 1))
        assert all(got[i] <= sum(most[:i]) for i in range(n + 1))


def test_pair_bounds_skip_more():
    """Two light terms that never meet: only the joint entry shows that their lists can be left unread."""
    rng = np.random.default_rng(4)
    n = 4000
    light, other = np.arange(0, n, 2), np.arange(1, n, 2)
    heavy = np.arange(0, 40)
    lists = {0: (light, rng.integers(40, 60, len(light))), 1: (other, rng.integers(40, 60, len(other))), 2: (heavy, np.full(len(heavy), 70))}
    block = Block(np.arange(n), np.zeros(n, bool), lists, {t: int(x[1].max()) for t, x in lists.items()}, {2: 130})
    found = {}
    for paired in (False, True):
        best = Best(10)
        found[paired] = (search_block(block, [0, 1, 2], [-1, 0, 1], best, paired), best.ids.tolist(), best.scores.tolist())
    assert found[True][1:] == found[False][1:]
    assert found[True][0][0] < 0.1 * found[False][0][0]
