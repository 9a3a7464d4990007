"""Phrase collocations against brute force, the transducers, and awkward tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cloakframe.llm import phrase_mining
from cloakframe.llm.phrase_mining import CountTransducer, collocations

_LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, least, percent, top):
    n, counts = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(_LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    around[p[i : i + size]] = max(around[p[i : i + size]], a)
        rows = []
        for p, a in found.items():
            if around[p] and 100 * around[p] >= percent * a:
                continue
            score, _, l, r = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def corpus(seed, n):
    r = random.Random(seed)
    words = ["a", "B", "c", "Über", "der", "d-e", "x\x01", "x", "señor", "日本", "\x00z", "zz"]
    fixed = ["new york city", "a b c der x", "über der x\x01 x", "zz zz zz"]
    rows = []
    for _ in range(n):
        parts = [r.choice(fixed) if r.random() < 0.4 else " ".join(r.choice(words) for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 12))]
        rows.append((r.choice(["en", "de", None]), "".join(p + r.choice([" ", "\t", ". ", ",", "\n", "  "]) for p in parts)))
    return rows


AWKWARD = [("en", None), ("en", ""), ("en", ".,; "), (None, "a b"), ("en", "q"), ("fr", "rare words only"), ("de", "zz " * 20_000), ("de", "A b C der X. " * 50)] + [("en", "same row, same row")] * 30


@pytest.mark.parametrize("least, percent, top", [(12, 100, 2000), (5, 60, 7), (1, 100, 10_000)])
def test_as_brute_force(spark, least, percent, top, monkeypatch):
    rows = corpus(1, 150) + AWKWARD
    monkeypatch.setattr(phrase_mining, "RANGE_PHRASES", 40)
    monkeypatch.setattr(phrase_mining, "RANGE_ASKS", 30)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    found = collocations(docs, least, percent, top)
    assert found.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, least, percent, top)


def test_full_buckets_change_nothing(spark, monkeypatch):
    """On a huge corpus every bucket is full."""
    rows = corpus(2, 60)
    docs = spark.createDataFrame(rows, "lang string, text string")
    cells = (phrase_mining._WORD_CELLS + phrase_mining._PAIR_CELLS) // 8
    monkeypatch.setattr(phrase_mining, "frequent_cells", lambda docs, least, most: (np.full(cells, 255, np.uint8), np.zeros(cells, np.uint8)))
    assert sorted(tuple(r) for r in collocations(docs, 9, 100, 50).collect()) == brute(rows, 9, 100, 50)


@pytest.mark.parametrize("hot_pair", [1, 40])
def test_frequent_pairs_are_cut(spark, hot_pair):
    rows = corpus(3, 120) + AWKWARD
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    counts, _ = phrase_mining.phrase_counts(docs, 7, hot_pair)
    wanted, _ = phrase_mining.phrase_counts(docs, 7, 10**9)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, wanted.collect()))


def test_empty_and_clashing_columns(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    docs = spark.createDataFrame([("en", "a b c", 1, "n", "f")] * 3, "lang string, text string, n int, phrase string, f string")
    assert [r["phrase"] for r in collocations(docs, 3).collect()] == ["a b c"]


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "a", 1, 9 * 10**15), ("en", "b", 1, 8 * 10**15), ("en", "a b", 2, 7 * 10**15)], "lang string, phrase string, size int, f long")
    totals = spark.createDataFrame([("en", 6 * 10**16)], "lang string, n long")
    whole = phrase_mining.phrase_counts
    try:
        phrase_mining.phrase_counts = lambda documents, least: (counts, totals)
        got = collocations(counts, 1).collect()
    finally:
        phrase_mining.phrase_counts = whole
    assert [(r["l"], r["r"], r["score"]) for r in got] == [(9 * 10**15, 8 * 10**15, 1000 * 7 * 10**15 * 6 * 10**16 // (72 * 10**30))]


def test_transducer_is_minimal_and_exact():
    r = random.Random(5)
    phrases = sorted({tuple(r.choice([b"a", b"b", b"c", b"d"]) for _ in range(r.randrange(1, 6))) for _ in range(400)})
    counts = [r.randrange(1, 1000) for _ in phrases]
    made = CountTransducer.from_bytes(CountTransducer.build(phrases, counts).to_bytes())
    asks = sorted({*phrases, *(p + (b"a",) for p in phrases), (b"q",), (b"a", b"q", b"a")})
    held = dict(zip(phrases, counts))
    assert made.compose(asks).tolist() == [held.get(a, 0) for a in asks]
    marks = [(final, *((w, t) for w, (t, _) in arcs.items()), *((x for _, x in arcs.values()))) for final, arcs in made.states]
    assert len(set(marks[:-1])) == len(marks) - 1
    tree = {p[:i] for p in phrases for i in range(len(p) + 1)}
    assert len(made.states) < len(tree) / 2
