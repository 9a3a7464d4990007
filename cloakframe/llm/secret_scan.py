"""Secret scan: fixed patterns, and a character convolutional network over every candidate.

The three base patterns find what they describe, always.  Candidates of the network
are all other runs of key characters, from 16 characters or, after a key word, from 8, and
what base findings leave of such a run, of any length; it reads the candidate together
with ``AROUND`` characters before and after it.  Longer candidates are read in
overlapping windows, of which the best counts.

The network learns from labelled findings: all base findings of all documents, equal ones
in equal surroundings once, a generated look-alike in the place of each, and a generated
table of common key formats and look-alikes.  No candidate of the corpus counts as a
look-alike, since nobody has labelled it.  It is trained in numpy, on the driver on the
generated table, and then in ``ROUNDS`` rounds on the corpus: its windows are dealt by hash
to shards of about ``SHARD``, every shard trains a copy of the network on all its windows
and the generated table, and the mean of the copies goes into the next round.  A part
of the findings is held out: a logistic calibration is fitted to their scores, and the
threshold is the highest one that keeps ``LEAST_RECALL`` of the held-out secrets, however
low it is; generated findings weigh as much as those of the corpus there, and no less than
one each.  The labels of documents are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.operators.numbering import stash

from . import common

# Base patterns and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run that is shorter fails
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex")
MODEL = "model"
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_KEY_WORD = r"pass(?:word|wd|phrase)?|pwd|secret|token|key|auth(?:orization)?|credentials?"
# Group 2 is a run after a key word.
KEYED = re.compile(
    rf"""(?:(?:{_KEY_WORD})["']?\x20*[:=]\x20*|\b(?:{_KEY_WORD}|bearer|basic)\x20+|(?<!\S)-p\x20+)(["']?)([A-Za-z0-9+/_.=-]{{7,}}[A-Za-z0-9+/_=-])""",
    re.IGNORECASE | re.ASCII,
)

AROUND, WINDOW = 24, 96
GENERATED, HELD_OUT, LEAST_RECALL = 4000, 0.25, 0.95
# Windows of a shard, rounds over all shards, least steps of a shard in a round, rate of the first round.
SHARD, ROUNDS, STEPS, RATE = 4096, 3, 100, 0.004
BATCH = 128
# Scores of the corpus are counted in steps of 1 / _FINE, weights are summed in steps of 1 / _EXACT.
_FINE, _EXACT = 256, 1 << 24
_WIDTHS, _FILTERS, _EMBED = (3, 5), 16, 8

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Base findings by start, then kind; code points, end exclusive."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Runs of key characters, and runs after a key word, without what base findings cover."""
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    runs += [m.span(2) for m in KEYED.finditer(text)]
    found: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if found and start < found[-1][1]:
            found[-1] = (found[-1][0], max(end, found[-1][1]))
        else:
            found.append((start, end))
    if not base:
        return found
    left, k = [], 0
    covered: list[list[int]] = []
    for s, _, e in base:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(e, covered[-1][1])
        else:
            covered.append([s, e])
    for start, end in found:
        while k < len(covered) and covered[k][1] <= start:
            k += 1
        at = k
        while at < len(covered) and covered[at][0] < end:
            if covered[at][0] > start:
                left.append((start, covered[at][0]))
            start = covered[at][1]
            at += 1
        if start < end:
            left.append((start, end))
    return left


def touching(base: list[Span]) -> list[list[Span]]:
    """Base findings in groups that overlap or touch."""
    groups: list[list[Span]] = []
    reach = -1
    for span in base:
        if span[0] > reach:
            groups.append([])
        groups[-1].append(span)
        reach = max(reach, span[2])
    return groups


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Codes of a candidate and what surrounds it, in windows of ``WINDOW`` characters; 0 is padding."""
    inner = WINDOW - 2 * AROUND
    found = []
    for at in range(start, max(start + 1, end - inner // 2), inner // 2) if end - start > inner else (start,):
        piece = text[max(0, at - AROUND) : at].rjust(AROUND, "\0") + text[at : min(end, at + inner)]
        piece += text[min(end, at + inner) :][:AROUND] if at + inner >= end else text[at + inner : at + inner + AROUND]
        codes = np.zeros(WINDOW, np.uint8)
        raw = [min(ord(c), 127) for c in piece[:WINDOW]]
        codes[: len(raw)] = raw
        found.append(codes)
    return found


class CharacterNetwork:
    """Embedding, convolutions of two widths, maximum over positions, logistic output."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (128, _EMBED))
        self.filters = [rng.normal(0, 0.3, (w * _EMBED, _FILTERS)) for w in _WIDTHS]
        self.shift = [np.zeros(_FILTERS) for _ in _WIDTHS]
        self.out, self.bias = rng.normal(0, 0.3, _FILTERS * len(_WIDTHS)), np.zeros(1)
        self.slope, self.offset, self.threshold = 1.0, 0.0, 0.5
        self.recall, self.precision = 0.0, 0.0  # of the held-out findings

    def _forward(self, codes: np.ndarray):
        letters = self.embed[codes]
        pooled, where, patches = [], [], []
        for width, weights, shift in zip(_WIDTHS, self.filters, self.shift):
            patch = np.lib.stride_tricks.sliding_window_view(letters, width, axis=1).transpose(0, 1, 3, 2)
            patch = patch.reshape(len(codes), -1, width * _EMBED)
            active = patch @ weights + shift
            at = active.argmax(1)
            pooled.append(np.maximum(0, np.take_along_axis(active, at[:, None], 1)[:, 0]))
            where.append(at)
            patches.append(patch)
        pooled = np.concatenate(pooled, 1)
        return pooled @ self.out + self.bias[0], pooled, where, patches

    def logits(self, codes: np.ndarray) -> np.ndarray:
        parts = [self._forward(codes[i : i + 512])[0] for i in range(0, len(codes), 512)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(codes) + self.offset, -50, 50)))

    def _weights(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.shift, self.out, self.bias]

    def weights(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self._weights()])

    def with_weights(self, flat: np.ndarray) -> CharacterNetwork:
        network, at = CharacterNetwork(), 0
        for v in network._weights():
            v[...] = flat[at : at + v.size].reshape(v.shape)
            at += v.size
        return network

    def fit(self, codes: np.ndarray, wanted: np.ndarray, steps: int = 600, rate: float = 0.01, seed: int = 9) -> CharacterNetwork:
        """Steps on windows drawn at random, half of them secrets."""
        rng = np.random.default_rng(seed)
        classes = [np.flatnonzero(wanted == c) for c in (0, 1)]
        return self._descend(codes, wanted, (np.concatenate([rng.choice(c, BATCH // 2) for c in classes]) for _ in range(steps)), rate)

    def fit_all(self, codes: np.ndarray, wanted: np.ndarray, steps: int = STEPS, rate: float = RATE, seed: int = 9) -> CharacterNetwork:
        """At least ``steps`` steps, as many as it takes to draw every window; half of each batch are secrets."""
        rng = np.random.default_rng(seed)
        classes = [np.flatnonzero(wanted == c) for c in (0, 1)]
        steps = max(steps, *(-(-len(c) // (BATCH // 2)) for c in classes))
        n = steps * (BATCH // 2)
        # Whole passes: no window comes again before all others have come.
        drawn = [np.concatenate([rng.permutation(c) for _ in range(-(-n // len(c)))])[:n].reshape(steps, -1) for c in classes]
        return self._descend(codes, wanted, np.concatenate(drawn, 1), rate)

    def _descend(self, codes: np.ndarray, wanted: np.ndarray, batches: Iterable[np.ndarray], rate: float) -> CharacterNetwork:
        values = self._weights()
        mean, spread = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
        for step, at in enumerate(batches, 1):
            scores, pooled, where, patches = self._forward(codes[at])
            error = (1 / (1 + np.exp(-np.clip(scores, -50, 50))) - wanted[at]) / len(at)
            d_pooled = error[:, None] * self.out * (pooled > 0)
            d_embed, d_filters, d_shift = np.zeros_like(self.embed), [], []
            for k, (width, weights) in enumerate(zip(_WIDTHS, self.filters)):
                d = d_pooled[:, k * _FILTERS : (k + 1) * _FILTERS]
                best = np.take_along_axis(patches[k], where[k][:, :, None], 1)  # (batch, filters, patch)
                d_filters.append(np.einsum("bf,bfp->pf", d, best))
                d_shift.append(d.sum(0))
                d_patch = (d[:, :, None] * weights.T[None]).reshape(len(at), _FILTERS, width, _EMBED)
                for w in range(width):
                    np.add.at(d_embed, np.take_along_axis(codes[at], where[k] + w, 1), d_patch[:, :, w])
            grads = [d_embed, *d_filters, *d_shift, pooled.T @ error, np.array([error.sum()])]
            for v, g, m, s in zip(values, grads, mean, spread):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        return self

    def calibrate(self, codes: np.ndarray, wanted: np.ndarray, least_recall: float = LEAST_RECALL, of: np.ndarray | None = None) -> CharacterNetwork:
        """``settle`` on held-out findings; ``of`` numbers the finding of each window, ascending, without it each is a finding."""
        return self.settle(*self.scored(codes, wanted, of), least_recall=least_recall)

    def scored(self, codes: np.ndarray, wanted: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Score and class of each finding: the best of its windows counts."""
        scores = self.logits(codes)
        if of is not None and len(of):
            first = np.flatnonzero(np.diff(of, prepend=of[0] - 1))
            scores, wanted = np.maximum.reduceat(scores, first), wanted[first]
        return scores, wanted

    def settle(self, scores: np.ndarray, wanted: np.ndarray, weight: np.ndarray | None = None, least_recall: float = LEAST_RECALL) -> CharacterNetwork:
        """Logistic calibration on the scores of held-out findings, and the highest threshold that keeps the recall."""
        weight = np.ones(len(scores)) if weight is None else weight
        slope, offset = 1.0, 0.0
        mean = lambda values: float(np.average(values, weights=weight))
        size = max(1.0, mean(scores**2) ** 0.5)
        for _ in range(300):
            error = 1 / (1 + np.exp(-np.clip(slope * scores + offset, -50, 50))) - wanted
            slope -= 0.05 * mean(error * scores) / size
            offset -= 0.05 * mean(error)
        # A slope that is not positive would turn the order of the scores round.
        self.slope, self.offset = max(slope, 1e-3), offset
        found = 1 / (1 + np.exp(-np.clip(self.slope * scores + self.offset, -50, 50)))
        secret = np.flatnonzero(wanted == 1)
        if len(secret):
            secret = secret[np.argsort(found[secret], kind="stable")]
            below = np.cumsum(weight[secret]) - weight[secret]
            self.threshold = float(found[secret[np.flatnonzero(below <= (1 - least_recall) * weight[secret].sum() + 1e-9)[-1]]])
            kept = found >= self.threshold
            self.recall = float(np.average(kept[secret], weights=weight[secret]))
            self.precision = float(np.average(wanted[kept], weights=weight[kept]))
        return self


_HEXA, _UPPER, _DIGITS = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789"
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_MIXED = _LETTERS + _LETTERS.upper()
# Generated findings: prefix, alphabet, lengths, suffix.
_SECRETS = [
    ("", _HEXA, (32, 40, 64), ""), ("", _BASE64, (32, 40, 44, 64), ""), ("", _BASE64, (22, 43), "="), ("AKIA", _UPPER, (16,), ""),
    ("ghp_", _BASE64[:62], (36,), ""), ("sk-", _BASE64[:62], (32, 48), ""), ("xoxb-", _BASE64[:62], (24, 36), ""),
    ("eyJ", _BASE64[:62], (40, 60), ""), ("AIza", _BASE64[:62], (35,), ""), ("", _BASE64[:62], (20, 24, 32), ""),
    ("", _MIXED, (20, 24, 32, 40), ""),
]
# Bodies that only count after a key word.
_SHORT = [("", _BASE64[:62], (8, 10, 12, 15), ""), ("", _LETTERS + _DIGITS, (10, 12, 15), ""), ("", _MIXED, (10, 12, 15), "")]
_KEY_FRONT = ("pwd=", "pwd: ", "Bearer ", "auth=", "key: ", 'key = "', "pass=", "passphrase: ", "credential ", "token ", "secret: ", "-p ")
# A base finding and the rest of its run.
_HEADS = [("AKIA", _UPPER, 16), ("", _HEXA, 32), ("token=", _BASE64[:62], 12)]
_ODD = "éèüßñóÄÖ.,;!?()$%&*#|:"

_SECRET_FRONT = ("key = ", "token: ", "auth=", "Bearer ", "pwd=", 'secret = "', "credential ", "-p ", "", "", " ")
_PLAIN_FRONT = ("call ", "card ", "no. ", "see ", "order ", "id ", "page ", "file ", "", "", " ")


def generated(count: int, seed: int = 17, first: int = 0) -> list[tuple[str, int, int, int]]:
    """Labelled findings: text, start, end, secret or not; their kinds take turns, from the ``first`` on."""
    rng = np.random.default_rng(seed)
    pick = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))
    any_of = lambda values: values[int(rng.integers(len(values)))]
    word = lambda: pick(_LETTERS, int(rng.integers(2, 9)))
    words = lambda n, between="": between.join(word() for _ in range(n))
    digits = lambda n: pick(_DIGITS, n) if rng.random() < 0.6 else ""
    plain = (
        lambda: pick(_DIGITS, int(rng.integers(16, 20))),
        lambda: "-".join(pick(_DIGITS, 4) for _ in range(4)),
        lambda: words(5, "/") + "/" + digits(2),
        lambda: words(4, "_") + digits(1),
        lambda: words(5, "-") + "-" + digits(4),
        lambda: "".join(word().capitalize() for _ in range(4)) + digits(2),
        lambda: "2024-01-" + pick(_DIGITS, 2) + "_" + pick(_DIGITS, 6),
        lambda: "=" * 10 + pick(_DIGITS, 2) + "=" * 10,
        lambda: words(6) + digits(1),
        lambda: any_of("=-_+/ax0") * int(rng.integers(16, 60)),
        lambda: (words(5) + "tionheit")[: int(rng.integers(16, 26))].ljust(16, "e"),
        lambda: words(5).ljust(16, "e").capitalize(),
        lambda: words(5).ljust(16, "e").upper(),
    )
    after_key = (
        lambda: pick(_LETTERS, int(rng.integers(8, 16))),
        lambda: pick(_LETTERS, int(rng.integers(8, 16))).capitalize(),
        lambda: pick(_LETTERS, int(rng.integers(8, 16))).upper(),
        lambda: words(3, any_of("-_./")).ljust(8, "e"),
    )
    context = lambda w: {0: w.capitalize(), 1: w.upper(), 2: w + pick(_ODD, 1), 3: pick(_ODD, 1) + w, 4: w[:2] + pick(_ODD, 2) + w[2:], 5: pick(_DIGITS, 3)}.get(int(rng.integers(0, 14)), w)  # noqa: E501, E731
    around = lambda: " ".join(context(word()) for _ in range(int(rng.integers(0, 6))))

    rows = []
    for i in range(first, first + count):
        kind, head = i // 2 % 5, ""
        if i % 2:
            prefix, alphabet, lengths, suffix = any_of(_SHORT if kind == 0 else _SECRETS)
            body = prefix + pick(alphabet, int(rng.choice(lengths))) + suffix
            front = any_of(_KEY_FRONT if kind == 0 else _SECRET_FRONT)
        else:
            body, front = (any_of(after_key)(), any_of(_KEY_FRONT)) if kind == 0 else (any_of(plain)(), any_of(_PLAIN_FRONT))
        if kind == 1 and i // 10 % 2:
            start, alphabet, n = any_of(_HEADS)
            head = start + pick(alphabet, n)
            body = pick(_BASE64[:62], int(rng.integers(1, 25))) if i % 2 else any_of("/-_") + words(int(rng.integers(1, 4)), any_of("/-_"))
        before = around() + " " + front + head
        text = before + body + ('"' if front.endswith('"') else "") + " " + around()
        rows.append((text, len(before), len(before) + len(body), i % 2))
    return rows


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base findings that touch each other, cut out with what surrounds them; starts and ends in there by turns."""
    for _, texts in _sliced(batches, 0):
        pieces, bounds = [], []
        for text in texts:
            for group in touching(base_spans(text or "")):
                cut = max(0, group[0][0] - AROUND)
                pieces.append(text[cut : max(e for _, _, e in group) + AROUND])
                bounds.append([x - cut for s, _, e in group for x in (s, e)])
        yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(bounds, pa.list_(pa.int64()))], names=["piece", "bounds"])


_LABELLED = pa.schema([("place", pa.int64()), ("finding", pa.int64()), ("window", pa.int64()), ("secret", pa.int64()), ("codes", pa.binary())])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the findings of each place, and of a look-alike in the same surroundings."""
    columns: list[list] = [[] for _ in _LABELLED]

    def flush() -> pa.RecordBatch:
        arrays = [pa.array(c, kind) for c, kind in zip(columns, _LABELLED.types)]
        for c in columns:
            c.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=_LABELLED)

    for batch in batches:
        for place, piece, bounds in zip(*(c.to_pylist() for c in batch.columns)):
            text, start, end, _ = generated(1, seed=place & ((1 << 63) - 1), first=2 * (place % 10))[0]
            front, back = piece[: bounds[0]], piece[max(bounds[1::2]) :]
            rows = [(front + text[:end] + back, len(front) + start, len(front) + end)]
            rows += [(piece, s, e) for s, e in zip(bounds[::2], bounds[1::2])]
            for number, row in enumerate(rows):
                for k, codes in enumerate(windows(*row)):
                    for c, value in zip(columns, (place, number, k, int(number > 0), codes.tobytes())):
                        c.append(value)
                    if k % SHARD == SHARD - 1:
                        yield flush()
            if len(columns[0]) >= SHARD:
                yield flush()
        yield flush()


def labelled(docs: DataFrame) -> DataFrame:
    """``place, finding, window, secret, codes, held``: the windows of all base findings of all texts and of their look-alikes.

    Equal findings in equal surroundings count once, wherever they come from.  All
    windows of a place are held out or none.
    """
    places = docs.select("text").mapInArrow(_places, "piece string, bounds array<long>").distinct()
    places = places.select(F.xxhash64("piece", "bounds").alias("place"), "piece", "bounds")
    rows = places.mapInArrow(_labelled, "place long, finding long, window long, secret long, codes binary")
    return stash(rows.withColumn("held", F.pmod("place", F.lit(1000)) < int(1000 * HELD_OUT)))


def _codes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WINDOW)


def _shard(weights: np.ndarray, codes: np.ndarray, wanted: np.ndarray, rate: float):
    """Trains a copy of the network on a shard and the generated windows: its weights, times the windows of the shard."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("place", "ascending"), ("finding", "ascending"), ("window", "ascending")])
        some, secret = _codes(rows["codes"]), rows["secret"].to_numpy()
        network = CharacterNetwork().with_weights(weights)
        network.fit_all(np.concatenate([some, codes]), np.concatenate([secret, wanted]), rate=rate)
        values = np.rint(network.weights() * _EXACT).astype(np.int64) * len(rows)
        return pa.table({"position": np.arange(len(values)), "value": values, "n": np.full(len(values), len(rows))})

    return run


def _scores(network: CharacterNetwork):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Rounded down: no finding is taken for better than it is, so the recall holds.
            score = np.floor(network.logits(_codes(batch["codes"])) * _FINE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score)], names=["place", "finding", "secret", "score"])

    return run


def learn(docs: DataFrame) -> CharacterNetwork:
    """Train and calibrate on the base findings of all of ``docs`` and the generated table."""
    rows = generated(GENERATED)
    codes, wanted, of = [], [], []
    for number, i in enumerate(np.random.default_rng(23).permutation(len(rows))):
        text, start, end, secret = rows[i]
        for w in windows(text, start, end):
            codes.append(w)
            wanted.append(secret)
            of.append(number)
    codes, wanted, of = np.array(codes), np.array(wanted, np.int64), np.array(of)
    held = of < int(HELD_OUT * len(rows))  # all windows of a finding are on one side
    network = CharacterNetwork().fit(codes[~held], wanted[~held])

    found = labelled(docs)
    train = found.where("not held")
    shards = -(-train.count() // SHARD)
    # A long finding has many windows: they are dealt one by one.
    train = train.withColumn("shard", F.pmod(F.xxhash64("place", "finding", "window"), F.lit(max(1, shards))))
    for k in range(ROUNDS if shards else 0):
        shard = _shard(network.weights(), codes[~held], wanted[~held], RATE / 2**k)
        sums = train.groupBy("shard").applyInArrow(shard, "position long, value long, n long")
        # Sums of whole numbers: the order in which they are added changes nothing.
        sums = sums.groupBy("position").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).collect()
        network = network.with_weights(np.array([r["value"] / r["n"] / _EXACT for r in sorted(sums)]))

    scores = found.where("held").select("place", "finding", "secret", "codes").mapInArrow(_scores(network), "place long, finding long, secret long, score long")
    scores = scores.groupBy("place", "finding", "secret").agg(F.max("score").alias("score"))
    counts = sorted(scores.groupBy("score", "secret").count().collect())  # a row per step of the score
    score, secret, n = np.array(counts, np.int64).reshape(-1, 3).T
    own, label = network.scored(codes[held], wanted[held], of[held])
    weight = np.full(len(own), max(1.0, n.sum() / len(own)))
    return network.settle(np.concatenate([own, score / _FINE]), np.concatenate([label, secret]), np.concatenate([weight, n]))


def model_spans(network: CharacterNetwork, texts: list[str], bases: list[list[Span]]) -> list[list[tuple[int, int]]]:
    """Candidates that the network calls secrets, per text."""
    owner, spans, codes, of = [], [], [], []
    for i, (text, base) in enumerate(zip(texts, bases)):
        for start, end in candidates(text, base):
            for w in windows(text, start, end):
                codes.append(w)
                of.append(len(spans))
            owner.append(i)
            spans.append((start, end))
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    if spans:
        best = np.zeros(len(spans))
        np.maximum.at(best, np.array(of), network.probabilities(np.array(codes)))
        for k in np.flatnonzero(best >= network.threshold):
            found[owner[k]].append(spans[k])
    return found


def findings(network: CharacterNetwork, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Kind, start and end of all findings of each text, in order."""
    bases = [base_spans(t) for t in texts]
    order = {k: i for i, k in enumerate((*KINDS, MODEL))}
    found = []
    for base, more in zip(bases, model_spans(network, texts, bases)):
        spans = [(KINDS[k], s, e) for s, k, e in base] + [(MODEL, s, e) for s, e in more]
        found.append(sorted(spans, key=lambda x: (x[1], order[x[0]])))
    return found


def _sliced(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Rows and texts of a bounded number of bytes at a time."""
    for batch in batches:
        _, offsets = common.utf8(batch.column(place))
        for i, j in common.slices(offsets):
            part = batch.slice(i, j - i)
            yield part, part.column(place).to_pylist()


def _scan(network: CharacterNetwork, place: int, names: list[str], result: str):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _sliced(batches, place):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in findings(network, [t or "" for t in texts])]
            yield pa.RecordBatch.from_arrays([*part.columns[:place], pa.array(found, kind)], names=[*names, result])

    return run


def scan(docs: DataFrame, keep: list[str], network: CharacterNetwork | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` and a last one, ``findings``: ``array<struct<kind, start, end>>`` in order.

    Positions are code points, the end is exclusive.  A null text is empty.
    """
    network = network or learn(docs)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(common.fresh(docs, "whole_text")))
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    result = common.fresh(docs, "findings")
    kinds += f"{result} array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(_scan(network, len(keep), keep, result), kinds)


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model`` of every document row.

    Repeated rows each get a result, a null ``doc_id`` stays null, other columns are
    ignored, an empty table gives an empty result.
    """
    found = scan(docs.select("doc_id", "text"), ["doc_id"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("findings", lambda s: s["kind"] != MODEL)
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"), of(MODEL).alias("n_model"),
    )


def _masked(network: CharacterNetwork, place: int, names: list[str], mask: str):
    """Rows with the findings of their text replaced, overlaps as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _sliced(batches, place):
            for i, found in enumerate(findings(network, [t or "" for t in texts])):
                merged: list[list[int]] = []
                for _, start, end in sorted(found, key=lambda f: f[1:]):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                for start, end in reversed(merged):
                    texts[i] = texts[i][:start] + mask + texts[i][end:]
            columns = list(part.columns)
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding replaced; ``n_chars``, where there is one, follows a changed text."""
    masked = docs.mapInArrow(_masked(learn(docs), docs.columns.index("text"), docs.columns, mask), docs.schema)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        hidden = F.col("text").contains(mask)
        masked = masked.withColumn("n_chars", F.when(hidden, length).otherwise(F.col("n_chars")))
    return masked
