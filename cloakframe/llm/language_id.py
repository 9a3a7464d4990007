"""Language identification: a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on a bounded sample of labelled
rows (``SAMPLE_DOCS`` per language, ``CROP`` characters of each).  Prediction reads
every byte of every text: a text is laid out in lanes of ``LANE`` bytes, the
network labels every position from its lane in both directions, and the
probabilities of the positions that belong to letters are averaged per document.
The work of a task is matrix products over thousands of lanes, memory is bounded by
the slice of text in hand, and no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

# The sample: documents of each language, and characters taken of each from a hashed place.
SAMPLE_DOCS, CROP = 300, 512
LANE, HIDDEN = 64, 8
LANES = 2048
UNKNOWN = "und"
# Columns of a prediction; a name that the table has already gets an underscore in front.
RESULT = ("lang_pred", "score")

_LETTER = np.zeros(256, np.float32)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = 1.0


@dataclass
class Direction:
    """One recurrent layer: input table per byte (3H, 256), recurrence (3H, H)."""

    table: np.ndarray
    recur: np.ndarray

    def run(self, codes: np.ndarray, keep: bool = False):
        """Hidden states ``(T, H, lanes)`` for ``codes (T, lanes)``; with ``keep`` also what training needs."""
        steps, lanes = codes.shape
        size = self.recur.shape[1]
        states = np.empty((steps, size, lanes), np.float32)
        h = np.zeros((size, lanes), np.float32)
        inputs, kept = np.empty((3 * size, lanes), np.float32), []
        for t in range(steps):
            np.take(self.table, codes[t], axis=1, out=inputs, mode="clip")
            recurrent = self.recur @ h
            gates = inputs[: 2 * size] + recurrent[: 2 * size]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1.0
            gates *= 0.5
            reset, update = gates[:size], gates[size:]
            candidate = recurrent[2 * size :] * reset
            candidate += inputs[2 * size :]
            np.tanh(candidate, out=candidate)
            if keep:
                kept.append((h, reset, update, candidate, recurrent[2 * size :]))
            change = candidate - h
            change *= update
            h = np.add(h, change, out=states[t])
        return (states, kept) if keep else states

    def gradients(self, codes: np.ndarray, kept: list, from_output: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backpropagation through time: gradients of the table and the recurrence."""
        steps, lanes = codes.shape
        size = self.recur.shape[1]
        d_recur = np.zeros_like(self.recur)
        d_inputs = np.empty((3 * size, steps, lanes), np.float32)
        d_h = np.zeros((size, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            before, reset, update, candidate, recurrent = kept[t]
            d_h = d_h + from_output[t]
            d_candidate = d_h * update * (1 - candidate**2)
            d_update = d_h * (candidate - before) * update * (1 - update)
            d_reset = d_candidate * recurrent * reset * (1 - reset)
            d_gates = np.concatenate([d_reset, d_update, d_candidate * reset])
            d_inputs[:, t] = np.concatenate([d_reset, d_update, d_candidate])
            d_recur += d_gates @ before.T
            d_h = d_h * (1 - update) + self.recur.T @ d_gates
        flat = codes.ravel()
        d_table = np.stack([np.bincount(flat, weights=row.ravel(), minlength=256) for row in d_inputs])
        return d_table.astype(np.float32), d_recur


class ByteNetwork:
    """Forward and backward layer, and an output layer on both states of a position."""

    def __init__(self, labels: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.labels = labels
        small = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.ahead = Direction(small(3 * HIDDEN, 256), small(3 * HIDDEN, HIDDEN))
        self.back = Direction(small(3 * HIDDEN, 256), small(3 * HIDDEN, HIDDEN))
        self.out, self.bias = small(len(labels), 2 * HIDDEN), np.zeros((len(labels), 1), np.float32)

    def _probabilities(self, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Label probabilities of every position: ``(T, labels, lanes)``."""
        scores = self.out[:, :HIDDEN] @ ahead + self.out[:, HIDDEN:] @ back + self.bias
        scores -= scores.max(1, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(1, keepdims=True)
        return scores

    def pooled(self, codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sum over the positions of each lane, ``(labels, lanes)``."""
        ahead = self.ahead.run(codes)
        back = self.back.run(codes[::-1])[::-1]
        return (self._probabilities(ahead, back) * weight[:, None, :]).sum(0)

    def fit(self, codes: np.ndarray, weight: np.ndarray, wanted: np.ndarray, steps: int = 400, batch: int = 192, rate: float = 0.01, seed: int = 5) -> ByteNetwork:
        """Adam on the cross-entropy of every weighted position; ``codes (T, lanes)``."""
        rng = np.random.default_rng(seed)
        values = [self.ahead.table, self.ahead.recur, self.back.table, self.back.recur, self.out, self.bias]
        mean, spread = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
        for step in range(1, steps + 1):
            at = rng.integers(0, codes.shape[1], batch)
            x, w, y = codes[:, at], weight[:, at], wanted[at]
            ahead, kept_ahead = self.ahead.run(x, True)
            back, kept_back = self.back.run(x[::-1], True)
            error = self._probabilities(ahead, back[::-1])
            error[:, y, np.arange(batch)] -= 1
            error *= (w / max(1.0, w.sum()))[:, None, :]
            d_out = np.concatenate([np.einsum("tkb,thb->kh", error, s) for s in (ahead, back[::-1])], 1)
            parts = [np.einsum("kh,tkb->thb", self.out[:, i : i + HIDDEN], error) for i in (0, HIDDEN)]
            grads = [
                *self.ahead.gradients(x, kept_ahead, parts[0]), *self.back.gradients(x[::-1], kept_back, parts[1][::-1]),
                d_out, error.sum((0, 2))[:, None],
            ]
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for v, g, m, s in zip(values, grads, mean, spread):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        return self


def lanes_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and weights ``(T, lanes)`` of the rows of a slice, and the row of each lane."""
    count = -(-np.diff(bounds) // LANE)
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[:-1][row] + place * LANE
    at = start[None, :] + np.arange(LANE)[:, None]
    inside = at < bounds[1:][row][None, :]
    codes = np.where(inside, data[np.minimum(at, max(0, len(data) - 1))] if len(data) else 0, 0).astype(np.uint8)
    return codes, _LETTER[codes] * inside, row


def _row_probabilities(network: ByteNetwork, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean label probabilities over the letters of each row, ``(rows, labels)``."""
    codes, weight, row = lanes_of(data, bounds)
    rows = len(bounds) - 1
    total, letters = np.zeros((rows, len(network.labels))), np.zeros(rows)
    for i in range(0, codes.shape[1], LANES):
        part = network.pooled(codes[:, i : i + LANES], weight[:, i : i + LANES])
        for k in range(len(network.labels)):
            total[:, k] += np.bincount(row[i : i + LANES], part[k], rows)
    letters = np.bincount(row, weight.sum(0), rows)
    return total / np.maximum(1.0, letters)[:, None]


def learn(rows: DataFrame) -> ByteNetwork | None:
    """Train on at most ``SAMPLE_DOCS`` documents of each language, chosen by a hash of the text."""
    rows = rows.where("lang is not null and text rlike '\\\\p{L}'")
    order = F.xxhash64("text", "doc_id")
    from_ = 1 + F.pmod(order, F.greatest(F.length("text") - CROP, F.lit(1)))
    crops = rows.select("lang", order.alias("order"), F.col("text").substr(from_.cast("int"), F.lit(CROP)).alias("crop"))
    by_language = Window.partitionBy("lang").orderBy("order", "crop")
    sample = crops.withColumn("place", F.row_number().over(by_language)).where(F.col("place") <= SAMPLE_DOCS)
    sample = sorted((r["lang"], r["place"], r["crop"]) for r in sample.collect())
    labels = sorted({s[0] for s in sample})
    if not labels:
        return None
    texts = [np.frombuffer(s[2].encode(), np.uint8) for s in sample]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    codes, weight, row = lanes_of(np.concatenate(texts), bounds)
    wanted = np.array([labels.index(s[0]) for s in sample])[row]
    share = np.bincount(wanted, minlength=len(labels))
    weight = weight * (len(wanted) / len(labels) / share[wanted])[None, :].astype(np.float32)
    return ByteNetwork(labels).fit(codes, weight, wanted)


def predict(docs: DataFrame, network: ByteNetwork | None, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``lang_pred`` and ``score``; ``docs`` has ``text``.

    Every letter of a text counts alike; a text that is null or has no letter is
    ``und`` with score 0, and so is every text if nothing could be learned.
    """
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(common.fresh(docs, "whole_text")))
    place = len(keep)
    label, score = (common.fresh(docs, c) for c in RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            data, offsets = common.utf8(column)
            for i, j in common.slices(offsets):
                bounds, part = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
                labels, scores = [], []
                mean = _row_probabilities(network, part, bounds) if network else np.zeros((j - i, 1))
                ascii_letters = np.concatenate([[0], np.cumsum((part < 128) & (_LETTER[part] > 0))])
                plain = ascii_letters[bounds[1:]] > ascii_letters[bounds[:-1]]
                for k in range(j - i):
                    letters = plain[k] or any(c.isalpha() for c in part[bounds[k] : bounds[k + 1]].tobytes().decode())
                    best = int(np.argmax(mean[k]))
                    labels.append(network.labels[best] if letters and network else UNKNOWN)
                    scores.append(min(1.0, round(float(mean[k, best]), 6)) if letters and network else 0.0)
                rows = [c.slice(i, j - i) for c in batch.columns[:place]]
                columns = [*rows, pa.array(labels, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, label, score])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds + ', ' if keep else ''}`{label}` string, `{score}` double")


def held_out(doc_id) -> F.Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document row.

    Learns from rows that have an id and a language and are not held out; a null id
    is not held out but not learned from either.  Repeated rows each get a result,
    other columns are ignored, an empty table gives an empty result.
    """
    network = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    found = predict(docs.select("doc_id", "text"), network, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def reject_unknown(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """``docs`` without rows that have no letter or whose best language scores below ``least``."""
    network = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    found = predict(docs, network, docs.columns)
    label, score = (common.fresh(docs, c) for c in RESULT)
    known = (F.col(label) != UNKNOWN) & (F.col(score) >= least)
    return found.where(known).select(*[F.col(f"`{c}`") for c in docs.columns])
