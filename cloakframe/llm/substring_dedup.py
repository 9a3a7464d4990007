"""Substring deduplication of word sequences with suffix automata.

The reference of a document is whatever else the corpus holds, so it is cut into
shards by anchor (``anchors``): the distinct contexts of an anchor are one shard,
and every context that may match a shard is routed to it, so no automaton has to
travel.  A task builds the automaton of a shard with the number of occurrences of
every state, streams each context through it, and reads the matching statistics:
the longest suffix of what was read that occurs at least twice.  Where it reaches
the threshold, a window ends.  ``remove_listed`` is the broadcast form for a
reference of proven size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import anchors, common

SEED = 8
# Words that a broadcast reference may hold.
LISTED_WORDS = 1_000_000


class SuffixAutomaton:
    """Generalised suffix automaton with occurrence counts."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def _clone(self, parent: int, token: int, target: int) -> int:
        """Split the state that ``token`` leads to, where it is longer than one more than ``parent``."""
        moves, link, length = self.next, self.link, self.length
        if length[target] == length[parent] + 1:
            return target
        clone = self._state(length[parent] + 1, dict(moves[target]), link[target])
        link[target] = clone
        while parent >= 0 and moves[parent].get(token) == target:
            moves[parent][token] = clone
            parent = link[parent]
        return clone

    def add(self, tokens: list[int], copies: int = 1) -> None:
        moves, link, length = self.next, self.link, self.length
        last = 0
        for token in tokens:
            target = moves[last].get(token)
            if target is not None:
                last = self._clone(last, token, target)
            else:
                new, parent = self._state(length[last] + 1, {}, 0), last
                while parent >= 0 and token not in moves[parent]:
                    moves[parent][token] = new
                    parent = link[parent]
                if parent >= 0:
                    link[new] = self._clone(parent, token, moves[parent][token])
                last = new
            self.count[last] += copies

    def finish(self, least: int = 2) -> None:
        """Add up occurrences along the links; ``reach``: longest suffix of a state that occurs ``least`` times."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for state in reversed(order):
            self.count[self.link[state]] += self.count[state]
        self.reach = [0] * len(self.length)
        for state in order:
            self.reach[state] = self.length[state] if self.count[state] >= least else self.reach[self.link[state]]

    def matching(self, tokens: list[int]) -> list[int]:
        """For every position the longest suffix of what was read that occurs often enough."""
        state, size, found = 0, 0, []
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if token in self.next[state]:
                state = self.next[state][token]
                size += 1
            link = self.link[state]
            found.append(size if self.reach[state] == self.length[state] else min(size, self.reach[link] if link >= 0 else 0))
        return found


def _matcher(length: int) -> anchors.Matcher:
    def flags(anchor: np.ndarray, tokens: np.ndarray, bounds: np.ndarray, copies: np.ndarray) -> np.ndarray:
        words, found = tokens.tolist(), []
        shards = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]])
        for i, j in zip(shards[:-1], shards[1:]):
            automaton = SuffixAutomaton()
            for k in range(i, j):
                automaton.add(words[bounds[k] : bounds[k + 1]], int(copies[k]))
            automaton.finish()
            for k in range(i, j):
                reached = automaton.matching(words[bounds[k] : bounds[k + 1]])
                found += [size >= length for size in reached[length - 1 :]]
        return np.array(found, bool)

    return flags


def _kept_words(data: np.ndarray, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    every = data.tobytes().split()
    removed = 0
    for a, b in reversed(spans):
        del every[a:b]
        removed += b - a
    return b" ".join(every), len(every) + removed, removed


def _leave_out(length: int, spans_of) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.utf8(batch.column("text"))
            for i, j in common.slices(offsets):
                done = [_kept_words(text := data[offsets[k] : offsets[k + 1]], spans_of(batch, k, text)) for k in range(i, j)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array([d[1] for d in done], pa.int64()),
                     pa.array([d[2] for d in done], pa.int64()), pa.array([d[0].decode() for d in done], pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    return run


def _schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string"


def remove_repeats(docs: DataFrame, length: int = 35, group: int = anchors.GROUP) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every document row.

    Removes every word covered by ``length`` consecutive words that also start
    elsewhere, in another document or the same one.  Words are the runs between
    ASCII white space, unchanged; windows are judged on the input and never cross
    documents; ``kept`` joins the other words by one space.  A null text has no
    words, a null ``doc_id`` is a document like any other, rows that repeat are
    copies of each other, other columns are ignored.
    """
    grain = anchors.by_words(length, SEED)
    found = anchors.repeated(docs, grain, _matcher(length), group=group)
    rows = docs.select("doc_id", common.row_key().alias("key"), "text").join(found, "key", "left")

    def spans_of(batch: pa.RecordBatch, k: int, _: np.ndarray) -> list[tuple[int, int]]:
        span = batch.column("spans")[k]
        if not span.is_valid:
            return []
        return anchors.covered(span.values.field("lo").to_numpy(), span.values.field("hi").to_numpy(), length)

    return rows.select("doc_id", "text", "spans").mapInArrow(_leave_out(length, spans_of), _schema(docs))


def remove_listed(docs: DataFrame, reference: DataFrame, length: int = 35) -> DataFrame:
    """As ``remove_repeats``, for windows that occur in the ``text`` of ``reference``.

    The automaton of the reference is broadcast, so the reference may hold
    ``LISTED_WORDS`` words at most; a larger one is refused.
    """
    texts, size = [], 0
    for row in reference.select("text").where("text is not null").toLocalIterator():
        texts.append(row["text"].encode().split())
        size += len(texts[-1])
        if size > LISTED_WORDS:
            raise ValueError(f"the reference has more than {LISTED_WORDS} words")
    automaton = SuffixAutomaton()
    for text in texts:
        automaton.add(text)
    automaton.finish(1)
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def spans_of(_: pa.RecordBatch, __: int, text: np.ndarray) -> list[tuple[int, int]]:
        reached = np.array(shared.value.matching(text.tobytes().split()), np.int64)
        start = np.flatnonzero(reached >= length) - length + 1
        return anchors.covered(start, start + 1, length)

    return docs.select("doc_id", "text").mapInArrow(_leave_out(length, spans_of), _schema(docs))
