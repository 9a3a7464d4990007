"""Suffix-array deduplication of byte strings.

Contexts that may share a string of ``length`` bytes meet in a task (``anchors``),
which sorts their suffixes.  The order is built by prefix doubling and only to the
depth ``length``; suffixes that agree that far are ordered by position, so the
previous and the next smaller position that matter for the longest-previous-factor
array are neighbours: a position's factor reaches ``length`` exactly if a neighbour of
the same rank precedes it.  Ranks are arrays, nothing is compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, common

SEED = 48
SPANS = "array<struct<lo:bigint,hi:bigint>>"


def truncated_ranks(tokens: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Rank, among the given places, of the suffixes cut to ``length`` tokens."""
    depth = 1
    if tokens.dtype == np.uint8 and length >= 8:  # eight bytes at once
        padded = np.concatenate([tokens, np.zeros(7, np.uint8)])
        tokens = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(">u8").ravel().astype(np.uint64)
        depth = 8
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    while depth * 2 <= length:
        rank = _doubled(rank, np.arange(len(rank)), depth)
        depth *= 2
    return _doubled(rank, places, length - depth)


def _doubled(rank: np.ndarray, places: np.ndarray, shift: int) -> np.ndarray:
    """Ranks of places by their own rank, then by the rank ``shift`` further on."""
    ahead = places + shift
    second = np.where(ahead < len(rank), rank[np.minimum(ahead, len(rank) - 1)] + 1, 0)
    return np.unique(rank[places] * (len(rank) + 1) + second, return_inverse=True)[1].astype(np.int64)


def smaller_neighbours(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Previous and next position in suffix order within the same rank, -1 without one."""
    order = np.argsort(rank, kind="stable")
    same = rank[order][1:] == rank[order][:-1]
    before, after = np.full(len(rank), -1), np.full(len(rank), -1)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def _matcher(length: int, keep_first: bool) -> anchors.Matcher:
    def flags(_: np.ndarray, tokens: np.ndarray, bounds: np.ndarray, copies: np.ndarray) -> np.ndarray:
        each = np.diff(bounds) - length + 1
        places = np.repeat(bounds[:-1] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        before, after = smaller_neighbours(truncated_ranks(tokens, places, length))
        return before >= 0 if keep_first else (before >= 0) | (after >= 0)

    return flags


def _cut_out(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.utf8(batch.column("text"))
            lists = batch.column("spans")
            for i, j in common.slices(offsets):
                sizes, removed, spans, kept = np.diff(offsets[i : j + 1]), [], [], []
                for row in range(i, j):
                    text = data[offsets[row] : offsets[row + 1]]
                    cover = []
                    if lists[row].is_valid:
                        span = lists[row].values
                        cover = anchors.covered(span.field("lo").to_numpy(), span.field("hi").to_numpy(), length)
                    edges = [0, *(x for c in cover for x in c), len(text)]
                    kept.append(b"".join(text[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])))
                    removed.append(sum(b - a for a, b in cover))
                    spans.append([{"lo": a, "hi": b} for a, b in cover])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
                )

    return run


def remove_repeats(docs: DataFrame, length: int = 200, keep_first: bool = True, group: int = anchors.GROUP) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` of every document row.

    Removes the bytes covered by strings of ``length`` bytes that also start
    elsewhere, in another document or the same one, overlaps included: with
    ``keep_first`` the later copies in the order of ``doc_id`` and position, else all.
    Strings are judged on the input and never cross documents.  ``spans`` are the
    maximal removed runs, ``kept`` the remaining bytes.  A null text is empty; a null
    ``doc_id`` comes first in the order; rows that repeat an id and a text are alike:
    with ``keep_first`` they stay or go together.  Other columns are ignored.
    """
    grain = anchors.by_bytes(length, SEED)
    found = anchors.repeated(docs, grain, _matcher(length, keep_first), keep_first, group)
    rows = docs.select("doc_id", common.row_key().alias("key"), "text").join(found, "key", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, spans {SPANS}, kept binary"
    return rows.select("doc_id", "text", "spans").mapInArrow(_cut_out(length), schema)


def digested(found: DataFrame) -> DataFrame:
    """The result with the number of spans and the digest of what is left."""
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
