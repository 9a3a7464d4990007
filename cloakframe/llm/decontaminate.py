"""Benchmark decontamination: q-gram lemma filter on diagonal bands, then banded alignment.

Benchmark items and documents are normalised alike (ASCII letters lower-cased,
everything else in ASCII a single space).  Items are cut into overlapping segments;
a segment may differ from a passage by ``edits`` insertions, deletions and
replacements, an edit budget in proportion to its length.

*Filter.*  If a passage is within the budget, it shares at least
``n + 1 - (edits + 1) * q`` of the segment's q-grams, on diagonals that differ by at
most ``edits``.  The q-grams that a document shares are counted in bands of
diagonals, two overlapping bands for every diagonal, so that a passage lies in one of them
whole; bands below the bound hold no passage.

*Verification.*  The regions that are left are aligned with their segment within the
band; the smallest distance decides.

The benchmark is a small table: its segments are broadcast in blocks of at most
``BLOCK_BYTES``, with one narrow pass over the documents per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

Q = 10
# Normalised bytes of a segment, bytes between segment starts, edits allowed per 100 bytes.
SEGMENT, STEP, EDIT_PERCENT = 80, 20, 8
# Normalised bytes below which an item is one segment that must occur without an edit.
SHORTEST = 40
# Item bytes of a broadcast block.
BLOCK_BYTES = 2 << 20
_TABLE_BITS = 22

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
for _first, _last in ((48, 57), (97, 122)):
    _FOLD[_first : _last + 1] = np.arange(_first, _last + 1)
_FOLD[65:91] = np.arange(97, 123)


def normalise(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes of the rows of a slice and their bounds; a row does not start with a space."""
    folded = _FOLD[data]
    keep = folded != 32
    after_word = np.zeros(len(folded), bool)
    after_word[1:] = keep[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    after_word[inner] = False
    keep |= after_word  # the first space after a word
    places = np.concatenate([[0], np.cumsum(keep)])
    return folded[keep], places[bounds]


def gram_keys(data: np.ndarray) -> np.ndarray:
    """64-bit key of the ``Q`` bytes at every position."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    eight = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view("<u8").ravel()
    n = len(data) - Q + 1
    return common.mix(eight[:n]) + eight[Q - 8 : Q - 8 + n]


@dataclass
class Segments:
    """Segments of benchmark items, their q-grams in key order, and a bit table of the keys.

    ``items`` are numbers of ``ids``, which may be of any type.
    """

    text: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    items: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    segment: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    ids: list

    @property
    def edits(self) -> np.ndarray:
        allowed = np.minimum(self.lengths * EDIT_PERCENT // 100, np.maximum(0, self.lengths // Q - 1))
        return np.where(self.lengths < SHORTEST, 0, allowed)


def segments(items: list[tuple[object, str]]) -> Segments:
    """Cut items ``(id, text)`` into segments; the last one ends with the item."""
    texts, starts, lengths, owners, at = [], [], [], [], 0
    # Items that share an id are one.
    number = {item: i for i, item in enumerate(dict.fromkeys(item for item, _ in items))}
    for item, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        text, _ = normalise(raw, np.array([0, len(raw)]))
        text = text[:-1] if len(text) and text[-1] == 32 else text
        if len(text) < Q:
            continue  # without a q-gram
        for start in [*range(0, max(1, len(text) - SEGMENT), STEP), max(0, len(text) - SEGMENT)]:
            starts.append(at + start)
            lengths.append(min(SEGMENT, len(text)))
            owners.append(number[item])
        texts.append(text)
        at += len(text)
    text = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
    starts, lengths = np.array(starts, np.int64), np.array(lengths, np.int64)
    every = gram_keys(text)
    grams = np.maximum(0, lengths - Q + 1)
    segment = np.repeat(np.arange(len(starts)), grams)
    place = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
    keys = every[starts[segment] + place] if len(segment) else np.zeros(0, np.uint64)
    order = np.argsort(keys, kind="stable")
    keys, first = np.unique(keys[order], return_index=True)
    seen = np.zeros(1 << _TABLE_BITS, bool)
    seen[(keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
    return Segments(text, starts, lengths, np.array(owners, np.int64), keys, np.append(first, len(order)), segment[order], place[order], seen, list(number))


def shared_grams(known: Segments, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position in the text, segment and place in the segment of every shared q-gram."""
    keys = gram_keys(text)
    at = np.flatnonzero(known.seen[(keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
    found = np.searchsorted(known.keys, keys[at])
    real = known.keys[np.minimum(found, len(known.keys) - 1)] == keys[at]
    at, found = at[real], found[real]
    number = known.first[found + 1] - known.first[found]
    index = np.repeat(known.first[found] - (np.cumsum(number) - number), number) + np.arange(number.sum())
    return np.repeat(at, number), known.segment[index], known.place[index]


def regions(known: Segments, text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, segment and first diagonal of every band that meets the q-gram bound."""
    at, segment, place = shared_grams(known, text)
    row = np.searchsorted(bounds, at, "right") - 1
    whole = at + Q <= bounds[np.minimum(row + 1, len(bounds) - 1)]
    at, segment, place, row = at[whole], segment[whole], place[whole], row[whole]
    diagonal = at - place + SEGMENT  # of the slice, never negative
    edits = known.edits
    width = 2 * (edits[segment] + 1)  # bands of twice the budget, each shifted by half a band
    need = known.lengths + 1 - (edits + 1) * Q
    found = []
    for shift in (0, 1):
        band = (diagonal + shift * (edits[segment] + 1)) // width
        order = np.lexsort((band, segment, row))
        if not len(order):
            continue
        same = np.ones(len(order), bool)
        same[0] = False
        for x in (band, segment, row):
            same[1:] &= x[order][1:] == x[order][:-1]
        starts = np.flatnonzero(~same)
        counts = np.diff(np.append(starts, len(order)))
        first = order[starts]
        enough = counts >= need[segment[first]]
        first = first[enough]
        low = band[first] * width[first] - shift * (edits[segment[first]] + 1) - SEGMENT
        found.append((row[first], segment[first], low))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def banded_distances(known: Segments, text: np.ndarray, bounds: np.ndarray, row: np.ndarray, segment: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest edit distance of each segment to a passage within its band, and where the passage ends.

    All regions are aligned together, one row of the segment at a time.  Column j
    of row i stands for the text position ``low + i + j - edits``; a passage may start
    and end anywhere in the band.  Text outside the row never matches.
    """
    edits = known.edits[segment]
    widest = int(4 * (edits.max() + 1)) if len(edits) else 0
    columns = np.arange(widest)
    left, right = bounds[row], bounds[row + 1]
    base = low - edits
    active = columns[None, :] < (4 * (edits + 1))[:, None]
    far = np.int32(1 << 20)
    cost = np.where(active, 0, far).astype(np.int32)
    best = np.full(len(row), far, np.int32)
    end = np.zeros(len(row), np.int64)
    slope = columns.astype(np.int32)[None, :]
    lengths = known.lengths[segment]
    for i in range(int(lengths.max()) if len(lengths) else 0):
        at = base[:, None] + i + columns[None, :]
        letter = known.text[np.minimum(known.starts[segment] + i, len(known.text) - 1)]
        inside = (at >= left[:, None]) & (at < right[:, None])
        equal = inside & (text[np.clip(at, 0, max(0, len(text) - 1))] == letter[:, None])
        new = np.where(inside, cost + ~equal, far)  # row i reads text position base + i + j: diagonal moves keep j
        up = np.full_like(cost, far)
        up[:, :-1] = cost[:, 1:] + 1  # a segment byte without a text byte
        new = np.minimum(new, up)
        new = np.minimum.accumulate(new - slope, 1) + slope  # text bytes without a segment byte
        cost = np.where(active, new, far).astype(np.int32)
        done = lengths == i + 1
        if done.any():
            least = cost[done].argmin(1)
            best[done] = cost[done].min(1)
            end[done] = base[done] + i + 1 + least
    return best, end


def passages(known: Segments, text: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Row, item, first and last position (normalised) and edits of every contaminated passage.

    Passages of one item that touch or overlap are one; the edits are the fewest of a segment.
    """
    row, segment, low = regions(known, text, bounds)
    found = []
    for part in range(0, len(row), 4096):
        r, s, d = row[part : part + 4096], segment[part : part + 4096], low[part : part + 4096]
        best, end = banded_distances(known, text, bounds, r, s, d)
        for k in np.flatnonzero(best <= known.edits[s]):
            last = int(end[k] - bounds[r[k]])
            found.append((int(r[k]), int(known.items[s[k]]), max(0, last - int(known.lengths[s[k]])), last, int(best[k])))
    merged: list[tuple[int, int, int, int, int]] = []
    for hit in sorted(found):
        if merged and merged[-1][:2] == hit[:2] and hit[2] <= merged[-1][3]:
            r, item, lo, hi, edits = merged[-1]
            merged[-1] = (r, item, lo, max(hi, hit[3]), min(edits, hit[4]))
        else:
            merged.append(hit)
    return merged


def _scan(shared, place: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            data, offsets = common.utf8(batch.column(place))
            for i, j in common.slices(offsets):
                text, bounds = normalise(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hits = passages(known, text, bounds)
                if hits:
                    rows = batch.column(0).slice(i, j - i).take(pa.array([h[0] for h in hits]))
                    ids = [known.ids[h[1]] for h in hits]
                    yield pa.RecordBatch.from_arrays(
                        [rows, pa.array(ids, kind), *(pa.array([h[k] for h in hits], pa.int64()) for k in (2, 3, 4))],
                        names=["doc", "item_id", "first", "last", "edits"],
                    )

    return run


def _blocks(benchmark: DataFrame) -> Iterator[Segments]:
    """Segments of the benchmark, block by block; the driver holds one block."""
    items, size = [], 0
    for r in benchmark.where("text is not null").select("item_id", "text").toLocalIterator():
        items.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size >= BLOCK_BYTES:
            yield segments(items)
            items, size = [], 0
    if items:
        yield segments(items)


def contaminated(docs: DataFrame, benchmark: DataFrame, by: str = "doc_id") -> DataFrame:
    """``<by>, item_id, first, last, edits``: every passage of a document that a benchmark item explains.

    Positions count normalised bytes.  A null text has no passage; a null ``doc_id`` is
    reported as null; repeated rows are reported as often as they occur; item ids may be of
    any type that a table key has, and an item without one is reported under a null id; an item of fewer than ``SHORTEST`` normalised bytes
    must occur whole and without an edit; null items and those of fewer than ``Q`` bytes are
    not searched.  An exact quote of ``SEGMENT + STEP - 1`` bytes of an item is always found.  Empty tables give an empty result.
    """
    kind, item_kind = docs.schema[by].dataType.simpleString(), benchmark.schema["item_id"].dataType
    rows = docs.select(F.col(f"`{by}`").alias("doc"), F.col("text"))
    found = None
    for known in _blocks(benchmark):
        if not len(known.keys):
            continue
        shared = docs.sparkSession.sparkContext.broadcast(known)
        scan = _scan(shared, 1, to_arrow_type(item_kind))
        part = rows.mapInArrow(scan, f"doc {kind}, item_id {item_kind.simpleString()}, first long, last long, edits long")
        found = part if found is None else found.union(part)
    if found is None:
        none = F.lit(None).cast(item_kind).alias("item_id")
        found = rows.select("doc", none, *(F.lit(0).cast("long").alias(c) for c in ("first", "last", "edits"))).where("false")
    return found.withColumnRenamed("doc", by)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a passage of the benchmark."""
    name = common.fresh(docs, "row_key")
    keyed = docs.withColumn(name, common.row_key())
    hits = contaminated(keyed, benchmark, name).select(name).distinct()
    return keyed.join(hits, name, "left_anti").drop(name)
