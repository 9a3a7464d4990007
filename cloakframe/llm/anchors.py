"""Finding the windows of ``length`` tokens that occur more than once in a corpus.

A window's *anchor* is the smallest of the seed hashes in it, so equal windows have
the same anchor at the same place.  Consecutive windows with one anchor form a run;
the tokens that a run covers are its *context*.  Only about 2 / (length - seed) of
the positions are anchors, and only those are shuffled:

* anchors whose hash occurs once end there;
* contexts that are equal as a whole are settled by counting;
* the distinct contexts of an anchor meet in one task, where a matcher (a suffix
  order, a suffix automaton) finds the windows they share;
* an anchor with more than ``GROUP`` distinct contexts does not fit in a task: its
  windows are counted by digest instead, which gives the same answer.

Texts are shuffled twice, to cut contexts and to cut results; spans travel to them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.operators.numbering import stash

from . import common

# Distinct contexts of an anchor that one task compares: a few MB.
GROUP = 12_000
# Windows that are searched together, and bytes of contexts compared together at least.
_SEGMENT = 1 << 21
COMPARED = 1 << 20
_PLACE_BITS = np.uint64(24)

# Contexts in hand: a row per context, tokens flat with bounds, ordered by anchor and corpus position.
Matcher = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Grain:
    """How a text is cut: windows of ``length`` tokens, seeds of ``seed`` tokens.

    ``tokens`` gives the tokens of a slice and their row bounds, ``values`` their
    64-bit values, ``kind`` is the type of a token.
    """

    length: int
    seed: int
    kind: type
    tokens: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    values: Callable[[np.ndarray], np.ndarray]


def by_bytes(length: int, seed: int) -> Grain:
    return Grain(length, min(seed, max(1, length // 4)), np.uint8, lambda data, bounds: (data, bounds), common.byte_values)


def by_words(length: int, seed: int) -> Grain:
    """Words between ASCII white space, by hash."""

    def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, row = common.words(data, bounds)
        return common.word_hashes(data, starts, ends), np.searchsorted(row, np.arange(len(bounds)))

    return Grain(length, min(seed, max(1, length // 4)), np.uint64, tokens, lambda hashes: hashes)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(grain: Grain, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows by anchor: row, anchor hash, context hash, first window, window after the last.

    Positions are those of the slice; windows do not cross row bounds.
    """
    length, seed = grain.length, grain.seed
    found: list[tuple[np.ndarray, ...]] = []
    for from_ in range(0, max(0, len(tokens) - length + 1), _SEGMENT):
        part = grain.values(tokens[from_ : from_ + _SEGMENT + length - 1])
        sums = common.running(part)
        first = np.arange(len(part) - seed + 1)
        seeds = common.span_hashes(sums, first, first + seed)
        least = sliding_least((seeds >> _PLACE_BITS << _PLACE_BITS) + first.astype(np.uint64), length - seed + 1)
        anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        places = np.arange(len(anchor)) + from_
        row = np.searchsorted(bounds, places, "right") - 1
        fits = places + length <= bounds[row + 1]
        at, anchor = np.flatnonzero(fits), anchor[fits]
        if not len(at):
            continue
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        lo, hi = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] + 1
        contexts = common.span_hashes(sums, lo, hi - 1 + length)
        found.append((row[lo], seeds[anchor[new]], contexts, lo + from_, hi + from_))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def _emit(grain: Grain):
    """Anchors of documents; a context that a document repeats is one row, its later copies are spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.utf8(batch.column(2))
            for i, j in common.slices(offsets):
                tokens, bounds = grain.tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                row, anchor, context, lo, hi = runs(grain, tokens, bounds)
                if not len(row):
                    continue
                order = np.lexsort((lo, context, anchor, row))
                same = np.zeros(len(row), bool)
                same[1:] = (
                    (context[order][1:] == context[order][:-1])
                    & (anchor[order][1:] == anchor[order][:-1])
                    & (row[order][1:] == row[order][:-1])
                )
                copies = np.diff(np.append(np.flatnonzero(~same), len(row)))
                first, later = order[~same], np.sort(order[same])
                joined = np.zeros(len(later), bool)
                if len(later):
                    joined[1:] = (lo[later][1:] == hi[later][:-1]) & (row[later][1:] == row[later][:-1])
                span_lo = later[~joined]
                span_hi = later[np.append(np.flatnonzero(~joined)[1:], len(later)) - 1] if len(later) else later
                none = np.ones(len(first) + len(span_lo), bool)
                none[: len(first)] = False
                rows = np.concatenate([row[first], row[span_lo]])
                pad = lambda x: np.concatenate([x[first].view(np.int64), np.zeros(len(span_lo), np.int64)])  # noqa: B023,E731
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(rows)), batch.column(1).slice(i, j - i).take(pa.array(rows)),
                     pa.array(pad(anchor), mask=none), pa.array(pad(context), mask=none),
                     pa.array(np.concatenate([copies, np.ones(len(span_lo), np.int64)])),
                     pa.array(np.concatenate([lo[first], lo[span_lo]]) - bounds[rows]),
                     pa.array(np.concatenate([hi[first], hi[span_hi]]) - bounds[rows])],
                    names=["doc_id", "key", "anchor", "context", "n", "lo", "hi"],
                )

    return run


def _cut(grain: Grain):
    """Tokens of the contexts that a document was chosen to carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.utf8(batch.column(0))
            lists = batch.column(1)
            for i in range(batch.num_rows):
                tokens, _ = grain.tokens(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                wanted = lists[i].values
                lo, hi = wanted.field("lo").to_numpy(), wanted.field("hi").to_numpy()
                cut = [tokens[a : b - 1 + grain.length].tobytes() for a, b in zip(lo, hi)]
                for part in range(0, len(cut), 2000):
                    rows = pa.RecordBatch.from_struct_array(wanted.slice(part, 2000))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cut[part : part + 2000], pa.binary())], names=[*rows.schema.names, "tokens"])

    return run


def _spans(flags: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set flags within their context: context, first, one after the last."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
    lo, hi = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] + 1
    return owner[lo], lo - bounds[owner[lo]], hi - bounds[owner[lo]]


def _compare(grain: Grain, matcher: Matcher, settled: int):
    """Windows of contexts that a matcher flags, for contexts of fewer than ``settled`` copies."""

    def judge(rows: pa.Table) -> pa.RecordBatch:
        tokens = np.frombuffer(b"".join(rows.column("tokens").to_pylist()), grain.kind)
        lengths = pc.binary_length(rows.column("tokens")).to_numpy() // np.dtype(grain.kind).itemsize
        copies = rows.column("n").to_numpy()
        flags = matcher(rows.column("anchor").to_numpy(), tokens, np.concatenate([[0], np.cumsum(lengths)]), copies)
        windows = np.concatenate([[0], np.cumsum(lengths - grain.length + 1)])
        flags &= np.repeat(copies < settled, np.diff(windows))
        at, lo, hi = _spans(flags, windows)
        base = rows.column("lo").to_numpy()[at]
        key = rows.column("key").combine_chunks().take(pa.array(at))
        return pa.RecordBatch.from_arrays([key, pa.array(base + lo), pa.array(base + hi)], names=["key", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column("tokens"))).as_py() or 0
            if size < COMPARED:
                continue
            rows = pa.Table.from_batches(held)
            anchors = rows.column("anchor").to_numpy()
            whole = int(np.flatnonzero(anchors == anchors[-1])[0])  # the last anchor may go on
            if whole:
                for part in _parts(rows.slice(0, whole)):
                    yield judge(part)
            rows = rows.slice(whole).combine_chunks()
            held, size = rows.to_batches(), pc.sum(pc.binary_length(rows.column("tokens"))).as_py()
        if held:
            for part in _parts(pa.Table.from_batches(held)):
                yield judge(part)

    return run


def _parts(rows: pa.Table) -> Iterator[pa.Table]:
    """Whole anchors, about ``COMPARED`` bytes at a time."""
    if not rows.num_rows:
        return
    anchors = rows.column("anchor").to_numpy()
    ends = np.append(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, rows.num_rows)
    sizes = np.cumsum(pc.binary_length(rows.column("tokens")).to_numpy())[ends - 1]
    from_, done = 0, 0
    for end, size in zip(ends, sizes):
        if size - done >= COMPARED or end == rows.num_rows:
            yield rows.slice(from_, end - from_)
            from_, done = int(end), int(size)


def _digests(grain: Grain):
    """Every window of a context by digest, for anchors whose contexts do not fit in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = grain.values(np.frombuffer(row["tokens"], grain.kind))
                at = np.arange(len(values) - grain.length + 1)
                one = common.span_hashes(common.running(values), at, at + grain.length)
                two = common.span_hashes(common.running(common.mix(values)), at, at + grain.length)
                same = lambda x, kind: pa.array([x] * len(at), kind)  # noqa: B023,E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), same(row["n"], pa.int64()),
                     same(row["doc_id"], batch.schema.field("doc_id").type), same(row["key"], pa.int64()), pa.array(at + row["lo"])],
                    names=["one", "two", "n", "doc_id", "key", "lo"],
                )

    return run


def repeated(docs: DataFrame, grain: Grain, matcher: Matcher, keep_first: bool = False, group: int = GROUP) -> DataFrame:
    """``key, spans``: ranges of first tokens of the windows that occur more than once.

    With ``keep_first`` only windows with an earlier occurrence, in the order of
    ``doc_id``, row key and position.  Documents without such windows have no row.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", common.row_key().alias("key"), "text")
    schema = f"doc_id {kind}, key long, anchor long, context long, n long, lo long, hi long"
    anchors = stash(rows.mapInArrow(_emit(grain), schema))
    spans = anchors.where("anchor is null").select("key", "lo", "hi")
    often = anchors.where("anchor is not null").groupBy("anchor").agg(F.sum("n").alias("all")).where("all > 1").select("anchor")
    anchors = stash(anchors.join(often, "anchor"))
    first = F.min(F.struct("doc_id", "key", "lo", "hi")).alias("first")
    contexts = stash(anchors.groupBy("anchor", "context").agg(F.sum("n").alias("n"), first))

    settled = contexts.where("n > 1").select("anchor", "context", "first")
    settled = anchors.join(settled, ["anchor", "context"])
    if keep_first:
        here = F.struct(*[F.col(c).eqNullSafe(F.col(f"first.{c}")) for c in ("doc_id", "key", "lo")])
        settled = settled.where(~(here["col1"] & here["col2"] & here["col3"]))
    spans = spans.union(settled.select("key", "lo", "hi"))

    several = contexts.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1")
    several = contexts.join(several, "anchor").select("anchor", "n", "m", "first.*")
    carried = several.groupBy("key").agg(F.collect_list(F.struct("anchor", "n", "m", "doc_id", "key", "lo", "hi")).alias("cuts"))
    carried = rows.join(carried, "key").dropDuplicates(["key"]).select("text", "cuts")
    cut = f"anchor long, n long, m long, doc_id {kind}, key long, lo long, hi long, tokens binary"
    carried = stash(carried.mapInArrow(_cut(grain), cut))
    fits = carried.where(f"m <= {group}").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "key", "lo")
    spans = spans.union(fits.mapInArrow(_compare(grain, matcher, 1 << 62 if keep_first else 2), "key long, lo long, hi long"))

    windows = carried.where(f"m > {group}").select("tokens", "n", "doc_id", "key", "lo")
    windows = windows.mapInArrow(_digests(grain), f"one long, two long, n long, doc_id {kind}, key long, lo long")
    counted = windows.groupBy("one", "two").agg(F.sum("n").alias("all"), F.min(F.struct("doc_id", "key", "lo")).alias("first"))
    shared = windows.join(counted.where("all > 1"), ["one", "two"])
    if keep_first:
        here = [F.col(c).eqNullSafe(F.col(f"first.{c}")) for c in ("doc_id", "key", "lo")]
        shared = shared.where(~(here[0] & here[1] & here[2]))
    spans = spans.union(shared.select("key", "lo", (F.col("lo") + 1).alias("hi")))
    return spans.distinct().groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def covered(lo: np.ndarray, hi: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal token ranges that the windows starting in the given ranges cover."""
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order] - 1 + length)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    return list(zip(lo[new].tolist(), hi[np.append(np.flatnonzero(new)[1:], len(lo)) - 1].tolist()))
