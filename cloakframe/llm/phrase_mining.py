"""Phrase collocations from weighted acyclic automata: count transducers per prefix range, composed for the counts of parts.

1. Every task sums, for words and for pairs of neighbours, hash buckets of a fixed number.
   A bucket under ``least`` holds no frequent pair; the bits of the others (2.5 MB) go to
   all tasks.  Buckets only spare work: on a corpus so large that all of them are full,
   nothing is spared and the result is the same.
2. Every shard lists, per position, the words from there on for as long as all pairs may
   be frequent, five at most: its distinct n-grams, sorted, with their counts.
3. They are dealt to prefix ranges by their first two words, one packed list per shard and
   range.  In a range the lists' union opens a state per prefix; its weight is the sum of
   all n-grams below it, which is how often the phrase that leads to it occurs.  Only
   frequent states are followed further.  n-grams under a very frequent pair do not go to
   one range: they are sorted and cut by their whole length, and states that a cut goes
   through are summed over the ranges.
4. The frequent phrases of a prefix range become a minimal acyclic transducer, built
   incrementally from their sorted order; the weights along a path sum to the place of
   the phrase's count.  The parts of all candidates, sorted, are composed with it.  A
   transducer that many candidates ask is sent to several tasks.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.operators.numbering import stash

from .common import mix
from .tokens import Tokens, byte_set, encode, hashes, pack, pack_words, shards, unpack, unpack_words

# Longest phrase.
MOST_WORDS = 5
# Buckets of single words and of pairs of words, as powers of two; slices of 2^18 are summed apart.
WORD_BITS, PAIR_BITS, SLICE_BITS = 22, 24, 18
# Occurrences of a pair from which its n-grams are cut by their whole length.
FREQUENT_PAIR = 1 << 18
# Phrases of one transducer, and asks that meet it in one task.
RANGE_PHRASES, RANGE_ASKS = 1 << 15, 1 << 17
# Rows of one language that are ranked in one task at first.
_SALTS = 64
_BREAKS = byte_set(*((ord(c), ord(c)) for c in ".,;:!?"), (0x0A, 0x0D))
_BETWEEN = _BREAKS | byte_set((0x20, 0x20), (0x09, 0x09))
_WORD_CELLS, _PAIR_CELLS = 1 << WORD_BITS, 1 << PAIR_BITS


def _tokens(shard: pa.Table) -> tuple[Tokens, np.ndarray, list[str]]:
    """Tokens of a shard, their language number, the languages."""
    found = encode(shard.column("text").combine_chunks(), _BETWEEN, _BREAKS)
    lang = shard.column("lang").combine_chunks().dictionary_encode()
    number = np.repeat(lang.indices.to_numpy(zero_copy_only=False), np.diff(found.bounds))
    return found, number.astype(np.int64), lang.dictionary.to_pylist()


def _word_hash(lang: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(word ^ (lang << np.uint64(32)))


def _pair_hash(lang: np.ndarray, word: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix((_word_hash(lang, word) >> np.uint64(1)) + after)


def _cells(hashed: np.ndarray, count: int) -> np.ndarray:
    return (hashed & np.uint64(count - 1)).astype(np.int64)


def _hashed(found: Tokens, number: np.ndarray, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word's language, and of every word."""
    return hashes(x.encode() for x in langs).astype(np.uint64)[number], hashes(found.vocabulary.to_pylist()).astype(np.uint64)[found.ids]


def _sums(counts: np.ndarray) -> Iterator[dict]:
    """Slices of bucket counts that are not empty."""
    for i, part in enumerate(counts.reshape(-1, 1 << SLICE_BITS)):
        at = np.flatnonzero(part)
        if len(at):
            yield {"part": i, "cells": pack(np.diff(at, prepend=0)), "counts": pack(part[at])}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(_WORD_CELLS + _PAIR_CELLS, np.uint32)
    for shard in shards(batches):
        found, number, langs = _tokens(shard)
        lang, word = _hashed(found, number, langs)
        pairs = _cells(_pair_hash(lang[:-1], word[:-1], word[1:]), _PAIR_CELLS)
        for cells in (_cells(_word_hash(lang, word), _WORD_CELLS), pairs[~found.begins[1:]] + _WORD_CELLS):
            at, n = np.unique(cells, return_counts=True)
            counts[at] += n.astype(np.uint32)
    yield pa.RecordBatch.from_pylist(list(_sums(counts)), schema=pa.schema([("part", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())]))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the slices that meet in this task."""
    parts: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            counts = parts.setdefault(row["part"], np.zeros(1 << SLICE_BITS, np.int64))
            counts[np.cumsum(unpack(row["cells"]))] += unpack(row["counts"])
    for part, counts in parts.items():
        at = np.flatnonzero(counts)
        row = {"part": part, "cells": pack(np.diff(at, prepend=0)), "counts": pack(counts[at])}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())]))


def frequent_cells(docs: DataFrame, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the buckets, of words and then of pairs, that hold ``least`` or more, and ``most`` or more; of fixed size."""
    spark = docs.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = (_WORD_CELLS + _PAIR_CELLS) >> SLICE_BITS
    schema = "part int, cells binary, counts binary"
    sums = docs.mapInArrow(_counted, schema)
    # Slices meet in two steps, so that no task reads those of all tasks.
    salted = sums.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(max(1, wide // parts))))
    sums = salted.repartition(wide, "part", "salt").drop("salt").mapInArrow(_summed, schema)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _summed(batches):
            row = batch.to_pylist()[0]
            counts = np.zeros(1 << SLICE_BITS, np.int64)
            counts[np.cumsum(unpack(row["cells"]))] = unpack(row["counts"])
            full = [[np.packbits(counts >= n).tobytes()] for n in (least, most)]
            yield pa.RecordBatch.from_arrays([pa.array([row["part"]], pa.int32()), *(pa.array(x, pa.binary()) for x in full)], names=["part", "often", "hot"])

    out = np.zeros((2, parts, (1 << SLICE_BITS) // 8), np.uint8)
    for row in sums.repartition(min(wide, parts), "part").mapInArrow(bits, "part int, often binary, hot binary").collect():
        out[:, row["part"]] = [np.frombuffer(row[c], np.uint8) for c in ("often", "hot")]
    return out[0].reshape(-1), out[1].reshape(-1)


def _holds(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1


def _reach(found: Tokens, frequent: np.ndarray, lang: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Words that the n-gram from each position may have: 0 if its word is rare."""
    word = _holds(frequent, _cells(_word_hash(lang, words), _WORD_CELLS))
    further = word.copy()
    if len(word):
        pairs = _cells(_pair_hash(lang[:-1], words[:-1], words[1:]), _PAIR_CELLS)
        further[-1] = False
        further[:-1] &= word[1:] & ~found.begins[1:] & _holds(frequent, pairs + _WORD_CELLS)
    reach, going = word.astype(np.int64), further.copy()
    for _ in range(MOST_WORDS - 1):
        reach += going
        going[:-1] = going[1:] & further[:-1]
        going[-1:] = False
    return reach


_LISTS = pa.schema([
    ("part", pa.int32()), ("langs", pa.list_(pa.string())), ("words", pa.binary()), ("path", pa.binary()), ("counts", pa.binary()),
    ("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64()),
])
_LISTED = "part int, langs array<string>, words binary, path binary, counts binary, lang string, gram string, n long"


def _grams(ids: np.ndarray, number: np.ndarray, reach: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of two words or more, sorted: language and words (-1 where it is shorter), and counts."""
    at = np.flatnonzero(reach > 1)
    lead, parents, last, found, counts = number[at], [], [], [], []
    for depth in range(MOST_WORDS):
        # The n-grams of one word more extend distinct ones: a number stands for what leads up to the word.
        keys, place = np.unique(lead * width + ids[at + depth], return_inverse=True)
        parents.append(keys // width)
        last.append(keys % width)
        longer = reach[at] > depth + 1
        n = np.bincount(place[~longer], minlength=len(keys))
        node = np.flatnonzero(n)
        path = np.full((len(node), MOST_WORDS + 1), -1, np.int64)
        counts.append(n[node])
        for up in range(depth, -1, -1):
            path[:, up + 1] = last[up][node]
            node = parents[up][node]
        path[:, 0] = node
        found.append(path)
        at, lead = at[longer], place[longer]
    paths, n = np.concatenate(found), np.concatenate(counts)
    order = np.lexsort(paths.T[::-1])
    return paths[order], n[order]


def _packed(part: int, langs: list[str], words: pa.Array, path: np.ndarray, counts: np.ndarray) -> dict:
    """One shard's list for one range; only its own words go along."""
    own, place = np.unique(path[:, 1:], return_inverse=True)
    place = place.reshape(len(path), -1) + (own[0] >= 0)  # 0 stands for no word
    path = np.concatenate([path[:, :1], place], axis=1)
    return {"part": part, "langs": langs, "words": pack_words(words.take(pa.array(own[own >= 0]))), "path": pack(path.T.ravel()), "counts": pack(counts)}


def _listed(frequent: np.ndarray, hot: np.ndarray, ranges: int) -> Callable:
    """Lists of every shard: single words (ranges from 0), n-grams (from ``ranges``); n-grams under a hot pair one by one; all words as the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            found, number, langs = _tokens(shard)
            lang, word = _hashed(found, number, langs)
            reach = _reach(found, frequent, lang, word)
            order = pc.sort_indices(found.vocabulary).to_numpy()
            words = found.vocabulary.take(pa.array(order))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            ids, width = rank[found.ids], max(1, len(order))
            total = np.bincount(number, minlength=len(langs))
            out = [{"part": -1, "lang": x, "gram": "", "n": int(n)} for x, n in zip(langs, total)]
            single, n = np.unique(number[reach > 0] * width + ids[reach > 0], return_counts=True)
            singles = np.stack([single // width, single % width], axis=1)
            paths, counts = _grams(ids, number, reach, width)
            lang_hash, word_hash = hashes(x.encode() for x in langs).astype(np.uint64), hashes(words.to_pylist()).astype(np.uint64)
            pair = _pair_hash(lang_hash[paths[:, 0]], word_hash[paths[:, 1]], word_hash[paths[:, 2]])
            is_hot = _holds(hot, _cells(pair, _PAIR_CELLS) + _WORD_CELLS)
            for path, size in zip(paths[is_hot].tolist(), counts[is_hot].tolist()):
                out.append({"part": -1, "lang": langs[path[0]], "gram": "".join(words[i].as_py().decode() + " " for i in path[1:] if i >= 0), "n": size})
            word_range = (_word_hash(lang_hash[singles[:, 0]], word_hash[singles[:, 1]]) >> np.uint64(32)) % np.uint64(ranges)
            pair_range = (pair >> np.uint64(32)) % np.uint64(ranges) + np.uint64(ranges)
            for table, size, where in ((singles, n, word_range), (paths[~is_hot], counts[~is_hot], pair_range[~is_hot])):
                by_range = np.argsort(where, kind="stable")
                stops = np.flatnonzero(np.append(np.diff(where[by_range]), 1)) + 1 if len(where) else []
                for a, b in zip([0, *stops[:-1]], stops):
                    pick = by_range[a:b]
                    out.append(_packed(int(where[pick[0]]), langs, words, table[pick], size[pick]))
            yield pa.RecordBatch.from_pylist(out, schema=_LISTS)

    return run


_STATES = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("n", pa.int64())])


def _union(least: int) -> Callable:
    """Frequent states of the union of all shards' lists in a range."""

    def run(lists: pa.Table) -> pa.Table:
        words = [unpack_words(b) for b in lists.column("words").to_pylist()]
        merged = pa.chunked_array(words).dictionary_encode().unify_dictionaries()
        langs = pa.chunked_array([pa.array(x, pa.string()) for x in lists.column("langs").to_pylist()]).dictionary_encode().unify_dictionaries()
        paths, counts = [], []
        for blob, counted, own, names in zip(lists.column("path").to_pylist(), lists.column("counts").to_pylist(), merged.chunks, langs.chunks):
            number = np.concatenate([[-1], own.indices.to_numpy()])
            columns = unpack(blob).reshape(-1, len(sizes := unpack(counted)))
            counts.append(sizes)
            paths.append(np.concatenate([names.indices.to_numpy()[columns[:1]], number[columns[1:]]]))
        return _weighed(np.concatenate(paths, axis=1), np.concatenate(counts), merged.chunk(0).dictionary, langs.chunk(0).dictionary, least)

    return run


def _weighed(paths: np.ndarray, counts: np.ndarray, words: pa.Array, langs: pa.Array, least: int) -> pa.Table:
    """A state per prefix, its weight the sum of the n-grams below it; rare ones are not followed."""
    lead, rows, out = paths[0], np.arange(paths.shape[1]), []
    text = langs.take(pa.array(np.arange(len(langs))))
    heads, phrases = np.arange(len(langs)), pa.array([""] * len(langs), pa.large_string())
    words = words.cast(pa.large_string())
    for depth in range(1, len(paths)):
        has = paths[depth, rows] >= 0
        rows, lead = rows[has], lead[has]
        if not len(rows):
            break
        keys, place = np.unique(lead * len(words) + paths[depth, rows], return_inverse=True)
        weight = np.zeros(len(keys), np.int64)
        np.add.at(weight, place, counts[rows])
        often = weight >= least
        above, last = pa.array(keys[often] // len(words)), words.take(pa.array(keys[often] % len(words)))
        phrases = last if depth == 1 else pc.binary_join_element_wise(phrases.take(above), last, pa.scalar(" ", pa.large_string()))
        heads = heads[np.asarray(above)]
        number = np.cumsum(often) - 1
        stay = often[place]
        rows, lead = rows[stay], number[place[stay]]
        if depth > 1 or len(paths) == 2:  # the words that n-grams start with are counted as words
            out.append(pa.table([text.take(pa.array(heads)), phrases.cast(pa.string()), pa.array(np.full(len(heads), depth, np.int32)), pa.array(weight[often])], schema=_STATES))
    return pa.concat_tables(out) if out else _STATES.empty_table()


def _stated(least: int) -> Callable:
    """Weights of the states that sorted n-grams open: whole ones of ``least`` or more, and all on the first and last path."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            grams = pc.split_pattern(pc.utf8_slice_codeunits(batch.column("gram"), 0, stop=-1), " ")
            size = np.asarray(pc.list_value_length(grams), np.int64)
            ids = np.asarray(pc.list_flatten(grams).dictionary_encode().indices, np.int64)
            starts = np.cumsum(size) - size
            lang = np.asarray(batch.column("lang").dictionary_encode().indices, np.int64)
            n = np.asarray(batch.column("n"), np.int64)
            path = np.full((batch.num_rows, MOST_WORDS), -1, np.int64)
            for depth in range(MOST_WORDS):
                has = size > depth
                path[has, depth] = ids[starts[has] + depth]
            same = np.ones(batch.num_rows, bool)  # as the n-gram before, up to this depth
            same[0] = False
            same[1:] = lang[1:] == lang[:-1]
            for depth in range(MOST_WORDS):
                same[1:] &= path[1:, depth] == path[:-1, depth]
                has = np.flatnonzero(size > depth)
                if not len(has):
                    break
                if not depth:  # single words are counted apart
                    continue
                first = np.flatnonzero(~same[has])  # the words up to here change only where a state opens
                weight = np.add.reduceat(n[has], first)
                opened, closed = has[first], np.append(has[first[1:] - 1], has[-1])
                cut = (opened == 0) | (closed == batch.num_rows - 1)
                keep = np.flatnonzero((weight >= least) | cut)
                if not len(keep):
                    continue
                pick = opened[keep]
                take = pa.array((starts[pick][:, None] + np.arange(depth + 1)).ravel())
                words = pa.ListArray.from_arrays(pa.array(np.arange(len(pick) + 1) * (depth + 1), pa.int32()), pc.list_flatten(grams).take(take))
                yield pa.RecordBatch.from_arrays([
                    batch.column("lang").take(pa.array(pick)), pc.binary_join(words, " "), pa.array(np.full(len(pick), depth + 1, np.int32)), pa.array(weight[keep]),
                ], schema=schema)

    return run


def phrase_counts(documents: DataFrame, least: int, hot_pair: int = FREQUENT_PAIR) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, f`` of all phrases of 1 to 5 words with ``least`` or more, and ``lang, n`` (all words)."""
    docs = documents.select(
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    )
    ranges = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    frequent, hot = frequent_cells(docs, least, max(least, hot_pair))
    lists = stash(docs.mapInArrow(_listed(frequent, hot, ranges), _LISTED))
    totals = lists.where("gram = ''").groupBy("lang").agg(F.sum("n").alias("n"))
    kind = "lang string, phrase string, size int, n long"
    states = lists.where("part >= 0").select("part", "langs", "words", "path", "counts").groupBy("part").applyInArrow(_union(least), kind)
    sorted_grams = lists.where("gram <> ''").select("lang", "gram", "n").repartitionByRange("lang", "gram").sortWithinPartitions("lang", "gram")
    states = states.union(sorted_grams.mapInArrow(_stated(least), kind))
    counts = states.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return stash(counts), totals


class CountTransducer:
    """Minimal acyclic automaton over words; the weights along a path sum to the place of the phrase's count."""

    def __init__(self, states: list[tuple[bool, dict[bytes, tuple[int, int]]]], start: int, counts: np.ndarray):
        self.states, self.start, self.counts = states, start, counts

    @classmethod
    def build(cls, phrases: list[tuple[bytes, ...]], counts: list[int]) -> CountTransducer:
        """From distinct phrases in sorted order: a state that no later phrase can change is replaced by an equal one."""
        states: list[tuple[bool, dict[bytes, tuple[int, int]]]] = []
        sizes: list[int] = []
        known: dict[tuple, int] = {}
        # States of the last phrase, still open: final, arcs to settled states, phrases below.
        path: list[list] = [[False, {}, 0]]
        labels: list[bytes] = []

        def settle(down_to: int) -> None:
            while len(path) > down_to + 1:
                final, arcs, size = path.pop()
                mark = (final, *arcs.items())
                at = known.setdefault(mark, len(states))
                if at == len(states):
                    states.append((final, arcs))
                    sizes.append(size)
                above = path[-1]
                above[1][labels.pop()] = (at, above[2])
                above[2] += sizes[at]

        for phrase in phrases:
            shared = 0
            while shared < min(len(phrase), len(labels)) and phrase[shared] == labels[shared]:
                shared += 1
            settle(shared)
            for word in phrase[shared:]:
                labels.append(word)
                path.append([False, {}, 0])
            path[-1][0], path[-1][2] = True, 1
        settle(0)
        states.append((path[0][0], path[0][1]))
        return cls(states, len(states) - 1, np.array(counts, np.int64))

    def compose(self, asks: list[tuple[bytes, ...]]) -> np.ndarray:
        """Counts of sorted phrases, 0 for those it does not hold; shared beginnings are walked once."""
        out = np.zeros(len(asks), np.int64)
        walked: list[tuple[int, int] | None] = [(self.start, 0)]
        last: tuple[bytes, ...] = ()
        for i, ask in enumerate(asks):
            shared = 0
            while shared < min(len(ask), len(last)) and ask[shared] == last[shared]:
                shared += 1
            del walked[shared + 1 :]
            for word in ask[shared:]:
                here = walked[-1]
                arc = self.states[here[0]][1].get(word) if here else None
                walked.append((arc[0], here[1] + arc[1]) if arc else None)
            last = ask
            if walked[-1] and self.states[walked[-1][0]][0]:
                out[i] = self.counts[walked[-1][1]]
        return out

    def to_bytes(self) -> bytes:
        words: dict[bytes, int] = {}
        arcs = [(words.setdefault(w, len(words)), target, weight) for _, out in self.states for w, (target, weight) in out.items()]
        columns = np.array(arcs, np.int64).reshape(-1, 3)
        blobs = [
            pack(np.array([len(out) for _, out in self.states])), pack(np.array([final for final, _ in self.states])), *(pack(c) for c in columns.T),
            pack(self.counts), pack_words(pa.array(list(words), pa.large_binary())),
        ]
        return np.array([len(b) for b in blobs], np.int64).tobytes() + b"".join(blobs)

    @classmethod
    def from_bytes(cls, data: bytes) -> CountTransducer:
        ends = np.cumsum(np.frombuffer(data[:56], np.int64)) + 56
        degree, final, label, target, weight, counts, words = (data[a:b] for a, b in zip([56, *ends[:-1]], ends))
        names = unpack_words(words).to_pylist()
        arcs = list(zip([names[i] for i in unpack(label)], zip(unpack(target).tolist(), unpack(weight).tolist())))
        stops = np.cumsum(unpack(degree)).tolist()
        states = [(bool(f), dict(arcs[a:b])) for f, a, b in zip(unpack(final).tolist(), [0, *stops[:-1]], stops)]
        return cls(states, len(states) - 1, unpack(counts))


def _key(lang: str, phrase: str) -> tuple[bytes, ...]:
    return (lang.encode(), *phrase.encode().split(b" "))


def _transduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transducers of ``RANGE_PHRASES`` sorted phrases each; the language is their first word."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("blob", pa.binary())])
    held: list[tuple[str, str, int]] = []

    def built() -> pa.RecordBatch:
        made = CountTransducer.build(*zip(*sorted((_key(a, b), n) for a, b, n in held)))
        return pa.RecordBatch.from_pydict({"lang": [held[0][0]], "phrase": [held[0][1]], "blob": [made.to_bytes()]}, schema=schema)

    for batch in batches:
        held += zip(*(batch.column(c).to_pylist() for c in ("lang", "phrase", "f")))
        while len(held) >= RANGE_PHRASES:
            held, rest = held[:RANGE_PHRASES], held[RANGE_PHRASES:]
            yield built()
            held = rest
    if held:
        yield built()


def _routed(firsts: list[tuple[bytes, bytes]]) -> Callable:
    """Which range an ask falls in: the last one that begins at or before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("lang").to_pylist(), batch.column("part").to_pylist())
            place = [bisect_right(firsts, (a.encode(), b.encode())) - 1 for a, b in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int32())], [*batch.schema.names, "range"])

    return run


def _composed(asks: pa.Table, transducers: pa.Table) -> pa.Table:
    out = asks.select(["lang", "phrase", "a", "k", "first"])
    if not asks.num_rows or not transducers.num_rows:
        return out.slice(0, 0).append_column("f", pa.array([], pa.int64()))
    made = CountTransducer.from_bytes(transducers.column("blob")[0].as_py())
    keys = [_key(a, b) for a, b in zip(asks.column("lang").to_pylist(), asks.column("part").to_pylist())]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    counts = np.empty(len(keys), np.int64)
    counts[order] = made.compose([keys[i] for i in order])
    return out.append_column("f", pa.array(counts))


def part_counts(counts: DataFrame) -> DataFrame:
    """``lang, phrase, a, k, l, r`` for every cut of every phrase of two words or more, by composition."""
    spark = counts.sparkSession
    ranges = stash(counts.repartitionByRange("lang", "phrase").sortWithinPartitions("lang", "phrase").mapInArrow(_transduced, "lang string, phrase string, blob binary"))
    # A row per RANGE_PHRASES phrases.
    firsts = sorted((r["lang"].encode(), r["phrase"].encode()) for r in ranges.select("lang", "phrase").collect())
    words = F.split("phrase", " ")
    cuts = counts.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    part: Column = F.when(F.col("first"), F.slice("w", F.lit(1), F.col("k"))).otherwise(F.slice("w", F.col("k") + 1, F.size("w")))
    asks = cuts.withColumn("first", F.explode(F.array(F.lit(True), F.lit(False)))).select("lang", "phrase", "a", "k", "first", F.array_join(part, " ").alias("part"))
    asks = stash(asks.mapInArrow(_routed(firsts), "lang string, phrase string, a long, k int, first boolean, part string, range int"))
    tasks = stash(asks.groupBy("range").agg(F.ceil(F.count("*") / F.lit(RANGE_ASKS)).cast("int").alias("tasks")))
    number = spark.createDataFrame([(a.decode(), b.decode(), i) for i, (a, b) in enumerate(firsts)], "lang string, phrase string, range int")
    copies = tasks.join(number, "range").join(ranges, ["lang", "phrase"]).select("range", "blob", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("salt"))
    salted = asks.join(tasks, "range").withColumn("salt", F.pmod(F.xxhash64("phrase", "k", "first"), F.col("tasks")).cast("int"))
    found = salted.groupBy("range", "salt").cogroup(copies.groupBy("range", "salt")).applyInArrow(_composed, "lang string, phrase string, a long, k int, first boolean, f long")
    sides = [F.max(F.when(F.col("first") == side, F.col("f"))).alias(name) for side, name in ((True, "l"), (False, "r"))]
    return found.groupBy("lang", "phrase", "k").agg(F.max("a").alias("a"), *sides)


def collocations(documents: DataFrame, least: int = 100, percent: int = 100, top: int = 2000) -> DataFrame:
    """Each language's best phrases: ``lang, rank, phrase, a, l, r, n, score``.

    ``documents`` has ``text`` and ``lang``; other columns are ignored.  A null text is
    empty, a null language ``und``.  Phrases of 2 to 5 words that occur ``least`` times (1
    or more) are scored by their weakest cut; one that lies in a longer phrase with at least
    ``percent`` of its occurrences is dropped.  Repeated rows count each time; a corpus
    without frequent phrases, or without rows, returns no row.
    """
    counts, totals = phrase_counts(documents, least)
    whole = lambda c: F.col(c).cast("decimal(17,0)")
    scored = part_counts(counts).join(totals, "lang").withColumns({"up": F.lit(1000).cast("decimal(4,0)") * (whole("a") * whole("n")), "down": whole("l") * whole("r")})
    scored = scored.withColumn("score", F.expr("up div down"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.*")
    longer = counts.where("size > 2").withColumn("w", F.split("phrase", " "))
    inner = longer.select("lang", "f", "w", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"), "size")
    inner = inner.select("lang", "f", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i"))
    inner = inner.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < percent * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
