"""Many literal rules in one pass: an Aho-Corasick automaton over all their terms.

The outcome is that of the rules applied one after the other.  One scan finds every
occurrence of every term.  Where no replacement can take part in a later match (the
conflict test below), the rules in order claim their occurrences, left to right, and the
text is written once.  A text in which another rule matches is worked off rule by rule,
but only over the rules whose terms it holds.
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from functools import cache, lru_cache, partial
from itertools import repeat

import ahocorasick
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters of terms and replacements that one automaton holds; longer lists take several, in order.
AUTOMATON_CHARS = 8_000_000
# Characters of texts that a task holds while the portions pass over them, and what a row adds to its text.
HELD_CHARS = 64_000_000
ROW_CHARS = 50
# One rule: four log fields, term (empty: only logged, with count 0), replacement, whether case counts.
Rule = tuple[str, str, str, str, str, str, bool]


@cache
def _folds() -> dict[int, int]:
    """Characters that ignore-case comparison takes for another one: the lower case of the upper case."""
    out = {}
    for code in range(0x110000):
        upper = chr(code).upper()
        lower = (upper if len(upper) == 1 else chr(code)).lower()
        if len(lower) == 1 and ord(lower) != code:
            out[code] = ord(lower)
    out[0x130] = ord("i")  # its lower case has two characters; the simple one is a plain i
    return out


def fold(text: str) -> str:
    """Of the same length as the text; equal for texts that differ in case only."""
    return text.lower() if text.isascii() else text.translate(_folds())


def _caseless(term: str) -> bool:
    """A single character without an upper case of its own; the engine compares it as it is."""
    upper = term.upper() if len(term) == 1 else ""
    return len(term) == 1 and (upper if len(upper) == 1 else term) == fold(term)


class Terms:
    """The rules of one automaton, ready to run on texts."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = rules
        exact, folded = (ahocorasick.Automaton(ahocorasick.STORE_INTS) for _ in range(2))
        self.lengths = array("I")
        self.more: dict[int, list[int]] = {}  # rules with the term of an earlier one
        self.skipped = []
        letters: set[str] = set()
        for i, (term, case) in enumerate(rules.terms() if isinstance(rules, RuleTable) else ((rule[4], rule[6]) for rule in rules)):
            self.lengths.append(len(term))
            if not term:
                self.skipped.append((i, 0))
                continue
            letters.update(term)
            automaton, key = (exact, term) if case or (len(term) == 1 and _caseless(term)) else (folded, fold(term))
            first = automaton.get(key, None)
            if first is None:
                automaton.add_word(key, i)
            else:
                self.more.setdefault(first, []).append(i)
        self.letters = set(fold("".join(letters)))
        self.automata = [(automaton is exact, automaton) for automaton in (exact, folded) if len(automaton)]
        for _, automaton in self.automata:
            automaton.make_automaton()
        self._inert: dict[str, bool] = {}

    def inert(self, new: str) -> bool:
        """Whether a replacement takes part in no later match.

        A match that takes part of a replacement holds its first or its last character, or lies inside it.
        """
        if new not in self._inert:
            ends = bool(new) and fold(new[0]) not in self.letters and fold(new[-1]) not in self.letters
            self._inert[new] = ends and not self.matches(new)
        return self._inert[new]

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """``(rule, start, end)`` of every occurrence of every term."""
        found = []
        for as_is, automaton in self.automata:
            for last, rule in automaton.iter(text if as_is else fold(text)):
                start = last + 1 - self.lengths[rule]
                found.append((rule, start, last + 1))
                if rule in self.more:
                    found += [(other, start, last + 1) for other in self.more[rule]]
        return found

    def apply(self, text: str) -> tuple[str, list[tuple[int, int]]]:
        """The text after all rules, and ``(rule, count)`` of those that matched, in order."""
        found = sorted(self.matches(text))
        if not found:
            return text, []
        if all(self.inert(self.rules[rule][5]) for rule in {f[0] for f in found}):
            return self._claimed(text, found)
        counts, done = [], -1
        while True:
            rule = min((f[0] for f in found if f[0] > done), default=None)
            if rule is None:
                return text, counts
            text, counted = self._claimed(text, [f for f in found if f[0] == rule])
            counts += counted
            found, done = sorted(self.matches(text)), rule

    def _claimed(self, text: str, found: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int]]]:
        """Earlier rules first, within a rule from the left; what is claimed is replaced."""
        if len(found) == 1:
            ((rule, start, end),) = found
            return text[:start] + self.rules[rule][5] + text[end:], [(rule, 1)]
        taken = bytearray(len(text))
        spans, counts = [], {}
        for rule, start, end in found:
            if not any(taken[start:end]):
                taken[start:end] = b"\1" * (end - start)
                spans.append((start, end, rule))
                counts[rule] = counts.get(rule, 0) + 1
        out, at = [], 0
        for start, end, rule in sorted(spans):
            out += [text[at:start], self.rules[rule][5]]
            at = end
        return "".join([*out, text[at:]]), sorted(counts.items())


class RuleTable(Sequence):
    """Packed literal rules ``(id, term, shown replacement, replacement, whether case counts)``; one is read when it is asked for."""

    MARK = b"rules:"

    def __init__(self, packed: bytes):
        table = pa.ipc.open_stream(memoryview(packed)[len(self.MARK) :]).read_all()
        self.columns = [pa.concat_arrays(column.chunks) for column in table.columns]
        self._rule = lru_cache(10_000)(partial(self._read, self.columns))  # one that matched is asked for several times

    @classmethod
    def pack(cls, batches: list[pa.RecordBatch]) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for batch in batches:
                out.write_batch(batch)
        return cls.MARK + sink.getvalue().to_pybytes()

    def __len__(self) -> int:
        return len(self.columns[0])

    def __getitem__(self, i: int) -> Rule:
        return self._rule(i)

    @staticmethod
    def _read(columns: list[pa.Array], i: int) -> Rule:
        name, term, shown, new, case = (column[i].as_py() for column in columns)
        return name, term, re.escape(term), shown, term, new, case

    def terms(self) -> Iterator[tuple[str, bool]]:
        some = pc.any(self.columns[4]).as_py()
        for start in range(0, len(self), 65536):
            terms, cased = (self.columns[k].slice(start, 65536) for k in (1, 4))
            yield from zip(terms.to_pylist(), cased.to_pylist() if some else repeat(False))


def packed_rules(rules: DataFrame) -> DataFrame:
    """``(packed)``: the literal rules of a table ``(place, id, term, shown, new, cased)`` in order, a row per portion.

    Rules of an equal ``place`` are in the order of their other columns.
    """
    columns, most = ["id", "term", "shown", "new", "cased"], AUTOMATON_CHARS
    sized = rules.withColumn("_chars", (F.length("term") + F.length("new")).cast("long"))
    total = sized.agg(F.coalesce(F.sum("_chars"), F.lit(0)).alias("n")).first()["n"]
    order = ["place", *columns]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        portion = lambda held: pa.RecordBatch.from_pydict({"packed": [RuleTable.pack(held)]})
        held, size = [], 0
        for batch in batches:
            start, plain = 0, batch.select(columns)
            for i, chars in enumerate(batch.column("_chars").to_pylist()):
                if size and size + chars > most:
                    yield portion([*held, plain.slice(start, i - start)])
                    held, size, start = [], 0, i
                size += chars
            held.append(plain.slice(start))
        if size:
            yield portion(held)

    ordered = sized.repartitionByRange(max(1, -(-total // most)), *order).sortWithinPartitions(*order)
    return ordered.select(*columns, "_chars").mapInArrow(pack, "packed binary")


def _portions(rules: list[Rule]) -> Iterator[list[Rule]]:
    held, size = [], 0
    for rule in rules:
        length = len(rule[4]) + len(rule[5])
        if held and size + length > AUTOMATON_CHARS:
            yield held
            held, size = [], 0
        held.append(rule)
        size += length
    if held:
        yield held


def _shared(spark: SparkSession, rules: list[Rule] | DataFrame) -> Iterator[Broadcast]:
    """The rules in portions of ``AUTOMATON_CHARS``, each a broadcast of packed bytes.

    A table of rules is packed by the executors; the driver sees one packed portion at a time.
    """
    if isinstance(rules, list):
        for portion in _portions(rules):
            yield spark.sparkContext.broadcast(zlib.compress(pickle.dumps(portion), 1))
        return
    for row in rules.toLocalIterator():
        yield spark.sparkContext.broadcast(bytes(row["packed"]))


def _unpacked(packed: bytes) -> Sequence[Rule]:
    return RuleTable(packed) if packed.startswith(RuleTable.MARK) else pickle.loads(zlib.decompress(packed))


def _held(batches: Iterator[pd.Series], chars: int) -> Iterator[list[pd.Series]]:
    """Batches in groups of about so many characters."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += sum(ROW_CHARS + len(text) for text in batch if text is not None) + ROW_CHARS * int(batch.isna().sum())
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def apply_terms(df: DataFrame, rules: list[Rule] | DataFrame, text: Column, output: str) -> DataFrame:
    """Adds ``output``, a struct ``text, log``: the text after the rules in order, an entry per rule that matched.

    A null text stays null and logs skipped rules only.  ``rules`` is a list, or a table made
    by ``packed_rules``, of which the driver never holds more than a portion.  The rules are
    broadcast in portions of ``AUTOMATON_CHARS``.  A task builds one automaton at a time, over a
    portion, for all texts that it holds; where there are several portions it holds about
    ``HELD_CHARS`` of them, and rows are merged into as few tasks as that asks for.
    """
    portions = list(_shared(df.sparkSession, rules))
    most = HELD_CHARS if len(portions) > 1 else 0
    if most and not df.isStreaming:
        size = df.agg(F.coalesce(F.sum(F.coalesce(F.length(text), F.lit(0)) + F.lit(ROW_CHARS)), F.lit(0)).alias("n")).first()["n"]
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // most)))

    @F.pandas_udf("text string, log array<struct<ruleId:string,originalTermDisplay:string,appliedPattern:string,replacedWith:string,count:bigint>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        terms = None
        for held in _held(batches, most):
            texts = [text for batch in held for text in batch]
            logs: list[list | None] = [None] * len(texts)
            for shared in portions:
                if terms is None or len(portions) > 1:
                    terms = None  # its room is free before the next is built
                    terms = Terms(_unpacked(shared.value))
                for i, text in enumerate(texts):
                    counts = []
                    if text is not None:
                        texts[i], counts = terms.apply(text)
                    if counts or terms.skipped:
                        logs[i] = (logs[i] or []) + [(*terms.rules[rule][:4], n) for rule, n in sorted(counts + terms.skipped)]
            start = 0
            for batch in held:
                end = start + len(batch)
                yield pd.DataFrame({"text": pd.Series(texts[start:end], dtype=object), "log": pd.Series([log or [] for log in logs[start:end]], dtype=object)})
                start = end

    return df.withColumn(output, run(text))
