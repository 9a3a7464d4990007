"""Katz backoff language model: Good-Turing discounted counts with exactly normalised backoff weights.

The model over the known words, the end of a text and one unknown word:

    P(w | v) = d(c(vw)) c(vw) / (c(v) + KEPT)      if vw was seen
    P(w | v) = alpha(v) P(w)                       if only v was seen
    P(w | v) = P(w)                                if v was not seen
    P(w)     = d(c(w)) c(w) / (N + KEPT), the rest of the mass for the unknown word

``d`` discounts counts up to 5 by Good-Turing (from the counts of counts of all words, or
pairs), and alpha(v) = (1 - sum of P(w | v) over the words seen after v) / (1 - sum of
their P(w)), so that P( | v) sums to 1 for every v.  ``KEPT`` leaves a context whose counts
are all above 5 a little mass.  The end of a text is the context of the next one's first word.

Counts live in partitioned tables; only texts of a shard and their answers meet:

1. A shard of texts is written as numbers of its own vocabulary, and asks the ranges of
   the word table (dealt by hash) for the counts of its words.
2. With them it scores unknown contexts itself, and sends its distinct pairs to the ranges
   of the pair table, dealt by context; the pairs of a frequent context are split by their
   second word.  All shards' counts of a pair are summed there.
3. Whatever does not depend on the discounts of pairs is summed per text at once.  What
   does: how many counts of 1 to 5 a text met (one number each), and the contexts that it
   backed off from, whose weights are joined from a table of contexts.

Words are compared as words, never by hash.  Every text is scored, every training text counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.operators.numbering import stash

from .common import mix
from .tokens import SPACES, encode, hashes, pack, pack_words, shards, unpack, unpack_words

# Counts up to this one are discounted.
DISCOUNTED = 5
# Added to the count of every context.
KEPT = 0.01
# Training tokens whose pairs meet in one range of the pair table.
RANGE_TOKENS = 1 << 20
# Occurrences of a context from which its pairs are split over several ranges.
FREQUENT = 1 << 20

_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
_SHARD = "shard long, range int, words binary, counts binary, ids array<long>, held array<boolean>"
_ANSWER = "shard long, range int, numbers binary, counts binary, stats array<long>"
_PAIRS = "shard long, range int, v binary, runs binary, cv binary, w binary, cw binary, train binary, met binary, docs binary, ids array<long>, held array<boolean>, base binary, score binary"
_MODEL = "kind string, shard long, range int, docs binary, score binary, classes binary, ids array<long>, held array<boolean>, base binary, v long, doc int, n long, m array<long>, c long, p double, stats array<long>"


def _arrow(schema: str) -> pa.Schema:
    fields = (f.split() for f in schema.split(", "))
    kind = lambda k: pa.string() if k == "string" else pa.list_(_KINDS[k[6:-1]]) if k.startswith("array") else _KINDS[k]
    return pa.schema([(n, kind(k)) for n, k in fields])


def discounts(of_count: list[int]) -> np.ndarray:
    """Factors d(0) .. d(5) from the numbers of types that occur once, twice, ... six times.

    Good-Turing with the largest k up to 5 for which all factors lie in (0, 1]; counts of
    a small or odd corpus that allow none are discounted by a constant below 1.
    """
    n = [0, *of_count]
    for k in range(DISCOUNTED, 1, -1):
        if all(n[1 : k + 2]) and (k + 1) * n[k + 1] < n[1]:
            a = (k + 1) * n[k + 1] / n[1]
            d = [((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) for r in range(1, k + 1)]
            if all(0 < x <= 1 for x in d):
                return np.array([0.0, *d, *[1.0] * (DISCOUNTED - k)])
    off = min(0.9, n[1] / (n[1] + 2 * n[2])) if n[1] and n[2] else 0.5
    return np.array([0.0, *((r - off) / r for r in range(1, DISCOUNTED + 1))])


class Unigrams:
    """P(w) from a word's count."""

    def __init__(self, tokens: int, types: int, of_count: list[int]):
        self.tokens, self.types, self.factors = tokens, types, discounts(of_count)
        seen = tokens - sum((1 - self.factors[r]) * r * of_count[r - 1] for r in range(1, DISCOUNTED + 1))
        self.unknown = 1 - seen / (tokens + KEPT)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        factor = np.where(counts > DISCOUNTED, 1.0, self.factors[np.minimum(counts, DISCOUNTED)])
        return np.where(counts > 0, factor * counts / (self.tokens + KEPT), self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the add-0.1 estimate."""
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


def _streams(ranges: int) -> Callable:
    schema = _arrow(_SHARD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in enumerate(shards(batches)):
            shard = (TaskContext.get().partitionId() << 24) + number
            found = encode(rows.column("text").combine_chunks(), SPACES)
            # The end of a text is the empty word.  Words are numbered range by range.
            words = pa.concat_arrays([found.vocabulary.cast(pa.large_binary()), pa.array([b""], pa.large_binary())])
            ranged = (hashes(words.to_pylist()) % np.uint32(ranges)).astype(np.int64)
            order = np.argsort(ranged, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            sizes = np.diff(found.bounds) + 1
            ends = np.cumsum(sizes) - 1
            stream = np.empty(int(sizes.sum()), np.int64)
            inner = np.ones(len(stream), bool)
            inner[ends] = False
            stream[inner], stream[ends] = place[found.ids], place[-1]
            held = rows.column("held").combine_chunks()
            train = np.repeat(~held.to_numpy(zero_copy_only=False), sizes)
            counts = np.bincount(stream[train], minlength=len(order))
            out = [{"shard": shard, "range": -1, "words": pack(stream), "counts": pack(sizes), "ids": rows.column("doc_id").to_pylist(), "held": held.to_pylist()}]
            words, ranged = words.take(pa.array(order)), ranged[order]
            stops = np.flatnonzero(np.append(np.diff(ranged), 1)) + 1
            for a, b in zip([0, *stops[:-1]], stops):
                out.append({"shard": shard, "range": int(ranged[a]), "words": pack_words(words.slice(a, b - a)), "counts": pack(counts[a:b])})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _of_count(counts: np.ndarray) -> list[int]:
    """How many are 1, 2, ... 6."""
    return np.bincount(np.minimum(counts, DISCOUNTED + 2), minlength=DISCOUNTED + 2)[1 : DISCOUNTED + 2].tolist()


def _word_range(ranges: int) -> Callable:
    """Sum a range of the word table, number its known words, answer every shard in the order it asked."""
    schema = _arrow(_ANSWER)

    def run(asks: pa.Table) -> pa.Table:
        at = asks.column("range")[0].as_py()
        lists = [unpack_words(b) for b in asks.column("words").to_pylist()]
        own = np.concatenate([unpack(b) for b in asks.column("counts").to_pylist()])
        merged = pa.chunked_array(lists).dictionary_encode().unify_dictionaries()
        ids = np.concatenate([c.indices.to_numpy() for c in merged.chunks])
        totals = np.zeros(len(merged.chunk(0).dictionary), np.int64)
        np.add.at(totals, ids, own)
        known = totals > 0
        number = np.where(known, np.cumsum(known) * ranges + at, 0)
        stops = np.cumsum([len(x) for x in lists])
        out = [
            {"shard": shard, "range": at, "numbers": pack(number[ids[a:b]]), "counts": pack(totals[ids[a:b]])}
            for shard, a, b in zip(asks.column("shard").to_pylist(), [0, *stops[:-1]], stops)
        ]
        out.append({"shard": -1, "range": at, "stats": [int(totals.sum()), int(known.sum()), *_of_count(totals)]})
        return pa.Table.from_pylist(out, schema=schema)

    return run


def _pairs(model: Unigrams, ranges: int, frequent: int) -> Callable:
    """The shard's distinct pairs for every range of the pair table, and its texts with what needs no pair."""
    schema = _arrow(_PAIRS)

    def run(streams: pa.Table, answers: pa.Table) -> pa.Table:
        if not streams.num_rows:
            return schema.empty_table()
        row = streams.to_pylist()[0]
        answers = answers.sort_by("range")
        number = np.concatenate([unpack(b) for b in answers.column("numbers").to_pylist()])
        count = np.concatenate([unpack(b) for b in answers.column("counts").to_pylist()])
        stream, sizes = unpack(row["words"]).astype(np.int32), unpack(row["counts"])
        n = len(sizes)
        doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
        held = np.array(row["held"], bool)
        before = np.concatenate([stream[-1:], stream[:-1]])
        alone = count[before] == 0
        stats = np.stack([
            sizes, np.bincount(doc, count[stream] > 0, n), np.bincount(doc, model.base(count)[stream], n),
        ]).astype(np.float64)
        score = np.bincount(doc[alone], np.log10(model(count))[stream[alone]], n)
        out = [{"shard": row["shard"], "range": -1 - row["shard"] % ranges, "ids": row["ids"], "held": row["held"], "base": stats.tobytes(), "score": score.tobytes()}]
        width = len(number) + 1
        stream[count[stream] == 0] = width - 1
        key, doc = (before.astype(np.int64) * width + stream)[~alone], doc[~alone]
        del stream, before, alone
        order = np.argsort(key, kind="stable")
        key, docs = key[order], doc[order]
        del order, doc
        first = np.flatnonzero(np.append(True, np.diff(key) != 0)) if len(key) else np.zeros(0, np.int64)
        met = np.diff(np.append(first, len(key)))
        train = np.add.reduceat((~held[docs]).astype(np.int64), first) if len(first) else first
        number, count = np.append(number, 0), np.append(count, 0)
        v, w = key[first] // width, key[first] % width
        cv, cw, v, w = count[v], count[w], number[v], number[w]
        split = mix(w.astype(np.uint64)) % (1 + cv // frequent).astype(np.uint64)
        ranged = (mix(mix(v.astype(np.uint64)) + split) % np.uint64(ranges)).astype(np.int64)
        by_range = np.argsort(ranged, kind="stable")
        docs = docs[np.argsort(np.repeat(ranged, met), kind="stable")]
        ranged, v, w, cv, cw, train, met = (x[by_range] for x in (ranged, v, w, cv, cw, train, met))
        places = np.concatenate([[0], np.cumsum(met)])
        stops = np.flatnonzero(np.append(np.diff(ranged), 1)) + 1 if len(ranged) else []
        for a, b in zip([0, *stops[:-1]], stops):
            runs = np.flatnonzero(np.append(True, np.diff(v[a:b]) != 0))
            out.append({
                "shard": row["shard"], "range": int(ranged[a]), "v": pack(v[a:b][runs]), "runs": pack(np.diff(np.append(runs, b - a))), "cv": pack(cv[a:b][runs]),
                "w": pack(w[a:b]), "cw": pack(cw[a:b]), "train": pack(train[a:b]), "met": pack(met[a:b]), "docs": pack(docs[places[a] : places[b]]),
            })
        return pa.Table.from_pylist(out, schema=schema)

    return run


def _pair_range(model: Unigrams, frequent: int) -> Callable:
    """Sum a range of the pair table; per shard and text what follows from it, and the contexts that were backed off from.

    Rows of texts pass through.
    """
    schema = _arrow(_MODEL)

    def run(asks: pa.Table) -> pa.Table:
        rows = asks.to_pylist()
        if rows[0]["range"] < 0:
            return pa.Table.from_pylist([{"kind": "shard"} | {k: r[k] for k in ("shard", "range", "ids", "held", "base", "score")} for r in rows], schema=schema)
        rows.sort(key=lambda r: r["shard"])
        del asks
        # A packed column goes as soon as it is unpacked; places in this range's tables take four bytes.
        lists = lambda name: [unpack(r.pop(name)) for r in rows]
        join = lambda name: np.concatenate(lists(name))
        contexts, context = np.unique(join("v"), return_inverse=True)
        c = np.zeros(len(contexts), np.int64)
        c[context] = join("cv")
        context = np.repeat(context.astype(np.int32), join("runs"))
        words, word = np.unique(join("w"), return_inverse=True)
        word = context.astype(np.int64) * len(words) + word
        n_words = len(words)
        del words
        pairs, first, pair = np.unique(word, return_index=True, return_inverse=True)
        first, pair = first.astype(np.int32), pair.astype(np.int32)
        del word
        totals = np.zeros(len(pairs), np.int64)
        np.add.at(totals, pair, join("train"))
        cw = join("cw")
        # The contexts: counts of counts, mass of the words seen after them.
        owner, seen = pairs // n_words, totals > 0
        del pairs
        p = np.bincount(owner[seen], model(cw[first])[seen], len(contexts))
        small = seen & (totals <= DISCOUNTED)
        m = np.bincount(owner[small] * DISCOUNTED + totals[small] - 1, minlength=len(contexts) * DISCOUNTED).reshape(-1, DISCOUNTED)
        del owner, seen, small, first
        # The texts: pairs that were seen are scored but for their discount, the others are backed off.
        r = totals[pair]
        del pair
        value = np.empty(len(r))
        value[r > 0] = np.log10(r[r > 0]) - np.log10(c + KEPT)[context[r > 0]]
        value[r == 0] = np.log10(model(cw[r == 0]))
        del cw
        mets = lists("met")
        shard = np.repeat(np.arange(len(rows)), [len(x) for x in mets])
        met = np.concatenate(mets)
        docs = join("docs")
        entry = np.repeat(np.arange(len(met), dtype=np.int32), met)
        del mets, met
        cells, cell = np.unique((shard[entry] << 32) + docs, return_inverse=True)
        cell = cell.astype(np.int32)
        score = np.bincount(cell, value[entry], len(cells))
        del value
        low = (r[entry] > 0) & (r[entry] <= DISCOUNTED)
        classes = np.bincount(cell[low].astype(np.int64) * DISCOUNTED + r[entry[low]] - 1, minlength=len(cells) * DISCOUNTED).reshape(-1, DISCOUNTED)
        del cell, low
        numbers = [x["shard"] for x in rows]
        stops = np.searchsorted(cells, np.arange(1, len(rows) + 1) << 32)
        out = [
            {"kind": "texts", "shard": s, "range": rows[0]["range"], "docs": pack(cells[a:b] & 0xFFFFFFFF), "score": score[a:b].tobytes(), "classes": pack(classes[a:b].ravel())}
            for s, a, b in zip(numbers, [0, *stops[:-1]], stops)
        ]
        out.append({"kind": "stats", "stats": _of_count(totals)})
        back = np.flatnonzero(r[entry] == 0)
        uses, n = np.unique(np.stack([context[entry[back]], shard[entry[back]], docs[back]]), axis=1, return_counts=True) if len(back) else (np.zeros((3, 0), np.int64), np.zeros(0, np.int64))
        needed = np.zeros(len(contexts), bool)
        needed[uses[0]] = True
        needed |= c >= frequent
        at = np.flatnonzero(needed)
        tables = [pa.Table.from_pylist(out, schema=schema)]
        tables.append(_filled(schema, len(n), kind=["use"] * len(n), v=contexts[uses[0]], shard=np.array(numbers, np.int64)[uses[1]], doc=uses[2].astype(np.int32), n=n))
        tables.append(_filled(schema, len(at), kind=["context"] * len(at), v=contexts[at], c=c[at], p=p[at], m=list(m[at])))
        return pa.concat_tables(tables)

    return run


def _filled(schema: pa.Schema, rows: int, **columns) -> pa.Table:
    """Rows with the given columns, null elsewhere."""
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema]
    return pa.Table.from_arrays(arrays, schema=schema)


def _texts(factors: np.ndarray) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(rows: pa.Table) -> pa.Table:
        parts = sorted(rows.to_pylist(), key=lambda r: (r["kind"], r["range"] or 0, r["doc"] or 0))
        own = next(r for r in parts if r["kind"] == "shard")
        stats = np.frombuffer(own["base"], np.float64).reshape(3, -1)
        score = np.frombuffer(own["score"], np.float64).copy()
        for part in parts:
            if part["kind"] == "texts":
                docs = unpack(part["docs"])
                score[docs] += np.frombuffer(part["score"], np.float64) + unpack(part["classes"]).reshape(-1, DISCOUNTED) @ np.log10(factors[1:])
            elif part["kind"] == "back":
                score[part["doc"]] += part["p"]
        return pa.table([
            pa.array(own["ids"], pa.int64()), pa.array(own["held"], pa.bool_()), pa.array(stats[0].astype(np.int64)), pa.array(stats[1].astype(np.int64)), pa.array(stats[2]), pa.array(score),
        ], schema=schema)

    return run


def score_texts(documents: DataFrame, held_out, frequent: int = FREQUENT) -> DataFrame:
    """Every text under a bigram Katz model of the others: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``documents`` has ``doc_id`` and ``text``, other columns are ignored; texts for which the
    Column ``held_out`` is false or null are learned from.  A null or empty text is one end
    token.  Repeated rows are texts of their own, learned from each time.  Without training
    texts every token has probability 1.  An empty table returns no row.
    """
    spark = documents.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held")
    )
    streams = stash(docs.mapInArrow(_streams(ranges), _SHARD))
    answers = stash(streams.where("range >= 0").select("shard", "range", "words", "counts").groupBy("range").applyInArrow(_word_range(ranges), _ANSWER))
    tokens, types, *of_count = _summed(answers, DISCOUNTED + 3)
    model = Unigrams(tokens, types, of_count)
    texts = streams.where("range < 0").groupBy("shard")
    answered = answers.where("shard >= 0").select("shard", "range", "numbers", "counts").groupBy("shard")
    asks = texts.cogroup(answered).applyInArrow(_pairs(model, max(1, -(-tokens // RANGE_TOKENS)), frequent), _PAIRS)
    found = stash(asks.groupBy("range").applyInArrow(_pair_range(model, frequent), _MODEL))
    factors = discounts(_summed(found, DISCOUNTED + 1))
    columns = ["kind", "shard", "range", "docs", "score", "classes", "ids", "held", "base", "doc", "p"]
    parts = found.where(F.col("kind").isin("shard", "texts")).select(*columns)
    back = _backed_off(found, factors).withColumns({"kind": F.lit("back"), "range": F.lit(0)})
    given = {f.name: f.dataType for f in parts.schema.fields}
    back = back.select(*[F.col(c) if c in back.columns else F.lit(None).cast(given[c]).alias(c) for c in columns])
    out = parts.unionByName(back).groupBy("shard").applyInArrow(_texts(factors), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _summed(table: DataFrame, n: int) -> list[int]:
    """The first ``n`` statistics of all ranges."""
    sums = [F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(n)]
    return [int(x) for x in table.where(F.col("stats").isNotNull()).agg(*sums).first()]


def _backed_off(found: DataFrame, factors: np.ndarray) -> DataFrame:
    """``shard, doc, p``: the logarithms of the backoff weights that a text met, summed."""
    sums = [F.sum(F.col("m")[i]).alias(f"m{i}") for i in range(DISCOUNTED)]
    contexts = found.where("kind = 'context'").groupBy("v").agg(*sums, F.max("c").alias("c"), F.sum("p").alias("p"))
    lost = sum(((1.0 - float(factors[i + 1])) * (i + 1) * F.col(f"m{i}") for i in range(DISCOUNTED)), F.lit(0.0))
    left = (F.lit(KEPT) + lost) / (F.col("c") + KEPT)
    contexts = stash(contexts.select("v", (F.log10(left) - F.log10(1.0 - F.col("p"))).alias("alpha")))
    uses = found.where("kind = 'use'").select("v", "shard", "doc", "n")
    return uses.join(contexts, "v").groupBy("shard", "doc").agg(F.sum(F.col("n") * F.col("alpha")).alias("p"))
