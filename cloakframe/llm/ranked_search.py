"""Ranked lexical search: MaxScore whose bounds of single terms are tightened by bounds of term pairs.

Index time.  Documents are gathered to blocks where they lie; a block keeps, per term,
the documents with their frequencies.  From the statistics of all documents every block
then gets its impacts (the score that a term adds to a document), per term the largest
one, and, for the pairs of terms that stand side by side in the order of weight of some
item, an intersection entry: how many documents hold both and the largest sum that the
two reach together.  The entries of all blocks are the pair's intersection list.

Query time.  A block's bound on what the lighter terms of an item can still add is the
least over all ways to cover them by pairs and single terms: a pair counts with
max(largest of either, largest joint sum), which is less than the sum of both unless some
document takes both at once.  Terms are read from the heaviest to the lightest; as soon
as the bound of the rest is below the k-th score, only documents met so far are looked
up in the remaining lists, and those that cannot reach it are dropped.  A block whose
whole bound is below the k-th score is not read.  The k-th score runs on over the blocks
of a task; tasks' best rows are ranked per item at the end.

Nothing is shuffled but document frequencies and k rows per item and task.  The items
are the stated query set: their terms are broadcast in portions of ``ITEM_BYTES``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.operators.numbering import stash

from .tokens import byte_set, encode, pack, shards, unpack

# Text of the items that are searched in one pass over the index; more items take more passes.
ITEM_BYTES = 4 << 20
# Documents of a block.
BLOCK_ROWS = 8192
# Bytes between the terms `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`.
_BETWEEN = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_POSTINGS = "n_docs long, n_terms long, lens array<long>, nulls array<boolean>, ids array<long>, terms array<int>, dfs array<long>, docs binary, tfs binary"
_INDEX = "ids array<long>, nulls array<boolean>, terms array<int>, dfs array<long>, most array<long>, docs binary, impacts binary, pairs array<int>, both array<long>, joint array<long>"


def _terms(texts: list[str | None]) -> list[list[bytes]]:
    """Distinct terms of each text, in order."""
    found = encode(pa.array(texts, pa.string()), _BETWEEN)
    words = found.vocabulary.to_pylist()
    return [[words[i] for i in dict.fromkeys(found.ids[a:b].tolist())] for a, b in zip(found.bounds[:-1], found.bounds[1:])]


def _posted(terms: list[bytes]) -> Callable:
    """Blocks with the postings of the given terms; every other term counts for the lengths only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(terms, pa.large_binary())
        for shard in shards(batches):
            for at in range(0, shard.num_rows, BLOCK_ROWS):
                yield _block(shard.slice(at, BLOCK_ROWS), wanted)

    return run


def _block(rows: pa.Table, wanted: pa.Array) -> pa.RecordBatch:
    found = encode(rows.column("text").combine_chunks(), _BETWEEN)
    lengths = np.diff(found.bounds)
    term = np.asarray(pc.index_in(found.vocabulary, value_set=wanted).fill_null(-1), np.int64)[found.ids]
    doc = np.repeat(np.arange(len(lengths)), lengths)
    kept = term >= 0
    key, tfs = np.unique(term[kept] * len(lengths) + doc[kept], return_counts=True)
    terms, dfs = np.unique(key // len(lengths), return_counts=True)
    ids = rows.column("doc_id").combine_chunks().cast(pa.int64())
    return pa.RecordBatch.from_pylist([{
        "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum()), "lens": lengths.tolist(),
        "ids": ids.fill_null(0).to_pylist(), "nulls": ids.is_null().to_pylist(),
        "terms": terms.tolist(), "dfs": dfs.tolist(), "docs": pack(key % len(lengths)), "tfs": pack(tfs),
    }], schema=_arrow(_POSTINGS))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = (f.split() for f in schema.split(", "))
    return pa.schema([(n, pa.list_(kinds[k[6:-1]]) if k.startswith("array") else kinds[k]) for n, k in fields])


def weight(n_docs: int, df: int) -> int:
    """floor(1000 ln((2N + 2) / (2 df + 1)))."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _indexed(weights: np.ndarray, pairs: np.ndarray, n_docs: int, n_terms: int) -> Callable:
    """Blocks of postings to blocks of impacts with their bounds for terms and pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lens, inverse = np.unique(np.array(row["lens"], np.int64), return_inverse=True)
                damping = np.array([10 + 90 * int(n) * n_docs // max(n_terms, 1) for n in lens], np.int64)[inverse]
                docs, tfs, dfs = unpack(row["docs"]), unpack(row["tfs"]), np.array(row["dfs"], np.int64)
                terms = np.array(row["terms"], np.int64)
                impacts = np.repeat(weights[terms], dfs) * (1_000_000_000 * tfs // (1000 * tfs + 8 * damping[docs]))
                ends = np.cumsum(dfs)
                lists = {int(t): (docs[e - n : e], impacts[e - n : e]) for t, n, e in zip(terms, dfs, ends)}
                number, both, joint = [], [], []
                row_of = np.zeros(len(row["lens"]), np.int64)
                here = np.flatnonzero(np.isin(pairs[:, 0], terms) & np.isin(pairs[:, 1], terms))
                for p in here[np.argsort(pairs[here, 0], kind="stable")].tolist():
                    (a, x), (b, y) = lists[int(pairs[p, 0])], lists[int(pairs[p, 1])]
                    row_of[a] = x
                    other = row_of[b]
                    meet = other > 0
                    if meet.any():
                        number.append(p)
                        both.append(int(meet.sum()))
                        joint.append(int((other[meet] + y[meet]).max()))
                    row_of[a] = 0
                yield pa.RecordBatch.from_pylist([{
                    "ids": row["ids"], "nulls": row["nulls"], "terms": row["terms"], "dfs": row["dfs"], "docs": row["docs"], "impacts": pack(impacts),
                    "most": np.maximum.reduceat(impacts, ends - dfs).tolist() if len(terms) else [],
                    "pairs": number, "both": both, "joint": joint,
                }], schema=_arrow(_INDEX))

    return run


@dataclass
class Block:
    """One block of the index, ready to be searched."""

    ids: np.ndarray
    nulls: np.ndarray
    lists: dict[int, tuple[np.ndarray, np.ndarray]]
    most: dict[int, int]
    joint: dict[int, int]

    @classmethod
    def of(cls, row: dict) -> Block:
        docs, impacts, ends = unpack(row["docs"]), unpack(row["impacts"]), np.cumsum(np.array(row["dfs"], np.int64))
        lists = {t: (docs[e - n : e], impacts[e - n : e]) for t, n, e in zip(row["terms"], row["dfs"], ends)}
        return cls(
            np.array(row["ids"], np.int64), np.array(row["nulls"], bool), lists,
            dict(zip(row["terms"], row["most"])), dict(zip(row["pairs"], row["joint"])),
        )


def bounds(most: list[int], joint: list[int | None]) -> list[int]:
    """Per prefix of the terms, the most that one document can get from them.

    ``joint[i]`` is the largest sum of the terms i - 1 and i, None if no document holds both.
    """
    out = [0]
    for i, u in enumerate(most):
        best = out[i] + u
        if i:
            best = min(best, out[i - 1] + max(u, most[i - 1], joint[i] or 0))
        out.append(best)
    return out


class Best:
    """The k best documents of one item so far: best score first, ties to the smaller id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.nulls = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def floor(self) -> int:
        """A document below it is not among the k best; 1 as long as there are fewer."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        scores, ids, nulls = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.nulls, nulls)))
        keep = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.ids, self.nulls = scores[keep], ids[keep], nulls[keep]


def search_block(block: Block, terms: list[int], pair_of: list[int], best: Best, paired: bool = True) -> tuple[int, int]:
    """Search one item in one block; ``(postings read, postings of its terms)``.

    ``terms`` are the item's, lightest first; ``pair_of[i]`` is the number of the pair of
    the terms i - 1 and i.  Without ``paired`` the bounds are those of single terms.
    """
    here = [(i, t) for i, t in enumerate(terms) if t in block.lists]
    total = sum(len(block.lists[t][0]) for _, t in here)
    if not here:
        return 0, 0
    most, joint = [], []
    for n, (i, t) in enumerate(here):
        most.append(block.most[t])
        beside = paired and n and here[n - 1][0] == i - 1
        joint.append(block.joint.get(pair_of[i]) if beside else most[n] + (most[n - 1] if n else 0))
    rest = bounds(most, joint)
    least = best.floor()
    if rest[-1] < least:
        return 0, total
    sums = np.zeros(len(block.ids), np.int64)
    j, read = len(here), 0
    while j and rest[j] >= least:
        docs, impacts = block.lists[here[j - 1][1]]
        sums[docs] += impacts
        read, j = read + len(docs), j - 1
        if len(sums) >= best.k:
            least = max(least, int(np.partition(sums, len(sums) - best.k)[len(sums) - best.k]))
    left = np.flatnonzero((sums > 0) & (sums + rest[j] >= least))
    while j and len(left):
        docs, impacts = block.lists[here[j - 1][1]]
        at = np.minimum(np.searchsorted(docs, left), len(docs) - 1)
        sums[left] += np.where(docs[at] == left, impacts[at], 0)
        read, j = read + min(len(left), len(docs)), j - 1
        left = left[sums[left] + rest[j] >= least]
    if len(left):
        best.add(sums[left], block.ids[left], block.nulls[left])
    return read, total


def _searched(items: list[list[int]], pair_of: list[list[int]], k: int) -> Callable:
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(row)
                for terms, pairs, found in zip(items, pair_of, best):
                    search_block(block, terms, pairs, found)
        item = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        if not best:
            return
        ids = pa.array(np.concatenate([b.ids for b in best]), mask=np.concatenate([b.nulls for b in best]))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), ids, pa.array(np.concatenate([b.scores for b in best]))], schema=schema)

    return run


def build_postings(documents: DataFrame, terms: list[bytes]) -> DataFrame:
    """A written table of blocks with the postings of ``terms``."""
    return stash(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_posted(terms), _POSTINGS))


def _search(documents: DataFrame, rows: list, kind: T.DataType, k: int) -> DataFrame:
    spark = documents.sparkSession
    asked = _terms([r["text"] for r in rows])
    terms = list(dict.fromkeys(t for ts in asked for t in ts))
    number = {t: i for i, t in enumerate(terms)}
    postings = build_postings(documents, terms)
    n_docs, n_terms = (int(x or 0) for x in postings.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    # At most a row per term of the items.
    each = postings.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy("t.terms").agg(F.sum("t.dfs").alias("df"))
    dfs = {r["terms"]: r["df"] for r in each.collect()}
    weights = np.array([weight(n_docs, dfs.get(i, 0)) for i in range(len(terms))], np.int64)
    items = [sorted((number[t] for t in ts), key=lambda t: (weights[t], t)) for ts in asked]
    pairs: dict[tuple[int, int], int] = {}
    pair_of = [[pairs.setdefault((a, b), len(pairs)) if i else -1 for i, (a, b) in enumerate(zip([-1, *ts], ts))] for ts in items]
    numbered = np.array(list(pairs) or np.zeros((0, 2)), np.int64).reshape(-1, 2)
    index = stash(postings.mapInArrow(_indexed(weights, numbered, n_docs, n_terms), _INDEX))
    best = index.mapInArrow(_searched(items, pair_of, k), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind)]))
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(documents: DataFrame, items: DataFrame, k: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The ``k`` best documents of every item: ``item_id, rank, doc_id, score``.

    ``documents`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` (of any type) and
    ``text``; other columns are ignored.  A null or termless text of an item finds nothing,
    one of a document is never found and does not count as a document.  Repeated rows are
    documents, or items, of their own.  A document with a null id ranks last among equal
    scores.  Empty tables return no row.  Items beyond ``item_bytes`` of text are searched
    in several passes, each with the statistics of all documents.
    """
    asked = items.select("item_id", F.col("text").cast("string").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // item_bytes) or 1
    chosen = [asked.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == i) if parts > 1 else asked for i in range(parts)]
    found = [_search(documents, part.collect(), asked.schema["item_id"].dataType, k) for part in chosen]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
