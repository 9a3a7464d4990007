"""Shared helpers: UTF-8 columns as numpy arrays, word bounds, span hashes, row keys, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.operators.numbering import stash

# Bytes of text that are hashed together; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20
# ASCII white space: what separates words.
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def row_key() -> Column:
    """Key of a document row: equal rows share it, other rows do not, whatever is null."""
    return F.xxhash64(F.col("doc_id"), F.col("text"), F.length("text"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; a null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or one row each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross a row bound."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    gap = _GAP[data]
    begins, ends = ~gap, ~gap
    begins[1:] &= gap[:-1]
    ends[:-1] &= gap[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    begins[inner] = ~gap[inner]
    ends[inner - 1] = ~gap[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(bounds, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def running(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums of 64-bit values, for ``span_hashes``."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power_tables(len(values))[0][: len(values)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the values from each start to each end: equal spans hash alike anywhere."""
    inverse = _power_tables(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(running(byte_values(data)), starts, ends)


def contracted(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Edges ``a``, ``b`` (``a`` > ``b``) that connect the same nodes, drawn towards the smallest node.

    Alternates large-star and small-star steps until every node has one edge, to the
    smallest node of its component, with a written table per round; no group of
    neighbours is ever gathered.  After a given number of ``rounds`` it stops short.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    seen, turn = None, 0
    while rounds is None or turn < rounds:
        edges = stash(edges)  # a plan that grew over rounds would double with each
        if rounds is None:
            state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == seen or not state[0]:
                break
            seen = state
        turn += 1
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.union(least).distinct()
    return edges.select(F.col("u").alias("a"), F.col("v").alias("b"))


def roots(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node that an edge of contracted edges leads to."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b"))
    return ends.groupBy("node").agg(F.min("root").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node of its component) of every node on an edge ``a``, ``b``."""
    return roots(contracted(edges))
