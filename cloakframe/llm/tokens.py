"""Tokens of text columns as exact dictionary ids, shards of texts, packed integer arrays.

Words are cut with numpy on bytes and encoded by Arrow, so equal ids are equal words: no
hash stands for a word.  Texts are cut in pieces of ``PIECE_BYTES`` at a separator, so a
very long text needs temporary arrays of a piece only, and 4 bytes per word beside them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import utf8

# Bytes of text that are cut into words at once.
PIECE_BYTES = 1 << 21
# Bytes of text that a shard gathers before it is counted; one longer text is a shard of its own.
SHARD_BYTES = 8 << 20
# Rows of a shard, so that a row's number takes 16 bits.
SHARD_ROWS = 1 << 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Mask of the byte values in the given inclusive ranges."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


# Separators of the words `[^\x20\x09-\x0D]+`.
SPACES = byte_set((9, 13), (32, 32))


@dataclass
class Tokens:
    """``ids`` index ``vocabulary``; row r has the tokens ``bounds[r]:bounds[r + 1]``."""

    ids: np.ndarray
    vocabulary: pa.Array
    bounds: np.ndarray
    begins: np.ndarray  # the token is the first of its row, or a break lies before it


def _cuts(data: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges that end behind a separator."""
    at = 0
    while at < len(data):
        stop = min(len(data), at + PIECE_BYTES)
        while stop < len(data):
            near = np.flatnonzero(separators[data[stop : stop + 4096]])
            stop += int(near[0]) + 1 if len(near) else 4096
            if len(near):
                break
        yield at, min(stop, len(data))
        at = min(stop, len(data))


def encode(column: pa.Array, separators: np.ndarray, breaks: np.ndarray | None = None) -> Tokens:
    """Tokens between separator bytes, A-Z lower-cased; a null text has none.

    ``breaks`` are separators that end a piece of the text as well.
    """
    data, row_bounds = utf8(column)
    words, rows, pieces, passed = [], [], [], 0
    for low, high in _cuts(data, separators):
        text = LOWER[data[low:high]]
        inside = ~separators[text]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        inner = row_bounds[np.searchsorted(row_bounds, low, "right") : np.searchsorted(row_bounds, high, "left")] - low
        begins[inner], ends[inner - 1] = inside[inner], inside[inner - 1]
        starts = np.flatnonzero(begins)
        offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(ends) + 1 - starts)]).astype(np.int64)
        words.append(pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(text[inside])]))
        rows.append((np.searchsorted(row_bounds, starts + low, "right") - 1).astype(np.int32))
        if breaks is not None:
            seen = np.cumsum(breaks[text], dtype=np.int64)
            pieces.append(seen[starts] + passed)
            passed += int(seen[-1]) if len(seen) else 0
    encoded = pa.chunked_array(words, pa.large_binary()).dictionary_encode().unify_dictionaries()
    ids = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in encoded.chunks] or [np.zeros(0)]).astype(np.int32)
    vocabulary = encoded.chunk(0).dictionary if encoded.num_chunks else pa.array([], pa.large_binary())
    row = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    first = np.ones(len(ids), bool)
    first[1:] = row[1:] != row[:-1]
    if breaks is not None and len(ids):
        piece = np.concatenate(pieces)
        first[1:] |= piece[1:] != piece[:-1]
    return Tokens(ids, vocabulary, np.searchsorted(row, np.arange(len(row_bounds))), first)


def shards(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.Table]:
    """Batches gathered to tables of about ``SHARD_BYTES`` of text and at most ``SHARD_ROWS`` rows."""
    held, size, rows = [], 0, 0
    for batch in batches:
        at = 0
        _, offsets = utf8(batch.column(text))
        while at < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[at] + SHARD_BYTES - size, "right")) - 1
            stop = min(max(stop, at + (not held)), at + SHARD_ROWS - rows, batch.num_rows)
            if stop > at:
                held.append(batch.slice(at, stop - at))
                size, rows = size + int(offsets[stop] - offsets[at]), rows + stop - at
            if stop < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
            at = stop
    if held:
        yield pa.Table.from_batches(held)


def hashes(words: Iterable[bytes]) -> np.ndarray:
    """A 32-bit hash per word, the same everywhere; it deals words to tasks and buckets, never names them."""
    return np.fromiter((zlib.crc32(w) for w in words), np.uint32)


def pack(values: np.ndarray) -> bytes:
    """Integers as the bytes that the largest needs, one plane per byte, compressed."""
    values = np.ascontiguousarray(values, np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    head = np.array([len(values), width], np.int64).tobytes()
    return head + pa.compress(pa.py_buffer(planes), codec="zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    """What ``pack`` has packed, as 64-bit integers."""
    n, width = np.frombuffer(blob[:16], np.int64)
    planes = np.frombuffer(pa.decompress(blob[16:], int(n * width), codec="zstd"), np.uint8).reshape(int(width), int(n))
    out = np.zeros((int(n), 8), np.uint8)
    out[:, : int(width)] = planes.T
    return out.reshape(-1).view(np.int64)


def pack_words(words: pa.Array) -> bytes:
    """Words of a binary array, their lengths in front."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    data = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else b""
    lengths = pack(np.diff(offsets))
    head = np.array([len(lengths), len(data)], np.int64).tobytes()
    return head + lengths + pa.compress(pa.py_buffer(bytes(data)), codec="zstd", asbytes=True)


def unpack_words(blob: bytes) -> pa.Array:
    lengths, size = np.frombuffer(blob[:16], np.int64)
    offsets = np.concatenate([[0], np.cumsum(unpack(blob[16 : 16 + int(lengths)]))]).astype(np.int64)
    data = pa.decompress(blob[16 + int(lengths) :], int(size), codec="zstd")
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), data])
