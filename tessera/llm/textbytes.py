"""Vectorised work on the UTF-8 bytes of a column of texts.

An Arrow string column is one buffer of bytes and one of offsets; everything
here works on these two with numpy, without a Python object for a text or a
word. Words are runs of letters, digits and underscores, where every byte of
a non-ASCII character counts as a letter.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 2_000_000

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
STEP = U64(0x9E3779B97F4A7C15)
GRAM_CODE = _rng.integers(1, 2**63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is bytes[offsets[i]:offsets[i + 1]]; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(pa.scalar(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batch with at most that many bytes of text each; a longer text is a slice of its own."""
    _, offsets = text_bytes(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


@cache
def _malloc_trim():
    """The function of glibc, None where the C library is another."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system, which both Arrow and the C library keep otherwise."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim():
        _malloc_trim()(0)


def trimmed(run):
    """run, a function for mapInArrow, that gives back memory at its end: Spark keeps several idle workers beside each one that works."""

    def over(it):
        yield from run(it)
        give_back()

    return over


def trimmed_group(run):
    """The like of trimmed for applyInArrow, after each group."""

    def over(table):
        found = run(table)
        give_back()
        return found

    return over


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every word, in order; end is exclusive. A word doesn't reach over the end of its text."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = WORD[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return begin, end, np.searchsorted(offsets, begin, "right") - 1


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; spans are in order, not empty and don't overlap."""
    if len(begin) == 0:
        return np.zeros(0, U64)
    lengths = end - begin
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), STEP, U64))
    values = BYTE_CODE[data[at + np.repeat(begin, lengths)]] * powers[at]
    return mix(np.add.reduceat(values, first) + lengths.astype(U64))


def ngrams(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every n-gram of words; a text of fewer than n words has one n-gram, of all its words."""
    if len(hashes) == 0:
        return hashes, text
    k = len(hashes)
    values = np.zeros(k, U64)
    for i in range(min(n, k)):
        values[: k - i] += np.where(text[: k - i] == text[i:], hashes[i:] * GRAM_CODE[i], U64(0))
    first = np.r_[True, text[1:] != text[:-1]]
    whole = np.zeros(k, bool)
    if k >= n:
        whole[: k - n + 1] = text[: k - n + 1] == text[n - 1 :]
    keep = whole | (first & ~whole)
    return mix(values[keep]), text[keep]


def distinct_grams(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct n-grams of each text, ordered by text, then hash."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    begin, end, text = words(data, offsets)
    h, t = ngrams(span_hashes(data, begin, end), text, n)
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    if len(h):
        keep = np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])]
        h, t = h[keep], t[keep]
    return h, t


def binary(parts: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose value i holds the items parts[bounds[i]:bounds[i + 1]]."""
    raw = np.ascontiguousarray(parts)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds * raw.itemsize, np.int64)), pa.py_buffer(raw.view(np.uint8) if raw.size else b"")]).cast(pa.binary())


def unpacked(column, dtype) -> np.ndarray:
    """All items of a binary column, one after the other."""
    data, _ = text_bytes(column)
    return np.frombuffer(data.tobytes(), dtype)


def lengths_of(column, size: int) -> np.ndarray:
    """Items in each value of a binary column."""
    _, offsets = text_bytes(column)
    return np.diff(offsets) // size
