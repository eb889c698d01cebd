"""Vectorised word hashing over the byte buffers of Arrow string columns.

Texts are read as UTF-8 bytes in slices of a few megabytes, so the arrays of a
task stay small whatever the size of its batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_1
    x ^= x >> np.uint64(27)
    x *= _MIX_2
    x ^= x >> np.uint64(31)
    return x


def numbered(seed: int, count: int) -> np.ndarray:
    """``count`` odd pseudo-random multipliers."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) * _GOLDEN + np.uint64(seed)) | np.uint64(1)


def _byte_values(fold_case: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
    if fold_case:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


EXACT = _byte_values(False)
FOLDED = _byte_values(True)

# Bytes of [^\x20\x09-\x0D].
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
# Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x30:0x3A] = LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def powers(count: int) -> np.ndarray:
    """``count`` powers of the hash base, modulo 2**64."""
    out = np.full(count, _BASE, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(4096)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cut(data: np.ndarray, start: int, size: int, is_word: np.ndarray) -> int:
    """An end for the slice from ``start`` that splits no word."""
    end = min(start + size, len(data))
    while end < len(data):
        block = is_word[data[max(start, end - 4096) : end]]
        gaps = np.flatnonzero(~block)
        if len(gaps):
            return end - len(block) + int(gaps[-1]) + 1
        end = min(end + size, len(data))
    return end


def hash_words(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, values: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word in text order: 64-bit hash, row, first byte, number of bytes."""
    found, start = [], 0
    while start < len(data):
        end = _cut(data, start, SLICE_BYTES, is_word)
        part = data[start:end]
        mask = is_word[part]
        opens = np.zeros(len(part) + 1, dtype=bool)
        first, last = np.searchsorted(offsets, [start, end], "left")
        opens[offsets[first:last] - start] = True
        opens = opens[:-1]
        before = np.concatenate(([False], mask[:-1]))
        heads = np.flatnonzero(mask & (opens | ~before))
        at = np.flatnonzero(mask)
        if len(at):
            rank = np.searchsorted(at, heads)
            lengths = np.diff(np.append(rank, len(at)))
            place = np.arange(len(at)) - np.repeat(rank, lengths)
            longest = int(lengths.max())
            table = _POWERS if longest <= len(_POWERS) else powers(longest)
            hashed = mix(np.add.reduceat(values[part[at]] * table[place], rank))
            rows = np.searchsorted(offsets, heads + start, "right") - 1
            found.append((hashed, rows, heads + start, lengths))
        start = end
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none.view(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def pieces(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``size`` bytes of one string column."""
    lengths = text_buffers(batch.column(column))[1]
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(lengths, lengths[start] + size, "right"))
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def row_bounds(rows: np.ndarray, count: int) -> np.ndarray:
    """Offsets of each row's run in ``rows``, which is ascending."""
    return np.searchsorted(rows, np.arange(count + 1), "left")


def shingle_hashes(
    hashes: np.ndarray, rows: np.ndarray, count: int, width: int
) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its ``width``-word shingles.

    A row with fewer words, but not none, has its whole sequence as the one shingle.
    """
    bounds = row_bounds(rows, count)
    weights = numbered(width, width)
    rolled = np.zeros(max(len(hashes) - width + 1, 0), dtype=np.uint64)
    for i in range(width):
        rolled += hashes[i : len(rolled) + i] * weights[i]
    rolled = mix(rolled)
    for row in range(count):
        low, high = int(bounds[row]), int(bounds[row + 1])
        if high - low >= width:
            yield np.unique(rolled[low : high - width + 1])
        elif high > low:
            weighed = (hashes[low:high] * weights[: high - low]).sum(dtype=np.uint64)
            yield mix(np.array([weighed + np.uint64(high - low)], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)
