"""Words, lines and windows of many texts at once, as numpy arrays over the bytes of an Arrow batch.

White space is \\x20 and \\x09-\\x0D, all of it ASCII, so words of the UTF-8 bytes are words of the text. Hashes are 64 bits wide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_TABLE = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, dtype=np.uint64)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    return h ^ (h >> np.uint64(29))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * _A + mix(b + _B))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, one after another, and where each begins (one more at the end). Null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of bytes where `inside` holds; runs end with their text."""
    first = np.zeros(data.size + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if data.size else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False])) if data.size else inside
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number, modulo 2**64."""
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _A))))[:n]


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each piece, of at least one byte, from its bytes and their places in it."""
    if not starts.size:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    where = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(total) - where
    longest = int(lengths.max())
    powers = _powers(longest)
    value = mix(_TABLE[data[place + np.repeat(starts, lengths)]]) * powers[place]
    sums = np.add.reduceat(value, np.cumsum(lengths) - lengths)
    return mix(sums + lengths.astype(np.uint64) * _B)


def words(column: pa.Array, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data, offsets, and of each word: text number, hash, length in code points."""
    data, offsets = buffers(column)
    if fold:
        data = FOLD[data]
    starts, ends, text = pieces(data, offsets, ~SPACE[data])
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return data, offsets, text, piece_hashes(data, starts, ends), points[ends] - points[starts]


def slices(batches, column: str = "text", most: int = 2 << 20):
    """The batches anew, in slices of about `most` bytes of text (a longer text is a slice by itself), which bounds memory."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        _, offsets = buffers(batch.column(i))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each place, by doubling: the hash of 2n bytes is that of two neighbouring hashes of n bytes."""
    h, n = mix(_TABLE[data]), 1
    while n < size:
        step = min(n, size - n)
        h = pair(h[: max(0, h.size - step)], h[step:])
        n += step
    return h
