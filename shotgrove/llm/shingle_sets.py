"""Hashed word shingles of many texts at once, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORDS = 5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_JOIN = np.uint64(0xD6E8FEB86659FD93)

# Bytes of text that are hashed at once; a longer text is a group of its own.
GROUP_BYTES = 1 << 20

# The same for sets of shingles, whose tasks run beside large sorts and joins.
SET_BYTES = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    values = np.full(n, base, dtype=np.uint64)
    values[0] = 1
    return np.multiply.accumulate(values)


class _Powers:
    """Powers of the base and of its inverse, made longer when needed."""

    up = _powers(_BASE, 2)
    down = _powers(_INVERSE, 2)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = n + (n >> 2)
            cls.up, cls.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return cls.up[:n], cls.down[:n]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the word position at which each text begins (and the end)."""
    data = np.frombuffer(b" ".join(texts).lower() + b" ", dtype=np.uint8)  # bytes.lower() touches A-Z only
    up, down = _Powers.of(len(data))
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, begins)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles of one text's words, in order; the whole as one if it is shorter."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(n, WORDS)
    value = hashes[:n - size + 1].copy()
    for k in range(1, size):
        value = value * _JOIN + hashes[k:n - size + 1 + k]
    return mixed(value + np.uint64(size))


def groups(values: list, size_of, size: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of `values` of about `size` bytes."""
    begin = total = 0
    for i, value in enumerate(values):
        total += size_of(value)
        if total >= size:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(values):
        yield begin, len(values)


def text_bytes(column: pa.Array) -> list[bytes]:
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def text_slices(batch: pa.RecordBatch, column: str = "text", size: int = 8 * SET_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `size` bytes of text, so that what is worked out for one part stays small."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    part = np.cumsum(lengths, dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For every text the sorted distinct shingle hashes (int64)."""
    texts = text_bytes(column)
    for a, b in groups(texts, len, SET_BYTES):
        hashes, begins = word_hashes(texts[a:b])
        for first, last in zip(begins[:-1], begins[1:]):
            yield np.unique(shingles(hashes[first:last]).view(np.int64))


def set_id(values: np.ndarray) -> int:
    """One signed number for a sorted set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(np.ascontiguousarray(values).tobytes())).view(np.int64))
