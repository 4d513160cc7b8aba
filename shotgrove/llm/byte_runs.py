"""Runs of bytes of many texts at once, with numpy and Arrow."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text that are looked at at once; a longer text is cut between runs.
SLICE_BYTES = 1 << 22

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

# Words up to this many bytes have their checksums worked out side by side.
_SHORT = 64


def slices(texts: list[bytes], outside: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(indices of texts, their bytes) of about SLICE_BYTES, in order.

    A long text is cut after a byte that is `outside`.
    """
    indices: list[int] = []
    parts: list[bytes] = []
    held = 0
    for i, text in enumerate(texts):
        at = 0
        if parts and len(text) > SLICE_BYTES:
            yield np.array(indices), parts
            indices, parts, held = [], [], 0
        while len(text) - at > SLICE_BYTES:
            window = np.frombuffer(text, dtype=np.uint8, count=SLICE_BYTES, offset=at)
            cuts = np.flatnonzero(outside[window])
            end = at + SLICE_BYTES
            if len(cuts):
                end = at + int(cuts[-1]) + 1
            else:  # a run longer than a slice stays whole
                rest = np.flatnonzero(outside[np.frombuffer(text, dtype=np.uint8, offset=end)])
                end = end + int(rest[0]) + 1 if len(rest) else len(text)
            yield np.array([i]), [text[at:end]]
            at = end
        indices.append(i)
        parts.append(text[at:] if at else text)
        held += len(parts[-1]) + 1
        if held >= SLICE_BYTES:
            yield np.array(indices), parts
            indices, parts, held = [], [], 0
    if parts:
        yield np.array(indices), parts


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The parts as one array of bytes with a blank after each, and the place at which each begins."""
    data = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
    return data, np.cumsum(lengths) - lengths


def edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    changes = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    return changes[::2], changes[1::2]


def distinct(data: np.ndarray, inside: np.ndarray, lengths: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct runs and, for every run, the place of its value among them.

    `inside` marks the bytes of the runs, which are `lengths` long.
    """
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    runs = pa.Array.from_buffers(pa.binary(), len(lengths),
                                 [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    encoded = runs.dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy()


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, np.uint32(0xEDB88320) ^ (value >> np.uint32(1)), value >> np.uint32(1))
    return value


_CRC = _crc_table()


def crc32_of_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """crc32 of every run, going on from the checksum `begun` of what stands before it."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    long = int(np.searchsorted(-lengths[order], -_SHORT, side="left"))
    result = np.empty(len(starts), dtype=np.uint32)
    for i in order[:long]:
        result[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes(), int(begun[i]))
    short = order[long:]
    first, size = starts[short], lengths[short]
    state = ~begun[short].astype(np.uint32)
    active = len(short)
    for k in range(int(size[0]) if len(short) else 0):
        active = int(np.searchsorted(-size[:active], -k, side="left"))
        now = state[:active]
        state[:active] = _CRC[(now ^ data[first[:active] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    result[short] = ~state
    return result
