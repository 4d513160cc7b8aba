"""Byte-pair merges of many plain words side by side, with numpy.

A plain word is a run of a-z and the small letters U+00DF to U+00FF: normalisation leaves it as it is, and the word rules
make one word of it. Every round carries out one merge per word, the one of lowest rank and of these the leftmost, as
the merge rules say. Whatever is not plain goes to the tokenizers library.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np

from shotgrove.llm.bpe import byte_alphabet

# Longer words take the library's way.
MAX_BYTES = 24

_NONE = np.iinfo(np.int32).max
_CHUNK = 1 << 14


def plain_bytes(data: np.ndarray) -> np.ndarray:
    """Marks the bytes of plain letters."""
    small = (data >= ord("a")) & (data <= ord("z"))
    lead = data == 0xC3
    inner = np.zeros(len(data), dtype=bool)
    inner[1:] = lead[:-1] & (data[1:] >= 0x9F) & (data[1:] != 0xB7)
    lead[:-1] &= inner[1:]
    if len(lead):
        lead[-1] = False
    return small | lead | inner


class Merges:
    """Merge rules of a tokenizer file."""

    def __init__(self, path: str) -> None:
        model = json.loads(Path(path).read_text())["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.first = np.full(256, -1, dtype=np.int64)  # tokens of a byte inside and at the end of a word
        self.last = np.full(256, -1, dtype=np.int64)
        for sign, byte in byte_alphabet().items():
            self.first[byte] = vocab.get(sign, -1)
            self.last[byte] = vocab.get(sign + end, -1)
        rules = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in rules], dtype=np.int64)
        # A second merge of the same pair replaces the first one, as in a dictionary.
        _, place = np.unique(keys[::-1], return_index=True)
        rank = len(keys) - 1 - place
        self.keys, self.rank = keys[rank], rank.astype(np.int32)
        made = np.array([vocab[a + b] for a, b in rules], dtype=np.int64)
        self.made = made[rank]

    def _rules(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the merge of each pair, and what it makes."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.rank[at], _NONE), self.made[at]

    def apply(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per word) of the words of 1 to MAX_BYTES bytes that begin at `starts`."""
        order = np.argsort(sizes, kind="stable")
        counts = np.zeros(len(starts), dtype=np.int64)
        parts, begins = [], np.zeros(len(starts), dtype=np.int64)
        total = 0
        for at in range(0, len(order), _CHUNK):
            rows = order[at:at + _CHUNK]
            ids, n = self._chunk(data, starts[rows], sizes[rows])
            counts[rows] = n
            begins[rows] = total + np.cumsum(n) - n
            total += len(ids)
            parts.append(ids)
        every = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        upto = np.cumsum(counts)
        return every[np.arange(total) + np.repeat(begins - upto + counts, counts)], counts

    def _chunk(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = int(sizes.max())
        column = np.arange(width)
        bytes_ = data[np.minimum(starts[:, None] + column, len(data) - 1)]
        ids = np.where(column < sizes[:, None] - 1, self.first[bytes_], -1)
        ids[np.arange(len(sizes)), sizes - 1] = self.last[bytes_[np.arange(len(sizes)), sizes - 1]]
        done = np.full((len(sizes), width), -1, dtype=np.int64)
        row = np.arange(len(sizes))
        ids = np.concatenate([ids, np.full((len(sizes), 1), -1)], axis=1)  # room to shift
        rank, made = self._rules(ids[:, :-1].ravel(), ids[:, 1:].ravel())
        rank, made = rank.reshape(len(row), width), made.reshape(len(row), width)
        rank = np.concatenate([rank, np.full((len(row), 1), _NONE, dtype=rank.dtype)], axis=1)
        made = np.concatenate([made, np.zeros((len(row), 1), dtype=made.dtype)], axis=1)
        column = np.arange(width)
        while len(row):
            at = rank.argmin(axis=1)
            here = np.arange(len(row))
            open_ = rank[here, at] != _NONE
            if not open_.all():
                closed = ~open_
                done[row[closed]] = ids[closed, :-1]
                row, ids, rank, made, at = row[open_], ids[open_], rank[open_], made[open_], at[open_]
                here = np.arange(len(row))
            if not len(row):
                break
            new = made[here, at]
            source = column + (column > at[:, None])
            ids[:, :-1] = np.take_along_axis(ids, source, axis=1)
            rank[:, :-1] = np.take_along_axis(rank, source, axis=1)
            made[:, :-1] = np.take_along_axis(made, source, axis=1)
            ids[here, at] = new
            rank[here, at], made[here, at] = self._rules(new, ids[here, at + 1])
            before = here[at > 0]
            left = at[before] - 1
            rank[before, left], made[before, left] = self._rules(ids[before, left], new[before])
        kept = done >= 0
        return done[kept], kept.sum(axis=1)
