"""Token ids of whole texts, word by word.

For a tokenizer whose tokens hold no white space, white space is a forced boundary: texts are cut there, and between
plain letters and ASCII signs where no token holds such a pair. Each distinct fragment is encoded once per worker.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

from shotgrove.llm.bpe import WHITE_SPACE, codec
from shotgrove.llm.byte_merges import MAX_BYTES, Merges, plain_bytes
from shotgrove.llm.byte_runs import LOWER, distinct, edges, joined, slices

# Distinct fragments that a worker remembers, some 200 bytes each. A full memory is emptied.
REMEMBERED = 500_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[ord(c) for c in WHITE_SPACE]] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[:0x80] = True
_SIGN[[ord("'"), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = False


class WordIds:
    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        own = codec(path)
        if not own.drops_space:
            raise ValueError(f"{path}: tokens with white space")
        self.tokenizer = own.tokenizer
        self.merges = Merges(path) if own.cuts_signs else None
        # A-Z may be lower-cased first where the tokenizer does so itself.
        self.lowers = self._encoded(["ABC xYZ"]) == self._encoded(["abc xyz"])
        self.remembered = remembered
        self._forget()

    def _parted(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of plain letters and ASCII signs cut where one kind follows the other; not those with an apostrophe."""
        if self.merges is None or not len(starts):
            return starts, ends
        letters = plain_bytes(data)
        simple = np.logical_and.reduceat(letters | _SIGN[data] | _SPACE[data], starts)
        changes = np.flatnonzero(letters[1:] != letters[:-1]) + 1
        changes = changes[~_SPACE[data[changes]] & ~_SPACE[data[changes - 1]]]
        changes = changes[simple[np.searchsorted(starts, changes, side="right") - 1]]
        return np.sort(np.concatenate([starts, changes])), np.sort(np.concatenate([ends, changes]))

    @staticmethod
    @functools.lru_cache(maxsize=2)
    def of(path: str) -> WordIds:
        """The worker's own; it lives as long as the worker."""
        return WordIds(path)

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts = np.zeros(1024, dtype=np.int64)
        self.sizes = np.zeros(1024, dtype=np.int64)
        self.pool = np.zeros(4096, dtype=np.int32)
        self.used = 0

    def _encoded(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        """Remember the ids of words not met before: plain ones by merges, others by the library."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.cumsum(sizes) - sizes
        plain = np.zeros(len(words), dtype=bool)
        if self.merges is not None and len(words):
            plain = (np.add.reduceat(plain_bytes(data), starts, dtype=np.int64) == sizes) & (sizes <= MAX_BYTES)
        self._keep([w for w, p in zip(words, plain) if p],
                   *(self.merges.apply(data, starts[plain], sizes[plain]) if plain.any() else ((), ())))
        others = [w for w, p in zip(words, plain) if not p]
        for first in range(0, len(others), 10_000):
            part = others[first:first + 10_000]
            lists = self._encoded([w.decode() for w in part])
            self._keep(part, [i for ids in lists for i in ids], list(map(len, lists)))

    def _keep(self, words: list[bytes], ids, counts) -> None:
        at, total = len(self.known), len(ids)
        counts = np.asarray(counts, dtype=np.int64)
        self.starts, self.sizes = (_room(a, at + len(words)) for a in (self.starts, self.sizes))
        self.pool = _room(self.pool, self.used + total)
        self.sizes[at:at + len(words)] = counts
        self.starts[at:at + len(words)] = self.used + np.cumsum(counts) - counts
        self.pool[self.used:self.used + total] = ids
        self.used += total
        self.known.update(zip(words, range(at, at + len(words))))

    def _places(self, words: list[bytes]) -> np.ndarray:
        """Where the distinct words are among the remembered ones."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.remembered:
            self._forget()
            new = words
        self._learn(new)
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))

    def encode(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the text, its ids) of all texts in order."""
        open_text, gathered = -1, []
        for indices, parts in slices(texts, _SPACE):
            data, begins = joined(parts)
            inside = ~_SPACE[data]
            starts, ends = edges(inside)
            # A special token's string must not come into being by lower-casing.
            plain = self.lowers and not any(b"<|" in p for p in parts)
            if plain:
                data = LOWER[data]
                starts, ends = self._parted(data, starts, ends)
            values, codes = distinct(data, inside, ends - starts)
            place = self._places(values.to_pylist())[codes]
            sizes = self.sizes[place]
            upto = np.cumsum(sizes)
            total = int(upto[-1]) if len(upto) else 0
            ids = self.pool[np.arange(total) + np.repeat(self.starts[place] - upto + sizes, sizes)]
            first = np.searchsorted(starts, begins)  # the first word of each text
            cuts = np.concatenate([[0], upto])[np.append(first, len(starts))]
            for k, i in enumerate(indices):
                if i != open_text:
                    if open_text >= 0:
                        yield open_text, np.concatenate(gathered)
                    open_text, gathered = int(i), []
                gathered.append(ids[cuts[k]:cuts[k + 1]])
        if open_text >= 0:
            yield open_text, np.concatenate(gathered)


def _room(values: np.ndarray, size: int) -> np.ndarray:
    if size <= len(values):
        return values
    grown = np.zeros(max(size, 2 * len(values)), dtype=values.dtype)
    grown[:len(values)] = values
    return grown
