"""Vector bin packing of token sequences, without padding.

A sequence has three limits at once: tokens, segments (pieces of examples), and tokens that bear loss. The open
sequence takes the piece with the largest dot product of its demand and what the sequence has left, each dimension
divided by its limit and weighted by the mean demand in the pool. Where no piece fits whole, the longest one is cut to
what is left. Pieces of equal demand are interchangeable, so choices are made among distinct demands. Longer examples
give whole sequences first.

Every task packs the examples it reads, in windows of bounded size; what does not fill a sequence waits for the next
window. So nothing is shuffled and no group grows with the input. A sequence that cannot be filled, as the pool is
empty or a limit is met, is cut back to a power of two, which needs no padding; the rest goes back to the pool. This
happens at the end of a task, and where examples are so short that segments run out first.

Defined results: NULL and empty texts have the closing token alone. Rows with the same id, NULL included, are examples of
their own. A very long text becomes many sequences. An example without tokens has no piece. Empty tables give no rows.
Further columns are not read. Sequence ids hold the number of the task, so they depend on how the table is split, and
a task that is run again gives them again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrove.llm import bpe
from shotgrove.llm.common import read
from shotgrove.llm.shingle_sets import text_bytes
from shotgrove.llm.token_ids import WordIds


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("every limit has to be 1 or more")


# The token that closes a document, and tokens that a task gathers before it packs them.
CLOSING = 1
WINDOW_TOKENS = 1 << 21

# Sequences' worth of tokens that stay in the pool for the next window, to choose from.
RESERVE = 8

# Longest pieces that are tried when one has to be cut.
_CUT_TRIES = 8

_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                    ("loss_tokens", pa.int64())])
_PIECE_TYPE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
               "loss_tokens long")


class Example:
    """Token ids under one id; `sums` counts the tokens with loss before each place, None if all bear loss."""

    __slots__ = ("key", "ids", "sums")

    def __init__(self, key: int | None, ids: np.ndarray, mask: np.ndarray | None = None) -> None:
        self.key, self.ids = key, ids
        self.sums = None if mask is None else np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])

    def loss(self, start: int, length: int) -> int:
        return length if self.sums is None else int(self.sums[start + length] - self.sums[start])

    def prefix(self, start: int, length: int, tokens: int, loss: int) -> int:
        """Tokens from `start` that fit into so many tokens with so much loss."""
        size = min(length, tokens)
        if self.sums is None:
            return min(size, loss)
        return min(size, int(np.searchsorted(self.sums, self.sums[start] + loss, side="right")) - 1 - start)


Piece = tuple[Example, int, int]  # example, start, length


class Pool:
    """Pieces by demand (tokens, loss)."""

    def __init__(self) -> None:
        self.slots: dict[tuple[int, int], int] = {}
        self.pieces: list[list[Piece]] = []
        self.tokens, self.loss, self.count = (np.zeros(64, dtype=np.int64) for _ in range(3))
        self.total = self.total_loss = self.n = 0

    def add(self, piece: Piece) -> None:
        example, start, length = piece
        demand = (length, example.loss(start, length))
        slot = self.slots.get(demand)
        if slot is None:
            slot = self.slots[demand] = len(self.pieces)
            self.pieces.append([])
            if slot == len(self.tokens):
                self.tokens, self.loss, self.count = (np.concatenate([a, np.zeros_like(a)])
                                                      for a in (self.tokens, self.loss, self.count))
            self.tokens[slot], self.loss[slot] = demand
        self.pieces[slot].append(piece)
        self.count[slot] += 1
        self._tell(demand, 1)

    def take(self, slot: int) -> Piece:
        self.count[slot] -= 1
        self._tell((int(self.tokens[slot]), int(self.loss[slot])), -1)
        return self.pieces[slot].pop()

    def _tell(self, demand: tuple[int, int], sign: int) -> None:
        self.total += sign * demand[0]
        self.total_loss += sign * demand[1]
        self.n += sign

    def best(self, tokens: int, loss: int, limits: Limits) -> int | None:
        """The slot with the largest dot product among those that fit.

        Every piece is one segment, so that dimension adds the same to all of them.
        """
        used = len(self.pieces)
        t, d = self.tokens[:used], self.loss[:used]
        fits = (self.count[:used] > 0) & (t <= tokens) & (d <= loss)
        # Means of demand / limit as weights; the common number of pieces is left out.
        by_tokens = self.total / limits.tokens * tokens / limits.tokens ** 2
        by_loss = self.total_loss / limits.loss * loss / limits.loss ** 2
        value = np.where(fits, t * by_tokens + d * by_loss, -1.0)
        slot = int(value.argmax()) if used else 0
        return slot if used and fits[slot] else None

    def longest(self) -> np.ndarray:
        """Slots of the longest pieces, the longest first."""
        held = np.flatnonzero(self.count[:len(self.pieces)])
        if len(held) > _CUT_TRIES:
            held = held[np.argpartition(-self.tokens[held], _CUT_TRIES)[:_CUT_TRIES]]
        return held[np.argsort(-self.tokens[held], kind="stable")]

    def forget_empty(self) -> None:
        """Drop the slots without pieces, of which there may be many after a window."""
        pieces = [p for stack in self.pieces for p in stack]
        self.__init__()
        for piece in pieces:
            self.add(piece)


class Packer:
    """Packs one task's examples; sequences are numbered from `first`."""

    def __init__(self, limits: Limits, first: int) -> None:
        self.limits, self.next = limits, first
        self.pool = Pool()
        self.rows: list[tuple] = []

    def add(self, example: Example) -> None:
        start, size = 0, len(example.ids)
        while size - start > self.limits.tokens:
            length = example.prefix(start, size - start, self.limits.tokens, self.limits.loss)
            if length == self.limits.tokens:
                self._close([(example, start, length)])
            else:
                self.pool.add((example, start, length))
            start += length
        if size > start:
            self.pool.add((example, start, size - start))

    def pack(self, reserve: int) -> None:
        """Fill sequences until no more than `reserve` tokens are left."""
        while self.pool.n and self.pool.total > reserve:
            self._close(self._filled())
        self.pool.forget_empty()

    def _filled(self) -> list[Piece]:
        held: list[Piece] = []
        tokens, loss = self.limits.tokens, self.limits.loss
        while tokens and len(held) < self.limits.segments and self.pool.n:
            slot = self.pool.best(tokens, loss, self.limits)
            piece = self.pool.take(slot) if slot is not None else self._cut(tokens, loss)
            if piece is None:
                break
            held.append(piece)
            tokens -= piece[2]
            loss -= piece[0].loss(piece[1], piece[2])
        return held

    def _cut(self, tokens: int, loss: int) -> Piece | None:
        """The most that fits of one of the longest pieces; its rest goes back."""
        best, most = None, 0
        for slot in self.pool.longest():
            example, start, length = self.pool.pieces[slot][-1]
            size = example.prefix(start, length, tokens, loss)
            if size > most:
                best, most = slot, size
        if best is None:
            return None
        example, start, length = self.pool.take(best)
        if length > most:
            self.pool.add((example, start + most, length - most))
        return example, start, most

    def _close(self, held: list[Piece]) -> None:
        total = sum(p[2] for p in held)
        size = total if total == self.limits.tokens else 1 << (total.bit_length() - 1)
        offset = 0
        for example, start, length in held:
            kept = min(length, size - offset)
            if kept < length:
                self.pool.add((example, start + kept, length - kept))
            if kept:
                values = example.ids[start:start + kept]
                self.rows.append((example.key, start, kept, zlib.crc32(values.astype("<u4").tobytes()),
                                  len(example.ids), self.next, offset, example.loss(start, kept)))
                offset += kept
        self.next += 1

    def drained(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = zip(*rows) if rows else [()] * len(_PIECE)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE)], schema=_PIECE)


def _packed(examples: Iterator[Example], limits: Limits) -> Iterator[pa.RecordBatch]:
    packer = Packer(limits, TaskContext.get().partitionId() << 40)
    reserve = RESERVE * limits.tokens
    waiting = 0
    for example in examples:
        packer.add(example)
        waiting += len(example.ids)
        if waiting >= WINDOW_TOKENS:
            packer.pack(reserve)
            waiting = 0
            yield packer.drained()
    packer.pack(0)
    yield packer.drained()


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Pieces of `examples (doc_id, ids array<int>, loss array<boolean>)`; a NULL `loss` means that all tokens bear it.

    For instruction data, `loss` marks the tokens of the answers. It has to be as long as `ids`.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Example]:
        for batch in batches:
            for key, ids, loss in zip(*(batch.column(c) for c in ("doc_id", "ids", "loss"))):
                values = ids.values.to_numpy() if ids.is_valid else np.zeros(0, dtype=np.int32)
                mask = loss.values.to_numpy(zero_copy_only=False) if loss.is_valid else None
                if mask is not None and len(mask) != len(values):
                    raise ValueError("loss marks have to be as many as ids")
                yield Example(key.as_py(), values, mask)

    wanted = examples.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"),
                             F.col("loss").cast("array<boolean>").alias("loss"))
    return wanted.mapInArrow(lambda batches: _packed(rows(batches), limits), _PIECE_TYPE)


def pack_documents(documents: DataFrame, limits: Limits = Limits(), path: str | None = None) -> DataFrame:
    """Pieces of `documents (doc_id, text)`: the ids of each whole text and a closing token; all tokens bear loss."""
    path = path or bpe.default_path()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Example]:
        words = WordIds.of(path)
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for i, ids in words.encode(text_bytes(batch.column("text"))):
                yield Example(keys[i], np.append(ids, np.int32(CLOSING)))

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lambda batches: _packed(rows(batches), limits), _PIECE_TYPE)


def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(read(spark, folder, "documents"))
