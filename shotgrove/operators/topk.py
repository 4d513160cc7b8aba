"""Best k corpus rows per query, without emitting all pairs.

Every task scores blocks of its corpus rows against a block of queries and keeps a running best k per
query; a window over these short lists gives the final rank. The corpus is never moved: few queries are broadcast
after their size is checked, many are cut into chunks that are broadcast one after the other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotgrove.schema import HIT
from shotgrove.session import materialize

# Values (rows x values per row, lists included) that a broadcast of queries, and that a chunk of them, may hold. Every
# Python worker holds them, so this and the blocks of scores bound a worker's memory whatever the number of queries.
MAX_BROADCAST_VALUES = 2_000_000
CHUNK_VALUES = 2_000_000
BATCH_ROWS = 4_096
# Queries whose lists a task sends at once.
SENT_VALUES = 100_000
# Length of all short lists of one task from which a bound is taken first, and the share of rows used for it.
BOUND_FROM = 500_000
BOUND_SHARE = 1_000
# Tasks of one pass over the corpus, where there are many passes.
TASKS_PER_CORE = 2
_NO_ID = np.iinfo(np.int64).max


class Scorer(Protocol):
    """Scores corpus rows against the queries it was built with."""

    query_ids: np.ndarray
    batch_rows: int  # corpus rows to take at once

    def offer(self, batch: pa.Table, best: RunningBest) -> None:
        """Offer `best` all pairs of a query and a row of the batch that may be among the best."""


class RunningBest:
    """The best k (score, doc id) of each query so far; on equal scores the lower id wins.

    Scores below `floor` cannot be among the best k of the whole corpus and are left out.
    """

    def __init__(self, n_queries: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.floor = np.full(n_queries, -np.inf) if floor is None else floor
        self.scores = np.full((n_queries, k), -np.inf)
        self.ids = np.full((n_queries, k), _NO_ID, dtype=np.int64)

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if scores.size == 0:
            return
        scores = np.where(np.isnan(scores), -np.inf, scores)  # a vector with NaN is nobody's neighbour
        last, top = self.scores[rows].min(axis=1), scores.max(axis=1)
        entering = (top > last) & (top >= self.floor[rows])
        level = np.flatnonzero((top == last) & np.isfinite(last))
        if level.size:
            # Equal to the last place: only a lower id gets in.
            at = last[level][:, None]
            worst = np.where(self.scores[rows[level]] == at, self.ids[rows[level]], -1).max(axis=1)
            entering[level] = np.where(scores[level] == at, ids, _NO_ID).min(axis=1) < worst
        for start in range(0, int(entering.sum()), 256):
            chosen = np.flatnonzero(entering)[start:start + 256]
            self._merge(rows[chosen], ids, scores[chosen])

    def limits(self, rows: np.ndarray) -> np.ndarray:
        """The score that a document needs to enter the lists of these queries, at least."""
        return np.maximum(self.scores[rows].min(axis=1), self.floor[rows])

    def offer_pairs(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Single pairs: a query row, a doc id and a score each. Query rows ascend."""
        asked, owner = np.unique(rows, return_inverse=True)
        held = self.scores[asked]
        last = held.min(axis=1)
        worst = np.where(held == last[:, None], self.ids[asked], np.iinfo(np.int64).min).max(axis=1)
        last, worst = last[owner], worst[owner]
        entering = (scores >= self.floor[rows]) & ((scores > last) | ((scores == last) & (ids < worst)))
        ids, scores = ids[entering], scores[entering]
        asked, first, counts = np.unique(rows[entering], return_index=True, return_counts=True)
        for start in range(0, len(asked), 64):
            n = counts[start:start + 64]
            own = slice(first[start], first[start] + n.sum())
            place = np.arange(n.max()) < n[:, None]
            side, side_ids = np.full(place.shape, -np.inf), np.full(place.shape, _NO_ID, dtype=np.int64)
            side[place], side_ids[place] = scores[own], ids[own]
            self._merge(asked[start:start + 64], side_ids, side)

    def _merge(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """`ids` are those of all rows, or each row's own."""
        k, own = self.k, self.ids[rows]
        if np.isfinite(self.floor[rows]).any():
            scores = np.where(scores >= self.floor[rows][:, None], scores, -np.inf)
        ids = np.broadcast_to(ids, scores.shape)
        every = np.hstack([self.scores[rows], scores])
        top = np.argpartition(every, every.shape[1] - k, axis=1)[:, -k:]
        best = np.take_along_axis(every, top, axis=1)
        last = best.min(axis=1)
        self.scores[rows] = best
        self.ids[rows] = np.where(top < k, np.take_along_axis(own, np.minimum(top, k - 1), axis=1),
                                  np.take_along_axis(ids, np.maximum(top - k, 0), axis=1))
        # Where more rows tie at the last place than fit, the lowest ids are kept.
        tied = np.flatnonzero(((every >= last[:, None]).sum(axis=1) > k) & np.isfinite(last))
        for r in tied:
            fit = np.flatnonzero(every[r] >= last[r])
            fit_ids = np.where(fit < k, own[r, np.minimum(fit, k - 1)], ids[r, np.maximum(fit - k, 0)])
            chosen = np.lexsort((fit_ids, -every[r, fit]))[:k]
            self.scores[rows[r]], self.ids[rows[r]] = every[r, fit[chosen]], fit_ids[chosen]

    def to_batch(self, query_ids: np.ndarray, rows: slice = slice(None)) -> pa.RecordBatch:
        scores, ids = self.scores[rows], self.ids[rows]
        found = np.isfinite(scores)
        owner = np.broadcast_to(np.asarray(query_ids)[rows][:, None], scores.shape)
        return pa.RecordBatch.from_arrays(
            [pa.array(owner[found], pa.int64()), pa.array(ids[found], pa.int64()),
             pa.array(scores[found], pa.float64())], names=["query_id", "doc_id", "score"])

    def to_batches(self, query_ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The lists, some queries at a time."""
        step = max(SENT_VALUES // self.k, 1)
        for start in range(0, len(self.scores), step):
            yield self.to_batch(query_ids, slice(start, start + step))


def _scan(batches: Iterator[pa.RecordBatch], scorer: Scorer, k: int,
          floors: dict[int, float] | None = None) -> Iterator[pa.RecordBatch]:
    floor = np.array([floors.get(q, -np.inf) for q in scorer.query_ids.tolist()]) if floors else None
    best = RunningBest(len(scorer.query_ids), k, floor)
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= scorer.batch_rows:
            scorer.offer(pa.Table.from_batches(waiting), best)
            waiting = []
    if waiting:
        scorer.offer(pa.Table.from_batches(waiting), best)
    yield from best.to_batches(scorer.query_ids)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score) with rank 1 for the best."""
    window = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return (hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
            .select("query_id", "rank", "doc_id", "score"))


def small_table(df: DataFrame, max_rows: int) -> pa.Table | None:
    """`df` on the driver if it has at most `max_rows` rows, else None."""
    table = df.limit(max_rows + 1).toArrow()
    return table if table.num_rows <= max_rows else None


def _lower_bounds(queries: pa.Table, corpus: DataFrame, k: int, make_scorer: Callable[[pa.Table], Scorer],
                  share: int) -> dict[int, float]:
    """The k-th best score of each query within a share of the corpus, at most one row per query.

    The k-th best of the whole corpus is no lower, so the bound removes no result. It only keeps tasks from
    sending k rows per query each.
    """
    part = corpus.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    last = search_broadcast(queries, part, k, make_scorer, bound_from=None).where(F.col("rank") == k).toArrow()
    return dict(zip(last["query_id"].to_pylist(), last["score"].to_pylist()))


def search_broadcast(queries: pa.Table, corpus: DataFrame, k: int, make_scorer: Callable[[pa.Table], Scorer],
                     bound_from: int | None = BOUND_FROM, bound_share: int = BOUND_SHARE) -> DataFrame:
    """One pass over the corpus where it lies; the only shuffle is of the short lists."""
    context = corpus.sparkSession.sparkContext
    floors = None
    if bound_from is not None and queries.num_rows * k >= bound_from:
        floors = _lower_bounds(queries, corpus, k, make_scorer, bound_share)
    shared = context.broadcast((queries, floors))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bounds = shared.value
        yield from _scan(batches, make_scorer(table), k, bounds)

    return ranked(corpus.mapInArrow(scan, HIT), k)


def search_chunks(queries: DataFrame, corpus: DataFrame, k: int, make_scorer: Callable[[pa.Table], Scorer],
                  rows: int, width: float = 1, chunk_values: int = CHUNK_VALUES) -> DataFrame:
    """Any number of queries against a corpus that stays where it lies.

    Written `queries` are cut into hash chunks by query id. Each chunk is broadcast, makes one pass over the corpus, and
    its hits are written before the next one starts, so that the driver and the tasks hold one chunk at a time: the
    queries' values and the k best of each count towards its size. `rows` is the number of queries.

    Each task sends k rows for each query, so a pass has no more tasks than keep all cores busy, however many parts the
    corpus has.
    """
    most = TASKS_PER_CORE * corpus.sparkSession.sparkContext.defaultParallelism
    if corpus.rdd.getNumPartitions() > most:
        corpus = corpus.coalesce(most)
    chunks = max(1, math.ceil(rows * (width + 2 * k) / chunk_values))
    chunk = F.pmod(F.xxhash64("query_id"), F.lit(chunks))
    found: DataFrame | None = None
    for c in range(chunks):
        hits = materialize(search_broadcast(queries.where(chunk == c).toArrow(), corpus, k, make_scorer), "chunk")
        found = hits if found is None else found.unionByName(hits)
    return found
