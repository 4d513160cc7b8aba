"""Nearest neighbours of vectors: exact, and by inverted file."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrove.operators import topk
from shotgrove.session import materialize
from shotgrove.tasks import NPROBE, TOP_K

DIGITS = 6  # scores are compared at this precision, so that ties do not hang on rounding noise


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    if len(column) == 0:
        return np.zeros((0, 1))
    values = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(column), -1)


def usable(table: pa.Table, width: int) -> tuple[pa.Table, np.ndarray]:
    """The rows whose `emb` has `width` numbers, and these as a matrix. NULL, NaN and other lengths make no vector."""
    lists = table["emb"]
    table = table.filter(pc.fill_null(pc.equal(pc.list_value_length(lists), width), False))
    if not table.num_rows:
        return table, np.zeros((0, width))
    vectors = matrix(table["emb"])
    numbers = ~np.isnan(vectors).any(axis=1)
    return (table, vectors) if numbers.all() else (table.filter(pa.array(numbers)), vectors[numbers])


def similarity(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    """Scores by (left row, right row), larger is nearer: "ip", "cosine" or "l2" (negative distance)."""
    product = left @ right.T
    if metric == "ip":
        score = product
    elif metric == "cosine":
        norms = np.linalg.norm(left, axis=1)[:, None] * np.linalg.norm(right, axis=1)[None, :]
        score = np.divide(product, norms, out=np.zeros_like(product), where=norms > 0)
    elif metric == "l2":
        squared = (left ** 2).sum(axis=1)[:, None] + (right ** 2).sum(axis=1)[None, :] - 2 * product
        score = -np.sqrt(np.maximum(squared, 0))
    else:
        raise ValueError(f"unknown metric {metric!r}")
    np.round(score, DIGITS, out=score)
    score += 0.0
    return score


def pair_similarity(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    """The same scores row by row: each left row with its right row."""
    product = np.einsum("ij,ij->i", left, right)
    if metric == "ip":
        score = product
    elif metric == "cosine":
        norms = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)
        score = np.divide(product, norms, out=np.zeros_like(product), where=norms > 0)
    else:
        squared = (left ** 2).sum(axis=1) + (right ** 2).sum(axis=1) - 2 * product
        score = -np.sqrt(np.maximum(squared, 0))
    return np.round(score, DIGITS) + 0.0


# Values of the corpus rows that are taken at once where each is met by the queries of its cell only.
_CELL_VALUES = 1_000_000

# Queries and corpus rows of a block of single-precision products, values of a block of exact ones, and the greatest
# norm at which sums in another order still agree to DIGITS digits.
_BLOCK_QUERIES, _BLOCK_ROWS, _EXACT_VALUES, _GREATEST = 256, 4_096, 250_000, 1e4


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`np.nonzero` of a mask with few true values: eight are looked at together."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    places = np.append((words[:, None] * 8 + np.arange(8)).ravel(), np.arange(whole, len(flat)))
    return np.divmod(places[flat[places]], max(mask.shape[1], 1))


class VectorScorer:
    """Queries `(query_id, emb[, cell])` against rows `(doc_id, emb[, cell])`.

    With cells, a query is compared only with the rows of the cells it probes. Rows without a vector of `dim` numbers
    have no neighbours and are nobody's.

    Products in single precision tell which rows may enter a query's list, with room for their error, and only these are
    scored in double precision. Vectors too long for that are all scored in double precision.
    """

    def __init__(self, queries: pa.Table, metric: str, dim: int):
        if metric not in ("ip", "cosine", "l2"):
            raise ValueError(f"unknown metric {metric!r}")
        queries, vectors = usable(queries, dim)
        ids = queries["query_id"].to_numpy()
        self.query_ids, first, self.owner = np.unique(ids, return_index=True, return_inverse=True)
        self.vectors, self.dim = vectors[first], dim
        self.cells = queries["cell"].to_numpy() if "cell" in queries.column_names else None
        self.metric = metric
        # Rows of one cell are a small part of a batch.
        width = max(self.vectors.shape[1], 1)
        self.batch_rows = topk.BATCH_ROWS if self.cells is None else max(topk.BATCH_ROWS, _CELL_VALUES // width)
        self.left, self.left_norms = self._single(self.vectors, query=True)

    def _single(self, rows: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows in single precision, so made that a greater product is a greater score, and their lengths."""
        with np.errstate(over="ignore", invalid="ignore"):
            if self.metric == "cosine":
                rows = _unit(rows)
            elif self.metric == "l2":
                last = np.ones(len(rows)) if query else -(rows ** 2).sum(axis=1) / 2
                rows = np.hstack([rows, last[:, None]])
            return rows.astype(np.float32), np.linalg.norm(rows, axis=1)

    def _least_products(self, rows: np.ndarray, limits: np.ndarray, products: np.ndarray, greatest: float,
                        k: int) -> np.ndarray:
        """Products below these belong to rows that cannot be among a query's best k.

        The limit is that of the list, or else the k-th best product of the first rows. The room is for the error of
        single precision, with rows of norm `greatest` at most, and for scores that are equal at DIGITS digits.
        """
        lengths = self.left_norms[rows]
        room = (self.dim + 16) * 2.0 ** -21 * lengths * greatest + 4 * 10.0 ** -DIGITS * (1 + lengths + greatest)
        least = limits
        if self.metric == "l2":
            least = ((self.vectors[rows] ** 2).sum(axis=1) - limits ** 2) / 2
        least = np.where(np.isfinite(limits), least, -np.inf)
        short = np.flatnonzero(~np.isfinite(limits))
        first = min(products.shape[1], max(1024, 32 * k))
        if len(short) and first >= k:
            least[short] = np.partition(products[short, :first], first - k, axis=1)[:, first - k]
        return (least - room).astype(np.float32)

    def offer(self, batch: pa.Table, best: topk.RunningBest) -> None:
        batch, vectors = usable(batch, self.dim)
        ids = batch["doc_id"].to_numpy()
        if self.cells is None:
            pairs = [(np.arange(len(self.query_ids)), np.arange(len(ids)))]
        else:
            cells = batch["cell"].to_numpy()
            pairs = [(np.unique(self.owner[self.cells == c]), np.flatnonzero(cells == c)) for c in np.unique(cells)]
        for queries, docs in pairs:
            for start in range(0, len(docs), _BLOCK_ROWS):
                part = docs[start:start + _BLOCK_ROWS]
                self._offer_block(queries, ids[part], vectors[part], best)

    def _offer_block(self, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, best: topk.RunningBest) -> None:
        single, norms = self._single(rows, query=False)
        greatest = norms.max()
        for start in range(0, len(queries), _BLOCK_QUERIES):
            part = queries[start:start + _BLOCK_QUERIES]
            if not (greatest < _GREATEST and self.left_norms[part].max() < _GREATEST):  # also if infinite
                self._offer_all(part, ids, rows, best)
                continue
            products = self.left[part] @ single.T
            least = self._least_products(part, best.limits(part), products, greatest, best.k)
            at, doc = _where(products >= least[:, None])
            if len(at) > products.size // 4:
                self._offer_all(part, ids, rows, best)
                continue
            step = max(_EXACT_VALUES // max(self.dim, 1), 1)
            scores = [pair_similarity(self.vectors[part[at[i:i + step]]], rows[doc[i:i + step]], self.metric)
                      for i in range(0, len(at), step)]
            if scores:
                best.offer_pairs(part[at], ids[doc], np.concatenate(scores))

    def _offer_all(self, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, best: topk.RunningBest) -> None:
        step = max(_EXACT_VALUES // len(ids), 1)
        for start in range(0, len(queries), step):
            part = queries[start:start + step]
            best.offer(part, ids, similarity(self.vectors[part], rows, self.metric))


def _search(queries: DataFrame, corpus: DataFrame, k: int, metric: str, columns: list[str],
            max_broadcast_values: int) -> DataFrame:
    """Rows whose vector is missing, holds NULL or NaN, or is not as long as the longest of the queries have no part."""
    named = F.col("query_id").isNotNull()
    queries = queries.select("query_id", "emb", *columns).where(F.col("emb").isNotNull() & named)
    corpus = corpus.select("doc_id", "emb", *columns).where(F.col("emb").isNotNull() & F.col("doc_id").isNotNull())
    width, rows = queries.agg(F.coalesce(F.max(F.size("emb")), F.lit(0)), F.count(F.lit(1))).first()

    def scorer(table: pa.Table) -> VectorScorer:
        return VectorScorer(table, metric, width)

    if rows * (width + 2 * k) <= max_broadcast_values:
        return topk.search_broadcast(queries.toArrow(), corpus, k, scorer)
    return topk.search_chunks(materialize(queries, "queries", "zstd"), corpus, k, scorer, rows, width)


def knn_exact(queries: DataFrame, corpus: DataFrame, k: int = TOP_K, metric: str = "ip",
              max_broadcast_values: int = topk.MAX_BROADCAST_VALUES) -> DataFrame:
    """The k nearest rows of `corpus (doc_id, emb)` for each of `queries (query_id, emb)`."""
    return _search(queries, corpus, k, metric, [], max_broadcast_values)


@dataclass(frozen=True)
class Cells:
    """The cells of an index: their numbers, ascending, and their centroids."""

    numbers: np.ndarray
    centers: np.ndarray


def load_cells(centroids: DataFrame, max_cells: int = 1 << 18) -> Cells:
    """Centroids `(cell, emb)` on the driver; their number is the `nlist` of the index."""
    table = topk.small_table(centroids.select("cell", "emb"), max_cells)
    if table is None:
        raise ValueError(f"more than {max_cells} cells")
    table = table.sort_by("cell")
    return Cells(table["cell"].to_numpy(), matrix(table["emb"]))


def nearest_cells(vectors: DataFrame, cells: Cells, n: int, metric: str = "ip") -> DataFrame:
    """Add `cell`, one row for each of the `n` nearest cells of a vector. A pass without a shuffle.

    A row without a vector of the centroids' length has no cell and is left out.
    """
    width = cells.centers.shape[1]
    step = max(8_000_000 // max(len(cells.numbers), 1), 1)
    schema = vectors.select("*", F.lit(0).cast("int").alias("cell")).schema

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Slices keep the scores of rows x cells small.
            for start in range(0, batch.num_rows, step):
                table, own = usable(pa.Table.from_batches([batch.slice(start, step)]), width)
                rows = np.arange(table.num_rows)
                best = topk.RunningBest(table.num_rows, min(n, len(cells.numbers)))
                best.offer(rows, cells.numbers, similarity(own, cells.centers, metric))
                found = np.isfinite(best.scores)  # a vector of infinite numbers may have no cell
                repeated = table.take(pa.array(np.repeat(rows, found.sum(axis=1))))
                yield from repeated.append_column("cell", pa.array(best.ids[found], pa.int32())).to_batches()

    return vectors.mapInArrow(assign, schema)


def mean_centroids(vectors: DataFrame, cell: str) -> DataFrame:
    """(cell, emb): the mean vector of each value of `cell`."""
    return (vectors.select(F.col(cell).cast("int").alias("cell"), F.posexplode("emb").alias("dim", "x"))
            .groupBy("cell", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
            .groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v"))
            .select("cell", F.transform("v", lambda e: e["x"]).alias("emb")))


def kmeans_centroids(vectors: DataFrame, nlist: int, seed: int = 0, max_iter: int = 10) -> DataFrame:
    """(cell, emb) from k-means over the vectors."""
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter, featuresCol="features").fit(
        vectors.select(array_to_vector(F.col("emb").cast("array<double>")).alias("features")))
    rows = [(i, [float(x) for x in center]) for i, center in enumerate(model.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cell int, emb array<double>")


def knn_ivf(queries: DataFrame, corpus: DataFrame, centroids: DataFrame, k: int = TOP_K, nprobe: int = NPROBE,
            metric: str = "ip", max_broadcast_values: int = topk.MAX_BROADCAST_VALUES) -> DataFrame:
    """Nearest rows within the `nprobe` cells nearest to each query.

    `corpus` either has a `cell` already (a stored index) or is assigned to its nearest cell here.
    """
    cells = load_cells(centroids)
    if "cell" not in corpus.columns:
        corpus = nearest_cells(corpus.select("doc_id", "emb"), cells, 1, metric)
    probes = nearest_cells(queries.select("query_id", "emb"), cells, nprobe, metric)
    return _search(probes, corpus, k, metric, ["cell"], max_broadcast_values)


def write_index(corpus: DataFrame, centroids: DataFrame, path: str, metric: str = "ip") -> None:
    """Store the corpus by cell. Rebalancing gives a small cell one file and splits a large one."""
    placed = nearest_cells(corpus, load_cells(centroids), 1, metric)
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(corpus with cell, centroids) of a stored index."""
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/centroids")


def search_index(queries: DataFrame, path: str, k: int = TOP_K, nprobe: int = NPROBE,
                 metric: str = "ip", max_broadcast_values: int = topk.MAX_BROADCAST_VALUES) -> DataFrame:
    """Search a stored index; only the folders of probed cells are read.

    The probed cells, one row for each cell of the index at most, are joined on the partition column, which prunes the
    folders when the query runs.
    """
    corpus, centroids = open_index(queries.sparkSession, path)
    cells = load_cells(centroids)
    probes = materialize(nearest_cells(queries.select("query_id", "emb"), cells, nprobe, metric), "probes")
    return _search(probes, probed_rows(corpus, probes), k, metric, ["cell"], max_broadcast_values)


def probed_rows(corpus: DataFrame, probes: DataFrame) -> DataFrame:
    """The rows of a stored `corpus` in the cells of `probes`. The comparison tells the planner of a selection."""
    touched = materialize(probes.select("cell").distinct(), "cells").where(F.col("cell") >= 0)
    return corpus.join(F.broadcast(touched), "cell", "left_semi")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found, over all queries."""
    hit = found.select("query_id", "doc_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "doc_id"], "left").agg(
        F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
