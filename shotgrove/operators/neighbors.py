"""From search hits to the neighbours of an example."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from shotgrove.functions import text as X
from shotgrove.operators import bm25, knn
from shotgrove.operators.numbering import row_numbers
from shotgrove.session import materialize
from shotgrove.tasks import QUERY_BATCH, TOP_K


def _numbered(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Add `out`, the place of each row from 0 by unique `keys`.

    Only the keys are written and sorted; the places are joined back, so wide rows are neither written nor sorted.
    NULL is a value like any other.
    """
    places = row_numbers(rows.select(*keys), [F.col(k) for k in keys], "_n").select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], (F.col("_n") - 1).alias(out))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return rows.join(places, same).select(*rows.columns, out)


def number_queries(sentences: DataFrame) -> DataFrame:
    """Add `query_id` to sentence rows (guid, sent_id, ...), which these two columns tell apart."""
    return _numbered(sentences, ["guid", "sent_id"], "query_id")


def batch_queries(queries: DataFrame, order: str, size: int = QUERY_BATCH) -> DataFrame:
    """Add `batch_id` and `pos`: consecutive batches of `size` rows in `order`, which has to be unique."""
    numbered = _numbered(queries, [order], "_place")
    return numbered.select(*queries.columns, F.floor(F.col("_place") / size).cast("bigint").alias("batch_id"),
                           (F.col("_place") % size).cast("int").alias("pos"))


def retrieve(queries: DataFrame, corpus: DataFrame, method: str, **options) -> DataFrame:
    """(query_id, rank, doc_id, score) by the chosen method: "dense" compares vectors, "sparse" words.

    Where `emb` is missing on either side, "dense" makes the vectors of both from `text`, by the given `encoder` or one
    fitted on the corpus.
    """
    if method == "dense":
        encoder = options.pop("encoder", None)
        if "emb" not in queries.columns or "emb" not in corpus.columns:
            encoder = encoder or fit_encoder(corpus)
            queries, corpus = (encode_texts(df.select(key, "text"), encoder)
                               for df, key in ((queries, "query_id"), (corpus, "doc_id")))
        if "centroids" in options:
            return knn.knn_ivf(queries, corpus, **options)
        return knn.knn_exact(queries, corpus, **options)
    if method == "sparse":
        return bm25.bm25_topk(queries, corpus, **options)
    raise ValueError(f"unknown retriever {method!r}")


def neighbor_rows(queries: DataFrame, hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """(guid, sent_id, rank, doc_id, score, corpus columns): hits with their texts and vectors.

    Hits are written first: the search is the dear part, and their true size lets the planner broadcast a
    short list instead of shuffling the corpus. In a long one, a document that is everyone's neighbour is
    skew on one side only, which adaptive execution splits. A hit whose document is not in `corpus` keeps its
    rank, with NULL in the corpus columns.
    """
    # Short rows meet first: texts and vectors, which a hit repeats, move no further than to their hits.
    asked = materialize(hits, "hits").join(queries.select("query_id", "guid", "sent_id"), "query_id").drop("query_id")
    return asked.join(corpus, "doc_id", "left").select(
        "doc_id", *[c for c in hits.columns if c not in ("query_id", "doc_id")],
        *[c for c in corpus.columns if c != "doc_id"], "guid", "sent_id")


def attach_neighbors(neighbors: DataFrame, value: str = "text", out: str = "neighbor_texts") -> DataFrame:
    """(guid, out): all neighbours of the first sentence, then those of the second, best first.

    A group has k rows for each of at most two sentences.
    """
    ordered = F.array_sort(F.collect_list(F.struct("sent_id", "rank", F.col(value).alias("v"))))
    return neighbors.groupBy("guid").agg(ordered.alias("_n")).select(
        "guid", F.transform("_n", lambda n: n["v"]).alias(out))


def texts_by_sentence(neighbors: DataFrame) -> DataFrame:
    """(guid, retrieved): one list of passages, best first, for each sentence.

    Texts move once, to their example; its sentences, two at most, are told apart there.
    """
    held = neighbors.select("guid", "sent_id", "rank", "text").repartition("guid")
    per_sentence = held.groupBy("guid", "sent_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_n"))
    return (per_sentence.groupBy("guid").agg(F.array_sort(F.collect_list(F.struct(
        "sent_id", F.col("_n.text").alias("texts")))).alias("_s"))
        .select("guid", F.transform("_s", lambda s: s["texts"]).alias("retrieved")))


def parse_hits(raw: DataFrame, column: str = "raw", field: str = "contents") -> DataFrame:
    """Add `text`, the named field of a hit stored as JSON."""
    return raw.withColumn("text", F.get_json_object(column, f"$.{field}"))


def _plain(option) -> object:
    """An option as something that tells settings apart in every session.

    Centroids count by their values, which are as few as an index has cells. Other tables belong into the version.
    """
    if isinstance(option, HashedEncoder):
        return ["encoder", hashlib.md5(np.array(option.weights).tobytes()).hexdigest()]
    if isinstance(option, DataFrame):
        cells = knn.load_cells(option)
        return ["cells", hashlib.md5(cells.numbers.astype(np.int64).tobytes() + cells.centers.tobytes()).hexdigest()]
    return option


class NeighborCache:
    """Neighbours kept in a table, so that every query is searched once for each setting.

    A setting is the method, its options but k, and the caller's version of the corpus. A query is served from the
    table if it was searched to at least the asked depth; otherwise it is searched again. The row of rank 0 says that
    a query was searched, so queries without any hit are remembered. A batch that was appended twice counts once.
    """

    SCHEMA = "query_id bigint, rank int, doc_id bigint, score double, setting string, depth int"

    def __init__(self, spark: SparkSession, path: str, version: str = ""):
        self.spark, self.path, self.version = spark, path, version

    def _setting(self, method: str, options: dict) -> str:
        parts = json.dumps([method, self.version, sorted((name, _plain(v)) for name, v in options.items())])
        return f"{method}-{hashlib.md5(parts.encode()).hexdigest()}"

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self.SCHEMA)

    def _depths(self, setting: str) -> DataFrame:
        searched = self.read().where((F.col("setting") == setting) & (F.col("rank") == 0))
        return searched.groupBy("query_id").agg(F.max("depth").alias("_depth"))

    def missing(self, queries: DataFrame, method: str, k: int = TOP_K, **options) -> DataFrame:
        kept = self._depths(self._setting(method, options)).where(F.col("_depth") >= k)
        return queries.join(kept, "query_id", "left_anti")

    def fetch(self, queries: DataFrame, corpus: DataFrame, method: str, k: int = TOP_K, **options) -> DataFrame:
        """Hits of `queries`; only those not searched before to this depth are searched."""
        setting = self._setting(method, options)
        new = materialize(self.missing(queries, method, k, **options), "new-queries")
        if not new.isEmpty():
            kept = [F.lit(setting).alias("setting"), F.lit(k).alias("depth")]
            hits = retrieve(new, corpus, method, k=k, **options).select(
                "query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score", *kept)
            searched = new.select("query_id").distinct().select(
                "query_id", F.lit(0).alias("rank"), F.lit(None).cast("bigint").alias("doc_id"),
                F.lit(None).cast("double").alias("score"), *kept)
            hits.unionByName(searched).write.mode("append").parquet(self.path)
        found = self.read().where((F.col("setting") == setting) & F.col("rank").between(1, k))
        return (found.join(self._depths(setting), "query_id").where(F.col("depth") == F.col("_depth"))
                .dropDuplicates(["query_id", "rank"]).select("query_id", "rank", "doc_id", "score")
                .join(queries.select("query_id"), "query_id", "left_semi"))


@dataclass(frozen=True)
class HashedEncoder:
    """Hashed words, inverse document frequency, unit length: `weights` has one number for each dimension.

    A word's dimension is the first eight hexadecimal digits of its md5, modulo the number of dimensions.
    """

    weights: tuple[float, ...]


def _dimension_counts(words: pa.ListArray, dim: int) -> np.ndarray:
    """Words of each row by dimension."""
    encoded = words.flatten().dictionary_encode()
    place = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in encoded.dictionary.to_pylist()],
                     dtype=np.int64)
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
    row = np.repeat(np.arange(len(words)), lengths)
    return np.bincount(row * dim + place[encoded.indices.to_numpy()], minlength=len(words) * dim).reshape(-1, dim)


def _in_parts(words: pa.ListArray, dim: int) -> Iterator[np.ndarray]:
    """The same, some rows at a time, so that the counts of a batch stay small."""
    step = max(1, 1_000_000 // dim)
    for start in range(0, len(words), step):
        yield _dimension_counts(words.slice(start, step), dim)


def fit_encoder(texts: DataFrame, dim: int = 256) -> HashedEncoder:
    """A text encoder fitted on `texts (text)` in one pass; one row for each dimension reaches the driver."""
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(dim, dtype=np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for counts in _in_parts(batch.column("words"), dim):
                held += (counts > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1)), pa.array(np.append(held, rows))], names=["dim", "n"])

    return _fitted(texts.select(X.words(F.col("text")).alias("words")).mapInArrow(frequencies, "dim long, n long"), dim)


def _fitted(frequencies: DataFrame, dim: int) -> HashedEncoder:
    """The encoder of `frequencies (dim, n)`: rows with a word of each dimension and, as one more dimension, all rows."""
    n = dict(tuple(r) for r in frequencies.groupBy("dim").agg(F.sum("n")).collect())
    return HashedEncoder(tuple(math.log((n.get(dim, 0) + 1) / (n.get(d, 0) + 1)) for d in range(dim)))


def _weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Vectors of unit length, or of zeros, from counted words."""
    rows = counts * weights
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def count_words(texts: DataFrame, dim: int = 256) -> DataFrame:
    """Add `counts`, the words of `text` by dimension, from which an encoder is fitted and vectors are made.

    Finding the words is the dear part of both, and is done once if the counts are written.
    """
    @F.arrow_udf("array<int>")
    def counted(words: pa.Array) -> pa.Array:
        values = np.concatenate([np.zeros(0, np.int32), *(c.astype(np.int32).ravel() for c in _in_parts(words, dim))])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, dim), pa.int32()), pa.array(values))

    return texts.withColumn("counts", counted(X.words(F.col("text"))))


def fit_counts(counted: DataFrame, dim: int = 256) -> HashedEncoder:
    """What `fit_encoder` gives, from `counts`."""
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros(dim, dtype=np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            held += (batch.column("counts").flatten().to_numpy().reshape(-1, dim) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1)), pa.array(np.append(held, rows))], names=["dim", "n"])

    return _fitted(counted.select("counts").mapInArrow(frequencies, "dim long, n long"), dim)


def encode_counts(counted: DataFrame, encoder: HashedEncoder) -> DataFrame:
    """`emb` instead of `counts`: the vectors that `encode_texts` gives."""
    weights = np.array(encoder.weights)
    dim = len(weights)

    @F.arrow_udf("array<double>")
    def vectors(counts: pa.Array) -> pa.Array:
        values = _weighted(counts.flatten().to_numpy().reshape(-1, dim), weights).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, dim), pa.int32()), pa.array(values))

    return counted.withColumn("emb", vectors("counts")).drop("counts")


def encode_texts(texts: DataFrame, encoder: HashedEncoder) -> DataFrame:
    """Add `emb`, the vector of `text`, without a shuffle. A text without words, or NULL, has only zeros."""
    weights = np.array(encoder.weights)
    dim = len(weights)

    @F.arrow_udf("array<double>")
    def vectors(words: pa.Array) -> pa.Array:
        parts = []
        for counts in _in_parts(words, dim):
            parts.append(_weighted(counts, weights).ravel())
        values = np.concatenate(parts) if parts else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, dim), pa.int32()), pa.array(values))

    return texts.withColumn("emb", vectors(X.words(F.col("text"))))
