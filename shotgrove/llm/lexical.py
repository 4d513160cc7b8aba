"""Reversed lexical search: items are indexed, documents stream past.

The terms of the items make an inverted index (term to items) that is broadcast; its size is checked, and more items
than fit are searched block by block, each block against all documents. Tasks turn every document into counts of the
indexed terms, which are written once. From them come the frequencies, and then each task streams its documents
through the index: the scores of a few documents against all items are summed up, and what is not below an item's
lowest kept score enters its heap of k entries. A window merges the heaps of the tasks. Documents never meet items
by a join, so a frequent term gathers nowhere.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. Scores are whole
numbers: w * ((10^9 * tf) div (1000 * tf + 8 * m)), summed over an item's distinct terms, with
w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 10 + (90 * n * N) div L.

Defined results: NULL and empty texts have no terms; such documents count nowhere, such items have no rows. A document
that shares no term with an item, or only terms of weight 0, is not returned for it. Rows with the same item_id, NULL
included, are one item. Repeated documents are documents of their own, also where they share an id. Equal scores are
ordered by doc_id, a NULL id last. Empty tables give no rows. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotgrove.llm.byte_runs import LOWER, distinct, edges, joined, slices
from shotgrove.llm.common import read
from shotgrove.llm.shingle_sets import text_bytes
from shotgrove.session import materialize

TOP = 10

# Pairs of term and item that one broadcast index may hold (about 100 bytes each, terms included), and the bytes of
# its terms.
INDEX_PAIRS, INDEX_BYTES = 1_000_000, 64 << 20

# Scores that a task sums up at once, eight bytes each.
SCORE_CELLS = 1 << 21

_TERM = np.zeros(256, dtype=bool)
_TERM[0x80:] = True
for _first, _last in ("09", "AZ", "az"):
    _TERM[ord(_first):ord(_last) + 1] = True

_HIT = "item int, doc_id long, score long"
_RANKED = "item_id long, rank int, doc_id long, score long"


def term_counts(texts: list[bytes], known: pd.Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all terms per text, text, term, occurrences): the counts of the known terms, ordered by text and term."""
    totals = np.zeros(len(texts), dtype=np.int64)
    pairs, counts = [], []
    for indices, parts in slices(texts, ~_TERM):
        data, begins = joined(parts)
        inside = _TERM[data]
        starts, ends = edges(inside)
        text = indices[np.searchsorted(begins, starts, side="right") - 1]
        totals += np.bincount(text, minlength=len(texts))
        values, codes = distinct(LOWER[data], inside, ends - starts)
        term = known.get_indexer(values.to_pylist())[codes]
        found = term >= 0
        pair, count = np.unique(text[found] * len(known) + term[found], return_counts=True)
        pairs.append(pair)
        counts.append(count)
    pair, at = np.unique(np.concatenate(pairs or [np.zeros(0, np.int64)]), return_inverse=True)
    count = np.bincount(at, np.concatenate(counts or [np.zeros(0, np.int64)]), len(pair)).astype(np.int64)
    return totals, pair // max(1, len(known)), pair % max(1, len(known)), count


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of all items, without repetitions; terms are bytes."""
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            rows, found = [], []
            for indices, parts in slices(texts, ~_TERM):
                data, begins = joined(parts)
                inside = _TERM[data]
                starts, ends = edges(inside)
                values, codes = distinct(LOWER[data], inside, ends - starts)
                text = indices[np.searchsorted(begins, starts, side="right") - 1]
                pair = np.unique(text * max(1, len(values)) + codes)
                rows.append(pair // max(1, len(values)))
                found.append(values.take(pa.array(pair % max(1, len(values)))))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id").take(pa.array(np.concatenate(rows))), pa.concat_arrays(found)],
                    names=["item_id", "term"])

    return items.mapInArrow(terms, "item_id long, term binary").distinct()


class Index:
    """Inverted index of numbered items: items of term t are items[starts[t]:starts[t + 1]]."""

    def __init__(self, table: pd.DataFrame) -> None:
        self.item_ids = pd.Index(table["item_id"]).unique()  # NULL, as an item of its own, is one value
        terms, self.known = pd.factorize(table["term"])
        item = pd.factorize(table["item_id"], use_na_sentinel=False)[0]
        order = np.argsort(terms, kind="stable")
        self.items = item[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(self.known) + 1))


class Heaps:
    """The k best documents of each item; equal scores by id, without id last."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.floor = np.ones(items, dtype=np.int64)  # what a full heap holds at least; before that, any score
        self.item, self.score, self.doc = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.unnamed = np.zeros(0, dtype=bool)

    def update(self, scores: np.ndarray, docs: np.ndarray, unnamed: np.ndarray) -> None:
        """Take in `scores`, a row for each document."""
        row, item = np.nonzero(scores >= self.floor)
        if not len(row):
            return
        merged = (np.concatenate([self.item, item]), np.concatenate([self.score, scores[row, item]]),
                  np.concatenate([self.doc, docs[row]]), np.concatenate([self.unnamed, unnamed[row]]))
        order = np.lexsort((merged[2], merged[3], -merged[1], merged[0]))
        held = merged[0][order]
        place = np.arange(len(held)) - np.searchsorted(held, held)
        kept = order[place < self.k]
        self.item, self.score, self.doc, self.unnamed = (m[kept] for m in merged)
        full = place == self.k - 1
        self.floor[held[full]] = merged[1][order[full]]


def _streamed(batches: Iterator[pa.RecordBatch], index: Index, weight: np.ndarray, documents: int, terms: int,
              k: int) -> Iterator[pa.RecordBatch]:
    items = len(index.item_ids)
    heaps = Heaps(items, k)
    width = np.diff(index.starts)
    step = max(1, SCORE_CELLS // items)
    for batch in batches:
        ids = batch.column("doc_id")
        docs = ids.fill_null(0).to_numpy()
        unnamed = ids.is_null().to_numpy(zero_copy_only=False)
        # Python's whole numbers, as 90 * n * N may leave 64 bits for the longest documents only.
        share = np.fromiter((10 + 90 * n * documents // terms for n in batch.column("n").to_pylist()), dtype=np.int64,
                            count=batch.num_rows)
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            lists = part.column("terms")
            length = lists.value_lengths().to_numpy()
            term = lists.flatten().to_numpy()
            tf = part.column("counts").flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(part.num_rows), length)
            value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * share[first + row]))
            # One summand for each item of each term, below 2.7 * 10^10 each: doubles hold the sums of items of up to
            # 300,000 distinct terms exactly.
            wide = width[term]
            upto = np.cumsum(wide)
            item = index.items[np.arange(upto[-1] if len(upto) else 0) + np.repeat(index.starts[term] - upto + wide, wide)]
            scores = np.bincount(np.repeat(row, wide) * items + item, np.repeat(value, wide), part.num_rows * items)
            heaps.update(scores.astype(np.int64).reshape(part.num_rows, items), docs[first:first + step],
                         unnamed[first:first + step])
    yield pa.RecordBatch.from_arrays(
        [pa.array(heaps.item, pa.int32()), pa.array(heaps.doc, mask=heaps.unnamed), pa.array(heaps.score)],
        names=["item", "doc_id", "score"])


def _counted(batches: Iterator[pa.RecordBatch], known: pd.Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        n, text, term, count = term_counts(text_bytes(batch.column("text")), known)
        offsets = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (term, count)]
        rows = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists],
                                          names=["doc_id", "n", "terms", "counts"])
        yield rows.filter(pa.array(n > 0))


def _frequencies(batches: Iterator[pa.RecordBatch], known: int) -> Iterator[pa.RecordBatch]:
    """(term, documents, terms) of a task; the row after the last term counts all documents and their terms."""
    documents = np.zeros(known + 1, dtype=np.int64)
    terms = 0
    for batch in batches:
        documents[:known] += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=known)
        documents[known] += batch.num_rows
        terms += int(batch.column("n").to_numpy().sum())
    held = np.flatnonzero(documents)
    yield pa.RecordBatch.from_arrays(
        [pa.array(held, pa.int32()), pa.array(documents[held]), pa.array(np.where(held == known, terms, 0))],
        names=["term", "documents", "terms"])


def _search_block(documents: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """Hits of the items of one block, whose index is within bounds."""
    spark = documents.sparkSession
    arrow = block.toArrow()
    index = Index(pd.DataFrame({"item_id": arrow.column("item_id").to_pandas(integer_object_nulls=True),
                                "term": arrow.column("term").to_pylist()}))
    known = pd.Index(index.known)
    if not len(known):
        return spark.createDataFrame([], _RANKED)
    shared = spark.sparkContext.broadcast((index, known))
    counted = materialize(documents.select("doc_id", "text").mapInArrow(
        lambda batches: _counted(batches, shared.value[1]),
        "doc_id long, n long, terms array<int>, counts array<int>"), "term-counts")
    size = len(known)
    found = (counted.mapInArrow(lambda batches: _frequencies(batches, size), "term int, documents long, terms long")
             .groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).collect())
    frequency = {row["term"]: row for row in found}  # a row for each indexed term at most
    if size not in frequency:
        return spark.createDataFrame([], _RANKED)
    total, length = frequency.pop(size)[1:]
    weight = np.zeros(size, dtype=np.int64)
    for term, row in frequency.items():
        weight[term] = math.floor(1000 * math.log((2 * total + 2) / (2 * row["documents"] + 1)))
    weights = spark.sparkContext.broadcast(weight)
    hits = counted.mapInArrow(
        lambda batches: _streamed(batches, shared.value[0], weights.value, total, length, k), _HIT)
    names = spark.createDataFrame([(i, None if pd.isna(v) else int(v)) for i, v in enumerate(index.item_ids)],
                                  "item int, item_id long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = hits.select("item", "doc_id", "score", F.row_number().over(best).alias("rank")).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(documents: DataFrame, items: DataFrame, k: int = TOP, index_pairs: int = INDEX_PAIRS,
           index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of `documents (doc_id, text)` for each of `items (item_id, text)`."""
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    terms = materialize(item_terms(asked), "item-terms")
    pairs, size = terms.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    blocks = 2 * max(pairs // index_pairs, size // index_bytes) + 1  # hash blocks may be up to twice the mean
    numbered = terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    found = [_search_block(texts, numbered.where(F.col("block") == b).drop("block"), k) for b in range(blocks)]
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    return hits


def op13_search(spark: SparkSession, folder: str) -> DataFrame:
    return search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


_SQL_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""

SQL = f"""
    WITH docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
    words AS (SELECT row, doc_id, {_SQL_TERMS} AS term FROM docs),
    counted AS (SELECT row, any_value(doc_id) AS doc_id, term, COUNT(*) AS tf FROM words GROUP BY row, term),
    sizes AS (SELECT row, SUM(tf)::BIGINT AS n FROM counted GROUP BY row),
    totals AS (SELECT COUNT(*) AS docs, SUM(n)::BIGINT AS terms FROM sizes),
    frequency AS (SELECT term, COUNT(*) AS df FROM counted GROUP BY term),
    asked AS (SELECT DISTINCT item_id, {_SQL_TERMS} AS term FROM benchmark),
    weighted AS (SELECT a.item_id, a.term, floor(1000 * ln((2 * t.docs + 2) / (2 * f.df + 1)))::BIGINT AS w
                 FROM asked a JOIN frequency f ON f.term = a.term CROSS JOIN totals t),
    shares AS (SELECT s.row, 10 + (90 * s.n * t.docs) // t.terms AS m FROM sizes s CROSS JOIN totals t),
    scored AS (
        SELECT w.item_id, c.row, any_value(c.doc_id) AS doc_id,
               SUM(w.w * ((1000000000 * c.tf) // (1000 * c.tf + 8 * s.m)))::BIGINT AS score
        FROM weighted w JOIN counted c ON c.term = w.term JOIN shares s ON s.row = c.row GROUP BY w.item_id, c.row)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
        FROM scored WHERE score > 0)
    WHERE rank <= 10"""
