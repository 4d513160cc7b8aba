"""Lexical index and search by BM25.

The index is an inverted one. Postings of a term lie in blocks of bounded length; a frequent term has many blocks, each
with the documents of one hash class, so that no term gathers in one row or task. A block knows the most that one
occurrence of its term can add to a score. Blocks are stored by term bucket and are sorted by term.

A search reads the buckets of the asked terms only. A long list of postings is cut short without losing a hit: a bound
for the k-th best score of each query comes from the whole scores of the documents that are best by its rare terms; terms
that together cannot reach that bound count only for the documents that other terms have brought up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotgrove.functions import text as X
from shotgrove.operators import topk
from shotgrove.operators.knn import DIGITS
from shotgrove.session import materialize, spread

# Parameters of the lexical score.
K1, B = 0.9, 0.4

# Postings of a block, about; buckets of a stored index.
BLOCK_POSTINGS, BUCKETS = 4096, 64

# Postings of one bucket that a task puts into blocks, about.
TASK_POSTINGS = 2_000_000

# Postings that all queries together may read without bounds, and rare postings from which a query takes its bound.
PLAIN_POSTINGS, BOUND_POSTINGS = 20_000_000, 20_000

# Documents of a query, for each of the k asked for, whose whole scores give its bound.
BOUND_DOCUMENTS = 10

# Rows of a few short columns that a join may broadcast (100 bytes each, about).
BROADCAST_ROWS = 200_000

# Scores are compared at DIGITS digits; bounds leave more room than that.
_ROOM = 1e-5


def document_rows(corpus: DataFrame) -> DataFrame:
    """(doc_id, dl, terms) of `corpus (doc_id, text)`; a document without text has no terms."""
    words = F.coalesce(X.words(F.col("text")), F.array().cast("array<string>"))
    return corpus.select("doc_id", words.alias("terms")).withColumn("dl", F.size("terms"))


def postings(documents: DataFrame) -> DataFrame:
    """(doc_id, dl, term, tf) of document rows."""
    return (X.explode_once(documents, ["doc_id", "dl"], F.col("terms"), "term")
            .groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf")))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_statistics(documents: DataFrame) -> DataFrame:
    """(term, df, length) in one pass. The row with no term counts all documents and their words.

    Counts are combined in each task before the shuffle.
    """
    terms = F.concat(F.array_distinct("terms"), F.array(F.lit(None).cast("string")))
    return (documents.select("dl", F.explode_outer(terms).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("length")))


def query_terms(queries: DataFrame, words: str = "words") -> DataFrame:
    """(query_id, term, qtf) of `queries (query_id, words)`."""
    return (X.explode_once(queries, ["query_id"], F.col(words), "term")
            .groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("int").alias("qtf")))


def _bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _part(doc_id: str, parts: str) -> Column:
    """The block of its term that a document is in."""
    return F.pmod(F.xxhash64(doc_id), F.col(parts)).cast("int")


def _saturation(tf: Column, dl: Column, avgdl: float) -> Column:
    return tf / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


def _few(df: DataFrame) -> DataFrame:
    """`df`, a written table of short rows, with a broadcast hint where its row count allows one."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


@dataclass(frozen=True)
class LexicalIndex:
    """Blocks `(bucket, term, part, parts, df, top, posted array<struct<doc_id, tf, dl>>)` and the corpus totals.

    `top` is the block's greatest saturation, `parts` the number of blocks of the term.
    """

    blocks: DataFrame
    n_docs: int
    n_words: int
    buckets: int

    @property
    def avgdl(self) -> float:
        return self.n_words / self.n_docs


def blocks_of(posted: DataFrame, avgdl: float, buckets: int = BUCKETS, size: int = BLOCK_POSTINGS) -> DataFrame:
    """Blocks of written `posted (doc_id, dl, term, tf)`.

    Frequencies are joined to the postings of frequent terms only, of which there are few. Postings move once: to the
    task of a share of their bucket, with as many shares as a bucket needs.
    """
    counts = materialize(document_frequency(posted).where(F.col("df") > size).select(
        "term", F.ceil(F.col("df") / size).cast("int").alias("parts")), "frequent")
    sized = posted.join(_few(counts), "term", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    shares = math.ceil(max(posted.count(), 1) / (buckets * TASK_POSTINGS))
    placed = sized.withColumn("part", _part("doc_id", "parts")).withColumn("bucket", _bucket("term", buckets)).withColumn(
        "share", F.pmod(F.xxhash64("part", "term"), F.lit(shares)).cast("int"))
    grouped = placed.repartition("bucket", "share").groupBy("bucket", "share", "term", "parts", "part").agg(
        F.array_sort(F.collect_list(F.struct("doc_id", "tf", "dl"))).alias("posted"),
        F.max(_saturation(F.col("tf"), F.col("dl"), avgdl)).alias("top"))
    return grouped.select("bucket", "term", "part", "parts", F.size("posted").alias("held"), "top", "posted")


def _totals(documents: DataFrame) -> tuple[int, int]:
    row = documents.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return row[0], row[1]


def asked_postings(corpus: DataFrame, terms: DataFrame) -> tuple[DataFrame, int, int]:
    """(written postings of `terms (term)`, number of documents, number of words) in one pass over the corpus.

    A row without a term counts each document on its way.
    """
    documents = document_rows(spread(corpus.select("doc_id", "text")))
    every = documents.select("doc_id", "dl", F.explode(F.concat(
        F.array(F.lit(None).cast("string")), "terms")).alias("term"))
    wanted = terms.select("term").distinct().unionByName(terms.sparkSession.createDataFrame([(None,)], "term string"))
    wanted = _few(materialize(wanted.withColumnRenamed("term", "_term"), "asked"))
    kept = every.join(wanted, F.col("term").eqNullSafe(F.col("_term")), "left_semi")
    posted = materialize(kept.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf")), "postings")
    n_docs, n_words = posted.where(F.col("term").isNull()).agg(
        F.coalesce(F.sum("tf"), F.lit(0)), F.coalesce(F.sum(F.col("tf") * F.col("dl").cast("bigint")), F.lit(0))).first()
    return posted.where(F.col("term").isNotNull()), n_docs, n_words


def write_index(corpus: DataFrame, path: str, buckets: int = BUCKETS, block_postings: int = BLOCK_POSTINGS) -> None:
    """Store an index that many searches share."""
    n_docs, n_words = _totals(document_rows(spread(corpus.select("doc_id", "text"))))
    # Texts move, not their words, of which there are many more bytes.
    posted = materialize(postings(document_rows(corpus.select("doc_id", "text").repartition("doc_id"))), "postings")
    blocks = blocks_of(posted, n_words / max(n_docs, 1), buckets, block_postings)
    (blocks.sortWithinPartitions("bucket", "term").write.mode("overwrite")
     .partitionBy("bucket").parquet(f"{path}/blocks"))
    corpus.sparkSession.createDataFrame([(n_docs, n_words, buckets)], "n_docs long, n_words long, buckets int").write.mode(
        "overwrite").parquet(f"{path}/totals")


def open_index(spark: SparkSession, path: str) -> LexicalIndex:
    row = spark.read.parquet(f"{path}/totals").first()
    # The schema is given, so that an index without any block can be read.
    held = spark.read.schema("term string, part int, parts int, held int, top double, "
                             "posted array<struct<doc_id: bigint, tf: int, dl: int>>, bucket int")
    return LexicalIndex(held.parquet(f"{path}/blocks"), row["n_docs"], row["n_words"], row["buckets"])


def asked_blocks(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """The blocks of written `terms (bucket, term, ...)`, with their further columns; only the terms' buckets are read.

    The join on the partition column prunes the folders when the query runs; the comparison tells the planner that the
    terms are a selection.
    """
    return index.blocks.join(_few(terms).where(F.col("bucket") >= 0), ["bucket", "term"])


def _held(index: LexicalIndex, wanted: DataFrame) -> DataFrame:
    """(term, doc_id, share): each posting of the terms of `wanted (bucket, term, ...)`, once for all queries."""
    terms = materialize(wanted.select("bucket", "term").distinct(), "held-terms")
    return _shares(index, asked_blocks(index, terms))


def _shares(index: LexicalIndex, blocks: DataFrame) -> DataFrame:
    return blocks.select("term", F.explode("posted").alias("p")).select(
        "term", F.col("p.doc_id").alias("doc_id"), _saturation(F.col("p.tf"), F.col("p.dl"), index.avgdl).alias("share"))


def _scored(index: LexicalIndex, wanted: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) over written `wanted (query_id, bucket, term, weight)`.

    Postings move before they meet queries, so that a document's sums are made where it lies.
    """
    met = _held(index, wanted).repartition("doc_id").join(_few(wanted.select("query_id", "term", "weight")), "term")
    return met.select("query_id", "doc_id", (F.col("weight") * F.col("share")).alias("share")).groupBy(
        "query_id", "doc_id").agg(F.sum("share").alias("score"))


def weighted_terms(asked: DataFrame, index: LexicalIndex) -> DataFrame:
    """(query_id, bucket, term, weight, df, bound): weight = occurrences in the query x inverse document frequency, and
    the most that the term can add. Reads no postings."""
    terms = materialize(asked.select(_bucket("term", index.buckets).alias("bucket"), "term").distinct(), "terms")
    known = asked_blocks(index, terms).groupBy("bucket", "term").agg(
        F.sum("held").alias("df"), F.max("top").alias("top"), F.first("parts").alias("parts"))
    joined = asked.join(known, "term").withColumn(
        "weight", F.col("qtf") * _inverse_frequency(F.col("df"), index.n_docs))
    return joined.select("query_id", "bucket", "term", "weight", "df", "parts",
                         (F.col("weight") * F.col("top")).alias("bound"))


def _completed(index: LexicalIndex, pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """Written `pairs (query_id, doc_id, score)` with what `terms (query_id, bucket, term, weight, parts)` add to the scores.

    For few pairs, only the blocks that may hold them are read. For many, which every block holds some of, each posting
    of the terms moves once to the pairs of its document.
    """
    terms = materialize(terms, "others")
    pairs = pairs.select("query_id", "doc_id", "score")
    if pairs.count() <= BROADCAST_ROWS:
        looked = materialize(pairs.drop("score").join(_few(terms), "query_id").select(
            "query_id", "doc_id", "bucket", "term", "weight", _part("doc_id", "parts").alias("part")), "lookups")
        places = materialize(looked.select("bucket", "term", "part").distinct(), "places")
        blocks = index.blocks.join(_few(places).where(F.col("bucket") >= 0), ["bucket", "term", "part"])
        more = looked.join(_shares(index, blocks), ["term", "doc_id"]).select(
            "query_id", "doc_id", (F.col("weight") * F.col("share")).alias("score"))
        return pairs.unionByName(more).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
    both = _held(index, terms).unionByName(pairs, allowMissingColumns=True).repartition("doc_id")
    asked = _few(terms.select("term", F.col("query_id").alias("_asked"), "weight"))
    met = both.join(asked, "term", "left").select(
        F.coalesce("query_id", "_asked").alias("query_id"), "doc_id", F.col("query_id").isNotNull().alias("open"),
        F.coalesce("score", F.col("weight") * F.col("share")).alias("score"))
    return met.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"), F.max("open").alias("open")).where(
        "open").drop("open")


def _by_bounds(index: LexicalIndex, weighted: DataFrame, k: int, bound_postings: int) -> DataFrame:
    """The scores of all documents that may be among the best k."""
    rarest = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("df").over(rarest), F.lit(0))
    split = materialize(weighted.withColumn("_before", before).withColumn(
        "_rare", (F.col("_before") < k) | (F.col("_before") + F.col("df") <= bound_postings)).drop("_before"), "rare")
    # The whole scores of the documents that are best by rare terms: the k-th best of all documents is no lower.
    tried = materialize(topk.ranked(_scored(index, split.where("_rare")), BOUND_DOCUMENTS * k), "tried")
    others = split.where("NOT _rare").select("query_id", "bucket", "term", "weight", "parts")
    last = topk.ranked(_completed(index, tried, others), k).where(F.col("rank") == k).select(
        "query_id", (F.col("score") - _ROOM).alias("floor"))
    least = Window.partitionBy("query_id").orderBy("bound", "term").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    judged = weighted.join(_few(materialize(last, "floors")), "query_id", "left")
    judged = materialize(judged.withColumn("reach", F.sum("bound").over(least)).withColumn(
        "decides", F.coalesce(F.col("reach") >= F.col("floor"), F.lit(True))), "judged")
    found = _scored(index, materialize(judged.where("decides"), "deciding"))
    rest = judged.where("NOT decides").groupBy("query_id").agg(F.max("reach").alias("rest"), F.first("floor").alias(
        "floor"))
    open_ = found.join(_few(materialize(rest, "rest")), "query_id", "left")
    open_ = materialize(open_.where(F.col("rest").isNull() | (F.col("score") + F.col("rest") >= F.col("floor"))).select(
        "query_id", "doc_id", "score"), "open")
    # The other terms, for these documents only.
    others = judged.where("NOT decides").select("query_id", "bucket", "term", "weight", "parts")
    return _completed(index, open_, others)


def _inverse_frequency(df: Column, n_docs: int) -> Column:
    return F.log1p((F.lit(n_docs) - df + 0.5) / (df + 0.5))


def bm25_topk(queries: DataFrame, corpus: DataFrame | LexicalIndex, k: int = 10,
              plain_postings: int = PLAIN_POSTINGS, bound_postings: int = BOUND_POSTINGS) -> DataFrame:
    """The k best documents of `corpus (doc_id, text)`, or of an index, for each of `queries (query_id, text)`.

    Only documents that share a word with the query are hits. Few postings are scored plainly, many by bounds over
    blocks; both give the same hits. Of a corpus without an index, only the postings of asked words leave their task.
    """
    words = F.coalesce(X.words(F.col("text")), F.array().cast("array<string>"))
    asked = materialize(query_terms(queries.select("query_id", words.alias("words"))), "query-terms")
    if isinstance(corpus, LexicalIndex):
        index, posted = corpus, None
        n_words = index.n_words
    else:
        posted, n_docs, n_words = asked_postings(corpus, asked)
    if not n_words:
        return topk.ranked(queries.sparkSession.createDataFrame([], topk.HIT), k)
    if posted is not None:
        known = document_frequency(posted)
        weighted = materialize(asked.join(known, "term").select(
            "query_id", "term", "df", (F.col("qtf") * _inverse_frequency(F.col("df"), n_docs)).alias("weight")), "weighted")
        if _reads(weighted) <= plain_postings:
            # Postings move before they meet queries, so that a document's sums are made where it lies.
            met = posted.repartition("doc_id").join(_few(weighted.drop("df")), "term")
            share = F.col("weight") * _saturation(F.col("tf"), F.col("dl"), n_words / n_docs)
            return _best(met.select("query_id", "doc_id", share.alias("share")).groupBy("query_id", "doc_id").agg(
                F.sum("share").alias("score")), k)
        index = LexicalIndex(materialize(blocks_of(posted, n_words / n_docs), "blocks"), n_docs, n_words, BUCKETS)
    weighted = materialize(weighted_terms(asked, index), "weighted")
    if _reads(weighted) <= plain_postings:
        return _best(_scored(index, weighted.select("query_id", "bucket", "term", "weight")), k)
    return _best(_by_bounds(index, weighted, k, bound_postings), k)


def _reads(weighted: DataFrame) -> int:
    return weighted.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]


def _best(scores: DataFrame, k: int) -> DataFrame:
    return topk.ranked(scores.withColumn("score", F.round("score", DIGITS)), k)
