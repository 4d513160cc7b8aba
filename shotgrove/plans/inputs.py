"""Standard inputs derived from the tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrove.operators.examples import adjacent_pairs
from shotgrove.plans.registry import table


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their labels."""
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")


def _example(task: str, guid, text_a, text_b, label) -> list:
    return [F.lit(task).alias("task"), F.lit("train").alias("split"), F.concat(F.lit("train-"), guid).alias("guid"),
            text_a.alias("text_a"), text_b.cast("string").alias("text_b"), label.cast("string").alias("label")]


def quality_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Single texts in two classes."""
    return labelled(spark, folder).select(
        *_example("quality", F.col("doc_id").cast("string"), F.col("text"), F.lit(None), F.col("quality")))


def language_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Single texts in four classes."""
    return table(spark, folder, "documents").select(
        *_example("language", F.col("doc_id").cast("string"), F.col("text"), F.lit(None), F.col("lang")))


def priority_examples(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in five classes."""
    return table(spark, folder, "orders").select(
        *_example("priority", F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.lit(None),
                  F.col("o_orderpriority")))


def turn_examples(spark: SparkSession, folder: str) -> DataFrame:
    """A turn and the one after it; the class is who speaks second."""
    pairs = adjacent_pairs(table(spark, folder, "conversations"))
    return pairs.select(*_example("turns", F.concat_ws(".", "conv_id", "turn"), F.col("text_a"), F.col("text_b"),
                                  F.col("label")))


def vectors(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias(key), F.col("embedding").alias("emb"))


def passages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that have a vector."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return documents.join(vectors(spark, folder), "doc_id")


_QUALITY = """quality AS (
    SELECT 'quality' AS task, 'train' AS split, 'train-' || d.doc_id AS guid, d.text AS text_a,
           CAST(NULL AS VARCHAR) AS text_b, CAST(l.quality AS VARCHAR) AS label
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

_LANGUAGE = """language AS (
    SELECT 'language' AS task, 'train' AS split, 'train-' || doc_id AS guid, text AS text_a,
           CAST(NULL AS VARCHAR) AS text_b, lang AS label FROM documents)"""

_PRIORITY = """priority AS (
    SELECT 'priority' AS task, 'train' AS split, 'train-' || o_orderkey AS guid, o_orderstatus AS text_a,
           CAST(NULL AS VARCHAR) AS text_b, o_orderpriority AS label FROM orders)"""

_TURNS = """turns AS (
    SELECT 'turns' AS task, 'train' AS split, 'train-' || a.conv_id || '.' || a.turn AS guid, a.text AS text_a,
           b.text AS text_b, b.role AS label
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""

_VECTORS = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"

SQL_PARTS = {"quality": _QUALITY, "language": _LANGUAGE, "priority": _PRIORITY, "turns": _TURNS, "v": _VECTORS}


def with_parts(*names: str) -> str:
    """`WITH` clause that defines the named inputs."""
    return "WITH " + ",\n".join(SQL_PARTS[n] for n in names)


SQL_TOKENS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\s]')"
SQL_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
