"""Retrieval corpora and question-answering files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrove.schema import QA_ARTICLES


def open_corpus(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A corpus by table name if the catalog has one of that name, else from a folder of parquet files."""
    if name_or_path.replace("_", "").replace(".", "").isalnum() and spark.catalog.tableExists(name_or_path):
        return spark.table(name_or_path)
    return spark.read.parquet(name_or_path)


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a nested file of articles."""
    return flatten_qa(spark.read.schema(QA_ARTICLES).json(path, multiLine=True))


def flatten_qa(files: DataFrame) -> DataFrame:
    """One row per question of `files (data)`: article, then paragraph, then question.

    The answer is the first one; an unanswerable question has none.
    """
    articles = files.select(F.explode("data").alias("a"))
    paragraphs = articles.select("a.title", F.explode("a.paragraphs").alias("p"))
    questions = paragraphs.select("title", "p.context", F.explode("p.qas").alias("q"))
    impossible = F.coalesce("q.is_impossible", F.lit(False))
    answer = F.when(~impossible, F.get("q.answers", F.lit(0)))
    return questions.select(
        F.col("q.id").alias("qas_id"), "title", F.col("q.question").alias("question_text"),
        F.col("context").alias("context_text"), answer["text"].alias("answer_text"),
        answer["answer_start"].alias("answer_start"), impossible.alias("is_impossible"))
