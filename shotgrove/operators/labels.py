"""Labels against their task's label list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotgrove.functions import labels as L
from shotgrove.tasks import TASKS


def label_ids(examples: DataFrame, label_list: DataFrame, strict: bool = True, number: str | None = None) -> DataFrame:
    """Add `label_id`, the position in the label list `(task, label, label_id)`.

    Regression tasks have no list: their `label_id` is NULL, and their label as a number goes to the column
    `number`, if it is named.

    A missing label stays missing. An unknown label fails the job, or is -1 if not strict. The label list
    is configuration with one row per class, hence the broadcast.
    """
    known = F.broadcast(label_list.select("task", "label", F.col("label_id").cast("int").alias("_id")))
    unknown = F.lit(-1) if not strict else F.raise_error(
        F.concat(F.lit("unknown label "), F.col("label"))).cast("int")
    scored = F.col("task").isin(*(s.name for s in TASKS.values() if s.mode == "regression"))
    resolved = F.when(F.col("label").isNull() | scored, F.lit(None).cast("int")).otherwise(F.coalesce("_id", unknown))
    value = [F.when(scored, F.col("label").cast("double")).alias(number)] if number else []
    return examples.join(known, ["task", "label"], "left").select(
        *examples.columns, resolved.alias("label_id"), *value)


def label_distribution(examples: DataFrame, order_key: str) -> DataFrame:
    """Size and first occurrence of every class."""
    return examples.groupBy("task", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min(order_key).alias("first_key"))


def verbalize(label_words: DataFrame, vocab: DataFrame) -> DataFrame:
    """Label words to vocabulary ids: (task, label, word, word_id, problem).

    A word has to be one token of the vocabulary. Label words are configuration of a few rows; the small
    side is broadcast, so the vocabulary is scanned once and not shuffled.
    """
    wanted = label_words.select(
        "task", "label", "word", F.ltrim(L.label_word(F.col("word"))).alias("token"))
    found = (vocab.join(F.broadcast(wanted.select("token").distinct()), "token", "left_semi")
             .select("token", F.col("token_id").alias("word_id")))
    return wanted.join(found, "token", "left").select(
        "task", "label", "word", F.coalesce("word_id", F.lit(-1)).alias("word_id"),
        F.when(F.col("word_id").isNull(), "not one token").otherwise("").alias("problem"))
