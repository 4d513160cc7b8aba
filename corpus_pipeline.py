"""The corpus pipeline: stages that filter and change documents, one after the other.

Every stage takes (spark, documents, folder of the tables) and returns documents, the last one a report. Stages are
cut apart by tables in the shared folder, so that each runs once and a lost executor repeats no more than its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shotgrove.llm.bpe import encode_documents
from shotgrove.llm.decontaminate import drop_contaminated
from shotgrove.llm.jaccard_join import keep_one_of_each
from shotgrove.llm.language_id import keep_known
from shotgrove.llm.pseudonyms import hide_personal_data
from shotgrove.session import materialize

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known),
    ("jaccard_join", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("pseudonyms", hide_personal_data),
    ("bpe", encode_documents),
]

# Trained, compressed and keyed stages have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        documents = materialize(stage(spark, documents, sf_dir), name)
    return STAGES[-1][1](spark, documents, sf_dir)
