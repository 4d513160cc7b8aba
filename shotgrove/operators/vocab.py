"""Vocabulary by frequency, and tokens to ids and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from shotgrove.operators.numbering import row_numbers
from shotgrove.session import materialize
from shotgrove.tasks import SPECIAL_TOKENS, UNK

# Rows of the vocabulary head that is broadcast (200 bytes each in a task); ids follow frequency, so it holds every
# common token.
HEAD_ROWS = 200_000


def build_vocab(token_rows: DataFrame, column: str = "token") -> DataFrame:
    """(token, n, token_id): special tokens first, then by count and spelling."""
    counted = (token_rows.where(~F.col(column).isin(*SPECIAL_TOKENS))
               .groupBy(F.col(column).alias("token")).agg(F.count(F.lit(1)).alias("n")))
    numbered = row_numbers(counted, [F.col("n").desc(), F.col("token")], "_number")
    special = token_rows.sparkSession.createDataFrame(
        [(t, 0, i) for i, t in enumerate(SPECIAL_TOKENS)], "token string, n bigint, token_id bigint")
    return special.unionByName(numbered.select(
        "token", "n", (F.col("_number") + (len(SPECIAL_TOKENS) - 1)).alias("token_id")))


def stored_vocab(vocab: DataFrame) -> DataFrame:
    """Write the vocabulary once; it is read several times below."""
    return materialize(vocab, "vocab")


def _looked_up(rows: DataFrame, items: str, vocab: DataFrame, key: str, value: str, head_rows: int) -> DataFrame:
    """`rows` with the list `_found`: `value` of `vocab` for each of `items`, NULL where there is none.

    Common entries are looked up row by row in a broadcast of `head_rows` entries at most, so lists are neither
    taken apart nor moved. Only items that the head leaves open are, and only where the vocabulary is larger.
    """
    spark = rows.sparkSession
    kind = vocab.schema[value].dataType
    out = pa.int64() if isinstance(kind, LongType) else pa.string()
    head = vocab.where(F.col("token_id") < head_rows).select(key, value).toArrow()
    shared = spark.sparkContext.broadcast(dict(zip(head[key].to_pylist(), head[value].to_pylist())))

    @F.arrow_udf(ArrayType(kind))
    def look_up(lists: pa.Array) -> pa.Array:
        encoded = lists.flatten().dictionary_encode()
        values = pa.array([shared.value.get(v) for v in encoded.dictionary.to_pylist()], out)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.take(encoded.indices))

    found = rows.withColumn("_found", look_up(F.col(items)))
    tail = vocab.where(F.col("token_id") >= head_rows).select(F.col(key).alias("_item"), F.col(value).alias("_tail"))
    if tail.isEmpty():
        return found
    stored = materialize(found.withColumn("_row", F.monotonically_increasing_id()), "looked-up")
    open_ = stored.where(F.exists("_found", lambda v: v.isNull())).select("_row", F.explode(F.filter(
        F.transform(F.arrays_zip(F.col(items).alias("item"), F.col("_found").alias("found")), lambda x, i: F.struct(
            i.alias("pos"), x["item"].alias("item"), x["found"].isNull().alias("open"))), lambda x: x["open"])).alias("o"))
    late = open_.select("_row", "o.pos", F.col("o.item").alias("_item")).join(tail, "_item").groupBy("_row").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "_tail"))).alias("_late"))  # items of one row
    whole = stored.join(late, "_row", "left").withColumn("_found", F.transform(
        "_found", lambda v, i: F.coalesce(v, F.try_element_at("_late", i))))
    return whole.drop("_row", "_late")


def encode_ids(features: DataFrame, vocab: DataFrame, key: str = "guid", tokens: str = "tokens",
               head_rows: int = HEAD_ROWS) -> DataFrame:
    """(key, ids): token ids in token order; unknown tokens get the id of the unknown token, no tokens an empty list."""
    unknown = F.lit(SPECIAL_TOKENS.index(UNK)).cast("bigint")
    found = _looked_up(features.select(key, tokens), tokens, vocab, "token", "token_id", head_rows)
    ids = F.transform(F.coalesce("_found", F.array().cast("array<bigint>")), lambda v: F.coalesce(v, unknown))
    return found.select(key, ids.alias("ids"))


def decode_ids(encoded: DataFrame, vocab: DataFrame, key: str = "guid", ids: str = "ids",
               head_rows: int = HEAD_ROWS) -> DataFrame:
    """(key, text): tokens of the ids, joined by a space; an id that is none adds nothing, no ids give an empty text."""
    rows = encoded.select(key, F.col(ids).cast("array<bigint>").alias(ids))
    found = _looked_up(rows, ids, vocab, "token_id", "token", head_rows)
    return found.select(key, F.array_join(F.coalesce("_found", F.array().cast("array<string>")), " ").alias("text"))


def span_query(sequences: DataFrame, begin: Column, end: Column, tokens: str = "tokens") -> DataFrame:
    """Add `query`: the tokens from position `begin` up to `end`, decoded."""
    return sequences.withColumn("query", F.array_join(F.slice(tokens, begin + 1, end - begin), " "))
