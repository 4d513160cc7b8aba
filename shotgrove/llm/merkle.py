r"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces.

A paragraph is a line, a section eight consecutive paragraphs. A paragraph's node is the SHA-256 of its text, a
section's that of its paragraphs' nodes, the root that of the sections' nodes: equal texts have equal roots, and where
roots differ only differing branches need to be followed to find the edit. Below a paragraph lie its pieces (some
words of a sentence), each with a short code of its hash and its length, so that the likeness of two
fingerprints can be read from the fingerprints alone: the share of characters in common pieces, of all pieces.

The fingerprint is a string `root:pieces`, sixteen hexadecimal digits per piece, in order. All of it is computed from
the whole text by column expressions.

Defined results: NULL and empty texts have the same fingerprint, the root of an empty tree without pieces, and are
alike to each other by 1 and to other texts by 0. Repeated rows are documents of their own; of rows with the same id the
one with the lesser text comes first. NULL ids come first. Very long texts only make long fingerprints.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotgrove.llm.common import hinted, read, text_or_empty
from shotgrove.session import materialize

SECTION_PARAGRAPHS = 8
# A piece ends after a sentence sign, after white space that follows one of a few letters and digits, or after 48
# characters, so that an insertion changes the pieces around it only.
PIECE_PATTERN = r"[^\n]{1,48}?(?:[.!?]+\s*|(?<=[ent037])\s+|\n+|$)|[^\n]{1,48}|\n+"

# Bits of a piece's code that hold its length.
LENGTH_BITS = 20

# Characters of text in one ordered bucket, and the most ids that mark the ranges of buckets.
BUCKET_CHARS = 4_000_000
MARKS = 2000


def pieces(text: Column) -> Column:
    """One long per piece: the hash above, the length in characters below."""
    found = F.regexp_extract_all(text, F.lit(PIECE_PATTERN), F.lit(0))
    mask = (1 << LENGTH_BITS) - 1
    return F.transform(found, lambda p: F.xxhash64(p).bitwiseAND(F.lit(~mask)).bitwiseOR(
        F.least(F.length(p), F.lit(mask)).cast("bigint")))


def paragraph_nodes(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p, 256))


def section_nodes(paragraphs: Column) -> Column:
    starts = F.sequence(F.lit(1), F.size(paragraphs), F.lit(SECTION_PARAGRAPHS))
    return F.transform(starts, lambda s: F.sha2(F.array_join(F.slice(paragraphs, s, SECTION_PARAGRAPHS), ""), 256))


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(sections, ""), 256)


def _length(codes: Column) -> Column:
    mask = (1 << LENGTH_BITS) - 1
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda total, c: total + c.bitwiseAND(F.lit(mask)))


def likeness(left_root: Column, left: Column, right_root: Column, right: Column) -> Column:
    """Characters in common pieces as a share of those in all distinct pieces; 1 for equal roots."""
    shared, together = _length(F.array_intersect(left, right)), _length(F.array_union(left, right))
    return (F.when(left_root == right_root, F.lit(1.0))
            .when(together == 0, F.lit(0.0)).otherwise(shared / together))


def written(tree_root: Column, codes: Column) -> Column:
    return F.concat(tree_root, F.lit(":"), F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c), 16, "0")), ""))


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the columns name_root, name_sections, name_paragraphs and name_pieces."""
    df = df.withColumn(f"{name}_paragraphs", paragraph_nodes(F.col(text)))
    df = df.withColumns({f"{name}_sections": section_nodes(F.col(f"{name}_paragraphs")),
                         f"{name}_pieces": pieces(F.col(text))})
    return df.withColumn(f"{name}_root", root(F.col(f"{name}_sections")))


def differing_paragraphs(left: str, right: str) -> Column:
    """Positions (from 0) of the right tree's paragraphs that differ from the left's at the same place.

    `left` and `right` are names given to `with_tree`. Equal roots end the search at the root, equal sections at the
    section.
    """
    sections = F.sequence(F.lit(0), F.size(f"{right}_sections") - 1)
    changed = F.filter(sections, lambda s: ~F.get(f"{right}_sections", s).eqNullSafe(F.get(f"{left}_sections", s)))

    def inside(s: Column) -> Column:
        last = F.least((s + 1) * SECTION_PARAGRAPHS, F.size(f"{right}_paragraphs")) - 1
        return F.filter(F.sequence(s * SECTION_PARAGRAPHS, last), lambda p: ~F.get(
            f"{right}_paragraphs", p).eqNullSafe(F.get(f"{left}_paragraphs", p)))

    return F.when(F.col(f"{left}_root") == F.col(f"{right}_root"), F.array().cast("array<int>")).otherwise(
        F.flatten(F.transform(changed, inside)))


def with_next(documents: DataFrame, bucket_chars: int = BUCKET_CHARS, marks: int = MARKS) -> DataFrame:
    """(doc_id, text, next_text): the next row by ascending doc_id, after the last row the first.

    Rows go to buckets of neighbouring ids and are ordered inside; the first row of each bucket is also sent to the
    bucket before it. The buckets follow the ids' distribution: `marks` percentiles over all rows, and equal widths
    between two marks, so the number of buckets is free while what the driver holds is bounded.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty(documents).alias("text"))
    fractions = [i / marks for i in range(marks + 1)]
    seen = rows.agg(F.percentile_approx("doc_id", fractions, 10 * marks).alias("marks"),
                    F.sum(F.length("text")).alias("chars")).first()
    bounds = np.unique(np.array(seen["marks"] or [0], dtype=np.int64))
    inner = max(1, round((seen["chars"] or 0) / bucket_chars / max(1, len(bounds))))
    joint = max(1, round(len(bounds) * bucket_chars / max(1, seen["chars"] or 1)))

    @F.pandas_udf("bigint")
    def bucket_of(ids: pd.Series) -> pd.Series:
        values = ids.fillna(bounds[0] - 1).to_numpy().astype(np.int64)
        at = np.searchsorted(bounds, values, side="right")  # 0: before the first mark
        low = bounds[np.maximum(at - 1, 0)]
        high = bounds[np.minimum(at, len(bounds) - 1)]
        share = (values - low).astype(float) / np.maximum(high - low, 1)
        part = np.where((at > 0) & (at < len(bounds)), np.minimum(inner - 1, (share * inner).astype(np.int64)), 0)
        return pd.Series((at * inner + part) // (joint if inner == 1 else 1))

    rows = rows.withColumn("_bucket", bucket_of("doc_id"))
    # One row per bucket; the bucket before the first one is the last one.
    firsts = materialize(rows.groupBy("_bucket").agg(F.min_by("doc_id", F.coalesce("doc_id", F.lit(-2 ** 63)))
                                                     .alias("_first")), "firsts")
    ordered = Window.orderBy("_bucket")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    targets = materialize(firsts.select(
        F.col("_bucket").alias("_own"), "_first",
        F.coalesce(F.lag("_bucket").over(ordered), F.last("_bucket").over(whole)).alias("_target")), "targets")
    joined = rows.join(hinted(targets), (F.col("_bucket") == F.col("_own"))
                       & F.col("doc_id").eqNullSafe(F.col("_first")), "left")
    own = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("_target").alias("b"), F.lit(True).alias("guest"))
    placed = joined.withColumn("_place", F.explode(F.when(F.col("_target").isNull(), F.array(own))
                                                   .otherwise(F.array(own, guest))))
    order = Window.partitionBy("_place.b").orderBy("_place.guest", "doc_id", "text")
    return (placed.withColumn("next_text", F.lead("text").over(order)).where(~F.col("_place.guest"))
            .select("doc_id", "text", "next_text"))


def fingerprints(pairs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text) with the edited text's and the next text's likeness to the text."""
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    trees = pairs.withColumns({"n_chars": n.cast("bigint"), "edited": edited})
    for text, name in (("text", "t"), ("edited", "e")):
        trees = with_tree(trees, text, name)
    trees = trees.withColumns({"n_root": root(section_nodes(paragraph_nodes(F.col("next_text")))),
                               "n_pieces": pieces(F.col("next_text"))})
    return trees.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("t_root"), F.col("t_pieces")).alias("fingerprint"),
        written(F.col("e_root"), F.col("e_pieces")).alias("edited_fingerprint"),
        likeness(F.col("t_root"), F.col("t_pieces"), F.col("e_root"), F.col("e_pieces")).alias("near_edited"),
        likeness(F.col("t_root"), F.col("t_pieces"), F.col("n_root"), F.col("n_pieces")).alias("near_next"),
        differing_paragraphs("t", "e").alias("edited_paragraphs"))


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(with_next(read(spark, folder, "documents")))
