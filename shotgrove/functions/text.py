"""Text expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The spellings that a data-frame reader takes as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

WORD_PATTERN = r"[\p{L}\p{N}]+"
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def null_tokens(text: Column) -> Column:
    """Missing-value spellings become NULL."""
    return F.when(~text.isin(*NA_TOKENS), text)


def tokens(text: Column) -> Column:
    """Words and single punctuation marks, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case words, as the lexical index stores them."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def explode_once(df: DataFrame, keep: list[str], items: Column, name: str) -> DataFrame:
    """`keep` and one row per item, without a row for an empty list.

    A plain explode of a computed list makes the optimizer check its size first, which computes it twice.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def field(fields: Column, position: int) -> Column:
    """Field by position from 0 (negative: from the end); NULL where the row is too short."""
    return F.try_element_at(fields, F.lit(position + 1 if position >= 0 else position))


def split_line(line: Column) -> Column:
    """Tab-separated fields without quoting; trailing empty fields are kept."""
    return F.split(line, "\t", -1)


def strip(text: Column) -> Column:
    """Remove every kind of leading and trailing white space (trim takes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def concat_fields(*parts: Column, sep: str = " ") -> Column:
    """Join the fields that are present."""
    return F.concat_ws(sep, *parts)


def pair_text(text_a: Column, text_b: Column, sep: str) -> Column:
    """`a sep b`, or `a` alone where there is no second text."""
    return F.when(text_b.isNull(), text_a).otherwise(F.concat(text_a, F.lit(f" {sep} "), text_b))


def text_list(text_a: Column, text_b: Column) -> Column:
    """The example's one or two texts; a missing single text is the empty string."""
    return (F.when(text_b.isNull(), F.array(F.coalesce(text_a, F.lit(""))))
            .otherwise(F.array(text_a, text_b)))


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def drop_last(text: Column) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - 1)
