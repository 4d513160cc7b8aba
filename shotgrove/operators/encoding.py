"""Examples to fixed-length token features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotgrove.functions import templates as P
from shotgrove.functions import text as X
from shotgrove.tasks import CLS, MASK, PAD, SEP


def render_prompts(examples: DataFrame, templates: dict[str, str],
                   retrieved: list[Column] | None = None) -> DataFrame:
    """Add `prompt` for all tasks in one projection; tasks without a template get NULL."""
    texts = [F.coalesce("text_a", F.lit("")), F.col("text_b")]
    chosen = F.lit(None).cast("string")
    for name, template in templates.items():
        chosen = F.when(F.col("task") == name, P.render(template, texts, retrieved)).otherwise(chosen)
    return examples.withColumn("prompt", chosen)


def _with_tokens(df: DataFrame, pieces: list[Column], segments: list[int]) -> DataFrame:
    """Concatenate token pieces; each piece is computed once and also gives the segment ids."""
    names = [f"_piece{i}" for i in range(len(pieces))]
    staged = df.select("*", *[p.alias(n) for p, n in zip(pieces, names)])
    seg = F.concat(*[F.array_repeat(F.lit(s), F.size(n)) for s, n in zip(segments, names)])
    return staged.select(*df.columns, F.concat(*names).alias("_tokens"), seg.alias("_segments"))


def prompt_tokens(examples: DataFrame, template: str, first_limit: int | None = None,
                  other_limit: int | None = None, retrieved: list[Column] | None = None) -> DataFrame:
    """Add raw `_tokens` and `_segments` of a template."""
    texts = [F.coalesce("text_a", F.lit("")), F.col("text_b")]
    parts = P.compile_template(template)
    return _with_tokens(
        examples, [P.part_tokens(p, texts, retrieved, first_limit, other_limit) for p in parts],
        P.segment_numbers(parts))


def plain_tokens(examples: DataFrame) -> DataFrame:
    """Add raw tokens without a prompt: cls, then each text followed by sep."""
    second = F.when(F.col("text_b").isNull(), F.array().cast("array<string>")).otherwise(
        F.concat(X.tokens(F.col("text_b")), F.array(F.lit(SEP))))
    first = F.concat(X.tokens(F.coalesce("text_a", F.lit(""))), F.array(F.lit(SEP)))
    return _with_tokens(examples, [F.array(F.lit(CLS)), first, second], [0, 0, 1])


def fix_length(df: DataFrame, max_length: int | None, truncate_head: bool = False, segments: bool = True,
               prompt: bool = True) -> DataFrame:
    """Pad or cut `_tokens` to `max_length` and add the masks.

    The tail is cut by default; cutting the head keeps the last tokens and puts cls in front. `mask_pos`
    is the first mask token, -1 where it was cut off. `segments=False` leaves segment ids out, for
    encoders that have none. Without a `max_length` every row keeps its own length.
    """
    if max_length is None:
        out = df.select(
            *[c for c in df.columns if c not in ("_tokens", "_segments")], F.col("_tokens").alias("tokens"),
            F.array_repeat(F.lit(1), F.size("_tokens")).alias("attention_mask"),
            *([F.col("_segments").alias("segment_ids")] if segments else []),
            F.size("_tokens").alias("n_tokens"), F.lit(False).alias("truncated"))
        return out.withColumn("mask_pos", F.array_position("tokens", MASK).cast("int") - 1) if prompt else out
    n, longest = F.size("_tokens"), F.lit(max_length)

    def fixed(name: str, first: Column, filler: Column) -> Column:
        if truncate_head:
            cut = F.concat(F.array(first), F.slice(name, -(max_length - 1), max_length - 1))
        else:
            cut = F.slice(name, 1, max_length)
        return F.when(n > max_length, cut).otherwise(F.concat(F.col(name), F.array_repeat(filler, longest - n)))

    kept = F.least(n, longest)
    out = df.select(
        *[c for c in df.columns if c not in ("_tokens", "_segments")],
        fixed("_tokens", F.lit(CLS), F.lit(PAD)).alias("tokens"),
        F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), longest - kept)).alias("attention_mask"),
        *([fixed("_segments", F.lit(0), F.lit(0)).alias("segment_ids")] if segments else []),
        n.alias("n_tokens"), (n > max_length).alias("truncated"))
    return out.withColumn("mask_pos", F.array_position("tokens", MASK).cast("int") - 1) if prompt else out


def require_mask(features: DataFrame) -> DataFrame:
    """Fail the job at a prompt whose mask was cut off."""
    return features.withColumn("mask_pos", F.when(F.col("mask_pos") >= 0, F.col("mask_pos")).otherwise(
        F.raise_error(F.concat(F.lit("mask outside the length limit: "), F.col("guid"))).cast("int")))


def token_stats(features: DataFrame, by: list[str]) -> DataFrame:
    """Tokens kept and the shares of cut rows and of padding."""
    kept, length = F.expr("aggregate(attention_mask, 0, (a, x) -> a + x)"), F.size("tokens")
    return features.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(kept).alias("n_tokens"),
        F.avg(F.col("truncated").cast("int")).alias("truncated_share"),
        (1 - F.sum(kept) / F.sum(length)).alias("padding_share"))
