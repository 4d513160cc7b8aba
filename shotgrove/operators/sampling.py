"""Seeded, class-balanced K-shot splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotgrove.functions.labels import binarize
from shotgrove.operators.numbering import top_per_group
from shotgrove.operators.topk import small_table
from shotgrove.session import materialize
from shotgrove.tasks import MEDIANS, SEEDS, SHOTS

DEV_RATE = {"k-shot": 2, "k-shot-10x": 11}
FULL_SET_DEV = 100


def order_key(seed: Column, task: Column, guid: Column) -> Column:
    """Position of an example in the shuffle of a seed; it does not depend on partitioning."""
    return F.md5(F.concat_ws(":", seed, task, guid))


def seed_grid(examples: DataFrame, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """Every example once per seed, with its shuffle key, as one plan instead of a loop."""
    keyed = examples.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return keyed.withColumn("shuffle_key", order_key(F.col("seed"), F.col("task"), F.col("guid")))


# Fewer rows than this are ranked without a cut first; more classes than this are not counted on the driver.
CUT_FROM_ROWS = 200_000
MAX_CLASSES = 100_000


def _cut_keys(rows: DataFrame, seeds: tuple[int, ...], limit: int, cut_from: int) -> DataFrame | None:
    """The keyed rows that can be among the first `limit` of their class, or None if that is not worth it.

    Shuffle keys are uniform, so the first rows of a class lie below a cut that follows from its size. A class
    that kept too few rows by chance is noticed, and then no cut is made.
    """
    sizes = small_table(rows.groupBy("task", "label").agg(F.count(F.lit(1)).alias("n")), MAX_CLASSES)
    if sizes is None or sum(sizes["n"].to_pylist()) * len(seeds) < cut_from:
        return None
    wanted = 4 * limit + 64
    cuts = [(r["task"], r["label"], r["n"], format(min(wanted * 2**128 // r["n"], 2**128 - 1), "032x"))
            for r in sizes.to_pylist()]
    table = F.broadcast(rows.sparkSession.createDataFrame(cuts, "_task string, _label string, _n bigint, _cut string"))
    same = (F.col("task") == F.col("_task")) & F.col("label").eqNullSafe(F.col("_label"))
    keyed = seed_grid(rows.join(table, same), seeds).where(F.col("shuffle_key") <= F.col("_cut"))
    kept = materialize(keyed.select("task", "seed", "label", "guid", "shuffle_key", "_n"), "keys")
    complete = (kept.groupBy("task", "seed", "label").agg(F.count(F.lit(1)).alias("kept"), F.max("_n").alias("n"))
                .where(F.col("kept") >= F.least("n", F.lit(limit))).count())
    return kept.drop("_n") if complete == len(cuts) * len(seeds) else None


def _ranked(examples: DataFrame, seeds: tuple[int, ...], limit: int, cut_from: int = CUT_FROM_ROWS) -> DataFrame:
    """Keys of the first `limit` examples of each class; texts are left out, and most keys are not sorted."""
    rows = examples.select("task", "guid", sampling_class().alias("label"))
    keys = _cut_keys(rows, seeds, limit, cut_from)
    return top_per_group(seed_grid(rows, seeds) if keys is None else keys, ["task", "seed", "label"],
                         [F.col("shuffle_key"), F.col("guid")], limit, "draw", ["guid"])


def sampling_class() -> Column:
    """The label, or the half of the scores that it lies in for tasks with scores."""
    result = F.col("label")
    for task, median in MEDIANS.items():
        result = F.when(F.col("task") == task, binarize(F.col("label"), median).cast("string")).otherwise(result)
    return result


def draw_splits(examples: DataFrame, k: int = SHOTS, seeds: tuple[int, ...] = SEEDS,
                mode: str = "k-shot", cut_from: int = CUT_FROM_ROWS) -> DataFrame:
    """(task, seed, split, label, draw, guid): K train examples per class and the next ones for dev.

    A class with fewer examples gives all it has.
    """
    limit = k * DEV_RATE[mode]
    return _ranked(examples, seeds, limit, cut_from).select(
        "task", "seed", F.when(F.col("draw") <= k, "train").otherwise("dev").alias("split"),
        "label", "draw", "guid")


def draw_full_set(examples: DataFrame, fmt: str = "tsv") -> DataFrame:
    """K = 0: everything trains. Dev repeats the first 100 per class (tsv) or everything (csv)."""
    seeds = (0,)
    train = seed_grid(examples.select("task", "guid", sampling_class().alias("label")), seeds).select(
        "task", "seed", F.lit("train").alias("split"), "label", "guid")
    dev = train if fmt == "csv" else _ranked(examples, seeds, FULL_SET_DEV)
    return train.unionByName(dev.select("task", "seed", F.lit("dev").alias("split"), "label", "guid"))


def with_rows(draws: DataFrame, examples: DataFrame) -> DataFrame:
    """Put the texts and the examples' own labels back on the drawn keys; what they were drawn by is `class`.

    The keys are written first, so that the planner knows how few they are and leaves the texts in place.
    """
    texts = examples.select("task", "guid", "text_a", "text_b", "label")
    return materialize(draws.withColumnRenamed("label", "class"), "draws").join(texts, ["task", "guid"])


def leaked(splits: DataFrame) -> DataFrame:
    """Train examples that are in dev of the same seed as well."""
    dev = splits.where(F.col("split") == "dev").select("task", "seed", "guid")
    return splits.where(F.col("split") == "train").join(dev, ["task", "seed", "guid"], "left_semi")


def relabel_test(rows: DataFrame, fmt: str = "tsv") -> DataFrame:
    """The original dev split serves as test; csv tasks bring their own test split."""
    if fmt == "csv":
        return rows.where(F.col("split") == "test")
    return (rows.where(~F.col("split").startswith("train"))
            .withColumn("split", F.regexp_replace("split", "dev", "test")))
