"""Split folders and example files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotgrove.operators.numbering import row_numbers
from shotgrove.tasks import task as lookup


# How records are written: quotes are doubled inside quotes, blanks are kept.
CSV_WRITTEN = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def setting_folder(root: str, mode: str, task: str, k: int, seed: int) -> str:
    return f"{root.rstrip('/')}/{mode}/{task}/{k}-{seed}"


def write_splits(rows: DataFrame, path: str) -> None:
    """Write drawn rows `(task, k, seed, split, ...)` as parquet, one folder per setting.

    All settings are one job. Rebalancing gives a small split one file and splits a large one.
    """
    rows.hint("rebalance", "task", "k", "seed", "split").write.mode("overwrite").partitionBy("task", "k", "seed", "split").parquet(path)


def write_lines(lines: DataFrame, folder: str) -> None:
    """Write `(value, line_no)` as text, in order over the part files; the header is line 0."""
    (lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select("value")
     .write.mode("overwrite").text(folder))


def with_header(drawn: DataFrame, header: str | None) -> DataFrame:
    """Drawn lines `(value, label, draw)` in class order with the header first, as `(value, line_no)`.

    Used on K-shot splits, which hold K lines per class and seed.
    """
    numbered = row_numbers(drawn, [F.col("label"), F.col("draw")], "line_no").select("value", "line_no")
    if header is None:
        return numbered
    first = drawn.sparkSession.createDataFrame([(header, 0)], "value string, line_no bigint")
    return first.unionByName(numbered)


def write_split_tsv(drawn: DataFrame, folder: str, task: str, split: str, header: str | None) -> str:
    """Write one drawn split of raw lines as `{folder}/{file of the split}.tsv`; returns the path."""
    path = f"{folder}/{lookup(task).files[split]}.tsv"
    write_lines(with_header(drawn, header), path)
    return path


def write_split_csv(drawn: DataFrame, folder: str, split: str, shown: str = "label") -> str:
    """Write one drawn split `(label, text, draw)` as csv in class order, with the label in `shown`; returns the path."""
    path = f"{folder}/{split}.csv"
    (drawn.repartitionByRange("label", "draw").sortWithinPartitions("label", "draw").select(shown, "text")
     .write.mode("overwrite").options(header=False, **CSV_WRITTEN).csv(path))
    return path


def to_json_lines(features: DataFrame) -> DataFrame:
    """One JSON document per feature row, as column `value`; missing values are written as null."""
    return features.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_json(features: DataFrame, path: str) -> None:
    to_json_lines(features).write.mode("overwrite").text(path)
