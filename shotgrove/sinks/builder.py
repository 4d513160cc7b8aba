"""Split folders of whole tasks: task files in, `{mode}/{task}/{k}-{seed}/{train, dev, test}` files out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrove.functions.labels import raw_line_label
from shotgrove.operators import sampling
from shotgrove.session import materialize
from shotgrove.sinks.splits import CSV_WRITTEN, setting_folder
from shotgrove.sources.files import read_csv_rows, read_lines
from shotgrove.tasks import SEEDS, SHOTS, SPLIT_TASKS
from shotgrove.tasks import task as lookup

# Tasks whose folder has the files of another one as well.
_ALSO = {"mnli": ("mnli-mm",)}


def _lines(spark: SparkSession, folder: str, task: str, file: str) -> DataFrame:
    """(value, label, line_no) of a task file: raw lines of a tsv task with its header, records of a csv task as lines."""
    spec = lookup(task)
    path = f"{folder}/{file}.{spec.fmt}"
    if spec.fmt == "csv":
        record = F.to_csv(F.struct("label", "text"), CSV_WRITTEN)
        return read_csv_rows(spark, path).select(record.alias("value"), "label", "line_no")
    label = raw_line_label(task, F.col("value"), halves=False)
    return read_lines(spark, path).select("value", label.alias("label"), "line_no")


def _union(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def _test_files(task: str) -> dict[str, str]:
    """File name in the task's folder to file name in the split folders: dev files of a tsv task, test files of a csv task."""
    if lookup(task).fmt == "csv":
        return {"test": "test"}
    specs = [lookup(t) for t in (task, *_ALSO.get(task, ()))]
    return {n: n.replace("dev", "test") for spec in specs for s, n in spec.files.items() if s.startswith("dev")}


def _named(task: str, split: Column | str) -> str | Column:
    spec = lookup(task)
    if isinstance(split, str):
        return f"{spec.files[split]}.{spec.fmt}"
    return F.when(split == "train", _named(task, "train")).otherwise(_named(task, "dev"))


def split_lines(spark: SparkSession, data_dir: str, tasks: tuple[str, ...] = SPLIT_TASKS, seeds: tuple[int, ...] = SEEDS,
                k: int = SHOTS, mode: str = "k-shot") -> DataFrame:
    """(task, seed, file, head, label, draw, value): the lines of all files of all tasks and seeds, as one plan.

    The order within a file is by the three columns before `value`: the header, then classes, then draws; lines of a
    test file have no label there and keep their order. Task files are read once for all seeds.
    """
    heads, rows, tests = [], [], []
    for task in tasks:
        spec, folder = lookup(task), f"{data_dir}/{task}"
        train = _lines(spark, folder, task, spec.files["train"])
        header = int(spec.header and spec.fmt == "tsv")
        rows.append(train.where(F.col("line_no") >= header).select(
            F.lit(task).alias("task"), F.col("line_no").cast("string").alias("guid"), "label", "value"))
        if header:
            files = F.array(*[F.lit(_named(task, s)) for s in ("train", "dev")])
            heads.append(train.where(F.col("line_no") < header).select(
                F.lit(task).alias("task"), F.explode(files).alias("file"), F.lit(0).alias("head"),
                F.lit(None).cast("string").alias("label"), F.col("line_no").alias("draw"), "value"))
        for source, file in _test_files(task).items():
            tests.append(_lines(spark, folder, task, source).select(
                F.lit(task).alias("task"), F.lit(f"{file}.{spec.fmt}").alias("file"), F.lit(1).alias("head"),
                F.lit(None).cast("string").alias("label"), F.col("line_no").alias("draw"), "value"))
    every = _union(rows)
    draws = materialize(sampling.draw_splits(every.select("task", "guid", "label"), k, seeds, mode), "draws")
    file = F.coalesce(*[F.when(F.col("task") == t, _named(t, F.col("split"))) for t in tasks])
    drawn = draws.join(every.select("task", "guid", "value"), ["task", "guid"]).select(
        "task", "seed", file.alias("file"), F.lit(1).alias("head"), "label", F.col("draw").cast("bigint").alias("draw"), "value")
    fixed = _union(heads + tests).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return drawn.unionByName(fixed)


def _place(spark: SparkSession, staged: str, moves: dict[str, str]) -> None:
    """Give the folders of a partitioned write their names; a split without lines becomes an empty folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    for source, target in moves.items():
        to, at = path(target), path(source)
        fs.delete(to, True)
        if not fs.exists(at):
            fs.mkdirs(to)
            continue
        fs.mkdirs(to.getParent())
        if not fs.rename(at, to):
            raise OSError(f"{source} could not be moved to {target}")
    fs.delete(path(staged), True)


def build_splits(spark: SparkSession, data_dir: str, out_dir: str, tasks: tuple[str, ...] = SPLIT_TASKS,
                 seeds: tuple[int, ...] = SEEDS, k: int = SHOTS, mode: str = "k-shot") -> list[str]:
    """Write the split folders of all tasks and seeds by one job; returns their paths. Older ones are replaced.

    Lines stay as they are, with the header of the task's train file. Train and dev are drawn by class (scores by
    their half); the dev files of a tsv task become its test files, a csv task brings its own. Every file is a folder of
    part files in order; a large one, such as a test file, is written by several tasks. All files are written beside the
    split folders first, and put in their places when all are complete.
    """
    order = ["task", "seed", "file", "head", "label", "draw"]
    staged = f"{out_dir.rstrip('/')}/_splits-{uuid.uuid4().hex}"
    (split_lines(spark, data_dir, tasks, seeds, k, mode).repartitionByRange(*order).sortWithinPartitions(*order)
     .select("task", "seed", "file", "value").write.partitionBy("task", "seed", "file").text(staged))
    folders, moves = [], {}
    for task in tasks:
        ending = lookup(task).fmt
        names = [_named(task, "train"), _named(task, "dev"), *[f"{f}.{ending}" for f in _test_files(task).values()]]
        for seed in seeds:
            folder = setting_folder(out_dir, mode, task, k, seed)
            moves |= {f"{staged}/task={task}/seed={seed}/file={n}": f"{folder}/{n}" for n in names}
            folders.append(folder)
    _place(spark, staged, moves)
    return folders
