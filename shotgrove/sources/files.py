"""Task files with stable row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotgrove.operators import examples as E
from shotgrove.tasks import task as lookup

# Rows of the table of file blocks that may be broadcast: one row for each 128 MB read.
MAX_BLOCKS = 1_000_000


def _numbered(rows: DataFrame) -> DataFrame:
    """Add `line_no` from 0, in file order, without sorting the lines.

    Lines of a file block are contiguous in their task, so their running id gives the position in the
    block; the lines of all blocks before it are added from a table with one row per block.
    """
    tagged = rows.withColumns({
        "_path": F.xxhash64("_metadata.file_path"), "_file": F.col("_metadata.file_path"),
        "_start": F.col("_metadata.file_block_start"), "_seq": F.monotonically_increasing_id()})
    blocks = tagged.groupBy("_file", "_path", "_start").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "_path", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    small = offsets.limit(MAX_BLOCKS + 1).toArrow()
    if small.num_rows <= MAX_BLOCKS:
        offsets = F.broadcast(rows.sparkSession.createDataFrame(small))
    return (tagged.join(offsets, ["_path", "_start"])
            .withColumn("line_no", F.col("_seq") + F.col("_shift")).select(*rows.columns, "line_no"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no) of a text file or of a folder of part files in name order."""
    return _numbered(spark.read.text(path))


_QUOTED = {"quote": '"', "escape": '"'}
_CSV = "label string, text string"


def read_csv_rows(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(label, text, line_no) of a header-less csv file or a folder of part files; `line_no` counts records from 0.

    Quotes are doubled inside quotes, empty lines are no records. Files are read by many tasks, also where texts have
    line breaks; `multi_line=False` spares the pass that finds out which blocks begin inside a text.
    """
    if not multi_line:
        return _numbered(spark.read.schema(_CSV).options(**_QUOTED).csv(path))
    fields = F.from_csv("record", F.lit(_CSV), _QUOTED)
    return quoted_records(spark, path).select(fields.alias("f"), "line_no").select("f.label", "f.text", "line_no")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array, np.ndarray]]:
    """(file and start of a block, lines, quotes before each line and in all) in file order, piece by piece."""
    for batch in batches:
        files, starts = batch.column("file").to_pylist(), batch.column("start").to_numpy()
        change = [i for i in range(1, len(files)) if files[i] != files[i - 1] or starts[i] != starts[i - 1]]
        for a, b in zip([0, *change], [*change, len(files)]):
            if b > a:
                lines = batch.column("value").slice(a, b - a)
                quotes = pc.count_substring(lines, '"').to_numpy()
                yield (files[a], int(starts[a])), lines, np.concatenate([[0], np.cumsum(quotes)])


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: its quotes, and the records that begin in it if it begins outside, or inside, quotes."""
    found: dict[tuple[str, int], list[int]] = {}  # the blocks of one task
    for block, lines, quotes in _blocks(batches):
        held = found.setdefault(block, [0, 0, 0])
        odd = (held[0] + quotes[:-1]) % 2 == 1
        filled = pc.greater(pc.utf8_length(pc.utf8_rtrim(lines, "\r")), 0).to_numpy(zero_copy_only=False)
        held[1] += int((filled & ~odd).sum())
        held[2] += int((filled & odd).sum())
        held[0] += int(quotes[-1])
    rows = [(f, s, *counts) for (f, s), counts in found.items()]
    yield pa.RecordBatch.from_pylist([dict(zip(_COUNTS.names, r)) for r in rows], schema=_COUNTS)


_COUNTS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("quotes", pa.int64()), ("outside", pa.int64()),
                     ("inside", pa.int64())])
_PART = pa.schema([("line_no", pa.int64()), ("place", pa.int64()), ("record", pa.string()), ("whole", pa.bool_())])


def _cut_records(batches: Iterator[pa.RecordBatch], before: dict[tuple[str, int], tuple[int, int]]
                 ) -> Iterator[pa.RecordBatch]:
    """Records that lie in one block, and the parts of those that do not, with their numbers.

    `before` has, for each block, the quotes before it in its file and the records before it in all files.
    """
    at: tuple[str, int] | None = None
    quotes = number = 0
    waiting: list[str] = []  # lines of the open record

    def part(whole: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
            (number - 1, at[1], "\n".join(waiting), whole), _PART)], schema=_PART)

    # Whether the open record began in an earlier block.
    torn = False
    for block, lines, upto in _blocks(batches):
        if block != at:
            if waiting:
                yield part(False)
            at, waiting = block, []
            quotes, number = before[block]
            torn = quotes % 2 == 1
        inside = (quotes + upto) % 2 == 1
        begins, ends = ~inside[:-1], ~inside[1:]
        filled = pc.greater(pc.utf8_length(pc.utf8_rtrim(lines, "\r")), 0).to_numpy(zero_copy_only=False)
        # Records of one line at once, the others line by line.
        single = begins & ends & filled
        first = np.cumsum(begins & filled)
        own = np.flatnonzero(single)
        yield pa.RecordBatch.from_arrays([pa.array(number + first[own] - 1), pa.array(np.full(len(own), at[1])),
                                          lines.take(pa.array(own)), pa.array(np.ones(len(own), dtype=bool))], schema=_PART)
        base = number
        for i in np.flatnonzero(~(begins & ends)):
            number = base + int(first[i])
            waiting.append(lines[i].as_py())
            if ends[i]:
                yield part(not torn)
                waiting, torn = [], False
        number = base + int(first[-1])
        quotes += int(upto[-1])
    if waiting:
        yield part(False)


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, line_no): the records of a quoted csv file as text, read block by block.

    The number of quotes before a line tells whether it begins inside a text. A first pass counts the quotes of every
    block, and sums over the blocks before it, one row per block, tell each block its state. Then every task cuts its
    blocks into records; only the parts of records that cross a block's end are shuffled.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    counts = lines.mapInArrow(_block_counts, "file string, start long, quotes long, outside long, inside long")
    so_far = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.withColumn("quotes", F.coalesce(F.sum("quotes").over(so_far), F.lit(0))).withColumn(
        "records", F.when(F.col("quotes") % 2 == 1, F.col("inside")).otherwise(F.col("outside")))
    rows = blocks.select("file", "start", "quotes", F.coalesce(F.sum("records").over(earlier), F.lit(0)).alias("number")).limit(
        MAX_BLOCKS + 1).collect()
    if len(rows) > MAX_BLOCKS:
        raise ValueError(f"more than {MAX_BLOCKS} file blocks")
    shared = spark.sparkContext.broadcast({(r["file"], r["start"]): (r["quotes"], r["number"]) for r in rows})
    cut = lines.mapInArrow(lambda batches: _cut_records(batches, shared.value),
                           "line_no long, place long, record string, whole boolean")
    torn = cut.where("NOT whole").groupBy("line_no").agg(F.array_sort(F.collect_list(F.struct("place", "record"))).alias(
        "parts")).select("line_no", F.array_join(F.col("parts.record"), "\n").alias("record"))
    every = cut.where("whole").select("line_no", "record").unionByName(torn)
    return every.select(F.regexp_replace("record", "\r$", "").alias("record"), "line_no")


def read_task(spark: SparkSession, folder: str, task: str, split: str) -> DataFrame:
    """Examples of one split of a task, from `{folder}/{file of the split}.tsv` or `.csv`."""
    spec = lookup(task)
    path = f"{folder}/{spec.files[split]}.{spec.fmt}"
    if spec.fmt == "csv":
        return E.parse_csv_rows(read_csv_rows(spark, path), task, split)
    if spec.fmt == "tsv":
        return E.parse_lines(read_lines(spark, path), task, split)
    raise ValueError(f"task {task!r} has no table of examples")


def read_multilingual(spark: SparkSession, folder: str, split: str, language: str,
                      train_language: str | None = None) -> DataFrame:
    """Examples of the multilingual inference task; training files are one per language."""
    if split == "train":
        path = f"{folder}/XNLI-MT-1.0/multinli/multinli.train.{train_language or language}.tsv"
    elif split == "test":
        path = f"{folder}/XNLI-1.0/xnli.test.tsv"
    else:
        raise ValueError(f"no split {split!r}")
    return E.require_types(E.parse_multilingual(read_lines(spark, path), split, language), pair=True)


def read_records(spark: SparkSession, path: str, task: str, split: str, fmt: str = "parquet") -> DataFrame:
    """Examples from files with named columns."""
    return E.examples_from_records(spark.read.format(fmt).load(path), task, split)
