"""Spelling variants: words that differ by one inserted, deleted or replaced code point.

Counting words comes first: tasks count distinct words of many texts at once, Spark adds them up.

A single edit leaves all before and all behind it as it was: with the longer word's length L, common prefix plus common
suffix reach L - 1. So words are dealt to tiles (L, window of places, code points before and behind the window), for
their own length and the next one as L; two words whose edit lies in a window meet in its tile. At first the windows
are the two halves. A tile of many words is split into the halves of its window, again and again; a window of one
place holds no more words than there are letters. In each tile, padded code-point matrices are compared block by block:
the first differing place from the left gives the prefix, from the right the suffix. A pair counts where its first
difference lies in the tile's window, so it counts once. Tiles return one row per word with its number of near words
and the most frequent of them; no pair leaves its tile.

Defined results: NULL and empty texts have no words. A NULL id counts as the empty text in the checksum. Repeated rows
count as often as they occur. Very long texts and runs need no special care. Empty tables give no rows. Further
columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrove.llm.byte_runs import LOWER, crc32_of_runs, distinct, edges, joined, slices
from shotgrove.llm.common import hinted, read
from shotgrove.llm.shingle_sets import text_bytes
from shotgrove.session import materialize

# Fixed values of the task: shortest word, fewest occurrences, share of runs that lose a letter, and by how much more
# frequent a form is.
LEAST_LENGTH, LEAST_COUNT, DAMAGED, FORM_TIMES = 6, 5, 199, 5

# Words of a tile before it is split, and cells that are compared at once.
TILE_WORDS = 128
CELLS = 1 << 22

# Distinct words that a task gathers before it adds them up.
GATHERED = 500_000

_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_LEAD = 0xC3  # first byte of U+00C0 to U+00FF, and of nothing else
_OUTSIDE = ~_ASCII_LETTER
_OUTSIDE[0x80:] = False


def _letters(data: np.ndarray) -> np.ndarray:
    lead = data == _LEAD
    inside = _ASCII_LETTER[data] | lead
    inside[1:] |= lead[:-1]
    return inside


def _words(texts: list[bytes], keys: list[int | None], damaged: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(distinct words, their counts) of some of the texts at a time."""
    begun = np.array([zlib.crc32(f"{'' if k is None else k}:".encode()) for k in keys], dtype=np.uint32)
    for indices, parts in slices(texts, _OUTSIDE):
        data, begins = joined(parts)
        low = LOWER[data]
        starts, ends = edges(_letters(data))
        leads = np.concatenate([[0], np.cumsum(data == _LEAD)])
        length = ends - starts - (leads[ends] - leads[starts])
        long = length >= LEAST_LENGTH
        starts, ends, length = starts[long], ends[long], length[long]
        text = indices[np.searchsorted(begins, starts, side="right") - 1]
        h = crc32_of_runs(low, starts, ends, begun[text]).astype(np.int64)
        hurt = h % damaged == 0
        changed: Counter[bytes] = Counter()
        for i in np.flatnonzero(hurt):
            word = low[starts[i]:ends[i]].tobytes().decode()
            at = int(h[i]) % len(word)
            if len(word) > LEAST_LENGTH:
                changed[(word[:at] + word[at + 1:]).encode()] += 1
        if changed:
            yield pa.array(list(changed), pa.binary()), np.array(list(changed.values()), dtype=np.int64)
        starts, ends = starts[~hurt], ends[~hurt]
        marks = np.zeros(len(data) + 1, dtype=np.int8)
        marks[starts] += 1
        marks[ends] -= 1
        values, codes = distinct(low, np.cumsum(marks[:-1], dtype=np.int8).view(bool), ends - starts)
        yield values, np.bincount(codes, minlength=len(values)).astype(np.int64)


def _added(tables: list[pa.Table]) -> pa.Table:
    total = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")])
    return pa.table({"word": total["word"], "n": total["n_sum"]})


def _as_text(total: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from total.set_column(0, "word", total["word"].cast(pa.string())).to_batches(max_chunksize=100_000)


def word_counts(documents: DataFrame, damaged: int = DAMAGED) -> DataFrame:
    """(word, n) of all words of `documents (doc_id, text)` that are long and frequent enough.

    A run is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased; where `damaged` divides the crc32 of
    "<doc_id>:<run>", one code point is left out.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[pa.Table] = []
        rows = 0
        for batch in batches:
            texts, keys = text_bytes(batch.column("text")), batch.column("doc_id").to_pylist()
            for values, counts in _words(texts, keys, damaged):
                gathered.append(pa.table({"word": values, "n": counts}))
                rows += len(values)
                if rows >= 2 * GATHERED:
                    total = _added(gathered)
                    gathered, rows = [total], total.num_rows
                    if rows >= GATHERED:
                        yield from _as_text(total)
                        gathered, rows = [], 0
        if gathered:
            yield from _as_text(_added(gathered))

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= LEAST_COUNT))


_FRAME = ["long", "low", "high", "tile"]


def _dealt(rows: DataFrame, windows: Column) -> DataFrame:
    """(word, n, size, long, low, high, tile): a row of `rows (word, n, size, long, ...)` for each of its windows."""
    placed = rows.select("word", "n", "size", "long", F.explode(windows).alias("w")).select(
        "word", "n", "size", "long", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    return placed.withColumn("tile", F.xxhash64(
        "long", "low", "high", F.expr("concat(left(word, low), right(word, long - high))")))


def tiles(words: DataFrame, tile_words: int = TILE_WORDS) -> DataFrame:
    """Rows (word, n, size, long, low, high, tile) of all tiles of `words (word, n)` that may hold pairs.

    Tiles are told apart by a hash; what meets under one hash is still compared exactly.
    """
    framed = words.select("word", "n", F.length("word").alias("size")).withColumn(
        "long", F.explode(F.array("size", F.col("size") + 1)))
    middle = F.ceil(F.col("long") / 2).cast("int")
    rows = _dealt(framed, F.array(F.struct(F.lit(0).alias("low"), middle.alias("high")),
                                  F.struct(middle.alias("low"), F.col("long").alias("high"))))
    done: list[DataFrame] = []
    while True:
        rows = materialize(rows, "tiles")
        found = rows.groupBy(*_FRAME).agg(
            F.count("*").alias("members"), F.max((F.col("size") == F.col("long")).cast("int")).alias("owned"))
        wide = F.col("high") - F.col("low") > 1
        found = materialize(found.where("members > 1 AND owned = 1").select(
            *_FRAME, ((F.col("members") > tile_words) & wide).alias("split")), "tile-sizes")
        placed = materialize(rows.join(hinted(found), _FRAME), "placed")
        done.append(placed.where("NOT split").drop("split"))
        large = placed.where("split")
        if large.isEmpty():
            break
        middle = F.ceil((F.col("low") + F.col("high")) / 2).cast("int")
        rows = _dealt(large, F.array(F.struct(F.col("low"), middle.alias("high")),
                                     F.struct(middle.alias("low"), F.col("high"))))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every


def _matrices(words: pa.Array, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words from the left and from the right, padded with 0."""
    flat = np.frombuffer(b"".join(words.cast(pa.binary()).to_pylist()), dtype=np.uint8)
    lead = flat == _LEAD
    points = flat.copy()
    points[1:][lead[:-1]] += 0x40  # 80 to BF after the lead byte is U+00C0 to U+00FF
    column = np.arange(int(size.max()))
    left = np.zeros((len(size), len(column)), dtype=np.uint8)
    left[column < size[:, None]] = points[~lead]
    back = size[:, None] - 1 - column
    right = np.where(back >= 0, np.take_along_axis(left, np.maximum(back, 0), axis=1), 0).astype(np.uint8)
    return left, right


def _first_difference(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Per row, the first place where x and y differ; the width if they never do."""
    differs = x != y
    return np.where(differs.any(axis=1), differs.argmax(axis=1), x.shape[1])


def _tile_matches(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, in tile order, whose words differ by one edit inside the tile's window."""
    size, long, low, high, tile = (table.column(c).to_numpy() for c in ("size", *_FRAME))
    left, right = _matrices(table.column("word").combine_chunks(), size)
    ends = np.append(np.flatnonzero((np.diff(tile) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
                                    | (np.diff(long) != 0)) + 1, len(tile))
    end = ends[np.searchsorted(ends, np.arange(len(tile)), side="right")]
    block = max(1, CELLS // max(1, left.shape[1]))
    first, second = [], []
    here = np.arange(len(tile))
    step = 0
    while len(here):
        step += 1
        here = here[here + step < end[here]]
        for at in range(0, len(here), block):
            i = here[at:at + block]
            j = i + step
            ok = (size[i] == long[i]) | (size[j] == long[j])  # two shorter words meet in their own length's tile
            i, j = i[ok], j[ok]
            prefix = _first_difference(left[i], left[j])
            ok = (prefix >= low[i]) & (prefix < high[i])
            i, j, prefix = i[ok], j[ok], prefix[ok]
            ok = prefix + _first_difference(right[i], right[j]) >= long[i] - 1
            first.append(i[ok])
            second.append(j[ok])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *second])


def _tile_rows(table: pa.Table) -> pa.RecordBatch:
    """(word, near, n, form) of the words with near words: their number, the largest count and the smallest such word."""
    i, j = _tile_matches(table)
    owner, other = np.concatenate([i, j]), np.concatenate([j, i])
    n = table.column("n").to_numpy()
    order = np.lexsort((other, -n[other], owner))  # rows of a tile are ordered by word
    owner, other = owner[order], other[order]
    owners, at, near = np.unique(owner, return_index=True, return_counts=True)
    word = table.column("word").combine_chunks()
    best = other[at]
    return pa.RecordBatch.from_arrays([word.take(pa.array(owners)), pa.array(near.astype(np.int64)), pa.array(n[best]),
                                       word.take(pa.array(best))], names=["word", "near", "n", "form"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole tiles of the sorted rows; the last tile of a batch waits for the next batch."""
    waiting: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if waiting is not None:
            table = pa.concat_tables([waiting, table])
        if not table.num_rows:
            continue
        tile = table.column("tile").to_numpy()
        new = np.flatnonzero(np.diff(tile)) + 1
        cut = int(new[-1]) if len(new) else 0
        if cut:
            yield _tile_rows(table.slice(0, cut))
        waiting = table.slice(cut)
    if waiting is not None:
        yield _tile_rows(waiting)


def near_words(words: DataFrame, tile_words: int = TILE_WORDS) -> DataFrame:
    """(word, n_near, best, best_n) of the words of `words (word, n)` that have near words."""
    dealt = tiles(words, tile_words)
    # By length first, so that the matrices of a batch hold words of like lengths.
    rows = dealt.repartition("tile").sortWithinPartitions("long", "tile", "low", "high", "word")
    found = rows.mapInArrow(_compared, "word string, near long, n long, form string")
    return found.groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "form")).alias("best")).select(
        "word", "n_near", F.col("best.form").alias("best"), (-F.col("best.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from `forms (word, form)`: the last word that forms lead to.

    Counts grow fivefold with each form, so a chain has few links; every round halves it.
    """
    known = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = materialize(known.join(further, "root", "left").select("word", "root", "_next"), "roots")
        if step.where("_next IS NOT NULL").isEmpty():
            return step.select("word", "root")
        known = step.select("word", F.coalesce("_next", "root").alias("root"))


def variants(documents: DataFrame, damaged: int = DAMAGED, tile_words: int = TILE_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of `documents (doc_id, text)`."""
    words = materialize(word_counts(documents, damaged), "words")
    near = near_words(words, tile_words)
    accepted = F.col("best_n") >= FORM_TIMES * F.col("n")
    judged = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(accepted, F.col("best")).alias("form"),
        F.when(accepted, F.col("best_n")).alias("form_n")), "judged")
    last = roots(judged.where("form IS NOT NULL"))
    return judged.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return variants(read(spark, folder, "documents"))
