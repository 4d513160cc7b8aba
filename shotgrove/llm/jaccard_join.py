"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmap signatures, sorted-array intersection.

Two documents link when the distinct five-word shingles of their texts have a Jaccard similarity of 0.8 or more.

1. Equal sets are one class and one node; one of its rows stands for it.
2. Stars: documents that share one of their lowest shingle hashes are compared with the smallest document that shares
   it. This joins groups of near copies without pairs inside the group.
3. Tiles: a similar pair shares a twentieth of its shingles among the first quarter in any common order. Here common
   shingles come last, and documents that share fewer with any other are left out. Documents of different components
   that share such a shingle meet in the tile of that shingle and of a size band (sizes within 1.25 of each other; large
   tiles are cut into blocks that meet two by two). There hashed bitmaps bound the overlap from above: a bit says
   whether an odd number of shingles fall on it, so every bit in which two sets differ takes a shingle that only one of
   them has, and what they share, however much, hides no difference. The lowest shingles have tiles as well: a pair that
   shares some of them is taken from the tile of the lowest one alone. A set is in many tiles, so its rows there hold a
   folded bitmap; the whole ones judge the pairs that pass. Pairs that can reach 0.8 go to
4. exact intersection of the sorted shingle arrays. Links make components.

No link between different texts is lost: the tiles hold every pair of documents that steps 1 and 2 left in different
components and that can be similar. Which shingles count as common only changes the order.

Defined results: NULL and empty texts, and texts without words, have an empty set and link with nothing. A text of
fewer than five words has one shingle. Documents with a NULL id get a NULL component. Rows with the same id are one
document: their texts are linked, but one without words keeps its id. Shingles are compared by 64-bit hashes, and so
are sets, which are the nodes of the graph. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrove.llm.common import free_name, hinted, only_ids, read, without_ids
from shotgrove.llm.graph import components
from shotgrove.llm.shingle_sets import set_id, shingle_sets, text_slices
from shotgrove.session import batches_of, materialize

PERCENT = 80
_POPCOUNT = np.bitwise_count

# Lowest shingle hashes of a document that look for a star.
LOWEST = 8

# A shingle is common if the batches that hold it twice or more count so many documents; of more than COMMON_SHINGLES
# such shingles the most frequent ones are taken.
COMMON_DOCUMENTS, COMMON_SHINGLES = 6, 500_000

# Rows of a tile's block, and band edges: sizes grow by 1 / 0.8.
BLOCK_ROWS = 500

# Tiles go to so many times the usual number of partitions, as each task sorts its own rows. Bitmaps are folded so many
# times for them, but not below MIN_TILE_BITS.
TILE_PARTITIONS, TILE_FOLDS = 2, 4
BAND = math.log(100 / PERCENT)
MIN_BITS, MAX_BITS = 64, 1 << 15
MIN_TILE_BITS = 256

# Batches of rows that hold texts, or the shingles of two sets, go to Python in so many bytes.
BATCH_BYTES = 4 << 20

# Words of bitmaps, of eight bytes each, that are gathered for one side of the pairs compared at once.
GATHERED_WORDS = 1 << 19

# One more shingle has to be common in the prefixes for every so many shingles of a set.
PER_COMMON = 20


def prefix_size(n: int) -> int:
    """Of the first so many shingles two similar sets have at least 1 + m // PER_COMMON in common.

    m is the smaller size. The last but l - 1 of the common shingles has at least o - l of them behind it, where o is
    the overlap, so the first l lie among the first n - o + l; o is at least eight tenths of either size.
    """
    return n - -(-PERCENT * n // 100) + 1 + n // PER_COMMON


def band_of(n: int) -> int:
    return int(math.log(n) / BAND + 1e-9)


def band_bits(band: int) -> int:
    """Bitmap width of a band, a power of two of three to six times the size: few bits are shared by chance."""
    return min(MAX_BITS, max(MIN_BITS, 1 << math.ceil(math.log2(3 * math.exp(band * BAND)))))


def tile_bits(band: int) -> int:
    """Width of the folded bitmaps in a band's tiles. Those of small sets are folded less, as they differ in few bits."""
    return max(min(MIN_TILE_BITS, band_bits(band)), band_bits(band) // TILE_FOLDS)


def bitmap(values: np.ndarray, bits: int) -> np.ndarray:
    """A bit is set if an odd number of the values fall on it."""
    places = (values.view(np.uint64) >> np.uint64(17)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(places.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little")


_SET_ARROW = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("n", pa.int64()), ("h", pa.int64()),
                        ("lowest", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())), ("bits", pa.binary())])


def _described(batches: Iterator[pa.RecordBatch], common: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in text_slices(whole)):
        sizes, ids, lowest, prefixes, bitmaps = [], [], [], [], []
        for values in shingle_sets(batch.column("text")):
            n = len(values)
            sizes.append(n)
            if n == 0:
                ids.append(0), lowest.append([]), prefixes.append([]), bitmaps.append(b"")
                continue
            ids.append(set_id(values))
            lowest.append(values[:LOWEST])
            at = np.minimum(np.searchsorted(common, values), max(0, len(common) - 1))
            late = common[at] == values if len(common) else np.zeros(n, dtype=bool)
            size = prefix_size(n)
            first = values[~late][:size]
            prefixes.append(np.concatenate([first, values[late][:size - len(first)]]))
            bitmaps.append(bitmap(values, band_bits(band_of(n))).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"), *(pa.array(c, f.type) for c, f in zip(
                (sizes, ids, lowest, prefixes, bitmaps), list(_SET_ARROW)[2:]))], schema=_SET_ARROW)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that a batch holds in several documents, with their number."""
    for batch in batches:
        parts = [np.concatenate(list(shingle_sets(part.column("text")))) for part in text_slices(batch)]
        if not parts:
            continue
        values = np.concatenate(parts)
        del parts
        values.sort()
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[:len(values)])
        count = np.diff(first, append=len(values))
        first, count = first[count >= 2], count[count >= 2]
        yield pa.RecordBatch.from_arrays([pa.array(values[first]), pa.array(count)], names=["shingle", "n"])


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in text_slices(whole)):
        ids, packed = [], []
        for values in shingle_sets(batch.column("text")):
            ids.append(set_id(values) if len(values) else 0)
            packed.append(values.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())],
                                         names=["node", "shingles"])


def describe(texts: DataFrame) -> DataFrame:
    """(doc_id, digest, n, h, lowest, prefix, bits) of (doc_id, text); the digest is the text's."""
    tally = texts.mapInArrow(_counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    tally = materialize(tally.where(F.col("n") >= COMMON_DOCUMENTS), "common")
    bins = tally.groupBy(F.floor(F.log2("n") * 4).alias("bin")).agg(
        F.count("*").alias("shingles"), F.min("n").alias("least")).orderBy(F.desc("bin")).collect()
    least, taken = 1 << 62, 0
    for row in bins:  # some hundred at most
        taken += row["shingles"]
        if taken > COMMON_SHINGLES:
            break
        least = row["least"]
    common = np.sort(np.asarray(tally.where(F.col("n") >= least).toArrow().column("shingle"), dtype=np.int64))
    shared = texts.sparkSession.sparkContext.broadcast(common)
    named = texts.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    return named.mapInArrow(lambda batches: _described(batches, shared.value),
                            "doc_id long, digest long, n long, h long, lowest array<long>, prefix array<long>, bits binary")


def similar(overlap: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * overlap >= PERCENT * (n + m - overlap)


def _intersected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = np.zeros(batch.num_rows, dtype=bool)
        for i in range(batch.num_rows):
            x = np.frombuffer(batch.column("x")[i].as_buffer(), dtype=np.int64)
            y = np.frombuffer(batch.column("y")[i].as_buffer(), dtype=np.int64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            overlap = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            good[i] = 100 * overlap >= PERCENT * (len(x) + len(y) - overlap)
        yield batch.select(["a", "b"]).filter(pa.array(good))


def verified(pairs: DataFrame, texts: DataFrame, holders: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar, by exact intersection.

    `holders (node, first)` names a document that holds each set.
    """
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    held = materialize(holders.join(hinted(wanted), "node").select("first").distinct(), "holders")
    # A document may occur again, with the same or another text.
    arrays = only_ids(only_ids(texts, held).mapInArrow(_arrays, "node long, shingles binary"), wanted, "node")
    arrays = materialize(arrays.groupBy("node").agg(F.first("shingles").alias("shingles")), "arrays")
    left = arrays.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = arrays.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_intersected, "a long, b long")


def overlap_bound(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """No more shingles can be common. One row of words each.

    Common shingles change both bitmaps alike, so each bit in which these differ needs a shingle that is not common.
    """
    return (n + m - _POPCOUNT(x ^ y).sum(axis=1, dtype=np.int64)) // 2


def _folded(value: bytes, words: int) -> np.ndarray:
    """A bitmap in a smaller width."""
    return np.bitwise_xor.reduce(np.frombuffer(value, dtype=np.uint64).reshape(-1, words), axis=0)


def _tile_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [tile_bits(band_of(n)) // 64 for n in batch.column("n").to_pylist()]
        folded = [_folded(bits.as_buffer(), w).tobytes() for bits, w in zip(batch.column("bits"), words)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("lowest"), pa.array(folded, pa.binary())],
                                         names=["node", "lowest", "bits"])


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
        good = np.zeros(batch.num_rows, dtype=bool)
        for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
            words = min(len(x), len(y)) // 8
            good[i] = similar(overlap_bound(n[i:i + 1], m[i:i + 1], _folded(x, words)[None], _folded(y, words)[None]),
                              n[i:i + 1], m[i:i + 1])[0]
        yield batch.select(["a", "b"]).filter(pa.array(good))


def bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow a similarity of 0.8."""
    left = sets.select(F.col("node").alias("a"), "n", F.col("bits").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y")
            .mapInArrow(_bounded, "a long, b long"))


def star_pairs(sets: DataFrame) -> DataFrame:
    """Each set with the one of the smallest document that shares one of its lowest shingles and has a fitting size.

    Copies mostly follow what they were made from, so the smallest document is near to more of them than another copy.
    """
    rows = sets.select("node", "first", "n", F.explode("lowest").alias("shingle"))
    least = rows.groupBy("shingle").agg(
        F.min(F.struct("first", "node", "n")).alias("least"), F.count("*").alias("rows"))
    pairs = rows.join(least.where("rows > 1"), "shingle").select(
        F.col("least.node").alias("a"), F.col("node").alias("b"), F.col("least.n").alias("m"), "n")
    fits = (100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m")) & (F.col("a") != F.col("b"))
    return pairs.where(fits).select("a", "b").distinct()


_TILE_ORDER = ["band", "shingle", "block", "other"]


def tile_rows(sets: DataFrame, labels: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (band, shingle, block, other, node, component, n, mine, bits) of all tiles with several components.

    A document is in the tile of its band, and as a guest in the next smaller band's. Blocks of a large tile meet two
    by two: a row of block i (`mine`) lies in the tiles (i, j) and (j, i) with the smaller number first.
    """
    labelled = sets.join(labels.withColumnRenamed("node", "_labelled"), F.col("node") == F.col("_labelled"), "left").select(
        "node", "n", "lowest", "prefix", F.coalesce("component", "node").alias("component"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(BAND) + 1e-9).cast("int")
    marked = F.concat(
        F.transform("prefix", lambda s: F.struct(s.alias("shingle"), F.lit(True).alias("first"))),
        F.transform(F.array_except("lowest", "prefix"), lambda s: F.struct(s.alias("shingle"), F.lit(False).alias("first"))))
    # Narrow rows, as there is one for every fourth shingle of all documents.
    posted = labelled.select("node", "component", F.explode(marked).alias("p")).select(
        "node", "component", "p.shingle", "p.first")
    several = posted.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    several = materialize(several.where("low < high").select(F.col("shingle").alias("_shingle")), "several")
    few = hinted(several, 50_000)
    met = materialize(posted.drop("component").join(few, F.col("shingle") == F.col("_shingle")).drop("_shingle"), "met")
    met = met.join(labelled.select("node", "component", "n", band.alias("own")), "node")
    # A document with fewer shared shingles than it has in common with the smallest similar set has no link left.
    needed = 1 + F.floor(F.ceil(F.col("n") * PERCENT / 100) / PER_COMMON)
    enough = met.where("first").groupBy("node", "n").agg(F.count("*").alias("shared")).where(
        F.col("shared") >= needed)
    enough = materialize(enough.select("node"), "enough")
    met = only_ids(met, enough, "node")
    guests = F.explode(F.array("own", F.col("own") - 1)).alias("band")
    placed = materialize(met.select("node", "component", "n", "own", "shingle", "first", guests), "placed")
    counts = placed.groupBy("band", "shingle").agg(
        F.count("*").alias("rows"), F.min("component").alias("low"), F.max("component").alias("high"),
        F.max((F.col("own") == F.col("band")).cast("int")).alias("owned"))
    tiles = counts.where("low < high AND owned = 1").select(
        "band", "shingle", F.ceil(F.col("rows") / block_rows).cast("int").alias("blocks"))
    inside = placed.join(tiles, ["band", "shingle"])
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = inside.withColumn("_mine", mine).withColumn(
        "_meets", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = spread.select("band", "shingle", F.least("_mine", "_meets").alias("block"),
                          F.greatest("_mine", "_meets").alias("other"), "node", "component", "n", "own", "first",
                          F.col("_mine").alias("mine"))
    marks = only_ids(sets.select("node", "n", "lowest", "bits"), enough, "node").mapInArrow(
        _tile_marks, "node long, lowest array<long>, bits binary")
    return keyed.join(marks, "node").select(
        *_TILE_ORDER, "node", "component", "n", "own", "first", "mine", "lowest", "bits")


def _tile_pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one band's rows, in tile order, that may be similar."""
    band = table.column("band")[0].as_py()
    keys = [table.column(c).to_numpy() for c in _TILE_ORDER[1:]]
    doc, comp, n, own, first, mine = (
        table.column(c).to_numpy() for c in ("node", "component", "n", "own", "first", "mine"))
    crossed = keys[1] != keys[2]
    words = tile_bits(band) // 64
    bits = np.zeros((len(doc), words), dtype=np.uint64)
    for i, value in enumerate(table.column("bits")):
        bits[i] = _folded(value.as_buffer(), words)  # a guest's may be wider
    lists = table.column("lowest").combine_chunks()
    lowest = np.zeros((len(doc), LOWEST), dtype=np.int64)
    lengths = lists.value_lengths().to_numpy()
    lowest[np.arange(LOWEST) < lengths[:, None]] = lists.flatten().to_numpy()
    lowest = np.where(np.arange(LOWEST) < lengths[:, None], lowest, lowest[:, :1])  # short lists repeat their first
    here = np.arange(len(doc))
    step = 1
    while True:
        here = here[here + step < len(doc)]
        there = here + step
        same = np.logical_and.reduce([k[here] == k[there] for k in keys])
        here = here[same]
        if not len(here):
            return
        there = here + step
        # Two guests meet in the tile of their own band, and two rows of one block where it is alone.
        good = (comp[here] != comp[there]) & ((own[here] == band) | (own[there] == band))
        good &= ~crossed[here] | (mine[here] != mine[there])
        good &= 100 * np.minimum(n[here], n[there]) >= PERCENT * np.maximum(n[here], n[there])
        i, j = here[good], there[good]
        size = max(1, GATHERED_WORDS // max(words, LOWEST))
        for s in range(0, len(i), size):
            x, y = i[s:s + size], j[s:s + size]
            keep = similar(overlap_bound(n[x], n[y], bits[x], bits[y]), n[x], n[y])
            x, y = x[keep], y[keep]
            # The lowest common one of the lowest shingles, if there is any, decides which tile gives the pair.
            common = (lowest[x][:, :, None] == lowest[y][:, None, :]).any(axis=2)
            least = np.where(common, lowest[x], np.iinfo(np.int64).max).min(axis=1)
            keep = np.where(common.any(axis=1), least == keys[0][x], first[x] & first[y])
            if keep.any():
                yield np.minimum(doc[x[keep]], doc[y[keep]]), np.maximum(doc[x[keep]], doc[y[keep]])
        step += 1


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles that arrive in order; the last tile of a batch waits for the next batch."""
    def finished(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bands = table.column("band").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(bands)) + 1), len(bands)]
        pairs = [p for a, b in zip(cuts, cuts[1:]) if b > a for p in _tile_pairs(table.slice(a, b - a))]
        if pairs:
            both = np.unique(np.stack([np.concatenate([p[k] for p in pairs]) for k in (0, 1)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    waiting: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if waiting is not None:
            table = pa.concat_tables([waiting, table]).combine_chunks()
        if not table.num_rows:
            continue
        keys = [table.column(c).to_numpy() for c in _TILE_ORDER]
        new = np.flatnonzero(np.logical_or.reduce([np.diff(k) != 0 for k in keys])) + 1
        cut = int(new[-1]) if len(new) else 0
        if cut:
            yield from finished(table.slice(0, cut))
        waiting = table.slice(cut)
    if waiting is not None and waiting.num_rows:
        yield from finished(waiting)


def tile_pairs(sets: DataFrame, labels: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    rows = tile_rows(sets, labels, block_rows)
    partitions = TILE_PARTITIONS * int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(partitions, *_TILE_ORDER).sortWithinPartitions(*_TILE_ORDER, "n", "node")
    met = materialize(ordered.mapInArrow(_compared, "a long, b long").distinct(), "met-pairs")
    asked = materialize(met.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "met-nodes")
    return bounded(met, only_ids(sets, asked, "node"))


def one_row_of_each(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """The sets as nodes: one row (node, first, n, lowest, prefix, bits) for each of the `classes (n, h, first, members)`."""
    several = classes.where("members > 1").select("n", "h", "first")
    ids = sets.select("doc_id", "n", "h")
    of_first = materialize(ids.join(several, ["n", "h"]).select("doc_id", "h", (F.col("doc_id") > F.col("first")).alias(
        "copy")), "copies")
    gone = of_first.where("copy").select(F.col("doc_id").alias("_doc_id"), F.col("h").alias("_h"))
    kept = sets.where("n > 0 AND doc_id IS NOT NULL").join(
        hinted(gone), (F.col("doc_id") == F.col("_doc_id")) & (F.col("h") == F.col("_h")), "left_anti")
    repeated = materialize(of_first.where("NOT copy").groupBy("h").agg(F.count("*").alias("rows")).where("rows > 1")
                           .select("h"), "repeated")
    if not repeated.isEmpty():  # the same row again
        once = only_ids(kept, repeated, "h").groupBy("h").agg(
            *[F.first(c).alias(c) for c in kept.columns if c != "h"]).select(*kept.columns)
        kept = without_ids(kept, repeated, "h").unionByName(once)
    return kept.select(F.col("h").alias("node"), F.col("doc_id").alias("first"), "n", "lowest", "prefix", "bits")


def set_components(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): `rows (doc_id, digest, n, h)` of all texts, `classes (n, h, first, members)` of equal sets
    with the smallest document, and links (a, b) between the sets h that are similar, enough for all components."""
    described = describe(texts)
    with batches_of(texts.sparkSession, BATCH_BYTES):
        sets = materialize(described, "sets")
        rows = sets.select("doc_id", "digest", "n", "h")
        classes = materialize(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "h").agg(
            F.min("doc_id").alias("first"), F.count("*").alias("members")), "classes")
        holders = classes.select(F.col("h").alias("node"), "first")
        own = materialize(one_row_of_each(sets, classes), "nodes")
        stars = materialize(bounded(star_pairs(own), own), "stars")
        links = materialize(verified(stars, texts, holders), "star-links")
        more = materialize(tile_pairs(own, components(links)), "candidates")
        return rows, classes, links.union(materialize(verified(more, texts, holders), "tile-links"))


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def linked(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all rows of (doc_id, text)."""
    rows, classes, links = set_components(_texts(documents))
    # Rows of one id are one document, whatever their texts.
    sharing = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("h").alias("low"), F.max("h").alias("high"))
    sharing = materialize(sharing.where("low < high").select(F.col("doc_id").alias("_doc_id"), "low"), "sharing")
    if not sharing.isEmpty():
        same = rows.where("n > 0").join(hinted(sharing), F.col("doc_id") == F.col("_doc_id")).where("low < h")
        links = links.union(same.select(F.col("low").alias("a"), F.col("h").alias("b")).distinct())
    labels = components(links)
    placed = classes.join(labels, F.col("h") == F.col("node"), "left").select(
        "n", "h", "first", "members", "component")
    least = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("least"))
    named = placed.join(least, "component", "left").where("members > 1 OR component IS NOT NULL").select(
        "n", "h", F.coalesce("least", "first").alias("_component"))
    known = rows.join(named, ["n", "h"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return known.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return linked(read(spark, folder, "documents"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: of each group of similar texts the row with the smallest id stays.

    Groups are made of texts here, so a text stays although another one under its id is a copy. Rows without an id, and
    texts without words, stay.
    """
    rows, classes, links = set_components(_texts(docs))
    labels = components(links)
    placed = classes.join(labels, F.col("h") == F.col("node"), "left").select(
        "n", "h", "first", "members", F.coalesce("component", "h").alias("component"))
    best = placed.groupBy("component").agg(F.min(F.struct("first", "h")).alias("best"), F.count("*").alias("sets"),
                                           F.sum("members").alias("members")).where("members > 1")
    chosen = materialize(placed.drop("members").join(best, "component").select(
        "n", "h", F.col("best.first").alias("first"), F.col("best.h").alias("kept")), "chosen")
    judged = rows.join(chosen, ["n", "h"]).where("doc_id IS NOT NULL")
    judged = materialize(judged.groupBy("doc_id", "digest").agg(
        F.max((F.col("h") == F.col("kept")) & (F.col("doc_id") == F.col("first"))).alias("stays"),
        F.count("*").alias("rows")), "judged")
    least = judged.where("stays").groupBy("doc_id").agg(F.min("digest").alias("least")).withColumnRenamed("doc_id", "_id")
    judged = materialize(judged.join(least, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", "digest", "rows", F.coalesce(F.col("stays") & (F.col("digest") == F.col("least")), F.lit(False)).alias(
            "stays")), "judged")
    left = _by_key(docs, judged.where("NOT stays"), "left_anti")
    again = materialize(judged.where("stays AND rows > 1"), "again")
    if again.isEmpty():
        return left
    # The kept row occurs more than once.
    key = [free_name(docs, "_id"), free_name(docs, "_digest")]
    once = _by_key(left, again, "left_semi").withColumns(dict(zip(key, _key(docs)))).dropDuplicates(key).drop(*key)
    return _by_key(left, again, "left_anti").unionByName(once)


def _key(docs: DataFrame) -> tuple[Column, Column]:
    return docs["doc_id"].cast("bigint"), F.xxhash64(docs["text"].cast("string"))


def _by_key(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    names = [free_name(docs, "_gone_id"), free_name(docs, "_gone_digest")]
    doc_id, digest = _key(docs)
    return docs.join(hinted(keys.select("doc_id", "digest").toDF(*names)),
                     (doc_id == F.col(names[0])) & (digest == F.col(names[1])), how)
