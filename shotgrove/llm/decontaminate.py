"""Benchmark decontamination by SimHash over item-sized windows.

Windows of a document as long as a benchmark item get a 64-bit SimHash of their word shingles. Items are found by a
multi-index: the 64 bits are cut into `BLOCKS` blocks, and fingerprints within the radius agree in some block up to
`BLOCK_DISTANCE` bits; items are listed under every such value of each block, so no fingerprint within the radius is
missed. Candidates within the radius are verified by the weighted similarity of the shingles (each counts as often as
it occurs): the sum of the lesser over the sum of the greater counts.

Windows are only fingerprinted where they can match: a window that is similar by 0.8 holds at least eight tenths of the
item's shingles, so (document, item) pairs with fewer common shingles are left out without loss. Windows begin where a
common shingle puts the beginning of the item, and at the common shingles themselves: a window can slide right to its
first common shingle without losing any, so no other window is more similar than all of these. Items are queries against all documents; their shingles are
broadcast while they are few, and joined by shuffle otherwise. All of it is column expressions.

Defined results: NULL and empty texts, and items without words, match nothing. A text of fewer than five words has one
shingle. A window is cut off at the document's end. Equal windows: the first of these counts. Equal items each get their
rows. Rows that repeat a document's id are looked at as one document's texts. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrove.llm.common import hinted, let, only_ids, read, without_ids
from shotgrove.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 5
SIMILARITY = 0.8

BITS = 64
BLOCKS, BLOCK_DISTANCE = 7, 2
# All fingerprints at most so far apart agree in some block up to BLOCK_DISTANCE bits. At a similarity of 0.8 they are
# 10 bits apart on average with a deviation below 3.
RADIUS = BLOCKS * (BLOCK_DISTANCE + 1) - 1


def words(text: Column) -> Column:
    """A-Z lowered, cut at ASCII white space."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def shingles(text: Column) -> Column:
    """Shingle hashes in order, repeated ones included; empty without words."""
    def joined(hashes: Column) -> Column:
        n = F.size(hashes)
        several = F.transform(F.sequence(F.lit(0), n - WORDS),
                              lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WORDS)]))
        return F.when(n >= WORDS, several).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(
            F.array().cast("array<bigint>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), joined)


def simhash(shingle_list: Column) -> Column:
    """Bit b is set where most shingle hashes have it set."""
    def bit(hashes: Column, i: Column) -> Column:
        votes = F.aggregate(hashes, F.lit(0), lambda s, h: s + F.call_function(
            "shiftright", h, i).bitwiseAND(F.lit(1)).cast("int") * 2 - 1)
        return F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(
            F.lit(0).cast("bigint"))

    return let(shingle_list, lambda hashes: F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("bigint"),
        lambda bits, i: bits.bitwiseOR(bit(hashes, i))))


def block_layout() -> list[tuple[int, int]]:
    """(lowest bit, width) of the blocks."""
    edges = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def block_keys(fingerprint: Column, near: bool) -> Column:
    """Structs (block, value); with `near` all values up to BLOCK_DISTANCE bits away."""
    def block_part(block: int, low: int, width: int) -> Column:
        value = F.shiftrightunsigned(fingerprint, low).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        flips = [sum(1 << b for b in chosen) for size in range(BLOCK_DISTANCE + 1)
                 for chosen in combinations(range(width), size)] if near else [0]
        return F.transform(F.array(*map(F.lit, flips)), lambda flip: F.struct(
            F.lit(block).alias("block"), value.bitwiseXOR(flip).alias("value")))

    return F.concat(*[block_part(block, low, width) for block, (low, width) in enumerate(block_layout())])


def weighted_similarity(left: Column, right: Column) -> Column:
    def count(items: Column, wanted: Column) -> Column:
        return F.size(F.filter(items, lambda x: x == wanted))

    shared = F.aggregate(F.array_intersect(left, right), F.lit(0),
                         lambda s, h: s + F.least(count(left, h), count(right, h)))
    return shared / (F.size(left) + F.size(right) - shared)


def item_shingles(items: DataFrame) -> DataFrame:
    named = items.select("item_id", shingles(F.col("text")).alias("item_list"))
    return (named.where(F.size("item_list") > 0)
            .select("item_id", "item_list", F.size("item_list").alias("size"), simhash(F.col("item_list")).alias("mark")))


def windows(documents: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, digest, start, size): where windows of an item's size can be similar to it."""
    seeds = materialize(items.select("size", "item_id", F.posexplode("item_list").alias("item_at", "hash")), "seeds")
    # The outer kind, as the plain one works the list out twice to check its size.
    places = documents.select("doc_id", "digest", F.posexplode_outer(shingles(F.col("text"))).alias("at", "hash"))
    anchor = F.greatest(F.col("at") - F.col("item_at"), F.lit(0))
    common = places.join(hinted(seeds), "hash").select("doc_id", "digest", "item_id", "size", F.explode(F.array(
        F.struct(anchor.alias("start"), F.lit(1).alias("n"), F.lit(False).alias("held")),
        F.struct(F.col("at").alias("start"), F.lit(0).alias("n"), F.lit(True).alias("held")))).alias("b"))
    # First per beginning, so that what is gathered is one list of beginnings.
    counted = common.groupBy("doc_id", "digest", "item_id", "size", F.col("b.start").alias("start")).agg(
        F.sum("b.n").alias("n"), F.max("b.held").alias("held"))
    enough = (counted.groupBy("doc_id", "digest", "item_id", "size")
              .agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") > 0, F.col("start"))).alias("anchors"),
                   F.sort_array(F.collect_list(F.when(F.col("held"), F.col("start")))).alias("held"))
              .where(F.col("n") >= similarity * F.col("size")))
    # A window from a common shingle on must hold enough of them: the last one needed lies within it.
    need = F.ceil(F.lit(similarity) * F.col("size") - 1e-9).cast("int")
    full = F.filter("held", lambda at, k: F.get(F.col("held"), k + need - 1) < at + F.col("size"))
    return enough.select("doc_id", "digest", "size", F.explode(F.array_union("anchors", full)).alias("start")).distinct()


def contaminated(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start, similarity): the best window of each document and item that are similar."""
    rows = documents.select("doc_id", "text").withColumn("digest", F.xxhash64("text"))
    items = materialize(item_shingles(benchmark), "items")
    found = materialize(windows(rows, items, similarity), "windows")
    texts = only_ids(rows, materialize(found.select("doc_id").distinct(), "suspects"))
    marked = (texts.select("doc_id", "digest", shingles(F.col("text")).alias("list"))
              .join(found.withColumnRenamed("doc_id", "_id").withColumnRenamed("digest", "_digest"),
                    (F.col("doc_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")))
              .select("doc_id", "start", "size", F.slice("list", F.col("start") + 1, F.col("size")).alias("window")))
    marked = materialize(marked.withColumn("window_mark", simhash(F.col("window"))), "marked")
    index = items.select("item_id", "size", "item_list", "mark", F.explode(block_keys(F.col("mark"), True)).alias("key"))
    index = materialize(index.select("item_id", "size", "item_list", "mark", "key.block", "key.value"), "index")
    asked = marked.withColumn("key", F.explode(block_keys(F.col("window_mark"), False))).select(
        "doc_id", "start", "window", "window_mark", F.col("size").alias("window_size"), "key.block", "key.value")
    near = (asked.join(hinted(index, 200_000), ["block", "value"])
            .where(F.col("size") == F.col("window_size"))
            .where(F.bit_count(F.col("mark").bitwiseXOR(F.col("window_mark"))) <= RADIUS))
    # A pair can agree in several blocks: it counts in the first.
    agrees = [F.bit_count(F.shiftrightunsigned(F.col("mark").bitwiseXOR(F.col("window_mark")), low)
                          .bitwiseAND(F.lit((1 << width) - 1))) <= BLOCK_DISTANCE for low, width in block_layout()]
    first = F.array_position(F.array(*agrees), True) - 1
    verified = (near.where(first == F.col("block"))
                .select("doc_id", "item_id", "start",
                        F.round(weighted_similarity(F.col("window"), F.col("item_list")), 6).alias("similarity"))
                .where(F.col("similarity") >= similarity))
    best = verified.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.s")).alias("start"), F.col("b.similarity").alias("similarity"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    hits = contaminated(docs, read(spark, folder, "benchmark"))
    return without_ids(docs, materialize(hits.select("doc_id").distinct(), "contaminated"))


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{u}', '{l}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_SHINGLES = """CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END"""

SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS.format(u=UPPER, l=LOWER)} AS words FROM documents),
dl AS MATERIALIZED (SELECT doc_id, {_SHINGLES} AS list FROM dw),
ds AS MATERIALIZED (SELECT doc_id, unnest(list) AS sh, unnest(range(len(list))) AS pos, len(list) AS m FROM dl),
iw AS (SELECT item_id, {_WORDS.format(u=UPPER, l=LOWER)} AS words FROM benchmark),
il AS MATERIALIZED (SELECT item_id, {_SHINGLES} AS list FROM iw),
i AS MATERIALIZED (SELECT item_id, unnest(list) AS sh, unnest(range(len(list))) AS pos, len(list) AS size FROM il),
counts AS (SELECT item_id, sh, count(*) AS c FROM i GROUP BY ALL),
anchors AS MATERIALIZED (SELECT d.doc_id, i.item_id, i.size, d.m, greatest(d.pos - i.pos, 0) AS start
                         FROM ds d JOIN i ON d.sh = i.sh),
enough AS (SELECT doc_id, item_id FROM anchors GROUP BY doc_id, item_id, size HAVING count(*) >= 0.8 * size),
starts AS MATERIALIZED (SELECT DISTINCT a.* FROM anchors a SEMI JOIN enough e
                        ON a.doc_id = e.doc_id AND a.item_id = e.item_id),
held AS (SELECT s.doc_id, s.item_id, s.start, s.size, s.m, least(count(*), any_value(c.c)) AS shared
         FROM starts s JOIN ds d ON d.doc_id = s.doc_id AND d.pos >= s.start AND d.pos < s.start + s.size
         JOIN counts c ON c.item_id = s.item_id AND c.sh = d.sh
         GROUP BY s.doc_id, s.item_id, s.start, s.size, s.m, d.sh),
sims AS (SELECT doc_id, item_id, start,
                round(sum(shared) / (any_value(least(size, m - start)) + any_value(size) - sum(shared)), 6) AS similarity
         FROM held GROUP BY doc_id, item_id, start),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r
           FROM sims WHERE similarity >= 0.8)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, similarity FROM ranked WHERE r = 1"""
