"""Jaccard join, decontamination, sharding, URL filter, chat, language model: brute force on small tables."""

import collections
import itertools
import math
import os
import random
import tracemalloc
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shotgrove.llm import chat, decontaminate, jaccard_join, lm_scoring, sharding, url_filter
from shotgrove.llm.graph import components
from tests.llm.rows import documents, saved, shingles, with_clashes, words


@pytest.fixture(scope="module")
def docs(spark):
    return with_clashes(documents(spark)).cache()


def brute_components(texts):
    sets = {i: set(shingles(t)) for i, t in texts.items()}
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(s), label[i]) for i, s in sets.items()}


def families(seed=3):
    """Groups of near copies around the threshold, with a passage that most texts share."""
    rng = random.Random(seed)
    passage = " ".join(f"common{i}" for i in range(40))
    texts = {}
    for family in range(12):
        base = [f"f{family}w{rng.randrange(10 ** 6)}" for _ in range(rng.choice([8, 60, 200, 400]))]
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 22))):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10 ** 6)}"
            text = " ".join(copy)
            texts[len(texts)] = f"{text} {passage}" if rng.random() < 0.6 else text
    return texts


@pytest.mark.parametrize("block_rows", [500, 3])
def test_jaccard_join_is_brute_force(spark, block_rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(jaccard_join.tile_pairs, "__defaults__", (block_rows,))
    texts = families()
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(frame).collect()}
    assert got == brute_components(texts)


def test_tiles_alone_lose_no_link(spark):
    """Without any star, and with every shingle common, the tiles still give all links."""
    texts = {i: t for t, i in {t: i for i, t in families(5).items()}.items()}  # equal texts are one node
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    sets = jaccard_join.materialize(jaccard_join.describe(frame), "sets")
    nobody = spark.createDataFrame([], "node long, component long")
    own = sets.where("n > 0").select(F.col("h").alias("node"), "n", "lowest", "prefix", "bits").distinct()
    holders = sets.select(F.col("h").alias("node"), F.col("doc_id").alias("first"))
    links = jaccard_join.verified(jaccard_join.tile_pairs(own, nobody, 4), frame, holders).collect()
    of = {r.h: r.doc_id for r in sets.collect()}
    assert len(of) == len(texts)
    pairs = {tuple(sorted((of[r.a], of[r.b]))) for r in links}
    found = {i: set(shingles(t)) for i, t in texts.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(found), 2)
            if 100 * len(found[a] & found[b]) >= 80 * len(found[a] | found[b])}
    assert pairs == want


def test_tile_rows_are_narrow(spark):
    """Rows of a tile hold a folded bitmap; the pairs they give are judged by the whole ones."""
    rng = random.Random(11)
    parts = [[f"p{i}x{rng.randrange(10 ** 6)}" for _ in range(60)] for i in range(6)]
    texts = []
    for i in range(24):  # two of six parts are shared with others: far from similar, but met in tiles
        own = [f"d{i}x{j}" for j in range(300)]
        texts.append((i, " ".join(own[:150] + parts[i % 6] + own[150:] + parts[(i + 1) % 6])))
    texts.append((24, texts[0][1] + " more"))
    sets = jaccard_join.materialize(jaccard_join.describe(spark.createDataFrame(texts, "doc_id long, text string")), "sets")
    own = sets.select(F.col("h").alias("node"), "n", "lowest", "prefix", "bits")
    nobody = spark.createDataFrame([], "node long, component long")
    rows = jaccard_join.tile_rows(own, nobody).collect()
    whole = {r.node: r for r in own.collect()}
    assert rows
    for r in rows:
        value, words = whole[r.node].bits, len(r.bits) // 8
        assert len(r.bits) == len(value) // 4 and r.bits == jaccard_join._folded(value, words).tobytes()
    of = {r.h: r.doc_id for r in sets.collect()}
    assert [{of[r.a], of[r.b]} for r in jaccard_join.tile_pairs(own, nobody).collect()] == [{0, 24}]


def test_copies_that_are_not_similar_are_told_apart_in_tiles(spark):
    """Copies of one text, each with changes of its own, so that two of them share two thirds: few pairs of them
    leave a tile, although all meet there."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(60):
        at = set(rng.sample(range(0, 150, 5), 3))
        rows.append((i, " ".join(f"d{i}x{k}" if k in at else w for k, w in enumerate(base))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sets = jaccard_join.materialize(jaccard_join.describe(frame), "sets")
    own = sets.select(F.col("h").alias("node"), "n", "lowest", "prefix", "bits")
    held = {i: set(shingles(t)) for i, t in rows}
    of = {r.h: r.doc_id for r in sets.collect()}
    want = {(a, b) for a, b in itertools.combinations(range(60), 2)
            if 100 * len(held[a] & held[b]) >= 80 * len(held[a] | held[b])}
    tiles = jaccard_join.tile_rows(own, spark.createDataFrame([], "node long, component long"))
    ordered = tiles.repartition(2, *jaccard_join._TILE_ORDER).sortWithinPartitions(*jaccard_join._TILE_ORDER, "n", "node")
    met = {tuple(sorted((of[r.a], of[r.b])))
           for r in ordered.mapInArrow(jaccard_join._compared, "a long, b long").collect()}
    assert want <= met
    assert len(met) < 60 * 59 / 2 / 10


@pytest.mark.parametrize("bits", [64, 256, 2048])
def test_bitmaps_bound_the_overlap(bits):
    """Never below the overlap, at any width and folded, and the overlap itself where no two values share a bit that only
    one set has, however many both have."""
    rng = np.random.default_rng(bits)
    for size in (1, 7, 90, 700):
        shared, x, y = (rng.integers(-2 ** 63, 2 ** 63 - 1, k) for k in (size, size // 3, size // 2))
        x, y = np.union1d(shared, x), np.union1d(shared, y)
        marks = [jaccard_join.bitmap(v, bits) for v in (x, y)]
        overlap, n, m = len(np.intersect1d(x, y)), np.array([len(x)]), np.array([len(y)])
        for words in {1, bits // 64}:
            a, b = (jaccard_join._folded(v.tobytes(), words)[None] for v in marks)
            assert jaccard_join.overlap_bound(n, m, a, b)[0] >= overlap
    shared, few = rng.integers(2 ** 40, 2 ** 60, 5 * bits), np.arange(40, dtype=np.int64) << 17
    sets = [np.union1d(shared, v) for v in (few[:30], few[10:])]
    a, b = (jaccard_join.bitmap(v, bits).view(np.uint64)[None] for v in sets)
    size = len(sets[0])
    assert jaccard_join.overlap_bound(np.array([size]), np.array([size]), a, b)[0] == size - 10


def test_texts_go_to_python_in_small_batches(spark, monkeypatch, tmp_path):
    """Texts, and the shingles of pairs, go to Python in a few megabytes at once, not in ten thousand rows."""
    seen = str(tmp_path)
    described = jaccard_join._described

    def noted(batches, common):
        def kept():
            for batch in batches:
                with open(f"{seen}/{uuid.uuid4().hex}", "w") as f:
                    f.write(str(batch.nbytes))
                yield batch
        yield from described(kept(), common)

    monkeypatch.setattr(jaccard_join, "_described", noted)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    rows = spark.range(6000).coalesce(1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 400) AS text")
    jaccard_join.set_components(jaccard_join._texts(rows))
    sizes = [int(open(f"{seen}/{name}").read()) for name in os.listdir(seen)]
    assert sum(sizes) > 10_000_000 and max(sizes) < 6_000_000
    assert spark.conf.get(setting) == before


def test_sets_are_made_in_little_memory():
    """A worker hashes a quarter of a megabyte of text at once; copies of a batch are counted in place."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9000, 300)) for _ in range(3000)]
    texts += texts[:40]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(3040)), "text": texts, "digest": [0] * 3040})
    tracemalloc.start()
    rows = sum(b.num_rows for b in jaccard_join._described(iter([batch]), np.zeros(0, dtype=np.int64)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    counted = pa.Table.from_batches(jaccard_join._counted(iter([batch])))
    peak = max(peak, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert rows == 3040 and counted.num_rows >= 40 * 296
    assert peak < 40_000_000


def test_jaccard_awkward_rows(spark, docs):
    got = jaccard_join.linked(docs).collect()
    assert len(got) == docs.count()
    of = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert of[4] == (0, 4) and of[5] == (0, 5) and of[11] == (0, 11)
    assert of[1][1] == of[2][1] == of[3][1] == of[14][1] == 1 and of[7][1] == of[8][1] == 6 and of[10] == (1, 9)
    assert of[None][1] is None
    kept = jaccard_join.keep_one_of_each(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 4, 5, 6, 9, 11, 12, 13, None}
    assert jaccard_join.linked(docs.limit(0)).count() == 0


def test_rows_of_one_id(spark):
    """An id with two texts: both have their links, and only what is a copy goes."""
    base = [f"w{i}" for i in range(30)]
    a, b = " ".join(base), " ".join(f"v{w}" for w in base)
    near = b + " more"
    rows = [(1, a, "x"), (5, a.upper(), "x"), (5, b, "x"), (9, near, "x"), (9, near, "x"), (20, "other text", "x"),
            (20, "other text", "y"), (21, "\tother TEXT", "x"), (30, None, "x"), (30, "", "x"), (None, a, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _gone_id string").repartition(4)
    got = {(r.doc_id, r.component_id) for r in jaccard_join.linked(frame).collect()}
    assert got == {(1, 1), (5, 1), (9, 1), (20, 20), (21, 20), (30, 30), (None, None)}
    kept = [(r.doc_id, r.text) for r in jaccard_join.keep_one_of_each(spark, frame, "").collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (5, b), (20, "other text"), (30, None), (30, ""), (None, a)], key=str)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 400)] + [(5, 5), (900, 901), (901, 900)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(200, 400)} == {7} and got[901] == 900
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark, docs, tmp_path):
    rng = random.Random(1)
    items = [(i, " ".join(f"q{rng.randrange(500)}" for _ in range(rng.randrange(15, 60)))) for i in range(6)]
    items += [(90, "tiny item"), (91, None), (92, ""), (93, items[0][1])]
    noise = " ".join(f"z{i}" for i in range(300))
    edited = items[1][1].split()
    edited[3] = "other"
    cut = items[2][1].split()
    rows = [(100, noise + " " + items[0][1].upper() + " " + noise), (101, " ".join(edited) + " " + noise),
            (102, noise), (103, " ".join(cut[:len(cut) // 2]) + " " + noise), (104, "Tiny\titem"),
            (105, items[3][1] + " " + items[3][1])]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    folder = saved(spark, tmp_path, documents=frame,
                   benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.op7_decontamination(spark, folder).collect()}
    assert {(100, 0), (100, 93), (105, 3), (104, 90)} <= set(got) and got[100, 0].start == 300
    n = len(shingles(items[1][1]))
    assert ((101, 1) in got) == ((n - 4) / (n + 4) >= 0.8)
    assert {d for d, _ in got} <= {100, 101, 104, 105} and got[105, 3].start == 0
    left = decontaminate.drop_contaminated(spark, frame, folder)
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in frame.collect()} - {d for d, _ in got}
    assert decontaminate.contaminated(frame.limit(0), spark.read.parquet(f"{folder}/benchmark.parquet")).count() == 0


def best_of_all_windows(text, item):
    """The greatest similarity over every start."""
    have, want = shingles(text), collections.Counter(shingles(item))
    size, best = sum(want.values()), 0
    for start in range(len(have)):
        window = collections.Counter(have[start:start + size])
        shared = sum((window & want).values())
        best = max(best, shared / (sum(window.values()) + size - shared))
    return round(best, 6)


def test_windows_of_copies_edited_at_both_ends(spark):
    """The best window begins at none of the places where a common shingle puts the item's beginning."""
    rng = random.Random(8)
    items, texts = [], []
    for i, (n, inserted) in enumerate([(59, 2), (59, 1), (80, 3), (100, 6), (100, 4), (120, 5)]):
        item = [f"i{i}q{rng.randrange(10 ** 6)}" for _ in range(n)]
        copy = ["first", *item[1:n // 2], *(f"new{i}x{k}" for k in range(inserted)), *item[n // 2:-1], "last"]
        noise = [[f"z{rng.randrange(10 ** 6)}" for _ in range(40)] for _ in range(2)]
        items.append((i, " ".join(item)))
        texts.append((i, " ".join([*noise[0], *copy, *noise[1]])))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(
        spark.createDataFrame(texts, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string")).collect()}
    best = {(i, i): best_of_all_windows(text, item) for (i, text), (_, item) in zip(texts, items)}
    assert got == {pair: s for pair, s in best.items() if s >= 0.8} and (0, 0) in got


def test_multi_index_finds_all_within_the_radius(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    marks = [base ^ sum(1 << b for b in rng.sample(range(64), k)) for k in list(range(0, 21)) * 8]
    signed = [(i, m - (1 << 64) if m >> 63 else m) for i, m in enumerate([base, *marks])]
    frame = spark.createDataFrame(signed, "id long, mark long")
    near = {(r.block, r.value) for r in frame.where("id = 0").select(F.explode(decontaminate.block_keys(
        F.col("mark"), True)).alias("k")).select("k.*").collect()}
    for row in frame.select("id", decontaminate.block_keys(F.col("mark"), False).alias("keys")).collect():
        assert {(k.block, k.value) for k in row["keys"]} & near


def test_shards_are_exact_and_gapless(spark, docs, folder, tmp_path):
    got = sharding.op4_sharding(spark, folder).toPandas()
    sizes = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert len(got) == 200 and sizes["count"].max() - sizes["count"].min() <= 1
    assert (sizes["min"] == 0).all() and (sizes["max"] == sizes["count"] - 1).all() and (sizes["nunique"] == sizes["count"]).all()
    got = sharding.op4_sharding(spark, saved(spark, tmp_path, documents=docs)).collect()
    assert len(got) == docs.count() and {r["size"] for r in got if r.doc_id in (4, 5)} == {1}
    assert all(r.text_crc32 == 0 for r in got if r.doc_id in (4, 5))
    row = next(r for r in got if r.doc_id == 13)
    text = docs.where("doc_id = 13").first().text.encode()
    assert (row["size"], row.text_crc32) == (len(text) + 1, zlib.crc32(text))
    empty = docs.limit(0).select("doc_id")
    assert sharding.shuffle_into_shards(empty, [F.col("doc_id")], 8).count() == 0


def test_shuffle_is_uniform(spark):
    """Shard and slot do not depend on the id, and neighbours part."""
    n, shards = 4000, 4
    rows = sharding.shuffle_into_shards(spark.range(n), [F.col("id")], shards, seed=5, block_rows=100).toPandas()
    table = np.zeros((4, shards))
    for i, s in zip(rows.id * 4 // n, rows.shard):
        table[i, s] += 1
    assert ((table - n / 16) ** 2 / (n / 16)).sum() < 28  # chi square, 9 degrees of freedom: 0.1 %
    assert abs(np.corrcoef(rows.id, rows.slot)[0, 1]) < 0.06


def test_hypergeometric_draws():
    rng = random.Random(1)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(20000)]
    share = collections.Counter(draws)
    for k in range(3, 10):
        want = math.comb(30, k) * math.comb(70, 20 - k) / math.comb(100, 20)
        assert abs(share[k] / 20000 - want) < 0.012
    big = sharding.hypergeometric(rng, 10 ** 12, 3 * 10 ** 12, 10 ** 9)
    assert abs(big - 2.5e8) < 1e5
    matrix = sharding.communication_matrix([5, 0, 17, 1], 3, 9)
    assert [sum(m) for m in matrix] == [5, 0, 17, 1] and sorted(map(sum, zip(*matrix))) == [7, 8, 8]


PAGES = [(1, "https://A.Example.net/en/x?q=1", '<a href="https://good.org/fr/">x</a>'), (2, "http://b.net", None),
         (3, "HTTP://x.example.com/de/1", "<a href='//spam.net/'>"), (4, None, "<a href=/x>"), (5, "no host", ""),
         (6, "https://good.org/fr/1#f", ""), (7, "https://good.org/en", '<A class=x HREF=rel>'),
         (8, "https://links.info/", '<a href="http://spam.net/1"><a href="http://spam.net/2">'),
         (9, "https://spam.net/", ""), (9, "https://spam.net/", ""), (10, "https://orgx.com/fr/", ""),
         (11, "https://fan.info/", '<a href="https://good.org/">'), (12, "://", "")]


def test_url_filter(spark, tmp_path):
    import duckdb

    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("rule", F.lit("x"))
    folder = saved(spark, tmp_path, pages=frame)
    got = url_filter.op8_url_filter(spark, folder).toPandas()
    assert len(got) == len(PAGES)
    of = got.drop_duplicates("page_id").set_index("page_id")
    assert of.loc[1, ["host", "path", "rule", "verdict"]].tolist() == ["a.example.net", "/en/x", "example.net/en/", "allow"]
    assert of.rule[2] is None and of.path[2] == "" and of.rule[3] == "example.com/de/" and of.verdict[3] == "block"
    assert of.host[4] == of.host[5] == "" and of.verdict[4] == of.verdict[5] == of.verdict[12] == "allow"
    assert of.rule[6] == "org/fr/" and of.rule[7] is None and of.verdict[7] == "allow" and of.rule[10] is None
    assert of.verdict[8] == "block" and of.verdict[11] == "allow" and of.rule[9] == "net/"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    want = db.execute(url_filter.sql()).df()
    order = ["page_id", "host"]
    left, right = (t.sort_values(order)[["page_id", "verdict", "trust", "distrust"]].reset_index(drop=True)
                   for t in (got, want))
    assert left.astype(str).equals(right.astype(str))
    assert url_filter.judge(frame.limit(0)).count() == 0


def test_url_rules_inline_and_joined_agree(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    frame = frame.withColumns({"host": url_filter.host_of(F.col("url")), "path": url_filter.path_of(F.col("url"))})
    rules = (*url_filter.RULES, url_filter.Rule("allow", "net", "/"))
    rows = [url_filter.judge_by_rules(frame, rules, inline).select("page_id", "rule", "_ruled").collect()
            for inline in (0, 99)]
    assert sorted(map(str, rows[0])) == sorted(map(str, rows[1]))


def test_trust_with_hubs_split(spark):
    edges = [("hub", f"h{i}", 1 + i % 3) for i in range(30)] + [("h1", "hub", 2), ("h2", "h3", 1)]
    frame = spark.createDataFrame(edges, "source string, target string, links long")
    seeds = spark.createDataFrame([("hub", 1.0, 0.0), ("h3", 0.0, 1.0)], "host string, trust double, distrust double")
    a, b = (sorted(map(str, url_filter.propagate(seeds, frame, edges_per_key=k).collect())) for k in (100_000, 4))
    assert a == b and len(a) == 31


def test_chat(spark, tmp_path):
    import duckdb

    rows = [(1, 0, "user", "hi # <x> \\"), (1, 1, "assistant", "### user: </turn>\n"), (2, None, None, None),
            (2, 5, "assistant", None), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    rows += [(4, i, ("user", "assistant")[i % 2], f"turn {i} <#\\>") for i in range(70)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1))
    folder = saved(spark, tmp_path, conversations=frame)
    got = chat.op5_chat(spark, folder).toPandas().sort_values("conv_id").reset_index(drop=True)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    sql = chat.SQL.replace("ORDER BY turn", "ORDER BY turn NULLS FIRST")
    want = db.execute(sql).df().sort_values("conv_id").reset_index(drop=True)
    assert len(got) == 5 and got.equals(want[got.columns].astype(got.dtypes.to_dict()))
    assert chat.conversation_digests(frame.limit(0)).count() == 0
    parts = chat.format_conversations(frame.where("conv_id = 4"), segment=16).collect()
    assert [p.segment for p in sorted(parts, key=lambda p: p.segment)] == [0, 1, 2, 3, 4]
    assert all(chat.unescape(p.formatted[s.begin:s.end]).startswith("turn ") for p in parts for s in p.spans)


def test_templates_that_rewrite_history():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]

    def last_marked(turns, first):
        return "".join(f"[{r}]{t}" + ("<end>" if i == len(turns) - 1 else "") for i, (r, t) in enumerate(turns))

    ((_, spans, _),) = chat.format_turns(iter(turns), last_marked)
    assert spans == [(6, 7), None, None]
    ((text, spans, _),) = chat.format_turns(iter(turns))
    assert [text[a:b] for a, b in spans] == ["a", "b", "c"] and chat.parse_marked(text) == turns


def last_answer_only(turns, first):
    last = max((i for i, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
    return "".join(f"[{i}/{r}]{t if r == 'user' or i == last else ''}\n" for i, (r, t) in enumerate(turns))


def counted_users(turns, first):
    """Rewrites nothing, but every turn is written after how many came before."""
    return "".join(f"{i}:{t};" for i, (_, t) in enumerate(turns))


def test_long_conversations_see_the_whole_prefix(spark):
    turns = [(("user", "assistant")[i % 2], f"text {i}") for i in range(60)]
    for template in (last_answer_only, counted_users):
        ((output, spans, seen),) = chat.format_turns(iter(turns), template)
        assert output == template(turns, True) and seen == turns
        for (begin, end), (_, text) in ((s, t) for s, t in zip(spans, turns) if s is not None):
            assert output[begin:end] == text
        # Answers but the first rewrite the one before, at every place; users' spans behind it are open.
        assert (None in spans) == (template is last_answer_only)
    frame = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)],
                                  "conv_id long, turn long, role string, text string")
    for template in (last_answer_only, counted_users, chat.marked_template):
        parts = sorted(chat.format_conversations(frame, template).collect(), key=lambda p: p.segment)
        assert "".join(p.formatted for p in parts) == template(turns, True)
        assert len(parts) == (3 if template is chat.marked_template else 1)
    swapped = chat.format_turns(iter(turns[:24] + [("assistant", "late")]), last_answer_only)
    assert [s for _, s, _ in swapped][0][23:] == [None, None]


@pytest.mark.parametrize("head", [500_000, 4])
def test_language_model(spark, docs, head):
    rng = random.Random(4)
    rows = [(100 + i, " ".join(f"a{rng.randrange(9)}" if i % 2 else f"b{rng.randrange(9)}" for _ in range(60)))
            for i in range(120)]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    frame = frame.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)))
    trained = lm_scoring.learn(frame.where(~F.col("held_out")).select("text"), head, passes=12)
    got = lm_scoring.score(frame.select("doc_id", "held_out", "text"), trained).toPandas()
    every = [(r.doc_id, r.held_out, [*words(r.text), None]) for r in frame.collect()]
    count = collections.Counter(w for _, held, line in every if not held for w in line)
    total, types = sum(count.values()), len(count)
    want = sorted((-1 if i is None else i, held, len(line), sum(w in count for w in line), total,
                   round(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (types + 1))) for w in line), 6))
                  for i, held, line in every)
    have = sorted((-1 if math.isnan(r.doc_id) else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                   round(r.base_score, 6)) for r in got.itertuples())
    assert have == want
    held = got[got.held_out & (got.doc_id >= 100)]
    assert held.score.sum() > held.base_score.sum()
    # The probabilities of all classes after any two add up to one.
    model, counts, n = trained.model, trained.counts, trained.counts.end + 1
    sums = [sum(np.exp(model.logits(np.full(n, c), np.full(n, one), np.arange(n)) - trained.normalisers[one, :n])
                for c in range(n)) for one in (0, n // 2, n)]
    assert np.allclose(sums, 1, atol=1e-3)
    # The score of every text, token by token.
    endings = {w: int(e) for line in every for w in line[2] if w for e in lm_scoring.word_ends([w])}
    ranked = sorted((w for w in count if w and count[w] >= trained.least),
                    key=lambda w: (-count[w], int(lm_scoring.word_hashes([w])[0].view(np.int64)[0])))
    own = {w: i for i, w in enumerate(ranked[:counts.own])}

    def class_of(word):
        return counts.end if word is None else own.get(word, counts.own + endings[word] % counts.shared)

    in_class = collections.Counter()
    for w, c in count.items():
        in_class[class_of(w)] += c
    unseen = (sum(c == 1 for c in count.values()) + 0.5) / (total + 1)

    def log_class(c, one, two):
        before = model.context[one] @ model.positions[0] + model.context[two] @ model.positions[1]
        logits = (model.target @ before + model.bias).astype(float)
        return logits[c] - np.log(np.exp(logits).sum())

    brute = collections.defaultdict(list)
    for i, _, line in every:
        one = two = counts.start
        value = 0.0
        for w in line:
            c = class_of(w)
            value += (math.log10(1 - unseen) + log_class(c, one, two) / math.log(10) + math.log10(count[w] / in_class[c])
                      if count[w] else math.log10(unseen))
            one, two = c, one
        brute[-1 if i is None else i].append(value)
    scores = collections.defaultdict(list)
    for r in got.itertuples():
        scores[-1 if math.isnan(r.doc_id) else int(r.doc_id)].append(r.score)
    assert scores.keys() == brute.keys()
    for key, values in brute.items():
        assert np.allclose(sorted(scores[key]), sorted(values), rtol=1e-4, atol=1e-3)
    nothing = lm_scoring.learn(frame.limit(0).select("text"), passes=2)
    assert lm_scoring.score(frame.select("doc_id", "held_out", "text"), nothing).where("n_known = 0").count() == len(every)
    assert lm_scoring.score(frame.limit(0), trained).count() == 0


def chained(n, seed):
    """Texts whose next word follows from the two before, mostly."""
    rng = random.Random(seed)
    for i in range(n):
        line = ["w1", "w2"]
        while len(line) < 50:
            a, b = (int(w[1:]) for w in line[-2:])
            line.append(f"w{(a * 7 + b * 3) % 40 if rng.random() < 0.8 else rng.randrange(40)}")
        yield seed * 100_000 + i, " ".join(line)


def test_language_model_learns_more_from_more_texts(spark):
    """Held-out texts are better foretold by a larger corpus, and one model comes from any partitioning."""
    held = spark.createDataFrame([(i, True, t) for i, t in chained(60, 1)], "doc_id long, held_out boolean, text string")
    every = spark.createDataFrame(list(chained(1200, 2)), "doc_id long, text string")

    def total(texts):
        return lm_scoring.score(held, lm_scoring.learn(texts)).agg(F.sum("score")).first()[0]

    few, many = total(every.where("doc_id < 200040").select("text")), total(every.select("text"))
    assert many > few
    assert total(every.repartition(7).select("text")) == pytest.approx(many, rel=1e-6)


def test_language_model_in_many_shards(spark):
    """The mean over shards takes every triple in, and the order of files does not matter."""
    texts = spark.createDataFrame(list(chained(300, 3)), "doc_id long, text string").select("text")
    vocabulary = lm_scoring.materialize(lm_scoring.count_words(texts), "v")
    counts, _ = lm_scoring.gather(vocabulary, texts.count())
    shared = spark.sparkContext.broadcast(counts)
    triples = lm_scoring.count_triples(texts, shared)
    assert triples.agg(F.sum("n")).first()[0] == counts.tokens
    one, parts = (lm_scoring.train(triples, counts, 4, shard_triples=size) for size in (1 << 20, 500))
    start, _ = lm_scoring.first_model(counts)
    rows = triples.toPandas()
    base = counts.start + 1
    word, before, second = (rows.triple // base ** k % base for k in range(3))

    def loss(model):
        norm = np.stack([model.normaliser(c) for c in range(base)])
        logits = model.logits(word.to_numpy(), before.to_numpy(), second.to_numpy())
        return -np.average(logits - norm[before, second], weights=rows.n)

    assert loss(one) < loss(start) and loss(parts) < loss(start)
