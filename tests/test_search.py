import hashlib
import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shotgrove.operators import bm25, knn, neighbors, topk


def vectors(spark, data, key):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, f"{key} bigint, emb array<float>")


def found(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in df.collect())


def brute(queries, corpus, k, metric, cells=None, probes=None):
    score = knn.similarity(queries.astype("f4").astype("f8"), corpus.astype("f4").astype("f8"), metric)
    out = []
    for q, line in enumerate(score):
        docs = [d for d in range(len(corpus)) if cells is None or cells[d] in probes[q]]
        best = sorted(docs, key=lambda d: (-line[d], d))[:k]
        out += [(q, r + 1, d, round(float(line[d]), 6)) for r, d in enumerate(best)]
    return sorted(out)


@pytest.fixture(scope="module")
def data():
    """Vectors of which a third are copies of one, so that ties cross every block."""
    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(900, 6))
    corpus[::3] = corpus[0]
    return rng.normal(size=(40, 6)), corpus


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
@pytest.mark.parametrize("limit", [0, 10**6])
def test_exact(spark, data, metric, limit, monkeypatch):
    monkeypatch.setattr(topk.search_chunks, "__defaults__", (1, 200))
    queries, corpus = data
    got = knn.knn_exact(vectors(spark, queries, "query_id"), vectors(spark, corpus, "doc_id").repartition(5), 7,
                        metric, limit)
    assert found(got) == brute(queries, corpus, 7, metric)


def test_fewer_rows_than_k(spark, data):
    queries, corpus = data[0], data[1][:3]
    got = knn.knn_exact(vectors(spark, queries, "query_id"), vectors(spark, corpus, "doc_id"), 5)
    assert found(got) == brute(queries, corpus, 5, "ip")


def test_no_queries_and_no_corpus(spark, data):
    some = vectors(spark, data[1], "doc_id")
    empty = vectors(spark, data[0], "query_id").where("query_id < 0")
    assert knn.knn_exact(empty, some, 3).count() == 0
    none = some.where("doc_id < 0")
    assert knn.knn_exact(vectors(spark, data[0], "query_id"), none, 3).count() == 0


def test_bounds_change_nothing(spark, data):
    queries, corpus = data
    table = vectors(spark, queries, "query_id").toArrow()
    docs = vectors(spark, corpus, "doc_id").repartition(6)

    def scorer(t):
        return knn.VectorScorer(t, "ip", 6)

    assert len(topk._lower_bounds(table, docs, 7, scorer, 4)) == len(queries)
    bounded = topk.search_broadcast(table, docs, 7, scorer, bound_from=0, bound_share=4)
    assert found(bounded) == brute(queries, corpus, 7, "ip")


def test_bounds_shorten_the_lists(data):
    queries, corpus = data
    scores = np.round(queries @ corpus.T, 6)
    floor = np.sort(scores, axis=1)[:, -3]
    best = topk.RunningBest(len(queries), 10, floor)
    best.offer(np.arange(len(queries)), np.arange(len(corpus)), scores)
    kept = best.to_batch(np.arange(len(queries)))
    assert len(queries) * 3 <= kept.num_rows < len(queries) * 10 or (scores >= floor[:, None]).sum() > len(queries) * 9


@pytest.mark.parametrize("limit", [0, 10**6])
@pytest.mark.parametrize("nprobe", [1, 3, 8])
def test_inverted_file(spark, data, limit, nprobe, monkeypatch):
    monkeypatch.setattr(topk.search_chunks, "__defaults__", (1, 400))
    queries, corpus = data
    centers = np.random.default_rng(5).normal(size=(8, 6))
    centroids = spark.createDataFrame([(10 * i, [float(x) for x in c]) for i, c in enumerate(centers)],
                                      "cell int, emb array<double>")
    got = knn.knn_ivf(vectors(spark, queries, "query_id"), vectors(spark, corpus, "doc_id"), centroids, 5, nprobe,
                      max_broadcast_values=limit)
    cells = knn.similarity(corpus.astype("f4").astype("f8"), centers, "ip").argmax(axis=1)
    order = np.argsort(-knn.similarity(queries.astype("f4").astype("f8"), centers, "ip"), axis=1)
    probes = [set(line[:nprobe]) for line in order]
    assert found(got) == brute(queries, corpus, 5, "ip", cells, probes)
    if nprobe == 8:
        assert found(got) == brute(queries, corpus, 5, "ip")


def test_stored_index(spark, data, tmp_path):
    queries, corpus = (vectors(spark, d, key) for d, key in zip(data, ("query_id", "doc_id")))
    centroids = knn.kmeans_centroids(corpus, 6, seed=1)
    knn.write_index(corpus, centroids, str(tmp_path / "ix"))
    stored = knn.search_index(queries, str(tmp_path / "ix"), 5, 2)
    assert found(stored) == found(knn.knn_ivf(queries, corpus, centroids, 5, 2))
    near = knn.knn_ivf(queries, corpus, centroids, 5, 4)
    assert knn.recall(near, knn.knn_exact(queries, corpus, 5)).first()["recall"] >= 0.6


def test_the_corpus_stays_where_it_lies(spark, data, monkeypatch):
    """Chunks of queries: no exchange but that of the short lists."""
    plans = []
    write = topk.materialize
    monkeypatch.setattr(topk, "materialize", lambda df, name: (plans.append(
        df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    monkeypatch.setattr(topk.search_chunks, "__defaults__", (1, 150))
    queries, corpus = (vectors(spark, d, key) for d, key in zip(data, ("query_id", "doc_id")))
    got = knn.knn_exact(queries, corpus, 5, max_broadcast_values=0)
    assert found(got) == brute(*data, 5, "ip") and len(plans) >= 4
    for plan in plans:
        assert plan.count("Exchange") == 1 and "hashpartitioning(query_id" in plan and "CoGroup" not in plan


def test_folders_of_other_cells_are_not_read(spark, data, tmp_path):
    queries, corpus = (vectors(spark, d, key) for d, key in zip(data, ("query_id", "doc_id")))
    knn.write_index(corpus, knn.kmeans_centroids(corpus, 6, seed=1), str(tmp_path / "ix"))
    stored, centroids = knn.open_index(spark, str(tmp_path / "ix"))
    one = topk.materialize(knn.nearest_cells(queries.where("query_id = 3"), knn.load_cells(centroids), 1), "one")
    rows = knn.probed_rows(stored, one)
    assert "dynamicpruning" in rows._jdf.queryExecution().executedPlan().toString().lower()
    assert {r["cell"] for r in rows.select("cell").distinct().collect()} == {one.first()["cell"]}


AWKWARD = [(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [1.0, None]), (4, [1.0]), (5, [1.0, 2.0, 3.0]), (6, []),
           (7, [0.5, 0.5]), (None, [9.0, 9.0]), (8, [float("inf"), 1.0])]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_rows_without_a_vector(spark, tmp_path, limit):
    """NULL, NaN, NULL inside, other lengths and rows without id: no neighbours, and nobody's, on every path."""
    corpus = spark.createDataFrame(AWKWARD, "doc_id bigint, emb array<float>")
    queries = spark.createDataFrame([(i, v) for i, v in AWKWARD if v is None or len(v) < 3], "query_id bigint, emb array<float>")
    centroids = spark.createDataFrame([(0, [1.0, 1.0]), (1, [-1.0, -1.0])], "cell int, emb array<double>")
    knn.write_index(corpus, centroids, str(tmp_path / "ix"))
    for got in (knn.knn_exact(queries, corpus, 9, max_broadcast_values=limit),
                knn.knn_ivf(queries, corpus, centroids, 9, 2, max_broadcast_values=limit),
                knn.search_index(queries, str(tmp_path / "ix"), 9, 2, max_broadcast_values=limit)):
        rows = {(r["query_id"], r["doc_id"]) for r in got.collect()}
        assert {p for p in rows if 8 not in p} == {(0, 0), (0, 7), (7, 0), (7, 7)}
        assert {i for p in rows for i in p} <= {0, 7, 8}


def texts(spark, data, key):
    return spark.createDataFrame(list(enumerate(data)), f"{key} bigint, text string")


def brute_bm25(queries, corpus, k):
    docs = [Counter(re.findall(r"[^\W_]+", d.lower())) for d in corpus]
    sizes = [sum(d.values()) for d in docs]
    mean = sum(sizes) / len(docs)
    df = Counter(t for d in docs for t in d)
    out = []
    for q, text in enumerate(queries):
        scored = []
        for i, d in enumerate(docs):
            score = sum(
                n * math.log(1 + (len(docs) - df[t] + .5) / (df[t] + .5))
                * d[t] / (d[t] + .9 * (.6 + .4 * sizes[i] / mean))
                for t, n in Counter(re.findall(r"[^\W_]+", text.lower())).items() if t in d)
            if score > 0:
                scored.append((-round(score, 6), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    """Documents that all hold one word, a third of them equal."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(60)]
    docs = ["the " + " ".join(rng.choice(words, size=rng.integers(1, 30))) for _ in range(240)]
    docs[::3] = [docs[0]] * len(docs[::3])
    asked = ["the the " + " ".join(rng.choice(words, size=5)) for _ in range(30)] + ["The", "unknown", "w1 W1 w2"]
    return asked, docs + ["", "..."]


BOUNDED = {"plain_postings": 0, "bound_postings": 40}


@pytest.mark.parametrize("options", [{}, BOUNDED, {"plain_postings": 0, "bound_postings": 1}])
def test_lexical(spark, prose, options):
    asked, docs = prose
    got = bm25.bm25_topk(texts(spark, asked, "query_id"), texts(spark, docs, "doc_id").repartition(4), 6, **options)
    assert found(got) == brute_bm25(asked, docs, 6)


@pytest.mark.parametrize("options", [{}, BOUNDED])
def test_lexical_over_a_stored_index(spark, prose, tmp_path, options):
    asked, docs = prose
    bm25.write_index(texts(spark, docs, "doc_id"), str(tmp_path / "ix"), buckets=8, block_postings=20)
    index = bm25.open_index(spark, str(tmp_path / "ix"))
    assert index.n_docs == len(docs)
    held = {r["term"]: r for r in index.blocks.groupBy("term").agg(
        F.count("*").alias("blocks"), F.max("held").alias("most"), F.sum("held").alias("df")).collect()}
    assert held["the"]["df"] == 240 and held["the"]["blocks"] >= 8 and max(r["most"] for r in held.values()) < 120
    assert found(bm25.bm25_topk(texts(spark, asked, "query_id"), index, 6, **options)) == brute_bm25(asked, docs, 6)


def test_lexical_reads_the_buckets_of_asked_terms(spark, prose, tmp_path):
    bm25.write_index(texts(spark, prose[1], "doc_id"), str(tmp_path / "ix"), buckets=16)
    index = bm25.open_index(spark, str(tmp_path / "ix"))
    asked = bm25.materialize(bm25.query_terms(spark.createDataFrame([(1, ["w1", "w2"])], "query_id long, words array<string>")),
                             "asked")
    wanted = bm25.materialize(bm25.weighted_terms(asked, index), "weighted")
    scored = bm25._scored(index, wanted)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "Python" not in plan and "Arrow" not in plan
    scored.collect()
    ran = scored._jdf.queryExecution().executedPlan()
    scans = [s for s in _leaves(ran) if s.nodeName().startswith("Scan parquet") and s.metrics().contains("numPartitions")]
    assert scans and min(s.metrics().apply("numPartitions").value() for s in scans) <= 2
    assert "posted" not in bm25.weighted_terms(asked, index)._jdf.queryExecution().executedPlan().toString().split(
        "ReadSchema")[1].split("\n")[0]


def _leaves(plan):
    """Leaves of a plan that ran, through the stages of adaptive execution."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _leaves(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return _leaves(plan.plan())
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    return [leaf for child in children for leaf in _leaves(child)] if children else [plan]


def test_lexical_bounds_leave_frequent_terms_unread(spark):
    """Of the word that all documents hold, only the blocks of documents with the rare words are read."""
    docs = [f"the w{i % 50} x{i}" for i in range(2000)]
    asked = texts(spark, ["the x7", "the x9 x11"], "query_id")
    got = bm25.bm25_topk(asked, texts(spark, docs, "doc_id"), 1, plain_postings=0, bound_postings=10)
    assert found(got) == brute_bm25(["the x7", "the x9 x11"], docs, 1)


def test_lexical_with_missing_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (None, "a"), (4, "a a"), (4, "b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "query_id long, text string")
    for options in ({}, BOUNDED):
        got = bm25.bm25_topk(asked, docs, 5, **options).collect()
        assert {r["query_id"] for r in got} == {1} and {r["doc_id"] for r in got} == {1, None, 4}
        assert len({(r["doc_id"], r["rank"]) for r in got}) == len(got)


def test_lexical_without_words(spark):
    assert bm25.bm25_topk(texts(spark, ["a"], "query_id"), texts(spark, ["..."], "doc_id")).count() == 0


def test_switch(spark, data):
    queries, corpus = (vectors(spark, d, key) for d, key in zip(data, ("query_id", "doc_id")))
    assert found(neighbors.retrieve(queries, corpus, "dense", k=2)) == brute(*data, 2, "ip")
    centroids = knn.kmeans_centroids(corpus, 4)
    assert neighbors.retrieve(queries, corpus, "dense", k=2, centroids=centroids, nprobe=4).count() == 80
    with pytest.raises(ValueError, match="unknown retriever"):
        neighbors.retrieve(queries, corpus, "other")


def test_cache_searches_each_query_once(spark, data, tmp_path, monkeypatch):
    queries, corpus = (vectors(spark, d, key) for d, key in zip(data, ("query_id", "doc_id")))
    cache = neighbors.NeighborCache(spark, str(tmp_path / "cache"))
    searched, retrieve = [], neighbors.retrieve

    def counting(new, *rest, **options):
        searched.append(sorted(r["query_id"] for r in new.collect()))
        return retrieve(new, *rest, **options)

    monkeypatch.setattr(neighbors, "retrieve", counting)
    first = queries.where("query_id < 10")
    assert cache.fetch(first, corpus, "dense", k=3).count() == 30
    assert found(cache.fetch(queries, corpus, "dense", k=3)) == brute(*data, 3, "ip")
    assert cache.fetch(first, corpus, "dense", k=3).count() == 30
    assert searched == [list(range(10)), list(range(10, 40))]


def test_neighbors_of_pairs(spark):
    sentences = spark.createDataFrame([("p", 0), ("p", 1), ("s", 0)], "guid string, sent_id int")
    queries = neighbors.number_queries(sentences)
    assert [r["query_id"] for r in queries.orderBy("guid", "sent_id").collect()] == [0, 1, 2]
    hits = spark.createDataFrame([(0, 1, 8, .9), (0, 2, 9, .5), (1, 1, 9, .7), (1, 2, 7, .7), (2, 1, 7, .1)],
                                 "query_id bigint, rank int, doc_id bigint, score double")
    corpus = spark.createDataFrame([(7, "g"), (8, "h"), (9, "i")], "doc_id bigint, text string")
    rows = neighbors.neighbor_rows(queries, hits, corpus)
    got = {r["guid"]: r["neighbor_texts"] for r in neighbors.attach_neighbors(rows).collect()}
    assert got == {"p": ["h", "i", "i", "g"], "s": ["g"]}


def test_batches(spark):
    got = neighbors.batch_queries(spark.range(70).select(F.format_string("%03d", "id").alias("guid")), "guid")
    assert {(int(r["guid"]), r["batch_id"], r["pos"]) for r in got.collect()} == {(i, i // 32, i % 32) for i in range(70)}


def test_encoder_gives_unit_vectors(spark):
    corpus = texts(spark, ["a b c", "a d", "e", "A a, a"], "doc_id")
    encoder = neighbors.fit_encoder(corpus, 32)
    rows = {r["doc_id"]: r["emb"] for r in neighbors.encode_texts(corpus, encoder).collect()}
    assert {len(v) for v in rows.values()} == {32}
    assert all(sum(x * x for x in v) == pytest.approx(1) for v in rows.values())
    place = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 32 for w in "abcde"}
    assert rows[3][place["a"]] == pytest.approx(1) and encoder.weights[place["e"]] == pytest.approx(math.log(5 / 2))
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert [set(r["emb"]) for r in neighbors.encode_texts(none, encoder).collect()] == [{0.0}, {0.0}]
    assert neighbors.fit_encoder(none.limit(0), 4).weights == (0, 0, 0, 0)


def test_dense_retrieval_of_texts(spark):
    corpus = texts(spark, ["red apples grow", "blue sky above", "apples and pears", "", "sky"], "doc_id")
    asked = texts(spark, ["apples", "the sky"], "query_id")
    got = neighbors.retrieve(asked, corpus, "dense", k=2).collect()
    assert {r["doc_id"] for r in got if r["query_id"] == 0} == {0, 2} and {
        r["doc_id"] for r in got if r["query_id"] == 1} >= {4}
    plan = neighbors.retrieve(asked, corpus, "dense", k=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # texts are neither written nor moved


def test_cache_with_centroids(spark, data, tmp_path):
    """Settings with tables and encoders are told apart by their values, also in another session's order."""
    queries, corpus = (vectors(spark, d, key) for d, key in zip(data, ("query_id", "doc_id")))
    cache = neighbors.NeighborCache(spark, str(tmp_path / "cache"))
    rows = [(i, [float(i), 1.0, 0.0, 0.0, 0.0, -1.0]) for i in range(3)]
    centroids = spark.createDataFrame(rows, "cell int, emb array<double>")
    again = spark.createDataFrame(rows[::-1], "cell int, emb array<double>")
    first = found(cache.fetch(queries, corpus, "dense", k=3, centroids=centroids, nprobe=3))
    assert first == brute(*data, 3, "ip")
    assert cache.missing(queries, "dense", k=3, centroids=again, nprobe=3).count() == 0
    assert cache.missing(queries, "dense", k=3, centroids=again, nprobe=2).count() == 40
    assert cache.missing(queries, "dense", k=3, centroids=again.where("cell > 0"), nprobe=3).count() == 40


def test_hits_as_json(spark):
    raw = spark.createDataFrame([('{"id": 1, "contents": "a \\"b\\""}',)], "raw string")
    assert neighbors.parse_hits(raw).first()["text"] == 'a "b"'


def test_empty_table_has_no_vectors():
    assert knn.matrix(pa.chunked_array([], pa.list_(pa.float32()))).shape[0] == 0


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_a_task_holds_small_blocks_of_scores(metric):
    """Large batches of rows, copies among them: the same hits, in blocks, and lists sent some queries at a time."""
    rng = np.random.default_rng(11)
    corpus, asked = rng.normal(size=(20_000, 8)), rng.normal(size=(1_500, 8))
    corpus[::5] = corpus[0]

    def rows(key, data):
        return pa.table({key: np.arange(len(data)), "emb": pa.array(list(data))})

    queries, batch = rows("query_id", asked), rows("doc_id", corpus).to_batches()
    tracemalloc.start()
    sent = list(topk._scan(iter(batch), knn.VectorScorer(queries, metric, 8), 6))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120_000_000
    got = {}
    for q, d, s in (x for b in sent for x in zip(*(b.column(i).to_pylist() for i in range(3)))):
        got.setdefault(q, []).append((-s, d))
    for q in range(0, 1_500, 100):
        scores = knn.similarity(asked[q:q + 1], corpus, metric)[0]
        assert sorted(got[q]) == sorted(zip((-scores).tolist(), range(20_000)))[:6]


def test_long_lists_are_sent_in_parts():
    best = topk.RunningBest(30_000, 64)
    best.scores[:], best.ids[:] = 1.0, 0
    sent = list(best.to_batches(np.arange(30_000)))
    assert sum(b.num_rows for b in sent) == 30_000 * 64 and max(b.num_rows for b in sent) <= 500_000


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]


def test_postings_move_once(spark, prose, tmp_path):
    """To their share of a bucket when an index is built, and to their document, once for all queries, when it is read."""
    docs = texts(spark, prose[1], "doc_id")
    posted = topk.materialize(bm25.postings(bm25.document_rows(docs)), "posted")
    moved = exchanges(bm25.blocks_of(posted, 5.0, 8, 20))
    assert len(moved) == 1 and "bucket" in moved[0]
    bm25.write_index(docs, str(tmp_path / "ix"), buckets=8, block_postings=20)
    index = bm25.open_index(spark, str(tmp_path / "ix"))
    asked = bm25.query_terms(bm25.document_rows(texts(spark, prose[0], "doc_id")).select(
        F.col("doc_id").alias("query_id"), F.col("terms").alias("words")))
    weighted = topk.materialize(bm25.weighted_terms(topk.materialize(asked, "asked"), index), "weighted")
    moved = exchanges(bm25._scored(index, weighted.select("query_id", "bucket", "term", "weight")))
    assert len(moved) == 1 and "query_id" not in moved[0].split("ENSURE")[0].split("REPARTITION")[0]


@pytest.mark.parametrize("few", [0, 10**6])
def test_bounds_with_few_and_many_open_documents(spark, prose, few, monkeypatch):
    asked, docs = prose
    monkeypatch.setattr(bm25, "BROADCAST_ROWS", few)
    got = bm25.bm25_topk(texts(spark, asked, "query_id"), texts(spark, docs, "doc_id"), 6, plain_postings=0, bound_postings=5)
    assert found(got) == brute_bm25(asked, docs, 6)


def test_texts_of_neighbours_move_once(spark):
    rows = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 1, None), (2, 0, 1, "c")],
                                 "guid int, sent_id int, rank int, text string")
    shown = neighbors.texts_by_sentence(rows)
    assert len(exchanges(shown)) == 1
    assert sorted(tuple(r) for r in shown.collect()) == [(1, [["a", "b"], [None]]), (2, [["c"]])]


@pytest.mark.parametrize("k", [16, 64])
def test_a_task_holds_little_for_a_whole_chunk(k):
    """As many queries as a chunk may have, with vectors of 64 numbers: their vectors, lists and blocks stay small."""
    rng = np.random.default_rng(13)
    corpus = rng.normal(size=(20_000, 64))
    asked = rng.normal(size=(topk.CHUNK_VALUES // (64 + 2 * k), 64))
    queries = pa.table({"query_id": np.arange(len(asked)), "emb": pa.array(list(asked))})
    batches = pa.table({"doc_id": np.arange(len(corpus)), "emb": pa.array(list(corpus))}).to_batches()
    tracemalloc.start()
    first = {}
    for batch in topk._scan(iter(batches), knn.VectorScorer(queries, "ip", 64), k):
        if not first:
            first = batch.slice(0, k).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 65_000_000
    scores = knn.similarity(asked[:1], corpus, "ip")[0]
    best = sorted(zip((-scores).tolist(), range(len(corpus))))[:k]
    assert first["query_id"] == [0] * k and sorted(zip((-s for s in first["score"]), first["doc_id"])) == best


def test_masks_are_read_as_numpy_reads_them():
    rng = np.random.default_rng(3)
    for shape, share in (((256, 4096), 0.001), ((7, 13), 0.5), ((3, 5), 0), ((2, 8), 1), ((4, 1), 0.5), ((0, 5), 0), ((5, 0), 0)):
        mask = rng.random(shape) < share
        assert [a.tolist() for a in knn._where(mask)] == [a.tolist() for a in np.nonzero(mask)]


def test_passes_have_few_tasks(spark, monkeypatch):
    """Each task of a pass sends its own lists, so their number must not grow with the parts of the corpus."""
    data = np.random.default_rng(5).normal(size=(300, 4))
    queries, corpus = vectors(spark, data[:40], "query_id"), vectors(spark, data, "doc_id").repartition(60)
    seen, search = [], topk.search_broadcast
    monkeypatch.setattr(topk, "search_broadcast", lambda asked, rows, *more: (
        seen.append(rows.rdd.getNumPartitions()), search(asked, rows, *more))[1])
    hits = knn.knn_exact(queries, corpus, 3, max_broadcast_values=1)
    assert found(hits) == brute(data[:40], data, 3, "ip")
    assert seen and max(seen) <= topk.TASKS_PER_CORE * spark.sparkContext.defaultParallelism < 60
