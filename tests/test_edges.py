"""NULL, NaN, constant, empty and missing cases, on both sides of every size switch."""

import math

import pytest
from pyspark.sql import functions as F

from shotgrove.operators import evaluate, knn, labels, neighbors, numbering, sampling, scoring, vocab
from shotgrove.tasks import label_table

VECTORS = "{} bigint, emb array<double>"


def best(hits):
    return sorted((r["query_id"], r["rank"], r["doc_id"]) for r in hits.collect())


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_search_with_nan_and_null_vectors(spark, limit):
    rows = [(i, [float(i), 1.0]) for i in range(50)] + [(50, [math.nan, 1.0]), (51, None)]
    corpus = spark.createDataFrame(rows, VECTORS.format("doc_id"))
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [math.nan, 0.0])], VECTORS.format("query_id"))
    hits = knn.knn_exact(queries, corpus, k=3, max_broadcast_values=limit)
    assert best(hits) == [(0, 1, 49), (0, 2, 48), (0, 3, 47)]


PREDS = [("a", float(i), float(i * i)) for i in range(5)] + [("a", None, 1.0), ("a", 9.0, None)]
PREDS += [("b", 1.0, 2.0), ("b", 2.0, 2.0), (None, 1.0, 3.0), (None, 2.0, 1.0), ("c", None, 1.0), ("d", 1.0, 1.0)]


@pytest.mark.parametrize("window_rows", [1_000_000, 0])
def test_rank_correlation(spark, window_rows):
    preds = spark.createDataFrame(PREDS, "task string, label double, pred double")
    got = {r["task"]: r["spearman"] for r in evaluate.spearman(preds, ["task"], window_rows).collect()}
    assert got == {"a": pytest.approx(1.0), "b": None, None: pytest.approx(-1.0), "c": None, "d": None}
    whole = evaluate.spearman(preds.where("task = 'a'").drop("task"), [], window_rows).first()
    assert whole["spearman"] == pytest.approx(1.0)


def test_correlation_and_evaluation_survive_constants(spark):
    preds = spark.createDataFrame(PREDS, "task string, label double, pred double")
    got = {r["task"]: r["pearson"] for r in evaluate.pearson(preds, ["task"]).collect()}
    assert got["b"] is None and got["c"] is None and got["d"] is None and got[None] == pytest.approx(-1.0)
    registry = spark.createDataFrame([(t, "pearson_spearman") for t in "abcd"], "task string, metric string")
    values = evaluate.evaluate(preds.where("task IS NOT NULL"), registry).collect()
    assert {r["task"] for r in values} == set("abcd")


def test_missing_predictions_are_wrong_everywhere(spark):
    preds = spark.createDataFrame([(1, 1)] * 5 + [(1, None), (0, None)], "label int, pred int")
    rows = preds.withColumn("task", F.lit("t"))
    accuracy = evaluate.accuracy(rows, ["task"]).first()["acc"]
    both = evaluate.f1_binary(rows, ["task"]).first()
    assert accuracy == both["acc"] == pytest.approx(5 / 7) and both["f1"] == pytest.approx(10 / 11)


@pytest.mark.parametrize("window_rows", [1_000_000, 0])
def test_running_totals_keep_rows_without_a_key(spark, window_rows):
    rows = [("a", 1), ("a", 2), (None, 1), (None, 2), (None, 3)]
    frame = spark.createDataFrame(rows, "k string, v int")
    got = numbering.running_total(frame, ["k"], [F.col("v")], F.col("v").cast("bigint"), "t", window_rows).collect()
    assert sorted((r["k"] or "", r["v"], r["t"]) for r in got) == [
        ("", 1, 1), ("", 2, 3), ("", 3, 6), ("a", 1, 1), ("a", 2, 3)]


@pytest.mark.parametrize("head_rows", [50_000, 6])
def test_empty_rows_are_encoded_and_decoded(spark, head_rows):
    features = spark.createDataFrame([("x", ["b", "a", "b"]), ("y", []), ("z", None), ("u", ["new"])],
                                     "guid string, tokens array<string>")
    words = vocab.stored_vocab(vocab.build_vocab(features.where("guid = 'x'").select(F.explode("tokens").alias("token"))))
    encoded = vocab.encode_ids(features, words, head_rows=head_rows)
    assert {r["guid"]: r["ids"] for r in encoded.collect()} == {"x": [5, 6, 5], "y": [], "z": [], "u": [3]}
    decoded = vocab.decode_ids(encoded, words, head_rows=head_rows)
    assert {r["guid"]: r["text"] for r in decoded.collect()} == {"x": "b a b", "y": "", "z": "", "u": "<unk>"}


def test_hits_without_a_document_stay(spark):
    queries = spark.createDataFrame([(0, "g", 0)], "query_id bigint, guid string, sent_id int")
    hits = spark.createDataFrame([(0, 1, 7, 0.5), (0, 2, 8, 0.4)], "query_id bigint, rank int, doc_id bigint, score double")
    corpus = spark.createDataFrame([(8, "text")], "doc_id bigint, text string")
    rows = neighbors.neighbor_rows(queries, hits, corpus)
    assert neighbors.attach_neighbors(rows).first()["neighbor_texts"] == [None, "text"]


def test_cache_knows_depth_and_setting(spark, tmp_path):
    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], VECTORS.format("doc_id"))
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], VECTORS.format("query_id"))
    cache = neighbors.NeighborCache(spark, str(tmp_path / "cache"))
    assert cache.fetch(queries.limit(0), corpus, "dense", k=2).count() == 0
    assert cache.fetch(queries, corpus, "dense", k=2).count() == 4
    assert cache.fetch(queries, corpus, "dense", k=5).count() == 10
    assert cache.fetch(queries, corpus, "dense", k=3).count() == 6
    assert cache.missing(queries, "dense", k=5).count() == 0 and cache.missing(queries, "dense", k=6).count() == 2
    far = cache.fetch(queries, corpus, "dense", k=1, metric="l2")
    assert best(far) == best(knn.knn_exact(queries, corpus, k=1, metric="l2"))
    cache.read().where("depth = 5").write.mode("append").parquet(str(tmp_path / "cache"))  # a retried append
    assert cache.fetch(queries, corpus, "dense", k=5).count() == 10
    assert cache.fetch(queries, corpus.limit(0), "dense", k=9).count() == 0
    assert cache.missing(queries, "dense", k=9).count() == 0


def test_scored_tasks_are_labelled_and_drawn_by_halves(spark):
    rows = [("sts-b", f"g{i}", "a", "b", str(i / 10)) for i in range(50)]
    examples = spark.createDataFrame(rows, "task string, guid string, text_a string, text_b string, label string")
    found = labels.label_ids(examples, label_table(spark), number="value").collect()
    assert all(r["label_id"] is None and r["value"] == float(r["label"]) for r in found)
    draws = sampling.draw_splits(examples, 3, (13,))
    assert draws.where("split = 'train'").count() == 6 and {r["label"] for r in draws.collect()} == {"0", "1"}
    back = sampling.with_rows(draws, examples).collect()
    assert all(r["class"] == str(int(float(r["label"]) >= 2.5)) for r in back)


def test_scores_of_string_guids(spark):
    features = spark.createDataFrame([("train-1", 2.0)], "guid string, x double")
    out = scoring.external_scores(features, lambda pdf: pdf.assign(label_id=1, logit=pdf.x))
    assert out.first()["guid"] == "train-1"
