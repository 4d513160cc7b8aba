import hashlib

import pytest
from pyspark.sql import functions as F

from shotgrove.operators import sampling as S
from shotgrove.operators.numbering import row_numbers, running_total, top_per_group


def labelled(spark, *classes):
    rows = [("t", f"{label}{i}", label) for label, n in classes for i in range(n)]
    return spark.createDataFrame(rows, "task string, guid string, label string")


def expected(df, seed, limit):
    groups = {}
    for r in df.collect():
        key = hashlib.md5(f"{seed}:{r['task']}:{r['guid']}".encode()).hexdigest()
        groups.setdefault(r["label"], []).append((key, r["guid"]))
    return {(label, i + 1, g) for label, rows in groups.items() for i, (_, g) in enumerate(sorted(rows)[:limit])}


def drawn(df):
    return {(r["label"], r["draw"], r["guid"]) for r in df.collect()}


@pytest.mark.parametrize("cut_from", [0, 10**9])
def test_draws(spark, cut_from):
    examples = labelled(spark, ("hot", 3000), ("mid", 500), ("short", 20), ("tiny", 3))
    got = S.draw_splits(examples, 16, (13, 21), cut_from=cut_from)
    for seed in (13, 21):
        assert drawn(got.where(F.col("seed") == seed)) == expected(examples, seed, 32)
    sizes = {(r["split"], r["label"]): r["n"] for r in got.where("seed = 13").groupBy("split", "label").agg(
        F.count("*").alias("n")).collect()}
    assert sizes == {("train", "hot"): 16, ("dev", "hot"): 16, ("train", "mid"): 16, ("dev", "mid"): 16,
                     ("train", "short"): 16, ("dev", "short"): 4, ("train", "tiny"): 3}
    assert S.leaked(got).count() == 0


def test_a_class_without_label_is_a_class(spark):
    examples = labelled(spark, (None, 400), ("a", 400))
    assert drawn(S.draw_splits(examples, 4, (1,), cut_from=0)) == expected(examples, 1, 8)


def test_a_cut_that_kept_too_few_is_given_up(spark, monkeypatch):
    examples = labelled(spark, ("a", 5000))
    keys = S._cut_keys(examples, (1,), 10, 0)
    assert 10 <= keys.count() < 400
    # Keys that are not uniform leave nothing below the cut.
    monkeypatch.setattr(S, "order_key", lambda seed, task, guid: F.concat(F.lit("f"), F.md5(guid)))
    assert S._cut_keys(examples, (1,), 10, 0) is None
    assert S.draw_splits(examples, 5, (1,), cut_from=0).count() == 10


def test_partitioning_does_not_matter(spark):
    examples = labelled(spark, ("a", 200), ("b", 50))
    assert drawn(S.draw_splits(examples.repartition(7), seeds=(5,))) == drawn(
        S.draw_splits(examples.coalesce(1), seeds=(5,)))


def test_more_dev(spark):
    got = S.draw_splits(labelled(spark, ("a", 300)), 16, (1,), "k-shot-10x")
    assert {r["split"]: r["n"] for r in got.groupBy("split").agg(F.count("*").alias("n")).collect()} == {
        "train": 16, "dev": 160}


@pytest.mark.parametrize("fmt, dev", [("tsv", 150), ("csv", 350)])
def test_full_set(spark, fmt, dev):
    got = S.draw_full_set(labelled(spark, ("a", 300), ("b", 50)), fmt)
    assert {r["split"]: r["n"] for r in got.groupBy("split").agg(F.count("*").alias("n")).collect()} == {
        "train": 350, "dev": dev}
    assert S.leaked(got).count() == dev and {r["seed"] for r in got.collect()} == {0}


@pytest.mark.parametrize("limit", [5, 1500])
def test_large_limits_rank_alike(spark, limit):
    rows = spark.range(6000).select("id", (F.col("id") % 3 == 0).alias("g"), F.xxhash64("id").alias("k"))
    got = top_per_group(rows, ["g"], [F.col("k")], limit, "n", ["id"], buckets=16)
    want = {}
    for r in rows.collect():
        want.setdefault(r["g"], []).append((r["k"], r["id"]))
    assert {(r["g"], r["n"], r["id"]) for r in got.collect()} == {
        (g, i + 1, x) for g, ks in want.items() for i, (_, x) in enumerate(sorted(ks)[:limit])}


@pytest.mark.parametrize("window_rows", [0, 10**6])
def test_running_totals(spark, window_rows):
    # Two thirds of the rows are in one group.
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(
        F.lit("g"), F.col("id") % 7)).alias("g"), (F.col("id") % 11).alias("w"))
    got = {r["id"]: r["s"] for r in running_total(rows, ["g"], [F.col("id")], F.col("w"), "s", window_rows).collect()}
    sums, want = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r["id"]):
        sums[r["g"]] = want[r["id"]] = sums.get(r["g"], 0) + r["w"]
    assert got == want


@pytest.mark.parametrize("window_rows", [0, 10**6])
def test_row_numbers(spark, window_rows):
    rows = spark.range(1000).select(F.xxhash64("id").alias("x"))
    got = row_numbers(rows, [F.col("x").desc()], "n", window_rows=window_rows).collect()
    assert [r["x"] for r in sorted(got, key=lambda r: r["n"])] == sorted((r["x"] for r in rows.collect()), reverse=True)
    assert sorted(r["n"] for r in got) == list(range(1, 1001))


def test_test_split(spark):
    rows = spark.createDataFrame([("train",), ("dev_matched",), ("dev",), ("test",)], "split string")
    assert sorted(r["split"] for r in S.relabel_test(rows).collect()) == ["test", "test", "test_matched"]
    assert [r["split"] for r in S.relabel_test(rows, "csv").collect()] == ["test"]


def test_distribution(spark):
    from shotgrove.operators.labels import label_distribution

    got = label_distribution(labelled(spark, ("a", 5), ("b", 2)), "guid").orderBy("label").collect()
    assert [(r["label"], r["n"], r["first_key"]) for r in got] == [("a", 5, "a0"), ("b", 2, "b0")]
