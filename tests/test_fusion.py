import tracemalloc
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shotgrove.operators import fusion as U

K, DIM = 3, 2


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    return rng.normal(size=(4, DIM)), rng.normal(size=(4, K, DIM))


@pytest.fixture(scope="module")
def frames(spark, data):
    base, near = data
    one = spark.createDataFrame([(f"g{i}", [float(x) for x in v]) for i, v in enumerate(base)], "guid string, emb array<double>")
    many = spark.createDataFrame([(f"g{i}", r + 1, [float(x) for x in v]) for i, vs in enumerate(near) for r, v in enumerate(vs)],
                                 "guid string, rank int, emb array<double>")
    return one, many


@pytest.fixture(scope="module")
def parameters(spark):
    mask = spark.createDataFrame([(1, .5), (2, -1.), (3, 2.)], "rank int, m double")
    beta = spark.createDataFrame([(r, d, b) for r, line in enumerate([[9., .1], [-.4, -7.], [.3, 0.]], 1)
                                  for d, b in enumerate(line)], "rank int, dim int, beta double")
    matrix = spark.createDataFrame([(o, i, float(2 * o - i + .5)) for o in range(DIM) for i in range(DIM)],
                                   "dim_out int, dim_in int, w double")
    return U.parameters(mask, beta, matrix)


MASK = np.exp([.5, -1, 2]) / np.exp([.5, -1, 2]).sum()
PROJECTION = np.array([[2 * o - i + .5 for i in range(DIM)] for o in range(DIM)])


def ordered():
    c = 1 / (1 + np.exp(-np.clip(np.array([[9., .1], [-.4, -7.], [.3, 0.]]), -5, 5)))
    e = np.exp(np.cumprod(c, axis=0) * (1 - c) / 5)
    return np.cumsum(e / e.sum(axis=1, keepdims=True), axis=0)[::-1]


def pooled(near, name):
    weights = ordered() if name.startswith("ordered") else MASK[:, None] if name.startswith("mask") else 1
    p = (near * weights).mean(axis=1)
    return p @ PROJECTION.T if "residual" in name else p


def rows(df):
    return np.array([r["emb"] for r in df.orderBy("guid").collect()])


def test_parameters(parameters):
    assert np.allclose(parameters.mask, MASK) and np.allclose(parameters.projection, PROJECTION)
    assert np.allclose(parameters.ordered, ordered())
    assert (np.diff(parameters.ordered, axis=0) <= 0).all()


@pytest.mark.parametrize("name", U.STRATEGIES)
def test_strategies(frames, data, parameters, name):
    base, near = data
    assert np.allclose(rows(U.fuse(*frames, name, parameters)), base + pooled(near, name))


def test_before_or_after_the_linear_map(frames, data, parameters):
    (base, near), w = data, np.array([[1., 2.], [0., -1.]])
    p = pooled(near, "add_cls")
    assert np.allclose(rows(U.fuse(*frames, "add_cls", linear=w)), base @ w.T + p)
    assert np.allclose(rows(U.fuse(*frames, "add_cls_x", linear=w)), (base + p) @ w.T)


def test_unknown_strategy_is_an_error(frames):
    with pytest.raises(ValueError, match="unknown fusion strategy"):
        U.fuse(*frames, "concat")


def test_equal_masks_are_means_divided_by_k(spark, frames, data):
    p = U.parameters(spark.createDataFrame([(r, 1.) for r in (1, 2, 3)], "rank int, m double"))
    base, near = data
    assert np.allclose(rows(U.fuse(*frames, "mask_add_cls", p)), base + near.mean(axis=1) / K)


def test_no_neighbors_keep_the_base(frames, data):
    base, near = frames
    got = rows(U.fuse(base, near.where("guid <> 'g1'"), "add_cls"))
    assert np.allclose(got[1], data[0][1]) and not np.allclose(got[0], data[0][0])


ARCHITECTURE = {"identity": .3, "add_cls": .1, "ordered_mask_add_cls": .9, "residual_add_cls": .2,
                "mask_residual_add_cls": -.5, "odd": 1.5}


def test_mixture(frames, data, parameters):
    base, near = data
    shares = U.mixture_weights(ARCHITECTURE)
    want = sum(s * (base + (0 if n == "identity" else pooled(near, n))) for n, s in shares.items() if n != "odd")
    assert np.allclose(rows(U.fuse_mixture(*frames, ARCHITECTURE, parameters)), want)
    assert np.allclose(rows(U.fuse_mixture(*frames, {"identity": 0.}, parameters)), base)
    assert np.allclose(rows(U.fuse_mixture(*frames, {"odd": 0.}, parameters)), 0)


@pytest.mark.parametrize("architecture, chosen", [
    ({"identity": 1, "add_cls": 0}, "identity"), ({"add_cls": 1, "mask_add_cls": 1}, "add_cls"), ({"odd": 2, "add_cls": 1}, "odd")])
def test_selection(frames, data, parameters, architecture, chosen):
    base, near = data
    want = base if chosen == "identity" else np.zeros_like(base) if chosen == "odd" else base + pooled(near, chosen)
    assert np.allclose(rows(U.fuse_select(*frames, architecture, parameters)), want)


def test_every_candidate_has_its_own_map(frames, data, parameters):
    base, near = data
    rng = np.random.default_rng(8)
    out = DIM  # pooled vectors are added after the map
    maps = {n: U.LinearMap(rng.normal(size=(out, DIM)), rng.normal(size=out) if i % 2 else None)
            for i, n in enumerate(ARCHITECTURE)}

    def one(name):
        return maps[name](base) + (0 if name == "identity" else pooled(near, name))

    shares = U.mixture_weights(ARCHITECTURE)
    want = sum(s * one(n) for n, s in shares.items() if n != "odd")
    assert np.allclose(rows(U.fuse_mixture(*frames, ARCHITECTURE, parameters, maps)), want)
    assert np.allclose(rows(U.fuse_mixture(*frames, {"odd": 0.}, parameters, maps)), 0)
    for name in ("identity", "add_cls", "mask_residual_add_cls"):
        assert np.allclose(rows(U.fuse_select(*frames, {name: 1., "odd": 0.}, parameters, maps)), one(name))
    assert np.allclose(rows(U.fuse_select(*frames, {"odd": 1.}, parameters, maps)), 0)


def test_pairs_are_folded_rank_by_rank(spark):
    near = spark.createDataFrame([("p", 0, 1, [1., 2.]), ("p", 1, 1, [3., 6.]), ("p", 0, 2, [5., 5.]), ("s", 0, 1, [1., 1.])],
                                 "guid string, sent_id int, rank int, emb array<float>")
    got = {(r["guid"], r["rank"]): r["emb"] for r in U.fold_pairs(near).collect()}
    assert got == {("p", 1): [2., 4.], ("p", 2): [5., 5.], ("s", 1): [1., 1.]}


def test_search_takes_the_least_loss(spark, frames, data, parameters):
    base, near = data
    centers = np.array([[1., 0.], [0., 1.], [-1., -1.]])
    gold = [0, 2, 1, 0]
    labelled = frames[0].withColumn("gold", F.element_at(F.array(*[F.lit(g) for g in gold]), F.substring("guid", 2, 1).cast("int") + 1))
    centroids = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cell int, emb array<double>")
    names = ["identity", "add_cls", "ordered_mask_add_cls"]
    got = {r["candidate"]: r for r in U.search_strategy(labelled, frames[1], names, centroids, parameters).collect()}
    losses = {}
    for n in names:
        z = (base + (0 if n == "identity" else pooled(near, n))) @ centers.T
        losses[n] = np.mean([np.log(np.exp(line).sum()) - line[g] for line, g in zip(z, gold)])
        assert got[n]["loss"] == pytest.approx(losses[n]) and got[n]["n"] == 4
    assert [n for n in names if got[n]["chosen"]] == [min(losses, key=losses.get)]


def test_search_on_dev(spark, frames, data, parameters):
    """Means of the fused train rows, losses of both splits, and shares moved batch by batch."""
    base, near = data
    gold, split = [0, 1, 0, 1], ["train", "train", "dev", "dev"]
    guids = [r["guid"] for r in frames[0].orderBy("guid").collect()]
    rows = spark.createDataFrame(list(zip(guids, gold, split)), "guid string, gold int, split string")
    labelled = frames[0].join(rows.drop("split"), "guid")
    names = ["identity", "add_cls", "ordered_mask_add_cls"]
    got = {r["candidate"]: r for r in U.search_on_dev(
        labelled, frames[1], names, rows.select("guid", "split"), parameters, rate=0.7, batch=1).collect()}
    weight = {}
    for n in names:
        x = base + (0 if n == "identity" else pooled(near, n))
        z = x @ x[:2].T  # one train row for each class
        loss = [np.log(np.exp(line).sum()) - line[g] for line, g in zip(z, gold)]
        assert got[n]["train_loss"] == pytest.approx(np.mean(loss[:2])) and got[n]["n_train"] == 2
        assert got[n]["dev_loss"] == pytest.approx(np.mean(loss[2:])) and got[n]["n_dev"] == 2
        share = 1.0
        for step in loss[2:]:
            share *= np.exp(-0.7 * step)
        weight[n] = share
    assert all(got[n]["share"] == pytest.approx(weight[n] / sum(weight.values())) for n in names)
    assert [n for n in names if got[n]["chosen"]] == [max(weight, key=weight.get)]
    other = rows.withColumn("gold", F.when(F.col("split") == "dev", 9).otherwise(F.col("gold")))
    none = U.search_on_dev(frames[0].join(other.drop("split"), "guid"), frames[1], names, other.select("guid", "split"),
                           parameters).collect()
    assert all(r["n_dev"] == 0 and r["dev_loss"] is None and r["share"] == pytest.approx(1 / 3) for r in none)
    assert U.search_on_dev(labelled, frames[1], names, rows.where("guid IS NULL").select("guid", "split")).count() == 0


def test_fusion_holds_few_rows_at_once(monkeypatch):
    """A batch of 10,000 rows with ten neighbours each is widened to double precision some rows at a time."""
    functions = []
    monkeypatch.setattr(U.F, "arrow_udf", lambda rows, kind: functions.append(rows) or mock.MagicMock())
    weights = np.arange(1, 641).reshape(10, 64) / 640
    U._fused("ordered_mask_add_cls", U.FusionParameters(ordered=weights), None)
    n = 10_000
    rng = np.random.default_rng(5)
    base, near = rng.normal(size=(n, 64)).astype(np.float32), rng.normal(size=(n, 640)).astype(np.float32)
    near_lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 640), pa.array(near.ravel()))
    columns = (pa.array(list(base)), pa.array([list(range(1, 11))] * n, pa.list_(pa.int32())), near_lists)
    tracemalloc.start()
    fused = functions[0](*columns)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000
    want = base + (near.reshape(n, 10, 64) * weights).mean(axis=1)
    assert np.allclose(fused.flatten().to_numpy().reshape(n, 64), want)
