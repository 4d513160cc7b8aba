"""Pooling of neighbour vectors by rank, and adding the result to a base vector.

The pooling weights depend on rank and dimension only, so every strategy is one weight matrix. Strategies
therefore share one pass over the neighbours, and a mixture of strategies is a mixture of matrices.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotgrove.operators.neighbors import batch_queries
from shotgrove.operators.scoring import log_softmax_lists, score_lists
from shotgrove.operators.topk import small_table
from shotgrove.session import materialize
from shotgrove.tasks import QUERY_BATCH

# Strategy names, clamp of the order parameters, temperature.
STRATEGIES = ("add_cls", "mask_add_cls", "ordered_mask_add_cls",
              "residual_add_cls", "mask_residual_add_cls", "ordered_mask_residual_add_cls")
IDENTITY = "identity"
CLAMP = 5.0
TAU = 5.0

MAX_PARAMETERS = 4_000_000


@dataclass(frozen=True)
class FusionParameters:
    """Given parameters: `mask` by rank, `ordered` by rank and dimension, `projection` from in to out."""

    mask: np.ndarray | None = None
    ordered: np.ndarray | None = None
    projection: np.ndarray | None = None


@dataclass(frozen=True)
class LinearMap:
    """weight x + bias; `weight` from in to out."""

    weight: np.ndarray
    bias: np.ndarray | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.weight.T
        return y if self.bias is None else y + self.bias


def _mixed_map(shares: dict[str, float], maps: dict[str, LinearMap]) -> LinearMap:
    """A sum of linear maps is one linear map."""
    weight = sum(share * maps[name].weight for name, share in shares.items())
    biases = [share * maps[name].bias for name, share in shares.items() if maps[name].bias is not None]
    return LinearMap(weight, sum(biases) if biases else None)


def _parameter_rows(table: DataFrame, order: list[str]) -> pa.Table:
    rows = small_table(table, MAX_PARAMETERS)
    if rows is None:
        raise ValueError(f"more than {MAX_PARAMETERS} parameters")
    return rows.sort_by([(c, "ascending") for c in order])


def softmax_mask(mask: DataFrame) -> DataFrame:
    """(rank, weight) from `mask (rank, m)`; k rows."""
    everything = Window.partitionBy()
    e = F.exp(F.col("m") - F.max("m").over(everything))
    return mask.select("rank", (e / F.sum(e).over(everything)).alias("weight"))


def ordered_mask(beta: DataFrame) -> DataFrame:
    """(rank, dim, mask) from `beta (rank, dim, beta)`, without the training noise.

    c is the sigmoid of the clamped parameter and q the running product of c times (1 - c). A softmax of
    q over the dimensions is summed over the ranks up to k - 1 - rank, so the mask falls with the rank.
    The table has rank x dim rows.
    """
    c = 1 / (1 + F.exp(-F.greatest(F.least(F.col("beta"), F.lit(CLAMP)), F.lit(-CLAMP))))
    by_rank = Window.partitionBy("dim").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from_last = Window.partitionBy("dim").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.exp("q") / F.sum(F.exp("q")).over(Window.partitionBy("rank"))
    highest = F.max("rank").over(Window.partitionBy("dim"))
    lowest = F.min("rank").over(Window.partitionBy("dim"))
    return (beta.withColumn("c", c)
            .withColumn("q", F.exp(F.sum(F.ln("c")).over(by_rank)) * (1 - F.col("c")) / TAU)
            .withColumn("s", share)
            .select((highest + lowest - F.col("rank")).alias("rank"), "dim",
                    F.sum("s").over(from_last).alias("mask")))


def parameters(mask: DataFrame | None = None, beta: DataFrame | None = None,
               projection: DataFrame | None = None) -> FusionParameters:
    """Parameters from tables `(rank, m)`, `(rank, dim, beta)` and `(dim_out, dim_in, w)`."""
    weight = ordered = matrix = None
    if mask is not None:
        weight = _parameter_rows(softmax_mask(mask), ["rank"])["weight"].to_numpy()
    if beta is not None:
        rows = _parameter_rows(ordered_mask(beta), ["rank", "dim"])
        ordered = rows["mask"].to_numpy().reshape(len(np.unique(rows["rank"].to_numpy())), -1)
    if projection is not None:
        rows = _parameter_rows(projection, ["dim_out", "dim_in"])
        matrix = rows["w"].to_numpy().reshape(len(np.unique(rows["dim_out"].to_numpy())), -1)
    return FusionParameters(weight, ordered, matrix)


def fold_pairs(neighbors: DataFrame) -> DataFrame:
    """(guid, rank, emb): neighbours of both sentences of a pair averaged rank by rank."""
    both = neighbors.groupBy("guid", "rank").agg(
        F.collect_list(F.col("emb").cast("array<double>")).alias("_e"))  # one or two vectors
    total = F.when(F.size("_e") == 1, F.col("_e")[0]).otherwise(
        F.zip_with(F.get("_e", F.lit(0)), F.get("_e", F.lit(1)), lambda a, b: (a + b) / 2))
    return both.select("guid", "rank", total.alias("emb"))


def _weights(strategy: str, p: FusionParameters) -> np.ndarray | None:
    """Weight by rank (and dimension) of a strategy; None where all ranks weigh the same."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown fusion strategy {strategy!r}")
    if strategy.startswith("ordered_mask"):
        return p.ordered
    return p.mask[:, None] if strategy.startswith("mask") else None


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rows.ravel()))


def _dense(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _pool(ranks: pa.Array, flat: pa.Array, dim: int, weights: np.ndarray | None) -> np.ndarray:
    """Mean over each row's neighbours of weight x vector; zero where a row has none."""
    counts = ranks.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(counts), dim))
    if counts.sum() == 0:
        return out
    vectors = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    if weights is not None:
        vectors = vectors * weights[ranks.flatten().to_numpy(zero_copy_only=False) - 1]
    present = counts > 0
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])[present]
    out[present] = np.add.reduceat(vectors, starts, axis=0) / counts[present][:, None]
    return out


# Rows whose neighbours' vectors are held in double precision at once.
_ROWS = 512


def _in_parts(rows: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """A function of vectors row by row, applied to a batch some rows at a time, so that what it holds stays small."""
    def apply(*columns: pa.Array) -> pa.Array:
        n = len(columns[0])
        step = max(n, 1) if columns[0].null_count else _ROWS  # a NULL vector fails as it does in the whole batch
        return pa.concat_arrays([rows(*(c.slice(s, step) for c in columns)) for s in range(0, max(n, 1), step)])

    return apply


def _run_once(rows: Callable[..., pa.Array]) -> Callable[..., Column]:
    """A vector function that the optimizer does not copy into filters, where it would run again."""
    return F.arrow_udf(_in_parts(rows), "array<double>").asNondeterministic()


def _fused(strategy: str, p: FusionParameters, linear: np.ndarray | LinearMap | None) -> Column:
    """Column of fused vectors. A name that ends in `_x` fuses before the linear map."""
    linear = LinearMap(linear) if isinstance(linear, np.ndarray) else linear
    before = strategy.endswith("_x")
    name = strategy.removesuffix("_x")
    weights = _weights(name, p)
    projection = p.projection if "residual" in name else None

    def fuse_rows(base: pa.Array, ranks: pa.Array, flat: pa.Array) -> pa.Array:
        x = _dense(base)
        pooled = _pool(ranks, flat, x.shape[1], weights)
        if projection is not None:
            pooled = pooled @ projection.T
        if linear is None:
            return _lists(x + pooled)
        return _lists(linear(x + pooled) if before else linear(x) + pooled)

    return _run_once(fuse_rows)("_base", "_ranks", "_flat")


def gather(base: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Base rows with the ranks and vectors of their neighbours side by side, k per row."""
    grouped = neighbors.groupBy("guid").agg(F.array_sort(F.collect_list(F.struct("rank", "emb"))).alias("_n"))
    empty = F.array().cast(neighbors.schema["emb"].dataType)
    return base.withColumnRenamed("emb", "_base").join(grouped, "guid", "left").select(
        *[c for c in base.columns if c != "emb"], "_base",
        F.coalesce(F.col("_n.rank"), F.array().cast("array<int>")).alias("_ranks"),
        F.coalesce(F.flatten("_n.emb"), empty).alias("_flat"))


def fuse(base: DataFrame, neighbors: DataFrame, strategy: str, p: FusionParameters = FusionParameters(),
         linear: np.ndarray | LinearMap | None = None) -> DataFrame:
    """`base (guid, emb, ...)` with `emb` fused with the vectors of `neighbors (guid, rank, emb)`."""
    gathered = gather(base, neighbors)
    kept = [c for c in base.columns if c != "emb"]
    return gathered.select(*kept, _fused(strategy, p, linear).alias("emb"))


def mixture_weights(architecture: dict[str, float]) -> dict[str, float]:
    """Softmax of the strategy weights."""
    e = np.exp(np.array(list(architecture.values())) - max(architecture.values()))
    return dict(zip(architecture, (e / e.sum()).tolist()))


def fuse_mixture(base: DataFrame, neighbors: DataFrame, architecture: dict[str, float],
                 p: FusionParameters = FusionParameters(), maps: dict[str, LinearMap] | None = None) -> DataFrame:
    """Weighted sum of all candidates. An unknown candidate adds nothing, "identity" adds the base.

    `maps` has a linear map for each candidate, which takes the base before the neighbours are added.
    """
    shares = mixture_weights(architecture)
    known = {n: s for n, s in shares.items() if n in STRATEGIES}
    mapped = {n: s for n, s in shares.items() if n == IDENTITY or n in STRATEGIES}
    kept_share = sum(mapped.values())
    one_map = _mixed_map(mapped, maps) if maps and mapped else None
    width = len(next(iter(maps.values())).weight) if maps else None

    def mix(vectors: pa.Array, ranks: pa.Array, flat: pa.Array) -> pa.Array:
        x = _dense(vectors)
        if one_map is not None:
            out = one_map(x)
        else:
            out = x * kept_share if width is None else np.zeros((len(x), width))
        for projected in (False, True):
            total = None
            for name, share in known.items():
                if ("residual" in name) == projected:
                    w = _weights(name, p)
                    part = share * (np.ones((1, 1)) if w is None else w)
                    total = part if total is None else total + part
            if total is not None:
                # One row of weights for all ranks stands for plain means.
                pooled = (_pool(ranks, flat, x.shape[1], None) * total if len(total) == 1
                          else _pool(ranks, flat, x.shape[1], total))
                out = out + (pooled @ p.projection.T if projected else pooled)
        return _lists(out)

    kept = [c for c in base.columns if c != "emb"]
    return gather(base, neighbors).select(*kept, _run_once(mix)("_base", "_ranks", "_flat").alias("emb"))


def fuse_select(base: DataFrame, neighbors: DataFrame, architecture: dict[str, float],
                p: FusionParameters = FusionParameters(), maps: dict[str, LinearMap] | None = None) -> DataFrame:
    """Only the candidate with the largest weight (the first on ties), with its own map; zeros if it is unknown."""
    chosen = max(architecture, key=architecture.get)
    linear = maps.get(chosen) if maps else None
    if chosen == IDENTITY:
        if linear is not None:
            return base.withColumn("emb", _run_once(lambda emb: _lists(linear(_dense(emb))))("emb"))
        return base.withColumn("emb", F.col("emb").cast("array<double>"))
    if chosen not in STRATEGIES:
        if maps:
            width = len(next(iter(maps.values())).weight)
            return base.withColumn("emb", F.array_repeat(F.lit(0.0), width))
        return base.withColumn("emb", F.transform("emb", lambda _: F.lit(0.0)))
    return fuse(base, neighbors, chosen, p, linear)


def fuse_each(base: DataFrame, neighbors: DataFrame, candidates: list[str],
              p: FusionParameters = FusionParameters()) -> DataFrame:
    """One row per candidate and base row, from one pass over the neighbours."""
    gathered = gather(base, neighbors)
    kept = [c for c in base.columns if c != "emb"]
    options = [F.struct(F.lit(n).alias("candidate"), (
        F.col("_base").cast("array<double>") if n == IDENTITY else _fused(n, p, None)).alias("emb"))
        for n in candidates]
    return gathered.select(*kept, F.explode(F.array(*options)).alias("_o")).select(*kept, "_o.candidate", "_o.emb")


def search_strategy(base: DataFrame, neighbors: DataFrame, candidates: list[str], centroids: DataFrame,
                    p: FusionParameters = FusionParameters()) -> DataFrame:
    """(candidate, n, loss, chosen): cross entropy of each strategy on labelled rows `(guid, gold, emb)`.

    All candidates share one pass; the one with the least loss is chosen, by name on ties.
    """
    fused = fuse_each(base, neighbors, candidates, p)
    logp = log_softmax_lists(score_lists(fused, centroids)).select("candidate", "gold", F.inline("scores"))
    losses = logp.where(F.col("label_id") == F.col("gold")).groupBy("candidate").agg(
        F.count(F.lit(1)).alias("n"), F.avg(-F.col("logp")).alias("loss"))
    # One row per candidate.
    first = F.row_number().over(Window.partitionBy().orderBy("loss", "candidate")) == 1
    return losses.withColumn("chosen", first.cast("int"))


def _own_losses(centers: dict[str, np.ndarray], classes: list[int]) -> Callable[..., Column]:
    """-log p of the right class, each row against its own candidate's class vectors; NULL for a class without any."""
    place = {c: i for i, c in enumerate(classes)}

    @F.arrow_udf("double")
    def loss(candidate: pa.Array, gold: pa.Array, emb: pa.Array) -> pa.Array:
        names = np.array(candidate.to_pylist(), dtype=object)
        right = np.array([place.get(g, -1) for g in gold.to_pylist()], dtype=np.int64)
        vectors = _dense(emb) if len(emb) else np.zeros((0, 1))
        out = np.full(len(names), np.nan)
        for name in set(names):
            rows = np.flatnonzero((names == name) & (right >= 0))
            z = vectors[rows] @ centers[name].T
            z -= z.max(axis=1, keepdims=True, initial=-np.inf)
            out[rows] = np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(rows)), right[rows]]
        return pa.array(out, mask=np.isnan(out))

    return loss


def search_on_dev(base: DataFrame, neighbors: DataFrame, candidates: list[str], splits: DataFrame,
                  p: FusionParameters = FusionParameters(), rate: float = 1.0, batch: int = QUERY_BATCH) -> DataFrame:
    """(candidate, n_train, train_loss, n_dev, dev_loss, share, chosen): strategies weighed by dev batches.

    `base (guid, gold, emb)` has the vectors, `splits (guid, split)` the train and dev draws of one seed; guids are
    unique. Below, the fused train draws of each strategy give its own class means. Above, shares start equal, and every
    dev batch multiplies them by exp(-rate x mean loss of the batch); in the end the largest share is chosen, by name on
    ties. Dev rows of a class without train draws have no loss and do not count. Reads the drawn rows only.
    """
    drawn = materialize(base.join(splits.select("guid", "split"), "guid"), "drawn")
    near = neighbors.join(drawn.select("guid"), "guid", "left_semi")
    fused = materialize(fuse_each(drawn, near, candidates, p), "fused")
    means = (fused.where(F.col("split") == "train").select("candidate", "gold", F.posexplode("emb").alias("dim", "x"))
             .groupBy("candidate", "gold", "dim").agg(F.avg("x").alias("x")))
    rows = _parameter_rows(means, ["candidate", "gold", "dim"]).to_pandas()  # candidates x classes x dimensions
    classes = sorted(rows["gold"].unique().tolist())
    centers = {name: part["x"].to_numpy().reshape(len(classes), -1) for name, part in rows.groupby("candidate")}
    if not centers:
        return base.sparkSession.createDataFrame([], _SEARCHED)
    judged = fused.select("candidate", "guid", "split", _own_losses(centers, classes)("candidate", "gold", "emb").alias("loss"))
    judged = materialize(judged, "losses").where(F.col("loss").isNotNull())
    dev = judged.where((F.col("split") == "dev") & (F.col("candidate") == candidates[0])).select("guid")
    steps = judged.join(batch_queries(dev, "guid", batch).select("guid", "batch_id"), "guid").groupBy(
        "candidate", "batch_id").agg(F.avg("loss").alias("loss"))
    moved = steps.groupBy("candidate").agg((-rate * F.sum("loss")).alias("_log"))

    def of(split: str, value: Column) -> Column:
        return F.when(F.col("split") == split, value)

    totals = judged.groupBy("candidate").agg(
        F.count(of("train", F.col("loss"))).alias("n_train"), F.avg(of("train", F.col("loss"))).alias("train_loss"),
        F.count(of("dev", F.col("loss"))).alias("n_dev"), F.avg(of("dev", F.col("loss"))).alias("dev_loss"))
    # One row per candidate from here on.
    whole = Window.partitionBy()
    weight = F.exp(F.coalesce("_log", F.lit(0.0)) - F.max(F.coalesce("_log", F.lit(0.0))).over(whole))
    shared = totals.join(moved, "candidate", "left").withColumn("_weight", weight).withColumn(
        "share", F.col("_weight") / F.sum("_weight").over(whole))
    first = F.row_number().over(whole.orderBy(F.desc("share"), "candidate")) == 1
    return shared.select("candidate", "n_train", "train_loss", "n_dev", "dev_loss", "share", first.cast("int").alias("chosen"))


_SEARCHED = ("candidate string, n_train long, train_loss double, n_dev long, dev_loss double, share double, chosen int")
