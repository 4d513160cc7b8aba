"""Fusion of neighbour vectors, class scores and losses."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shotgrove.functions import text as X
from shotgrove.operators import fusion as U
from shotgrove.operators import knn, neighbors, sampling
from shotgrove.operators import labels as LB
from shotgrove.operators import scoring as C
from shotgrove.plans.catalog_encoding import sql_knn
from shotgrove.plans.catalog_examples import SQL_VOCAB, document_vocab
from shotgrove.plans.catalog_retrieval import SQL_MEANS, label_means, pair_queries
from shotgrove.plans.inputs import SQL_TOKENS, turn_examples, vectors, with_parts
from shotgrove.plans.registry import joined, query, rounded, table
from shotgrove.session import materialize

K = 10


def _base(spark, folder):
    return vectors(spark, folder, "guid")


def _neighbors(spark, folder):
    """The ten nearest vectors of every vector."""
    queries, corpus = vectors(spark, folder, "query_id"), vectors(spark, folder)
    asked = queries.select("query_id", F.col("query_id").alias("guid"), F.lit(0).alias("sent_id"))
    return neighbors.neighbor_rows(asked, knn.knn_exact(queries, corpus, K), corpus).select("guid", "rank", "emb")


# Parameters come from the class means: class c gives rank c + 1.
def _mask(means):
    return means.select((F.col("cell") + 1).alias("rank"), (F.col("emb")[0] * 10).alias("m"))


def _beta(means):
    return means.select((F.col("cell") + 1).alias("rank"), F.posexplode("emb").alias("dim", "x")).select(
        "rank", "dim", (F.col("x") * 10).alias("beta"))


def _projection(means):
    """Sum over the classes of mean[i] x mean[j]; dimension x dimension rows."""
    one = means.select("cell", F.posexplode("emb").alias("dim", "x"))
    other = one.select("cell", F.col("dim").alias("dim_in"), F.col("x").alias("y"))
    return (one.join(other, "cell").groupBy(F.col("dim").alias("dim_out"), "dim_in")
            .agg(F.sum(F.col("x") * F.col("y")).alias("w")))


def _parameters(spark, folder, projection=False):
    means = materialize(label_means(spark, folder), "means")
    return U.parameters(_mask(means), _beta(means), _projection(means) if projection else None)


def _values(fused, *keys):
    return fused.select("guid", *keys, F.posexplode("emb").alias("dim", "x")).select(
        "guid", *keys, "dim", rounded("x").alias("value"))


_SQL_NEAR = with_parts("v") + ",\n" + SQL_MEANS + ",\n" + sql_knn(K) + """,
near AS (SELECT k.query_id AS guid, k.rank, p.dim, p.x FROM knn k JOIN parts p ON p.vec_id = k.doc_id),
mask AS (SELECT label + 1 AS rank, exp(10 * x) / SUM(exp(10 * x)) OVER () AS w FROM means WHERE dim = 0),
cut AS (SELECT label + 1 AS rank, dim, 1 / (1 + exp(-greatest(least(10 * x, 5), -5))) AS c FROM means),
running AS (SELECT rank, dim, exp(SUM(ln(c)) OVER (
                PARTITION BY dim ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) * (1 - c) / 5 AS q
            FROM cut),
share AS (SELECT rank, dim, exp(q) / SUM(exp(q)) OVER (PARTITION BY rank) AS s FROM running),
ordered AS (SELECT 11 - rank AS rank, dim, SUM(s) OVER (
                PARTITION BY dim ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w FROM share),
projection AS (SELECT a.dim AS dim_out, b.dim AS dim_in, SUM(a.x * b.x) AS w
               FROM means a JOIN means b ON a.label = b.label GROUP BY a.dim, b.dim),
pool_add_cls AS (SELECT guid, dim, AVG(x) AS x FROM near GROUP BY guid, dim),
pool_mask_add_cls AS (SELECT n.guid, n.dim, AVG(n.x * m.w) AS x FROM near n JOIN mask m ON m.rank = n.rank
                      GROUP BY n.guid, n.dim),
pool_ordered_mask_add_cls AS (
    SELECT n.guid, n.dim, AVG(n.x * o.w) AS x FROM near n JOIN ordered o ON o.rank = n.rank AND o.dim = n.dim
    GROUP BY n.guid, n.dim)""" + "".join(f""",
pool_{to} AS (SELECT n.guid, p.dim_out AS dim, SUM(n.x * p.w) AS x
              FROM pool_{of} n JOIN projection p ON p.dim_in = n.dim GROUP BY n.guid, p.dim_out)"""
    for of, to in (("add_cls", "residual_add_cls"), ("mask_add_cls", "mask_residual_add_cls"),
                   ("ordered_mask_add_cls", "ordered_mask_residual_add_cls")))


def _sql_fused(strategy: str) -> str:
    return _SQL_NEAR + f"""
SELECT b.vec_id AS guid, b.dim::INTEGER AS dim, round(b.x + p.x, 6) + 0.0 AS value
FROM parts b JOIN pool_{strategy} p ON p.guid = b.vec_id AND p.dim = b.dim"""


@query("fold_pair_neighbors", with_parts("v") + ",\n" + SQL_MEANS + ",\n" + sql_knn(K) + """,
    pairs AS (SELECT a.vec_id AS guid, unnest([a.vec_id, b.vec_id]) AS q FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
    SELECT p.guid, k.rank, d.dim::INTEGER AS dim, round(AVG(d.x), 6) + 0.0 AS value
    FROM pairs p JOIN knn k ON k.query_id = p.q JOIN parts d ON d.vec_id = k.doc_id
    GROUP BY p.guid, k.rank, d.dim""")
def fold_pair_neighbors(spark, folder):
    queries, corpus = pair_queries(spark, folder), vectors(spark, folder)
    rows = neighbors.neighbor_rows(queries, knn.knn_exact(queries, corpus, K), corpus)
    return _values(U.fold_pairs(rows), "rank")


def _strategy(name: str, projection: bool = False):
    def build(spark, folder):
        return _values(U.fuse(_base(spark, folder), _neighbors(spark, folder), name,
                              _parameters(spark, folder, projection)))
    return build


for _key, _name in (("fuse_add", "add_cls"), ("fuse_mask_add", "mask_add_cls"),
                    ("fuse_ordered_mask_add", "ordered_mask_add_cls")):
    query(_key, _sql_fused(_name))(_strategy(_name))
for _key, _name in (("fuse_residual_add", "residual_add_cls"), ("fuse_residual_mask_add", "mask_residual_add_cls"),
                    ("fuse_residual_ordered_mask_add", "ordered_mask_residual_add_cls")):
    query(_key, _sql_fused(_name))(_strategy(_name, True))


@query("ordered_mask", _SQL_NEAR + "\nSELECT rank::INTEGER AS rank, dim::INTEGER AS dim, round(w, 6) AS mask FROM ordered")
def ordered_mask(spark, folder):
    return U.ordered_mask(_beta(label_means(spark, folder))).select("rank", "dim", rounded("mask").alias("mask"))


@query("fuse_dispatch", _SQL_NEAR + """,
    before AS (SELECT b.vec_id, b.dim, b.x + p.x AS x FROM parts b JOIN pool_add_cls p ON p.guid = b.vec_id AND p.dim = b.dim),
    mapped AS (SELECT b.vec_id AS guid, p.dim_out AS dim, SUM(b.x * p.w) AS x
               FROM before b JOIN projection p ON p.dim_in = b.dim GROUP BY ALL),
    linear AS (SELECT b.vec_id AS guid, p.dim_out AS dim, SUM(b.x * p.w) AS x
               FROM parts b JOIN projection p ON p.dim_in = b.dim GROUP BY ALL)
    SELECT 'add_cls_x' AS strategy, guid, dim::INTEGER AS dim, round(x, 6) + 0.0 AS value FROM mapped
    UNION ALL
    SELECT 'add_cls' AS strategy, l.guid, l.dim::INTEGER AS dim, round(l.x + p.x, 6) + 0.0 AS value
    FROM linear l JOIN pool_add_cls p ON p.guid = l.guid AND p.dim = l.dim""")
def fuse_dispatch(spark, folder):
    """The same strategy after the linear map, and before it."""
    p = _parameters(spark, folder, True)
    found = [_values(U.fuse(_base(spark, folder), _neighbors(spark, folder), name, p, linear=p.projection))
             .withColumn("strategy", F.lit(name)) for name in ("add_cls", "add_cls_x")]
    return found[0].unionByName(found[1]).select("strategy", "guid", "dim", "value")


_ARCHITECTURE = {"identity": 0.1, "mask_add_cls": 0.4, "ordered_mask_add_cls": 0.7, "residual_add_cls": 0.2, "other": 0.3}


@query("fuse_mixture", _SQL_NEAR + """,
    arch(name, a) AS (VALUES ('identity', 0.1), ('mask_add_cls', 0.4), ('ordered_mask_add_cls', 0.7),
                             ('residual_add_cls', 0.2), ('other', 0.3)),
    shares AS (SELECT name, exp(a::DOUBLE) / SUM(exp(a::DOUBLE)) OVER () AS s FROM arch),
    candidates AS (
        SELECT 'identity' AS name, vec_id AS guid, dim, x FROM parts
        UNION ALL SELECT 'mask_add_cls', b.vec_id, b.dim, b.x + p.x
        FROM parts b JOIN pool_mask_add_cls p ON p.guid = b.vec_id AND p.dim = b.dim
        UNION ALL SELECT 'ordered_mask_add_cls', b.vec_id, b.dim, b.x + p.x
        FROM parts b JOIN pool_ordered_mask_add_cls p ON p.guid = b.vec_id AND p.dim = b.dim
        UNION ALL SELECT 'residual_add_cls', b.vec_id, b.dim, b.x + p.x
        FROM parts b JOIN pool_residual_add_cls p ON p.guid = b.vec_id AND p.dim = b.dim)
    SELECT c.guid, c.dim::INTEGER AS dim, round(SUM(c.x * s.s), 6) + 0.0 AS value
    FROM candidates c JOIN shares s ON s.name = c.name GROUP BY c.guid, c.dim""")
def fuse_mixture(spark, folder):
    return _values(U.fuse_mixture(_base(spark, folder), _neighbors(spark, folder), _ARCHITECTURE,
                                  _parameters(spark, folder, True)))


@query("fuse_select", _sql_fused("ordered_mask_add_cls"))
def fuse_select(spark, folder):
    return _values(U.fuse_select(_base(spark, folder), _neighbors(spark, folder), _ARCHITECTURE,
                                 _parameters(spark, folder)))


# Scale of the projection and offset in each candidate's linear map.
_SCALES = {"identity": (1.0, None), "mask_add_cls": (0.5, 0.25), "ordered_mask_add_cls": (2.0, None),
           "residual_add_cls": (-1.0, -0.5)}
_SQL_MAPPED = _SQL_NEAR + """,
    scales(name, scale, bias) AS (VALUES ('identity', 1.0, 0.0), ('mask_add_cls', 0.5, 0.25),
                                         ('ordered_mask_add_cls', 2.0, 0.0), ('residual_add_cls', -1.0, -0.5)),
    linear AS (SELECT s.name, b.vec_id AS guid, p.dim_out AS dim, SUM(b.x * p.w) * s.scale + s.bias AS x
               FROM parts b JOIN projection p ON p.dim_in = b.dim CROSS JOIN scales s
               GROUP BY s.name, s.scale, s.bias, b.vec_id, p.dim_out),
    pools AS (SELECT 'mask_add_cls' AS name, * FROM pool_mask_add_cls
              UNION ALL SELECT 'ordered_mask_add_cls', * FROM pool_ordered_mask_add_cls
              UNION ALL SELECT 'residual_add_cls', * FROM pool_residual_add_cls)"""


def _maps(p):
    return {name: U.LinearMap(p.projection * scale, None if bias is None else np.full(len(p.projection), bias))
            for name, (scale, bias) in _SCALES.items()}


@query("fuse_mixture_mapped", _SQL_MAPPED + """,
    arch(name, a) AS (VALUES ('identity', 0.1), ('mask_add_cls', 0.4), ('ordered_mask_add_cls', 0.7),
                             ('residual_add_cls', 0.2), ('other', 0.3)),
    shares AS (SELECT name, exp(a::DOUBLE) / SUM(exp(a::DOUBLE)) OVER () AS s FROM arch)
    SELECT l.guid, l.dim::INTEGER AS dim, round(SUM(s.s * (l.x + coalesce(p.x, 0))), 6) + 0.0 AS value
    FROM linear l JOIN shares s ON s.name = l.name LEFT JOIN pools p ON p.name = l.name AND p.guid = l.guid AND p.dim = l.dim
    GROUP BY l.guid, l.dim""")
def fuse_mixture_mapped(spark, folder):
    """Every candidate with a linear map of its own."""
    p = _parameters(spark, folder, True)
    return _values(U.fuse_mixture(_base(spark, folder), _neighbors(spark, folder), _ARCHITECTURE, p, _maps(p)))


@query("fuse_select_mapped", _SQL_MAPPED + """
    SELECT l.guid, l.dim::INTEGER AS dim, round(l.x + p.x, 6) + 0.0 AS value
    FROM linear l JOIN pools p ON p.name = l.name AND p.guid = l.guid AND p.dim = l.dim
    WHERE l.name = 'ordered_mask_add_cls'""")
def fuse_select_mapped(spark, folder):
    p = _parameters(spark, folder, True)
    return _values(U.fuse_select(_base(spark, folder), _neighbors(spark, folder), _ARCHITECTURE, p, _maps(p)))


_CANDIDATES = ["identity", "mask_add_cls", "ordered_mask_add_cls"]


@query("search_fusion", _SQL_NEAR + """,
    fused AS (
        SELECT 'identity' AS candidate, vec_id AS guid, dim, x FROM parts
        UNION ALL SELECT 'mask_add_cls', b.vec_id, b.dim, b.x + p.x
        FROM parts b JOIN pool_mask_add_cls p ON p.guid = b.vec_id AND p.dim = b.dim
        UNION ALL SELECT 'ordered_mask_add_cls', b.vec_id, b.dim, b.x + p.x
        FROM parts b JOIN pool_ordered_mask_add_cls p ON p.guid = b.vec_id AND p.dim = b.dim),
    draws AS (SELECT vec_id AS guid, label AS gold, row_number() OVER (
        PARTITION BY label ORDER BY md5('13:vectors:' || vec_id), vec_id) AS draw FROM v),
    drawn AS (SELECT guid, gold, CASE WHEN draw <= 16 THEN 'train' ELSE 'dev' END AS split FROM draws WHERE draw <= 32),
    own AS (SELECT f.candidate, d.gold AS label, f.dim, AVG(f.x) AS x
            FROM fused f JOIN drawn d ON d.guid = f.guid AND d.split = 'train' GROUP BY f.candidate, d.gold, f.dim),
    logits AS (SELECT f.candidate, f.guid, m.label, SUM(f.x * m.x) AS z FROM fused f JOIN drawn d ON d.guid = f.guid
               JOIN own m ON m.candidate = f.candidate AND m.dim = f.dim GROUP BY f.candidate, f.guid, m.label),
    logp AS (SELECT *, z - ln(SUM(exp(z)) OVER (PARTITION BY candidate, guid)) AS lp FROM logits),
    judged AS (SELECT l.candidate, d.split, l.guid, -l.lp AS loss
               FROM logp l JOIN drawn d ON d.guid = l.guid AND d.gold = l.label),
    batches AS (SELECT guid, floor((row_number() OVER (ORDER BY guid) - 1) / 32) AS batch FROM drawn WHERE split = 'dev'),
    steps AS (SELECT j.candidate, b.batch, AVG(j.loss) AS loss FROM judged j JOIN batches b ON b.guid = j.guid
              GROUP BY j.candidate, b.batch),
    moved AS (SELECT candidate, exp(-SUM(loss)) AS weight FROM steps GROUP BY candidate),
    totals AS (SELECT candidate, COUNT(*) FILTER (split = 'train') AS n_train, AVG(loss) FILTER (split = 'train') AS train_loss,
                      COUNT(*) FILTER (split = 'dev') AS n_dev, AVG(loss) FILTER (split = 'dev') AS dev_loss
               FROM judged GROUP BY candidate)
    SELECT t.candidate, t.n_train, round(t.train_loss, 6) AS train_loss, t.n_dev, round(t.dev_loss, 6) AS dev_loss,
           round(m.weight / SUM(m.weight) OVER (), 6) AS share,
           (row_number() OVER (ORDER BY m.weight DESC, t.candidate) = 1)::INTEGER AS chosen
    FROM totals t JOIN moved m ON m.candidate = t.candidate""")
def search_fusion(spark, folder):
    """Class means from fused train draws, shares of the strategies from batches of dev draws."""
    base = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("guid"), F.col("label").alias("gold"), F.col("embedding").alias("emb"))
    splits = sampling.draw_splits(base.select(F.lit("vectors").alias("task"), "guid", F.col("gold").cast("string").alias(
        "label")), 16, (13,))
    losses = U.search_on_dev(base, _neighbors(spark, folder), _CANDIDATES, splits, _parameters(spark, folder))
    return losses.select("candidate", "n_train", rounded("train_loss").alias("train_loss"), "n_dev",
                         rounded("dev_loss").alias("dev_loss"), rounded("share").alias("share"), "chosen")


def vector_scores(spark, folder):
    """Inner products of every vector with the class means, as lists."""
    return C.score_lists(_base(spark, folder), label_means(spark, folder))


def _log_softmax(spark, folder):
    return C.log_softmax_lists(vector_scores(spark, folder)).select("guid", F.inline("scores"))


SQL_SCORES = SQL_MEANS + """,
scores AS (SELECT v.vec_id AS guid, c.cell AS label_id, list_inner_product(v.e, c.e) AS logit
           FROM v CROSS JOIN centers c),
logp AS (SELECT *, logit - ln(SUM(exp(logit)) OVER (PARTITION BY guid)) AS logp FROM scores)"""


@query("class_scores", with_parts("v") + ",\n" + SQL_SCORES + """
    SELECT guid, label_id, round(logit, 6) + 0.0 AS logit FROM scores""")
def class_scores(spark, folder):
    scores = C.class_scores(_base(spark, folder), label_means(spark, folder))
    return scores.select("guid", "label_id", rounded("logit").alias("logit"))


@query("label_word_scores", f"""
    WITH {SQL_VOCAB}, words(label_id, word) AS (VALUES (0, 'the'), (1, 'la'), (2, 'und'), (3, 'el')),
    coded AS (SELECT w.label_id, v.token_id, v.token FROM words w JOIN vocab v ON v.token = w.word),
    pieces AS (SELECT doc_id, unnest({SQL_TOKENS.format('text')}) AS token FROM documents)
    SELECT p.doc_id AS guid, c.label_id::INTEGER AS label_id, COUNT(*)::DOUBLE AS logit
    FROM pieces p JOIN coded c ON c.token = p.token GROUP BY ALL""")
def label_word_scores(spark, folder):
    """Word counts of a document stand for its scores over the vocabulary."""
    words = spark.createDataFrame([("language", str(i), w) for i, w in enumerate(("the", "la", "und", "el"))],
                                  "task string, label string, word string")
    known = LB.verbalize(words, document_vocab(spark, folder))
    verbalizer = known.select("word", "word_id", F.col("label").cast("int").alias("label_id"))
    documents = table(spark, folder, "documents").withColumnRenamed("doc_id", "guid")
    counted = (X.explode_once(documents, ["guid"], X.tokens(F.col("text")), "word")
               .groupBy("guid", "word").agg(F.count(F.lit(1)).cast("double").alias("score")))
    scored = counted.join(F.broadcast(verbalizer.select("word", "word_id")), "word")
    return C.label_word_scores(scored, verbalizer)


@query("log_softmax", with_parts("v") + ",\n" + SQL_SCORES + """
    SELECT guid, label_id, round(logp, 6) AS logp FROM logp""")
def log_softmax(spark, folder):
    return _log_softmax(spark, folder).select("guid", "label_id", rounded("logp").alias("logp"))


@query("argmax_predict", with_parts("v") + ",\n" + SQL_SCORES + """
    SELECT guid, label_id AS pred FROM (
        SELECT *, row_number() OVER (PARTITION BY guid ORDER BY logit DESC, label_id) AS n FROM scores) WHERE n = 1""")
def argmax_predict(spark, folder):
    return C.argmax_lists(vector_scores(spark, folder))


@query("cross_entropy", with_parts("v") + ",\n" + SQL_SCORES + """
    SELECT COUNT(*) AS n, round(AVG(-logp), 6) AS loss FROM logp JOIN v ON v.vec_id = logp.guid AND v.label = logp.label_id""")
def cross_entropy(spark, folder):
    gold = table(spark, folder, "embeddings").select(F.col("vec_id").alias("guid"), F.col("label").alias("label_id"))
    return C.cross_entropy(_log_softmax(spark, folder), gold).select("n", rounded("loss").alias("loss"))


@query("kl_regression", """
    WITH p AS (SELECT CAST(p_size AS DOUBLE) / 50 AS hi, 1 - CAST(p_size AS DOUBLE) / 50 AS lo,
                      p_retailprice / 4000 AS q FROM part)
    SELECT COUNT(*) AS n, round(AVG((CASE WHEN hi > 0 THEN hi * (ln(hi) - ln(q)) ELSE 0 END
                                   + CASE WHEN lo > 0 THEN lo * (ln(lo) - ln(1 - q)) ELSE 0 END) / 2), 6) AS loss FROM p""")
def kl_regression(spark, folder):
    q = F.col("p_retailprice") / 4000
    rows = table(spark, folder, "part").select(
        (F.col("p_size").cast("double") / 10).alias("y"), F.ln(1 - q).alias("logp_low"), F.ln(q).alias("logp_high"))
    return C.kl_regression(rows).select("n", rounded("loss").alias("loss"))


@query("train_classifier")
def train_classifier(spark, folder):
    """Predictions of a linear classifier trained on K vectors per class."""
    rows = table(spark, folder, "embeddings").select(
        F.lit("topic").alias("task"), F.col("vec_id").cast("string").alias("guid"),
        F.col("label").cast("string").alias("label"), F.col("embedding").alias("emb"))
    drawn = sampling.draw_splits(rows, seeds=(13,)).where(F.col("split") == "train").select("guid", "label")
    train = drawn.join(rows.select("guid", "emb"), "guid").withColumn("label_id", F.col("label").cast("int"))
    model = C.train_classifier(train)
    rest = rows.join(drawn, "guid", "left_anti").select("guid", F.col("label").cast("int").alias("gold"), "emb")
    scores = C.classifier_scores(rest, model)
    return C.argmax_predict(scores, ["guid", "gold"])


@query("classifier_grid")
def classifier_grid(spark, folder):
    """Predictions of classifiers of all seeds, on the vectors alone and fused with their neighbours', fitted in one job."""
    rows = table(spark, folder, "embeddings").select(
        F.lit("topic").alias("task"), F.col("vec_id").alias("guid"), F.col("label").alias("gold"), F.col("embedding").alias("emb"))
    kept = rows.select("guid", "gold", F.col("emb").cast("array<double>").alias("emb"))
    fused = U.fuse(kept, _neighbors(spark, folder), "add_cls")
    every = materialize(kept.withColumn("variant", F.lit("plain")).unionByName(
        fused.withColumn("variant", F.lit("neighbors"))), "variants")
    drawn = materialize(sampling.draw_splits(rows.select(
        "task", "guid", F.col("gold").cast("string").alias("label"))).where(F.col("split") == "train"), "draws")
    train = every.join(drawn.select("seed", "guid"), "guid").withColumn("label_id", F.col("gold"))
    classes = C.train_grid(train.select("variant", "seed", "guid", "label_id", "emb"), ["variant", "seed"])
    preds = C.grid_predictions(every, classes, "variant", "seed")
    return preds.join(drawn.select("seed", "guid"), ["seed", "guid"], "left_anti").select(
        "variant", "seed", "guid", "gold", "pred")


@query("score_udf", with_parts("v") + """
    SELECT vec_id AS guid, unnest([0, 1])::INTEGER AS label_id, unnest([round(e[1], 6), round(list_sum(e), 6)]) + 0.0 AS logit
    FROM v""")
def score_udf(spark, folder):
    """A model given as a function over batches; it scores the first value and the sum."""
    def model(batch):
        emb = np.stack(batch["emb"]).astype("float64")
        return pd.DataFrame({
            "guid": batch["guid"].repeat(2), "label_id": np.tile([0, 1], len(emb)).astype("int32"),
            "logit": np.stack([emb[:, 0], emb.sum(axis=1)], axis=1).ravel()})

    return C.external_scores(_base(spark, folder), model).select("guid", "label_id", rounded("logit").alias("logit"))


@query("collate_batches", with_parts("turns") + f""",
    numbered AS (SELECT *, row_number() OVER (ORDER BY guid) - 1 AS n FROM turns)
    SELECT CAST(floor(n / 32) AS BIGINT) AS batch_id, COUNT(*) AS size, string_agg(guid, ' ' ORDER BY n) AS guid,
           string_agg(label, ' ' ORDER BY n) AS label, 1 AS no_extra,
           string_agg(array_to_string({SQL_TOKENS.format('text_b')}, ' '), ' ' ORDER BY n) AS texts
    FROM numbered GROUP BY CAST(floor(n / 32) AS BIGINT)""")
def collate_batches(spark, folder):
    rows = turn_examples(spark, folder).select(
        "guid", "label", F.lit(None).cast("int").alias("extra"), X.tokens(F.col("text_b")).alias("texts"))
    batches = C.collate_batches(rows, "guid", ["guid", "label", "extra", "texts"], flat=("texts",))
    return batches.select("batch_id", F.col("n").alias("size"), joined("guid").alias("guid"), joined("label").alias("label"),
                          F.col("extra").isNull().cast("int").alias("no_extra"), joined("texts").alias("texts"))
