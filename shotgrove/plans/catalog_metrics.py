"""Metrics per task and seed."""

import time

from pyspark.sql import functions as F

from shotgrove.operators import evaluate as V
from shotgrove.operators import scoring as C
from shotgrove.plans.catalog_fusion import SQL_SCORES, vector_scores
from shotgrove.plans.inputs import labelled, with_parts
from shotgrove.plans.registry import query, rounded, table
from shotgrove.tasks import registry_table


def _raters(spark, folder):
    """Two labels of each document as truth and prediction, by language."""
    return labelled(spark, folder).select("lang", F.col("quality").alias("label"), F.col("toxic").alias("pred"))


_SQL_RATERS = """raters AS (SELECT d.lang, l.quality AS label, l.toxic AS pred
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
counts AS (SELECT lang, COUNT(*) AS n, COUNT(*) FILTER (label = pred)::DOUBLE AS hit,
    COUNT(*) FILTER (label = 1 AND pred = 1)::DOUBLE AS tp, COUNT(*) FILTER (label <> 1 AND pred = 1)::DOUBLE AS fp,
    COUNT(*) FILTER (label = 1 AND pred <> 1)::DOUBLE AS fn, COUNT(*) FILTER (label <> 1 AND pred <> 1)::DOUBLE AS tn
    FROM raters GROUP BY lang),
found AS (SELECT lang, n, hit / n AS acc,
    CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
    CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0
         ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc FROM counts)"""


@query("accuracy", f"WITH {_SQL_RATERS} SELECT lang, n, round(acc, 6) AS acc FROM found")
def accuracy(spark, folder):
    return V.accuracy(_raters(spark, folder), ["lang"]).select("lang", "n", rounded("acc").alias("acc"))


@query("f1_binary", f"""WITH {_SQL_RATERS}
    SELECT lang, round(acc, 6) AS acc, round(f1, 6) AS f1, round((acc + f1) / 2, 6) AS acc_and_f1 FROM found""")
def f1_binary(spark, folder):
    return V.f1_binary(_raters(spark, folder), ["lang"]).select(
        "lang", *[rounded(m).alias(m) for m in ("acc", "f1", "acc_and_f1")])


@query("matthews", f"WITH {_SQL_RATERS} SELECT lang, round(mcc, 6) + 0.0 AS mcc FROM found")
def matthews(spark, folder):
    return V.matthews(_raters(spark, folder), ["lang"]).select("lang", rounded("mcc").alias("mcc"))


def _prices(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_returnflag", F.col("l_quantity").alias("label"), F.col("l_extendedprice").alias("pred"))


_SQL_RANKS = """ranks AS (
    SELECT *, rank() OVER (PARTITION BY g ORDER BY label) + (COUNT(*) OVER (PARTITION BY g, label) - 1) / 2.0 AS a,
           rank() OVER (PARTITION BY g ORDER BY pred) + (COUNT(*) OVER (PARTITION BY g, pred) - 1) / 2.0 AS b FROM pairs)"""


@query("pearson", """
    SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) + 0.0 AS pearson FROM lineitem GROUP BY l_returnflag""")
def pearson(spark, folder):
    return V.pearson(_prices(spark, folder), ["l_returnflag"]).select("l_returnflag", rounded("pearson").alias("pearson"))


@query("spearman", f"""
    WITH pairs AS (SELECT l_returnflag AS g, l_quantity AS label, l_extendedprice AS pred FROM lineitem), {_SQL_RANKS}
    SELECT g AS l_returnflag, round(corr(a, b), 6) + 0.0 AS spearman FROM ranks GROUP BY g""")
def spearman(spark, folder):
    return V.spearman(_prices(spark, folder), ["l_returnflag"]).select("l_returnflag", rounded("spearman").alias("spearman"))


@query("matched_mismatched", """
    SELECT CASE WHEN d.lang = 'en' THEN 'test_matched' ELSE 'test_mismatched' END AS split, COUNT(*) AS n,
           round(AVG((l.quality = l.toxic)::INTEGER), 6) AS acc
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def matched_mismatched(spark, folder):
    split = F.when(F.col("lang") == "en", "test_matched").otherwise("test_mismatched")
    return V.accuracy(_raters(spark, folder).withColumn("split", split), ["split"]).select(
        "split", "n", rounded("acc").alias("acc"))


_SQL_ALL = f"""{_SQL_RATERS},
pairs AS (SELECT 'sts-b' AS g, l_quantity AS label, l_extendedprice AS pred FROM lineitem), {_SQL_RANKS},
linked AS (SELECT corr(label, pred) AS p, corr(a, b) AS s FROM ranks),
metrics AS (
    SELECT 'mrpc' AS task, unnest(['acc', 'f1', 'acc_and_f1']) AS metric, unnest([acc, f1, (acc + f1) / 2]) AS value
    FROM found WHERE lang = 'en'
    UNION ALL SELECT 'cola', 'mcc', mcc FROM found WHERE lang = 'fr'
    UNION ALL SELECT 'sst-2', 'acc', acc FROM found WHERE lang = 'de'
    UNION ALL SELECT 'qqp', unnest(['acc', 'f1', 'acc_and_f1']), unnest([acc, f1, (acc + f1) / 2])
    FROM found WHERE lang = 'es'
    UNION ALL SELECT 'sts-b', unnest(['pearson', 'spearmanr', 'corr']), unnest([p, s, (p + s) / 2]) FROM linked)"""


def _task_predictions(spark, folder):
    names = {"en": "mrpc", "fr": "cola", "de": "sst-2", "es": "qqp"}
    task = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("lang")]
    raters = _raters(spark, folder).select(
        task.alias("task"), F.col("label").cast("double").alias("label"), F.col("pred").cast("double").alias("pred"))
    return raters.unionByName(_prices(spark, folder).select(F.lit("sts-b").alias("task"), "label", "pred"))


@query("metric_dispatch", f"""WITH {_SQL_ALL}
    SELECT task, metric, round(value, 6) + 0.0 AS value FROM metrics
    UNION ALL SELECT task, 'combined_score', round(AVG(value), 6) FROM metrics GROUP BY task HAVING COUNT(*) > 1""")
def metric_dispatch(spark, folder):
    found = V.evaluate(_task_predictions(spark, folder), registry_table(spark))
    return found.select("task", "metric", rounded("value").alias("value"))


@query("combined_score", f"""WITH {_SQL_RATERS}
    SELECT lang, round(((hit_rate + f1) / 2 + hit_rate + f1) / 3, 6) AS combined_score
    FROM (SELECT lang, acc AS hit_rate, f1 FROM found)""")
def combined_score(spark, folder):
    found = V.f1_binary(_raters(spark, folder), ["lang"])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("acc", "f1", "acc_and_f1")])
    rows = found.select("lang", F.explode(pairs).alias("m")).select("lang", "m.metric", "m.value")
    return V.combined(rows, ["lang"]).where(F.col("metric") == "combined_score").select(
        "lang", rounded("value").alias("combined_score"))


# A run for each language and event kind stands for task and seed.
_SQL_RESULTS = """results AS (
    SELECT l_returnflag AS task, l_linenumber AS seed, AVG((l_quantity > 25)::INTEGER) AS value FROM lineitem
    GROUP BY l_returnflag, l_linenumber)"""


def _results(spark, folder):
    preds = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("task"), F.col("l_linenumber").alias("seed"),
        F.lit(1).alias("label"), (F.col("l_quantity") > 25).cast("int").alias("pred"))
    return V.accuracy(preds, ["task", "seed"]).select("task", "seed", F.lit("acc").alias("metric"), F.col("acc").alias("value"))


@query("grid_report", f"""WITH {_SQL_RESULTS}
    SELECT task, 'acc' AS metric, COUNT(*) AS n_seeds, round(AVG(value), 6) AS mean, round(stddev_samp(value), 6) AS std
    FROM results GROUP BY task""")
def grid_report(spark, folder):
    return V.grid_report(_results(spark, folder)).select(
        "task", "metric", "n_seeds", rounded("mean").alias("mean"), rounded("std").alias("std"))


@query("best_of_dev", f"""WITH {_SQL_RESULTS},
    runs AS (SELECT task, task || '-' || seed AS run_id, seed AS step, value AS dev FROM results)
    SELECT task, arg_max(run_id, dev * 1e6 - step / 1e6) AS best_run, arg_max(run_id, step) AS last_run
    FROM runs GROUP BY task""")
def best_of_dev(spark, folder):
    runs = _results(spark, folder).select(
        "task", F.concat_ws("-", "task", "seed").alias("run_id"), F.col("seed").alias("step"),
        F.col("value").alias("dev_metric"))
    return V.best_of_dev(runs, ["task"])


@query("class_accuracy", with_parts("v") + ",\n" + SQL_SCORES + """,
    preds AS (SELECT guid, label_id AS pred FROM (
        SELECT *, row_number() OVER (PARTITION BY guid ORDER BY logit DESC, label_id) AS n FROM scores) WHERE n = 1)
    SELECT v.label, COUNT(*) AS n, round(AVG((p.pred = v.label)::INTEGER), 6) AS acc
    FROM preds p JOIN v ON v.vec_id = p.guid GROUP BY v.label""")
def class_accuracy(spark, folder):
    """Accuracy of the nearest class mean, by class."""
    gold = table(spark, folder, "embeddings").select(F.col("vec_id").alias("guid"), "label")
    preds = C.argmax_lists(vector_scores(spark, folder)).join(gold, "guid").withColumn("class", F.col("label"))
    return V.accuracy(preds, ["class"]).select(F.col("class").alias("label"), "n", rounded("acc").alias("acc"))


@query("run_throughput", """
    SELECT 'documents' AS run, COUNT(*) AS n_rows, 1 AS n_steps, SUM(len(string_split(text, ' ')))::BIGINT AS n_tokens,
           true AS rates_fit
    FROM documents""")
def run_throughput(spark, folder):
    """Rows and words of one pass over the documents, and whether the rates are these by the seconds."""
    begun = time.time()
    rows, words = table(spark, folder, "documents").agg(
        F.count(F.lit(1)), F.sum(F.size(F.split("text", " ")))).first()
    figures = V.throughput(spark, "documents", rows, words, 1, time.time() - begun)
    fit = (F.abs(F.col("rows_per_second") * F.col("seconds") - F.col("n_rows")) < 1e-3) & (
        F.abs(F.col("tokens_per_second") * F.col("seconds") - F.col("n_tokens")) < 1e-3) & (
        F.abs(F.col("steps_per_second") * F.col("seconds") - 1) < 1e-3)
    return figures.select("run", "n_rows", F.col("n_steps").cast("int").alias("n_steps"), "n_tokens", fit.alias("rates_fit"))
