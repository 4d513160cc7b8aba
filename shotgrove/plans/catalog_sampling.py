"""Seeded splits."""

from pyspark.sql import functions as F

from shotgrove.operators import sampling as S
from shotgrove.operators.numbering import row_numbers
from shotgrove.plans.inputs import labelled, language_examples, priority_examples, quality_examples, with_parts
from shotgrove.plans.registry import query
from shotgrove.session import new_table_path
from shotgrove.sinks.builder import build_splits
from shotgrove.sinks.splits import write_lines, write_split_csv

_GRID = "(VALUES (13), (21), (42), (87), (100)) AS s(seed)"
_RANKED = """ranked AS (
    SELECT e.task, s.seed, e.label, e.guid, row_number() OVER (
        PARTITION BY e.task, s.seed, e.label ORDER BY md5(s.seed || ':' || e.task || ':' || e.guid), e.guid) AS draw
    FROM {0} e CROSS JOIN """ + _GRID + ")"


def _draws(source: str, condition: str, split: str) -> str:
    return with_parts(source) + ",\n" + _RANKED.format(source) + f"""
    SELECT task, seed, '{split}' AS split, label, CAST(draw AS INTEGER) AS draw, guid FROM ranked WHERE {condition}"""


@query("seeded_shuffle", with_parts("quality") + f"""
    SELECT s.seed, e.guid, md5(s.seed || ':' || e.task || ':' || e.guid) AS shuffle_key,
           row_number() OVER (PARTITION BY s.seed ORDER BY md5(s.seed || ':' || e.task || ':' || e.guid), e.guid) AS pos
    FROM quality e CROSS JOIN {_GRID}""")
def seeded_shuffle(spark, folder):
    keyed = S.seed_grid(quality_examples(spark, folder).select("task", "guid"))
    order = [F.col("shuffle_key"), F.col("guid")]
    return row_numbers(keyed, order, "pos", ["seed"]).select("seed", "guid", "shuffle_key", "pos")


@query("kshot_train", _draws("quality", "draw <= 16", "train"))
def kshot_train(spark, folder):
    return S.draw_splits(quality_examples(spark, folder)).where(F.col("split") == "train")


@query("kshot_dev", _draws("quality", "draw BETWEEN 17 AND 32", "dev"))
def kshot_dev(spark, folder):
    return S.draw_splits(quality_examples(spark, folder)).where(F.col("split") == "dev")


@query("kshot_dev_10x", _draws("quality", "draw BETWEEN 17 AND 176", "dev"))
def kshot_dev_10x(spark, folder):
    return S.draw_splits(quality_examples(spark, folder), mode="k-shot-10x").where(F.col("split") == "dev")


@query("full_set", with_parts("language") + """
    SELECT task, 0 AS seed, 'train' AS split, label, guid FROM language
    UNION ALL
    SELECT task, 0 AS seed, 'dev' AS split, label, guid FROM (
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || task || ':' || guid), guid) AS draw
        FROM language) WHERE draw <= 100""")
def full_set(spark, folder):
    return S.draw_full_set(language_examples(spark, folder))


@query("full_set_csv", with_parts("language") + """
    SELECT task, 0 AS seed, split, label, guid
    FROM (SELECT task, label, guid, unnest(['train', 'dev']) AS split FROM language)""")
def full_set_csv(spark, folder):
    return S.draw_full_set(language_examples(spark, folder), "csv")


@query("seed_task_grid", with_parts("quality", "language", "priority") + """,
    every AS (SELECT * FROM quality UNION ALL SELECT * FROM language UNION ALL SELECT * FROM priority),
    """ + _RANKED.format("every") + """
    SELECT task, seed, CASE WHEN draw <= 16 THEN 'train' ELSE 'dev' END AS split, label,
           CAST(draw AS INTEGER) AS draw, guid
    FROM ranked WHERE draw <= 32""")
def seed_task_grid(spark, folder):
    every = (quality_examples(spark, folder).unionByName(language_examples(spark, folder))
             .unionByName(priority_examples(spark, folder)))
    return S.draw_splits(every)


@query("kshot_rows", with_parts("quality") + ",\n" + _RANKED.format("quality") + """
    SELECT r.seed, CASE WHEN r.draw <= 16 THEN 'train' ELSE 'dev' END AS split, r.label, r.guid, q.text_a
    FROM ranked r JOIN quality q ON q.guid = r.guid WHERE r.draw <= 32""")
def kshot_rows(spark, folder):
    examples = quality_examples(spark, folder)
    return S.with_rows(S.draw_splits(examples), examples).select("seed", "split", "label", "guid", "text_a")


@query("split_leakage_check", with_parts("quality", "language") + ",\n" + _RANKED.format("quality") + """,
    dev AS (SELECT guid FROM (SELECT guid, row_number() OVER (
                PARTITION BY label ORDER BY md5('0:' || task || ':' || guid), guid) AS draw FROM language)
            WHERE draw <= 100)
    SELECT 'k-shot' AS mode, count(*) AS n_leaked FROM ranked t JOIN ranked d ON t.seed = d.seed AND t.guid = d.guid
    WHERE t.draw <= 16 AND d.draw > 16 AND d.draw <= 32
    UNION ALL SELECT 'full-set', count(*) FROM language t JOIN dev d ON t.guid = d.guid""")
def split_leakage_check(spark, folder):
    shots = S.leaked(S.draw_splits(quality_examples(spark, folder)))
    full = S.leaked(S.draw_full_set(language_examples(spark, folder)))

    def counted(rows, mode):
        return rows.agg(F.count(F.lit(1)).alias("n_leaked")).select(F.lit(mode).alias("mode"), "n_leaked")

    return counted(shots, "k-shot").unionByName(counted(full, "full-set"))


def _one_line(text):
    return F.translate(F.coalesce(text, F.lit("")), "\t\n\r", "   ")


def _write_task_files(spark, folder, root):
    """Documents as files of a tsv and a csv task: those that are not toxic to train on, the toxic ones beside them."""
    rows = labelled(spark, folder).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic",
                                          F.col("quality").cast("string").alias("label"))
    header = spark.createDataFrame([("sentence\tlabel", -1)], "value string, line_no bigint")
    for toxic, tsv, csv in ((0, "train", "train"), (1, "dev", "test")):
        part = rows.where(F.col("toxic") == toxic)
        lines = part.select(F.concat_ws("\t", _one_line(F.col("text")), "label").alias("value"), F.col("doc_id").alias("line_no"))
        write_lines(header.unionByName(lines), f"{root}/sst-2/{tsv}.tsv")
        # All under one class, so that the records are in order of their ids.
        write_split_csv(part.select(F.col("label").alias("own"), "text", F.col("doc_id").alias("draw"), F.lit(0).alias("label")),
                        f"{root}/cr", csv, "own")


@query("kshot_files", f"""
    WITH read AS (
        SELECT l.toxic, CAST(l.quality AS VARCHAR) AS label, coalesce(d.text, '') AS raw,
               translate(coalesce(d.text, ''), chr(9) || chr(10) || chr(13), '   ') AS line,
               row_number() OVER (PARTITION BY l.toxic ORDER BY d.doc_id) AS n
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
    sources AS (SELECT 'sst-2' AS task, toxic, CAST(n AS VARCHAR) AS guid, label, line AS text FROM read
                UNION ALL SELECT 'cr', toxic, CAST(n - 1 AS VARCHAR), label, raw FROM read),
    drawable AS (SELECT * FROM sources WHERE toxic = 0),
    {_RANKED.format("drawable")}
    SELECT r.task, r.seed, CASE WHEN r.draw <= 16 THEN 'train' ELSE 'dev' END AS file, r.label, d.text
    FROM ranked r JOIN drawable d ON d.task = r.task AND d.guid = r.guid WHERE r.draw <= 32
    UNION ALL SELECT e.task, s.seed, 'test' AS file, e.label, e.text FROM sources e CROSS JOIN {_GRID} WHERE e.toxic = 1
    UNION ALL SELECT 'sst-2' AS task, s.seed, unnest(['train', 'dev', 'test']) AS file, 'label' AS label, 'sentence' AS text
    FROM {_GRID}""")
def kshot_files(spark, folder):
    """Task files, split folders from them, and all lines of these read back, headers too."""
    root = new_table_path(spark, "tasks")
    _write_task_files(spark, folder, root)
    out = new_table_path(spark, "kshot")
    build_splits(spark, root, out, ("sst-2", "cr"))
    lines = spark.read.text(f"{out}/k-shot/sst-2/*/*.tsv").select(
        F.col("_metadata.file_path").alias("path"), F.lit("sst-2").alias("task"), F.split("value", "\t").alias("f"))
    records = spark.read.schema("label string, text string").options(quote='"', escape='"', multiLine=True).csv(
        f"{out}/k-shot/cr/*/*.csv").select(F.col("_metadata.file_path").alias("path"), F.lit("cr").alias("task"), "label", "text")
    every = lines.select("path", "task", F.get("f", F.lit(1)).alias("label"), F.get("f", F.lit(0)).alias("text")).unionByName(records)
    place = "/16-([0-9]+)/([a-z]+)[.]"
    return every.select("task", F.regexp_extract("path", place, 1).cast("int").alias("seed"),
                        F.regexp_extract("path", place, 2).alias("file"), "label", F.coalesce("text", F.lit("")).alias("text"))
