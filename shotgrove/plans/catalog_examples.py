"""Sources, sinks, examples and labels."""

from pyspark.sql import functions as F

from shotgrove.functions import labels as L
from shotgrove.functions import text as X
from shotgrove.operators import examples as E
from shotgrove.operators import labels as LB
from shotgrove.operators import sampling, vocab
from shotgrove.plans.inputs import (
    SQL_TOKENS, labelled, quality_examples, turn_examples, with_parts)
from shotgrove.plans.registry import query, rounded, table
from shotgrove.schema import QA_ARTICLES
from shotgrove.session import new_table_path
from shotgrove.sinks import splits
from shotgrove.sources import corpus, files
from shotgrove.tasks import TASKS, registry_table


def _one_line(text):
    return F.regexp_replace(text, r"[\t\r\n]+", " ")


_SQL_ONE_LINE = r"regexp_replace({0}, '[\t\r\n]+', ' ', 'g')"
_A, _B = _SQL_ONE_LINE.format("a.text"), _SQL_ONE_LINE.format("b.text")


@query("scan_tsv_task", f"""
    WITH p AS (SELECT a.conv_id, a.turn, {_A} AS text_a, {_B} AS text_b, b.role AS label
               FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
    SELECT 'mrpc' AS task, 'train-' || row_number() OVER (ORDER BY conv_id, turn) AS guid, text_a, text_b, label FROM p
    UNION ALL
    SELECT 'mnli' AS task, 'train-' || conv_id || '.' || turn AS guid, text_a, text_b, label FROM p""")
def scan_tsv_task(spark, folder):
    pairs = E.adjacent_pairs(table(spark, folder, "conversations")).select(
        (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("line_no"), F.concat_ws(".", "conv_id", "turn").alias("id"),
        _one_line(F.col("text_a")).alias("a"), _one_line(F.col("text_b")).alias("b"), "label")
    filler = [F.lit("-")] * 7
    layouts = {"mrpc": ["label", "id", "id", "a", "b"], "mnli": ["id", *filler, "a", "b", "label"]}
    read = []
    for task, fields in layouts.items():
        root = new_table_path(spark, task)
        header = spark.createDataFrame([("header", 0)], "value string, line_no bigint")
        lines = pairs.select(F.concat_ws("\t", *fields).alias("value"), "line_no")
        splits.write_lines(header.unionByName(lines), f"{root}/train.tsv")
        read.append(files.read_task(spark, root, task, "train").select("task", "guid", "text_a", "text_b", "label"))
    return read[0].unionByName(read[1])


@query("scan_csv_task", """
    SELECT 'mr' AS task, 'train-' || (row_number() OVER (ORDER BY d.doc_id) - 1) AS guid, d.text AS text_a,
           CAST(l.quality AS VARCHAR) AS label
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def scan_csv_task(spark, folder):
    root = new_table_path(spark, "mr")
    rows = labelled(spark, folder).select(F.lit(0).alias("one"), "quality", "text", F.col("doc_id").alias("draw"))
    (rows.repartitionByRange("draw").sortWithinPartitions("draw").select("quality", "text").write
     .options(quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
     .csv(f"{root}/train.csv"))
    return files.read_task(spark, root, "mr", "train").select("task", "guid", "text_a", "label")


@query("null_tokens", """
    SELECT doc_id, CASE lang WHEN 'en' THEN text ELSE '' END AS text, lang <> 'en' AS missing FROM documents""")
def null_tokens(spark, folder):
    spelled = F.when(F.col("lang") == "de", "NA").when(F.col("lang") == "es", "null").when(
        F.col("lang") == "fr", "").otherwise(F.col("text"))
    read = table(spark, folder, "documents").select("doc_id", X.null_tokens(spelled).alias("text"))
    return read.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("missing"))


@query("scan_multilingual", rf"""
    SELECT 'xnli' AS task, 'test-' || (d.doc_id + 1) AS guid, {_SQL_ONE_LINE.format('d.text')} AS text_a,
           d.source AS text_b,
           CASE WHEN l.toxic = 1 THEN 'contradiction' WHEN l.quality = 1 THEN 'entailment' ELSE 'neutral' END AS label
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang = 'fr'""")
def scan_multilingual(spark, folder):
    label = F.when(F.col("toxic") == 1, "contradictory").when(F.col("quality") == 1, "entailment").otherwise("neutral")
    lines = labelled(spark, folder).select(
        (F.col("doc_id") + 1).alias("line_no"),
        F.concat_ws("\t", "lang", label, *[F.lit("-")] * 4, _one_line(F.col("text")), "source").alias("value"))
    parsed = E.require_types(E.parse_multilingual(lines, "test", "fr"), pair=True)
    return parsed.select("task", "guid", "text_a", "text_b", "label")


@query("scan_named_record", f"""
    SELECT 'cola' AS task, CAST(d.doc_id AS VARCHAR) AS guid, d.text AS text_a, '' AS text_b,
           CAST(l.quality AS VARCHAR) AS label
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id
    UNION ALL
    SELECT 'mnli' AS task, a.conv_id || '.' || a.turn AS guid, a.text AS text_a, b.text AS text_b, b.role AS label
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def scan_named_record(spark, folder):
    single = labelled(spark, folder).select(
        F.col("doc_id").alias("idx"), F.col("text").alias("sentence"), F.col("quality").alias("label"))
    pair = E.adjacent_pairs(table(spark, folder, "conversations")).select(
        F.concat_ws(".", "conv_id", "turn").alias("idx"), F.col("text_a").alias("premise"),
        F.col("text_b").alias("hypothesis"), "label")
    both = E.examples_from_records(single, "cola", "train").unionByName(
        E.examples_from_records(pair, "mnli", "train"))
    return both.select("task", "guid", "text_a", F.coalesce("text_b", F.lit("")).alias("text_b"), "label")


@query("scan_qa_json", """
    SELECT doc_id || '-0' AS qas_id, source AS title, lang AS question_text, text AS context_text,
           text AS answer_text, 0 AS answer_start, 0 AS impossible FROM documents
    UNION ALL
    SELECT doc_id || '-1', source, lang || '?', text, '', -1, 1 FROM documents""")
def scan_qa_json(spark, folder):
    def question(number, text, impossible):
        answer = F.array(F.struct(F.col("text"), F.lit(0).alias("answer_start")))
        return F.struct(F.concat(F.col("doc_id"), F.lit(f"-{number}")).alias("id"), text.alias("question"),
                        F.lit(impossible).alias("is_impossible"), answer.alias("answers"))

    asked = F.array(question(0, F.col("lang"), False), question(1, F.concat("lang", F.lit("?")), True))
    paragraph = F.struct(F.col("text").alias("context"), asked.alias("qas"))
    article = F.struct(F.col("source").alias("title"), F.array(paragraph).alias("paragraphs"))
    document = F.to_json(F.struct(F.array(article).alias("data")))
    read = table(spark, folder, "documents").select(F.from_json(document, QA_ARTICLES).alias("j")).select("j.data")
    return corpus.flatten_qa(read).select(
        "qas_id", "title", "question_text", "context_text", F.coalesce("answer_text", F.lit("")).alias("answer_text"),
        F.coalesce("answer_start", F.lit(-1)).alias("answer_start"), F.col("is_impossible").cast("int").alias("impossible"))


@query("scan_corpus", "SELECT doc_id, text, n_chars FROM documents")
def scan_corpus(spark, folder):
    return corpus.open_corpus(spark, f"{folder}/documents.parquet").select("doc_id", "text", "n_chars")


# Every task of the registry, by customer number.
_SQL_REGISTRY = """registry(task, fmt, n_labels, mode, metric, median, lower_bound, upper_bound, max_length) AS (VALUES
    ('mrpc', 'tsv', 2, 'classification', 'acc_and_f1', NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 128),
    ('mnli', 'tsv', 3, 'classification', 'accuracy', NULL, NULL, NULL, 256),
    ('mnli-mm', 'tsv', NULL, 'classification', 'accuracy', NULL, NULL, NULL, 256),
    ('cola', 'tsv', 2, 'classification', 'matthews', NULL, NULL, NULL, 128),
    ('sst-2', 'tsv', 2, 'classification', 'accuracy', NULL, NULL, NULL, 128),
    ('sts-b', 'tsv', 1, 'regression', 'pearson_spearman', 2.5, 0, 5, 128),
    ('qqp', 'tsv', 2, 'classification', 'acc_and_f1', NULL, NULL, NULL, 128),
    ('qnli', 'tsv', 2, 'classification', 'accuracy', NULL, NULL, NULL, 128),
    ('rte', 'tsv', 2, 'classification', 'accuracy', NULL, NULL, NULL, 256),
    ('wnli', 'tsv', 2, 'classification', 'accuracy', NULL, NULL, NULL, 128),
    ('snli', 'tsv', 3, 'classification', 'accuracy', NULL, NULL, NULL, 256),
    ('mr', 'csv', 2, 'classification', 'accuracy', NULL, NULL, NULL, 128),
    ('sst-5', 'csv', 5, 'classification', 'accuracy', NULL, NULL, NULL, 128),
    ('subj', 'csv', 2, 'classification', 'accuracy', NULL, NULL, NULL, 128),
    ('trec', 'csv', 6, 'classification', 'accuracy', NULL, NULL, NULL, 128),
    ('cr', 'csv', 2, 'classification', 'accuracy', NULL, NULL, NULL, 128),
    ('mpqa', 'csv', 2, 'classification', 'accuracy', NULL, NULL, NULL, 128),
    ('xnli', 'tsv', 3, 'classification', 'accuracy', NULL, NULL, NULL, 128),
    ('squadv1', 'json', NULL, 'generation', NULL, NULL, NULL, NULL, 128),
    ('squadv2', 'json', NULL, 'generation', NULL, NULL, NULL, NULL, 128))"""


@query("task_registry", f"""WITH {_SQL_REGISTRY},
    places AS (SELECT *, row_number() OVER (ORDER BY task) - 1 AS place FROM registry)
    SELECT p.* EXCLUDE (place), COUNT(*) AS n_customers
    FROM customer c JOIN places p ON p.place = c.c_custkey % 20 GROUP BY ALL""")
def task_registry(spark, folder):
    """Customers stand for examples; each belongs to one of the tasks by its number."""
    names = F.array(*[F.lit(name) for name in sorted(TASKS)])
    task = F.get(names, (F.col("c_custkey") % len(TASKS)).cast("int"))
    counted = table(spark, folder, "customer").groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n_customers"))
    return counted.join(F.broadcast(registry_table(spark)), "task")


_DRAWN = """drawn AS (
    SELECT * FROM (SELECT guid, label, text_a, row_number() OVER (
                       PARTITION BY label ORDER BY md5('13:' || task || ':' || guid), guid) AS draw FROM quality)
    WHERE draw <= 16)"""


def _drawn_quality(spark, folder):
    examples = quality_examples(spark, folder)
    draws = sampling.draw_splits(examples, seeds=(13,)).where(F.col("split") == "train")
    return sampling.with_rows(draws, examples)


@query("write_split_tsv", with_parts("quality") + f""", {_DRAWN}
    SELECT 'train-' || row_number() OVER (ORDER BY label, draw) AS guid,
           {_SQL_ONE_LINE.format('text_a')} AS text_a, label FROM drawn""")
def write_split_tsv(spark, folder):
    rows = _drawn_quality(spark, folder).select(
        F.concat_ws("\t", _one_line(F.col("text_a")), "label").alias("value"), "label", "draw")
    root = splits.setting_folder(new_table_path(spark, "splits"), "k-shot", "sst-2", 16, 13)
    splits.write_split_tsv(rows, root, "sst-2", "train", "sentence\tlabel")
    return files.read_task(spark, root, "sst-2", "train").select("guid", "text_a", "label")


@query("write_split_csv", with_parts("quality") + f""", {_DRAWN}
    SELECT 'train-' || (row_number() OVER (ORDER BY label, draw) - 1) AS guid, text_a, label FROM drawn""")
def write_split_csv(spark, folder):
    rows = _drawn_quality(spark, folder).select(F.col("text_a").alias("text"), "label", "draw")
    root = splits.setting_folder(new_table_path(spark, "splits"), "k-shot", "mr", 16, 13)
    splits.write_split_csv(rows, root, "train")
    return files.read_task(spark, root, "mr", "train").select("guid", "text_a", "label")


@query("relabel_test_split", """
    SELECT doc_id, CASE lang WHEN 'de' THEN 'test_matched' WHEN 'fr' THEN 'test_mismatched' ELSE 'test' END AS split
    FROM documents WHERE lang <> 'en'""")
def relabel_test_split(spark, folder):
    split = (F.when(F.col("lang") == "en", "train").when(F.col("lang") == "de", "dev_matched")
             .when(F.col("lang") == "fr", "dev_mismatched").otherwise("dev"))
    return sampling.relabel_test(table(spark, folder, "documents").select("doc_id", split.alias("split")))


@query("examples_to_json", with_parts("turns") + """
    SELECT guid, text_a, text_b, label FROM turns""")
def examples_to_json(spark, folder):
    written = splits.to_json_lines(turn_examples(spark, folder))
    fields = ["guid", "text_a", "text_b", "label"]
    return written.select(*[F.get_json_object("value", f"$.{f}").alias(f) for f in fields])


@query("normalize_examples", with_parts("quality", "turns") + """
    SELECT task, split, guid, text_a, COALESCE(text_b, '') AS text_b, label
    FROM (SELECT * FROM quality UNION ALL SELECT * FROM turns)""")
def normalize_examples(spark, folder):
    return quality_examples(spark, folder).unionByName(turn_examples(spark, folder)).withColumn(
        "text_b", F.coalesce("text_b", F.lit("")))


@query("skip_header", """
    SELECT 'sst-2' AS task, doc_id AS line_no, lang AS value FROM documents WHERE doc_id > 0
    UNION ALL SELECT 'cola' AS task, doc_id AS line_no, lang AS value FROM documents""")
def skip_header(spark, folder):
    lines = table(spark, folder, "documents").select(F.col("doc_id").alias("line_no"), F.col("lang").alias("value"))
    kept = [E.without_header(lines, t).withColumn("task", F.lit(t)) for t in ("sst-2", "cola")]
    return kept[0].unionByName(kept[1]).select("task", "line_no", "value")


@query("skip_malformed", rf"""
    SELECT 'train-' || d.doc_id AS guid, d.source AS text_a, {_SQL_ONE_LINE.format('d.text')} AS text_b,
           CAST(l.quality AS VARCHAR) AS label
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang <> 'de'""")
def skip_malformed(spark, folder):
    full = F.concat_ws("\t", "doc_id", F.lit(""), F.lit(""), "source", _one_line(F.col("text")), "quality")
    short = F.concat_ws("\t", "doc_id", F.lit(""), "source")
    lines = labelled(spark, folder).select(
        (F.col("doc_id") + 1).alias("line_no"), F.when(F.col("lang") == "de", short).otherwise(full).alias("value"))
    return E.parse_lines(lines, "qqp", "train").select("guid", "text_a", "text_b", "label")


@query("label_normalize", """
    SELECT doc_id, CASE toxic WHEN 1 THEN 'contradiction' ELSE 'neutral' END AS label FROM labels""")
def label_normalize(spark, folder):
    raw = F.when(F.col("toxic") == 1, "contradictory").otherwise("neutral")
    return table(spark, folder, "labels").select("doc_id", L.normalize(raw).alias("label"))


@query("validate_types", """
    SELECT d.doc_id, CASE WHEN d.lang = 'fr' THEN 'text_a is not a string'
                          WHEN l.quality IS NULL THEN 'label is not a string' ELSE '' END AS problem
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def validate_types(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left").select(
        "doc_id", F.when(F.col("lang") != "fr", F.col("text")).alias("text_a"),
        F.col("quality").cast("string").alias("label"))
    return E.flag_types(rows).select("doc_id", "problem")


@query("concat_fields", """
    SELECT doc_id, concat_ws(' ', lang, CASE WHEN source <> 'src1' THEN source END, text) AS text_a FROM documents""")
def concat_fields(spark, folder):
    optional = F.when(F.col("source") != "src1", F.col("source"))
    return table(spark, folder, "documents").select(
        "doc_id", X.concat_fields(F.col("lang"), optional, F.col("text")).alias("text_a"))


@query("join_pair_text", with_parts("quality", "turns") + """
    SELECT guid, CASE WHEN text_b IS NULL THEN text_a ELSE text_a || ' </s> ' || text_b END AS text
    FROM (SELECT * FROM quality UNION ALL SELECT * FROM turns)""")
def join_pair_text(spark, folder):
    both = quality_examples(spark, folder).unionByName(turn_examples(spark, folder))
    return both.select("guid", X.pair_text(F.col("text_a"), F.col("text_b"), "</s>").alias("text"))


@query("to_text_list", with_parts("quality", "turns") + """
    SELECT guid, CASE WHEN text_b IS NULL THEN 1 ELSE 2 END AS n, concat_ws('|', text_a, text_b) AS texts
    FROM (SELECT * FROM quality UNION ALL SELECT * FROM turns)""")
def to_text_list(spark, folder):
    both = quality_examples(spark, folder).unionByName(turn_examples(spark, folder))
    listed = both.select("guid", X.text_list(F.col("text_a"), F.col("text_b")).alias("t"))
    return listed.select("guid", F.size("t").alias("n"), F.array_join("t", "|").alias("texts"))


@query("explode_sentences", with_parts("quality", "turns") + """
    SELECT task, guid, 0 AS sent_id, text_a AS text FROM quality
    UNION ALL SELECT task, guid, 0, text_a FROM turns UNION ALL SELECT task, guid, 1, text_b FROM turns""")
def explode_sentences(spark, folder):
    return E.explode_sentences(quality_examples(spark, folder).unionByName(turn_examples(spark, folder)))


def _roles(spark):
    return spark.createDataFrame([("turns", r, i) for i, r in enumerate(("assistant", "system", "user"))],
                                 "task string, label string, label_id int")


@query("label_ids", with_parts("turns") + """
    SELECT guid, label, CASE label WHEN 'assistant' THEN 0 WHEN 'system' THEN 1 WHEN 'user' THEN 2 END AS label_id
    FROM turns""")
def label_ids(spark, folder):
    return LB.label_ids(turn_examples(spark, folder), _roles(spark)).select("guid", "label", "label_id")


@query("binarize_label", """
    SELECT p_partkey, CAST(p_size AS DOUBLE) / 10 AS score,
           CASE WHEN CAST(p_size AS DOUBLE) / 10 < 2.5 THEN 0 ELSE 1 END AS label FROM part""")
def binarize_label(spark, folder):
    score = F.col("p_size").cast("double") / 10
    return table(spark, folder, "part").select("p_partkey", score.alias("score"), L.binarize(score).alias("label"))


@query("raw_line_label", """
    SELECT doc_id, CAST(quality AS VARCHAR) AS cola, CAST(toxic AS VARCHAR) AS qnli,
           CASE WHEN toxic < 2.5 THEN '0' ELSE '1' END AS stsb FROM labels""")
def raw_line_label(spark, folder):
    line = F.concat_ws("\t", F.concat(F.lit("  id"), "doc_id"), "quality", F.lit("text"), "toxic", F.lit(""), F.lit(" "))
    return table(spark, folder, "labels").select("doc_id", *[
        L.raw_line_label(task, line).alias(name) for task, name in (("cola", "cola"), ("qnli", "qnli"), ("sts-b", "stsb"))])


@query("bounded_to_probs", """
    SELECT p_partkey, round(1 - CAST(p_size AS DOUBLE) / 50, 6) AS p_low, round(CAST(p_size AS DOUBLE) / 50, 6) AS p_high
    FROM part""")
def bounded_to_probs(spark, folder):
    high = L.to_probability(F.col("p_size").cast("double") / 10)
    return table(spark, folder, "part").select("p_partkey", rounded(1 - high).alias("p_low"), rounded(high).alias("p_high"))


@query("probs_to_bounded", """
    SELECT p_partkey, CASE WHEN p_size = 0 THEN 0.0 ELSE round(exp(ln(CAST(p_size AS DOUBLE) / 50)) * 5, 6) END AS score
    FROM part""")
def probs_to_bounded(spark, folder):
    probability = L.to_probability(F.col("p_size").cast("double") / 10)
    # The logarithm of no chance at all; the engine's own is NULL there.
    logp = F.when(probability == 0, F.lit(float("-inf"))).otherwise(F.ln(probability))
    return table(spark, folder, "part").select(
        "p_partkey", rounded(L.from_log_probability(logp)).alias("score"))


SQL_VOCAB = f"""counts AS (
    SELECT token, COUNT(*) AS n
    FROM (SELECT unnest({SQL_TOKENS.format('text')}) AS token FROM documents) GROUP BY token),
vocab AS (
    SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 4 AS token_id FROM counts
    UNION ALL
    SELECT * FROM (VALUES ('<s>', 0, 0), ('<pad>', 0, 1), ('</s>', 0, 2), ('<unk>', 0, 3), ('<mask>', 0, 4)))"""


def document_vocab(spark, folder):
    return vocab.build_vocab(X.explode_once(
        table(spark, folder, "documents"), [], X.tokens(F.col("text")), "token"))


@query("verbalize", f"""
    WITH {SQL_VOCAB}, words(task, label, word) AS (
        VALUES ('language', 'en', 'the'), ('language', 'fr', 'la'), ('language', 'de', 'und'), ('language', 'es', 'el'),
               ('language', 'none', 'not one'), ('quality', '0', '.'), ('quality', '1', ','))
    SELECT w.task, w.label, w.word, CAST(COALESCE(v.token_id, -1) AS BIGINT) AS word_id,
           CASE WHEN v.token_id IS NULL THEN 'not one token' ELSE '' END AS problem
    FROM words w LEFT JOIN vocab v ON v.token = w.word""")
def verbalize(spark, folder):
    words = spark.createDataFrame(
        [("language", "en", "the"), ("language", "fr", "la"), ("language", "de", "und"), ("language", "es", "el"),
         ("language", "none", "not one"), ("quality", "0", "."), ("quality", "1", ",")],
        "task string, label string, word string")
    return LB.verbalize(words, document_vocab(spark, folder))


@query("label_distribution", with_parts("quality", "turns") + """
    SELECT task, label, COUNT(*) AS n, MIN(md5('42:' || task || ':' || guid)) AS first_key
    FROM (SELECT * FROM quality UNION ALL SELECT * FROM turns) GROUP BY task, label""")
def label_distribution(spark, folder):
    both = quality_examples(spark, folder).unionByName(turn_examples(spark, folder))
    return LB.label_distribution(sampling.seed_grid(both, (42,)), "shuffle_key")
