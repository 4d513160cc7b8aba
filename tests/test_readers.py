import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shotgrove.functions import labels as L
from shotgrove.functions import text as X
from shotgrove.operators import examples as E
from shotgrove.operators import labels as LB
from shotgrove.schema import EXAMPLE, QA_ARTICLES
from shotgrove.sinks import splits
from shotgrove.sources import corpus, files
from shotgrove.tasks import SPLIT_TASKS, TASKS, label_table, task


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())
    return str(path)


def test_row_numbers_follow_the_file(spark, tmp_path):
    lines = [f"line {i}" for i in range(5000)]
    path = write(tmp_path / "big.tsv", "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = files.read_lines(spark, path)
        assert read.rdd.getNumPartitions() > 4
        assert sorted(rows(read, "line_no", "value")) == sorted(enumerate(lines))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_numbers_go_on_over_part_files(spark, tmp_path):
    lines = spark.range(1000).select(F.concat(F.lit("v"), "id").alias("value"), F.col("id").alias("line_no"))
    splits.write_lines(lines, str(tmp_path / "parts"))
    read = files.read_lines(spark, str(tmp_path / "parts"))
    assert sorted(rows(read, "line_no", "value")) == sorted((i, f"v{i}") for i in range(1000))


def test_header_and_guid_from_column(spark, tmp_path):
    body = "\t".join(["17", "x", "x", "x", "x", "x", "x", "x", 'an "unbalanced quote', "b", "more", "neutral"])
    write(tmp_path / "dev_matched.tsv", "h1\th2\n" + body + "\n")
    read = files.read_task(spark, str(tmp_path), "mnli", "dev")
    assert read.schema.names == EXAMPLE.names
    assert rows(read, *EXAMPLE.names) == [
        ("mnli", "dev", "dev_matched-17", 'an "unbalanced quote', "b", "neutral")]


def test_file_without_header_counts_from_zero(spark, tmp_path):
    write(tmp_path / "train.tsv", "s\t1\t\tfirst\ns\t0\t*\tsecond\ns\t1\t\tthird\n")
    read = files.read_task(spark, str(tmp_path), "cola", "train").orderBy("guid")
    assert rows(read, "guid", "text_a", "label") == [
        ("train-0", "first", "1"), ("train-1", "second", "0"), ("train-2", "third", "1")]


def test_short_rows_are_dropped_only_where_the_task_says_so(spark, tmp_path):
    write(tmp_path / "train.tsv", "h\n1\tx\tx\ta\tb\t1\n2\tx\tx\ta\n3\tx\tx\tc\td\t0\textra\n")
    read = files.read_task(spark, str(tmp_path), "qqp", "train").orderBy("guid")
    assert rows(read, "guid", "text_a", "text_b", "label") == [
        ("train-1", "a", "b", "1"), ("train-3", "c", "d", "0")]
    with pytest.raises(PySparkException, match="no field 4 in line 2"):
        files.read_task(spark, str(tmp_path), "mrpc", "train").collect()
    assert rows(E.short_lines(files.read_lines(spark, str(tmp_path / "train.tsv")), "mrpc"), "line_no", "n_fields") == [(2, 4)]


def test_trailing_empty_field_counts_for_readers_but_not_for_sampling(spark):
    line = F.lit("1\ta\tb\tnot_entailment\t")
    one = spark.range(1)
    assert rows(one, X.field(X.split_line(line), -1)) == [("",)]
    assert rows(one, L.raw_line_label("qnli", line)) == [("not_entailment",)]
    assert rows(one, L.raw_line_label("sts-b", F.lit("1\t2.4\n")), L.raw_line_label("sts-b", F.lit("1\t2.5 "))) == [("0", "1")]
    assert rows(one, L.raw_line_label("mrpc", F.lit(" 1\ta"))) == [("1",)]


@pytest.mark.parametrize("size", ["64", "700", "100000"])
def test_texts_with_line_breaks_are_read_by_many_tasks(spark, tmp_path, size):
    """The same rows as one task that reads the whole file; records cross the ends of blocks, one of them several."""
    texts = [f"text {i} " + ("line\nbreak, \"\"quoted\"\"\r\n\n" * (i % 4)) + "x" * (i % 50) for i in range(400)]
    texts[200] = "first\n" + "many more lines\n" * 60 + "last"
    body = "".join(f'{i % 3},"{t}"\r\n' if i % 7 else f"{i % 3},plain {i}\n" for i, t in enumerate(texts)) + "\n1,end"
    write(tmp_path / "a.csv", body)
    write(tmp_path / "b.csv", '2,"a second file"\n\n0,\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = files.read_csv_rows(spark, str(tmp_path))
        got = sorted(rows(read, "line_no", "label", "text"))
        lines = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert lines > 20 or size == "100000"
    whole = []
    for name in ("a", "b"):
        one = spark.read.schema("label string, text string").options(quote='"', escape='"', multiLine=True).csv(
            str(tmp_path / f"{name}.csv"))
        whole += [tuple(r) for r in one.collect()]
    assert got == [(i, *r) for i, r in enumerate(whole)] and len(got) == 403


def test_quoted_csv(spark, tmp_path):
    write(tmp_path / "test.csv", '0,plain\n1,"comma, and ""quotes"""\n0,NA\n1,\n0,"two\nlines"\n')
    read = files.read_task(spark, str(tmp_path), "mr", "test").orderBy("guid")
    assert rows(read, "guid", "text_a", "label") == [
        ("test-0", "plain", "0"), ("test-1", 'comma, and "quotes"', "1"), ("test-2", None, "0"),
        ("test-3", None, "1"), ("test-4", "two\nlines", "0")]


def test_multilingual_files(spark, tmp_path):
    write(tmp_path / "XNLI-1.0/xnli.test.tsv",
          "h\nde\tneutral\t\t\t\t\tein\tsatz\nfr\tcontradictory\t\t\t\t\tune\tphrase\n")
    write(tmp_path / "XNLI-MT-1.0/multinli/multinli.train.de.tsv", "h\nein\tsatz\tcontradictory\n")
    test = files.read_multilingual(spark, str(tmp_path), "test", "fr")
    assert rows(test, "guid", "text_a", "text_b", "label") == [("test-2", "une", "phrase", "contradiction")]
    train = files.read_multilingual(spark, str(tmp_path), "train", "fr", "de")
    assert rows(train, "guid", "label") == [("train-1", "contradiction")]


def test_missing_text_is_an_error_in_strict_mode(spark):
    bad = spark.createDataFrame([("g", None, "b", "x")], "guid string, text_a string, text_b string, label string")
    assert rows(E.flag_types(bad, pair=True), "problem") == [("text_a is not a string",)]
    with pytest.raises(PySparkException, match="text_a is not a string"):
        E.require_types(bad, pair=True).collect()


def test_named_records(spark, tmp_path):
    spark.createDataFrame([(7, "q", "s", "entailment")], "idx int, question string, sentence string, label string"
                          ).write.parquet(str(tmp_path / "r"))
    read = files.read_records(spark, str(tmp_path / "r"), "qnli", "dev")
    assert rows(read, *EXAMPLE.names) == [("qnli", "dev", "7", "q", "s", "entailment")]


def test_questions(spark, tmp_path):
    answers = [{"text": "a", "answer_start": 3}, {"text": "b", "answer_start": 5}]
    data = {"data": [{"title": "t", "paragraphs": [{"context": "c", "qas": [
        {"id": "1", "question": "q1", "answers": answers},
        {"id": "2", "question": "q2", "is_impossible": True, "answers": []}]}]}]}
    path = write(tmp_path / "qa.json", json.dumps(data, indent=1))
    found = corpus.read_qa(spark, path).orderBy("qas_id")
    assert rows(found, "qas_id", "title", "answer_text", "answer_start", "is_impossible") == [
        ("1", "t", "a", 3, False), ("2", "t", None, None, True)]
    assert QA_ARTICLES.names == ["data"]


def test_corpus_by_name_then_by_path(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.range(3).write.parquet(path)
    spark.range(5).createOrReplaceTempView("known_corpus")
    assert corpus.open_corpus(spark, "known_corpus").count() == 5
    assert corpus.open_corpus(spark, path).count() == 3


def test_written_splits_read_back(spark, tmp_path):
    drawn = spark.createDataFrame([("b\t1", "1", 1), ("a\t0", "0", 2), ("c\t0", "0", 1)], "value string, label string, draw int")
    folder = splits.setting_folder(str(tmp_path), "k-shot", "sst-2", 2, 13)
    splits.write_split_tsv(drawn, folder, "sst-2", "train", "sentence\tlabel")
    assert folder.endswith("k-shot/sst-2/2-13")
    assert rows(files.read_task(spark, folder, "sst-2", "train").orderBy("guid"), "guid", "text_a", "label") == [
        ("train-1", "c", "0"), ("train-2", "a", "0"), ("train-3", "b", "1")]
    splits.write_split_csv(drawn.selectExpr("label", "concat(' ', value, '\"x') AS text", "draw"), folder, "train")
    assert rows(files.read_task(spark, folder, "mr", "train").orderBy("guid"), "text_a") == [
        (' c\t0"x',), (' a\t0"x',), (' b\t1"x',)]


def test_splits_as_folders(spark, tmp_path):
    data = spark.createDataFrame([("t", 2, s, p, f"{s}{p}") for s in (1, 2) for p in ("train", "dev")],
                                 "task string, k int, seed int, split string, guid string")
    splits.write_splits(data, str(tmp_path / "out"))
    one = spark.read.parquet(str(tmp_path / "out")).where("seed = 2 AND split = 'dev'")
    assert rows(one, "guid") == [("2dev",)]


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([("g", [1, 2], None)], "guid string, ids array<int>, text_b string")
    splits.write_json(df, str(tmp_path / "j"))
    [(value,)] = rows(spark.read.text(str(tmp_path / "j")), "value")
    assert json.loads(value) == {"guid": "g", "ids": [1, 2], "text_b": None}


def test_registry():
    assert len(SPLIT_TASKS) == 16 and set(SPLIT_TASKS) <= set(TASKS)
    assert task("MNLI").n_labels == 3 and task("mnli-mm").n_labels is None
    with pytest.raises(ValueError, match="unknown task"):
        task("nothing")


def test_label_ids(spark):
    examples = spark.createDataFrame([("snli", "neutral"), ("snli", None), ("snli", "odd")], "task string, label string")
    labels = label_table(spark, ["snli"])
    assert rows(LB.label_ids(examples, labels, strict=False).orderBy(F.desc("label")), "label", "label_id") == [
        ("odd", -1), ("neutral", 2), (None, None)]
    with pytest.raises(PySparkException, match="unknown label odd"):
        LB.label_ids(examples, labels).collect()


def test_text_helpers(spark):
    one = spark.range(1)
    null = F.lit(None).cast("string")
    assert rows(one, X.text_list(null, null), X.text_list(F.lit("a"), F.lit("b"))) == [([""], ["a", "b"])]
    assert rows(one, X.pair_text(F.lit("a"), null, "|"), X.pair_text(F.lit("a"), F.lit("b"), "|")) == [("a", "a | b")]
    assert rows(one, X.concat_fields(F.lit("a"), null, F.lit("c"))) == [("a c",)]
    assert rows(one, X.strip(F.lit(" \t a b \n"))) == [("a b",)]
    assert rows(one, L.label_word(F.lit("great")), L.label_word(F.lit("<mask>"))) == [(" great", "<mask>")]
    assert rows(one, F.round(L.from_log_probability(F.log(L.to_probability(F.lit(3.2)))), 9)) == [(3.2,)]
