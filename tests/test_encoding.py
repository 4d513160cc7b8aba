import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shotgrove.functions.templates import compile_template, segment_numbers
from shotgrove.operators import encoding as N
from shotgrove.operators import labels as LB
from shotgrove.operators import vocab as V
from shotgrove.operators.neighbors import texts_by_sentence
from shotgrove.tasks import TASKS, verbalizer_table


def examples(spark, *texts):
    return spark.createDataFrame([("t", str(i), *t) for i, t in enumerate(texts)],
                                 "task string, guid string, text_a string, text_b string")


def prompt(spark, template, text_a, text_b=None, retrieved=None):
    return N.render_prompts(examples(spark, (text_a, text_b)), {"t": template}, retrieved).first()["prompt"]


@pytest.mark.parametrize("part, text", [
    ("sent_0", "Good film."), ("+sent_0", " Good film."), ("sent-_0", "Good film"), ("sentl_0", "good film."),
    ("+sentl_0", " good film."), ("sentl-_0", "good film"), ("sentu_0", "Good film."), ("+sentu_0", " Good film.")])
def test_sentence_variants(spark, part, text):
    assert prompt(spark, f"*{part}*", "Good film.") == text


def test_variants_at_the_edges(spark):
    assert prompt(spark, "*sentu_0*", "éa") == "Éa"
    assert prompt(spark, "*sentl_0*", "1 Up") == "1 Up"
    assert prompt(spark, "*sent-_0*|", "") == "|"
    assert prompt(spark, "*sent-_0*|", None) == "|"
    assert prompt(spark, "*sent_0**sent_1*", "a", None) is None
    with pytest.raises(ValueError):
        compile_template("*+sent-_0*")


def test_known_prompts(spark):
    assert prompt(spark, TASKS["sst-2"].template, "Fun") == "<s>Fun It was<mask>.</s>"
    assert prompt(spark, TASKS["mnli"].template, "A b.", "Cd") == "<s>A b?<mask>, cd</s>"
    assert prompt(spark, TASKS["trec"].template, "Who?") == "<s><mask>: Who?</s>"
    for spec in TASKS.values():
        if spec.template:
            assert sum(p.text == "<mask>" for p in compile_template(spec.template)) == 1


def test_retrieved_texts_are_shown_worst_first(spark):
    hits = spark.createDataFrame([("0", 0, 2, "worse"), ("0", 0, 1, "best"), ("0", 1, 1, "other")],
                                 "guid string, sent_id int, rank int, text string")
    joined = examples(spark, ("a", "b"), ("c", None)).join(texts_by_sentence(hits), "guid", "left")
    shown = N.render_prompts(joined, {"t": "*ret_0*/*ret_1*"}, [F.get("retrieved", F.lit(i)) for i in (0, 1)])
    assert [r["prompt"] for r in shown.orderBy("guid").collect()] == ["worse best/other", "/"]
    assert prompt(spark, "*ret_0*/*sent_0*", "a") == "/a"


def test_segments_grow_after_each_plus_separator():
    parts = compile_template("*cls**sent_0**sep+**sent_1**sep*x*sep+*y")
    assert segment_numbers(parts) == [0, 0, 0, 1, 1, 1, 1, 2]


def test_limits_bound_sentences_only(spark):
    got = N.prompt_tokens(examples(spark, ("a b c d", "e f g")), "*cls**sent_0*_one_two_three*sent_1*", 2, 1).first()
    assert got["_tokens"] == ["<s>", "a", "b", "one", "two", "three", "e"]


@pytest.mark.parametrize("head", [False, True])
@pytest.mark.parametrize("n", [2, 5, 8, 9, 20])
def test_fixed_length(spark, head, n):
    raw = N.prompt_tokens(examples(spark, ("a b c d", "e")), "*cls**sent_0**sep+**sent_1**mask*")
    tokens = ["<s>", "a", "b", "c", "d", "</s>", "e", "<mask>"]
    segments = [0] * 6 + [1] * 2
    got = N.fix_length(raw, n, truncate_head=head).first()
    if len(tokens) <= n:
        pad = n - len(tokens)
        want, seg = tokens + ["<pad>"] * pad, segments + [0] * pad
    elif head:
        want, seg = ["<s>"] + tokens[-(n - 1):], [0] + segments[-(n - 1):]
    else:
        want, seg = tokens[:n], segments[:n]
    assert (got["tokens"], got["segment_ids"]) == (want, seg)
    assert got["attention_mask"] == [1] * min(n, len(tokens)) + [0] * (n - len(tokens))
    assert got["mask_pos"] == (want.index("<mask>") if "<mask>" in want else -1)
    assert got["truncated"] == (len(tokens) > n)


def test_cut_off_mask_is_an_error_in_strict_mode(spark):
    features = N.fix_length(N.prompt_tokens(examples(spark, ("a b c", None)), "*sent_0**mask*"), 3)
    with pytest.raises(PySparkException, match="mask outside the length limit: 0"):
        N.require_mask(features).collect()


def test_plain_encoding(spark):
    got = N.fix_length(N.plain_tokens(examples(spark, ("a b", "c"), ("d", None), (None, None))), 6, prompt=False)
    kept = [(r["tokens"], r["segment_ids"]) for r in got.orderBy("guid").collect()]
    assert kept == [
        (["<s>", "a", "b", "</s>", "c", "</s>"], [0, 0, 0, 0, 1, 1]),
        (["<s>", "d", "</s>"] + ["<pad>"] * 3, [0] * 6), (["<s>", "</s>"] + ["<pad>"] * 4, [0] * 6)]
    assert "segment_ids" not in N.fix_length(N.plain_tokens(examples(spark, ("a", None))), 6, segments=False).columns


def vocabulary(spark, text):
    return V.build_vocab(spark.createDataFrame([(t,) for t in text.split()], "token string"))


@pytest.mark.parametrize("head", [0, 6, 8, 100])
def test_ids_do_not_depend_on_the_head_of_the_vocabulary(spark, head):
    words = V.stored_vocab(vocabulary(spark, "b a a c c c d"))
    assert {r["token"]: r["token_id"] for r in words.collect() if r["n"]} == {"c": 5, "a": 6, "b": 7, "d": 8}
    features = spark.createDataFrame([("x", ["d", "c", "zz", "a"]), ("y", ["c"] * 50)], "guid string, tokens array<string>")
    coded = V.encode_ids(features, words, head_rows=head)
    assert {r["guid"]: r["ids"] for r in coded.collect()} == {"x": [8, 5, 3, 6], "y": [5] * 50}
    texts = {r["guid"]: r["text"] for r in V.decode_ids(coded, words, head_rows=head).collect()}
    assert texts == {"x": "d c <unk> a", "y": " ".join(["c"] * 50)}


def test_span(spark):
    seq = spark.createDataFrame([(list("abcdef"),)], "tokens array<string>")
    assert V.span_query(seq, F.lit(1), F.lit(4)).first()["query"] == "b c d"


def test_label_words_have_to_be_one_token(spark):
    words = vocabulary(spark, "great terrible No Yes")
    got = LB.verbalize(verbalizer_table(spark, ["sst-2", "mnli"]), words).orderBy("task", "label")
    assert [(r["word"], r["problem"]) for r in got.collect()] == [
        ("No", ""), ("Yes", ""), ("Maybe", "not one token"), ("terrible", ""), ("great", "")]


def test_stats(spark):
    rows = N.fix_length(N.plain_tokens(examples(spark, ("a b c d e", None), ("a", None))), 5, prompt=False)
    got = N.token_stats(rows.withColumn("split", F.lit("train")), ["split"]).first()
    assert (got["n_rows"], got["n_tokens"], got["truncated_share"]) == (2, 8, 0.5)
    assert got["padding_share"] == pytest.approx(0.2)
