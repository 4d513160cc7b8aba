"""Raw rows to examples, and examples to queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotgrove.functions import labels as L
from shotgrove.functions import text as X
from shotgrove.tasks import TaskSpec, task as lookup


def _needed_fields(spec: TaskSpec) -> int:
    """Fewest fields with which a row can be read."""
    positions = [p for p in (spec.text_a, spec.text_b, spec.label, spec.guid) if p is not None and p >= 0]
    return max(positions) + 1


def without_header(lines: DataFrame, task: str) -> DataFrame:
    """Drop line 0 of tasks whose files have a header."""
    return lines.where(F.col("line_no") > 0) if lookup(task).header else lines


def _guid(split: str, suffix: Column) -> Column:
    return F.concat(F.lit(f"{split}-"), suffix.cast("string"))


def parse_lines(lines: DataFrame, task: str, split: str) -> DataFrame:
    """Lines `(value, line_no)` of a tab-separated file to examples.

    Rows with too few fields are dropped where the task says so, and fail the job elsewhere.
    """
    spec = lookup(task)
    stem = spec.files.get(split, split)
    fields = without_header(lines, task).select("line_no", X.split_line(F.col("value")).alias("f"))
    if spec.skip_short:
        fields = fields.where(F.size("f") >= _needed_fields(spec))

    def required(position: int) -> Column:
        return F.coalesce(X.field(F.col("f"), position), F.raise_error(F.concat(
            F.lit(f"{spec.name}: no field {position} in line "), F.col("line_no").cast("string"))))

    suffix = F.col("line_no") if spec.guid is None else required(spec.guid)
    return fields.select(
        F.lit(spec.name).alias("task"), F.lit(split).alias("split"), _guid(stem, suffix).alias("guid"),
        required(spec.text_a).alias("text_a"),
        (F.lit(None).cast("string") if spec.text_b is None else required(spec.text_b)).alias("text_b"),
        required(spec.label).alias("label"))


def short_lines(lines: DataFrame, task: str) -> DataFrame:
    """The lines that lack a needed field, with their number of fields."""
    return (without_header(lines, task)
            .select("line_no", F.size(X.split_line(F.col("value"))).alias("n_fields"))
            .where(F.col("n_fields") < _needed_fields(lookup(task))))


def parse_csv_rows(rows: DataFrame, task: str, split: str) -> DataFrame:
    """Rows `(label, text, line_no)` of a header-less csv file to examples."""
    spec = lookup(task)
    return rows.select(
        F.lit(spec.name).alias("task"), F.lit(split).alias("split"),
        _guid(spec.files.get(split, split), F.col("line_no")).alias("guid"),
        X.null_tokens(F.col("text")).alias("text_a"), F.lit(None).cast("string").alias("text_b"),
        F.col("label").cast("string").alias("label"))


# Where the multilingual files keep their fields.
MULTILINGUAL_TRAIN = {"text_a": 0, "text_b": 1, "label": 2}
MULTILINGUAL_TEST = {"lang": 0, "label": 1, "text_a": 6, "text_b": 7}


def parse_multilingual(lines: DataFrame, split: str, language: str | None = None) -> DataFrame:
    """Lines of a multilingual inference file; a test file holds all languages and is filtered."""
    positions = MULTILINGUAL_TEST if split == "test" else MULTILINGUAL_TRAIN
    fields = without_header(lines, "xnli").select("line_no", X.split_line(F.col("value")).alias("f"))
    value = {name: X.field(F.col("f"), position) for name, position in positions.items()}
    if split == "test":
        fields = fields.where(value["lang"] == language)
    return fields.select(
        F.lit("xnli").alias("task"), F.lit(split).alias("split"), _guid(split, F.col("line_no")).alias("guid"),
        value["text_a"].alias("text_a"), value["text_b"].alias("text_b"),
        L.normalize(value["label"]).alias("label"))


# Column names of records that already have named fields.
RECORD_NAMES = {
    "mrpc": ("sentence1", "sentence2"), "mnli": ("premise", "hypothesis"), "mnli-mm": ("premise", "hypothesis"),
    "cola": ("sentence", None), "sst-2": ("sentence", None), "sts-b": ("sentence1", "sentence2"),
    "qqp": ("question1", "question2"), "qnli": ("question", "sentence"), "rte": ("sentence1", "sentence2"),
    "wnli": ("sentence1", "sentence2"), "snli": ("premise", "hypothesis"),
    "mr": ("sentence", None), "sst-5": ("sentence", None), "subj": ("sentence", None),
    "trec": ("sentence", None), "cr": ("sentence", None), "mpqa": ("sentence", None),
}


def examples_from_records(records: DataFrame, task: str, split: str) -> DataFrame:
    """Records with the task's own column names, `idx` and `label`, to examples."""
    name_a, name_b = RECORD_NAMES[lookup(task).name]
    return records.select(
        F.lit(lookup(task).name).alias("task"), F.lit(split).alias("split"), F.col("idx").cast("string").alias("guid"),
        F.col(name_a).alias("text_a"),
        (F.col(name_b) if name_b else F.lit(None)).cast("string").alias("text_b"),
        F.col("label").cast("string").alias("label"))


def flag_types(examples: DataFrame, pair: bool = False) -> DataFrame:
    """Add `problem`: the first required field that is missing, or the empty string."""
    required = ["text_a", "text_b", "label"] if pair else ["text_a", "label"]
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c} is not a string")) for c in required]
    return examples.withColumn("problem", F.coalesce(*checks, F.lit("")))


def require_types(examples: DataFrame, pair: bool = False) -> DataFrame:
    """Fail the job at the first row with a missing text or label."""
    flagged = flag_types(examples, pair)
    guard = F.when(F.col("problem") != "", F.raise_error(F.concat_ws(": ", "guid", "problem")))
    return flagged.withColumn("label", F.coalesce(guard.cast("string"), F.col("label"))).drop("problem")


def explode_sentences(examples: DataFrame) -> DataFrame:
    """One query row per sentence of an example."""
    return examples.select(
        "task", "guid", F.posexplode(X.text_list(F.col("text_a"), F.col("text_b"))).alias("sent_id", "text"))


def adjacent_pairs(turns: DataFrame) -> DataFrame:
    """Every turn with the turn after it.

    The equi-join is on the unique key (conversation, turn), so a long conversation spreads over tasks.
    """
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_b"),
                       F.col("role").alias("label"))
    return turns.select("conv_id", "turn", F.col("text").alias("text_a")).join(nxt, ["conv_id", "turn"])
