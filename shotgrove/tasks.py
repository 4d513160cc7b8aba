"""What is known about each task: file layout, labels, metrics, prompt."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class TaskSpec:
    name: str
    fmt: str                      # "tsv", "csv" or "json"
    text_a: int | None = None     # field positions from 0; -1 is the last field
    text_b: int | None = None
    label: int | None = None
    guid: int | None = None       # None: the row number is the id
    header: bool = True
    skip_short: bool = False      # drop rows with too few fields instead of failing
    labels: tuple[str, ...] = ()
    words: dict[str, str] = field(default_factory=dict)
    template: str | None = None
    max_length: int = 128
    first_limit: int | None = None
    other_limit: int | None = None
    mode: str = "classification"
    metric: str | None = "accuracy"
    n_labels: int | None = None
    files: dict[str, str] = field(default_factory=lambda: {"train": "train", "dev": "dev", "test": "test"})


# Templates, label words, label orders, column positions and limits.
_WAS = "*cls**sent_0*_It_was*mask*.*sep+*"
_IS = "*cls**sent_0*_This_is*mask*.*sep+*"
_PAIR = "*cls**sent_0**mask*,*+sentl_1**sep+*"
_PAIR_QUESTION = "*cls**sent-_0*?*mask*,*+sentl_1**sep+*"
_ASK = "*cls**mask*:*+sent_0**sep+*"

_NLI = ("contradiction", "entailment", "neutral")
_ENTAIL = ("entailment", "not_entailment")
_BINARY = ("0", "1")

_NO_YES = {"0": "No", "1": "Yes"}
_NO_YES_MAYBE = {"contradiction": "No", "entailment": "Yes", "neutral": "Maybe"}
_NOT_YES = {"not_entailment": "No", "entailment": "Yes"}
_BAD_GOOD = {"0": "terrible", "1": "great"}
_FIVE = {"0": "terrible", "1": "bad", "2": "okay", "3": "good", "4": "great"}
_KINDS = {"0": "Description", "1": "Entity", "2": "Expression", "3": "Human", "4": "Location", "5": "Number"}

_MATCHED = {"train": "train", "dev": "dev_matched", "test": "test_matched"}
_MISMATCHED = {"train": "train", "dev": "dev_mismatched", "test": "test_mismatched"}


def _csv(name: str, words: dict[str, str], template: str, first: int, other: int | None = None) -> TaskSpec:
    return TaskSpec(name, "csv", text_a=1, label=0, header=False, labels=tuple(words), n_labels=len(words),
                    words=words, template=template, first_limit=first, other_limit=other)


TASKS: dict[str, TaskSpec] = {spec.name: spec for spec in [
    TaskSpec("mrpc", "tsv", 3, 4, 0, labels=_BINARY, n_labels=2, words=_NO_YES, template=_PAIR, metric="acc_and_f1"),
    TaskSpec("mnli", "tsv", 8, 9, -1, 0, labels=_NLI, n_labels=3, words=_NO_YES_MAYBE, template=_PAIR_QUESTION,
             max_length=256, files=_MATCHED),
    TaskSpec("mnli-mm", "tsv", 8, 9, -1, 0, labels=_NLI, words=_NO_YES_MAYBE, template=_PAIR_QUESTION,
             max_length=256, files=_MISMATCHED),
    TaskSpec("cola", "tsv", 3, None, 1, header=False, labels=_BINARY, n_labels=2,
             words={"0": "incorrect", "1": "correct"}, template=_IS, metric="matthews"),
    TaskSpec("sst-2", "tsv", 0, None, 1, labels=_BINARY, n_labels=2, words=_BAD_GOOD, template=_WAS),
    TaskSpec("sts-b", "tsv", 7, 8, -1, 0, n_labels=1, words=_NO_YES, template=_PAIR,
             mode="regression", metric="pearson_spearman"),
    TaskSpec("qqp", "tsv", 3, 4, 5, 0, skip_short=True, labels=_BINARY, n_labels=2, words=_NO_YES,
             template=_PAIR, metric="acc_and_f1"),
    TaskSpec("qnli", "tsv", 1, 2, -1, 0, labels=_ENTAIL, n_labels=2, words=_NOT_YES, template=_PAIR_QUESTION),
    TaskSpec("rte", "tsv", 1, 2, -1, 0, labels=_ENTAIL, n_labels=2, words=_NOT_YES, template=_PAIR_QUESTION,
             max_length=256, first_limit=240),
    TaskSpec("wnli", "tsv", 1, 2, -1, 0, labels=_BINARY, n_labels=2),
    TaskSpec("snli", "tsv", 7, 8, -1, 0, labels=_NLI, n_labels=3, words=_NO_YES_MAYBE, template=_PAIR_QUESTION,
             max_length=256),
    _csv("mr", _BAD_GOOD, _WAS, 110, 50),
    _csv("sst-5", _FIVE, _WAS, 110, 20),
    _csv("subj", {"0": "subjective", "1": "objective"}, _IS, 110, 50),
    _csv("trec", _KINDS, _ASK, 110),
    _csv("cr", _BAD_GOOD, _WAS, 110, 50),
    _csv("mpqa", _BAD_GOOD, _WAS, 110),
    TaskSpec("xnli", "tsv", 0, 1, 2, labels=_NLI, n_labels=3),
    TaskSpec("squadv1", "json", mode="generation", metric=None),
    TaskSpec("squadv2", "json", mode="generation", metric=None),
]}

SPLIT_TASKS = ("mrpc", "mnli", "cola", "sst-2", "sts-b", "qqp", "qnli", "rte", "wnli", "snli",
               "mr", "sst-5", "subj", "trec", "cr", "mpqa")
SEEDS = (13, 21, 42, 87, 100)
SHOTS = 16
TOP_K = 64
NPROBE = 512
QUERY_BATCH = 32

MEDIANS = {"sts-b": 2.5}
BOUNDS = {"sts-b": (0.0, 5.0)}

CLS, SEP, MASK, EOS, PAD, UNK = "<s>", "</s>", "<mask>", "</s>", "<pad>", "<unk>"
SPECIAL_TOKENS = (CLS, PAD, SEP, UNK, MASK)
# End of fixed values.


def task(name: str) -> TaskSpec:
    """The registered task; an unknown name is an error."""
    try:
        return TASKS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown task {name!r}; known: {', '.join(TASKS)}") from None


def registry_table(spark: SparkSession) -> DataFrame:
    """The registry as a table with one row per task."""
    rows = [
        (s.name, s.fmt, s.n_labels, s.mode, s.metric, MEDIANS.get(s.name),
         *(BOUNDS.get(s.name, (None, None))), s.max_length)
        for s in TASKS.values()
    ]
    return spark.createDataFrame(
        rows, "task string, fmt string, n_labels int, mode string, metric string, "
              "median double, lower_bound double, upper_bound double, max_length int")


def label_table(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """One row per task and class; `label_id` is the position in the task's label list."""
    rows = [(s.name, label, i)
            for s in TASKS.values() if names is None or s.name in names
            for i, label in enumerate(s.labels)]
    return spark.createDataFrame(rows, "task string, label string, label_id int")


def verbalizer_table(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    rows = [(s.name, label, word)
            for s in TASKS.values() if names is None or s.name in names
            for label, word in s.words.items()]
    return spark.createDataFrame(rows, "task string, label string, word string")
