"""Label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotgrove.functions import text as X
from shotgrove.tasks import BOUNDS, MEDIANS


def normalize(label: Column) -> Column:
    """The long spelling of one inference label is folded into the common one."""
    return F.when(label == "contradictory", "contradiction").otherwise(label)


def binarize(score: Column, median: float = MEDIANS["sts-b"]) -> Column:
    """Class of a score, used only for balanced sampling."""
    return F.when(score.cast("double") < median, 0).otherwise(1)


# Where the label stands in a raw line, by task.
RAW_LABEL_POSITION = {"cola": 1, "mrpc": 0}


def raw_line_label(task: str, line: Column, halves: bool = True) -> Column:
    """Label of a raw line for sampling; a score is replaced by its half, unless `halves` is off.

    The line is stripped before it is split, so trailing empty fields vanish; the readers keep them.
    """
    label = X.field(X.split_line(X.strip(line)), RAW_LABEL_POSITION.get(task, -1))
    return binarize(label).cast("string") if halves and task in MEDIANS else label


def to_probability(score: Column, bounds: tuple[float, float] = BOUNDS["sts-b"]) -> Column:
    """Share of the high class for a bounded score; the low class has the rest."""
    low, high = bounds
    return (score - F.lit(low)) / F.lit(high - low)


def from_log_probability(log_high: Column, bounds: tuple[float, float] = BOUNDS["sts-b"]) -> Column:
    """Bounded score from the log-probability of the high class."""
    low, high = bounds
    return F.exp(log_high) * F.lit(high - low) + F.lit(low)


def label_word(word: Column) -> Column:
    """Label word as it appears in running text: with a leading space unless it opens with < [ . or ,"""
    return F.when(F.substring(word, 1, 1).isin("<", "[", ".", ","), word).otherwise(F.concat(F.lit(" "), word))
