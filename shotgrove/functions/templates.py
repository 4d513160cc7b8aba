"""Prompt templates compiled to column expressions.

A template is a list of parts between asterisks. It is read once on the driver; each part becomes an
expression, so rendering is an ordinary projection.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotgrove.functions import text as X
from shotgrove.tasks import CLS, EOS, MASK, SEP

# Part names.
_SPECIAL = {"cls": CLS, "mask": MASK, "sep": SEP, "sep+": SEP, "eos": EOS}
_SENTENCE = re.compile(r"(?P<space>\+?)sent(?P<form>-|l-|l|u|)_(?P<index>\d+)")
_RETRIEVED = re.compile(r"ret_(\d+)")


@dataclass(frozen=True)
class Part:
    kind: str            # "special", "sentence", "retrieved" or "literal"
    text: str = ""       # token or literal text
    index: int = 0       # sentence number
    form: str = ""       # "-" drops the last character, "l" / "u" change the case of the first
    space: bool = False  # put a space in front
    ends_segment: bool = False


def compile_template(template: str) -> list[Part]:
    parts = []
    for piece in template.split("*"):
        if piece == "":
            continue
        sentence, retrieved = _SENTENCE.fullmatch(piece), _RETRIEVED.fullmatch(piece)
        if piece in _SPECIAL:
            parts.append(Part("special", _SPECIAL[piece], ends_segment=piece == "sep+"))
        elif sentence:
            if sentence["space"] and "-" in sentence["form"]:
                raise ValueError(f"unknown sentence variant {piece!r}")
            parts.append(Part("sentence", index=int(sentence["index"]), form=sentence["form"],
                              space=bool(sentence["space"])))
        elif retrieved:
            parts.append(Part("retrieved", index=int(retrieved[1])))
        else:
            parts.append(Part("literal", piece.replace("_", " ")))
    return parts


def part_text(part: Part, texts: list[Column], retrieved: list[Column] | None = None) -> Column:
    """Text of one part. `retrieved[i]` holds the passages of sentence i, best first.

    Retrieved passages are shown worst first, so that the best stands next to what follows.
    """
    if part.kind in ("special", "literal"):
        return F.lit(part.text)
    if part.kind == "retrieved":
        if retrieved is None:
            return F.lit("")
        return F.coalesce(F.array_join(F.reverse(retrieved[part.index]), " "), F.lit(""))
    value = texts[part.index]
    if part.form.startswith("l"):
        value = X.lower_first(value)
    elif part.form.startswith("u"):
        value = X.upper_first(value)
    if part.form.endswith("-"):
        value = X.drop_last(value)
    return F.concat(F.lit(" "), value) if part.space else value


def part_tokens(part: Part, texts: list[Column], retrieved: list[Column] | None = None,
                first_limit: int | None = None, other_limit: int | None = None) -> Column:
    """Tokens of one part; only sentences are limited in length."""
    if part.kind == "special":
        return F.array(F.lit(part.text))
    if part.kind == "literal":
        return F.array(*[F.lit(t) for t in re.findall(r"[^\W_]+|[^\w\s]|_", part.text)])
    found = X.tokens(part_text(part, texts, retrieved))
    limit = first_limit if part.index == 0 else other_limit
    return F.slice(found, 1, limit) if part.kind == "sentence" and limit is not None else found


def segment_numbers(parts: list[Part]) -> list[int]:
    """Segment of every part: it grows after each part that ends a segment."""
    numbers, current = [], 0
    for part in parts:
        numbers.append(current)
        current += part.ends_segment
    return numbers


def render(template: str, texts: list[Column], retrieved: list[Column] | None = None) -> Column:
    """The whole prompt as text."""
    return F.concat(*[part_text(p, texts, retrieved) for p in compile_template(template)])
