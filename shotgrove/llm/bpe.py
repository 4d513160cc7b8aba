"""BPE encoding and decoding of whole texts by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never be merged: the text may be cut
there, and the fragments encoded one by one give the tokens of the whole. Of these pairs the ones are used where the
tokenizers' own word rules end a word as well (a cut inside a word would give its left part a word end): before white
space, and between a letter and an ASCII sign or digit if no token holds such a pair. Words with an apostrophe, and
texts with other letters or signs or with what may be a special token, are cut at white space only. Fragments repeat
a lot, so each distinct one is encoded once per worker.

Defined results: NULL and empty texts have no tokens. Repeated rows get the same answer, further columns are kept.
White space at either end, very long texts and texts without any forced boundary (one fragment) need no special care.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from shotgrove.llm.common import read

WHITE_SPACE = " \t\n\x0b\x0c\r"

# Distinct fragments that a worker remembers; about 400 bytes each. A full memory is emptied.
REMEMBERED = 250_000

# Characters whose fragments are looked up at once.
GROUP_CHARS = 1_000_000

# Without U+0130, whose lower case is a letter and a sign.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
SIGNS = "\x00-\x08\x0e-\x1f!-&(-@\\[-`{-\x7f"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, with their bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(0x100) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


def inner_pairs(tokens: Iterator[str], word_end: str) -> set[tuple[int, int]]:
    """Byte pairs that occur inside some token."""
    alphabet = byte_alphabet()
    pairs = set()
    for token in tokens:
        if word_end:
            token = token.removesuffix(word_end)
        values = [alphabet[c] for c in token if c in alphabet]
        pairs.update(zip(values, values[1:]))
    return pairs


def boundary_pattern(pairs: set[tuple[int, int]]) -> re.Pattern:
    """Finds the fragments between forced boundaries: a byte that is no white space, then white space."""
    cuts = []
    for space in WHITE_SPACE:
        open_left = {a for a, b in pairs if b == ord(space)} - {ord(s) for s in WHITE_SPACE}
        if any(a >= 0x80 for a in open_left):
            continue
        stay = "".join(re.escape(chr(a)) for a in sorted(open_left)) + re.escape(WHITE_SPACE)
        cuts.append(f"(?<=[^{stay}]){re.escape(space)}")
    return re.compile("|".join(cuts) if cuts else r"(?!)")


class Codec:
    """One tokenizer file; encodes and decodes texts by fragments."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        settings = json.loads(Path(path).read_text())
        pairs = inner_pairs(settings["model"]["vocab"], settings["model"].get("end_of_word_suffix") or "")
        spaces = {ord(s) for s in WHITE_SPACE}
        # White space that no token holds and that has no tokens of its own is left out of the fragments.
        self.drops_space = (not any(a in spaces or b in spaces for a, b in pairs)
                            and not any(self.tokenizer.encode(s, add_special_tokens=False).ids for s in WHITE_SPACE))
        self.words = re.compile(f"[^{WHITE_SPACE}]+")
        sides = {a for a, b in pairs if chr(b).isascii() and chr(b).isalpha() != chr(a).isalpha()
                 and ord("'") not in (a, b) and a < 0x80}
        self.cuts_signs = self.drops_space and not sides
        self.parts = re.compile(f"[^{WHITE_SPACE}']*'[^{WHITE_SPACE}]*|[{LETTERS}]+|[{SIGNS}]+")
        self.other = re.compile(rf"[^\x00-\x7f{LETTERS}]|<\|")
        self.cut = boundary_pattern(pairs)
        self.glue = " " if settings.get("decoder") is None else ""
        self.remembered = remembered
        self.ids: dict[str, str] = {}
        self.counts: dict[str, int] = {}
        self.decoded: dict[str, str] = {}

    def fragments(self, text: str) -> list[str]:
        if self.cuts_signs and not self.other.search(text):
            return self.parts.findall(text.encode().lower().decode())
        if self.drops_space:
            return self.words.findall(text)
        starts = [0, *(m.start() for m in self.cut.finditer(text)), len(text)]
        return [text[a:b] for a, b in zip(starts, starts[1:]) if b > a]

    def learn(self, fragments: set[str]) -> None:
        """Encode and decode the fragments not met before."""
        new = sorted(fragments - self.ids.keys())
        if len(self.ids) + len(new) > self.remembered:
            self.ids, self.counts, self.decoded = {}, {}, {}
            new = sorted(fragments)
        for start in range(0, len(new), 10_000):
            part = new[start:start + 10_000]
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            for fragment, ids, text in zip(part, encoded,
                                           self.tokenizer.decode_batch(encoded, skip_special_tokens=False)):
                self.ids[fragment] = " ".join(map(str, ids))
                self.counts[fragment] = len(ids)
                self.decoded[fragment] = text

    def pieces(self, texts: Iterable[str | None]) -> Iterator[tuple[int, str, str]]:
        """For each text the number of tokens, the ids as numbers joined by spaces, and the decoded text."""
        group: list[list[str]] = []
        chars = 0
        for text in texts:
            group.append(self.fragments(text or ""))
            chars += len(text or "")
            if chars >= GROUP_CHARS:
                yield from self._joined(group)
                group, chars = [], 0
        yield from self._joined(group)

    def _joined(self, group: list[list[str]]) -> Iterator[tuple[int, str, str]]:
        self.learn(set().union(*group))
        for parts in group:
            n = sum(map(self.counts.__getitem__, parts))
            kept = [p for p in parts if self.counts[p]]  # characters without tokens leave no gap
            yield (n, " ".join(map(self.ids.__getitem__, kept)),
                   self.glue.join(map(self.decoded.__getitem__, kept)))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The worker's codec; it lives as long as the worker."""
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(df: DataFrame, path: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the token ids of the whole text."""
    path = path or default_path()

    @F.pandas_udf(ArrayType(LongType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path)
        for batch in batches:
            yield pd.Series([[int(i) for i in ids.split()] for _, ids, _ in own.pieces(batch)])

    return df.withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of the token ids, special tokens included; NULL ids give the empty text."""
    path = path or default_path()

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path).tokenizer
        for batch in batches:
            lists = [[] if i is None else [int(x) for x in i] for i in batch]
            yield pd.Series([own.decode(i, skip_special_tokens=False) for i in lists])

    return df.withColumn(out, texts(F.col(ids)))


def digests(df: DataFrame, path: str | None = None, text: str = "text", out: str = "bpe") -> DataFrame:
    """Add a struct with the number of tokens and digests of the ids and of the decoded text."""
    path = path or default_path()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for batch in batches:
            rows = [(n, hashlib.sha256(ids.encode()).hexdigest(),
                     hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest())
                    for n, ids, decoded in own.pieces(batch)]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return df.withColumn(out, digest(F.col(text)))


def _report(documents: DataFrame) -> DataFrame:
    found = digests(documents.select("doc_id", "text"))
    return found.select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return _report(read(spark, folder, "documents"))


def encode_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: token counts and digests of the documents that are left."""
    return _report(docs)
