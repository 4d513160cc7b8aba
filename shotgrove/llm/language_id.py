"""Language identification by compression.

One zstandard raw-content dictionary is made per language from labelled texts. The words of a text, in lower case and
without repeating the word before, are compressed with each of them; the dictionary that gives the fewest bytes names the language, and the lead over the second best, as a share
of the second best, is the score. A narrow lead is a rejection.

Defined results: NULL, empty and letterless texts are `und` with score 0 and rejected. Equal sizes go to the language
that sorts first, with score 0. Labelled rows with a NULL text or label teach nothing; with no labelled row at all
every text is `und`. Long texts are compressed whole, in blocks, so that a text never becomes its own dictionary.
Repeated rows get the same answer; further columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrove.llm.common import free_name, read, remainder
from shotgrove.operators.numbering import top_per_group

UNKNOWN = "und"

# The labelled sample: at most so many texts of a language, so many characters of each.
SAMPLE_TEXTS = 400
SAMPLE_CHARS = 700

LEVEL = 5
BLOCK_BYTES = 4096

# ASCII characters that are no letters become spaces.
_LETTERS_ONLY = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def word_bytes(text: str) -> bytes:
    """Lower-case words, one space around each, none twice in a row."""
    words = text.lower().encode("utf-8", "replace").translate(_LETTERS_ONLY).split()
    once = [b"", *(w for w, before in zip(words, [b"", *words]) if w != before), b""]
    return b" ".join(once)

# A lead below this share of the second best size is narrow.
MARGIN = 0.005

Dictionaries = dict[str, bytes]


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> Dictionaries:
    """Dictionaries from a bounded sample of the labelled rows: per language the texts with the lowest hash.

    The driver gets `sample_texts` x `sample_chars` characters per language, whatever the size of the table.
    """
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    rows = rows.where("t IS NOT NULL AND l IS NOT NULL").withColumn("h", F.xxhash64("k", "t"))
    start = F.pmod("h", F.greatest(F.length("t") - sample_chars, F.lit(0)) + 1) + 1
    rows = rows.select("l", "h", F.substring("t", start.cast("int"), F.lit(sample_chars)).alias("piece"))
    chosen = top_per_group(rows, ["l"], [F.col("h"), F.col("piece")], sample_texts, "rank", ["h"]).collect()
    pieces: dict[str, dict[str, None]] = {}
    for row in sorted(chosen, key=lambda r: (r["l"], r["rank"])):
        pieces.setdefault(row["l"], {})[row["piece"]] = None
    return {name: b"".join(map(word_bytes, texts)) for name, texts in pieces.items() if any(texts)}


class Classifier:
    """Compressors of all languages, made once per task."""

    def __init__(self, dictionaries: Dictionaries) -> None:
        self.names = sorted(dictionaries)
        self.compressors = []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content))
        self.plain = zstandard.ZstdCompressor(level=LEVEL)

    @staticmethod
    def _size(compressor: zstandard.ZstdCompressor, blocks: list[bytes]) -> int:
        return sum(len(compressor.compress(b)) for b in blocks)

    def answer(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        data = word_bytes(text)
        blocks = [data[i:i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        sizes = [self._size(c, blocks) for c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min([*sizes[:best], *sizes[best + 1:]], default=self._size(self.plain, blocks))
        return self.names[best], max(0.0, (second - sizes[best]) / second)


def identify(df: DataFrame, dictionaries: Dictionaries, text: str = "text", out: str = "language",
             margin: float = MARGIN) -> DataFrame:
    """Add the struct column `out` (lang, score, rejected). Only the text goes through Python."""

    @F.pandas_udf("lang string, score double, rejected boolean")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(dictionaries)
        for batch in batches:
            answers = [classifier.answer(t) for t in batch]
            yield pd.DataFrame({"lang": [a for a, _ in answers], "score": [s for _, s in answers],
                                "rejected": [a == UNKNOWN or s < margin for a, s in answers]})

    return df.withColumn(out, classify(F.col(text)))


def learning_rows(documents: DataFrame) -> DataFrame:
    """The rows a model may learn from; the others are held out."""
    return documents.where(remainder(F.col("doc_id"), 3) != 1)


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    found = identify(documents.select("doc_id", "text"), learn(learning_rows(documents)))
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"),
                        F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"),
                        F.col("language.rejected").alias("rejected"))


def keep_known(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pipeline stage: documents whose language is rejected go."""
    found = free_name(docs, "_language")
    return (identify(docs, learn(learning_rows(docs)), out=found)
            .where(~F.col(found)["rejected"]).select(*docs.columns))
