"""Small documents with the awkward cases, and readers of words."""

import re

from pyspark.sql import functions as F  # noqa: F401

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORDS.findall((text or "").encode().lower())


def shingles(text):
    w = words(text)
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def documents(spark):
    """NULLs in every column, empty and very long texts, repeated rows, copies and near copies."""
    long = " ".join(f"w{i * 7919 % 4001}" for i in range(6000))
    near = long.replace(" w7 ", " changed ")
    short = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, long, "en", "a", 1), (2, near, "en", "a", 1), (3, long, "en", "a", 1), (4, None, None, None, None),
            (5, "", "de", "a", 0), (6, short, "de", "b", 3), (7, short.upper(), "de", "b", 3),
            (8, short + " thirteen", "de", "b", 3), (9, "a b", "de", "b", 3), (10, "A\tB ", "de", "b", 3),
            (11, " \n\t ", "de", "b", 3), (12, "123 456", "fr", "b", 7), (None, short, "en", "c", 1),
            (13, "Übergröße ﬁn ́x \U0001f600 it's", "de", "c", 1), (14, long, "en", "a", 1), (14, long, "en", "a", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(df):
    """Further columns with the names that operators use inside."""
    extra = ("n", "h", "bits", "lowest", "prefix", "digest", "list", "language", "component", "row", "kinds",
             "_new", "_between", "_private", "_language", "_gone_id", "_kept_id", "_gone_digest", "_id", "_digest")
    for name in extra:
        df = df.withColumn(name, df["source"])
    return df


def saved(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
