"""Spelling variants against a plain version."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shotgrove.llm import spelling
from tests.llm import rows as R

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def counts(rows, damaged):
    found = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(_LOW)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % damaged == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= 6:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 5}


def one_edit(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def expected(n_of):
    """The near words by leaving out one letter of either side, then a plain comparison."""
    cut = defaultdict(set)
    for w in n_of:
        for v in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            cut[v].add(w)
    near = {w: {x for v in {w} | {w[:i] + w[i + 1:] for i in range(len(w))} for x in cut[v]
                if x != w and one_edit(w, x)} for w in n_of}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n_of[x], x), default=None)
        form[w] = best if best is not None and n_of[best] >= 5 * n_of[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), n_of.get(form[w])) for w, n in n_of.items()}


def results(df):
    found = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("damaged,tile_words", [(199, 128), (3, 2)])
def test_documents(spark, folder, damaged, tile_words):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = expected(counts([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], damaged))
    assert results(spelling.variants(docs, damaged, tile_words)) == want
    assert sum(w[1] is not None for w in want) > 10


def test_awkward_words(spark):
    """Doubled letters, ends, letters beyond ASCII, long runs, chains of forms, ties and the signs among U+00C0 to U+00FF."""
    plan = {"letter": 700, "leter": 3, "lettter": 5, "letterr": 140, "lletter": 6, "letters": 28, "lettersx": 5, "betters": 28,
            "ärgerlich": 5, "Ärgerlich": 30, "argerlich": 30, "aaaaaa": 50, "aaaaaaa": 9, "aaaaaaaa": 6, "a" * 90: 5,
            "a" * 91: 40, "x" * 6 + "×" + "y" * 6: 6, "xxxxxxyyyyyy": 30, "z" * 300: 5, "z" * 150 + "y" + "z" * 149: 25}
    rows = [(i % 7 if i % 5 else None, " 中".join(w.upper() if w.isascii() and i % 2 else w for w in [word] * n), "x", "y")
            for i, (word, n) in enumerate(plan.items())]
    rows += [(99, None, "a", "b"), (100, "", "a", "b"), (101, "ĀĀ 12 !", "a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tile string, word string").repartition(3)
    want = expected(counts([r[:2] for r in rows], 199))
    for tile_words in (128, 2):
        assert results(spelling.variants(df, tile_words=tile_words)) == want
    assert {w[0]: w[2] for w in want}["lettersx"] == "letter"


def test_long_texts_in_slices(spark, monkeypatch):
    from shotgrove.llm import byte_runs

    monkeypatch.setattr(byte_runs, "SLICE_BYTES", 50)
    texts = [b"abcdef " * 40, b"x" * 200, b"", b"word letter \xc3\xa4\xc3\xb6\xc3\xbc\xc3\xa4\xc3\xb6\xc3\xbc!" * 9, b"short"]
    total = Counter()
    for values, n in spelling._words(texts, [1, 2, 3, None, 5], 7):
        total.update(dict(zip((v.decode() for v in values.to_pylist()), n.tolist())))
    plain = Counter()
    for key, text in zip([1, 2, 3, None, 5], texts):
        plain.update(counts([(key, text.decode())] * 5, 7))
    assert {w: 5 * n for w, n in total.items()} == plain


def test_empty(spark):
    empty = spark.createDataFrame([], R.SCHEMA)
    assert spelling.variants(empty).count() == 0
    few = spark.createDataFrame([(1, "onceonly twice")], "doc_id long, text string")
    assert spelling.variants(few).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abä", min_size=6, max_size=9), min_size=2, max_size=30, unique=True))
def test_tiles_find_single_edits(words):
    """The matrices of one tile with the whole word as its window."""
    import pyarrow as pa

    for long in {len(w) for w in words}:
        held = sorted(w for w in words if len(w) in (long, long - 1))
        n = len(held)
        table = pa.table({"word": held, "n": [5] * n, "size": [len(w) for w in held], "long": [long] * n, "low": [0] * n,
                          "high": [long] * n, "tile": [1] * n})
        got = set(zip(*(a.tolist() for a in spelling._tile_matches(table))))
        want = {(i, j) for i in range(n) for j in range(i + 1, n)
                if one_edit(held[i], held[j]) and long in (len(held[i]), len(held[j]))}
        assert got == want
