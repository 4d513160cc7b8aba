"""Reversed search against a plain version."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from shotgrove.llm import lexical
from tests.llm import rows as R

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms(text):
    return TERM.findall((text or "").encode().lower())


def expected(docs, items, k=10):
    counts = [(key, Counter(terms(text))) for key, text in docs]
    counts = [(key, c, sum(c.values())) for key, c in counts if c]
    N, L = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for key, text in items:
        asked.setdefault(key, set()).update(terms(text))
    rows = []
    for key, wanted in asked.items():
        w = {t: math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) for t in wanted if df[t]}
        scored = []
        for doc, c, n in counts:
            m = 10 + 90 * n * N // L
            score = sum(w[t] * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in w if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc))
        scored.sort()
        rows += [(key, i + 1, doc, -s) for i, (s, _, doc) in enumerate(scored[:k])]
    return sorted(rows, key=str)


def results(df):
    assert dict(df.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_awkward_rows(spark):
    docs = R.with_clashes(R.documents(spark)).withColumn("item", F.lit(1)).withColumn("counts", F.lit("x"))
    items = [(1, "one TWO three w5 w7"), (2, None), (3, ""), (4, "unknown words only"), (5, "Übergröße GRÖSSE it s"), (5, "a b"),
             (None, "a thirteen"), (None, "123"), (6, "one one one"), (7, "中 \U0001f600")]
    asked = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, term string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = expected(rows, items)
    assert results(lexical.search(docs, asked)) == want
    assert results(lexical.search(docs, asked, index_pairs=3)) == want  # several blocks
    assert results(lexical.search(docs, asked, k=2)) == expected(rows, items, 2)


def test_ties_over_many_tasks(spark):
    rng = np.random.default_rng(1)
    docs = [(int(i), " ".join(rng.choice(["red", "blue", "green", "grey"], 3))) for i in rng.permutation(500)]
    items = [(i, w) for i, w in enumerate(["red blue", "green", "grey red green", "blue blue"])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(16)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert results(lexical.search(df, asked)) == expected(docs, items)


def test_heaps_keep_the_best():
    rng = np.random.default_rng(2)
    heaps, rows = lexical.Heaps(5, 3), []
    for first in range(0, 200, 7):
        scores = rng.integers(0, 6, (7, 5))
        ids = rng.permutation(1000)[:7]
        unnamed = rng.random(7) < 0.1
        heaps.update(scores, ids, unnamed)
        rows += [(item, -int(scores[r, item]), bool(unnamed[r]), int(ids[r])) for r in range(7) for item in range(5)
                 if scores[r, item] > 0]
    want = [x for item in range(5) for x in sorted(r for r in rows if r[0] == item)[:3]]
    assert sorted(zip(heaps.item.tolist(), (-heaps.score).tolist(), heaps.unnamed.tolist(), heaps.doc.tolist())) == want


def test_empty(spark):
    docs, items = R.documents(spark), spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.where("text IS NULL"), items).count() == 0
