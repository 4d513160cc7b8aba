"""Packed sequences: limits, whole coverage, and ids against the tokenizers library."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from shotgrove.llm import packing
from shotgrove.llm.bpe import default_path
from shotgrove.llm.packing import Limits
from shotgrove.llm.token_ids import WordIds
from tests.llm import rows as R


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(default_path())
    own.no_truncation()
    own.no_padding()
    return lambda text: own.encode(text or "", add_special_tokens=False).ids + [1]


def check_sequences(rows, limits):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == limits.tokens or at & (at - 1) == 0
        assert at <= limits.tokens and len(pieces) <= limits.segments
        assert sum(r.loss_tokens for r in pieces) <= limits.loss
    return by_sequence


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 3, 64), Limits(2048, 64, 500)])
def test_documents(spark, folder, library, limits):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    ids = {r.doc_id: library(r.text) for r in docs.collect()}
    rows = packing.pack_documents(docs, limits).collect()
    sequences = check_sequences(rows, limits)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert pieces.keys() == ids.keys()
    for key, found in pieces.items():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            own = np.asarray(ids[key][at:at + r.length], dtype="<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids[key]), zlib.crc32(own.tobytes()))
            at += r.length
        assert at == len(ids[key])
    if limits == Limits():  # few sequences, few cuts
        total = sum(map(len, ids.values()))
        assert len(sequences) <= total / 2048 + 11 * docs.rdd.getNumPartitions()
        assert len(rows) <= len(ids) + total / 2048 + 11 * docs.rdd.getNumPartitions()


def test_awkward_documents(spark, library):
    docs = R.with_clashes(R.documents(spark)).withColumn("ids", R.F.lit("x")).withColumn("start", R.F.lit("y"))
    rows = packing.pack_documents(docs).collect()
    check_sequences(rows, Limits())
    want = defaultdict(int)
    for r in docs.collect():
        want[r.doc_id] += len(library(r.text))
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_instruction_data(spark):
    """All three limits bind; loss is counted by the marks of each example."""
    rng = np.random.default_rng(3)
    data = []
    for key in range(400):
        n = int(rng.integers(0, 300))
        ids = rng.integers(0, 1000, n).tolist()
        data.append((key, ids, None if key % 11 == 0 else (rng.random(n) < rng.random()).tolist()))
    data += [(1000, None, None), (None, [7] * 5, [False] * 5), (1001, [3] * 1000, [True] * 1000)]
    limits = Limits(256, 4, 90)
    df = spark.createDataFrame(data, "doc_id long, ids array<int>, loss array<boolean>").repartition(2)
    rows = packing.pack_examples(df, limits).collect()
    check_sequences(rows, limits)
    by_key = {d[0]: d for d in data}
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    for key, (_, ids, loss) in by_key.items():
        at = 0
        for r in sorted(got[key], key=lambda r: r.start):
            part = slice(at, at + r.length)
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.asarray(ids[part], dtype="<u4").tobytes())
            assert r.loss_tokens == (r.length if loss is None else sum(loss[part]))
            at += r.length
        assert at == len(ids or [])
    with pytest.raises(ValueError):
        Limits(loss=0)


def test_dot_product_choice():
    """Loss is scarce: the sequence takes what uses most of it, not the longest piece."""
    limits = Limits(100, 10, 10)
    packer = packing.Packer(limits, 0)
    ids = np.arange(60, dtype=np.int32)
    for key, loss in ((1, 1), (2, 9)):
        packer.add(packing.Example(key, ids[:50 + 2 * (key == 1)], np.arange(50 + 2 * (key == 1)) < loss))
    assert packer.pool.pieces[packer.pool.best(100, 10, limits)][-1][0].key == 2
    packer.pack(0)
    assert {r[0] for r in packer.rows} == {1, 2}


def test_word_ids_like_the_library(library):
    """Random strings of letters, signs, white space and special tokens."""
    rng = np.random.default_rng(5)
    alphabet = list("aAbBeE '.,-0123\t\n\x0b\r\x00İäßΣσ́  中\U0001f600'") + [
        "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "ẞ", "fiﬁ"]
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 25)))) for _ in range(3000)]
    own = WordIds(default_path(), remembered=500)
    found = list(own.encode([t.encode() for t in texts]))
    assert [i for i, _ in found] == list(range(len(texts)))
    assert [ids.tolist() for _, ids in found] == [library(t)[:-1] for t in texts]


def test_long_texts_in_slices(library, monkeypatch):
    from shotgrove.llm import byte_runs

    monkeypatch.setattr(byte_runs, "SLICE_BYTES", 64)
    texts = ["a short one", "word and more words, " * 30, "x" * 300 + " end", "", "last"]
    found = dict(WordIds(default_path()).encode([t.encode() for t in texts]))
    assert {i: v.tolist() for i, v in found.items()} == {i: library(t)[:-1] for i, t in enumerate(texts)}


def test_merges_like_the_library(library):
    """Random plain words, of frequent and of rare pairs, up to the longest that merges take."""
    from shotgrove.llm.byte_merges import MAX_BYTES, Merges, plain_bytes

    rng = np.random.default_rng(7)
    words = set()
    for letters in ("abcdefghijklmnopqrstuvwxyz", "etaoinshr", "aäeéoöuüßñçþÿ", "al"):
        words |= {"".join(rng.choice(list(letters), int(rng.integers(1, 16)))) for _ in range(2000)}
    words = sorted(w for w in words if len(w.encode()) <= MAX_BYTES)
    data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
    assert plain_bytes(data).all()
    sizes = np.array([len(w.encode()) for w in words])
    ids, counts = Merges(default_path()).apply(data, np.cumsum(sizes) - sizes, sizes)
    found = np.split(ids, np.cumsum(counts)[:-1])
    assert [f.tolist() for f in found] == [library(w)[:-1] for w in words]
