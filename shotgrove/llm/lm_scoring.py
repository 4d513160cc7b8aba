"""Log-bilinear language model with noise-contrastive estimation, and scores of whole texts.

Words fall into classes: the most frequent words are classes of their own, the others share a class by their last
bytes, and the end of a text is one more. The number of classes grows with the cube root of the vocabulary. The
network predicts the class of a token from the two classes before it: context vectors times position matrices give a
predicted vector, its products with the class vectors plus biases give the logits. A word's share of its class is its
share of the counts.

    log10 P(word | before) = log10(1 - e) + log10 P(class | before) + log10(count / count of the class)
    log10 P(unseen)        = log10 e,   e = (words seen once + 0.5) / (tokens + 1)

so the probabilities of all seen tokens and of "unseen" add up to one.

What is gathered covers every training text: word counts, and counts of class triples, which stay a table. Training
passes over all triples several times, weighted by their counts. In a pass each task starts from the same weights and
goes through its shards of triples in numpy, by noise-contrastive estimation; the weights of all shards are then
averaged by the tokens they stand for, by Spark, and only the average reaches the driver. Shards are made by the hash
of the triple and sorted, so that a repeated task gives the same weights. For scoring, Spark works out the normaliser
of every context by batched matrix products. It and the model are broadcast, with about 47 bytes times the vocabulary to
the power of two thirds. Scoring takes the counts of the most frequent words from a broadcast of at most `HEAD_WORDS`
rows; all others are joined by shuffle.

Defined results: NULL and empty texts are one end token. A text is scored whole, however long. Rows without an id are
training rows; repeated rows count as often as they occur and get a score each. Without training rows every token is
unseen. An empty table gives an empty result. Words are told apart by 64-bit hashes. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotgrove.llm.common import read, remainder
from shotgrove.llm.shingle_sets import groups, text_bytes, word_hashes
from shotgrove.session import materialize

HEAD_WORDS = 500_000

SIZE = 24
NOISE = 32
BATCH = 4096
PASSES = 6
RATE = 0.15
SHARD_TRIPLES = 1 << 20
HEAVIEST = 4  # a triple with more than so many times the mean count is seen in several parts
BLOCK_VALUES = 8192


def class_numbers(distinct: int) -> tuple[int, int]:
    """(words that are classes of their own, classes shared by the others) for a vocabulary."""
    own = max(64, round(2.5 * distinct ** (1 / 3)))
    return own, own * 3 // 8


def word_ends(texts: list[bytes]) -> np.ndarray:
    """A number of 20 bits for every word from its last three bytes, A-Z lowered."""
    data = np.frombuffer(b"   " + b" ".join(texts).lower() + b" ", dtype=np.uint8)
    space = np.isin(data, [0x20, *range(0x09, 0x0E)])
    ends = np.flatnonzero(space[1:] & ~space[:-1])  # places of last bytes
    last, middle, first = (data[ends - k].astype(np.uint32) for k in range(3))
    outside = space[ends - 1]
    middle = np.where(outside, 0, middle)
    first = np.where(outside | space[ends - 2], 0, first)
    mixed = (first * 65599 + middle) * 65599 + last
    return ((mixed ^ (mixed >> 15)) * np.uint32(0x2C1B3C6D) >> np.uint32(12)).astype(np.int32)


def words_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """For groups of texts: word hashes, word ends, each word's text number in the group, number of texts."""
    texts = text_bytes(column)
    for a, b in groups(texts, len):
        hashes, begins = word_hashes(texts[a:b])
        owner = np.repeat(np.arange(b - a), np.diff(begins))
        yield hashes.view(np.int64), word_ends(texts[a:b]), owner, b - a


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each batch with their ends and counts."""
    for batch in batches:
        parts = list(words_of(batch.column("text")))
        if not parts:
            continue
        words, at, count = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_counts=True)
        ends = np.concatenate([p[1] for p in parts])[at]
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(ends), pa.array(count.astype(np.int64))],
                                         names=["word", "ending", "n"])


@dataclass
class Counts:
    """What scoring needs to know of the training texts."""

    words: np.ndarray        # sorted hashes of the frequent words
    numbers: np.ndarray      # their counts
    classes: np.ndarray      # their classes
    class_counts: np.ndarray
    texts: int
    tokens: int
    distinct: int
    unseen: float            # probability of an unseen word
    own: int
    shared: int

    @property
    def end(self) -> int:
        return self.own + self.shared

    @property
    def start(self) -> int:
        """The class before the first token; never predicted."""
        return self.own + self.shared + 1

    def look_up(self, words: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(is it in the head, count or 0, class) of each word."""
        others = endings % self.shared + self.own
        if not len(self.words):
            return np.zeros(len(words), bool), np.zeros(len(words), np.int64), others
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        found = self.words[at] == words
        return (found, np.where(found, self.numbers[at], 0),
                np.where(found, self.classes[at], others))


def count_words(training: DataFrame) -> DataFrame:
    """(word, ending, n) over all training texts."""
    return (training.select("text").mapInArrow(_counted, "word long, ending int, n long").groupBy("word")
            .agg(F.min("ending").alias("ending"), F.sum("n").alias("n")))


def gather(vocabulary: DataFrame, texts: int, head_words: int = HEAD_WORDS) -> tuple[Counts, int]:
    """The counts, and the least count of a word in the head. `vocabulary` is a written table."""
    binned = F.floor(F.log2("n") * 8).cast("int")
    bins = vocabulary.groupBy(binned.alias("bin")).agg(
        F.count("*").alias("types"), F.sum("n").alias("tokens"), F.min("n").alias("least"),
        F.sum((F.col("n") == 1).cast("long")).alias("once")).orderBy(F.desc("bin")).collect()
    least, taken = 1 << 62, 0
    for row in bins:  # at most some hundred
        if taken + row["types"] > head_words:
            break
        taken, least = taken + row["types"], row["least"]
    head = vocabulary.where(F.col("n") >= least).toArrow()
    words, numbers, endings = (np.asarray(head.column(c)) for c in ("word", "n", "ending"))
    n_own, n_shared = class_numbers(sum(r["types"] for r in bins))
    own = np.lexsort((words, -numbers))[:n_own]
    classes = (endings % n_shared + n_own).astype(np.int32)
    class_counts = np.zeros(n_own + n_shared + 1, dtype=np.int64)
    by_class = vocabulary.groupBy((F.col("ending") % n_shared).alias("shared")).agg(F.sum("n").alias("n"))
    for row in by_class.collect():  # one row per shared class
        class_counts[n_own + row["shared"]] = row["n"]
    np.subtract.at(class_counts, classes[own], numbers[own])
    classes[own] = np.arange(len(own))
    class_counts[:len(own)] = numbers[own]
    class_counts[-1] = texts
    tokens = sum(r["tokens"] for r in bins) + texts
    once = sum(r["once"] for r in bins) + (texts == 1)
    order = np.argsort(words)
    return Counts(words[order], numbers[order], classes[order], class_counts, texts, tokens,
                  sum(r["types"] for r in bins) + (texts > 0), (once + 0.5) / (tokens + 1), n_own, n_shared), least


def sequences(counts: Counts, classes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, ...]:
    """Classes of all tokens with the ends put in, the two classes before each, and the places of the words."""
    places = np.arange(len(classes)) + owner
    lengths = np.bincount(owner, minlength=texts) + 1
    line = np.full(len(classes) + texts, counts.end, dtype=np.int64)
    line[places] = classes
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    nth = np.arange(len(line)) - np.repeat(begins, lengths)
    one = np.where(nth >= 1, np.roll(line, 1), counts.start)
    two = np.where(nth >= 2, np.roll(line, 2), counts.start)
    return line, one, two, places


def count_triples(training: DataFrame, shared_counts) -> DataFrame:
    """(triple, n): a number for (class, class before, class before that), and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared_counts.value
        base = counts.start + 1
        for batch in batches:
            keys = []
            for words, endings, owner, texts in words_of(batch.column("text")):
                classes = counts.look_up(words, endings)[2]
                line, one, two, _ = sequences(counts, classes, owner, texts)
                keys.append((two * base + one) * base + line)
            if keys:
                triple, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(triple), pa.array(n.astype(np.int64))],
                                                 names=["triple", "n"])

    return (training.select("text").mapInArrow(run, "triple long, n long").groupBy("triple")
            .agg(F.sum("n").alias("n")))


@dataclass
class Model:
    context: np.ndarray    # vectors of the classes before, the start included
    positions: np.ndarray  # one matrix per position
    target: np.ndarray
    bias: np.ndarray

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.context, self.positions, self.target, self.bias

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def like(self, flat: np.ndarray) -> Model:
        """A model of the same shapes from numbers in a row."""
        cuts = np.cumsum([p.size for p in self.parts()])[:-1]
        return Model(*(v.reshape(p.shape).copy() for v, p in zip(np.split(flat, cuts), self.parts())))

    def logits(self, line: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The logit of each token after its two classes before."""
        first, second = self.context @ self.positions[0], self.context @ self.positions[1]
        return np.einsum("ij,ij->i", first[one] + second[two], self.target[line]) + self.bias[line]

    def normaliser(self, one: int) -> np.ndarray:
        """Logarithm of the sum over all classes, for this class before and every one before that."""
        predicted = (self.context[one] @ self.positions[0])[None, :] + self.context @ self.positions[1]
        logits = predicted @ self.target.T + self.bias
        top = logits.max(axis=1)
        return top + np.log(np.exp(logits - top[:, None]).sum(axis=1))


def first_model(counts: Counts, size: int = SIZE, seed: int = 7) -> tuple[Model, np.ndarray]:
    """Weights to begin with, and the distribution that noise is drawn from."""
    rng = np.random.default_rng(seed)
    n = counts.end + 1
    unigram = (counts.class_counts + 0.5) / (counts.class_counts + 0.5).sum()
    return Model(rng.normal(0, 0.1, (n + 1, size)).astype(np.float32),
                 np.stack([np.eye(size, dtype=np.float32)] * 2) * np.float32(0.5),
                 rng.normal(0, 0.1, (n, size)).astype(np.float32), np.log(unigram).astype(np.float32)), unigram


def _row_sums(rows: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
    """The sum of `rows` for each of `n` numbers."""
    order = np.argsort(numbers, kind="stable")
    found, begins = np.unique(numbers[order], return_index=True)
    out = np.zeros((n, rows.shape[1]), dtype=rows.dtype)
    out[found] = np.add.reduceat(rows[order], begins, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def descend(model: Model, squares: Model, triples: np.ndarray, numbers: np.ndarray, unigram: np.ndarray, mean: float,
            speed: float, seed: int, noise: int = NOISE, batch: int = BATCH) -> None:
    """Go once through weighted triples by noise-contrastive estimation with Adagrad, changing model and squares."""
    rng = np.random.default_rng(seed)
    n = len(model.bias)
    copies = np.ceil(numbers / (HEAVIEST * mean)).astype(np.int64)
    examples = np.repeat(np.arange(len(triples)), copies)
    weights = (numbers / copies / mean).astype(np.float32)
    rng.shuffle(examples)
    batch = min(batch, max(64, len(examples) // 64))  # few triples are seen in many small steps
    upto = np.cumsum(unigram)
    log_noise = (np.log(unigram) + math.log(noise)).astype(np.float32)
    base = n + 1
    for start in range(0, len(examples), batch):
        chosen = examples[start:start + batch]
        weight, taken = weights[chosen] / len(chosen), triples[chosen]
        word, one, two = taken % base, taken // base % base, taken // base // base
        fake = np.minimum(np.searchsorted(upto, rng.random(noise)), n - 1)
        c1, c2 = model.context[one], model.context[two]
        predicted = c1 @ model.positions[0] + c2 @ model.positions[1]
        real_target, fake_target = model.target[word], model.target[fake]
        # Gradients of the log-likelihood of telling data from noise.
        real = weight * (1 - _sigmoid((predicted * real_target).sum(axis=1) + model.bias[word] - log_noise[word]))
        false = -weight[:, None] * _sigmoid(predicted @ fake_target.T + model.bias[fake] - log_noise[fake])
        into = real[:, None] * real_target + false @ fake_target
        target = _row_sums(np.concatenate([real[:, None] * predicted, false.T @ predicted]),
                           np.concatenate([word, fake]), n)
        bias = np.bincount(word, real, n) + np.bincount(fake, false.sum(axis=0), n)
        context = _row_sums(np.concatenate([into @ model.positions[0].T, into @ model.positions[1].T]),
                            np.concatenate([one, two]), base)
        positions = np.stack([c1.T @ into, c2.T @ into])
        for values, square, gradient in zip(model.parts(), squares.parts(), (context, positions, target, bias)):
            square += gradient * gradient
            values += (speed * gradient / np.sqrt(square)).astype(np.float32)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, triples, counts) of rows that are sorted by shard, one shard in memory at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    now = -1

    def whole() -> tuple[int, np.ndarray, np.ndarray]:
        return now, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])

    for batch in batches:
        shard, triples, numbers = (batch.column(c).to_numpy() for c in ("shard", "triple", "n"))
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                if held and shard[a] != now:
                    yield whole()
                    held = []
                now = int(shard[a])
                held.append((triples[a:b], numbers[a:b]))
    if held:
        yield whole()


def _mean_blocks(rows: pa.Table) -> pa.Table:
    """The mean of one block of weights over all tasks, by their tokens."""
    masses, total = np.asarray(rows.column("mass")), 0.0
    for mass, values in zip(masses, rows.column("values").to_pylist()):
        total = total + mass * np.frombuffer(values, dtype=np.float64)
    return pa.table({"block": rows.column("block")[:1].combine_chunks(),
                     "values": pa.array([(total / masses.sum()).tobytes()], pa.binary())})


def train(triples: DataFrame, counts: Counts, passes: int = PASSES, rate: float = RATE,
          shard_triples: int = SHARD_TRIPLES) -> Model:
    """`passes` passes over all triples (triple, n). Every task trains shard by shard from the same weights."""
    model, unigram = first_model(counts)
    stored = materialize(triples, "triples")
    rows, tokens = stored.agg(F.count("*"), F.sum("n")).first()
    if not rows:
        return model
    spark, mean = stored.sparkSession, tokens / rows
    n_shards = -(-rows // shard_triples)
    shards = materialize(stored.withColumn("shard", F.pmod(F.xxhash64("triple"), F.lit(n_shards)).cast("int"))
                         .repartition("shard").sortWithinPartitions("shard", "triple"), "shards")
    size = model.flat().size
    state = np.concatenate([model.flat(), np.full(size, 1e-3)]).astype(np.float64)
    for nth in range(passes):
        begun = spark.sparkContext.broadcast(state)
        speed = rate * (1 - 0.9 * nth / passes)

        def run(batches: Iterator[pa.RecordBatch], nth=nth, speed=speed, begun=begun) -> Iterator[pa.RecordBatch]:
            total, mass = np.zeros_like(begun.value), 0.0
            for shard, keys, numbers in _shards(batches):
                # A model takes part in the mean with its own squares; both start from the last pass.
                mine = model.like(begun.value[:size].astype(np.float32))
                squares = model.like(begun.value[size:])
                descend(mine, squares, keys, numbers, unigram, mean, speed, seed=nth * 1_000_003 + shard)
                share = float(numbers.sum())
                total += share * np.concatenate([mine.flat(), squares.flat()])
                mass += share
            if mass:
                cuts = range(0, len(total), BLOCK_VALUES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(cuts), dtype=np.int32)), pa.array(np.full(len(cuts), mass)),
                     pa.array([(total[c:c + BLOCK_VALUES] / mass).tobytes() for c in cuts], pa.binary())],
                    names=["block", "mass", "values"])

        blocks = (shards.mapInArrow(run, "block int, mass double, values binary").groupBy("block")
                  .applyInArrow(_mean_blocks, "block int, values binary").collect())  # as many values as the model has
        state = np.concatenate([np.frombuffer(b["values"], dtype=np.float64) for b in sorted(blocks)])
        begun.unpersist()
    return model.like(state[:size].astype(np.float32))


def normalisers(spark: SparkSession, model: Model) -> np.ndarray:
    """The normalisers of all contexts, by (class before, class before that); worked out by Spark."""
    n = len(model.context)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column("id").to_pylist():
                values = shared.value.normaliser(one).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([one]), pa.array([values.tobytes()], pa.binary())],
                                                 names=["one", "values"])

    rows = spark.range(n).mapInArrow(run, "one long, values binary").collect()
    return np.stack([np.frombuffer(r["values"], dtype=np.float32) for r in sorted(rows)])


_SCORED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
    ("n_head", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("words", pa.list_(pa.int64())),
    ("logs", pa.list_(pa.float64()))])


def _scored(batches: Iterator[pa.RecordBatch], counts: Counts, model: Model,
            normalisers: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums over the tokens that are in the head or ends; hashes and class parts of the others."""
    log_class = np.log10(np.maximum(counts.class_counts, 1)).astype(np.float64)
    seen = math.log10(1 - counts.unseen)
    for batch in batches:
        sums, words_left, logs_left, lengths = [], [], [], []
        for words, endings, owner, texts in words_of(batch.column("text")):
            found, number, classes = counts.look_up(words, endings)
            line, one, two, places = sequences(counts, classes, owner, texts)
            log_p = (model.logits(line, one, two) - normalisers[one, two]).astype(np.float64) / math.log(10) + seen
            of_word = log_p[places] - log_class[classes]
            ends = np.setdiff1d(np.arange(len(line)), places, assume_unique=True)
            known_end = counts.texts > 0
            end_base = math.log10(counts.texts + 0.5)
            end_score = log_p[ends] if known_end else np.full(texts, math.log10(counts.unseen))
            head_owner, head_number = owner[found], number[found].astype(np.float64)
            per_text = np.bincount(owner, minlength=texts)
            sums.append((per_text + 1, np.bincount(head_owner, minlength=texts) + int(known_end),
                         np.bincount(head_owner, np.log10(head_number + 0.5), texts) + end_base,
                         np.bincount(head_owner, of_word[found] + np.log10(head_number), texts) + end_score))
            words_left.append(words[~found])
            logs_left.append(of_word[~found])
            lengths.append(np.bincount(owner[~found], minlength=texts))
        if not sums:
            continue
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32))
        columns = [np.concatenate([s[k] for s in sums]) for k in range(4)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("row", "doc_id", "held_out")),
             *(pa.array(c, f.type) for c, f in zip(columns, list(_SCORED)[3:])),
             pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(words_left))),
             pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(logs_left)))], schema=_SCORED)


@dataclass
class Trained:
    vocabulary: DataFrame
    counts: Counts
    least: int
    model: Model
    normalisers: np.ndarray


def learn(training: DataFrame, head_words: int = HEAD_WORDS, passes: int = PASSES) -> Trained:
    """Counts and the network from all texts of `training`."""
    vocabulary = materialize(count_words(training), "vocabulary")
    counts, least = gather(vocabulary, training.count(), head_words)
    shared = training.sparkSession.sparkContext.broadcast(counts)
    model = train(count_triples(training, shared), counts, passes)
    return Trained(vocabulary, counts, least, model, normalisers(training.sparkSession, model))


def score(texts: DataFrame, trained: Trained) -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score and score to (doc_id, held_out, text)."""
    counts = trained.counts
    shared = texts.sparkSession.sparkContext.broadcast((counts, trained.model, trained.normalisers))
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    # Written at once, so that the numbers hold.
    sums = materialize(numbered.mapInArrow(
        lambda batches: _scored(batches, *shared.value),
        "row long, doc_id long, held_out boolean, n_tokens long, n_head long, base double, score double, "
        "words array<long>, logs array<double>"), "sums")
    left = sums.select("row", F.explode(F.arrays_zip("words", "logs")).alias("t")).select("row", "t.words", "t.logs")
    tail = trained.vocabulary.where(F.col("n") < trained.least).select(F.col("word").alias("words"), "n")
    n = F.coalesce("n", F.lit(0))
    rest = left.join(tail, "words", "left").groupBy("row").agg(
        F.sum((n > 0).cast("long")).alias("known"), F.sum(F.log10(n + 0.5)).alias("rest_base"),
        F.sum(F.when(n > 0, F.col("logs") + F.log10(n)).otherwise(math.log10(counts.unseen))).alias("rest_score"))
    divisor = math.log10(counts.tokens + 0.5 * (counts.distinct + 1))
    zero = F.lit(0.0)
    return (sums.drop("words", "logs").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", zero) - F.col("n_tokens") * divisor).alias("base_score"),
        (F.col("score") + F.coalesce("rest_score", zero)).alias("score")))


def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    documents = documents.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    rows = documents.withColumn("held_out", remainder(F.col("doc_id"), 5) == 1)
    return score(rows.select("doc_id", "held_out", "text"), learn(rows.where(~F.col("held_out")).select("text")))
