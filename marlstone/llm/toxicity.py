"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the average of the vectors of its character n-grams (with marks at its ends) and of
itself, a text the average of its words; two linear outputs and a softmax follow. The share of an n-gram in a
text is taken in units of its root mean square over the sample, so rare ones count like frequent ones.
Vectors and outputs are trained together, in numpy, in one task, from a sample of labelled rows that is
bounded in rows and in characters, so the driver holds only the model. Training is by
accelerated proximal gradient steps on the cross-entropy with a penalty on the length of each vector: the
vectors of n-grams that say nothing are zero, and a few marked words decide a text however much
else it holds. A misspelled or inflected word shares most n-grams with its source, and so its vector.

As all but the softmax is linear, a text's margin is the average of its words' margins; scoring
works out each distinct word of a batch once.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.texts import bound_batches, give_back, held_out, sliced
from marlstone.plans.stash import Stash


#: Labelled rows that the model is fitted on, at most; those of the lowest hashes of their ids.
SAMPLE_ROWS = 4500
#: Characters of all of their texts, at most; rows beyond are left out of the fit.
SAMPLE_CHARS = 40_000_000
BUCKETS = 1 << 18
DIMENSIONS = 4
SHORTEST, LONGEST = 3, 5
#: Steps of training; the penalty on vectors, times the square root of the sample's rows.
STEPS, PENALTY = 150, 0.45
#: How often a toxic row counts, as they are few.
TOXIC_COUNTS = 6.0
#: Factors of margins that are tried at the end.
SURENESS = (1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0)
#: Vectors of n-grams in fewer texts of the sample stay zero.
LEAST_TEXTS = 10
#: Zero vectors that are averaged with a text's words, so that one word decides less alone.
PADDING = 1

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def normal_word(piece: str) -> str:
    """Lower case, without marks at either end; what has no letter or digit is left as it is."""
    piece = piece.lower()
    return piece if piece.isalnum() else (_EDGES.sub("", piece) or piece)


#: Words whose n-grams are listed at a time.
WORDS_A_TIME = 4_000


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the word) of each n-gram of the words and of each word itself; in no order."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    to = np.cumsum(sizes)
    ends, place = to[owner], np.arange(len(text))
    hashes, owners = [], []
    h = np.zeros(len(text), np.uint64)
    for n in range(1, LONGEST + 1):
        live = np.flatnonzero(place + n <= ends)
        h[live] = (h[live] ^ text[live + n - 1]) * np.uint64(0x100000001B3) + np.uint64(n)
        if n >= SHORTEST:
            hashes.append(h[live].copy())
            owners.append(owner[live])
    # a word of its own, over all its characters
    power = (text + np.uint64(7)) * (np.uint64(0x9E3779B97F4A7C15) * (place - (ends - sizes[owner]) + 1).astype(np.uint64) | np.uint64(1))
    hashes.append(np.add.reduceat(power ^ (power >> np.uint64(29)), to - sizes))
    owners.append(np.arange(len(words)))
    h = np.concatenate(hashes)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (h >> np.uint64(40)).astype(np.int64) % BUCKETS, np.concatenate(owners)


@dataclass
class SubwordModel:
    """``margins``: of each bucket, the difference of its two outputs; ``bias``: of the texts."""

    margins: np.ndarray
    bias: float

    def word_margins(self, words: list[str]) -> np.ndarray:
        out = [np.empty(0)]
        for k in range(0, len(words), WORDS_A_TIME):
            buckets, owner = subwords(words[k : k + WORDS_A_TIME])
            out.append(np.bincount(owner, self.margins[buckets]) / np.bincount(owner))
        return np.concatenate(out)


class Sample:
    """Labelled texts as numbers of words and weights, added one at a time; no text is kept."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.texts: list[tuple[np.ndarray, np.ndarray]] = []
        self.labels: list[int] = []

    def add(self, text: str | None, label: int) -> None:
        known = self.known
        found = np.array([known.setdefault(normal_word(w), len(known)) for w in (text or "").split()], np.int64)
        at, n = np.unique(found, return_counts=True)
        self.texts.append((at.astype(np.int32), (n / (len(found) + PADDING)).astype(np.float32)))
        self.labels.append(int(label))

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the n-grams of all words, word by word, and how many each word has."""
        words, buckets, counts = list(self.known), [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for k in range(0, len(words), WORDS_A_TIME):
            bucket, owner = subwords(words[k : k + WORDS_A_TIME])
            buckets.append(bucket[np.argsort(owner, kind="stable")].astype(np.int32))
            counts.append(np.bincount(owner))
        return np.concatenate(buckets), np.concatenate(counts)


def spread(at: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of what the words ``at`` have in a list word by word, and the place in ``at`` of each one's word."""
    n = counts[at]
    ends = np.cumsum(n)
    pick = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - (ends - n), n)
    return pick, np.repeat(np.arange(len(at)), n)


class Sums:
    """Sums of values by group, for values that are sorted by group once; groups without values are 0."""

    def __init__(self, group: np.ndarray, n: int):
        self.order = None if (np.diff(group) >= 0).all() else np.argsort(group, kind="stable")
        group = group if self.order is None else group[self.order]
        self.starts = np.flatnonzero(np.diff(group, prepend=-1))
        self.groups, self.n = group[self.starts], n

    def of(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.starts):
            out[self.groups] = np.add.reduceat(values if self.order is None else values[self.order], self.starts)
        return out


class Shares:
    """The linear part of the model: from the margins of n-grams to those of texts, and back."""

    def __init__(self, sample: Sample):
        buckets, counts = sample.buckets()
        starts, n = np.cumsum(counts) - counts, len(sample.texts)
        texts_with, squares = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS)
        for at, weight in sample.texts:
            pick, owner = spread(at, starts, counts)
            share = np.bincount(buckets[pick], (weight / counts[at])[owner])
            some = np.flatnonzero(share)
            texts_with[some] += 1
            squares[some] += share[some] ** 2
        usual = np.sqrt(squares / max(1, n))
        common = texts_with >= LEAST_TEXTS
        kept = common[buckets]
        word = np.repeat(np.arange(len(counts)), counts)[kept]
        self.used, column = np.unique(buckets[kept], return_inverse=True)
        self.column = column.astype(np.int32)
        self.unit = 1 / usual[self.used]
        self.part = (self.unit[self.column] / counts[word]).astype(np.float32)
        self.word = word.astype(np.int32)
        self.at = np.concatenate([at for at, _ in sample.texts])
        self.weight = np.concatenate([w for _, w in sample.texts])
        self.text = np.repeat(np.arange(n, dtype=np.int32), [len(at) for at, _ in sample.texts])
        self.by_word, self.by_text = Sums(self.word, len(counts)), Sums(self.text, n)
        self.by_column, self.words_back = Sums(self.column, len(self.used)), Sums(self.at, len(counts))

    def margins(self, of_grams: np.ndarray) -> np.ndarray:
        of_words = self.by_word.of(of_grams[self.column] * self.part)
        return self.by_text.of(of_words[self.at] * self.weight)

    def back(self, of_texts: np.ndarray) -> np.ndarray:
        of_words = self.words_back.of(of_texts[self.text] * self.weight)
        return self.by_column.of(of_words[self.word] * self.part)


def shortened(vectors: np.ndarray, by: float) -> np.ndarray:
    """Vectors made shorter by a length; those that are no longer than it are zero."""
    length = np.sqrt((vectors**2).sum(1, keepdims=True))
    return vectors * np.maximum(1 - by / np.maximum(length, 1e-30), 0)


def fit_sample(sample: Sample, seed: int = 11) -> SubwordModel:
    """Train vectors and softmax outputs together: weighted cross-entropy plus the penalty on the vectors' lengths.

    The two outputs are opposite and their difference is a unit vector, as a longer one could do for
    longer vectors.
    """
    y = np.asarray(sample.labels, np.int64)
    if len(set(sample.labels)) < 2:
        share = float(np.mean(y)) if len(y) else 0.0
        share = min(max(share, 1e-3), 1 - 1e-3)
        return SubwordModel(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    shares, n = Shares(sample), len(y)
    penalty = PENALTY / np.sqrt(n)
    counts = np.where(y == 1, TOXIC_COUNTS, 1.0) / n
    output = rng.normal(size=DIMENSIONS)
    output /= np.linalg.norm(output)
    # how steep the loss can be, by powers of its linear part
    probe = rng.normal(size=len(shares.used))
    steep = 1e-12
    for _ in range(8):
        probe = shares.back(shares.margins(probe / (np.linalg.norm(probe) or 1.0)) * counts)
        steep = max(np.linalg.norm(probe) * 1.1 / 4, 1e-12)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    vectors = ahead = np.zeros((len(shares.used), DIMENSIONS))
    pace = 1.0
    for _ in range(STEPS):
        margin = shares.margins(ahead @ output) + bias
        p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        wrong = (p - y) * counts
        gradient = shares.back(wrong)  # of an n-gram's margin; its vector's is this times the outputs' difference
        before, vectors = vectors, shortened(ahead - gradient[:, None] * output / steep, penalty / steep)
        turned = output - (ahead.T @ gradient) / steep
        output = turned / (np.linalg.norm(turned) or 1.0)
        bias -= 2 * float(wrong.sum())
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = vectors + (pace - 1) / faster * (vectors - before)
        pace = faster
    margin = shares.margins(vectors @ output) + bias
    side = np.where(y == 1, -1.0, 1.0)
    # toxic rows counted more, so the scores are made as sure as the sample is; which side they are on stays
    sure = min(SURENESS, key=lambda c: float(np.logaddexp(0, c * margin * side).mean()))
    margins = np.zeros(BUCKETS)
    margins[shares.used] = (vectors @ output) * shares.unit * sure
    return SubwordModel(margins, bias * sure)


def fit(texts: list[str | None], labels: list[int], seed: int = 11) -> SubwordModel:
    """A model from texts and their labels."""
    sample = Sample()
    for text, label in zip(texts, labels):
        sample.add(text, label)
    return fit_sample(sample, seed)


class WordMargins(dict):
    """Numbers pieces of text as they are first asked for, and keeps the margins of their words."""

    def __init__(self, model: SubwordModel, most: int = 200_000):
        super().__init__()
        self.model, self.most = model, most
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.number: dict[str, int] = {}  # of a word in values
        self.word, self.values = np.empty(0, np.int64), np.empty(0)  # word: of a piece in number

    def __missing__(self, piece: str) -> int:
        self.fresh.append(piece)
        value = self[piece] = len(self)
        return value

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if len(self) > self.most:
            self._reset()
        places = []
        for x in texts:
            found = x.split() if x else []
            places.append(np.fromiter(map(self.__getitem__, found), np.int64, len(found)))
        if self.fresh:
            known = len(self.number)
            words = list(map(normal_word, self.fresh))
            self.word = np.append(self.word, [self.number.setdefault(w, len(self.number)) for w in words])
            self.values = np.append(self.values, self.model.word_margins(list(self.number)[known:]))
            self.fresh = []
        of_piece = self.values[self.word]
        margin = np.array([of_piece[at].sum() / (len(at) + PADDING) for at in places]) + self.model.bias
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit_on(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS
) -> SubwordModel:
    """A model from ``rows`` labelled rows and ``chars`` characters of text at most, none of them held out.

    The sample is by least hash of the id, the same at every run; a text that would go beyond the
    characters is left out, and those after it that fit are taken. Rows without a label, with
    labels other than 0 and 1 or without a document are left out; an id labelled more than once
    counts with its largest label, one with several documents with the least text.
    """
    mark = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).cast("long").alias("_id"))
    mark = mark.agg(F.max(label).cast("int").alias("_y"))
    mark = mark.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    text_of = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    got = text_of.join(F.broadcast(mark), "_id").groupBy("_id").agg(F.first("_y").alias("_y"), F.min("_text").alias("_text"))  # ``rows`` is the proven bound
    stash = Stash(docs.sparkSession)
    got = stash.put(got)
    sizes = got.select("_id", F.xxhash64("_id").alias("h"), F.coalesce(F.length("_text"), F.lit(0)).alias("n")).orderBy("h", "_id").collect()  # ``rows`` numbers
    left, taken = chars, []
    for x in sizes:
        if x.n <= left:
            left -= x.n
            taken.append((x._id,))
    fits = docs.sparkSession.createDataFrame(taken, "_id long")
    got = got.join(F.broadcast(fits), "_id", "left_semi").repartition(1).sortWithinPartitions("_id")  # ``chars`` is the bound of the one task

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = Sample()
        for part in sliced(batches):
            for x, y in zip(part.column("_text"), part.column("_y")):
                sample.add(x.as_py(), y.as_py())
        part, model = None, fit_sample(sample)
        yield pa.RecordBatch.from_pydict({"margins": [model.margins.astype(np.float32).tobytes()], "bias": [model.bias]})
        sample = model = None
        give_back()

    bound_batches(docs.sparkSession)
    found = got.mapInArrow(train, "margins binary, bias double").collect()  # one row of fixed size
    stash.drop(got)
    if not found:
        return fit_sample(Sample())
    return SubwordModel(np.frombuffer(found[0].margins, np.float32), found[0].bias)


def toxicity_score(spark: SparkSession, model: SubwordModel):
    """A column function: text -> score (0 to 1). Null and empty texts have the score of no words."""
    shared = spark.sparkContext.broadcast((model.margins.astype(np.float32), model.bias))  # fixed size

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        margins = WordMargins(SubwordModel(*shared.value))
        for texts in sliced(batches):
            yield pa.array(margins.scores(texts.to_pylist()), pa.float64())
        margins = texts = None
        give_back()

    bound_batches(spark)
    return score


def score_toxicity(docs: DataFrame, model: SubwordModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each row.

    Null and empty texts have the score of no words: the bias alone. A null doc_id stays null and
    is not held out. Repeated rows get equal scores. Only the text is scored; whole texts are.
    """
    score = toxicity_score(docs.sparkSession, model)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), score(F.col(text).cast("string")).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: SubwordModel, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that are not predicted to be toxic."""
    return docs.where(toxicity_score(docs.sparkSession, model)(F.col(text).cast("string")) < 0.5)
