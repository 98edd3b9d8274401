"""Text quality by a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its distinct lower-case words, hashed to ``BINS`` and weighted by the root of their count so
that their squares add to 1; its structure statistics, each in one of ``STEPS`` intervals; and the declared length
beside the real one. The machine has a weight for each feature and, for each pair, the inner product of their
factors, so that a statistic counts otherwise beside other words. Pairs are never listed: their sum is half of the square
of the sum less the sum of the squares, for all texts of a batch at once, which is linear in the features.

Labels are learnt only from rows whose crc32(doc_id) mod 5 is not 0. Labels, language, source and id are no inputs
of a score. The machine is fitted on at most ``SAMPLE`` labelled rows in expectation, in passes in which tasks learn side by side
and their machines are averaged after each; no features are left out. Null and empty texts
have the features of a text without words; null lengths have a feature of their own. Texts are read whole. Of several labels for one
id the greatest counts; rows without an id or a label teach nothing; with no labels at all, or of one class, the
score is the smoothed share of good labels. Other columns stay; one named as the score is replaced.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .toxicity import held_out

BINS = 1 << 15
STEPS = 16
#: Labelled rows that the machine is fitted on at most (in expectation).
SAMPLE = 40_000
FACTORS = 4
THRESHOLD = 0.3
REMEMBERED = 400_000
#: Passes over the sample, texts of a step, rate and decay of its steps, and how many tasks learn side by side: one for so many rows.
ROUNDS, BATCH, RATE, DECAY = 12, 64, 0.1, 1e-4
ROWS_A_TASK, MOST_TASKS = 2_000, 8

_SYMBOLS = re.compile(r"[#*$%&|<>{}\\^~=_@]")
_MARKS = ("!!", "??", "$$", "##", "**", "..")

#: The structure statistics, each from 0 to 1.
STATISTICS = (
    "words", "distinct", "repeats", "top_word", "symbol_words", "upper_words", "marked_words", "digit_words", "bare_words", "long_words", "short_words", "mean_length",
    "line_length", "repeated_lines", "symbol_lines", "ended_words", "commas", "letters", "declared",
)
FEATURES = BINS + len(STATISTICS) * STEPS


class Words:
    """Bin, length and kind of words (UTF-8), remembered by a worker."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((1024, 10), np.float32)

    def of(self, words: list[bytes]) -> np.ndarray:
        """A row for each of these different words: bin, length, symbol, upper, marked, digit, bare, long, short, ended."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        at, known = list(map(self.known.get, words)), self.known
        if None in at:
            new = [w for w, i in zip(words, at, strict=True) if i is None]
            first = len(known)
            known.update(zip(new, range(first, first + len(new)), strict=True))
            if len(known) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(len(known), len(self.table)), self.table.shape[1]), np.float32)])
            self.table[first : len(known)] = list(map(_kind, new))
            at = list(map(known.get, words))
        return self.table[at]


def _kind(word: bytes) -> tuple:
    w = word.decode("utf-8", "replace")
    n, bin = len(w), zlib.crc32(word.lower() if w.isascii() else w.lower().encode()) % BINS
    if w.isalpha():
        return bin, n if n < 40 else 40, 0, n > 1 and w.isupper(), 0, 0, 0, n > 14, n == 1, 0
    letters = sum(map(str.isalpha, w))
    return bin, min(n, 40), bool(_SYMBOLS.search(w)), n > 1 and w.isupper(), w.endswith(_MARKS), any(map(str.isdigit, w)), letters == 0, letters > 14, letters == 1, w[-1] in ".!?:;"


def _share(n: float, of: float) -> float:
    return n / of if of else 0.0


def statistics(text: str, words: list[bytes], counts: np.ndarray, rows: np.ndarray, declared: int | None) -> list[float]:
    """The statistics of a text of these words; counts and rows are of its distinct words."""
    n = len(words)
    if not n:
        return [0.0] * (len(STATISTICS) - 1) + [1.0]
    by = counts @ rows
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    marked = sum(1 for line in lines if "|" in line or "\t" in line)
    gap = 1.0 if declared is None else min(0.9, abs(math.log((declared + 1) / (len(text) + 1))) / 4) if declared >= 0 else 0.95
    return [
        min(1.0, math.log2(n + 1) / 16), _share(len(counts), n), _share(sum(map(operator.eq, words, words[1:])), n), _share(float(counts.max()), n), by[2] / n, by[3] / n, by[4] / n, by[5] / n, by[6] / n, by[7] / n, by[8] / n, min(1.0, by[1] / n / 16),
        min(1.0, math.log2(n / len(lines) + 1) / 10), 1 - len(set(lines)) / len(lines), marked / len(lines), by[9] / n, _share(text.count(","), n), _share(by[1], len(text)), gap,
    ]


def _step(value: float) -> int:
    """The interval of a share: 0 and 1 have one of their own, the others grow from 1/1000 on."""
    if value <= 0.001:
        return 0
    return STEPS - 1 if value >= 1 else 1 + min(STEPS - 3, int((STEPS - 2) * math.sqrt(value)))


def features_of(text: str | None, declared: int | None, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text, rising, and their weights."""
    text = text or ""
    all_ = text.encode("utf-8", "replace").split()  # by ASCII white space
    counted = Counter(all_)
    rows = words.of(list(counted))
    counts = np.fromiter(counted.values(), float, len(counted))
    steps = [BINS + STEPS * i + _step(v) for i, v in enumerate(statistics(text, all_, counts, rows, declared))]
    bins, at = np.unique(rows[:, 0].astype(np.int64), return_inverse=True)
    weights = np.sqrt(np.bincount(at, counts, len(bins)))
    if len(weights):
        weights /= math.sqrt(float(counts.sum()))
    return np.append(bins, steps), np.append(weights, np.ones(len(steps)))


@dataclass(frozen=True)
class Machine:
    intercept: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, features: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
        """Of many texts at once. Every text has features."""
        at, x = np.concatenate(features), np.concatenate(weights)
        starts = np.cumsum([0, *map(len, features[:-1])])
        v = self.factors[at] * x[:, None]
        pairs = (np.add.reduceat(v, starts) ** 2 - np.add.reduceat(v**2, starts)).sum(axis=1) / 2
        z = self.intercept + np.add.reduceat(self.linear[at] * x, starts) + pairs
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """label, at and weights (features) of the rows of the training folds with one of ``labels``, a drawn sample that each task gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                made = [features_of(t, n, words) for t, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32()))], ["label", "at", "weights"])

    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "n_chars")
    return rows.join(F.broadcast(labels), "doc_id").select("text", F.col("n_chars").cast("long").alias("n_chars"), "label").mapInArrow(run, "label double, at array<int>, weights array<float>")


class Learner:
    """A machine in training: AdaGrad over batches of texts; only the features of a batch are touched."""

    def __init__(self, parameters: np.ndarray, squares: np.ndarray):
        self.parameters, self.squares = parameters, squares  # a row per feature: weight, factors; the last row has the intercept

    @staticmethod
    def start(share: float) -> Learner:
        made = np.random.default_rng(5).normal(0, 0.02, (FEATURES + 1, 1 + FACTORS))
        made[:, 0] = 0
        made[-1] = 0
        made[-1, 0] = math.log(share / (1 - share))
        return Learner(made, np.full(made.shape, 1e-3))

    def learn(self, at: np.ndarray, x: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> None:
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        used, where = np.unique(at, return_inverse=True)
        own = self.parameters[used]
        v = own[where, 1:] * x[:, None]
        sums = np.add.reduceat(v, starts)
        z = self.parameters[-1, 0] + np.add.reduceat(own[where, 0] * x, starts) + (sums**2 - np.add.reduceat(v**2, starts)).sum(axis=1) / 2
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(labels)
        pull = np.repeat(error, sizes) * x
        gradient = np.empty_like(own)
        gradient[:, 0] = np.bincount(where, pull, len(used))
        slopes = pull[:, None] * (np.repeat(sums, sizes, axis=0) - v)
        for f in range(FACTORS):
            gradient[:, 1 + f] = np.bincount(where, slopes[:, f], len(used))
        gradient += DECAY * own
        self.squares[used] += gradient**2
        self.parameters[used] -= RATE * gradient / np.sqrt(self.squares[used])
        self.squares[-1, 0] += error.sum() ** 2
        self.parameters[-1, 0] -= RATE * error.sum() / math.sqrt(self.squares[-1, 0])

    def machine(self) -> Machine:
        return Machine(float(self.parameters[-1, 0]), self.parameters[:-1, 0].copy(), self.parameters[:-1, 1:].copy())


def _round(rows: DataFrame, learner: Learner) -> Learner:
    """One pass: every task learns from its rows, and the tasks' parameters are averaged by their numbers of rows."""
    shared = rows.sparkSession.sparkContext.broadcast((learner.parameters, learner.squares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = Learner(*(a.copy() for a in shared.value)), 0
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                sizes = part.column(1).value_lengths().to_numpy(zero_copy_only=False)
                own.learn(part.column(1).flatten().to_numpy().astype(np.int64), part.column(2).flatten().to_numpy().astype(np.float64), sizes, part.column(0).to_numpy())
                n += part.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([own.parameters.astype(np.float32).tobytes()]), pa.array([own.squares.astype(np.float32).tobytes()])], ["n", "parameters", "squares"])

    found = rows.mapInArrow(run, "n long, parameters binary, squares binary").collect()  # a machine for each task over a bounded sample
    shared.unpersist()
    share = np.array([r["n"] for r in found]) / sum(r["n"] for r in found)
    read = lambda name: sum(w * np.frombuffer(r[name], np.float32).reshape(learner.parameters.shape).astype(float) for w, r in zip(share, found, strict=True))
    return Learner(read("parameters"), read("squares"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fitted on rows drawn by a hash of their ids."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    n, good = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    share = (good + 1) / (n + 2)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(1, n)))
    with Scratch(docs.sparkSession) as scratch:
        tasks = max(1, min(MOST_TASKS, int(min(n, sample) // ROWS_A_TASK)))
        rows = scratch.written(labelled(docs.where(drawn), known.where(drawn)).repartition(tasks))
        if rows.select("label").distinct().count() < 2:
            return Machine(math.log(share / (1 - share)), np.zeros(FEATURES), np.zeros((FEATURES, FACTORS)))
        learner = Learner.start(share)
        for _ in range(ROUNDS):
            learner = _round(rows, learner)
        return learner.machine()


def scored(docs: DataFrame, machine: Machine, text: str = "text", declared: str = "n_chars", out: str = "score") -> DataFrame:
    """``docs`` with its score."""
    kept = [c for c in docs.columns if c != out]
    at, length = kept.index(text), kept.index(declared)
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # FEATURES numbers and factors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            scores = [np.zeros(0)]
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                made = [features_of(t, n, words) for t, n in zip(part.column(at).to_pylist(), part.column(length).to_pylist(), strict=True)]
                scores.append(shared.value.scores([m[0] for m in made], [m[1] for m in made]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], [*kept, out])

    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def per_document(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = scored(docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")), fit(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
