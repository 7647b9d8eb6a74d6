"""Text quality by regularised quadratic discriminant analysis over document statistics.

One pass over the texts counts words, signs and repetitions of every document.  Counts
become logarithms of rates that are smoothed towards the rates of good training
texts, so a short text is judged by little evidence and an empty one by none.  Each class
is a Gaussian whose covariance is shrunk towards the pooled one and a multiple of the
identity; its Cholesky factor is computed once and sent along.  A score is the difference of
the two Mahalanobis log-densities, put on the scale of a probability by a logistic curve
fitted to a histogram of the training rows' differences.

All labelled training rows count: the rates and moments are sums over partitions, and what reaches
the driver is d x d numbers for each class and a histogram of fixed size.

Defined cases: a null text is the empty text; a null ``doc_id`` is not held out and has no
label; a document with several labels is a training row for each; labels other than 0 and 1
are ignored; with one class or none, all scores are the smoothed share of label 1; rows that repeat
stay rows of their own; columns other than those named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.text_batches import texts
from postmill.llm.worker_memory import release
from postmill.sources.staging import settle

THRESHOLD = 0.7
# Shrinkage towards the pooled covariance, and of that towards a multiple of the identity.
POOLED, ROUND = 0.1, 0.02
# Words, lines or characters that a text's own evidence is weighed against.
PRIOR = 20.0
FLOOR = 1e-4
WINDOW = 64
BINS, REACH = 2000, 60.0

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_STOP = np.isin(_BYTES, list(b".,;:'\"-()"))
_CALL = np.isin(_BYTES, list(b"!?"))
_SPACE = np.isin(_BYTES, list(b" \t\n\r\x0b\x0c"))
_SIGN = ~(_LETTER | _DIGIT | _STOP | _CALL | _SPACE)

# What is counted, and what it is a share of: characters, words, words seen in windows, lines.
FEATURES = (
    ("upper", "chars"),
    ("digit", "chars"),
    ("stop", "words"),
    ("call", "words"),
    ("sign", "words"),
    ("short", "words"),
    ("letters", "words"),
    ("bare", "words"),
    ("distinct", "words"),
    ("again", "words"),
    ("distinct_lines", "lines"),
)
COUNTS = ("chars", "words", "lines") + tuple(name for name, _ in FEATURES)


def statistics(text: bytes) -> list[float]:
    """The counts of one UTF-8 text, in the order of ``COUNTS``."""
    seen = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    words = text.split()
    lines = [line for line in text.split(b"\n") if line]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    distinct = sum(len(set(words[i : i + WINDOW])) for i in range(0, len(words), WINDOW))
    return [
        float(value)
        for value in (
            seen[~_SPACE].sum(),
            len(words),
            len(lines),
            seen[_UPPER].sum(),
            seen[_DIGIT].sum(),
            seen[_STOP].sum(),
            seen[_CALL].sum(),
            seen[_SIGN].sum(),
            (lengths <= 3).sum(),
            seen[_LETTER].sum(),
            sum(not word.isalpha() and word.isascii() for word in words),
            distinct,
            sum(map(bytes.__eq__, words, words[1:])),
            len(set(lines)),
        )
    ]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        rows = [statistics(text.as_py() or b"") for text in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "counts"])


def counted(docs: DataFrame) -> DataFrame:
    """``(doc_id, counts)`` of every row."""
    return texts(docs).mapInArrow(_count_batches, "doc_id bigint, counts array<double>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


# Model --------------------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def features(counts: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Log of smoothed rates; a row of zeros becomes the log of ``rates``."""
    place = {name: i for i, name in enumerate(COUNTS)}
    bases = counts[:, [place[base] for _, base in FEATURES]]
    hits = counts[:, [place[name] for name, _ in FEATURES]]
    return np.log(FLOOR + (hits + PRIOR * rates) / (bases + PRIOR))


@dataclass(frozen=True)
class QuadraticModel:
    """Means, lower Cholesky factors' inverses and offsets of the classes 0 and 1."""

    rates: np.ndarray
    means: tuple[np.ndarray, np.ndarray] | None
    inverses: tuple[np.ndarray, np.ndarray] | None
    offset: float
    slope: float
    shift: float

    def difference(self, counts: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        if self.means is None:
            return np.zeros(len(counts))
        x = features(counts, self.rates)
        far = [((x - mean) @ inverse.T) ** 2 for mean, inverse in zip(self.means, self.inverses, strict=True)]
        return (far[0].sum(axis=1) - far[1].sum(axis=1)) / 2 + self.offset

    def score(self, counts: np.ndarray) -> np.ndarray:
        level = np.clip(self.difference(counts), -REACH, REACH) * self.slope + self.shift
        return 1 / (1 + np.exp(-np.clip(level, -500, 500)))


def _moment_batches(rates: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of 1, x and x x' for each class, one row per number and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(FEATURES) + 1
        sums = np.zeros((2, width, width))
        for batch in batches:
            if batch.num_rows:
                x = features(_matrix(batch.column(0)), rates)
                x = np.column_stack([np.ones(len(x)), x])
                label = np.asarray(batch.column(1))
                for k in (0, 1):
                    own = x[label == k]
                    sums[k] += own.T @ own
        places = np.arange(sums.size)
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(sums.reshape(-1))], ["place", "value"])

    return run


def _bin_batches(model: QuadraticModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                level = np.clip(model.difference(_matrix(batch.column(0))), -REACH, REACH)
                bins = np.minimum((level + REACH) / (2 * REACH) * BINS, BINS - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1).cast(pa.int64())], ["bin", "label"])

    return run


def _logistic(levels: np.ndarray, ones: np.ndarray, totals: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve through binned labels, by Newton steps with a light penalty."""
    x = np.column_stack([levels, np.ones(len(levels))])
    weights = np.array([1.0, 0.0])
    for _ in range(100):
        chance = 1 / (1 + np.exp(-np.clip(x @ weights, -500, 500)))
        gradient = x.T @ (totals * chance - ones) + 1e-3 * (weights - [1.0, 0.0])
        curve = (x * (totals * chance * (1 - chance))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        weights = weights - step
        if np.abs(step).max() < 1e-10:
            break
    return float(max(weights[0], 1e-6)), float(weights[1])


def fit(counts: DataFrame, labels: DataFrame) -> QuadraticModel:
    """The model of ``counts`` (written before) and all labels of documents that are not held out."""
    wanted = labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
    train = settle(counts.filter(~held_out(F.col("doc_id"))).join(wanted, "doc_id").select("counts", "label"), "training")
    sums = train.groupBy("label").agg(F.count("*").alias("rows"), *(F.sum(F.get("counts", F.lit(i))).alias(name) for i, name in enumerate(COUNTS)))
    totals = {row["label"]: row for row in sums.collect()}
    sizes = [totals[k]["rows"] if k in totals else 0 for k in (0, 1)]
    if not all(sizes):
        share = (sizes[1] + 1) / (sum(sizes) + 2)
        return QuadraticModel(np.zeros(len(FEATURES)), None, None, 0.0, 1.0, math.log(share / (1 - share)))
    good = totals[1]
    rates = np.array([good[name] / max(good[base], 1.0) for name, base in FEATURES])
    parts = train.select("counts", "label").mapInArrow(_moment_batches(rates), "place bigint, value double")
    width = len(FEATURES) + 1
    flat = np.zeros(2 * width * width)
    for row in parts.groupBy("place").agg(F.sum("value").alias("value")).collect():
        flat[row["place"]] = row["value"]
    moments = flat.reshape(2, width, width)
    means = tuple(moments[k][0, 1:] / sizes[k] for k in (0, 1))
    scatter = [moments[k][1:, 1:] / sizes[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (sizes[0] * scatter[0] + sizes[1] * scatter[1]) / sum(sizes)
    d = len(FEATURES)
    inverses, halves = [], []
    for k in (0, 1):
        shrunk = (1 - POOLED) * scatter[k] + POOLED * pooled
        shrunk = (1 - ROUND) * shrunk + ROUND * (np.trace(pooled) / d + 1e-9) * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        inverses.append(np.linalg.inv(factor))
        halves.append(np.log(np.diag(factor)).sum())
    raw = QuadraticModel(rates, means, tuple(inverses), halves[0] - halves[1] + math.log(sizes[1] / sizes[0]), 1.0, 0.0)
    binned = train.mapInArrow(_bin_batches(raw), "bin bigint, label bigint").groupBy("bin").agg(F.sum("label").alias("ones"), F.count("*").alias("rows"))
    rows = binned.collect()
    levels = np.array([(row["bin"] + 0.5) / BINS * 2 * REACH - REACH for row in rows])
    slope, shift = _logistic(levels, np.array([float(row["ones"]) for row in rows]), np.array([float(row["rows"]) for row in rows]))
    return QuadraticModel(raw.rates, raw.means, raw.inverses, raw.offset, slope, shift)


def _score_batches(model: QuadraticModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = model.score(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``.

    Only labels of documents that are not held out are learned from.
    """
    counts = settle(counted(docs), "counts")
    scored = counts.mapInArrow(_score_batches(fit(counts, labels)), "doc_id bigint, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
