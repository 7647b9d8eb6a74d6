"""Language identification with a string kernel.

The kernel of two texts is the number of byte n-grams (n from 1 to 4, lower case) that are
present in both, over the geometric mean of their own numbers; grams of three and
four bytes are hashed.  Kernel ridge regression, one language against the rest, is
solved on Nyström landmarks.  A landmark only sees grams it has itself, so all landmarks
together are one sparse matrix over their grams; its product with the ridge weights is folded once, and
a batch of texts is scored by one product of its presence matrix with it.

Fitting uses a sample whose size per language is a parameter: documents with the least
hashes of their ids, of which the first are the landmarks.  Its grams, not its texts, reach the
driver, one row of at most ``SLOTS`` numbers for each sampled document.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every
text when there is nothing to learn from; a null ``doc_id`` is not held out; rows with a null
language are not learned from; of equal scores the first language in code point order
wins; rows that repeat stay rows of their own; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.quality import held_out
from postmill.llm.text_batches import bound_batches
from postmill.llm.worker_memory import release

UNKNOWN = "und"
SAMPLE = 240
LANDMARKS = 40
RIDGE = 1e-3
BATCH = 32
HASH_BITS = 17
STARTS = (0, 256, 256 + (1 << 16), 256 + (1 << 16) + (1 << HASH_BITS))
SLOTS = STARTS[3] + (1 << HASH_BITS)
_SPREAD = np.uint32(2654435761)
_LETTER = regex.compile(r"\p{L}")


def gram_slots(text: str) -> Iterator[np.ndarray]:
    """Slots of the 1- to 4-grams of a text, repeats included."""
    letters = np.frombuffer(text.lower().encode(), dtype=np.uint8).astype(np.uint32)
    code = letters
    for n, start in enumerate(STARTS, 1):
        if n > 1:
            if len(letters) < n:
                return
            code = (code[:-1] << np.uint32(8)) | letters[n - 1 :]
        yield start + (code if n < 3 else (code * _SPREAD) >> np.uint32(32 - HASH_BITS)).astype(np.int64)


def present(text: str) -> np.ndarray:
    """Sorted slots of the grams that a text has."""
    flags = np.zeros(SLOTS, dtype=bool)
    for slots in gram_slots(text):
        flags[slots] = True
    return np.flatnonzero(flags).astype(np.int32)


@dataclass(frozen=True)
class KernelModel:
    """``places`` maps a slot to a row of ``weights`` or to the row behind the last."""

    languages: tuple[str, ...]
    places: np.ndarray
    weights: np.ndarray

    def score(self, rows: list[str]) -> np.ndarray:
        """One-versus-rest values of each text."""
        grams = len(self.weights)
        flags = np.zeros((len(rows), grams + 1), dtype=np.uint8)
        for i, text in enumerate(rows):
            for slots in gram_slots(text):
                flags[i, self.places[slots]] = 1
        seen = flags[:, :grams].astype(np.float32)
        norms = np.sqrt(np.maximum(seen.sum(axis=1), 1.0))
        return (seen @ self.weights) / norms[:, None]


def solve(languages: list[str], grams: list[np.ndarray], landmarks: int, ridge: float = RIDGE) -> KernelModel:
    """The model of a sample, in which each language's landmarks come first.

    ``grams`` are the present slots of a document of the language at the same place.
    """
    names = tuple(sorted(set(languages)))
    order = {name: 0 for name in names}
    chosen = []
    for i, name in enumerate(languages):
        if order[name] < landmarks:
            chosen.append(i)
        order[name] += 1
    vocabulary = np.unique(np.concatenate([grams[i] for i in chosen]))
    places = np.full(SLOTS, len(vocabulary), dtype=np.int32)
    places[vocabulary] = np.arange(len(vocabulary), dtype=np.int32)
    known = [row[row < len(vocabulary)] for row in (places[g] for g in grams)]

    def dense(rows: list[int]) -> np.ndarray:
        out = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
        for i, row in enumerate(rows):
            out[i, known[row]] = 1
        return out / np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1.0))

    marks = dense(chosen)
    kernel = np.vstack([dense(list(range(i, min(i + BATCH, len(grams))))) @ marks.T for i in range(0, len(grams), BATCH)]).astype(np.float64)
    inner = (marks @ marks.T).astype(np.float64)
    wanted = np.array([[1.0 if name == language else -1.0 for name in names] for language in languages])
    left = kernel.T @ kernel + ridge * len(grams) * inner + 1e-9 * np.eye(len(chosen))
    dual = np.linalg.solve(left, kernel.T @ wanted)
    return KernelModel(names, places, (marks.T @ dual).astype(np.float32))


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = [present(text or "").tobytes() for text in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grams, pa.binary())], ["lang", "turn", "grams"])


def fit(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> KernelModel | None:
    """The model of at most ``sample`` documents of each language; None where there are none."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {row["lang"]: row["rows"] for row in known.groupBy("lang").agg(F.count("*").alias("rows")).collect()}
    if not sizes:
        return None
    # About twice the sample by hash, which bounds what is ordered, then the first of it.
    shares = F.create_map(*(F.lit(x) for name, rows in sizes.items() for x in (name, min(1.0, 2.0 * sample / rows))))
    key = F.xxhash64("doc_id")
    drawn = known.filter(F.pmod(key, F.lit(1 << 30)) < shares[F.col("lang")] * float(1 << 30))
    bound_batches(docs)
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(key, "doc_id", "text"))
    chosen = drawn.withColumn("turn", turn).filter(F.col("turn") <= sample)
    rows = chosen.select("lang", "turn", "text").mapInArrow(_gram_batches, "lang string, turn int, grams binary").collect()
    rows.sort(key=lambda row: (row["lang"], row["turn"]))
    return solve([row["lang"] for row in rows], [np.frombuffer(row["grams"], dtype=np.int32) for row in rows], landmarks)


def _predict_batches(model: KernelModel | None, at_text: int, names_of: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with the prediction and its score behind their own columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            whole = batch.column(at_text).to_pylist()
            told = [i for i, text in enumerate(whole) if model and text and _LETTER.search(text)]
            for at in range(0, len(told), BATCH):
                rows = told[at : at + BATCH]
                values = model.score([whole[i] for i in rows])
                best = values.argmax(axis=1)
                scores[rows] = np.clip((values.max(axis=1) + 1) / 2, 0, 1)
                for i, k in zip(rows, best.tolist(), strict=True):
                    names[i] = model.languages[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], names_of)

    return run


def predict(docs: DataFrame, model: KernelModel | None, lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two columns more, whose names must be free; the model is a few megabytes."""
    bound_batches(docs)
    schema = T.StructType([*docs.schema, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(_predict_batches(model, docs.columns.index("text"), schema.names), schema)


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``; learned from documents that are not held out."""
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
