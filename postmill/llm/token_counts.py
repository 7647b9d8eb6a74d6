"""Exact token counts at every prefix, by dynamic programming over the vocabulary.

For each prefix of a text the last token of its encoding is found among the pieces
that end there: the one that fits the last token of the prefix in front of it.
The count is then one more than that prefix's.  Counts at all prefixes answer
truncation and budget questions without encoding again.

No piece holds a word sign behind another character, so no merge crosses
the space in front of a word; a text is cut there, and a cut that was seen
before by the Python worker is not counted again.  That memory is bounded.

Defined cases: a null text is the empty text and has no tokens; a text is never
truncated, whatever its length; rows that repeat stay rows of their own; other columns are
not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate
from operator import itemgetter

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from postmill.llm.bpe import Pairs
from postmill.llm.text_batches import texts
from postmill.llm.worker_memory import kept

SPACE = "▁"
REMEMBERED = 1_200_000
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint"


class PrefixCounter:
    """Prefix counts under a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        if not any(model.is_byte(i) for i in ids) or any(model.is_unused(i) for i in ids):
            raise ValueError("Only models with byte fallback and without unused pieces are counted.")
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        crossing = [piece for piece in scores if re.search(f"[^{SPACE}]{SPACE}", piece)]
        self.letters = {letter for piece in scores for letter in piece}
        if crossing or "\n" in self.letters:
            raise ValueError("A piece runs over the end of a word or a line.")

        def rank(pair: tuple[str, str], never: float) -> float:
            return -scores.get(pair[0] + pair[1], -never)

        self.pairs = Pairs(rank, list)
        # A letter that is only part of pieces stands for its bytes when left alone.
        tokens = list(scores) + sorted(self.letters - set(scores))
        self.tokens = tokens
        self.costs = [1 if token in scores else len(token.encode()) for token in tokens]
        self.automaton = ahocorasick.Automaton()
        for number, token in enumerate(tokens):
            self.automaton.add_word(token, (number, len(token)))
        self.automaton.make_automaton()
        self.fitting: dict[int, bool] = {}
        self.known: dict[str, array] = {}
        self.cuts = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.runs = re.compile("[" + re.escape("".join(sorted(self.letters))) + "]+|.", re.DOTALL)

    def _fits(self, left: int, right: int) -> bool:
        key = left * len(self.tokens) + right
        fits = self.fitting.get(key)
        if fits is None:
            fits = self.fitting[key] = self.pairs.fits(self.tokens[left], self.tokens[right])
        return fits

    def _run(self, run: str) -> list[int]:
        """Counts at the prefixes of a run of letters that pieces know."""
        last = [-1] * (len(run) + 1)
        counts = [0] * (len(run) + 1)
        fitting, width, costs = self.fitting, len(self.tokens), self.costs
        for end, (number, length) in self.automaton.iter(run):
            start = end + 1 - length
            if start:
                left = last[start]
                fits = fitting.get(left * width + number)
                if fits is None:
                    fits = self._fits(left, number)
            else:
                fits = self.pairs.stands(self.tokens[number])
            if fits:
                last[end + 1] = number
                counts[end + 1] = counts[start] + costs[number]
        return counts[1:]

    def cut_counts(self, cut: str) -> array:
        """Counts at the prefixes of one cut of a text."""
        known = self.known.get(cut)
        if known is not None:
            return known
        counts, total = array("q"), 0
        for run in self.runs.findall(cut):
            if run[0] in self.letters:
                counts.extend(total + count for count in self._run(run))
            else:
                counts.append(total + len(run.encode()))
            total = counts[-1]
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[cut] = counts
        return counts

    def _cuts(self, text: str) -> list[array]:
        """Counts of the cuts, with the sign that the model puts in front of a text."""
        if not text:
            return []
        known = self.known
        cuts = self.cuts.findall(SPACE + text.replace(" ", SPACE))
        return [known.get(cut) or self.cut_counts(cut) for cut in cuts]

    def count(self, text: str) -> int:
        return sum(map(itemgetter(-1), self._cuts(text)))

    def measure(self, text: str, limit: int) -> tuple[int, int]:
        """Tokens of the text, and code points of its longest prefix of at most ``limit`` tokens."""
        cuts = self._cuts(text)
        total = sum(map(itemgetter(-1), cuts))
        if total <= limit:
            return total, len(text)
        place = before = best = 0
        for counts in cuts:
            if before >= limit:
                break
            fitting = [at for at, count in enumerate(counts, 1) if before + count <= limit]
            if fitting:
                best = place + fitting[-1]
            place += len(counts)
            before += counts[-1]
        return total, max(best - 1, 0)

    def prefix_counts(self, text: str) -> list[int]:
        """Count of ``text[:k]`` for every k from 1 to its length."""
        cuts = self._cuts(text)
        starts = accumulate(map(itemgetter(-1), cuts), initial=0)
        whole = [start + count for start, counts in zip(starts, cuts, strict=False) for count in counts]
        return whole[1:]


@kept
def counter(path: str) -> PrefixCounter:
    """One counter for each Python worker."""
    return PrefixCounter(path)


def _count_batches(path: str, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            measured = [counts.measure(text.as_py() or "", limit) for text in batch.column(1)]
            sizes = batch.column(1).cast(pa.binary()).fill_null(b"")
            tokens = [total for total, _ in measured]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pc.binary_length(sizes).cast(pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([total > limit for total in tokens], pa.bool_()),
                    pa.array([fit for _, fit in measured], pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    return run


def count_tokens(docs: DataFrame, model: str, limit: int) -> DataFrame:
    """Bytes and tokens of every text, whether it passes ``limit`` tokens, and how many code
    points of it fit into them.  ``model`` is a path that every executor can read."""
    return texts(docs).mapInArrow(_count_batches(model, limit), SCHEMA)


def _prefix_batches(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            prefixes = [counts.prefix_counts(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "counts"])

    return run


def prefix_counts(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, counts)``: the k-th count is that of the first k code points of the text."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("counts", T.ArrayType(T.LongType()))])
    return texts(docs).mapInArrow(_prefix_batches(model), schema)
