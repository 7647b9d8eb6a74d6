"""Encoding and decoding with a word-end BPE vocabulary: speculate, verify, repair.

The greedy longest match proposes the tokens of a word.  The proposal is the encoding
exactly when every adjacent pair of tokens is compatible (see ``bpe``), which is looked up
for all pairs of all new words of a batch at once in a sorted array of known
pairs.  Only words with a pair that fails are merged in full.

White space never belongs to a token, so a text is cut at ASCII white space, and what a Python
worker has encoded before is not encoded again.  That memory is bounded.

Defined cases: a null text is the empty text and has no ids; strings of special
tokens inside a text become those tokens; a text is never truncated; rows that
repeat stay rows of their own; other columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.bpe import Pairs, merge
from postmill.llm.text_batches import texts
from postmill.llm.worker_memory import kept

REMEMBERED = 600_000
PAIRS_REMEMBERED = 4_000_000
PORTION = 2_000_000
# Cuts at ASCII white space, and between a letter and a full stop or comma, where no token
# crosses either; other white space stays inside a cut and is dealt with there.
CUT = re.compile(r"[A-Za-zß-öø-ÿ]+(?=[., \t-\r]|$)|[^ \t-\r]+")


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, others move past 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [byte for byte in range(256) if byte not in plain]
    return {byte: chr(byte) for byte in plain} | {byte: chr(256 + i) for i, byte in enumerate(moved)}


class WordCodec:
    """A tokenizer file with NFC, lower case, a splitting pattern and BPE with a word-end suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = [step["type"] for step in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError("This codec reads BPE files with NFC, one space and lower case, and no decoder.")
        self.suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        self.tokens = {number: token for token, number in (self.ids | self.special).items()}
        self.width = max(self.tokens) + 1
        ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.rank = ranks.get
        self.pairs = Pairs(self.rank, self._symbols)
        self.longest = max(map(len, self.ids))
        # The file's white space is Unicode's; Python's class has four separators more.
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.letters = str.maketrans(byte_letters())
        self.known: dict[str, tuple[bytes, str]] = {}
        self.known_words: dict[str, list[int]] = {}
        self.pair_keys = np.zeros(0, dtype=np.int64)
        self.pair_fits = np.zeros(0, dtype=bool)

    def _symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            letters = list(token.removesuffix(self.suffix))
            return [*letters[:-1], letters[-1] + self.suffix]
        return list(token)

    # Cuts to words

    def split(self, cut: str) -> Iterator[str | int]:
        """Words of a cut in the byte alphabet, and ids of the special tokens in it."""
        for piece in self.specials.split(cut) if "<|" in cut else (cut,):
            if piece in self.special:
                yield self.special[piece]
                continue
            if not piece.isascii():
                # The lower case wanted is that of single letters: no final sigma.
                piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
            for word in self.words.findall(piece.lower()):
                yield word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)

    # Words to ids

    def propose(self, word: str) -> list[int]:
        """Greedy longest match."""
        found, start, end = [], 0, len(word)
        ids, suffix = self.ids, self.suffix
        while start < end:
            number = ids.get(word[start:] + suffix) if end - start <= self.longest else None
            stop = end
            if number is None:
                for stop in range(min(end - 1, start + self.longest), start, -1):
                    number = ids.get(word[start:stop])
                    if number is not None:
                        break
            if number is None:
                raise ValueError(f"The vocabulary has no token for {word[start]!r}.")
            found.append(number)
            start = stop
        return found

    def _fits(self, keys: np.ndarray) -> np.ndarray:
        """Compatibility of pairs given as left id times width plus right id."""
        unique, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.pair_keys, unique)
        seen = np.zeros(len(unique), dtype=bool)
        inside = at < len(self.pair_keys)
        seen[inside] = self.pair_keys[at[inside]] == unique[inside]
        fresh = unique[~seen]
        if len(fresh):
            tested = [self.pairs.fits(self.tokens[key // self.width], self.tokens[key % self.width]) for key in fresh.tolist()]
            if len(self.pair_keys) > PAIRS_REMEMBERED:
                seen_keys, seen_fits = unique[seen], self.pair_fits[at[seen]]
            else:
                seen_keys, seen_fits = self.pair_keys, self.pair_fits
            keys_now = np.concatenate([seen_keys, fresh])
            order = np.argsort(keys_now, kind="stable")
            self.pair_keys = keys_now[order]
            self.pair_fits = np.concatenate([seen_fits, np.array(tested, dtype=bool)])[order]
        return self.pair_fits[np.searchsorted(self.pair_keys, unique)][back]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word: proposals of which all pairs fit, exact merging for the others."""
        proposals = [self.propose(word) for word in words]
        sizes = np.fromiter(map(len, proposals), dtype=np.int64, count=len(proposals))
        flat = np.fromiter((number for ids in proposals for number in ids), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = owner[1:] == owner[:-1]
        fails = np.zeros(len(words), dtype=bool)
        if inner.any():
            fits = self._fits(flat[:-1][inner] * self.width + flat[1:][inner])
            fails[owner[1:][inner][~fits]] = True
        for place in np.flatnonzero(sizes == 1).tolist():
            fails[place] = not self.pairs.stands(self.tokens[proposals[place][0]])
        for place in np.flatnonzero(fails).tolist():
            merged = merge(self._symbols(words[place] + self.suffix), self.rank)
            proposals[place] = [self.ids[token] for token in merged]
        return proposals

    # Texts

    def learn(self, cuts: Iterable[str]) -> None:
        """Encode cuts that are not known yet."""
        splits = {cut: list(self.split(cut)) for cut in cuts}
        words = list({word for split in splits.values() for word in split if isinstance(word, str)} - self.known_words.keys())
        if len(self.known_words) + len(words) > REMEMBERED:
            self.known_words.clear()
            words = list({word for split in splits.values() for word in split if isinstance(word, str)})
        self.known_words.update(zip(words, self.encode_words(words), strict=True))
        for cut, split in splits.items():
            ids = [number for word in split for number in (self.known_words[word] if isinstance(word, str) else (word,))]
            self.known[cut] = (np.array(ids, dtype="<u4").tobytes(), self.decode(ids))

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by spaces, as the file names no decoder; unknown ids are skipped."""
        return " ".join(token for number in ids if (token := self.tokens.get(number)) is not None)

    def round_trip(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids as little-endian 32-bit numbers, and the decoded text, of each text."""
        cuts = [CUT.findall(text) for text in texts]
        fresh = set().union(*cuts) - self.known.keys()
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = set().union(*cuts)
        self.learn(fresh)
        known = self.known
        pieces = [[known[cut] for cut in row] for row in cuts]
        return [(b"".join([ids for ids, _ in row]), " ".join([text for _, text in row if text])) for row in pieces]


@kept
def codec(path: str) -> WordCodec:
    """One codec for each Python worker."""
    return WordCodec(path)


def portions(texts: list[str]) -> Iterator[range]:
    """Runs of texts of about ``PORTION`` characters; a longer text is a run of its own."""
    start = size = 0
    for place, text in enumerate(texts):
        size += len(text)
        if size >= PORTION:
            yield range(start, place + 1)
            start, size = place + 1, 0
    if start < len(texts):
        yield range(start, len(texts))


def _round_trip_batches(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = codec(path)
        for batch in batches:
            whole = [text or "" for text in batch.column(1).to_pylist()]
            for portion in portions(whole):
                coded = words.round_trip(whole[portion.start : portion.stop])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(portion.start, len(portion)),
                        pa.array([len(ids) // 4 for ids, _ in coded], pa.int64()),
                        pa.array([ids for ids, _ in coded], pa.binary()),
                        pa.array([text for _, text in coded], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    return run


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)``: ids are little-endian unsigned 32-bit numbers.

    ``path`` is a tokenizer file that every executor can read.
    """
    schema = "doc_id bigint, n_tokens bigint, ids binary, decoded string"
    return texts(docs).mapInArrow(_round_trip_batches(path), schema)


def digests(coded: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of what ``round_trip`` gives."""
    decoded = F.sha2(F.encode("decoded", "UTF-8"), 256)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), decoded.alias("decoded_sha256"))


def _decode_batches(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = codec(path)
        for batch in batches:
            decoded = [words.decode(array("I", row or b"")) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.string())], ["doc_id", "decoded"])

    return run


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, decoded)`` of stored ``(doc_id, ids)``."""
    return coded.select("doc_id", "ids").mapInArrow(_decode_batches(path), "doc_id bigint, decoded string")
