"""Alignment of two tokenizers' tokens by byte offsets, with an associative fragment monoid.

Text A is a byte-level BPE encoding of a space and the text, text B a sentencepiece encoding of the text, which
puts the space in front itself.  Where a token of A and one of B end at the same byte, both texts are cut;
what stands between two cuts is a group, and its last two tokens are a link.

A byte range of a text gives a fragment: tokens in front of its first cut (open prefix), whole groups, and tokens
behind its last cut (open suffix); a fragment without a cut is all prefix.  Joining two fragments closes the
suffix of the first with the prefix of the second.  Joining is associative and the empty fragment is its
identity, so a text longer than ``LONG`` characters is dealt over tasks by byte ranges of ``CHUNK`` bytes that
may cut words and groups anywhere, and its fragments are joined by a tree of shuffles, ``FAN`` at a time.
A task encodes the whole words that its range touches and keeps the tokens that end inside the range.
All other texts are folded in their own task, from fragments of words that the worker remembers.

No token of either kind crosses from a character that is no white space into a space or line end, nor from
a letter into a full stop or comma, so texts are cut there for encoding; the constructor checks what of this
the vocabulary tells.

Counts of pairs: a block of texts keeps each distinct pair once, with its links as places in that dictionary.
Dictionaries, not links, are summed over the corpus, joined with the totals and sent back to their blocks.

Defined cases: null and empty texts, and texts whose tokens do not spell a space and the text (the sign
U+2581 is a space to B), have no tokens and no groups; strings of special tokens are plain text; rows that
repeat an id or a text are rows of their own; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.text_batches import texts
from postmill.llm.token_blocks import TextEncoder
from postmill.llm.word_codec import byte_letters
from postmill.llm.worker_memory import kept, release
from postmill.sources.staging import settle

LONG = 1 << 16
CHUNK = 1 << 15
FAN = 8
REMEMBERED = 120_000
CUTS_REMEMBERED = 60_000
# Words that are encoded and cut in one go.
AT_ONCE = 20_000
# Characters of a block of texts.
PORTION = 1_000_000
SPACE = "▁"
_LETTER = "A-Za-zß-öø-ÿ"
# A word with the white space in front of it; cut between other characters and a space or line end, and between
# a letter and a full stop or comma, where no token of either kind crosses.
UNIT = re.compile(rf"\s*[{_LETTER}]+(?=[.,])|\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
Tokens = tuple[int, ...]


# Fragments ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Fragment:
    """Tokens of a byte range: ``before`` its first cut, ``groups`` (as text) with their links, and ``after`` its last.

    Without a cut there is no group and all tokens are in ``before``.  ``sound`` is false where the tokens
    do not spell the text.
    """

    cut: bool = False
    before: tuple[Tokens, Tokens] = ((), ())
    groups: tuple[bytes, ...] = ()
    links: tuple[int, ...] = ()
    after: tuple[Tokens, Tokens] = ((), ())
    sound: bool = True


def group_text(a: Tokens, b: Tokens) -> bytes:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}".encode()


def link_of(a: Tokens, b: Tokens) -> int:
    return a[-1] << 32 | b[-1]


def _meet(one: tuple[Tokens, Tokens], other: tuple[Tokens, Tokens]) -> tuple[Tokens, Tokens]:
    return one[0] + other[0], one[1] + other[1]


def compose(one: Fragment, other: Fragment) -> Fragment:
    """The fragment of two byte ranges that follow each other."""
    sound = one.sound and other.sound
    if not one.cut:
        return Fragment(other.cut, _meet(one.before, other.before), other.groups, other.links, other.after, sound)
    if not other.cut:
        return Fragment(True, one.before, one.groups, one.links, _meet(one.after, other.before), sound)
    closed = _meet(one.after, other.before)
    return Fragment(
        True, one.before, (*one.groups, group_text(*closed), *other.groups), (*one.links, link_of(*closed), *other.links), other.after, sound
    )


def fragment(a: list[tuple[int, int]], b: list[tuple[int, int]], start: int, stop: int) -> Fragment:
    """The fragment of the tokens (id, end) whose end is in (start, stop]."""
    a = [token for token in a if start < token[1] <= stop]
    b = [token for token in b if start < token[1] <= stop]
    both = {end for _, end in a} & {end for _, end in b}
    pieces: list[tuple[Tokens, Tokens]] = []
    sides = []
    for side in (a, b):
        runs, run = [], []
        for number, end in side:
            run.append(number)
            if end in both:
                runs.append(tuple(run))
                run = []
        sides.append((runs, tuple(run)))
    (runs_a, rest_a), (runs_b, rest_b) = sides
    pieces = list(zip(runs_a, runs_b, strict=True))
    if not pieces:
        return Fragment(False, (rest_a, rest_b))
    inner = pieces[1:]
    return Fragment(True, pieces[0], tuple(group_text(*p) for p in inner), tuple(link_of(*p) for p in inner), (rest_a, rest_b))


@dataclass
class Aligned:
    """The alignment of a whole text; without tokens all counts are 0."""

    n_a: int = 0
    n_b: int = 0
    groups: bytes = b""
    links: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    sha256: str = ""

    def closed(self) -> Aligned:
        """The same with the hash of its groups in their place."""
        return Aligned(self.n_a, self.n_b, b"", self.links, hashlib.sha256(self.groups).hexdigest() if self.groups else "")


def whole_text(found: Fragment) -> Aligned:
    """A text starts and ends with a cut."""
    if not found.sound or not found.cut or any(found.after):
        return Aligned()
    groups = b";".join((group_text(*found.before), *found.groups))
    sides = [side.split(b"|") for side in groups.split(b";")]
    n_a, n_b = (sum(side[i].count(b",") + 1 for side in sides) for i in (0, 1))
    return Aligned(n_a, n_b, groups, np.array([link_of(*found.before), *found.links], dtype=np.int64))


# Words ----------------------------------------------------------------------------------


class Aligner:
    """Two tokenizers; the groups of words that it has aligned are remembered."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = TextEncoder(byte_level)
        self.a.tokenizer.encode_special_tokens = True
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=False)
        from_letter = {letter: byte for byte, letter in byte_letters().items()}
        self.a_bytes = {number: bytes(from_letter[letter] for letter in token) for token, number in vocabulary.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        plain = [name for i, name in enumerate(names) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        if any(re.search(f"[^{SPACE}]{SPACE}|\n|[{_LETTER}][.,]", name) for name in plain):
            raise ValueError("A piece runs over the end of a word or a line.")
        self.b_bytes = [bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace(SPACE, " ").encode() for i, name in enumerate(names)]
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, dtype=np.int64)
        self.a_sizes[list(self.a_bytes)] = list(map(len, self.a_bytes.values()))
        self.b_sizes = np.array(list(map(len, self.b_bytes)))
        # Every id as text with the sign that can stand behind it.
        ids = range(max(len(self.a_sizes), len(self.b_sizes)))
        self.commas, self.bars, self.ends = (np.array([f"{i}{sign}".encode() for i in ids], dtype=object) for sign in ",|;")
        self.again: set[str] = set()
        self.known: dict[str, tuple[int, int, bytes, bytes] | None] = {}

    def _piece_ids(self, units: list[str]) -> list[list[int]]:
        """Ids of B.  It puts a space in front of what it encodes: a unit's own, or one before a line end that is
        taken off again; in front of nothing it puts none."""
        coded = self.b.encode([unit[1:] if unit[0] == " " else unit if unit[0] == "\n" else "\n" + unit for unit in units], num_threads=1)
        alone = [self.b.piece_to_id(SPACE)]
        drop = [0 if unit[0] == " " else 1 if unit[0] == "\n" else 2 for unit in units]
        return [alone if unit == " " else ids[skip:] for unit, skip, ids in zip(units, drop, coded, strict=True)]

    def learn(self, units: list[str]) -> None:
        # Words are remembered with their groups; the encoder's own memory only serves those that are new.
        if len(self.a.known) > CUTS_REMEMBERED:
            self.a.known.clear()
        for at in range(0, len(units), AT_ONCE):
            self._learn(units[at : at + AT_ONCE])

    def _learn(self, units: list[str]) -> None:
        """Remember ``units``; those whose tokens do not spell them as None."""
        a_ids, b_ids = self.a.encode(units), self._piece_ids(units)
        n_a, n_b = np.array([len(ids) // 4 for ids in a_ids]), np.array(list(map(len, b_ids)))
        a = np.frombuffer(b"".join(a_ids), dtype="<u4").astype(np.int64)
        b = np.fromiter(chain.from_iterable(b_ids), np.int64, int(n_b.sum()))
        own = [unit.encode() for unit in units]
        whole = b"".join(own)
        if whole != b"".join(map(self.a_bytes.__getitem__, a.tolist())) or whole != b"".join(map(self.b_bytes.__getitem__, b.tolist())):
            coded = zip(own, a_ids, b_ids, strict=True)
            sound = [self._spells(spelled, np.frombuffer(ids, dtype="<u4").tolist(), pieces) for spelled, ids, pieces in coded]
            if not all(sound):
                self.known.update((unit, None) for unit, good in zip(units, sound, strict=True) if not good)
                if any(sound):
                    self._learn([unit for unit, good in zip(units, sound, strict=True) if good])
                return
        groups, links, links_until = self._closed(a, b)
        until = np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
        links_at = [0, *links_until[np.cumsum(n_a) - 1].tolist()]
        packed = links.tobytes()
        for i, unit in enumerate(units):
            own_groups = b"".join(groups[until[i] : until[i + 1]])[:-1]
            self.known[unit] = (int(n_a[i]), int(n_b[i]), own_groups, packed[8 * links_at[i] : 8 * links_at[i + 1]])

    def _spells(self, own: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == own == b"".join(map(self.b_bytes.__getitem__, b))

    def _closed(self, a: np.ndarray, b: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Tokens of units in a row, which begin and end with a cut: all tokens as text in the order of the groups, each
        with the sign behind it; the links; and the links up to each token of A."""
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        cut_a, cut_b = (own[np.searchsorted(own, other).clip(max=len(own) - 1)] == other for own, other in ((ends_b, ends_a), (ends_a, ends_b)))
        last_a, last_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
        # A token stands behind all of the groups before its own, and one of B behind those of A in its group.
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        spelled = np.empty(len(a) + len(b), dtype=object)
        spelled[np.arange(len(a)) + np.concatenate(([0], last_b + 1))[group_a]] = np.where(cut_a, self.bars[a], self.commas[a])
        spelled[np.arange(len(b)) + (last_a + 1)[group_b]] = np.where(cut_b, self.ends[b], self.commas[b])
        return spelled.tolist(), a[cut_a] << 32 | b[cut_b], np.cumsum(cut_a)

    def _know(self, wanted: set[str]) -> None:
        """Learn what is new of ``wanted``.  When the memory is full, words that were asked for again stay."""
        found = wanted & self.known.keys()
        self.again |= found
        if len(self.known) + len(wanted) - len(found) > REMEMBERED:
            self.known = {unit: self.known[unit] for unit in self.again}
            self.again = set()
            if len(self.known) + len(wanted) - len(found) > REMEMBERED:
                self.known, found = {}, set()
        self.learn(list(wanted - found))

    def units(self, batch: list[str]) -> list[list[str]]:
        """Units of each text, a space put in front, all of them known afterwards."""
        cut = [UNIT.findall(" " + text) if text else [] for text in batch]
        self._know(set().union(*cut))
        return cut

    def align(self, batch: list[str]) -> list[Aligned]:
        out = []
        for cut in self.units(batch):
            found = list(map(self.known.__getitem__, cut))
            if not found or None in found:
                out.append(Aligned())
                continue
            n_a, n_b, groups, links = zip(*found, strict=True)
            out.append(Aligned(sum(n_a), sum(n_b), b";".join(groups), np.frombuffer(b"".join(links), dtype=np.int64)))
        return out

    def range_fragment(self, span: str, offset: int, start: int, stop: int) -> Fragment:
        """The fragment of the bytes (start, stop] of a text, of which ``span`` are the whole units from ``offset`` on."""
        a: list[tuple[int, int]] = []
        b: list[tuple[int, int]] = []
        units = UNIT.findall(span)
        for at in range(0, len(units), REMEMBERED // 4):
            part = units[at : at + REMEMBERED // 4]
            self._know(set(part))
            for unit in part:
                known = self.known[unit]
                if known is None:
                    return Fragment(sound=False)
                ends = [offset, offset]
                for group in known[2].split(b";"):
                    for side, (ids, tokens, spelled) in enumerate(zip(group.split(b"|"), (a, b), (self.a_bytes, self.b_bytes), strict=True)):
                        for number in map(int, ids.split(b",")):
                            ends[side] += len(spelled[number])
                            tokens.append((number, ends[side]))
                offset = ends[0]
        return fragment(a, b, start, stop)


@kept
def aligner(byte_level: str, pieces: str) -> Aligner:
    """One aligner for each Python worker."""
    return Aligner(byte_level, pieces)


# Blocks ---------------------------------------------------------------------------------

BLOCKS = (
    "doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_links array<bigint>, groups_sha256 array<string>, "
    "pairs array<bigint>, counts array<bigint>, links binary"
)


def _block(docs: list[int | None], found: list[Aligned]) -> pa.RecordBatch:
    links = np.concatenate([row.links for row in found])
    pairs, places, counts = np.unique(links, return_inverse=True, return_counts=True)
    values = {
        "doc_ids": ([docs], pa.list_(pa.int64())),
        "n_a": ([[row.n_a for row in found]], pa.list_(pa.int64())),
        "n_b": ([[row.n_b for row in found]], pa.list_(pa.int64())),
        "n_links": ([[len(row.links) for row in found]], pa.list_(pa.int64())),
        "groups_sha256": ([[row.sha256 for row in found]], pa.list_(pa.string())),
        "pairs": ([pairs], pa.list_(pa.int64())),
        "counts": ([counts], pa.list_(pa.int64())),
        "links": ([places.astype("<u4").tobytes()], pa.binary()),
    }
    return pa.RecordBatch.from_arrays([pa.array(value, kind) for value, kind in values.values()], list(values))


def _short_batches(byte_level: str, pieces: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(byte_level, pieces).align
        for batch in batches:
            if not batch.num_rows:
                continue
            docs, portion, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(doc)
                portion.append(text.as_py() or "")
                size += len(portion[-1])
                if size >= PORTION:
                    yield _block(docs, list(map(Aligned.closed, align(portion))))
                    docs, portion, size = [], [], 0
            if docs:
                yield _block(docs, list(map(Aligned.closed, align(portion))))

    return run


# Long texts -----------------------------------------------------------------------------

RANGES = "row bigint, doc_id bigint, place bigint, start bigint, stop bigint, offset bigint, span string"
FRAGMENTS = (
    "row bigint, doc_id bigint, place bigint, cut boolean, sound boolean, before_a array<bigint>, before_b array<bigint>, "
    "after_a array<bigint>, after_b array<bigint>, groups binary, links binary"
)


def byte_ranges(text: str, chunk: int = CHUNK) -> Iterator[tuple[int, int, int, str]]:
    """(start, stop, offset, span) of the ranges of a space and the text: ``span`` holds the whole units that the range
    touches and begins at byte ``offset``.  A range ends after ``chunk`` bytes, or where a longer unit ends."""
    start, offset, end = 0, 0, 0
    span: list[str] = []
    for unit in UNIT.findall(" " + text):
        size = len(unit.encode())
        span.append(unit)
        end += size
        while end - start >= chunk:
            stop = end if size > chunk else start + chunk
            yield start, stop, offset, "".join(span)
            start = stop
            # The unit belongs to the next range too where that begins inside it.
            span, offset = ([unit], end - size) if stop < end else ([], end)
    if start < end:
        yield start, end, offset, "".join(span)


def _range_batches(chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for place, (start, stop, offset, span) in enumerate(byte_ranges(text.as_py(), chunk)):
                    values = [row, doc, place, start, stop, offset]
                    arrays = [pa.array([value], pa.int64()) for value in values] + [pa.array([span], pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "place", "start", "stop", "offset", "span"])

    return run


def _packed(row: int, doc: int | None, place: int, found: Fragment) -> pa.RecordBatch:
    ids = pa.list_(pa.int64())
    values = [
        ("row", row, pa.int64()),
        ("doc_id", doc, pa.int64()),
        ("place", place, pa.int64()),
        ("cut", found.cut, pa.bool_()),
        ("sound", found.sound, pa.bool_()),
        ("before_a", list(found.before[0]), ids),
        ("before_b", list(found.before[1]), ids),
        ("after_a", list(found.after[0]), ids),
        ("after_b", list(found.after[1]), ids),
        ("groups", b";".join(found.groups), pa.binary()),
        ("links", np.array(found.links, dtype="<i8").tobytes(), pa.binary()),
    ]
    return pa.RecordBatch.from_arrays([pa.array([value], kind) for _, value, kind in values], [name for name, *_ in values])


def _fragments(batch: pa.RecordBatch) -> Iterator[tuple[int, int | None, int, Fragment]]:
    for r in batch.to_pylist():
        groups = tuple(r["groups"].split(b";")) if r["groups"] else ()
        links = tuple(np.frombuffer(r["links"], dtype="<i8").tolist())
        before, after = ((tuple(r[f"{name}_a"]), tuple(r[f"{name}_b"])) for name in ("before", "after"))
        yield r["row"], r["doc_id"], r["place"], Fragment(r["cut"], before, groups, links, after, r["sound"])


def _fragment_batches(byte_level: str, pieces: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(byte_level, pieces)
        for batch in batches:
            for r in batch.to_pylist():
                found = known.range_fragment(r["span"], r["offset"], r["start"], r["stop"])
                yield _packed(r["row"], r["doc_id"], r["place"], found)

    return run


def _compose_batches(fan: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fragments sorted by row and place to one for each ``fan`` places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for row, doc, place, found in _fragments(batch):
                if held and held[0] == row and held[2] == place // fan:
                    held = (row, doc, place // fan, compose(held[3], found))
                else:
                    if held:
                        yield _packed(*held)
                    held = (row, doc, place // fan, found)
        if held:
            yield _packed(*held)

    return run


def _long_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, doc, _, found in _fragments(batch):
            yield _block([doc], [whole_text(found).closed()])


def _composed(docs: DataFrame, byte_level: str, pieces: str, chunk: int, fan: int) -> DataFrame:
    """One fragment for each row of ``docs(doc_id, text)``, joined over tasks."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    ranges = settle(numbered.mapInArrow(_range_batches(chunk), RANGES), "ranges")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = ranges.repartition(tasks, "row", "place").mapInArrow(_fragment_batches(byte_level, pieces), FRAGMENTS)
    found = settle(coded, "fragments")
    last = found.agg(F.max("place")).first()[0] or 0
    while last:
        dealt = found.repartition(tasks, F.col("row"), F.floor(F.col("place") / fan)).sortWithinPartitions("row", "place")
        found = settle(dealt.mapInArrow(_compose_batches(fan), FRAGMENTS), "fragments")
        last //= fan
    return found


# Counts ---------------------------------------------------------------------------------


def _scored_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the corpus counts of their pairs, in order, to a row for each text."""
    release()
    for batch in batches:
        for r in batch.to_pylist():
            totals = np.array([pair["total"] for pair in r["found"] or ()], dtype=np.int64)
            best = np.array([pair["best"] for pair in r["found"] or ()], dtype=np.int64)
            places = np.frombuffer(r["links"], dtype="<u4")
            ends = np.cumsum(r["n_links"])
            sums = [np.concatenate(([0], np.cumsum(values[places]) if len(places) else [])).astype(np.int64) for values in (best, totals)]
            n_best, count_sum = (s[ends] - s[ends - r["n_links"]] for s in sums)
            arrays = [r["doc_ids"], r["n_a"], r["n_b"], r["n_links"], r["n_links"], n_best, count_sum]
            columns = [pa.array(values, pa.int64()) for values in arrays] + [pa.array(r["groups_sha256"], pa.string())]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``(pair, total, best)``: links of each pair of ids in the whole corpus, and whether no pair with the
    same id of B has more."""
    entries = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("entry")).select("entry.*")
    totals = settle(entries.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("total")), "pair-totals")
    of_b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    highest = totals.groupBy(of_b).agg(F.max("total").alias("highest"))
    joined = totals.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))).join(highest, "b")
    return joined.select("pair", "total", (F.col("total") == F.col("highest")).cast("int").alias("best"))


def align_blocks(docs: DataFrame, byte_level: str, pieces: str, long: int = LONG, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Blocks of aligned texts with their dictionaries of linked pairs; paths are readable on every executor."""
    rows = texts(docs)
    is_long = F.coalesce(F.char_length("text") > long, F.lit(False))
    short = rows.filter(~is_long).mapInArrow(_short_batches(byte_level, pieces), BLOCKS)
    composed = _composed(rows.filter(is_long), byte_level, pieces, chunk, fan)
    both = short.unionByName(composed.mapInArrow(_long_blocks, BLOCKS))
    return settle(both.withColumn("block", F.monotonically_increasing_id()), "blocks")


def align(docs: DataFrame, byte_level: str, pieces: str, long: int = LONG, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row of ``docs``."""
    blocks = align_blocks(docs, byte_level, pieces, long, chunk, fan)
    counted = settle(pair_counts(blocks), "pair-counts")
    entries = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    found = entries.join(counted, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "total", "best"))).alias("found"))
    names = ["doc_ids", "n_a", "n_b", "n_links", "groups_sha256", "links", "found"]
    scored = blocks.join(found, "block", "left").select(*names)
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return scored.mapInArrow(_scored_batches, schema)
