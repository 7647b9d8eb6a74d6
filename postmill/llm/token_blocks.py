"""Token ids in fixed-width bit-packed blocks.

A block is a run of whole documents in ascending ``doc_id`` order; each id takes the
least number of bits that the vocabulary needs.  Its row holds the payload and, per
document, where its ids start and how many there are, so numpy unpacks any span
of a block at once and any document is found by its id.  Blocks are numbered inside the
part that wrote them, with the ids ``before`` them in it; parts follow each other in document
order, and the ids in front of a part come from one small table of part sizes.

The container is Parquet, written by Spark: it needs no file system but Spark's own,
a failed task leaves nothing behind, and readers prune blocks by ``first_doc`` and
``last_doc``.

Defined cases: a null text is the empty text, whose only id is the end id; null
ids come first; rows that repeat an id are documents of their own, ordered by text; a
long document makes a long block and is never cut; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postmill.llm.text_batches import texts
from postmill.llm.word_codec import byte_letters
from postmill.llm.worker_memory import kept

END = 2
BLOCK_IDS = 1 << 17
REMEMBERED = 1_200_000
PORTION = 2_000_000
SCHEMA = (
    "part int, block int, bits int, before bigint, n_ids bigint, first_doc bigint, last_doc bigint, payload binary, "
    "doc_ids array<bigint>, starts array<bigint>, counts array<bigint>"
)
# Unicode white space.  A token never crosses from another character into white space, nor
# from a letter into a full stop or comma; cutting at both leaves fewer cuts to remember.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = "A-Za-zß-öø-ÿ"
WORD = re.compile(f" ?[{_LETTER}]+")
# A line end, a word and signs: the library's pattern ends a piece between them.
WORD_AND_SIGNS = re.compile(f"([\t-\r]?)((?<![\t-\r]) ?[{_LETTER}]+|[{_LETTER}]+)([!#$%&*+@?:;.,=~^|<>()-]*)")
CUT = re.compile(f"[{_SPACE}]*[{_LETTER}]+(?=[.,{_SPACE}]|$)|[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


# Bits ------------------------------------------------------------------------------


def width(vocabulary: int) -> int:
    """Bits that the ids below ``vocabulary`` need."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits for each id, least significant first."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError("An id does not fit the width.")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from the one numbered ``start``, reading only their bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    first, last = start * bits, (start + count) * bits
    window = np.frombuffer(payload, np.uint8, -(-last // 8) - first // 8, first // 8)
    flags = np.unpackbits(window, bitorder="little")[first % 8 : first % 8 + count * bits].reshape(count, bits)
    return (flags.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1).astype(np.uint32)


# Encoding ----------------------------------------------------------------------------


class _Known(dict):
    """Ids of the cuts seen so far as little-endian 32-bit numbers; a new cut is encoded when it is asked for."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.letters = str.maketrans(byte_letters())
        self.space = " ".translate(self.letters)
        # Every piece is asked for once, so the model's own memory of pieces only costs time.
        self.model._resize_cache(0)

    def __missing__(self, cut: str) -> bytes:
        """A word of letters is one piece of the library's splitting pattern, so its model is
        asked directly; a line end before it and signs behind it are pieces of their own, which
        are mostly known; everything else takes the whole way."""
        parts = WORD_AND_SIGNS.fullmatch(cut)
        if parts and parts[2] != cut:
            coded = b"".join([self[part] for part in parts.groups() if part])
        elif WORD.fullmatch(cut):
            # ASCII letters stand for themselves.
            piece = cut.replace(" ", self.space) if cut.isascii() else cut.encode().decode("latin-1").translate(self.letters)
            coded = array("I", [token.id for token in self.model.tokenize(piece)]).tobytes()
        else:
            coded = array("I", self.tokenizer.encode_batch_fast([cut], add_special_tokens=False)[0].ids).tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[cut] = coded
        return coded


class TextEncoder:
    """A byte-level tokenizer; cuts of texts that it has encoded are remembered."""

    def __init__(self, path: str) -> None:
        # Spark runs a worker for each core; threads below them only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bits = width(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.known = _Known(self.tokenizer)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        find = self.known.__getitem__
        return [b"".join(map(find, CUT.findall(text))) for text in texts]


@kept
def encoder(path: str) -> TextEncoder:
    """One encoder for each Python worker."""
    return TextEncoder(path)


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[list[int | None], list[str]]]:
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        ids.append(doc_id)
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= PORTION:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


class _Block:
    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.number = self.before = 0
        self.clear()

    def clear(self) -> None:
        self.ids: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        self.size = 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.ids.append(ids)
        self.counts.append(len(ids))
        self.size += len(ids)

    def row(self, part: int) -> pa.RecordBatch:
        counts = np.array(self.counts, dtype=np.int64)
        named = [doc for doc in self.docs if doc is not None]
        values = {
            "part": [part],
            "block": [self.number],
            "bits": [self.bits],
            "before": [self.before],
            "n_ids": [self.size],
            "first_doc": [named[0] if named else None],
            "last_doc": [named[-1] if named else None],
            "payload": [pack(np.concatenate(self.ids), self.bits)],
            "doc_ids": [self.docs],
            "starts": [(np.cumsum(counts) - counts).tolist()],
            "counts": [self.counts],
        }
        kinds = [pa.int32()] * 3 + [pa.int64()] * 4 + [pa.binary()] + [pa.list_(pa.int64())] * 3
        arrays = [pa.array(value, kind) for value, kind in zip(values.values(), kinds, strict=True)]
        self.number += 1
        self.before += self.size
        self.clear()
        return pa.RecordBatch.from_arrays(arrays, list(values))


def _block_batches(path: str, end: int, block_ids: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        coder = encoder(path)
        block = _Block(coder.bits)
        last = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            for docs, texts in _portions(batch):
                for doc, ids in zip(docs, coder.encode(texts), strict=True):
                    block.add(doc, np.frombuffer(ids + last, dtype="<u4"))
                    if block.size >= block_ids:
                        yield block.row(part)
        if block.size:
            yield block.row(part)

    return run


def write_blocks(docs: DataFrame, tokenizer: str, path: str, end: int = END, block_ids: int = BLOCK_IDS) -> None:
    """Encode all texts and write their blocks under ``path``, in ascending ``doc_id`` order.

    Texts are range-partitioned before they are encoded, so the sampling of the ranges
    costs a scan and not an encoding.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts(docs).repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_block_batches(tokenizer, end, block_ids), SCHEMA).write.parquet(path)


# Reading -------------------------------------------------------------------------------


def part_starts(blocks: DataFrame) -> DataFrame:
    """``(part, part_start)``: ids in front of each part; one row per part."""
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("part_start"))


def block_starts(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``start``, the ids of all blocks in front; broadcasts a row per part."""
    placed = blocks.join(F.broadcast(part_starts(blocks)), "part")
    return placed.withColumn("start", F.col("part_start") + F.col("before"))


def _span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            for doc, start, count in zip(row["doc_ids"], row["starts"], row["counts"], strict=True):
                ids = unpack(row["payload"], row["bits"], start, count).astype("<u4").tobytes()
                arrays = [[doc], [row["start"] + start], [count], [zlib.crc32(ids)], [ids]]
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value, kind) for value, kind in zip(arrays, kinds, strict=True)],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            whole = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")
            spans = zip(row["starts"], row["counts"], strict=True)
            digests = [zlib.crc32(whole[start : start + count].tobytes()) for start, count in spans]
            starts = np.array(row["starts"], dtype=np.int64) + row["start"]
            arrays = [row["doc_ids"], starts, row["counts"], digests]
            yield pa.RecordBatch.from_arrays(
                [pa.array(value, pa.int64()) for value in arrays], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )


_READ = ["start", "bits", "n_ids", "payload", "doc_ids", "starts", "counts"]
_DIGESTS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the blocks under ``path``."""
    blocks = block_starts(spark.read.parquet(path))
    return blocks.select(*_READ).mapInArrow(_digest_batches, _DIGESTS)


def read_documents(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The same with ``ids`` (little-endian 32-bit) for the documents from ``first`` to ``last``;
    blocks outside are pruned by their document range."""
    blocks = block_starts(spark.read.parquet(path)).filter((F.col("last_doc") >= first) & (F.col("first_doc") <= last))
    found = blocks.select(*_READ).mapInArrow(_span_batches, _DIGESTS + ", ids binary")
    return found.filter(F.col("doc_id").between(first, last))
