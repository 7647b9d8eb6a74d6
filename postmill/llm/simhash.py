"""SimHash near-duplicates: BK-trees over shards of the distinct fingerprints.

A pair within ``radius`` bits agrees on one of ``radius + 1`` disjoint bit
fields, so a fingerprint goes to the shards of its own fields.  A shard with more
than ``SHARD`` fingerprints is split again by the same argument over the bits
that its members do not share yet, three times over; a shard still too large
is cut into blocks and every pair of blocks is searched.  No shard, task or
group grows with the data, and no link is lost.

In a shard each fingerprint is searched in, then added to, a BK-tree: the children
of a node are keyed by their Hamming distance to it and only the edges within
the radius are followed.  The links found are folded with union-find, so a shard gives
at most one link per member instead of all pairs.

Broadcasting shard trees would send every fingerprint of the corpus to every executor;
trees and queries meet by their shard's key in a shuffle instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.components import components
from postmill.llm.text_batches import texts
from postmill.llm.worker_memory import release
from postmill.sources.staging import settle

SHINGLE = 4
SEED = 42
RADIUS = 4
BITS = 64
SHARD = 1024
LEVELS = 3
CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text, as a signed 64-bit number.

    ``bytes.lower`` folds A-Z only and ``bytes.split`` cuts at space and
    0x09-0x0D only, which are the rules wanted here.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)]
        shingle = 1
    total = len(words) - shingle + 1
    votes = np.zeros(BITS, dtype=np.int64)
    for start in range(0, total, CHUNK):
        part = words[start : start + CHUNK + shingle - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(votes * 2 > total, bitorder="little")
    return int(packed.view("<i8")[0])


def _fingerprint_batches(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            utf8 = batch.column(1).cast(pa.binary())
            prints = [fingerprint(text.as_py() or b"", shingle) for text in utf8]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, print)``; a null text is empty, and a text without words has print 0."""
    return texts(docs).mapInArrow(_fingerprint_batches(shingle), "doc_id bigint, print bigint")


# Shards -------------------------------------------------------------------------


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _fields(mask: int, radius: int) -> list[int]:
    """The bits outside ``mask`` dealt into radius + 1 fields, each joined with ``mask``."""
    free = [bit for bit in range(BITS) if not mask >> bit & 1]
    return [mask | sum(1 << bit for bit in free[i :: radius + 1]) for i in range(radius + 1)]


def _masks(radius: int) -> list[dict[int, list[int]]]:
    """For each level, the masks that refine a mask of the level before."""
    levels, masks = [], [0]
    for _ in range(LEVELS):
        levels.append({mask: _fields(mask, radius) for mask in masks})
        masks = [fine for row in levels[-1].values() for fine in row]
    return levels


def _dealt(rows: DataFrame, refine: dict[int, list[int]]) -> DataFrame:
    """Rows ``(mask, print)`` to one row for each finer mask, with the bits they must share."""
    pairs = [x for mask, fine in refine.items() for x in (F.lit(_signed(mask)), F.array(*(F.lit(_signed(f)) for f in fine)))]
    finer = F.create_map(*pairs)[F.col("mask")]
    return rows.select("print", F.explode(finer).alias("mask")).withColumn("shared", F.col("print").bitwiseAND(F.col("mask")))


def _cells(prints: DataFrame, radius: int, shard: int) -> DataFrame:
    """``(mask, shared, a, b, side, print)``: the shards, with the large ones cut into pairs of blocks."""
    rows = prints.select(F.lit(0).cast("bigint").alias("mask"), "print")
    parts = []
    for level, refine in enumerate(_masks(radius)):
        rows = settle(_dealt(rows, refine), "fields")
        sizes = settle(rows.groupBy("mask", "shared").agg(F.count("*").alias("members")).filter("members > 1"), "shards")
        placed = rows.join(sizes, ["mask", "shared"])
        whole = placed.filter(F.col("members") <= shard)
        parts.append(whole.select("mask", "shared", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), "print"))
        large = placed.filter(F.col("members") > shard)
        if sizes.filter(F.col("members") > shard).isEmpty():
            break
        if level < LEVELS - 1:
            rows = large.select("mask", "print")
        else:
            parts.append(_blocks(large, shard))
    cells = parts[0]
    for part in parts[1:]:
        cells = cells.unionByName(part)
    return cells


def _blocks(large: DataFrame, shard: int) -> DataFrame:
    """A shard of n members in n / shard blocks; each member goes to the pairs its block is in."""
    blocks = F.ceil(F.col("members") / F.lit(shard)).cast("int")
    own = F.pmod(F.xxhash64("print"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = large.select("mask", "shared", "print", blocks.alias("blocks"), own.alias("own")).select("mask", "shared", "print", "own", other)
    return spread.select(
        "mask",
        "shared",
        F.least("own", "other").alias("a"),
        F.greatest("own", "other").alias("b"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "print",
    )


# Search -------------------------------------------------------------------------


class BKTree:
    """Distinct 64-bit values; the children of a node are keyed by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Add a value that is not in the tree; return its place."""
        place = len(self.values)
        at = 0
        while place:
            distance = (value ^ self.values[at]).bit_count()
            below = self.children[at].get(distance)
            if below is None:
                self.children[at][distance] = place
                break
            at = below
        self.values.append(value)
        self.children.append({})
        return place

    def within(self, value: int, radius: int) -> list[int]:
        """Places of the values at ``radius`` or fewer differing bits."""
        found, waiting = [], [0] if self.values else []
        while waiting:
            at = waiting.pop()
            distance = (value ^ self.values[at]).bit_count()
            if distance <= radius:
                found.append(at)
            for edge, below in self.children[at].items():
                if distance - radius <= edge <= distance + radius:
                    waiting.append(below)
        return found


def _root(parents: list[int], place: int) -> int:
    while parents[place] != place:
        parents[place] = parents[parents[place]]
        place = parents[place]
    return place


def shard_links(tree_values: list[int], queries: list[int], radius: int) -> Iterable[tuple[int, int]]:
    """Links that connect what lies within the radius: among the tree's values where there
    are no queries, else between queries and the tree."""
    values = tree_values + queries
    parents = list(range(len(values)))
    tree = BKTree()

    def join(place: int, value: int) -> None:
        for near in tree.within(value, radius):
            one, other = _root(parents, place), _root(parents, near)
            if one != other:
                parents[max(one, other)] = min(one, other)

    for place, value in enumerate(tree_values):
        if not queries:
            join(place, value)
        tree.add(value)
    for place, value in enumerate(queries, len(tree_values)):
        join(place, value)
    for place, value in enumerate(values):
        root = _root(parents, place)
        if root != place:
            yield value, values[root]


def _link_batches(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches sorted by cell to links; a cell may run over several batches."""
    unsigned = (1 << BITS) - 1

    def links(cell: np.ndarray) -> list[tuple[int, int]]:
        crossed = cell[0, 2] != cell[0, 3]
        prints = [value & unsigned for value in cell[:, 5].tolist()]
        if not crossed:
            return list(shard_links(prints, [], radius))
        side = cell[:, 4].tolist()
        tree = [value for value, s in zip(prints, side, strict=True) if not s]
        queries = [value for value, s in zip(prints, side, strict=True) if s]
        return list(shard_links(tree, queries, radius)) if tree and queries else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []

        def packed(found: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([column.cast(pa.int64()).to_numpy() for column in batch.columns])
            starts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            pieces = np.split(rows, starts)
            found: list[tuple[int, int]] = []
            for piece in pieces:
                if pending and (pending[-1][-1, :4] != piece[0, :4]).any():
                    found += links(np.concatenate(pending))
                    pending = []
                pending.append(piece)
            yield packed(found)
        if pending:
            yield packed(links(np.concatenate(pending)))

    return run


def near_links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links ``(u, v)`` that connect all distinct ``print`` values within ``radius`` bits."""
    cells = _cells(prints, radius, shard)
    keys = ["mask", "shared", "a", "b"]
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(tasks, *keys).sortWithinPartitions(*keys, "side", "print")
    return dealt.mapInArrow(_link_batches(radius), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``(doc_id, print, component_id)`` for every row of ``docs``.

    Rows link when their prints differ in ``radius`` bits or fewer; ``component_id`` is
    the smallest ``doc_id`` that is reachable over links.  Null and empty texts have print
    0 and link like any other; rows that repeat an id or a text are rows of their
    own; a component whose ids are all null has a null id; columns other than ``doc_id`` and
    ``text`` are not read; no rows give no rows.
    """
    rows = settle(fingerprints(docs, shingle), "prints")
    nodes = settle(rows.groupBy("print").agg(F.min("doc_id").alias("low")), "distinct-prints")
    roots = components(near_links(nodes, radius, shard)).withColumnRenamed("node", "print")
    rooted = settle(nodes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")), "rooted")
    lowest = settle(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    labels = settle(rooted.join(lowest, "root").select("print", "component_id"), "labels")
    return rows.join(labels, "print").select("doc_id", "print", "component_id")
