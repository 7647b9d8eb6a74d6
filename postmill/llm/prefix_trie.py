"""Prefix trie of conversations: balanced parentheses per shard, merged along shared spines.

A node is a distinct sequence of first turns.  Conversations become byte strings, 16 bytes of a
turn's SHA-256 for each turn, and are dealt by ranges of (sequence, ``conv_id``), so that copies of one
conversation in any number spread over tasks.  A task reads its sorted run once and cuts it into shards of
``SHARD_NODES`` nodes.  A shard is written as balanced parentheses in preorder: a range min-max tree over
the excess finds the closing parenthesis of every node at once and so its subtree, the rank of the
pairs "()" counts leaves, and cumulative arrays over preorder give members and savings.

Only nodes on the first or last path of a shard can also stand in another shard.  These spines are
merged by key: members, hanging leaves and hanging savings are sums, and what a spine node itself adds
(a leaf, savings that grow with all members) is counted after the merge, for it and all spine nodes
above.  All other nodes are final in their shard.

Sequences longer than ``SPAN`` turns are cut into bands of ``SPAN`` depths, so that no row or task holds a whole
conversation: the tries of the deepest band are built first, and their totals enter the nodes above.

Defined cases: rows without a ``conv_id`` belong to no conversation; null roles and texts are empty; turns
order by ``turn`` (null first), then role, then the SHA-256 of role and text, and repeated rows are
turns of their own; a conversation without turns is a member of the root alone; no conversations give no
nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.sources.staging import settle

SPAN = 512
SHARD_NODES = 1 << 16
# Ids in one piece of a hashed list that may run over the end of a task.
PIECE_IDS = 1 << 15
DIGEST = 16
NOTHING = hashlib.sha256(b"").hexdigest()


# Turns ------------------------------------------------------------------------------


def _number_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns with their place in the part of their conversation that this task reads."""
    part = TaskContext.get().partitionId()
    last, seen, first = None, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        convs = batch.column(0).to_numpy()
        first = int(convs[0]) if first is None else first
        starts = np.flatnonzero(np.concatenate(([True], convs[1:] != convs[:-1])))
        place = np.arange(len(convs)) - np.repeat(starts, np.diff(np.append(starts, len(convs))))
        if last == convs[0]:
            place[: starts[1] if len(starts) > 1 else len(convs)] += seen
        last, seen = int(convs[-1]), int(place[-1]) + 1
        opening = pa.array(convs == first)
        parts = pa.array(np.full(len(convs), part), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(place), parts, opening, batch.column(1), batch.column(2)],
            ["conv_id", "place", "part", "opening", "digest", "n_chars"],
        )


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, digest, n_chars)``: turns numbered from 0 in each conversation.

    Rows are sorted by ranges and numbered inside a task.  Only the conversation that opens a task can have
    begun in an earlier one; these, at most one for each task, are offset by a small table.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.char_length(text).alias("n_chars")
    )
    rows = settle(rows, "turns")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "digest"]
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("conv_id", "digest", "n_chars")
    schema = "conv_id bigint, place bigint, part int, opening boolean, digest binary, n_chars int"
    numbered = settle(dealt.mapInArrow(_number_batches, schema), "numbered")
    # One conversation at most for each task.
    opening = numbered.filter("opening").select("conv_id").distinct()
    sizes = numbered.join(F.broadcast(opening), "conv_id").groupBy("conv_id", "part").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("conv_id", "part", F.sum("size").over(earlier).alias("before")).filter("before IS NOT NULL")
    whole = numbered.join(F.broadcast(before), ["conv_id", "part"], "left")
    return whole.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "digest", "n_chars")


def shared_openings(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of the first conversation of their block.

    Conversation c takes the first h turns of conversation c - c % block, and its own after its first h;
    h is crc32 of the decimal c modulo ``most``.  Returns their turns ``(conv_id, depth, digest, n_chars)``, with
    depths from 1, and their ids.
    """
    head = F.col("conv_id") - F.col("conv_id") % block
    taken = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most
    turns = settle(turns, "ordered")
    ids = turns.filter("place = 0").select("conv_id")
    heads = settle(turns.filter(f"conv_id % {block} = 0 AND place < {most - 1}").withColumnRenamed("conv_id", "head"), "heads")
    lengths = settle(heads.groupBy("head").agg(F.count("*").alias("length")), "head-lengths")
    given = F.least(taken, F.coalesce("length", F.lit(0)))
    own = turns.filter(F.col("place") >= taken).withColumn("head", head).join(lengths, "head", "left")
    own = own.select("conv_id", (F.col("place") - taken + given + 1).alias("depth"), "digest", "n_chars")
    lent = ids.withColumn("head", head).withColumn("taken", taken).join(heads, "head").filter("place < taken")
    return own.unionByName(lent.select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "n_chars")), ids


# Sequences ---------------------------------------------------------------------------


def _half(digits: Column) -> Column:
    """60 bits of a hash in hexadecimal digits."""
    return F.conv(digits, 16, 10).cast("bigint")


def _segments(turns: DataFrame, ids: DataFrame, span: int) -> DataFrame:
    """``(band, root, path, conv_id, sizes, ends, next_root)``: conversations cut into bands of ``span`` depths.

    ``root`` names the turns of all bands above, ``next_root`` those down to the end of this band where it is
    full; a conversation that ends with a full band is also a member of the root of the next band.
    """
    marked = turns.unionByName(ids.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("n_chars")))
    band = F.floor((F.greatest(F.col("depth"), F.lit(1)) - 1) / span).cast("int").alias("band")
    grouped = marked.groupBy("conv_id", band).agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "n_chars"))).alias("turns"))
    kept = F.filter("turns", lambda turn: turn["digest"].isNotNull())
    path = F.unhex(F.array_join(F.transform(kept, lambda turn: F.hex(turn["digest"])), ""))
    rows = grouped.select("conv_id", "band", path.alias("path"), F.transform(kept, lambda turn: turn["n_chars"]).alias("sizes"))
    rows = settle(rows, "segments")
    full = settle(rows.filter(F.size("sizes") == span).select("conv_id", "band", "path", "sizes"), "full-segments")
    name = F.sha2(F.concat("path", F.encode(F.col("band").cast("string"), "UTF-8")), 256)
    down = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    halves = [F.lpad(F.hex(F.bit_xor(_half(F.substring(name, at, 15))).over(down)), 16, "0") for at in (1, 16)]
    roots = settle(full.select("conv_id", "band", F.concat(*halves).alias("next_root")), "roots")
    deeper = rows.filter("band > 0").select("conv_id", (F.col("band") - 1).alias("band"), F.lit(True).alias("more"))
    below = settle(full.join(deeper, ["conv_id", "band"], "left").join(roots, ["conv_id", "band"]), "full-roots")
    above = roots.select("conv_id", (F.col("band") + 1).alias("band"), F.col("next_root").alias("root"))
    names = ["band", "root", "path", "conv_id", "sizes", "ends", "next_root"]
    none = F.lit(None).cast("string")
    short = rows.filter((F.size("sizes") < span) & (F.col("band") == 0)).withColumn("root", F.lit(""))
    short = short.unionByName(rows.filter((F.size("sizes") < span) & (F.col("band") > 0)).join(above, ["conv_id", "band"]))
    short = short.withColumn("ends", F.lit(True)).withColumn("next_root", none)
    whole = below.withColumn("ends", F.col("more").isNull()).join(above, ["conv_id", "band"], "left").withColumn("root", F.coalesce("root", F.lit("")))
    closed = below.filter("more IS NULL").select(
        "conv_id",
        (F.col("band") + 1).alias("band"),
        F.col("next_root").alias("root"),
        F.unhex(F.lit("")).alias("path"),
        F.array().cast("array<int>").alias("sizes"),
        F.lit(False).alias("ends"),
        none.alias("next_root"),
    )
    return settle(short.select(*names).unionByName(whole.select(*names)).unionByName(closed.select(*names)), "sequences", by="band")


# Shards ------------------------------------------------------------------------------


class Parentheses:
    """A balanced sequence of parentheses with a range min-max tree over its excess."""

    BLOCK = 32

    def __init__(self, opens: np.ndarray) -> None:
        self.opens = opens
        self.excess = np.cumsum(np.where(opens, 1, -1), dtype=np.int32)
        blocks = max(1, -(-len(opens) // self.BLOCK))
        self.leaves = 1 << (blocks - 1).bit_length()
        high = np.iinfo(np.int32).max
        padded = np.full(blocks * self.BLOCK, high, dtype=np.int32)
        padded[: len(opens)] = self.excess
        self.padded = padded
        self.tree = np.full(2 * self.leaves, high, dtype=np.int32)
        self.tree[self.leaves : self.leaves + blocks] = padded.reshape(blocks, self.BLOCK).min(axis=1)
        for level in range(self.leaves.bit_length() - 2, -1, -1):
            row = slice(1 << level, 2 << level)
            self.tree[row] = self.tree[2 << level : 4 << level].reshape(-1, 2).min(axis=1)
        pairs = np.zeros(len(opens) + 1, dtype=np.int64)
        pairs[1:-1] = np.cumsum(opens[:-1] & ~opens[1:])
        pairs[-1] = pairs[-2] if len(opens) else 0
        self.pairs = pairs

    def _scan(self, place: np.ndarray, level: np.ndarray, found: np.ndarray, waiting: np.ndarray) -> np.ndarray:
        """Move ``waiting`` entries of ``place`` to the first excess below ``level``, inside their block;
        returns those whose block ends before."""
        over = [waiting[:0]]
        while len(waiting):
            low = self.padded[place[waiting]] < level[waiting]
            found[waiting[low]] = place[waiting[low]]
            waiting = waiting[~low]
            place[waiting] += 1
            ended = place[waiting] % self.BLOCK == 0
            over.append(waiting[ended])
            waiting = waiting[~ended]
        return np.concatenate(over)

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """Place of the closing parenthesis of each opening one in ``at``."""
        level = self.excess[at]
        found = np.full(len(at), -1, dtype=np.int64)
        place = at.astype(np.int64) + 1
        inside = place % self.BLOCK != 0
        rest = np.concatenate([np.flatnonzero(~inside), self._scan(place, level, found, np.flatnonzero(inside))])
        node, goal = self.leaves + place[rest] // self.BLOCK, level[rest]
        climbing = np.flatnonzero(self.tree[node] >= goal)
        while len(climbing):
            up = node[climbing] + 1
            node[climbing] = up // (up & -up)
            climbing = climbing[self.tree[node[climbing]] >= goal[climbing]]
        falling = np.flatnonzero(node < self.leaves)
        while len(falling):
            left = 2 * node[falling]
            node[falling] = left + (self.tree[left] >= goal[falling])
            falling = falling[node[falling] < self.leaves]
        place[rest] = (node - self.leaves) * self.BLOCK
        self._scan(place, level, found, rest)
        return found

    def leaf_pairs(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Number of pairs "()" that open in [start, stop)."""
        return self.pairs[stop] - self.pairs[start]


class _Sequence:
    """Equal sequences of one run: how many, and the ids of those that end here."""

    __slots__ = ("root", "path", "sizes", "count", "least", "ids", "below", "opens_task")

    def __init__(self, root: str, path: bytes, sizes: list[int], conv: int, below: tuple[int, int, int], opens_task: bool) -> None:
        self.root, self.path, self.sizes = root, path, sizes
        self.count, self.least, self.ids = 0, conv, array("q")
        self.below, self.opens_task = below, opens_task


def _shared_turns(one: bytes, other: bytes) -> int:
    most = min(len(one), len(other)) // DIGEST
    at = 0
    while at < most and one[at * DIGEST : at * DIGEST + DIGEST] == other[at * DIGEST : at * DIGEST + DIGEST]:
        at += 1
    return at


NODE, SPINE, IDS = 0, 1, 2
ENCODED = (
    "kind int, key string, parent string, path array<string>, root string, conv_id bigint, depth bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, size bigint, "
    "all_children bigint, below_children bigint, below_leaves bigint, below_saved bigint, ids binary"
)
_KINDS = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "bigint": pa.int64(), "binary": pa.binary()}
_FIELDS = [tuple(field.split(" ")) for field in ENCODED.split(", ")]


def _batch(columns: dict[str, object], rows: int) -> pa.RecordBatch:
    arrays = [pa.array(columns[name], _KINDS[kind]) if name in columns else pa.nulls(rows, _KINDS[kind]) for name, kind in _FIELDS]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in _FIELDS])


def joined_ids(ids: array) -> bytes:
    return ",".join(map(str, ids)).encode()


class Shard:
    """The trie of some sorted sequences, as parentheses and arrays in preorder."""

    def __init__(self, sequences: list[_Sequence], band: int, span: int) -> None:
        self.sequences, self.band, self.span = sequences, band, span
        shared = [-1]
        for one, other in zip(sequences, sequences[1:], strict=False):
            shared.append(_shared_turns(one.path, other.path) if one.root == other.root else -1)
        self.shared = np.array(shared, dtype=np.int64)
        lengths = np.array([len(s.path) // DIGEST for s in sequences], dtype=np.int64)
        fresh = lengths - self.shared
        ends = np.cumsum(fresh)
        total = int(ends[-1])
        runs = np.empty(2 * len(sequences) + 1, dtype=np.int64)
        runs[0], runs[2:-1:2], runs[-1] = 0, lengths[:-1] - self.shared[1:], lengths[-1] + 1
        runs[1::2] = fresh
        self.parens = Parentheses(np.repeat(np.arange(len(runs)) % 2 == 1, runs))
        self.depth = np.arange(total) - np.repeat(ends - fresh, fresh) + np.repeat(self.shared + 1, fresh)
        self.parent = np.arange(-1, total - 1)
        self.sequence = np.repeat(np.arange(len(sequences)), fresh)
        self.terminal = ends - 1
        self.size = np.zeros(total, dtype=np.int64)
        stack: list[int] = []
        for number, (start, lcp) in enumerate(zip((ends - fresh).tolist(), shared, strict=True)):
            own = sequences[number].sizes
            self.parent[start] = stack[lcp] if lcp >= 0 else -1
            stack[lcp + 1 :] = range(start, start + len(own) - lcp)
            self.size[start : start + len(own) - lcp] = own[lcp:] if lcp >= 0 else [0, *own]
        self.last_path = stack

    def spine(self) -> np.ndarray:
        """Nodes on the first and the last path, and all roots."""
        flags = self.depth == 0
        flags |= self.sequence == 0
        flags[self.last_path] = True
        return flags

    def key(self, node: int, depth: int) -> str:
        own = self.sequences[self.sequence[node]]
        return hashlib.sha256(f"{self.band}:{own.root}:".encode() + own.path[: depth * DIGEST]).hexdigest()[:32]

    def encode(self, closes_task: bool) -> Iterator[pa.RecordBatch]:
        """Final nodes, spine nodes and ids whose list may go on in another task."""
        total = len(self.depth)
        spine = self.spine()
        opened = np.flatnonzero(self.parens.opens)
        closed = self.parens.find_close(opened)
        after = np.arange(total) + (closed - opened + 1) // 2
        counts, leaves_below, saved_below, children_below = (np.zeros(total, dtype=np.int64) for _ in range(4))
        counts[self.terminal] = [s.count for s in self.sequences]
        children_below[self.terminal] = [s.below[0] for s in self.sequences]
        leaves_below[self.terminal] = [s.below[1] for s in self.sequences]
        saved_below[self.terminal] = [s.below[2] for s in self.sequences]

        def within(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(values)))
            return sums[after] - sums[:-1]

        members = within(counts)
        # Sequences of a subtree are a run; the least id of each run.
        least = np.array([s.least for s in self.sequences], dtype=np.int64)
        ended = np.zeros(total, dtype=np.int64)
        ended[self.terminal] = 1
        first = np.concatenate(([0], np.cumsum(ended)))
        bounds = np.column_stack([first[:-1], first[after]])
        # A closing entry keeps the last bound inside the array.
        conv = np.minimum.reduceat(np.append(least, np.iinfo(np.int64).max), bounds.reshape(-1))[::2]
        children = np.bincount(self.parent[self.parent >= 0], minlength=total)
        hashes: list[str | None] = [None] * total
        pieces: list[tuple[int, array]] = []
        for number, (own, node) in enumerate(zip(self.sequences, self.terminal.tolist(), strict=True)):
            if not own.ids:
                continue
            if own.opens_task or (closes_task and number == len(self.sequences) - 1):
                pieces.append((node, own.ids))
            else:
                hashes[node] = hashlib.sha256(joined_ids(own.ids)).hexdigest()
        # A terminal that goes on in the next band is no leaf, and what is below it counts instead.
        goes_on = children_below > 0
        inner = ~spine
        leaves = self.parens.leaf_pairs(opened, closed) + within(np.where(goes_on & inner, leaves_below - 1, 0))
        saved = within(np.where(inner, (members - 1) * self.size + saved_below, 0))
        # Spine nodes add nothing here themselves; their leaf is counted after the merge.
        spine_leaf = spine & (closed == opened + 1)
        hanging = leaves - within(spine_leaf.astype(np.int64))
        yield from self._final(np.flatnonzero(inner), spine, conv, members, children + children_below, leaves, saved, hashes)
        yield self._spine(np.flatnonzero(spine), spine, conv, members, children, hanging, saved, hashes, children_below, leaves_below, saved_below)
        for node, ids in pieces:
            key = self.key(node, int(self.depth[node]))
            for start in range(0, len(ids), PIECE_IDS):
                part = ids[start : start + PIECE_IDS]
                yield _batch({"kind": [IDS], "key": [key], "conv_id": [part[0]], "ids": [joined_ids(part)]}, 1)

    def _final(self, nodes, spine, conv, members, children, leaves, saved, hashes) -> Iterator[pa.RecordBatch]:
        if not len(nodes):
            return
        parent = self.parent[nodes]
        hangs = spine[parent]
        keys = {node: self.key(node, int(self.depth[node])) for node in np.unique(parent[hangs]).tolist()}
        yield _batch(
            {
                "kind": np.full(len(nodes), NODE),
                "parent": [keys[p] if h else None for p, h in zip(parent.tolist(), hangs.tolist(), strict=True)],
                "conv_id": conv[nodes],
                "depth": self.depth[nodes] + self.band * self.span,
                "parent_conv_id": pa.array(conv[parent], mask=hangs),
                "n_convs": members[nodes],
                "n_children": children[nodes],
                "n_leaves": leaves[nodes],
                "saved_tokens": saved[nodes],
                "ends_sha256": [hashes[node] for node in nodes.tolist()],
            },
            len(nodes),
        )

    def _spine(self, nodes, spine, conv, members, children, hanging, saved, hashes, children_below, leaves_below, saved_below) -> pa.RecordBatch:
        """What hangs on each spine node itself, not on the spine nodes below it."""
        total = len(self.depth)
        parent = self.parent[nodes]
        inner = parent >= 0

        def own(values: np.ndarray) -> np.ndarray:
            lower = np.zeros(total, dtype=np.int64)
            np.add.at(lower, parent[inner], values[nodes[inner]])
            return (values - lower)[nodes]

        on_spine = np.bincount(parent[inner], minlength=total)
        paths: dict[int, list[str]] = {}
        for node, above in zip(nodes.tolist(), parent.tolist(), strict=True):
            paths[node] = [*paths.get(above, []), self.key(node, int(self.depth[node]))]
        listed = [paths[node] for node in nodes.tolist()]
        roots = [self.sequences[self.sequence[node]].root if not self.depth[node] else None for node in nodes.tolist()]
        return _batch(
            {
                "kind": np.full(len(nodes), SPINE),
                "key": [path[-1] for path in listed],
                "parent": [path[-2] if len(path) > 1 else None for path in listed],
                "path": listed,
                "root": roots,
                "conv_id": conv[nodes],
                "depth": self.depth[nodes] + self.band * self.span,
                "n_convs": members[nodes],
                "n_children": (children - on_spine)[nodes],
                "all_children": children[nodes],
                "n_leaves": own(hanging),
                "saved_tokens": own(saved),
                "ends_sha256": [hashes[node] for node in nodes.tolist()],
                "size": self.size[nodes],
                "below_children": children_below[nodes],
                "below_leaves": leaves_below[nodes],
                "below_saved": saved_below[nodes],
            },
            len(nodes),
        )


def _encode_batches(band: int, span: int, shard_nodes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences: list[_Sequence] = []
        nodes, current, opening = 0, None, True
        for batch in batches:
            columns = [column.to_pylist() for column in batch.columns]
            for root, path, conv, sizes, ends, *below in zip(*columns, strict=True):
                if current is None or current.path != path or current.root != root:
                    if nodes >= shard_nodes:
                        yield from Shard(sequences, band, span).encode(False)
                        sequences, nodes = [], 0
                    current = _Sequence(root, path, sizes, conv, tuple(below), opening)
                    opening = False
                    sequences.append(current)
                    nodes += len(sizes) + 1
                current.count += 1
                current.least = min(current.least, conv)
                if ends:
                    current.ids.append(conv)
        if sequences:
            yield from Shard(sequences, band, span).encode(True)

    return run


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of id lists, sorted by key and first id, to the hash of each whole list."""
    key, digest = None, None
    for batch in batches:
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if name != key:
                if key is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "listed_sha256"])
                key, digest = name, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.as_py())
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "listed_sha256"])


# Merge -------------------------------------------------------------------------------


def _merged_spine(encoded: DataFrame) -> DataFrame:
    """Spine nodes of all shards, one row for each node, with the totals of their subtrees."""
    tasks = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = encoded.filter(f"kind = {IDS}").select("key", "ids", "conv_id").repartition(tasks, "key").sortWithinPartitions("key", "conv_id")
    listed = pieces.select("key", "ids").mapInArrow(_hash_batches, "key string, listed_sha256 string")
    same = [F.any_value(name).alias(name) for name in ("parent", "path", "root")]
    sums = [F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    most = [F.max(name).alias(name) for name in ("depth", "size", "ends_sha256", "all_children", "below_children", "below_leaves", "below_saved")]
    nodes = encoded.filter(f"kind = {SPINE}").groupBy("key").agg(F.min("conv_id").alias("conv_id"), *same, *sums, *most)
    nodes = settle(nodes.join(listed, "key", "left"), "spine-nodes")
    leaf = F.when((F.col("all_children") == 0) & (F.col("below_children") == 0), 1).otherwise(0)
    adds = nodes.select(
        F.explode("path").alias("above"),
        "parent",
        (F.col("n_leaves") + leaf + F.col("below_leaves")).alias("leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size") + F.col("below_saved")).alias("saved"),
    )
    totals = adds.groupBy(F.col("above").alias("key")).agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count_if(F.col("parent") == F.col("above")).alias("on_spine")
    )
    return settle(
        nodes.join(totals, "key").select(
            "key",
            "parent",
            "root",
            "conv_id",
            "depth",
            "n_convs",
            (F.col("n_children") + F.col("on_spine") + F.col("below_children")).alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("listed_sha256", "ends_sha256").alias("ends_sha256"),
        ),
        "spine",
    )


def trie(turns: DataFrame, ids: DataFrame, span: int = SPAN, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row for each distinct sequence of first turns among conversations.

    ``turns`` is ``(conv_id, depth, digest, n_chars)`` with depths from 1 without gaps, ``ids`` the conversations,
    with or without turns.  Gives ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (characters of turns that need not be stored again) and ``ends_sha256``.
    """
    sequences = _segments(turns, ids, span)
    tasks = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deepest = sequences.agg(F.max("band")).first()[0]
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below, parts = None, []
    for band in range(deepest or 0, -1, -1):
        rows = sequences.filter(F.col("band") == band)
        zeros = [F.lit(0).cast("bigint").alias(name) for name in ("children", "leaves", "saved")]
        under = rows.select("*", *zeros)
        if below is not None:
            going_on = rows.filter("next_root IS NOT NULL").join(below, "next_root", "left").fillna(0, ["children", "leaves", "saved"])
            under = under.filter("next_root IS NULL").unionByName(going_on)
        order = ["root", "path", "conv_id"]
        dealt = under.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
        dealt = dealt.select("root", "path", "conv_id", "sizes", "ends", "children", "leaves", "saved")
        encoded = settle(dealt.mapInArrow(_encode_batches(band, span, shard_nodes), ENCODED), "encoded")
        spine = _merged_spine(encoded)
        # A root without children stands for conversations that end with the band above.
        tops = spine.filter("root IS NOT NULL AND n_children > 0")
        below = tops.select(
            F.col("root").alias("next_root"), F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")
        )
        parents = spine.select(F.col("key").alias("parent"), F.col("conv_id").alias("spine_conv_id"))
        own = spine.filter("root IS NULL") if band else spine
        parts.append(encoded.filter(f"kind = {NODE} AND parent IS NULL").select(*names))
        hanging = encoded.filter(f"kind = {NODE} AND parent IS NOT NULL").drop("parent_conv_id").join(parents, "parent", "left")
        parts.append(hanging.withColumnRenamed("spine_conv_id", "parent_conv_id").select(*names))
        parts.append(own.join(parents, "parent", "left").withColumnRenamed("spine_conv_id", "parent_conv_id").select(*names))
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)
    return nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))


def conversation_trie(conversations: DataFrame, span: int = SPAN, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = settle(ordered_turns(conversations), "ordered")
    ids = turns.filter("place = 0").select("conv_id")
    return trie(turns.select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "n_chars"), ids, span, shard_nodes)
