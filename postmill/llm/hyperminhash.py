"""Near-duplicates by HyperMinHash: banded compressed registers, estimates, then the whole sets.

A text is its set of distinct shingles.  Hashes of shingles are dealt to ``BUCKETS`` buckets; each keeps its
least hash as a register of a leading-zero count and ``MANTISSA`` bits behind it, 16 bits in all.
Texts with the same set are one node.  A bucket without a hash borrows the register of the next one
that has one, and ``ROWS`` neighbouring registers, with the buckets they come from, are a band: nodes that
agree on a band are in a cell.  Two sets with a Jaccard similarity of 0.85 share none of the 24 bands with a
chance of about (1 - 0.85**4)**24, 2e-8.  Sets so small that one different shingle is too much are
linked by equality alone.

In a cell the similarity of all members is estimated from their registers, corrected for different hashes
that share a register; a pair more than ``SIGMAS`` deviations below the threshold is no candidate.  Every
candidate that counts is verified on both whole sets of 64-bit shingle hashes:

1. each member's best candidate in the cells of the first ``FIRST`` bands, so a crowd of near copies comes together;
   pairs are verified anchor by anchor, an anchor's set sent once for up to ``PARTNERS`` partners;
2. then the candidates between two components, in the cells of all bands that still hold two or more.  Each
   cell's largest component is its pivot: members of others are compared once with all members of the pivot, whatever
   number of cells they share with it, and with each other in the cells.  Components that hang together over such
   candidates are a cluster.  Clusters get every node's set once, test candidates from the likeliest on, skip pairs
   that links found meanwhile have joined, and give one link at most for each component.

Cells with the same members are searched once.  A cell of more than ``CELL`` members is searched in blocks:
first against a few guides, then, without its pivot, by pairs of bands and at last by pairs of blocks; pivots of more
than ``CELL`` nodes and clusters of more than ``CLUSTER`` are searched by pairs of blocks.  No task grows with a group.
Two nodes in a cell that has more than ``CELL`` members outside its pivot must share a second band, which 0.85 misses
with a chance of about 6e-7.

Defined cases: null texts and texts without words have no shingles and link with nothing, each alone in
its component; fewer words than a shingle are one shingle; rows that repeat an id or a text are rows of their
own; a component whose ids are all null has a null id; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.components import components
from postmill.llm.text_batches import bound_batches, texts
from postmill.llm.worker_memory import release
from postmill.sources.staging import settle

SHINGLE = 5
SEED = 42
ROWS = 4
BANDS = 24
BUCKETS = ROWS * BANDS
MANTISSA = 10
EMPTY = 0
SIGMAS = 6.0
CELL = 1024
GUIDES = 8
FIRST = 8
PARTNERS = 128
CLUSTER = 256
LEVELS = 2


@dataclass(frozen=True)
class Threshold:
    """Similarity as a ratio of whole numbers, so that the comparison of sets is exact."""

    shared: int = 85
    whole: int = 100

    @property
    def ratio(self) -> float:
        return self.shared / self.whole

    @property
    def least_size(self) -> int:
        """Smallest set that can reach the threshold with another set."""
        return self.shared // (self.whole - self.shared) if self.shared < self.whole else 1 << 62

    def reached(self, both: np.ndarray | int, one: np.ndarray | int, other: np.ndarray | int):
        return self.whole * both >= self.shared * (one + other - both)


# Sketches ---------------------------------------------------------------------------------


def shingles(text: bytes, shingle: int = SHINGLE) -> set[bytes]:
    """Distinct runs of words with A-Z folded; ``bytes.split`` cuts at space and 0x09-0x0D only."""
    words = text.lower().split()
    if len(words) < shingle:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))


def hashes(found: set[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), dtype=np.uint64, count=len(found))


def registers(values: np.ndarray) -> np.ndarray:
    """Registers of a set of hashes: 1 + (leading zeros, complement of the bits behind) of the
    least hash of each bucket, so that a lower register is a larger hash; 0 where there is none."""
    out = np.zeros(BUCKETS, dtype=np.uint16)
    if not len(values):
        return out
    # The bucket comes from the high half, the register from all bits mixed once more.
    bucket = ((values >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
    mixed = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    least = np.full(BUCKETS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, bucket.astype(np.int64), mixed)
    used = np.zeros(BUCKETS, dtype=bool)
    used[bucket.astype(np.int64)] = True
    out[used] = compress(least[used])
    return out


def compress(least: np.ndarray) -> np.ndarray:
    """1 + leading zeros (at most 52) and the ``MANTISSA`` bits that follow the first one bit."""
    top = np.frexp((least >> np.uint64(11)).astype(np.float64))[1]  # exact: 53 bits
    zeros = np.minimum(53 - top, 52)
    shift = (zeros + 1).astype(np.uint64)
    behind = (least << shift) >> np.uint64(64 - MANTISSA)
    return (1 + (zeros.astype(np.uint64) << np.uint64(MANTISSA)) + behind).astype(np.uint16)


def bands(row: np.ndarray) -> list[int]:
    """One 64-bit value for each band of registers, empty ones filled by the next that is not."""
    used = np.flatnonzero(row)
    nearest = used[np.searchsorted(used, np.arange(BUCKETS)) % len(used)]
    filled = np.column_stack([nearest, row[nearest]]).astype("<u2").reshape(BANDS, -1)
    return [xxhash.xxh64_intdigest(band.tobytes(), SEED) - (1 << 63) for band in filled]


def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [bands(np.frombuffer(row.as_py(), dtype="<u2")) for row in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "bands"])


def set_name(found: set[bytes]) -> bytes:
    return hashlib.sha256(b"\n".join(sorted(found))).digest()


def _sketch_batches(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            sizes, names, rows = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                found = shingles(text.as_py() or b"", shingle)
                sizes.append(len(found))
                names.append(set_name(found) if found else None)
                rows.append(registers(hashes(found)).astype("<u2").tobytes() if found else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(rows, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "set_sha256", "registers"],
            )

    return run


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_key, n_shingles, set_sha256, registers)`` of every row; the last two are null for an
    empty set."""
    schema = "doc_id bigint, text_key bigint, n_shingles bigint, set_sha256 binary, registers binary"
    return texts(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(_sketch_batches(shingle), schema)


# Estimates --------------------------------------------------------------------------------


def collisions(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Chance that the least hashes of two buckets with disjoint contents share a register.

    With n hashes the least of a bucket is exponential with rate n / BUCKETS (as a fraction of the range); a
    register is a cell of width 2**-(z + 1 + MANTISSA) at z leading zeros.
    """
    a, b = one / BUCKETS, other / BUCKETS
    zeros = np.arange(53, dtype=np.float64)
    upper, lower = 2.0**-zeros, 2.0 ** -(zeros + 1)
    both = (a + b)[..., None]
    cells = np.exp(-both * lower) - np.exp(-both * upper)
    chance = (cells * 2.0 ** -(zeros + 1 + MANTISSA)).sum(axis=-1) * a * b / (a + b)
    return np.clip(chance / np.maximum((1 - np.exp(-a)) * (1 - np.exp(-b)), 1e-12), 0, 0.5)


def matches(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal registers, registers in use) of each row of ``one`` with each row of ``other``."""
    equal = np.zeros((len(one), len(other)), dtype=np.int16)
    used = np.zeros_like(equal)
    for place in range(BUCKETS):
        left, right = one[:, place, None], other[None, :, place]
        present = (left | right) != EMPTY
        used += present
        equal += present & (left == right)
    return equal, used


def candidates(one, one_sizes, other, other_sizes, threshold: Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``one``, row of ``other``, Jaccard estimate) of the pairs that may reach the threshold.

    Sizes alone rule out some; the share of equal registers bounds the corrected estimate from above.
    """
    equal, used = matches(one, other)
    ratio = threshold.ratio
    used = np.maximum(used, 1)
    share = equal / used
    floor = ratio - SIGMAS * np.sqrt(ratio * (1 - ratio) / used)
    small = np.minimum(one_sizes[:, None], other_sizes[None, :])
    large = np.maximum(one_sizes[:, None], other_sizes[None, :])
    i, j = np.nonzero((share >= floor) & (threshold.whole * small >= threshold.shared * large))
    guesses = np.empty(len(i))
    for start in range(0, len(i), 1 << 15):
        part = slice(start, start + (1 << 15))
        chance = collisions(one_sizes[i[part]].astype(float), other_sizes[j[part]].astype(float))
        guesses[part] = np.clip((share[i[part], j[part]] - chance) / (1 - chance), 0, 1)
    may = guesses >= floor[i, j]
    return i[may], j[may], guesses[may]


# Cells ------------------------------------------------------------------------------------


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the members to compare with each other: two sides, or all with all."""
    if side.any() and not side.all():
        return np.flatnonzero(side == 1), np.flatnonzero(side == 0), True
    return np.arange(len(side)), np.arange(len(side)), False


def _cell_candidates(roots, sizes, rows, side, threshold: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(u, v, estimate) by place, for pairs of members of different components."""
    left, right, two = _sides(side)
    for start in range(0, len(left), 256):
        part = left[start : start + 256]
        i, j, guess = candidates(rows[part], sizes[part], rows[right], sizes[right], threshold)
        u, v = part[i], right[j]
        apart = (roots[u] != roots[v]) & (two | (u > v))
        yield u[apart], v[apart], guess[apart]


def _best(found) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest partner of each member."""
    us, vs = [], []
    for u, v, guess in found:
        order = np.lexsort((v, -guess, u))
        first = order[np.unique(u[order], return_index=True)[1]]
        us.append(u[first])
        vs.append(v[first])
    return np.concatenate(us), np.concatenate(vs)


def _hanging(found, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each component that candidates connect with a lower one, and the lowest that they connect it with."""
    pairs = [(u, v) for u, v, _ in found]
    low, place = np.unique(roots, return_inverse=True)
    u, v = (place[np.concatenate([pair[i] for pair in pairs])] for i in (0, 1))
    label = np.arange(len(low))
    while len(u):
        before = label.copy()
        np.minimum.at(label, u, label[v])
        np.minimum.at(label, v, label[u])
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(low)))
    return low[moved], low[label[moved]]


def _cells_of(batches: Iterator[pa.RecordBatch], keys: int, numbers: int) -> Iterator[tuple[np.ndarray, list[list]]]:
    """Runs of rows with the same first ``keys`` columns: the first ``numbers`` columns as an array, the others as lists."""
    held: list[tuple[np.ndarray, list[list]]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = np.column_stack([column.cast(pa.int64()).to_numpy() for column in batch.columns[:numbers]])
        rest = [column.to_pylist() for column in batch.columns[numbers:]]
        starts = [0, *(np.flatnonzero((table[1:, :keys] != table[:-1, :keys]).any(axis=1)) + 1).tolist(), len(table)]
        for start, stop in zip(starts, starts[1:], strict=False):
            if held and (held[-1][0][-1, :keys] != table[start, :keys]).any():
                yield np.concatenate([part[0] for part in held]), [sum((part[1][i] for part in held), []) for i in range(len(rest))]
                held = []
            held.append((table[start:stop], [column[start:stop] for column in rest]))
    if held:
        yield np.concatenate([part[0] for part in held]), [sum((part[1][i] for part in held), []) for i in range(len(held[0][1]))]


def _registers_of(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype="<u2").reshape(-1, BUCKETS)


def _links(us, vs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _pair_batches(threshold: Threshold, best: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (cell, a, b, side, node, root, n_shingles, registers) sorted by cell, a and b, to pairs (u, v): the best
    candidates, or the components that candidates connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for table, (blobs,) in _cells_of(batches, 3, 7):
            nodes, roots = table[:, 4], table[:, 5]
            found = _cell_candidates(roots, table[:, 6], _registers_of(blobs), table[:, 3], threshold)
            if best:
                u, v = (nodes[places] for places in _best(found))
            else:
                u, v = _hanging(found, roots)
            yield _links(np.minimum(u, v), np.maximum(u, v))

    return run


def _searched(cells: DataFrame, nodes: DataFrame, threshold: Threshold, best: bool) -> DataFrame:
    """Distinct pairs (u, v) of ``cells(cell, a, b, side, node)``."""
    keys = ["cell", "a", "b"]
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = cells.join(nodes.select("node", "root", "n_shingles", "registers"), "node")
    dealt = full.repartition(tasks, *keys).sortWithinPartitions(*keys, "side", "node")
    dealt = dealt.select(*keys, "side", "node", "root", "n_shingles", "registers")
    return dealt.mapInArrow(_pair_batches(threshold, best), "u bigint, v bigint").distinct()


def _open(places: DataFrame) -> DataFrame:
    """``places(cell, node, band, root)`` of cells that hold more than one component, with their ``members``; of
    cells with the same members in one band or several, one stays."""
    sizes = places.groupBy("cell").agg(
        F.count("*").alias("members"),
        F.min("root").alias("low"),
        F.max("root").alias("high"),
        F.bit_xor(F.xxhash64("node")).alias("one"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("other"),
        F.min("band").alias("band"),
    )
    first = sizes.filter("low != high").groupBy("members", "one", "other").agg(F.min(F.struct("band", "cell")).alias("first"))
    open_cells = settle(first.select(F.col("first.cell").alias("cell"), "members"), "open-cells")
    return settle(places.select("cell", "node", "band").join(open_cells.hint("merge"), "cell"), "open-places")


def _places(bandings: DataFrame, nodes: DataFrame, until: int = BANDS) -> DataFrame:
    """``(cell, node, band, root, weight)`` of the first ``until`` bands."""
    rooted = bandings.join(nodes.select("node", "root", "weight"), "node")
    banded = rooted.select("node", "root", "weight", F.posexplode(F.slice("bands", 1, until)).alias("band", "value"))
    return banded.select(F.xxhash64("band", "value").alias("cell"), "node", "band", "root", "weight")


def _beside_pivots(places: DataFrame) -> DataFrame:
    """``places`` outside the largest component of their cell, with its root as ``pivot``."""
    pivots = places.groupBy("cell").agg(
        F.max(F.struct("weight", "root")).alias("largest"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    pivots = settle(pivots.filter("low != high").select("cell", F.col("largest.root").alias("pivot")), "pivots")
    beside = places.join(pivots.hint("merge"), "cell").filter("root != pivot")
    return settle(beside.select("cell", "node", "band", "root", "pivot"), "beside-pivots")


def _with_pivots(beside: DataFrame, nodes: DataFrame, cell: int) -> DataFrame:
    """The members of each pivot and the nodes that share a cell with it, in pairs of blocks."""
    guests = settle(beside.select(F.col("pivot").alias("cell"), "node").distinct(), "guests")
    sizes = guests.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(cell)).cast("int").alias("guest_blocks"))
    weights = nodes.filter("node = root").select(F.col("root").alias("cell"), F.ceil(F.col("weight") / F.lit(cell)).cast("int").alias("own_blocks"))
    blocks = settle(weights.join(sizes, "cell"), "pivot-blocks")

    def dealt(rows: DataFrame, own: str, others: str) -> DataFrame:
        placed = rows.join(blocks, "cell").withColumn("own", F.pmod(F.xxhash64("node"), F.col(own)).cast("int"))
        return placed.select("cell", "node", "own", F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias("other"))

    hosts = dealt(nodes.select(F.col("root").alias("cell"), "node"), "own_blocks", "guest_blocks")
    hosts = hosts.select("cell", F.col("own").alias("a"), F.col("other").alias("b"), F.lit(0).alias("side"), "node")
    sent = dealt(guests, "guest_blocks", "own_blocks")
    return hosts.unionByName(sent.select("cell", F.col("other").alias("a"), F.col("own").alias("b"), F.lit(1).alias("side"), "node"))


def _with_roots(places: DataFrame, nodes: DataFrame) -> DataFrame:
    return places.join(nodes.select("node", "root"), "node")


def _whole(places: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return places.select("cell", zero.alias("a"), zero.alias("b"), zero.alias("side"), "node")


def _guided(large: DataFrame, cell: int) -> DataFrame:
    """Large cells in blocks, each with the same few members of the cell as its other side."""
    blocks = F.ceil(F.col("members") / F.lit(cell)).cast("int")
    own = large.select("cell", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("a"), F.lit(0).alias("b"), F.lit(1).alias("side"), "node")
    kind = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(GUIDES))
    guides = large.groupBy("cell", kind.alias("kind")).agg(F.min("node").alias("node"), F.any_value("members").alias("members"))
    guides = settle(guides, "guides")
    sent = guides.select("cell", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), "node")
    return own.unionByName(sent)


def _blocks(large: DataFrame, cell: int) -> DataFrame:
    """A cell of n members in n / cell blocks; each member goes to the pairs its block is in."""
    count = F.ceil(F.col("members") / F.lit(cell)).cast("int")
    placed = large.select("cell", "node", count.alias("count"), F.pmod(F.xxhash64("node"), count).cast("int").alias("own"))
    spread = placed.select("cell", "node", "own", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("other"))
    return spread.select(
        "cell",
        F.least("own", "other").alias("a"),
        F.greatest("own", "other").alias("b"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "node",
    )


def _exhaustive(places: DataFrame, nodes: DataFrame, bandings: DataFrame, cell: int) -> DataFrame:
    """Cells in which the pairs of members that share ``places`` meet; large ones by further bands
    first, then by pairs of blocks."""
    parts, rows = [], places
    for level in range(LEVELS):
        parts.append(_whole(rows.filter(F.col("members") <= cell)))
        large = rows.filter(F.col("members") > cell)
        if large.isEmpty():
            break
        if level == LEVELS - 1:
            parts.append(_blocks(large, cell))
            break
        others = bandings.select("node", F.posexplode("bands").alias("other", "value"))
        finer = large.select("cell", "node", "band").join(others, "node").filter("other > band")
        finer = settle(finer.select(F.xxhash64("cell", "other", "value").alias("cell"), "node", F.col("other").alias("band")), "finer-cells")
        rows = _open(_with_roots(finer, nodes))
    cells = parts[0]
    for part in parts[1:]:
        cells = cells.unionByName(part)
    return cells


# Verification -----------------------------------------------------------------------------


def _set_batches(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (node, set_sha256, text) to the sorted hashes of the node's set; other texts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            nodes, sets = [], []
            for node, name, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).cast(pa.binary()), strict=True):
                found = shingles(text.as_py() or b"", shingle)
                if set_name(found) == name.as_py():
                    nodes.append(node)
                    sets.append(np.sort(hashes(found)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "hashes"])

    return run


def _verify_batches(threshold: Threshold) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (anchor, part, node, hashes), an anchor's own set first, to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        anchor, own = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            us, vs = [], []
            anchors, parts, nodes = (batch.column(i).to_pylist() for i in range(3))
            for key, node, blob in zip(zip(anchors, parts, strict=True), nodes, batch.column(3), strict=True):
                values = np.frombuffer(blob.as_py(), dtype=np.uint64)
                if node == key[0]:
                    anchor, own = key, values
                    continue
                if key != anchor:
                    raise ValueError(f"The set of node {key[0]} is missing.")
                if _linked(own, values, threshold):
                    us.append(key[0])
                    vs.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def _sets(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, join: str = "merge") -> DataFrame:
    """``(node, hashes)`` of the ``wanted(node)``, from the text of one row of each."""
    named = nodes.select("node", "set_sha256", "standing").join(wanted, "node", "left_semi")
    named = settle(named.select("node", "set_sha256", "standing.*"), "wanted")
    bound_batches(docs)
    rows = docs.select(F.col("doc_id").alias("row_id"), "text")
    same = F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("text") == F.col("text_key"))
    named = named.hint(join) if join else named
    read = rows.join(named, same).select("node", "set_sha256", "text")
    return settle(read.mapInArrow(_set_batches(shingle), "node bigint, hashes binary").dropDuplicates(["node"]), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: Threshold) -> DataFrame:
    """The pairs (u, v) whose whole sets reach the threshold."""
    counts = settle(pairs.groupBy("u").agg(F.ceil(F.count("*") / F.lit(PARTNERS)).cast("int").alias("parts")), "anchors")
    partners = pairs.join(counts, "u").select(F.col("u").alias("anchor"), F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), F.col("v").alias("node"))
    own = counts.select(F.col("u").alias("anchor"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("u").alias("node"))
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = partners.unionByName(own).join(sets, "node").withColumn("later", F.col("node") != F.col("anchor"))
    dealt = full.repartition(tasks, "anchor", "part").sortWithinPartitions("anchor", "part", "later", "node")
    return dealt.select("anchor", "part", "node", "hashes").mapInArrow(_verify_batches(threshold), "u bigint, v bigint")


def _linked(one: np.ndarray, other: np.ndarray, threshold: Threshold) -> bool:
    at = np.searchsorted(one, other)
    at[at == len(one)] = 0
    return bool(threshold.reached(int((one[at] == other).sum()), len(one), len(other)))


def _cluster_batches(threshold: Threshold) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (cluster, a, b, side, node, root, n_shingles, registers, hashes) to links that join components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for table, (blobs, sets) in _cells_of(batches, 3, 7):
            nodes, roots = table[:, 4], table[:, 5].tolist()
            found = list(_cell_candidates(table[:, 5], table[:, 6], _registers_of(blobs), table[:, 3], threshold))
            u, v, guess = (np.concatenate([part[i] for part in found]) for i in range(3))
            order = np.argsort(-guess, kind="stable")
            parent: dict[int, int] = {}

            def top(root: int) -> int:
                while (above := parent.get(root, root)) != root:
                    root = above
                return root

            values = [np.frombuffer(blob, dtype=np.uint64) for blob in sets]
            us, vs = [], []
            for i, j in zip(u[order].tolist(), v[order].tolist(), strict=True):
                one, other = top(roots[i]), top(roots[j])
                if one != other and _linked(values[i], values[j], threshold):
                    parent[max(one, other)] = min(one, other)
                    us.append(nodes[i])
                    vs.append(nodes[j])
            yield _links(us, vs)

    return run


def _clusters(hanging: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(cell, node)`` of the nodes of components that ``hanging(u, v)`` connects."""
    tops = components(hanging)
    heads = tops.select(F.col("root").alias("node"), "root").distinct()
    tops = settle(tops.unionByName(heads).select(F.col("root").alias("cell"), F.col("node").alias("root")), "hanging-roots")
    return settle(nodes.select("node", "root").join(tops, "root").select("cell", "node"), "clusters")


def _between(clusters: DataFrame, sets: DataFrame, nodes: DataFrame, threshold: Threshold) -> DataFrame:
    """Links between the components of each cluster."""
    sizes = settle(clusters.groupBy("cell").agg(F.count("*").alias("members")), "cluster-sizes")
    placed = clusters.join(sizes, "cell")
    cells = _whole(placed.filter(F.col("members") <= CLUSTER)).unionByName(_blocks(placed.filter(F.col("members") > CLUSTER), CLUSTER))
    full = cells.join(nodes.select("node", "root", "n_shingles", "registers"), "node").join(sets, "node")
    keys = ["cell", "a", "b"]
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = full.repartition(tasks, *keys).sortWithinPartitions(*keys, "side", "node")
    dealt = dealt.select(*keys, "side", "node", "root", "n_shingles", "registers", "hashes")
    return dealt.mapInArrow(_cluster_batches(threshold), "u bigint, v bigint")


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with the ``root`` of their component under ``links`` and its number of nodes, ``weight``."""
    roots = components(links)
    weights = roots.groupBy("root").agg((F.count("*") + 1).alias("weight"))
    joined = nodes.drop("root", "weight").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return settle(joined.join(weights, "root", "left").fillna(1, ["weight"]), "rooted")


def near_duplicates(docs: DataFrame, threshold: Threshold = Threshold(), shingle: int = SHINGLE, cell: int = CELL) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Rows link when their sets reach the threshold; ``component_id`` is the smallest ``doc_id`` reachable over links,
    and ``kept`` marks the rows that have it.
    """
    rows = settle(sketches(docs, shingle), "sketches")
    classes = rows.filter("n_shingles > 0").groupBy("set_sha256").agg(
        F.min("doc_id").alias("low"),
        F.min(F.struct("doc_id", "text_key")).alias("standing"),
        F.min("n_shingles").alias("n_shingles"),
        F.min("registers").alias("registers"),
    )
    nodes = settle(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    nodes = nodes.withColumns({"root": F.col("node"), "weight": F.lit(1).cast("bigint")})
    banded = nodes.filter(F.col("n_shingles") >= threshold.least_size).select("node", "registers")
    bandings = settle(banded.mapInArrow(_band_batches, "node bigint, bands array<bigint>"), "bandings")

    # The best candidates first.
    shared = _open(_places(bandings, nodes, FIRST))
    # As many sets as there are near copies: not a table to broadcast, at any size.
    sets = _sets(shared.select("node").distinct(), docs, nodes, shingle)
    small, large = shared.filter(F.col("members") <= cell), shared.filter(F.col("members") > cell)
    pairs = settle(_searched(_whole(small).unionByName(_guided(large, cell)), nodes, threshold, True), "pairs")
    links = settle(_verified(pairs, sets, threshold), "links")
    rooted = _rooted(nodes, links)

    # Then all that could still link two components.
    beside = _beside_pivots(_places(bandings, rooted))
    cells = _exhaustive(_open(beside), rooted, bandings, cell).unionByName(_with_pivots(beside, rooted, cell))
    clusters = _clusters(settle(_searched(cells, rooted, threshold, False), "hanging"), rooted)
    missing = settle(clusters.select("node").join(sets.select("node"), "node", "left_anti").distinct(), "missing")
    if not missing.isEmpty():
        sets = sets.unionByName(_sets(missing, docs, rooted, shingle, ""))
    links = links.unionByName(settle(_between(clusters, sets, rooted, threshold), "more-links"))
    rooted = _rooted(nodes, links)

    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = settle(rooted.select("set_sha256", "root").join(lowest, "root").select("set_sha256", "component_id"), "labels")
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = rows.filter("n_shingles > 0").join(labels, "set_sha256").select("doc_id", "n_shingles", "component_id")
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
