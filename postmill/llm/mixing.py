"""Mixing sources to target weights, in DataFrame expressions only.

The words of a source, its documents in a seeded permutation, form one stream that is read
as often as the source's target asks for.  The stream up to the target is cut into blocks of
equal word counts, so quotas are exact numbers of blocks.  A splitting tree deals them to
the output shards: each node splits its vector of quotas between its two halves by a
multivariate-hypergeometric draw, which is what a uniform shuffle of all blocks followed by a cut
would give, without a shuffle of blocks.  A shard then takes its own disjoint range of each
source's permuted blocks, and orders what it took by a hash.

Every draw is a function of the seed and the place in the tree, and every position one of the
seed and the document, so runs agree on any partitioning.

Defined cases: a null text has no words; documents without words take none; a null
source comes last and is a source like any other; no words at all give targets of 0; rows that repeat
an id are documents of their own; columns other than ``doc_id``, ``text`` and ``source`` are
not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.expressions import let
from postmill.sources.staging import settle

# What a word is, and the weights in the order of the sources.
WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3

BLOCK_WORDS = 1 << 14
SHARD_BLOCKS = 256
RUN_ROWS = 10_000
# Standard deviations around the mode that a draw looks at; what lies outside has no weight in a double.
REACH = 30


@dataclass(frozen=True)
class Mix:
    """Three tables: what each source gives, what each document gives, and where it goes."""

    sources: DataFrame
    documents: DataFrame
    pieces: DataFrame


# Targets ------------------------------------------------------------------------


def _ranked(sources: DataFrame) -> DataFrame:
    """``rank`` of the sources by code point, null last: numbered inside range partitions,
    plus the sources in front of the partition."""
    order = [F.col("source").isNull(), F.col("source")]
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sources.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed = settle(dealt.withColumn("place", F.monotonically_increasing_id()), "sources-placed")
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("members"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("members").over(before), F.lit(0)).alias("ahead"))
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("ahead") + inside).drop("part", "place", "ahead")


def targets(sources: DataFrame) -> DataFrame:
    """``(source, source_size)`` with ``target``: shares by weight of all words, none above
    ``MOST_REPEATS`` times its source, and the excess shared by weight until none is.

    The share of a unit of weight is a number; it is raised until the sources above their
    limit no longer change, with one aggregation to three numbers a round.
    """
    cycle = F.pmod("rank", F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (cycle + 1).cast("int"))
    limit = F.col("source_size") * float(MOST_REPEATS)
    weighed = settle(_ranked(sources).withColumn("weight", weight).withColumn("limit", limit), "weighed")
    total = float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    share, full = 0.0, -1
    while True:
        above = F.col("limit") < F.col("weight") * share
        count, held, free = weighed.agg(
            F.count(F.when(above, 1)), F.sum(F.when(above, F.col("limit")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))
        ).first()
        if count == full or not free:
            break
        full, share = count, (total - held) / free
    target = F.least("limit", F.col("weight") * F.lit(share))
    return weighed.select("source", "source_size", "documents", "rank", target.alias("target"))


# Splitting tree -----------------------------------------------------------------------


def _uniform(*place: Column) -> Column:
    """A number in (0, 1) that belongs to a place."""
    return (F.pmod(F.xxhash64(*place), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _drawn(given: Column) -> Column:
    """How many of ``draws`` without replacement from ``population`` are ``marked``.

    The inverse of the hypergeometric distribution at ``uniform``: weights relative to the
    mode by the ratio of neighbours, down to the start, up to the stop, and then a
    walk from the start until the wanted share of their sum is passed.
    """
    population, marked, draws = given["population"], given["marked"], given["draws"]
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def ratio(x: Column) -> Column:
        """Weight of x + 1 over that of x."""
        return ((marked - x) * (draws - x)).cast("double") / ((x + 1) * (population - marked - draws + x + 1)).cast("double")

    def steps(first: Column, last: Column, by: int) -> Column:
        wanted = first <= last if by > 0 else first >= last
        return F.when(wanted, F.sequence(first, last, F.lit(by).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))

    def summed(places: Column, factor: Callable[[Column], Column]) -> Column:
        begin = F.struct(F.lit(1.0).alias("last"), F.lit(0.0).alias("sum"))
        return F.aggregate(
            places,
            begin,
            lambda state, x: let(
                state["last"] * factor(x), lambda w: F.struct(w.alias("last"), (state["sum"] + w).alias("sum"))
            ),
        )

    def walked(reach: Column, sides: Column) -> Column:
        wanted = given["uniform"] * (1.0 + sides["down"]["sum"] + sides["up"]["sum"])
        begin = F.struct(sides["down"]["last"].alias("w"), F.lit(0.0).alias("sum"), zero.alias("below"))
        return let(
            wanted,
            lambda enough: F.aggregate(
                steps(reach["start"], reach["stop"], 1),
                begin,
                lambda state, x: F.struct(
                    F.when(x < reach["stop"], state["w"] * ratio(x)).otherwise(0.0).alias("w"),
                    (state["sum"] + state["w"]).alias("sum"),
                    (state["below"] + F.when(state["sum"] + state["w"] < enough, one).otherwise(zero)).alias("below"),
                ),
                lambda state: F.least(reach["stop"], reach["start"] + state["below"]),
            ),
        )

    low = F.greatest(zero, draws - (population - marked))
    high = F.least(marked, draws)
    likely = F.floor((draws + 1.0) * (marked + 1.0) / (population + 2.0)).cast("bigint")
    spread = (F.sqrt(draws * (marked / population) * (1 - marked / population)) * REACH + 8).cast("bigint")
    bounds = F.struct(low.alias("low"), high.alias("high"), F.greatest(low, F.least(high, likely)).alias("mode"), spread.alias("spread"))
    answer = let(
        bounds,
        lambda b: let(
            F.struct(
                b["mode"].alias("mode"),
                F.greatest(b["low"], b["mode"] - b["spread"]).alias("start"),
                F.least(b["high"], b["mode"] + b["spread"]).alias("stop"),
            ),
            lambda reach: let(
                F.struct(
                    summed(steps(reach["mode"] - 1, reach["start"], -1), lambda x: 1 / ratio(x)).alias("down"),
                    summed(steps(reach["mode"], reach["stop"] - 1, 1), ratio).alias("up"),
                ),
                lambda sides: walked(reach, sides),
            ),
        ),
    )
    return F.when((population > 0) & (marked > 0) & (draws > 0), answer).otherwise(zero)


def _split(quotas: Column, draws: Column, *place: Column) -> Column:
    """The left half's quotas: source by source, drawn from what is left of both."""
    begin = F.struct(
        F.aggregate(quotas, F.lit(0).cast("bigint"), lambda total, q: total + q).alias("population"),
        draws.alias("draws"),
        F.array().cast("array<bigint>").alias("taken"),
    )

    def step(state: Column, quota: Column) -> Column:
        given = F.struct(
            state["population"].alias("population"),
            quota.alias("marked"),
            state["draws"].alias("draws"),
            _uniform(*place, F.size(state["taken"])).alias("uniform"),
        )
        return let(
            let(given, _drawn),
            lambda x: F.struct(
                (state["population"] - quota).alias("population"),
                (state["draws"] - x).alias("draws"),
                F.concat(state["taken"], F.array(x)).alias("taken"),
            ),
        )

    return F.aggregate(quotas, begin, step, lambda state: state["taken"])


def shard_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``(shard, rank, blocks)``: the blocks of each source ``(rank, blocks)`` dealt to the shards.

    Shards hold equal numbers of blocks, to one.  A node of the tree is one row, with a
    number for each source.
    """
    gathered = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", "blocks"))).alias("dealt"))
    total = F.aggregate("quotas", F.lit(0).cast("bigint"), lambda t, q: t + q)
    nodes = gathered.select(
        F.lit(0).cast("bigint").alias("low"),
        F.lit(shards).cast("bigint").alias("high"),
        F.transform("dealt", lambda x: x["rank"]).alias("ranks"),
        F.transform("dealt", lambda x: x["blocks"]).alias("quotas"),
    ).withColumn("total", total)
    for _ in range((shards - 1).bit_length()):
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("bigint")
        nodes = settle(nodes.withColumn("middle", middle), "nodes")
        ahead = lambda shard: F.floor(F.col(shard) * F.col("total") / shards).cast("bigint")
        left = _split(F.col("quotas"), ahead("middle") - ahead("low"), F.lit(seed), F.col("low"), F.col("high"))
        drawn = nodes.withColumn("left", F.when(F.col("middle") > F.col("low"), left).otherwise(F.transform("quotas", lambda q: q * 0)))
        rest = F.zip_with("quotas", "left", lambda q, x: q - x)
        halves = F.array(
            F.struct(F.col("low"), F.col("middle").alias("high"), F.col("left").alias("quotas")),
            F.struct(F.col("middle").alias("low"), F.col("high"), rest.alias("quotas")),
        )
        nodes = drawn.select("ranks", "total", F.explode(halves).alias("half")).filter("half.high > half.low")
        nodes = nodes.select("half.low", "half.high", "ranks", "half.quotas", "total")
    pairs = F.explode(F.arrays_zip("ranks", "quotas")).alias("pair")
    leaves = nodes.select(F.col("low").alias("shard"), pairs)
    return settle(leaves.select("shard", F.col("pair.ranks").alias("rank"), F.col("pair.quotas").alias("blocks")), "shard-quotas")


# Documents ------------------------------------------------------------------------------


def _key(seed: int, name: Column) -> Column:
    """60 bits of a hash of the seed and ``name``."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), name), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _permuted(docs: DataFrame, seed: int) -> DataFrame:
    """``(doc_id, source, size, key)``; the key orders a source's documents."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select("doc_id", "source", size.alias("size"), _key(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"))


def _placed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document with the words of its source in front of it, its ``offset``.

    A source is cut into runs of about ``RUN_ROWS`` documents by its keys, which are uniform;
    words are added up inside runs, and over the runs of a source.
    """
    runs = F.greatest(F.lit(1.0), F.ceil(F.col("documents") / RUN_ROWS))
    run = F.floor(F.col("key") / float(1 << 60) * runs).cast("bigint")
    same = sized["source"].eqNullSafe(sources["source"])
    rows = settle(sized.join(sources, same).drop(sources["source"]).withColumn("run", run), "runs")
    sizes = rows.groupBy("rank", "run").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(sizes.select("rank", "run", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead")), "run-starts")
    inside = Window.partitionBy("rank", "run").orderBy("key", "doc_id", "size")
    numbered = rows.withColumn("row", F.row_number().over(inside)).withColumn(
        "words", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.join(starts, ["rank", "run"]).withColumn("offset", F.col("ahead") + F.col("words") - F.col("size")).drop("ahead", "words")


def _shuffled(slots: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """``(rank, shard, block)``: each slot of a source gets one of its blocks, by a seeded permutation.

    A slot's block is its place by a hash among the source's slots.  Slots are numbered inside
    runs of the hash, as documents are.
    """
    key = _key(seed, F.concat_ws(",", "rank", "slot"))
    runs = F.greatest(F.lit(1.0), F.ceil(F.col("blocks") / RUN_ROWS))
    rows = slots.join(sources, "rank").withColumn("key", key).withColumn("run", F.floor(F.col("key") / float(1 << 60) * runs).cast("bigint"))
    rows = settle(rows, "slot-runs")
    before = Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("rank", "run").agg(F.count("*").alias("slots"))
    starts = settle(counts.select("rank", "run", F.coalesce(F.sum("slots").over(before), F.lit(0)).alias("ahead")), "slot-starts")
    inside = Window.partitionBy("rank", "run").orderBy("key", "slot")
    numbered = rows.withColumn("row", F.row_number().over(inside)).join(starts, ["rank", "run"])
    return numbered.select("rank", "shard", (F.col("ahead") + F.col("row") - 1).cast("bigint").alias("block"))


def _pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """One row for each block that a pass over a document reaches into, below the quota."""
    passes = F.ceil(F.col("quota") / F.col("source_size")).cast("bigint")
    wanted = (F.col("size") > 0) & (F.col("quota") > 0)
    each = placed.filter(wanted).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), passes - 1)))
    begin = F.col("pass") * F.col("source_size") + F.col("offset")
    spans = each.withColumn("begin", begin).withColumn("end", F.least(begin + F.col("size"), F.col("quota"))).filter("end > begin")
    width = F.lit(block_words)
    reached = F.sequence(F.floor(F.col("begin") / width), F.floor((F.col("end") - 1) / width))
    cut = spans.withColumn("block", F.explode(reached))
    first = F.greatest(F.col("begin"), F.col("block") * width)
    last = F.least(F.col("end"), (F.col("block") + 1) * width)
    return cut.select(
        "rank", "run", "row", "doc_id", "source", "pass", "block", "blocks", (first - F.col("begin")).alias("from_word"), (last - first).alias("words")
    )


def mix(docs: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> Mix:
    """Mix all of ``docs`` to the target weights of their sources.

    ``documents`` has one row per document: ``size``, ``source_size``, ``target`` and
    ``taken``, the words that its pieces hold.  ``pieces`` says which words of which pass over which
    document go to which ``shard``, and in what ``order`` there.
    """
    sized = settle(_permuted(docs, seed), "sized")
    totals = settle(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents")), "sources")
    quota = F.round("target").cast("bigint")
    sources = settle(
        targets(totals).withColumn("quota", quota).withColumn("blocks", F.ceil(F.col("quota") / block_words).cast("bigint")), "targets"
    )
    blocks = sources.agg(F.sum("blocks")).first()[0] or 0
    shards = max(1, -(-blocks // shard_blocks))
    dealt = shard_quotas(sources.select("rank", "blocks"), shards, seed)
    until = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.withColumn("first", F.coalesce(F.sum("blocks").over(until), F.lit(0)).cast("bigint")).filter("blocks > 0")
    slot = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("slot")
    slots = settle(_shuffled(settle(ranges.select("rank", "shard", slot), "slots"), sources.select("rank", "blocks"), seed), "dealt")
    placed = settle(_placed(sized, sources), "placed")
    pieces = settle(
        _pieces(placed, block_words)
        .join(slots, ["rank", "block"])
        .withColumn("order", F.xxhash64(F.lit(seed), "shard", "doc_id", "run", "row", "pass", "block")),
        "pieces",
    )
    taken = pieces.groupBy("rank", "run", "row").agg(F.sum("words").alias("taken"))
    documents = placed.join(taken, ["rank", "run", "row"], "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")
    )
    return Mix(sources, documents, pieces.select("doc_id", "source", "pass", "from_word", "words", "shard", "order"))


def passes(mixed: Mix) -> DataFrame:
    """``(doc_id, passes)``: how often each document is read, to whole passes; half a pass
    or more counts as one.  Documents that are not read have no row."""
    whole = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    read = mixed.documents.filter("size > 0").groupBy("doc_id").agg(F.max(whole).alias("passes"))
    return read.filter("passes > 0")
