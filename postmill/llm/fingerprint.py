"""Merkle fingerprints of documents, in DataFrame expressions only.

A text is sections divided by blank lines, a section is paragraphs divided by line
ends.  The node of a paragraph is the SHA-256 of its text, the node of a section that of
its paragraphs' nodes, the root that of its sections' nodes.  Dividing loses
nothing, so texts are equal when their roots are, and where roots differ the
first differing nodes lead to the edit.

Roots cannot tell a small edit from another text, so the tree also has marks as leaves: all pairs of
neighbouring words, and all runs of a few characters inside a long word, each with the number of times
that it stood before, so that an edit changes the marks near it alone in any script and a repeated word counts as often
as it stands.  The root holds the ``KEPT`` least hashes of the marks beside its sections, and the fingerprint is
the root and these hashes.  Two fingerprints alone give the likeness of their texts: the Dice ratio of
all marks, estimated by the share of the least hashes of both that stand in both (exact for up to ``KEPT`` marks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.expressions import let
from postmill.sources.staging import settle

# What ends a section and a paragraph, and what counts as a space between words.
SECTION_END = "\n\n"
PARAGRAPH_END = "\n"
SPACES = "\n\t\r"
# A word of more characters is also marked by its runs of characters.
BOUND = 16
RUN_CHARS = 8
KEPT = 64
DIGITS = 8
LEAST = -(1 << 63)


def _node(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def sections(text: Column) -> Column:
    """Array of sections: ``node`` and the nodes of its ``paragraphs``."""
    paragraphs = F.transform(
        F.split(text, SECTION_END, -1),
        lambda section: F.transform(F.split(section, PARAGRAPH_END, -1), lambda paragraph: F.sha2(paragraph, 256)),
    )
    return F.transform(paragraphs, lambda nodes: F.struct(_node(nodes).alias("node"), nodes.alias("paragraphs")))


def _character_runs(word: Column) -> Column:
    def runs(letters: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(letters) - RUN_CHARS)
        return F.transform(starts, lambda at: F.concat(*(F.get(letters, at + i) for i in range(RUN_CHARS))))

    return let(F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0)), runs)


def _marks(text: Column) -> Column:
    """Pairs of words, the last word alone, and the character runs of long words, with repeats."""

    def of(words: Column) -> Column:
        pairs = F.transform(words, lambda word, at: F.concat(word, F.lit(" "), F.coalesce(F.get(words, at + 1), F.lit(""))))
        long_words = F.filter(words, lambda word: F.char_length(word) > BOUND)
        return F.concat(pairs, F.flatten(F.transform(long_words, _character_runs)))

    return let(F.split(F.translate(text, SPACES, " " * len(SPACES)), " ", -1), of)


def least_marks(text: Column) -> Column:
    """The least hashes of the marks of a text in ascending order; each mark is hashed with its turn among equals."""

    def hashed(marks: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(marks) - 1), lambda at: (at == 0) | (F.get(marks, at) != F.get(marks, at - 1)))

        def turns(begun: Column, start: Column, number: Column) -> Column:
            last = F.coalesce(F.get(begun, number + 1), F.size(marks)) - start - 1
            mark = F.get(marks, start)
            return F.transform(F.sequence(F.lit(0), last), lambda turn: F.substring(F.md5(F.concat(mark, F.lit(" "), turn.cast("string"))), 1, DIGITS))

        return let(starts, lambda begun: F.flatten(F.transform(begun, lambda start, number: turns(begun, start, number))))

    return F.slice(F.sort_array(F.array_distinct(let(F.sort_array(_marks(text)), hashed))), 1, KEPT)


def fingerprint(tree: Column, least: Column) -> Column:
    """The root over the sections and the least marks, and these marks."""
    marks = F.array_join(least, "")
    nodes = F.array_join(F.transform(tree, lambda section: section["node"]), "")
    return F.concat(F.sha2(F.concat(nodes, marks), 256), F.lit(":"), marks)


def _bytes(print_: Column) -> Column:
    """A fingerprint in half its size, in the same order; for tables that are written or shuffled."""
    return F.unhex(F.concat(F.substr(print_, F.lit(1), F.lit(64)), F.substr(print_, F.lit(66))))


def _digits(bytes_: Column) -> Column:
    """The fingerprint of ``_bytes``."""
    digits = F.lower(F.hex(bytes_))
    return F.concat(F.substr(digits, F.lit(1), F.lit(64)), F.lit(":"), F.substr(digits, F.lit(65)))


def _marks_of(print_: Column) -> Column:
    """Least marks in a fingerprint, after the 64 digits of the root and a colon."""
    count = F.floor((F.char_length(print_) - 65) / DIGITS).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda at: F.substr(print_, at * DIGITS + 66, F.lit(DIGITS)))


def likeness(print_a: Column, print_b: Column) -> Column:
    """Likeness of two texts from their fingerprints, 0 to 1; a text without words has one mark."""

    def ratio(x: Column) -> Column:
        both = F.slice(F.sort_array(F.array_union(x["a"], x["b"])), 1, KEPT)
        shared = F.size(F.array_intersect(F.array_intersect(x["a"], x["b"]), both))
        return 2 * shared / (F.size(both) + shared)

    return let(F.struct(_marks_of(print_a).alias("a"), _marks_of(print_b).alias("b")), ratio)


def _differing(nodes: Column) -> Column:
    """Place of the first node that differs between ``nodes.a`` and ``nodes.b``, or null; a node
    without a partner differs."""
    longest = F.greatest(F.size(nodes["a"]), F.size(nodes["b"]))
    differs = lambda at: ~F.get(nodes["a"], at).eqNullSafe(F.get(nodes["b"], at))
    places = F.when(longest > 0, F.filter(F.sequence(F.lit(0), longest - 1), differs))
    return F.get(places, F.lit(0))


def first_difference(tree_a: Column, tree_b: Column) -> Column:
    """(section, paragraph) of the first edit, descending only into the first branch whose
    nodes differ; null where the trees agree."""
    nodes = F.struct(*(F.transform(tree, lambda s: s["node"]).alias(name) for name, tree in (("a", tree_a), ("b", tree_b))))

    def paragraph(section: Column) -> Column:
        inside = [F.coalesce(F.get(tree, section)["paragraphs"], F.array().cast("array<string>")) for tree in (tree_a, tree_b)]
        return let(F.struct(inside[0].alias("a"), inside[1].alias("b")), _differing)

    found = let(let(nodes, _differing), lambda at: F.struct(at.alias("section"), paragraph(at).alias("paragraph")))
    return F.when(found["section"].isNotNull(), found)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, fingerprint, tree)`` of every row; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.char_length(text).cast("bigint").alias("n_chars"), sections(text).alias("tree"), least_marks(text).alias("least"))
    return rows.select("doc_id", "n_chars", fingerprint(F.col("tree"), F.col("least")).alias("fingerprint"), "tree")


# Neighbours ---------------------------------------------------------------------


def successors(keys: DataFrame) -> DataFrame:
    """``(key, next_key)`` in descending order of the distinct ``key``; the first follows the last.

    Keys are range-partitioned and numbered inside their partition; a row's successor
    is the row with the next number, and only the ends of partitions, one row for each
    partition, are ordered together.
    """
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.repartitionByRange(tasks, F.desc("key")).sortWithinPartitions(F.desc("key"))
    placed = settle(ordered.withColumn("place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("place", 33)
    ends = placed.groupBy(part.alias("part")).agg(F.max("place").alias("place"), F.max("key").alias("first"))
    order = Window.orderBy("part")
    opening = F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    turns = ends.select("place", F.coalesce(F.lead("first").over(order), opening).alias("turn"))
    followers = placed.select((F.col("place") - 1).alias("place"), F.col("key").alias("follower"))
    linked = placed.join(followers, "place", "left").join(turns, "place", "left")
    # A place before the first of a partition belongs to no row, so a follower is in the same partition.
    return linked.select("key", F.coalesce("follower", "turn").alias("next_key"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, one row per document.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document in descending ``doc_id``; after the last comes the first.
    Null texts are empty.  A null id counts as the smallest.  Rows that repeat an id have the
    same next document, and the one of them whose text sorts first stands for the id where it is
    the next.  One row alone is its own next document; no rows give no rows.  Columns
    other than ``doc_id`` and ``text`` are not read.
    """
    # Both roles of a row, the document and the one that follows another, read the same two
    # columns, so that texts are shuffled once.
    base = docs.select(F.coalesce("doc_id", F.lit(LEAST)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    needs = settle(base.groupBy("key").agg(F.floor(F.max(F.char_length("text")) / 2).cast("int").alias("need")), "needs")
    links = successors(needs.select("key"))
    sent = settle(links.join(needs, "key").select(F.col("next_key").alias("key"), F.col("key").alias("to_key"), "need"), "sent")
    same_id = Window.partitionBy("key").orderBy("text")
    rows = base.withColumn("standing", F.lag("key").over(same_id).isNull())
    heads = rows.filter("standing").join(sent, "key")
    heads = heads.select(
        F.col("to_key").alias("key"),
        F.col("key").alias("next_key"),
        F.xxhash64("text").alias("next_hash"),
        F.substr("text", F.lit(1), F.col("need")).alias("next_text"),
    )
    n_chars = F.char_length("text")
    taken = F.floor(n_chars / 2).cast("int")
    edited = base.join(heads, "key").select(
        "key",
        "next_key",
        "next_hash",
        n_chars.cast("bigint").alias("n_chars"),
        "text",
        F.concat(F.substr("text", F.lit(1), n_chars - taken), F.substr("next_text", F.lit(1), taken)).alias("edited"),
    )
    trees = edited.select(
        "key",
        "next_key",
        "next_hash",
        "n_chars",
        F.xxhash64("text").alias("text_hash"),
        F.sha2("edited", 256).alias("edited_sha256"),
        sections(F.col("text")).alias("tree"),
        sections(F.col("edited")).alias("edited_tree"),
        least_marks(F.col("text")).alias("least"),
        least_marks(F.col("edited")).alias("edited_least"),
    )
    printed = trees.select(
        "key",
        "next_key",
        "next_hash",
        "n_chars",
        "text_hash",
        F.unhex("edited_sha256").alias("edited_sha256"),
        _bytes(fingerprint(F.col("tree"), F.col("least"))).alias("fingerprint"),
        _bytes(fingerprint(F.col("edited_tree"), F.col("edited_least"))).alias("edited_fingerprint"),
        first_difference(F.col("tree"), F.col("edited_tree")).alias("change"),
    )
    printed = settle(printed, "fingerprints")
    # Every text's marks are taken once; the next document's come from its own row.
    prints = printed.groupBy(F.col("key").alias("next_key"), F.col("text_hash").alias("next_hash")).agg(F.min("fingerprint").alias("next_fingerprint"))
    joined = printed.join(prints, ["next_key", "next_hash"]).select(
        "key",
        "n_chars",
        F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        *(_digits(F.col(name)).alias(name) for name in ("fingerprint", "edited_fingerprint", "next_fingerprint")),
        "change",
    )
    return joined.select(
        F.nullif("key", F.lit(LEAST)).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        "change",
    )
