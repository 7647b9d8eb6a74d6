"""Removal of passages of lines that repeat anywhere in the corpus, in DataFrame expressions only.

Lines are hashed; a rolling hash over the hashes of ``WINDOW`` lines ends a chunk where it is
divisible by ``DIVISOR``, so borders depend on nearby content alone.  A line of ``MIN_WORDS`` words or
more is a chunk by itself.  Chunks of two lines or more are pieces of a text; so are, for every
line with a word, the shortest run of whole lines that starts there and the shortest that ends there
of ``MIN_WORDS`` words or more.  A passage of so many words that stands in two places is covered by the
runs that lie inside it, whatever surrounds it.

A piece is removed where it stands whole at an earlier place that it does not overlap: a smaller ``doc_id``,
then a smaller MD5 of the text, then an earlier line.  A place counts only if no line of it is removed itself, so
every piece that goes stays whole somewhere.  Which places count is found in rounds: a place is lost when a
piece over it repeats a place that is known to stay, and stays when no piece over it repeats a place that
may still stay.  Places depend on earlier ones alone, so every round decides some and all end decided.

Pieces are counted by their MD5 in narrow rows; those that occur more than once are read
again from their texts, and a group is only removed when the least and the greatest text in it are the
same bytes (map-side combine, so a piece in a third of all documents is one row per task).  Joins of
narrow rows may be split by the planner at a hot piece, and only then each text meets the list
of its pieces.

Defined cases: a null text stays null and has no lines; a text that loses all its lines is empty;
pieces without any word are never removed; texts that lose nothing stay as they are, byte for byte;
rows that repeat an id and a text keep or lose the same lines, and different texts under one id are
different rows; a null id counts as the smallest; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.expressions import let
from postmill.sources.staging import settle

WINDOW = 2
BASE = 31
DIVISOR = 3
MIN_LINES = 2
MIN_WORDS = 50
# Lines tried first when a run is measured; no run has more than MIN_WORDS lines with a word.
NEAR = 6
WORD = "[^ \t\r]+"
LEAST = -(1 << 63)


def _line_hash(line: Column) -> Column:
    """32 bits of the MD5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def _rolling(hashes: Column, at: Column) -> Column:
    """Polynomial over the hashes of the last ``WINDOW`` lines up to ``at``."""
    total = F.get(hashes, at)
    for back in range(1, WINDOW):
        total = total + F.when(at >= back, F.get(hashes, at - back)).otherwise(0) * BASE**back
    return total


def _parsed(text: Column) -> Column:
    """``lines`` of a text that is not null, with ``hashes`` and ``words``."""
    return let(
        F.split(text, "\n", -1),
        lambda found: F.struct(
            found.alias("lines"),
            F.transform(found, _line_hash).alias("hashes"),
            F.transform(found, lambda line: F.regexp_count(line, F.lit(WORD))).alias("words"),
        ),
    )


def _chunks(line: Column) -> Column:
    """Array of chunks in order, as ``start`` and ``stop``, the places of their first and last lines."""
    last = F.size(line["lines"]) - 1

    def ends(at: Column) -> Column:
        alone = (F.get(line["words"], at) >= MIN_WORDS) | (F.get(line["words"], at + 1) >= MIN_WORDS)
        return (at == last) | alone | (_rolling(line["hashes"], at) % DIVISOR == 0)

    def chunk(borders: Column, end: Column, number: Column) -> Column:
        start = F.when(number > 0, F.get(borders, number - 1) + 1).otherwise(0)
        return F.struct(start.alias("start"), end.alias("stop"))

    borders = F.filter(F.sequence(F.lit(0), last), ends)
    return let(borders, lambda b: F.transform(b, lambda end, number: chunk(b, end, number)))


def _run_lengths(words: Column) -> Column:
    """For each of the positive ``words`` how many from there on first reach ``MIN_WORDS``, or null."""

    def reach(at: Column, most: int) -> Column:
        return F.aggregate(
            F.slice(words, at + 1, F.lit(most)),
            F.struct(F.lit(0).alias("size"), F.lit(0).alias("words")),
            lambda run, w: F.when(run["words"] >= MIN_WORDS, run).otherwise(
                F.struct((run["size"] + 1).alias("size"), (run["words"] + w).alias("words"))
            ),
            lambda run: F.when(run["words"] >= MIN_WORDS, run["size"]),
        )

    return F.transform(words, lambda w, at: F.when(w >= MIN_WORDS, F.lit(1)).otherwise(F.coalesce(reach(at, NEAR), reach(at, MIN_WORDS))))


def _runs(places: Column, words: Column, names: tuple[str, str]) -> Column:
    """The run from each place on, its near and its far end under ``names``."""

    def ends(size: Column) -> Column:
        found = F.transform(
            places, lambda place, at: F.when(F.get(size, at).isNotNull(), F.struct(place.alias(names[0]), F.get(places, at + F.get(size, at) - 1).alias(names[1])))
        )
        return F.transform(F.filter(found, lambda run: run.isNotNull()), lambda run: F.struct(run["start"].alias("start"), run["stop"].alias("stop")))

    return let(_run_lengths(words), ends)


def _pieces(line: Column) -> Column:
    """Distinct chunks and runs of a text that may be removed, as ``start`` and ``stop``."""
    counts = lambda span: F.slice(line["words"], span["start"] + 1, span["stop"] - span["start"] + 1)
    long_chunks = F.filter(_chunks(line), lambda c: (c["stop"] - c["start"] + 1 >= MIN_LINES) & F.exists(counts(c), lambda w: w > 0))
    worded = F.filter(F.sequence(F.lit(0), F.size(line["lines"]) - 1), lambda at: F.get(line["words"], at) > 0)

    def runs(places: Column) -> Column:
        both = F.struct(places.alias("down"), F.reverse(places).alias("up"))

        def towards(x: Column, name: str, names: tuple[str, str]) -> Column:
            return let(F.transform(x[name], lambda at: F.get(line["words"], at)), lambda words: _runs(x[name], words, names))

        return let(both, lambda x: F.concat(towards(x, "down", ("start", "stop")), towards(x, "up", ("stop", "start"))))

    return F.array_distinct(F.concat(long_chunks, let(worded, runs)))


def _text_of(lines: Column, span: Column) -> Column:
    return F.array_join(F.slice(lines, span["start"] + 1, span["stop"] - span["start"] + 1), "\n")


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def pieces(text: Column) -> Column:
    """Array of ``start``, ``stop`` and ``key`` of the pieces of a text."""

    def keyed(line: Column) -> Column:
        return F.transform(
            _pieces(line), lambda span: F.struct(span["start"].alias("start"), span["stop"].alias("stop"), _key(_text_of(line["lines"], span)).alias("key"))
        )

    return F.when(text.isNotNull(), let(_parsed(text), keyed))


ROW = ["row_id", "row_hash"]
OPEN, KEPT, LOST = 0, 1, 2


def _row_keys() -> list[Column]:
    """Rows are known by their id and the MD5 of their text."""
    return [F.coalesce("doc_id", F.lit(LEAST)).alias("row_id"), _key(F.col("text")).alias("row_hash")]


def _places(docs: DataFrame) -> DataFrame:
    """``(row_id, row_hash, start, stop, key)`` of all places of the pieces that occur more than once, byte for byte."""
    rows = docs.select(*_row_keys(), "text")
    names = [*ROW, "start", "stop", "key"]
    found = rows.select(*ROW, F.explode(pieces(F.col("text"))).alias("piece"))
    occurrences = settle(found.select(*ROW, "piece.*"), "occurrences")
    counted = settle(occurrences.groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1").select("key"), "counted")
    again = settle(occurrences.join(counted, "key").select(*names).distinct(), "again")
    # The texts of what was counted, for the comparison of bytes.
    lists = settle(again.groupBy(*ROW).agg(F.collect_set(F.struct("start", "stop", "key")).alias("spans")), "lists")
    listed = rows.join(lists.hint("merge"), ROW)
    texts = let(
        F.struct(F.split("text", "\n", -1).alias("lines"), F.col("spans").alias("spans")),
        lambda x: F.transform(x["spans"], lambda span: F.struct(span["key"].alias("key"), _text_of(x["lines"], span).alias("text"))),
    )
    compared = listed.select(F.explode(texts).alias("piece")).select("piece.*")
    groups = compared.groupBy("key").agg(F.min("text").alias("least"), F.max("text").alias("greatest"))
    return again.join(settle(groups.filter("least = greatest").select("key"), "same-bytes"), "key")


def _place() -> Column:
    return F.struct(*ROW, "start")


def _earlier(first: str) -> Column:
    """Whether the place ``first`` of the same piece lies before this one, without a line in common."""
    other_row = (F.col(f"{first}.row_id") != F.col("row_id")) | (F.col(f"{first}.row_hash") != F.col("row_hash"))
    before = F.col("start") > F.col(f"{first}.start") + F.col("stop") - F.col("start")
    return F.coalesce(other_row & (F.col(first) < _place()) | ~other_row & before, F.lit(False))


def _decided(places: DataFrame) -> DataFrame:
    """One round: ``places`` with a new ``state``."""
    firsts = places.groupBy("key").agg(
        F.min(F.when(F.col("state") == KEPT, _place())).alias("kept_first"),
        F.min(F.when(F.col("state") != LOST, _place())).alias("open_first"),
    )
    known = places.join(settle(firsts, "firsts"), "key").withColumn("goes", _earlier("kept_first")).withColumn("may_go", _earlier("open_first"))
    # A place meets what goes if the furthest end of what goes and starts by its own end reaches its start.
    starts = known.select(
        *ROW, "start", "stop", "key", F.col("start").alias("at"), F.lit(0).alias("turn"), F.when(F.col("goes"), F.col("stop")).alias("gone"),
        F.when(F.col("may_go"), F.col("stop")).alias("may_be_gone"),
    )
    none = F.lit(None).cast("int")
    ends = known.select(*ROW, "start", "stop", "key", F.col("stop").alias("at"), F.lit(1).alias("turn"), none.alias("gone"), none.alias("may_be_gone"))
    so_far = Window.partitionBy(*ROW).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = starts.unionByName(ends).select(
        *ROW, "start", "stop", "key", "turn", F.max("gone").over(so_far).alias("gone"), F.max("may_be_gone").over(so_far).alias("may_be_gone")
    )
    state = F.when(F.col("gone") >= F.col("start"), LOST).when(F.col("may_be_gone") >= F.col("start"), OPEN).otherwise(KEPT)
    return reached.filter("turn = 1").select(*ROW, "start", "stop", "key", state.alias("state"))


def repeated_pieces(docs: DataFrame) -> DataFrame:
    """``(row_id, row_hash, start, stop)`` of every piece that repeats one that stays whole at an earlier place."""
    places = settle(_places(docs).withColumn("state", F.lit(OPEN)), "places")
    while not places.filter(F.col("state") == OPEN).isEmpty():
        places = settle(_decided(places), "places")
    firsts = places.filter(F.col("state") == KEPT).groupBy("key").agg(F.min(_place()).alias("first"))
    return places.join(settle(firsts, "kept-first"), "key").filter(_earlier("first")).select(*ROW, "start", "stop")


def remove_repeated(docs: DataFrame, report_name: str = "line_dedup") -> DataFrame:
    """``docs`` with repeated pieces taken out of ``text``, and ``n_lines``, ``removed_lines`` and
    ``removed_chunks``, the chunks that lost a line, in a struct column ``report_name``, a name that must be free."""
    removed = repeated_pieces(docs).groupBy(*ROW).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    lists = settle(removed, "removed")
    rows = docs.select(F.struct(*(F.col(f"`{name}`") for name in docs.columns)).alias("doc"), *_row_keys())
    # A list for each document with something to remove is never small: texts are dealt by their row
    # at every size, and the plan does not change where a broadcast would stop to fit.
    joined = rows.join(lists.hint("merge"), ROW, "left")

    def cut(line: Column) -> Column:
        """What is left of a text; sets of places are hashed, so long texts cost no more per line."""
        chunk_of = F.flatten(F.transform(_chunks(line), lambda c, number: F.transform(F.sequence(c["start"], c["stop"]), lambda _: number)))
        places = F.array_distinct(F.flatten(F.transform("spans", lambda span: F.sequence(span["start"], span["stop"]))))
        parts = F.struct(
            places.alias("gone"),
            F.array_except(F.sequence(F.lit(0), F.size(line["lines"]) - 1), places).alias("kept"),
            chunk_of.alias("chunk_of"),
        )
        return let(
            parts,
            lambda x: F.struct(
                F.array_join(F.transform(x["kept"], lambda at: F.get(line["lines"], at)), "\n").alias("text"),
                F.size(x["gone"]).alias("lines"),
                F.size(F.array_distinct(F.transform(x["gone"], lambda at: F.get(x["chunk_of"], at)))).alias("chunks"),
            ),
        )

    dropped = F.when(F.col("spans").isNotNull(), let(_parsed(F.col("doc.text")), cut))
    cleaned = joined.select("doc", dropped.alias("cleaned"))
    kept = [F.col(f"doc.`{name}`") for name in docs.columns]
    kept[docs.columns.index("text")] = F.coalesce("cleaned.text", "doc.text").alias("text")
    report = F.struct(
        F.coalesce(F.regexp_count("doc.text", F.lit("\n")) + 1, F.lit(0)).alias("n_lines"),
        F.coalesce("cleaned.lines", F.lit(0)).alias("removed_lines"),
        F.coalesce("cleaned.chunks", F.lit(0)).alias("removed_chunks"),
    )
    return cleaned.select(*kept, report.alias(report_name))
