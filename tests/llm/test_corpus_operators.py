"""The other corpus operators against plain Python, on small tables and awkward ones."""

import random
from collections import Counter, defaultdict

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from postmill.llm import exact_dedup, fingerprint, language, line_dedup, mixing, quality, simhash
from postmill.llm.components import components

# Exact de-duplication ---------------------------------------------------------------


def admitted(spark, docs, path):
    return exact_dedup.admit(docs, exact_dedup.open_index(spark, str(path), 4)).collect()


def test_only_ascii_letters_fold(spark, table, tmp_path):
    docs = table([(1, "ÀB"), (2, "Àb"), (3, "àb"), (4, None), (5, ""), (6, "İ"), (7, "i̇")])
    found = {row.doc_id: row for row in admitted(spark, docs, tmp_path)}
    assert {doc: row.keep_id for doc, row in found.items()} == {1: 2, 2: 2, 3: 3, 4: 5, 5: 5, 6: 6, 7: 7}
    assert found[1].text_sha256 == plain.sha("Àb") and found[1].group_size == 2


def test_new_batches_meet_the_index(spark, table, tmp_path):
    index = exact_dedup.open_index(spark, str(tmp_path / "i"), 4)
    exact_dedup.admit(table([(1, "a"), (2, "A"), (3, "b")]), index).collect()
    later = table([(9, "a"), (10, "c"), (11, "c")])
    wanted = {(9, 2, False), (10, 11, False), (11, 11, True)}
    for _ in range(2):  # the second time the batch finds its own digests
        assert {(row.doc_id, row.keep_id, row.kept) for row in exact_dedup.admit(later, index).collect()} == wanted
    assert spark.table(index).count() == 3
    packed = exact_dedup.compact(spark, index, str(tmp_path / "packed"))
    assert {(bytes(r.digest), r.keep_id) for r in spark.table(packed).collect()} == {(bytes(r.digest), r.keep_id) for r in spark.table(index).collect()}


def test_exact_dedup_of_awkward_and_empty_tables(spark, awkward, empty, tmp_path):
    found = admitted(spark, awkward, tmp_path / "a")
    assert len(found) == awkward.count()
    copies = [row for row in found if row.doc_id in (4, 5, 10)]
    assert {(row.keep_id, row.group_size) for row in copies} == {(10, 4)}
    assert Counter(row.text_sha256 for row in found if row.kept) == {row.text_sha256: 1 for row in found}
    assert admitted(spark, empty, tmp_path / "e") == []


# SimHash -----------------------------------------------------------------------------


def test_fingerprints_by_majority(rows):
    for row in rows[:40]:
        assert simhash.fingerprint(row.text.encode()) % (1 << 64) == plain.simhash(row.text)
    assert simhash.fingerprint(b" \t\n") == 0
    assert simhash.fingerprint("A  b".encode()) == simhash.fingerprint(b"a b")


def near(centres: int, around: int, seed: int) -> list[int]:
    rng = random.Random(seed)
    out = []
    for _ in range(centres):
        centre = rng.getrandbits(64)
        out += [centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(6))}) for _ in range(around)]
    return out


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("shard", [2, 7, 1024])
def test_links_are_complete_at_every_shard_size(spark, shard):
    prints = sorted(set(near(6, 14, shard) + near(60, 1, shard + 1)))
    table = spark.createDataFrame([(signed(p),) for p in prints], "print bigint")
    links = simhash.near_links(table, shard=shard).collect()
    pairs = [(row.u % (1 << 64), row.v % (1 << 64)) for row in links]
    assert plain.components(pairs, prints) == plain.near_components(prints)


def test_tree_finds_what_lies_within_the_radius():
    values = list(dict.fromkeys(near(5, 20, 5)))
    tree = simhash.BKTree()
    for value in values:
        tree.add(value)
    for value in values[:30]:
        wanted = {i for i, other in enumerate(values) if (value ^ other).bit_count() <= 4}
        assert set(tree.within(value, 4)) == wanted


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(200, 201), (201, 200), (202, 202)]
    found = components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()
    got = {row.node: row.root for row in found}
    nodes = sorted({x for pair in pairs for x in pair})
    assert {node: got.get(node, node) for node in nodes} == plain.components(pairs, nodes)
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_near_duplicates_of_documents(documents, rows):
    prints = {row.doc_id: plain.simhash(row.text) for row in rows}
    roots = plain.near_components(list(prints.values()))
    least = defaultdict(list)
    for doc, value in prints.items():
        least[roots[value]].append(doc)
    found = {row.doc_id: (row.print % (1 << 64), row.component_id) for row in simhash.near_duplicates(documents).collect()}
    assert found == {doc: (value, min(least[roots[value]])) for doc, value in prints.items()}


def test_near_duplicates_of_awkward_and_empty_tables(awkward, empty):
    found = simhash.near_duplicates(awkward).collect()
    assert len(found) == awkward.count()
    assert {row.component_id for row in found if row.doc_id in (4, 5, 10)} == {4}
    assert {row.component_id for row in found if row.print == 0} == {2}
    assert simhash.near_duplicates(empty).collect() == []


# Fingerprints ------------------------------------------------------------------------


def test_edits_and_neighbours(table):
    texts = {1: "One, two.\nThree", 5: "A b c d.\n\nE f. G h", 9: None, 12: "x", 40: "Last one here. And more, of it."}
    found = {row.doc_id: row for row in fingerprint.edited_fingerprints(table(list(texts.items()))).collect()}
    order = sorted(texts, reverse=True)
    for doc, following in zip(order, order[1:] + order[:1], strict=True):
        text, other = texts[doc] or "", texts[following] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        row = found[doc]
        assert (row.n_chars, row.edited_sha256) == (len(text), plain.sha(edited))
        prints = [plain.fingerprint(each) for each in (text, edited, other)]
        assert [row.fingerprint, row.edited_fingerprint] == prints[:2]
        assert row.near_edited == pytest.approx(plain.likeness(prints[0], prints[1]))
        assert row.near_next == pytest.approx(plain.likeness(prints[0], prints[2]))


def test_likeness_is_that_of_the_fingerprints(documents):
    """Nothing but the returned strings decides how alike two texts are."""
    found = {row.doc_id: row for row in fingerprint.edited_fingerprints(documents).collect()}
    order = sorted(found, reverse=True)
    for doc, following in zip(order, order[1:] + order[:1], strict=True):
        row = found[doc]
        assert row.near_edited == pytest.approx(plain.likeness(row.fingerprint, row.edited_fingerprint))
        assert row.near_next == pytest.approx(plain.likeness(row.fingerprint, found[following].fingerprint))


def test_a_text_of_few_words_is_like_its_half(table):
    texts = [("ha " * 200).strip(), "entirely different words stand in this one " * 30]
    found = {row.doc_id: row for row in fingerprint.edited_fingerprints(table(list(enumerate(texts)))).collect()}
    assert all(row.near_edited > 0.3 and row.near_next < 0.1 for row in found.values())


def test_half_a_text_is_like_the_whole_without_punctuation(table):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    spaced = [" ".join(word() for _ in range(n)) for n in (12, 40, 300)]
    unspaced = ["".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(n)) for n in (60, 900)]
    found = fingerprint.edited_fingerprints(table(list(enumerate(spaced + unspaced)))).collect()
    assert all(row.near_edited > 0.2 and row.near_edited > row.near_next + 0.2 for row in found)


def test_half_a_document_is_like_the_whole(documents):
    found = fingerprint.edited_fingerprints(documents.filter("length(text) >= 100")).collect()
    assert all(row.near_edited > row.near_next or row.near_next > 0.8 for row in found)


def test_the_first_difference_is_located(spark):
    pairs = [("a\nb\n\nc\nd", "a\nb\n\nc\nX", (1, 1)), ("a", "a", None), ("a\nb", "a", (0, 1)), ("a", "a\n\nb", (1, 0))]
    frame = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    trees = frame.select("a", "b", fingerprint.sections(F.col("a")).alias("s"), fingerprint.sections(F.col("b")).alias("t"))
    found = {(row.a, row.b): row.d for row in trees.select("a", "b", fingerprint.first_difference(F.col("s"), F.col("t")).alias("d")).collect()}
    assert {key: tuple(value) if value else None for key, value in found.items()} == {(a, b): at for a, b, at in pairs}


def test_fingerprints_of_awkward_and_empty_tables(awkward, empty, table):
    found = fingerprint.edited_fingerprints(awkward).collect()
    assert len(found) == awkward.count()
    assert all(0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1 for row in found)
    assert len({row.fingerprint for row in found if row.doc_id in (4, 5)}) == 1
    assert fingerprint.fingerprints(awkward).count() == awkward.count()
    assert fingerprint.edited_fingerprints(empty).collect() == []
    alone = fingerprint.edited_fingerprints(table([(3, "abcd")])).collect()
    assert alone[0].edited_sha256 == plain.sha("abab") and alone[0].near_next == 1.0


# Lines ---------------------------------------------------------------------------------


def lines_left(docs):
    return Counter((row.doc_id, row.text) for row in line_dedup.remove_repeated(docs).collect())


def test_repeated_lines_of_documents(documents, rows):
    assert lines_left(documents) == Counter(plain.without_repeated([(row.doc_id, row.text) for row in rows]))


def test_a_passage_that_goes_stays_whole_somewhere(table):
    rng = random.Random(11)
    line = {name: " ".join(f"{name}{rng.randrange(10**6)}" for _ in range(30)) for name in "ABCDEFGHPQRST"}
    orders = ["PBC", "ABCQ", "RAB", "SAB", "CDEF", "DEFG", "EFGH", "FGHAB", "TABTAB", "ABCDEFGH"]
    rows = [(i, "\n".join(line[name] for name in order)) for i, order in enumerate(orders)]
    # Texts under one id, null ids and repeated rows.
    rows += [(7, rows[4][1] + "\nown"), (7, "other\n" + rows[4][1]), (None, rows[1][1]), (None, "x\n" + rows[1][1]), (3, rows[3][1])]
    assert lines_left(table(rows)) == Counter(plain.without_repeated(rows))
    # BC goes from the second text, so AB is first whole in the third.
    few = plain.without_repeated(rows[:4])
    assert [text.split("\n") for _, text in few] == [[line[name] for name in order] for order in ("PBC", "AQ", "RAB", "S")]


def test_a_passage_goes_wherever_it_stands(table):
    passage = " ".join(f"word{i}" for i in range(60))
    texts = [(i, f"Own line {i}.\n{passage}\nOther line {i}.") for i in range(5)]
    found = {row.doc_id: row for row in line_dedup.remove_repeated(table(texts)).collect()}
    assert found[0].text == texts[0][1]
    assert all(passage not in found[i].text and f"Own line {i}." in found[i].text for i in range(1, 5))
    assert found[3].line_dedup.removed_lines == 1 and found[3].line_dedup.n_lines == 3


def test_passages_of_short_lines_go_in_any_context(table):
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passages = [[words(12) for _ in range(5)], [words(n) for n in (3, 20, 1, 40, 15, 5)], [words(7) for _ in range(9)]]
    texts = []
    for i in range(18):
        own = [words(rng.randrange(1, 9)) for _ in range(6)]
        texts.append((i, "\n".join(own[:3] + passages[i % 3] + own[3:])))
    found = {row.doc_id: row for row in line_dedup.remove_repeated(table(texts)).collect()}
    for i, text in texts:
        left = text if i < 3 else "\n".join(line for line in text.split("\n") if line not in passages[i % 3])
        assert found[i].text == left
        assert found[i].line_dedup.removed_lines == (0 if i < 3 else len(passages[i % 3]))


def test_a_line_without_end_keeps_its_first_run(table):
    line = " ".join(f"v{i}" for i in range(12))
    found = line_dedup.remove_repeated(table([(1, "\n".join([line] * 40)), (2, f"own\n{line}\nwords")])).collect()
    assert {row.doc_id: row.text for row in found} == {1: "\n".join([line] * 5), 2: f"own\n{line}\nwords"}


def test_other_bytes_under_one_key_stay(table, monkeypatch):
    monkeypatch.setattr(line_dedup.F, "md5", lambda column: F.lit("0" * 32))
    texts = [(1, "a b\nc d\ne f"), (2, "g h\ni j\nk l")]
    found = {row.doc_id: row.text for row in line_dedup.remove_repeated(table(texts)).collect()}
    assert found == dict(texts)


def test_lines_of_awkward_and_empty_tables(awkward, empty):
    found = line_dedup.remove_repeated(awkward, "report")
    assert found.columns == [*awkward.columns, "report"]
    rows = found.collect()
    assert len(rows) == awkward.count()
    assert all(row.text is None for row in rows if row.doc_id == 2)
    before = {row.doc_id: row.text for row in awkward.collect()}
    assert all(row.text == before[row.doc_id] for row in rows if row.doc_id in (1, 3, 6, 7, 8, 9, 10))
    assert line_dedup.remove_repeated(empty).collect() == []


# Mixing --------------------------------------------------------------------------------


def test_targets_and_words_of_documents(documents, rows):
    found = mixing.mix(documents, block_words=500, shard_blocks=20)
    got = {row.doc_id: row.taken for row in found.documents.collect()}
    assert got == plain.taken_words([(row.doc_id, row.text, row.source) for row in rows])
    by_source = found.documents.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    assert all(abs(row.taken - row.target) <= 0.5 for row in by_source.collect())
    again = mixing.mix(documents.repartition(7), block_words=500, shard_blocks=20)
    assert {tuple(row) for row in again.pieces.collect()} == {tuple(row) for row in found.pieces.collect()}
    shards = [row["words"] for row in found.pieces.groupBy("shard").agg(F.sum("words").alias("words")).collect()]
    assert len(shards) > 2 and max(shards) <= 21 * 500


def test_limits_are_shared_again(spark):
    sizes = {"a": 10, "b": 1000, "c": 10, None: 500}
    frame = spark.createDataFrame([(name, size, 1) for name, size in sizes.items()], "source string, source_size bigint, documents bigint")
    found = {row.source: row.target for row in mixing.targets(frame).collect()}
    assert found == pytest.approx(plain.target_shares(sizes))
    assert found["a"] == 30


def test_the_tree_keeps_quotas_and_draws_without_replacement(spark):
    quotas = {0: 400, 1: 0, 2: 37, 3: 163}
    frame = spark.createDataFrame(list(quotas.items()), "rank bigint, blocks bigint")
    drawn = mixing.shard_quotas(frame, 12, seed=5).collect()
    assert {r: sum(row.blocks for row in drawn if row["rank"] == r) for r in quotas} == quotas
    assert {sum(row.blocks for row in drawn if row.shard == s) for s in range(12)} == {50}
    # The first of two halves holds a hypergeometric number of the marked.
    pair = spark.createDataFrame([(0, 30), (1, 70)], "rank bigint, blocks bigint")
    halves = [mixing.shard_quotas(pair, 2, seed).filter("shard = 0 AND rank = 0").first().blocks for seed in range(12)]
    assert abs(np.mean(halves) - 15) < 2.5 and len(set(halves)) > 2


def test_mix_of_awkward_and_empty_tables(awkward, empty):
    found = mixing.mix(awkward).documents.collect()
    assert len(found) == awkward.count()
    assert all(row.taken <= 3 * row["size"] for row in found)
    assert mixing.mix(empty).documents.collect() == []


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_batches_meet_the_digests_of_earlier_ones(spark, awkward, empty, tmp_path, batches):
    copies = spark.createDataFrame([(i, f"Text {i % 7}") for i in range(40)] + [(None, "TEXT 3"), (39, "text 4")], "doc_id bigint, text string")
    for number, docs in enumerate((copies, awkward, empty)):
        paths = [str(tmp_path / f"{batches}-{number}-{name}") for name in ("whole", "parts")]
        whole, parts = (exact_dedup.open_index(spark, path, 2) for path in paths)
        expected = sorted(map(str, exact_dedup.admit(docs, whole).collect()))
        found = exact_dedup.admit_batches(docs, parts, batches)
        assert spark.table(parts).groupBy("digest").count().filter("count > 1").isEmpty()
        exact_dedup.drop_index(spark, parts, paths[1])
        assert sorted(map(str, found.collect())) == expected
        assert not spark.catalog.tableExists(parts)


def test_blocks_of_a_source_are_permuted(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN_ROWS", 60)
    sources = spark.range(1, 501).selectExpr("id AS rank", "id AS blocks")
    slots = sources.selectExpr("rank", "explode(sequence(0L, blocks - 1)) AS slot").selectExpr("rank", "slot AS shard", "slot")
    dealt = {}
    for row in mixing._shuffled(slots, sources, 3).collect():
        dealt.setdefault(row["rank"], {})[row["shard"]] = row["block"]
    neighbours = 0
    for n, blocks in dealt.items():
        assert sorted(blocks) == sorted(blocks.values()) == list(range(n))
        steps = [blocks[i + 1] - blocks[i] for i in range(n - 1)]
        assert n < 8 or len(set(steps)) > n / 4  # neither a rotation nor a stride
        neighbours += sum(abs(step) == 1 for step in steps)
    assert len(dealt) == 500 and neighbours < 1500  # about two for each permutation by chance


# Learned models -------------------------------------------------------------------------


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality.classify(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").collect()
    good = [row.score for row in scored if row.quality == 1]
    bad = [row.score for row in scored if row.quality == 0]
    above = np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good])
    assert above > 0.98
    assert np.mean([score >= 0.7 for score in good]) > 0.97


def test_quality_of_awkward_and_empty_tables(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    few = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (8, 0, 0), (4, None, 1), (None, 1, 0), (5, 0, 0)], "doc_id bigint, quality int, toxic int")
    for labels in (none, few):
        found = quality.classify(awkward, labels).collect()
        assert len(found) == awkward.count() and all(0 <= row.score <= 1 for row in found)
        assert quality.classify(empty, labels).collect() == []
    assert {row.score for row in quality.classify(awkward, none).collect()} == {0.5}


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([row.lang_pred == row.lang for row in found if row.held_out]) > 0.97
    assert all(0 <= row.score <= 1 for row in found)


def test_language_of_awkward_and_empty_tables(awkward, empty):
    found = language.identify(awkward).collect()
    assert len(found) == awkward.count()
    assert {row.lang_pred for row in found if row.doc_id in (2, 3, 7, 8)} == {"und"}
    assert all(row.lang_pred in ("en", "de", "fr") for row in found if row.doc_id in (1, 4, 6, 9))
    assert language.identify(empty).collect() == []
    assert {row.lang_pred for row in language.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_folded_weights_equal_the_kernel():
    texts = ["the cat and the dog", "der hund und die katze", "the house", "das haus und der hof", "a tree", "ein baum"]
    langs = ["en", "de"] * 3
    grams = [language.present(text) for text in texts]
    model = language.solve(langs, grams, landmarks=2)
    shared = np.array([[len(set(a) & set(b)) for b in grams[:4]] for a in grams], dtype=float)
    known = set(np.concatenate(grams[:4]))
    sizes = np.array([len(set(g) & known) for g in grams], dtype=float)
    kernel = shared / np.sqrt(sizes[:, None] * sizes[None, :4])
    wanted = np.array([[1.0, -1.0] if lang == "de" else [-1.0, 1.0] for lang in langs])
    left = kernel.T @ kernel + language.RIDGE * 6 * kernel[:4] + 1e-9 * np.eye(4)
    assert model.score(texts) == pytest.approx(kernel @ np.linalg.solve(left, kernel.T @ wanted), abs=1e-3)


def test_fingerprints_are_kept_in_half_their_size(spark):
    texts = ["", "a b c", "one two\n\nthree " * 40]
    tree, least = fingerprint.sections(F.col("text")), fingerprint.least_marks(F.col("text"))
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(fingerprint.fingerprint(tree, least).alias("print"))
    halves = rows.withColumn("half", fingerprint._bytes(F.col("print"))).withColumn("again", fingerprint._digits(F.col("half"))).collect()
    assert all(r["again"] == r["print"] and 2 * len(r["half"]) == len(r["print"]) - 1 for r in halves)
