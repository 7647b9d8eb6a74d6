"""Every stage of the pipeline against a plain version, given the rows that the stage is given."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import plain
import public_tokenizers
import pytest
from tokenizers import Tokenizer

STAGES = dict(corpus_pipeline.STAGES)
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stage_rows(spark, documents):
    """Input and output of every stage, as lists of rows."""
    found, docs = [], documents
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.settle(stage(spark, docs, FOLDER), "stage")
        found.append((name, docs, docs.collect(), out, out.collect()))
        docs = out
    return found


def test_names_and_columns(stage_rows, documents):
    assert [name for name, *_ in stage_rows] == ["language ID", "line dedup", "SimHash near-dedup", "mixing sources", "BPE encoding"]
    assert all(out.columns == documents.columns and out.dtypes == documents.dtypes for _, _, _, out, _ in stage_rows[:-1])


def test_language_stage(stage_rows):
    _, _, given, _, kept = stage_rows[0]
    assert sorted(row.doc_id for row in kept) == sorted(row.doc_id for row in given if re.search(r"[^\W\d_]", row.text or ""))


def test_line_stage(stage_rows):
    _, _, given, _, kept = stage_rows[1]
    wanted = plain.without_repeated([(row.doc_id, row.text) for row in given])
    wanted = {doc: text for doc, text in wanted if text.strip()}
    assert {row.doc_id: row.text for row in kept} == wanted
    assert all(row.n_chars == len(row.text) for row in kept)


def test_near_duplicate_stage(stage_rows):
    _, _, given, _, kept = stage_rows[2]
    prints = {row.doc_id: plain.simhash(row.text) for row in given}
    roots = plain.near_components(list(prints.values()))
    groups = defaultdict(list)
    for doc, value in prints.items():
        groups[roots[value]].append(doc)
    assert sorted(row.doc_id for row in kept) == sorted(map(min, groups.values()))


def test_one_row_of_a_group_stays(spark, table):
    """Rows that share an id, and rows without one, stay or go by themselves."""
    words = "one two three four five six seven eight"
    rows = [(3, words), (3, words.upper()), (None, words), (2, "other words stand here now"), (2, "quite another text of its own"), (None, "alone")]
    kept = STAGES["SimHash near-dedup"](spark, table(rows), FOLDER).collect()
    assert Counter((row.doc_id, row.text.lower()) for row in kept) == Counter([(3, words), (2, rows[3][1]), (2, rows[4][1]), (None, "alone")])


def test_mixing_stage(stage_rows):
    _, _, given, _, kept = stage_rows[3]
    taken = plain.taken_words([(row.doc_id, row.text, row.source) for row in given])
    sizes = {row.doc_id: plain.word_count(row.text) for row in given}
    wanted = {doc: int(taken[doc] / size + 0.5) for doc, size in sizes.items() if size}
    assert Counter(row.doc_id for row in kept) == {doc: n for doc, n in wanted.items() if n}


def test_encoding_stage(stage_rows):
    _, _, given, _, kept = stage_rows[4]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    wanted = Counter()
    for row in given:
        ids = library.encode(row.text, add_special_tokens=False).ids
        wanted[row.doc_id, len(ids), plain.sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((row.doc_id, row.n_tokens, row.decoded_sha256) for row in kept) == wanted


@pytest.mark.parametrize("name", list(STAGES))
def test_awkward_and_empty_tables(spark, awkward, empty, name):
    out = STAGES[name](spark, awkward, FOLDER)
    if name != "BPE encoding":
        assert out.columns == awkward.columns
    assert 0 < out.count() <= 3 * awkward.count()
    assert STAGES[name](spark, empty, FOLDER).count() == 0
