"""Token counts, word BPE and token blocks against the tokenizer libraries."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from plain import fuzz
from tokenizers import Tokenizer

from postmill.llm import token_blocks, token_counts, word_codec
from postmill.llm.bpe import _merge_long, _merge_short

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def tokenizer(path):
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def test_prefix_counts_equal_encoding_every_prefix():
    counter = token_counts.PrefixCounter(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for number, text in enumerate(fuzz(600, 1)):
        wanted = [len(model.encode(text[:i])) for i in range(len(text) + 1)]
        assert counter.prefix_counts(text) == wanted[1:]
        limit = number % 7
        assert counter.measure(text, limit) == (wanted[-1], max(i for i, n in enumerate(wanted) if n <= limit))


def test_counts_of_whole_documents(documents, rows):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = {row.doc_id: row for row in token_counts.count_tokens(documents, PIECES, 4096).collect()}
    for row in rows:
        wanted = len(model.encode(row.text))
        got = found[row.doc_id]
        assert (got.n_bytes, got.n_tokens, got.over_limit) == (len(row.text.encode()), wanted, wanted > 4096)
        assert len(model.encode(row.text[: got.fit_chars])) <= 4096


def test_prefix_table(table):
    found = token_counts.prefix_counts(table([(1, "ab cd"), (2, None)]), PIECES).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert {row.doc_id: row.counts for row in found} == {1: [len(model.encode("ab cd"[:i])) for i in range(1, 6)], 2: []}


def test_counts_of_awkward_and_empty_tables(awkward, empty):
    found = token_counts.count_tokens(awkward, PIECES, 4096)
    assert found.count() == awkward.count()
    assert found.filter("doc_id IN (2, 3) AND n_tokens = 0 AND n_bytes = 0 AND fit_chars = 0").count() == 2
    assert token_counts.count_tokens(empty, PIECES, 4096).collect() == []


def test_both_ways_of_merging_agree():
    codec = word_codec.WordCodec(WORDS)
    for word in ("thehellonationaaaa", "abcabcabc", "zzzzzzz"):
        symbols = [*word[:-1], word[-1] + "</w>"]
        assert _merge_short(list(symbols), codec.rank) == _merge_long(symbols, codec.rank)


def test_word_codec_equals_the_library():
    texts, library = fuzz(4000, 2), tokenizer(WORDS)
    for text, (ids, decoded) in zip(texts, word_codec.WordCodec(WORDS).round_trip(texts), strict=True):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == wanted, repr(text)
        assert decoded == library.decode(wanted, skip_special_tokens=False), repr(text)


def test_word_codec_when_its_memory_is_full(monkeypatch):
    monkeypatch.setattr(word_codec, "REMEMBERED", 50)
    monkeypatch.setattr(word_codec, "PAIRS_REMEMBERED", 20)
    texts, library, codec = fuzz(300, 3), tokenizer(WORDS), word_codec.WordCodec(WORDS)
    for start in range(0, 300, 10):
        part = texts[start : start + 10]
        for text, (ids, _) in zip(part, codec.round_trip(part), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_word_table_and_decoding(documents, rows):
    library = tokenizer(WORDS)
    coded = word_codec.round_trip(documents, WORDS)
    found = {row.doc_id: row for row in coded.collect()}
    decoded = {row.doc_id: row.decoded for row in word_codec.decode(coded, WORDS).collect()}
    for row in rows:
        wanted = library.encode(row.text, add_special_tokens=False).ids
        got = found[row.doc_id]
        assert np.frombuffer(got.ids, "<u4").tolist() == wanted and got.n_tokens == len(wanted)
        assert got.decoded == decoded[row.doc_id] == library.decode(wanted, skip_special_tokens=False)


def test_words_of_awkward_and_empty_tables(awkward, empty):
    found = word_codec.round_trip(awkward, WORDS)
    assert found.count() == awkward.count()
    assert {(row.n_tokens, row.decoded) for row in found.filter("doc_id IN (2, 3, 7)").collect()} == {(0, "")}
    assert word_codec.round_trip(empty, WORDS).collect() == []


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 20, 32])
def test_packing_round_trip_and_random_access(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    packed = token_blocks.pack(ids, bits)
    assert len(packed) == -(-1000 * bits // 8)
    for start, count in ((0, 1000), (3, 50), (999, 1), (10, 0)):
        assert (token_blocks.unpack(packed, bits, start, count) == ids[start : start + count]).all()
    if bits < 32:
        with pytest.raises(ValueError):
            token_blocks.pack(np.array([1 << bits]), bits)


def test_widths():
    assert [token_blocks.width(n) for n in (1, 2, 3, 50257, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


def test_encoder_equals_the_library():
    texts, library = fuzz(4000, 4), tokenizer(BYTES)
    for text, ids in zip(texts, token_blocks.TextEncoder(BYTES).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_blocks_of_documents(spark, documents, rows, tmp_path):
    path, library = str(tmp_path / "blocks"), tokenizer(BYTES)
    token_blocks.write_blocks(documents, BYTES, path, block_ids=5000)
    found = {row.doc_id: row for row in token_blocks.read_digests(spark, path).collect()}
    start, coded = 0, {}
    for row in sorted(rows, key=lambda row: row.doc_id):
        ids = [*library.encode(row.text, add_special_tokens=False).ids, 2]
        coded[row.doc_id] = np.array(ids, "<u4").tobytes()
        got = found[row.doc_id]
        assert (got.start, got.n_tokens, got.ids_crc32) == (start, len(ids), zlib.crc32(coded[row.doc_id]))
        start += len(ids)
    some = token_blocks.read_documents(spark, path, 20, 29).collect()
    assert {row.doc_id: bytes(row.ids) for row in some} == {doc: ids for doc, ids in coded.items() if 20 <= doc <= 29}
    blocks = spark.read.parquet(path)
    assert blocks.count() > 5 and blocks.select("bits").distinct().collect()[0].bits == 16


def test_blocks_of_awkward_and_empty_tables(spark, awkward, empty, tmp_path):
    token_blocks.write_blocks(awkward, BYTES, str(tmp_path / "a"))
    found = token_blocks.read_digests(spark, str(tmp_path / "a")).collect()
    assert len(found) == awkward.count()
    assert {row.n_tokens for row in found if row.doc_id in (2, 3)} == {1}
    ordered = sorted(found, key=lambda row: row.start)
    assert [row.doc_id is None for row in ordered][:2] == [True, True]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:]))
    token_blocks.write_blocks(empty, BYTES, str(tmp_path / "e"))
    assert token_blocks.read_digests(spark, str(tmp_path / "e")).collect() == []


def test_known_pieces_make_new_cuts_without_the_tokenizer():
    coder = token_blocks.TextEncoder(BYTES)
    line_end, word, signs = coder.encode(["\n", "word", "$$$"])
    coder.known.tokenizer = coder.known.model = None
    assert coder.encode(["\nword$$$", "word$$$"]) == [line_end + word + signs, word + signs]
