"""Alignment of two tokenizers against their libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import plain
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from postmill.llm import token_alignment as ta

PATHS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def library():
    """(a, b) of a text: (id, bytes) of every token."""
    tokenizer = Tokenizer.from_file(PATHS[0])
    tokenizer.encode_special_tokens = True
    tokenizer.no_truncation()
    tokenizer.no_padding()
    letters = {letter: byte for byte, letter in ta.byte_letters().items()}
    model = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])

    def piece(number):
        name = model.id_to_piece(number)
        return bytes([int(name[3:5], 16)]) if model.is_byte(number) else name.replace("▁", " ").encode()

    def encode(text):
        if not text:
            return [], []
        coded = tokenizer.encode(" " + text, add_special_tokens=False)
        a = [(number, bytes(letters[letter] for letter in token)) for number, token in zip(coded.ids, coded.tokens, strict=True)]
        b = [(number, piece(number)) for number in model.encode(text)]
        sound = all(b"".join(own for _, own in side) == (" " + text).encode() for side in (a, b))
        return (a, b) if sound else ([], [])

    return encode


def plain_groups(a, b):
    ends = []
    for side in (a, b):
        end, own = 0, []
        for _, spelled in side:
            end += len(spelled)
            own.append(end)
        ends.append(own)
    both = set(ends[0]) & set(ends[1])
    cut = []
    for side, own in zip((a, b), ends, strict=True):
        groups = [[]]
        for (number, _), end in zip(side, own, strict=True):
            groups[-1].append(number)
            if end in both:
                groups.append([])
        cut.append(groups[:-1])
    return list(zip(*cut, strict=True))


def plain_rows(rows, encode):
    aligned = [(doc, *encode(text)) for doc, text in rows]
    groups = [plain_groups(a, b) for _, a, b in aligned]
    counts = Counter((x[-1], y[-1]) for own in groups for x, y in own)
    highest = defaultdict(int)
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    out = Counter()
    for (doc, a, b), own in zip(aligned, groups, strict=True):
        links = [(x[-1], y[-1]) for x, y in own]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in own)
        digest = hashlib.sha256(text.encode()).hexdigest() if own else ""
        best = sum(counts[link] == highest[link[1]] for link in links)
        out[doc, len(a), len(b), len(own), len(own), best, sum(counts[link] for link in links), digest] += 1
    return out


@pytest.fixture(scope="module")
def aligner():
    return ta.Aligner(*PATHS)


EDGES = [" ", "  ", " a", "a ", "\n", "\n\n", " \n ", "a\n b", "\t", "a\t b", " \t  b", "\xa0a \xa0b", "▁", "a▁", "<|endoftext|> a<s>", "日本語 テキスト", "\r\n x"]


def test_words_align_as_whole_texts(aligner, library, rows):
    texts = EDGES + plain.fuzz(3000, 5) + [row.text for row in rows[:60]]
    for text, found in zip(texts, aligner.align(texts), strict=True):
        a, b = library(text)
        groups = plain_groups(a, b)
        assert (found.n_a, found.n_b, found.groups) == (len(a), len(b), b";".join(ta.group_text(tuple(x), tuple(y)) for x, y in groups)), text
        assert found.links.tolist() == [ta.link_of(tuple(x), tuple(y)) for x, y in groups]


@pytest.mark.parametrize("chunk", [3, 50])
def test_byte_ranges_compose_in_any_order(aligner, rows, chunk):
    rng = random.Random(chunk)
    texts = [text for text in EDGES + plain.fuzz(150, 6) if text] + [row.text[:600] for row in rows[:12]] + ["x" * 300 + " y"]
    for text in texts:
        parts = [aligner.range_fragment(span, offset, start, stop) for start, stop, offset, span in ta.byte_ranges(text, chunk)]
        while len(parts) > 1:
            at = rng.randrange(len(parts) - 1)
            parts[at : at + 2] = [ta.compose(parts[at], parts[at + 1])]
        found, wanted = ta.whole_text(parts[0]), aligner.align([text])[0]
        assert (found.n_a, found.n_b, found.groups, found.links.tolist()) == (wanted.n_a, wanted.n_b, wanted.groups, wanted.links.tolist())


def test_fragments_are_a_monoid():
    rng = random.Random(2)

    def tokens(end):
        ends = sorted(rng.sample(range(1, end), 9)) + [end]
        return [(rng.randrange(50), at) for at in ends]

    a, b = tokens(40), tokens(40)
    cuts = [0, 5, 6, 19, 33, 40]
    parts = [ta.fragment(a, b, start, stop) for start, stop in zip(cuts, cuts[1:], strict=False)]
    for i in range(len(parts) - 2):
        x, y, z = parts[i : i + 3]
        assert ta.compose(ta.compose(x, y), z) == ta.compose(x, ta.compose(y, z))
    assert all(ta.compose(ta.Fragment(), x) == x == ta.compose(x, ta.Fragment()) for x in parts)
    whole = parts[0]
    for part in parts[1:]:
        whole = ta.compose(whole, part)
    assert whole == ta.fragment(a, b, 0, 40)


def found(frame):
    return Counter(tuple(row) for row in frame.collect())


def test_counts_of_documents(documents, rows, library):
    wanted = plain_rows([(row.doc_id, row.text) for row in rows], library)
    # Texts of over 1,000 characters are composed from byte ranges of several tasks.
    assert found(ta.align(documents, *PATHS, long=1000, chunk=300, fan=3)) == wanted


def test_awkward_and_empty_tables(awkward, empty, library):
    wanted = plain_rows([(row.doc_id, row.text) for row in awkward.collect()], library)
    assert found(ta.align(awkward, *PATHS)) == wanted
    assert ta.align(empty, *PATHS).collect() == []
