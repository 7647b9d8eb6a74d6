"""Plain Python versions of the corpus operators, for small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import xxhash

LETTERS = (
    "a e T th \n é ß É 日本 \t \x00 \xa0 　 😊 The ing 's ' 'LL . , !! <|endoftext|> <|startoftext|> <| <s> </s> <0x0A> ﬁ 한 \r\n "
    "Σ ΑΣ İ aaaa 1 ² ½ 23 \x1c \x85 _ - ǅ ​ ﻿ ª"
).split(" ") + [" ", "  ", "     "]


def fuzz(count: int, seed: int, longest: int = 14) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, longest))) for _ in range(count)]


def fold(text: str | None) -> bytes:
    return (text or "").encode().lower()


def simhash(text: str | None) -> int:
    words = fold(text).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    votes = Counter(bit for s in shingles for bit in range(64) if xxhash.xxh64_intdigest(s, 42) >> bit & 1)
    return sum(1 << bit for bit, n in votes.items() if 2 * n > len(shingles))


def components(links: list[tuple[int, int]], nodes: list[int]) -> dict[int, int]:
    parent = {node: node for node in nodes}

    def root(node: int) -> int:
        while parent[node] != node:
            node = parent[node]
        return node

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {node: root(node) for node in nodes}


def near_components(prints: list[int], radius: int = 4) -> dict[int, int]:
    nodes = sorted(set(prints))
    links = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if (a ^ b).bit_count() <= radius]
    return components(links, nodes)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def least_marks(text: str) -> list[str]:
    words = re.sub("[\n\t\r]", " ", text).split(" ")
    marks = [f"{word} {after}" for word, after in zip(words, words[1:] + [""], strict=True)]
    marks += [word[i : i + 8] for word in words if len(word) > 16 for i in range(len(word) - 7)]
    turns: Counter[str] = Counter()
    hashes = set()
    for mark in marks:
        hashes.add(hashlib.md5(f"{mark} {turns[mark]}".encode()).hexdigest()[:8])
        turns[mark] += 1
    return sorted(hashes)[:64]


def fingerprint(text: str) -> str:
    marks = "".join(least_marks(text))
    nodes = "".join(sha("".join(sha(p) for p in s.split("\n"))) for s in text.split("\n\n"))
    return f"{sha(nodes + marks)}:{marks}"


def likeness(one: str, other: str) -> float:
    a, b = ({x[i : i + 8] for i in range(65, len(x), 8)} for x in (one, other))
    both = set(sorted(a | b)[:64])
    shared = len(a & b & both)
    return 2 * shared / (len(both) + shared)


def line_chunks(text: str) -> list[tuple[str, int, int]]:
    """(text, lines, words) of each chunk."""
    lines = text.split("\n")
    hashes = [int(hashlib.md5(line.encode()).hexdigest()[:8], 16) for line in lines]
    words = [len(re.findall(r"[^ \t\r]+", line)) for line in lines]
    out, start = [], 0
    for i in range(len(lines)):
        rolling = hashes[i] + 31 * (hashes[i - 1] if i else 0)
        alone = words[i] >= 50 or (i + 1 < len(lines) and words[i + 1] >= 50)
        if i == len(lines) - 1 or alone or rolling % 3 == 0:
            out.append(("\n".join(lines[start : i + 1]), i + 1 - start, sum(words[start : i + 1])))
            start = i + 1
    return out


def line_pieces(text: str) -> list[tuple[int, int]]:
    """First and last line of the pieces of a text: chunks of two lines or more with a word, and the shortest
    runs of 50 words from and up to every line with a word."""
    found, start = set(), 0
    for _, lines, words in line_chunks(text):
        if lines >= 2 and words:
            found.add((start, start + lines - 1))
        start += lines
    sizes = [len(re.findall(r"[^ \t\r]+", line)) for line in text.split("\n")]
    for first, own in enumerate(sizes):
        if own:
            total, last = 0, first
            while last < len(sizes) and (total := total + sizes[last]) < 50:
                last += 1
            if last < len(sizes):
                found.add((first, last))
            total, up = 0, first
            while up >= 0 and (total := total + sizes[up]) < 50:
                up -= 1
            if up >= 0:
                found.add((up, first))
    return sorted(found)


def removed_lines(rows: list[tuple[int, str | None]]) -> dict[tuple[int, str], set[int]]:
    """Lines that go of each (id, text): row after row, and in a row by the ends of its pieces."""
    texts = sorted({(-(1 << 63) if doc is None else doc, hashlib.md5(text.encode()).digest(), text) for doc, text in rows if text is not None})
    stays: set[str] = set()
    out = {}
    for doc, _, text in texts:
        lines, spans = text.split("\n"), line_pieces(text)
        keys = {span: "\n".join(lines[span[0] : span[1] + 1]) for span in spans}
        here: dict[str, list[int]] = defaultdict(list)

        def goes(span, here=here, keys=keys):
            return keys[span] in stays or any(stop < span[0] for stop in here[keys[span]])

        for span in sorted(spans, key=lambda span: (span[1], span[0])):
            over = [other for other in spans if other[0] <= span[1] and other[1] >= span[0]]
            if not any(map(goes, over)):
                here[keys[span]].append(span[1])
        out[doc, text] = {at for span in spans if goes(span) for at in range(span[0], span[1] + 1)}
        stays |= {key for key, stops in here.items() if stops}
    return out


def without_repeated(rows: list[tuple[int | None, str | None]]) -> list[tuple[int | None, str | None]]:
    """Rows (id, text) with repeated pieces taken out."""
    gone = removed_lines(rows)

    def left(doc, text):
        if text is None:
            return None
        lost = gone[-(1 << 63) if doc is None else doc, text]
        return "\n".join(line for at, line in enumerate(text.split("\n")) if at not in lost)

    return [(doc, left(doc, text)) for doc, text in rows]


def word_count(text: str | None) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def target_shares(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Shares by weight, held at three times the source, the excess shared again until none is above."""
    names = sorted(sizes, key=lambda name: (name is None, name or ""))
    weights = {name: (5, 2, 1)[i % 3] for i, name in enumerate(names)}
    held: dict[str | None, float] = {}
    while True:
        free = [name for name in names if name not in held]
        if not free:
            return held
        rest = sum(sizes.values()) - sum(held.values())
        unit = rest / sum(weights[name] for name in free)
        above = [name for name in free if unit * weights[name] > 3 * sizes[name]]
        if not above:
            return held | {name: unit * weights[name] for name in free}
        held |= {name: 3.0 * sizes[name] for name in above}


def taken_words(rows: list[tuple[int, str | None, str | None]], seed: int = 0) -> dict[int, int]:
    """Words that the mix takes of each (id, text, source)."""
    by_source = defaultdict(list)
    for doc, text, source in rows:
        by_source[source].append((sha(f"{seed}:{doc}")[:15], doc, word_count(text)))
    shares = target_shares({source: sum(size for *_, size in docs) for source, docs in by_source.items()})
    out = {}
    for source, docs in by_source.items():
        total = sum(size for *_, size in docs)
        quota, place = round(shares[source]), 0
        for _, doc, size in sorted(docs):
            whole, rest = divmod(quota, total) if total else (0, 0)
            out[doc] = size * whole + max(0, min(size, rest - place))
            place += size
    return out
