"""HyperMinHash near-duplicates against plain Python."""

import random
from collections import Counter, defaultdict

import numpy as np
import plain
import pytest

from postmill.llm import hyperminhash as hm


def shingle_set(text):
    words = plain.fold(text).split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain_rows(rows):
    sets = [shingle_set(text) for _, text in rows]
    holders = defaultdict(list)
    for place, own in enumerate(sets):
        for shingle in own:
            holders[shingle].append(place)
    shared = Counter((i, j) for places in holders.values() for n, i in enumerate(places) for j in places[:n])
    links = [(i, j) for (i, j), n in shared.items() if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n)]
    roots = plain.components(links, list(range(len(rows))))
    least = {}
    for place, (doc, _) in enumerate(rows):
        known = least.get(roots[place])
        least[roots[place]] = doc if known is None else known if doc is None else min(known, doc)
    return Counter((doc, len(sets[i]), least[roots[i]], doc == least[roots[i]]) for i, (doc, _) in enumerate(rows))


def found(frame):
    return Counter((row.doc_id, row.n_shingles, row.component_id, row.kept) for row in frame.collect())


def crowd(seed):
    """Near copies of every likeness, a large group of near copies, and texts that share half of their words."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = ["", " \n", None, "a b", "A  B", "a b c d", "a b c d e", "a b c d e f"]
    for _ in range(25):
        own = [word() for _ in range(rng.choice([6, 9, 11, 12, 30, 80, 300]))]
        texts.append(" ".join(own))
        for _ in range(4):
            copy = list(own)
            for at in rng.sample(range(len(own)), rng.randrange(0, max(2, len(own) // 20))):
                copy[at] = word()
            texts.append(" ".join(copy + [word() for _ in range(rng.randrange(3))]).upper())
    base = [word() for _ in range(150)]
    for _ in range(60):
        copy = list(base)
        copy[rng.randrange(150)] = word()
        texts.append(" ".join(copy))
    half = [word() for _ in range(60)]
    texts += [" ".join(half + [word() for _ in range(40)]) for _ in range(30)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cell", [4, 1024])
def test_components_at_every_cell_size(spark, table, cell, monkeypatch):
    monkeypatch.setattr(hm, "CLUSTER", cell // 2)
    monkeypatch.setattr(hm, "PARTNERS", cell)
    rows = crowd(4)
    assert found(hm.near_duplicates(table(rows), cell=cell)) == plain_rows(rows)


def test_other_thresholds(spark, table):
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k"), (3, "z b c d e f g h i k"), (4, "q r s t u v")]
    kept = hm.near_duplicates(table(rows), hm.Threshold(70, 100)).filter("kept").collect()
    assert {row.doc_id for row in kept} == {1, 4}


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for size, share in ((40, 0.9), (400, 0.85), (4000, 0.5), (60000, 0.2)):
        both = int(size * 2 * share / (1 + share))
        values = rng.integers(0, 1 << 63, 2 * size - both, dtype=np.uint64) * np.uint64(2)
        one, other = hm.registers(values[:size]), hm.registers(values[size - both :])
        equal, used = hm.matches(one[None], other[None])
        chance = hm.collisions(np.array([float(size)]), np.array([float(size)]))[0]
        guess = (equal[0, 0] / used[0, 0] - chance) / (1 - chance)
        errors.append(abs(guess - both / (2 * size - both)))
        assert used[0, 0] == np.count_nonzero(one | other) and 0 <= chance < 0.01
    assert max(errors) < 0.2


def test_collisions_are_as_often_as_said():
    rng = np.random.default_rng(5)
    size, hits, total = 300, 0, 0
    for _ in range(3000):
        one, other = (hm.registers(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)) for _ in range(2))
        both = (one != hm.EMPTY) & (other != hm.EMPTY)
        hits += int((one == other)[both].sum())
        total += int(both.sum())
    assert hits / total == pytest.approx(hm.collisions(np.array([300.0]), np.array([300.0]))[0], rel=0.35)


def test_awkward_and_empty_tables(spark, awkward, empty):
    rows = [(row.doc_id, row.text) for row in awkward.collect()]
    assert found(hm.near_duplicates(awkward)) == plain_rows(rows)
    assert hm.near_duplicates(empty).collect() == []
