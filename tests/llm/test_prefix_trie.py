"""The prefix trie of conversations against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from postmill.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def in_order(rows):
    """Turns (role, text) of each conversation."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            found[conv].append((turn is not None, turn or 0, role.encode(), sha(f"{len(role)}:{role}{text}"), (role, text)))
    return {conv: [turn[-1] for turn in sorted(turns)] for conv, turns in found.items()}


def with_shared_openings(own):
    out = {}
    for conv, turns in own.items():
        taken = zlib.crc32(str(conv).encode()) % 6
        head = conv - (abs(conv) % 100) * (1 if conv >= 0 else -1)
        out[conv] = own.get(head, [])[:taken] + turns[taken:]
    return out


def plain_trie(conversations):
    members = defaultdict(list)
    for conv, turns in conversations.items():
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[child] for child in children[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own + sum(saved[child] for child in children[node])
    rows = set()
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(conversations[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        rows.add((min(convs), len(node), parent, len(convs), len(children[node]), leaves[node], saved[node], sha(ends)))
    return rows


def found(frame):
    rows = [tuple(row) for row in frame.select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def conversations(seed):
    """Shared openings of all lengths, many copies, conversations much longer than a band, ties and nulls."""
    rng = random.Random(seed)
    words = ["", "a", "b", "bc", None, "é😊"]
    rows = []
    for conv in [*range(-120, 0, 7), *range(0, 420, 3)]:
        for turn in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), rng.choice(words)))
    for conv in range(500, 590):  # copies
        rows += [(conv, turn, "user", "same") for turn in range(4)]
    for conv, length in ((600, 31), (601, 31), (603, 40), (604, 12), (605, 12), (606, 9), (607, 9)):
        rows += [(conv, turn, "user", str(turn % 9)) for turn in range(length)]
    rows += [(700, None, "user", "first"), (700, 3, "b", "x"), (700, 3, "a", "x"), (700, 3, "a", "x"), (700, -1, "a", None)]
    rows += [(None, 0, "user", "nobody"), (None, None, None, None), (None, 1, "user", "a")]
    rng.shuffle(rows)
    return rows


def test_closing_parentheses():
    rng = np.random.default_rng(3)
    for size in (1, 2, 31, 33, 700):
        depth, opens = 0, []
        for left in range(2 * size, 0, -1):
            up = depth == 0 or (depth < left and rng.random() < 0.55)
            depth += 1 if up else -1
            opens.append(up)
        opens = np.array(opens)
        stack, wanted = [], {}
        for place, up in enumerate(opens):
            if up:
                stack.append(place)
            else:
                wanted[stack.pop()] = place
        trie = prefix_trie.Parentheses(opens)
        at = np.flatnonzero(opens)
        closed = trie.find_close(at)
        assert dict(zip(at.tolist(), closed.tolist(), strict=True)) == wanted
        pairs = [sum(opens[i] and not opens[i + 1] for i in range(start, stop)) for start, stop in wanted.items()]
        assert trie.leaf_pairs(np.array(list(wanted)), np.array(list(wanted.values()))).tolist() == pairs


@pytest.mark.parametrize(("span", "shard_nodes"), [(4, 6), (512, 40)])
def test_trie_at_small_bands_and_shards(spark, span, shard_nodes, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    rows = conversations(span)
    turns = prefix_trie.ordered_turns(spark.createDataFrame(rows, SCHEMA))
    got = found(prefix_trie.trie(*prefix_trie.shared_openings(turns), span=span, shard_nodes=shard_nodes))
    assert got == plain_trie(with_shared_openings(in_order(rows)))


def test_conversations_as_they_are(spark):
    rows = conversations(5)
    assert found(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie(in_order(rows))


def test_one_conversation_over_all_tasks(spark):
    """Turns of one conversation in every task are numbered through."""
    rows = [(7, turn, "user", str(turn)) for turn in range(900)] + [(8, 0, "user", "0")]
    numbered = prefix_trie.ordered_turns(spark.createDataFrame(rows, SCHEMA).repartition(5))
    places = sorted((row.conv_id, row.place) for row in numbered.collect())
    assert places == [(7, place) for place in range(900)] + [(8, 0)]


def test_extra_columns_and_empty_tables(spark):
    extra = spark.createDataFrame([(1, 0, "user", "hi", "x", "y")], SCHEMA + ", depth string, digest string")
    assert found(prefix_trie.conversation_trie(extra)) == plain_trie({1: [("user", "hi")]})
    none = spark.createDataFrame([], SCHEMA)
    turns = prefix_trie.ordered_turns(none)
    assert prefix_trie.trie(*prefix_trie.shared_openings(turns)).collect() == []
    nobody = spark.createDataFrame([(None, 1, "user", "hi")], SCHEMA)
    assert prefix_trie.conversation_trie(nobody).collect() == []
