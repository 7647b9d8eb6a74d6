"""Byte-pair merging and the compatibility of adjacent tokens.

A sequence of tokens is the encoding of its text exactly when each token encodes to
itself and each adjacent pair does: the first merge that crosses a border in
the whole text would cross it in the pair alone as well, because priority and
left-to-right order among the symbols of the pair are the same in both.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence

# The rank of a pair of symbols, or the given number where they do not merge.
Rank = Callable[[tuple[str, str], float], float]
NEVER = math.inf
SHORT = 48


def merge(symbols: Sequence[str], rank: Rank) -> list[str]:
    """Merge adjacent symbols, lowest rank first and leftmost among equals, until none has a rank."""
    return _merge_short(list(symbols), rank) if len(symbols) <= SHORT else _merge_long(symbols, rank)


def _merge_short(parts: list[str], rank: Rank) -> list[str]:
    ranks = [rank(pair, NEVER) for pair in zip(parts, parts[1:], strict=False)]
    while ranks and (best := min(ranks)) < NEVER:
        at = ranks.index(best)
        merged = parts[at] + parts[at + 1]
        parts[at : at + 2] = [merged]
        del ranks[at]
        if at:
            ranks[at - 1] = rank((parts[at - 1], merged), NEVER)
        if at < len(ranks):
            ranks[at] = rank((merged, parts[at + 1]), NEVER)
    return parts


def _merge_long(symbols: Sequence[str], rank: Rank) -> list[str]:
    """The same with a heap, for symbols whose number is not small."""
    parts: list[str | None] = list(symbols)
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    waiting: list[tuple[float, int, str, str]] = []

    def offer(left: int, right: int) -> None:
        if left >= 0 and right < len(parts):
            one, other = parts[left], parts[right]
            if (value := rank((one, other), NEVER)) < NEVER:
                heapq.heappush(waiting, (value, left, one, other))

    for place in range(len(parts) - 1):
        offer(place, place + 1)
    while waiting:
        _, left, one, other = heapq.heappop(waiting)
        right = after[left]
        if parts[left] != one or right >= len(parts) or parts[right] != other:
            continue
        parts[left], parts[right] = one + other, None
        after[left] = after[right]
        if after[left] < len(parts):
            before[after[left]] = left
        offer(before[left], left)
        offer(left, after[left])
    return [part for part in parts if part is not None]


class Pairs:
    """Whether tokens, alone or in a pair, encode to themselves; answers are remembered."""

    def __init__(self, rank: Rank, symbols: Callable[[str], list[str]]) -> None:
        self.rank = rank
        self.symbols = symbols
        self.alone: dict[str, bool] = {}

    def stands(self, token: str) -> bool:
        if token not in self.alone:
            self.alone[token] = merge(self.symbols(token), self.rank) == [token]
        return self.alone[token]

    def fits(self, left: str, right: str) -> bool:
        if not (self.stands(left) and self.stands(right)):
            return False
        return merge(self.symbols(left) + self.symbols(right), self.rank) == [left, right]
