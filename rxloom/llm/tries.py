"""Tries of names and their traversal by Levenshtein automata.

The distance is optimal string alignment: insertions, deletions, substitutions and swaps of neighbours cost 1. The
automaton of a query is its dynamic-programming row; a branch is left as soon as no entry is within the bound.

For a distributed join the names are sharded: a name that may have k errors is cut into k + 1 segments, and a name within
the bound must hold one of them unchanged, shifted by no more than the bound allows. Short names may have fewer errors, so
their segments aren't shorter than those of long ones. A swap across a cut would spoil two segments; a query therefore also
asks for its substrings with an end exchanged for the character beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator

BOUND = 2


class Trie:
    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, value: object) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(value)

    def within(self, query: str, bound: int) -> Iterator[tuple[object, int]]:
        """(value, distance) of each word within the bound."""
        n = len(query)
        first = list(range(n + 1))
        stack: list[tuple[dict, list[int], list[int] | None, str, int]] = [(self.root, first, None, "", 0)]
        while stack:
            node, row, above, last, depth = stack.pop()
            if "" in node and row[n] <= bound:
                for v in node[""]:
                    yield v, row[n]
            lo, hi = max(1, depth + 1 - bound), min(n, depth + 1 + bound)
            for c, child in node.items():
                if c == "":
                    continue
                new = [bound + 1] * (n + 1)
                new[0] = depth + 1
                best = new[0]
                for j in range(lo, hi + 1):
                    q = query[j - 1]
                    d = row[j - 1] + (q != c)
                    if row[j] < d - 1 or row[j] + 1 < d:
                        d = row[j] + 1
                    if new[j - 1] + 1 < d:
                        d = new[j - 1] + 1
                    if above is not None and j > 1 and q == last and query[j - 2] == c and above[j - 2] + 1 < d:
                        d = above[j - 2] + 1
                    new[j] = d
                    if d < best:
                        best = d
                if best <= bound or (min(row) < bound and last):
                    stack.append((child, new, row, c, depth + 1))


def allowed(a: str, b: str) -> int:
    """Bound of the distance between two names: short ones have little that tells a typo from another name."""
    return bound_of(min(len(a), len(b)))


def bound_of(n: int) -> int:
    return 0 if n < 4 else 1 if n < 6 else BOUND


def cuts(n: int, parts: int = BOUND + 1) -> list[tuple[int, int]]:
    size, more = divmod(n, parts)
    out, at = [], 0
    for i in range(parts):
        end = at + size + (i >= parts - more)
        out.append((at, end))
        at = end
    return out


def segments(word: str) -> list[str]:
    return [f"{len(word)}.{i}.{word[a:b]}" for i, (a, b) in enumerate(cuts(len(word), bound_of(len(word)) + 1))]


def substrings(query: str) -> set[str]:
    """Every segment key of a word within the allowed distance is among these for at least one of its segments."""
    n, out = len(query), set()
    for m in range(max(1, n - BOUND), n + BOUND + 1):
        bound, delta = bound_of(min(m, n)), n - m
        for i, (a, b) in enumerate(cuts(m, bound_of(m) + 1)):
            for shift in range(-bound, bound + 1):
                if abs(shift) + abs(delta - shift) > bound:
                    continue
                p, q = a + shift, b + shift
                if p < 0 or q > n:
                    continue
                s = query[p:q]
                out.add(f"{m}.{i}.{s}")
                if s and bound:
                    right = s[:-1] + query[q] if q < n else s
                    out.add(f"{m}.{i}.{right}")
                    if p > 0:
                        out.add(f"{m}.{i}.{query[p - 1] + s[1:]}")
                        if len(s) > 1:
                            out.add(f"{m}.{i}.{query[p - 1] + right[1:]}")
    return out
