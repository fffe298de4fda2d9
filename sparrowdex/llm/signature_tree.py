"""The signature tree: which of a set of hash sets are linked, directly or through others.

Leaves hold a few sets that are neighbours in min-hash order; every node holds the OR of the token
bitmaps below it, the range of set sizes and the largest surplus of tokens over bits.  A dual
traversal of the tree with itself leaves out a pair of nodes if no two sets below it can overlap
enough, or if all of them are linked already; pairs of sets that remain are compared exactly.
"""

from __future__ import annotations

import numpy as np

_WORDS = 32  # bitmap of 2048 bits
_LEAF = 8
_FAN = 4


def signature(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(_WORDS * 64, dtype=np.uint8)
    bits[(hashes >> np.uint64(40)) % np.uint64(_WORDS * 64)] = 1
    return np.packbits(bits).view(np.uint64)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate((x, y))
    both.sort(kind="stable")  # two runs: merged in linear time
    return int(np.count_nonzero(both[1:] == both[:-1]))


class _Level:
    def __init__(self, sig, least, most, surplus, first):
        self.sig, self.least, self.most, self.surplus, self.first = sig, least, most, surplus, first
        self.one = np.zeros(len(least), dtype=bool)  # all below known to be linked

    def above(self) -> _Level:
        cut = np.arange(0, len(self.least), _FAN)
        return _Level(
            np.bitwise_or.reduceat(self.sig, cut, axis=0),
            np.minimum.reduceat(self.least, cut),
            np.maximum.reduceat(self.most, cut),
            np.maximum.reduceat(self.surplus, cut),
            self.first[cut],
        )


class SignatureTree:
    """Links among sets whose Jaccard similarity is num/den or more."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int, labels: list[int] | None = None):
        order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))
        self.order, self.num, self.den = order, num, den
        self.sets = [sets[i] for i in order]
        self.n = np.array([len(s) for s in self.sets], dtype=np.int64)
        self.root = list(range(len(order)))
        self.compared = 0
        if labels is not None:
            first: dict[int, int] = {}
            for i, k in enumerate(order):
                self._join(first.setdefault(labels[k], i), i)
        sig = np.stack([signature(s) for s in self.sets])
        surplus = self.n - np.bitwise_count(sig).sum(axis=1).astype(np.int64)
        self.sig, self.surplus = sig, surplus
        cut = np.arange(0, len(order), _LEAF)
        self.levels = [
            _Level(np.bitwise_or.reduceat(sig, cut, axis=0), np.minimum.reduceat(self.n, cut), np.maximum.reduceat(self.n, cut), np.maximum.reduceat(surplus, cut), cut)
        ]
        while len(self.levels[-1].least) > 1:
            self.levels.append(self.levels[-1].above())

    def _find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def _join(self, i: int, j: int) -> None:
        i, j = self._find(i), self._find(j)
        self.root[max(i, j)] = min(i, j)

    def _span(self, level: int, i: int) -> range:
        first = self.levels[level].first
        return range(int(first[i]), int(first[i + 1]) if i + 1 < len(first) else len(self.sets))

    def _one(self, level: int, i: int) -> bool:
        at = self.levels[level]
        if not at.one[i]:
            span = self._span(level, i)
            r = self._find(span[0])
            at.one[i] = all(self._find(k) == r for k in span)
        return bool(at.one[i])

    def _apart(self, sig_x, sig_y, least_x, most_x, least_y, most_y, surplus) -> bool:
        """True if no set of one side can be linked with one of the other."""
        num, den = self.num, self.den
        if most_x * den < num * least_y or most_y * den < num * least_x:
            return True
        most = min(int(np.bitwise_count(sig_x & sig_y).sum()) + int(surplus), int(most_x), int(most_y))
        return (num + den) * most < num * (int(least_x) + int(least_y))

    def _leaves(self, i: int, j: int) -> None:
        for a in self._span(0, i):
            for b in self._span(0, j):
                if (i == j and b <= a) or self._find(a) == self._find(b):
                    continue
                na, nb = int(self.n[a]), int(self.n[b])
                if self._apart(self.sig[a], self.sig[b], na, na, nb, nb, min(self.surplus[a], self.surplus[b])):
                    continue
                self.compared += 1
                both = overlap(self.sets[a], self.sets[b])
                if self.den * both >= self.num * (na + nb - both):
                    self._join(a, b)

    def roots(self) -> list[int]:
        """For each set, in the order given, the index of one set of its class (the same for all of it)."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            at = self.levels[level]
            if self._one(level, i) and (i == j or (self._one(level, j) and self._find(int(at.first[i])) == self._find(int(at.first[j])))):
                continue
            if i != j and self._apart(at.sig[i], at.sig[j], at.least[i], at.most[i], at.least[j], at.most[j], min(at.surplus[i], at.surplus[j])):
                continue
            if level == 0:
                self._leaves(i, j)
                continue
            end = len(self.levels[level - 1].least)
            pairs = [
                (level - 1, x, y)
                for x in range(_FAN * i, min(_FAN * i + _FAN, end))
                for y in range(_FAN * j, min(_FAN * j + _FAN, end))
                if i != j or x <= y
            ]
            # a node with itself comes first: what is linked within need not be met across
            stack.extend(sorted(pairs, key=lambda p: p[1] == p[2]))
        out = [0] * len(self.order)
        for i, k in enumerate(self.order):
            out[k] = self.order[self._find(i)]
        return out
