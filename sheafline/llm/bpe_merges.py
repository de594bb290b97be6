"""Byte-pair merging with segment trees, for many words at once.

A word is a row of symbols. Over its positions stands a segment tree whose leaf
at a position holds the rank of the pair that starts there, and whose inner nodes
hold the smaller rank of their children, the left one of equals. The root thus
leads to the leftmost pair of the lowest rank. A merge changes three leaves, that
of the pair, that of the symbol it swallows and that of the live neighbour before;
each is carried up the tree in logarithmic time.

Words of like length are merged in lockstep as rows of numpy arrays; a long word
has its tree in Python lists.
"""

from __future__ import annotations

import numpy as np

from .textbytes import Words, ranges

NONE = np.int32(2**31 - 1)
#: Words of more symbols are merged one by one.
LONG = 128
#: Tree cells that are worked on at once.
CELLS = 1 << 20


class MergeTable:
    """Which pairs of symbols merge: three rows of numbers, for each pair left << 32 | right, its rank and the merged symbol."""

    def __init__(self, keys, ranks, merged) -> None:
        keys, ranks, merged = np.array(keys, np.int64), np.array(ranks, np.int32), np.array(merged, np.int32)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], ranks[order]
        self.merged = np.zeros(int(ranks.max()) + 1 if len(ranks) else 1, np.int32)
        self.merged[ranks] = merged
        # for words that are merged one by one; the rank names the merged symbol
        self.by_pair = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32)
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges words that lie one after another in ``symbols``; returns the same for the results."""
        first = np.cumsum(counts) - counts
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, their symbols one after another, how many each
        width = np.ones(len(counts), np.int64)
        big = counts > 2
        width[big] = 1 << np.ceil(np.log2(np.maximum(counts[big] - 1, 1))).astype(np.int64)
        for i in np.flatnonzero(counts > LONG):
            word = np.array(self._long(symbols[first[i] : first[i] + counts[i]].tolist()), np.int32)
            done.append((np.array([i]), word, np.array([len(word)])))
        tiny = np.flatnonzero(counts <= 1)
        done.append((tiny, symbols[ranges(first[tiny], counts[tiny])], counts[tiny]))
        for w in np.unique(width[(counts <= LONG) & (counts > 1)]):
            rows = np.flatnonzero((width == w) & (counts <= LONG) & (counts > 1))
            step = max(1, CELLS // (2 * int(w)))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                done.append((part, *self._lockstep(symbols, first[part], counts[part], int(w))))
        sizes = np.zeros(len(counts), np.int64)
        for rows, _, many in done:
            sizes[rows] = many
        starts = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int32)
        for rows, flat, many in done:
            out[ranges(starts[rows], many)] = flat
        return out, sizes

    def _lockstep(self, symbols: np.ndarray, first: np.ndarray, counts: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(first)
        columns = np.arange(w + 2)
        live = columns[None, :] < counts[:, None]
        sym = np.where(live, symbols[np.minimum(first[:, None] + columns, len(symbols) - 1)], 0).astype(np.int32)
        after = np.broadcast_to(columns + 1, (n, w + 2)).copy()
        before = np.broadcast_to(columns - 1, (n, w + 2)).copy()
        tree = np.full((n, 2 * w), NONE, np.int32)
        paired = columns[None, :w] < counts[:, None] - 1
        r, c = np.nonzero(paired)
        tree[r, w + c] = self.rank(sym[r, c], sym[r, c + 1])
        level = w
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            node = np.ones(len(rows), np.int64)
            while node[0] < w:
                node = 2 * node
                node += tree[rows, node] > tree[rows, node + 1]
            at = node - w
            new = self.merged[tree[rows, node]]
            gone = after[rows, at]
            behind = after[rows, gone]
            sym[rows, at] = new
            live[rows, gone] = False
            after[rows, at] = behind
            before[rows, np.minimum(behind, w + 1)] = at
            ahead = before[rows, at]
            has_next = behind < counts[rows]
            tree[rows, node] = np.where(has_next, self.rank(new, sym[rows, np.minimum(behind, w + 1)]), NONE)
            swallowed = np.where(gone < w, gone, at) + w
            tree[rows[gone < w], gone[gone < w] + w] = NONE
            has_prev = ahead >= 0
            tree[rows[has_prev], ahead[has_prev] + w] = self.rank(sym[rows[has_prev], ahead[has_prev]], new[has_prev])
            left = np.where(has_prev, ahead, at) + w
            while node[0] > 1:
                node, swallowed, left = node >> 1, swallowed >> 1, left >> 1
                for x in (node, swallowed, left):
                    tree[rows, x] = np.minimum(tree[rows, 2 * x], tree[rows, 2 * x + 1])
            rows = rows[tree[rows, 1] != NONE]
        return sym[live], live.sum(axis=1)

    def _long(self, sym: list[int]) -> list[int]:
        n = len(sym)
        w = 1 << (n - 1).bit_length()
        none, pairs = int(NONE), self.by_pair
        rank = lambda a, b: pairs.get(a << 32 | b, none)
        tree = [none] * (2 * w)
        for i in range(n - 1):
            tree[w + i] = rank(sym[i], sym[i + 1])
        for i in range(w - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += w
            tree[i] = value
            i >>= 1
            while i:
                low = tree[2 * i] if tree[2 * i] <= tree[2 * i + 1] else tree[2 * i + 1]
                if tree[i] == low:
                    break
                tree[i] = low
                i >>= 1

        alive = [True] * n
        while tree[1] != none:
            i = 1
            while i < w:
                i = 2 * i if tree[2 * i] <= tree[2 * i + 1] else 2 * i + 1
            at = i - w
            sym[at] = int(self.merged[tree[i]])
            gone = after[at]
            alive[gone] = False
            behind = after[gone]
            after[at] = behind
            if behind < n:
                before[behind] = at
            put(gone, none)
            put(at, rank(sym[at], sym[behind]) if behind < n else none)
            if before[at] >= 0:
                put(before[at], rank(sym[before[at]], sym[at]))
        return [s for s, x in zip(sym, alive, strict=True) if x]


class Remembered:
    """Ids of pieces of text, for the pieces met lately, known by their bytes.

    Holds at most ``most`` pieces, ``most_ids`` ids and as many bytes of long pieces between
    calls and starts anew beyond.
    """

    def __init__(self, most: int = 600_000, most_ids: int = 4_000_000) -> None:
        self.most, self.most_ids = most, most_ids
        self._clear()

    def _clear(self) -> None:
        self.words = Words()
        self.starts, self.counts, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.have = self.used = 0

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        have, used = self.have, self.used
        for name, size in (("starts", have + len(counts)), ("counts", have + len(counts)), ("ids", used + len(ids))):
            old = getattr(self, name)
            if len(old) < size:
                new = np.zeros(2 * size, old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.starts[have : have + len(counts)] = used + np.cumsum(counts) - counts
        self.counts[have : have + len(counts)] = counts
        self.ids[used : used + len(ids)] = ids
        self.have, self.used = have + len(counts), used + len(ids)

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and how many each piece has.

        encode(positions) gives the same for the pieces at these positions.
        """
        if self.have > self.most or self.used > self.most_ids or self.words.long_bytes > self.most_ids:
            self._clear()
        at, new = self.words.number(data, starts, ends)
        if len(new):
            self._add(*encode(new))
        sizes = self.counts[at].astype(np.int64)
        return self.ids[ranges(self.starts[at], sizes)], sizes
