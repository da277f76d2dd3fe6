"""A bidirectional FM-index over delimited words, searched by many patterns at once (numpy, inside tasks).

The text is every word followed by the delimiter, read as a circle. The index
holds the Burrows-Wheeler transform of the text and of its reverse, each with
counts of every symbol at every STEP-th rank. A pattern is the interval of the
ranks of the rotations that start with it, in both: extending it to the left
reads the transform of the text, to the right that of its reverse, and the
other interval moves by the symbols that are smaller.

The search scheme for one error takes a pattern in two parts. The first is
matched exactly, from its end to the left as far as the delimiter; then the
search turns and extends across the second part to the right, with one symbol
inserted, deleted or replaced, as far as the next delimiter. Matching the last
part exactly and the first with an error is the same search over reversed
words.
"""

from __future__ import annotations

import numpy as np

#: Ranks between stored counts; patterns that are searched together.
STEP, TOGETHER = 64, 4096


def rotations(text: np.ndarray) -> np.ndarray:
    """Starts of the rotations of a circular text in order, by prefix doubling; equal ones by their start."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.zeros(n, np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], text[order][1:] != text[order][:-1])))
    step = 1
    while step < n and rank.max(initial=0) < n - 1:
        key = rank * n + np.roll(rank, -step)
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
        step *= 2
    return order


class Occurrences:
    """How often each symbol occurs before a rank of the transform, and the first rank of the rotations that start with it."""

    def __init__(self, text: np.ndarray, order: np.ndarray, symbols: int):
        bwt = text[order - 1]
        n, self.symbols = len(bwt), symbols
        blocks = n // STEP + 1
        self.bwt = np.concatenate((bwt, np.full(blocks * STEP - n, symbols, bwt.dtype))).reshape(blocks, STEP)
        each = np.bincount(np.arange(n) // STEP * symbols + bwt, minlength=blocks * symbols).reshape(blocks, symbols)
        self.before = np.zeros((blocks, symbols), np.int32)
        np.cumsum(each[:-1], axis=0, out=self.before[1:])
        self.first = np.cumsum(np.bincount(bwt, minlength=symbols)) - np.bincount(bwt, minlength=symbols)

    def all(self, at: np.ndarray) -> np.ndarray:
        """Counts of all symbols before each rank."""
        block, rest = at // STEP, at % STEP
        seen = np.where(np.arange(STEP) < rest[:, None], self.bwt[block], self.symbols)
        width = self.symbols + 1
        inside = np.bincount((np.arange(len(at))[:, None] * width + seen).ravel(), minlength=len(at) * width)
        return self.before[block] + inside.reshape(len(at), width)[:, :-1]

    def one(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Count of one symbol before each rank."""
        block, rest = at // STEP, at % STEP
        return self.before[block, symbol] + ((self.bwt[block] == symbol[:, None]) & (np.arange(STEP) < rest[:, None])).sum(axis=1)


class BidirectionalIndex:
    """words: distinct, not empty, without the delimiter."""

    def __init__(self, words: list[str]):
        joined = np.frombuffer("".join(w + "\0" for w in words).encode("utf-32-le"), np.uint32)
        self.alphabet, text = np.unique(joined, return_inverse=True)
        text = text.astype(np.int64)  # the delimiter is symbol 0
        mirrored = text[::-1].copy()
        symbols = len(self.alphabet) + 1  # the last one stands for those that do not occur
        order = rotations(mirrored)
        self.ahead = Occurrences(mirrored, order, symbols)
        self.back = Occurrences(text, rotations(text), symbols)
        self.total = len(text)
        # a match delimited on both sides starts, in the mirrored text, at the delimiter after its word
        owner = np.cumsum(text == 0) - (text == 0)
        self.owner = owner[::-1][order]

    def left(self, lo: np.ndarray, mirror: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both intervals of the patterns with a symbol put before them."""
        start, end = self.back.all(lo), self.back.all(lo + size)
        own = np.arange(len(lo))
        smaller = np.cumsum(end - start, axis=1)
        found = end[own, symbol] - start[own, symbol]
        return self.back.first[symbol] + start[own, symbol], mirror + smaller[own, symbol] - found, found

    def right(self, mirror: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mirrored interval of the patterns with a symbol put after them."""
        start = self.ahead.one(mirror, symbol)
        return self.ahead.first[symbol] + start, self.ahead.one(mirror + size, symbol) - start

    def right_all(self, mirror: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for every symbol: patterns x symbols."""
        start = self.ahead.all(mirror)
        return self.ahead.first + start, self.ahead.all(mirror + size) - start

    def one_error(self, patterns: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word) for every indexed word that starts with a pattern's first `exact` symbols and differs from it by one edit after them.

        A pattern itself may be indexed or not; each pair is found once.
        """
        found = [self._search(patterns[i : i + TOGETHER], exact[i : i + TOGETHER]) for i in range(0, len(patterns), TOGETHER)]
        base = np.arange(0, len(patterns), TOGETHER)
        return np.concatenate([np.zeros(0, np.int64), *[q + b for (q, _), b in zip(found, base, strict=True)]]), np.concatenate([np.zeros(0, np.int64), *[w for _, w in found]])

    def _search(self, patterns: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in patterns])
        # the delimiter ends each pattern, as symbol 0
        codes = np.frombuffer("".join(p + "\0" for p in patterns).encode("utf-32-le"), np.uint32)
        flat = np.searchsorted(self.alphabet, codes)
        flat[self.alphabet[np.minimum(flat, len(self.alphabet) - 1)] != codes] = len(self.alphabet)
        begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        lo, mirror, size = (np.full(len(patterns), x, np.int64) for x in (0, 0, self.total))
        for t in range(int(exact.max(initial=0)) + 1):
            on = np.flatnonzero(exact >= t)
            symbol = np.where(exact[on] > t, flat[begin[on] + exact[on] - 1 - t], 0)
            lo[on], mirror[on], size[on] = self.left(lo[on], mirror[on], size[on], symbol)
        none = np.zeros(0, np.int64)
        right, wrong = (np.arange(len(patterns)), exact.astype(np.int64), mirror, size), (none, none, none, none)
        out_q, out_w = [none], [none]
        while len(right[0]) or len(wrong[0]):
            q, at, mirror, size = right
            symbol, over = flat[begin[q] + at], at == sizes[q]
            moved, held = self.right_all(mirror, size)
            row, other = np.nonzero(held)
            row, other = row[(other > 0) & (other != symbol[row])], other[(other > 0) & (other != symbol[row])]
            where = moved[row, other], held[row, other]
            replaced = ~over[row]
            # of equal neighbours only the last counts as deleted
            gone = ~over & (flat[np.minimum(begin[q] + at + 1, len(flat) - 1)] != symbol)
            fresh = [
                (q[row], at[row], *where),
                (q[row][replaced], at[row][replaced] + 1, where[0][replaced], where[1][replaced]),
                (q[gone], at[gone] + 1, mirror[gone], size[gone]),
            ]
            own = np.arange(len(q))
            more = ~over & (held[own, symbol] > 0)
            right = q[more], at[more] + 1, moved[own, symbol][more], held[own, symbol][more]
            q, at, mirror, size = (np.concatenate(x) for x in zip(wrong, *fresh, strict=True))
            symbol = flat[begin[q] + at]
            mirror, size = self.right(mirror, size, symbol)
            done = (size > 0) & (at == sizes[q])
            out_q.append(q[done])
            out_w.append(self.owner[mirror[done]])
            more = (size > 0) & (at < sizes[q])
            wrong = q[more], at[more] + 1, mirror[more], size[more]
        return np.concatenate(out_q), np.concatenate(out_w)
