"""A compressed FM-index over words: packed wavelet matrix, rank by popcount, backward search in lockstep.

Words are numbered by frequency, so the matrix takes as many bits a word as the largest number has, some 15 to 20 where a
word and its space have 50 or more. The suffix array is only there while the index is made. What stays of it are two bit
vectors that mark where suffixes begin to differ in their first ``depth`` and ``depth - 1`` symbols, and for each class of
the first kind the value that the search is after.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class Bits:
    """A packed bit vector with the ones before each word of 64."""

    def __init__(self, bits: np.ndarray) -> None:
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, dtype=np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8").astype(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.before.nbytes

    def ones(self, at: np.ndarray) -> np.ndarray:
        """The ones before each place."""
        word = at >> 6
        mask = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)


class WaveletMatrix:
    """Rank of any symbol below ``sigma`` in a sequence, in one step for each bit of the symbol."""

    def __init__(self, values: np.ndarray, sigma: int) -> None:
        self.levels, self.zeros = [], []
        self.bits = max(1, int(sigma - 1).bit_length())
        for level in reversed(range(self.bits)):
            bit = ((values >> level) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(len(values) - int(bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in self.levels)

    def spans(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the symbol's occurrences in [lo, hi) lie at the lowest level."""
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            bit = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = level.ones(lo), level.ones(hi)
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return lo, hi


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by ``depth`` symbols at least, by doubling; only those that aren't alone yet are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    in_order = text[order]
    new = np.ones(n, dtype=bool)
    np.not_equal(in_order[1:], in_order[:-1], out=new[1:])
    rank, done = np.empty(n, dtype=np.int64), 1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # the place of the first of its class
    while done < depth:
        alone = new & np.append(new[1:], True)
        live = np.flatnonzero(~alone)
        if not len(live):
            break
        suffix = order[live]
        after = suffix + done
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        own = rank[suffix]
        by = np.lexsort((second, own))  # classes keep their places
        suffix, second, own = suffix[by], second[by], own[by]
        order[live] = suffix
        fresh = np.ones(len(live), dtype=bool)
        fresh[1:] = (own[1:] != own[:-1]) | (second[1:] != second[:-1])
        new[live] = fresh
        rank[suffix] = np.maximum.accumulate(np.where(fresh, live, 0))
        done *= 2
    return order


def first_differences(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix, in order, differs from the one before it in its first ``depth`` symbols; past the end all do."""
    n, a, b = len(text), order[:-1], order[1:]
    live, out = np.arange(n - 1), np.ones(n, dtype=bool)
    for step in range(depth):
        x, y = a[live] + step, b[live] + step
        inside = np.maximum(x, y) < n
        live, x, y = live[inside], x[inside], y[inside]
        live = live[text[x] == text[y]]
    out[live + 1] = False
    return out


class FMIndex:
    """The index of a sequence of symbols from 1 to sigma-1, with zeros between its texts, for patterns of ``depth`` symbols.

    ``value`` has a number for each place of the text; ``least`` gives the smallest of those at which a pattern stands.
    """

    def __init__(self, text: np.ndarray, sigma: int, depth: int, value: np.ndarray) -> None:
        self.depth = depth
        order = suffix_order(text, depth)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        self.tree = WaveletMatrix(text[order - 1], sigma)  # the last symbol, a zero, stands before the first
        whole, part = first_differences(text, order, depth), first_differences(text, order, depth - 1)
        self.whole, self.part = Bits(whole), Bits(part)
        self.heads = np.append(np.flatnonzero(part), len(text)).astype(np.int32)
        self.values = np.minimum.reduceat(value[order], np.flatnonzero(whole))
        # where each symbol's occurrences begin at the lowest level
        symbols = np.arange(sigma, dtype=np.int64)
        none = np.zeros(sigma, dtype=np.int64)
        self.shift = self.starts[:-1] - self.tree.spans(symbols, none, none)[0]

    @property
    def nbytes(self) -> int:
        return self.tree.nbytes + self.whole.nbytes + self.part.nbytes + sum(x.nbytes for x in (self.starts, self.shift, self.heads, self.values))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of the patterns with a symbol put before."""
        a, b = self.tree.spans(symbol, lo, hi)
        shift = self.shift[symbol]
        return a + shift, b + shift

    def searched(self, text: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns of ``size`` symbols at these places, empty where there is none."""
        symbol = text[at + size - 1]
        lo, hi = self.starts[symbol], self.starts[symbol + 1]
        for k in range(size - 2, -1, -1):
            lo, hi = self.extend(text[at + k], lo, np.maximum(lo, hi))
        return lo, hi

    def shortened(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of patterns of ``depth`` symbols without their last one."""
        k = self.part.ones(lo + 1) - 1
        return self.heads[k].astype(np.int64), self.heads[k + 1].astype(np.int64)

    def least(self, lo: np.ndarray) -> np.ndarray:
        return self.values[self.whole.ones(lo + 1) - 1]

    def matching(self, text: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of streamed texts, each searched from its end to its beginning, all in step.

        For each place of each text ``text[begins[i]:stops[i]]``, one after the other: the length of the longest match that
        begins there, up to ``depth`` symbols, and its interval. A match of full length gives up its last symbol before it is
        extended by the next one, so a place costs one step of the search and not ``depth`` of them. Where the index hasn't
        the extended match, shorter ones are searched for from their last symbol on.
        """
        size = stops - begins
        at = np.cumsum(size) - size
        lo, hi, length = (np.zeros(int(size.sum()), dtype=np.int64) for _ in range(3))
        by = np.argsort(-size, kind="stable")
        longest = size[by]
        live = len(by)
        a, z, m = (np.zeros(live, dtype=np.int64) for _ in range(3))
        for step in range(int(longest[0]) if live else 0):
            live = int(np.searchsorted(-longest, -step, side="left"))
            texts = by[:live]
            symbol = text[stops[texts] - 1 - step]
            a, z, m = a[:live], z[:live], m[:live]
            if (full := np.flatnonzero(m == self.depth)).size:
                a[full], z[full] = self.shortened(a[full])
                m[full] -= 1
            grown = np.flatnonzero(m > 0)
            x, y = self.starts[symbol], self.starts[symbol + 1]  # a match of one symbol
            n = (y > x).astype(np.int64)
            if grown.size:
                p, q = self.extend(symbol[grown], a[grown], z[grown])
                found = q > p
                lost, grown = grown[~found], grown[found]
                x[grown], y[grown], n[grown] = p[found], q[found], m[grown] + 1
                for shorter in range(int(m[lost].max(initial=0)), 1, -1):
                    part = lost[m[lost] >= shorter]
                    p, q = self.searched(text, stops[texts[part]] - 1 - step, shorter)
                    x[part[q > p]], y[part[q > p]], n[part[q > p]] = p[q > p], q[q > p], shorter
                    lost = lost[n[lost] < 2]
            a, z, m = x, y, n
            place = at[texts] + size[texts] - 1 - step
            lo[place], hi[place], length[place] = a, z, m
        return lo, hi, length
