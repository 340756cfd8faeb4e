"""External suffix sorting with longest common prefixes, by recursive induced sorting over disk-backed priority queues.

A suffix is of type S if it is smaller than the one after it, else of type L; an S suffix after an L one is a *star*.

1. Star substrings (from a star to the next) are sorted by as many symbols as fit a number at a time, and named.
2. If names repeat, the text of names is sorted by recursion, down to a few thousand names.
3. From the sorted stars, L suffixes are induced in ascending order and S suffixes in descending order. A priority queue
   carries (symbol, order, position); each suffix that leaves it sends the suffix one symbol longer back in. Common
   prefixes travel along: two neighbours with one first symbol share one symbol more than what their sources share, the
   minimum over the sources' stretch, which is looked up in a table of minima over powers of two.

The queue is cut by first symbols into ranges of a bounded number of tuples, or of one symbol. What exceeds the bound in all is
written to the task's own disk, range by range, and a range is read a block at a time when its turn comes. Arrays with an
entry for each suffix are memory-mapped files once they exceed the bound, and are filled and read in blocks. The files go
with the store.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples and symbols held in memory; beyond this they go to disk.
IN_MEMORY = 8_000_000
#: Names that are sorted without further recursion, entries of a block, tuples of a queue's range of several symbols, and
#: entries of a range of one symbol that leave at once, at most.
FEW, BLOCK, RANGE, RUN = 4_000, 1 << 18, 1 << 13, 1 << 16


class Store:
    """Arrays in memory, or in files of a folder that is removed with the store. It counts what queues wrote to disk and how
    deep the recursion went."""

    def __init__(self, limit: int = IN_MEMORY) -> None:
        self.limit, self.folder, self.count, self.spilled, self.depth = limit, None, 0, 0, 0
        self.mapped: dict[int, str] = {}

    def file(self) -> str:
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="suffixes-")
        self.count += 1
        return os.path.join(self.folder, str(self.count))

    def array(self, n: int, dtype: type = np.int64) -> np.ndarray:
        if n <= self.limit:
            return np.zeros(n, dtype=dtype)
        path = self.file()
        self.mapped[id(out := np.asarray(np.memmap(path, dtype=dtype, mode="w+", shape=(n,))))] = path
        return out

    def drop(self, *arrays: np.ndarray | Minima) -> None:
        """Remove the files of arrays that aren't needed any more."""
        for x in arrays:
            for y in (x.values, x.left, x.right, *x.levels) if isinstance(x, Minima) else (x,):
                if (path := self.mapped.pop(id(y), None)) is not None:
                    os.remove(path)

    def close(self) -> None:
        if self.folder is not None:
            shutil.rmtree(self.folder, ignore_errors=True)
            self.folder = None

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()


def blocks(n: int, size: int = BLOCK) -> Iterator[slice]:
    return (slice(at, min(n, at + size)) for at in range(0, n, size))


class Queue:
    """A priority queue of tuples (symbol, order, position), where order only grows, as suffixes leave in order.

    Symbols are dealt to ranges by how often they stand in the text. What is put comes in order, so the tuples of one symbol
    are sorted as they lie. When more are held than the store's limit, each range's are appended to a file of its own.
    """

    def __init__(self, store: Store, counts: np.ndarray) -> None:
        self.store, self.held = store, 0
        upto = np.cumsum(counts)
        most = max(1, min(store.limit // 8, RANGE))
        heavy = counts > most
        named = upto // most * 2 + heavy  # a heavy symbol is a range of its own
        edge = np.ones(len(counts), dtype=bool)
        edge[1:] = (named[1:] != named[:-1]) | heavy[1:] | heavy[:-1]
        self.range_of = (np.cumsum(edge) - 1).astype(np.int32)
        n = int(edge.sum())
        self.parts: list[list[np.ndarray]] = [[] for _ in range(n)]
        self.files: list[str | None] = [None] * n
        self.written = [0] * n

    def put(self, symbol: np.ndarray, order: np.ndarray, position: np.ndarray) -> None:
        if not len(symbol):
            return
        part = self.range_of[symbol]
        rows = np.stack([symbol, order, position], axis=1).astype(np.int32)
        if (part == part[0]).all():
            self.parts[part[0]].append(rows)
        else:
            by = np.argsort(part.astype(np.int16) if len(self.parts) < 1 << 15 else part, kind="stable")
            part, rows = part[by], rows[by]
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                self.parts[part[a]].append(rows[a:z])
        self.held += len(symbol)
        if self.held > self.store.limit:
            self._spill()

    def _spill(self) -> None:
        for k, rows in enumerate(self.parts):
            if rows:
                self.files[k] = self.files[k] or self.store.file()
                with open(self.files[k], "ab") as f:
                    for x in rows:
                        f.write(np.ascontiguousarray(x).tobytes())
                        self.written[k] += len(x)
                        self.store.spilled += len(x)
                self.parts[k] = []
        self.held = 0

    def take(self, k: int) -> Iterator[np.ndarray]:
        """All tuples of a range, in the order in which they were put, a block at a time."""
        path, n = self.files[k], self.written[k]
        self.files[k], self.written[k] = None, 0
        rows, self.parts[k] = self.parts[k], []
        if path is not None:
            for s in blocks(n):
                yield np.fromfile(path, dtype=np.int32, count=3 * (s.stop - s.start), offset=12 * s.start).reshape(-1, 3)
            os.remove(path)
        while rows:
            held, at = [], 0
            while rows and at < BLOCK:
                held.append(rows.pop(0))
                at += len(held[-1])
            self.held -= at
            yield held[0] if len(held) == 1 else np.concatenate(held)

    def empty(self, k: int) -> bool:
        return not self.parts[k] and not self.written[k]


class Minima:
    """An array that is written from left to right and asked for minima over stretches of what is written.

    In blocks of ``SIDE`` entries there are minima from each entry to the block's ends, and over blocks, for each power of two,
    minima of that many blocks up to each.
    """

    SIDE = 64

    def __init__(self, store: Store, n: int) -> None:
        whole = -(-n // self.SIDE) * self.SIDE
        self.values, self.left, self.right = (store.array(whole, np.int32) for _ in range(3))
        self.levels = [store.array(whole // self.SIDE, np.int32)]
        while 1 << len(self.levels) <= whole // self.SIDE:
            self.levels.append(store.array(whole // self.SIDE, np.int32))

    def write(self, a: int, values: np.ndarray) -> None:
        z = a + len(values)
        self.values[a:z] = values
        k, m = a // self.SIDE, -(-z // self.SIDE)
        table = np.full((m - k) * self.SIDE, np.iinfo(np.int32).max, dtype=np.int32)
        table[: z - k * self.SIDE] = self.values[k * self.SIDE : z]
        table = table.reshape(-1, self.SIDE)
        left = np.minimum.accumulate(table, axis=1)
        self.left[k * self.SIDE : m * self.SIDE] = left.ravel()
        self.right[k * self.SIDE : m * self.SIDE] = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels[0][k:m] = left[:, -1]
        for n, (below, level) in enumerate(zip(self.levels[:-1], self.levels[1:], strict=True)):
            start = max(k, 1 << n)
            level[k:start] = below[k:start]
            if start < m:
                level[start:m] = np.minimum(below[start:m], below[start - (1 << n) : m - (1 << n)])

    def over(self, after: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least of the entries after ``after`` up to ``last``."""
        begin = after + 1
        k, m = begin // self.SIDE, last // self.SIDE
        out = np.minimum(self.right[begin], self.left[last]).astype(np.int64)
        near = np.flatnonzero(k == m)
        if near.size:
            size = (last - begin + 1)[near]
            upto = np.cumsum(size)
            flat = np.asarray(self.values[np.repeat(begin[near] - upto + size, size) + np.arange(upto[-1])])
            out[near] = np.minimum.reduceat(flat, upto - size)
        between = m - k - 1
        which = np.frexp(between.astype(np.float64))[1] - 1  # floor of the logarithm
        for n in np.unique(which[between > 0]).tolist():
            some = np.flatnonzero((which == n) & (between > 0))
            level = self.levels[n]
            out[some] = np.minimum(out[some], np.minimum(level[m[some] - 1], level[k[some] + (1 << n)]))
        return out


def types(text: np.ndarray, store: Store) -> np.ndarray:
    """Whether each suffix is of type S; the last, a unique smallest symbol, is."""
    n = len(text)
    out = store.array(n, np.bool_)
    out[n - 1] = True
    after, kind = int(text[n - 1]), True  # the symbol after a block, and its type
    for s in reversed(list(blocks(n - 1))):
        x = np.append(np.asarray(text[s]).astype(np.int64), after)
        up, same = x[:-1] < x[1:], x[:-1] == x[1:]
        # in a run of equal symbols all are of the type of what follows it
        place = np.where(same, len(up), np.arange(len(up)))
        decides = np.minimum.accumulate(place[::-1])[::-1]
        out[s] = np.where(decides < len(up), up[np.minimum(decides, len(up) - 1)], kind)
        after, kind = int(x[0]), bool(out[s.start])
    return out


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a[i] and b[i], by comparing them."""
    n, out, live = len(text), np.zeros(len(a), dtype=np.int64), np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        live = live[text[x] == text[y]]
        out[live] += 1
    return out


class _Induction:
    """One sweep: L suffixes with the stars between them, ascending, or S suffixes with the L suffixes before them, descending.

    ``given`` are suffixes that are there from the start, in the sweep's order, with what each shares with the one before it.
    In descending sweeps symbols are counted from the top, so that both sweeps run upwards.
    """

    def __init__(self, text: np.ndarray, small: np.ndarray, counts: np.ndarray, store: Store, up: bool, total: int) -> None:
        self.text, self.small, self.store, self.up, self.top = text, small, store, up, len(counts) - 1
        self.order, self.minima = store.array(total, np.int32), Minima(store, total)
        self.queue, self.at = Queue(store, counts if up else counts[::-1]), 0

    def symbols(self, p: np.ndarray) -> np.ndarray:
        s = np.asarray(self.text[p]).astype(np.int64)
        return s if self.up else self.top - s

    def sent(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these suffixes send the one before them into the queue, and its symbol."""
        before = np.flatnonzero(p > 0)
        own = p[before] - 1
        # ascending sweeps send L suffixes, descending ones S suffixes
        before = before[np.asarray(self.small[own]) != self.up]
        return before, self.symbols(p[before] - 1)

    def leave(self, p: np.ndarray, lcp: np.ndarray) -> int:
        """Write suffixes at the end of the order; returns where."""
        a, z = self.at, self.at + len(p)
        self.order[a:z] = p
        self.minima.write(a, lcp)
        self.at = z
        return a

    def induced(self, rows: np.ndarray, last: tuple[int, int]) -> np.ndarray:
        """What tuples, ordered by symbol, share with the one before them; ``last`` is symbol and order of the one before all."""
        symbol = np.concatenate([[last[0]], rows[:, 0]])
        order = np.concatenate([[last[1]], rows[:, 1]])
        out = np.zeros(len(rows), dtype=np.int64)
        same = np.flatnonzero(symbol[1:] == symbol[:-1])
        if same.size:
            out[same] = self.minima.over(order[same], order[same + 1]) + 1
        return out

    def run(self, given: np.ndarray, given_lcp: np.ndarray) -> None:
        """``given`` with equal symbols go after the induced ones with that symbol."""
        at = 0
        for k in range(len(self.queue.parts)):
            lo, hi = (int(x) for x in np.searchsorted(self.queue.range_of, [k, k + 1]))
            end = at
            while end < len(given):  # given suffixes of this range
                s = self.symbols(np.asarray(given[end : end + BLOCK]))
                n = int(np.searchsorted(s, hi))
                end += n
                if n < len(s):
                    break
            if hi - lo == 1:
                self._heavy(k, lo, given, given_lcp, at, end)
            else:
                self._light(k, hi, given, given_lcp, at, end)
            at = end

    def _push(self, p: np.ndarray, a: int, which: np.ndarray, symbol: np.ndarray) -> None:
        self.queue.put(symbol, a + which, p[which] - 1)

    def _meeting(self, p: int, q: int) -> int:
        return int(common(self.text, np.array([p]), np.array([q]))[0])

    def _heavy(self, k: int, symbol: int, given: np.ndarray, given_lcp: np.ndarray, at: int, end: int) -> None:
        """A range of one symbol: its tuples leave as they lie, until it sends itself no more."""
        last, tail = (-1, -1), -1
        while not self.queue.empty(k):
            for rows in self.queue.take(k):
                for s in blocks(len(rows), RUN):
                    part = rows[s].astype(np.int64)
                    a = self.leave(part[:, 2], self.induced(part, last))
                    last, tail = (symbol, int(part[-1, 1])), int(part[-1, 2])
                    self._push(part[:, 2], a, *self.sent(part[:, 2]))
        for s in blocks(end - at, RUN):
            p, shared = np.asarray(given[at + s.start : at + s.stop]).astype(np.int64), np.array(given_lcp[at + s.start : at + s.stop])
            if not s.start:
                shared[0] = self._meeting(tail, int(p[0])) if tail >= 0 else 0
            a = self.leave(p, shared)
            self._push(p, a, *self.sent(p))

    def _light(self, k: int, hi: int, given: np.ndarray, given_lcp: np.ndarray, at: int, end: int) -> None:
        """A range of several symbols, few enough tuples to be held.

        First all tuples that the range will get are gathered, with those that its own suffixes send. Then they are ordered:
        by symbol, tuples before given suffixes, tuples from outside before those from inside, and these by the place of
        their source, which is sought until it stays: a chain of sources within the range adds one round for each.
        """
        rows = [*self.queue.take(k)] if not self.queue.empty(k) else []
        rows = np.concatenate(rows).astype(np.int64) if rows else np.zeros((0, 3), dtype=np.int64)
        own, n = np.asarray(given[at:end]).astype(np.int64), len(rows)
        symbol, p = np.concatenate([rows[:, 0], self.symbols(own)]), np.concatenate([rows[:, 2], own])
        if not len(p):
            return
        kind = np.repeat([0, 2], [n, len(own)])
        source = np.concatenate([rows[:, 1], np.arange(len(own))])
        out_of, out_symbol, fresh, begin = [], [], p, 0
        while len(fresh):
            which, sent = self.sent(fresh)
            inside = sent < hi
            out_of.append(begin + which[~inside])
            out_symbol.append(sent[~inside])
            source = np.concatenate([source, begin + which[inside]])
            begin, fresh = len(p), fresh[which[inside]] - 1
            symbol, p, kind = np.concatenate([symbol, sent[inside]]), np.concatenate([p, fresh]), np.concatenate([kind, np.ones(len(fresh), dtype=np.int64)])
        inner, rank = np.flatnonzero(kind == 1), np.zeros(len(p), dtype=np.int64)
        class_, key = (3 * symbol + kind) << 31, source.copy()
        while True:
            by = np.argsort(class_ + key)
            rank[by] = np.arange(len(p))
            now = rank[source[inner]]
            if (now == key[inner]).all():
                break
            key[inner] = now
        symbol, p, kind, source = symbol[by], p[by], kind[by], source[by]
        same = np.zeros(len(p), dtype=bool)
        same[1:] = symbol[1:] == symbol[:-1]
        shared = np.zeros(len(p), dtype=np.int64)
        alike = same.copy()
        alike[1:] &= kind[1:] == kind[:-1]
        outer = np.flatnonzero(alike & (kind == 0))
        shared[outer] = self.minima.over(source[outer - 1], source[outer]) + 1
        mine = np.flatnonzero(alike & (kind == 2))
        shared[mine] = np.asarray(given_lcp[at:end])[source[mine]]
        met = np.flatnonzero(same & ~alike | alike & (kind == 1))
        shared[met] = common(self.text, p[met - 1], p[met])
        a = self.leave(p, shared)
        place, sent = rank[np.concatenate(out_of)], np.concatenate(out_symbol)
        order = np.argsort(place)
        place, sent = place[order], sent[order]
        self.queue.put(sent, a + place, p[place] - 1)


def _induced(text: np.ndarray, small: np.ndarray, counts: np.ndarray, stars: np.ndarray, star_lcp: np.ndarray, larges: int, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order from sorted stars, with common prefixes."""
    n = len(text)
    rise = _Induction(text, small, counts, store, True, larges + len(stars))
    rise.run(stars, star_lcp)
    # the L suffixes alone, backwards: what one shares with the next is what the next shares with it
    large, large_lcp, at = store.array(larges, np.int32), store.array(larges, np.int32), larges
    for s in blocks(rise.at):
        p, m = np.asarray(rise.order[s]), np.asarray(rise.minima.values[s])
        least = np.asarray(small[p])
        where = np.flatnonzero(~least)
        if not len(where):
            continue
        # no star stands between two L suffixes with one symbol, so what they share is what the second shares with the one before it
        own, shared = p[where], m[where]
        k = len(where)
        large[at - k : at] = own[::-1]
        large_lcp[at - k + 1 : at] = shared[1:][::-1]
        if at < larges:
            large_lcp[at] = shared[0]
        at -= k
    store.drop(rise.order, rise.minima)
    fall = _Induction(text, small, counts, store, False, n)
    fall.run(_Last(large, n - 1), _Last(large_lcp, 0))
    store.drop(large, large_lcp)
    order, lcp = store.array(n, np.int32), store.array(n, np.int32)
    for s in blocks(n):
        back = slice(n - s.stop, n - s.start)
        order[s] = np.asarray(fall.order[back])[::-1]
        # what a suffix shares with the one that left before it is what that one shares with it
        own = np.asarray(fall.minima.values[n - s.stop + 1 : min(n, n - s.start + 1)])
        lcp[s.start : s.start + len(own)] = 0
        lcp[s.stop - len(own) : s.stop] = own[::-1]
    store.drop(fall.order, fall.minima)
    return order, lcp


class _Last:
    """An array with one value more."""

    def __init__(self, values: np.ndarray, last: int) -> None:
        self.values, self.last = values, last

    def __len__(self) -> int:
        return len(self.values) + 1

    def __getitem__(self, s: slice) -> np.ndarray:
        a, z, _ = s.indices(len(self))
        own = np.asarray(self.values[a : min(z, len(self.values))])
        return np.append(own, self.last) if z == len(self) and z > a else own


def _named(text: np.ndarray, stars: np.ndarray, top: int, store: Store) -> tuple[np.ndarray, int]:
    """A name for each star substring, in their order: equal ones have one name. They are compared by as many symbols at a
    time as fit a number; past a substring's end stands a symbol larger than all others."""
    n, bits = len(stars), int(top + 1).bit_length()
    per = max(1, 63 // bits)
    length = np.diff(np.append(stars, len(text) - 1)) + 1  # up to and with the next star's first symbol
    by, rank, done = np.arange(n), np.zeros(n, dtype=np.int64), 0
    live = by
    while True:
        key = np.zeros(len(live), dtype=np.int64)
        for j in range(per):
            inside = length[live] > done + j
            key = (key << bits) + np.where(inside, text[np.minimum(stars[live] + done + j, len(text) - 1)], top + 1)
        # ranks are places of the first of each class, so classes stay where they are
        order = np.lexsort((key, rank[live]))
        live, key = live[order], key[order]
        own = rank[live]
        new = np.ones(len(live), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
        head = np.ones(len(live), dtype=bool)
        head[1:] = own[1:] != own[:-1]
        start = np.maximum.accumulate(np.where(head, np.arange(len(live)), 0))
        rank[live] = own + np.maximum.accumulate(np.where(new, np.arange(len(live)), 0)) - start
        done += per
        # one that ends here goes another round, which puts it behind longer ones that begin like it
        again = ~(new & np.append(new[1:], True)) & (length[live] >= done)
        live = live[again]
        if not len(live):
            break
        live = live[np.argsort(rank[live], kind="stable")]
    present = np.zeros(n, dtype=bool)
    present[rank] = True
    return (np.cumsum(present) - 1)[rank], int(present.sum())


def _few(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and common prefixes of a short text, by doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    done = 1
    while rank.max() < n - 1:
        second = np.zeros(n, dtype=np.int64)
        second[: max(0, n - done)] = rank[done:] + 1
        rank = np.unique(rank * (n + 1) + second, return_inverse=True)[1].astype(np.int64)
        done *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    return order, np.concatenate([[0], common(text, order[:-1], order[1:])])


def suffix_array(text: np.ndarray, store: Store, few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in order, and the length that each shares with the one before it.

    Symbols are numbers from 0; the last is smaller than all others and stands nowhere else. Names repeat a text a third as
    long at most, which goes the same way; of ``few`` names the recursion makes no more names.
    """
    n = len(text)
    assert n < 1 << 31
    if n < 3:
        return np.argsort(text, kind="stable"), np.zeros(n, dtype=np.int64)
    small = types(text, store)
    counts, found, larges = np.zeros(0, dtype=np.int64), [], 0
    for s in blocks(n):
        own = np.bincount(text[s], minlength=len(counts))
        own[: len(counts)] += counts
        counts = own
        kind = np.asarray(small[max(0, s.start - 1) : s.stop])
        larges += int((~np.asarray(small[s])).sum())
        found.append(np.flatnonzero(kind[1:] & ~kind[:-1]) + max(1, s.start))
    stars = store.array(sum(map(len, found)), np.int32)
    at = 0
    for x in found:
        stars[at : at + len(x)] = x
        at += len(x)
    del found
    if not len(stars):
        ordered, star_lcp = stars, stars
    else:
        names, distinct = _named(text, stars, len(counts) - 1, store)
        if distinct == len(stars):
            order = np.empty(len(stars), dtype=np.int64)
            order[names] = np.arange(len(stars))
            lcp = np.zeros(len(stars), dtype=np.int64)
        elif len(stars) <= few:
            order, lcp = _few(names)
        else:
            store.depth += 1
            order, lcp = suffix_array(names, store, few)
        ordered, star_lcp = store.array(len(stars), np.int32), store.array(len(stars), np.int32)
        for s in blocks(len(stars)):
            a, b = (np.asarray(order[t]).astype(np.int64) for t in (slice(max(0, s.start - 1), s.stop - 1), slice(max(1, s.start), s.stop)))
            ordered[s] = stars[np.asarray(order[s])]
            # equal names share their stars' whole distance, and what differs is compared
            to = np.minimum(b + lcp[max(1, s.start) : s.stop], len(stars))
            gone = np.where(to < len(stars), stars[np.minimum(to, len(stars) - 1)], n - 1).astype(np.int64) - stars[b]
            rest = common(text, np.minimum(stars[a] + gone, n), np.minimum(stars[b] + gone, n))
            star_lcp[max(1, s.start) : s.stop] = gone + rest
    return _induced(text, small, counts, ordered, star_lcp, larges, store)
