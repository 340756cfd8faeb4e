"""Benchmark decontamination by the q-gram lemma and banded alignment.

A region of a text within k edits of a pattern of m bytes has at least m - q + 1 - qk of the pattern's q-grams, all on
diagonals that lie within k of each other. Shared q-grams are counted in overlapping bands of diagonals, so one band holds
all of a region's; bands that reach the bound are verified by an alignment that stays within the band. Bands of one
pattern that touch are aligned as one, all of its width at a time in the bits of two numbers, so a text that repeats
itself costs one alignment and not one for each of its bands.

Places of one q-gram that follow each other at one distance (rulers, repeated words) are one run. Two runs of one distance
share q-grams on diagonals at that distance, more towards the middle, so their shares of all bands follow from a sum in
closed form; the product of their lengths is never made.

The patterns are a stated query set. They go to every task in blocks of a bounded size, and each block is one pass over
the texts, so a benchmark of any size is searched for whole; the driver holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, documents, long_rows, saved, schema_of, texts

#: Bytes of a q-gram, edits for each byte of a pattern, and bytes of patterns that a task holds at a time.
GRAM, ERRORS, BLOCK = 10, 0.08, 8 << 20
_C = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22
#: The largest distance within a run, pairs of runs and bands that are counted at a time, and bytes of a text.
DISTANCE, PAIRS, PART = 64, 1 << 20, 1 << 20


def normal(data: bytes) -> bytes:
    """A-Z in lower case, runs of ASCII white space as one space, none at the ends."""
    return b" ".join(data.lower().split())


def gram_hashes(data: np.ndarray, q: int = GRAM) -> np.ndarray:
    """A number for each q-gram, 8 to 16 bytes long."""
    n = max(0, len(data) - q + 1)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    x = data.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    h = x[:n] * _C
    h ^= h >> np.uint64(32)
    h += x[q - 8 : q - 8 + n]
    h *= _C
    h ^= h >> np.uint64(29)
    h *= _C
    return h


def edits_within(pattern: bytes, errors: float = ERRORS, q: int = GRAM) -> int:
    """The edit budget: a share of the pattern's bytes, or less where the lemma would ask for no q-gram at all."""
    return max(0, min(int(errors * len(pattern)), (len(pattern) - q) // q))


def _marks(window: np.ndarray, symbols: bytes) -> dict[int, int]:
    """For each of these symbols, a number whose bits say where the window has it."""
    return {c: int.from_bytes(np.packbits(window == c, bitorder="little").tobytes(), "little") for c in set(symbols)}


def _costs(base: int, up: int, down: int, width: int) -> np.ndarray:
    """Edits at each place of a window, from those at its first place and the bits where they rise or fall by one."""
    bits = lambda x: np.unpackbits(np.frombuffer(x.to_bytes(width // 8 + 1, "little"), dtype=np.uint8), count=width, bitorder="little").astype(np.int32)
    return base + np.concatenate([np.zeros(1, np.int32), np.cumsum(bits(up) - bits(down), dtype=np.int32)])


def banded(pattern: bytes, text: np.ndarray, low: int, high: int, most: int, anywhere: bool = True) -> tuple[int, np.ndarray] | None:
    """Edits between the pattern and what stops at each place of the text, within diagonals low to high (text place less
    pattern place): the first place and the edits from there on, or none where all are above ``most``.

    What is compared begins anywhere in the text, or at its beginning. A row of the alignment is two numbers of as many
    bits as the band is wide, which say where edits rise and fall by one; the window moves on by steps no longer than
    the band. Cells outside the band may be used but never give less than a true alignment costs.
    """
    step = max(256, high - low + 1)
    at = min(max(0, low), len(text))
    end = min(max(at, high + min(step, len(pattern))), len(text))
    base, up, down = 0 if anywhere else at, 0 if anywhere else (1 << (end - at)) - 1, 0
    for row in range(0, len(pattern), step):
        rows = pattern[row : row + step]
        if row:
            if _costs(base, up, down, end - at).min() > most:  # the least of a row never falls
                return None
            to = min(max(at, low + row), len(text))
            gone = (1 << (to - at)) - 1
            base += (up & gone).bit_count() - (down & gone).bit_count()
            up, down, at = up >> (to - at), down >> (to - at), to
            to = min(max(end, high + row + len(rows)), len(text))
            up, end = up | ((1 << (to - end)) - 1) << (end - at), to
        marks, full = _marks(text[at:end], rows), (1 << (end - at)) - 1
        for c in rows:
            same = marks[c]
            level = ((((same & up) + up) ^ up) | same | down) & full  # diagonal steps that cost nothing
            right, left = (down | (full ^ (level | up))) << 1 | 1, (level & up) << 1
            up, down = (left | ~(level | right)) & full, right & level
            base += 1
    costs = _costs(base, up, down, end - at)
    return (at, costs) if costs.min() <= most else None


def align(pattern: bytes, text: bytes, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """The best alignment of a pattern with a part of the text on diagonals low to high: edits, start and stop; none above
    ``most`` edits. Of equal ones the leftmost stop, then the latest start."""
    found = banded(pattern, np.frombuffer(text, dtype=np.uint8), low, high, most)
    if found is None:
        return None
    k = int(found[1].argmin())
    edits, stop = int(found[1][k]), found[0] + k
    behind = np.frombuffer(text[max(0, stop - len(pattern) - edits) : stop][::-1], dtype=np.uint8)
    at, costs = banded(pattern[::-1], behind, -edits, edits, edits, anywhere=False)
    return edits, stop - at - int(costs.argmin()), stop


def runs(hashes: np.ndarray, group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by hash, group and place as runs of places at one distance: first row, distance and number of rows.

    Each row is in one run. Single rows have distance 1.
    """
    n = len(place)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    gap = np.zeros(n, dtype=np.int64)
    gap[1:] = np.where((hashes[1:] == hashes[:-1]) & (group[1:] == group[:-1]), place[1:] - place[:-1], 0)
    gap[gap > DISTANCE] = 0
    new = gap == 0
    second = np.zeros(n, dtype=bool)
    second[1:] = new[:-1]
    new[1:] |= (gap[1:] != gap[:-1]) & ~second[1:]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    step = np.where(size > 1, gap[np.minimum(first + 1, n - 1)], 1)
    return first, step, size


def _shared_upto(k: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the a*b pairs of two runs lie on the first k diagonals: they grow by one a diagonal, stay, and fall."""
    few, many = np.minimum(a, b), np.maximum(a, b)
    k = np.clip(k, 0, a + b - 1)
    left = a + b - 1 - k
    return np.where(k <= few, k * (k + 1) // 2, np.where(k <= many, few * (few + 1) // 2 + (k - few) * few, a * b - left * (left + 1) // 2))


@dataclass
class Patterns:
    ids: list[int]
    data: list[bytes]
    errors: float = ERRORS

    def __post_init__(self) -> None:
        self.budget = np.array([edits_within(p, self.errors) for p in self.data], dtype=np.int64)
        self.size = np.array([len(p) for p in self.data], dtype=np.int64)
        self.need = np.maximum(1, self.size - GRAM + 1 - GRAM * self.budget)
        self.band = np.maximum(16, self.budget + 1)
        grams = [gram_hashes(np.frombuffer(p, dtype=np.uint8)) for p in self.data]
        hashes = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])
        order = np.lexsort((place, item, hashes))
        hashes, item, place = hashes[order], item[order], place[order].astype(np.int64)
        first, self.step, self.length = runs(hashes, item, place)
        self.hashes, self.item, self.place = hashes[first], item[first], place[first]
        self.distinct, self.first = np.unique(self.hashes, return_index=True)
        self.many = np.diff(np.append(self.first, len(self.hashes)))
        self.maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.maybe[self.distinct >> np.uint64(64 - _FILTER_BITS)] = True
        self.short = [(i, p) for i, p in enumerate(self.data) if p and len(p) < GRAM]

    def shared(self, text: np.ndarray, at: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Shared q-grams of a part of a text that begins at ``at``: pattern, number of a strip of diagonals as wide as the
        pattern's ``band``, and how many lie there; a bounded number of rows at a time."""
        h = gram_hashes(text)
        here = np.flatnonzero(self.maybe[h >> np.uint64(64 - _FILTER_BITS)])
        if not len(here) or not len(self.distinct):
            return
        k = np.minimum(np.searchsorted(self.distinct, h[here]), len(self.distinct) - 1)
        good = self.distinct[k] == h[here]
        here, k = here[good], k[good]
        order = np.argsort(k, kind="stable")
        here, k = here[order], k[order]
        first, step, length = runs(k, np.zeros(len(k), np.int64), here)
        here, k = here[first] + at, k[first]
        upto, begin = np.cumsum(self.many[k]), 0
        while begin < len(k):
            end = max(begin + 1, int(np.searchsorted(upto, PAIRS + (upto[begin - 1] if begin else 0), side="right")))
            times = self.many[k[begin:end]]
            of = np.repeat(np.arange(begin, end), times)
            entry = np.repeat(self.first[k[begin:end]], times) + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            begin = end
            item, t, p, a, b = self.item[entry], here[of], self.place[entry], length[of], self.length[entry]
            single = (a == 1) & (b == 1)
            if single.any():
                yield item[single], (t - p)[single] // self.band[item[single]], np.ones(int(single.sum()), np.int64)
            if not single.all():
                item, t, p, a, b, s, z = (x[~single] for x in (item, t, p, a, b, step[of], self.step[entry]))
                odd = (a > 1) & (b > 1) & (s != z)
                if odd.any():  # two distances: the shorter run counts row by row
                    text_side = odd & (a <= b)
                    t, p, a, b, s, z, item = self._apart(text_side, odd & ~text_side, t, p, a, b, s, z, item)
                yield from self._banded(item, t, p, a, b, np.where(a > 1, s, z))

    @staticmethod
    def _apart(text_side: np.ndarray, item_side: np.ndarray, t: np.ndarray, p: np.ndarray, a: np.ndarray, b: np.ndarray, s: np.ndarray, z: np.ndarray, item: np.ndarray) -> list[np.ndarray]:
        """Runs of these sides as single rows."""
        many = np.where(text_side, a, np.where(item_side, b, 1))
        of = np.repeat(np.arange(len(t)), many)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        text_side, item_side = text_side[of], item_side[of]
        t, p = t[of] + np.where(text_side, nth * s[of], 0), p[of] + np.where(item_side, nth * z[of], 0)
        return [t, p, np.where(text_side, 1, a[of]), np.where(item_side, 1, b[of]), s[of], z[of], item[of]]

    def _banded(self, item: np.ndarray, t: np.ndarray, p: np.ndarray, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The strips of pairs of runs of one distance ``s``."""
        wide, low = self.band[item], t - p - (b - 1) * s
        least = low // wide
        strips = (low + (a + b - 2) * s) // wide - least + 1
        upto, begin = np.cumsum(strips), 0
        while begin < len(item):
            end = max(begin + 1, int(np.searchsorted(upto, PAIRS + (upto[begin - 1] if begin else 0), side="right")))
            of = np.repeat(np.arange(begin, end), strips[begin:end])
            strip = least[of] + np.arange(len(of)) - np.repeat(np.cumsum(strips[begin:end]) - strips[begin:end], strips[begin:end])
            begin = end
            diagonals = lambda strip: -((low[of] - strip * wide[of]) // s[of])  # noqa: E731, B023 - those before a strip begins
            n = _shared_upto(diagonals(strip + 1), a[of], b[of]) - _shared_upto(diagonals(strip), a[of], b[of])
            yield item[of], strip, n

    def regions(self, text: bytes) -> set[tuple[int, int]]:
        """Patterns and bands with as many shared q-grams as the lemma asks for; band b has the diagonals from b times
        the band's width up to (b+2) times."""
        array = np.frombuffer(text, dtype=np.uint8)
        keys, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            key = np.concatenate([keys, *(k for k, _ in held)])
            n = np.concatenate([counts, *(c for _, c in held)])
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            return key[first], np.add.reduceat(n, first) if len(first) else n

        for at in range(0, max(1, len(array)), PART):
            for item, strip, n in self.shared(array[at : at + PART + GRAM - 1], at):
                held.append((item * (1 << 40) + (strip + (1 << 39)), n))
                size += len(n)
                if size > 2 * PAIRS:
                    keys, counts = summed()
                    held, size = [], 0
        keys, counts = summed()
        # a band is a strip and the next one
        both = np.concatenate([keys, keys - 1])
        order = np.argsort(both, kind="stable")
        both, n = both[order], np.concatenate([counts, counts])[order]
        if not len(both):
            return set()
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        both, n = both[first], np.add.reduceat(n, first)
        both = both[n >= self.need[both >> 40]]
        return {(k >> 40, (k & ((1 << 40) - 1)) - (1 << 39)) for k in both.tolist()}

    def _intervals(self, text: bytes) -> dict[int, list[tuple[int, int]]]:
        """For each pattern the diagonals on which it may lie: its bands with the edits around them, those that touch as one."""
        out: dict[int, list[tuple[int, int]]] = {}
        for i, band in sorted(self.regions(text)):
            wide, most, known = int(self.band[i]), int(self.budget[i]), out.setdefault(i, [])
            low, high = band * wide - most, (band + 2) * wide + most
            if known and low <= known[-1][1] + 1:
                known[-1] = (known[-1][0], high)
            else:
                known.append((low, high))
        return out

    def found(self, text: bytes) -> Iterator[tuple[int, int, int, int]]:
        """For each pattern within its budget somewhere in the text, its best region: pattern id, edits, start, stop. The
        best has the fewest edits, then the leftmost stop, then the latest start."""
        for i, p in self.short:
            if (at := text.find(p)) >= 0:
                yield self.ids[i], 0, at, at + len(p)
        for i, spans in self._intervals(text).items():
            p, most = self.data[i], int(self.budget[i])
            exact = (at for low, high in spans if (at := text.find(p, max(0, low), max(0, high + len(p)))) >= 0)
            if (at := next(exact, -1)) >= 0:  # nothing is better than a copy, and this is the leftmost
                yield self.ids[i], 0, at, at + len(p)
                continue
            # no alignment leaves its first diagonal by more than its edits, so wide intervals can be taken in parts
            parts = ((x, min(high, x + PART + most)) for low, high in spans for x in range(low, high + 1, PART))
            best = min((got for x, z in parts if (got := align(p, text, x - most, z, most))), key=lambda x: (x[0], x[2], -x[1]), default=None)
            if best:
                yield self.ids[i], *best

    def search(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """What ``found`` gives, by pattern."""
        return sorted(self.found(text))


_FOUND = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block: int) -> tuple[int, Iterator[list[tuple[int, bytes]]]]:
    """How many blocks of about ``block`` bytes the items make, and the blocks, one after the other."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").cast("binary").alias("data")).dropna()
    total = items.agg(F.sum(F.length("data"))).first()[0] or 0
    n = -(-total // block) or 1
    return n, (sorted((r.item_id, normal(bytes(r.data))) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).collect()) for b in range(n))


def contamination(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Benchmark items found in documents: ``doc_id, item_id, edits, start, stop``, a row for each pair with the best region.

    Both texts are taken with A-Z in lower case and single spaces; start and stop are bytes of the text so taken. An item
    is found where a part of the text is within ``errors`` edits a byte of it, or less where the q-gram lemma needs it;
    an item shorter than a q-gram, only as it is. Null and empty texts and items find nothing, nor do items without an
    id; repeated rows give repeated rows and equal items one each; a document's null id stays null; empty tables give no
    rows. Other columns aren't read.
    """
    long_rows(docs.sparkSession)
    rows, out = texts(docs, doc_id, text), None
    n, parts = _blocks(benchmark, item_id, item_text, block)
    for part in parts:

        def run(batches: Iterator[pa.RecordBatch], part: list[tuple[int, bytes]] = part) -> Iterator[pa.RecordBatch]:
            patterns = Patterns([i for i, _ in part], [p for _, p in part], errors)
            for b in batches:
                yield batch([(i, *f) for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True) for f in patterns.search(normal(x.as_py()))], _FOUND)

        found = rows.mapInArrow(run, schema_of(_FOUND))
        found = saved(found) if n > 1 else found  # so that no plan holds two blocks
        out = found if out is None else out.unionByName(found)
    return out


def uncontaminated(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block: int = BLOCK, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all their columns; see ``contamination``."""
    long_rows(docs.sparkSession)
    out, at = docs, docs.columns.index(text)
    n, parts = _blocks(benchmark, item_id, item_text, block)
    for part in parts:

        def run(batches: Iterator[pa.RecordBatch], part: list[tuple[int, bytes]] = part) -> Iterator[pa.RecordBatch]:
            patterns = Patterns([i for i, _ in part], [p for _, p in part], errors)
            for b in batches:
                clean = [next(patterns.found(normal((x.as_py() or "").encode())), None) is None for x in b.column(at)]
                yield b.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
        out = saved(out) if n > 1 else out  # as in contamination
    return out


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
