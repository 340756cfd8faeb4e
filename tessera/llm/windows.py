"""Repeated windows across a corpus, brought together by content so that no shard has to meet every other.

A window is W consecutive symbols (words or bytes) of one text. Its anchor is the smallest hash among its grams of m
symbols, so equal windows have equal anchors wherever they stand. Consecutive windows with one anchor make a *piece*,
which is a few symbols longer than a window.

1. ``shared_anchors``: each task reduces its texts to distinct (anchor, document) pairs. Anchors that two of its documents
   hold are known to be shared at once and go as one row, whatever their number of documents; only the rest is counted
   across tasks. So a passage that a third of all documents hold is one row for each task.
2. ``pieces``: texts cut to the pieces whose anchors are shared; the others can't repeat.
3. Equal pieces collapse to one row with the smallest and largest document, before any shuffle by anchor.
4. An engine gets the distinct pieces of an anchor together, many anchors at a time, and says for each window which
   document holds it first. An anchor with very many distinct pieces is dealt anew: its pieces are cut again by longer
   grams, whose anchors spread them over many shards, and the same engine indexes them there.
5. ``ranges``: what each document must give up, as spans of symbols.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import forget, long_rows, saved, schema_of, texts, width

#: Anchors that a task gathers before it reduces them, and windows of a piece; both bound a worker's memory.
CHUNK, LONGEST = 2_000_000, 256
#: Distinct pieces of one anchor that stay in one shard; more are dealt anew by longer grams.
MANY = 4_000
#: Symbols that are hashed at a time, few enough to stay in a processor's cache.
CACHED = 1 << 15

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0x5851F42D4C957F2D
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= _C2
    x ^= x >> np.uint64(29)
    return x


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    done = 1
    while done < size:
        step = min(done, size - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, CACHED + 1), _powers(pow(_BASE, -1, 1 << 64), CACHED + 1)


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, tables: tuple[np.ndarray, np.ndarray] = (_UP, _DOWN)) -> np.ndarray:
    """64-bit hashes of the words ``data[begins[i]:ends[i]]``, in order: polynomials from sums of a block, then mixed."""
    up, down = tables
    out, at = np.empty(len(begins), dtype=np.uint64), 0
    while at < len(begins):
        low = int(begins[at])
        to = int(np.searchsorted(ends, low + CACHED, side="right"))
        if to <= at:  # a word longer than a block
            out[at] = xxhash.xxh3_64_intdigest(data[low : ends[at]].tobytes(), int(up[1]) >> 1)
            at += 1
            continue
        block = data[low : ends[to - 1]].astype(np.uint64)
        block += np.uint64(1)
        block *= up[: len(block)]
        sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(block, out=sums[1:])
        a, z = begins[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[z] - sums[a]) * down[a] + (z - a).astype(np.uint64)
        at = to
    return _mixed(out * _C1)


@dataclass
class Split:
    """The symbols of a batch of texts: their bytes, where each symbol begins and ends (none for bytes), their hashes, and where
    each text starts, counted in symbols, with one more at the end."""

    data: np.ndarray
    begins: np.ndarray | None
    ends: np.ndarray | None
    hashes: np.ndarray
    starts: np.ndarray

    def spans(self, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of runs of symbols, of one symbol at least."""
        return (first, stop) if self.begins is None else (self.begins[first], self.ends[stop - 1])

    def contents(self, first: np.ndarray, stop: np.ndarray) -> pa.BinaryArray:
        a, z = self.spans(first, stop)
        offsets = np.concatenate([[0], np.cumsum(z - a)])
        return binary(self.data[np.repeat(a - offsets[:-1], z - a) + np.arange(offsets[-1])], offsets)

    def cut(self, first: int, stop: int) -> bytes:
        if stop <= first:
            return b""
        a, z = (first, stop) if self.begins is None else (self.begins[first], self.ends[stop - 1])
        return self.data[a:z].tobytes()


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.BinaryArray:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _bytes_of(texts: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts, none of which is null, and where each starts."""
    starts = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[starts[0] : starts[-1]]
    return data, starts - starts[0]


@dataclass(frozen=True)
class Words:
    """Texts as words: runs of bytes other than ASCII white space, compared byte for byte."""

    window: int = 13
    gram: int = 4

    def split(self, texts: pa.BinaryArray) -> Split:
        """Words with one space between them, whatever stood there."""
        data, starts = _bytes_of(texts)
        space = _SPACE[data]
        opens = np.zeros(len(data) + 1, dtype=bool)  # where a text begins
        opens[starts] = True
        word = ~space
        head = word.copy()
        head[1:] &= space[:-1] | opens[1:-1]
        tail = word.copy()
        tail[:-1] &= space[1:] | opens[1:-1]
        begins, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
        counts = np.searchsorted(begins, starts)
        follows = ends[~opens[ends]]  # the white space after a word, unless its text ends there
        keep = word
        keep[follows] = True
        place = np.cumsum(keep, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
        begins, ends = place[begins].astype(np.int64) - 1, place[ends - 1].astype(np.int64)
        plain = np.where(space, np.uint8(32), data)[keep]
        return Split(plain, begins, ends, word_hashes(plain, begins, ends), counts)

    def grams(self, hashes: np.ndarray, size: int | None = None) -> np.ndarray:
        size = size or self.gram
        n = max(0, len(hashes) - size + 1)
        out = np.zeros(n, dtype=np.uint64)
        for j in range(size):
            out *= _C1
            out += hashes[j : j + n]
            out ^= out >> np.uint64(32)
        return _mixed(out)


@dataclass(frozen=True)
class Bytes:
    """Texts as bytes of UTF-8; grams have eight at least."""

    window: int = 50
    gram: int = 20

    def split(self, texts: pa.BinaryArray) -> Split:
        data, starts = _bytes_of(texts)
        return Split(data, None, None, data, starts)

    def grams(self, data: np.ndarray, size: int | None = None) -> np.ndarray:
        size = size or self.gram
        n = max(0, len(data) - size + 1)
        if not n:
            return np.zeros(0, dtype=np.uint64)
        if size < 8:
            return Words.grams(self, data.astype(np.uint64), size)
        x = data.astype(np.uint64)
        for step in (1, 2, 4):  # eight bytes in one number
            x = x[:-step] | (x[step:] << np.uint64(8 * step))
        out = np.zeros(n, dtype=np.uint64)
        for j in [*range(0, size - 8, 8), size - 8]:
            out *= _C1
            out += x[j : j + n]
            out ^= out >> np.uint64(32)
        return _mixed(out)


Symbols = Words | Bytes


def _anchors(kind: Symbols, hashes: np.ndarray) -> np.ndarray:
    """The anchor of the window at each place, as if all texts were one."""
    n = len(hashes) - kind.window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for at in range(0, n, CACHED):
        to = min(n, at + CACHED)
        out[at:to] = _sliding_min(kind.grams(hashes[at : to + kind.window - 1]), kind.window - kind.gram + 1)
    return out


def _runs(kind: Symbols, split: Split) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of all texts of a batch: anchor, text number, first window and one past the last, counted over the batch."""
    least, starts = _anchors(kind, split.hashes), split.starts
    none = np.zeros(0, dtype=np.int64)
    if not len(least):
        return np.zeros(0, dtype=np.uint64), none, none, none
    sizes = np.maximum(0, np.diff(starts) - kind.window + 1)
    good = np.zeros(len(least) + 1, dtype=np.int8)  # windows within one text
    np.add.at(good, starts[:-1][sizes > 0], 1)
    np.add.at(good, (starts[:-1] + sizes)[sizes > 0], -1)
    good = np.cumsum(good[:-1], dtype=np.int8) > 0
    change = np.ones(len(least), dtype=bool)
    np.not_equal(least[1:], least[:-1], out=change[1:])
    change[starts[:-1][sizes > 0]] = True
    change[1:] |= good[1:] != good[:-1]
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(least))
    keep = good[first]
    first, last = first[keep], last[keep]
    if len(first) and (last - first).max() > LONGEST:
        parts = -(-(last - first) // LONGEST)
        at = np.repeat(first, parts) + LONGEST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        first, last = at, np.minimum(at + LONGEST, np.repeat(last, parts))
    return least[first], np.searchsorted(starts, first, side="right") - 1, first, last


def _pairs(anchors: list[np.ndarray], docs: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of ``key, doc_id, anchor``: see ``shared_anchors``."""
    a, d = np.concatenate(anchors), np.concatenate(docs)
    order = np.lexsort((d, a))
    a, d = a[order], d[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    a, d = a[new], d[new]
    first = np.ones(len(a), dtype=bool)
    first[1:] = a[1:] != a[:-1]
    group = np.cumsum(first) - 1
    shared = np.bincount(group)[group] > 1 if len(a) else first
    signal = a[first & shared]
    known_a, known_d = a[shared], d[shared]
    salt = _mixed(known_d.view(np.uint64) + _C1)
    key = np.concatenate([a[~shared], signal, salt]).view(np.int64)
    doc = np.concatenate([d[~shared], np.zeros(len(signal), np.int64), known_d])
    anchor = np.concatenate([np.zeros((~shared).sum() + len(signal), np.int64), known_a.view(np.int64)])
    no_doc = np.zeros(len(key), dtype=bool)
    no_doc[(~shared).sum() : (~shared).sum() + len(signal)] = True
    no_anchor = np.ones(len(key), dtype=bool)
    no_anchor[len(key) - len(known_a) :] = False
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc, mask=no_doc), pa.array(anchor, mask=no_anchor)], names=["key", "doc_id", "anchor"])


def _slices(b: pa.RecordBatch, rows: int = 65536) -> Iterator[pa.RecordBatch]:
    for at in range(0, max(1, len(b)), rows):
        yield b.slice(at, rows)


def shared_anchors(rows: DataFrame, kind: Symbols) -> DataFrame:
    """``doc_id, anchors array<long>``: for each document the anchors that another document holds too, some perhaps twice.

    A task's rows have a key: an anchor that one document of the task holds, with that document; an anchor that more hold,
    with no document, as a signal; or a salt, with a document and an anchor that is known to be shared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        size = 0
        for b in batches:
            least, text, _, _ = _runs(kind, kind.split(b.column(1)))
            anchors.append(least)
            docs.append(b.column(0).to_numpy()[text])
            size += len(least)
            if size > CHUNK:
                yield from _slices(_pairs(anchors, docs))
                anchors, docs, size = [], [], 0
        if size:
            yield from _slices(_pairs(anchors, docs))

    found = rows.mapInArrow(run, "key long, doc_id long, anchor long")
    # the commonest anchor has one row of 16 bytes for each CHUNK of anchors (some 30 MB of text): 3 million rows at 100 TB,
    # which the window streams and spills; a join with counts would sort all anchors twice instead
    counted = found.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    known = counted.filter(F.col("doc_id").isNotNull() & (F.col("anchor").isNotNull() | (F.col("n") > 1)))
    return known.groupBy("doc_id").agg(F.collect_list(F.coalesce("anchor", "key")).alias("anchors"))


def _shares(sizes: np.ndarray, rows: int = 16384, most: int = 8 << 20) -> Iterator[slice]:
    """Slices of rows of these many bytes, each of ``rows`` rows and about ``most`` bytes at most."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, min(at + rows, int(np.searchsorted(upto, most + (upto[at - 1] if at else 0), side="right"))))
        yield slice(at, to)
        at = to


_PIECE = [("anchor", pa.int64()), ("piece", pa.int64()), ("content", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int32())]


def _contents(split: Split, first: np.ndarray, stop: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """Runs of symbols and a hash of each."""
    content = split.contents(first, stop)
    data, offsets = memoryview(content.buffers()[2] or b""), np.frombuffer(content.buffers()[1], dtype=np.int32).tolist()
    digest = xxhash.xxh3_64_intdigest
    return content, np.array([digest(data[a:z]) for a, z in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.uint64).view(np.int64)


def pieces(rows: DataFrame, shared: DataFrame, kind: Symbols) -> DataFrame:
    """``anchor, piece, content, doc_id, row, at``: the pieces with shared anchors; ``piece`` is a hash of the content and
    ``at`` the first symbol within the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = kind.split(b.column(1))
            least, text, first, last = _runs(kind, split)
            lists = b.column(3)
            wanted = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            of = np.repeat(np.arange(len(b)), np.diff(lists.offsets.to_numpy()))
            pair = lambda anchor, text: _mixed(anchor + text.astype(np.uint64) * _C1)
            hit = np.flatnonzero(np.isin(pair(least, text), pair(wanted, of)))
            ids, keys = b.column(0).to_numpy(), b.column(2).to_numpy()
            a, z = split.spans(first[hit], last[hit] + kind.window - 1)
            for share in _shares(z - a):
                part = hit[share]
                t = text[part]
                content, hashed = _contents(split, first[part], last[part] + kind.window - 1)
                yield pa.RecordBatch.from_arrays([pa.array(least[part].view(np.int64)), pa.array(hashed), content, pa.array(ids[t]), pa.array(keys[t]), pa.array((first[part] - split.starts[t]).astype(np.int32))], names=[n for n, _ in _PIECE])

    joined = rows.join(shared, "doc_id").select("doc_id", "data", "row", "anchors")
    return joined.mapInArrow(run, schema_of(_PIECE))


@dataclass
class Shard:
    """Distinct pieces that are indexed together: their symbols, and the first document of each."""

    split: Split
    first: np.ndarray


@dataclass(frozen=True)
class Engine:
    """Makes a function that tells, for each window of each piece of a shard, in order, the first document that holds it.

    ``symbols`` is how many bytes of pieces make a shard. With ``single``, pieces of anchors that have no other piece are
    indexed as well; without, their one document range is taken as it is, as no other piece can hold their windows, and
    pieces that differ from all others on both sides of the anchor are left out too.
    """

    load: Callable[[], Callable[[Shard], np.ndarray]]
    symbols: int
    single: bool


_SEGMENT = [("anchor", pa.int64()), ("piece", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("earliest", pa.int64())]


def _segments(anchors: np.ndarray, names: np.ndarray, sizes: np.ndarray, lasts: np.ndarray, earliest: np.ndarray) -> pa.RecordBatch:
    """Runs of windows of a piece with one first document, where that isn't the piece's only one."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    change = np.ones(len(of), dtype=bool)
    change[1:] = (of[1:] != of[:-1]) | (earliest[1:] != earliest[:-1])
    first = np.flatnonzero(change)
    size = np.diff(np.append(first, len(of)))
    keep = earliest[first] < lasts[of[first]]
    first, size = first[keep], size[keep]
    return pa.RecordBatch.from_arrays([pa.array(anchors[of[first]]), pa.array(names[of[first]]), pa.array(start[first].astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(earliest[first])], names=[x for x, _ in _SEGMENT])


def _may_meet(kind: Symbols, split: Split, anchors: np.ndarray) -> np.ndarray:
    """Pieces that can share a window with another piece of their anchor.

    A window has the anchor and W-m symbols more, so at least half of these, rounded up, stand on one side of it. Two
    pieces without a like side are told apart here, before any index is made. If a piece holds the anchor's gram more
    than once, all of that anchor are kept.
    """
    n, starts = len(anchors), split.starts
    anchor, side = anchors.view(np.uint64), -(-(kind.window - kind.gram) // 2)
    grams, sides = kind.grams(split.hashes), kind.grams(split.hashes, max(1, side))
    of = np.repeat(np.arange(n), np.diff(starts))[: len(grams)]
    at = np.flatnonzero(grams == anchor[of])
    at = at[at + kind.gram <= starts[of[at] + 1]]
    often = np.bincount(of[at], minlength=n)
    new = np.ones(n, dtype=bool)
    new[1:] = anchors[1:] != anchors[:-1]
    group = np.cumsum(new) - 1
    out = np.bincount(group, weights=often != 1)[group] > 0
    once = at[often[of[at]] == 1]
    left, right = once[once - side >= starts[of[once]]], once[once + kind.gram + side <= starts[of[once] + 1]]
    keys = np.concatenate([sides[left - side] * _C1, sides[right + kind.gram] ^ _C1]) + group[of[np.concatenate([left, right])]].astype(np.uint64) * _C2
    _, back, times = np.unique(_mixed(keys), return_inverse=True, return_counts=True)
    out[of[np.concatenate([left, right])][times[back] > 1]] = True
    return out


def _solved(kind: Symbols, solve: Callable[[Shard], np.ndarray], single: bool, rows: pa.Table) -> pa.RecordBatch:
    """Segments of rows ``anchor, piece, content, first, last`` of whole anchors, in order."""
    rows = rows.combine_chunks()
    column = lambda c: rows[c].combine_chunks() if rows[c].num_chunks != 1 else rows[c].chunk(0)
    anchors, names, first, last = (column(c).to_numpy() for c in ("anchor", "piece", "first", "last"))
    content = column("content")
    split = kind.split(content)
    sizes = np.diff(split.starts) - kind.window + 1
    earliest, may = np.repeat(first, sizes), np.ones(len(anchors), dtype=bool)
    if not single:
        new = np.ones(len(anchors) + 1, dtype=bool)
        new[1:-1] = anchors[1:] != anchors[:-1]
        may = ~(new[:-1] & new[1:])
        if some := np.flatnonzero(may).tolist():
            part = content.take(pa.array(some))
            may[some] = _may_meet(kind, kind.split(part), anchors[some])
    if may.all():
        earliest = solve(Shard(split, first))
    elif may.any():
        earliest[np.repeat(may, sizes)] = solve(Shard(kind.split(content.filter(pa.array(may))), first[may]))
    return _segments(anchors, names, sizes, last, earliest)


def _indexed(kind: Symbols, engine: Engine):
    """Reads distinct pieces sorted by anchor and writes segments, a shard of about ``engine.symbols`` bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solve, held, size = engine.load(), [], 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            size += b.column(2).nbytes
            if size > engine.symbols:
                anchors = b.column(0).to_numpy()
                cut = int(np.argmax(anchors == anchors[-1]))
                if not cut:  # one anchor fills the batch: it ends before it, or goes on
                    if len(held) == 1 or held[-2].column(0)[-1].as_py() == anchors[0]:
                        continue
                    whole, held = held[:-1], [b]
                else:
                    whole, held = [*held[:-1], b.slice(0, cut)], [b.slice(cut)]
                size = held[0].column(2).nbytes
                yield from _slices(_solved(kind, solve, engine.single, pa.Table.from_batches(whole)))
        if held:
            yield from _slices(_solved(kind, solve, engine.single, pa.Table.from_batches(held)))

    return run


_PART = [("anchor", pa.int64()), ("piece", pa.int64()), ("content", pa.binary()), ("first", pa.int64()), ("last", pa.int64()), ("of_anchor", pa.int64()), ("of_piece", pa.int64()), ("at", pa.int32())]


def _cut_anew(kind: Symbols):
    """Pieces ``anchor, piece, content, first, last`` cut again by the grams of ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = kind.split(b.column(2))
            least, of, begin, end = _runs(kind, split)
            a, z = split.spans(begin, end + kind.window - 1)
            for part in _shares(z - a):
                content, hashed = _contents(split, begin[part], end[part] + kind.window - 1)
                rows = pa.array(of[part])
                yield pa.RecordBatch.from_arrays([pa.array(least[part].view(np.int64)), pa.array(hashed), content, b.column(3).take(rows), b.column(4).take(rows), b.column(0).take(rows), b.column(1).take(rows), pa.array((begin[part] - split.starts[of[part]]).astype(np.int32))], names=[n for n, _ in _PART])

    return run


def first_documents(distinct: DataFrame, kind: Symbols, engine: Engine, many: int) -> DataFrame:
    """``anchor, piece, start, size, earliest`` of distinct pieces ``anchor, piece, content, first, last``.

    Pieces of an anchor that has over ``many`` are cut anew by grams half way to a whole window, and again if need be. At a
    whole window's length an anchor has no piece but one, so no group stays large.
    """
    hot = distinct.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > many).select("anchor")
    hot = saved(hot) if kind.gram < kind.window else None
    dealt_anew = hot is not None and not hot.isEmpty()
    cold = distinct.join(hot, "anchor", "left_anti") if dealt_anew else distinct
    segments = cold.repartition(width(distinct.sparkSession), "anchor").sortWithinPartitions("anchor").mapInArrow(_indexed(kind, engine), schema_of(_SEGMENT))
    if not dealt_anew:
        return saved(segments)
    finer = replace(kind, gram=(kind.gram + kind.window + 1) // 2)
    parts = saved(distinct.join(hot, "anchor", "left_semi").select("anchor", "piece", "content", "first", "last").mapInArrow(_cut_anew(finer), schema_of(_PART)))
    again = saved(parts.groupBy("anchor", "piece", "content").agg(F.min("first").alias("first"), F.max("last").alias("last")))
    inner = first_documents(again, finer, engine, many)
    back = parts.select("anchor", "piece", "last", "of_anchor", "of_piece", "at").join(inner, ["anchor", "piece"]).filter("earliest < last")
    back = back.select(F.col("of_anchor").alias("anchor"), F.col("of_piece").alias("piece"), (F.col("at") + F.col("start")).alias("start"), "size", "earliest")
    out = saved(segments.unionByName(back))
    forget(hot, parts, again, inner)
    return out


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, data, row``; with ``doc_id`` the row tells repeated ids apart by their texts."""
    return texts(docs, doc_id, text).withColumn("row", F.xxhash64("data"))


def removed_ranges(docs: DataFrame, kind: Symbols, engine: Engine, many: int | None = None) -> DataFrame:
    """``doc_id, row, spans array<struct<start, stop>>``: symbols covered by windows that a smaller ``doc_id`` holds too.

    ``docs`` comes from ``keyed``. Rows with a null id neither give up anything nor count for others.
    """
    long_rows(docs.sparkSession)
    rows = docs.filter("doc_id is not null")
    shared = saved(shared_anchors(rows.select("doc_id", "data"), kind))
    found = saved(pieces(rows, shared, kind), ["anchor", "piece", "content"])
    forget(shared)
    distinct = saved(found.groupBy("anchor", "piece", "content").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), ["anchor", "piece", "content"])
    segments = first_documents(distinct, kind, engine, many or MANY)
    forget(distinct)
    spans = found.drop("content").join(segments, ["anchor", "piece"]).filter("earliest < doc_id")
    start = F.col("at") + F.col("start")
    spans = spans.select("doc_id", "row", F.struct(start.alias("start"), (start + F.col("size") + (kind.window - 1)).alias("stop")).alias("span"))
    out = saved(spans.groupBy("doc_id", "row").agg(F.collect_list("span").alias("spans")))
    forget(found, segments)
    return out


def merged(spans: pa.ListArray) -> list[list[tuple[int, int]]]:
    """Disjoint, sorted spans of each row, with overlapping and adjoining ones joined."""
    flat = spans.flatten()
    start, stop = (flat.field(k).to_numpy().astype(np.int64) for k in range(2))
    sizes = np.diff(spans.offsets.to_numpy())
    if spans.null_count:
        sizes = np.where(spans.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    of = np.repeat(np.arange(len(spans)), sizes)
    order = np.lexsort((start, of))
    of, start, stop = of[order], start[order], stop[order]
    far = np.maximum.accumulate(stop + (of << 32)) - (of << 32)  # rows are apart, so this is each row's own
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (start[1:] > far[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(of)) - 1
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(spans))]
    if len(of):
        for k, a, z in zip(of[heads].tolist(), start[heads].tolist(), far[tails].tolist(), strict=True):
            out[k].append((a, z))
    return out
