"""Substring dedup by bytes: suffix arrays with common prefixes, made by external induced sorting.

Shards are made by ``windows``: every window of 50 bytes goes where all equal windows go. A shard's distinct pieces are
sorted together; neighbours in the suffix array that share a whole window hold the same one, and the smallest document
among them is the first to hold it. Shards are larger than what the sort holds in memory, so its queues and arrays go to disk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import batch, documents, long_rows, schema_of
from tessera.llm.suffix_array import BLOCK, Store, blocks, suffix_array
from tessera.llm.windows import Bytes, Engine, Shard, keyed, merged, removed_ranges

WINDOW = 50
#: Bytes of distinct pieces that are sorted together, and tuples that the sort's queues hold, the rest being on the task's disk.
SHARD, IN_MEMORY = 3_000_000, 300_000


def suffix_engine(window: int = WINDOW, symbols: int = SHARD, in_memory: int = IN_MEMORY) -> Engine:
    """The first document to hold each window of a shard's pieces."""

    def solve(shard: Shard) -> np.ndarray:
        # bytes are 2 to 257, a piece ends with 1, the text with 0
        starts = shard.split.starts
        sizes, pieces = np.diff(starts), len(starts) - 1
        stops = np.cumsum(sizes + 1)
        windows = np.cumsum(sizes - window + 1) - (sizes - window + 1)
        earliest = np.empty(int((sizes - window + 1).sum()), dtype=np.int64)
        with Store(in_memory) as store:
            text = store.array(int(stops[-1]) + 1, np.uint16)
            for s in blocks(pieces, 4096):
                own = np.insert(shard.split.data[starts[s.start] : starts[s.stop]].astype(np.uint16) + 2, starts[s.start + 1 : s.stop + 1] - starts[s.start], 1)
                text[stops[s.start] - sizes[s.start] - 1 : stops[s.stop - 1]] = own
            order, lcp = suffix_array(text, store)
            at = 0
            while at < len(text):
                to = at + BLOCK
                while to < len(text) and (heads := np.flatnonzero(np.asarray(lcp[to - BLOCK // 2 : to + 1]) < window)).size == 0:
                    to += BLOCK // 2
                to = len(text) if to >= len(text) else to - BLOCK // 2 + int(heads[-1])
                # neighbours that share a whole window hold the same one
                place = np.asarray(order[at:to]).astype(np.int64)
                new = np.asarray(lcp[at:to]) < window
                new[0] = True
                piece = np.minimum(np.searchsorted(stops, place, side="right"), pieces - 1)
                heads = np.flatnonzero(new)
                least = np.minimum.reduceat(shard.first[piece], heads)
                whole = np.flatnonzero(stops[piece] - 1 - place >= window)
                where = windows[piece[whole]] + place[whole] - (stops[piece[whole]] - 1 - sizes[piece[whole]])
                earliest[where] = least[(np.cumsum(new) - 1)[whole]]
                at = to
        return earliest

    return Engine(lambda: solve, symbols, False)


_KEPT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))]


def dedup_bytes(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", content: bool = True, shard: int = SHARD, in_memory: int = IN_MEMORY) -> DataFrame:
    """Remove each byte covered by a window of bytes that also starts in a document with a smaller ``doc_id``.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256, spans`` for each row: the bytes left (without
    ``content`` null), their SHA-256, and the removed runs as byte numbers, start and stop in turn. Windows never cross
    texts and are judged on the input. A null text is empty. Of equal ids none is the smaller, so repeated rows leave
    each other alone; a null id is never smaller or larger. An empty table gives no rows; other columns aren't read.
    """
    rows = keyed(docs, doc_id, text)
    long_rows(docs.sparkSession)
    spans = removed_ranges(rows, Bytes(window, min(20, max(8, window // 2))), suffix_engine(window, shard, in_memory))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, data, gone in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), merged(b.column(2)), strict=True):
                kept, at = [], 0
                for start, stop in gone:
                    kept.append(data[at:start])
                    at = stop
                kept.append(data[at:])
                left = b"".join(kept)
                out.append((i, len(data), len(data) - len(left), len(gone), left if content else None, hashlib.sha256(left).hexdigest(), [x for s in gone for x in s]))
            yield batch(out, _KEPT)

    joined = rows.join(spans, ["doc_id", "row"], "left").select("doc_id", "data", "spans")
    return joined.mapInArrow(cut, schema_of(_KEPT))


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_bytes(documents(spark, sf_dir), content=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
