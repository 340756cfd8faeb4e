"""Substring dedup by words: compressed FM-indexes over shards of like content, searched backwards by streamed texts.

Shards are made by ``windows``: every window goes where all equal windows go. A shard's distinct pieces are indexed once
and streamed through the index; a match of a whole window's length ends an interval above the threshold, and the interval
of suffixes that it leaves names all pieces that hold the window, so its smallest document is the first to hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, documents, long_rows, schema_of
from tessera.llm.fm_index import FMIndex
from tessera.llm.windows import CACHED, Engine, Shard, Split, Words, _powers, _shares, keyed, merged, removed_ranges, word_hashes

WINDOW = 13
_SECOND = 0x2545F4914F6CDD1D
#: Bytes of distinct pieces in one index.
SHARD = 6_000_000
#: Words that are streamed through it at a time.
STREAM = 400_000
_OTHER = _powers(_SECOND, CACHED + 1), _powers(pow(_SECOND, -1, 1 << 64), CACHED + 1)


def numbered(split: Split) -> tuple[np.ndarray, int]:
    """Each word's number from 1 up, the commonest first, and how many words there are."""
    names, back = np.unique(split.hashes, return_inverse=True)
    other = word_hashes(split.data, split.begins, split.ends, _OTHER)
    first = np.empty(len(names), dtype=np.uint64)
    first[back] = other
    if (first[back] != other).any():  # two words with one hash
        names, back = np.unique(np.array([split.cut(i, i + 1) for i in range(len(split.hashes))], dtype=object), return_inverse=True)
    place = np.empty(len(names), dtype=np.int64)
    place[np.argsort(-np.bincount(back), kind="stable")] = np.arange(1, len(names) + 1)
    return place[back], len(names)


def fm_engine(window: int = WINDOW, symbols: int = SHARD) -> Engine:
    """The first document to hold each window of a shard's pieces: the index of the pieces, and the pieces streamed through
    it; a window is a match of full length."""

    def solve(shard: Shard) -> np.ndarray:
        words, sigma = numbered(shard.split)
        starts, sizes = shard.split.starts[:-1], np.diff(shard.split.starts)
        piece = np.repeat(np.arange(len(sizes)), sizes + 1)
        text = np.insert(words, shard.split.starts[1:], 0)  # a zero after each piece
        index = FMIndex(text, sigma + 1, window, shard.first[piece])
        earliest, at = np.empty(int((sizes - window + 1).sum()), dtype=np.int64), 0
        upto = np.cumsum(sizes)
        for share in _shares(sizes, len(sizes), STREAM):
            lo, _, length = index.matching(words, starts[share], upto[share])
            within = np.arange(len(lo)) - np.repeat(np.cumsum(sizes[share]) - sizes[share], sizes[share])
            windows = within <= np.repeat(sizes[share] - window, sizes[share])
            assert (length[windows] == window).all()  # a piece finds itself at least
            found = index.least(lo[windows])
            earliest[at : at + len(found)] = found
            at += len(found)
        return earliest

    return Engine(lambda: solve, symbols, True)


_KEPT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.int64()))]


def dedup_words(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", digest: bool = False, shard: int = SHARD) -> DataFrame:
    """Remove each word covered by a window that also starts in a document with a smaller ``doc_id``.

    Returns ``doc_id, n_words, n_removed, kept, spans`` for each row: the words left, joined by one space (with ``digest``
    their SHA-256 instead), and the removed spans as word numbers, start and stop in turn. Words are runs of bytes other
    than ASCII white space; windows are judged on the input. A null text has no words. A document of fewer words than a
    window keeps them all. Of equal ids none is the smaller, so repeated rows leave each other alone; a null id is never
    smaller or larger. An empty table gives no rows; other columns aren't read.
    """
    rows = keyed(docs, doc_id, text)
    long_rows(docs.sparkSession)
    kind = Words(window)
    spans = removed_ranges(rows, kind, fm_engine(window, shard))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split, out = kind.split(b.column(1)), []
            starts = split.starts.tolist()
            for k, (i, gone) in enumerate(zip(b.column(0).to_pylist(), merged(b.column(2)), strict=True)):
                left = _left(split, starts[k], starts[k + 1], gone)
                out.append((i, starts[k + 1] - starts[k], sum(z - a for a, z in gone), hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "replace"), [x for s in gone for x in s]))
            yield batch(out, _KEPT)

    joined = rows.join(spans, ["doc_id", "row"], "left").select("doc_id", "data", "spans")
    return joined.mapInArrow(cut, schema_of(_KEPT))


def _left(split: Split, begin: int, end: int, gone: list[tuple[int, int]]) -> bytes:
    """The words of a text that aren't gone, with one space between them."""
    edges = [begin, *(begin + x for s in gone for x in s), end]
    return b" ".join(split.cut(a, z) for a, z in zip(edges[::2], edges[1::2], strict=True) if z > a)


def without_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """The rows of ``docs`` with all their columns, each text without its repeated words; see ``dedup_words``.

    A text that gives up nothing stays as it is; another has its words joined by one space. Rows may become empty, but
    stay.
    """
    long_rows(docs.sparkSession)
    rows = keyed(docs, doc_id, text)
    kind = Words(window)
    spans = removed_ranges(rows, kind, fm_engine(window, shard))
    others = [c for c in docs.columns if c != text]
    whole = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")).alias("row"), F.col(f"`{text}`").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("others"))
    schema = whole.select("text", "others").schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = merged(b.column(2))
            some = [k for k, spans in enumerate(gone) if spans]
            split, out = kind.split(b.column(0).take(pa.array(some, pa.int64())).cast(pa.binary())), b.column(0).to_pylist()
            starts = split.starts.tolist()
            for n, k in enumerate(some):
                out[k] = _left(split, starts[n], starts[n + 1], gone[k]).decode()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), b.column(1)], names=["text", "others"])

    joined = whole.join(spans, ["doc_id", "row"], "left").select("text", "others", "spans").mapInArrow(cut, schema)
    return joined.select(*(F.col(f"others.`{c}`") if c != text else F.col("text").alias(text) for c in docs.columns))


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_words(documents(spark, sf_dir), digest=True)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


#: Words and windows as the contract has them.
OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), spots AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13
), win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM spots
), firsts AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k
), hit AS (
  SELECT DISTINCT doc_id, i + o AS p FROM win JOIN firsts USING (k) CROSS JOIN (SELECT unnest(range(13)) AS o) WHERE f < doc_id
), words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w
), marked AS (SELECT words.*, hit.p IS NOT NULL AS gone FROM words LEFT JOIN hit USING (doc_id, p)
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id
)
SELECT documents.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""
