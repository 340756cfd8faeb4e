"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs, which also tells how alike two texts are.

Each paragraph piece hashes to a wide vector, and a text's fingerprint is the sum of its pieces' vectors, lane by lane: four
lanes of 64 bits over their whole range, modulo 2^64, for equality, and 256 lanes of +1 and -1, modulo 2^32, for likeness.
The sum doesn't depend on order, and adding or removing a piece adds or subtracts its vector, so a fingerprint is kept up to
date without the rest of the text. The signed lanes of a difference of two fingerprints have as mean square the number of
pieces that only one text has (with multiplicity, squared), so likeness comes from the fingerprints alone. No text has 2^31
pieces, so signed lanes never wrap.

Pieces are paragraphs (lines), cut after sentence ends and after 16 words, so that a change costs a piece and not a page.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import batch, documents, long_rows, schema_of, texts, width

LANES, WIDE, WORDS = 256, 4, 16
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def pieces(text: str) -> list[str]:
    """Paragraph pieces, with single spaces: lines, cut after words that end a sentence and after ``WORDS`` words."""
    out: list[str] = []
    for line in text.split("\n"):
        for sentence in _SENTENCE.split(line):
            words = sentence.split()
            if len(words) <= WORDS:
                if words:
                    out.append(" ".join(words))
            else:
                out += [" ".join(words[at : at + WORDS]) for at in range(0, len(words), WORDS)]
    return out


@dataclass(frozen=True)
class Fingerprint:
    """Sums of pieces' vectors: unsigned lanes of 64 bits, and sums of signs as unsigned lanes of 32 bits."""

    wide: np.ndarray
    signs: np.ndarray

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.wide + other.wide, self.signs + other.signs)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.wide - other.wide, self.signs - other.signs)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.wide == other.wide).all() and (self.signs == other.signs).all())

    def hex(self) -> str:
        return (self.wide.astype(">u8").tobytes() + self.signs.astype(">u4").tobytes()).hex()


def fingerprint(parts: list[str]) -> Fingerprint:
    """The sum of the pieces' vectors."""
    wide, signs, size = np.zeros(WIDE, dtype=np.uint64), np.zeros(LANES, dtype=np.int64), LANES // 8 + 8 * WIDE
    for at in range(0, len(parts), 4096):
        some = parts[at : at + 4096]
        digests = np.frombuffer(b"".join([hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=size).digest() for p in some]), dtype=np.uint8).reshape(-1, size)
        wide += np.ascontiguousarray(digests[:, LANES // 8 :]).view("<u8").sum(axis=0, dtype=np.uint64)
        signs += 2 * np.unpackbits(digests[:, : LANES // 8], axis=1).sum(axis=0, dtype=np.int64) - len(some)
    return Fingerprint(wide, signs.astype(np.uint32))


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """From 0 to 1: twice what two texts share over what both have, estimated from their fingerprints; equal ones: 1."""
    if a == b:
        return 1.0
    x, y, d = (v.view(np.int32).astype(np.float64) for v in (a.signs, b.signs, a.signs - b.signs))
    whole = float((x * x).sum() + (y * y).sum())
    return max(0.0, min(1.0, 1.0 - float((d * d).sum()) / whole)) if whole else 0.0


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` for each row; null texts are empty, and empty ones have the fingerprint zero."""
    long_rows(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("fingerprint", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch([(i, fingerprint(pieces(x.decode("utf-8", "replace"))).hex()) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], fields)

    return texts(docs, doc_id, text).mapInArrow(run, schema_of(fields))


def _next_to(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``part, guest, doc_id, data`` in order: each row of its own part with the one that follows it there."""

    def step(out: list[tuple], held: tuple, text: str, mark: Fingerprint) -> None:
        i, mine, own = held
        half = len(mine) // 2
        kept, new = mine[: len(mine) - half], text[:half]
        edited = kept + new
        # the pieces that change are those from the cut's line on: take them out and put the new ones in
        line = kept.rfind("\n") + 1
        changed = own - fingerprint(pieces(mine[line:])) + fingerprint(pieces(edited[line:]))
        out.append((i, len(mine), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own.hex(), changed.hex(), likeness(own, changed), likeness(own, mark)))

    part, held = None, None
    for b in batches:
        out: list[tuple] = []
        for p, guest, i, data in zip(*(b.column(k) for k in range(4)), strict=True):
            text = data.as_py().decode("utf-8", "replace")
            mark = fingerprint(pieces(text))
            if held is not None and p.as_py() == part:
                step(out, held, text, mark)
            part = p.as_py()
            held = None if guest.as_py() else (i.as_py(), text, mark)
            if len(out) >= 512:
                yield batch(out, _FIELDS)
                out = []
        yield batch(out, _FIELDS)


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint next to that of an edited one and of the next document, by descending ``doc_id``.

    In the edited text the last half of the code points, rounded down, is replaced by as many of the next document's
    first, or by all it has; the next after the last is the first. Its fingerprint is updated from the text's own.
    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for each row. A
    null text is empty; rows with one id follow each other by text; null ids come last; a lone row is its own next; an
    empty table gives no rows; other columns aren't read.

    Ids are dealt to the ranges that the engine itself draws for sorting them. A range's smallest row needs one row of the
    range below, so each range's largest row is sent up as a guest: one row for each range, found by its id. The driver
    sees two ids for each range.
    """
    spark = docs.sparkSession
    long_rows(spark)
    rows = texts(docs, doc_id, text).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    ranged = rows.select("key").repartitionByRange(4 * width(spark), "key")
    ranges = sorted((r.low, r.top) for r in ranged.groupBy(F.spark_partition_id()).agg(F.min("key").alias("low"), F.max("key").alias("top")).collect())
    if not ranges:
        return rows.select("doc_id").limit(0).selectExpr("doc_id", "0L n_chars", "'' edited_sha256", "'' fingerprint", "'' edited_fingerprint", "0D near_edited", "0D near_next")
    lows, tops = (np.array(x, dtype=np.int64) for x in zip(*ranges, strict=True))

    @F.pandas_udf("part int, above int")
    def placed(key: pd.Series) -> pd.DataFrame:
        part = np.searchsorted(lows, key.to_numpy(), side="right") - 1
        # the largest of a range is the guest of the range above, that of the last one of the first
        return pd.DataFrame({"part": part.astype(np.int32), "above": np.where(tops[part] == key.to_numpy(), (part + 1) % len(tops), -1).astype(np.int32)})

    dealt = rows.withColumn("place", placed("key")).select("doc_id", "data", "key", "place.part", "place.above")
    # of equal ids the first in order is the guest
    guests = dealt.filter("above >= 0").withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("data"))).filter("nth = 1")
    both = dealt.withColumn("guest", F.lit(False)).drop("above").unionByName(guests.drop("part", "nth").withColumnRenamed("above", "part").withColumn("guest", F.lit(True)))
    ordered = both.repartition(width(spark), "part").sortWithinPartitions("part", "guest", F.desc("key"), "data")
    return ordered.select("part", "guest", "doc_id", "data").mapInArrow(_next_to, schema_of(_FIELDS))


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
