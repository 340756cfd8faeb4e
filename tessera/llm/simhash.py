"""Near duplicates by SimHash, with candidates from covering locality-sensitive hashing.

``covering_masks`` gives 2^(r+1)-1 masks over the bits of a fingerprint such that any two fingerprints which differ in at
most r bits agree under one mask at least, so the tables miss no pair. Documents with one fingerprint are one class, and
only classes are linked: copies are never expanded into pairs.

A bucket of a table is compared within one task while it is small. A larger one goes another way, which is exact too:
two fingerprints within two bits of each other have a midpoint within one bit of both, so each member is sent to itself
and its one-bit neighbours outside the mask. All that meet at one midpoint are within two bits, and no midpoint can have
more than 65 visitors, however large the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import batch, documents, long_rows, saved, schema_of, texts
from tessera.llm.components import components

BITS = 64
#: Members of a bucket that one task compares with each other.
SMALL_BUCKET = 32
#: Words whose shingles are hashed at a time, which bounds a worker's memory on a text of any length.
PIECE = 100_000


def covering_masks(bits: int = BITS, radius: int = 2) -> list[int]:
    """Masks, as unsigned integers, of which one at least keeps none of any ``radius`` bits.

    Bit i is given the nonzero vector 1 + i mod (2^(r+1)-1) of r+1 bits, and the mask of a nonzero vector v keeps the bits
    whose vectors have an odd product with v. The vectors of r bits span r dimensions at most, so some v is orthogonal to
    all of them.
    """
    vectors = range(1, 2 ** (radius + 1))
    given = [vectors[i % len(vectors)] for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(given) if (m & v).bit_count() % 2) for v in vectors]


def simhash(data: bytes, shingle: int = 3, seed: int = 42) -> int:
    """A bit is one if it is one in over half of the shingles' XXH64, repeats included. No words: zero.

    Words are runs of bytes other than ASCII white space, with A-Z in lower case. A text of fewer words than a shingle
    has is one shingle.
    """
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest, counts, total = xxhash.xxh64_digest, np.zeros(BITS, dtype=np.int64), len(words) - shingle + 1
    for at in range(0, total, PIECE):
        part = words[at : at + PIECE + shingle - 1]
        hashes = b"".join([digest(s, seed) for s in map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))])
        counts += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint long``, one row for each row; the long holds the 64 unsigned bits."""
    long_rows(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("fingerprint", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_signed(simhash(x.as_py())) for x in b.column(1)], pa.int64())], names=["doc_id", "fingerprint"])

    return texts(docs, doc_id, text).mapInArrow(run, schema_of(fields))


_LINK = [("a", pa.int64()), ("b", pa.int64())]


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a spanning forest of each small bucket, by comparing its members two by two."""
    for b in batches:
        out = []
        for members in b.column(0).to_pylist():
            x = np.array(members, dtype=np.int64).view(np.uint64)
            near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
            left = set(range(len(x)))
            while left:
                reached = [left.pop()]
                for i in reached:
                    found = [j for j in left if near[i, j]]
                    left.difference_update(found)
                    reached += found
                    out += [(members[i], members[j]) for j in found]
        yield batch(out, _LINK)


def link_fingerprints(distinct: DataFrame, masks: list[int] | None = None) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints that differ in two bits at most: enough of them to keep every
    component whole. ``distinct`` has the column ``fingerprint``."""
    masks = covering_masks() if masks is None else masks
    keys = F.explode(F.array(*(F.struct(F.lit(n).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("key")) for n, m in enumerate(masks))))
    tables = saved(distinct.select("fingerprint", keys.alias("k")).select("fingerprint", "k.t", "k.key"))
    sizes = tables.groupBy("t", "key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = saved(tables.join(sizes, ["t", "key"]))
    small = buckets.filter(F.col("size") <= SMALL_BUCKET).groupBy("t", "key").agg(F.collect_list("fingerprint").alias("members"))
    links = small.select("members").mapInArrow(_within, schema_of(_LINK))
    outside = F.element_at(F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1)) for m in masks)), F.col("t") + 1)
    visits = buckets.filter(F.col("size") > SMALL_BUCKET).select("fingerprint", F.explode(outside).alias("bit"))
    met = visits.select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("bit")).alias("z")).distinct().groupBy("z").agg(F.collect_list("fingerprint").alias("members"))
    stars = met.filter(F.size("members") > 1).select(F.array_min("members").alias("a"), F.explode("members").alias("b")).filter("a < b")
    return links.unionByName(stars)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint string, component_id, copies long`` for each row of ``docs``.

    Documents whose fingerprints differ in two bits at most are linked; ``component_id`` is the smallest id reachable, the
    document itself included, and ``copies`` counts the rows with the same fingerprint. A null text is an empty one, all
    texts without words share the fingerprint zero, and repeated rows are copies. A row with a null id has the component
    of its fingerprint's other rows (null if there are none) and is never the smallest. An empty table gives no rows;
    other columns aren't read.
    """
    marked = saved(fingerprints(docs, doc_id, text))
    classes = saved(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    roots = components(link_fingerprints(classes.select("fingerprint")))
    labelled = classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    labelled = saved(labelled.withColumn("root", F.coalesce("root", "fingerprint")))
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = labelled.join(smallest, "root").select("fingerprint", "component_id", "copies")
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return marked.join(named, "fingerprint").select("doc_id", hexed.alias("fingerprint"), "component_id", "copies")


def only(docs: DataFrame, kept: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows with an id among ``__kept``, one for each id, and those with a null id."""
    found = docs.join(kept, F.col(f"`{doc_id}`").cast("long") == F.col("__kept"), "left_semi")
    nth = F.row_number().over(Window.partitionBy(f"`{doc_id}`").orderBy(f"`{text}`"))
    first = found.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")
    return first.unionByName(docs.filter(F.col(f"`{doc_id}`").isNull()))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that have their component's smallest id; see ``near_duplicates``.

    Rows with one id are one document: of its texts the first in order stays. Rows with a null id stay.
    """
    kept = saved(near_duplicates(docs, doc_id, text).filter("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct())
    return only(docs, kept, doc_id, text)


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
