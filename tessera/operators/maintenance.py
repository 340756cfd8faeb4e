"""Keeping a corpus up to date: upsert, stale rows, orphans, provenance, manifests, ledgers, digests, lengths."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import forget, place_of, saved  # noqa: F401


def upsert(old: DataFrame, new: DataFrame, key: str, created: str, now: Column) -> DataFrame:
    """The new rows, each with the time at which its key was first written. Old keys that aren't in ``new`` are gone."""
    first = unique(old.select(key, F.col(created).alias("__first")), key, what="a stored key twice")
    return new.join(first, key, "left").withColumn(created, F.coalesce("__first", now)).drop("__first")


def stale(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key).distinct(), key, "left_anti")


def unique(rows: DataFrame, *key: str, what: str = "repeated") -> DataFrame:
    """The rows; a key that stands more than once fails the query. Rows are dealt by the key once, and read once."""
    last = F.col(f"`{key[-1]}`")
    counted = rows.withColumn("__n", F.count("*").over(Window.partitionBy(*(f"`{k}`" for k in key))))
    refused = F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(last.cast("string"), F.lit("null"))))
    return counted.withColumn(key[-1], F.when(F.col("__n") == 1, last).otherwise(refused)).select(*(f"`{c}`" for c in rows.columns))


def publish(df: DataFrame, root: str) -> str:
    """Write a new version next to the others and then a pointer to it; returns its path.

    Pointers are added and never overwritten, and a pointer appears whole or not at all, so a reader always finds a complete
    version, and a crash before the pointer is written leaves the one before it current.
    """
    root, name = root.rstrip("/"), f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    path = f"{root}/version={name}"
    df.write.parquet(path)
    df.sparkSession.createDataFrame([(name,)], "name string").coalesce(1).write.mode("append").text(f"{root}/current")
    return path


def current(spark, root: str) -> DataFrame:
    """The newest published version."""
    root = root.rstrip("/")
    name = spark.read.text(f"{root}/current").agg(F.max("value")).first()[0]
    return spark.read.parquet(f"{root}/version={name}")


#: What is stored of where a corpus comes from.
PROVENANCE = ["name", "revision", "dimensions", "chunker_version", "chunker_digest", "resolution_version", "catalog_sha256"]


def ingest(chunks: DataFrame, vectors: DataFrame, root: str, provenance: dict[str, object], now: Column, key: str = "chunk_id", vector: str = "embedding", expected: int | None = None) -> DataFrame:
    """Replace the corpus under ``root`` by chunks with their vectors, and tell what happened, in one row: ``written, deleted,
    dimensions, vector_bytes, table_bytes, corpus_digest, previous_digest, version, changed, touched``.

    Refused before anything is committed: no chunks, a key that repeats, a chunk without a vector, and vectors of another
    width than ``provenance["dimensions"]``. Rows and provenance become current together, by one entry of the corpus's log, and
    only buckets with a chunk that is new, changed or gone are written (see ``commits.merge``, also for ``expected``). The
    digest is over the buckets' digests, each over its chunks' keys and vectors in key order, so no task sees all.
    """
    from tessera.operators import commits

    spark, root, width = chunks.sparkSession, root.rstrip("/"), int(provenance["dimensions"])
    if missing := [c for c in PROVENANCE if c not in provenance]:
        raise ValueError(f"provenance lacks {missing}")
    joined = unique(chunks, key, what="a chunk twice").join(unique(vectors.select(key, vector), key, what="a vector twice"), key, "left")
    wrong = F.when(F.col(vector).isNull(), F.raise_error(F.concat(F.lit("no vector for "), F.col(key)))).when(F.size(vector) != width, F.raise_error(F.format_string("a vector of width %d for %s", F.size(vector), F.col(key))))
    new = saved(joined.withColumn(vector, F.coalesce(wrong.cast(joined.schema[vector].dataType), F.col(vector))))
    try:
        if new.isEmpty():
            raise ValueError("no chunks")
        before = commits.entry(spark, root)
        facts = {c: provenance[c] for c in PROVENANCE} | {"ingested_at": spark.range(1).select(now.cast("string")).first()[0]}
        by_bucket = lambda rows: corpus_digest(rows, key, vector, commits.BUCKET)
        done = commits.merge(new, root, key, now, complete=True, facts=facts, digest=by_bucket, expected=expected)
    finally:
        forget(new)
    paths = [p["path"] for p in commits.entry(spark, root, done["version"]).parts.values()]
    size = spark.read.format("binaryFile").load(paths).agg(F.sum("length")).first()[0]
    report = [(done["rows"], done["deleted"], width, done["rows"] * width * 4, int(size), done["digest"], before.digest if before else None, done["version"], done["changed"], done["touched"])]
    return spark.createDataFrame(report, "written long, deleted long, dimensions int, vector_bytes long, table_bytes long, corpus_digest string, previous_digest string, version long, changed long, touched long")


def read_provenance(spark, root: str, version: int | None = None):
    """The provenance of the current corpus, or of a version, as a row with ``chunks, corpus_digest, version, ingested_at``; None
    where nothing was ingested."""
    from pyspark.sql import Row

    from tessera.operators import commits

    found = commits.entry(spark, root, version)
    return None if found is None else Row(**found.facts, chunks=found.rows, corpus_digest=found.digest, version=found.version)


def corpus_of(spark, root: str, version: int | None = None) -> DataFrame:
    """The rows of the current corpus, or of a version."""
    from tessera.operators import commits

    return commits.table(spark, root, version)


def verify_corpus(spark, root: str, pins: dict[str, object], key: str = "chunk_id", vector: str = "embedding") -> str | None:
    """The first thing in which the stored corpus isn't what the pins say; None if it is as they say.

    In order: whether there is one; each of PROVENANCE that ``pins`` names; ``chunks``, the live controls of the pinned
    document, if it is named; vectors' widths; and the digests of the stored rows, computed anew, against the entry's.
    """
    from tessera.operators import commits

    found = commits.entry(spark, root)
    if found is None:
        return "nothing was ingested"
    for c in PROVENANCE:
        if c in pins and found.facts.get(c) != pins[c]:
            return f"{c}: {found.facts.get(c)!r}, not {pins[c]!r}"
    if "chunks" in pins and found.rows != pins["chunks"]:
        return f"chunks: {found.rows}, not {pins['chunks']}"
    rows = commits.table(spark, root).withColumn(commits.BUCKET, F.pmod(F.xxhash64(F.col(key)), F.lit(found.width)).cast("int"))
    width = int(found.facts["dimensions"])
    if odd := rows.filter(F.coalesce(F.size(vector) != width, F.lit(True))).select(key).first():
        return f"a vector of another width: {odd[0]}"
    now = {str(r[0]): r[1] for r in corpus_digest(rows, key, vector, commits.BUCKET).collect()}  # one a bucket
    changed = sorted(int(b) for b in now.keys() | found.parts.keys() if now.get(b) != found.parts.get(b, {}).get("digest"))
    return f"other rows than were ingested, in buckets {changed}" if changed else None


def count_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``field, expected, actual`` where two rows of counts differ."""
    cells = lambda d, name: d.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("long").alias(name)) for c in d.columns))).alias("x")).select("x.*")
    return cells(expected, "expected").join(cells(actual, "actual"), "field", "full").filter("not (expected <=> actual)")


#: What a change can invalidate, costliest first: fixed names.
COSTS = ["corpus", "queries", "generation", "judge", "counts"]


def manifest_entries(document: DataFrame, known: list[str]) -> DataFrame:
    """``name, identity, digest, invalidates`` of a manifest ``document`` (VARIANT), whose entries must be the known names and
    may only invalidate what COSTS has."""
    entries = document.select(F.explode(F.expr("try_variant_get(document, '$.entries', 'map<string, variant>')")).alias("name", "e"))
    get = lambda p, t: F.expr(f"try_variant_get(e, '$.{p}', '{t}')")
    kinds = F.coalesce(get("invalidates", "array<string>"), F.array().cast("array<string>"))
    odd = F.array_except(kinds, F.array(*map(F.lit, COSTS)))
    checked = F.when(F.size(odd) > 0, F.raise_error(F.concat(F.lit("no such cost: "), F.array_join(odd, ", ")))).otherwise(kinds)
    rows = entries.select("name", get("identity", "string").alias("identity"), get("digest", "string").alias("digest"), checked.alias("invalidates"))
    names = document.sparkSession.createDataFrame([(n, True) for n in known], "name string, known boolean")
    both = rows.withColumn("listed", F.lit(True)).join(names, "name", "full")
    wrong = F.when(F.col("known").isNull(), F.concat(F.lit("an entry that nothing computes: "), F.col("name"))).when(F.col("listed").isNull(), F.concat(F.lit("an input without an entry: "), F.col("name")))
    return both.withColumn("name", F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(F.col("name"))).select("name", "identity", "digest", "invalidates")


def compare_manifest(entries: DataFrame, observed: DataFrame) -> DataFrame:
    """``name, state, rank, kinds`` of mismatches: entries(name, identity, digest, invalidates), observed(name, identity,
    digest). The costliest go first: the lowest rank of what they invalidate, then the most kinds, then the name. An entry
    that isn't observed fails the query."""
    seen = observed.select("name", F.col("identity").alias("seen_identity"), F.col("digest").alias("seen_digest"), F.lit(True).alias("seen"))
    joined = unique(entries, "name").join(unique(seen, "name"), "name", "left")
    checked = joined.withColumn("name", F.when(F.col("seen").isNull(), F.raise_error(F.concat(F.lit("not observed: "), F.col("name")))).otherwise(F.col("name")))
    state = (
        F.when(F.col("digest").isNull() & F.col("seen_digest").isNotNull(), "appeared")
        .when(F.col("digest").isNotNull() & F.col("seen_digest").isNull(), "gone")
        .when(~F.col("identity").eqNullSafe(F.col("seen_identity")), "identity")
        .when(~F.col("digest").eqNullSafe(F.col("seen_digest")), "digest")
    )
    ranks = F.transform("invalidates", lambda x: F.array_position(F.lit(COSTS), x).cast("int"))
    cheapest = F.coalesce(F.array_min(F.filter(ranks, lambda x: x > 0)) - 1, F.lit(len(COSTS)))
    found = checked.withColumn("state", state).filter("state is not null").select("name", "state", cheapest.alias("rank"), F.size("invalidates").alias("kinds"))
    return found.orderBy("rank", F.desc("kinds"), "name")


def check_manifest(entries: DataFrame, observed: DataFrame) -> None:
    """Fails with the costliest mismatch, if there is one."""
    if worst := compare_manifest(entries, observed).first():
        raise ValueError(f"{worst['name']}: {worst['state']}")


def ledger_drift(scripts: DataFrame, ledger: DataFrame) -> DataFrame:
    """``version, state``: pending, changed or ahead; scripts(version, checksum), ledger(version, checksum)."""
    joined = scripts.select("version", F.col("checksum").alias("want")).join(ledger.select("version", F.col("checksum").alias("have")), "version", "full")
    state = F.when(F.col("have").isNull(), "pending").when(F.col("want").isNull(), "ahead").when(F.col("want") != F.col("have"), "changed")
    return joined.withColumn("state", state).filter("state is not null").select("version", "state")


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that isn't true; null if all are."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return out


def _streamed(names: list[str], numbered: bool = True):
    """From rows ``group, body`` in order, the SHA-256 of each group's bodies, each after its position if ``numbered``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nth, digest, out = None, 0, None, []
        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if digest is None or name != held:
                    if digest is not None:
                        out.append((held, digest.hexdigest()))
                    held, nth, digest = name, 0, sha256()
                digest.update((str(nth).encode() if numbered else b"") + body)
                nth += 1
        if digest is not None:
            out.append((held, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], names=names)

    return run


def _fields(fields: list[str]) -> Column:
    return F.concat(*(x for f in fields for x in (F.lit("\x1f"), F.coalesce(F.col(f).cast("string"), F.lit("")))), F.lit("\x1e")).cast("binary")


def ordered_digest(rows: DataFrame, order: list[str], fields: list[str], group: str) -> DataFrame:
    """``group, digest``: SHA-256 over each group's rows in order: the position, then each field after 0x1F, then 0x1E.

    A digest of a sequence can't be split, so a group is one task's stream; none is held in memory. For groups of many rows
    there is ``ranged_digest``. A null field is empty.
    """
    named = rows.withColumn("__group", F.col(group).cast("string")).repartition("__group").sortWithinPartitions("__group", *order)
    return named.select("__group", _fields(fields).alias("body")).mapInArrow(_streamed([group, "digest"]), f"`{group}` string, digest string")


def ranged_digest(rows: DataFrame, order: str, fields: list[str], group: str, size: int) -> DataFrame:
    """``group, ranges, digest``: a digest of digests, for groups of any size: ``order`` is a whole number, each range of ``size``
    of its values is digested by itself, as in ``ordered_digest``, and the group's digest is over each range's number, after
    0x1F, and digest, after 0x1F, then 0x1E, in order. Ranges without rows don't count."""
    cut = rows.withColumn("__range", F.floor(F.col(order) / size).cast("long"))
    named = cut.withColumn("__group", F.concat_ws("\x1f", F.col(group).cast("string"), F.col("__range").cast("string")))
    each = named.repartition("__group").sortWithinPartitions("__group", order).select("__group", _fields(fields).alias("body"))
    parts = each.mapInArrow(_streamed(["__group", "digest"]), "__group string, digest string")
    parts = parts.select(F.substring_index("__group", "\x1f", 1).alias(group), F.substring_index("__group", "\x1f", -1).cast("long").alias("n"), "digest")
    listed = F.array_sort(F.collect_list(F.struct("n", "digest")))
    body = F.array_join(F.transform(listed, lambda x: F.concat(F.lit("\x1f"), x["n"].cast("string"), F.lit("\x1f"), x["digest"], F.lit("\x1e"))), "")
    return parts.groupBy(group).agg(F.count("*").alias("ranges"), F.sha2(body, 256).alias("digest"))


def corpus_digest(rows: DataFrame, key: str = "chunk_id", vector: str = "embedding", group: str | None = None) -> DataFrame:
    """``group, digest``: SHA-256 over keys and vectors in key order: the key, 0x1F, the vector's little-endian float32 bytes,
    0x1E. Without a group there is one, ``all``; a group is one task's stream."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = [str(k).encode() + b"\x1f" + np.asarray(v, dtype="<f4").tobytes() + b"\x1e" for k, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bodies, pa.binary())], names=["__group", "body"])

    named = rows.select((F.col(group).cast("string") if group else F.lit("all")).alias("__group"), F.col(key).alias("__key"), vector)
    ordered = named.repartition("__group").sortWithinPartitions("__group", "__key").mapInArrow(packed, "__group string, body binary")
    return ordered.mapInArrow(_streamed([group or "group", "digest"], False), f"`{group or 'group'}` string, digest string")


def nearest_rank(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``group, n, largest`` and a column for each share: the value at place min(n-1, floor(n*share)), from 0.

    Rows are counted by value first, so a task holds the distinct values of a group, not its rows; nulls don't count.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("here"))
    upto, whole = Window.partitionBy(group).orderBy(value), Window.partitionBy(group)
    summed = counted.select(group, value, F.sum("here").over(upto).alias("upto"), F.sum("here").over(whole).alias("n"))
    at = lambda s: F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(s)))
    return summed.groupBy(group).agg(F.max("n").alias("n"), F.max(value).alias("largest"), *(F.min(F.when(F.col("upto") > at(s), F.col(value))).alias(c) for c, s in shares.items()))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def stored_bytes(spark, path: str) -> DataFrame:
    """``files, bytes`` of a table's files."""
    return spark.read.format("binaryFile").load(path).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def schema_health(ledger: DataFrame, expected: int) -> DataFrame:
    """``healthy, expected, applied``: whether the ledger's newest version is the one this build expects; an empty ledger has none."""
    return ledger.agg(F.max("version").alias("applied")).select((F.col("applied").eqNullSafe(F.lit(expected))).alias("healthy"), F.lit(expected).alias("expected"), "applied")
