"""A keyed table that changes by commits: files in buckets of the key's hash, and a log of numbered entries.

An entry names all that a version is: the folder, row count and digest of each bucket, and facts about the whole (where it comes
from). It is added under the next number, whole and only if nothing is there, so that a reader between any two steps of a writer
sees one version, with its facts, and of two writers that start from one version one wins; the other starts again from the
winner's version or, if it named the version that it builds on, is refused.

A merge writes the buckets that hold a row which is new, changed or gone, and no others: what is written follows the change and not
the table. Of the table, it reads keys and row digests.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from hashlib import sha256

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.maintenance import unique
from tessera.storage import forget, place_of, saved

BUCKET, DIGEST = "__bucket", "__digest"


class Conflict(RuntimeError):
    """Another writer's commit came first."""


@dataclass(frozen=True)
class Entry:
    """One version of a table; ``parts`` has for each bucket that isn't empty its path, rows and digest."""

    version: int
    key: str
    width: int
    schema: dict
    parts: dict[str, dict] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)
    tags: dict[str, int] = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(p["rows"] for p in self.parts.values())

    @property
    def digest(self) -> str:
        """SHA-256 over each bucket's number, 0x1F, digest, 0x1E, in order: of the same rows in as many buckets always the same."""
        return sha256("".join(f"{b}\x1f{self.parts[b]['digest']}\x1e" for b in sorted(self.parts, key=int)).encode()).hexdigest()


def _entry_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/_log/{version:020d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions in the log, ascending."""
    fs, place = place_of(spark, f"{root.rstrip('/')}/_log")
    names = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def entry(spark: SparkSession, root: str, version: int | None = None) -> Entry | None:
    """The entry of a version, or of the newest; None where nothing was committed."""
    if version is None:
        known = versions(spark, root)
        if not known:
            return None
        version = known[-1]
    fs, place = place_of(spark, _entry_path(root, version))
    stream = fs.open(place)
    try:
        return Entry(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def _added(spark: SparkSession, path: str, text: str) -> bool:
    """Whether the file was added; False if there is one already. It appears whole or not at all.

    On a local disk that is a hard link, which never replaces; elsewhere a rename, which doesn't either on a Hadoop file system. A
    store whose renames replace needs another way.
    """
    fs, place = place_of(spark, path)
    _, temp = place_of(spark, f"{place.getParent()}/.{uuid.uuid4().hex}.tmp")
    out = fs.create(temp, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() != "file":
            return not fs.exists(place) and fs.rename(temp, place)
        local = lambda p: spark._jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri())
        spark._jvm.java.nio.file.Files.createLink(local(place), local(temp))
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise
    finally:
        if fs.exists(temp):
            fs.delete(temp, False)


def _read(spark: SparkSession, found: Entry, buckets: set[str] | None = None) -> DataFrame:
    paths = [p["path"] for b, p in found.parts.items() if buckets is None or b in buckets]
    schema = StructType.fromJson(found.schema)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def table(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version, or of the newest."""
    found = entry(spark, root, version)
    if found is None:
        raise ValueError(f"nothing was committed under {root}")
    return _read(spark, found).drop(DIGEST)


def merge(
    rows: DataFrame, root: str, key: str, now: Column, *, complete: bool = False, deletes: DataFrame | None = None, newer: str | None = None, created: str = "created_at", buckets: int = 64, facts: dict | None = None,
    tag: tuple[str, int] | None = None, digest: Callable[[DataFrame], DataFrame] | None = None, expected: int | None = None, attempts: int = 5,
) -> dict:
    """Put ``rows`` into the table under ``root`` by ``key``, in one commit, and tell what happened: ``version, inserted, changed,
    deleted, unchanged, touched`` (buckets written), ``rows`` and ``digest`` of the whole.

    ``created`` is when a key was first written, and stays. If ``complete``, keys that aren't in ``rows`` go; else those of
    ``deletes`` do. With ``newer``, a row whose value there is below the stored one's changes nothing. ``tag`` is a source's name and
    the number of its batch: a batch that was committed already isn't applied again. ``facts`` are stored in the entry. ``digest``
    makes of rows with ``__bucket`` the table ``__bucket, digest`` that is kept with each bucket that is written; the default is
    over row digests by key. ``buckets`` counts for a new table.

    Refused: a null key, one that stands twice, and other columns than the table's unless ``complete``. Repeated after a lost race up to ``attempts``
    times, unless ``expected`` names the version to build on (0: none), which is then refused as ``Conflict``.
    """
    spark, root = rows.sparkSession, root.rstrip("/")
    named = F.when(F.col(key).isNotNull(), F.col(key)).otherwise(F.raise_error(F.lit("a null key")))
    sound = unique(rows.withColumn(key, named), key, what="a key twice")
    columns = [c for c in rows.columns if c != created]
    mine = saved(sound.select(*columns, F.sha2(F.to_json(F.struct(*sorted(columns))), 256).alias(DIGEST)))
    try:
        for _ in range(attempts):
            base = entry(spark, root)
            at = base.version if base else 0
            if expected is not None and at != expected:
                raise Conflict(f"version {at} is there, not {expected}")
            if base and tag and base.tags.get(tag[0], -1) >= tag[1]:
                return _report(base, {})
            made, told = _merged(mine, base, root, key, columns, now, complete, deletes, newer, created, buckets, facts, tag, digest)
            if _added(spark, _entry_path(root, made.version), json.dumps(made.__dict__)):
                return _report(made, told)
            if expected is not None:
                break
        raise Conflict(f"another writer committed version {made.version}")
    finally:
        forget(mine)


def _report(found: Entry, told: dict) -> dict:
    counts = {c: sum(t.get(c, 0) for t in told.values()) for c in ("inserted", "changed", "deleted")}
    return {"version": found.version, **counts, "unchanged": found.rows - counts["inserted"] - counts["changed"], "touched": len(told), "rows": found.rows, "digest": found.digest}


def _merged(mine, base, root, key, columns, now, complete, deletes, newer, created, buckets, facts, tag, digest):
    spark, width = mine.sparkSession, base.width if base else buckets
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(width)).cast("int")
    mine = mine.withColumn(BUCKET, bucket)
    stored = [*columns, created, DIGEST]
    if base:
        if base.key != key:
            raise ValueError(f"the table's key is {base.key}")
        old = _read(spark, base)
        if not complete and set(old.columns) != set(stored):
            raise ValueError(f"the table has the columns {old.columns}")
    else:
        old = mine.withColumn(created, now).select(*stored).limit(0)
    gone = deletes.select(key).distinct() if deletes is not None else mine.select(key).limit(0)
    if not complete and base:  # only buckets that a change can be in
        may = {str(r[0]) for r in mine.select(BUCKET).union(gone.select(bucket)).distinct().collect()}  # numbers of buckets
        old = _read(spark, base, may)
    if newer and newer in old.columns:
        late = old.select(key, F.col(newer).alias("__newer"))
        mine = mine.join(late, key, "left").filter(F.coalesce(F.col("__newer") <= F.col(newer), F.lit(True))).drop("__newer")

    was, is_ = old.select(key, F.col(DIGEST).alias("__was")), mine.select(key, F.col(DIGEST).alias("__is"))
    both = was.join(is_, key, "full").join(gone.withColumn("__gone", F.lit(True)), key, "left")
    leaves = F.col("__was").isNotNull() & (F.lit(complete) & F.col("__is").isNull() | F.col("__gone").isNotNull() & F.col("__is").isNull())
    what = F.when(F.col("__was").isNull() & F.col("__is").isNotNull(), "inserted").when(leaves, "deleted").when(F.col("__was") != F.col("__is"), "changed")
    told: dict[str, dict] = {}
    for r in both.select(bucket.alias(BUCKET), what.alias("what")).filter("what is not null").groupBy(BUCKET, "what").count().collect():  # three a bucket
        told.setdefault(str(r[BUCKET]), {})[r["what"]] = r["count"]

    parts = {b: p for b, p in base.parts.items() if b not in told} if base else {}
    if told:
        touched = F.col(BUCKET).isin(*map(int, told))
        before = _read(spark, base, set(told)) if base else old
        first = before.select(key, F.col(created).alias("__first")) if created in before.columns else before.select(key, F.lit(None).cast("timestamp").alias("__first"))
        fresh = mine.filter(touched).join(first, key, "left").withColumn(created, F.coalesce("__first", now))
        whole = fresh.select(*stored)
        if not complete:
            whole = whole.unionByName(before.join(mine.select(key), key, "left_anti").join(gone, key, "left_anti").select(*stored))
        path = f"{root}/data/{uuid.uuid4().hex}"
        dealt = whole.withColumn(BUCKET, bucket).repartition(len(told), BUCKET).sortWithinPartitions(BUCKET, key)
        dealt.write.option("compression", "zstd").partitionBy(BUCKET).parquet(path)
        written = spark.read.schema(StructType([*whole.schema.fields, dealt.schema[BUCKET]])).parquet(path)
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, DIGEST))), lambda x: x[DIGEST]), "\x1e")
        digests = digest(written) if digest else written.groupBy(BUCKET).agg(F.sha2(listed, 256).alias("digest"))
        counts = written.groupBy(BUCKET).agg(F.count("*").alias("rows"))
        for r in counts.join(digests.select(F.col(BUCKET).cast("int").alias(BUCKET), "digest"), BUCKET).collect():  # one a bucket
            parts[str(r[BUCKET])] = {"path": f"{path}/{BUCKET}={r[BUCKET]}", "rows": r["rows"], "digest": r["digest"]}
        schema = whole.schema.jsonValue()
    else:
        schema = base.schema if base else old.schema.jsonValue()
    tags = (base.tags if base else {}) | ({tag[0]: tag[1]} if tag else {})
    return Entry((base.version if base else 0) + 1, key, width, schema, parts, facts if facts is not None else base.facts if base else {}, tags), told


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Remove entries but the last ``keep``, and folders of rows that no entry left names; tells how many folders went.

    What a writer is about to commit is named by no entry yet, so this isn't to run next to one.
    """
    known = versions(spark, root)
    for v in known[:-keep]:
        fs, place = place_of(spark, _entry_path(root, v))
        fs.delete(place, False)
    named = {p["path"] for v in known[-keep:] for p in entry(spark, root, v).parts.values()}
    fs, place = place_of(spark, f"{root.rstrip('/')}/data")
    gone = 0
    for batch in fs.listStatus(place) if fs.exists(place) else []:
        for part in fs.listStatus(batch.getPath()):
            if part.isDirectory() and not any(p.endswith(f"/{batch.getPath().getName()}/{part.getPath().getName()}") for p in named):
                gone += fs.delete(part.getPath(), True)
        if not any(x.isDirectory() for x in fs.listStatus(batch.getPath())):
            fs.delete(batch.getPath(), True)
    return gone
