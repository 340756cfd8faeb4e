"""Tables that cut a plan's lineage: written to the folder that all executors share, and removed when no plan reads them."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; where it names none, as in tests, one beside the warehouse.

    A warehouse on a local disk is refused unless all executors run in this process: other machines wouldn't find it.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    master = spark.sparkContext.master
    if urlparse(warehouse).scheme in ("", "file") and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no shared folder, and the warehouse is a local one")
    return f"{warehouse}/tessera-saved"


def saved(df: DataFrame, distinct: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Cut the lineage: write the rows to a table of their own in the shared folder and read them again.

    The table outlives any executor, and the shuffles that made it are given back as soon as it is written. Columns named as
    ``distinct`` have few repeats, so no dictionaries are tried for them; ``by`` partitions the table.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").options(**{f"parquet.enable.dictionary#{c}": "false" for c in distinct}).partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = tracked(spark, path, out)
    return out


#: Folders that are to be removed, each with a weak reference to the relation that reads it, and whose they are.
_TRACKED: dict[str, tuple[SparkSession, object]] = {}


def place_of(spark: SparkSession, path: str):
    """The file system that a path is on, and the path in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def tracked(spark: SparkSession, path: str, reader: DataFrame | None = None) -> str:
    """The path, which is removed when nothing can read it any more.

    That is when the driver has let go of the relation that ``reader`` reads it by, which every plan made of it holds, and at the
    latest when the session's JVM ends. Without a reader it is the end of the JVM, or ``forget_path``. What has been let go since
    is removed on the way.
    """
    fs, place = place_of(spark, path)
    fs.deleteOnExit(place)
    sweep(spark)
    if reader is not None:
        relation = reader._jdf.queryExecution().analyzed().relation()
        _TRACKED[path] = (spark, spark._jvm.java.lang.ref.WeakReference(relation))
    return path


def sweep(spark: SparkSession) -> None:
    """Remove the saved tables of this session that no plan reads any more."""
    for path, (owner, reference) in list(_TRACKED.items()):
        if owner is not spark:
            if owner.sparkContext._jsc is None:  # it has ended, and its tables with it
                del _TRACKED[path]
        elif reference.refersTo(None):
            forget_path(spark, path)


def forget_path(spark: SparkSession, path: str) -> None:
    _TRACKED.pop(path, None)
    fs, place = place_of(spark, path)
    fs.delete(place, True)
    fs.cancelDeleteOnExit(place)


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``saved`` made and that nothing is still to be computed from."""
    for df in tables:
        forget_path(df.sparkSession, df._saved_at)
