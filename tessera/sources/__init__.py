"""Readers: whole JSON documents, JSON lines, file digests, numbered scripts."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import checksum
from tessera.sources.npy import file_system


def whole_json(spark: SparkSession, path: str) -> DataFrame:
    """``path, document`` (VARIANT); text that isn't JSON fails the query."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.parse_json("value").alias("document"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


#: Bytes of a file that are read at a time.
BLOCK = 1 << 20


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for path in b.column(0).to_pylist():
            digest = sha256()
            system, place = file_system(path)
            with system.open_input_stream(place) as f:
                while block := f.read(BLOCK):
                    digest.update(block)
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["path", "size", "sha256"])


#: Schemes of file systems that a worker opens itself.
STREAMED = ("file", "s3", "s3a", "gs", "abfs", "abfss")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, size, sha256`` of each file, bytes as they are, of files of any size.

    Spark lists the files, and each is opened in a task and read a block at a time. On a file system that only Spark's readers
    know, a file is one row of its bytes instead, so that one of 2 GB or more fails there. Spark lists no empty files.
    """
    listed = spark.read.format("binaryFile").load(path)
    first = listed.select("path").first()
    if first is not None and urlparse(first["path"]).scheme in STREAMED:
        return listed.select("path", F.col("length").alias("size")).mapInArrow(_hashed, "path string, size long, sha256 string")
    return listed.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def scripts(spark: SparkSession, folder: str) -> DataFrame:
    """``version, name, sql, checksum`` of files named ``<number>_<name>.sql``; versions must run on from 1."""
    read = spark.read.text(folder, wholetext=True, pathGlobFilter="*.sql").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("sql"))
    pattern = r"^(\d+)_(\w+)\.sql$"
    named = read.select(F.when(F.col("file").rlike(pattern), F.regexp_extract("file", pattern, 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("not a numbered script: "), F.col("file")))).alias("version"), F.regexp_extract("file", pattern, 2).alias("name"), "sql", checksum(F.col("sql")).alias("checksum"))
    last = named.agg(F.max("version").alias("last"), F.count_distinct("version").alias("n"), F.count("*").alias("rows"))
    checked = named.crossJoin(F.broadcast(last))  # one row
    return checked.withColumn("version", F.when((F.col("last") == F.col("n")) & (F.col("n") == F.col("rows")), F.col("version")).otherwise(F.raise_error(F.lit("versions must run on from 1")))).drop("last", "n", "rows")
