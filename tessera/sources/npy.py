"""Matrices of float32 in NumPy's ``.npy`` format as tables ``row, vector``, read by byte ranges and written in shards.

A path is one ``.npy`` file, or a folder that ``write_npy`` made: shards of neighbouring rows and an index that names them. The
index is written when all shards are there, so a folder without one holds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a partition, of a batch, and of a shard that a writer holds before it is written.
RANGE, BATCH, SHARD = 64 << 20, 4 << 20, 64 << 20
INDEX = "_index.json"
SCHEMA = "row long, vector array<float>"


def file_system(path: str):
    """The file system that a path is on, and the path in it, for code that runs without the JVM."""
    from pyarrow import fs

    if "://" not in path or path.startswith("file:"):
        return fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _header(f, path: str) -> tuple[int, int, int]:
    """Rows, width and where the data begins; anything but a readable matrix of float32 by rows is refused."""
    try:
        version = np.lib.format.read_magic(f)
        shape, by_columns, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    except ValueError as e:
        raise ValueError(f"{path} isn't a readable array: {e}") from e
    if kind != np.dtype("<f4"):
        raise ValueError(f"{path} holds {kind} numbers, not float32")
    if len(shape) != 2 or by_columns:
        raise ValueError(f"{path} isn't a matrix by rows: {shape}")
    return *shape, f.tell()


@dataclass
class _Range(InputPartition):
    path: str
    offset: int
    first: int
    rows: int
    width: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def _files(self) -> list[tuple[str, int]]:
        """Files with their first row."""
        from pyarrow import fs

        system, place = file_system(self.path)
        kind = system.get_file_info(place).type
        if kind == fs.FileType.NotFound:
            raise ValueError(f"no vectors at {self.path}")
        if kind == fs.FileType.File:
            return [(place, 0)]
        try:
            with system.open_input_stream(f"{place}/{INDEX}") as f:
                return [(f"{place}/{s['file']}", s["first"]) for s in json.loads(f.read())["shards"]]
        except FileNotFoundError as e:
            raise ValueError(f"no vectors at {self.path}") from e

    def partitions(self) -> list[_Range]:
        system, _ = file_system(self.path)
        out = []
        for path, first in self._files():
            with system.open_input_file(path) as f:
                rows, width, offset = _header(f, path)
                if f.size() != offset + 4 * rows * width:
                    raise ValueError(f"{path} isn't a readable array: {f.size()} bytes")
            step = max(1, self.size // max(1, 4 * width))
            out += [_Range(path, offset + 4 * width * at, first + at, min(step, rows - at), width) for at in range(0, rows, step)]
        return out or [_Range("", 0, 0, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        system, _ = file_system(self.path)
        step = max(1, BATCH // max(1, 4 * part.width))
        with system.open_input_file(part.path) as f:
            f.seek(part.offset)
            for at in range(0, part.rows, step):
                n = min(step, part.rows - at)
                flat = pa.array(np.frombuffer(f.read(4 * n * part.width), dtype="<f4"))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part.width), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int64) + part.first + at), vectors], names=["row", "vector"])


@dataclass
class _Written(WriterCommitMessage):
    shards: list[dict]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, width: int, attempt: str):
        self.path, self.width, self.attempt = path, width, attempt

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        system, place = file_system(self.path)
        system.create_dir(place, recursive=True)
        held: list[np.ndarray] = []
        first, size, shards = None, 0, []

        def flush() -> None:
            nonlocal held, first, size
            if first is not None:
                x = np.concatenate(held).astype("<f4", copy=False)
                name = f"{self.attempt}-{uuid.uuid4().hex}.npy"
                with system.open_output_stream(f"{place}/{name}") as f:
                    np.lib.format.write_array(f, x, version=(1, 0), allow_pickle=False)
                shards.append({"file": name, "first": first, "rows": len(x)})
            held, first, size = [], None, 0

        for b in batches:
            rows, vectors = b.column(0).to_numpy(), b.column(1)
            if vectors.null_count or (b.num_rows and set(np.unique(vectors.value_lengths().to_numpy())) != {self.width}):
                raise ValueError(f"a vector that isn't of {self.width} numbers")
            x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, self.width)
            # shards hold rows that follow each other
            for some in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows) != 1) + 1):
                if len(some):
                    if first is not None and rows[some[0]] != first + sum(map(len, held)):
                        flush()
                    first = int(rows[some[0]]) if first is None else first
                    held.append(x[some])
                    size += x[some].nbytes
                    if size >= SHARD:
                        flush()
        flush()
        return _Written(shards)

    def commit(self, messages: list) -> None:
        shards = sorted((s for m in messages if m for s in m.shards), key=lambda s: s["first"])
        at = 0
        for s in shards:
            if s["first"] != at:
                self.abort(messages)
                raise ValueError(f"rows don't run on from 0: {s['first']} after {at - 1}")
            at += s["rows"]
        system, place = file_system(self.path)
        with system.open_output_stream(f"{place}/.{INDEX}") as f:
            f.write(json.dumps({"rows": at, "width": self.width, "shards": shards}).encode())
        system.move(f"{place}/.{INDEX}", f"{place}/{INDEX}")

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, place = file_system(self.path)
        for f in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
            if f.base_name.startswith(self.attempt):
                system.delete_file(f.path)


class NpyVectors(DataSource):
    """``spark.read.format("npy").load(path)``; ``range`` is the bytes of a partition. See ``read_npy`` and ``write_npy``."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("range", RANGE)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options["width"]), self.options["attempt"])


def read_npy(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """``row, vector`` of a matrix, each bit as stored. What isn't a readable matrix of float32 fails."""
    spark.dataSource.register(NpyVectors)
    return spark.read.format("npy").option("range", str(range_bytes)).load(path)


def write_npy(vectors: DataFrame, path: str, width: int) -> None:
    """Write ``row, vector`` to a folder. Rows must run on from 0, each vector have ``width`` numbers; else nothing is committed."""
    spark = vectors.sparkSession
    spark.dataSource.register(NpyVectors)
    rows = vectors.select(F.col("row").cast("long").alias("row"), F.col("vector").cast("array<float>").alias("vector"))
    ordered = rows.repartitionByRange("row").sortWithinPartitions("row")
    ordered.write.format("npy").mode("append").option("width", str(width)).option("attempt", uuid.uuid4().hex).save(path)
