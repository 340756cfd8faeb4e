"""What the operators of this package share: shuffle width, saved tables (see ``tessera.storage``), batch sizes and the tables they read."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ARROW_BYTES, ARROW_ROWS, long_rows  # noqa: F401 - what the operators use
from tessera.storage import forget, forget_path, saved, shared_folder, sweep, tracked  # noqa: F401 - what the operators use


def width(spark: SparkSession) -> int:
    """The session's shuffle width; operators that need an explicit count use this, so it is sized once for a cluster."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that the operators read, under fixed names, whatever else the table holds: ``doc_id long, data
    binary``, the text in UTF-8; a null text is empty."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("data"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str | Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text is divisible by five. Without an id: false."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def batch(rows: Sequence[tuple], fields: Sequence[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


SQL_TYPES = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean", pa.float64(): "double"}


def schema_of(fields: Sequence[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"{n} {f'array<{SQL_TYPES[t.value_type]}>' if pa.types.is_list(t) else SQL_TYPES[t]}" for n, t in fields)
