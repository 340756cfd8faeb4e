"""Embedding whitening by merging singular value decompositions up a tree.

A partition of the vectors is summed up by how many there are, their exact sums, and the singular values and right vectors of
its centred rows, all dimensions of them. Two summaries merge by stacking both sides' scaled vectors and one row more, which
corrects for the difference of the means, and decomposing the stack again. The centred rows' products are kept to double
precision by that, so nothing is lost, whatever the order, and no covariance of uncentred numbers is ever formed.

A summary has a fixed size (dimensions squared), ``FAN`` of them meet in a task, and the last one goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components that are reported, summaries that a task merges, and rows that are decomposed at a time.
COMPONENTS, FAN, ROWS = 32, 16, 2048
#: An eigenvalue below this share of the largest is zero: so much comes of rounding.
TINY = 1e-13


def whole(c: Column) -> Column:
    """An entry as a whole number: floor(64 c) + 1,000,000."""
    return F.floor(64 * c.cast("double")).cast("long") + F.lit(1_000_000).cast("long")


def usable(v: Column) -> Column:
    """Whether the vector is there and all its entries are finite numbers."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))), F.lit(False))


@dataclass(frozen=True)
class Summary:
    """Of n rows: their exact sums, and the singular values and right vectors (as rows) of the rows less their mean."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Summary:
        """Of whole numbers; rows are centred exactly, times n, before anything is rounded."""
        n, sums = len(rows), rows.sum(axis=0)
        return Summary(n, sums.tolist(), *_decomposed((rows * n - sums).astype(np.float64) / n))

    def merge(self, other: Summary) -> Summary:
        n, m = self.n, other.n
        apart = np.array([(a * m - b * n) / (n * m) for a, b in zip(self.sums, other.sums, strict=True)])
        stack = np.vstack([self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, np.sqrt(n * m / (n + m)) * apart])
        return Summary(n + m, [a + b for a, b in zip(self.sums, other.sums, strict=True)], *_decomposed(stack))

    def packed(self) -> dict:
        return {"n": self.n, "sums": [str(x) for x in self.sums], "singular": self.values.tolist(), "vectors": self.vectors.ravel().tolist()}

    @staticmethod
    def read(n: int, sums, singular, vectors) -> Summary:
        values = np.asarray(singular, dtype=np.float64)
        return Summary(int(n), [int(x) for x in sums], values, np.asarray(vectors, dtype=np.float64).reshape(len(values), len(values)))


def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All singular values and right vectors; as many as there are dimensions, with zeros where there are fewer rows."""
    if not (d := rows.shape[1]):
        return np.zeros(0), np.zeros((0, 0))
    if len(rows) > d:
        rows = np.linalg.qr(rows, mode="r")
    else:
        rows = np.vstack([rows, np.zeros((d - len(rows), d))])
    _, values, vectors = np.linalg.svd(rows)
    return values, vectors


_SUMMARY = "slot long, n long, sums array<string>, singular array<double>, vectors array<double>"


def _vectors_of(b: pa.RecordBatch, at: int) -> np.ndarray:
    """A column of vectors as a matrix; vectors of two widths are refused."""
    lengths = np.unique(b.column(at).value_lengths().to_numpy())
    if len(lengths) > 1:
        raise ValueError(f"vectors of {lengths[0]} and of {lengths[-1]} entries")
    return b.column(at).flatten().to_numpy().reshape(b.num_rows, int(lengths[0]))


def summary_of(vectors: DataFrame) -> Summary | None:
    """The summary of a column ``x array<long>``; None of no rows. Vectors of different widths are refused."""

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: Summary | None = None
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                rows = _vectors_of(b.slice(at, ROWS), 0)
                if held is not None and rows.shape[1] != len(held.sums):
                    raise ValueError(f"vectors of {len(held.sums)} and of {rows.shape[1]} entries")
                held = Summary.of(rows) if held is None else held.merge(Summary.of(rows))
        if held is not None:
            row = {"slot": TaskContext.get().partitionId(), **held.packed()}
            yield pa.RecordBatch.from_pydict({c: pa.array([v], _ARROW[c]) for c, v in row.items()})

    def together(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("slot")
        parts = [Summary.read(r.n, r.sums, r.singular, r.vectors) for r in some.itertuples()]
        if len({len(p.sums) for p in parts}) > 1:
            raise ValueError(f"vectors of {min(len(p.sums) for p in parts)} and of {max(len(p.sums) for p in parts)} entries")
        return pd.DataFrame([{"slot": key[0], **reduce(Summary.merge, parts).packed()}])

    level, left = vectors.select("x").mapInArrow(partly, _SUMMARY), vectors.rdd.getNumPartitions()
    while left > 1:
        level, left = level.groupBy(F.floor(F.col("slot") / FAN).alias("slot_")).applyInPandas(together, _SUMMARY), -(-left // FAN)
    found = level.collect()  # one row, or none
    return Summary.read(*found[0][1:]) if found else None


_ARROW = {"slot": pa.int64(), "n": pa.int64(), "sums": pa.list_(pa.string()), "singular": pa.list_(pa.float64()), "vectors": pa.list_(pa.float64())}


@dataclass(frozen=True)
class Whitening:
    """Components (as rows) and eigenvalues of the covariance, the largest first, with the fit's count, sums and trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @staticmethod
    def of(summary: Summary, most: int | None = None) -> Whitening:
        """``most`` components, or all. Each has its largest entry positive, so that its sign doesn't depend on the order."""
        values = summary.values**2 / summary.n
        order = np.argsort(-values, kind="stable")[:most]
        components = summary.vectors[order]
        largest = np.abs(components).argmax(axis=1)
        components = components * np.where(components[np.arange(len(order)), largest] < 0, -1.0, 1.0)[:, None]
        e = np.where(values[order] > TINY * values.max(initial=0.0), values[order], 0.0)
        return Whitening(summary.n, summary.sums, components, e, float(values.sum()))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        top = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if top >= 1 << 63:
            return x.astype(object) * self.n - np.array(self.sums, dtype=object)
        return x * self.n - np.array(self.sums, dtype=np.int64)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows. A component without variance, of which nothing can be made, gives 0."""
        scale = np.divide(1.0, np.sqrt(self.eigenvalues), out=np.zeros_like(self.eigenvalues), where=self.eigenvalues > 0)
        return (self.centred(x).astype(np.float64) / self.n) @ self.components.T * scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum of squares of n x - S for each row, exactly; one beyond a long is refused."""
        c = self.centred(x)
        top = int(np.abs(c).max(initial=0))
        if top * top * max(1, c.shape[1]) >= 1 << 63:
            c = c.astype(object)
        out = (c * c).sum(axis=1).tolist()
        if out and max(out) >= 1 << 63:
            raise OverflowError("a squared deviation beyond 64 bits")
        return out


def fit(vectors: DataFrame, components: int | None = COMPONENTS) -> Whitening | None:
    """The whitening of ``x array<long>``; None if there are no rows or no dimensions."""
    summary = summary_of(vectors)
    return Whitening.of(summary, components) if summary is not None and summary.sums else None


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened rows less the identity, over components with variance.

    Sums and products of a partition's whitened rows, which are centred and of size 1, meet by entry; at most components
    squared of them reach the driver.
    """
    used = np.flatnonzero(w.eigenvalues > 0)
    if not len(used):
        return 0.0

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(used) + 1, len(used)))
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                y = w.apply(_vectors_of(b.slice(at, ROWS), 0))[:, used]
                total += np.vstack([y.T @ y, y.sum(axis=0)])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int64()), pa.array(j.ravel(), pa.int64()), pa.array(total.ravel())], names=["i", "j", "total"])

    total = np.zeros((len(used) + 1, len(used)))
    for r in vectors.select("x").mapInArrow(partly, "i long, j long, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        total[r.i, r.j] = r.total
    mean = total[-1] / w.n
    return float(np.abs(total[:-1] / w.n - np.outer(mean, mean) - np.eye(len(used))).max())


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id long, x array<long>`` of the rows whose vector is usable; no other column is read."""
    v = F.col(f"`{vector}`")
    return rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v")).filter(usable(F.col("v"))).select("vec_id", F.transform("v", whole).alias("x"))


_FIELDS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each usable row and component, from 1 by
    falling eigenvalue.

    Rows whose vector is null or holds a null or an entry that isn't finite are left out. Repeated rows count each, and a null
    id stays null; equal eigenvalues have any basis of theirs, the same for all rows. A component without variance (equal
    vectors, a lone one) gives ``whitened`` 0 and counts for nothing in ``identity_error``; ``explained`` is then 0 too if there
    is no variance at all. An empty table, and vectors without entries, give no rows; vectors of different widths are
    refused, and so is a deviation beyond 64 bits. Other columns aren't read. The rows are read three times and never shuffled.
    """
    x = whole_vectors(rows, vec_id, vector)
    w = fit(x, components)
    if w is None:
        return x.select(*(F.lit(None).cast(kind).alias(name) for name, kind in (f.split() for f in _FIELDS.split(", ")))).limit(0)
    error = identity_error(x, w)
    explained = w.eigenvalues / w.trace if w.trace > 0 else w.eigenvalues

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                x = _vectors_of(some, 1)
                y, k, n = w.apply(x), len(w.components), some.num_rows
                wide = lambda v, kind: pa.array(np.repeat(np.asarray(v), k), kind)
                ids = some.column(0).take(pa.array(np.repeat(np.arange(n), k)))
                columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), wide(np.full(n, w.n), pa.int64()), wide(np.array(w.deviations(x), dtype=np.int64), pa.int64()), pa.array(y.ravel()), pa.array(np.tile(explained, n)), pa.array(np.full(n * k, error))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _FIELDS.split(", ")])

    return x.mapInArrow(run, _FIELDS)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
