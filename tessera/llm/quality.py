"""Quality scores: ridge regression on random Fourier features of document statistics, with isotonic calibration.

The features approximate a Gaussian kernel over a few statistics of the whole text. Each partition of the labelled rows
adds up its part of the normal equations, the engine adds up the partitions', and the driver solves one system of a fixed
size. Labelled rows are dealt to folds; each fold is scored by weights of the other folds, whose equations are those of all
folds less its own. These scores are counted in a fixed number of bins and made monotone by pooling adjacent violators.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, documents, forget, held_out, long_rows, saved, schema_of, texts, width

#: Random features, their seed, the ridge, the bins of the calibration, the folds, and about the most labelled rows that are learned from.
FEATURES, SEED, RIDGE, BINS, FOLDS, MOST_LABELS = 192, 7, 1.0, 256, 4, 500_000
THRESHOLD = 0.3

_CLASSES = np.zeros((256, 9))
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = [
        "A" <= _c <= "Z", "a" <= _c <= "z", "0" <= _c <= "9", _c in ".,;:?'\"-()", _c == "!", _c in "#$%&*+/<=>@[\\]^_`{}~", _c == "|", _b in (10, 13), _b >= 128,
    ]
STATISTICS = _CLASSES.shape[1] + 8


def statistics(data: bytes) -> np.ndarray:
    """Statistics of a text: shares of kinds of bytes, length, words, repetition of words and lines, entropy of bytes."""
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256).astype(np.float64)
    n = max(1.0, counts.sum())
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    share = counts / n
    seen = share[share > 0]
    cut = words[:-1], words[1:]
    return np.concatenate([
        share @ _CLASSES,
        [
            np.log1p(n), np.log1p(len(words)), np.log1p(n / max(1, len(words))),
            len(set(words)) / max(1, len(words)), len(set(lines)) / max(1, len(lines)), np.log1p(len(lines) / max(1, len(words))),
            -(seen * np.log(seen)).sum(), sum([a == b for a, b in zip(*cut, strict=True)]) / max(1, len(words)),
        ],
    ])


_STATS = [("doc_id", pa.int64()), ("stats", pa.list_(pa.float64()))]


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, stats array<double>`` for each row; a null text is an empty one."""
    long_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch([(i, statistics(x.as_py()).tolist()) for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True)], _STATS)

    return texts(docs, doc_id, text).mapInArrow(run, schema_of(_STATS))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features, and a one for the intercept."""
        rng = np.random.default_rng(SEED)
        d = len(self.mean)
        w, phase = rng.standard_normal((d, FEATURES)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, FEATURES)
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ w + phase), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights if self.weights is not None else np.zeros(len(stats))

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.values)


def _matrix(column: pa.ListArray, size: int = STATISTICS) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _summed(rows: DataFrame, part) -> np.ndarray:
    """Adds up, over partitions, a matrix of a fixed size that ``part(stats, labels, folds)`` makes of each batch."""
    fields = [("i", pa.int64()), ("v", pa.list_(pa.float64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                m = part(_matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(float), b.column(2).to_numpy(zero_copy_only=False))
                total = m if total is None else total + m
        yield batch(list(enumerate(total.tolist())) if total is not None else [], fields)

    each = rows.select("stats", "label", "fold").mapInArrow(run, schema_of(fields)).select("i", F.posexplode("v").alias("j", "x"))
    cells = each.groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # a matrix of a fixed size
    out = np.zeros((max([c.i for c in cells], default=-1) + 1, max([c.j for c in cells], default=-1) + 1))
    for c in cells:
        out[c.i, c.j] = c.x
    return out


def pooled(hits: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Isotonic fit of hits/total over bins in order, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for h, t in zip(hits.tolist(), total.tolist(), strict=True):
        blocks.append([h, t, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            h2, t2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + h2, blocks[-1][1] + t2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), h / t) for h, t, n in blocks])


def solved(equations: np.ndarray) -> np.ndarray:
    """The weights of normal equations with the ridge; the intercept has next to none."""
    return np.linalg.solve(equations[:, :-1] + RIDGE * np.diag([*[1.0] * FEATURES, 1e-6]), equations[:, -1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", most: int = MOST_LABELS) -> Model:
    """A model from labelled documents that aren't held out, at most about ``most`` of them, chosen by a hash of the id.

    Rows of ``labels`` without an id or a label are ignored; of rows that disagree, each counts. Without labels, or with only
    one kind, the score is a constant.
    """
    known = labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), (F.col(f"`{label}`") > 0).cast("int").alias("label")).dropna().filter(~held_out("doc_id"))
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_003)) < int(1_000_003 * most / n))
    # about ``most`` rows of twelve bytes at most, whatever the tables' size
    some = docs.join(F.broadcast(known.select(F.col("doc_id").alias("__known")).distinct()), F.col(f"`{doc_id}`").cast("long") == F.col("__known"), "left_semi")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(FOLDS)).cast("int")
    table = saved(document_statistics(some, doc_id, text).join(F.broadcast(known), "doc_id").select("stats", "label", fold.alias("fold")))
    rows = table.repartition(min(width(docs.sparkSession), 1 + n // 16_000)) if n else table
    moments = _summed(rows, lambda x, y, _: np.stack([np.append(x.sum(axis=0), [len(x), y.sum()]), np.append((x * x).sum(axis=0), [0, 0])]))
    flat = Model(np.zeros(STATISTICS), np.ones(STATISTICS), None, np.array([0.0]), np.array([0.5]))
    if not moments.size:
        return flat
    count, ones = moments[0, -2:]
    if ones in (0, count):
        flat.values = np.array([float(ones > 0)])
        return flat
    mean = moments[0, :-2] / count
    scale = np.sqrt(np.maximum(moments[1, :-2] / count - mean**2, 1e-12))
    model = Model(mean, np.where(scale < 1e-5, 1.0, scale), None, np.array([0.0]), np.array([0.5]))

    def normal(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.vstack([np.hstack([z[own].T @ z[own], (z[own].T @ y[own])[:, None]]) for own in (fold == k for k in range(FOLDS))])

    folds = _summed(rows, normal).reshape(FOLDS, FEATURES + 1, FEATURES + 2)
    model.weights = solved(folds.sum(axis=0))
    without = np.stack([solved(folds.sum(axis=0) - own) for own in folds])

    def binned(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        raw = (model.features(x) * without[fold]).sum(axis=1)
        at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.stack([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)])

    seen = _summed(rows, binned)
    used = np.flatnonzero(seen[1])
    # a bin counts with one row of the overall share more, so that few rows don't make certainty
    model.knots, model.values = (used + 0.5) / BINS * 2 - 0.5, pooled(seen[0][used] + ones / count, seen[1][used] + 1)
    forget(table)
    return model


_SCORES = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())]


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""
    long_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                s = model.score(np.stack([statistics(x.as_py()) for x in b.column(2)]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[n for n, _ in _SCORES])

    return texts(docs, doc_id, text).select("doc_id", held_out("doc_id").alias("held_out"), "data").mapInArrow(run, schema_of(_SCORES))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``; only the text is looked at.

    Learns from labelled rows that aren't held out (crc32 of the id modulo five isn't 0), and computes statistics of these
    first and then of all rows once. A null text is an empty one, which has
    a score as any other; repeated rows repeat; a null id has no label and isn't held out; an empty table gives no rows.
    """
    return score(docs, fit(docs, labels, label, doc_id, text), doc_id, text, threshold)


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches the threshold; learned as in ``quality_scores``."""
    long_rows(docs.sparkSession)
    model = fit(docs, labels, label, doc_id, text)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                s = model.score(np.stack([statistics((x.as_py() or "").encode()) for x in b.column(at)]))
                yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
