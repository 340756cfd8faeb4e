"""Pluggable encoders and token counters, run in Arrow batches; deterministic stand-ins, as no model is at hand."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import long_rows

#: Makes a matrix of float32, a row for each text.
Encode = Callable[[list[str]], np.ndarray]


def seeded(dimensions: int = 16) -> Encode:
    """Normal vectors from a hash of the text, not of unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        import hashlib

        seeds = [int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big") for t in texts]
        return np.stack([np.random.default_rng(s).standard_normal(dimensions) for s in seeds]).astype(np.float32) if texts else np.zeros((0, dimensions), np.float32)

    return encode


def embed(rows: DataFrame, text: str, load: Callable[[], Encode], dimensions: int, prefix: str = "", out: str = "embedding") -> DataFrame:
    """``rows`` with an embedding; the encoder is loaded once in a worker and must give ``dimensions`` numbers a text. Texts come
    in batches of bounded size (``long_rows``)."""
    long_rows(rows.sparkSession)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for b in batches:
            m = encode([prefix + x for x in b.fillna("")])
            if m.shape != (len(b), dimensions):
                raise ValueError(f"the encoder gave {m.shape}, not {(len(b), dimensions)}")
            yield pd.Series(list(m), index=b.index)

    return rows.withColumn(out, run(F.col(text)))


#: Makes a number of tokens for each text.
Count = Callable[[list[str]], list[int]]


def counted(rows: DataFrame, text: str, load: Callable[[], Count], out: str = "tokens") -> DataFrame:
    """``rows`` with a number of tokens; the counter is loaded once in a worker and must give one number a text. Null texts are empty."""
    long_rows(rows.sparkSession)

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = load()
        for b in batches:
            n = count(list(b.fillna("")))
            if len(n) != len(b):
                raise ValueError(f"the counter gave {len(n)} numbers for {len(b)} texts")
            yield pd.Series(n, index=b.index, dtype="int64")

    return rows.withColumn(out, run(F.col(text)))


def word_count(text: Column) -> Column:
    """A stand-in for a token counter: words between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def keyword_axes(text: Column, words: list[str]) -> Column:
    """A stand-in encoder: a unit vector with an axis for each keyword that the text holds (all axes if it holds none)."""
    hits = [F.contains(F.lower(text), F.lit(w)).cast("double") for w in words]
    total = sum(hits[1:], hits[0])
    return F.array(*(F.when(total > 0, h / F.sqrt(F.when(total > 0, total).otherwise(1.0))).otherwise(F.lit(1.0 / len(words) ** 0.5)) for h in hits))
