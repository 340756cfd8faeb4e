"""Exact nearest neighbours with deterministic ties, and measures of a ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import cosine_distance, norm

#: About how many queries one block holds, and how many rows of the corpus: a group of two blocks is some 30 MB at a width of 64.
BLOCK, CORPUS_BLOCK = 20_000, 50_000
#: Rows and queries that are compared at a time; their product bounds what a worker holds, some 8 MB a matrix.
ROWS, ASKED = 2048, 512


def checked_k(k: int) -> int:
    if k < 1:
        raise ValueError(f"k must be at least 1, not {k}")
    return k


def same_width(vector: Column, other: Column) -> Column:
    """The vector, or an error if it has another width."""
    return F.when(F.size(vector) == F.size(other), vector).otherwise(F.raise_error(F.format_string("a vector of width %d, not %d", F.size(vector), F.size(other))))


def asked_question(text: str | None) -> str:
    if not (text or "").strip():
        raise ValueError("the question is blank")
    return text


def top_k(corpus: DataFrame, query: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", refuse_empty: bool = False) -> DataFrame:
    """The k nearest rows of one query row: ``rank, key, score, k``. ``query`` has the column ``q``.

    Distances are computed as the corpus is scanned, and only k rows of each task travel. ``k`` beyond the corpus gives
    all of it. Null vectors are left out, zero ones come last with a score of NaN, and another width than the query's fails.
    With ``refuse_empty`` a corpus without vectors fails at once; else it gives no rows.
    """
    one = F.broadcast(query.limit(1).select("q", norm(F.col("q")).alias("q_norm")))
    corpus = corpus.filter(F.col(vector).isNotNull())
    if refuse_empty and corpus.isEmpty():
        raise ValueError("the corpus is empty")
    scored = corpus.crossJoin(one).select(key, cosine_distance(same_width(F.col(vector), F.col("q")), F.col("q"), norm_b=F.col("q_norm")).alias("distance"))
    best = scored.orderBy("distance", key).limit(checked_k(k))
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy("distance", key)))  # k rows
    return ranked.select("rank", key, (1.0 - F.col("distance")).alias("score"), F.lit(k).alias("k"))


def retrieve(corpus: DataFrame, question: str, encode: Callable[[str], list[float]], width: int, k: int = 10, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows of a question: ``rank, score, k, question`` and all columns of the corpus but the vector.

    Refused, in this order: an encoder of another width than the stored vectors' (one that says so in ``dimensions`` isn't
    called for that), k below 1, a blank question, an empty corpus.
    """
    said = getattr(encode, "dimensions", None)
    if said is not None and said != width:
        raise ValueError(f"the encoder gives vectors of width {said}, not {width}")
    checked_k(k)
    asked_question(question)
    q = [float(x) for x in encode(question)]
    if len(q) != width:
        raise ValueError(f"the encoder gave a vector of width {len(q)}, not {width}")
    found = top_k(corpus, corpus.sparkSession.createDataFrame([(q,)], "q array<double>"), k, key, vector, refuse_empty=True)
    return corpus.drop(vector).join(F.broadcast(found), key).withColumn("question", F.lit(question))  # k rows


def _nearest(batches: Iterator[pa.RecordBatch], asked: pa.Table, k: int, but_itself: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The k nearest rows of all batches, for each query: ``ASKED`` queries at a time, against ``ROWS`` rows at a time.

    One product of matrices finds the candidates; their distances are then added up row by row, so that equal vectors have
    equal distances wherever they stand, and ties go by key.
    """
    held = list(batches)
    for at in range(0, len(asked), ASKED):
        found = list(_near(held, asked.slice(at, ASKED), k, but_itself, names))
        if found:
            yield _best(pa.Table.from_batches(found).combine_chunks(), k)


def _best(found: pa.Table, k: int) -> pa.RecordBatch:
    """Of the k nearest of each piece the k nearest of all, for each query; in order, ties by key. NaN comes last."""
    query, key, far = (c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in found.columns)
    whose, keys = (c.to_numpy(zero_copy_only=False) for c in (query.dictionary_encode().indices, key))
    order = np.lexsort((keys.astype(str) if keys.dtype == object else keys, far.to_numpy(), whose))
    whose = whose[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = whose[1:] != whose[:-1]
    place = np.arange(len(order))
    nth = place - np.maximum.accumulate(np.where(first, place, 0))
    some = pa.array(order[nth < k])
    return pa.RecordBatch.from_arrays([c.take(some) for c in (query, key, far)], names=found.column_names)


def _near(batches: list[pa.RecordBatch], asked: pa.Table, k: int, but_itself: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The k nearest rows of each piece of a batch, for each query."""
    ids, q = asked.column(0).combine_chunks(), _matrix(asked.column(1).combine_chunks())
    q_norm, own = np.sqrt((q * q).sum(axis=1)), ids.to_numpy(zero_copy_only=False)
    for b in batches:
        for at in range(0, len(b) if len(q) else 0, ROWS):
            part = b.slice(at, ROWS)
            x, keys = _matrix(part.column(1)), part.column(0).to_numpy(zero_copy_only=False)
            keys = keys.astype(str) if keys.dtype == object else keys
            norms = np.sqrt((x * x).sum(axis=1))
            with np.errstate(invalid="ignore", divide="ignore"):
                rough = 1.0 - (q @ x.T) / (q_norm[:, None] * norms)
                whose, which, far = [], [], []
                for i, row in enumerate(rough):
                    near = np.flatnonzero(keys != own[i]) if but_itself else np.arange(len(row))
                    if len(near) > k and not np.isnan(last := np.partition(row[near], k - 1)[k - 1]):
                        near = near[row[near] <= last + 1e-9]
                    exact = 1.0 - (x[near] * q[i]).sum(axis=1) / (q_norm[i] * norms[near])
                    best = np.lexsort((keys[near], exact))[:k]
                    whose.append(np.full(len(best), i)), which.append(near[best]), far.append(exact[best])
            columns = [ids.take(pa.array(np.concatenate(whose))), part.column(0).take(pa.array(np.concatenate(which))), pa.array(np.concatenate(far))]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def batch_top_k(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "q_id", but_itself: bool = False) -> DataFrame:
    """The k nearest rows of each query: ``query_key, rank, key, score``. ``queries`` has the columns query_key and ``q``;
    ``but_itself`` leaves out the row whose key is the query's.

    Queries and rows are dealt to blocks of bounded size, and each pair of blocks is one group that a task compares: every
    pair is scored, as an exact search must, but neither side is ever in one place. Only k rows of each query leave a group.
    Null vectors are left out, zero ones come last with a score of NaN, and vectors of another width than the queries fail.
    """
    checked_k(k)
    rows, queries = corpus.select(key, vector).filter(F.col(vector).isNotNull()), queries.select(query_key, "q").filter("q is not null")
    parts = max(-(-rows.count() // CORPUS_BLOCK), 1)
    blocks = max(-(-queries.count() // BLOCK), 1)
    kind = lambda d, c: d.schema[c].dataType.simpleString()
    schema, names = f"`{query_key}` {kind(queries, query_key)}, `{key}` {kind(corpus, key)}, distance double", [query_key, key, "distance"]
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = queries.select(dealt(query_key, blocks).alias("__block"), spread(parts).alias("__part"), query_key, "q")
    held = rows.select(spread(blocks).alias("__block"), dealt(key, parts).alias("__part"), key, vector)

    def near(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        found = list(_nearest(iter(theirs.select([key, vector]).combine_chunks().to_batches()), ours.select([query_key, "q"]), k, but_itself, names)) if len(ours) and len(theirs) else []
        types = [pa.field(query_key, ours.schema.field(query_key).type), pa.field(key, theirs.schema.field(key).type), pa.field("distance", pa.float64())]
        return pa.Table.from_batches(found, pa.schema(types))

    best = asked.groupBy("__block", "__part").cogroup(held.groupBy("__block", "__part")).applyInArrow(near, schema)
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy("distance", key))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select(query_key, "rank", key, (1.0 - F.col("distance")).alias("score"))


def judged(ranked: DataFrame, relevant: DataFrame, query_key: str = "q_id", key: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """``ranked`` with ``hit``, and ``query_key, relevant``: how many rows are relevant; from judgments by query_key and key."""
    relevant = relevant.select(query_key, key).distinct()
    hits = ranked.join(relevant.withColumn("hit", F.lit(True)), [query_key, key], "left").fillna({"hit": False})
    return hits, relevant.groupBy(query_key).agg(F.count("*").alias("relevant"))


def ranking_measures(hits: DataFrame, sizes: DataFrame, ks: list[int], query_key: str = "q_id") -> DataFrame:
    """``k, recall, precision, mrr`` over all queries of ``sizes(query_key, relevant)``; ``hits`` has query_key, rank and hit."""
    cut = F.explode(F.array(*map(F.lit, ks))).alias("k")
    each = hits.filter("hit").select(query_key, "rank", cut).filter("rank <= k").groupBy(query_key, "k").agg(F.count("*").alias("found"), F.min("rank").alias("first"))
    all_queries = sizes.select(query_key, "relevant", cut).join(each, [query_key, "k"], "left").fillna({"found": 0})
    return all_queries.groupBy("k").agg(
        F.avg(F.col("found") / F.col("relevant")).alias("recall"), F.avg(F.col("found") / F.col("k")).alias("precision"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr")
    )
