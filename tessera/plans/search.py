"""Search, vector and ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import norm, unit
from tessera.operators.encoders import embed, seeded
from tessera.operators.search import batch_top_k, ranking_measures, top_k


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _one(v: DataFrame) -> DataFrame:
    return v.filter("vec_id = 0").select(F.col("embedding").alias("q"))


def _asked(v: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20."""
    return v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q"), F.col("label").alias("q_label"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def knn_cosine_topk(spark, d):
    v = _vectors(spark, d)
    return _rounded(top_k(v, _one(v), 10))


def knn_filtered(spark, d):
    v = _vectors(spark, d)
    return _rounded(top_k(v.filter("label = 3"), _one(v), 5))


def knn_k_beyond_corpus(spark, d):
    v = _vectors(spark, d)
    return _rounded(top_k(v.filter("label = 3"), _one(v), 100_000))


def knn_tie_break(spark, d):
    v = _vectors(spark, d).withColumn("embedding", F.expr("transform(array(0, 1, 2), x -> if(x = vec_id % 3, 1.0f, 0.0f))"))
    return _rounded(top_k(v, _one(v), 25))


def knn_batch_topk(spark, d):
    v = _vectors(spark, d)
    return _rounded(batch_top_k(v, _asked(v), 5))


def retrieval_measures(spark, d):
    v = _vectors(spark, d)
    ranked = batch_top_k(v, _asked(v), 10, but_itself=True)
    hits = ranked.join(v.select("vec_id", "label"), "vec_id").join(_asked(v).select("q_id", "q_label"), "q_id").withColumn("hit", F.col("label") == F.col("q_label"))
    others = v.groupBy(F.col("label").alias("q_label")).agg((F.count("*") - 1).alias("relevant")).filter("relevant > 0")
    m = ranking_measures(hits, _asked(v).join(others, "q_label").select("q_id", "relevant"), [1, 3, 5, 10])
    return m.select("k", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr")))


def vector_normalise(spark, d):
    u = _vectors(spark, d).select("vec_id", unit(F.expr("transform(embedding, x -> x * (1 + vec_id % 5))")).alias("u"))
    return u.select("vec_id", F.round(norm(F.col("u")), 6).alias("length"), F.round(F.col("u")[0], 5).alias("first"))


def vector_widths(spark, d):
    return _vectors(spark, d).agg(F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"), (4 * F.sum(F.size("embedding"))).alias("bytes"))


def embed_stub(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    e = embed(docs, "text", lambda: seeded(16), 16)
    return e.select("doc_id", F.size("embedding").alias("width"), F.round(norm(F.col("embedding")), 4).alias("length"))


def _knn(where: str, k: int, vector: str = "embedding::DOUBLE[]") -> str:
    return f"""WITH v AS (SELECT vec_id, label, {vector} AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 0),
s AS (SELECT vec_id, 1 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) AS d FROM v, q WHERE {where})
SELECT CAST(row_number() OVER (ORDER BY d, vec_id) AS INTEGER) AS rank, vec_id, round(1 - d, 6) AS score, {k} AS k FROM s ORDER BY d, vec_id LIMIT {k}"""


_PAIRS = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS q_id, label AS q_label, e AS q FROM v WHERE vec_id % 20 = 0),
s AS (SELECT q_id, q_label, vec_id, label, 1 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) AS d FROM v, q WHERE {where}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY d, vec_id) AS INTEGER) AS rank FROM s)
"""

QUERIES = {f.__name__: f for f in (knn_cosine_topk, knn_filtered, knn_k_beyond_corpus, knn_tie_break, knn_batch_topk, retrieval_measures, vector_normalise, vector_widths, embed_stub)}
SQL = {
    "knn_cosine_topk": _knn("true", 10),
    "knn_filtered": _knn("label = 3", 5),
    "knn_k_beyond_corpus": _knn("label = 3", 100_000),
    "knn_tie_break": _knn("true", 25, "[CASE WHEN vec_id % 3 = x THEN 1.0 ELSE 0.0 END FOR x IN [0, 1, 2]]::DOUBLE[]"),
    "knn_batch_topk": _PAIRS.format(where="true") + "SELECT q_id, rank, vec_id, round(1 - d, 6) AS score FROM r WHERE rank <= 5",
    "retrieval_measures": _PAIRS.format(where="q_id <> vec_id") + """, n AS (SELECT q_id, count(*) AS relevant FROM r WHERE label = q_label GROUP BY q_id),
m AS (SELECT q_id, k, relevant, (SELECT count(*) FROM r WHERE r.q_id = n.q_id AND rank <= k AND label = q_label) AS found,
  (SELECT min(rank) FROM r WHERE r.q_id = n.q_id AND rank <= k AND label = q_label) AS first FROM n, (SELECT unnest([1, 3, 5, 10]) AS k))
SELECT k, round(avg(found / relevant), 6) AS recall, round(avg(found / k), 6) AS precision, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM m GROUP BY k""",
    "vector_normalise": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, round(sqrt(list_dot_product(u, u)), 6) AS length, round(u[1], 5) AS first FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v)",
    "vector_widths": "SELECT CAST(min(len(embedding)) AS INTEGER) AS least, CAST(max(len(embedding)) AS INTEGER) AS most, CAST(4 * sum(len(embedding)) AS BIGINT) AS bytes FROM embeddings",
}
