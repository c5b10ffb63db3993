"""Keyword search: term weights as (id, token, weight) rows, and scores as one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import words
from kgspark.operators.ranking import top_k
from kgspark.storage import cut, spread


def term_counts(texts: DataFrame, key: str, column: str = "text", stop: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """``(key, token, tf, length)`` of every text; ``only(token)`` keeps these tokens, before anything is shuffled."""
    w = spread(texts.select(key, column)).select(key, words(F.col(column), stop=stop).alias("w"))
    # explode would put a filter before itself that splits the text twice more; the outer one does not.
    w = w.select(key, F.size("w").alias("length"), F.explode_outer("w").alias("token")).where("token IS NOT NULL")
    if only is not None:
        w = w.join(only.select("token").distinct(), "token", "left_semi")
    return w.groupBy(key, "length", "token").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(terms: DataFrame, key: str, total: DataFrame) -> DataFrame:
    """``(token, df, idf)``; ``total`` is one row with the number of documents ``n``."""
    df = terms.groupBy("token").agg(F.count(key).alias("df"))
    n = F.col("n").cast("double")
    return df.crossJoin(F.broadcast(total)).select("token", "df", F.log(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # total is one row


def bm25_weights(terms: DataFrame, k1: float = 1.2, b: float = 0.75, average: float = 256.0) -> DataFrame:
    """The document side of BM25 with a fixed average length, as the index stores it."""
    tf = F.col("tf").cast("double")
    return terms.withColumn("weight", tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / average)))


def keyword_scores(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, id, bm25, overlap)`` for every ``queries(query_id, text)`` and ``documents(id, text)`` that share a word.

    Texts are read once for both scores: BM25, and the share of the query's different words that the document
    holds, an offline stand-in for a reranker. Only tokens of the queries leave the document side.
    """
    asked = cut(term_counts(queries, "query_id").select("query_id", "token"))
    terms = cut(term_counts(documents, "id", only=asked))
    idf = document_frequency(terms, "id", documents.agg(F.count("id").alias("n")))
    size = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_asked"))
    asked = asked.join(idf, "token").join(size, "query_id").select("query_id", "token", "idf", "n_asked")
    found = bm25_weights(terms).join(asked, "token")
    return found.groupBy("query_id", "id").agg(
        F.round(F.sum(F.col("weight") * F.col("idf")), 6).alias("bm25"), F.round(F.count(F.lit(1)) / F.first("n_asked"), 6).alias("overlap")
    )


def bm25_scores(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, id, score)`` by BM25; see keyword_scores."""
    return keyword_scores(documents, queries).select("query_id", "id", F.col("bm25").alias("score"))


def bm25_top_k(documents: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, id, score, rank, rescore)``: the k best by BM25, with their overlap for a reranking."""
    scored = keyword_scores(documents, queries).select("query_id", "id", F.col("bm25").alias("score"), F.col("overlap").alias("rescore"))
    return top_k(scored, k)


def overlap_scores(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, id, score)`` by overlap; see keyword_scores."""
    q = term_counts(queries, "query_id").select("query_id", "token")
    size = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    both = term_counts(documents, "id", only=q).select("id", "token").join(q, "token").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("both"))
    return both.join(size, "query_id").select("query_id", "id", F.round(F.col("both") / F.col("n"), 6).alias("score"))


def sparse_dot(points: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, id, score)`` of sparse vectors in parallel arrays ``sparse.indices`` and ``sparse.values``."""
    long = lambda df, key: df.select(key, F.explode(F.arrays_zip("sparse.indices", "sparse.values")).alias("x")).select(key, F.col("x.indices").alias("idx"), F.col("x.values").alias("val"))
    q = long(queries, "query_id").withColumnRenamed("val", "qval")
    return long(points, "id").join(q, "idx").groupBy("query_id", "id").agg(F.sum(F.col("val") * F.col("qval")).alias("score"))
