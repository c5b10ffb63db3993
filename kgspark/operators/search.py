"""Search from a query: hybrid ranking over vectors, lookups of what is like a row, and engines with one interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.functions.text import embedding_text
from kgspark.operators import engines, sparse
from kgspark.operators.prompts import deltas
from kgspark.operators.ranking import dense_top_k, fuse, rerank, top_k


def sparse_top_k(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """The k best ``points(id, sparse)`` for each ``queries(query_id, sparse)`` by their product: ``(query_id, id, score, rank)``.

    Only coordinates that some query asks for leave the points' side; what shares none is not found.
    """
    return top_k(sparse.sparse_dot(points, queries).withColumn("score", F.round("score", 6)), k)


def hybrid_top_k(queries: DataFrame, points: DataFrame, k: int, dim: int, metric: str = "cosine", digits: int | None = 6) -> DataFrame:
    """The k best by reciprocal ranks of a dense and a sparse search of length k each: ``(query_id, id, score, rank)``.

    ``queries(query_id, vector[, sparse])``, ``points(id, vector[, sparse])``. A query without
    sparse vector is searched densely alone; one with a sparse vector alone is an error.
    """
    if "sparse" in queries.columns and queries.where("vector IS NULL AND sparse IS NOT NULL").limit(1).count():
        raise NotImplementedError("a query needs a dense vector beside its sparse one")
    lists = [dense_top_k(queries, points, k, dim, metric, digits=digits)]
    if "sparse" in queries.columns and "sparse" in points.columns:
        has = F.col("sparse").isNotNull()
        lists.append(sparse_top_k(queries.where(has), points.where(has), k))
    return fuse([x.select("query_id", "id", "rank") for x in lists], k)


class VectorIndex:
    """A table of rows and the vectors that stand for them; the backend of dense and hybrid queries.

    ``rows(id, ...)``, ``vectors(id, vector[, sparse])``; hits without a row are dropped.
    """

    def __init__(self, rows: DataFrame, vectors: DataFrame, dim: int, metric: str = "cosine") -> None:
        self.rows, self.vectors, self.dim, self.metric = rows, vectors, dim, metric

    def query(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """``(query_id, id, score, rank, <columns of the rows>)`` for ``queries(query_id, vector[, sparse])``.

        Of the k best vectors those whose row is gone leave a gap in the ranks.
        """
        if "sparse" in queries.columns and "sparse" not in self.vectors.columns:
            raise ValueError("the index holds no sparse vectors")
        hits = hybrid_top_k(queries, self.vectors, k, self.dim, self.metric) if "sparse" in queries.columns else dense_top_k(queries, self.vectors, k, self.dim, self.metric, digits=6)
        return hits.join(self.rows, "id")

    def get(self, ids: DataFrame) -> DataFrame:
        """``(id, vector)`` as they are stored: of length 1 under the cosine, null where there is none; requests in any number."""
        from kgspark.functions.vectors import normalise

        stored = normalise(F.col("vector")) if self.metric == "cosine" else F.col("vector").cast("array<double>")
        return ids.select("id").distinct().join(self.vectors.select("id", stored.alias("vector")), "id", "left")

    def similar(self, rows: DataFrame, k: int = 10) -> DataFrame:
        """Hits for rows of the table by their own vectors, themselves among them: ``(query_id, id, score, rank, ...)``."""
        asked = rows.select("id").distinct().join(self.vectors, "id").withColumnRenamed("id", "query_id")
        return self.query(asked.drop("sparse"), k)

    def similar_to_text(self, rows: DataFrame, embed: Callable[[DataFrame, str], DataFrame], k: int = 10) -> DataFrame:
        """Like ``similar`` by a new embedding of each row's text: name and description, or the description alone."""
        name = F.col("entity_name") if "entity_name" in rows.columns else F.lit(None).cast("string")
        texts = rows.select(F.col("id").alias("query_id"), embedding_text(name, F.col("description")).alias("text"))
        return self.query(embed(texts, "text").select("query_id", F.col("embedding").alias("vector")), k)


def reranked_seeds(hits: DataFrame, score: DataFrame | None, k: int) -> DataFrame:
    """Seeds ``(query_id, id, pos)`` from ranked hits, reordered by ``score(query_id, id, score)`` if there is one, cut to k.

    A hit without score counts 0.
    """
    if score is None:
        order = Window.partitionBy("query_id").orderBy("rank")
        return hits.select("query_id", "id", (F.row_number().over(order) - 1).alias("pos")).where(F.col("pos") < k)
    pairs = hits.select("query_id", "id", F.col("rank").alias("pos")).join(score.select("query_id", "id", "score"), ["query_id", "id"], "left").na.fill(0.0, ["score"])
    return rerank(pairs, k).select("query_id", "id", F.col("rank").alias("pos"))


def local_search(
    queries: DataFrame, entities: VectorIndex, relations: DataFrame, chunks: DataFrame, summaries: DataFrame,
    k: int = 20, score: Callable[[DataFrame], DataFrame] | None = None, keep: int | None = None,
) -> DataFrame:
    """Local retrieval from ``queries(query_id, vector)``: the k nearest entities, reranked and cut to ``keep``, and all that surrounds them.

    ``score(hits) -> (query_id, id, score)`` reranks. One row a query as in ``engines.local_retrieve``, lists in ranked order.
    """
    from kgspark.storage import cut

    hits = cut(entities.query(queries, k).select("query_id", "id", "rank"))
    seeds = cut(reranked_seeds(hits, None if score is None else score(hits), keep or k))
    return engines.local_retrieve(seeds, entities.rows, relations, chunks, summaries)


class Engine:
    """One interface for all engines: batches of queries in, rows out; a batch fails as a whole.

    ``retrieve(DataFrame(query_id, query)) -> DataFrame(query_id, ...)``;
    ``answer(DataFrame) -> DataFrame(query_id, answer)`` makes answers of what was retrieved.
    """

    def __init__(self, spark: SparkSession, retrieve: Callable[[DataFrame], DataFrame], answer: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.spark, self.retrieve, self.answer = spark, retrieve, answer

    def batch_search(self, queries: DataFrame) -> DataFrame:
        return self.retrieve(queries)

    def batch_query(self, queries: DataFrame) -> DataFrame:
        if self.answer is None:
            raise ValueError("this engine retrieves only")
        return self.answer(self.retrieve(queries))

    def _one(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([("q", query)], "query_id string, query string")

    def search(self, query: str) -> DataFrame:
        """A batch of one."""
        return self.batch_search(self._one(query)).drop("query_id")

    def query(self, query: str) -> str | None:
        row = self.batch_query(self._one(query)).select("answer").first()
        return None if row is None else row["answer"]

    def stream_query(self, query: str) -> Iterator[dict]:
        """The answer word by word, then the whole with what was retrieved."""
        retrieved = self.batch_search(self._one(query))
        if self.answer is None:
            raise ValueError("this engine retrieves only")
        row = self.answer(retrieved).select("answer").first()
        return deltas(iter((row["answer"] or "").split(" ") if row else ()), query, retrieved)


def tolerant_mix(queries: DataFrame, run: dict[str, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """Contexts of several engines, and the errors of those that failed; an error if all of them did.

    Each engine's rows are written before the next begins, so a failure shows here and not later.
    """
    from kgspark.storage import cut

    done: dict[str, DataFrame] = {}
    errors: dict[str, str] = {}
    for name, engine in run.items():
        try:
            done[name] = cut(engine(queries).select("query_id", "context"))
        except Exception as e:  # an engine is foreign code: whatever it raises is reported
            errors[name] = f"{type(e).__name__}: {e}"[:500]
    if not done:
        raise RuntimeError(f"every engine failed: {errors}")
    return engines.mix(done), errors
