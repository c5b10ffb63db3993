"""Retrieval engines: batches of queries as rows in, ranked contexts as rows out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.operators import neighbourhood
from kgspark.operators.ranking import rerank, top_k, topological_levels
from kgspark.operators.sparse import bm25_top_k, overlap_scores
from kgspark.storage import cut

#: Queries that a nested-loop engine takes in one batch.
MAX_QUERIES = 100_000


def naive_retrieve(queries: DataFrame, chunks: DataFrame, k: int = 20, rerank_k: int | None = None, search: Callable = bm25_top_k, score: Callable | None = overlap_scores) -> DataFrame:
    """``(query_id, chunk_id, doc_id, score, rank)``: chunks found by ``search``, reordered by ``score`` if there is one.

    ``search(documents, queries, k)`` gives ``(query_id, id, score, rank)``; ``score(documents, queries)`` gives ``(query_id, id, score)``
    and is not called where the search gives ``rescore`` itself and the scorer is the offline one.
    The cut to ``rerank_k`` applies only when a scorer is given.
    """
    texts = chunks.select("id", F.col("content").alias("text"))
    hits = search(texts, queries, k)
    if score is None:
        ranked = hits.select("query_id", "id", "score", (F.col("rank") - 1).alias("rank"))
    elif score is overlap_scores and "rescore" in hits.columns:
        ranked = rerank(hits.select("query_id", "id", F.col("rank").alias("pos"), F.col("rescore").alias("score")), rerank_k).select("query_id", "id", "score", "rank")
    else:
        hits = cut(hits)
        found = score(texts.join(hits.select("id").distinct(), "id", "left_semi"), queries)
        pairs = hits.select("query_id", "id", F.col("rank").alias("pos")).join(found, ["query_id", "id"], "left").na.fill(0.0, ["score"])
        ranked = rerank(pairs, rerank_k).select("query_id", "id", "score", "rank")
    return ranked.join(chunks.select("id", "doc_id"), "id").select("query_id", F.col("id").alias("chunk_id"), "doc_id", "score", "rank")


def local_retrieve(seeds: DataFrame, entities: DataFrame, relations: DataFrame, chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row a query with ranked lists of what surrounds its ``seeds(query_id, id, pos)``: entities, relations, chunks, summaries, documents.

    Lists keep their order through the ranks inside them.
    """
    ordered = lambda *c: F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x[c[-1]])
    seed = seeds.groupBy("query_id").agg(ordered("pos", "id").alias("entity_ids"))
    rel = neighbourhood.ranked_relations(seeds, relations).groupBy("query_id").agg(ordered("rank", "relation_id").alias("relation_ids"))
    ch = neighbourhood.ranked_chunks(seeds, entities, relations, chunks).groupBy("query_id").agg(ordered("rank", "chunk_id").alias("chunk_ids"))
    com = neighbourhood.community_summaries(seeds, entities, summaries).groupBy("query_id").agg(F.array_sort(F.collect_set("community")).alias("community_ids"))
    doc = neighbourhood.document_ids(seeds, entities)
    out = seed
    for part in (rel, ch, com, doc):
        out = out.join(part, "query_id", "left")
    lists = [c for c in out.columns if c != "query_id"]
    return out.select("query_id", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in lists])


def global_retrieve(queries: DataFrame, summaries: DataFrame, rate: Callable[[Column, Column], Column]) -> DataFrame:
    """``(query_id, community_id, rating, rank)``: every summary rated for every query, best first, ratings of 0 dropped.

    The queries, at most MAX_QUERIES, are the stated set that meets all summaries.
    """
    if queries.limit(MAX_QUERIES + 1).count() > MAX_QUERIES:
        raise ValueError(f"at most {MAX_QUERIES} queries in a batch")
    pairs = summaries.select(F.col("id").alias("community_id"), "summary").crossJoin(F.broadcast(queries.select("query_id", "query")))
    rated = pairs.select("query_id", "community_id", rate(F.col("query"), F.col("summary")).alias("rating")).where("rating > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("rating"), "community_id")
    return rated.withColumn("rank", F.row_number().over(order) - 1)


def mix(contexts: dict[str, DataFrame]) -> DataFrame:
    """Per-engine ``(query_id, context)`` tables side by side: ``(query_id, engine, context)`` in order of the engines.

    An engine that has nothing for a query is left out; a query no engine answers has no row.
    """
    out = None
    for n, (name, df) in enumerate(contexts.items()):
        part = df.where("context IS NOT NULL").select("query_id", F.lit(n).alias("position"), F.lit(name).alias("engine"), "context")
        out = part if out is None else out.unionByName(part)
    return out


def require_answers(queries: DataFrame, mixed: DataFrame) -> None:
    missing = queries.join(mixed, "query_id", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"every engine failed for {[r['query_id'] for r in missing]}")


def run_plans(subqueries: DataFrame, answer: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Answers of ``subqueries(plan_id, id, query, depends_on)`` of many plans, frontier by frontier.

    ``answer(DataFrame(plan_id, id, query)) -> (plan_id, id, answer)`` runs once a level for all
    plans; ``rewrite`` sees the level's queries with ``context``, the answers they depend
    on. Result ``(plan_id, id, level, query, answer, is_sink)``.
    """
    from kgspark.storage import cut

    levels = cut(topological_levels(subqueries).join(subqueries, ["plan_id", "id"]))
    depth = levels.agg(F.max("level")).first()[0]
    done = None
    for level in range(0 if depth is None else depth + 1):
        now = levels.where(F.col("level") == level).select("plan_id", "id", "query", "depends_on")
        if done is not None and rewrite is not None:
            need = now.select("plan_id", "id", F.explode("depends_on").alias("needs")).join(done.select("plan_id", F.col("id").alias("needs"), "answer"), ["plan_id", "needs"])
            context = need.groupBy("plan_id", "id").agg(F.array_sort(F.collect_list(F.struct("needs", "answer"))).alias("context"))
            now = rewrite(now.join(context, ["plan_id", "id"], "left"))
        got = answer(now.select("plan_id", "id", "query"))
        step = cut(now.select("plan_id", "id", "query").join(got, ["plan_id", "id"], "left").withColumn("level", F.lit(level)))
        done = step if done is None else done.unionByName(step)
    needed = subqueries.select("plan_id", F.explode("depends_on").alias("id")).distinct().withColumn("_n", F.lit(True))
    return done.join(needed, ["plan_id", "id"], "left").select("plan_id", "id", "level", "query", "answer", F.col("_n").isNull().alias("is_sink"))
