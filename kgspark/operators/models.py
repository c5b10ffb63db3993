"""Calls of models as batch functions over rows, with offline stand-ins, a cache and an error column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import cache_key
from kgspark.operators.chunking import hashed_embedding


def batch_call(rows: DataFrame, column: str, call: Callable[[list], list], batch: int = 500, retries: int = 2, continue_on_error: bool = True) -> DataFrame:
    """``rows`` with ``response`` and ``error``: one call for each batch of values, responses aligned with rows.

    A failing batch is tried again, then value by value; what still fails has a null
    response and its error, or stops the job if ``continue_on_error`` is off.
    """
    schema = rows.select("*", F.lit(None).cast("string").alias("response"), F.lit(None).cast("string").alias("error")).schema

    def attempt(values: list) -> list:
        for left in range(retries, -1, -1):
            try:
                out = call(values)
                if len(out) != len(values):
                    raise ValueError("a response for each value is needed")
                return [(x, None) for x in out]
            except Exception as e:
                if left == 0:
                    if len(values) > 1:
                        return [r for v in values for r in attempt([v])]
                    if not continue_on_error:
                        raise
                    return [(None, f"{type(e).__name__}: {e}")]
        return []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            values = f[column].tolist()
            got = [r for i in range(0, len(values), batch) for r in attempt(values[i : i + batch])]
            yield f.assign(response=[r[0] for r in got], error=[r[1] for r in got])

    return rows.mapInPandas(run, schema)


def cached_call(rows: DataFrame, column: str, call: Callable[[list], list], cache: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Like batch_call, but only for values whose key ``cache(key, response)`` lacks. Returns the rows and the grown cache."""
    from kgspark.storage import cut

    keyed = rows.withColumn("key", cache_key(F.col(column)))
    new = keyed.select("key", column).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    fresh = cut(batch_call(new, column, call, **options))
    grown = cache.select("key", "response").unionByName(fresh.where("error IS NULL").select("key", "response"))
    errors = fresh.where("error IS NOT NULL").select("key", "error")
    return keyed.join(grown, "key", "left").join(errors, "key", "left").drop("key"), grown


def embed(rows: DataFrame, column: str, model: Callable[[list[str]], np.ndarray] = hashed_embedding) -> DataFrame:
    """``rows`` with ``embedding``; null texts have none."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), dtype=object)
        have = texts.notna().to_numpy()
        if have.any():
            v = np.asarray(model(texts[have].tolist()), dtype=np.float32)
            for i, x in zip(np.flatnonzero(have), v):
                out.iloc[i] = x
        return out

    return rows.withColumn("embedding", run(column))


def extract(chunks: DataFrame, model: Callable[[str], tuple[list[dict], list[dict]]]) -> tuple[DataFrame, DataFrame]:
    """Entity and relation mentions of every chunk by a function of its text; a chunk that fails has none."""
    from kgspark import schema
    from kgspark.storage import cut

    entity = "struct<entity_name: string, entity_type: string, description: string>"
    relation = "struct<source_entity: string, target_entity: string, relation_type: string, description: string, relationship_strength: int>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for text in f["content"]:
                try:
                    out.append(model(text))
                except Exception:
                    out.append(([], []))
            yield pd.DataFrame({"chunk_id": f["id"], "entities": [o[0] for o in out], "relations": [o[1] for o in out]})

    found = cut(chunks.select("id", "content").mapInPandas(run, f"chunk_id string, entities array<{entity}>, relations array<{relation}>"))
    e = found.select("chunk_id", F.explode("entities").alias("x")).select("chunk_id", "x.*")
    r = found.select("chunk_id", F.explode("relations").alias("x")).select("chunk_id", "x.*").where(F.col("relationship_strength").isNull() | F.col("relationship_strength").between(0, 5))
    assert [c.split()[0] for c in schema.ENTITY_MENTIONS.split(", ")] == e.columns
    return e, r


def select_examples(examples: DataFrame, queries: DataFrame, k: int, search: Callable) -> DataFrame:
    """The k best examples for each query; ``search(documents, queries, k)`` as in the engines."""
    return search(examples.select("id", F.col("input_text").alias("text")), queries, k)


def judge_score(correct, complete, grounded, cosine):
    """Combined score of an answer: 0.7 of the judged marks (1 to 5 each), 0.3 of the cosine; and whether they disagree."""
    marks = (correct + complete + grounded - 3) / 12.0
    return 0.7 * marks + 0.3 * cosine, F.abs(marks - cosine) > 0.3


def low_match_rate(queries: DataFrame, hits: DataFrame):
    """Share of queries without any hit, one row."""
    found = queries.select("query_id").join(hits.select("query_id").distinct().withColumn("_h", F.lit(1)), "query_id", "left")
    return found.agg(F.round(F.avg(F.col("_h").isNull().cast("int")), 6).alias("low_match_rate"))


def fuse_examples(ranked: list[DataFrame], k: int) -> DataFrame:
    """``(query_id, id, score, rank)``: examples by reciprocal ranks of all candidates, with the constant max(k // 2, 1)."""
    from kgspark.operators.ranking import fuse

    return fuse(ranked, k, max(k // 2, 1))


def semantic_examples(examples: DataFrame, queries: DataFrame, k: int, dim: int) -> DataFrame:
    """The k ``examples(id, vector)`` nearest to each ``queries(query_id, vector)``: none for a zero query, similarity 0 for a zero example."""
    from kgspark.operators.ranking import dense_top_k

    return dense_top_k(queries.where(F.exists("vector", lambda x: x != 0)), examples, k, dim)
