"""Renewal of descriptions and communities of a stored graph."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import fragments
from kgspark.operators import community, lookup, mutate
from kgspark.operators.chunking import hashed_embedding
from kgspark.storage import cut


def density_clusters(vectors: np.ndarray, eps: float = 0.5, min_samples: int = 2) -> np.ndarray:
    """Labels of density clusters from 0 in order of first members; -1 for what is in none."""
    n = len(vectors)
    near = np.sqrt(np.maximum(((vectors[:, None] - vectors[None]) ** 2).sum(axis=2), 0)) <= eps
    core = near.sum(axis=1) >= min_samples
    label = np.full(n, -1)
    current = 0
    for i in range(n):
        if label[i] >= 0 or not core[i]:
            continue
        label[i], work = current, [i]
        while work:
            for j in np.flatnonzero(near[work.pop()] & (label < 0)):
                label[j] = current
                if core[j]:
                    work.append(j)
        current += 1
    return label


def cluster_descriptions(grouped: DataFrame, summarise: Callable[[list[str]], str | None], above: int = 10_000, embed: Callable[[list[str]], np.ndarray] = hashed_embedding, **options) -> DataFrame:
    """Descriptions of entities with more than ``above`` texts: clustered, each cluster summarised, joined in their order.

    A cluster whose summary fails keeps its joined texts; texts in no cluster stay as they are, at the end. The list of one entity is one unit of work.
    """

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        def one(texts) -> str:
            texts = [t for t in texts if t]
            label = density_clusters(embed(texts), **options) if texts else np.zeros(0)
            parts = []
            for c in range(int(label.max(initial=-1)) + 1):
                members = [t for t, x in zip(texts, label) if x == c]
                parts.append(summarise(members) or " ".join(members))
            return " ".join(parts + [t for t, x in zip(texts, label) if x == -1])

        return lists.map(one)

    joined = F.array_join(F.filter("descriptions", lambda d: d.isNotNull()), " ")
    many = grouped.where(F.size("descriptions") > above).withColumn("description", run("descriptions"))
    return grouped.where(F.size("descriptions") <= above).withColumn("description", joined).unionByName(many)


def reindex_descriptions(entities: DataFrame, threshold: int, summarise: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Entities of more than ``threshold`` fragments with summarised descriptions; a null summary keeps the old one."""
    long = lookup.long_descriptions(entities, threshold)
    new = cut(long.withColumn("description", F.coalesce(F.pandas_udf(summarise, "string")(fragments(F.col("description"))), F.col("description"))))
    return mutate.update(entities, new)


def reindex_communities(entities: DataFrame, relations: DataFrame, summarise: Callable[[pd.Series], pd.Series], max_cluster_size: int = 128, min_cluster_size: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New memberships, communities and summaries of the whole graph: ``(entities, communities, summaries)``.

    Everything is computed and written before it is returned, so a failing summary leaves the stored tables as they are.
    """
    m = cut(community.detect_communities(relations, max_cluster_size))
    groups = cut(community.build_communities(m, relations, min_cluster_size))
    lists = m.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("level", "cluster_id"))).alias("clusters"))
    renewed = community.keep_memberships(entities.drop("clusters").join(lists, "id", "left"), groups)
    return cut(renewed), groups, cut(community.summarise_communities(groups, entities, relations, summarise))
