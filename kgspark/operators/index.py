"""The stored graph with its vectors as one value: every change gives new tables, with all cascades."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.ids import community_id
from kgspark.functions.text import embedding_text
from kgspark.operators import mutate
from kgspark.operators.lookup import first_seen
from kgspark.operators.neighbourhood import chunk_refs

Embed = Callable[[DataFrame, str], DataFrame]
"""``embed(rows, column)`` adds ``embedding``, as ``models.embed`` does."""


def _last(rows: DataFrame, position: str | None) -> DataFrame:
    """Of repeated ids the row that comes last by ``position``; as they are if there is none."""
    return rows if position is None else first_seen(rows.withColumn("_at", -F.col(position)), ["id"], "_at").drop("_at", position)


def _put(vectors: DataFrame | None, rows: DataFrame, text, embed: Embed | None) -> DataFrame | None:
    """Vectors with those of the rows made anew; unchanged without a model."""
    if vectors is None or embed is None:
        return vectors
    made = embed(rows.select("id", text.alias("text")), "text").select("id", F.col("embedding").alias("vector"))
    return mutate.upsert(vectors, made)


def _without(table: DataFrame | None, ids: DataFrame) -> DataFrame | None:
    return None if table is None else table.join(ids.select("id").distinct(), "id", "left_anti")


def remap_and_rewrite(existing: DataFrame, entities: DataFrame, communities: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New cluster numbers after those of ``existing(level, cluster_id)``, in memberships, communities and summaries alike.

    ``entities(id, clusters, ...)``, ``communities(id, level, cluster_id, ...)``, ``summaries(id, ...)`` come from one
    detection. A membership or summary whose community is not among them is left out.
    """
    moved = mutate.remap_clusters(existing, communities.select("level", "cluster_id"))
    one = entities.select("id", F.explode("clusters").alias("c")).select("id", "c.level", "c.cluster_id").join(moved, ["level", "cluster_id"])
    lists = one.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("level", F.col("new_cluster_id").alias("cluster_id")))).alias("_clusters"))
    kind = dict(entities.dtypes)["clusters"]
    renewed = entities.join(lists, "id", "left").withColumn("clusters", F.coalesce(F.col("_clusters").cast(kind), F.array().cast(kind))).drop("_clusters")
    groups = communities.join(moved, ["level", "cluster_id"]).withColumn("_old", F.col("id")).withColumn("id", F.col("community_id")).withColumn("cluster_id", F.col("new_cluster_id"))
    names = groups.select(F.col("_old"), F.col("id").alias("_new"))
    renamed = summaries.join(names, summaries["id"] == names["_old"]).withColumn("id", F.col("_new")).select(*summaries.columns)
    return renewed.select(*entities.columns), groups.select(*communities.columns), renamed


@dataclass(frozen=True)
class GraphIndex:
    """Tables of a graph; vector tables are ``(id, vector)`` or absent.

    Methods return a new index and leave this one as it is. What is embedded is embedded before
    any table changes, so a failing model changes nothing once the tables are written.
    """

    entities: DataFrame
    relations: DataFrame
    chunks: DataFrame
    communities: DataFrame | None = None
    summaries: DataFrame | None = None
    entity_vectors: DataFrame | None = None
    relation_vectors: DataFrame | None = None
    chunk_vectors: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in vars(self).items() if v is not None}

    def chunk_index(self) -> DataFrame:
        """``(chunk_id, entity_ids)``: the reverse index, always that of the present entities."""
        return chunk_refs(self.entities).groupBy("chunk_id").agg(F.array_sort(F.collect_set("id")).alias("entity_ids"))

    def upsert_nodes(self, rows: DataFrame, embed: Embed | None = None, position: str | None = None) -> "GraphIndex":
        """Entities replaced or added by id, with their vectors; of repeated ids the last by ``position``."""
        rows = _last(rows, position)
        vectors = _put(self.entity_vectors, rows, embedding_text(F.col("entity_name"), F.col("description")), embed)
        return replace(self, entities=mutate.upsert(self.entities, rows), entity_vectors=vectors)

    def update_nodes(self, rows: DataFrame, embed: Embed | None = None) -> "GraphIndex":
        """Like upsert_nodes; every id must be there."""
        mutate.update(self.entities, rows)
        return self.upsert_nodes(rows, embed)

    def upsert_edges(self, rows: DataFrame, embed: Embed | None = None, position: str | None = None) -> "GraphIndex":
        """Relations replaced or added by id; both ends must be entities."""
        rows = _last(rows, position)
        ends = rows.select(F.explode(F.array("subject_id", "object_id")).alias("id"))
        if ends.join(self.entities.select("id"), "id", "left_anti").limit(1).count():
            raise ValueError("a relation names an entity that does not exist")
        return replace(self, relations=mutate.upsert(self.relations, rows), relation_vectors=_put(self.relation_vectors, rows, F.col("description"), embed))

    def update_edges(self, rows: DataFrame, embed: Embed | None = None) -> "GraphIndex":
        """Like upsert_edges; every (subject_id, object_id, id) must be there."""
        spec = ["subject_id", "object_id", "id"]
        if rows.select(spec).join(self.relations.select(spec), spec, "left_anti").limit(1).count():
            raise ValueError("an update names relations that do not exist")
        return self.upsert_edges(rows, embed)

    def merge_nodes(self, rows: DataFrame, embed: Embed | None = None) -> "GraphIndex":
        """Entities merged with the stored ones of their id; vectors of all that were touched are made anew."""
        merged = mutate.merge_upsert_entities(self.entities, rows)
        touched = merged.join(rows.select("id"), "id", "left_semi")
        return replace(self, entities=merged, entity_vectors=_put(self.entity_vectors, touched, embedding_text(F.col("entity_name"), F.col("description")), embed))

    def merge_edges(self, rows: DataFrame, embed: Embed | None = None) -> "GraphIndex":
        merged = mutate.merge_upsert_relations(self.relations, rows, self.entities)
        return replace(self, relations=merged, relation_vectors=_put(self.relation_vectors, merged.join(rows.select("id"), "id", "left_semi"), F.col("description"), embed))

    def upsert_chunks(self, rows: DataFrame, embed: Embed | None = None, position: str | None = None) -> "GraphIndex":
        """Chunks replaced or added by id, with their vectors."""
        rows = _last(rows, position)
        return replace(self, chunks=mutate.upsert(self.chunks, rows), chunk_vectors=_put(self.chunk_vectors, rows, F.col("content"), embed))

    def upsert_communities(self, communities: DataFrame, summaries: DataFrame | None = None, must_exist: bool = False) -> "GraphIndex":
        """Communities, and summaries of them, replaced or added; with ``must_exist`` only replaced."""
        put = mutate.update if must_exist else mutate.upsert
        return replace(self, communities=put(self.communities, communities), summaries=self.summaries if summaries is None else put(self.summaries, summaries))

    def delete_nodes(self, ids: DataFrame) -> "GraphIndex":
        """Entities deleted with the relations at them and all their vectors."""
        entities, relations = mutate.delete_entities(self.entities, self.relations, ids)
        return self._kept(entities, relations)

    def delete_edges(self, specs: DataFrame) -> "GraphIndex":
        return self._kept(self.entities, mutate.delete_relations(self.relations, specs))

    def delete_chunks(self, ids: DataFrame, retain_shared: bool = False) -> "GraphIndex":
        """Chunks deleted with all that cites them, the relations at those, and all their vectors."""
        chunks, entities, relations = mutate.delete_chunks(self.chunks, self.entities, self.relations, ids, retain_shared)
        return replace(self._kept(entities, relations), chunks=chunks, chunk_vectors=_without(self.chunk_vectors, ids))

    def _kept(self, entities: DataFrame, relations: DataFrame) -> "GraphIndex":
        """These rows, and of the vectors those whose row went are gone; vectors without a row before stay, they are for the audit."""
        gone = lambda before, after: before.select("id").join(after.select("id"), "id", "left_anti")
        return replace(
            self, entities=entities, relations=relations,
            entity_vectors=_without(self.entity_vectors, gone(self.entities, entities)), relation_vectors=_without(self.relation_vectors, gone(self.relations, relations)),
        )

    def delete_communities(self, ids: DataFrame) -> "GraphIndex":
        communities, summaries = mutate.delete_communities(self.communities, self.summaries, ids)
        return replace(self, communities=communities, summaries=summaries)

    def add_communities(self, entities: DataFrame, communities: DataFrame, summaries: DataFrame) -> "GraphIndex":
        """Clusters of a further build under numbers of their own: memberships joined, communities and summaries added."""
        known = self.communities.select("level", "cluster_id")
        renewed, groups, renamed = remap_and_rewrite(known, entities, communities, summaries)
        own = renewed.select("id", F.col("clusters").alias("_new"))
        both = self.entities.join(own, "id", "left")
        joined = F.array_sort(F.array_union(F.coalesce("clusters", F.col("_new"), F.array().cast(dict(entities.dtypes)["clusters"])), F.coalesce("_new", F.array().cast(dict(entities.dtypes)["clusters"]))))
        merged = both.withColumn("clusters", joined).select(*self.entities.columns)
        return replace(self, entities=merged, communities=mutate.upsert(self.communities, groups.select(*self.communities.columns)), summaries=mutate.upsert(self.summaries, renamed))

    def reindex(self, threshold: int, summarise: Callable, report: Callable, max_cluster_size: int = 128, min_cluster_size: int = 1, embed: Embed | None = None) -> "GraphIndex":
        """Long descriptions summarised, then communities and their reports made anew; vectors follow changed descriptions."""
        from kgspark.operators.reindex import reindex_communities, reindex_descriptions

        described = reindex_descriptions(self.entities, threshold, summarise)
        entities, communities, summaries = reindex_communities(described, self.relations, report, max_cluster_size, min_cluster_size)
        before = self.entities.select("id", F.col("description").alias("_before"))
        changed = entities.join(before, "id").where(~F.col("description").eqNullSafe(F.col("_before"))).drop("_before")
        vectors = _put(self.entity_vectors, changed, embedding_text(F.col("entity_name"), F.col("description")), embed)
        return replace(self, entities=entities.select(*self.entities.columns), communities=communities, summaries=summaries, entity_vectors=vectors)


def next_cluster_ids(communities: DataFrame) -> DataFrame:
    """``(level, cluster_id, id)`` of the number that follows the greatest of each level."""
    top = communities.groupBy("level").agg((F.max("cluster_id") + 1).alias("cluster_id"))
    return top.select("level", "cluster_id", community_id(F.col("level"), F.col("cluster_id")).alias("id"))
