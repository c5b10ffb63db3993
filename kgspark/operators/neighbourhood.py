"""Neighbours, edges and sources around entities of a directed multigraph.

``relations`` are edge rows with ``id, subject_id, object_id, …``; seeds come as
``(query_id, id, pos)`` so that a whole batch of queries is one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ends(relations: DataFrame) -> DataFrame:
    """Each edge once for each of its different ends, with the other end."""
    e = F.explode(
        F.array_distinct(
            F.array(
                F.struct(F.col("subject_id").alias("node"), F.col("object_id").alias("other")),
                F.struct(F.col("object_id").alias("node"), F.col("subject_id").alias("other")),
            )
        )
    )
    return relations.withColumn("end", e).select("*", "end.node", "end.other").drop("end")


def incident_edges(seeds: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges in and out of each seed, in their stored direction; a loop once."""
    return seeds.join(ends(relations).withColumnRenamed("id", "relation_id"), F.col("node") == seeds["id"]).drop("node")


def edges_by_spec(specs: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges for each ``specs(pos, subject_id, object_id, relation_id)``; null relation_id takes all parallel edges."""
    e = relations.select("id", F.col("subject_id").alias("_s"), F.col("object_id").alias("_o"))
    on = (F.col("subject_id") == F.col("_s")) & (F.col("object_id") == F.col("_o")) & (F.col("relation_id").isNull() | (F.col("relation_id") == F.col("id")))
    return specs.join(e, on, "left").groupBy("pos", "subject_id", "object_id", "relation_id").agg(F.array_sort(F.collect_set("id")).alias("relation_ids"))


def degrees(relations: DataFrame) -> DataFrame:
    """Edge ends at each node; a loop counts twice."""
    return relations.select(F.explode(F.array("subject_id", "object_id")).alias("id")).where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def edge_degrees(edges: DataFrame, relations: DataFrame) -> DataFrame:
    """Sum of both ends' degrees for each ``edges(id, subject_id, object_id)``; unknown nodes count 0."""
    d = degrees(relations)
    s, o = d.select(F.col("id").alias("subject_id"), F.col("degree").alias("_ds")), d.select(F.col("id").alias("object_id"), F.col("degree").alias("_do"))
    total = F.coalesce("_ds", F.lit(0)) + F.coalesce("_do", F.lit(0))
    return edges.join(s, "subject_id", "left").join(o, "object_id", "left").select("id", total.alias("edge_degree"))


def ranked_relations(seeds: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations around each query's seeds, each once, strongest first, then in order of the seeds and ids."""
    around = ends(relations).withColumnRenamed("id", "relation_id").join(seeds.select("query_id", F.col("id").alias("node"), "pos"), "node")
    once = around.groupBy("query_id", "relation_id").agg(F.min("pos").alias("pos"), F.first("relation_strength").alias("relation_strength"), F.first("subject_id").alias("subject_id"), F.first("object_id").alias("object_id"))
    order = Window.partitionBy("query_id").orderBy(F.col("relation_strength").desc_nulls_last(), "pos", "relation_id")
    return once.withColumn("rank", F.row_number().over(order) - 1)


def chunk_refs(rows: DataFrame) -> DataFrame:
    """``(id, chunk_id)``: the inverted index of source chunks."""
    return rows.select("id", F.explode(F.array_distinct("source_chunk_id")).alias("chunk_id")).where("chunk_id IS NOT NULL")


def ranked_chunks(seeds: DataFrame, entities: DataFrame, relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Source chunks of each query's seeds: by first seed that cites them, then by edges to neighbours that cite them too."""
    cited = chunk_refs(entities)
    own = seeds.join(cited, "id").groupBy("query_id", "chunk_id").agg(F.min(F.struct("pos", "id")).alias("s"))
    own = own.select("query_id", "chunk_id", "s.pos", F.col("s.id").alias("seed"))
    near = own.join(ends(relations).select(F.col("node").alias("seed"), "other"), "seed").where("seed <> other")
    shared = near.join(cited.select(F.col("id").alias("other"), "chunk_id"), ["other", "chunk_id"]).groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("n_edges"))
    found = own.join(shared, ["query_id", "chunk_id"], "left").na.fill(0, ["n_edges"]).join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy("pos", F.desc("n_edges"), "chunk_id")
    return found.select("query_id", "chunk_id", "pos", "n_edges", (F.row_number().over(order) - 1).alias("rank"))


def neighbour_chunks(seeds: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Chunks that seeds' direct neighbours cite, with the number of such neighbours."""
    near = seeds.join(ends(relations).select(F.col("node").alias("id"), "other"), "id").select("query_id", "other").distinct()
    return near.join(chunk_refs(entities).withColumnRenamed("id", "other"), "other").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("n_neighbours"))


def community_summaries(seeds: DataFrame, entities: DataFrame, summaries: DataFrame, deepest: int = 2) -> DataFrame:
    """Summaries of the communities the seeds belong to, down to a level."""
    from kgspark.functions.ids import community_id
    from kgspark.operators.lookup import shallow_clusters

    member = entities.select("id", F.explode(shallow_clusters(F.col("clusters"), deepest)).alias("c")).select("id", community_id(F.col("c.level"), F.col("c.cluster_id")).alias("community"))
    wanted = seeds.join(member, "id").select("query_id", "community").distinct()
    return wanted.join(summaries.select(F.col("id").alias("community"), "summary"), "community")


def document_ids(seeds: DataFrame, entities: DataFrame) -> DataFrame:
    """Documents of each query's seeds, sorted, each once."""
    refs = seeds.join(entities.select("id", F.explode("documents_id").alias("doc")), "id").where("doc IS NOT NULL")
    return refs.groupBy("query_id").agg(F.array_sort(F.collect_set("doc")).alias("documents_id"))


def resolve_names(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relation mentions with the ids of the entities they name in their chunk; unresolved ones dropped.

    Of equal names in a chunk the last by ``pos`` counts.
    """
    names = entities.groupBy("chunk_id", "entity_name").agg(F.max_by("id", "pos").alias("id"))
    s = names.select("chunk_id", F.col("entity_name").alias("source_entity"), F.col("id").alias("subject_id"))
    o = names.select("chunk_id", F.col("entity_name").alias("target_entity"), F.col("id").alias("object_id"))
    return relations.join(s, ["chunk_id", "source_entity"]).join(o, ["chunk_id", "target_entity"])


def ordered_pairs(entities: DataFrame) -> DataFrame:
    """All ordered pairs of different entities of a chunk, the input of pairwise relation extraction.

    Quadratic in the entities of one chunk by definition; a chunk is bounded by its size limit.
    """
    a = entities.select("chunk_id", F.col("entity_name").alias("source_entity"), F.col("pos").alias("_a"))
    b = entities.select("chunk_id", F.col("entity_name").alias("target_entity"), F.col("pos").alias("_b"))
    return a.join(b, "chunk_id").where("_a <> _b").drop("_a", "_b")


def shared_communities(relations: DataFrame, memberships: DataFrame) -> DataFrame:
    """``(level, cluster_id, relation_id)``: relations in every community that holds both ends."""
    m = memberships.select("level", "cluster_id", F.col("id").alias("subject_id"))
    n = memberships.select("level", "cluster_id", F.col("id").alias("object_id"))
    return relations.select(F.col("id").alias("relation_id"), "subject_id", "object_id").join(m, "subject_id").join(n, ["level", "cluster_id", "object_id"]).select("level", "cluster_id", "relation_id")
