"""Upserts, deletions with cascades, and renumbering, as new versions of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions.ids import community_id
from kgspark.operators.lookup import require_unique
from kgspark.operators.merge import merge_entities, merge_relations
from kgspark.operators.ranking import running_total


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id", last: str | None = None) -> DataFrame:
    """Rows replaced or added by key; of repeated incoming keys the greatest ``last`` counts."""
    new = incoming if last is None else incoming.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*incoming.columns), last).alias("r")).select("r.*")
    return existing.join(new.select(key), key, "left_anti").unionByName(new.select(*existing.columns))


def update(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Like upsert, but every incoming key must exist."""
    if incoming.join(existing.select(key), key, "left_anti").limit(1).count():
        raise ValueError("an update names rows that do not exist")
    return upsert(existing, incoming, key)


def merge_upsert_entities(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming entities merged with stored ones of the same id; a repeated id in the request is an error."""
    require_unique(incoming)
    touched = existing.join(incoming.select("id"), "id", "left_semi").withColumn("pos", F.lit(0))
    merged = merge_entities(touched.unionByName(incoming.withColumn("pos", F.lit(1)))).drop("n_rows")
    return existing.join(incoming.select("id"), "id", "left_anti").unionByName(merged.select(*existing.columns))


def merge_upsert_relations(existing: DataFrame, incoming: DataFrame, entities: DataFrame) -> DataFrame:
    """Incoming relations merged with stored ones; both ends must exist."""
    require_unique(incoming)
    ends = incoming.select(F.explode(F.array("subject_id", "object_id")).alias("id"))
    if ends.join(entities.select("id"), "id", "left_anti").limit(1).count():
        raise ValueError("a relation names an entity that does not exist")
    touched = existing.join(incoming.select("id"), "id", "left_semi").withColumn("pos", F.lit(0))
    merged = merge_relations(touched.unionByName(incoming.withColumn("pos", F.lit(1)))).drop("n_rows")
    return existing.join(incoming.select("id"), "id", "left_anti").unionByName(merged.select(*existing.columns))


def delete_entities(entities: DataFrame, relations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities without the named ones, relations without those that touch them."""
    gone = ids.select("id").distinct()
    kept = relations
    for end in ("subject_id", "object_id"):
        kept = kept.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return entities.join(gone, "id", "left_anti"), kept.select(*relations.columns)


def delete_relations(relations: DataFrame, specs: DataFrame) -> DataFrame:
    """Relations without those of ``specs(subject_id, object_id, relation_id)``; null relation_id means all of the pair."""
    s = specs.select(F.col("subject_id").alias("_s"), F.col("object_id").alias("_o"), F.col("relation_id").alias("_r"))
    hit = (F.col("subject_id") == F.col("_s")) & (F.col("object_id") == F.col("_o")) & (F.col("_r").isNull() | (F.col("_r") == F.col("id")))
    return relations.join(s, hit, "left_anti")


def _citing(rows: DataFrame, chunks: DataFrame, shared: bool) -> DataFrame:
    """Ids of rows that cite a deleted chunk; with ``shared`` only those that cite no other."""
    refs = rows.select("id", F.explode(F.array_distinct("source_chunk_id")).alias("chunk"))
    marked = refs.join(chunks.select(F.col("id").alias("chunk"), F.lit(1).alias("gone")).distinct(), "chunk", "left")
    counts = marked.groupBy("id").agg(F.count("gone").alias("gone"), F.count(F.lit(1)).alias("all"))
    return counts.where("gone > 0 AND gone = all" if shared else "gone > 0").select("id")


def delete_chunks(
    chunks: DataFrame, entities: DataFrame, relations: DataFrame, ids: DataFrame, retain_shared: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks deleted with all entities and relations that cite them, and the relations at those entities.

    ``retain_shared`` keeps rows that another chunk backs too.
    """
    left, edges = delete_entities(entities, relations, _citing(entities, ids, retain_shared))
    edges = edges.join(_citing(relations, ids, retain_shared), "id", "left_anti")
    return chunks.join(ids.select("id").distinct(), "id", "left_anti"), left, edges


def delete_communities(communities: DataFrame, summaries: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select("id").distinct()
    return communities.join(gone, "id", "left_anti"), summaries.join(gone, "id", "left_anti")


def new_chunks(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks of a batch that are not stored, each id once, the first by ``pos``."""
    once = batch.groupBy(F.col("id").alias("_k")).agg(F.min_by(F.struct(*batch.columns), "pos").alias("r")).select("r.*")
    return once.join(stored.select("id"), "id", "left_anti")


def remap_clusters(existing: DataFrame, local: DataFrame) -> DataFrame:
    """New numbers for ``local(level, cluster_id)`` after the greatest of ``existing`` on the level: ``(level, cluster_id, new_cluster_id, community_id)``."""
    top = existing.groupBy("level").agg(F.max("cluster_id").alias("top"))
    renumbered = running_total(local.select("level", "cluster_id").distinct(), F.lit(1), "level", ["cluster_id"], "n")
    out = renumbered.join(top, "level", "left")
    new = F.coalesce(F.col("top"), F.lit(-1)) + F.col("n")
    return out.select("level", "cluster_id", new.cast("int").alias("new_cluster_id"), community_id(F.col("level"), new).alias("community_id"))


def retype_entity(entities: DataFrame, relations: DataFrame, new_types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities under ``new_types(id, entity_type)`` with their new ids, and relations that follow them."""
    from kgspark.functions import ids as make

    t = new_types.select("id", F.col("entity_type").alias("_type"))
    changed = entities.join(t, "id").withColumn("new_id", make.entity_id(F.col("entity_name"), F.col("_type")))
    moves = changed.select("id", "new_id")
    renamed = changed.withColumn("entity_type", F.col("_type")).withColumn("id", F.col("new_id")).select(*entities.columns)
    out = entities.join(moves, "id", "left_anti").unionByName(renamed)
    r = relations
    for end in ("subject_id", "object_id"):
        r = r.join(moves.select(F.col("id").alias(end), F.col("new_id").alias("_n")), end, "left").withColumn(end, F.coalesce("_n", end)).drop("_n")
    moved = make.relation_id(F.col("subject_id"), F.col("object_id"), F.col("relation_type"))
    return out, r.withColumn("id", F.when(F.col("subject_id").isNull() | F.col("object_id").isNull(), F.col("id")).otherwise(moved)).select(*relations.columns)
