"""Consistency of the stored tables: every check is an anti-join that must be empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators.neighbourhood import chunk_refs


def _absent(refs: DataFrame, table: DataFrame, check: str, kind: str) -> DataFrame:
    ids = refs.toDF("id").where("id IS NOT NULL").distinct()
    return ids.join(table.select("id").distinct(), "id", "left_anti").select(F.lit(check).alias("check_name"), F.lit(kind).alias("id_kind"), "id")


def source_chunk_references(entities: DataFrame, relations: DataFrame, chunks: DataFrame) -> DataFrame:
    refs = chunk_refs(entities).select("chunk_id").union(chunk_refs(relations).select("chunk_id"))
    return _absent(refs, chunks, "source_chunk_references", "chunk")


def relation_endpoints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Missing entities, and the relations that name them."""
    e = relations.select(F.col("id").alias("relation_id"), F.explode(F.array("subject_id", "object_id")).alias("id")).where("id IS NOT NULL")
    bad = e.join(entities.select("id").distinct(), "id", "left_anti")
    name = F.lit("relation_endpoints").alias("check_name")
    return bad.select(name, F.lit("entity").alias("id_kind"), "id").union(bad.select(name, F.lit("relation"), "relation_id")).distinct()


def community_references(communities: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Members that do not exist, and communities that are broken by them or by a null list."""
    parts = []
    name = F.lit("community_references").alias("check_name")
    for column, kind, table in (("entity_ids", "entity", entities), ("relation_ids", "relation", relations)):
        refs = communities.select(F.col("id").alias("community"), F.explode(column).alias("id")).where("id IS NOT NULL")
        bad = refs.join(table.select("id").distinct(), "id", "left_anti")
        parts += [bad.select(name, F.lit(kind).alias("id_kind"), "id"), bad.select(name, F.lit("community"), "community")]
        parts.append(communities.where(F.col(column).isNull()).select(name, F.lit("community"), "id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def representations(rows: DataFrame, vectors: DataFrame, kind: str) -> DataFrame:
    """Rows without a vector, and vectors without a row."""
    return _absent(rows.select("id"), vectors, f"{kind}_vector_representations", kind).union(_absent(vectors.select("id"), rows, f"{kind}_vector_endpoints", kind))


def check_consistency(entities: DataFrame, relations: DataFrame, chunks: DataFrame, communities: DataFrame, vectors: dict[str, DataFrame]) -> DataFrame:
    """All checks as ``(check_name, id_kind, id)``; an empty result is a consistent store."""
    out = source_chunk_references(entities, relations, chunks).union(relation_endpoints(relations, entities)).union(community_references(communities, entities, relations))
    for kind, rows in (("entity", entities), ("relation", relations), ("chunk", chunks)):
        if kind in vectors:
            out = out.union(representations(rows, vectors[kind], kind))
    return out


def report_text(issues: DataFrame, most: int = 100) -> str:
    """The report as text; each check lists at most ``most`` ids."""
    # Rows are ranked before they are gathered, so a list has at most ``most`` ids.
    from pyspark.sql import Window

    w = Window.partitionBy("check_name", "id_kind").orderBy("id")
    few = issues.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    rows = few.groupBy("check_name", "id_kind").agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("ids")).orderBy("check_name", "id_kind").collect()
    return "\n".join(f"{r['check_name']} [{r['id_kind']}]: {r['ids']}" for r in rows) or "-"
