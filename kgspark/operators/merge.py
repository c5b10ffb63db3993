"""Grouping of mentions and merging of stored rows by content-addressed id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions import ids
from kgspark.functions.text import merge_descriptions


def union_of(column: str) -> Column:
    """Sorted distinct members of all lists of a group."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(column, F.array().cast("array<string>"))))))


def group_entities(mentions: DataFrame) -> DataFrame:
    """Entities from ``mentions(entity_name, entity_type, description, source_chunk_id)``.

    Null names or types are left out; duplicate_count counts non-null descriptions.
    """
    keyed = mentions.where("entity_name IS NOT NULL AND entity_type IS NOT NULL")
    return (
        keyed.groupBy("entity_name", "entity_type")
        .agg(
            F.array_sort(F.collect_list("description")).alias("descriptions"),
            F.count("description").alias("duplicate_count"),
            union_of("source_chunk_id").alias("source_chunk_id"),
        )
        .withColumn("id", ids.entity_id(F.col("entity_name"), F.col("entity_type")))
    )


def group_relations(mentions: DataFrame) -> DataFrame:
    """Relations from mentions with ``pos``: first names, distinct descriptions by line in first-seen order, mean strength."""
    seen = F.array_sort(F.collect_list(F.struct("pos", "description")))
    texts = F.array_distinct(F.filter(F.transform(seen, lambda x: x["description"]), lambda d: d.isNotNull()))
    return (
        mentions.where("subject_id IS NOT NULL AND object_id IS NOT NULL AND relation_type IS NOT NULL")
        .groupBy("subject_id", "object_id", "relation_type")
        .agg(
            F.min_by("subject_name", "pos").alias("subject_name"),
            F.min_by("object_name", "pos").alias("object_name"),
            F.array_join(texts, "\n").alias("description"),
            F.avg("relation_strength").alias("relation_strength"),
            union_of("source_chunk_id").alias("source_chunk_id"),
            F.count("description").alias("duplicate_count"),
        )
        .withColumn("id", ids.relation_id(F.col("subject_id"), F.col("object_id"), F.col("relation_type")))
    )


def _richest_first(*columns: str) -> Column:
    """Rows of a group by number of chunks, most first, then in their order of arrival."""
    row = F.struct((-F.coalesce(F.size("source_chunk_id"), F.lit(0))).alias("fewer"), F.col("pos"), *columns)
    return F.array_sort(F.collect_list(row))


def merge_entities(rows: DataFrame) -> DataFrame:
    """Entities with one id merged: the richest leads, fragments and sources of all are joined.

    ``rows`` have ``pos``, their order of arrival. A single row keeps its description.
    """
    g = rows.groupBy("id").agg(
        _richest_first("entity_name", "entity_type", "description").alias("rows"),
        union_of("source_chunk_id").alias("source_chunk_id"),
        union_of("documents_id").alias("documents_id"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("clusters", F.array().cast("array<struct<level:int,cluster_id:int>>")))))).alias("clusters"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    texts = F.transform("rows", lambda r: r["description"])
    lead = F.col("rows")[0]
    return g.select(
        "id", lead["entity_name"].alias("entity_name"), lead["entity_type"].alias("entity_type"),
        F.when(F.size("rows") == 1, lead["description"]).otherwise(merge_descriptions(F.filter(texts, lambda t: t.isNotNull()))).alias("description"),
        "source_chunk_id", "documents_id", "clusters", "n_rows",
    )


def merge_relations(rows: DataFrame) -> DataFrame:
    """Relations with one id merged like entities; the strength is the plain mean of the rows."""
    g = rows.groupBy("id").agg(
        _richest_first("subject_id", "object_id", "subject_name", "object_name", "relation_type", "description").alias("rows"),
        union_of("source_chunk_id").alias("source_chunk_id"),
        F.avg("relation_strength").alias("relation_strength"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    texts = F.transform("rows", lambda r: r["description"])
    lead = F.col("rows")[0]
    return g.select(
        "id", *[lead[c].alias(c) for c in ("subject_id", "object_id", "subject_name", "object_name", "relation_type")],
        F.when(F.size("rows") == 1, lead["description"]).otherwise(merge_descriptions(F.filter(texts, lambda t: t.isNotNull()))).alias("description"),
        "relation_strength", "source_chunk_id", "n_rows",
    )


def split_by_duplicates(grouped: DataFrame, threshold: int = 7) -> DataFrame:
    """Whether a grouped entity's descriptions are to be summarised; those that are not are joined as they are."""
    joined = F.array_join(F.filter("descriptions", lambda d: d.isNotNull()), " ")
    return grouped.withColumn("needs_summary", F.col("duplicate_count") > threshold).withColumn("description", F.when(~F.col("needs_summary"), joined))


def summarise(grouped: DataFrame, summariser, threshold: int = 7) -> DataFrame:
    """Descriptions: joined where few, by ``summariser(Series of lists) -> Series`` where many. A null summary keeps the joined text."""
    fn = F.pandas_udf(summariser, "string")
    joined = F.array_join(F.filter("descriptions", lambda d: d.isNotNull()), " ")
    many = grouped.where(F.col("duplicate_count") > threshold).withColumn("description", F.coalesce(fn("descriptions"), joined))
    few = grouped.where(F.col("duplicate_count") <= threshold).withColumn("description", joined)
    return few.unionByName(many)
