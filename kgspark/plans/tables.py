"""The stored graph as the delivered tables show it: the latest row of each id that is not deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators.lookup import latest


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return latest(read(spark, sf, "entity_rows"), "id", "ingested_at", "row_id").where("deleted_at IS NULL")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return latest(read(spark, sf, "relation_rows"), "id", "ingested_at", "row_id")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return latest(read(spark, sf, "kv_chunks"), "id", "ingested_at", "row_id").where("deleted_at IS NULL")


def communities(spark: SparkSession, sf: str) -> DataFrame:
    return latest(read(spark, sf, "kv_community"), "id", "ingested_at", "row_id")


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a query whose seeds are the entities that name it, in order of their ids."""
    from pyspark.sql import Window

    refs = nodes(spark, sf).select(F.explode(F.array_distinct("documents_id")).alias("query_id"), "id").where("query_id IS NOT NULL")
    return refs.withColumn("pos", (F.row_number().over(Window.partitionBy("query_id").orderBy("id")) - 1).cast("int"))


def _one(name: str, table: str, extra: str = "") -> str:
    return f"""{name} AS (SELECT * EXCLUDE (k) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, row_id DESC) AS k FROM {table} WHERE id IS NOT NULL) WHERE k = 1{extra})"""


#: The same tables as common table expressions.
WITH = (
    "WITH "
    + ",\n".join(
        (
            _one("nodes", "entity_rows", " AND deleted_at IS NULL"),
            _one("edges", "relation_rows"),
            _one("chunks", "kv_chunks", " AND deleted_at IS NULL"),
            _one("communities", "kv_community"),
            """seeds AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) - 1 AS pos FROM (
  SELECT DISTINCT unnest(documents_id) AS query_id, id FROM nodes) WHERE query_id IS NOT NULL)""",
            """ends AS (SELECT DISTINCT * FROM (SELECT id AS relation_id, relation_strength, subject_id AS node, object_id AS other FROM edges
  UNION ALL SELECT id, relation_strength, object_id, subject_id FROM edges))""",
            "cites AS (SELECT DISTINCT id, unnest(source_chunk_id) AS chunk_id FROM nodes)",
        )
    )
    + "\n"
)
