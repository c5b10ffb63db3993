"""Queries of the problems that belong to the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators.references import orphan_references, orphan_report


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every reference to a missing, deleted or late chunk or entity."""
    chunks = spark.read.parquet(f"{sf}/kv_chunks.parquet")
    entities = spark.read.parquet(f"{sf}/entity_rows.parquet")
    relations = spark.read.parquet(f"{sf}/relation_rows.parquet")
    communities = spark.read.parquet(f"{sf}/kv_community.parquet")

    def parent(df, kind):
        return df.select(F.lit(kind).alias("kind"), F.col("id").alias("key"), "ingested_at", "deleted_at")

    def refs(df, table, kind, keys):
        return df.select(
            F.lit(table).alias("table_name"),
            F.lit(kind).alias("kind"),
            "row_id",
            "ingested_at",
            F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), k.alias("ref_ids")) for f, k in keys])).alias("x"),
        ).select(
            "table_name", "x.field_name", "kind", "row_id", F.explode(F.array_distinct("x.ref_ids")).alias("ref_id"), "ingested_at"
        )

    references = (
        refs(entities, "entity_rows", "chunk", [("source_chunk_id", F.col("source_chunk_id"))])
        .unionByName(
            refs(relations, "relation_rows", "entity", [(c, F.array(c)) for c in ("subject_id", "object_id")])
        )
        .unionByName(refs(communities, "kv_community", "entity", [("entity_ids", F.col("entity_ids"))]))
    )
    return orphan_references(parent(chunks, "chunk").unionByName(parent(entities, "entity")), references)


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references counted per table, field, state and month."""
    return orphan_report(p5_found(spark, sf))


_P5_SQL = """
WITH parents AS (
  SELECT 'chunk' AS kind, id AS key, min(ingested_at) AS first_at, bool_and(deleted_at IS NOT NULL) AS gone
  FROM kv_chunks WHERE id IS NOT NULL GROUP BY id
  UNION ALL
  SELECT 'entity', id, min(ingested_at), bool_and(deleted_at IS NOT NULL) FROM entity_rows WHERE id IS NOT NULL GROUP BY id
), refs AS (
  SELECT 'entity_rows' AS table_name, 'source_chunk_id' AS field_name, 'chunk' AS kind, row_id, unnest(source_chunk_id) AS ref_id, ingested_at FROM entity_rows
  UNION ALL SELECT 'relation_rows', 'subject_id', 'entity', row_id, subject_id, ingested_at FROM relation_rows
  UNION ALL SELECT 'relation_rows', 'object_id', 'entity', row_id, object_id, ingested_at FROM relation_rows
  UNION ALL SELECT 'kv_community', 'entity_ids', 'entity', row_id, unnest(entity_ids), ingested_at FROM kv_community
), found AS (
  SELECT DISTINCT r.table_name, r.field_name, r.row_id, r.ref_id,
    CASE WHEN p.key IS NULL THEN 'missing' WHEN p.gone THEN 'deleted' WHEN p.first_at > r.ingested_at THEN 'late' END AS ref_state,
    strftime(r.ingested_at, '%Y-%m') AS month_key
  FROM refs r LEFT JOIN parents p ON p.kind = r.kind AND p.key = r.ref_id
  WHERE r.ref_id IS NOT NULL
)
"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
SQL = {
    "p5_found": _P5_SQL + "SELECT * FROM found WHERE ref_state IS NOT NULL",
    "p5_report": _P5_SQL
    + """SELECT table_name, field_name, month_key, ref_state, count(*) AS n_refs, count(DISTINCT row_id) AS n_rows
FROM found WHERE ref_state IS NOT NULL GROUP BY ALL""",
}
