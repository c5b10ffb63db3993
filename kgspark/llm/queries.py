"""Queries of the problems for training data, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.llm.canonical import map_to_list
from kgspark.llm.leakage import leaked_items
from kgspark.llm.mixing import mix
from kgspark.llm.name_variants import name_variants
from kgspark.llm.near_duplicates import NearDuplicateSpec, near_duplicate_groups
from kgspark.llm.neighbours import nearest
from kgspark.llm.sentences import sentences
from kgspark.llm.splitting import split_oversized
from kgspark.llm.survivorship import survivors


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _p1_mapped(spark: SparkSession, sf: str) -> DataFrame:
    def one(table: str, column: str, reference: str) -> DataFrame:
        rows = _read(spark, sf, table).select(F.col("mention_id").alias("row_id"), F.col(column).alias("value"))
        return map_to_list(rows, _read(spark, sf, reference)).withColumn("table_name", F.lit(table))

    return one("entity_model", "entity_type", "entity_type_list").unionByName(one("relation_model", "relation_type", "relation_type_list"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Typed values that are no name of their list, and the name each stands for."""
    mapped = _p1_mapped(spark, sf).where("value <> canonical_name")
    return mapped.select("table_name", F.col("row_id").alias("mention_id"), "canonical_name").distinct()


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and different spellings for each name, and the unmatched values."""
    shown = F.when(F.col("canonical_name") == "UNMATCHED", F.col("value"))
    return _p1_mapped(spark, sf).groupBy("table_name", "canonical_name", shown.alias("unmatched_value")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("value").alias("n_spellings")
    )


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered pieces of every chunk of more than 200 words."""
    return split_oversized(_read(spark, sf, "kv_chunks"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of more than 200 words, and whether they had to be cut inside a sentence."""
    return p2_pieces(spark, sf).where("chunk_order_idx = 0").select("row_id", "cut_kind").distinct()


_P3 = NearDuplicateSpec(words=3, threshold=0.5)


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Each chunk that is like another one, with its group and number of links."""
    texts = _read(spark, sf, "kv_chunks").select(F.col("row_id").alias("node"), F.col("id").alias("text_id"), F.col("content").alias("text"))
    return near_duplicate_groups(texts, _P3)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of different chunk ids in one group of edited copies."""
    g = p3_groups(spark, sf).where(F.col("text_id").isNotNull()).select("group_id", "text_id").distinct()
    a, b = g.withColumnRenamed("text_id", "chunk_a"), g.withColumnRenamed("text_id", "chunk_b")
    return a.join(b, "group_id").where("chunk_a < chunk_b").select("chunk_a", "chunk_b").distinct()


def _p4_rows(spark: SparkSession, sf: str) -> DataFrame:
    entities = _read(spark, sf, "entity_rows").select(
        F.lit("entity").alias("record_kind"), "id", "row_id", "description", F.col("source_chunk_id").alias("chunks"), "trust_level", "updated_at"
    )
    relations = _read(spark, sf, "relation_rows").select(
        F.lit("relation").alias("record_kind"), "id", "row_id", "description", F.lit(None).cast("array<string>").alias("chunks"), "trust_level", "updated_at"
    )
    return entities.unionByName(relations)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The row that survives for each repeated id and field."""
    return survivors(_p4_rows(spark, sf)).select("record_kind", "id", "field_name", "row_id").distinct()


def p4_records(spark: SparkSession, sf: str) -> DataFrame:
    """One record for each repeated id, with its surviving field values."""
    return survivors(_p4_rows(spark, sf)).groupBy("record_kind", "id").agg(
        F.max("description").alias("description"), F.max(F.array_join("source_chunk_id", ",")).alias("source_chunk_id")
    )


_P4_SQL = """
WITH r AS (
  SELECT 'entity' AS record_kind, id, row_id, description AS d, source_chunk_id AS c, trust_level AS t, updated_at AS u FROM entity_rows
  UNION ALL SELECT 'relation', id, row_id, description, NULL, trust_level, updated_at FROM relation_rows
), m AS (
  SELECT *, rtrim(regexp_replace(d, '\\s*(\\[cut\\]|\\.\\.\\.|…)\\s*$', '')) AS stem FROM r
  WHERE (record_kind, id) IN (SELECT (record_kind, id) FROM r GROUP BY record_kind, id HAVING count(*) > 1)
), ok AS (
  SELECT * FROM m WHERE d IS NOT NULL AND lower(trim(d, ' ()')) NOT IN ('tbd','todo','n/a','none','null','unknown','no description','?','-','...','')
), usable AS (
  SELECT * FROM ok a WHERE NOT EXISTS (SELECT 1 FROM ok b WHERE b.record_kind = a.record_kind AND b.id = a.id AND
    (starts_with(b.stem, a.stem) AND length(b.stem) > length(a.stem) OR a.stem = b.stem AND a.stem <> rtrim(a.d) AND b.stem = rtrim(b.d)))
), best AS (
  SELECT record_kind, id, 'description' AS field_name, row_id, d, NULL AS c,
    row_number() OVER (PARTITION BY record_kind, id ORDER BY t DESC NULLS LAST, u DESC NULLS LAST, row_id) AS k FROM usable
  UNION ALL
  SELECT record_kind, id, 'source_chunk_id', row_id, NULL, array_to_string(c, ','),
    row_number() OVER (PARTITION BY record_kind, id ORDER BY len(list_distinct(c)) DESC, row_id) FROM m WHERE len(list_distinct(c)) > 0
)
"""


def _p6_lists(spark: SparkSession, sf: str, least: float | None) -> DataFrame:
    points = _read(spark, sf, "points").select("id", F.col("dense_embedding").alias("vector"))
    return nearest(points, k=5, min_similarity=least)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs in which one vector is among the other's 5 most similar, all of 0.85 or more."""
    full = _p6_lists(spark, sf, 0.85).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("id"))).where("n = 5")
    return full.select(F.least("id", "neighbour").alias("point_a"), F.greatest("id", "neighbour").alias("point_b")).distinct()


def p6_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 most similar vectors of every usable vector, however far."""
    return _p6_lists(spark, sf, None).select("id", "neighbour", F.round("similarity", 4).alias("similarity"), "place")


# Types of entity_type_list that are persons or organisations, and the rest.
_AGENTS = ("PERSON", "GUILD", "MERCHANT_HOUSE", "OBSERVATORY", "HARBOUR_MASTER")
_OTHERS = (
    "SHIP", "SHIPYARD", "HARBOUR", "LIGHTHOUSE", "SETTLEMENT", "WATERWAY", "MOUNTAIN_PASS", "ISLAND", "TREATY", "LEDGER", "FESTIVAL", "TRADE", "TRADE_ROUTE",
    "EPIDEMIC", "INSTRUMENT", "CROP", "MINERAL", "COINAGE", "MANUSCRIPT", "TOLL_DUTY", "STORM_EVENT", "DOCTRINE", "TIME_SPAN",
)


def p7_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Each name of a person or organisation and the entity it stands for."""
    columns = [F.col("entity_name").alias("name"), F.col("entity_type").alias("type")]
    names = _read(spark, sf, "entity_rows").select(*columns).unionByName(_read(spark, sf, "entity_model").select(*columns))
    return name_variants(names, _AGENTS, _OTHERS)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of spellings of one person or organisation."""
    e = p7_entities(spark, sf)
    a, b = e.withColumnRenamed("name", "name_a"), e.withColumnRenamed("name", "name_b")
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the test items that leaked into them."""
    return leaked_items(_read(spark, sf, "documents"), _read(spark, sf, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    """Each leaked test item and the number of documents that hold some of it."""
    found = leaked_items(_read(spark, sf, "documents"), _read(spark, sf, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_windows").alias("most_windows"), F.round(F.max("containment"), 6).alias("most_contained"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources whose target share the mix cannot reach within its repeats."""
    _, report = mix(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"))
    return report.where(F.col("cannot_reach") & (F.col("reached_size") < F.col("target_size"))).select("source")


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached size and share of each source."""
    return mix(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"))[1]


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of the mix and how often each is used."""
    return mix(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"))[0]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as its sentences, headings and list lines."""
    return sentences(_read(spark, sf, "documents")).distinct()


QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p4_records": p4_records,
    "p6_found": p6_found,
    "p6_neighbours": p6_neighbours,
    "p7_found": p7_found,
    "p7_entities": p7_entities,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p9_found": p9_found,
    "p9_shares": p9_shares,
    "p9_mix": p9_mix,
    "p10_found": p10_found,
}
SQL = {
    "p4_found": _P4_SQL + "SELECT record_kind, id, field_name, row_id FROM best WHERE k = 1",
    "p4_records": _P4_SQL + "SELECT record_kind, id, max(d) AS description, max(c) AS source_chunk_id FROM best WHERE k = 1 GROUP BY ALL",
    "p9_found": """
WITH s AS (SELECT source, sum(strlen(text)) AS size FROM documents WHERE source IN (SELECT source FROM mix_targets) GROUP BY source)
SELECT t.source FROM mix_targets t LEFT JOIN s USING (source)
WHERE t.target_share * (SELECT sum(size) FROM s) > t.max_repeats * coalesce(s.size, 0)""",
}
