"""Point lookups, filters and first-seen removal of repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key: the greatest by ``order``, without a sort of the groups."""
    whole = F.struct(*[F.col(c) for c in order], F.struct("*").alias("row"))
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row")).select("row.*")


def first_seen(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row of smallest position for each key."""
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(F.struct(*rows.columns), position).alias("row")).select("row.*")


def lookup(requests: DataFrame, table: DataFrame, key: str = "id", fields: list[str] | None = None) -> DataFrame:
    """Rows of ``table`` in the order of ``requests(pos, <key>)``; nulls where the key is unknown."""
    columns = fields or [c for c in table.columns if c != key]
    return requests.join(table.select(key, *columns), key, "left").select("pos", key, *columns)


def missing_keys(keys: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Requested keys the table does not hold, each once."""
    return keys.select(key).where(F.col(key).isNotNull()).distinct().join(table.select(key), key, "left_anti")


def repeated_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    """Keys that occur more than once, with their number; a request must have none."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(rows: DataFrame, key: str = "id") -> None:
    bad = [r[0] for r in repeated_ids(rows, key).limit(5).collect()]
    if bad:
        raise ValueError(f"repeated {key} in one request: {bad}")


def with_known_endpoints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations both of whose ends are entities."""
    ids = entities.select("id").distinct()
    for end in ("subject_id", "object_id"):
        relations = relations.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return relations


def without_isolated(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations between known entities, and the entities that still have one."""
    kept = with_known_endpoints(relations, entities)
    ends = kept.select(F.explode(F.array("subject_id", "object_id")).alias("id")).distinct()
    return entities.join(ends, "id", "left_semi"), kept


def long_descriptions(entities: DataFrame, threshold: int) -> DataFrame:
    from kgspark.functions.text import fragments

    return entities.where(F.size(fragments(F.col("description"))) > threshold)


def obsolete_entities(entities: DataFrame, obsolete: DataFrame) -> DataFrame:
    """Entities all of whose documents are in ``obsolete(doc_id)``; entities without documents stay.

    Works on document references one by one, so the obsolete list may be of any size.
    """
    refs = entities.select("id", F.explode(F.array_distinct("documents_id")).alias("doc_id"))
    gone = refs.join(obsolete.select("doc_id").distinct().withColumn("gone", F.lit(1)), "doc_id", "left")
    all_gone = gone.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count("gone").alias("g")).where("n = g")
    return entities.join(all_gone.select("id"), "id", "left_semi")


def in_communities_of(rows: DataFrame, communities: DataFrame, least: int, key: str = "id") -> DataFrame:
    """Rows whose community has at least ``least`` entities; rows without community row stay."""
    if least <= 1:
        return rows
    sizes = communities.select(F.col("id").alias(key), F.size("entity_ids").alias("_size"))
    return rows.join(sizes, key, "left").where(F.col("_size").isNull() | (F.col("_size") >= least)).drop("_size")


def shallow_clusters(clusters: Column, deepest: int = 2) -> Column:
    return F.filter(clusters, lambda c: F.coalesce(c["level"], F.lit(9999)) <= deepest)


# Russian phrases that say there is no relation.
_NO_RELATION = r"(?i)(нет (?:прямой |явной )?(?:связи|отношени)|отсутству(?:ет|ют) (?:связ|отношени)|не связан|не указан|не упомина)"


def stated_relations(rows: DataFrame, column: str = "description") -> DataFrame:
    """Rows whose text, without a bullet, says something other than that there is no relation."""
    bare = F.trim(F.regexp_replace(column, r"^\s*(?:[-*•]|\d+[.)])\s*", ""))
    return rows.withColumn(column, bare).where((bare != "") & ~bare.rlike(r"^[-–—.]+$") & ~bare.rlike(_NO_RELATION))


def found_rows(hits: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Hits with the columns of their rows; hits whose row is gone are dropped."""
    return hits.join(table, key)


def long_texts(rows: DataFrame, column: str, least: int) -> DataFrame:
    """Rows whose stripped text has at least ``least`` characters."""
    return rows.where(F.length(F.trim(column)) >= least)


def with_endpoints(relations: DataFrame) -> DataFrame:
    """Relations that name both ends."""
    return relations.where("subject_id IS NOT NULL AND object_id IS NOT NULL")


def good_enough(rated: DataFrame, least: float, column: str = "rating") -> DataFrame:
    """Rows rated at least ``least``; rows without a rating are left out."""
    return rated.where(F.col(column) >= least)


def answered(responses: DataFrame, column: str = "response") -> DataFrame:
    """Rows that have a response; failed calls left it null."""
    return responses.where(F.col(column).isNotNull())


def distinct_texts(rows: DataFrame, text: str, key: str) -> DataFrame:
    """The smallest key for each different stripped text."""
    return rows.where(F.col(text).isNotNull()).groupBy(F.trim(text).alias("_text")).agg(F.min(key).alias(key)).select(key)


def unprocessed_texts(rows: DataFrame, text: str, stored: DataFrame) -> DataFrame:
    """Rows whose text, by the id it would get, is not among ``stored(doc_id)``."""
    from kgspark.functions.ids import doc_id

    done = stored.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_h")).distinct()
    return rows.where(F.col(text).isNotNull()).withColumn("_h", doc_id(F.col(text))).join(done, "_h", "left_anti").drop("_h")


def members_of(communities: DataFrame, entities: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """``(community, kind, place, member)``: known members of each community in the order of its lists, entities, then relations.

    A member named twice counts once, at its first place.
    """
    def part(column: str, kind: str, table: DataFrame) -> DataFrame:
        m = communities.select(F.col("id").alias("community"), F.posexplode(F.array_distinct(column)).alias("place", "member"))
        return m.join(table.select(F.col("id").alias("member")), "member", "left_semi").select("community", F.lit(kind).alias("kind"), "place", "member")

    out = part("entity_ids", "entity", entities)
    return out if relations is None else out.unionByName(part("relation_ids", "relation", relations))


def top_clusters(communities: DataFrame) -> DataFrame:
    """The greatest cluster number of each level."""
    return communities.groupBy("level").agg(F.max("cluster_id").alias("top"))


def lookup_saving(refs: DataFrame, column: str) -> DataFrame:
    """How many references there are and how many different rows they need, one row."""
    return refs.where(F.col(column).isNotNull()).agg(F.count(F.lit(1)).alias("total_hits"), F.countDistinct(column).alias("unique_ids"))


def most_common(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values and their numbers; ties by value."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(k)
