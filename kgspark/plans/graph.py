"""Lookups, filters, joins, grouping and audits over the whole stored graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import ids, text
from kgspark.operators import audit, lookup, merge, mutate, neighbourhood
from kgspark.plans import tables as t
from kgspark.plans.tables import WITH

QUERIES: dict = {}
SQL: dict = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# Lookups and filters


@_query("prj1_lookup_ordered", WITH + "SELECT r.row_id AS pos, r.subject_id AS id, n.entity_name, n.entity_type FROM relation_rows r LEFT JOIN nodes n ON n.id = r.subject_id")
def _(spark, sf):
    requests = t.read(spark, sf, "relation_rows").select(F.col("row_id").alias("pos"), F.col("subject_id").alias("id"))
    return lookup.lookup(requests, t.nodes(spark, sf), fields=["entity_name", "entity_type"])


@_query("prj3_chunk_lookup", WITH + "SELECT pos, u.id, c.doc_id, c.chunk_order_idx FROM (SELECT row_id AS pos, unnest(source_chunk_id) AS id FROM entity_rows) u LEFT JOIN chunks c ON c.id = u.id")
def _(spark, sf):
    requests = t.read(spark, sf, "entity_rows").select(F.col("row_id").alias("pos"), F.explode("source_chunk_id").alias("id"))
    return lookup.lookup(requests, t.chunks(spark, sf), fields=["doc_id", "chunk_order_idx"])


@_query("prj5_all_ids", WITH + "SELECT id FROM nodes")
def _(spark, sf):
    return t.nodes(spark, sf).select("id")


@_query("prj7_embedding_text", WITH + "SELECT id, entity_name || ' - ' || description AS embedding_text FROM nodes UNION ALL SELECT id, description FROM edges")
def _(spark, sf):
    entity = t.nodes(spark, sf).select("id", F.concat("entity_name", F.lit(" - "), "description").alias("embedding_text"))
    return entity.unionByName(t.edges(spark, sf).select("id", F.col("description").alias("embedding_text")))


@_query("prj9_group_label", "SELECT mention_id, nullif(entity_type, '') AS label FROM entity_model")
def _(spark, sf):
    return t.read(spark, sf, "entity_model").select("mention_id", text.group_label(F.col("entity_type")).alias("label"))


@_query("flt3_community_size", WITH + """, seen AS (SELECT DISTINCT id FROM kv_community UNION SELECT 'com-unknown')
SELECT s.id FROM seen s LEFT JOIN communities c ON c.id = s.id WHERE c.id IS NULL OR c.entity_ids IS NULL OR len(c.entity_ids) >= 4""")
def _(spark, sf):
    seen = t.read(spark, sf, "kv_community").select("id").distinct().unionByName(spark.sql("SELECT 'com-unknown' AS id"))
    return lookup.in_communities_of(seen, t.communities(spark, sf), 4).select("id")


@_query("flt5_shallow_clusters", WITH + "SELECT id, len(list_filter(clusters, lambda c: coalesce(c.level, 9999) <= 0)) AS n FROM nodes")
def _(spark, sf):
    return t.nodes(spark, sf).select("id", F.size(lookup.shallow_clusters(F.col("clusters"), 0)).alias("n")).withColumn("n", F.when(F.col("n") >= 0, F.col("n")))


@_query("flt6_stated_relations", r"""SELECT row_id, d AS description FROM (SELECT row_id, trim(regexp_replace(description, '^\s*([-*•]|\d+[.)])\s*', '')) AS d FROM relation_rows)
WHERE d <> '' AND NOT regexp_matches(d, '^[-–—.]+$')""")
def _(spark, sf):
    return lookup.stated_relations(t.read(spark, sf, "relation_rows").select("row_id", "description"))


_FRAGMENTS = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce({0}, ''), '([.!?])\s+', '\1' || chr(7), 'g'), '\n+', chr(7), 'g'), chr(7)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"


@_query("flt7_long_descriptions", WITH + f"SELECT id FROM nodes WHERE description IS NOT NULL AND len({_FRAGMENTS.format('description')}) > 1")
def _(spark, sf):
    return lookup.long_descriptions(t.nodes(spark, sf), 1).select("id")


@_query("flt9_known_endpoints", WITH + "SELECT id FROM edges WHERE subject_id IN (SELECT id FROM nodes) AND object_id IN (SELECT id FROM nodes)")
def _(spark, sf):
    return lookup.with_known_endpoints(t.edges(spark, sf), t.nodes(spark, sf)).select("id")


@_query("flt10_long_texts", "SELECT doc_id FROM documents WHERE length(trim(text)) >= 80")
def _(spark, sf):
    return lookup.long_texts(t.read(spark, sf, "documents"), "text", 80).select("doc_id")


@_query("flt11_hits_with_endpoints", "SELECT row_id FROM relation_rows WHERE subject_id IS NOT NULL AND object_id IS NOT NULL")
def _(spark, sf):
    return lookup.with_endpoints(t.read(spark, sf, "relation_rows")).select("row_id")


@_query("flt13_missing_keys", WITH + "SELECT DISTINCT object_id AS id FROM relation_rows WHERE object_id IS NOT NULL AND object_id NOT IN (SELECT id FROM nodes)")
def _(spark, sf):
    return lookup.missing_keys(t.read(spark, sf, "relation_rows").select(F.col("object_id").alias("id")), t.nodes(spark, sf))


@_query("flt14_repeated_ids", "SELECT id, count(*) AS n FROM entity_rows GROUP BY id HAVING count(*) > 1")
def _(spark, sf):
    return lookup.repeated_ids(t.read(spark, sf, "entity_rows"))


@_query("flt15_obsolete_entities", WITH + """, gone AS (SELECT DISTINCT doc_id FROM kv_chunks WHERE lang = 'en')
SELECT id FROM nodes WHERE len(list_filter(documents_id, lambda d: d IS NOT NULL)) > 0 AND id NOT IN (
  SELECT id FROM (SELECT id, unnest(documents_id) AS d FROM nodes) WHERE d NOT IN (SELECT doc_id FROM gone WHERE doc_id IS NOT NULL))""")
def _(spark, sf):
    gone = t.read(spark, sf, "kv_chunks").where("lang = 'en'").select("doc_id").distinct()
    return lookup.obsolete_entities(t.nodes(spark, sf), gone).select("id")


@_query("join9_remove_isolated", WITH + """, kept AS (SELECT * FROM edges WHERE subject_id IN (SELECT id FROM nodes) AND object_id IN (SELECT id FROM nodes))
SELECT 'relation' AS kind, id FROM kept UNION ALL SELECT 'entity', id FROM nodes WHERE id IN (SELECT subject_id FROM kept UNION SELECT object_id FROM kept)""")
def _(spark, sf):
    entities, relations = lookup.without_isolated(t.nodes(spark, sf), t.edges(spark, sf))
    return relations.select(F.lit("relation").alias("kind"), "id").unionByName(entities.select(F.lit("entity").alias("kind"), "id"))


# Neighbourhood


@_query("join4_edges_by_spec", WITH + """SELECT r.row_id AS pos, r.subject_id, r.object_id, CASE WHEN r.relation_strength IS NOT NULL THEN r.id END AS relation_id,
  coalesce(list_sort(list(DISTINCT e.id) FILTER (WHERE e.id IS NOT NULL)), []) AS relation_ids
FROM relation_rows r LEFT JOIN edges e ON e.subject_id = r.subject_id AND e.object_id = r.object_id AND (r.relation_strength IS NULL OR e.id = r.id) GROUP BY ALL""")
def _(spark, sf):
    specs = t.read(spark, sf, "relation_rows").select(
        F.col("row_id").alias("pos"), "subject_id", "object_id", F.when(F.col("relation_strength").isNotNull(), F.col("id")).alias("relation_id")
    )
    return neighbourhood.edges_by_spec(specs, t.edges(spark, sf))


@_query("join5_incident_edges", WITH + "SELECT n.id, e.relation_id, e.other FROM nodes n JOIN ends e ON e.node = n.id")
def _(spark, sf):
    return neighbourhood.incident_edges(t.nodes(spark, sf).select("id"), t.edges(spark, sf)).select("id", "relation_id", "other")


@_query("join6_neighbour_chunks", WITH + """SELECT query_id, chunk_id, count(*) AS n_neighbours FROM (SELECT DISTINCT s.query_id, e.other FROM seeds s JOIN ends e ON e.node = s.id) q
JOIN cites c ON c.id = q.other WHERE chunk_id IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    return neighbourhood.neighbour_chunks(t.seeds(spark, sf), t.nodes(spark, sf), t.edges(spark, sf))


@_query("join7_ranked_relations", WITH + """SELECT query_id, relation_id, relation_strength, row_number() OVER (PARTITION BY query_id ORDER BY relation_strength DESC NULLS LAST, pos, relation_id) - 1 AS rank
FROM (SELECT query_id, relation_id, any_value(relation_strength) AS relation_strength, min(pos) AS pos FROM seeds s JOIN ends e ON e.node = s.id GROUP BY ALL)""")
def _(spark, sf):
    return neighbourhood.ranked_relations(t.seeds(spark, sf), t.edges(spark, sf)).select("query_id", "relation_id", "relation_strength", "rank")


@_query("join8_ranked_chunks", WITH + """, own AS (SELECT query_id, chunk_id, min(pos) AS pos, arg_min(s.id, pos) AS seed FROM seeds s JOIN cites c ON c.id = s.id WHERE chunk_id IS NOT NULL GROUP BY ALL),
shared AS (SELECT query_id, o.chunk_id, count(*) AS n FROM own o JOIN ends e ON e.node = o.seed AND e.other <> o.seed JOIN cites c ON c.id = e.other AND c.chunk_id = o.chunk_id GROUP BY ALL),
found AS (SELECT o.query_id, o.chunk_id, pos, coalesce(n, 0) AS n_edges FROM own o LEFT JOIN shared s ON s.query_id = o.query_id AND s.chunk_id = o.chunk_id WHERE o.chunk_id IN (SELECT id FROM chunks))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, n_edges DESC, chunk_id) - 1 AS rank FROM found""")
def _(spark, sf):
    return neighbourhood.ranked_chunks(t.seeds(spark, sf), t.nodes(spark, sf), t.edges(spark, sf), t.chunks(spark, sf))


@_query("join11_resolve_names", """WITH n AS (SELECT chunk_id, entity_name, max(mention_id) AS id FROM entity_model GROUP BY ALL)
SELECT r.mention_id, s.id AS subject_id, o.id AS object_id FROM relation_model r JOIN n s ON s.chunk_id = r.chunk_id AND s.entity_name = r.source_entity
JOIN n o ON o.chunk_id = r.chunk_id AND o.entity_name = r.target_entity""")
def _(spark, sf):
    entities = t.read(spark, sf, "entity_model").select("chunk_id", "entity_name", F.col("mention_id").alias("id"), F.col("mention_id").alias("pos"))
    relations = t.read(spark, sf, "relation_model").select("mention_id", "chunk_id", "source_entity", "target_entity")
    return neighbourhood.resolve_names(relations, entities).select("mention_id", "subject_id", "object_id")


_SUMMARY_SQL = "SELECT id, 'level ' || level || ' with ' || coalesce(len(entity_ids), 0) || ' members' AS summary FROM communities"


def summaries(spark, sf):
    size = F.when(F.col("entity_ids").isNotNull(), F.size("entity_ids")).otherwise(0)
    return t.communities(spark, sf).select("id", F.concat(F.lit("level "), F.col("level").cast("string"), F.lit(" with "), size.cast("string"), F.lit(" members")).alias("summary"))


@_query("join12_community_summaries", WITH + f""", summaries AS ({_SUMMARY_SQL}),
m AS (SELECT id, unnest(clusters) AS c FROM nodes), w AS (SELECT DISTINCT query_id, 'com-' || md5(chr(0) || c.level || ':' || c.cluster_id) AS community FROM seeds JOIN m USING (id) WHERE c.level <= 2)
SELECT query_id, community, summary FROM w JOIN summaries s ON s.id = w.community""")
def _(spark, sf):
    return neighbourhood.community_summaries(t.seeds(spark, sf), t.nodes(spark, sf), summaries(spark, sf)).select("query_id", "community", "summary")


@_query("join13_community_members", WITH + """SELECT c.id AS community, n.id AS member, n.entity_name FROM (SELECT id, unnest(list_distinct(entity_ids)) AS m FROM communities) c JOIN nodes n ON n.id = c.m""")
def _(spark, sf):
    m = t.communities(spark, sf).select(F.col("id").alias("community"), F.explode(F.array_distinct("entity_ids")).alias("member"))
    return m.join(t.nodes(spark, sf).select(F.col("id").alias("member"), "entity_name"), "member")


@_query("join15_chunk_index", WITH + "SELECT chunk_id, list_sort(list(id)) AS entity_ids FROM cites WHERE chunk_id IS NOT NULL GROUP BY chunk_id")
def _(spark, sf):
    return neighbourhood.chunk_refs(t.nodes(spark, sf)).groupBy("chunk_id").agg(F.array_sort(F.collect_list("id")).alias("entity_ids"))


@_query("join18_ordered_pairs", """SELECT a.chunk_id, count(*) AS n_pairs FROM entity_model a JOIN entity_model b ON a.chunk_id = b.chunk_id AND a.mention_id <> b.mention_id GROUP BY ALL""")
def _(spark, sf):
    e = t.read(spark, sf, "entity_model").select("chunk_id", "entity_name", F.col("mention_id").alias("pos"))
    return neighbourhood.ordered_pairs(e).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_pairs"))


@_query("join20_shared_communities", WITH + """, m AS (SELECT DISTINCT id, c.level AS level, c.cluster_id AS cluster_id FROM (SELECT id, unnest(clusters) AS c FROM nodes))
SELECT a.level, a.cluster_id, e.id AS relation_id FROM edges e JOIN m a ON a.id = e.subject_id JOIN m b ON b.id = e.object_id AND a.level = b.level AND a.cluster_id = b.cluster_id""")
def _(spark, sf):
    return neighbourhood.shared_communities(t.edges(spark, sf), memberships(t.nodes(spark, sf)))


def memberships(entities):
    """Distinct ``(id, level, cluster_id)`` of the entities' clusters."""
    return entities.select("id", F.explode("clusters").alias("c")).select("id", "c.level", "c.cluster_id").distinct()


# Grouping and merging


@_query("agg1_group_entities", r"""SELECT 'ent-' || md5(chr(0) || entity_name || ' - ' || entity_type) AS id, entity_name, entity_type, count(description) AS duplicate_count,
  list_sort(list(DISTINCT chunk_id) FILTER (WHERE chunk_id IS NOT NULL)) AS source_chunk_id
FROM entity_model WHERE entity_name IS NOT NULL AND entity_type IS NOT NULL GROUP BY entity_name, entity_type""")
def _(spark, sf):
    m = t.read(spark, sf, "entity_model").withColumn("source_chunk_id", F.when(F.col("chunk_id").isNotNull(), F.array("chunk_id")))
    return merge.group_entities(m).select("id", "entity_name", "entity_type", "duplicate_count", "source_chunk_id")


@_query("agg2_group_relations", r"""SELECT subject_id, object_id, relation_type, arg_min(subject_name, row_id) AS subject_name, round(avg(relation_strength), 6) AS relation_strength, count(description) AS duplicate_count,
  list_aggregate(list_transform(list_sort(list_transform(map_entries(map_from_entries(list_reverse(list_sort(list(struct_pack(k := description, v := row_id)) FILTER (WHERE description IS NOT NULL))))), lambda e: struct_pack(v := e.value, k := e.key))), lambda e: e.k), 'string_agg', chr(10)) AS description
FROM relation_rows WHERE subject_id IS NOT NULL AND object_id IS NOT NULL AND relation_type IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    m = t.read(spark, sf, "relation_rows").withColumn("pos", F.col("row_id"))
    g = merge.group_relations(m).withColumn("relation_strength", F.round("relation_strength", 6)).withColumn("description", F.nullif("description", F.lit("")))
    return g.select("subject_id", "object_id", "relation_type", "subject_name", "relation_strength", "duplicate_count", "description")


SQL["agg2_group_relations"] = r"""WITH d AS (SELECT subject_id, object_id, relation_type, description, min(row_id) AS p FROM relation_rows WHERE description IS NOT NULL GROUP BY ALL),
j AS (SELECT subject_id, object_id, relation_type, string_agg(description, chr(10) ORDER BY p) AS description FROM d GROUP BY ALL)
SELECT r.subject_id, r.object_id, r.relation_type, arg_min(subject_name, row_id) AS subject_name, round(avg(relation_strength), 6) AS relation_strength, count(r.description) AS duplicate_count, nullif(any_value(j.description), '') AS description
FROM relation_rows r LEFT JOIN j ON j.subject_id = r.subject_id AND j.object_id = r.object_id AND j.relation_type = r.relation_type
WHERE r.subject_id IS NOT NULL AND r.object_id IS NOT NULL AND r.relation_type IS NOT NULL GROUP BY r.subject_id, r.object_id, r.relation_type"""


_MERGED = r"""WITH f AS (SELECT id, row_id, len(coalesce(source_chunk_id, [])) AS n, unnest(%s) AS piece, generate_subscripts(%s, 1) AS nth FROM {0} WHERE id IS NOT NULL),
g AS (SELECT id, lower(piece) AS k, arg_min(piece, struct_pack(a := -n, b := row_id, c := nth)) AS piece, min(struct_pack(a := -n, b := row_id, c := nth)) AS o FROM f GROUP BY ALL),
j AS (SELECT id, string_agg(piece, ' ' ORDER BY o) AS d FROM g GROUP BY id)""" % (_FRAGMENTS.format("description"), _FRAGMENTS.format("description"))
_LIST = "list_sort(list_distinct(flatten(list(coalesce({0}, [])))))"


@_query("agg3_merge_entities", _MERGED.format("entity_rows") + f"""
SELECT e.id, count(*) AS n_rows, arg_min(e.entity_name, struct_pack(a := -len(coalesce(source_chunk_id, [])), b := row_id)) AS entity_name,
  CASE WHEN count(*) = 1 THEN any_value(e.description) ELSE coalesce(any_value(j.d), '') END AS description,
  {_LIST.format("source_chunk_id")} AS source_chunk_id, {_LIST.format("documents_id")} AS documents_id
FROM entity_rows e LEFT JOIN j ON j.id = e.id GROUP BY e.id""")
def _(spark, sf):
    m = merge.merge_entities(t.read(spark, sf, "entity_rows").withColumn("pos", F.col("row_id")))
    return m.select("id", "n_rows", "entity_name", "description", "source_chunk_id", "documents_id")


@_query("agg4_merge_relations", _MERGED.format("relation_rows") + f"""
SELECT e.id, count(*) AS n_rows, round(avg(relation_strength), 6) AS relation_strength,
  CASE WHEN count(*) = 1 THEN any_value(e.description) ELSE coalesce(any_value(j.d), '') END AS description, {_LIST.format("source_chunk_id")} AS source_chunk_id
FROM relation_rows e LEFT JOIN j ON j.id = e.id GROUP BY e.id""")
def _(spark, sf):
    m = merge.merge_relations(t.read(spark, sf, "relation_rows").withColumn("pos", F.col("row_id")))
    return m.select("id", "n_rows", F.round("relation_strength", 6).alias("relation_strength"), "description", "source_chunk_id")


@_query("agg6_split_by_duplicates", """SELECT needs_summary, count(*) AS n FROM (SELECT count(description) > 7 AS needs_summary FROM entity_model
WHERE entity_name IS NOT NULL AND entity_type IS NOT NULL GROUP BY entity_name, entity_type) GROUP BY ALL""")
def _(spark, sf):
    m = t.read(spark, sf, "entity_model").withColumn("source_chunk_id", F.array("chunk_id"))
    return merge.split_by_duplicates(merge.group_entities(m)).groupBy("needs_summary").agg(F.count(F.lit(1)).alias("n"))


@_query("agg8_edge_degrees", WITH + """, d AS (SELECT node, count(*) AS n FROM (SELECT subject_id AS node FROM edges UNION ALL SELECT object_id FROM edges) WHERE node IS NOT NULL GROUP BY node)
SELECT e.id, coalesce(s.n, 0) + coalesce(o.n, 0) AS edge_degree FROM edges e LEFT JOIN d s ON s.node = e.subject_id LEFT JOIN d o ON o.node = e.object_id""")
def _(spark, sf):
    e = t.edges(spark, sf)
    return neighbourhood.edge_degrees(e.select("id", "subject_id", "object_id"), e)


@_query("agg9_communities", WITH + """, m AS (SELECT DISTINCT id, c.level AS level, c.cluster_id AS cluster_id FROM (SELECT id, unnest(clusters) AS c FROM nodes)),
r AS (SELECT a.level, a.cluster_id, list_sort(list(DISTINCT e.id)) AS relation_ids FROM edges e JOIN m a ON a.id = e.subject_id JOIN m b ON b.id = e.object_id AND a.level = b.level AND a.cluster_id = b.cluster_id GROUP BY ALL)
SELECT 'com-' || md5(chr(0) || m.level || ':' || m.cluster_id) AS id, m.level, m.cluster_id, list_sort(list(m.id)) AS entity_ids, coalesce(any_value(r.relation_ids), []) AS relation_ids
FROM m LEFT JOIN r ON r.level = m.level AND r.cluster_id = m.cluster_id GROUP BY m.level, m.cluster_id HAVING count(*) >= 3""")
def _(spark, sf):
    from kgspark.operators.community import build_communities

    return build_communities(memberships(t.nodes(spark, sf)), t.edges(spark, sf), least=3).select("id", "level", "cluster_id", "entity_ids", "relation_ids")


@_query("agg10_top_cluster", "SELECT level, max(cluster_id) AS top FROM kv_community GROUP BY level")
def _(spark, sf):
    return lookup.top_clusters(t.read(spark, sf, "kv_community"))


@_query("agg11_document_ids", WITH + """SELECT c.chunk_id AS query_id, list_sort(list(DISTINCT d)) AS documents_id FROM cites c JOIN (SELECT id, unnest(documents_id) AS d FROM nodes) n ON n.id = c.id
WHERE c.chunk_id IS NOT NULL AND d IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    n = t.nodes(spark, sf)
    return neighbourhood.document_ids(neighbourhood.chunk_refs(n).withColumnRenamed("chunk_id", "query_id"), n)


@_query("agg17_lookup_saving", "SELECT count(*) AS total_hits, count(DISTINCT r) AS unique_ids FROM (SELECT unnest(source_chunk_id) AS r FROM entity_rows) WHERE r IS NOT NULL")
def _(spark, sf):
    return lookup.lookup_saving(t.read(spark, sf, "entity_rows").select(F.explode("source_chunk_id").alias("r")), "r")


# Ids


@_query("fn1_content_ids", """SELECT row_id, 'chunk-' || md5(chr(0) || content) AS made, 'chunk-' || md5(chr(0) || content) = id AS same FROM kv_chunks
UNION ALL SELECT row_id, 'rel-' || md5(chr(0) || subject_id || ' -> ' || object_id || relation_type), 'rel-' || md5(chr(0) || subject_id || ' -> ' || object_id || relation_type) = id FROM relation_rows""")
def _(spark, sf):
    c = t.read(spark, sf, "kv_chunks").select("row_id", ids.chunk_id(F.col("content")).alias("made"), "id")
    r = t.read(spark, sf, "relation_rows").select("row_id", ids.relation_id(F.col("subject_id"), F.col("object_id"), F.col("relation_type")).alias("made"), "id")
    return c.unionByName(r).select("row_id", "made", (F.col("made") == F.col("id")).alias("same"))


# Mutation


_GONE = "gone AS (SELECT id FROM kv_chunks WHERE id IS NOT NULL GROUP BY id HAVING bool_and(deleted_at IS NOT NULL))"


def _deleted_chunks(spark, sf):
    return t.read(spark, sf, "kv_chunks").where("id IS NOT NULL").groupBy("id").agg(F.bool_and(F.col("deleted_at").isNotNull()).alias("x")).where("x").select("id")


@_query("mut1_upsert", WITH + """, new AS (SELECT mention_id, 'ent-' || md5(chr(0) || entity_name || ' - ' || entity_type) AS id, entity_name, description FROM entity_model WHERE entity_name IS NOT NULL AND entity_type IS NOT NULL),
one AS (SELECT id, arg_max(entity_name, mention_id) AS entity_name, max_by(coalesce(description, '<null>'), mention_id) AS description FROM new GROUP BY id)
SELECT id, entity_name, nullif(description, '<null>') AS description FROM one UNION ALL SELECT id, entity_name, description FROM nodes WHERE id NOT IN (SELECT id FROM one)""")
def _(spark, sf):
    m = t.read(spark, sf, "entity_model").where("entity_name IS NOT NULL AND entity_type IS NOT NULL")
    new = m.select(ids.entity_id(F.col("entity_name"), F.col("entity_type")).alias("id"), "entity_name", "description", "mention_id")
    return mutate.upsert(t.nodes(spark, sf).select("id", "entity_name", "description"), new, last="mention_id")


@_query("mut5_delete_entities", WITH + """, gone AS (SELECT id FROM entity_rows WHERE deleted_at IS NOT NULL)
SELECT id FROM edges WHERE (subject_id IS NULL OR subject_id NOT IN (SELECT id FROM gone)) AND (object_id IS NULL OR object_id NOT IN (SELECT id FROM gone))""")
def _(spark, sf):
    gone = t.read(spark, sf, "entity_rows").where("deleted_at IS NOT NULL").select("id")
    return mutate.delete_entities(t.nodes(spark, sf), t.edges(spark, sf), gone)[1].select("id")


@_query("mut6_delete_relations", WITH + """, s AS (SELECT subject_id AS s, object_id AS o, CASE WHEN relation_strength IS NOT NULL THEN id END AS r FROM relation_rows WHERE trust_level <= 2)
SELECT id FROM edges e WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.s = e.subject_id AND s.o = e.object_id AND (s.r IS NULL OR s.r = e.id))""")
def _(spark, sf):
    specs = t.read(spark, sf, "relation_rows").where("trust_level <= 2").select("subject_id", "object_id", F.when(F.col("relation_strength").isNotNull(), F.col("id")).alias("relation_id"))
    return mutate.delete_relations(t.edges(spark, sf), specs).select("id")


_CASCADE = """, {gone}, ec AS (SELECT id FROM (SELECT DISTINCT id, unnest(source_chunk_id) AS c FROM nodes) GROUP BY id HAVING bool_or(c IN (SELECT id FROM gone)){all}),
rc AS (SELECT id FROM (SELECT DISTINCT id, unnest(source_chunk_id) AS c FROM edges) GROUP BY id HAVING bool_or(c IN (SELECT id FROM gone)){all})
SELECT 'entity' AS kind, id FROM nodes WHERE id NOT IN (SELECT id FROM ec)
UNION ALL SELECT 'relation', id FROM edges WHERE id NOT IN (SELECT id FROM rc) AND (subject_id IS NULL OR subject_id NOT IN (SELECT id FROM ec)) AND (object_id IS NULL OR object_id NOT IN (SELECT id FROM ec))"""


def _chunk_cascade(spark, sf, retain):
    _, e, r = mutate.delete_chunks(t.chunks(spark, sf), t.nodes(spark, sf), t.edges(spark, sf), _deleted_chunks(spark, sf), retain)
    return e.select(F.lit("entity").alias("kind"), "id").unionByName(r.select(F.lit("relation").alias("kind"), "id"))


@_query("mut7_delete_chunks", WITH + _CASCADE.format(gone=_GONE, all=""))
def _(spark, sf):
    return _chunk_cascade(spark, sf, False)


@_query("mut7_delete_chunks_shared", WITH + _CASCADE.format(gone=_GONE, all=" AND bool_and(c IN (SELECT id FROM gone))"))
def _(spark, sf):
    return _chunk_cascade(spark, sf, True)


@_query("mut9_delete_communities", WITH + f", summaries AS ({_SUMMARY_SQL}) SELECT id FROM summaries WHERE id IN (SELECT id FROM communities WHERE level <= 0)")
def _(spark, sf):
    c = t.communities(spark, sf)
    return mutate.delete_communities(c, summaries(spark, sf), c.where("level > 0").select("id"))[1].select("id")


@_query("mut11_remap_clusters", """SELECT level, cluster_id, top + n AS new_cluster_id, 'com-' || md5(chr(0) || level || ':' || (top + n)) AS community_id FROM (
SELECT level, cluster_id, (SELECT max(cluster_id) FROM kv_community k WHERE k.level = c.level) AS top, row_number() OVER (PARTITION BY level ORDER BY cluster_id) AS n FROM (SELECT DISTINCT level, cluster_id FROM kv_community) c)""")
def _(spark, sf):
    c = t.read(spark, sf, "kv_community")
    return mutate.remap_clusters(c, c)


@_query("mut15_new_chunks", "SELECT id, min(row_id) AS pos FROM kv_chunks WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM kv_chunks WHERE deleted_at IS NOT NULL) GROUP BY id")
def _(spark, sf):
    c = t.read(spark, sf, "kv_chunks").where("id IS NOT NULL").select("id", F.col("row_id").alias("pos"), "deleted_at")
    return mutate.new_chunks(c.select("id", "pos"), c.where("deleted_at IS NOT NULL").select("id"))


# Audit


@_query("con1_source_chunks", WITH + """SELECT DISTINCT 'source_chunk_references' AS check_name, 'chunk' AS id_kind, r AS id FROM (SELECT unnest(source_chunk_id) AS r FROM nodes UNION ALL SELECT unnest(source_chunk_id) FROM edges)
WHERE r IS NOT NULL AND r NOT IN (SELECT id FROM chunks)""")
def _(spark, sf):
    return audit.source_chunk_references(t.nodes(spark, sf), t.edges(spark, sf), t.chunks(spark, sf))


@_query("con2_relation_endpoints", WITH + """, bad AS (SELECT id, e FROM (SELECT id, subject_id AS e FROM edges UNION ALL SELECT id, object_id FROM edges) WHERE e IS NOT NULL AND e NOT IN (SELECT id FROM nodes))
SELECT DISTINCT 'relation_endpoints' AS check_name, 'entity' AS id_kind, e AS id FROM bad UNION SELECT 'relation_endpoints', 'relation', id FROM bad""")
def _(spark, sf):
    return audit.relation_endpoints(t.edges(spark, sf), t.nodes(spark, sf))


@_query("con3_communities", WITH + """, bad AS (SELECT id, 'entity' AS kind, m FROM (SELECT id, unnest(entity_ids) AS m FROM communities) WHERE m IS NOT NULL AND m NOT IN (SELECT id FROM nodes)
UNION ALL SELECT id, 'relation', m FROM (SELECT id, unnest(relation_ids) AS m FROM communities) WHERE m IS NOT NULL AND m NOT IN (SELECT id FROM edges))
SELECT DISTINCT 'community_references' AS check_name, kind AS id_kind, m AS id FROM bad UNION SELECT 'community_references', 'community', id FROM bad
UNION SELECT 'community_references', 'community', id FROM communities WHERE entity_ids IS NULL OR relation_ids IS NULL""")
def _(spark, sf):
    return audit.community_references(t.communities(spark, sf), t.nodes(spark, sf), t.edges(spark, sf))


_VEC = """, v AS (SELECT DISTINCT kind, id FROM (SELECT metadata['kind'] AS kind, metadata['ref_id'] AS id FROM points) WHERE id IS NOT NULL)
SELECT '{k}_vector_representations' AS check_name, '{k}' AS id_kind, id FROM {t} WHERE id NOT IN (SELECT id FROM v WHERE kind = '{k}')
UNION ALL SELECT '{k}_vector_endpoints', '{k}', id FROM v WHERE kind = '{k}' AND id NOT IN (SELECT id FROM {t})"""


def _vectors(spark, sf, kind):
    m = F.col("metadata")
    return t.read(spark, sf, "points").where((m["kind"] == kind) & m["ref_id"].isNotNull()).select(m["ref_id"].alias("id"))


@_query("con4_con5_entity_vectors", WITH + _VEC.format(k="entity", t="nodes"))
def _(spark, sf):
    return audit.representations(t.nodes(spark, sf), _vectors(spark, sf, "entity"), "entity")


@_query("con6_con7_relation_vectors", WITH + _VEC.format(k="relation", t="edges"))
def _(spark, sf):
    return audit.representations(t.edges(spark, sf), _vectors(spark, sf, "relation"), "relation")


@_query("con8_con9_chunk_vectors", WITH + _VEC.format(k="chunk", t="chunks"))
def _(spark, sf):
    return audit.representations(t.chunks(spark, sf), _vectors(spark, sf, "chunk"), "chunk")
