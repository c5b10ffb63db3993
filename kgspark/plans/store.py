"""Vector search, engines from a query, changes of the stored graph with its vectors, and vocabulary constraints."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from kgspark.functions import ids, text, vectors
from kgspark.operators import extract, lookup, merge, models, neighbourhood, ontology, ranking, search, sparse
from kgspark.operators.community import keep_memberships
from kgspark.operators.index import GraphIndex, next_cluster_ids, remap_and_rewrite
from kgspark.plans import graph
from kgspark.plans import tables as t
from kgspark.plans.tables import WITH
from kgspark.sources.store import append_examples, display_attributes, fixed_batches

QUERIES: dict = {}
SQL: dict = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# Vectors: every point whose number, the end of its id, is divisible by 100 asks all points; by 10 for the sparse ones, which are few

_NUMBER, _MORE = "conv(right(id, 7), 16, 10) % 100 = 0", "conv(right(id, 7), 16, 10) % 10 = 0"
_POINTS = """v AS (SELECT id, metadata['kind'] AS kind, metadata['ref_id'] AS ref, dense_embedding::DOUBLE[] AS v, sparse_embedding AS s, ('0x' || right(id, 7))::BIGINT % 100 = 0 AS asks, ('0x' || right(id, 7))::BIGINT % 10 = 0 AS more
  FROM points WHERE len(dense_embedding) = 64 AND list_count(dense_embedding) = 64 AND NOT isnan(list_sum(dense_embedding)) AND list_sum(list_transform(dense_embedding, lambda x: x * x)) > 0)"""
_NEAR = """near AS (SELECT * FROM (SELECT query_id, id, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank
  FROM (SELECT q.id AS query_id, p.id, round(list_cosine_similarity(q.v, p.v), 6) AS s FROM v q, {points} p WHERE {asks})) WHERE rank <= {k})"""
_SPARSE = """term AS (SELECT id, more, unnest(s.indices) AS i, unnest(s.values) AS x FROM v WHERE s IS NOT NULL),
dots AS (SELECT q.id AS query_id, p.id, round(sum(q.x * p.x), 6) AS score FROM term q JOIN term p USING (i) WHERE q.more GROUP BY ALL)"""


def _points(spark, sf):
    p = t.read(spark, sf, "points").where(vectors.usable(F.col("dense_embedding"), 64))
    return p.select("id", F.col("dense_embedding").alias("vector"), F.col("sparse_embedding").alias("sparse"), F.col("metadata.kind").alias("kind"), F.col("metadata.ref_id").alias("ref"))


def _asked(points):
    return points.where(_MORE).where("sparse IS NOT NULL").select(F.col("id").alias("query_id"), "vector", "sparse")


@_query("top2_hybrid_vectors", f"WITH {_POINTS}, {_NEAR.format(points='v', k=20, asks='q.more AND q.s IS NOT NULL')}, {_SPARSE}, " + """sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dots) WHERE rank <= 20)
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, round(sum(1.0 / (60 + rank)), 12) AS score FROM (SELECT query_id, id, rank FROM near UNION ALL SELECT query_id, id, rank FROM sp) GROUP BY ALL)) WHERE rank <= 20""")
def _(spark, sf):
    p = _points(spark, sf)
    return search.hybrid_top_k(_asked(p), p.select("id", "vector", "sparse"), 20, 64).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@_query("fn13_sparse_dot", f"WITH {_POINTS}, {_SPARSE} SELECT query_id, id, round(score, 4) AS score FROM dots")
def _(spark, sf):
    p = _points(spark, sf).where("sparse IS NOT NULL")
    return sparse.sparse_dot(p.select("id", "sparse"), _asked(p).select("query_id", "sparse")).select("query_id", "id", F.round("score", 4).alias("score"))


@_query("top8_similar_points", f"WITH {_POINTS}, {_NEAR.format(points='v', k=10, asks='q.asks')} SELECT query_id, near.id, rank, v.ref, v.kind FROM near JOIN v ON v.id = near.id")
def _(spark, sf):
    p = _points(spark, sf)
    index = search.VectorIndex(p.select("id", "ref", "kind"), p.select("id", "vector"), 64)
    return index.similar(p.where(_NUMBER)).select("query_id", "id", "rank", "ref", "kind")


@_query("prj4_stored_vectors", f"WITH {_POINTS} SELECT p.id, v.id IS NOT NULL AS stored, round(CASE WHEN v.v IS NOT NULL THEN v.v[1] / sqrt(list_inner_product(v.v, v.v)) END, 5) AS first FROM points p LEFT JOIN v ON v.id = p.id")
def _(spark, sf):
    p = _points(spark, sf)
    got = search.VectorIndex(p, p.select("id", "vector"), 64).get(t.read(spark, sf, "points").select("id"))
    return got.select("id", F.col("vector").isNotNull().alias("stored"), F.round(F.col("vector")[0], 5).alias("first"))


def _entity_index(spark, sf):
    """Stored entities and, of the points that stand for each, the one of the smallest id."""
    p = _points(spark, sf).where("kind = 'entity'")
    return search.VectorIndex(t.nodes(spark, sf), p.groupBy(F.col("ref").alias("id")).agg(F.min_by("vector", F.col("id")).alias("vector")), 64)


_BEFORE, _AFTER = re.match(r"(?s)(.*?)seeds AS \(.*?\),\n(ends AS .*)", WITH).groups()
_LOCAL = (
    _BEFORE
    + f"{_POINTS}, ev AS (SELECT ref AS id, arg_min(v, id) AS v FROM v WHERE kind = 'entity' GROUP BY ref), {_NEAR.format(points='ev', k=20, asks='q.asks')},\n"
    + "seeds AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY {order}) - 1 AS pos FROM (SELECT near.*, length(description) AS size FROM near JOIN nodes USING (id)) {keep}),\n"
    + _AFTER
)
_LISTS = f"""summaries AS ({graph._SUMMARY_SQL}),
ent AS (SELECT query_id, list(id ORDER BY pos) AS entity_ids FROM seeds GROUP BY query_id),
r0 AS (SELECT query_id, relation_id, any_value(relation_strength) AS w, min(pos) AS pos FROM seeds s JOIN ends e ON e.node = s.id GROUP BY ALL),
rel AS (SELECT query_id, list(relation_id ORDER BY w DESC NULLS LAST, pos, relation_id) AS relation_ids FROM r0 GROUP BY query_id),
own AS (SELECT query_id, chunk_id, min(pos) AS pos, arg_min(s.id, pos) AS seed FROM seeds s JOIN cites c ON c.id = s.id WHERE chunk_id IS NOT NULL GROUP BY ALL),
shared AS (SELECT query_id, o.chunk_id, count(*) AS n FROM own o JOIN ends e ON e.node = o.seed AND e.other <> o.seed JOIN cites c ON c.id = e.other AND c.chunk_id = o.chunk_id GROUP BY ALL),
ch AS (SELECT o.query_id, list(o.chunk_id ORDER BY pos, coalesce(n, 0) DESC, o.chunk_id) AS chunk_ids FROM own o LEFT JOIN shared s ON s.query_id = o.query_id AND s.chunk_id = o.chunk_id WHERE o.chunk_id IN (SELECT id FROM chunks) GROUP BY o.query_id),
com AS (SELECT query_id, list_sort(list(DISTINCT 'com-' || md5(chr(0) || c.level || ':' || c.cluster_id))) AS community_ids FROM seeds JOIN (SELECT id, unnest(clusters) AS c FROM nodes) USING (id)
  WHERE c.level <= 2 AND 'com-' || md5(chr(0) || c.level || ':' || c.cluster_id) IN (SELECT id FROM summaries) GROUP BY ALL),
doc AS (SELECT query_id, list_sort(list(DISTINCT d)) AS documents_id FROM seeds JOIN (SELECT id, unnest(documents_id) AS d FROM nodes) USING (id) WHERE d IS NOT NULL GROUP BY ALL)
SELECT query_id, array_to_string(entity_ids, ' ') AS entity_ids, coalesce(array_to_string(relation_ids, ' '), '') AS relation_ids, coalesce(array_to_string(chunk_ids, ' '), '') AS chunk_ids,
  coalesce(array_to_string(community_ids, ' '), '') AS community_ids, coalesce(array_to_string(documents_id, ' '), '') AS documents_id
FROM ent LEFT JOIN rel USING (query_id) LEFT JOIN ch USING (query_id) LEFT JOIN com USING (query_id) LEFT JOIN doc USING (query_id)"""


def _local(spark, sf, score=None, keep=None):
    q = _points(spark, sf).where(_NUMBER).select(F.col("id").alias("query_id"), "vector")
    out = search.local_search(q, _entity_index(spark, sf), t.edges(spark, sf), t.chunks(spark, sf), graph.summaries(spark, sf), 20, score, keep)
    return out.select("query_id", *[F.array_join(c, " ").alias(c) for c in ("entity_ids", "relation_ids", "chunk_ids", "community_ids", "documents_id")])


@_query("eng2_local_search", _LOCAL.format(order="rank", keep="") + ", " + _LISTS)
def _(spark, sf):
    return _local(spark, sf)


@_query("eng2_local_reranked", _LOCAL.format(order="size DESC, rank", keep="QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY size DESC, rank) <= 5") + ", " + _LISTS)
def _(spark, sf):
    sizes = t.nodes(spark, sf).select("id", F.coalesce(F.length("description"), F.lit(0)).cast("double").alias("score"))
    return _local(spark, sf, lambda hits: hits.join(sizes, "id").select("query_id", "id", "score"), 5)


@_query("eng0_batch_of_one", WITH + "SELECT id, entity_name FROM nodes WHERE entity_type = 'PERSON'")
def _(spark, sf):
    n = t.nodes(spark, sf)
    engine = search.Engine(spark, lambda q: q.join(n, q["query"] == n["entity_type"]).select("query_id", "id", "entity_name"))
    return engine.search("PERSON")


@_query("eng4_failing_engine", "SELECT name AS query_id, 1 AS position, 'echo' AS engine, lower(name) AS context FROM entity_type_list".replace("1 AS position", "0 AS position"))
def _(spark, sf):
    q = t.read(spark, sf, "entity_type_list").select(F.col("name").alias("query_id"), F.col("name").alias("query"))
    fails = lambda df: df.select("query_id", F.raise_error(F.lit("no model")).cast("string").alias("context"))
    mixed, errors = search.tolerant_mix(q, {"broken": fails, "echo": lambda df: df.select("query_id", F.lower("query").alias("context"))})
    assert list(errors) == ["broken"]
    return mixed


# Changes of the graph, with a model that a vector of lengths stands in for


def _lengths(rows, column):
    return rows.withColumn("embedding", F.array(F.length(column).cast("float")))


def _index(spark, sf) -> GraphIndex:
    n, e, c = t.nodes(spark, sf), t.edges(spark, sf), t.chunks(spark, sf)
    of = lambda rows: rows.select("id", F.array(F.lit(-1.0).cast("float")).alias("vector"))
    return GraphIndex(
        n.select("id", "entity_name", "entity_type", "description", "source_chunk_id", "documents_id", "clusters"), e.select("id", "subject_id", "object_id", "subject_name", "object_name", "relation_type", "description", "relation_strength", "source_chunk_id"),
        c.select("id", "content", "doc_id"), t.communities(spark, sf).select("id", "level", "cluster_id"), graph.summaries(spark, sf).select("id", "summary"), of(n), of(e), of(c),
    )


_NEW = """new AS (SELECT mention_id, 'ent-' || md5(chr(0) || entity_name || ' - ' || entity_type) AS id, entity_name, description FROM entity_model WHERE entity_name IS NOT NULL AND entity_type IS NOT NULL),
one AS (SELECT id, arg_max(entity_name, mention_id) AS entity_name, nullif(max_by(coalesce(description, '<null>'), mention_id), '<null>') AS description FROM new GROUP BY id)"""


def _new_nodes(spark, sf):
    m = t.read(spark, sf, "entity_model").where("entity_name IS NOT NULL AND entity_type IS NOT NULL")
    none = F.lit(None)
    return m.select(
        ids.entity_id(F.col("entity_name"), F.col("entity_type")).alias("id"), "entity_name", "entity_type", "description", F.array("chunk_id").alias("source_chunk_id"),
        none.cast("array<string>").alias("documents_id"), none.cast("array<struct<level:int,cluster_id:int>>").alias("clusters"), "mention_id",
    )


@_query("mut1_node_vectors", WITH + f", {_NEW} SELECT id, length(CASE WHEN description IS NULL THEN entity_name ELSE entity_name || ' - ' || description END)::DOUBLE AS first FROM one UNION ALL SELECT id, -1 FROM nodes WHERE id NOT IN (SELECT id FROM one)")
def _(spark, sf):
    out = _index(spark, sf).upsert_nodes(_new_nodes(spark, sf), _lengths, "mention_id")
    return out.entity_vectors.select("id", F.col("vector")[0].cast("double").alias("first"))


@_query("mut1_chunk_index", WITH + f""", {_NEW}, chunk AS (SELECT id, arg_max(chunk_id, mention_id) AS chunk_id FROM (SELECT n.id, n.mention_id, coalesce(e.chunk_id, '<null>') AS chunk_id FROM new n JOIN entity_model e USING (mention_id)) GROUP BY id),
c AS (SELECT id, chunk_id FROM chunk WHERE chunk_id <> '<null>' UNION SELECT id, chunk_id FROM cites WHERE chunk_id IS NOT NULL AND id NOT IN (SELECT id FROM one))
SELECT chunk_id, count(*) AS n FROM c GROUP BY chunk_id""")
def _(spark, sf):
    out = _index(spark, sf).upsert_nodes(_new_nodes(spark, sf), None, "mention_id")
    return out.chunk_index().select("chunk_id", F.size("entity_ids").alias("n"))


@_query("mut2_update_nodes", WITH + "SELECT id, CASE WHEN entity_type = 'PERSON' THEN upper(entity_name) ELSE entity_name END AS entity_name FROM nodes")
def _(spark, sf):
    index = _index(spark, sf)
    return index.update_nodes(index.entities.where("entity_type = 'PERSON'").withColumn("entity_name", F.upper("entity_name"))).entities.select("id", "entity_name")


_KNOWN = "subject_id IN (SELECT id FROM nodes) AND object_id IN (SELECT id FROM nodes)"


@_query("mut3_update_edges", WITH + f"""SELECT id, CASE WHEN relation_strength IS NULL AND {_KNOWN} THEN 1 ELSE relation_strength END AS relation_strength,
CASE WHEN relation_strength IS NULL AND {_KNOWN} THEN length(description) ELSE -1 END::DOUBLE AS first FROM edges""")
def _(spark, sf):
    index = _index(spark, sf)
    weak = lookup.with_known_endpoints(index.relations.where("relation_strength IS NULL"), index.entities).withColumn("relation_strength", F.lit(1.0))
    out = index.update_edges(weak, _lengths)
    return out.relations.select("id", "relation_strength").join(out.relation_vectors.select("id", F.col("vector")[0].cast("double").alias("first")), "id")


@_query("mut3_upsert_edges", WITH + f", k AS (SELECT * FROM edges WHERE {_KNOWN}) SELECT id FROM edges UNION ALL SELECT DISTINCT 'rel-' || md5(chr(0) || object_id || ' -> ' || subject_id || 'MIRROR') AS id FROM k")
def _(spark, sf):
    index = _index(spark, sf)
    known = lookup.with_known_endpoints(index.relations, index.entities)
    turned = known.select(
        ids.relation_id(F.col("object_id"), F.col("subject_id"), F.lit("MIRROR")).alias("id"), F.col("object_id").alias("subject_id"), F.col("subject_id").alias("object_id"), F.col("object_name").alias("subject_name"),
        F.col("subject_name").alias("object_name"), F.lit("MIRROR").alias("relation_type"), "description", "relation_strength", "source_chunk_id", F.xxhash64("id").alias("at"),
    )
    return index.upsert_edges(turned, None, "at").relations.select("id")


@_query("mut4_merge_nodes", WITH + """, inc AS (SELECT id, min(row_id) AS row_id FROM entity_rows WHERE deleted_at IS NULL AND id IN (SELECT id FROM nodes) GROUP BY id)
SELECT n.id, list_sort(list_distinct(list_concat(coalesce(n.source_chunk_id, []), coalesce(e.source_chunk_id, [])))) AS source_chunk_id, n.row_id <> e.row_id AS changed FROM nodes n JOIN inc USING (id) JOIN entity_rows e ON e.row_id = inc.row_id""")
def _(spark, sf):
    index, rows = _index(spark, sf), t.read(spark, sf, "entity_rows").where("deleted_at IS NULL")
    known = rows.join(index.entities.select("id"), "id", "left_semi")
    first = lookup.first_seen(known, ["id"], "row_id")
    out = index.merge_nodes(first.select(*index.entities.columns), _lengths).entities
    at = t.nodes(spark, sf).select("id", F.col("row_id").alias("_n")).join(first.select("id", F.col("row_id").alias("_e")), "id")
    return out.join(at, "id").select("id", F.array_sort("source_chunk_id").alias("source_chunk_id"), (F.col("_n") != F.col("_e")).alias("changed"))


_GONE_NODES = "gone AS (SELECT id FROM nodes WHERE entity_type = 'GUILD'), cut AS (SELECT id FROM edges WHERE subject_id IN (SELECT id FROM gone) OR object_id IN (SELECT id FROM gone))"


@_query("mut5_vector_cascade", WITH + f", {_GONE_NODES} SELECT 'entity' AS kind, id FROM nodes WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'relation', id FROM edges WHERE id NOT IN (SELECT id FROM cut)")
def _(spark, sf):
    index = _index(spark, sf)
    out = index.delete_nodes(index.entities.where("entity_type = 'GUILD'"))
    return out.entity_vectors.select(F.lit("entity").alias("kind"), "id").unionByName(out.relation_vectors.select(F.lit("relation").alias("kind"), "id"))


@_query("mut7_vector_cascade", WITH + """, gone AS (SELECT id FROM chunks WHERE length(content) % 10 = 0), gn AS (SELECT DISTINCT id FROM cites WHERE chunk_id IN (SELECT id FROM gone)),
ge AS (SELECT id FROM edges WHERE subject_id IN (SELECT id FROM gn) OR object_id IN (SELECT id FROM gn) OR len(list_filter(coalesce(source_chunk_id, []), lambda c: c IN (SELECT id FROM gone))) > 0)
SELECT 'chunk' AS kind, id FROM chunks WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'entity', id FROM nodes WHERE id NOT IN (SELECT id FROM gn) UNION ALL SELECT 'relation', id FROM edges WHERE id NOT IN (SELECT id FROM ge)""".replace(
    "len(list_filter(coalesce(source_chunk_id, []), lambda c: c IN (SELECT id FROM gone))) > 0", "id IN (SELECT id FROM (SELECT id, unnest(source_chunk_id) AS c FROM edges) WHERE c IN (SELECT id FROM gone))"))
def _(spark, sf):
    index = _index(spark, sf)
    out = index.delete_chunks(index.chunks.where("length(content) % 10 = 0"))
    parts = [v.select(F.lit(k).alias("kind"), "id") for k, v in (("chunk", out.chunk_vectors), ("entity", out.entity_vectors), ("relation", out.relation_vectors))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query("mut8_upsert_chunks", WITH + """, made AS (SELECT 'chunk-' || md5(chr(0) || text) AS id, max(md5(chr(0) || text)) AS doc_id, length(any_value(text)) AS n FROM documents WHERE text IS NOT NULL GROUP BY text)
SELECT id, doc_id, n::DOUBLE AS first FROM made UNION ALL SELECT id, doc_id, -1 FROM chunks WHERE id NOT IN (SELECT id FROM made)""")
def _(spark, sf):
    d = t.read(spark, sf, "documents").where("text IS NOT NULL")
    whole = d.select(ids.chunk_id(F.col("text")).alias("id"), F.col("text").alias("content"), ids.doc_id(F.col("text")).alias("doc_id"), F.col("doc_id").alias("at"))
    out = _index(spark, sf).upsert_chunks(whole, _lengths, "at")
    return out.chunks.select("id", "doc_id").join(out.chunk_vectors.select("id", F.col("vector")[0].cast("double").alias("first")), "id")


@_query("mut9_upsert_communities", WITH + f""", summaries AS ({graph._SUMMARY_SQL}), nx AS (SELECT level, max(cluster_id) + 1 AS cluster_id FROM communities GROUP BY level)
SELECT id, level, cluster_id, NULL AS summary FROM (SELECT 'com-' || md5(chr(0) || level || ':' || cluster_id) AS id, level, cluster_id FROM nx) WHERE FALSE
UNION ALL SELECT c.id, c.level, c.cluster_id, s.summary FROM (SELECT id, level, cluster_id FROM communities UNION SELECT 'com-' || md5(chr(0) || level || ':' || cluster_id), level, cluster_id FROM nx) c
LEFT JOIN (SELECT id, summary FROM summaries UNION ALL SELECT 'com-' || md5(chr(0) || level || ':' || cluster_id), 'new' FROM nx) s ON s.id = c.id""")
def _(spark, sf):
    index = _index(spark, sf)
    new = next_cluster_ids(index.communities)
    out = index.upsert_communities(new.select("id", "level", "cluster_id"), new.select("id", F.lit("new").alias("summary")))
    return out.communities.join(out.summaries, "id", "left")


_REMAP = """, mv AS (SELECT level, cluster_id, (SELECT max(cluster_id) FROM communities k WHERE k.level = c.level) + row_number() OVER (PARTITION BY level ORDER BY cluster_id) AS n FROM (SELECT DISTINCT level, cluster_id FROM communities) c)"""


@_query("mut11_rewritten", WITH + f", summaries AS ({graph._SUMMARY_SQL})" + _REMAP + """, m AS (SELECT DISTINCT x.id, mv.level, mv.n FROM (SELECT id, unnest(clusters) AS c FROM nodes) x JOIN mv ON mv.level = c.level AND mv.cluster_id = c.cluster_id)
SELECT 'entity' AS kind, id, level, n AS cluster_id FROM m UNION ALL SELECT 'community', 'com-' || md5(chr(0) || mv.level || ':' || n), mv.level, n FROM mv JOIN communities c USING (level, cluster_id)
UNION ALL SELECT 'summary', 'com-' || md5(chr(0) || mv.level || ':' || n), NULL, NULL FROM mv JOIN communities c USING (level, cluster_id) JOIN summaries s ON s.id = c.id""")
def _(spark, sf):
    i = _index(spark, sf)
    e, c, s = remap_and_rewrite(i.communities, i.entities, i.communities, i.summaries)
    none = F.lit(None).cast("int")
    members = e.select(F.lit("entity").alias("kind"), "id", F.explode("clusters").alias("x")).select("kind", "id", "x.level", "x.cluster_id")
    return members.unionByName(c.select(F.lit("community").alias("kind"), "id", "level", "cluster_id")).unionByName(s.select(F.lit("summary").alias("kind"), "id", none.alias("level"), none.alias("cluster_id")))


@_query("flt4_kept_memberships", WITH + """SELECT n.id, coalesce(len(list_filter(clusters, lambda c: c.level = 0)), 0) AS n FROM nodes n""")
def _(spark, sf):
    n = t.nodes(spark, sf)
    groups = graph.memberships(n).where("level = 0").select("level", "cluster_id").distinct()
    return keep_memberships(n, groups).select("id", F.coalesce(F.size("clusters"), F.lit(0)).alias("n"))


@_query("join13_ordered_members", WITH + """, m AS (SELECT id AS community, 'entity' AS kind, unnest(entity_ids) AS member, generate_subscripts(entity_ids, 1) AS i FROM communities
UNION ALL SELECT id, 'relation', unnest(relation_ids), generate_subscripts(relation_ids, 1) FROM communities),
o AS (SELECT community, kind, member, row_number() OVER (PARTITION BY community, kind ORDER BY min(i)) - 1 AS place FROM m GROUP BY community, kind, member)
SELECT * FROM o WHERE (kind = 'entity' AND member IN (SELECT id FROM nodes)) OR (kind = 'relation' AND member IN (SELECT id FROM edges))""")
def _(spark, sf):
    return lookup.members_of(t.communities(spark, sf), t.nodes(spark, sf), t.edges(spark, sf)).select("community", "kind", "member", "place")


@_query("join1_found_rows", WITH + "SELECT r.row_id, n.id, n.entity_name FROM relation_rows r JOIN nodes n ON n.id = r.object_id")
def _(spark, sf):
    hits = t.read(spark, sf, "relation_rows").select("row_id", F.col("object_id").alias("id"))
    return lookup.found_rows(hits, t.nodes(spark, sf).select("id", "entity_name"))


@_query("snk7_edge_widths", WITH + "SELECT id, round(1 + least(2 * coalesce(relation_strength, 1.0), 5.0), 4) AS edge_width FROM edges")
def _(spark, sf):
    return display_attributes(t.nodes(spark, sf), t.edges(spark, sf))[1]


@_query("snk12_batches", "SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) // 100 AS batch_id FROM kv_chunks")
def _(spark, sf):
    return fixed_batches(t.read(spark, sf, "kv_chunks").select("row_id"), "row_id", 100).select("row_id", "batch_id")


# Aggregates, ratings and functions


@_query("agg5_joined_text", """SELECT entity_name, entity_type, length(string_agg(description, ' ' ORDER BY description)) AS n, md5(string_agg(description, ' ' ORDER BY description)) AS digest FROM entity_model
WHERE entity_name IS NOT NULL AND entity_type IS NOT NULL GROUP BY ALL HAVING count(description) BETWEEN 1 AND 7""")
def _(spark, sf):
    m = t.read(spark, sf, "entity_model").withColumn("source_chunk_id", F.array("chunk_id"))
    few = merge.split_by_duplicates(merge.group_entities(m)).where("NOT needs_summary AND duplicate_count > 0")
    return few.select("entity_name", "entity_type", F.length("description").alias("n"), F.md5("description").alias("digest"))


@_query("sum1_summarised", """SELECT entity_name, entity_type, count(description) || ' texts' AS description FROM entity_model WHERE entity_name IS NOT NULL AND entity_type IS NOT NULL GROUP BY ALL HAVING count(description) > 7""")
def _(spark, sf):
    m = t.read(spark, sf, "entity_model").withColumn("source_chunk_id", F.array("chunk_id"))
    out = merge.summarise(merge.group_entities(m), _counted)
    return out.where("duplicate_count > 7").select("entity_name", "entity_type", "description")


def _counted(lists):
    return lists.map(lambda texts: f"{len(texts)} texts")


_JUDGED = "(relation_strength % 5 + 1)"


@_query("agg16_judge_mean", f"""WITH j AS (SELECT relation_type, 0.7 * ({_JUDGED} + trust_level % 5 + 1 + 5 - 3) / 12.0 + 0.3 * trust_level / 10.0 AS score,
abs(({_JUDGED} + trust_level % 5 + 1 + 5 - 3) / 12.0 - trust_level / 10.0) > 0.3 AS differs FROM relation_rows WHERE relation_strength IS NOT NULL AND trust_level IS NOT NULL)
SELECT relation_type, round(avg(score), 6) AS mean_score, count(*) FILTER (differs) AS n_differ FROM j GROUP BY relation_type""")
def _(spark, sf):
    r = t.read(spark, sf, "relation_rows").where("relation_strength IS NOT NULL AND trust_level IS NOT NULL")
    score, differs = models.judge_score(F.expr(_JUDGED), F.expr("trust_level % 5 + 1"), F.lit(5), F.col("trust_level") / 10.0)
    judged = r.select("relation_type", score.alias("score"), differs.alias("differs"))
    return judged.groupBy("relation_type").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count_if("differs").alias("n_differ"))


@_query("flt8_good_enough", "SELECT mention_id FROM relation_model WHERE relationship_strength >= 4")
def _(spark, sf):
    return lookup.good_enough(t.read(spark, sf, "relation_model"), 4, "relationship_strength").select("mention_id")


@_query("flt12_answered", "SELECT mention_id, upper(description) AS response FROM entity_model WHERE description IS NOT NULL")
def _(spark, sf):
    called = models.batch_call(t.read(spark, sf, "entity_model").select("mention_id", "description"), "description", _shout)
    return lookup.answered(called).select("mention_id", "response")


def _shout(values):
    return [v.upper() for v in values]


@_query("fn16_base64_vectors", "SELECT vec_id, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def _(spark, sf):
    back = vectors.decode_float32(vectors.encode_float32(F.col("embedding")))
    total = F.aggregate(back.cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return t.read(spark, sf, "embeddings").select("vec_id", F.size(back).alias("n"), F.round(total, 4).alias("total"))


@_query("fn17_typed_properties", """SELECT row_id, relation_type, relation_strength, len(source_chunk_id) AS n_chunks FROM relation_rows""")
def _(spark, sf):
    r = t.read(spark, sf, "relation_rows")
    p = text.encode_properties({c: F.col(c) for c in ("relation_type", "relation_strength", "source_chunk_id")}, {"relation_type", "relation_strength"})
    back = r.select("row_id", p.alias("p"))
    get = lambda name, kind, native: text.decode_property(F.col("p"), name, kind, native)
    n = F.size(get("source_chunk_id", "array<string>", False))
    return back.select("row_id", get("relation_type", "string", True).alias("relation_type"), get("relation_strength", "double", True).alias("relation_strength"), F.when(F.col("p")["source_chunk_id"].isNotNull(), n).alias("n_chunks"))


@_query("fn19_truncated", "SELECT doc_id, array_to_string(regexp_split_to_array(trim(title), '\\s+')[1:2], ' ') AS short FROM documents WHERE title IS NOT NULL AND trim(title) <> '' AND len(regexp_split_to_array(trim(title), '\\s+')) > 2")
def _(spark, sf):
    d = t.read(spark, sf, "documents").where(F.trim("title") != "")
    return d.where(F.size(F.split(F.trim("title"), r"\s+")) > 2).select("doc_id", text.truncate_words(F.col("title"), 4, 2).alias("short"))


@_query("prj8_row_json", "SELECT row_id, json_extract_string(j, '$.id') AS id, CASE WHEN source_chunk_id IS NOT NULL THEN json_array_length(json_extract(j, '$.source_chunk_id')) END AS n FROM (SELECT row_id, source_chunk_id, to_json(struct_pack(id := id, source_chunk_id := source_chunk_id)) AS j FROM entity_rows)")
def _(spark, sf):
    j = text.row_json(F.col("id"), F.col("source_chunk_id"))
    return t.read(spark, sf, "entity_rows").select("row_id", F.get_json_object(j, "$.id").alias("id"), F.json_array_length(F.get_json_object(j, "$.source_chunk_id")).alias("n"))


@_query("set5_appended", "SELECT task, count(*) + 1 AS n FROM eval_items GROUP BY task")
def _(spark, sf):
    old = t.read(spark, sf, "eval_items").select(F.col("item_id").cast("string").alias("id"), "task", "text")
    return append_examples(old, old.select("task").distinct()).groupBy("task").agg(F.count(F.lit(1)).alias("n"))


@_query("top5_example_fusion", """WITH w AS (SELECT a.item_id AS query_id, b.item_id AS id, length(b.text) AS x, b.item_id AS y FROM eval_items a JOIN eval_items b ON a.task = b.task AND a.item_id <> b.item_id),
r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, id) - 1 AS rx, row_number() OVER (PARTITION BY query_id ORDER BY y DESC, id) - 1 AS ry FROM w)
SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(1.0 / (2 + rx + 1) + 1.0 / (2 + ry + 1), 12) DESC, id) AS rank FROM r) WHERE rank <= 4""")
def _(spark, sf):
    e = t.read(spark, sf, "eval_items")
    pairs = e.select(F.col("item_id").alias("query_id"), "task").join(e.select(F.col("item_id").alias("id"), "text", "task"), "task").where("query_id <> id")
    by = lambda c: pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "id"))).select("query_id", "id", "rank")
    return models.fuse_examples([by(F.length("text")), by("id")], 4).select("query_id", "id", "rank")


# Vocabulary with constraints: some relation types get ends, rules and inverses of their own


def constrained_ontology(spark, sf) -> ontology.Ontology:
    base = ontology.Ontology.from_lists(t.read(spark, sf, "entity_type_list"), t.read(spark, sf, "relation_type_list"))
    names = sorted(base.relations)
    first, second, third, fourth = names[:4]
    ends = {
        first: {"domain": ["PERSON"], "range": ["GUILD"], "retype_when": [{"to": second, "subject": "PERSON", "object": "SETTLEMENT"}]},
        second: {"domain": ["PERSON"], "range": ["SETTLEMENT"]},
        third: {"domain": ["PERSON"], "range": ["PERSON"], "symmetric": True},
        fourth: {"domain": ["GUILD"], "inverse_aliases": ["INVERSE OF FOURTH"]},
    }
    return ontology.Ontology.from_mapping({"relations": [{"name": n, "aliases": list(base.relations[n].aliases), **x} for n, x in ends.items()]}, base)


_VOCABULARY = """WITH RECURSIVE up AS (SELECT name, name AS a FROM entity_type_list UNION ALL SELECT up.name, e.parent FROM up JOIN entity_type_list e ON e.name = up.a WHERE e.parent IS NOT NULL),
n AS (SELECT name, row_number() OVER (ORDER BY name) AS k FROM relation_type_list),
isa AS (SELECT s.name AS s, o.name AS o, s.name IN (SELECT name FROM up WHERE a = 'PERSON') AS sp, o.name IN (SELECT name FROM up WHERE a = 'PERSON') AS op, s.name IN (SELECT name FROM up WHERE a = 'GUILD') AS sg,
  o.name IN (SELECT name FROM up WHERE a = 'GUILD') AS og, s.name IN (SELECT name FROM up WHERE a = 'SETTLEMENT') AS ss, o.name IN (SELECT name FROM up WHERE a = 'SETTLEMENT') AS os FROM entity_type_list s, entity_type_list o),
tri AS (SELECT n.name AS r, s, o, CASE k WHEN 1 THEN CASE WHEN sp AND og THEN 'ok' WHEN sp AND os THEN 'retype' WHEN op AND sg THEN 'swap' END
  WHEN 2 THEN CASE WHEN sp AND os THEN 'ok' WHEN op AND ss THEN 'swap' END WHEN 3 THEN CASE WHEN sp AND op THEN 'ok' END WHEN 4 THEN CASE WHEN sg THEN 'ok' WHEN og THEN 'swap' END END AS outcome FROM n, isa WHERE k <= 4)"""


@_query("ont4_allowed_triples", _VOCABULARY + " SELECT r AS relation_type, s AS subject_type, o AS object_type, outcome FROM tri WHERE outcome IS NOT NULL")
def _(spark, sf):
    return constrained_ontology(spark, sf).triples(spark).select("relation_type", "subject_type", "object_type", "outcome")


@_query("ont6_relations_by_pair", _VOCABULARY + """, p AS (SELECT DISTINCT chunk_id, entity_type FROM entity_model WHERE entity_type IN (SELECT name FROM entity_type_list))
SELECT a.chunk_id, tri.r AS relation_type, count(*) AS n_pairs FROM p a JOIN p b ON b.chunk_id = a.chunk_id JOIN tri ON tri.s = a.entity_type AND tri.o = b.entity_type AND (tri.outcome = 'ok') WHERE a.chunk_id IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    types = t.read(spark, sf, "entity_model").where("chunk_id IS NOT NULL").select("chunk_id", "entity_type")
    pairs = ontology.type_pairs(types, constrained_ontology(spark, sf))
    return pairs.groupBy("chunk_id", "relation_type").agg(F.count(F.lit(1)).alias("n_pairs"))


_REL_KEY = "array_to_string(list_filter(regexp_split_to_array(upper(regexp_replace(regexp_replace(r.relation_type, '(?s) \\(.*$', ''), '[-_]', ' ', 'g')), '\\s+'), lambda x: x <> ''), '_')"


@_query("ont10_constraints", _VOCABULARY + f""", sp AS (SELECT DISTINCT upper(s) AS k, name FROM (SELECT name, unnest(list_append(coalesce(aliases, []), name)) AS s FROM relation_type_list)),
e AS (SELECT chunk_id, entity_name, arg_max(coalesce(entity_type, '<null>'), mention_id) AS ty FROM entity_model WHERE chunk_id IS NOT NULL AND entity_name IS NOT NULL GROUP BY ALL),
v AS (SELECT r.mention_id, r.source_entity, r.target_entity, sp.name AS rel, s.ty AS st, o.ty AS ot, CASE WHEN s.ty IS NULL OR o.ty IS NULL THEN 'dangling_endpoint' WHEN r.source_entity = r.target_entity THEN 'self_loop' WHEN sp.name IS NULL THEN 'unknown_relation_type' END AS bad
  FROM relation_model r LEFT JOIN e s ON s.chunk_id = r.chunk_id AND s.entity_name = r.source_entity LEFT JOIN e o ON o.chunk_id = r.chunk_id AND o.entity_name = r.target_entity LEFT JOIN sp ON sp.k = {_REL_KEY}),
c AS (SELECT v.*, tri.outcome, rel IN (SELECT r FROM tri) AND st IN (SELECT name FROM entity_type_list) AND ot IN (SELECT name FROM entity_type_list) AND coalesce(tri.outcome, '') <> 'ok' AND bad IS NULL AS broken FROM v LEFT JOIN tri ON tri.r = rel AND tri.s = st AND tri.o = ot)
SELECT mention_id, CASE WHEN broken AND outcome = 'retype' THEN (SELECT name FROM n WHERE k = 2) ELSE rel END AS resolved_relation,
  CASE WHEN broken AND outcome = 'swap' THEN target_entity ELSE source_entity END AS subject, CASE WHEN broken AND outcome = 'swap' THEN source_entity ELSE target_entity END AS object,
  CASE WHEN bad IS NOT NULL THEN bad WHEN broken THEN 'constraint' END AS violation, CASE WHEN bad IS NOT NULL THEN 'dropped' WHEN broken AND outcome IS NOT NULL THEN 'coerced' WHEN broken THEN 'dropped' END AS action FROM c""")
def _(spark, sf):
    e = t.read(spark, sf, "entity_model").where("chunk_id IS NOT NULL AND entity_name IS NOT NULL").select("chunk_id", "entity_name", F.coalesce("entity_type", F.lit("<null>")).alias("resolved_type"), F.col("mention_id").alias("pos"))
    out = ontology.validate_relations(t.read(spark, sf, "relation_model"), e, constrained_ontology(spark, sf), ontology.Policies(unknown_relation="drop"))
    return out.select("mention_id", "resolved_relation", "subject", "object", "violation", "action")


@_query("set8_combined_types", "SELECT name, parent FROM entity_type_list WHERE name NOT IN ('TREATY', 'LEDGER') UNION ALL SELECT 'SANDBANK', 'ISLAND'")
def _(spark, sf):
    base = ontology.Ontology.from_lists(t.read(spark, sf, "entity_type_list"), t.read(spark, sf, "relation_type_list"))
    own = ontology.Ontology.from_mapping({"entities": [{"name": "SANDBANK", "parent": "ISLAND"}], "exclude": ["TREATY", "LEDGER"]}, base)
    return spark.createDataFrame([(e.name, e.parent) for e in own.entities.values()], "name string, parent string")


@_query("fn2_named_uuids", "SELECT id, length(id) > 0 AS named FROM points")
def _(spark, sf):
    u = ids.named_uuid("points", F.col("id"))
    return t.read(spark, sf, "points").select("id", u.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$").alias("named"))


@_query("fn18_json_bytes", "SELECT row_id, 9 + length(id) AS n FROM entity_rows")
def _(spark, sf):
    return t.read(spark, sf, "entity_rows").select("row_id", text.json_size(F.col("id")).alias("n"))


# Extraction with models that regular expressions stand in for


def _capitalised(content: str) -> list[str]:
    return sorted(set(re.findall(r"[A-Z][a-z]{3,}", content)))[:3]


def _entities_of(content: str) -> list[dict]:
    if len(content) % 7 == 0:
        raise ValueError("no answer")
    return [{"entity_name": w, "entity_type": "PERSON", "description": None} for w in _capitalised(content)]


def _follows(content: str, entities: list[dict]) -> list[dict]:
    n = sorted(e["entity_name"] for e in entities)
    return [{"source_entity": a, "target_entity": b, "relation_type": "FOLLOWS", "description": f"{a} {b}", "relationship_strength": 1} for a, b in zip(n, n[1:])]


_FOUND = """WITH f AS (SELECT row_id, list_sort(list_distinct(regexp_extract_all(content, '[A-Z][a-z]{3,}')))[1:3] AS n, length(content) AS len FROM kv_chunks WHERE content IS NOT NULL)"""


def _rows_as_chunks(spark, sf):
    return t.read(spark, sf, "kv_chunks").select(F.col("row_id").cast("string").alias("id"), "content")


@_query("ext2_two_stages", _FOUND + """SELECT row_id::VARCHAR AS chunk_id, n[i] AS source_entity, n[i + 1] AS target_entity, n[i] || ' ' || n[i + 1] AS description FROM (SELECT row_id, n, unnest(range(1, len(n))) AS i FROM f WHERE len % 7 <> 0)""".replace("len(n)", "array_length(n)"))
def _(spark, sf):
    out = extract.two_stage(_rows_as_chunks(spark, sf), _entities_of, _follows)
    return out.relations.select("chunk_id", "source_entity", "target_entity", "description")


@_query("ext4_failures", _FOUND + "SELECT row_id::VARCHAR AS chunk_id, 'entities' AS stage, 'ValueError: no answer' AS error FROM f WHERE len % 7 = 0")
def _(spark, sf):
    return extract.two_stage(_rows_as_chunks(spark, sf), _entities_of, _follows).failures


def _pair_text(content: str, a: str, b: str) -> str:
    return f"- {a} meets {b}" if a < b else "- "


@_query("ext3_four_stages", _FOUND + """, e AS (SELECT row_id, unnest(list_distinct(list_transform(n, lambda w: upper(w)))) AS w FROM f)
SELECT a.row_id::VARCHAR AS chunk_id, a.w AS source_entity, b.w AS target_entity, a.w || ' meets ' || b.w AS description FROM e a JOIN e b ON a.row_id = b.row_id AND a.w < b.w""")
def _(spark, sf):
    out = extract.four_stage(_rows_as_chunks(spark, sf), _capitalised, lambda content, w: w.upper(), lambda content, w: f"about {w}", _pair_text)
    return out.relations.select("chunk_id", "source_entity", "target_entity", "description")
