"""Search, chunking, vocabulary and engine queries over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kgspark.functions import text, vectors
from kgspark.operators import chunking, engines, lookup, models, neighbourhood, ontology, ranking, sparse
from kgspark.plans import graph
from kgspark.plans import tables as t
from kgspark.plans.tables import WITH
from kgspark.sources.store import display_attributes
from kgspark.storage import cut
from kgspark.streaming.ingest import windowed_counts

QUERIES: dict = {}
SQL: dict = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# Dense search: every hundredth vector against all of them


def _vectors(spark, sf):
    e = t.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return e.where("id % 100 = 0").withColumnRenamed("id", "query_id"), e


_DENSE = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS id, {f}(v, embedding::DOUBLE[]) AS s FROM q, embeddings)
SELECT query_id, id, round(s, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s{w}) WHERE rank <= 10"""


def _dense(metric, least):
    def run(spark, sf):
        q, e = _vectors(spark, sf)
        return ranking.dense_top_k(q, e, 10, 64, metric, least).select("query_id", "id", F.round("score", 5).alias("score"), "rank")

    return run


_query("top1_dense_cosine", _DENSE.format(f="list_cosine_similarity", w=""))(_dense("cosine", None))
_query("top1_dense_dot", _DENSE.format(f="list_inner_product", w=""))(_dense("dot", None))
_query("flt1_dense_threshold", _DENSE.format(f="list_cosine_similarity", w=" WHERE s >= 0.2"))(_dense("cosine", 0.2))


@_query("fn11_normalise", "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS squared, round(list_cosine_similarity(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS same FROM embeddings")
def _(spark, sf):
    v = F.col("embedding")
    n = vectors.normalise(v)
    return t.read(spark, sf, "embeddings").select("vec_id", F.round(vectors.dot(v, v), 4).alias("squared"), F.round(vectors.dot(n, n), 4).alias("same"))


@_query("win4_consecutive_similarity", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (lag(embedding) OVER (PARTITION BY label ORDER BY vec_id))::DOUBLE[]), 5) AS similarity FROM embeddings")
def _(spark, sf):
    before = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    return t.read(spark, sf, "embeddings").select("vec_id", F.round(vectors.cosine(F.col("embedding"), before), 5).alias("similarity"))


# Keyword search: every test item against all documents

_TERMS = """WITH tok AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]+$')) AS w FROM documents),
terms AS (SELECT id, len AS length, token, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS token FROM tok) GROUP BY ALL),
qt AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]+$'))) AS token FROM eval_items),
idf AS (SELECT token, ln(1.0 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM terms GROUP BY token),
bm AS (SELECT query_id, id, round(sum(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 256.0)) * idf), 6) AS score FROM qt JOIN idf USING (token) JOIN terms USING (token) GROUP BY ALL),
bmk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= {k}),
ov AS (SELECT query_id, id, round(count(*) / any_value(n), 6) AS score FROM qt JOIN terms USING (token) JOIN (SELECT query_id, count(*) AS n FROM qt GROUP BY ALL) USING (query_id) GROUP BY ALL),
ovk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ov) WHERE rank <= {k})
"""
_TERMS20, _TERMS10 = _TERMS.replace("{k}", "20"), _TERMS.replace("{k}", "10")


def _texts(spark, sf):
    docs = t.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs, t.read(spark, sf, "eval_items").select(F.col("item_id").alias("query_id"), "text")


@_query("agg18_document_frequency", _TERMS20 + "SELECT token, count(*) AS df FROM terms GROUP BY token")
def _(spark, sf):
    terms = sparse.term_counts(_texts(spark, sf)[0], "id")
    return terms.groupBy("token").agg(F.count("id").alias("df"))


@_query("top4_bm25", _TERMS10 + "SELECT query_id, id, round(score, 3) AS score, rank FROM bmk")
def _(spark, sf):
    return sparse.bm25_top_k(*_texts(spark, sf), 10).select("query_id", "id", F.round("score", 3).alias("score"), "rank")


@_query("top2_hybrid_fusion", _TERMS20 + """SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
FROM (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM bmk UNION ALL SELECT query_id, id, rank FROM ovk) GROUP BY ALL)) WHERE rank <= 10""")
def _(spark, sf):
    d, q = _texts(spark, sf)
    both = cut(sparse.keyword_scores(d, q))
    lists = [ranking.top_k(both, 20, score=c) for c in ("bm25", "overlap")]
    return ranking.fuse(lists, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@_query("top7_rerank", _TERMS20 + """SELECT query_id, id, rank FROM (SELECT b.query_id, b.id, row_number() OVER (PARTITION BY b.query_id ORDER BY coalesce(o.score, 0) DESC, b.rank) - 1 AS rank
FROM bmk b LEFT JOIN ov o ON o.query_id = b.query_id AND o.id = b.id) WHERE rank < 5""")
def _(spark, sf):
    d, q = _texts(spark, sf)
    hits = sparse.bm25_top_k(d, q, 20).select("query_id", "id", F.col("rank").alias("pos"), F.col("rescore").alias("score"))
    return ranking.rerank(hits, 5).select("query_id", "id", "rank")


@_query("top6_sample", _TERMS20 + "SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY md5(query_id::VARCHAR || '|' || id::VARCHAR || '|42'), id) AS rank FROM bm) WHERE rank <= 2")
def _(spark, sf):
    d, q = _texts(spark, sf)
    return ranking.sample_k(sparse.bm25_scores(d, q).select("query_id", "id"), 2)


@_query("agg15_low_match_rate", _TERMS20 + "SELECT round(avg(CASE WHEN item_id NOT IN (SELECT query_id FROM bm) THEN 1 ELSE 0 END), 6) AS low_match_rate FROM eval_items")
def _(spark, sf):
    d, q = _texts(spark, sf)
    return models.low_match_rate(q, sparse.bm25_scores(d, q))


@_query("eng1_naive", _TERMS20.replace("doc_id AS id", "id").replace("lower(text), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]+$')) AS w FROM documents", "lower(content), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]+$')) AS w FROM chunks").replace("FROM documents)", "FROM chunks)").replace("WITH tok", WITH + ", tok") + """
SELECT query_id, r.id AS chunk_id, c.doc_id, r.rank FROM (SELECT b.query_id, b.id, row_number() OVER (PARTITION BY b.query_id ORDER BY coalesce(o.score, 0) DESC, b.rank) - 1 AS rank
FROM bmk b LEFT JOIN ov o ON o.query_id = b.query_id AND o.id = b.id) r JOIN chunks c ON c.id = r.id WHERE r.rank < 5""")
def _(spark, sf):
    return engines.naive_retrieve(_texts(spark, sf)[1], t.chunks(spark, sf), 20, 5).select("query_id", "chunk_id", "doc_id", "rank")


@_query("eng2_local", WITH + f""", summaries AS ({graph._SUMMARY_SQL}),
s AS (SELECT query_id, list_sort(list(id)) AS entity_ids FROM seeds GROUP BY query_id),
rel AS (SELECT query_id, count(DISTINCT relation_id) AS n FROM seeds JOIN ends ON node = id GROUP BY ALL),
ch AS (SELECT query_id, count(DISTINCT chunk_id) AS n FROM seeds JOIN cites USING (id) WHERE chunk_id IN (SELECT id FROM chunks) GROUP BY ALL),
com AS (SELECT query_id, list_sort(list(DISTINCT 'com-' || md5(chr(0) || c.level || ':' || c.cluster_id))) AS l FROM seeds JOIN (SELECT id, unnest(clusters) AS c FROM nodes) USING (id)
  WHERE c.level <= 2 AND 'com-' || md5(chr(0) || c.level || ':' || c.cluster_id) IN (SELECT id FROM summaries) GROUP BY ALL),
doc AS (SELECT query_id, list_sort(list(DISTINCT d)) AS l FROM seeds JOIN (SELECT id, unnest(documents_id) AS d FROM nodes) USING (id) WHERE d IS NOT NULL GROUP BY ALL)
SELECT query_id, entity_ids, coalesce(rel.n, 0) AS n_relations, coalesce(ch.n, 0) AS n_chunks, coalesce(com.l, []) AS community_ids, doc.l AS documents_id
FROM s LEFT JOIN rel USING (query_id) LEFT JOIN ch USING (query_id) LEFT JOIN com USING (query_id) LEFT JOIN doc USING (query_id)""")
def _(spark, sf):
    out = engines.local_retrieve(t.seeds(spark, sf), t.nodes(spark, sf), t.edges(spark, sf), t.chunks(spark, sf), graph.summaries(spark, sf))
    return out.select("query_id", "entity_ids", F.size("relation_ids").alias("n_relations"), F.size("chunk_ids").alias("n_chunks"), "community_ids", "documents_id")


_RATED = """rated AS (SELECT q.name AS query_id, s.id AS community_id, least(10, (length(s.summary) * length(q.name)) % 13)::DOUBLE AS rating FROM summaries s, entity_type_list q)"""


def _rate(query, summary):
    return F.least(F.lit(10), (F.length(summary) * F.length(query)) % 13).cast("double")


@_query("eng3_global", WITH + f", summaries AS ({graph._SUMMARY_SQL}), {_RATED} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rating DESC, community_id) - 1 AS rank FROM rated WHERE rating > 0")
def _(spark, sf):
    q = t.read(spark, sf, "entity_type_list").select(F.col("name").alias("query_id"), F.col("name").alias("query"))
    return engines.global_retrieve(q, graph.summaries(spark, sf), _rate)


@_query("eng4_mix", WITH + f", summaries AS ({graph._SUMMARY_SQL}), {_RATED}, " + """g AS (SELECT query_id, 'best ' || arg_max(community_id, struct_pack(r := rating, c := community_id)) AS context FROM rated WHERE rating > 9 GROUP BY query_id),
k AS (SELECT entity_type AS query_id, 'entities ' || count(*) AS context FROM nodes GROUP BY entity_type)
SELECT query_id, 0 AS position, 'types' AS engine, context FROM k WHERE query_id IN (SELECT name FROM entity_type_list) UNION ALL SELECT query_id, 1, 'global', context FROM g""")
def _(spark, sf):
    q = t.read(spark, sf, "entity_type_list").select(F.col("name").alias("query_id"), F.col("name").alias("query"))
    rated = engines.global_retrieve(q, graph.summaries(spark, sf), _rate).where("rating > 9")
    best = rated.groupBy("query_id").agg(F.concat(F.lit("best "), F.max_by("community_id", F.struct("rating", "community_id"))).alias("context"))
    kinds = t.nodes(spark, sf).groupBy(F.col("entity_type").alias("query_id")).agg(F.concat(F.lit("entities "), F.count(F.lit(1)).cast("string")).alias("context")).join(q.select("query_id"), "query_id", "left_semi")
    return engines.mix({"types": kinds, "global": best})


# Plans: the type hierarchy as a plan, a type after its parent

_LEVELS = """WITH RECURSIVE lv AS (SELECT name AS id, 0 AS level FROM entity_type_list WHERE parent IS NULL
UNION ALL SELECT e.name, lv.level + 1 FROM entity_type_list e JOIN lv ON e.parent = lv.id)"""


def _plan(spark, sf):
    needs = F.when(F.col("parent").isNotNull(), F.array("parent")).otherwise(F.array().cast("array<string>"))
    return t.read(spark, sf, "entity_type_list").select(F.lit("types").alias("plan_id"), F.col("name").alias("id"), F.col("description").alias("query"), needs.alias("depends_on"))


@_query("srt4_topological_levels", _LEVELS + " SELECT id, level FROM lv")
def _(spark, sf):
    return ranking.topological_levels(_plan(spark, sf)).select("id", "level")


@_query("eng5_query_plan", _LEVELS + " SELECT id, level, upper(description) AS answer, id NOT IN (SELECT parent FROM entity_type_list WHERE parent IS NOT NULL) AS is_sink FROM lv JOIN entity_type_list ON name = id")
def _(spark, sf):
    answer = lambda q: q.select("plan_id", "id", F.upper("query").alias("answer"))
    return engines.run_plans(_plan(spark, sf), answer).select("id", "level", "answer", "is_sink")


# Vocabulary


def _ontology(spark, sf):
    return ontology.Ontology.from_lists(t.read(spark, sf, "entity_type_list"), t.read(spark, sf, "relation_type_list"))


_KEY = "array_to_string(list_filter(regexp_split_to_array(upper(regexp_replace(regexp_replace({0}, '(?s) \\(.*$', ''), '[-_]', ' ', 'g')), '\\s+'), lambda x: x <> ''), '_')"
_SPELL = "sp AS (SELECT DISTINCT upper(s) AS k, name FROM (SELECT name, unnest(list_append(coalesce(aliases, []), name)) AS s FROM {0}))"


@_query("ont1_type_keys", f"SELECT DISTINCT entity_type, {_KEY.format('entity_type')} AS type_key FROM entity_model WHERE entity_type IS NOT NULL")
def _(spark, sf):
    return t.read(spark, sf, "entity_model").where("entity_type IS NOT NULL").select("entity_type", text.type_key(F.col("entity_type")).alias("type_key")).distinct()


@_query("ont2_resolve_types", f"WITH {_SPELL.format('entity_type_list')} SELECT mention_id, name AS resolved_type FROM entity_model LEFT JOIN sp ON k = {_KEY.format('entity_type')}")
def _(spark, sf):
    out = ontology.validate_entities(t.read(spark, sf, "entity_model"), _ontology(spark, sf), ontology.Policies(unknown_entity="drop"))
    return out.select("mention_id", "resolved_type")


@_query("ont3_closure", "WITH RECURSIVE c AS (SELECT name, parent AS ancestor, 1 AS distance FROM entity_type_list WHERE parent IS NOT NULL UNION ALL SELECT c.name, e.parent, distance + 1 FROM c JOIN entity_type_list e ON e.name = c.ancestor WHERE e.parent IS NOT NULL) SELECT * FROM c")
def _(spark, sf):
    return _ontology(spark, sf).closure(spark)


@_query("ont9_coerced_types")
def _(spark, sf):
    out = ontology.validate_entities(t.read(spark, sf, "entity_model"), _ontology(spark, sf))
    return out.select("mention_id", "resolved_type", "violation", "action")


_VALID = f"""WITH {_SPELL.format('relation_type_list')}, n AS (SELECT DISTINCT chunk_id, entity_name FROM entity_model),
v AS (SELECT mention_id, CASE WHEN NOT EXISTS (SELECT 1 FROM n WHERE n.chunk_id = r.chunk_id AND n.entity_name = r.source_entity) OR NOT EXISTS (SELECT 1 FROM n WHERE n.chunk_id = r.chunk_id AND n.entity_name = r.target_entity) THEN 'dangling_endpoint'
  WHEN source_entity = target_entity THEN 'self_loop' WHEN sp.name IS NULL THEN 'unknown_relation_type' END AS violation, relation_type FROM relation_model r LEFT JOIN sp ON k = {_KEY.format('relation_type')})"""


def _validated(spark, sf):
    e = t.read(spark, sf, "entity_model").select("chunk_id", "entity_name", F.col("entity_type").alias("resolved_type"))
    return ontology.validate_relations(t.read(spark, sf, "relation_model"), e, _ontology(spark, sf), ontology.Policies(unknown_relation="drop"))


@_query("ont10_validate_relations", _VALID + " SELECT mention_id, violation, CASE WHEN violation IS NOT NULL THEN 'dropped' END AS action FROM v")
def _(spark, sf):
    return _validated(spark, sf).select("mention_id", "violation", "action")


@_query("agg12_validation_report", _VALID + " SELECT violation, 'dropped' AS action, relation_type AS kind, count(*) AS n FROM v WHERE violation IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return ontology.report(_validated(spark, sf), "relation_type")


@_query("agg13_most_common", _VALID + " SELECT violation, count(*) AS n FROM v WHERE violation IS NOT NULL GROUP BY ALL ORDER BY n DESC, violation LIMIT 5")
def _(spark, sf):
    return lookup.most_common(_validated(spark, sf), "violation", 5)


# Text and chunks


_CHUNKS = r"""WITH s AS (SELECT text, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(7), 'g'), '\n+', chr(7), 'g'), chr(7)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
p AS (SELECT text, list_reduce(list_transform(l, lambda x: struct_pack(done := []::VARCHAR[], cur := x || ' ')), lambda a, x: CASE WHEN length(a.cur) + length(x.cur) - 1 <= 500 THEN struct_pack(done := a.done, cur := a.cur || x.cur)
  ELSE struct_pack(done := list_append(a.done, trim(a.cur)), cur := right(trim(a.cur), 40) || ' ' || x.cur) END) AS r FROM s WHERE len(l) > 0),
c AS (SELECT text, unnest(list_append(r.done, trim(r.cur))) AS content, generate_subscripts(list_append(r.done, trim(r.cur)), 1) - 1 AS i FROM p)
SELECT 'chunk-' || md5(chr(0) || content) AS id, content, i AS chunk_order_idx, md5(chr(0) || text) AS doc_id, len(regexp_split_to_array(content, '\s+')) AS num_tokens FROM c"""


@_query("chk1_simple_chunks", _CHUNKS)
def _(spark, sf):
    return chunking.simple_chunks(t.read(spark, sf, "documents"), 500, 40)


@_query("chk2_semantic_chunks")
def _(spark, sf):
    return chunking.semantic_chunks(t.read(spark, sf, "documents").where("text IS NOT NULL"), 80)


@_query("chk4_rule_sentences", r"""SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(7), 'g'), '\n+', chr(7), 'g'), chr(7)), lambda x: trim(x)), lambda x: x <> '')) AS n FROM documents WHERE text IS NOT NULL""")
def _(spark, sf):
    return t.read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.size(chunking.rule_sentences(F.col("text"))).alias("n"))


@_query("lim1_within_budget", """SELECT doc_id AS query_id, id, used FROM (SELECT doc_id, id, sum(coalesce(num_tokens, 0)) OVER (PARTITION BY doc_id ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS used FROM kv_chunks) WHERE used <= 300""")
def _(spark, sf):
    rows = t.read(spark, sf, "kv_chunks").select(F.col("doc_id").alias("query_id"), "id", F.col("row_id").alias("rank"), F.coalesce("num_tokens", F.lit(0)).alias("tokens"))
    return ranking.within_budget(rows, 300).select("query_id", "id", "used")


@_query("lim2_previews", "SELECT row_id, CASE WHEN length(content) > 60 THEN left(content, 60) || '...' ELSE content END AS preview FROM kv_chunks")
def _(spark, sf):
    return t.read(spark, sf, "kv_chunks").select("row_id", text.preview(F.col("content"), 60).alias("preview"))


@_query("set6_distinct_texts", "SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY trim(text)")
def _(spark, sf):
    return lookup.distinct_texts(t.read(spark, sf, "documents"), "text", "doc_id")


@_query("set7_unprocessed_texts", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND md5(chr(0) || text) NOT IN (SELECT doc_id FROM kv_chunks WHERE doc_id IS NOT NULL)")
def _(spark, sf):
    return lookup.unprocessed_texts(t.read(spark, sf, "documents"), "text", t.read(spark, sf, "kv_chunks")).select("doc_id")


@_query("fn10_labels", "SELECT DISTINCT entity_type, coalesce(nullif(CASE WHEN regexp_matches(s, '^[0-9]') THEN '_' || s ELSE s END, ''), 'ENTITY') AS label FROM (SELECT entity_type, regexp_replace(trim(entity_type), '[^A-Za-z0-9_]', '_', 'g') AS s FROM entity_model WHERE entity_type IS NOT NULL)")
def _(spark, sf):
    return t.read(spark, sf, "entity_model").where("entity_type IS NOT NULL").select("entity_type", text.label_name(F.col("entity_type")).alias("label")).distinct()


@_query("fn25_clean_fields", "SELECT mention_id, trim(source_entity) AS source_entity, relationship_strength IS NOT NULL AND relationship_strength BETWEEN 0 AND 5 AS valid, coalesce(nullif(trim(string_split(relation_type, ' (')[1]), ''), 'UNKNOWN') AS kind FROM relation_model")
def _(spark, sf):
    r = t.read(spark, sf, "relation_model")
    return r.select("mention_id", F.trim("source_entity").alias("source_entity"), text.valid_strength(F.col("relationship_strength")).alias("valid"), text.clean_type(F.col("relation_type")).alias("kind"))


_WORDS_OF = ", ".join(f"(list_sum([0] || list_transform(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in ws.split())})), lambda x: length(x) + 1))) AS {k}" for k, ws in text.FREQUENT_WORDS.items())


@_query("fn27_language", f"""WITH d AS (SELECT lang, text, string_split(' ' || lower(regexp_replace(text, '[^\\p{{L}}]+', ' ', 'g')) || ' ', ' ') AS w FROM documents WHERE length(text) > 0),
s AS (SELECT *, {_WORDS_OF} FROM d), b AS (SELECT *, greatest({', '.join(text.FREQUENT_WORDS)}) AS top FROM s)
SELECT lang, CASE WHEN regexp_matches(text, '[぀-ヿ]') THEN 'ja' WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' WHEN regexp_matches(text, '\\p{{Cyrillic}}') THEN 'ru' WHEN regexp_matches(text, '\\p{{Arabic}}') THEN 'ar'
  WHEN regexp_matches(text, '\\p{{Devanagari}}') THEN 'hi' WHEN regexp_matches(text, '\\p{{Thai}}') THEN 'th' {' '.join(f"WHEN {k} = top AND {k} > 0 THEN '{k}'" for k in text.FREQUENT_WORDS)} ELSE 'und' END AS detected, count(*) AS n FROM b GROUP BY ALL""")
def _(spark, sf):
    d = t.read(spark, sf, "documents").where(F.length("text") > 0)
    return d.groupBy("lang", text.language(F.col("text")).alias("detected")).agg(F.count(F.lit(1)).alias("n"))


@_query("snk7_display", WITH + """, d AS (SELECT node, count(*) AS n FROM (SELECT subject_id AS node FROM edges UNION ALL SELECT object_id FROM edges) WHERE node IS NOT NULL GROUP BY node), s AS (SELECT nodes.id, coalesce(n, 0) AS n FROM nodes LEFT JOIN d ON node = nodes.id)
SELECT id, round(15 + 35 * n / (SELECT max(n) FROM s), 4) AS node_size FROM s""")
def _(spark, sf):
    return display_attributes(t.nodes(spark, sf), t.edges(spark, sf))[0]


# Communities and streams


@_query("clu1_detect")
def _(spark, sf):
    from kgspark.operators.community import detect_communities

    return detect_communities(t.edges(spark, sf))


@_query("clu1_components")
def _(spark, sf):
    from kgspark.operators.components import connected_components

    return connected_components(t.edges(spark, sf).select(F.col("subject_id").alias("a"), F.col("object_id").alias("b")))


SQL["clu1_components"] = WITH.replace("WITH nodes", "WITH RECURSIVE nodes", 1) + """, e AS (SELECT DISTINCT a, b FROM (SELECT subject_id AS a, object_id AS b FROM edges UNION ALL SELECT object_id, subject_id FROM edges) WHERE a IS NOT NULL AND b IS NOT NULL),
r(node, c) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node WHERE r.c < e.b)
SELECT node, min(c) AS component FROM r GROUP BY node"""


@_query("str1_windowed_counts", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def _(spark, sf):
    import uuid

    out = windowed_counts(spark, sf, "events.parquet", f"events-{uuid.uuid4().hex}")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 3).alias("total"))
