"""Errors, ties and edge cases of search, engines and changes of the graph."""

import importlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kgspark.functions import text
from kgspark.operators import chunking, models, ontology, search
from kgspark.operators.index import GraphIndex
from kgspark.operators.ranking import dense_top_k, running_total
from kgspark.storage import clean, cut, shared_dir

ENTITY = "id string, entity_name string, entity_type string, description string, source_chunk_id array<string>, documents_id array<string>, clusters array<struct<level:int,cluster_id:int>>"
RELATION = "id string, subject_id string, object_id string, subject_name string, object_name string, relation_type string, description string, relation_strength double, source_chunk_id array<string>"


def vectors(spark, key, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], f"{key} string, vector array<float>")


def brute(q, p, k, metric):
    out = {}
    for i, a in q:
        scored = []
        for j, b in p:
            if b is None or len(b) != len(a) or any(x is None or math.isnan(x) for x in b):
                continue
            a_, b_ = np.asarray(a, np.float32).astype(float), np.asarray(b, np.float32).astype(float)
            n = np.linalg.norm(a_) * np.linalg.norm(b_) if metric == "cosine" else 1.0
            scored.append((-round(float(a_ @ b_) / n, 6) if n else 0.0, j))
        out[i] = [j for _, j in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("metric", ["cosine", "dot"])
def test_dense_equals_brute_force_with_ties_nulls_and_copies(spark, metric):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 12)) * rng.uniform(0.1, 9, size=(400, 1))
    x[100:200] = x[3]  # one vector often
    points = [(f"p{i:03d}", list(v)) for i, v in enumerate(x)] + [("n", None), ("short", [1.0]), ("nan", [float("nan")] * 12), ("null", [None] + [1.0] * 11), ("zero", [0.0] * 12)]
    asked = [(f"q{i}", list(v)) for i, v in enumerate(x[:5])]
    got = {}
    for r in sorted(dense_top_k(vectors(spark, "query_id", asked), vectors(spark, "id", points), 7, 12, metric, digits=6).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == brute(asked, points, 7, metric)


def test_dense_empty_and_bad_arguments(spark):
    some, none = vectors(spark, "id", [("a", [1, 0])]), vectors(spark, "query_id", [])
    assert dense_top_k(none, some, 3, 2).count() == 0
    assert dense_top_k(vectors(spark, "query_id", [("q", [1, 0])]), some.limit(0), 3, 2).count() == 0
    with pytest.raises(ValueError):
        dense_top_k(none, some, 0, 2)


def test_hybrid_needs_a_dense_vector(spark):
    q = spark.createDataFrame([("q", None, ([1], [1.0]))], "query_id string, vector array<float>, sparse struct<indices:array<int>,values:array<double>>")
    p = spark.createDataFrame([("a", [1.0], ([1], [2.0]))], "id string, vector array<float>, sparse struct<indices:array<int>,values:array<double>>")
    with pytest.raises(NotImplementedError):
        search.hybrid_top_k(q, p, 3, 1)
    with pytest.raises(ValueError):
        search.VectorIndex(p, p.drop("sparse"), 1).query(q, 3)


def test_engines(spark):
    engine = search.Engine(spark, lambda q: q, lambda got: got.select("query_id", F.upper("query").alias("answer")))
    assert engine.query("two words") == "TWO WORDS"
    events = list(engine.stream_query("two words"))
    assert [e["delta"] for e in events[:-1]] == ["TWO", "WORDS"] and events[-1]["payload"] is not None
    with pytest.raises(ValueError):
        search.Engine(spark, lambda q: q).query("x")
    fails = lambda q: q.select("query_id", F.raise_error(F.lit("down")).cast("string").alias("context"))
    with pytest.raises(RuntimeError, match="every engine failed"):
        search.tolerant_mix(spark.createDataFrame([("q", "x")], "query_id string, query string"), {"a": fails})


def graph_of(spark):
    e = lambda i: (i, f"name {i}", "KIND", f"about {i}", ["c1"], ["d"], [(0, 0)])
    entities = spark.createDataFrame([e("A"), e("B")], ENTITY)
    relations = spark.createDataFrame([("r", "A", "B", "A", "B", "R", "x", 1.0, ["c1"])], RELATION)
    chunks = spark.createDataFrame([("c1", "text", "d")], "id string, content string, doc_id string")
    com = spark.createDataFrame([("com-x", 0, 0)], "id string, level int, cluster_id int")
    return GraphIndex(entities, relations, chunks, com, com.select("id", F.lit("s").alias("summary")))


def test_changes_that_are_refused(spark):
    g = graph_of(spark)
    stranger = g.entities.limit(1).withColumn("id", F.lit("Z"))
    with pytest.raises(ValueError):
        g.update_nodes(stranger)
    with pytest.raises(ValueError):
        g.upsert_edges(g.relations.withColumn("object_id", F.lit("Z")))
    with pytest.raises(ValueError):
        g.update_edges(g.relations.withColumn("id", F.lit("other")))
    with pytest.raises(ValueError):
        g.upsert_communities(g.communities.withColumn("id", F.lit("other")), must_exist=True)
    with pytest.raises(ValueError):
        g.merge_nodes(g.entities.unionByName(g.entities))


def test_further_clusters_get_numbers_of_their_own(spark):
    g = graph_of(spark)
    out = g.add_communities(g.entities, g.communities, g.summaries)
    assert sorted((r["level"], r["cluster_id"]) for r in out.communities.collect()) == [(0, 0), (0, 1)]
    assert {tuple(map(tuple, r["clusters"])) for r in out.entities.collect()} == {((0, 0), (0, 1))}
    assert out.summaries.count() == 2


def test_reindexing_changes_text_vectors_and_communities(spark):
    g = graph_of(spark)
    long = g.entities.withColumn("description", F.lit("One. Two. Three."))
    flat = lambda rows, c: rows.withColumn("embedding", F.array(F.length(c).cast("float")))
    g = GraphIndex(long, g.relations, g.chunks, g.communities, g.summaries, long.select("id", F.array(F.lit(0.0).cast("float")).alias("vector")))
    out = g.reindex(2, lambda s: s.map(lambda x: "short"), lambda s: s.map(lambda x: "report"), embed=flat)
    assert {r["description"] for r in out.entities.collect()} == {"short"}
    assert {r["vector"][0] for r in out.entity_vectors.collect()} == {len("name A - short")}
    assert out.communities.count() >= 1 and out.summaries.count() == out.communities.count()


def test_overlap_comes_from_the_stripped_chunk(spark):
    s = F.array(*map(F.lit, ("alpha beta.", "gamma delta.", "epsilon.")))
    assert spark.range(1).select(chunking.pack(s, 12, 4).alias("c")).first()["c"] == ["alpha beta.", "eta. gamma delta.", "lta. epsilon."]


def test_properties_round_trip_and_foreign_types(spark):
    p = text.encode_properties({"a": F.lit(1), "b": F.array(F.lit("x"), F.lit("y")), "c": F.lit(None).cast("string")}, {"a"})
    row = spark.range(1).select(p.alias("p")).select(
        text.decode_property(F.col("p"), "a", "int", True).alias("a"), text.decode_property(F.col("p"), "b", "array<string>", False).alias("b"),
        text.decode_property(F.col("p"), "c", "string", True).alias("c"), text.decode_property(F.col("p"), "b", "int", True).alias("d"),
    ).first()
    assert tuple(row) == (1, ["x", "y"], None, None)


def test_semantic_examples_guard_zero_vectors(spark):
    q, e = vectors(spark, "query_id", [("z", [0, 0]), ("q", [1, 0])]), vectors(spark, "id", [("a", [1, 0]), ("b", [0, 0])])
    got = {(r["query_id"], r["id"]): r["score"] for r in models.semantic_examples(e, q, 5, 2).collect()}
    assert got == {("q", "a"): 1.0, ("q", "b"): 0.0}


def test_inverse_aliases_only_where_types_are_coerced(spark):
    o = ontology.Ontology.from_mapping({"entities": ["P", "Q"], "relations": [{"name": "OWNS", "inverse_aliases": ["OWNED BY"], "domain": ["P"]}]})
    r = spark.createDataFrame([("c", "a", "b", "owned by")], "chunk_id string, source_entity string, target_entity string, relation_type string")
    e = spark.createDataFrame([("c", "a", "Q", 1), ("c", "b", "Q", 1), ("c", "b", "P", 2)], "chunk_id string, entity_name string, resolved_type string, pos int")
    got = ontology.validate_relations(r, e, o).first()
    assert (got["resolved_relation"], got["subject"], got["object"], got["violation"]) == ("OWNS", "b", "a", None)
    assert ontology.validate_relations(r, e, o, ontology.Policies.strict()).first()["violation"] == "unknown_relation_type"


def test_clean_removes_what_was_cut(spark):
    df = cut(spark.range(3))
    assert df.count() == 3
    clean(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/cut-{spark.sparkContext.applicationId}")
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_core_queries_stay_if_a_package_is_missing(monkeypatch):
    real = importlib.import_module

    def without(name, *rest):
        if name.startswith("kgspark.llm"):
            raise ImportError("No module named 'xxhash'", name="xxhash")
        return real(name, *rest)

    monkeypatch.setattr(importlib, "import_module", without)
    with pytest.warns(UserWarning, match="xxhash"):
        assert "p5_found" in entry.queries()


def test_running_totals_of_a_hot_group_over_many_ranges(spark):
    rows = [("hot", i, i % 5) for i in range(3_000)] + [("a", 1, 4), ("a", 2, 1), (None, 1, 7), (None, 2, 2)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = {(r["g"], r["o"]): r["total"] for r in running_total(df, F.col("v"), "g", ["o"]).collect()}
    want, run = {}, {}
    for g, o, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        run[g] = want[g, o] = run.get(g, 0) + v
    assert got == want
    assert running_total(df.limit(0), F.col("v"), "g", ["o"]).count() == 0
