"""A mini graph by hand: A to B, B to C, A to B again, D to E, F alone, G missing."""

import pytest

from kgspark import schema
from kgspark.operators import audit, lookup, mutate, neighbourhood
from kgspark.operators.community import build_communities, keep_memberships


@pytest.fixture(scope="module")
def g(spark):
    def e(i, chunks, clusters):
        return (i, f"name {i}", "KIND", f"about {i}", chunks, ["d1"], clusters)

    entities = spark.createDataFrame(
        [e("A", ["c1", "c2"], [(0, 0)]), e("B", ["c1"], [(0, 0)]), e("C", ["c2"], [(0, 0)]), e("D", ["c3"], [(0, 1)]), e("E", ["c3"], [(0, 1)]), e("F", [], None)], schema.ENTITIES
    )
    rel = lambda i, s, o, w, c: (i, s, o, s, o, "R", f"{s} to {o}", w, c)
    relations = spark.createDataFrame([rel("r1", "A", "B", 1.0, ["c1"]), rel("r2", "B", "C", 3.0, ["c2"]), rel("r3", "A", "B", 2.0, ["c1"]), rel("r4", "D", "E", None, ["c3"]), rel("r5", "A", "G", 1.0, None)], schema.RELATIONS)
    chunks = spark.createDataFrame([(c, c, i, "d1", 1) for i, c in enumerate(["c1", "c2", "c3", "c4"])], schema.CHUNKS)
    return entities, relations, chunks


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_isolation(g):
    e, r = lookup.without_isolated(g[0], g[1])
    assert ids(e) == list("ABCDE") and ids(r) == ["r1", "r2", "r3", "r4"]


def test_degrees(g):
    kept = lookup.with_known_endpoints(g[1], g[0])
    assert {r["id"]: r["edge_degree"] for r in neighbourhood.edge_degrees(kept, kept).collect()} == {"r1": 5, "r2": 4, "r3": 5, "r4": 2}


def test_communities(spark, g):
    m = g[0].selectExpr("id", "explode(clusters) AS c").selectExpr("id", "c.level", "c.cluster_id")
    c = build_communities(m, g[1], least=3)
    row = c.collect()
    assert len(row) == 1 and row[0]["entity_ids"] == ["A", "B", "C"] and row[0]["relation_ids"] == ["r1", "r2", "r3"]
    assert {r["id"] for r in keep_memberships(g[0], c).where("clusters IS NOT NULL").collect()} == set("ABC")


def test_chunk_deletion(spark, g):
    gone = spark.createDataFrame([("c1",)], "id string")
    c, e, r = mutate.delete_chunks(g[2], g[0], g[1], gone)
    assert (ids(c), ids(e), ids(r)) == (["c2", "c3", "c4"], ["C", "D", "E", "F"], ["r4"])
    c, e, r = mutate.delete_chunks(g[2], g[0], g[1], gone, retain_shared=True)
    assert (ids(e), ids(r)) == (["A", "C", "D", "E", "F"], ["r4", "r5"])


def test_seed_chunks_and_relations(spark, g):
    seeds = spark.createDataFrame([("q", "A", 0)], "query_id string, id string, pos int")
    got = neighbourhood.ranked_chunks(seeds, *g).orderBy("rank").collect()
    assert [(r["chunk_id"], r["n_edges"]) for r in got] == [("c1", 2), ("c2", 0)]
    assert [r["relation_id"] for r in neighbourhood.ranked_relations(seeds, g[1]).orderBy("rank").collect()] == ["r3", "r1", "r5"]


def test_specs_and_lookup(spark, g):
    specs = spark.createDataFrame([(0, "A", "B", None), (1, "A", "B", "r3"), (2, "B", "A", None)], "pos int, subject_id string, object_id string, relation_id string")
    assert [r["relation_ids"] for r in neighbourhood.edges_by_spec(specs, g[1]).orderBy("pos").collect()] == [["r1", "r3"], ["r3"], []]
    assert ids(mutate.delete_relations(g[1], specs.where("pos = 0"))) == ["r2", "r4", "r5"]
    asked = spark.createDataFrame([(0, "C"), (1, "X"), (2, "A")], "pos int, id string")
    assert [r["entity_name"] for r in lookup.lookup(asked, g[0]).orderBy("pos").collect()] == ["name C", None, "name A"]


def test_audit(g):
    issues = {tuple(r) for r in audit.check_consistency(*g[:2], g[2], g[0].limit(0).selectExpr("id", "id AS x", "source_chunk_id AS entity_ids", "source_chunk_id AS relation_ids"), {}).collect()}
    assert issues == {("relation_endpoints", "entity", "G"), ("relation_endpoints", "relation", "r5")}
    e, r = lookup.without_isolated(g[0], g[1])
    assert audit.report_text(audit.relation_endpoints(r, e)) == "-"


def test_upserts(spark, g):
    new = g[0].where("id = 'A'").selectExpr("id", "'other' AS entity_name", "entity_type", "'About a. More.' AS description", "array('c9') AS source_chunk_id", "array('d2') AS documents_id", "clusters")
    merged = {r["id"]: r for r in mutate.merge_upsert_entities(g[0], new).collect()}
    assert len(merged) == 6 and merged["A"]["entity_name"] == "name A" and merged["A"]["source_chunk_id"] == ["c1", "c2", "c9"]
    with pytest.raises(ValueError):
        mutate.merge_upsert_entities(g[0], new.union(new))
    with pytest.raises(ValueError):
        mutate.update(g[0], new.selectExpr("'X' AS id", "entity_name", "entity_type", "description", "source_chunk_id", "documents_id", "clusters"))
    assert mutate.upsert(g[0], new).count() == 6


def test_retype(spark, g):
    e, r = mutate.retype_entity(g[0], g[1], spark.createDataFrame([("D", "NEW")], "id string, entity_type string"))
    moved = [x["id"] for x in e.where("entity_type = 'NEW'").collect()]
    assert len(moved) == 1 and moved[0].startswith("ent-") and moved[0] in ids(r, "subject_id")
