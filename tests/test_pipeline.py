import json

import pytest
from pyspark.sql import functions as F

from kgspark.operators import audit, chunking, community, engines, models, ranking
from kgspark.operators.build import build
from kgspark.operators.chunking import hashed_embedding
from kgspark.operators.components import connected_components
from kgspark.operators.ontology import Ontology, Policies
from kgspark.sources import files, graph_files, store

DOCS = ["Ann knows Bob. Bob knows Cid.", "Cid knows Ann. Dan sleeps.", "Ann knows Bob. Bob knows Cid."]


def people(content):
    names = [w.strip(".") for w in content.split() if w.strip(".").istitle()]
    return [{"entity_name": n, "entity_type": "PERSON (x)", "description": f"{n} is here."} for n in dict.fromkeys(names)]


def split_extractor(content):
    entities, relations = people(content), []
    for s in content.split("."):
        w = s.split()
        if len(w) == 3 and w[1] == "knows":
            relations.append({"source_entity": w[0], "target_entity": w[2], "relation_type": "KNOWS", "description": s.strip(), "relationship_strength": 3})
    return entities, relations


def test_build_is_consistent_and_idempotent(spark):
    docs = spark.createDataFrame([(d,) for d in DOCS], "text string")
    g = build(docs, split_extractor)
    assert sorted(r["entity_name"] for r in g.entities.collect()) == ["Ann", "Bob", "Cid"]
    assert g.relations.count() == 3 and g.chunks.count() == 2
    assert audit.check_consistency(g.entities, g.relations, g.chunks, g.communities, {}).count() == 0
    again = build(docs, split_extractor, stored=g)
    assert again.chunks.count() == 2
    assert {tuple(r) for r in again.relations.select("id", "relation_strength").collect()} == {tuple(r) for r in g.relations.select("id", "relation_strength").collect()}
    with pytest.raises(TypeError):
        build(docs, split_extractor, modules=[lambda e, r: e])


def test_build_validates_summarises_and_embeds(spark):
    def extractor(text):
        e = [{"entity_name": n, "entity_type": t, "description": n} for n, t in (("Ann", "person"), ("Rome", "CITTY"), ("Blob", "quux"))]
        r = [{"source_entity": a, "target_entity": b, "relation_type": k, "description": "d", "relationship_strength": 1} for a, b, k in (("Rome ", "Ann", "home of"), ("Ann", "Ann", "LIVES_IN"), ("Ann", "Blob", "LIVES_IN"), ("Ann", "Rome", "quux"))]
        return e, r

    onto = Ontology.from_mapping({"entities": ["PERSON", "CITTA"], "relations": [{"name": "LIVES_IN", "domain": ["PERSON"], "range": ["CITTA"], "inverse_aliases": ["HOME_OF"]}]})
    docs = spark.createDataFrame([("some text",)], "text string")
    g = build(docs, extractor, ontology=onto, policies=Policies(cutoff=0.7), reporter=lambda lists: lists.map(lambda t: "; ".join(t)), embedder=hashed_embedding)
    assert sorted((r["entity_name"], r["entity_type"]) for r in g.entities.collect()) == [("Ann", "PERSON"), ("Rome", "CITTA")]
    assert [(r["subject_name"], r["relation_type"], r["object_name"]) for r in g.relations.collect()] == [("Ann", "LIVES_IN", "Rome")]
    assert {r["id"] for r in g.summaries.collect()} == {r["id"] for r in g.communities.collect()} != set()
    for vectors, rows in ((g.chunk_vectors, g.chunks), (g.entity_vectors, g.entities), (g.relation_vectors, g.relations)):
        assert {r["id"] for r in vectors.where("embedding IS NOT NULL").collect()} == {r["id"] for r in rows.collect()} != set()


def python_pack(sentences, size, overlap):
    out, cur = [], ""
    for s in sentences:
        if cur and len(cur) + len(s) > size:
            out.append(cur.strip())
            cur = (out[-1][-overlap:] + " ") if overlap else ""  # of the stripped chunk
        cur += s + " "
    out.append(cur.strip())
    return [c for c in out if c]


@pytest.mark.parametrize("size,overlap", [(30, 0), (30, 6), (5, 0), (1000, 10)])
def test_packing(spark, size, overlap):
    sentences = [f"Sentence number {i} ends." for i in range(9)] + ["x" * 50, "end."]
    got = spark.createDataFrame([(sentences,)], "s array<string>").select(chunking.pack(F.col("s"), size, overlap)).first()[0]
    assert got == python_pack(sentences, size, overlap)


def test_semantic_split():
    s = ["cats purr", "cats sleep", "ships sail", "ships sink"]
    parts = chunking.semantic_split(s, 4, chunking.hashed_embedding)
    assert parts == ["cats purr cats sleep", "ships sail ships sink"]
    assert chunking.semantic_split([], 4, chunking.hashed_embedding) == []


def test_dense_top_k_and_fusion(spark):
    p = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [2.0, 0.1]), ("d", None), ("e", [1.0])], "id string, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<float>")
    ids = lambda df: [r["id"] for r in df.orderBy("rank").collect()]
    assert ids(ranking.dense_top_k(q, p, 2, 2)) == ["a", "c"] and ids(ranking.dense_top_k(q, p, 2, 2, "dot")) == ["c", "a"]
    assert ids(ranking.dense_top_k(q, p, 9, 2, least=0.2)) == ["a", "c"]
    with pytest.raises(ValueError):
        ranking.top_k(p, 0)
    lists = [spark.createDataFrame([(1, i, n) for n, i in enumerate(x, 1)], "query_id int, id string, rank int") for x in ("ab", "bc")]
    assert ids(ranking.fuse(lists, 3)) == ["b", "a", "c"]


def test_plans(spark):
    sub = spark.createDataFrame([("p", "1", "q1", []), ("p", "2", "q2", ["1"]), ("p", "3", "q3", ["1", "2"]), ("o", "1", "x", [])], "plan_id string, id string, query string, depends_on array<string>")
    rewrite = lambda q: q.withColumn("query", F.concat("query", F.lit("<"), F.array_join(F.transform("context", lambda c: c["answer"]), "+"), F.lit(">")))
    got = {(r["plan_id"], r["id"]): (r["level"], r["answer"], r["is_sink"]) for r in engines.run_plans(sub, lambda q: q.select("plan_id", "id", F.upper("query").alias("answer")), rewrite).collect()}
    assert got == {("p", "1"): (0, "Q1", False), ("p", "2"): (1, "Q2<Q1>", False), ("p", "3"): (2, "Q3<Q1+Q2<Q1>>", True), ("o", "1"): (0, "X", True)}
    loop = spark.createDataFrame([("p", "1", "q", ["2"]), ("p", "2", "q", ["1"])], sub.schema)
    with pytest.raises(ValueError, match="cycle"):
        ranking.topological_levels(loop)
    with pytest.raises(ValueError, match="does not have"):
        ranking.topological_levels(spark.createDataFrame([("p", "1", "q", ["9"])], sub.schema))


def test_model_calls(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c"), (4, "a")], "id int, prompt string").coalesce(1)

    def call(values):
        if "bad" in values:
            raise ValueError("no")
        return [v.upper() for v in values]

    got = {r["id"]: (r["response"], r["error"]) for r in models.batch_call(rows, "prompt", call).collect()}
    assert got == {1: ("A", None), 2: (None, "ValueError: no"), 3: ("C", None), 4: ("A", None)}
    cache = spark.createDataFrame([], "key string, response string")
    _, cache = models.cached_call(rows, "prompt", call, cache)
    out, grown = models.cached_call(rows.where("id <> 2"), "prompt", lambda v: 1 / 0, cache)
    assert {r["response"] for r in out.collect()} == {"A", "C"} and grown.count() == 2


def test_communities(spark):
    def clique(names):
        return [(f"{a}{b}", a, b, 1.0) for i, a in enumerate(names) for b in names[i + 1 :]]

    rel = spark.createDataFrame(clique("abcd") + clique("efgh") + [("x", "a", "e", 1.0), ("y", "p", "q", 1.0), ("z", "s", "s", 1.0)], "id string, subject_id string, object_id string, relation_strength double")
    for options in ({}, {"component_edges": 5}):
        got = {}
        for r in community.detect_communities(rel, **options).where("level = 0").collect():
            got.setdefault(r["cluster_id"], set()).add(r["id"])
        assert sorted(map(sorted, got.values())) == [list("abcd"), list("efgh"), ["p", "q"]] and sorted(got) == [0, 1, 2]


def test_cut_components_keep_every_node(spark):
    star = [("m", x) for x in "abcxyz"]
    sides = [(f"s{i}", f"t{j}") for i in range(3) for j in range(3)]
    path = [(f"v{i}", f"v{i + 1}") for i in range(8)]
    for edges in (star, sides, path, star + sides + path + [("a", "s0"), ("z", "v4")]):
        rel = spark.createDataFrame([(f"{a}-{b}", a, b, 1.0) for a, b in edges], "id string, subject_id string, object_id string, relation_strength double")
        got = [r for r in community.detect_communities(rel, component_edges=2).where("level = 0").collect()]
        assert sorted(r["id"] for r in got) == sorted({n for e in edges for n in e})
        shared = {r["id"]: r["cluster_id"] for r in got}
        assert all(any(shared[a] == shared[b] for a, b in edges if n in (a, b)) for n in shared)
        if edges is star:
            assert len(set(shared.values())) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  the cat and the dog  ")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\xfa bad")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.json").write_text(json.dumps({"texts": ["der Hund und die Maus", " "]}))
    (tmp_path / "d.json").write_text(json.dumps(["qq zz"]))
    assert files.read_texts(spark, str(tmp_path), [".TXT"]).count() == 1
    assert sorted((r["text"], r["lang"]) for r in files.load_inputs(spark, str(tmp_path)).collect()) == [("der Hund und die Maus", "de"), ("qq zz", "und"), ("the cat and the dog", "en")]
    assert files.load_inputs(spark, str(tmp_path), ["en"]).count() == 1
    s = files.Settings(top_k=7)
    s.save(str(tmp_path / "s.json"))
    assert files.Settings.load(str(tmp_path / "s.json")) == s
    (tmp_path / "s.json").write_text('{"top_k": "7"}')
    with pytest.raises(ValueError):
        files.Settings.load(str(tmp_path / "s.json"))


def test_stores(spark, tmp_path):
    nodes = spark.createDataFrame([("a",), ('b "x"',)], "id string")
    edges = spark.createDataFrame([("e1", "a", 'b "x"'), ("e2", "a", 'b "x"')], "id string, subject_id string, object_id string")
    graph_files.write_gml(nodes, edges, str(tmp_path / "g.gml"))
    n, e = graph_files.read_gml(spark, str(tmp_path / "g.gml"))
    assert sorted(r["id"] for r in n.collect()) == ["a", 'b "x"'] and sorted((r["id"], r["subject_id"], r["object_id"]) for r in e.collect()) == [("e1", "a", 'b "x"'), ("e2", "a", 'b "x"')]
    v = spark.createDataFrame([("p", [1.0, 2.0]), ("q", [3.0, 4.0])], "id string, vector array<float>")
    graph_files.write_vectors(v, str(tmp_path / "v.json"), 2)
    assert sorted(map(tuple, graph_files.read_vectors(spark, str(tmp_path / "v.json"), 2, "cosine").selectExpr("id", "vector[1]").collect())) == [("p", 2.0), ("q", 4.0)]
    with pytest.raises(ValueError):
        graph_files.read_vectors(spark, str(tmp_path / "v.json"), 3)
    (tmp_path / "kv.json").write_text('{"k": {"content": "c"}}')
    assert graph_files.read_kv(spark, str(tmp_path / "kv.json"), "content: string").first()["content"] == "c"
    with store.TableStore(spark, str(tmp_path / "store")) as s:
        assert s.write(nodes=nodes, edges=edges) == 1 and s.write(nodes=nodes.limit(1)) == 2
        assert s.read("nodes").count() == 1 and s.read("edges").count() == 2 and s.tables() == ["edges", "nodes"]
        store.register(s)
        assert store.run_sql(spark, "SELECT count(*) AS n FROM edges WHERE id = :x", x="e1").first()["n"] == 1
        with pytest.raises(KeyError):
            s.read("none")


def test_batches(spark):
    rows = spark.createDataFrame([(i, "x" * (5 if i else 500)) for i in range(6)], "i int, t string").coalesce(1)
    got = {r["i"]: r["batch_id"] for r in store.size_batches(rows, 60).collect()}
    assert len({got[i] for i in got}) >= 3 and list(got.values()).count(got[0]) == 1
    fixed = store.fixed_batches(spark.range(10).withColumnRenamed("id", "k"), "k", 4)
    assert sorted((r["k"], r["batch_id"]) for r in fixed.collect()) == [(k, k // 4) for k in range(10)]
