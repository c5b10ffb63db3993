"""Staged extraction with failing models, and remote stores on a local client."""

import functools

import pytest

from kgspark.operators import extract
from kgspark.operators.ontology import Ontology
from kgspark.sources.remote import FileStore, Throttle, delete_records, read_records, save_graph, write_records

CHUNKS = "id string, content string"


def chunks(spark, *texts):
    return spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], CHUNKS)


def found(text):
    if "fail" in text:
        raise ValueError("no")
    return [{"entity_name": w, "entity_type": "PERSON" if w.istitle() else "quux", "description": None} for w in text.split()]


def related(text, entities):
    if "lonely" in text:
        raise RuntimeError("none")
    n = [e["entity_name"] for e in entities]
    return [{"source_entity": n[0], "target_entity": n[-1], "relation_type": "KNOWS", "description": text, "relationship_strength": 2}]


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_single_stage_keeps_what_a_failing_check_leaves(spark):
    model = lambda text: {"entities": found(text), "relations": []}

    def check(text, both):
        if "bad" in text:
            raise KeyError("x")
        return {"entities": both["entities"][:1], "relations": []}

    out = extract.single_stage(chunks(spark, "Ann Bob", "Cid bad", "fail", None, ""), model, check)
    assert rows(out.entities, "chunk_id", "entity_name") == [("c0", "Ann"), ("c1", "Cid"), ("c1", "bad")]
    assert rows(out.failures, "chunk_id", "stage") == [("c1", "check"), ("c2", "extract")]
    with pytest.raises(Exception, match="no"):
        extract.single_stage(chunks(spark, "fail"), model, strict=True).entities.collect()


def test_two_stages_with_vocabulary(spark):
    onto = Ontology.from_mapping({"entities": ["PERSON"], "relations": ["KNOWS"]})
    out = extract.two_stage(chunks(spark, "Ann Bob other", "Cid Dan lonely", "fail", "Solo"), found, related, ontology=onto)
    assert rows(out.entities, "chunk_id", "entity_name") == [("c0", "Ann"), ("c0", "Bob"), ("c1", "Cid"), ("c1", "Dan"), ("c3", "Solo")]
    assert rows(out.relations, "chunk_id", "source_entity", "target_entity") == [("c0", "Ann", "Bob")]
    assert rows(out.failures, "chunk_id", "stage") == [("c1", "relations"), ("c2", "entities")]


def test_a_failing_check_of_entities_leaves_none_and_of_relations_all(spark):
    def no(*_):
        raise ValueError("down")

    out = extract.two_stage(chunks(spark, "Ann Bob"), found, related, check_entities=no)
    assert out.entities.count() == 0 and rows(out.failures, "stage") == [("check entities",)]
    out = extract.two_stage(chunks(spark, "Ann Bob"), found, related, check_relations=no)
    assert out.relations.count() == 1 and rows(out.failures, "stage") == [("check relations",)]


def test_four_stages(spark):
    said = lambda text, a, b: "нет связи" if a == "BOB" else f"* {a} and {b}"
    out = extract.four_stage(chunks(spark, "ann bob ann", ""), lambda t: t.split(), lambda t, n: n.upper(), lambda t, n: f"about {n}", said)
    assert rows(out.entities, "entity_name", "entity_type", "description") == [("ANN", "UNKNOWN", "about ANN"), ("BOB", "UNKNOWN", "about BOB")]
    assert rows(out.relations, "source_entity", "target_entity", "description") == [("ANN", "BOB", "ANN and BOB")]


def test_store_round_trip_and_repeats(spark, tmp_path):
    client = functools.partial(FileStore, str(tmp_path))
    df = spark.createDataFrame([(f"n{i}", f"имя {i}", ["a", "b"]) for i in range(300)] + [("n1", "имя 1", ["a", "b"])], "id string, name string, tags array<string>")
    assert write_records(df, "nodes", client, batch=7) == {"written": 301}
    assert write_records(df.limit(10), "nodes", client)["written"] == 10
    back = read_records(spark, "nodes", client, "id string, name string, tags array<string>, extra int")
    assert back.count() == 300 and back.where("id = 'n5'").first().asDict() == {"id": "n5", "name": "имя 5", "tags": ["a", "b"], "extra": None}
    assert delete_records(df.where("id < 'n2'").select("id"), "nodes", client)["deleted"] == 112
    assert back.count() == 188
    assert read_records(spark, "nothing", client, "id string").count() == 0
    assert save_graph({"empty": df.limit(0)}, client) == {"empty": 0}


def test_throttle_keeps_the_rate_and_repeats(spark):
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    throttle = Throttle(2, 2, 0.5, lambda: now[0], sleep)
    assert [throttle.call(lambda x: x, i) for i in range(3)] == [0, 1, 2] and now[0] == 1.0
    left = [2]

    def flaky():
        left[0] -= 1
        if left[0] >= 0:
            raise OSError
        return "ok"

    assert throttle.call(flaky) == "ok" and 0.5 in slept and 1.0 in slept
    with pytest.raises(OSError):
        Throttle(None, 0).call(lambda: (_ for _ in ()).throw(OSError()))
    with pytest.raises(ValueError):
        Throttle(0)
