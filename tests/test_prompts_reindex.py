import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark import schema
from kgspark.operators import prompts, reindex
from kgspark.operators.ontology import Ontology


def test_prompts(spark):
    df = spark.createDataFrame([("salt",)], "t string")
    assert df.select(prompts.DEFAULT.render("summarise", notes=F.col("t"))).first()[0].endswith("salt")
    with pytest.raises(KeyError):
        prompts.DEFAULT.override(nothing="x")
    assert df.select(prompts.messages(F.lit("be brief"), F.col("t"))).first()[0][1]["content"] == "salt"
    ex = spark.createDataFrame([(1, 2, "b", "B"), (1, 1, "a", "A")], "query_id int, rank int, input_text string, output string")
    assert [m["content"] for m in prompts.few_shot(ex).first()["shots"]] == ["a", "A", "b", "B"]
    assert prompts.few_shot(ex, "plain").first()["shots"] == "a\nA\n\nb\nB"
    assert prompts.few_shot(ex, "numbered").first()["shots"].startswith("Example 1\nInput: a")
    assert prompts.context_text(ex, "Docs", F.col("input_text"), 3).first()["context"] == "# Docs a"
    events = list(prompts.deltas(iter(["ab", "c"]), "q"))
    assert [e["delta"] for e in events] == ["ab", "c", ""] and events[-1]["payload"] == "abc"
    assert len(set(prompts.colours(30))) == 30


def test_density_clusters():
    x = np.array([[0.0], [0.3], [0.6], [5.0], [9.0], [9.1]])
    assert reindex.density_clusters(x).tolist() == [0, 0, 0, -1, 1, 1]
    assert len(reindex.density_clusters(np.zeros((0, 2)))) == 0


def test_cluster_descriptions(spark):
    g = spark.createDataFrame([(1, ["cats purr", "ships sail", "cats purr"]), (2, ["one", None]), (3, [])], "id int, descriptions array<string>")
    got = {r["id"]: r["description"] for r in reindex.cluster_descriptions(g, lambda t: None if "fail" in t else f"{len(t)} notes", above=2).collect()}
    assert got == {1: "2 notes ships sail", 2: "one", 3: ""}


def test_reindex(spark):
    e = spark.createDataFrame([(i, i, "K", "One. Two. Three." if i == "a" else "One.", ["c"], ["d"], None) for i in "abc"], schema.ENTITIES)
    r = spark.createDataFrame([("r", "a", "b", "a", "b", "R", "a to b", 1.0, ["c"])], schema.RELATIONS)
    new = {x["id"]: x["description"] for x in reindex.reindex_descriptions(e, 2, lambda s: s.map(lambda t: f"{len(t)} facts")).collect()}
    assert new == {"a": "3 facts", "b": "One.", "c": "One."}
    renewed, groups, summaries = reindex.reindex_communities(e, r, lambda s: s.map(lambda t: f"{len(t)} texts"))
    assert groups.count() == 1 and groups.first()["entity_ids"] == ["a", "b"] and summaries.first()["summary"] == "3 texts"
    assert {x["id"] for x in renewed.where("clusters IS NOT NULL").collect()} == {"a", "b"}


def test_allowed_relations():
    o = Ontology.from_mapping({"entities": ["A", "B"], "relations": [{"name": "R", "domain": ["A"], "range": ["B"]}, "S"]})
    assert o.allowed_relations(["A", "B"]) == {"R": [("A", "B")], "S": []} and o.allowed_relations(["A"]) == {"S": []}
    assert "R (A -> B)" in o.describe() and "R" not in o.describe(["A"]).split("\n")[-1]
