import pytest

from kgspark.operators.ontology import Ontology, Policies, key_of, validate_entities, validate_relations

SPEC = {
    "entities": ["THING", {"name": "PLACE", "aliases": ["SPOT"]}, {"name": "CITY", "parent": "PLACE"}, "PERSON", "FIRM"],
    "relations": [
        {"name": "LIVES_IN", "domain": ["PERSON"], "range": ["PLACE"], "inverse_aliases": ["HOME_OF"], "retype_when": [{"to": "SEATED_IN", "subject": "FIRM"}]},
        {"name": "SEATED_IN", "domain": ["FIRM"], "range": ["PLACE"]},
        {"name": "KNOWS", "domain": ["PERSON"], "range": ["PERSON"], "symmetric": True},
        "NEAR",
    ],
}


@pytest.fixture(scope="module")
def onto():
    return Ontology.from_mapping(SPEC)


def test_keys_and_hierarchy(onto):
    assert key_of("storm-event  type (maybe)") == "STORM_EVENT_TYPE"
    assert onto.ancestors("CITY") == ["PLACE"] and onto.is_a("CITY", "PLACE") and not onto.is_a("PLACE", "CITY")
    assert onto.allows("LIVES_IN", "PERSON", "CITY") and not onto.allows("LIVES_IN", "FIRM", "CITY")
    assert onto.retype("LIVES_IN", "FIRM", "CITY") == ("SEATED_IN", False)
    assert Ontology.from_mapping(onto.to_mapping()) == onto


@pytest.mark.parametrize(
    "spec,words",
    [
        ({"entities": [{"name": "A", "parent": "B"}]}, "unknown type B"),
        ({"entities": [{"name": "A", "parent": "B"}, {"name": "B", "parent": "A"}]}, "own ancestor"),
        ({"entities": ["A", {"name": "B", "aliases": ["a"]}]}, "stands for both"),
        ({"relations": [{"name": "R", "symmetric": True, "inverse_of": "S"}, "S"]}, "symmetric"),
        ({"entities": [{"name": "A", "colour": 1}]}, "unknown fields"),
        ({"entitles": []}, "unknown fields"),
    ],
)
def test_bad_specs(spec, words):
    with pytest.raises(ValueError, match=words):
        Ontology.from_mapping(spec)


def test_extends(tmp_path):
    (tmp_path / "base.yaml").write_text("entities: [A, B]\n")
    (tmp_path / "own.yaml").write_text("extends: base.yaml\nexclude: [B]\nentities: [C]\n")
    assert set(Ontology.load(str(tmp_path / "own.yaml")).entities) == {"A", "C"}
    (tmp_path / "base.yaml").write_text("extends: own.yaml\n")
    with pytest.raises(ValueError, match="extends itself"):
        Ontology.load(str(tmp_path / "own.yaml"))


def test_entities(spark, onto):
    m = spark.createDataFrame([("c", "x", k) for k in ("city", "Spot (?)", "PERSOM", "quux", None)], "chunk_id string, entity_name string, entity_type string")
    got = {r["entity_type"]: (r["resolved_type"], r["action"]) for r in validate_entities(m, onto, Policies(cutoff=0.8)).collect()}
    assert got == {"city": ("CITY", None), "Spot (?)": ("PLACE", None), "PERSOM": ("PERSON", "coerced"), "quux": (None, "dropped"), None: (None, "dropped")}
    kept = {r["entity_type"]: r["resolved_type"] for r in validate_entities(m, onto, Policies.permissive()).collect()}
    assert kept["quux"] == "quux"
    with pytest.raises(ValueError):
        validate_entities(m, onto, Policies.failing())


def test_relations(spark, onto):
    e = spark.createDataFrame([("c", n, t) for n, t in (("ann", "PERSON"), ("bob", "PERSON"), ("rome", "CITY"), ("acme", "FIRM"), ("blob", "ODD"))], "chunk_id string, entity_name string, resolved_type string")
    rows = [("ann", "rome", "LIVES_IN"), ("rome", "ann", "home of"), ("acme", "rome", "LIVES_IN"), ("rome", "ann", "LIVES_IN"), ("ann", "bob", "LIVES_IN"), ("ann", "ann", "KNOWS"), ("ann", "zed", "KNOWS"), ("ann", "bob", "LOVES"), ("ann", "blob", "KNOWS"), ("rome", "acme", "NEAR")]
    r = spark.createDataFrame([("c", *x) for x in rows], "chunk_id string, source_entity string, target_entity string, relation_type string")
    got = {(x["source_entity"], x["target_entity"], x["relation_type"]): (x["resolved_relation"], x["subject"], x["violation"], x["action"]) for x in validate_relations(r, e, onto).collect()}
    assert got[rows[0]] == ("LIVES_IN", "ann", None, None)
    assert got[rows[1]] == ("LIVES_IN", "ann", None, None)
    assert got[rows[2]] == ("SEATED_IN", "acme", "constraint", "coerced")
    assert got[rows[3]] == ("LIVES_IN", "ann", "constraint", "coerced")
    assert got[rows[4]][2:] == ("constraint", "dropped")
    assert got[rows[5]][2:] == ("self_loop", "dropped") and got[rows[6]][2:] == ("dangling_endpoint", "dropped")
    assert got[rows[7]][2:] == ("unknown_relation_type", "dropped")
    assert got[rows[8]][2:] == (None, None) and got[rows[9]][2:] == (None, None)
