from datetime import datetime

from kgspark.llm.survivorship import cut_off_values, survivors

T = [datetime(2024, 1, d) for d in range(1, 10)]
SCHEMA = "record_kind string, id string, row_id long, description string, chunks array<string>, trust_level int, updated_at timestamp, n int, grp string, text string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, 7, "clash", "clash") for r in rows], SCHEMA)
    return {(r["record_kind"], r["id"], r["field_name"]): r["row_id"] for r in survivors(df).collect()}


def test_fields_are_chosen_one_by_one(spark):
    got = run(spark, [
        ("entity", "x", 1, "A long text.", ["a"], 2, T[1]),
        ("entity", "x", 2, "Another text.", ["a", "b", "b", None], 3, T[2]),
        ("entity", "x", 3, "tbd", ["a", "b", "c"], 9, T[3]),
        ("entity", "x", 4, "Another te", None, 9, T[4]),
        ("entity", "x", 5, "Another text [cut]", [], 9, T[4]),
        ("relation", "x", 6, "Only once", None, 1, T[1]),
    ])
    assert got == {("entity", "x", "description"): 2, ("entity", "x", "source_chunk_id"): 3}


def test_nothing_usable_ties_and_nulls(spark):
    got = run(spark, [
        ("entity", "e", 1, None, None, None, None), ("entity", "e", 2, " ", [], None, None), ("entity", "e", 3, "(no description)", [None], 1, T[1]),
        ("relation", "t", 9, "same", None, 1, T[1]), ("relation", "t", 4, "same", None, 1, T[1]), ("relation", "t", 5, "other", None, None, T[8]),
        ("relation", None, 7, "x", None, 1, T[1]), ("relation", None, 8, "x", None, 1, T[1]),
    ])
    assert got == {("relation", "t", "description"): 4}


def test_empty(spark):
    assert run(spark, []) == {}


def test_cut_offs_of_all_lengths(spark):
    full = "The quick brown fox jumps over the lazy dog and then goes home to sleep until spring."
    values = [full, full[:3], full[:20], full[:60], full[:60] + "...", "The quiet one", "x" * 50_000, "x" * 49_000 + "…"]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", full[:20])], "grp string, text string")
    got = {(r["grp"], r["text"]) for r in cut_off_values(df).collect()}
    assert got == {("g", v) for v in (full[:3], full[:20], full[:60], full[:60] + "...", "x" * 49_000 + "…")}
