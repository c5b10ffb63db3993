import pytest

from kgspark.llm.canonical import UNMATCHED, Canonical, edits, map_to_list

SHIP = [("SHIP", "SHIP"), ("VESSEL", "SHIP"), ("SHIPYARD", "SHIPYARD"), ("STORM_EVENT", "STORM_EVENT"), ("TIED_UP_AT", "MOORED_AT"), ("ORE", "MINERAL")]


@pytest.mark.parametrize(
    "value,name",
    [
        ("ship", "SHIP"), (" Ship ", "SHIP"), ("a vessel", "SHIP"), ("vessels", "SHIP"), ("VЕSSЕL", "SHIP"), ("ＳＨＩＰ", "SHIP"), ("​ship", "SHIP"),
        ("StormEvent", "STORM_EVENT"), ("STORM EVENT (see note)", "STORM_EVENT"), ("storm evnet", "STORM_EVENT"), ("was tied up at the", "MOORED_AT"), ("tiedup at", "MOORED_AT"),
        ("vessle", "SHIP"), ("shipyrad", "SHIPYARD"), ("shipment", UNMATCHED), ("???", UNMATCHED), ("quux", UNMATCHED), ("x" * 10_000, UNMATCHED),
    ],
)
def test_values(value, name):
    assert Canonical(SHIP).find(value) == name


def test_longest_wins_and_ties_are_unmatched():
    c = Canonical([("RIVER", "A"), ("RIVER DELTA", "B"), ("cart", "C"), ("care", "D")])
    assert c.find("the river delta") == "B"
    assert c.find("carx") == UNMATCHED


def test_edits():
    assert [edits(a, b, 9) for a, b in (("ca", "abc"), ("kitten", "sitting"), ("", "ab"), ("same", "same"))] == [2, 3, 2, 0]
    assert edits("abcdef", "uvwxyz", 2) == 3


def test_rows(spark):
    rows = spark.createDataFrame([(1, "ship", "x"), (2, None, "x"), (3, "   ", "x"), (4, "vesel", "x"), (4, "vesel", "x"), (5, "none", None)], "row_id long, value string, canonical_name string")
    ref = spark.createDataFrame([("SHIP", ["VESSEL", None, ""], 1), ("DOCK", None, 2), (None, ["ship"], 3)], "name string, aliases array<string>, value int")
    got = sorted((r["row_id"], r["canonical_name"]) for r in map_to_list(rows, ref).collect())
    assert got == [(1, "SHIP"), (4, "SHIP"), (4, "SHIP"), (5, UNMATCHED)]
    assert {r["canonical_name"] for r in map_to_list(rows, ref.limit(0)).collect()} == {UNMATCHED}
    assert map_to_list(rows.limit(0), ref).count() == 0


WORDS = [("MERCHANT_HOUSE", "MERCHANT_HOUSE"), ("FUNDED_BY", "FINANCED_BY"), ("RULED_FROM", "RULED_FROM"), ("SETTLEMENT", "SETTLEMENT"), ("STORED_UNDER", "STORED_UNDER"), ("TIED_UP_AT", "MOORED_AT")]


@pytest.mark.parametrize(
    "value,name",
    [
        ("house merchant", "MERCHANT_HOUSE"), ("huose, merchnt", "MERCHANT_HOUSE"), ("by funded", "FINANCED_BY"), ("under stored", "STORED_UNDER"), ("at tied up", "MOORED_AT"), ("tied at", "MOORED_AT"),
        ("about a settlment", "SETTLEMENT"), ("by ruled", UNMATCHED), ("house", UNMATCHED), ("by", UNMATCHED), ("under", UNMATCHED),
    ],
)
def test_word_sets_in_any_order(value, name):
    assert Canonical(WORDS).find(value) == name


def test_equal_overlaps_are_unmatched():
    assert Canonical([("stone bridge", "A"), ("stone bridgs", "B")]).find("bridg stone") == UNMATCHED
