import random

import pytest

from kgspark.llm import name_variants as module
from kgspark.llm.canonical import edits
from kgspark.llm.name_variants import Trie, fold, name_variants


def groups(spark, names):
    df = spark.createDataFrame([(n, "clash") for n in names], "name string, core string")
    out = {}
    for r in name_variants(df).collect():
        out.setdefault(r["entity"], set()).add(r["name"])
    return sorted(map(sorted, out.values()))


def test_trie_finds_all_near_strings():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(3, 8))) for _ in range(150)})
    trie = Trie(words)

    def osa(a, b):
        d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    for w in words[:60]:
        for most in (0, 1, 2):
            assert dict(trie.within(w, most)) == {x: osa(w, x) for x in words if osa(w, x) <= most}
    assert edits("abcd", "acbd", 2) == 1


def test_persons(spark):
    one = ["Leonard Dritraimaivlai", "leonard  dritraimaivlai", "DRITRAIMAIVLAI, LEONARD", "Dritraimaivlai Leonard", "Lenny Dritraimaivlai", "L. Dritraimaivlai", "Dr. Leonard Dritraimaivlai", "Leonard J. Dritraimaivlai", "Leonard Ditraimaivlai", "Leonard Dritraimáivlai", "Леонард Дритраймайвлай", "Dritraimaivlai's"]
    assert groups(spark, one) == [sorted(one)]


def test_relatives_and_ambiguous_initials(spark):
    got = groups(spark, ["Robert Sagenpofli", "Rosa Sagenpofli", "R. Sagenpofli", "Vera Sagenpofli", "V. Sagenpofli"])
    assert got == [["R. Sagenpofli"], ["Robert Sagenpofli"], ["Rosa Sagenpofli"], ["V. Sagenpofli", "Vera Sagenpofli"]]


def test_organisations(spark):
    others = [f"{w} Chart Office" for w in ("Bagreldo", "Cunimestra", "Dolirampe", "Fegunalsi", "Gorampesti", "Hulinestro")]
    one = ["Stekigrusta Chart Office No. 9", "Stekigrusta C. O. No 9", "Chart Office, Stekigrusta #9", "The Stekigrusta Chart Off. Nr. 9", "Stekigrusta Chart Office Ltd № 9"]
    got = groups(spark, [*others, *one, "Stekigrusta Chart Office No. 8"])
    assert sorted(one) in got and ["Stekigrusta Chart Office No. 8"] in got


def test_nulls_blank_and_empty(spark):
    assert groups(spark, [None, "", "   ", "???", "42", "Anna", "x" * 50_000]) == []
    assert groups(spark, []) == []


def test_fold():
    assert fold("Wаrd") == fold("ward") and fold("Ксения") == fold("Xeniia") and fold("É") == "e"


OWN = ("Bagreldo", "Cunimestra", "Dolirampe", "Fegunalsi", "Gorampesti", "Hulinestro", "Kevratoni", "Lopiduska")


def test_legal_forms_are_no_part_of_a_kind_however_frequent(spark):
    forms = ("", " GmbH", " Ltd")
    for owns in (OWN[:2], OWN):  # few and many names with each form
        assert groups(spark, [f"{w} Observatory{f}" for w in owns for f in forms]) == sorted(sorted(f"{w} Observatory{f}" for f in forms) for w in owns)


def test_kinds_do_not_depend_on_the_number_of_names(spark):
    for owns in (OWN[:2], OWN):
        one = ["Stekigrusta Rope Works", "Rope Works, Stekigrusta", "Stekigrusta R. W."]
        assert sorted(one) in groups(spark, [*one, *[f"{w} Rope Works" for w in owns]])


def test_a_family_name_is_no_kind(spark):
    given = ("Helmut", "Brigitte", "Gudrun", "Manfred", "Rainer", "Sigrid")
    families = ("Kowalmerski", "Schulzendorp", "Brenzhaupt", "Dommeldanz", "Fruchtgold", "Gansebein", "Hirtzelback")
    got = groups(spark, [*[f"{g} {f}" for g in given for f in families], "H. Kowalmerski"])
    assert ["H. Kowalmerski", "Helmut Kowalmerski"] in got


def test_names_of_things_are_left_out_by_their_types(spark):
    rows = [(f"{w} Codex", "MANUSCRIPT") for w in OWN] + [(f"{w} Rope Works", "GUILD") for w in OWN] + [(f"{OWN[0]} Codex", None), (f"{OWN[1]} Codex", "gild")]
    df = spark.createDataFrame(rows, "name string, type string")
    assert {r["name"] for r in name_variants(df, ["GUILD"], ["MANUSCRIPT"]).collect()} == {f"{w} Rope Works" for w in OWN}
    assert len({r["name"] for r in name_variants(df.drop("type")).collect()}) == 2 * len(OWN)


def test_given_names_are_learned_whatever_the_number_of_names(spark):
    for n in (6, 18):
        families = [f"{a}{b}" for a in ("Kowal", "Schulz", "Brenz", "Dommig", "Frucht", "Ganse") for b in ("merski", "tadorn", "buholk")][:n]
        names = [f"Wunibald {f}" for f in families] + [f"{families[0]}, Wunibald", f"Wunibld {families[1]}", f"W. {families[2]}"]
        got = groups(spark, names)
        assert sorted([f"Wunibald {families[0]}", f"{families[0]}, Wunibald"]) in got
        assert sorted([f"Wunibald {families[1]}", f"Wunibld {families[1]}"]) in got
        assert sorted([f"Wunibald {families[2]}", f"W. {families[2]}"]) in got


@pytest.mark.parametrize("bound,names", [("MAX_KINDS", [f"{w} {k}" for w in OWN for k in ("Rope Works", "Chart Office")]), ("MAX_GIVEN", [f"{g} Kowalmer{x}{y}" for g in ("Helmut", "Sigrid") for x in "abcd" for y in "efgh"])])
def test_too_many_learned_words_are_refused(spark, monkeypatch, bound, names):
    monkeypatch.setattr(module, bound, 1)
    with pytest.raises(ValueError, match="more than 1 "):
        groups(spark, names)
