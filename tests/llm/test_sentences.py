import pytest

from kgspark.llm import sentences as module
from kgspark.llm.sentences import sentences, units

CASES = [
    ("Dr. Miller paid 3.5 crowns. He left.", ["Dr. Miller paid 3.5 crowns.", "He left."]),
    ("“Who came?” asked Ann. “We did. All of us.” Then she left!", ["“Who came?” asked Ann.", "“We did. All of us.”", "Then she left!"]),
    ("It (see p. 4. Really.) works. Yes", ["It (see p. 4. Really.) works.", "Yes"]),
    ("Am 24. Mai 1927 kam er z. B. mit Hrn. Maier. Nr. 4. Dann ging er usw. Und Schluss.", ["Am 24. Mai 1927 kam er z. B. mit Hrn. Maier.", "Nr. 4.", "Dann ging er usw.", "Und Schluss."]),
    ("« Qui vient ? » demanda Luc. Il cite p. ex. le no. 5.", ["« Qui vient ? » demanda Luc.", "Il cite p. ex. le no. 5."]),
    ("—¿Viene? —preguntó Luis. ¡Sí! La Sra. Paz llegó.", ["—¿Viene? —preguntó Luis.", "¡Sí!", "La Sra. Paz llegó."]),
    ("Указан журнал за 1767 г. Как писал он, в 1591 г. паром и т. д. стоял.", ["Указан журнал за 1767 г.", "Как писал он, в 1591 г. паром и т. д. стоял."]),
    ("彼は「急げ！ 潮が来る。」と叫んだ。商会（1639年設立。本部は港）は運んだ。その橋は……まだだ！次。", ["彼は「急げ！ 潮が来る。」と叫んだ。", "商会（1639年設立。本部は港）は運んだ。", "その橋は……まだだ！", "次。"]),
    ("“谁卖掉了？”渡芷问道。他写道：“走吧。好。”灯塔高约19.6米。", ["“谁卖掉了？”渡芷问道。", "他写道：“走吧。好。”", "灯塔高约19.6米。"]),
    ("यह बही है। डॉ. शिशि ने कहा। क्या?", ["यह बही है।", "डॉ. शिशि ने कहा।", "क्या?"]),
    ("عاش أ. هان هنا. كتب: «الجسر مغلق. لا أحد.» نقلت الشركة.", ["عاش أ. هان هنا.", "كتب: «الجسر مغلق. لا أحد.»", "نقلت الشركة."]),
    ("ประภาคารสูง 47.4 เมตร ตลาดเงียบ ซ่อมในปี 1493 ก่อนฝน", ["ประภาคารสูง 47.4 เมตร", "ตลาดเงียบ", "ซ่อมในปี 1493 ก่อนฝน"]),
    ("Chapter 3. Alpha\n\nThe gate\nclosed. Fine.\n\n- one 1\n• two 2\n3) three", ["Chapter 3. Alpha", "The gate\nclosed.", "Fine.", "- one 1", "• two 2", "3) three"]),
    ("A (b. 1774, d.\n1621) sold it. B.", ["A (b. 1774, d.\n1621) sold it.", "B."]),
    ("It was sold.The price fell to 3.5.Nobody came.", ["It was sold.", "The price fell to 3.5.", "Nobody came."]),
    ("no terminator at all", ["no terminator at all"]),
    ("", []), (" \n ", []), ("...", ["..."]), ("“unclosed. Next one.", ["“unclosed.", "Next one."]),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_units(text, expected):
    assert [text[a:b] for a, b in units(text)] == expected


def test_cover_everything():
    for text, _ in CASES:
        at = 0
        for a, b in units(text):
            assert not text[at:a].strip() and text[a:b] == text[a:b].strip() and b > a
            at = b
        assert not text[at:].strip()


def test_corpus_shows_abbreviations(spark):
    rows = [(i, f"The Zorn Ltd. sells salt. Entry Nm. {i} is long.", "x") for i in range(8)] + [(90, None, "x"), (91, "", "x"), (92, "word " * 50_000 + "end.", None), (7, "The Zorn Ltd. sells salt. Entry Nm. 7 is long.", "x")]
    got = sentences(spark.createDataFrame(rows, "doc_id long, text string, unit_start string")).collect()
    assert sorted(r["doc_id"] for r in got) == sorted([*range(8), *range(8), 7, 7, 92])
    assert sentences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_too_many_abbreviations_are_refused(spark, monkeypatch):
    monkeypatch.setattr(module, "MAX_ABBREVIATIONS", 1)
    with pytest.raises(ValueError, match="more than 1 abbreviations"):
        module.learn(spark.createDataFrame([("See zeg. in qop. and more, " * 9,)], "text string"))
