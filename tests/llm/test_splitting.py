import random

import pytest

from kgspark.llm.splitting import split_oversized, split_text


def pieces(text, limit=20, overlap=4):
    return [text[a:b] for a, b in split_text(text, limit, overlap)[0]], split_text(text, limit, overlap)[1]


def test_short_and_empty():
    assert split_text("") == ([], "natural")
    assert pieces("one two three")[0] == ["one two three"]


def test_cuts_at_sentence_ends():
    text = " ".join(f"Word{i} is in sentence number {i} here." for i in range(12))
    got, kind = pieces(text)
    assert kind == "natural" and len(got) > 1
    assert all(p.endswith(".") and len(p.split()) <= 20 for p in got)
    for a, b in zip(got, got[1:]):
        assert a.split()[-4:] == b.split()[:4]


def test_abbreviations_do_not_end_sentences():
    text = "He saw Dr. Miller and " + "many words follow here " * 8
    assert pieces(text)[1] == "forced"


def test_forced_run_is_covered():
    words = [f"w{i}" for i in range(97)]
    got, kind = pieces(" ".join(words))
    assert kind == "forced"
    rebuilt = got[0].split() + [w for p in got[1:] for w in p.split()[4:]]
    assert rebuilt == words


def test_random_texts_keep_every_word():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["a", "Bc ", ". ", "\n", "\n\n", "# Head\n", " ", "- it ", "x " * 30]) for _ in range(150))
        got, _ = split_text(text, 20, 4)
        words = text.split()
        rebuilt = []
        for k, (a, b) in enumerate(got):
            w = text[a:b].split()
            assert len(w) <= 20
            rebuilt += w if k == 0 else w[4:]
        assert rebuilt == words or len(got) <= 1


def test_table(spark):
    long = "One two three four five six. " * 100
    rows = spark.createDataFrame([(1, "c1", long, 9), (2, "c2", None, 9), (3, "c3", "", 9), (4, "c4", "x" * 5000, 9), (5, None, long, 9)], "row_id long, id string, content string, num_tokens int")
    got = split_oversized(rows).collect()
    assert {r["row_id"] for r in got} == {1, 5}
    assert all(r["num_tokens"] == len(r["content"].split()) <= 200 and r["cut_kind"] == "natural" for r in got)
    assert sorted(r["chunk_order_idx"] for r in got if r["row_id"] == 1) == list(range(sum(r["row_id"] == 1 for r in got)))
    assert split_oversized(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_oversized(rows, 10, 10)
