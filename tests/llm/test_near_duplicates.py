import random
import re

import numpy as np

from kgspark.llm.near_duplicates import NearDuplicateSpec, _tree_pairs, near_duplicate_groups, near_duplicate_links

SPEC = NearDuplicateSpec(words=3, threshold=0.5)
WORDS = [f"word{i}" for i in range(400)]


def corpus(n=60, copies=4, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = [rng.choice(WORDS) for _ in range(60)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(12)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(" ".join(w))
    return out


def sets(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(texts):
    s = [sets(t) for t in texts]
    return {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if s[i] and s[j] and len(s[i] & s[j]) >= 0.5 * len(s[i] | s[j])}


def frame(spark, texts):
    return spark.createDataFrame([(i, f"t{i}", t, "clash") for i, t in enumerate(texts)], "node long, text_id string, text string, shards string")


def test_links_equal_brute_force(spark):
    texts = list(dict.fromkeys(corpus()))
    links, _ = near_duplicate_links(frame(spark, texts), SPEC)
    assert {(r["a"], r["b"]) for r in links.collect()} == brute(texts)


def test_large_shards_give_the_same(spark):
    texts = list(dict.fromkeys(corpus(n=1, copies=40, seed=5) + corpus(n=4, copies=3, seed=6)))
    links, _ = near_duplicate_links(frame(spark, texts), SPEC, shard_members=7)
    assert {(r["a"], r["b"]) for r in links.collect()} == brute(texts)


def test_tree_equals_all_pairs():
    rng = np.random.default_rng(0)
    p = rng.integers(0, 3, (80, 12), dtype=np.uint8)
    got = {(min(a, b), max(a, b)) for x, y in _tree_pairs(p, np.arange(80), 6) for a, b in zip(x, y)}
    assert got == {(i, j) for i in range(80) for j in range(i + 1, 80) if (p[i] != p[j]).sum() <= 6}


def test_copies_nulls_and_empty(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    base = " ".join(WORDS[:50])
    rows = [(1, "a", base), (2, "a", base), (3, "b", base + " more"), (4, "c", None), (5, "d", ""), (6, "e", "two words"), (7, "f", long), (8, "g", long + " end"), (None, "h", base), (9, "i", "???")]
    df = spark.createDataFrame(rows, "node long, text_id string, text string")
    got = {r["text_id"]: (r["group_id"], r["n_links"]) for r in near_duplicate_groups(df, SPEC).collect()}
    assert got == {"a": (1, 1), "b": (1, 1), "f": (7, 1), "g": (7, 1)}
    assert near_duplicate_groups(df.limit(0), SPEC).count() == 0


def test_equal_texts_are_one_class_compared_once(spark):
    base = " ".join(WORDS[:50])
    rows = [(i, f"t{i}", base) for i in range(300)] + [(300, "u", base + " more"), (301, "v", "a b c d"), (302, "w", "a b c d"), (303, "x", " ".join(WORDS[100:150]))]
    df = spark.createDataFrame(rows, "node long, text_id string, text string")
    links, _ = near_duplicate_links(df, SPEC)
    assert [(r["a"], r["b"]) for r in links.collect()] == [(0, 300)]
    got = {r["text_id"]: (r["group_id"], r["n_links"]) for r in near_duplicate_groups(df, SPEC).collect()}
    assert got == {**{f"t{i}": (0, 300) for i in range(300)}, "u": (0, 300), "v": (301, 1), "w": (301, 1)}


def test_default_is_five_words_and_four_fifths():
    assert (NearDuplicateSpec().words, NearDuplicateSpec().threshold) == (5, 0.8)
