import numpy as np

from kgspark.llm.leakage import WORDS, build_indexes, leaked_items, plain, window_minima

ITEM = "When Alpha left Bravo, the keepers of Charlie gave 360 coins to Delta and to Echo before Foxtrot came."
JA = "マコトがシピゾンを離れたとき、ホピベノの番人はゾトカに八百枚の硬貨を渡し、ルベナへ向かった。"


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    e = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return {(r["doc_id"], r["item_id"]): r["n_windows"] for r in leaked_items(d, e).collect()}


def test_whole_partial_and_too_short(spark):
    w = ITEM.replace(",", "").rstrip(".").split()
    docs = [
        (1, f"Before. {ITEM} After."), (2, "x " * 30_000 + " ".join(w[3:13])), (3, " ".join(w[3:12]) + " other"), (4, ITEM.upper()), (5, ITEM.replace("coins", "co-\nins").replace("Delta", "Dél­ta")),
        (6, "\n".join(w)), (7, None), (8, ""), (8, ""), (9, " ".join(w[:9]) + " x " + " ".join(w[10:])),
    ]
    got = run(spark, docs, [(7, ITEM), (8, "too short to count"), (9, None), (None, ITEM)])
    assert set(got) == {(1, 7), (2, 7), (4, 7), (5, 7), (6, 7)}
    assert got[2, 7] == 1 and got[1, 7] == len(w) - 9


def test_japanese_by_characters(spark):
    plain = "".join(c for c in JA if c.isalnum())
    got = run(spark, [(1, "本日。" + "\n".join(plain[:30])), (2, plain[:24] + "別"), (3, plain[5:30])], [(1, JA)])
    assert set(got) == {(1, 1), (3, 1)}


def test_repeats_and_empty(spark):
    assert set(run(spark, [(1, ITEM), (1, ITEM)], [(1, ITEM), (1, ITEM), (2, ITEM)])) == {(1, 1), (1, 2)}
    assert run(spark, [], [(1, ITEM)]) == {} and run(spark, [(1, ITEM)], []) == {}


def test_equal_windows_have_equal_minima():
    ids = np.array([0, 1, 2, 3, 4, 5, 6, 0, 9, 1, 2, 3, 4, 5, 6], np.uint64)
    m = window_minima(ids, 2, 4)
    assert m[1] == m[9] and m[0] == np.iinfo(np.uint64).max and len(window_minima(ids[:3], 2, 4)) == 0


def test_scripts_without_spaces_and_without_kana(spark):
    han = "石桥下的守灯人在冬天把三百枚硬币交给河边的抄写员然后离开了旧城没有人再见过他"
    thai = "ผู้ดูแลประภาคารได้มอบเหรียญสามร้อยเหรียญให้แก่อาลักษณ์ริมแม่น้ำแล้วจากไป"
    got = run(spark, [(1, f"前言。{han[:30]}。"), (2, f"{han[:20]}别的"), (3, f"ก่อน {thai} หลัง"), (4, "plain words only " * 9)], [(1, han), (2, thai)])
    assert set(got) == {(1, 1), (3, 2)}


def test_equals_brute_force_in_every_size_class(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate([10, 11, 19, 20, 39, 45, 80, 200, 900])]
    items.append((99, " ".join(["same"] * 40)))
    docs = []
    for d in range(120):
        _, text = items[int(rng.integers(0, len(items)))]
        w = text.split()
        a, n = int(rng.integers(0, len(w))), int(rng.integers(5, 30))
        docs.append((d, " ".join([*rng.choice(vocabulary, int(rng.integers(0, 300))), *w[a : a + n], *rng.choice(vocabulary, 20)])))

    def windows(t):
        w = plain(t).split()
        return {tuple(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)}

    want = {(d, i): len(windows(t) & windows(u)) for d, t in docs for i, u in items if windows(t) & windows(u)}
    assert run(spark, docs, items) == want and len(want) > 30
    assert len(build_indexes(items)[0].partitions) >= 5


def test_containment_is_the_exact_share_of_shingles(spark):
    w = [f"w{i}" for i in range(24)]
    d = spark.createDataFrame([(1, " ".join(w[4:16] + ["x"] + w[17:22]))], "doc_id long, text string")
    e = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    assert abs(leaked_items(d, e).first()["containment"] - 9 / 20) < 1e-9
