import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from kgspark.llm.neighbours import _block_join, nearest


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "clash") for i, v in rows], "id string, vector array<float>, class_id string")


def brute(ids, x, k):
    x = np.asarray(x, np.float32).astype(float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {i: [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-round(s[n, j], 9), ids[j]))[:k]] for n, i in enumerate(ids) if True}


def test_equals_brute_force_over_several_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 16))
    x[300:400] = x[0] + 0.05 * rng.normal(size=(100, 16))
    ids = [f"p{i:03d}" for i in range(700)]
    got = nearest(frame(spark, list(zip(ids, x))), k=4, dim=16, block_rows=150).collect()
    lists = {}
    for r in sorted(got, key=lambda r: r["place"]):
        lists.setdefault(r["id"], []).append(r["neighbour"])
    assert lists == brute(ids, x, 4)


def test_threshold_only_drops(spark):
    rng = np.random.default_rng(3)
    rows = [(f"p{i:03d}", v) for i, v in enumerate(rng.normal(size=(200, 8)))]
    free = {(r["id"], r["neighbour"]) for r in nearest(frame(spark, rows), 3, dim=8).collect() if r["similarity"] >= 0.6}
    assert free == {(r["id"], r["neighbour"]) for r in nearest(frame(spark, rows), 3, 0.6, dim=8).collect()}


def test_unusable_copies_and_ties(spark):
    rows = [("a", [1, 0]), ("b", [1, 0]), ("c", [1, 0]), ("d", [0, 1]), ("d", [0, 1]), ("n", None), ("z", [0, 0]), ("x", [float("nan"), 1]), ("l", [1, 2, 3]), (None, [1, 1]), ("u", [None, 1])]
    got = {}
    for r in nearest(frame(spark, rows), 2, dim=2).collect():
        got.setdefault(r["id"], {})[r["place"]] = r["neighbour"]
    assert got == {"a": {1: "b", 2: "c"}, "b": {1: "a", 2: "c"}, "c": {1: "a", 2: "b"}, "d": {1: "a", 2: "b"}}


def test_empty_and_single(spark):
    assert nearest(frame(spark, []), 3, dim=2).count() == 0
    assert nearest(frame(spark, [("a", [1, 2])]), 3, dim=2).count() == 0


def test_a_block_joins_itself_whatever_the_order_of_rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)).astype(np.float32)

    def table(rows, key):
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * len(rows) + 1, 8, dtype=np.int32)), pa.array(x[rows].ravel()))
        return pa.table({key: pa.array(np.zeros(len(rows), np.int64)), "class_id": pa.array(rows.astype(np.int64)), "vector": vectors})

    shuffled = rng.permutation(len(x))
    got = _block_join(8, 5, -np.inf, 1)((pa.scalar(0),), table(shuffled, "pair"), table(shuffled[:0], "other_pair")).to_pandas()
    assert len(got) == 5 * len(x) and not (got["class_id"] == got["partner"]).any()
    want = brute(list(range(len(x))), x, 5)
    assert {i: set(g) for i, g in got.groupby("class_id")["partner"]} == {i: set(w) for i, w in want.items()}


@pytest.mark.parametrize("seed", [5, 6])
def test_sixty_thousand_vectors_of_mixed_length(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    n, dim = 60_000, 16
    centres = rng.normal(size=(4_000, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.12 * rng.normal(size=(n, dim))
    x[:6_000] = centres[0] + 0.3 * rng.normal(size=(6_000, dim))  # one dense group
    x = x[rng.permutation(n)]
    x[rng.integers(0, n, 2_000)] = x[7]  # one vector many times
    x = (x * rng.uniform(0.01, 50, size=(n, 1))).astype(np.float32)
    names = [f"p{i:05d}" for i in range(n)]
    pq.write_table(pa.table({"id": names, "vector": pa.array(list(x), pa.list_(pa.float32()))}), f"{tmp_path}/points.parquet")
    rows = nearest(spark.read.parquet(f"{tmp_path}/points.parquet"), 5, 0.85, dim=dim).toPandas()
    got = np.full((n, 5), -1.0)
    got[rows["id"].str[1:].astype(int), rows["place"] - 1] = rows["similarity"]
    u = x / np.linalg.norm(x.astype(float), axis=1)[:, None]
    for at in range(0, n, 2_000):
        s = u[at : at + 2_000] @ u.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -1
        best = -np.sort(-np.partition(s, n - 5, axis=1)[:, n - 5 :], axis=1)
        best[best < 0.85] = -1
        assert np.abs(best - got[at : at + 2_000]).max() < 1e-6
