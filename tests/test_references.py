import random
from datetime import datetime, timedelta

from kgspark.operators.references import orphan_references, orphan_report

T0 = datetime(2024, 1, 31)


def at(d):
    return None if d is None else T0 + timedelta(days=d)


def run(spark, parents, refs, **options):
    p = spark.createDataFrame([(*x, "clash") for x in parents], "kind string, key string, ingested_at timestamp, deleted_at timestamp, range_key string")
    r = spark.createDataFrame([(*x, 1) for x in refs], "table_name string, field_name string, kind string, row_id long, ref_id string, ingested_at timestamp, salt int")
    return orphan_references(p, r, **options)


def rows(df):
    return sorted((r["row_id"], r["ref_id"], r["ref_state"], r["month_key"]) for r in df.collect())


def test_states(spark):
    parents = [("e", "ok", at(0), None), ("e", "gone", at(0), at(1)), ("e", "half", at(0), at(1)), ("e", "half", at(1), None), ("e", "late", at(9), None), ("e", "late", at(5), None), ("e", "never", None, None), ("c", "other", at(0), None), ("e", None, at(0), None)]
    refs = [("t", "f", "e", i, k, at(2)) for i, k in enumerate(["ok", "gone", "half", "late", "never", "other", "none", None, "OK", ""])]
    refs += [("t", "f", "e", 20, "late", at(7)), ("t", "f", "e", 21, "late", None), ("t", "f", "e", 22, "none", None), ("t", "f", "e", 6, "none", at(2))]
    assert rows(run(spark, parents, refs)) == sorted([(1, "gone", "deleted", "2024-02"), (3, "late", "late", "2024-02"), (5, "other", "missing", "2024-02"), (6, "none", "missing", "2024-02"), (8, "OK", "missing", "2024-02"), (9, "", "missing", "2024-02"), (22, "none", "missing", None)], key=lambda x: x[:2])


def test_hot_key_over_many_ranges(spark):
    rng = random.Random(1)
    parents = [("e", f"k{i:04d}", at(rng.randrange(5)), None if rng.random() < 0.7 else at(6)) for i in range(300)]
    refs = [("t", "f", "e", i, "k0007" if i % 3 == 0 else f"k{rng.randrange(400):04d}", at(rng.randrange(5))) for i in range(900)]
    alive = {}
    for _, k, t, d in parents:
        alive[k] = (t, d)
    expected = []
    for _, _, _, i, k, t in refs:
        state = "missing" if k not in alive else "deleted" if alive[k][1] else "late" if alive[k][0] > t else None
        if state:
            expected.append((i, k, state, t.strftime("%Y-%m")))
    assert rows(run(spark, parents, refs, rows_per_range=25)) == sorted(expected)


def test_empty_and_report(spark):
    ref = [("t", "f", "e", 1, "x", at(0))]
    assert rows(run(spark, [], ref)) == [(1, "x", "missing", "2024-01")]
    assert rows(run(spark, [("e", "x", at(0), None)], [])) == []
    r = orphan_report(run(spark, [], ref)).first()
    assert (r["n_refs"], r["n_rows"], r["ref_state"]) == (1, 1, "missing")
