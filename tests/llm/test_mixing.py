import random

from kgspark.llm.mixing import _meet, _settle, mix


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 5) for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string, size int")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_meeting_keeps_expected_size():
    rng = random.Random(0)
    total = [0.0, 0.0]
    for _ in range(20_000):
        a, b = _meet(rng, 0.3, 10, 0.6, 4)
        assert min(abs(a), abs(1 - a), abs(b), abs(1 - b)) < 1e-9 and abs(a * 10 + b * 4 - 5.4) < 1e-9
        total[0] += a / 20_000
        total[1] += b / 20_000
    assert abs(total[0] - 0.3) < 0.02 and abs(total[1] - 0.6) < 0.02


def test_one_open_row_a_bucket():
    done, still = _settle(random.Random(1), [("a", i, i, 5 + i % 3, 0, 0.4) for i in range(50)])
    assert len(still) <= 1 and len(done) + len(still) == 50 and {r[5] for r in done} <= {0.0, 1.0}


def test_plan_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr("kgspark.llm.mixing.BUCKET_ROWS", 16)
    df = docs(spark, [(f"text number {i} {'long ' * (i % 7)}", "ab"[i % 2]) for i in range(300)])
    want = targets(spark, [("a", 0.7, 2), ("b", 0.3, 1)])
    one, other = (sorted(map(tuple, mix(df.repartition(n), want, fan_in=3)[0].collect())) for n in (1, 7))
    assert one == other and sorted(map(tuple, mix(df, want, seed=14, fan_in=3)[0].collect())) != one


def test_shares_and_caps(spark):
    rows = [(f"text number {i} of the big source", "big") for i in range(400)] + [(f"small {i}", "small") for i in range(20)]
    rows += [("small 0", "small"), (None, "big"), ("", "big"), ("é" * 10, None), ("other", "unlisted")]
    plan, report = mix(docs(spark, rows), targets(spark, [("big", 0.9, 2), ("small", 0.1, 3), ("none", 0.0, 1), ("big", 0.9, 2)]), fan_in=4)
    r = {x["source"]: x for x in report.collect()}
    assert set(r) == {"big", "small", "none"}
    assert r["small"]["source_size"] == sum(len(f"small {i}") for i in range(20)) + len("small 0")
    assert r["small"]["cannot_reach"] and not r["big"]["cannot_reach"]
    assert r["small"]["reached_size"] == 3 * (r["small"]["source_size"] - len("small 0"))
    assert abs(r["big"]["reached_size"] - r["big"]["target_size"]) <= 40
    p = plan.collect()
    assert max(x["copies"] for x in p if x["source"] == "small") == 3
    assert sum(x["size"] * x["copies"] for x in p if x["source"] == "big") == r["big"]["reached_size"]
    again = mix(docs(spark, rows), targets(spark, [("big", 0.9, 2), ("small", 0.1, 3)]), fan_in=4)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, p))


def test_empty(spark):
    plan, report = mix(docs(spark, []), targets(spark, [("a", 1.0, 1)]))
    assert plan.count() == 0 and report.first()["reached_size"] == 0
    assert mix(docs(spark, [("x", "a")]), targets(spark, []))[1].count() == 0
