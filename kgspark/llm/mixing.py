"""Mixing sources to target shares of a total size, with capped repeats.

A source that needs c copies of each text on average gives every text floor(c)
copies and the fraction of one more as a probability. Pivotal rounding settles
the fractions: two texts meet, probability times size moves from one to the other
until one is 0 or 1, and the other meets the next. So the source's size stays at
its target up to one text. Texts fall into buckets by their hash, whatever file they come
from; every bucket runs this over its own rows with a random stream of its own and leaves
at most one open text; those meet in a tree of fixed fan-in.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.storage import cut

FAN_IN = 512
_EPS = 1e-9
BUCKET_ROWS = 20_000
_KEY = ("text_key", "text_check")  # 128 bits of hash that stand for a text
_DECIDED = "source string, text_key bigint, text_check bigint, size bigint, base int, p double, open boolean"


def _meet(rng: random.Random, a: float, size_a: int, b: float, size_b: int) -> tuple[float, float]:
    """Move expected size between two fractions until one of them is 0 or 1."""
    up = min((1 - a) * size_a, b * size_b)  # to a
    down = min(a * size_a, (1 - b) * size_b)  # to b
    move = up if rng.random() * (up + down) < down else -down
    return a + move / size_a, b - move / size_b


def _settle(rng: random.Random, rows: Iterable[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Meets rows of a source one after the other; those that are decided, p being 0 or 1, and at most one that is open."""
    done: list[tuple] = []
    held: tuple | None = None
    for *key, size, base, p in rows:
        if size <= 0 or p <= _EPS or p >= 1 - _EPS:
            done.append((*key, size, base, float(round(p)) if size > 0 else 0.0))
            continue
        if held is None:
            held = (*key, size, base, p)
            continue
        *key0, size0, base0, p0 = held
        held = None
        p0, p = _meet(rng, p0, size0, p, size)
        for row, x in (((*key0, size0, base0), p0), ((*key, size, base), p)):
            if x <= _EPS or x >= 1 - _EPS:
                done.append((*row, float(round(x))))
            else:
                held = (*row, x)
    return done, [held] if held else []


def _table(done: list[tuple], still: list[tuple]) -> pa.Table:
    rows = [(*r, False) for r in done] + [(*r, True) for r in still]
    cols = list(zip(*rows)) or [[]] * 7
    names = ("source", *_KEY, "size", "base", "p", "open")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds)})


def _rows(t: pa.Table) -> list[tuple]:
    return sorted(zip(*(t.column(c).to_pylist() for c in ("source", *_KEY, "size", "base", "p"))))


def mix(documents: DataFrame, targets: DataFrame, seed: int = 13, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """Choose how often each text is used; report the shares reached.

    ``documents(doc_id, text, source)``; ``targets(source, target_share,
    max_repeats)``, one row a source. Size of a text: tokens of the byte-level
    tokenizer, one a UTF-8 byte. T is the size of all documents of the target
    sources, exact copies included. A text with exact copies in its source is used
    at most max_repeats times in all; its smallest doc_id stands for it.

    Returns ``(plan, report)``. ``plan(source, doc_id, size, copies)``: one row for
    each text used. ``report(source, target_share, max_repeats, source_size,
    target_size, capacity, cannot_reach, reached_size, actual_share)``: one row a
    target source; ``cannot_reach`` if target_size > max_repeats * source_size.

    Documents of null or unlisted sources, and null or empty texts, are not used; a
    listed source without documents has size 0. Repeated target rows count once.
    Expected reached_size is the target or the cap of its different texts, and the
    realised one differs by less than one text. Same seed and texts, same plan, however
    the documents lie in files and partitions.
    """
    t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    texts = (
        documents.where(F.col("source").isNotNull() & (F.octet_length("text") > 0))
        .groupBy("source", F.xxhash64("text").alias("text_key"), F.xxhash64(F.lit(1), "text").alias("text_check"), F.octet_length("text").cast("bigint").alias("size"))
        .agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("held"))
        .join(F.broadcast(t.select("source")) if _few(t) else t.select("source"), "source")
    )
    texts = cut(texts)
    sizes = texts.groupBy("source").agg(F.sum(F.col("size") * F.col("held")).alias("source_size"), F.sum("size").alias("text_size"))
    sources = t.join(sizes, "source", "left").na.fill(0, ["source_size", "text_size"])
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"))
    sources = sources.crossJoin(total).withColumn("target_size", F.col("target_share") * F.col("total"))  # one row
    want = sources.where("text_size > 0").select(
        "source", F.least(F.col("target_size") / F.col("text_size"), F.col("max_repeats").cast("double")).alias("uses")
    )
    units = texts.join(want, "source").select(
        "source", *_KEY, "size", F.floor("uses").cast("int").alias("base"), (F.col("uses") - F.floor("uses")).alias("p")
    )

    def settle(key, table):
        return _table(*_settle(random.Random("|".join(str(k.as_py()) for k in (*key, pa.scalar(seed)))), _rows(table)))

    step, decided, level, size = units.withColumn("open", F.lit(True)), None, 0, BUCKET_ROWS
    while True:
        left = step.where("open")
        most = left.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if level and most <= 1:
            last = left.withColumn("p", (F.pmod(F.xxhash64(*_KEY, F.lit(seed)), F.lit(1 << 20)) / (1 << 20) < F.col("p")).cast("double"))
            decided = decided.unionByName(last)
            break
        bucket = F.pmod(F.xxhash64(*_KEY, F.lit(level)), F.lit(max(1, -(-most // size))))
        step = cut(left.groupBy("source", bucket.alias("bucket"), F.lit(level).alias("level")).applyInArrow(settle, _DECIDED))
        closed = step.where("NOT open")
        decided = closed if decided is None else decided.unionByName(closed)
        level, size = level + 1, fan_in
    copies = (F.col("base") + F.col("p")).cast("int")
    plan = decided.withColumn("copies", copies).where("copies > 0").join(texts.select("source", *_KEY, "doc_id"), ["source", *_KEY])
    plan = plan.select("source", "doc_id", "size", "copies")
    reached = decided.groupBy("source").agg(F.sum(F.col("size") * copies).alias("reached_size"))
    all_reached = reached.agg(F.sum("reached_size").alias("all_reached"))
    report = (
        sources.join(reached, "source", "left").crossJoin(all_reached)  # one row
        .select(
            "source", "target_share", "max_repeats", "source_size", "target_size",
            (F.col("max_repeats") * F.col("source_size")).alias("capacity"),
            (F.col("target_size") > F.col("max_repeats") * F.col("source_size")).alias("cannot_reach"),
            F.coalesce("reached_size", F.lit(0)).alias("reached_size"),
            (F.coalesce("reached_size", F.lit(0)) / F.col("all_reached")).alias("actual_share"),
        )
    )
    return plan, report


def _few(t: DataFrame, most: int = 100_000) -> bool:
    return t.limit(most + 1).count() <= most
