"""The k most similar vectors of every vector, by a block matrix join.

Vectors are scaled to length 1, cut into blocks, and every pair of blocks is one
task. Inside it, vectors are rounded to 8-bit integers; integer products of tiles,
exact in float arithmetic, give each similarity up to a proven rounding error.
Only pairs that can still be among a vector's k best within that error are
computed again from the floats and kept in the vector's list of k best. Lists of
different block pairs are merged by one grouped ranking.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.storage import cut, tasks_for_cpu

BLOCK_BYTES = 32 << 20
"""Most bytes of floats in a block; a task holds two blocks."""
MOST_TASKS = 20_000
"""Most tasks of the join; beyond it a task works through several pairs of blocks, one after the other."""
_TILE = 1_024
_COLUMNS = 8_192


class _Block:
    """Unit vectors of a block and their 8-bit codes."""

    def __init__(self, t: pa.Table, dim: int) -> None:
        self.ids = t["class_id"].to_numpy()
        v = np.asarray(t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, dim)
        norm = np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64))
        self.unit = v / norm[:, None]  # float64
        self.scale = np.abs(self.unit).max(axis=1) / 127 if len(v) else np.zeros(0)
        codes = np.rint(self.unit / self.scale[:, None])  # -127 to 127
        rounded = codes * self.scale[:, None]
        self.off = np.sqrt(((self.unit - rounded) ** 2).sum(axis=1))  # |x - x'|
        self.size = np.sqrt((rounded**2).sum(axis=1))
        # Whole numbers up to 127 * 127 * dim are exact in float32 while dim <= 1040, in float64 always.
        self.codes = codes.astype(np.float32 if dim * 127 * 127 < 1 << 24 else np.float64)

    def __len__(self) -> int:
        return len(self.ids)


class _Best:
    """Lists of the k best partners of each row of a block."""

    def __init__(self, rows: int, k: int, least: float) -> None:
        self.k = k
        self.score = np.full((rows, k), -np.inf)
        self.partner = np.full((rows, k), np.iinfo(np.int64).max)
        self.bound = np.full(rows, least)  # no score below it can enter

    def add(self, rows: np.ndarray, partners: np.ndarray, scores: np.ndarray, least: float) -> None:
        """Enter candidates; equal scores prefer the smaller partner."""
        if not len(rows):
            return
        touched = np.unique(rows)
        r = np.concatenate([np.repeat(touched, self.k), rows])
        p = np.concatenate([self.partner[touched].ravel(), partners])
        s = np.concatenate([self.score[touched].ravel(), scores])
        order = np.lexsort((p, -s, r))
        r, p, s = r[order], p[order], s[order]
        first = np.searchsorted(r, touched)
        place = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
        top = place < self.k
        self.partner[r[top], place[top]] = p[top]
        self.score[r[top], place[top]] = s[top]
        self.bound[touched] = np.maximum(least, self.score[touched, -1])


def _enter(s: np.ndarray, error: np.ndarray, x0: int, y0: int, p: _Block, q: _Block, best: _Best, least: float) -> None:
    """Enter into the lists of rows ``x0 ...`` of ``p`` what tile ``s`` of products with ``q`` may hold for them."""
    k, bound = best.k, best.bound[x0 : x0 + len(s)]
    hit = s >= (bound - error).astype(np.float32)[:, None]
    many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 4 * k)
    if len(many) and s.shape[1] > k:
        sure = np.partition(s[many], s.shape[1] - k, axis=1)[:, s.shape[1] - k] - error[many]
        hit[many] &= s[many] >= (sure - error[many]).astype(np.float32)[:, None]
    x, y = np.nonzero(hit)
    if len(bound) and bound.min() == -np.inf:
        there = s[x, y] > -np.inf
        x, y = x[there], y[there]
    for at in range(0, len(x), 1 << 20):
        i, j = x[at : at + (1 << 20)] + x0, y[at : at + (1 << 20)] + y0
        exact = np.einsum("ij,ij->i", p.unit[i], q.unit[j])
        keep = exact >= best.bound[i]
        best.add(i[keep], q.ids[j[keep]], exact[keep], least)


def _pair(a: _Block, b: _Block, k: int, least: float) -> list[tuple[_Block, _Best]]:
    """Lists of both blocks from all products of ``a`` with ``b``; of one block if they are the same object."""
    of_a = _Best(len(a), k, least)
    of_b = of_a if a is b else _Best(len(b), k, least)
    for y in range(0, len(b), _COLUMNS):
        columns = slice(y, min(y + _COLUMNS, len(b)))
        for x in range(0, columns.stop if a is b else len(a), _TILE):
            rows = slice(x, min(x + _TILE, len(a)))
            s = a.codes[rows] @ b.codes[columns].T
            s *= a.scale[rows, None].astype(s.dtype)
            s *= b.scale[columns].astype(s.dtype)
            if a is b:  # only pairs above the diagonal: a vector is not its own neighbour, and each pair comes once
                below = np.arange(rows.start, rows.stop)[:, None] >= np.arange(columns.start, columns.stop)
                s[below] = -np.inf
            # |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|, plus what float32 scaling may lose.
            _enter(s, a.off[rows] + a.size[rows] * b.off[columns].max() + 1e-6, x, y, a, b, of_a, least)
            _enter(s.T, b.off[columns] + b.size[columns] * a.off[rows].max() + 1e-6, y, x, b, a, of_b, least)
    return [(a, of_a)] if a is b else [(a, of_a), (b, of_b)]


def _block_join(dim: int, k: int, least: float, blocks: int):
    def join(key, left: pa.Table, right: pa.Table) -> pa.Table:
        pair = key[0].as_py()
        a = _Block(left, dim)
        # A block with itself is one object: the two sides of a shuffle need not come in the same order.
        b = a if pair // blocks == pair % blocks else _Block(right, dim)
        parts = []
        if len(a) and len(b):
            for block, best in _pair(a, b, k, least):
                i, place = np.nonzero(best.score > -np.inf)
                parts.append((block.ids[i], best.partner[i, place], best.score[i, place]))
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"class_id": columns[0], "partner": columns[1], "similarity": columns[2]})

    return join


def nearest(points: DataFrame, k: int = 5, min_similarity: float | None = None, dim: int = 64, block_rows: int | None = None) -> DataFrame:
    """For every usable ``points(id, vector)`` row its ``k`` most similar others by cosine.

    Result: ``(id, neighbour, similarity, place)``, place from 1; equal similarities of
    equal vectors prefer the smaller neighbour id. With ``min_similarity`` only pairs of at least
    that are listed, which prunes most products. Exact: no pair is lost by rounding.

    Not usable, as query and as neighbour: a null vector, another length than
    ``dim``, NaN, infinite or null elements, all zero, a null id. Equal vectors are joined as one class
    of which the k + 1 smallest ids take part as neighbours; every copy gets its
    list. Fewer than k others give shorter lists, an empty table none. Repeated ids
    count as one if their vectors are equal. Extra columns are ignored.
    """
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = points.where(
        F.col("id").isNotNull() & (F.size("vector") == dim) & ~bad & F.exists("vector", lambda x: x != 0)
    ).select("id", F.transform("vector", lambda x: x.cast("float") + F.lit(0.0).cast("float")).alias("vector"))  # + 0: -0 becomes 0
    usable = usable.withColumn("hash", F.xxhash64("vector"))  # only leads sorts; classes are told apart by the vectors
    classes = cut(usable.select("hash", "vector").distinct().withColumn("class_id", F.monotonically_increasing_id()))
    members = cut(usable.join(classes, ["hash", "vector"]).select("id", "class_id").distinct())
    rows = classes.count()
    block_rows = block_rows or max(1, BLOCK_BYTES // (4 * dim))
    parallel = points.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-rows // block_rows), min(math.ceil(math.sqrt(8 * parallel)), -(-rows // 1_000)))
    placed = classes.select("class_id", "vector", F.pmod("hash", F.lit(blocks)).cast("int").alias("block"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = placed.select(F.explode(F.filter(every, lambda o: o >= F.col("block"))).alias("other"), "*").select((F.col("block") * F.lit(blocks).cast("long") + F.col("other")).alias("pair"), "class_id", "vector")
    right = placed.select(F.explode(F.filter(every, lambda o: o < F.col("block"))).alias("other"), "*").select((F.col("other") * F.lit(blocks).cast("long") + F.col("block")).alias("other_pair"), "class_id", "vector")
    least = -np.inf if min_similarity is None else float(min_similarity)
    tasks = min(MOST_TASKS, max(tasks_for_cpu(points.sparkSession), blocks * (blocks + 1)))
    found = (
        left.repartition(tasks, "pair")
        .groupBy("pair")
        .cogroup(right.repartition(tasks, "other_pair").groupBy("other_pair"))
        .applyInArrow(_block_join(dim, k, least, blocks), "class_id bigint, partner bigint, similarity double")
    )
    order = Window.partitionBy("class_id").orderBy(F.desc("similarity"), "partner")
    top = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("class_id", "partner", "similarity")
    return _to_ids(members, top, k, least)


def _to_ids(named: DataFrame, top: DataFrame, k: int, least: float) -> DataFrame:
    """Lists of classes as lists of ids."""
    few = named.withColumn("n", F.row_number().over(Window.partitionBy("class_id").orderBy("id"))).where(F.col("n") <= k + 1).select("class_id", F.col("id").alias("neighbour"))
    own = few.withColumn("similarity", F.lit(1.0)) if least <= 1 else few.withColumn("similarity", F.lit(1.0)).limit(0)
    others = top.join(few.withColumnRenamed("class_id", "partner"), "partner").select("class_id", "neighbour", "similarity")
    # At most k + 1 ids of the class itself and (k + 1) * k of others for each class.
    lists = own.unionByName(others).groupBy("class_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("d"), "neighbour"))), 1, k + 1).alias("list")
    )
    return (
        named.join(lists, "class_id")
        .select("id", F.posexplode(F.slice(F.filter("list", lambda x: x["neighbour"] != F.col("id")), 1, k)).alias("at", "x"))
        .select("id", "x.neighbour", (-F.col("x.d")).alias("similarity"), (F.col("at") + 1).alias("place"))
    )
