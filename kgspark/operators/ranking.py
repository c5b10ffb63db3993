"""Top-k, fusion, sampling and budgets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that are broadcast at once; more are searched in several passes.
QUERY_BYTES_AT_ONCE = 64 << 20


def top_k(scored: DataFrame, k: int, group: str = "query_id", score: str = "score", tie: str = "id", least: float | None = None) -> DataFrame:
    """The k best of each group, ranked from 1; ties by ``tie``; scores below ``least`` dropped."""
    if k <= 0:
        raise ValueError("k must be positive")
    kept = scored if least is None else scored.where(F.col(score) >= least)
    order = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _units(v: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _search(asked, dim: int, k: int, metric: str, least: float | None, digits: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = asked.value
        fast = q.astype(np.float32)
        reach = float(np.sqrt((q * q).sum(axis=1)).max(initial=0))
        for b in batches:
            v = _matrix(b.column("vector"), dim)
            bad = np.isnan(v).any(axis=1)
            if bad.any():
                b, v = b.filter(pa.array(~bad)), v[~bad]
            if not len(v):
                continue
            # Ties go to the smaller id, so no more than k of a batch are needed.
            order = np.asarray(pc.sort_indices(b.column("id")))
            place_of_id = np.empty(len(order), np.int64)
            place_of_id[order] = np.arange(len(order))
            if metric == "cosine":
                v = _units(v)
            low = v.astype(np.float32).T
            # Products in single precision choose what is computed again in double; this bounds their error.
            slack = 1e-6 * dim**0.5 * max(1.0, reach * float(np.sqrt((v * v).sum(axis=1)).max())) + (10.0**-digits if digits is not None else 0)
            out = []
            for at in range(0, len(q), 256):
                s = fast[at : at + 256] @ low
                width = s.shape[1]
                floor = np.full(len(s), -np.inf if least is None else least - slack)
                stripes = min(64, width // 8)
                if stripes >= k:  # the best of so many stripes are at least as many good ones
                    top = s[:, : width // stripes * stripes].reshape(len(s), -1, stripes).max(axis=1)
                    floor = np.maximum(floor, np.partition(top, stripes - k, axis=1)[:, stripes - k] - 2 * slack)
                elif width > k:
                    floor = np.maximum(floor, np.partition(s, width - k, axis=1)[:, width - k] - 2 * slack)
                flat = np.flatnonzero(s >= floor.astype(np.float32)[:, None])
                r, c = flat // width, flat % width
                exact = np.einsum("ij,ij->i", q[r + at], v[c])
                if digits is not None:
                    exact = np.round(exact, digits)
                by = np.lexsort((place_of_id[c], -exact, r))
                r, c, exact = r[by], c[by], exact[by]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                if least is not None:
                    keep &= exact >= least
                out.append((r[keep] + at, c[keep], exact[keep]))
            rows, found, score = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), b.column("id").take(pa.array(found)), pa.array(score)], names=["query_id", "id", "score"])

    return run


def dense_top_k(queries: DataFrame, points: DataFrame, k: int, dim: int, metric: str = "cosine", least: float | None = None, digits: int | None = None) -> DataFrame:
    """The k best ``points(id, vector)`` for each ``queries(query_id, vector)``: ``(query_id, id, score, rank)``.

    Query vectors, at most QUERY_BYTES_AT_ONCE in a pass, are broadcast; each batch of
    points meets them in one matrix product and keeps its own k best, so that only
    those are shuffled. Equal scores, with ``digits`` equal to so many decimals, go by id. Vectors of another length, with NaN and nulls are left out on both sides.
    """
    if metric not in ("cosine", "dot"):
        raise ValueError(f"unknown metric {metric}")
    if k <= 0:
        raise ValueError("k must be positive")
    spark = points.sparkSession
    fit = lambda df: df.where(F.size("vector") == dim)  # noqa: E731  # null elements become NaN in the matrix
    fit_queries = fit(queries).where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    passes = max(1, math.ceil(fit_queries.count() * dim * 8 / QUERY_BYTES_AT_ONCE))
    qtype, ptype = dict(queries.dtypes)["query_id"], dict(points.dtypes)["id"]
    found = None
    for p in range(passes):
        part = fit_queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p) if passes > 1 else fit_queries
        rows = part.select("query_id", "vector").toArrow()
        matrix = _matrix(rows["vector"], dim)
        asked = spark.sparkContext.broadcast((rows["query_id"].combine_chunks(), _units(matrix) if metric == "cosine" else matrix))
        one = fit(points).select("id", "vector").mapInArrow(_search(asked, dim, k, metric, least, digits), f"query_id {qtype}, id {ptype}, score double")
        found = one if found is None else found.unionByName(one)
    return top_k(found, k)


def fuse(ranked: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ``(query_id, id, rank)`` lists, ranks from 1, into one of length k. Shares are summed in order, so ties are exact."""
    everything = None
    for r in ranked:
        part = r.select("query_id", "id", (1.0 / (constant + F.col("rank"))).alias("share"))
        everything = part if everything is None else everything.unionByName(part)
    return top_k(everything.groupBy("query_id", "id").agg(F.round(F.sum("share"), 12).alias("score")), k)


def sample_k(candidates: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k of ``candidates(query_id, id)`` for each query, without replacement, the same for one seed."""
    draw = F.md5(F.concat_ws("|", F.col("query_id").cast("string"), F.col("id").cast("string"), F.lit(str(seed))))
    order = Window.partitionBy("query_id").orderBy(draw, "id")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank(scored: DataFrame, k: int | None = None) -> DataFrame:
    """``(query_id, id, pos, score)`` by score, then old position; ranks from 0, cut to k."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    out = scored.withColumn("rank", F.row_number().over(order) - 1)
    return out if k is None else out.where(F.col("rank") < k)


def running_total(rows: DataFrame, value: Column, group: str, order: list[str], name: str = "total") -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of its group up to its own, in an order without ties.

    Rows lie in ranges of (group, order), so a group of any size spreads over tasks; each
    range sums its own rows and is shifted by the ranges of the group before it.
    """
    from kgspark.storage import cut

    part = rows.withColumn("_value", value).repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id())
    part = cut(part)
    own = Window.partitionBy("_range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = part.groupBy("_range", F.col(group).alias("_group")).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    shift = sums.withColumn("_shift", F.coalesce(F.sum("_sum").over(before), F.lit(0))).where("_shift <> 0").select("_range", "_group", "_shift")
    local = part.withColumn("_own", F.sum("_value").over(own))
    out = local.join(shift, (local["_range"] == shift["_range"]) & local[group].eqNullSafe(F.col("_group")), "left")
    return out.select(*[local[c] for c in rows.columns], (F.col("_own") + F.coalesce("_shift", F.lit(0))).alias(name))


def within_budget(rows: DataFrame, budget: int, size: str = "tokens", group: str = "query_id", order: str = "rank") -> DataFrame:
    """The longest prefix of each group whose sizes sum up to at most the budget, as ``used``; ``order`` has no ties."""
    return running_total(rows, F.col(size), group, [order], "used").where(F.col("used") <= budget)


def topological_levels(subqueries: DataFrame, max_depth: int = 1_000) -> DataFrame:
    """``(plan_id, id, level)``: level 0 depends on nothing, others come after all they depend on.

    All plans advance together, one join a level. Unknown ids and cycles are errors.
    """
    from kgspark.storage import cut

    edges = subqueries.select("plan_id", "id", F.explode("depends_on").alias("needs"))
    unknown = edges.join(subqueries.select("plan_id", F.col("id").alias("needs")), ["plan_id", "needs"], "left_anti")
    if unknown.limit(1).count():
        raise ValueError("a sub-query depends on an id its plan does not have")
    nodes = subqueries.select("plan_id", "id")
    done = cut(nodes.join(edges, ["plan_id", "id"], "left_anti").withColumn("level", F.lit(0)))
    count, total = done.count(), nodes.count()
    for _ in range(max_depth):
        if count == total:
            return done
        need = edges.join(done.select("plan_id", F.col("id").alias("needs"), "level"), ["plan_id", "needs"], "left")
        ready = need.groupBy("plan_id", "id").agg(F.count(F.lit(1)).alias("n"), F.count("level").alias("have"), (F.max("level") + 1).alias("level")).where("n = have")
        new = ready.join(done, ["plan_id", "id"], "left_anti").select("plan_id", "id", "level")
        done = cut(done.unionByName(new))
        before, count = count, done.count()
        if count == before:
            raise ValueError("sub-queries depend on each other in a cycle")
    raise ValueError("plans are too deep")
