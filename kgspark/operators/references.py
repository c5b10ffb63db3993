"""References to records that do not exist, are deleted, or arrive later.

Parents and references are split by the same key ranges. Each range holds its
parent keys as one sorted array; reference batches are looked up in it by binary
search, so neither side is sorted or hashed as a whole. Ranges that many
references fall into (one key may hold a third of all rows) are split further by
a salt over the referring rows, with the range's parents repeated per salt.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_RANGE = 400_000
SAMPLES_PER_RANGE = 64

_MISSES = "table_name string, field_name string, row_id bigint, ref_id string, ref_state string, month_key string"


def _boundaries(keys: DataFrame, ranges: int, rows: int) -> list[str]:
    """Lower bounds of ranges 1.. from a sample of SAMPLES_PER_RANGE keys a range."""
    if ranges < 2 or not rows:
        return []
    share = min(1.0, ranges * SAMPLES_PER_RANGE / rows)
    sample = sorted(r[0] for r in keys.sample(share, seed=7).collect())
    step = max(1, len(sample) // ranges)
    return sorted(set(sample[step::step]))


def _range_of(bounds: list[str]):
    @F.pandas_udf(T.IntegerType())
    def range_of(key: pd.Series) -> pd.Series:
        return key.map(lambda k: bisect_right(bounds, k))

    return range_of


def _probe(_key, parents: pa.Table, refs: pa.Table) -> pa.Table:
    order = np.argsort(keys := np.array(parents["range_key"].to_pylist(), dtype=object))
    keys = keys[order]
    first = np.array(parents["first_us"].to_pylist(), dtype=np.float64)[order]
    gone = np.array(parents["all_deleted"].to_pylist(), dtype=bool)[order]
    wanted = np.array(refs["range_key"].to_pylist(), dtype=object)
    seen = np.array(refs["seen_us"].to_pylist(), dtype=np.float64)
    state = np.full(len(wanted), "missing", dtype=object)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        late = np.greater(first[at], seen)  # False where either time is unknown
        state[hit] = np.where(gone[at], "deleted", np.where(late, "late", "ok"))[hit]
    bad = pa.array(state != "ok")
    found = refs.append_column("ref_state", pa.array(state, pa.string())).filter(bad)
    return found.select(["table_name", "field_name", "row_id", "ref_id", "ref_state", "month_key"])


def orphan_references(
    parents: DataFrame, references: DataFrame, *, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """References whose key has no usable parent at the time of referring.

    ``parents(kind, key, ingested_at, deleted_at)`` may hold a key several times;
    ``references(table_name, field_name, kind, row_id, ref_id, ingested_at)`` holds
    one row for each referring row and key. Result: one distinct row for each
    reference with ``ref_state`` ``missing`` (no parent row), ``deleted`` (all its
    rows have deleted_at) or ``late`` (its first ingested_at is after the referring
    row's), and ``month_key``, the yyyy-MM of the referring row's ingested_at.

    Null keys are no references and no parents. Keys are equal only character for
    character. A parent or referring row without ingested_at is never late; its
    month_key is null. Repeated rows count once. Empty inputs give no row, empty
    parents make every reference missing. Extra columns are ignored.
    """
    spark = references.sparkSession
    key = F.concat_ws("\0", "kind", "key")
    parent = (
        parents.where(F.col("key").isNotNull())
        .select(key.alias("range_key"), "ingested_at", "deleted_at")
    )
    refs = references.where(F.col("ref_id").isNotNull()).select(
        F.concat_ws("\0", "kind", "ref_id").alias("range_key"),
        "table_name",
        "field_name",
        "row_id",
        "ref_id",
        F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("seen_us"),
        F.date_format("ingested_at", "yyyy-MM").alias("month_key"),
    )
    rows = parent.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_range))
    range_of = _range_of(_boundaries(parent.select("range_key"), ranges, rows))
    refs = refs.withColumn("range_id", range_of("range_key"))
    load = {r[0]: r[1] for r in refs.groupBy("range_id").count().collect()}  # one row a range
    salts = {k: -(-n // rows_per_range) for k, n in load.items() if n > rows_per_range}
    per_range = F.lit(1)
    if salts:
        hot = F.create_map(*[F.lit(x) for k, n in salts.items() for x in (k, n)])
        per_range = F.coalesce(hot[F.col("range_id")], F.lit(1))
    refs = refs.withColumn("salt", F.pmod(F.xxhash64("row_id"), per_range).cast("int"))
    sorted_side = (
        parent.groupBy("range_key")
        .agg(
            F.min(F.unix_micros(F.col("ingested_at").cast("timestamp"))).alias("first_us"),
            F.bool_and(F.col("deleted_at").isNotNull()).alias("all_deleted"),
        )
        .withColumn("range_id", range_of("range_key"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), (per_range - 1).cast("int"))))
    )
    return (
        sorted_side.groupBy("range_id", "salt")
        .cogroup(refs.groupBy("range_id", "salt"))
        .applyInArrow(_probe, _MISSES)
        .distinct()
    )


def orphan_report(misses: DataFrame) -> DataFrame:
    """Misses counted per table, field, state and month of the referring row."""
    return misses.groupBy("table_name", "field_name", "month_key", "ref_state").agg(
        F.count(F.lit(1)).alias("n_refs"), F.countDistinct("row_id").alias("n_rows")
    )
