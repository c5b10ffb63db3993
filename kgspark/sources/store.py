"""The engine's own store: a folder of Parquet snapshots behind one pointer file.

A write puts all changed tables into a new version and then replaces the pointer, so
readers see either the old state of all tables or the new one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.text import json_size


class TableStore:
    """Tables by name; usable as a context manager."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._fs_path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._fs_path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def __enter__(self) -> "TableStore":
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held open between calls."""

    def _pointer(self) -> dict:
        path = f"{self.root}/CURRENT.json"
        if not self._fs.exists(self._fs_path(path)):
            return {"version": 0, "tables": {}}
        text = self.spark.read.text(path, wholetext=True).first()[0]
        return json.loads(text)

    def tables(self) -> list[str]:
        return sorted(self._pointer()["tables"])

    def read(self, name: str) -> DataFrame:
        where = self._pointer()["tables"].get(name)
        if where is None:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.root}/{where}")

    def write(self, **tables: DataFrame) -> int:
        """A new version with these tables replaced and all others as they were."""
        now = self._pointer()
        version = now["version"] + 1
        for name, df in tables.items():
            where = f"v={version}/{name}"
            df.write.mode("overwrite").parquet(f"{self.root}/{where}")
            now["tables"][name] = where
        now["version"] = version
        path, new = self._fs_path(f"{self.root}/CURRENT.json"), self._fs_path(f"{self.root}/.CURRENT.{version}.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(now), "utf-8"))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
        options = self.spark._sc._gateway.new_array(getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = rename
        context.rename(new, path, options)
        return version

    def drop(self, name: str) -> None:
        """Leave a table out from the next version on."""
        self.write(**{name: self.read(name).limit(0)})


def register(store: TableStore) -> None:
    """All tables as temporary views, for SQL."""
    for name in store.tables():
        store.read(name).createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str, **args: object) -> DataFrame:
    """A parametrised query over the registered views."""
    return spark.sql(text, args=args)


def size_batches(rows: DataFrame, most_bytes: int) -> DataFrame:
    """``rows`` with ``batch_id``: consecutive rows of a partition up to a size as JSON; a larger row is alone."""
    sized = rows.withColumn("_size", json_size(*rows.columns)).withColumn("_part", F.spark_partition_id())
    schema, names = rows.withColumn("batch_id", F.lit("")).schema, rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, used = 0, 0
        for b in batches:
            ids = []
            for size, part in zip(b.column("_size").to_pylist(), b.column("_part").to_pylist()):
                if used and used + size > most_bytes:
                    number, used = number + 1, 0
                used += size
                ids.append(f"{part}-{number}")
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(ids, pa.string())], names=[*names, "batch_id"])

    return sized.mapInArrow(run, schema)


def fixed_batches(rows: DataFrame, order: str, n: int) -> DataFrame:
    """``rows`` with ``batch_id`` counting groups of n rows in an order.

    Range partitions are numbered by themselves and shifted by the sizes before them, so no task holds all rows.
    """
    from kgspark.storage import cut

    parted = cut(rows.orderBy(order).withColumn("_id", F.monotonically_increasing_id()))
    sizes = sorted(parted.groupBy(F.shiftright("_id", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    offsets, run = [], 0
    for p, size in sizes:
        offsets.append((p, run))
        run += size
    table = rows.sparkSession.createDataFrame(offsets, "_p long, _shift long")
    numbered = parted.withColumn("_p", F.shiftright("_id", 33)).join(F.broadcast(table), "_p")
    return numbered.withColumn("batch_id", F.floor((F.col("_id").bitwiseAND((1 << 33) - 1) + F.col("_shift")) / n)).drop("_p", "_id", "_shift")


def display_attributes(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes of nodes and widths of edges for drawing: 15 to 50 by degree, 1 to 6 by strength."""
    from kgspark.operators.neighbourhood import degrees

    d = degrees(relations)
    nodes = entities.select("id").join(d, "id", "left").na.fill(0, ["degree"])
    top = nodes.agg(F.max("degree").alias("top"))
    nodes = nodes.crossJoin(F.broadcast(top)).select("id", F.round(15 + 35 * F.coalesce(F.col("degree") / F.nullif("top", F.lit(0)), F.lit(0.0)), 4).alias("node_size"))  # top is one row
    return nodes, relations.select("id", F.round(1 + F.least(2 * F.coalesce("relation_strength", F.lit(1.0)), F.lit(5.0)), 4).alias("edge_width"))


def append_examples(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Examples added under new random ids."""
    return existing.unionByName(new.withColumn("id", F.uuid()), allowMissingColumns=True)
