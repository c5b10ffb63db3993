"""Shared folder of the cluster and tables written there to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only a plain ``local[...]`` session, whose executor is this process, may go
    without the setting; it then gets a temporary folder.
    """
    root = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {_CONF} to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="kgspark-")
    spark.conf.set(_CONF, root)
    return root


def _own_dir(spark: SparkSession) -> str:
    """Folder of this application's cut tables inside the shared one."""
    return f"{shared_dir(spark)}/cut-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Remove all tables that ``cut`` wrote in this application; call it when no result that builds on them is wanted any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    What follows depends on the files alone, so a lost executor costs a re-read
    and not a recomputation, and nondeterministic row order is fixed once. The
    files stay until ``clean`` removes those of the application.
    """
    path = f"{_own_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, most: int, what: str) -> list:
    """All rows, for the driver; an error if there are more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"there are more than {most} {what}; split the input")
    return rows


def tasks_for_cpu(spark: SparkSession) -> int:
    """Tasks for work that is heavy in CPU but small in bytes, which adaptive execution would merge into few."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over as many tasks as there are cores, if they are so few bytes that a scan would make fewer tasks.

    A scan packs up to ``spark.sql.files.openCostInBytes`` into a task even where cores stay idle, which is too much for work
    that is heavy in CPU. What is larger, or of unknown size, is left as it is, so nothing large is ever moved for this.
    """
    spark = rows.sparkSession
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))  # whole files: a projection's own estimate guesses at the length of texts
    least = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.openCostInBytes")))
    return rows.repartition(tasks_for_cpu(spark)) if size < least * spark.sparkContext.defaultParallelism else rows
