"""Cutting lineage in storage that outlives an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is read from spark.checkpoint.dir; only on one machine, where that is
    unset, a temporary folder takes its place. A cluster without it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="lumenfold-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(made)
    return jsc.getCheckpointDir().get().rstrip("/")


def clear(spark: SparkSession) -> None:
    """Removes all tables written so far. Only results already read may be used after it."""
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer tasks than there are cores; else as it is, without a shuffle.

    For work that is heavy for each row: a small table in one row group would be
    read and worked on by a single task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def place(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    _WRITTEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again with column pruning."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], column: str, name: str) -> DataFrame:
    """df with column: 0, 1, ... in the order of the given columns, without one task seeing all rows.

    The rows are range-partitioned and written once; a number is the place in
    the partition plus the sizes of the partitions before it. order must be
    total, else ties are numbered in any order.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    placed = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").count()  # one row a partition
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    here = Window.partitionBy("_part").orderBy(*order)
    return (
        placed.withColumn(column, F.row_number().over(here).cast("bigint"))
        .join(F.broadcast(offsets), "_part")
        .withColumn(column, F.col(column) + F.col("_offset") - 1)
        .drop("_part", "_offset")
    )
