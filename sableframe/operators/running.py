"""Running sums and ranks of groups of any size: rows are dealt by range, so no group has to meet in one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over a group's rows up to this one. Rows with equal order are summed one after another.

    The partitions' sums, one row for each group and partition, are what is
    added up in order; each row then joins what came before its partition. The
    dealt rows are kept, as bounds are sampled: dealt twice, or dealt anew for a
    lost task, rows could change their partitions.
    """
    ranged = kept(df.withColumn("_v", value).repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_p", F.spark_partition_id()))
    inside = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*by, "_p").agg(F.sum("_v").alias("_s")).withColumn("_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)))
    before = sums.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("_p").alias("_q"), "_b")
    same = F.col("_p") == F.col("_q")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return ranged.withColumn("_r", F.sum("_v").over(inside)).join(before, same).select(*df.columns, (F.col("_r") + F.col("_b")).alias(name))


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds `name`: the row's number in its group, from 1."""
    return running_sum(df, by, order, F.lit(1).cast("long"), name)


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names.

    A session in one process (as in tests) may leave it unset and gets a
    temporary folder; elsewhere that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sableframe-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """The rows as written to the shared folder, so that what made them runs once."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
