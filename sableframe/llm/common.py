"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of text each, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start, n - start)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that `spark.checkpoint.dir` names.

    Only a session in one process (as in tests) may leave it unset: it gets a
    folder below the temporary directory. Elsewhere that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{os.environ.get('TMPDIR', '/tmp')}/sableframe-{uuid.uuid4().hex[:8]}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder of the session."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tree_sum(parts: DataFrame, fan: int = 64) -> DataFrame:
    """Sums of arrays by `k`, from rows (k int, v binary of 64-bit integers) of any number of tasks.

    At most `fan` rows meet at once, up to fan**4 tasks.
    """

    def add(part: pa.Table) -> pa.Table:
        total = np.zeros(len(part["v"][0].as_buffer()) // 8, np.int64)
        for x in part["v"]:
            total += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"k": part["k"][:1], "part": part["part"][:1], "v": pa.array([total.tobytes()], pa.binary())})

    sums = parts.withColumn("part", F.spark_partition_id())
    for _ in range(3):
        sums = sums.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("k", "part").applyInArrow(add, "k int, part int, v binary")
    return sums.groupBy("k").applyInArrow(add, "k int, part int, v binary").select("k", "v")
