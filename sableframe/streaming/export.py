"""Incremental export of row versions, each exactly once, with recovery.

A stream of rows is written part by part: one folder for each micro-batch, with
a ledger of what each holds. A batch that is run again after a failure writes
the same folder again, and one that the ledger has is left as it is. Readers go
by the ledger, so what a failed batch left behind is never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "batch long, path string, rows long, digest string, columns array<string>"


def versions(rows: DataFrame, key: list[str], version: str, lateness: str | None = None) -> DataFrame:
    """Each version of a row once. With `lateness` (of a time column named by `version`), what is known of older ones may be forgotten."""
    if lateness is None:
        return rows.dropDuplicates([*key, version])
    return rows.withWatermark(version, lateness).dropDuplicatesWithinWatermark([*key, version])


def ledger(spark: SparkSession, target: str) -> DataFrame:
    """One row for each complete part."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/ledger")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LEDGER).json(f"{target}/ledger/*") if there else spark.createDataFrame([], LEDGER)


def digest(rows: DataFrame) -> DataFrame:
    """Rows and an order-free digest of them."""
    one = F.xxhash64(*rows.columns).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(one), F.lit(0)).cast("string").alias("digest"))


def write_part(rows: DataFrame, batch: int, target: str, kind: str = "parquet", options: dict[str, str] | None = None) -> None:
    """Write a batch's part and enter it, unless the ledger has it; the entry is what makes the part count."""
    spark = rows.sparkSession
    if not ledger(spark, target).where(F.col("batch") == batch).isEmpty():
        rows.write.format("noop").mode("overwrite").save()  # what the stream knows of versions has to be brought up all the same
        return
    path = f"{target}/parts/{batch:010d}"
    rows.write.format(kind).options(**(options or {})).mode("overwrite").save(path)
    written = spark.read.format(kind).options(**(options or {})).schema(rows.schema).load(path)
    entry = digest(written).select(F.lit(batch).cast("long").alias("batch"), F.lit(path).alias("path"), "rows", "digest", F.array(*map(F.lit, rows.columns)).alias("columns"))
    entry.coalesce(1).write.mode("overwrite").json(f"{target}/ledger/{batch:010d}")


def export(stream: DataFrame, target: str, checkpoint: str, kind: str = "parquet", options: dict[str, str] | None = None) -> None:
    """Work off what is there, part by part, then stop. The next call goes on where this one, or one that failed, ended."""

    def part(rows: DataFrame, batch: int) -> None:
        write_part(rows, batch, target, kind, options)

    query = stream.writeStream.foreachBatch(part).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def exported(spark: SparkSession, target: str, schema: str, kind: str = "parquet", options: dict[str, str] | None = None) -> DataFrame:
    """All rows of complete parts, with the batch that wrote them."""
    parts = [r["path"] for r in ledger(spark, target).select("path").collect()]
    reader = spark.read.format(kind).options(**(options or {})).schema(schema)
    rows = reader.load(parts) if parts else spark.createDataFrame([], schema)
    return rows.withColumn("batch", F.regexp_extract(F.input_file_name(), r"/parts/(\d+)/", 1).cast("long"))
