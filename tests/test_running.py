"""Ranks and running sums over rows that come in several partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sableframe.operators.running import ranked, running_sum


#: Narrow and wide rows of one shuffle are then read in different numbers of partitions.
UNEVEN = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m"}


def test_ranks_of_many_rows(spark):
    before = {k: spark.conf.get(k) for k in UNEVEN}
    for k, v in UNEVEN.items():
        spark.conf.set(k, v)
    try:
        _ranks(spark, 400_000)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _ranks(spark, n):
    rows = spark.range(n).select(F.col("id"), F.xxhash64("id").alias("x"), (F.col("id") % 3).alias("g"), F.repeat(F.lit("pad"), 5).alias("pad"))
    found = ranked(rows, [], [F.col("x").asc(), F.col("id").asc()], "nth")
    got = found.agg(F.count("*"), F.countDistinct("nth"), F.min("nth"), F.max("nth")).first()
    assert tuple(got) == (n, n, 1, n)
    sums = running_sum(rows, ["g"], [F.col("x").asc()], F.lit(2).cast("long"), "total").groupBy("g").agg(F.count("*").alias("n"), F.max("total").alias("m"), F.countDistinct("total").alias("d")).collect()
    assert all(r["m"] == 2 * r["n"] and r["d"] == r["n"] for r in sums) and sum(r["n"] for r in sums) == n
