"""Incremental export with failures, and passes until nothing is added."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from sableframe.operators.passes import ordered_values, union_of_passes
from sableframe.streaming import export as x

SCHEMA = "id long, version int, text string"


def incoming(spark, folder, n, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_each_version_once_over_failures(spark, tmp_path):
    source, target, marks = (f"{tmp_path}/{n}" for n in ("in", "out", "marks"))
    first = [(1, 1, "a"), (2, 1, "b"), (1, 1, "a"), (3, 1, None)]
    stream = incoming(spark, source, 1, first)
    x.export(x.versions(stream, ["id"], "version"), target, marks)
    assert sorted(r["id"] for r in x.exported(spark, target, SCHEMA).collect()) == [1, 2, 3]

    # the second file is written, but the run fails before the ledger's entry; what it left isn't read
    incoming(spark, source, 2, [(1, 2, "c"), (2, 1, "b"), (4, 1, "d")])
    whole = x.write_part

    def fails(rows, batch, *args):
        rows.write.mode("overwrite").parquet(f"{target}/parts/{batch:010d}")
        raise OSError("lost")

    x.write_part = fails
    with pytest.raises(Exception, match="lost"):
        x.export(x.versions(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), ["id"], "version"), target, marks)
    x.write_part = whole
    assert x.exported(spark, target, SCHEMA).count() == 3

    # the next run does the batch again and goes on
    stream = incoming(spark, source, 3, [(5, 1, "e"), (1, 2, "c")])
    x.export(x.versions(stream, ["id"], "version"), target, marks)
    found = x.exported(spark, target, SCHEMA)
    assert sorted((r["id"], r["version"]) for r in found.collect()) == [(1, 1), (1, 2), (2, 1), (3, 1), (4, 1), (5, 1)]
    entries = {r["batch"]: r for r in x.ledger(spark, target).collect()}
    assert sum(r["rows"] for r in entries.values()) == 6 and all(r["columns"] == ["id", "version", "text"] for r in entries.values())
    for batch, entry in entries.items():
        assert x.digest(found.where(F.col("batch") == batch).drop("batch")).first()["digest"] == entry["digest"]

    # with its marks lost, a stream numbers from the start: parts in the ledger stay as they are
    shutil.rmtree(marks)
    x.export(x.versions(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), ["id"], "version"), target, marks)
    assert x.exported(spark, target, SCHEMA).count() == 6


def test_export_of_nothing(spark, tmp_path):
    assert x.exported(spark, f"{tmp_path}/none", SCHEMA).count() == 0 == x.ledger(spark, f"{tmp_path}/none").count()


def test_passes_until_nothing_is_added(spark):
    docs = spark.createDataFrame([(d, d) for d in range(6)], "doc_id long, depth int")
    calls = []

    def ask(some, number):
        calls.append((number, sorted(r["doc_id"] for r in some.collect())))
        values = F.transform(F.sequence(F.lit(0), F.least(F.lit(number), F.col("depth"))), lambda k: F.concat(F.lit("v"), k.cast("string")))
        rows = some.select("doc_id", F.lit("T").alias("type"), F.explode(values).alias("value"))
        return rows.unionByName(some.select("doc_id", F.lit("T").alias("type"), F.lit("").alias("value")))

    found = union_of_passes(docs, ask, 4)
    assert {(r["doc_id"], r["value"], r["pass"]) for r in found.collect()} == {(d, f"v{k}", k) for d in range(6) for k in range(min(d, 3) + 1)}
    # a document whose last pass added nothing isn't asked again
    assert calls == [(0, [0, 1, 2, 3, 4, 5]), (1, [0, 1, 2, 3, 4, 5]), (2, [1, 2, 3, 4, 5]), (3, [2, 3, 4, 5])]
    got = {r["doc_id"]: (r["values"], r["passes"]) for r in ordered_values(found).collect()}
    assert got[5] == (["v0", "v1", "v2", "v3"], 4) and got[0] == (["v0"], 1)
    calls.clear()
    union_of_passes(docs.where("doc_id = 0"), ask, 9)
    assert [c[0] for c in calls] == [0, 1]
