"""Steps whose work must grow with the text, not with its square."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from sableframe.queries import layout as q


def timed(df):
    start = time.monotonic()
    df.write.format("noop").mode("overwrite").save()
    return time.monotonic() - start


@pytest.fixture
def long_texts(spark, tmp_path):
    """One text in the pieces of a small folder, and whole, 200 times as long."""

    def folder(name, rows):
        df = spark.range(rows).select(F.col("id").alias("doc_id"), F.repeat(F.lit("Anna berryfield and é others wrote\n"), 60_000 // rows).alias("text"))
        df.withColumns({"lang": F.lit("en"), "source": F.lit("a"), "n_chars": F.char_length("text")}).coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        return f"{tmp_path}/{name}"

    return folder("short", 200), folder("long", 1)


def test_runs_of_a_long_text(spark, long_texts):
    short, long = long_texts
    q.styled_runs(spark, short).count()
    few, one = (timed(q.styled_runs(spark, d)) for d in long_texts)
    assert one < 6 * few + 3


def test_spans_of_a_long_text(spark, long_texts):
    from sableframe.operators import recognition as r

    short, long = long_texts
    q.chunk_spans(spark, short).count()
    few, one = (timed(q.chunk_spans(spark, d)) for d in long_texts)
    assert one < 6 * few + 3
    docs = spark.createDataFrame([(1, "Anna berry, (12)号 x é Anna"), (2, "b")], "doc_id long, text string")
    spans = [(1, "PERSON", "Anna berry,", 0, 11), (1, "CASE_NUMBER", "12)号", 13, 17), (2, "PERSON", "b", 7, 8), (2, "PERSON", "zz", None, None)]
    found = spark.createDataFrame([(*x, "model", 0.5) for x in spans], r.FOUND)
    assert {tuple(x)[:5] for x in r.validated(found, docs).collect()} == {(1, "PERSON", "Anna berry", 0, 10), (1, "CASE_NUMBER", "(12)号", 12, 17), (2, "PERSON", "b", 0, 1)}


def test_values_and_blocks_are_made_once(spark):
    from sableframe.operators import blocks as b

    made = {x: spark.sparkContext.accumulator(0) for x in ("values", "blocks")}

    def counted(df, seen):
        def run(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch

        return df.mapInPandas(run, df.schema)

    values = spark.createDataFrame([(1, "ORG", "two\nthree"), (1, "NO", "12 3"), (2, "T", "abcdef"), (2, "T", "nowhere")], "doc_id long, type string, value string")
    blocks = spark.createDataFrame([(1, 0, "one two"), (1, 1, "three 123"), (2, 0, "xabc"), (2, 1, "def")], "doc_id long, pos int, text string")
    found = b.located(counted(values, made["values"]), counted(blocks, made["blocks"])).collect()
    assert sorted((x["value"], x["how"], x["pos"]) for x in found) == [("12 3", "spaced", 1), ("abcdef", "cut", 0), ("abcdef", "cut", 1), ("two\nthree", "wrapped", 0), ("two\nthree", "wrapped", 1)]
    assert (made["values"].value, made["blocks"].value) == (4, 4)
