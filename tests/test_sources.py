"""Readers and writers: round trips, odd inputs, and nothing left behind."""

from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from sableframe.operators import evaluate, jobs, running
from sableframe.plans import table_job
from sableframe.sources import files, sinks


def put(folder, name, data):
    path = folder / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_csv_encodings_and_headers(spark, tmp_path):
    df = files.read_csv(spark, put(tmp_path, "a.csv", "姓名;电话;电话;\n李雷;1;2;3\n".encode("gb18030")))
    assert df.columns == ["姓名", "电话", "电话_2", "column_4"] and rows(df) == [("李雷", "1", "2", "3")]
    df = files.read_csv(spark, put(tmp_path, "b.csv", "\ufeffa,b\n1,\"x\ny\"\n2,z\n"))
    assert df.columns == ["a", "b"] and rows(df) == [("1", "x\ny"), ("2", "z")]


def test_csv_without_open_quotations_is_split(spark, tmp_path):
    path = put(tmp_path, "c.csv", "a,b\n" + "\n".join(f"{i},v{i}" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        df = files.read_csv(spark, path)
        assert df.rdd.getNumPartitions() > 1 and df.agg(F.sum(F.col("a").cast("long"))).first()[0] == sum(range(20_000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_jsonl(spark, tmp_path):
    path = put(tmp_path, "a.jsonl", '{"b": 1, "a": "x"}\n\n7\n{"c": [1, 2], "a": null}\n')
    df = files.read_jsonl(spark, path)
    assert df.columns == ["b", "a", "c", "value"] and rows(df) == [("1", "x", None, None), (None, None, None, "7"), (None, None, "[1,2]", None)]
    assert files.read_jsonl(spark, path, probe_rows=1).columns == ["b", "a", "value"]
    with pytest.raises(ValueError, match="isn't JSON"):
        files.read_jsonl(spark, put(tmp_path, "b.jsonl", '{"a": 1}\n{oops\n'))


def test_sqlite_row_ids_and_tables_without(spark, tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE a (x INTEGER, y TEXT)")
        con.executemany("INSERT INTO a (rowid, x, y) VALUES (?, ?, ?)", [(i, i, f"v{i}") for i in range(-7, 9)])
        con.execute("CREATE TABLE b (x INTEGER PRIMARY KEY, y TEXT) WITHOUT ROWID")
        con.execute("INSERT INTO b VALUES (1, 'one'), (2, 'two')")
        con.execute("CREATE VIEW v AS SELECT x FROM a WHERE x > 0")
        con.execute("CREATE TABLE empty_one (x INTEGER)")
    assert sorted(rows(files.read_sqlite(spark, path, "a", 3))) == [(i, f"v{i}") for i in range(-7, 9)]
    assert sorted(rows(files.read_sqlite(spark, path, "b"))) == [(1, "one"), (2, "two")]
    assert files.read_sqlite(spark, path, "v").count() == 8 and files.read_sqlite(spark, path, "empty_one").count() == 0
    assert files.sqlite_tables(path) == [("a", "table"), ("b", "table"), ("empty_one", "table"), ("v", "view")]


def test_csv_round_trip_and_limits(spark, data, tmp_path):
    customer = spark.read.parquet(f"{data}/customer.parquet").coalesce(1)
    out = str(tmp_path / "out")
    assert sinks.write_csv(customer, out, rows_per_part=40) == {"rows": 150, "columns": 5, "parts": 4}
    part = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbf")
    back = files.read_csv(spark, out)
    assert back.columns == customer.columns and rows(back.orderBy(F.col("c_custkey").cast("int")).select("c_name")) == rows(customer.orderBy("c_custkey").select("c_name"))
    with pytest.raises(FileExistsError):
        sinks.write_csv(customer, out)
    with pytest.raises(ValueError, match="at most 100"):
        sinks.write_csv(customer, str(tmp_path / "no"), max_rows=100)
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_table_job(spark, tmp_path):
    path = put(tmp_path, "t.csv", "customer_name,mobile_phone,order_note\nAnn Lee,13800138000,hello\nBo Chan,13900139000,bye\n")
    summary = table_job.run(spark, path, str(tmp_path / "out"), "owner", "secret")
    assert summary["rows"] == 2 and summary["actions"]["keep"] == 1
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert "138****8000" in text and "hello" in text and "Ann Lee" not in text


def test_running_sums_and_ranks(spark):
    data = [(None if k % 3 == 0 else k % 3, i, (i * 7) % 11) for k in range(3) for i in range(500)]
    df = spark.createDataFrame(data, "g long, i long, v long").repartition(5)
    found = {(r["g"], r["i"]): r["s"] for r in running.running_sum(df, ["g"], [F.col("i")], F.col("v"), "s").collect()}
    for g in (None, 1, 2):
        total = 0
        for i in range(500):
            total += (i * 7) % 11
            assert found[g, i] == total
    ranks = running.ranked(df.where("g = 1"), [], [F.desc("i")], "n").orderBy("n").collect()
    assert [r["n"] for r in ranks] == list(range(1, 501)) and ranks[0]["i"] == 499


def test_volumes_by_a_plain_loop(spark):
    sizes = [(j, i, (i * 37 + j) % 90 + 1) for j in range(3) for i in range(200)]
    found = {(r["job_id"], r["pos"]): r["volume"] for r in jobs.volumes(spark.createDataFrame(sizes, "job_id long, pos long, n_bytes long"), 7, 250).collect()}
    for j in range(3):
        volume, n, b = 0, 0, 0
        for _, i, size in sizes[j * 200 : (j + 1) * 200]:
            if not n or n + 1 > 7 or b + size > 250:
                volume, n, b = volume + 1, 0, 0
            n, b = n + 1, b + size
            assert found[j, i] == volume


def test_percentiles(spark):
    df = spark.createDataFrame([(g, float((i * 31) % 97)) for g in range(2) for i in range(53 + g)], "g long, v double")
    for r in evaluate.percentiles(df, "v", (0.5, 0.95), ("g",)).collect():
        values = sorted(x["v"] for x in df.where(f"g = {r['g']}").collect())
        for name, p in (("p50", 0.5), ("p95", 0.95)):
            at = (len(values) - 1) * p
            low = int(at)
            assert r[name] == pytest.approx(values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low))
