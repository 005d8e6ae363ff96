"""Writers: parts of bounded size, SQL scripts, SQLite files, all or nothing."""

from __future__ import annotations

import sqlite3
import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import quoted_name, sql_literal, trimmed
from ..operators.running import ranked

MAX_ROWS, PART_ROWS = 5_000_000, 50_000


def write_csv(df: DataFrame, path: str, rows_per_part: int = PART_ROWS, max_rows: int = MAX_ROWS) -> dict[str, int]:
    """CSV parts, each with a byte order mark and a header, of at most `rows_per_part` rows.

    Rows are counted while they are written, beside `path`; only a whole table
    within `max_rows` moves there, so an error leaves nothing behind. `parts` counts the files.
    """
    spark, seen = df.sparkSession, Observation()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(path)
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes))
    flat = flat.observe(seen, F.count("*").alias("rows")).withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.writing-{uuid.uuid4().hex[:8]}")
    try:
        flat.write.option("maxRecordsPerFile", rows_per_part).csv(beside.toString(), header=True)
        n = seen.get["rows"]
        if n > max_rows:
            raise ValueError(f"{n} rows; at most {max_rows} can be exported")
        parts = sum(f.getPath().getName().startswith("part-") for f in files.listStatus(beside))
        files.rename(beside, target)
    finally:
        files.delete(beside, True)
    return {"rows": n, "columns": len(df.columns), "parts": parts}


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """(value): one INSERT for each row."""
    names = ", ".join(quoted_name(c) for c in df.columns)
    values = F.concat_ws(", ", *(sql_literal(F.when(F.col(c).isNotNull(), trimmed(F.col(c)))) for c in df.columns))
    return df.select(F.concat(F.lit(f"INSERT INTO {quoted_name(table)} ({names}) VALUES ("), values, F.lit(");")).alias("value"))


def write_sql(df: DataFrame, path: str, table: str) -> None:
    insert_statements(df, table).write.text(path)


def write_sqlite(df: DataFrame, path: str, table: str, batch: int = 1000) -> int:
    """One table of TEXT columns; rows stream through the driver in batches, for deliveries of bounded size."""
    con = sqlite3.connect(path)
    try:
        with con:
            con.execute(f"CREATE TABLE {quoted_name(table)} ({', '.join(f'{quoted_name(c)} TEXT' for c in df.columns)})")
            n, rows = 0, []
            for r in df.select(*(F.col(c).cast("string").alias(c) for c in df.columns)).toLocalIterator():
                rows.append(tuple(r))
                if len(rows) == batch:
                    n += _insert(con, table, rows)
            return n + _insert(con, table, rows)
    finally:
        con.close()


def _insert(con: sqlite3.Connection, table: str, rows: list[tuple]) -> int:
    if rows:
        con.executemany(f"INSERT INTO {quoted_name(table)} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    n = len(rows)
    rows.clear()
    return n


def part_numbers(df: DataFrame, order: list[Column], by: list[str], cap: int = PART_ROWS) -> DataFrame:
    """Adds `part`: rows of each group in order, `cap` to a part, from 1."""
    return ranked(df, by, order, "part").withColumn("part", F.ceil(F.col("part") / cap).cast("long"))


def unique_name(name: str, taken: list[str], short_id: str) -> str:
    """A free name: stem-N-shortid if the name is taken, whatever its case."""
    have = {t.lower() for t in taken}
    if name.lower() not in have:
        return name
    stem, dot, ending = name.rpartition(".")
    stem, ending = (stem, dot + ending) if dot else (name, "")
    return next(x for i in range(2, len(have) + 3) if (x := f"{stem}-{i}-{short_id}{ending}").lower() not in have)
