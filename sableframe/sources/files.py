"""Files and databases as DataFrames."""

from __future__ import annotations

import ipaddress
import sqlite3
import uuid
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import html_text, rtf_text

KINDS = {".csv": "csv", ".xlsx": "xlsx", ".jsonl": "jsonl", ".db": "sqlite", ".sqlite": "sqlite"}
#: Encodings tried in order.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "gbk", "latin-1")
SYSTEM_SCHEMAS = {"information_schema", "pg_catalog", "mysql", "performance_schema", "sys"}


def kind_of(name: str) -> str:
    ending = name[name.rfind(".") :].lower() if "." in name else ""
    if ending not in KINDS:
        raise ValueError(f"{name}: one of {', '.join(sorted(KINDS))} is expected")
    return KINDS[ending]


def column_names(names: list[str | None]) -> list[str]:
    """Trimmed; blank ones become column_i, repeated ones name_k."""
    out, seen = [], {}
    for i, n in enumerate(names, 1):
        n = (n or "").strip() or f"column_{i}"
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def _head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file, or of a folder's first file, in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getFileStatus(place).isDirectory():
        inside = sorted((f.getPath() for f in files.listStatus(place) if f.isFile() and not f.getPath().getName().startswith(("_", "."))), key=lambda p: p.getName())
        if not inside:
            return b""
        place = inside[0]
    stream = files.open(place)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def encoding_of(head: bytes) -> str:
    for name in ENCODINGS:
        for cut in range(4):  # the last character may be cut
            try:
                head[: len(head) - cut].decode(name)
                return name
            except UnicodeDecodeError:
                continue
    return "latin-1"


def separator_of(line: str) -> str:
    return max(",;\t|", key=lambda c: (line.count(c), c == ","))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings by position; duplicate and blank headers get names of their own.

    A file is split among tasks unless a line has an open quotation, which only a
    value with a line end in it leaves.
    """
    head = _head(spark, path, 8192)
    encoding = encoding_of(head)
    sep = separator_of(head.decode(encoding, "replace").split("\n", 1)[0])
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    several = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    # Spark reads few encodings itself. In the others a separator, a quotation mark or a line end is the one
    # byte it is in ASCII, so the bytes are read as Latin letters and decoded value by value.
    plain = encoding.startswith("utf-8")
    options = {"sep": sep, "encoding": "UTF-8" if plain else "ISO-8859-1", "multiLine": several, "escape": '"', "inferSchema": False, "enforceSchema": True}
    first = spark.read.options(**options, header=False).csv(path).limit(1).collect()
    header = [x if plain or x is None else x.encode("latin-1").decode(encoding, "replace") for x in first[0]] if first else []
    names = column_names([(x or "").lstrip("\ufeff") for x in header]) or ["column_1"]
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    df = spark.read.options(**options, header=True).schema(schema).csv(path)
    if plain or encoding == "latin-1":
        return df
    decoded = F.pandas_udf(lambda v: v.str.encode("latin-1").str.decode(encoding, "replace"), "string")
    return df.select(*(decoded(F.col(f"`{n}`")).alias(n) for n in names))


def read_jsonl(spark: SparkSession, path: str, probe_rows: int | None = None) -> DataFrame:
    """Columns in the order in which their keys first appear; other values than objects go to `value`, blank lines are skipped.

    All keys of the file count, also those that appear late, unless `probe_rows`
    names how many lines set the columns. A line that isn't JSON is an error.
    """
    lines = spark.read.text(path).where("trim(value) != ''").withColumn("at", F.monotonically_increasing_id())
    bad = lines.where(F.try_parse_json("value").isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"{path}: a line isn't JSON: {bad[0]['value'][:80]!r}")
    tree = lines.select("at", F.try_parse_json("value").alias("j"), "value")
    obj = F.schema_of_variant("j").startswith("OBJECT")
    probe = lines.limit(probe_rows) if probe_rows else lines
    keys = probe.select("at", F.posexplode(F.json_object_keys("value")).alias("k", "key"))
    order = [r["key"] for r in keys.groupBy("key").agg(F.min(F.struct("at", "k")).alias("first")).orderBy("first").collect()]
    scalars = tree.where(~obj).limit(1).count() > 0
    as_object = F.when(obj, F.col("value")).otherwise(F.to_json(F.struct(F.col("j").try_cast("string").alias("value"))))
    names = order + (["value"] if scalars and "value" not in order else [])
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    return tree.select(F.from_json(as_object, schema).alias("r")).select("r.*")


class SqliteSource(DataSource):
    """Tables of a SQLite file that all executors can open; options: path, table. Row ids are dealt into ranges, one for each partition."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def schema(self) -> str:
        with sqlite3.connect(self.options["path"]) as con:
            rows = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        kinds = {"INTEGER": "long", "INT": "long", "REAL": "double", "FLOAT": "double"}
        return ", ".join(f"`{r[1]}` {kinds.get(r[2].upper(), 'string')}" for r in rows)

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options)


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", 4))

    def partitions(self) -> list[InputPartition]:
        """Ranges of row ids between the least and the greatest; one part for what has no row ids."""
        with sqlite3.connect(self.path) as con:
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a view, or a table WITHOUT ROWID
                return [InputPartition(None)]
        if not isinstance(low, int):
            return [InputPartition(None)]
        step = -(-(high - low + 1) // self.parts)
        return [InputPartition((a, min(a + step - 1, high))) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with sqlite3.connect(self.path) as con:
            table = _quoted(self.table)
            if partition.value is None:
                yield from con.execute(f"SELECT * FROM {table}")
            else:
                yield from con.execute(f"SELECT * FROM {table} WHERE rowid BETWEEN ? AND ?", partition.value)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sqlite_tables(path: str) -> list[tuple[str, str]]:
    """(name, type) of tables and views, by name, without the system's own."""
    with sqlite3.connect(path) as con:
        return con.execute("SELECT name, type FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall()


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_file").options(path=path, table=table, partitions=partitions).load()


def read_xlsx(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """A sheet as strings, if the optional reader for the format is installed."""
    try:
        import openpyxl
    except ImportError as e:
        raise RuntimeError("reading xlsx needs openpyxl") from e
    rows = list(openpyxl.load_workbook(path, read_only=True, data_only=True)[sheet].iter_rows(values_only=True))
    names = column_names([None if x is None else str(x) for x in rows[0]])
    data = [tuple(None if x is None else str(x) for x in r) for r in rows[1:] if any(x is not None for x in r)]
    return spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names))


def jdbc_url(kind: str, host: str, port: int, database: str, allowed: list[str]) -> str:
    """Only hosts, addresses or networks on the list may be read."""

    def fits(rule: str) -> bool:
        if rule == host:
            return True
        try:
            return ipaddress.ip_address(host) in ipaddress.ip_network(rule, strict=False)
        except ValueError:
            return False

    if not any(map(fits, allowed)):
        raise PermissionError(f"host not allowed: {host}")
    if kind not in ("mysql", "postgresql"):
        raise ValueError(f"unknown kind of database: {kind}")
    return f"jdbc:{kind}://{host}:{port}/{quote(database)}"


def read_jdbc(spark: SparkSession, url: str, table: str, user: str, password: str, split_by: str | None = None, bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """A database table in partitions; limits, columns and filters are pushed to it."""
    options = {"url": url, "dbtable": table, "user": user, "password": password, "fetchsize": 1000}
    if split_by and bounds:
        options |= {"partitionColumn": split_by, "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": bounds[2]}
    return spark.read.format("jdbc").options(**options).load()


def dataset_id(connection: str, schema: str, table: str, kind: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{connection}:{schema}:{table}:{kind}"))


def read(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """Any supported file; a count, which is a second pass, is left to the caller."""
    kind = kind_of(path)
    if kind in ("sqlite", "xlsx"):
        return (read_sqlite if kind == "sqlite" else read_xlsx)(spark, path, table or "")
    return (read_csv if kind == "csv" else read_jsonl)(spark, path)


# -- texts ------------------------------------------------------------------


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of txt, md, html and rtf files in a folder, whatever their encoding of the usual ones."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    text = F.coalesce(F.try_validate_utf8(F.decode(F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content")), "UTF-8")), F.decode("content", "ISO-8859-1"))
    name = F.lower("path")
    parsed = F.when(name.rlike(r"\.html?$"), html_text(text)).when(name.endswith(".rtf"), rtf_text(text)).otherwise(text)
    return raw.select("path", parsed.alias("text"), F.sha2("content", 256).alias("sha256"))


def scanned(pages: DataFrame, least_chars: int = 100, least_cover: float = 0.9) -> DataFrame:
    """(doc_id, is_scanned): most pages are images, or have broken text, or little text on average."""
    from ..functions.text import fragmented

    full, broken = F.count_if(F.col("image_cover") >= least_cover), F.count_if(fragmented(F.col("text")))
    n = F.count("*")
    return pages.groupBy("doc_id").agg(((full * 2 > n) | (broken * 2 > n) | (F.sum(F.char_length("text")) < n * least_chars)).alias("is_scanned"))


def audit_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Events of an audit log's lines; those that aren't JSON are left out."""
    schema = "timestamp string, action string, resource_type string, resource_id string, user string, detail string"
    parsed = F.when(F.try_parse_json(value).isNotNull(), F.from_json(value, schema))
    return lines.select(parsed.alias("e")).where("e IS NOT NULL").select("e.*").orderBy(F.desc("timestamp"))


def labelled_spans(lines: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(id, type, value) of lines {id, text, label: {name: {value: [[a, b]]}}}; unknown names are dropped."""
    names = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    parsed = lines.select(F.from_json("value", "id long, text string, label map<string, map<string, array<array<long>>>>").alias("r")).select("r.*")
    by_name = parsed.select("id", F.explode("label").alias("name", "values")).select("id", F.try_element_at(names, F.col("name")).alias("type"), F.explode(F.map_keys("values")).alias("value"))
    return by_name.where("type IS NOT NULL")


def seeded_sample(df: DataFrame, key: Column, n: int, seed: int = 0) -> DataFrame:
    """The same n rows each time, spread by a hash."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
