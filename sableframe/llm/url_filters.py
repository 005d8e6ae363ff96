"""URL filters: dated list entries as validity intervals, joined as of fetch time.

A list is a table of dated events (key, day, seq, listed). Of several events of
a key on one day the last by `seq` counts. Events become intervals [valid_from,
valid_to) in which the key is listed. A key is a domain, which covers its
subdomains, or a host with the first part of a path ("host/part"). A capture is
blocked if any of its keys is listed on the day of its fetch.

Captures are first reduced to distinct (host, part, day), so a host with a
third of all captures is evaluated once a day and not once a capture; verdicts
go back to the captures by the same three columns. Captures without a readable
host, null URLs among them, have no keys and aren't blocked. Captures without
a day match nothing. Repeated captures get the same verdict, each of them; an
empty list blocks nothing. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PART = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"
FIRST_DAY = "2024-01-01"


def host_of(url: Column) -> Column:
    """Lower case, without user, port and a dot at the end; null if there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", ""), F.lit(""))


def part_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, PART, 1), F.lit(""))


def keys_of(host: Column, part: Column) -> Column:
    """The host, its parent domains of two labels or more, and the host with the path's first part."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), ".")
    )
    return F.when(part.isNull(), domains).otherwise(F.concat(domains, F.array(F.concat_ws("/", host, part))))


def intervals(events: DataFrame) -> DataFrame:
    """(key, valid_from, valid_to) while a key is listed; valid_to is null for the last."""
    of_day = Window.partitionBy("key", "day").orderBy(F.desc("seq"), "listed")
    of_key = Window.partitionBy("key").orderBy("day")
    return (
        events.where(F.col("key").isNotNull() & F.col("day").isNotNull())
        .withColumn("nth", F.row_number().over(of_day))
        .where("nth = 1")
        .select("key", "listed", F.col("day").alias("valid_from"), F.lead("day").over(of_key).alias("valid_to"))
        .where("listed")
        .drop("listed")
    )


def evaluate(captures: DataFrame, events: DataFrame) -> DataFrame:
    """capture_id, host, day, n_active, blocked, key and valid_from of the most specific active entry.

    `captures` has capture_id, url and day.
    """
    seen = captures.select("capture_id", "day", host_of(F.col("url")).alias("host"), part_of(F.col("url")).alias("part"))
    asked = seen.select("host", "part", "day").where(F.col("host").isNotNull() & F.col("day").isNotNull()).distinct()
    asked = asked.withColumn("key", F.explode(keys_of(F.col("host"), F.col("part"))))
    # Intervals meet each key and day once, however many hosts lie below the key.
    days = asked.select("key", "day").distinct()
    listed = days.join(intervals(events), "key").where((F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))))
    active = asked.join(listed.drop("valid_to"), ["key", "day"])
    verdicts = active.groupBy("host", "part", "day").agg(
        F.count("*").alias("n"), F.max(F.struct(F.char_length("key").alias("size"), "key", "valid_from")).alias("best")
    )
    verdicts = verdicts.withColumnsRenamed({c: f"of_{c}" for c in ("host", "part", "day")})
    # Captures without a host match nothing; a key of their own keeps them from meeting in one task.
    seen = seen.withColumn("site", F.coalesce("host", F.concat(F.lit(" "), F.xxhash64("capture_id", "day").cast("string"))))
    same = [F.col("site") == F.col("of_host"), F.col("part").eqNullSafe(F.col("of_part")), F.col("day").eqNullSafe(F.col("of_day"))]
    return seen.join(verdicts, same, "left").select(
        "capture_id",
        "host",
        "day",
        F.coalesce("n", F.lit(0)).alias("n_active"),
        F.col("n").isNotNull().alias("blocked"),
        F.col("best.key").alias("key"),
        F.col("best.valid_from").alias("valid_from"),
    )


# -- the query --------------------------------------------------------------


def _number(text: Column) -> Column:
    """The first 32 bits of an MD5, the same in any SQL."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages have no fetch date; one of 2024 follows from the page's id."""
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (_number(F.col("page_id").cast("string")) % 366).cast("int"))
    return pages.select(F.col("page_id").alias("capture_id"), "url", day.alias("day"))


def list_of(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' own keys: one in four is listed, struck off and listed again."""
    keys = pages.select(host_of(F.col("url")).alias("host"), part_of(F.col("url")).alias("part")).where("host IS NOT NULL").distinct()
    keys = keys.select(F.explode(keys_of(F.col("host"), F.col("part"))).alias("key")).distinct().withColumn("h", _number(F.col("key"))).where("h % 4 = 0")
    start = F.lit(FIRST_DAY).cast("date")
    dated = [(F.col("h") % 240, True), (F.col("h") % 240 + 20 + F.col("h") % 40, False), (F.col("h") % 240 + 90, True)]
    return keys.select(
        "key",
        F.explode(
            F.array(*(F.struct(F.date_add(start, d.cast("int")).alias("day"), F.lit(i).alias("seq"), F.lit(x).alias("listed")) for i, (d, x) in enumerate(dated)))
        ).alias("e"),
    ).select("key", "e.*")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return evaluate(captures_of(pages), list_of(pages)).withColumnRenamed("capture_id", "page_id")


_KEYS = """CASE WHEN part IS NULL THEN domains ELSE list_append(domains, host || '/' || part) END"""
ORACLE = f"""
WITH seen AS (
  SELECT page_id,
    DATE '{FIRST_DAY}' + (('0x' || substr(md5(page_id::VARCHAR), 1, 8))::UBIGINT % 366)::INTEGER AS day,
    nullif(regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '\\.$', ''), '') AS host,
    nullif(regexp_extract(url, '{PART}', 1), '') AS part
  FROM pages),
places AS (
  SELECT DISTINCT host, part, list_transform(range(1, greatest(len(l) - 1, 1) + 1), lambda i: array_to_string(l[i:], '.')) AS domains
  FROM (SELECT host, part, string_split(host, '.') AS l FROM seen WHERE host IS NOT NULL)),
keyed AS (SELECT host, part, unnest({_KEYS}) AS key FROM places),
listed AS (SELECT key, h FROM (SELECT DISTINCT key, ('0x' || substr(md5(key), 1, 8))::UBIGINT::BIGINT AS h FROM keyed) WHERE h % 4 = 0),
events AS (
  SELECT key, (DATE '{FIRST_DAY}' + (h % 240)::INTEGER) AS day, 0 AS seq, true AS on_list FROM listed
  UNION ALL SELECT key, (DATE '{FIRST_DAY}' + (h % 240 + 20 + h % 40)::INTEGER), 1, false FROM listed
  UNION ALL SELECT key, (DATE '{FIRST_DAY}' + (h % 240 + 90)::INTEGER), 2, true FROM listed),
last AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY key, day ORDER BY seq DESC) = 1),
found AS (
  SELECT s.page_id, s.day, e.key, e.day AS valid_from, e.on_list
  FROM seen s JOIN keyed k ON k.host = s.host AND k.part IS NOT DISTINCT FROM s.part
  ASOF JOIN last e ON e.key = k.key AND s.day >= e.day),
best AS (
  SELECT page_id, count(*) AS n, max(length(key)) AS size FROM found WHERE on_list GROUP BY page_id),
top AS (
  SELECT a.page_id, max(a.key) AS key FROM found a JOIN best b ON a.page_id = b.page_id AND length(a.key) = b.size WHERE on_list GROUP BY a.page_id),
chosen AS (SELECT t.page_id, t.key, max(a.valid_from) AS valid_from FROM top t JOIN found a ON a.page_id = t.page_id AND a.key = t.key WHERE on_list GROUP BY ALL)
SELECT s.page_id, s.host, s.day, coalesce(b.n, 0)::BIGINT AS n_active, b.n IS NOT NULL AS blocked, chosen.key, chosen.valid_from
FROM seen s LEFT JOIN best b ON b.page_id = s.page_id LEFT JOIN chosen ON chosen.page_id = s.page_id
"""
