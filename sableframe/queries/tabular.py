"""Redaction and profiling of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masking as m
from ..operators import profile as p
from ..operators import redact as r
from ..sources import sinks

SECRET = "test-secret"


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _hmac(message: str) -> str:
    """The SQL of m.hmac_sha256."""
    key = SECRET.encode().ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in key).hex() for x in (0x36, 0x5C))
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({message}))))"


CUSTOMER = [
    r.Rule("c_custkey", "keep"), r.Rule("c_name", "tokenize", "PERSON"), r.Rule("c_nationkey", "suppress"),
    r.Rule("c_acctbal", "bucket", "AMOUNT"), r.Rule("c_mktsegment", "mask", "ORG"),
]
_BUCKET = """CASE WHEN {x} < 1000 THEN '<1k' WHEN {x} < 10000 THEN '1k-10k' WHEN {x} < 100000 THEN '10k-100k'
  WHEN {x} < 1000000 THEN '100k-1m' ELSE '>=1m' END"""


def redact_customer_policy(spark: SparkSession, d: str) -> DataFrame:
    return r.redact(load(spark, d, "customer"), CUSTOMER, "owner", "customer", SECRET)


def hash_supplier_names(spark: SparkSession, d: str) -> DataFrame:
    rules = [r.Rule("s_name", "hash", "ORG"), r.Rule("s_acctbal", "custom", "AMOUNT", params={"replacement": "#"})]
    return r.redact(load(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), rules, "owner", "supplier", SECRET)


def bucket_amounts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").groupBy(m.bucket(F.col("o_totalprice").cast("string")).alias("bucket")).agg(F.count("*").alias("n"))


def generalize_dates(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd")
    return load(spark, d, "orders").groupBy(m.generalize(day, "DATE").alias("month")).agg(F.count("*").alias("n"))


def profile_customer_columns(spark: SparkSession, d: str) -> DataFrame:
    f = p.column_figures(load(spark, d, "customer"), ["c_custkey"])
    return f.select("column", "n_rows", "n_values", "n_distinct", "n_numbers", "top_kind", "top_votes", F.concat_ws("|", "samples").alias("samples"))


def default_policy_part(spark: SparkSession, d: str) -> DataFrame:
    found = p.profile_table(load(spark, d, "part"), ["p_partkey"])
    return found.select("name", "data_type", "entity_type", "risk", "confidence", "action", F.concat_ws("|", "reasons").alias("reasons"))


def semantic_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """The profile of supplier after a model has found its names to be organisations."""
    supplier = load(spark, d, "supplier")
    profiles = p.profile_table(supplier, ["s_suppkey"])
    samples = profiles.select(F.col("name").alias("column"), F.explode("samples").alias("value"))
    answer = supplier.where("s_suppkey <= 6").select(F.lit("ORG").alias("type"), F.col("s_name").alias("text"))
    answer = answer.union(supplier.where("s_suppkey <= 6").select(F.lit("PERSON"), F.col("s_name")))
    return p.merged_semantic(profiles, p.semantic_types(answer, samples)).select("name", "entity_type", "risk", "confidence", "action", F.concat_ws("|", "reasons").alias("reasons"))


def value_class_votes(spark: SparkSession, d: str) -> DataFrame:
    words = load(spark, d, "documents").select(F.explode(F.split("text", "[ \n]+")).alias("w")).where("w != ''").groupBy("w").agg(F.count("*").alias("n"))
    return words.groupBy(p.value_type(F.col("w")).alias("kind")).agg(F.sum("n").alias("n")).where("kind IS NOT NULL")


def redacted_values_gone(spark: SparkSession, d: str) -> DataFrame:
    before = load(spark, d, "customer")
    return r.still_there(before, redact_customer_policy(spark, d), ["c_name"]).groupBy("column").agg(F.count("*").alias("n"))


def policy_schema_check(spark: SparkSession, d: str) -> DataFrame:
    have, want = load(spark, d, "nation").columns, ["n_name", "n_owner", "n_nationkey"]
    a, b = (F.array(*map(F.lit, x)) for x in (have, want))
    return spark.range(1).select(
        F.array_join(F.array_sort(F.array_except(b, a)), ",").alias("unknown"), F.array_join(F.array_sort(F.array_except(a, b)), ",").alias("missing")
    )


def fictional_ids(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return load(spark, d, "customer").select(
        "c_custkey", m.fictional_id(k).alias("id_card"), m.fictional_phone(k).alias("phone"), m.fictional_card(k).alias("bank_card"), m.fictional_email(k).alias("email")
    )


def part_index(spark: SparkSession, d: str) -> DataFrame:
    parts = sinks.part_numbers(load(spark, d, "lineitem"), [F.col("l_orderkey"), F.col("l_linenumber")], ["l_returnflag"], 5000)
    return parts.groupBy("l_returnflag", "part").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))


def insert_script(spark: SparkSession, d: str) -> DataFrame:
    return sinks.insert_statements(load(spark, d, "nation"), "nation").withColumnRenamed("value", "statement")


def key_diff(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part")
    a = part.where("p_partkey % 3 != 0").select("p_partkey", F.col("p_brand").alias("before"))
    b = part.where("p_partkey % 5 != 0").select("p_partkey", F.when(F.col("p_size") > 40, F.upper("p_type")).otherwise(F.col("p_brand")).alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed").otherwise("same")
    return a.join(b, "p_partkey", "full_outer").groupBy(change.alias("change")).agg(F.count("*").alias("n"))


def dataset_left_joins(spark: SparkSession, d: str) -> DataFrame:
    region, nation, customer = (load(spark, d, t) for t in ("region", "nation", "customer"))
    n = customer.groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return (
        nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
        .join(n, nation.n_nationkey == n.c_nationkey, "left")
        .select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"))
    )


QUERIES = {
    f.__name__: f
    for f in (
        redact_customer_policy, hash_supplier_names, bucket_amounts, generalize_dates, profile_customer_columns, default_policy_part, semantic_overwrite, value_class_votes,
        redacted_values_gone, policy_schema_check, fictional_ids, part_index, insert_script, key_diff, dataset_left_joins,
    )
}

_ID = "'99000019900101' || lpad((c_custkey % 1000)::VARCHAR, 3, '0')"
_CARD = "'999900' || lpad((c_custkey % 1000000000000)::VARCHAR, 12, '0')"
_WEIGHTED = " + ".join(f"substr(i, {k + 1}, 1)::INT * {w}" for k, w in enumerate(m.ID_WEIGHTS))
_LUHN = " + ".join(f"(substr(c, {k + 1}, 1)::INT * 2) // 10 + (substr(c, {k + 1}, 1)::INT * 2) % 10" if k % 2 else f"substr(c, {k + 1}, 1)::INT" for k in range(18))
_KINDS = [(pattern.replace("(?i)", ""), kind, "(?i)" in pattern) for pattern, kind, _, _ in p.VALUE_RULES]
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(§, '{pattern}'{', ' + chr(39) + 'i' + chr(39) if i else ''}) THEN '{kind}'" for pattern, kind, i in _KINDS) + " END"
_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")

def _profile_sql(table: str, key: str, columns: dict[str, str]) -> str:
    """What p.profile_table says of columns whose names aren't technical."""
    names = ", ".join(f"({i}, '{x.replace(chr(39), chr(39) * 2)}', '{t}', {p.RISKS.index(k)}, {c})" for i, (x, t, k, c) in enumerate(p.NAME_RULES))
    kinds = ", ".join(f"('{t}', {p.RISKS.index(k)}, {c})" for _, t, k, c in p.VALUE_RULES)
    actions = " ".join(f"WHEN '{t}' THEN '{a}'" for t, a in p.ACTIONS_BY_TYPE.items())
    blocked = ", ".join(f"'{t}'" for t in sorted(p.NOT_DESCRIPTORS))
    one = " UNION ALL ".join(
        f"""
  SELECT '{c}' AS name, count(*) AS n, count({c}) AS n_values, round(count(DISTINCT trim({c}::VARCHAR)) / greatest(count({c}), 1), 4) AS u, '{kind}' AS data_type,
    (SELECT list({_KIND.replace('§', 'v')} ORDER BY nth) FROM (SELECT {c}::VARCHAR AS v, row_number() OVER (ORDER BY {key}) AS nth FROM {table} WHERE {c} IS NOT NULL) WHERE nth <= 200) AS votes
  FROM {table}"""
        for c, kind in columns.items()
    )
    return f"""
WITH rules(i, pattern, t, r, c) AS (VALUES {names}), kinds(t, r, c) AS (VALUES {kinds}), cols AS ({one}),
v0 AS (SELECT name, k, count(*) AS c, min(nth) AS a, any_value(len(votes)) AS n FROM (SELECT name, votes, unnest(votes) AS k, unnest(range(len(votes))) AS nth FROM cols) WHERE k IS NOT NULL GROUP BY name, k),
top AS (SELECT name, k, c / n AS share FROM v0 QUALIFY row_number() OVER (PARTITION BY name ORDER BY c DESC, a) = 1),
val AS (
  SELECT top.name, top.k AS t, (SELECT r FROM kinds WHERE kinds.t = top.k) AS r,
    round(least(0.99, greatest(share, (SELECT max(kinds.c) FROM kinds JOIN v0 ON v0.k = kinds.t WHERE v0.name = top.name))), 3) AS c
  FROM top WHERE share >= {p.LEAST_SHARE}),
nam AS (SELECT name, t, r, rules.c FROM cols JOIN rules ON regexp_matches(lower(name), pattern) QUALIFY row_number() OVER (PARTITION BY name ORDER BY i) = 1),
sides AS (
  SELECT cols.name, data_type, u, nam.t AS nt, val.t AS vt,
    CASE WHEN nam.t = val.t THEN nam.t WHEN nam.t IS NULL THEN val.t WHEN val.t IS NULL THEN nam.t WHEN round(val.c, 9) >= round(nam.c + {p.NAME_LEAD}, 9) THEN val.t ELSE nam.t END AS t,
    CASE WHEN nam.t = val.t THEN greatest(nam.r, val.r) WHEN nam.t IS NULL THEN val.r WHEN val.t IS NULL THEN nam.r WHEN round(val.c, 9) >= round(nam.c + {p.NAME_LEAD}, 9) THEN val.r ELSE nam.r END AS r,
    CASE WHEN nam.t = val.t THEN greatest(nam.c, val.c) WHEN nam.t IS NULL THEN val.c WHEN val.t IS NULL THEN nam.c WHEN round(val.c, 9) >= round(nam.c + {p.NAME_LEAD}, 9) THEN val.c ELSE nam.c END AS c,
    CASE WHEN nam.t = val.t THEN 'column_name|column_values' WHEN nam.t IS NULL AND val.t IS NULL THEN CASE WHEN u >= 0.98 THEN 'high_cardinality' ELSE '' END
      WHEN nam.t IS NULL THEN 'column_values' WHEN val.t IS NULL THEN 'column_name'
      WHEN round(val.c, 9) >= round(nam.c + {p.NAME_LEAD}, 9) THEN 'column_values|value_overrides_name' ELSE 'column_name|name_overrides_value' END AS reasons
  FROM cols LEFT JOIN nam ON nam.name = cols.name LEFT JOIN val ON val.name = cols.name),
flagged AS (
  SELECT *, regexp_matches(name, '{p.DESCRIPTOR_WORDS.replace("_" + chr(92) + "-" + chr(92) + "s", "_ -")}') AND coalesce(nt NOT IN ({blocked}), true) AND coalesce(vt NOT IN ({blocked}), true) AS descriptor FROM sides)
SELECT name, data_type, CASE WHEN descriptor THEN 'CUSTOM' ELSE coalesce(t, 'CUSTOM') END AS entity_type,
  CASE WHEN descriptor THEN 'low' ELSE ['low', 'medium', 'high', 'critical'][coalesce(r, 0) + 1] END AS risk,
  CASE WHEN descriptor THEN 0.84 ELSE coalesce(c, CASE WHEN u >= 0.98 THEN 0.35 ELSE 0.1 END) END::DOUBLE AS confidence,
  CASE WHEN descriptor THEN 'keep' WHEN t = 'PERSON' THEN CASE WHEN u > 0.5 THEN 'tokenize' ELSE 'mask' END ELSE CASE t {actions} ELSE 'keep' END END AS action,
  CASE WHEN descriptor THEN 'business_descriptor' ELSE reasons END AS reasons, u
FROM flagged"""


_PART = {"p_partkey": "number", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "number", "p_retailprice": "number"}
_SUPPLIER = {"s_suppkey": "number", "s_name": "string", "s_nationkey": "number", "s_acctbal": "number"}
_SAMPLES = " UNION ALL ".join(
    f"""SELECT '{c}' AS name, v FROM (SELECT v, min(nth) AS a FROM (SELECT {c}::VARCHAR AS v, row_number() OVER (ORDER BY s_suppkey) AS nth FROM supplier WHERE {c} IS NOT NULL)
  WHERE nth <= 20 GROUP BY v ORDER BY a LIMIT 8)"""
    for c in _SUPPLIER
)
_DIRECT = ", ".join(f"'{t}'" for t in p.DIRECT_VALUE_TYPES)

SQL = {
    "default_policy_part": f"SELECT * EXCLUDE (u) FROM ({_profile_sql('part', 'p_partkey', _PART)})",
    "semantic_overwrite": f"""
WITH samples AS ({_SAMPLES}), entities AS (SELECT DISTINCT s_name AS t FROM supplier WHERE s_suppkey <= 6),
votes AS (SELECT name, count(DISTINCT t) AS n FROM samples JOIN entities ON contains(v, t) OR (length(t) >= 4 AND contains(t, v)) GROUP BY name),
sure AS (SELECT name, round(least(0.97, greatest(0.72, 0.62 + 0.3 * least(1.0, n / (SELECT count(*) FROM samples s WHERE s.name = votes.name)))), 3) AS s FROM votes),
marked AS (
  SELECT p.*, s, coalesce(s >= CASE entity_type WHEN 'PERSON' THEN {p.SAME_LEAST} WHEN 'CUSTOM' THEN {p.CUSTOM_LEAST} ELSE {p.OTHER_LEAST} END
    AND NOT (contains(reasons, 'column_values') AND entity_type IN ({_DIRECT})), false) AS use
  FROM ({_profile_sql('supplier', 's_suppkey', _SUPPLIER)}) p LEFT JOIN sure USING (name))
SELECT name, CASE WHEN use THEN 'PERSON' ELSE entity_type END AS entity_type, CASE WHEN use THEN 'high' ELSE risk END AS risk,
  CASE WHEN use THEN greatest(s, confidence) ELSE confidence END::DOUBLE AS confidence,
  CASE WHEN use THEN CASE WHEN u > 0.5 THEN 'tokenize' ELSE 'mask' END ELSE action END AS action,
  CASE WHEN use THEN concat_ws('|', nullif(reasons, ''), 'semantic_model', 'semantic_model_value') ELSE reasons END AS reasons
FROM marked""",
    "redact_customer_policy": f"""
SELECT c_custkey, 'PERSON_' || substr({_hmac("'owner:customer:c_name:' || c_name")}, 1, 12) AS c_name, NULL::VARCHAR AS c_nationkey,
  {_BUCKET.format(x='c_acctbal')} AS c_acctbal,
  substr(c_mktsegment, 1, 1) || repeat('*', length(c_mktsegment) - 2) || right(c_mktsegment, 1) AS c_mktsegment
FROM customer""",
    "hash_supplier_names": f"SELECT s_suppkey, substr({_hmac(chr(39) + 'owner:supplier:s_name:' + chr(39) + ' || s_name')}, 1, 24) AS s_name, '#' AS s_acctbal FROM supplier",
    "bucket_amounts": f"SELECT {_BUCKET.format(x='o_totalprice')} AS bucket, count(*) AS n FROM orders GROUP BY 1",
    "generalize_dates": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1",
    "profile_customer_columns": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n_rows, count({c}) AS n_values, count(DISTINCT {c}) AS n_distinct,
  (SELECT count(*) FROM customer WHERE regexp_matches({c}::VARCHAR, '^[+-]?[0-9]+([.][0-9]*)?([eE][+-]?[0-9]+)?$')) AS n_numbers,
  (SELECT k FROM (SELECT {_KIND.replace('§', 'v')} AS k, nth FROM (SELECT {c}::VARCHAR AS v, row_number() OVER (ORDER BY c_custkey) AS nth FROM customer) WHERE nth <= 200) WHERE k IS NOT NULL GROUP BY k ORDER BY count(*) DESC, min(nth) LIMIT 1) AS top_kind,
  (SELECT count(*) FROM (SELECT {_KIND.replace('§', 'v')} AS k FROM (SELECT {c}::VARCHAR AS v, row_number() OVER (ORDER BY c_custkey) AS nth FROM customer) WHERE nth <= 200) WHERE k IS NOT NULL GROUP BY k ORDER BY 1 DESC LIMIT 1) AS top_votes,
  (SELECT string_agg(v, '|' ORDER BY a) FROM (SELECT v, min(nth) AS a FROM (SELECT {c}::VARCHAR AS v, row_number() OVER (ORDER BY c_custkey) AS nth FROM customer) WHERE nth <= 20 GROUP BY v ORDER BY a LIMIT 8)) AS samples
FROM customer"""
        for c in _COLUMNS
    ),
    "value_class_votes": f"""
SELECT kind, count(*) AS n FROM (
  SELECT {_KIND.replace('§', 'w')} AS kind FROM (SELECT unnest(string_split_regex(text, '[ \n]+')) AS w FROM documents) WHERE w != '')
WHERE kind IS NOT NULL GROUP BY 1""",
    "redacted_values_gone": """SELECT 'c_name' AS "column", count(*) AS n FROM customer WHERE c_name LIKE 'PERSON!_%' ESCAPE '!' HAVING count(*) > 0""",
    "policy_schema_check": "SELECT 'n_owner' AS unknown, 'n_regionkey' AS missing",
    "fictional_ids": f"""
SELECT c_custkey, i || substr('{m.ID_CHECKS}', ({_WEIGHTED}) % 11 + 1, 1) AS id_card, '199' || lpad((c_custkey % 100000000)::VARCHAR, 8, '0') AS phone,
  c || ((10 - ({_LUHN}) % 10) % 10)::VARCHAR AS bank_card, 'user' || lpad(c_custkey::VARCHAR, 4, '0') || '@example.com' AS email
FROM (SELECT c_custkey, {_ID} AS i, {_CARD} AS c FROM customer)""",
    "part_index": """
SELECT l_returnflag, part, count(*) AS n, min(l_orderkey) AS first_order FROM (
  SELECT *, ceil(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) / 5000.0)::BIGINT AS part FROM lineitem)
GROUP BY ALL""",
    "insert_script": """
SELECT 'INSERT INTO "nation" ("n_nationkey", "n_name", "n_regionkey") VALUES (''' || n_nationkey || ''', ''' || replace(n_name, '''', '''''') || ''', ''' || n_regionkey || ''');' AS statement
FROM nation""",
    "key_diff": """
SELECT CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' WHEN before IS DISTINCT FROM after THEN 'changed' ELSE 'same' END AS change, count(*) AS n
FROM (SELECT p_partkey, p_brand AS before FROM part WHERE p_partkey % 3 != 0) a
FULL JOIN (SELECT p_partkey, CASE WHEN p_size > 40 THEN upper(p_type) ELSE p_brand END AS after FROM part WHERE p_partkey % 5 != 0) b USING (p_partkey) GROUP BY 1""",
    "dataset_left_joins": """
SELECT n_name, r_name, coalesce(customers, 0) AS customers FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) ON c_nationkey = n_nationkey""",
}
