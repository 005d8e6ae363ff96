"""Lists, lookups and figures: orders stand for files, customers for owners, parts for risks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as c
from .tabular import load


def _files(spark: SparkSession, d: str) -> DataFrame:
    gone = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate"))
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), F.concat(F.lit("owner"), F.col("o_custkey") % 4).alias("owner_id"), F.col("o_orderpriority").alias("source"), gone.alias("deleted_at"), F.col("o_totalprice").alias("size"))


_FILES = "files AS (SELECT o_orderkey AS file_id, 'owner' || (o_custkey % 4) AS owner_id, o_orderpriority AS source, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS deleted_at, o_totalprice AS size FROM orders)"


def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return c.projected_fields(load(spark, d, "events").select("event_id", "props"), "props", ["k", "absent"])


def soft_deleted(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    back = c.restored(files, files.where("file_id % 10 = 0").select("file_id"), "file_id")
    parts = [c.active(files).select(F.lit("active").alias("state"), "size"), c.trash(files).select(F.lit("trash"), "size"), c.trash(back).select(F.lit("trash after restore"), "size")]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("state").agg(F.count("*").alias("n"), F.round(F.sum("size"), 2).alias("size"))


def job_files(spark: SparkSession, d: str) -> DataFrame:
    items = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("job_id"), F.col("l_orderkey").alias("file_id"))
    return c.file_list(_files(spark, d), items, owner="owner1", job="R").select("file_id", "source")


def study_page(spark: SparkSession, d: str) -> DataFrame:
    flags = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("study_id")).agg(F.collect_set("l_returnflag").alias("modalities"), F.count("*").alias("n"))
    rows = flags.withColumn("status", F.when(F.col("n") > 4, "ready").otherwise("open"))
    return c.studies(rows, "ready", "A", [F.col("study_id")], 10, 25).select("study_id", "n", "next_offset")


def _types(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return load(spark, d, "nation").select(F.upper("n_name").alias("type_id"), (F.col("n_regionkey") != 2).alias("enabled"), (k % 5 == 0).alias("custom"), (k % 3 != 0).alias("generic"), F.when(k % 2 == 0, F.lit("[0-9]+")).alias("regex"))


_TYPES = "types AS (SELECT upper(n_name) AS type_id, n_regionkey != 2 AS enabled, n_nationkey % 5 = 0 AS custom, n_nationkey % 3 != 0 AS generic FROM nation)"


def default_types(spark: SparkSession, d: str) -> DataFrame:
    return c.generic_types(_types(spark, d)).select("type_id", F.col("regex").isNotNull().alias("has_regex"))


def requested_types(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation")
    asked = n.select(F.col("n_nationkey").alias("position"), F.concat(F.lit(" "), F.lower("n_name")).alias("asked")).union(n.select(F.col("n_nationkey") + 100, F.upper("n_name"))).union(spark.createDataFrame([(500, "no such type")], "p int, a string"))
    return c.resolved_types(asked, _types(spark, d))


def searched_parts(spark: SparkSession, d: str) -> DataFrame:
    return c.searched(load(spark, d, "part"), "BRAND 1", ["p_name", "p_brand", "p_type"]).select("p_partkey")


def _risks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    severity = F.element_at(F.array(*map(F.lit, c.SEVERITIES)), (k % 5 + 1).cast("int"))
    return load(spark, d, "part").select(F.col("p_brand").alias("code"), F.col("p_type").alias("path"), (k % 7).alias("study"), (k % 3).alias("tag"), severity.alias("severity"), F.when(F.col("p_size") > 20, "open").otherwise("closed").alias("status"), "p_partkey")


_SEVERITY = "['critical', 'high', 'medium', 'low', 'info'][(p_partkey % 5 + 1)::INT]"
_RISKS = f"risks AS (SELECT p_brand AS code, p_type AS path, p_partkey % 7 AS study, p_partkey % 3 AS tag, {_SEVERITY} AS severity, CASE WHEN p_size > 20 THEN 'open' ELSE 'closed' END AS status, p_partkey FROM part)"


def worst_risks(spark: SparkSession, d: str) -> DataFrame:
    return c.by_severity(_risks(spark, d), "p_partkey").limit(30).select("p_partkey", "severity")


def risk_summary(spark: SparkSession, d: str) -> DataFrame:
    """Risks by part type and brand; all duplicates of one agree in severity and status."""
    once = _risks(spark, d).groupBy("code", "path", "study", "tag").agg(F.min("severity").alias("severity"), F.min("status").alias("status"))
    return c.risk_summary(once.union(once))


def oldest_candidates(spark: SparkSession, d: str) -> DataFrame:
    jobs = load(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return c.candidates(jobs, ("O", "P"), 40).select("job_id", "status")


def recognition_queue(spark: SparkSession, d: str) -> DataFrame:
    items = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("priority_class"), F.col("l_quantity").alias("work_units"), F.col("l_linenumber").alias("sort_order"))
    return c.recognition_order(items).select("job_id", "sort_order", "queue_place")


def item_report(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part").where("p_partkey % 9 != 0").select(F.col("p_partkey").alias("file_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"))
    rows = c.report_rows(load(spark, d, "lineitem").select(F.col("l_partkey").alias("file_id"), "l_orderkey"), part)
    return rows.groupBy("kind", "missing").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.countDistinct("name").alias("names"))


def chosen_tables(spark: SparkSession, d: str) -> DataFrame:
    schema = F.when(F.col("n_regionkey") > 0, F.col("n_regionkey").cast("string"))
    found = load(spark, d, "nation").select(schema.alias("schema"), F.col("n_name").alias("name"))
    asked = load(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.when(F.col("n_nationkey") % 4 == 0, schema).alias("schema"), F.col("n_name").alias("table"))
    return c.selected_tables(asked, found)


def risks_to_instances(spark: SparkSession, d: str) -> DataFrame:
    supplier = load(spark, d, "supplier")
    instances = supplier.select(F.col("s_suppkey").alias("instance_id"), F.col("s_name").alias("path"), F.col("s_nationkey").alias("uid"))
    risks = load(spark, d, "customer").select("c_custkey", F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") * 3).cast("string"), 9, "0")).alias("path"), F.col("c_nationkey").alias("uid"))
    return c.risk_instances(risks, instances).select("c_custkey", "instance_id")


def second_scan_leaks(spark: SparkSession, d: str) -> DataFrame:
    names = load(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_name").alias("value"), "c_custkey")
    again = names.where("c_custkey % 3 = 0").select("doc_id", F.concat(F.lit(" "), F.upper("value")).alias("value"))
    return c.rescanned_leaks(names, again, F.upper(F.regexp_replace("value", "[^0-9A-Za-z]+", ""))).select("doc_id", "value")


def tenant_overrides(spark: SparkSession, d: str) -> DataFrame:
    nation = load(spark, d, "nation")
    defaults = nation.where("n_nationkey < 15").select("n_nationkey", F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("pool"))
    own = nation.where("n_nationkey % 2 = 0").select("n_nationkey", F.when(F.col("n_nationkey") % 4 == 0, F.lower("n_name")).alias("name"), F.lit("own").alias("pool"))
    return c.overridden(defaults, own, "n_nationkey")


def reconciled_types(spark: SparkSession, d: str) -> DataFrame:
    nation = load(spark, d, "nation")
    base = nation.where("n_nationkey < 12").select(F.col("n_name").alias("type_id"), F.upper("n_name").alias("name"), F.lit(True).alias("enabled"))
    kind = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("custom_"), F.col("n_name"))).otherwise(F.col("n_name"))
    saved = nation.where("n_nationkey > 5").select(kind.alias("type_id"), F.lit("old").alias("name"), (F.col("n_nationkey") % 2 == 0).alias("enabled"))
    return c.reconciled(base, saved)


def account_types(spark: SparkSession, d: str) -> DataFrame:
    off = load(spark, d, "nation").where("n_regionkey = 1").select(F.upper("n_name").alias("type_id"))
    return c.without_disabled(_types(spark, d), off).select("type_id")


def manual_mapping(spark: SparkSession, d: str) -> DataFrame:
    customer = load(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_name").alias("text"), F.col("c_mktsegment").alias("type"), "c_custkey")
    found = customer.where("c_custkey % 2 = 0").drop("c_custkey")
    return c.merged_entities(found, customer.where("c_custkey % 3 = 0").drop("c_custkey")).groupBy("origin", "type").agg(F.count("*").alias("n"))


def truth_matches(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part")
    truth = part.select(F.col("p_size").alias("doc_id"), F.col("p_brand").alias("value"))
    found = part.select(F.col("p_size").alias("doc_id"), F.col("p_partkey").alias("place"), F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", F.lit("x"), "p_brand", "p_type")).otherwise(F.substring("p_brand", 1, 7)).alias("text"))
    return c.matched_truth(truth, found)


def dates_in_numbers(spark: SparkSession, d: str) -> DataFrame:
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("long")
    spans = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "R", "CASE_NUMBER").when(F.col("l_linenumber") % 2 == 0, "DATE").otherwise("ORG").alias("type"), day.alias("start"), (day + F.when(F.col("l_returnflag") == "R", 60).otherwise(5)).alias("end"))
    return c.dates_outside_numbers(spans).groupBy("type").agg(F.count("*").alias("n"), F.sum("start").alias("days"))


def job_file_types(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("text_only", "image_only", "smart_batch", "other"))), (k % 4 + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, ("txt", "jpg", "pdf", "zip", "scanned_pdf"))), (k % 5 + 1).cast("int"))
    return c.job_takes(load(spark, d, "orders").select(kind.alias("job_type"), ext.alias("file_type"))).groupBy("job_type", "file_type", "allowed").agg(F.count("*").alias("n"))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return load(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("type"), F.when(F.col("event_id") % 3 == 0, "regex").otherwise("model").alias("source"), F.when(F.col("event_id") % 7 != 0, v / 100).alias("confidence"), (F.col("event_id") % 4 != 0).alias("selected"), F.col("event_id").alias("place"), F.concat(F.col("event_type"), F.col("event_id") % 5).alias("text"))


_ENTITIES = "e AS (SELECT user_id AS doc_id, event_type AS type, CASE WHEN event_id % 3 = 0 THEN 'regex' ELSE 'model' END AS source, CASE WHEN event_id % 7 != 0 THEN value / 100 END AS confidence, event_id % 4 != 0 AS selected, event_id AS place, event_type || (event_id % 5) AS text FROM events)"


def redaction_report(spark: SparkSession, d: str) -> DataFrame:
    return c.redaction_report(_entities(spark, d))


def visual_evidence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    boxes = load(spark, d, "events").select(
        F.col("event_type").alias("source"), F.when(k % 2 == 0, "detail").alias("source_detail"), F.lit("page").alias("evidence_source"),
        F.when(k % 5 == 0, F.array(F.lit("small"), F.lit("edge"))).when(k % 3 == 0, F.array(F.lit("edge"))).alias("warnings"), F.when(k % 4 > 0, k % 4 > 1).alias("selected"),
    )
    return c.visual_evidence(boxes)


def file_figures(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("entities"))
    files = load(spark, d, "orders").join(n, "o_orderkey", "left").select((F.col("o_orderstatus") == "F").alias("redacted"), F.coalesce("entities", F.lit(0)).alias("entities"), F.col("o_custkey").alias("size"))
    return c.file_figures(files)


def selected_entities(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d).groupBy(F.col("doc_id").alias("file_id")).agg(F.collect_list(F.struct("selected")).alias("entities"))
    boxes = F.when(F.col("file_id") % 2 == 0, F.array(F.struct(F.lit(None).cast("boolean").alias("selected")), F.struct(F.lit(False).alias("selected"))))
    names = F.when(F.col("file_id") % 3 == 0, F.create_map(F.lit("a"), F.lit("b")))
    return c.selected_counts(e.select("file_id", F.when(F.col("file_id") % 5 != 0, F.col("entities")).alias("entities"), boxes.alias("boxes"), names.alias("map")))


def dropped_labels(spark: SparkSession, d: str) -> DataFrame:
    mapping = load(spark, d, "region").select(F.upper("r_name").alias("label"), F.lit("X").alias("type")).union(spark.createDataFrame([("BUILDING", "ORG"), ("MACHINERY", "ORG")], "label string, type string"))
    return c.drop_figures(load(spark, d, "customer").select(F.col("c_mktsegment").alias("label")), mapping)


def format_matrix(spark: SparkSession, d: str) -> DataFrame:
    cells = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("format"), F.col("l_linestatus").alias("mode"), (F.col("l_quantity") > 10).alias("passed"))
    return c.format_matrix(cells, ["O", "F"])


def coverage_map(spark: SparkSession, d: str) -> DataFrame:
    return c.coverage_map(_entities(spark, d))


def preview_map(spark: SparkSession, d: str) -> DataFrame:
    return c.preview_map(_entities(spark, d).withColumn("replacement", F.concat(F.lit("<"), "type", F.lit("_"), F.col("place").cast("string"), F.lit(">"))))


def coreference_ids(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d).select("doc_id", F.col("place").alias("start"), F.when(F.col("place") % 6 == 0, F.lit("c")).alias("coref"), "text", "type")
    return c.coreference_ids(e).select("doc_id", "start", "coref_id")


def run_versions(spark: SparkSession, d: str) -> DataFrame:
    return c.versions(load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "version")


def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_nationkey").alias("value"), F.col("c_custkey").alias("at"))
    b = load(spark, d, "nation").select(F.col("n_nationkey").alias("value"), F.col("n_nationkey").alias("at"))
    return c.ordered_union([a, b], "value", "at")


def types_to_ask_again(spark: SparkSession, d: str) -> DataFrame:
    got = load(spark, d, "events").groupBy("user_id").agg(F.map_from_entries(F.collect_set(F.struct("event_type", F.lit(1).alias("n")))).alias("answer"))
    asked = F.array(*map(F.lit, ("click", "view", "purchase", "signup", "never")))
    return got.select("user_id", F.array_join(c.missing_types(asked, F.col("answer")), ",").alias("again"))


def imported_pools(spark: SparkSession, d: str) -> DataFrame:
    nation = load(spark, d, "nation").orderBy("n_nationkey")
    pool = lambda rows, tail: rows.groupBy(F.col("n_regionkey").cast("string").alias("type")).agg(F.array_sort(F.collect_list("n_name")).alias("words"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", F.concat("n_name", F.lit(tail)))))).alias("names"))
    out = c.imported_pools(pool(nation.where("n_nationkey % 2 = 0 AND n_regionkey < 4"), "-own"), pool(nation.where("n_nationkey % 3 = 0"), "-new"))
    return out.select("type", F.array_join("words", ",").alias("words"), F.array_join(F.array_sort(F.map_values("names")), ",").alias("names"))


def batch_selection(spark: SparkSession, d: str) -> DataFrame:
    files = load(spark, d, "part").select(F.col("p_partkey").alias("file_id"), F.col("p_brand").alias("name"), F.when(F.col("p_partkey") % 11 == 0, F.lit("x")).alias("deleted_at"), (F.col("p_size") > 5).alias("has_output"))
    asked = load(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("position"), (F.col("l_partkey") + F.when(F.col("l_orderkey") % 50 == 0, 10_000_000).otherwise(0)).alias("file_id"))
    return c.batch_selection(asked, files)


def relocated_entities(spark: SparkSession, d: str) -> DataFrame:
    """The third word of each text as an entity, every other one with an offset that is too large."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    word = F.element_at(F.split("text", " "), 3)
    before = F.char_length(F.substring_index("text", " ", 2)) + 1
    e = docs.where(F.size(F.split("text", " ")) >= 3).select("doc_id", F.lit("W").alias("type"), word.alias("text"), (before + F.col("doc_id") % 2).cast("long").alias("start")).where("text != ''")
    return c.relocated(e, docs).select("doc_id", "text", "start", "end")


def json_cells(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders")
    cells = [("o_orderkey", "bigint"), ("o_orderstatus", "string"), ("o_orderdate", "timestamp")]
    return orders.select("o_orderkey", *(c.cell_to_json(F.col(n), k).alias(f"{n}_json") for n, k in cells))


QUERIES = {
    f.__name__: f
    for f in (
        json_fields, soft_deleted, job_files, study_page, default_types, requested_types, searched_parts, worst_risks, risk_summary, oldest_candidates, recognition_queue,
        item_report, chosen_tables, risks_to_instances, second_scan_leaks, tenant_overrides, reconciled_types, account_types, manual_mapping, truth_matches, dates_in_numbers,
        job_file_types, redaction_report, visual_evidence, file_figures, selected_entities, dropped_labels, format_matrix, coverage_map, preview_map, coreference_ids,
        run_versions, ordered_union, types_to_ask_again, imported_pools, batch_selection, relocated_entities, json_cells,
    )
}

_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END"
_FORM = "upper(regexp_replace({x}, '[^0-9A-Za-z]+', '', 'g'))"

SQL = {
    "json_fields": "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.absent') AS absent FROM events",
    "soft_deleted": f"""WITH {_FILES}
SELECT state, count(*) AS n, round(sum(size), 2) AS size FROM (
  SELECT 'active' AS state, size FROM files WHERE deleted_at IS NULL UNION ALL SELECT 'trash', size FROM files WHERE deleted_at IS NOT NULL
  UNION ALL SELECT 'trash after restore', size FROM files WHERE deleted_at IS NOT NULL AND file_id % 10 != 0) GROUP BY 1""",
    "job_files": f"""WITH {_FILES}
SELECT file_id, source FROM files WHERE deleted_at IS NULL AND owner_id = 'owner1' AND file_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
    "study_page": """
WITH s AS (SELECT l_orderkey AS study_id, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS a FROM lineitem GROUP BY 1 HAVING count(*) > 4 AND a > 0),
p AS (SELECT study_id, n, count(*) OVER () AS all_ FROM s ORDER BY study_id LIMIT 25 OFFSET 10)
SELECT study_id, n, CASE WHEN all_ > 35 THEN 35 END::INT AS next_offset FROM p""",
    "default_types": f"WITH {_TYPES} SELECT type_id, n_nationkey % 2 = 0 AS has_regex FROM types JOIN nation ON upper(n_name) = type_id WHERE enabled AND generic AND NOT custom",
    "requested_types": "SELECT upper(n_name) AS type_id, min(n_nationkey) AS position FROM nation WHERE n_regionkey != 2 GROUP BY 1",
    "searched_parts": "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand') AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), '1')",
    "worst_risks": f"WITH {_RISKS} SELECT p_partkey, severity FROM risks ORDER BY {_RANK}, p_partkey LIMIT 30",
    "risk_summary": f"""WITH {_RISKS},
once AS (SELECT min(severity) AS severity, min(status) AS status FROM risks GROUP BY code, path, study, tag)
SELECT severity, count(*) AS total, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'open' AND severity IN ('critical', 'high')) AS blocking FROM once GROUP BY 1""",
    "oldest_candidates": "SELECT o_orderkey AS job_id, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate, o_orderkey LIMIT 40",
    "recognition_queue": """
SELECT l_orderkey AS job_id, l_linenumber AS sort_order, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, l_quantity, l_linenumber)::INT AS queue_place FROM lineitem""",
    "item_report": """
SELECT coalesce(p_type, 'unknown') AS kind, p_name IS NULL AS missing, count(*) AS n, sum(coalesce(p_size, 0))::BIGINT AS size, count(DISTINCT coalesce(p_name, l_partkey::VARCHAR)) AS names
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 9 != 0) ON p_partkey = l_partkey GROUP BY ALL""",
    "chosen_tables": """
WITH n AS (SELECT n_nationkey AS k, CASE WHEN n_regionkey > 0 THEN n_regionkey::VARCHAR END AS schema, n_name AS name FROM nation)
SELECT schema, name FROM n WHERE k % 2 = 0 AND CASE WHEN k % 4 = 0 THEN schema END IS NOT DISTINCT FROM schema""",
    "risks_to_instances": """
SELECT c_custkey, coalesce((SELECT min(s_suppkey) FROM supplier WHERE s_name = 'Supplier#' || lpad((c_custkey * 3)::VARCHAR, 9, '0')), (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = c_nationkey)) AS instance_id FROM customer""",
    "second_scan_leaks": f"""
SELECT c_nationkey AS doc_id, c_name AS value FROM customer c WHERE EXISTS (
  SELECT 1 FROM customer o WHERE o.c_custkey % 3 = 0 AND o.c_nationkey = c.c_nationkey AND {_FORM.format(x='o.c_name')} = {_FORM.format(x='c.c_name')})""",
    "tenant_overrides": """
WITH d AS (SELECT n_nationkey, n_name AS name, n_regionkey::VARCHAR AS pool FROM nation WHERE n_nationkey < 15),
o AS (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) END AS name, 'own' AS pool FROM nation WHERE n_nationkey % 2 = 0)
SELECT coalesce(d.n_nationkey, o.n_nationkey) AS n_nationkey, coalesce(o.name, d.name) AS name, coalesce(o.pool, d.pool) AS pool,
  CASE WHEN o.pool IS NULL THEN 'default' WHEN d.pool IS NULL THEN 'added' ELSE 'override' END AS origin FROM d FULL JOIN o ON d.n_nationkey = o.n_nationkey""",
    "reconciled_types": """
WITH b AS (SELECT n_name AS type_id, upper(n_name) AS name FROM nation WHERE n_nationkey < 12),
s AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'custom_' || n_name ELSE n_name END AS type_id, n_nationkey % 2 = 0 AS enabled FROM nation WHERE n_nationkey > 5)
SELECT b.type_id, b.name, coalesce(s.enabled, true) AS enabled FROM b LEFT JOIN s ON s.type_id = b.type_id
UNION ALL SELECT type_id, 'old', enabled FROM s WHERE starts_with(type_id, 'custom_') AND type_id NOT IN (SELECT type_id FROM b)""",
    "account_types": "SELECT upper(n_name) AS type_id FROM nation WHERE n_regionkey != 1",
    "manual_mapping": """
WITH f AS (SELECT c_nationkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 2 = 0)
SELECT origin, type, count(*) AS n FROM (
  SELECT 'recognised' AS origin, c_mktsegment AS type FROM f
  UNION ALL SELECT 'manual', c_mktsegment FROM customer c WHERE c_custkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM f WHERE f.c_nationkey = c.c_nationkey AND f.c_name = c.c_name)) GROUP BY ALL""",
    "truth_matches": """
WITH t AS (SELECT DISTINCT p_size AS doc_id, p_brand AS value FROM part),
e AS (SELECT p_size AS doc_id, p_partkey AS place, CASE WHEN p_partkey % 2 = 0 THEN 'x ' || p_brand || ' ' || p_type ELSE substr(p_brand, 1, 7) END AS text FROM part)
SELECT t.doc_id, value, (SELECT arg_min(text, place) FROM e WHERE e.doc_id = t.doc_id AND (contains(text, value) OR (length(text) >= 2 AND contains(value, text)))) AS entity FROM t""",
    "dates_in_numbers": """
WITH s AS (SELECT l_orderkey AS doc_id, CASE WHEN l_returnflag = 'R' THEN 'CASE_NUMBER' WHEN l_linenumber % 2 = 0 THEN 'DATE' ELSE 'ORG' END AS type,
  (l_shipdate::DATE - DATE '1970-01-01')::BIGINT AS a, (l_shipdate::DATE - DATE '1970-01-01')::BIGINT + CASE WHEN l_returnflag = 'R' THEN 60 ELSE 5 END AS b FROM lineitem)
SELECT type, count(*) AS n, sum(a)::BIGINT AS days FROM s WHERE type != 'DATE' OR NOT EXISTS (SELECT 1 FROM s n WHERE n.type = 'CASE_NUMBER' AND n.doc_id = s.doc_id AND s.a >= n.a AND s.b <= n.b) GROUP BY 1""",
    "job_file_types": """
WITH j AS (SELECT ['text_only', 'image_only', 'smart_batch', 'other'][(o_orderkey % 4 + 1)::INT] AS job_type, ['txt', 'jpg', 'pdf', 'zip', 'scanned_pdf'][(o_orderkey % 5 + 1)::INT] AS file_type FROM orders)
SELECT job_type, file_type, CASE job_type WHEN 'text_only' THEN file_type IN ('txt', 'pdf') WHEN 'image_only' THEN file_type IN ('jpg', 'scanned_pdf') WHEN 'smart_batch' THEN file_type != 'zip' ELSE true END AS allowed, count(*) AS n
FROM j GROUP BY ALL""",
    "redaction_report": f"""WITH {_ENTITIES},
x AS (SELECT 'type' AS dimension, type AS value, selected FROM e UNION ALL SELECT 'source', source, selected FROM e
  UNION ALL SELECT 'confidence', CASE WHEN confidence IS NULL THEN 'unmeasured' WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END, selected FROM e)
SELECT dimension, value, count(*) AS n, round(count(*) FILTER (selected) * 100.0::DOUBLE / count(*), 1) AS coverage FROM x GROUP BY ALL""",
    "visual_evidence": """
WITH b AS (SELECT event_type AS s, CASE WHEN event_id % 2 = 0 THEN 'detail' END AS t, CASE WHEN event_id % 5 = 0 THEN ['small', 'edge'] WHEN event_id % 3 = 0 THEN ['edge'] ELSE [] END AS w, coalesce(CASE WHEN event_id % 4 > 0 THEN event_id % 4 > 1 END, true) AS c FROM events),
x AS (SELECT 'all' AS dimension, 'all' AS value, c FROM b UNION ALL SELECT 'source', s, c FROM b UNION ALL SELECT 'source_detail', t, c FROM b UNION ALL SELECT 'evidence_source', 'page', c FROM b UNION ALL SELECT 'warning', unnest(w), c FROM b)
SELECT dimension, value, count(*) AS total, count(*) FILTER (c) AS selected FROM x WHERE value IS NOT NULL GROUP BY ALL""",
    "file_figures": """
WITH f AS (SELECT o_orderstatus = 'F' AS r, coalesce(n, 0) AS n, o_custkey FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT count(*) AS total, count(*) FILTER (r) AS redacted, count(*) FILTER (NOT r AND n > 0) AS awaiting_review, sum(n)::BIGINT AS entities, sum(o_custkey)::BIGINT AS size FROM f""",
    "selected_entities": """
SELECT user_id AS file_id, CASE WHEN user_id % 5 = 0 AND user_id % 2 != 0 THEN CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END
  ELSE CASE WHEN user_id % 5 != 0 THEN count(*) FILTER (event_id % 4 != 0) ELSE 0 END + CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END END::INT AS n_selected FROM events GROUP BY user_id""",
    "dropped_labels": "SELECT c_mktsegment AS label, count(*) AS n, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 0 ELSE count(*) END AS dropped FROM customer GROUP BY 1",
    "format_matrix": """
SELECT l_returnflag AS format, count(*) AS cells, count(*) FILTER (l_quantity > 10) AS n_passed, round(avg((l_quantity > 10)::INT) FILTER (l_linestatus = 'O'), 4) AS "O", round(avg((l_quantity > 10)::INT) FILTER (l_linestatus = 'F'), 4) AS "F"
FROM lineitem GROUP BY 1""",
    "coverage_map": f"""WITH {_ENTITIES}
SELECT doc_id, text, type, selected, place FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, text ORDER BY NOT selected, place) = 1""",
    "preview_map": f"""WITH {_ENTITIES}
SELECT doc_id, text AS original, arg_min('<' || type || '_' || place || '>', place) AS replacement FROM e WHERE selected GROUP BY ALL""",
    "coreference_ids": f"""WITH {_ENTITIES},
k AS (SELECT doc_id, place, CASE WHEN place % 6 = 0 THEN 'c' ELSE text || '|' || type END AS key FROM e),
f AS (SELECT *, min(place) OVER (PARTITION BY doc_id, key) AS first FROM k)
SELECT doc_id, place AS start, 'coref_' || dense_rank() OVER (PARTITION BY doc_id ORDER BY first, key) AS coref_id FROM f""",
    "run_versions": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS version FROM orders",
    "ordered_union": """
WITH x AS (SELECT c_nationkey AS value, 0 AS list, c_custkey AS place FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT n_nationkey, 1, n_nationkey FROM nation)
SELECT value, list, place FROM x QUALIFY row_number() OVER (PARTITION BY value ORDER BY list, place) = 1""",
    "types_to_ask_again": """
WITH g AS (SELECT user_id, list(DISTINCT event_type) AS t FROM events GROUP BY 1)
SELECT user_id, array_to_string(list_filter(['click', 'view', 'purchase', 'signup', 'never'], lambda x: NOT list_contains(t, x)), ',') AS again FROM g""",
    "imported_pools": """
WITH o AS (SELECT n_regionkey::VARCHAR AS type, n_name AS w FROM nation WHERE n_nationkey % 2 = 0 AND n_regionkey < 4), n AS (SELECT n_regionkey::VARCHAR AS type, n_name AS w FROM nation WHERE n_nationkey % 3 = 0),
w AS (SELECT type, w, min(l) AS l FROM (SELECT *, 0 AS l FROM o UNION ALL SELECT *, 1 FROM n) GROUP BY ALL),
m AS (SELECT type, CASE WHEN w IN (SELECT n.w FROM n) THEN w || '-new' ELSE w || '-own' END AS v FROM w)
SELECT type, string_agg(w, ',' ORDER BY l, w) AS words, (SELECT string_agg(v, ',' ORDER BY v) FROM m WHERE m.type = w.type) AS names FROM w GROUP BY type""",
    "batch_selection": """
WITH a AS (SELECT l_partkey + CASE WHEN l_orderkey % 50 = 0 THEN 10000000 ELSE 0 END AS file_id, min(l_orderkey) AS position FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
r AS (SELECT file_id, position, p_brand AS name, CASE WHEN p_partkey IS NULL THEN 'not_found' WHEN p_partkey % 11 = 0 THEN 'deleted' WHEN p_size <= 5 THEN 'no_output' END AS reason FROM a LEFT JOIN part ON p_partkey = file_id),
n AS (SELECT *, row_number() OVER (PARTITION BY name, reason IS NULL ORDER BY position, file_id) AS nth FROM r)
SELECT file_id, position, CASE WHEN reason IS NULL THEN CASE WHEN nth > 1 THEN (nth - 1)::VARCHAR || '_' || name ELSE name END END AS archive_name, reason FROM n""",
    "relocated_entities": """
WITH t AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents), e AS (
  SELECT doc_id, text, w[3] AS word, length(w[1]) + length(w[2]) + 2 + doc_id % 2 AS pos FROM t WHERE len(w) >= 3 AND w[3] != ''),
s AS (SELECT doc_id, word, CASE WHEN substr(text, pos + 1, length(word)) = word THEN pos ELSE instr(text, word) - 1 END::BIGINT AS start FROM e)
SELECT doc_id, word AS text, start, start + length(word) AS "end" FROM s""",
    "json_cells": """
SELECT o_orderkey, '{"v":' || o_orderkey || '}' AS o_orderkey_json, '{"v":"' || o_orderstatus || '"}' AS o_orderstatus_json, '{"v":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '"}' AS o_orderdate_json FROM orders""",
}
