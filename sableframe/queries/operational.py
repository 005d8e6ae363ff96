"""Jobs, files, audit events: orders stand for jobs, line items for their items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as v
from ..operators import jobs as j
from .tabular import load


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    status = F.when(s == "F", "completed").when(s == "P", "awaiting_review").when(F.col("o_orderkey") % 7 == 0, "failed").otherwise("processing")
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderpriority").alias("job_type"), F.col("o_custkey").alias("owner_id"), "o_orderdate", "o_totalprice")


def _items(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("l_returnflag")
    status = F.when(f == "R", "failed").when(f == "A", "completed").when(F.col("l_linenumber") == 1, "awaiting_review").when(F.col("l_linenumber") == 2, "pending").otherwise("completed")
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber", status.alias("status"))


_JOBS = """jobs AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'awaiting_review'
  WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'processing' END AS status, o_orderpriority AS job_type, o_custkey AS owner_id, o_orderdate, o_totalprice FROM orders)"""
_ITEMS = """items AS (SELECT l_orderkey AS job_id, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'completed'
  WHEN l_linenumber = 1 THEN 'awaiting_review' WHEN l_linenumber = 2 THEN 'pending' ELSE 'completed' END AS status FROM lineitem)"""


def job_stats(spark: SparkSession, d: str) -> DataFrame:
    return j.job_stats(_jobs(spark, d), _items(spark, d))


def progress_pivot(spark: SparkSession, d: str) -> DataFrame:
    return j.progress(_items(spark, d))


def derived_job_status(spark: SparkSession, d: str) -> DataFrame:
    return j.derived_status(_items(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


def derived_job_status_simple(spark: SparkSession, d: str) -> DataFrame:
    return j.derived_status_simple(_items(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


def latest_status(spark: SparkSession, d: str) -> DataFrame:
    return j.latest(load(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"])


def owner_counts_json(spark: SparkSession, d: str) -> DataFrame:
    owner = F.coalesce(F.nullif(F.get_json_object("props", "$.k"), F.lit("")), F.lit("nobody"))
    return load(spark, d, "events").groupBy(owner.alias("owner")).agg(F.count("*").alias("n"))


def paged_list(spark: SparkSession, d: str) -> DataFrame:
    return j.page(j.filtered_jobs(_jobs(spark, d), status="active"), [F.desc("o_orderdate"), F.col("job_id")], 3, 50).select("job_id", "status", "job_type")


def grouped_sort(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderdate").cast("date").alias("created_at"), "o_orderkey")
    return j.newest_groups_first(rows)


def trash_retention(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return j.expired(rows, F.lit("1998-08-01").cast("timestamp"), 400).groupBy().agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


def stale_items(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("updated_at"))
    rows = last.select("user_id", F.lit("processing").alias("status"), F.lit(None).cast("timestamp").alias("progress_updated_at"), "updated_at")
    top = e.agg(F.max(F.col("ts").cast("timestamp")).alias("top"))
    return j.stale(rows.crossJoin(F.broadcast(top)), F.col("top") - F.expr("INTERVAL 1 HOUR")).select("user_id")  # top is one row


def transition_violations(spark: SparkSession, d: str) -> DataFrame:
    """Line items in order as the history of their order's state; line numbers repeat, so the status settles ties."""
    history = _items(spark, d).select(F.col("job_id").alias("id"), F.struct("l_linenumber", "status").alias("seq"), "status")
    return j.illegal_moves(history, j.ITEM_MOVES).groupBy("before", "status").agg(F.count("*").alias("n"))


def repaired_items(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d).withColumn("has_entities", F.col("l_linenumber") % 2 == 0).withColumn("has_output", F.col("l_linenumber") % 3 != 0)
    return j.repaired(rows).groupBy("status").agg(F.count("*").alias("n"))


def delivery_report(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_linenumber")
    rows = _items(spark, d).select("status", (k % 3 != 0).alias("has_output"), F.when(k == 5, "unsafe_path").alias("skip_reason"), (F.col("status") == "completed").alias("confirmed"), (k < 6).alias("selected"))
    return j.delivery_summary(j.blocking_reasons(rows))


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    nation = load(spark, d, "nation").select("n_nationkey", "n_name")
    new = nation.where("n_nationkey >= 20").select((F.col("n_nationkey") + 3).cast("int").alias("n_nationkey"), F.lower("n_name").alias("n_name"))
    return j.upserted(nation, new, "n_nationkey")


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = load(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("owner_id"))
    return j.without_keys(_jobs(spark, d), gone, "owner_id").groupBy("status").agg(F.count("*").alias("n"))


def audit_search(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").select("event_id", F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("user"), "props")
    return j.audit_search(rows, action="CLICK", q='"user":"1').select("event_id")


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = v.percentiles(load(spark, d, "events"), "value", by=("event_type",))
    return p.select("event_type", *(F.round(c, 6).alias(c) for c in ("mean", "max", "total", "p50", "p95", "p99")))


def volume_packing(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select(F.col("source").alias("job_id"), F.col("doc_id").alias("pos"), F.col("n_chars").alias("n_bytes"))
    return j.volumes(rows, 8, 20_000).groupBy("job_id", "volume").agg(F.count("*").alias("files"), F.min("pos").alias("first"))


def archive_names(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.concat("p_brand", F.lit(".txt")).alias("name"))
    return j.archive_names(rows).select("pos", "archive_name")


QUERIES = {
    f.__name__: f
    for f in (
        job_stats, progress_pivot, derived_job_status, derived_job_status_simple, latest_status, owner_counts_json, paged_list, grouped_sort, trash_retention, stale_items,
        transition_violations, repaired_items, delivery_report, upsert_latest, cascade_delete, audit_search, latency_percentiles, volume_packing, archive_names,
    )
}


def _in(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in names) + ")"


_LEGAL = " OR ".join(f"(before = '{a}' AND status IN {_in(b)})" for a, b in j.ITEM_MOVES.items() if b)
SQL = {
    "job_stats": f"""WITH {_JOBS}, {_ITEMS}
SELECT * FROM (SELECT count(*) AS total_jobs, count(*) FILTER (status = 'draft') AS draft_jobs, count(*) FILTER (status IN {_in(j.ACTIVE_JOBS)}) AS active_jobs,
  count(*) FILTER (status = 'awaiting_review') AS awaiting_review_jobs, count(*) FILTER (status = 'completed') AS completed_jobs, count(*) FILTER (status IN {_in(j.RISK)}) AS risk_jobs FROM jobs),
 (SELECT count(*) AS total_items, count(*) FILTER (status IN {_in(j.ACTIVE_ITEMS)}) AS active_items, count(*) FILTER (status IN {_in(j.REVIEW_ITEMS)}) AS awaiting_review_items,
  count(*) FILTER (status = 'completed') AS completed_items, count(*) FILTER (status IN {_in(j.RISK)}) AS risk_items FROM items WHERE job_id IN (SELECT job_id FROM jobs))""",
    "progress_pivot": f"WITH {_ITEMS} SELECT job_id, {', '.join(f'count(*) FILTER (status = {chr(39)}{s}{chr(39)}) AS {s}' for s in j.ITEM_STATES)}, count(*) AS total FROM items GROUP BY 1",
    "derived_job_status": f"""WITH {_ITEMS}, s AS (SELECT job_id, list_distinct(list(status)) AS l FROM items GROUP BY 1)
SELECT CASE WHEN list_contains(l, 'processing') THEN 'processing' WHEN list_contains(l, 'pending') THEN 'queued' WHEN l = ['completed'] THEN 'completed'
  WHEN l = ['failed'] THEN 'failed' WHEN list_contains(l, 'awaiting_review') THEN 'awaiting_review' ELSE 'completed' END AS status, count(*) AS n FROM s GROUP BY 1""",
    "derived_job_status_simple": f"""WITH {_ITEMS}, s AS (SELECT job_id, list_distinct(list(status)) AS l FROM items GROUP BY 1)
SELECT CASE WHEN list_has_any(l, ['processing', 'pending']) THEN 'processing' WHEN list_contains(l, 'failed') THEN 'failed'
  WHEN list_contains(l, 'awaiting_review') THEN 'awaiting_review' ELSE 'completed' END AS status, count(*) AS n FROM s GROUP BY 1""",
    "latest_status": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "owner_counts_json": "SELECT coalesce(nullif(json_extract_string(props, '$.k'), ''), 'nobody') AS owner, count(*) AS n FROM events GROUP BY 1",
    "paged_list": f"WITH {_JOBS} SELECT job_id, status, job_type FROM jobs WHERE status IN {_in(j.ACTIVE_JOBS)} ORDER BY o_orderdate DESC, job_id LIMIT 50 OFFSET 100",
    "grouped_sort": "SELECT o_custkey AS group_id, o_orderdate::DATE AS created_at, o_orderkey, max(o_orderdate::DATE) OVER (PARTITION BY o_custkey) AS group_newest FROM orders",
    "trash_retention": "SELECT count(*) AS n, max(o_orderkey) AS last FROM orders WHERE o_orderdate < TIMESTAMP '1998-08-01' - INTERVAL 400 DAY",
    "stale_items": "SELECT user_id FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
    "transition_violations": f"""WITH {_ITEMS}, h AS (SELECT status, lag(status) OVER (PARTITION BY job_id ORDER BY l_linenumber, status) AS before FROM items)
SELECT before, status, count(*) AS n FROM h WHERE before IS NOT NULL AND before != status AND NOT ({_LEGAL}) GROUP BY ALL""",
    "repaired_items": f"""WITH {_ITEMS}
SELECT CASE WHEN status = 'processing' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'awaiting_review' ELSE 'pending' END WHEN status = 'completed' AND l_linenumber % 3 = 0 THEN 'awaiting_review'
  WHEN status = 'failed' AND l_linenumber % 3 != 0 THEN 'completed' ELSE status END AS status, count(*) AS n FROM items GROUP BY 1""",
    "delivery_report": f"""WITH {_ITEMS}, r AS (SELECT l_linenumber < 6 AS sel, l_linenumber % 3 != 0 AS has_out, status = 'completed' AND l_linenumber % 3 != 0 AND l_linenumber != 5 AS ok FROM items)
SELECT count(*) AS total, count(*) FILTER (sel) AS n_selected, count(*) FILTER (sel AND ok) AS included, count(*) FILTER (sel AND NOT ok) AS action_required, count(*) FILTER (has_out) AS with_output,
  CASE WHEN count(*) FILTER (sel) = 0 THEN 'no_selection' WHEN count(*) FILTER (sel AND NOT ok) = 0 THEN 'ready_for_delivery' ELSE 'action_required' END AS status FROM r""",
    "upsert_latest": """WITH new AS (SELECT n_nationkey + 3 AS n_nationkey, lower(n_name) AS n_name FROM nation WHERE n_nationkey >= 20)
SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM new) UNION ALL SELECT * FROM new""",
    "cascade_delete": f"WITH {_JOBS} SELECT status, count(*) AS n FROM jobs WHERE owner_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1",
    "audit_search": "SELECT event_id FROM events WHERE lower(event_type) = 'click' AND starts_with(user_id::VARCHAR, '1')",
    "latency_percentiles": """SELECT event_type, round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(sum(value), 6) AS total, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""",
    "volume_packing": """WITH RECURSIVE o AS (SELECT source AS job_id, doc_id AS pos, n_chars AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
r AS (SELECT job_id, pos, i, 1::BIGINT AS volume, 1 AS n, b AS total FROM o WHERE i = 1
  UNION ALL SELECT o.job_id, o.pos, o.i, CASE WHEN r.n + 1 > 8 OR r.total + o.b > 20000 THEN r.volume + 1 ELSE r.volume END,
    CASE WHEN r.n + 1 > 8 OR r.total + o.b > 20000 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n + 1 > 8 OR r.total + o.b > 20000 THEN o.b ELSE r.total + o.b END
  FROM r JOIN o ON o.job_id = r.job_id AND o.i = r.i + 1)
SELECT job_id, volume, count(*) AS files, min(pos) AS first FROM r GROUP BY ALL""",
    "archive_names": """SELECT p_partkey AS pos, CASE WHEN n = 1 THEN name ELSE (n - 1)::VARCHAR || '_' || name END AS archive_name FROM (
  SELECT p_partkey, p_brand || '.txt' AS name, row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_partkey) AS n FROM part)""",
}
