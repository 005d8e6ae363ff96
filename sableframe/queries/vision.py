"""Boxes on pages and medical-image tags, both derived from the common tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dicom as d
from ..functions import geometry as g
from ..operators import boxes as b
from ..operators import dicom as dc
from .tabular import SECRET, _hmac, load


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Four numbers of each embedding as a box, 25 to a page."""
    v = [F.abs(F.get("embedding", i).cast("double")) for i in range(4)]
    part = [x - F.floor(x) for x in v]
    return load(spark, sf, "embeddings").select(
        F.col("vec_id").alias("box_id"), (F.col("vec_id") % 3).alias("run"), F.floor(F.col("vec_id") / 25).alias("page"), F.concat(F.lit("t"), (F.col("label") % 2).cast("string")).alias("type"),
        F.concat(F.lit("v"), (F.col("label") % 5).cast("string")).alias("text"), F.when(F.col("vec_id") % 4 == 0, "vl").otherwise("ocr").alias("source"),
        F.round(part[0] * 0.5, 4).alias("x"), F.round(part[1] * 0.5, 4).alias("y"), F.round(0.05 + part[2] * 0.4, 4).alias("width"), F.round(0.05 + part[3] * 0.4, 4).alias("height"),
        F.round(part[0], 3).alias("confidence"),
    )


_V = [f"(abs(embedding[{i + 1}]::DOUBLE) - floor(abs(embedding[{i + 1}]::DOUBLE)))" for i in range(4)]
_BOXES = f"""b AS (SELECT vec_id AS box_id, vec_id // 25 AS page, 't' || (label % 2) AS type, 'v' || (label % 5) AS text, CASE WHEN vec_id % 4 = 0 THEN 'vl' ELSE 'ocr' END AS source,
  round({_V[0]} * 0.5, 4) AS x, round({_V[1]} * 0.5, 4) AS y, round(0.05 + {_V[2]} * 0.4, 4) AS width, round(0.05 + {_V[3]} * 0.4, 4) AS height, round({_V[0]}, 3) AS confidence FROM embeddings)"""
_BOTH = "(greatest(least(a.x + a.width, c.x + c.width) - greatest(a.x, c.x), 0) * greatest(least(a.y + a.height, c.y + c.height) - greatest(a.y, c.y), 0))"


def iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return b.overlapping_pairs(_boxes(spark, sf), 0.3).select("page", "type", "a", "b", F.round("iou", 6).alias("iou"))


def containment_drop(spark: SparkSession, sf: str) -> DataFrame:
    return b.without_contained(_boxes(spark, sf)).select("box_id", "page", "type")


def detector_preference(spark: SparkSession, sf: str) -> DataFrame:
    return b.prefer_detector(_boxes(spark, sf), "vl").select("box_id")


def box_dedup_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return b.deduplicated(_boxes(spark, sf), 0.5, "smaller").select("box_id")


def box_consensus(spark: SparkSession, sf: str) -> DataFrame:
    return b.consensus(_boxes(spark, sf), 2, 0.3)


def box_issues(spark: SparkSession, sf: str) -> DataFrame:
    return b.issues(_boxes(spark, sf)).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def clamped_boxes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("box_id") % 7
    rows = _boxes(spark, sf).select("box_id", g.clamped(F.col("x") - k * 0.1, F.col("y"), F.col("width"), F.col("height") + 0.5).alias("c"))
    return rows.where("c IS NOT NULL").select("box_id", *(F.round(f"c.{n}", 6).alias(n) for n in ("x", "y", "width", "height")))


def dicom_tokens(spark: SparkSession, sf: str) -> DataFrame:
    who = F.col("c_name")
    return load(spark, sf, "customer").select("c_custkey", d.pseudonym(who, "study", SECRET).alias("pseudonym"), d.shift_days(who, "study", SECRET).alias("days"))


def dicom_date_shift(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "orders").select("o_orderkey", F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyyMMdd").alias("da"), F.col("o_custkey").cast("string").alias("who"))
    return rows.select("o_orderkey", d.shifted_date(F.col("da"), d.shift_days(F.col("who"), "study", SECRET)).alias("da"))


def dicom_uid_map(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "customer").select("c_custkey", d.uid(F.concat(F.lit("1.2.840."), F.col("c_custkey").cast("string")), "study", SECRET).alias("uid"))


def rule_precedence(spark: SparkSession, sf: str) -> DataFrame:
    rules = load(spark, sf, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("tag"), (F.col("user_id") % 50).cast("string")).alias("selector"), F.col("event_type").alias("action"))
    return dc.effective_rules(rules)


def _instances(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as studies, their lines as series and instances."""
    return load(spark, sf, "lineitem").join(load(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("study_uid"), F.col("l_orderkey").alias("series_uid"), F.col("l_partkey").alias("sop_uid"), F.col("l_suppkey").alias("patient_id"),
        F.when(F.col("l_linenumber") == 1, F.col("o_orderpriority")).alias("patient_name"), F.col("l_linestatus").alias("modality"), (F.col("l_linenumber") == 7).alias("pixel_review_pending"),
    )


def dicom_inspection(spark: SparkSession, sf: str) -> DataFrame:
    return dc.inspected(_instances(spark, sf)).select("study_uid", "n_series", "n_instances", F.array_join("modalities", ",").alias("modalities"))


def dicom_preflight(spark: SparkSession, sf: str) -> DataFrame:
    rows = _instances(spark, sf)
    few = rows.where("study_uid % 2 = 0")
    return dc.preflight(rows, dc.header_risks(few)).groupBy("status").agg(F.count("*").alias("n"))


def dicom_risks(spark: SparkSession, sf: str) -> DataFrame:
    return dc.header_risks(_instances(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        iou_pairs, containment_drop, detector_preference, box_dedup_greedy, box_consensus, box_issues, clamped_boxes, dicom_tokens, dicom_date_shift, dicom_uid_map, rule_precedence,
        dicom_inspection, dicom_preflight, dicom_risks,
    )
}


def _token(purpose: str, value: str) -> str:
    return _hmac(f"'v1' || chr(0) || 'study' || chr(0) || '{purpose}' || chr(0) || {value}")


def _days(value: str) -> str:
    return f"((('0x' || substr({_token('date', value)}, 1, 16))::UBIGINT % 7301)::INT - 3650)"


_INSIDE = "a.x >= c.x AND a.y >= c.y AND a.x + a.width <= c.x + c.width AND a.y + a.height <= c.y + c.height"
_INSTANCES = """i AS (SELECT o_custkey AS study_uid, l_orderkey AS series_uid, l_partkey AS sop_uid, l_suppkey AS patient_id, CASE WHEN l_linenumber = 1 THEN o_orderpriority END AS patient_name,
  l_linestatus AS modality, l_linenumber = 7 AS pending FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_RISKS = """r AS (SELECT 'duplicate_sop' AS code, study_uid, 'warning' AS severity, count(*) AS n FROM (SELECT study_uid, sop_uid FROM i GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL
  UNION ALL SELECT 'several_patients', study_uid, 'blocking', count(DISTINCT patient_id) FROM i GROUP BY study_uid HAVING count(DISTINCT patient_id) > 1
  UNION ALL SELECT 'patient_name', study_uid, 'high', count(*) FROM i WHERE trim(patient_name) != '' GROUP BY study_uid)"""
SQL = {
    "iou_pairs": f"""WITH {_BOXES} SELECT a.page, a.type, a.box_id AS a, c.box_id AS b, round({_BOTH} / (a.width * a.height + c.width * c.height - {_BOTH}), 6) AS iou
FROM b a JOIN b c ON a.page = c.page AND a.type = c.type AND a.box_id < c.box_id WHERE {_BOTH} / (a.width * a.height + c.width * c.height - {_BOTH}) >= 0.3""",
    "containment_drop": f"""WITH {_BOXES} SELECT box_id, page, type FROM b a WHERE NOT EXISTS (SELECT 1 FROM b c WHERE a.page = c.page AND a.type = c.type AND a.box_id != c.box_id AND {_INSIDE}
  AND (a.width * a.height < c.width * c.height OR (a.width * a.height = c.width * c.height AND a.box_id > c.box_id)))""",
    "detector_preference": f"""WITH {_BOXES} SELECT box_id FROM b a WHERE NOT EXISTS (SELECT 1 FROM b c WHERE c.source = 'vl' AND a.source != 'vl' AND a.page = c.page AND a.type = c.type
  AND c.x + c.width / 2 BETWEEN a.x AND a.x + a.width AND c.y + c.height / 2 BETWEEN a.y AND a.y + a.height)""",
    "box_issues": f"""WITH {_BOXES} SELECT issue, count(*) AS n FROM (SELECT 'low_confidence' AS issue FROM b WHERE confidence > 0 AND confidence < 0.5
  UNION ALL SELECT 'large_region' FROM b WHERE width * height > 0.5) GROUP BY 1""",
    "clamped_boxes": f"""WITH {_BOXES}, c AS (SELECT box_id, least(greatest(x - (box_id % 7) * 0.1::DOUBLE, 0), 1) AS x0, y AS y0, least(greatest(x - (box_id % 7) * 0.1::DOUBLE + width, 0), 1) AS x1, least(y + height + 0.5::DOUBLE, 1) AS y1 FROM b)
SELECT box_id, round(x0, 6) AS x, round(y0, 6) AS y, round(x1 - x0, 6) AS width, round(y1 - y0, 6) AS height FROM c WHERE x1 > x0 AND y1 > y0""",
    "dicom_tokens": f"SELECT c_custkey, 'P-' || upper(substr({_token('patient', 'c_name')}, 1, 20)) AS pseudonym, {_days('c_name')} AS days FROM customer",
    "dicom_date_shift": f"SELECT o_orderkey, strftime(o_orderdate::DATE + {_days('o_custkey::VARCHAR')}, '%Y%m%d') AS da FROM orders",
    "dicom_uid_map": f"SELECT c_custkey, '2.25.' || ('0x' || substr({_token('uid', chr(39) + '1.2.840.' + chr(39) + ' || c_custkey::VARCHAR')}, 1, 32))::UHUGEINT::VARCHAR AS uid FROM customer",
    "rule_precedence": "SELECT 'tag' || (user_id % 50)::VARCHAR AS selector, arg_max(event_type, event_id) AS action, max(event_id) AS seq FROM events GROUP BY 1",
    "dicom_inspection": f"WITH {_INSTANCES} SELECT study_uid, count(DISTINCT series_uid) AS n_series, count(DISTINCT sop_uid) AS n_instances, string_agg(DISTINCT modality, ',' ORDER BY modality) AS modalities FROM i GROUP BY 1",
    "dicom_preflight": f"""WITH {_INSTANCES}, {_RISKS}, p AS (SELECT study_uid, bool_or(pending) AS pending FROM i GROUP BY 1),
k AS (SELECT DISTINCT study_uid FROM r WHERE severity = 'blocking' AND study_uid % 2 = 0)
SELECT CASE WHEN k.study_uid IS NOT NULL THEN 'blocked' WHEN pending THEN 'review_required' ELSE 'ready' END AS status, count(*) AS n FROM p LEFT JOIN k USING (study_uid) GROUP BY 1""",
    "dicom_risks": f"WITH {_INSTANCES}, {_RISKS} SELECT * FROM r",
}
