"""De-identification of medical-image tags, as flattened rows.

A tag is a row (study_uid, series_uid, sop_uid, path, tag, keyword, vr, value).
Actions: X remove, Z empty, D dummy, U map the identifier, K keep, C clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dicom as d

# What stands for a value of each representation.
DUMMIES = {"PN": "ANON", "DA": "19000101", "DT": "19000101000000", "TM": "000000"}
NUMERIC = ("DS", "IS", "FL", "FD", "SL", "SS", "UL", "US")
SEVERITY_ORDER = ("blocking", "high", "warning", "info")


def effective_rules(rules: DataFrame) -> DataFrame:
    """One action for each selector: of rules (seq, selector, action) the last wins."""
    return rules.groupBy("selector").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq"))


def with_actions(tags: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds `action`: by keyword, else by hex tag, else U for identifiers, X for private tags, K."""
    by = effective_rules(rules).select(F.upper("selector").alias("selector"), F.col("action").alias("rule"))
    a, b = by.withColumnsRenamed({"selector": "_k", "rule": "_rk"}), by.withColumnsRenamed({"selector": "_t", "rule": "_rt"})
    joined = tags.join(F.broadcast(a), F.upper("keyword") == F.col("_k"), "left").join(F.broadcast(b), F.upper("tag") == F.col("_t"), "left")
    private = F.conv(F.substring("tag", 1, 4), 16, 10).cast("int") % 2 == 1
    default = F.when(private, "X").when(F.col("vr") == "UI", "U").otherwise("K")
    return joined.withColumn("action", F.coalesce("_rk", "_rt", default)).drop("_k", "_rk", "_t", "_rt")


def _dummy(patient: Column, namespace: str, secret: str) -> Column:
    out = F.when(F.col("keyword") == "PatientID", d.pseudonym(patient, namespace, secret))
    for vr, text in DUMMIES.items():
        out = out.when(F.col("vr") == vr, text)
    return out.when(F.col("vr").isin(*NUMERIC), "0").otherwise(F.upper(F.substring(d.token_digest("dummy", F.col("value"), namespace, secret), 1, 12)))


def processed(tags: DataFrame, rules: DataFrame, patient: Column, namespace: str, secret: str) -> DataFrame:
    """Tags after their actions; removed sequences take what lies below them along."""
    acted = with_actions(tags, rules).withColumn("_patient", patient)
    gone = acted.where("action = 'X' AND vr = 'SQ'").select(F.col("sop_uid").alias("_s"), F.concat("path", F.lit("/")).alias("_below"))
    kept = acted.where("action != 'X'").join(gone, (F.col("sop_uid") == F.col("_s")) & F.col("path").startswith(F.col("_below")), "left_anti")
    days = d.shift_days(F.col("_patient"), namespace, secret)
    value = (
        F.when(F.col("action") == "Z", F.lit(""))
        .when(F.col("action") == "D", _dummy(F.col("_patient"), namespace, secret))
        .when(F.col("action") == "U", d.uid(F.col("value"), namespace, secret))
        .when(F.col("action") == "C", d.shifted_date(F.col("value"), days))
        .otherwise(F.col("value"))
    )
    return kept.withColumn("value", value).drop("_patient")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(sop_uid, path, before, after, change) for added, removed and changed tags."""
    a = before.select("sop_uid", "path", F.col("value").alias("before"), F.lit(True).alias("_a"))
    b = after.select("sop_uid", "path", F.col("value").alias("after"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return a.join(b, ["sop_uid", "path"], "full_outer").withColumn("change", change).where("change IS NOT NULL").drop("_a", "_b")


def header_risks(instances: DataFrame) -> DataFrame:
    """(code, study_uid, severity, n): doubled instances, several patients in a study, names left in the open."""
    twice = instances.groupBy("study_uid", "sop_uid").count().where("count > 1").groupBy("study_uid").agg(F.count("*").alias("n"))
    several = instances.groupBy("study_uid").agg(F.count_distinct("patient_id").alias("n")).where("n > 1")
    named = instances.where("patient_name IS NOT NULL AND trim(patient_name) != ''").groupBy("study_uid").agg(F.count("*").alias("n"))
    found = [("duplicate_sop", "warning", twice), ("several_patients", "blocking", several), ("patient_name", "high", named)]
    out = None
    for code, severity, df in found:
        rows = df.select(F.lit(code).alias("code"), "study_uid", F.lit(severity).alias("severity"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def inspected(instances: DataFrame) -> DataFrame:
    """Series, instances and sorted modalities of each study."""
    return instances.groupBy("study_uid").agg(
        F.count_distinct("series_uid").alias("n_series"), F.count_distinct("sop_uid").alias("n_instances"), F.array_sort(F.collect_set("modality")).alias("modalities")
    )


def preflight(instances: DataFrame, risks: DataFrame) -> DataFrame:
    """(study_uid, status): blocked by a blocking risk, review_required while pixels wait, else ready."""
    r = risks.dropDuplicates(["code", "study_uid"]).groupBy("study_uid").agg(F.bool_or(F.col("severity") == "blocking").alias("blocked"))
    p = instances.groupBy("study_uid").agg(F.bool_or("pixel_review_pending").alias("pending"))
    status = F.when(F.coalesce("blocked", F.lit(False)), "blocked").when(F.col("pending"), "review_required").otherwise("ready")
    return p.join(r, "study_uid", "left").select("study_uid", status.alias("status"))


def output_issues(after: DataFrame, before: DataFrame, required: tuple[str, ...] = ("SOPInstanceUID", "PatientID")) -> DataFrame:
    """(sop_uid, code): originals that came through, private tags, missing required tags."""
    secret_vr = F.col("vr").isin("PN", "UI", "DA", "DT", "LO", "SH") & F.col("keyword").rlike("Patient|UID|Date|Institution|Physician")
    same = after.where(secret_vr & (F.coalesce("value", F.lit("")) != "")).join(before.select("sop_uid", "path", "value"), ["sop_uid", "path", "value"], "left_semi")
    private = after.where(F.conv(F.substring("tag", 1, 4), 16, 10).cast("int") % 2 == 1)
    has = after.groupBy("sop_uid").agg(F.collect_set("keyword").alias("k"))
    missing = has.select("sop_uid", F.explode(F.array_except(F.array(*map(F.lit, required)), F.col("k"))).alias("k"))
    return (
        same.select("sop_uid", F.lit("original_value").alias("code"))
        .unionByName(private.select("sop_uid", F.lit("private_tag").alias("code")))
        .unionByName(missing.select("sop_uid", F.concat(F.lit("missing_"), "k").alias("code")))
        .distinct()
    )
