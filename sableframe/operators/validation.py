"""Checks of de-identified medical images: a declared table of rules, compiled into one pass over files and one over tags.

Files are rows (path, readable, study_uid, series_uid, sop_uid, identity_removed,
method, method_codes, preamble, pixel_sha256, frames, burned_in, source_ae,
meta_sop_uid); `frames` has the shape of each decoded frame and is null if the
pixels can't be decoded. Tags are rows (path, tag, keyword, vr, value), a row for
each value. What is expected of a file is a row (path, study_uid, series_uid,
sop_uid, pixel_sha256, pixel_modified, frames, regions, sensitive). A rule is a
code, the tag it names and a condition; adding one adds neither a scan nor a
shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Codes of the profile and of cleaned pixels, representations without text, and keywords whose text may identify.
PROFILE, CLEAN_PIXELS = "113100", "113101"
NO_TEXT = ("OB", "OW", "OF", "OD", "OL", "OV", "UN", "SQ")
LEAK_KEYWORDS = (
    "PatientName", "PatientID", "IssuerOfPatientID", "OtherPatientNames", "PatientBirthName", "PatientBirthDate", "PatientAddress", "PatientMotherBirthName", "PatientTelephoneNumbers",
    "PatientTelecomInformation", "MedicalRecordLocator", "AccessionNumber", "AdmissionID", "ServiceEpisodeID", "ReferringPhysicianName", "PerformingPhysicianName", "OperatorsName",
    "RequestingPhysician", "InstitutionName", "InstitutionAddress", "InstitutionalDepartmentName", "StationName", "StudyDescription", "StudyComments", "SeriesDescription", "ProtocolName",
    "RequestedProcedureDescription", "ImageComments",
)
LEAST_SENSITIVE = 3


@dataclass(frozen=True)
class Policy:
    """What is asked of outputs: private tags allowed as hex or keyword, whether identifiers stay, and what must be clean."""

    safe_private: tuple[str, ...] = ()
    remove_private: bool = True
    retain_uids: bool = False
    clean_preamble: bool = True
    clean_file_meta: bool = True
    decodable: bool = False


@dataclass(frozen=True)
class Rule:
    code: str
    tag: str | None
    broken: Column = field(compare=False)


def allowed_private(policy: Policy) -> tuple[set[str], set[str]]:
    """Hex tags (of a block's elements also the block's creator) and keywords that may stay."""
    tags = {t.translate(str.maketrans("", "", "(), ")).upper() for t in policy.safe_private}
    for t in tuple(tags):
        if len(t) == 8 and all(c in "0123456789ABCDEF" for c in t) and int(t[:4], 16) % 2 and int(t[4:], 16) >= 0x1000:
            tags.add(f"{t[:4]}{int(t[4:], 16) >> 8:04X}")
    return tags, set(policy.safe_private)


def file_rules(policy: Policy) -> list[Rule]:
    """Conditions over a file beside what is expected of it (`e`, null if nothing is)."""
    c, e = F.col, lambda name: F.col(f"e.{name}")
    blank = lambda x: F.btrim(F.coalesce(x, F.lit(""))) == ""
    changed = F.coalesce(e("pixel_modified"), F.lit(False))
    same_pixels = F.coalesce(c("pixel_sha256"), F.lit("")) == F.coalesce(e("pixel_sha256"), F.lit(""))
    asked, codes = F.size(F.coalesce(e("frames"), F.array().cast("array<string>"))) > 0, F.coalesce(c("method_codes"), F.array().cast("array<string>"))
    uid = lambda x: F.coalesce(x, F.lit(""))
    levels = [uid(c(n)) != uid(e(n)) for n in ("study_uid", "series_uid", "sop_uid")]
    decoded = c("frames").isNotNull() & (F.lit(policy.decodable) | asked)
    return [
        Rule("OUTPUT_SOP_UID_DUPLICATE_OR_MISSING", None, (uid(c("sop_uid")) == "") | (c("nth") > 1)),
        Rule("PATIENT_IDENTITY_REMOVED_FLAG_MISSING", "0012,0062", F.upper(uid(c("identity_removed"))) != "YES"),
        Rule("DEIDENTIFICATION_METHOD_MISSING", "0012,0063", blank(c("method"))),
        Rule("BASIC_PROFILE_CODE_MISSING", "0012,0064", ~F.array_contains(codes, PROFILE)),
        Rule("NONZERO_PREAMBLE", None, F.lit(policy.clean_preamble) & F.hex("preamble").rlike("[1-9A-F]")),
        Rule("OUTPUT_PIXEL_DECODE_FAILED", None, (F.lit(policy.decodable) | asked) & c("frames").isNull()),
        Rule("HIERARCHY_UID_MISMATCH", None, e("path").isNotNull() & (levels[0] | levels[1] | levels[2])),
        Rule("PIXEL_DATA_NOT_CHANGED_AFTER_REDACTION", None, changed & same_pixels),
        Rule("PIXEL_DATA_CHANGED_UNEXPECTEDLY", None, e("path").isNotNull() & ~changed & ~same_pixels),
        Rule("PIXEL_REDACTION_EVIDENCE_MISSING", None, changed & (F.coalesce(e("regions"), F.lit(0)) < 1)),
        Rule("BURNED_IN_ANNOTATION_NOT_CLEARED", "0028,0301", changed & (F.btrim(F.upper(uid(c("burned_in")))) != "NO")),
        Rule("CLEAN_PIXEL_DATA_CODE_MISSING", "0012,0064", changed & ~F.array_contains(codes, CLEAN_PIXELS)),
        Rule("PIXEL_FRAME_COUNT_CHANGED", None, decoded & asked & (F.size("frames") != F.size(e("frames")))),
        Rule("PIXEL_FRAME_SHAPE_CHANGED", None, decoded & asked & (c("frames") != e("frames"))),
        Rule("SOURCE_AE_TITLE_REMAINS", "0002,0016", F.lit(policy.clean_file_meta) & c("source_ae").isNotNull()),
        Rule("FILE_META_SOP_UID_MISMATCH", None, uid(c("meta_sop_uid")) != uid(c("sop_uid"))),
    ]


def tag_rules(policy: Policy) -> list[Rule]:
    """Conditions over a tag's value, beside the identifier that it should have become and whether it is known to be sensitive."""
    tags, keywords = allowed_private(policy)
    plain = F.upper(F.translate("tag", "(), ", ""))
    private = F.conv(F.substring(plain, 1, 4), 16, 10).cast("int") % 2 == 1
    allowed = plain.isin(*sorted(tags)) | F.coalesce("keyword", F.lit("")).isin(*sorted(keywords))
    text = ~F.col("vr").isin(*NO_TEXT)
    return [
        Rule("PRIVATE_TAG_REMAINS", "", F.lit(policy.remove_private) & private & ~allowed),
        Rule("ORIGINAL_UID_REMAINS", "", F.lit(not policy.retain_uids) & (F.col("vr") == "UI") & (F.coalesce("mapped", F.lit("")) != "") & (F.col("mapped") != F.col("value"))),
        Rule("SOURCE_IDENTIFIER_VALUE_REMAINS", "", text & (F.coalesce("keyword", F.lit("")).isin(*LEAK_KEYWORDS) | (F.col("vr") == "PN")) & F.coalesce("sensitive", F.lit(False))),
    ]


def broken(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """(path, code, tag): one row for each rule that a row breaks; all conditions are computed in one pass."""
    found = F.array(*(F.when(F.coalesce(r.broken, F.lit(False)), F.struct(F.lit(r.code).alias("code"), (F.col("tag") if r.tag == "" else F.lit(r.tag)).cast("string").alias("tag"))) for r in rules))
    return rows.select("path", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("path", "x.*")


def issues(files: DataFrame, tags: DataFrame, expected: DataFrame, uids: DataFrame, policy: Policy | None = None) -> DataFrame:
    """path, code, tag of everything that is wrong with the outputs. `uids` has original and mapped identifiers.

    A private tag is one issue, a value of a multiple tag one for each original
    identifier in it, a sensitive value one for each tag.
    """
    policy = policy or Policy()
    unread = files.where(~F.coalesce("readable", F.lit(False))).select("path", F.lit("OUTPUT_PARSE_FAILED").alias("code"), F.lit(None).cast("string").alias("tag"))
    read = files.where("readable").withColumn("nth", F.row_number().over(Window.partitionBy(F.coalesce(F.nullif("sop_uid", F.lit("")), "path")).orderBy("path")))
    beside = read.alias("f").join(expected.alias("e"), F.col("f.path") == F.col("e.path"), "left").select("f.*", F.struct(*(F.col(f"e.{c}") for c in expected.columns)).alias("e"))
    of_files = broken(beside, file_rules(policy))
    secret = expected.select(F.col("path").alias("_p"), F.explode("sensitive").alias("_v")).where(F.char_length("_v") >= LEAST_SENSITIVE)
    secret = secret.select("_p", F.lower("_v").alias("_v")).distinct().withColumn("sensitive", F.lit(True))
    known = uids.select(F.col("original").alias("_o"), "mapped").dropDuplicates(["_o"])
    values = tags.join(files.where("readable").select("path"), "path", "left_semi").join(known, F.col("value") == F.col("_o"), "left")
    values = values.join(secret, (F.col("path") == F.col("_p")) & (F.lower("value") == F.col("_v")), "left")
    of_tags = broken(values, tag_rules(policy))
    once = of_tags.where("code != 'ORIGINAL_UID_REMAINS'").distinct().unionByName(of_tags.where("code = 'ORIGINAL_UID_REMAINS'"))
    return unread.unionByName(of_files).unionByName(once)


def report(files: DataFrame, found: DataFrame) -> DataFrame:
    """One row: ok, checked, and distinct studies, series and instances."""
    def distinct(name: str) -> Column:
        return F.count_distinct(F.when(F.coalesce(F.col(name), F.lit("")) != "", F.col(name)))

    counts = files.where("readable").agg(F.count("*").alias("checked"), distinct("study_uid").alias("studies"), distinct("series_uid").alias("series"), distinct("sop_uid").alias("instances"))
    return counts.join(found.agg((F.count("*") == 0).alias("ok")))
