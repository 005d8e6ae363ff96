"""Values with known results."""

from __future__ import annotations

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from sableframe.functions import geometry as g
from sableframe.functions import masking as m
from sableframe.operators import boxes, entities, jobs
from sableframe.operators import profile as p
from sableframe.operators import redact as r
from sableframe.sources import files


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_hmac_is_the_standard_one(spark):
    for secret in ("s", "k" * 100):
        want = hmac.new(secret.encode(), "päper".encode(), hashlib.sha256).hexdigest()
        assert one(spark, m.hmac_sha256(F.col("v"), secret), v="päper") == want
    with pytest.raises(ValueError):
        m.hmac_sha256(F.lit("v"), "")


@pytest.mark.parametrize(
    ("value", "kind", "want"),
    [("13812345678", "PHONE", "138****5678"), ("ann@example.com", "EMAIL", "a**@example.com"), ("ab", "ORG", "**"), ("abc", "ORG", "a*c"), ("1234567", "PHONE", "*******")],
)
def test_masks(spark, value, kind, want):
    assert one(spark, m.mask(F.col("v"), kind), v=value) == want


@pytest.mark.parametrize(("value", "want"), [("999", "<1k"), ("1,000", "1k-10k"), ("-5", "<1k"), ("¥250000", "100k-1m"), ("nan", "***"), ("1e7", ">=1m"), ("", "***")])
def test_buckets(spark, value, want):
    assert one(spark, m.bucket(F.col("v")), v=value) == want


def test_nulls_and_blanks_stay(spark):
    for action in m.ACTIONS:
        for value in (None, "  "):
            assert one(spark, m.redacted(F.col("v"), action, "ORG", "o:d:c", "s"), v=value) == value


def test_policy_faults():
    with pytest.raises(ValueError, match="unknown: z"):
        r.check_policy(["a"], [r.Rule("a", "keep"), r.Rule("z", "keep")])
    with pytest.raises(ValueError, match="actions"):
        r.check_policy(["a"], [r.Rule("a", "burn")])


def test_profile_by_name_and_value(spark):
    rows = [("Ann", "13800138000", "a@b.com", "7.5", "x"), ("Bo", "13900139000", "c@d.org", "8", "y")]
    found = {x.name: x for x in p.profile(spark.createDataFrame(rows, "customer_name string, opaque string, email string, billing_amount string, order_note string"), ["opaque"])}
    assert found["opaque"].entity_type == "PHONE" and found["opaque"].action == "mask"
    assert found["email"].entity_type == "EMAIL" and found["customer_name"].entity_type == "PERSON"
    assert found["order_note"].action == "keep" and found["billing_amount"].data_type == "number"


def test_unsafe_patterns_are_refused():
    with pytest.raises(ValueError):
        entities.safe_pattern("(a+)+b")
    with pytest.raises(ValueError):
        entities.safe_pattern("(a|a)*b")
    assert entities.safe_pattern("(ab+)+c")
    assert entities.safe_pattern("a+b").search("xAAb")


def test_spans_and_overlaps(spark):
    docs = spark.createDataFrame([(1, "mail ann@example.com or 10.0.0.1"), (2, None), (3, "")], "doc_id long, text string")
    found = {(x["type"], x["text"], x["start"]) for x in entities.spans(docs).collect()}
    assert found == {("EMAIL", "ann@example.com", 5), ("IP_ADDRESS", "10.0.0.1", 24)}
    spans = spark.createDataFrame([(1, "PERSON", "ab", 0, 2, "has", None), (1, "ADDRESS", "abc", 1, 4, "regex", None), (1, "ORG", "z", 9, 10, "has", None)], entities.SPAN)
    assert sorted(x["type"] for x in entities.settled(spans).collect()) == ["ADDRESS", "ORG"]


def test_replacement_prefers_the_longest(spark):
    docs = spark.createDataFrame([(1, "Acme Corp and Acme")], "doc_id long, text string")
    names = spark.createDataFrame([(1, "Acme", "A"), (1, "Acme Corp", "B")], "doc_id long, original string, replacement string")
    assert entities.replaced(docs, names).first()["text"] == "B and A"


def test_boxes(spark):
    box = "x double, y double, width double, height double"
    df = spark.createDataFrame([((0.0, 0.0, 0.4, 0.4), (0.2, 0.0, 0.4, 0.4))], f"a struct<{box.replace(' double', ':double')}>, b struct<{box.replace(' double', ':double')}>")
    assert df.select(g.iou("a", "b")).first()[0] == pytest.approx(1 / 3)
    assert df.select(g.smaller_overlap("a", "b")).first()[0] == pytest.approx(0.5)
    assert boxes is not None


def test_illegal_moves(spark):
    rows = [("i", 1, "pending"), ("i", 2, "completed"), ("i", 3, "completed"), ("j", 1, "pending"), ("j", 2, "processing")]
    bad = jobs.illegal_moves(spark.createDataFrame(rows, "id string, seq int, status string"), jobs.ITEM_MOVES).collect()
    assert [(x["id"], x["seq"]) for x in bad] == [("i", 2)]


def test_column_names_and_encodings():
    assert files.column_names(["a", "", "a", None, " a "]) == ["a", "column_2", "a_2", "column_4", "a_3"]
    assert files.encoding_of("姓名".encode("gb18030")) == "gb18030" and files.encoding_of("姓名".encode()) in ("utf-8-sig", "utf-8")
    with pytest.raises(ValueError):
        files.kind_of("x.pdf")


def test_patterns_ignore_case(spark):
    docs = spark.createDataFrame([(1, "Password: Abcdefgh12 and HTTPS://A.com/x, Ann@EXAMPLE.com")], "doc_id long, text string")
    assert docs.select(entities.masked_by_pattern(F.col("text"))).first()[0] == "<AUTH_SECRET> and <URL_WEBSITE> <EMAIL>"
    counts = {r["type"]: r["n"] for r in entities.counts_by_type(docs).collect()}
    assert counts == {"AUTH_SECRET": 1, "URL_WEBSITE": 1, "EMAIL": 1}
    found = entities.spans(docs).groupBy("type").count().collect()
    assert {r["type"]: r["count"] for r in found} == counts


def test_semantic_thresholds(spark):
    schema = "name string, entity_type string, risk string, confidence double, unique_rate double, reasons array<string>, action string"
    rows = [("same", "ORG", "high", 0.86), ("none", "CUSTOM", "low", 0.1), ("other", "ORG", "high", 0.86), ("direct", "PHONE", "high", 0.98), ("technical", "technical_identifier", "low", 0.88)]
    profiles = spark.createDataFrame([(*r, 1.0, ["column_values" if r[0] == "direct" else "column_name"], "keep") for r in rows], schema)
    for sure, want in ((0.5, {"same"}), (0.55, {"same", "none"}), (0.78, {"same", "none", "other"})):
        types = {"same": "ORG", "none": "PERSON", "other": "PERSON", "direct": "PERSON", "technical": "PERSON"}
        model = spark.createDataFrame([(c, t, "high", sure) for c, t in types.items()], "column string, type string, risk string, confidence double")
        out = p.merged_semantic(profiles, model).where("array_contains(reasons, 'semantic_model')").collect()
        assert {r["name"] for r in out} == want and all(r["entity_type"] == types[r["name"]] for r in out)
