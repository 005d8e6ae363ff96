"""Values in blocks, tables as grids, chunks, the entity pipeline and styled runs, over documents and pages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as b
from ..operators import entities as e
from ..operators import lines as n
from ..operators import passes as p
from ..operators import organisations as o
from ..operators import recognition as r
from ..operators import runs as s
from ..operators import validation as v
from ..operators.running import kept, shared_folder
from ..streaming import export as x
from ..operators import tables as t
from .tabular import load
from .text import _spans_sql


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


def block_places(spark: SparkSession, d: str) -> DataFrame:
    """Lines as blocks; values of each document that stand in one line, in one with other white space, over three lines, or over a lost line break."""
    docs = load(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    at = (F.col("doc_id") % F.greatest(F.size("l") - 2, F.lit(1))).cast("int")
    one, two, three = (F.coalesce(F.get("l", at + k), F.lit("")) for k in range(3))
    first, last = "^[^ \t]+", "[^ \t]+$"
    made = F.create_map(
        F.lit("ADDRESS"), F.concat(F.regexp_extract(one, last, 0), F.lit("\n"), two, F.lit("\n"), F.regexp_extract(three, first, 0)),
        F.lit("ORG"), F.concat(F.right(one, F.lit(5)), F.left(two, F.lit(4))),
        F.lit("ACCOUNT"), F.regexp_replace(F.left(two, F.lit(24)), " ", ""),
        F.lit("PERSON"), F.regexp_extract(one, first, 0),
        F.lit("AMOUNT"), F.regexp_extract(one, "[0-9]+", 0),
    )
    values = docs.select("doc_id", F.explode(made).alias("type", "value"))
    return b.located(values, _lines(spark, d), fuzzy=False).select("doc_id", "type", "how", "pos", "start", "end", F.md5(F.col("value").cast("binary")).alias("value"))


def table_grid(spark: SparkSession, d: str) -> DataFrame:
    """Pages as tables: paragraphs are rows, sentences cells whose spans follow from their lengths; every cell on its grid."""

    def cell(x: Column, i: Column) -> Column:
        n = F.char_length(x)
        spans = F.concat(F.lit('<td colspan="'), (n % 3 + 1).cast("string"), F.lit("\" rowspan='"), ((n + i) % 3 + 1).cast("string"), F.lit("'>"))
        return F.concat(spans, x, F.lit("</td>"))

    def row(x: Column, i: Column) -> Column:
        cells = F.filter(F.transform(F.split(F.regexp_replace(x, "(?s)<[^>]*>", ""), "[.]"), lambda c: F.btrim(c)), lambda c: c != "")
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: cell(c, i)), ""), F.lit("</tr>"))

    # character references are left to tests: SQL has no table of them
    parts = F.split(F.replace("html", F.lit("&"), F.lit("+")), "<p>")
    rows = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), row)
    html = F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>"))
    cells = t.table_cells(load(spark, d, "pages").select("page_id", html.alias("html")))
    return cells.select("page_id", "row", "col", "row_span", "col_span", "text")


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Distinct lines of each document in chunks of 1,600 characters, whole lines and all chunks, with the place of each line."""
    parts = r.chunks(load(spark, d, "documents"), longest=None, most=None)
    return parts.select("doc_id", "chunk", F.md5(F.col("text").cast("binary")).alias("text"), F.array_join("offsets", ",").alias("offsets"))


#: A stand-in for a model: capitalised words and the next one.
NAMES = "[A-ZÄÖÜÉÈ][a-zäöüßéèêàçñóí]{2,} [a-zäöüßéèêàçñóí]{5,}"


def names_model(parts: DataFrame) -> DataFrame:
    found = parts.select("doc_id", "chunk", F.col("text").alias("whole"), F.explode(b.places(F.col("text"), F.lit(NAMES))).alias("x"))
    text = F.substring(F.col("whole"), F.col("x.start") + 1, F.col("x.end") - F.col("x.start"))
    kind = F.when(F.char_length(text) % 3 == 0, "ORG").otherwise("PERSON")
    return found.select("doc_id", "chunk", kind.alias("type"), text.alias("text"), F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"), F.lit(0.8).alias("confidence"))


def chunk_spans(spark: SparkSession, d: str) -> DataFrame:
    """Names found in chunks, each at its place in the document and with the text that stands there."""
    docs = load(spark, d, "documents")
    parts = kept(r.chunks(docs, longest=None, most=None))
    found = r.in_document(names_model(parts), parts, docs, None)
    own = found.groupBy("doc_id").agg(F.collect_list(F.struct("type", "start", "end")).alias("all")).join(docs.select("doc_id", F.col("text").alias("full")), "doc_id")
    there = own.select("doc_id", "all", r.pieces(F.col("full"), F.col("all.start"), F.col("all.end")).alias("there"))
    return there.select("doc_id", F.explode(F.arrays_zip("all", "there")).alias("x")).select("doc_id", "x.all.*", F.col("x.there").alias("text"))


def recognised_entities(spark: SparkSession, d: str) -> DataFrame:
    """The whole recognition: a model's names, all patterns, checks, repeats, references and ids."""
    found = r.recognised(load(spark, d, "documents"), names_model, e.PATTERNS, longest=None, most=None)
    return found.select("doc_id", "entity_id", "type", "start", "end", "source", "propagated", "coref_id")


def _marks(docs: DataFrame) -> DataFrame:
    """Each document's matches of all patterns as originals, with a mark of the first type in their place."""
    found = e.spans(docs).groupBy("doc_id", F.col("text").alias("original")).agg(F.min("type").alias("type"))
    return found.select("doc_id", "original", F.concat(F.lit("<"), "type", F.lit(">")).alias("replacement"))


def styled_runs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as runs of 40 characters, all matches replaced across their borders."""
    docs = load(spark, d, "documents")
    parts = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit("(?s).{1,40}"), F.lit(0)))  # one pass, where a substring counts from the start
    runs = docs.select("doc_id", F.posexplode(parts).alias("run", "text"))
    return s.replaced_runs(runs, _marks(docs)).select("doc_id", "run", "text")


def preview_segments(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut at what is replaced: how many pieces, how many of them changed, and all of them in order."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    parts = s.segments(docs, _marks(docs))
    both = F.concat("text", F.lit("|"), F.coalesce("replacement", F.lit("")))
    one = F.transform(F.array_sort(F.collect_list(F.struct("nth", both.alias("x")))), lambda p: p["x"])
    return parts.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("replaced").alias("changed"), F.md5(F.array_join(one, "/").cast("binary")).alias("pieces"))


PLACES = ("", "中华人民共和国", "广西区", "南宁市", "中国", "都市", "全国", "江苏省南京市")
CORES = ("", "信尔胜", "法治企业", "政府顾问", "贸易", "联合国", "绿岛", "司法", "教育", "最高人民法院", "机械（江苏）")
KINDS = ("有限公司", "部", "厅", "律师事务所", "人才库", "研究院", "公证处", "党委", "组织部", "咖啡厅", "日报", "网", "医院", "小学", "律师事务中心", "司法厅", "协会", "指南", "办公室", "国资委", "集团财政厅", "大学", "服务中心")


def organisation_rules(spark: SparkSession, d: str) -> DataFrame:
    """Names of customers as organisations, put together from their keys: what keeps its name, what stands for it, and its pool."""
    k = F.col("c_custkey")
    parts = [F.element_at(F.array(*map(F.lit, x)), (F.floor(k / n) % len(x) + 1).cast("int")) for x, n in ((PLACES, 1), (CORES, 3), (KINDS, 7))]
    name = F.when(k % 13 == 0, F.concat(F.lit("《"), *parts, F.lit("》"))).otherwise(F.concat(F.lit(" "), *parts))
    return o.ruled(load(spark, d, "customer").select("c_custkey", name.alias("text"))).select("c_custkey", "preserved", "base", "pool")


def organisation_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Short names of a nation's customers and the full names they mean."""
    rows = load(spark, d, "customer").withColumn("k", F.col("c_custkey").cast("string"))
    full = F.concat("c_mktsegment", F.lit(" works "), "k", F.lit(" company limited"))
    short = F.concat(F.lit("("), F.regexp_replace("c_mktsegment", "[AEIOU]$", ""), F.lit(" works "), "k", F.lit(")"))
    names = rows.select(F.col("c_nationkey").cast("long").alias("doc_id"), F.explode(F.array(full, F.when(F.col("c_custkey") % 3 == 0, short))).alias("text")).where("text IS NOT NULL")
    return o.alias_links(names).select(F.col("doc_id").alias("nation"), "alias", "full")


def _page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Four numbers of each embedding as a block of a page of 50, its id in letters as the text."""
    part = [F.abs(F.get("embedding", i).cast("double")) - F.floor(F.abs(F.get("embedding", i).cast("double"))) for i in range(4)]
    name = F.translate(F.col("vec_id").cast("string"), "0123456789", "零一二三四五六七八九")
    text = F.when(F.col("vec_id") % 2 == 0, name).when(F.col("vec_id") % 11 == 0, F.concat(F.lit("<table>"), name)).otherwise(F.concat(name, F.lit(" 科技"), name))
    return load(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 50).alias("page"), F.col("vec_id").alias("box_id"), text.alias("text"), F.floor(part[0] * 900).cast("int").alias("left"), (F.floor(part[1] * 60) * 12).cast("int").alias("top"),
        (20 + F.floor(part[3] * 120)).cast("int").alias("width"), (10 + F.floor(part[2] * 6) + F.when(F.col("vec_id") % 17 == 0, 40).otherwise(0)).cast("int").alias("height"), F.round(part[0], 3).alias("confidence"),
    )


def visual_lines(spark: SparkSession, d: str) -> DataFrame:
    """Short names joined with the nearest block to their right on the line."""
    return n.bridged(_page_blocks(spark, d)).select("page", "left_id", "right_id", "text", "left", "top", "width", "height", F.round("confidence", 6).alias("confidence"))


def text_hulls(spark: SparkSession, d: str) -> DataFrame:
    return n.hulls(_page_blocks(spark, d))


def multi_pass_union(spark: SparkSession, d: str) -> DataFrame:
    """Words of a document, one a pass, until a pass finds one that is known or none."""

    def ask(some: DataFrame, number: int) -> DataFrame:
        words = F.split("text", " ")
        return some.select("doc_id", F.lit("WORD").alias("type"), F.element_at(words, (F.lit(number * number) % F.size(words) + 1).cast("int")).alias("value"))

    found = p.union_of_passes(load(spark, d, "documents").select("doc_id", "text"), ask, 5)
    return found.select("doc_id", "value", "pass")


def incremental_export(spark: SparkSession, d: str) -> DataFrame:
    """Orders arriving in four files, each row twice, exported as they come: what the ledger has, by status."""
    folder = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"), F.unix_date(F.col("o_orderdate").cast("date")).alias("version"))
    for k in range(4):  # a quarter of the keys, and again those of the quarter before
        orders.where(F.pmod("o_orderkey", F.lit(4)).isin(k, (k - 1) % 4)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    schema = "o_orderkey bigint, o_orderstatus string, o_totalprice decimal(12,2), version int"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    x.export(x.versions(stream, ["o_orderkey"], "version"), f"{folder}/out", f"{folder}/marks")
    rows = x.exported(spark, f"{folder}/out", schema)
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_keys"), F.sum("o_totalprice").cast("double").alias("total"))


_SOP = "CASE WHEN k % 41 = 0 THEN '' WHEN k % 29 < 2 THEN concat('I', CAST(floor(k / 2) AS INT)) ELSE concat('I', k) END"


def output_validation(spark: SparkSession, d: str) -> DataFrame:
    """Orders as de-identified files with faults that follow from their keys, lines as their tags: every rule that one breaks."""
    orders = load(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey", "o_orderpriority")
    files = orders.selectExpr(
        "concat('f', k) AS path", "k % 37 != 0 AS readable", "concat('S', o_custkey) AS study_uid", "concat('R', k % 5) AS series_uid", f"{_SOP} AS sop_uid", "IF(k % 11 = 0, 'no', 'Yes') AS identity_removed",
        "IF(k % 13 = 0, ' ', 'm') AS method", "CASE WHEN k % 7 = 0 THEN array() WHEN k % 2 = 0 THEN array('113100') ELSE array('113100', '113101') END AS method_codes",
        "IF(k % 17 = 0, X'0001', X'0000') AS preamble", "concat('p', k % 4) AS pixel_sha256", "CASE WHEN k % 19 != 0 THEN IF(k % 23 = 0, array('1x1'), array('2x2', '2x2')) END AS frames",
        "IF(k % 5 = 0, ' no ', 'YES') AS burned_in", "IF(k % 31 = 0, 'AE', NULL) AS source_ae", f"IF(k % 9 = 0, 'x', {_SOP}) AS meta_sop_uid",
    )
    expected = orders.where("k % 3 != 0").selectExpr(
        "concat('f', k) AS path", "concat('S', o_custkey) AS study_uid", "IF(k % 25 = 1, 'R9', concat('R', k % 5)) AS series_uid", f"{_SOP} AS sop_uid", "concat('p', k % 3) AS pixel_sha256",
        "k % 2 = 0 AS pixel_modified", "IF(k % 10 = 0, CAST(array() AS ARRAY<STRING>), array('2x2', '2x2')) AS frames", "CAST(k % 8 AS INT) AS regions", "array(o_orderpriority, 'ab') AS sensitive",
    )
    tags = load(spark, d, "lineitem").selectExpr(
        "concat('f', l_orderkey) AS path", "element_at(array('0010,0010', '0009,1001', '0020,000D', '0008,0080', '0009,1010', '0010,4000', '0010,4000'), l_linenumber) AS tag",
        "element_at(array('PatientName', '', 'StudyInstanceUID', 'InstitutionName', 'SafeKey', 'PatientComments', 'ImageComments'), l_linenumber) AS keyword",
        "element_at(array('PN', 'LO', 'UI', 'LO', 'LO', 'LT', 'OB'), l_linenumber) AS vr",
        "element_at(array(IF(l_partkey % 2 = 0, '1-URGENT', 'x'), 'v', concat('U', l_partkey % 40), '2-high', 'v', '1-urgent', '1-urgent'), l_linenumber) AS value",
    )
    uids = load(spark, d, "nation").selectExpr("concat('U', n_nationkey) AS original", "concat(IF(n_nationkey % 3 = 0, 'U', 'M'), n_nationkey) AS mapped")
    return v.issues(files, tags, expected, uids, v.Policy(safe_private=("(0009,1010)",)))


QUERIES = {f.__name__: f for f in (output_validation, multi_pass_union, incremental_export, visual_lines, text_hulls, organisation_rules, organisation_aliases, block_places, table_grid, document_chunks, chunk_spans, recognised_entities, styled_runs, preview_segments)}

_TRIM = "regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"
_PLAIN = r"""regexp_replace(regexp_replace(regexp_replace({x}, '\\(?:text|mathrm|mathbf|mathit|textbf|operatorname)\s*\{{([^{{}}]*)\}}', '\1', 'g'), '\\[()\[\]]|\$', '', 'g'), '\\[,;:! ]', ' ', 'g')"""
_TIGHT = "regexp_replace({x}, '\\s+', '', 'g')"
_SUM = r"""(CASE WHEN regexp_matches({x}, '[.．,，]00\D*$') AND length(regexp_replace({x}, '\D', '', 'g')) > 2 THEN regexp_replace(regexp_replace({x}, '\D', '', 'g'), '00$', '') ELSE regexp_replace({x}, '\D', '', 'g') END)"""
_CLASS = "CASE WHEN regexp_matches({c}, '[0-9０-９]') THEN 1 WHEN regexp_matches({c}, '[A-Za-z]') THEN 2 WHEN regexp_matches({c}, '[一-鿿]') THEN 3 ELSE 0 END"

# Distinct lines in order, each sought from the end of the one before; a chunk ends where the next line would pass the budget.
_CHUNKS = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(range(len(l))) AS i, trim(regexp_replace(unnest(l), '\s+', ' ', 'g')) AS line FROM d),
u AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS n FROM x WHERE line != '' GROUP BY doc_id, line),
f AS (
  SELECT doc_id, text, CAST(0 AS BIGINT) AS n, '' AS line, CAST(0 AS BIGINT) AS after, CAST(-1 AS BIGINT) AS spot, CAST(0 AS INT) AS chunk, CAST(0 AS BIGINT) AS used FROM d
  UNION ALL
  SELECT doc_id, text, n, line, CASE WHEN spot >= 0 THEN spot + length(line) ELSE after END, spot,
    CASE WHEN used > 0 AND used + length(line) + 1 > 1600 THEN chunk + 1 ELSE chunk END, CASE WHEN used > 0 AND used + length(line) + 1 > 1600 THEN 0 ELSE used END + length(line) + 1
  FROM (SELECT f.doc_id, f.text, u.n, u.line, f.after, f.chunk, f.used,
      CASE WHEN strpos(substr(f.text, f.after + 1), u.line) > 0 THEN f.after + strpos(substr(f.text, f.after + 1), u.line) - 1 ELSE strpos(f.text, u.line) - 1 END AS spot
    FROM f JOIN u ON u.doc_id = f.doc_id AND u.n = f.n + 1))"""

# Matches of the originals by start and length, each kept if it begins at or after the end of the last one kept.
_KEPT = f"""
WITH RECURSIVE o AS (SELECT doc_id, text AS original, '<' || min(type) || '>' AS replacement FROM ({_spans_sql(list(e.PATTERNS))}) GROUP BY ALL),
g AS (SELECT doc_id, original, replacement, string_split(text, original) AS gaps FROM o JOIN documents USING (doc_id)),
m AS (SELECT doc_id, original, replacement, CAST(list_sum(list_transform(gaps[:i], lambda x: length(x))) + (i - 1) * length(original) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(gaps))) AS i FROM g)),
n AS (SELECT doc_id, start, start + length(original) AS stop, replacement, row_number() OVER (PARTITION BY doc_id ORDER BY start, length(original) DESC) AS nth FROM m),
z AS (
  SELECT doc_id, nth, start, stop, replacement, stop AS past, TRUE AS keep FROM n WHERE nth = 1
  UNION ALL
  SELECT n.doc_id, n.nth, n.start, n.stop, n.replacement, CASE WHEN n.start >= z.past THEN n.stop ELSE z.past END, n.start >= z.past FROM z JOIN n ON n.doc_id = z.doc_id AND n.nth = z.nth + 1),
k AS (SELECT doc_id, start, stop, replacement FROM z WHERE keep)"""

_PARTS = [f"(abs(embedding[{i + 1}]::DOUBLE) - floor(abs(embedding[{i + 1}]::DOUBLE)))" for i in range(4)]
_PAGE_BLOCKS = f"""
WITH x AS (SELECT *, translate(vec_id::VARCHAR, '0123456789', '零一二三四五六七八九') AS name FROM embeddings),
b AS (SELECT vec_id // 50 AS page, vec_id AS box_id, CASE WHEN vec_id % 2 = 0 THEN name WHEN vec_id % 11 = 0 THEN '<table>' || name ELSE name || ' 科技' || name END AS text,
  floor({_PARTS[0]} * 900)::INT AS left, (floor({_PARTS[1]} * 60) * 12)::INT AS top, (20 + floor({_PARTS[3]} * 120))::INT AS width, (10 + floor({_PARTS[2]} * 6) + CASE WHEN vec_id % 17 = 0 THEN 40 ELSE 0 END)::INT AS height,
  round({_PARTS[0]}, 3) AS confidence FROM x)"""


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _any(test: str, words: tuple[str, ...]) -> str:
    quoted = ("'" + w + "'" for w in words)
    return "(" + " OR ".join(test.format(w=w) for w in quoted) + ")"


SQL = {
    "block_places": rf"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
a AS (SELECT doc_id, l, CAST(doc_id % greatest(len(l) - 2, 1) AS INT) + 1 AS i FROM d),
o AS (SELECT doc_id, coalesce(l[i], '') AS one, coalesce(l[i + 1], '') AS two, coalesce(l[i + 2], '') AS three FROM a),
m AS (SELECT doc_id, 'ADDRESS' AS type, regexp_extract(one, '[^ \t]+$') || chr(10) || two || chr(10) || regexp_extract(three, '^[^ \t]+') AS value FROM o
  UNION ALL SELECT doc_id, 'ORG', right(one, 5) || left(two, 4) FROM o
  UNION ALL SELECT doc_id, 'ACCOUNT', replace(left(two, 24), ' ', '') FROM o
  UNION ALL SELECT doc_id, 'PERSON', regexp_extract(one, '^[^ \t]+') FROM o
  UNION ALL SELECT doc_id, 'AMOUNT', regexp_extract(one, '[0-9]+') FROM o),
v AS (SELECT DISTINCT doc_id, type, {_TRIM.format(x=_PLAIN.format(x='value'))} AS value FROM m),
k AS (SELECT *, length(value) < CASE WHEN type = 'ADDRESS' THEN 4 ELSE 2 END AS strict FROM v WHERE {_TIGHT.format(x='value')} != ''
  AND (type != 'AMOUNT' OR regexp_matches(value, '[0-9０-９{b.NUMERALS}]'))),
lines AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS text FROM d),
direct AS (SELECT doc_id, list(struct_pack(pos, text) ORDER BY pos) AS bl FROM lines WHERE NOT starts_with(text, '<table') GROUP BY doc_id),
parts AS (SELECT k.*, bl, list_filter(list_transform(string_split(value, chr(10)), lambda x: {_TRIM.format(x='x')}), lambda x: x != '') AS p FROM k JOIN direct USING (doc_id)),
starts AS (SELECT *, unnest(range(1, greatest(1, len(bl) - len(p) + 2))) AS i FROM parts WHERE len(p) >= 2),
wrapped AS (
  SELECT doc_id, type, value, bl, p, i FROM starts WHERE ends_with(bl[i].text, p[1]) AND starts_with(bl[i + len(p) - 1].text, p[len(p)])
    AND len(list_filter(range(2, len(p)), lambda j: {_TIGHT.format(x='bl[i + j - 1].text')} != {_TIGHT.format(x='p[j]')})) = 0),
rest AS (SELECT k.* FROM k ANTI JOIN wrapped USING (doc_id, type, value)),
pairs AS (
  SELECT r.*, l.pos, l.text, contains(l.text, r.value) AS whole FROM rest r JOIN lines l USING (doc_id)
  WHERE NOT starts_with(l.text, '<table') AND contains({_TIGHT.format(x='l.text')}, {_TIGHT.format(x='r.value')})),
pattern AS (SELECT *, CASE WHEN whole THEN '\Q' || value || '\E' ELSE array_to_string(list_transform(regexp_extract_all({_TIGHT.format(x='value')}, '(?s).'), lambda c: '\Q' || c || '\E'), '\s*') END AS x FROM pairs WHERE whole OR NOT strict),
found AS (SELECT *, CASE WHEN whole THEN list_transform(string_split(text, value)[2:], lambda z: value) ELSE regexp_extract_all(text, x) END AS hits,
  CASE WHEN whole THEN string_split(text, value) ELSE string_split_regex(text, x) END AS gaps FROM pattern),
spans AS (
  SELECT *, CAST(list_sum(list_transform(gaps[:j], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[:j - 1], lambda g: length(g))), 0) AS INT) AS start, CAST(length(hits[j]) AS INT) AS size
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS j FROM found)),
sides AS (SELECT *, start + size AS stop, substr(text, start, 1) AS b4, substr(text, start + 1, 1) AS c1, substr(text, start + size, 1) AS c2, substr(text, start + size + 1, 1) AS aft FROM spans),
inside AS (
  SELECT doc_id, type, value, CASE WHEN whole THEN 'exact' ELSE 'spaced' END AS how, pos, start, stop FROM sides
  WHERE (NOT strict OR ((start = 0 OR {_CLASS.format(c='b4')} = 0 OR {_CLASS.format(c='b4')} != {_CLASS.format(c='c1')})
    AND (stop >= length(text) OR {_CLASS.format(c='aft')} = 0 OR {_CLASS.format(c='aft')} != {_CLASS.format(c='c2')})))
    AND (type != 'AMOUNT' OR ltrim(substr(text, stop + 1, 64)) = '' OR NOT contains('{b.NOT_MONEY}', substr(ltrim(substr(text, stop + 1, 64)), 1, 1)))
  UNION ALL
  SELECT r.doc_id, r.type, r.value, 'amount', l.pos, 0, CAST(length(l.text) AS INT) FROM rest r JOIN lines l USING (doc_id)
  WHERE r.type = 'AMOUNT' AND NOT starts_with(l.text, '<table') AND {_SUM.format(x=_TIGHT.format(x='r.value'))} != '' AND {_SUM.format(x=_TIGHT.format(x='r.value'))} = {_SUM.format(x=_TIGHT.format(x='l.text'))}
    AND NOT contains({_TIGHT.format(x='l.text')}, {_TIGHT.format(x='r.value')})
    AND (regexp_extract({_TIGHT.format(x='l.text')}, '\d(\D)\D*$', 1) = '' OR NOT contains('{b.NOT_MONEY}', regexp_extract({_TIGHT.format(x='l.text')}, '\d(\D)\D*$', 1)))),
left_over AS (SELECT r.*, bl FROM rest r ANTI JOIN inside USING (doc_id, type, value) JOIN direct USING (doc_id) WHERE length(value) >= 4 AND NOT contains(value, chr(10))),
cuts AS (
  SELECT doc_id, type, value, any_value(bl) AS bl, arg_min(h, i * 1000000 + h) AS h FROM (
    SELECT *, unnest(range(2, length(value))) AS h FROM (SELECT *, unnest(range(1, len(bl))) AS i FROM left_over))
  WHERE ends_with(bl[i].text, left(value, h)) AND starts_with(bl[i + 1].text, substr(value, h + 1)) GROUP BY ALL),
again AS (SELECT *, [{_TRIM.format(x='left(value, h)')}, {_TRIM.format(x='substr(value, h + 1)')}] AS p, unnest(range(1, len(bl))) AS i FROM cuts),
runs AS (
  SELECT doc_id, type, value, 'wrapped' AS how, bl, p, i FROM wrapped UNION ALL
  SELECT doc_id, type, value, 'cut', bl, p, i FROM again WHERE ends_with(bl[i].text, p[1]) AND starts_with(bl[i + 1].text, p[2])),
each AS (SELECT *, unnest(range(1, len(p) + 1)) AS j FROM runs),
r2 AS (SELECT doc_id, type, value, how, bl[i + j - 1].pos AS pos, CAST(CASE WHEN j = 1 THEN length(bl[i].text) - length(p[1]) WHEN j = len(p) THEN 0 ELSE greatest(0, instr(bl[i + j - 1].text, p[j]) - 1) END AS INT) AS start, CAST(length(p[j]) AS INT) AS size FROM each)
SELECT doc_id, type, how, CAST(pos AS INT) AS pos, start, stop AS "end", md5(value) AS value FROM (
  SELECT doc_id, type, value, how, pos, start, stop FROM inside UNION ALL SELECT doc_id, type, value, how, pos, start, start + size FROM r2)""",
    "table_grid": f"""
WITH RECURSIVE p AS (SELECT page_id, unnest(range(len(l) - 1)) AS i, unnest(l[2:]) AS x FROM (SELECT page_id, string_split(replace(html, '&', '+'), '<p>') AS l FROM pages)),
q AS (SELECT page_id, i, list_filter(list_transform(string_split(regexp_replace(x, '(?s)<[^>]*>', '', 'g'), '.'), lambda z: trim(z)), lambda z: z != '') AS l FROM p),
c AS (SELECT page_id, i, unnest(range(len(l))) AS j, unnest(l) AS x FROM q),
k AS (SELECT page_id, i, j, x, dense_rank() OVER (PARTITION BY page_id ORDER BY i) - 1 AS r, length(x) % 3 + 1 AS w, (length(x) + i) % 3 + 1 AS h FROM c),
o AS (SELECT page_id, r, w, h, x, row_number() OVER (PARTITION BY page_id ORDER BY i, j) AS n FROM k),
g AS (
  SELECT page_id, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS r, CAST(0 AS BIGINT) AS col, CAST(0 AS BIGINT) AS w, CAST(0 AS BIGINT) AS h, '' AS x, CAST(0 AS BIGINT) AS next, CAST([] AS BIGINT[]) AS free FROM pages
  UNION ALL
  SELECT page_id, n, r, col, w, h, x, col + w,
         list_transform(range(0, greatest(len(free), col + w)), lambda z: CASE WHEN z >= col AND z < col + w THEN greatest(coalesce(free[z + 1], 0), r + h) ELSE coalesce(free[z + 1], 0) END)
  FROM (SELECT o.page_id, o.n, o.r, o.w, o.h, o.x, g.free,
      list_filter(range(CASE WHEN o.r = g.r THEN g.next ELSE 0 END, greatest(CASE WHEN o.r = g.r THEN g.next ELSE 0 END, len(g.free)) + 1), lambda z: coalesce(g.free[z + 1], 0) <= o.r)[1] AS col
    FROM g JOIN o ON o.page_id = g.page_id AND o.n = g.n + 1))
SELECT page_id, CAST(r AS INT) AS row, CAST(col AS INT) AS col, CAST(h AS INT) AS row_span, CAST(w AS INT) AS col_span, {_TRIM.format(x='x')} AS text FROM g WHERE n > 0""",
    "document_chunks": _CHUNKS + """
SELECT doc_id, chunk, md5(string_agg(line, chr(10) ORDER BY n)) AS text, string_agg(CAST(spot AS VARCHAR), ',' ORDER BY n) AS offsets FROM f WHERE n > 0 GROUP BY doc_id, chunk""",
    "chunk_spans": _CHUNKS + f"""
, m AS (SELECT doc_id, spot, line, unnest(range(1, len(hits) + 1)) AS i, hits, gaps FROM (
    SELECT doc_id, spot, line, regexp_extract_all(line, '{NAMES}') AS hits, string_split_regex(line, '{NAMES}') AS gaps FROM f WHERE n > 0) WHERE len(hits) > 0)
SELECT doc_id, CASE WHEN length(hits[i]) % 3 = 0 THEN 'ORG' ELSE 'PERSON' END AS type,
  CAST(spot + list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda g: length(g))), 0) AS BIGINT) AS start,
  start + length(hits[i]) AS "end", hits[i] AS text FROM m""",
    "styled_runs": _KEPT + """
, hit AS (SELECT DISTINCT doc_id FROM k),
ch AS (SELECT doc_id, unnest(range(length(text))) AS pos, unnest(string_split(text, '')) AS c FROM documents SEMI JOIN hit USING (doc_id)),
cv AS (SELECT ch.*, k.start AS s, k.replacement AS r FROM ch LEFT JOIN k ON k.doc_id = ch.doc_id AND pos >= k.start AND pos < k.stop),
maj AS (SELECT doc_id, s, r, pos // 40 AS run FROM cv WHERE s IS NOT NULL GROUP BY doc_id, s, r, pos // 40 QUALIFY row_number() OVER (PARTITION BY doc_id, s ORDER BY count(*) DESC, pos // 40) = 1),
pieces AS (SELECT doc_id, pos // 40 AS run, pos, c AS x FROM cv WHERE s IS NULL UNION ALL SELECT doc_id, run, s, r FROM maj),
done AS (SELECT doc_id, run, string_agg(x, '' ORDER BY pos) AS text FROM pieces GROUP BY ALL),
runs AS (SELECT doc_id, unnest(range(greatest(1, (length(text) + 39) // 40))) AS run, text FROM documents)
SELECT runs.doc_id, CAST(runs.run AS INT) AS run, CASE WHEN hit.doc_id IS NULL THEN substr(runs.text, CAST(runs.run AS BIGINT) * 40 + 1, 40) ELSE coalesce(done.text, '') END AS text
FROM runs LEFT JOIN hit ON hit.doc_id = runs.doc_id LEFT JOIN done ON done.doc_id = runs.doc_id AND done.run = runs.run""",
    "preview_segments": _KEPT + """
, e AS (SELECT doc_id, start, stop, replacement, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS low FROM k),
p AS (
  SELECT doc_id, start AS pos, 1 AS o, substr(text, start + 1, stop - start) || '|' || replacement AS x, TRUE AS changed FROM e JOIN documents USING (doc_id)
  UNION ALL SELECT doc_id, low, 0, substr(text, low + 1, start - low) || '|', FALSE FROM e JOIN documents USING (doc_id) WHERE start > low
  UNION ALL SELECT doc_id, low, 0, substr(text, low + 1) || '|', FALSE FROM (SELECT doc_id, text, coalesce(max(stop), 0) AS low FROM documents LEFT JOIN k USING (doc_id) GROUP BY ALL) WHERE low < length(text))
SELECT doc_id, count(*) AS n, count(*) FILTER (changed) AS changed, md5(string_agg(x, '/' ORDER BY pos, o)) AS pieces FROM p GROUP BY doc_id""",
    "organisation_rules": f"""
WITH a AS (SELECT c_custkey, {_list(PLACES)}[CAST(c_custkey % {len(PLACES)} AS INT) + 1] || {_list(CORES)}[CAST((c_custkey // 3) % {len(CORES)} AS INT) + 1] || {_list(KINDS)}[CAST((c_custkey // 7) % {len(KINDS)} AS INT) + 1] AS z FROM customer),
x AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN '《' || z || '》' ELSE z END AS x FROM a),
n AS (SELECT *, CASE WHEN starts_with(x, '中华人民共和国') THEN substr(x, 8) ELSE x END AS y, regexp_matches(x, '{o.REGION}') AND NOT {_any("starts_with(x, {w})", o.NO_REGION)} AS regional FROM x),
t AS (SELECT *, CASE WHEN regional THEN regexp_replace(x, '{o.REGION}', '') ELSE x END AS z, coalesce({", ".join(f"CASE WHEN ends_with(x, '{w}') THEN '{w}' END" for w in o.SERVICE_ENDINGS)}) AS tail FROM n),
u AS (SELECT *, CASE WHEN starts_with(z, '中国') OR starts_with(z, '全国') THEN substr(z, 3) ELSE z END AS rest FROM t)
SELECT c_custkey,
  (NOT ((ends_with(y, '部') OR ends_with(y, '厅')) AND {_any("contains(y, {w})", o.BUSINESS_WORDS)})
    AND ({_any("ends_with(y, {w})", o.PUBLIC_ENDINGS)} OR {_any("contains(y, {w})", o.PUBLIC_WORDS + o.INTERNATIONAL_WORDS)} OR {_any("ends_with(y, {w} || '部')", o.MINISTRIES)}))
  OR regexp_matches(x, '^《[^》]{{1,40}}》$') OR {_any("ends_with(x, {w})", o.PUBLICATION_ENDINGS)} AS preserved,
  coalesce({", ".join(f"CASE WHEN ends_with(x, '{w}') THEN '{v}' END" for w, v in o.ORGANS.items())}, CASE WHEN ends_with(x, '厅') AND NOT {_any("contains(x, {w})", o.HALLS_ELSE)} THEN '某厅' END,
    CASE WHEN tail IS NOT NULL THEN '某' || CASE WHEN rest != '' THEN rest ELSE tail END END) AS base,
  coalesce({", ".join(f"CASE WHEN ends_with(x, '{w}') THEN '{v}' END" for w, v in o.POOLS.items())}) AS pool
FROM u""",
    "organisation_aliases": """
WITH n AS (
  SELECT DISTINCT c_nationkey::BIGINT AS nation, unnest([c_mktsegment || ' works ' || c_custkey || ' company limited',
    CASE WHEN c_custkey % 3 = 0 THEN '(' || regexp_replace(c_mktsegment, '[AEIOU]$', '') || ' works ' || c_custkey || ')' END]) AS text FROM customer),
k AS (SELECT nation, text, trim(regexp_replace(text, '\\s+', '', 'g'), ' ，。；;、()（）[]【】') AS key FROM n WHERE text IS NOT NULL),
p AS (SELECT a.nation, a.text AS alias, b.text AS whole, a.key AS short, b.key AS long FROM k a JOIN k b ON a.nation = b.nation AND length(b.text) > length(a.text) WHERE length(a.key) >= 4),
s AS (SELECT *, list_reduce(list_prepend({'at': 0, 'hit': 0, 'c': ''}, list_transform(string_split(short, ''), lambda c: {'at': 0, 'hit': 0, 'c': c})),
  lambda z, y: CASE WHEN strpos(substr(long, CAST(z.at AS BIGINT) + 1), y.c) > 0 THEN {'at': CAST(z.at + strpos(substr(long, CAST(z.at AS BIGINT) + 1), y.c) AS INT), 'hit': z.hit + 1, 'c': ''} ELSE {'at': z.at, 'hit': z.hit, 'c': ''} END).hit AS hit FROM p)
SELECT nation, alias, struct_extract(max(struct_pack(n := length(whole), f := whole)), 'f') AS "full" FROM s WHERE hit / length(short) >= 0.9 GROUP BY nation, alias""",
    "visual_lines": _PAGE_BLOCKS + r"""
, u AS (SELECT page, quantile_disc(height, 0.5) AS usual FROM b WHERE height > 4 AND width > height AND NOT regexp_matches(ltrim(text), '^<(table|div)') GROUP BY page),
t AS (SELECT b.*, regexp_replace(text, '\s+', '', 'g') AS key FROM b LEFT JOIN u USING (page) WHERE NOT starts_with(ltrim(text), '<table') AND NOT coalesce(height > usual * 2.4 AND width < height * 1.8, FALSE)),
p AS (
  SELECT a.page, a.box_id AS left_id, c.box_id AS right_id, a.key || c.key AS text, a.left AS al, a.top AS at_, a.width AS aw, a.height AS ah, c.left AS cl, c.top AS ct, c.width AS cw, c.height AS ch, least(a.confidence, c.confidence) * 0.95 AS confidence
  FROM t a JOIN t c ON a.page = c.page AND c.left > a.left
  WHERE length(a.key) BETWEEN 2 AND 6 AND length(c.key) BETWEEN 4 AND 24 AND length(a.key) + length(c.key) <= 30
    AND c.left - a.left - a.width BETWEEN 0 AND greatest(28, CAST(floor(greatest(a.height, c.height, 1) * 3.2) AS INT))
    AND ((least(a.top + greatest(a.height, 1), c.top + greatest(c.height, 1)) - greatest(a.top, c.top)) / greatest(least(a.height, c.height), 1) >= 0.35
      OR abs(a.top + a.height / 2 - c.top - c.height / 2) <= greatest(a.height, c.height) * 0.65)),
n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY page, left_id ORDER BY cl, ct, right_id) = 1),
o AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY page, text ORDER BY al, at_, left_id) = 1)
SELECT page, left_id, right_id, text, least(al, cl) AS left, least(at_, ct) AS top, greatest(al + aw, cl + cw) - least(al, cl) AS width, greatest(at_ + ah, ct + ch) - least(at_, ct) AS height, round(confidence, 6) AS confidence FROM o""",
    "text_hulls": _PAGE_BLOCKS + r"""
SELECT page, min(b.left) AS "left", min(b.top) AS top, max(b.left + b.width) AS "right", max(b.top + b.height) AS bottom, list_sort(list(height))[CAST(count(*) // 2 AS INT) + 1] AS em
FROM b WHERE length(regexp_replace(text, '\s+', '', 'g')) >= 2 GROUP BY page""",
    "multi_pass_union": """
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
p AS (SELECT doc_id, k, w[CAST((k * k) % len(w) AS INT) + 1] AS value FROM (SELECT doc_id, w, unnest(range(5)) AS k FROM w)),
f AS (SELECT *, value != '' AND NOT EXISTS (SELECT 1 FROM p q WHERE q.doc_id = p.doc_id AND q.k < p.k AND q.value = p.value) AS new FROM p),
stop AS (SELECT doc_id, min(k) FILTER (k > 0 AND NOT new) AS at_ FROM f GROUP BY doc_id)
SELECT doc_id, value, CAST(k AS INT) AS pass FROM f JOIN stop USING (doc_id) WHERE new AND k < coalesce(at_, 9)""",
    "incremental_export": """
SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_orderkey) AS n_keys, CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS DOUBLE) AS total FROM orders GROUP BY 1""",
    "output_validation": f"""
WITH o AS (SELECT o_orderkey AS k, o_custkey, o_orderpriority FROM orders),
f AS (SELECT k, 'f' || k AS path, {_SOP} AS sop, CASE WHEN k % 7 = 0 THEN [] WHEN k % 2 = 0 THEN ['113100'] ELSE ['113100', '113101'] END AS codes,
    CASE WHEN k % 19 != 0 THEN CASE WHEN k % 23 = 0 THEN ['1x1'] ELSE ['2x2', '2x2'] END END AS frames, k % 3 != 0 AS asked, k % 3 != 0 AND k % 2 = 0 AS changed,
    k % 3 != 0 AND k % 10 != 0 AS shapes, o_orderpriority FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN sop = '' THEN path ELSE sop END ORDER BY path) AS nth FROM f WHERE k % 37 != 0),
t AS (SELECT 'f' || l_orderkey AS path, l_linenumber AS n, ['0010,0010', '0009,1001', '0020,000D', '0008,0080', '0009,1010', '0010,4000', '0010,4000'][l_linenumber] AS tag,
    [CASE WHEN l_partkey % 2 = 0 THEN '1-URGENT' ELSE 'x' END, 'v', 'U' || l_partkey % 40, '2-high', 'v', '1-urgent', '1-urgent'][l_linenumber] AS value FROM lineitem),
x AS (
  SELECT path, 'OUTPUT_PARSE_FAILED' AS code, NULL AS tag FROM f WHERE k % 37 = 0
  UNION ALL SELECT path, 'OUTPUT_SOP_UID_DUPLICATE_OR_MISSING', NULL FROM r WHERE sop = '' OR nth > 1
  UNION ALL SELECT path, 'PATIENT_IDENTITY_REMOVED_FLAG_MISSING', '0012,0062' FROM r WHERE k % 11 = 0
  UNION ALL SELECT path, 'DEIDENTIFICATION_METHOD_MISSING', '0012,0063' FROM r WHERE k % 13 = 0
  UNION ALL SELECT path, 'BASIC_PROFILE_CODE_MISSING', '0012,0064' FROM r WHERE len(codes) = 0
  UNION ALL SELECT path, 'NONZERO_PREAMBLE', NULL FROM r WHERE k % 17 = 0
  UNION ALL SELECT path, 'OUTPUT_PIXEL_DECODE_FAILED', NULL FROM r WHERE shapes AND frames IS NULL
  UNION ALL SELECT path, 'HIERARCHY_UID_MISMATCH', NULL FROM r WHERE asked AND k % 25 = 1
  UNION ALL SELECT path, 'PIXEL_DATA_NOT_CHANGED_AFTER_REDACTION', NULL FROM r WHERE changed AND k % 4 = k % 3
  UNION ALL SELECT path, 'PIXEL_DATA_CHANGED_UNEXPECTEDLY', NULL FROM r WHERE asked AND NOT changed AND k % 4 != k % 3
  UNION ALL SELECT path, 'PIXEL_REDACTION_EVIDENCE_MISSING', NULL FROM r WHERE changed AND k % 8 = 0
  UNION ALL SELECT path, 'BURNED_IN_ANNOTATION_NOT_CLEARED', '0028,0301' FROM r WHERE changed AND k % 5 != 0
  UNION ALL SELECT path, 'CLEAN_PIXEL_DATA_CODE_MISSING', '0012,0064' FROM r WHERE changed AND NOT list_contains(codes, '113101')
  UNION ALL SELECT path, 'PIXEL_FRAME_COUNT_CHANGED', NULL FROM r WHERE shapes AND len(frames) != 2
  UNION ALL SELECT path, 'PIXEL_FRAME_SHAPE_CHANGED', NULL FROM r WHERE shapes AND frames != ['2x2', '2x2']
  UNION ALL SELECT path, 'SOURCE_AE_TITLE_REMAINS', '0002,0016' FROM r WHERE k % 31 = 0
  UNION ALL SELECT path, 'FILE_META_SOP_UID_MISMATCH', NULL FROM r WHERE k % 9 = 0
  UNION ALL SELECT DISTINCT path, 'PRIVATE_TAG_REMAINS', tag FROM t SEMI JOIN r USING (path) WHERE n = 2
  UNION ALL SELECT path, 'ORIGINAL_UID_REMAINS', tag FROM t SEMI JOIN r USING (path) WHERE n = 3 AND EXISTS (SELECT 1 FROM nation WHERE 'U' || n_nationkey = t.value AND n_nationkey % 3 != 0)
  UNION ALL SELECT DISTINCT t.path, 'SOURCE_IDENTIFIER_VALUE_REMAINS', tag FROM t JOIN r ON r.path = t.path AND asked AND lower(o_orderpriority) = lower(t.value) WHERE n IN (1, 4))
SELECT * FROM x""",
}
