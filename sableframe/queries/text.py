"""Entities, replacement and leaks in documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import entities as e
from ..operators import evaluate as v
from .tabular import load


def entity_counts_by_type(spark: SparkSession, d: str) -> DataFrame:
    return e.counts_by_type(load(spark, d, "documents")).groupBy("type").agg(F.sum("n").alias("n_matches"), F.count("*").alias("n_documents"))


def entity_spans(spark: SparkSession, d: str) -> DataFrame:
    return e.spans(load(spark, d, "documents")).select("doc_id", "type", "text", "start", "end")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return e.spans(load(spark, d, "documents"), {k: e.PATTERNS[k] for k in ("EMAIL", "IP_ADDRESS", "BANK_CARD", "PHONE")})


def settled_entities(spark: SparkSession, d: str) -> DataFrame:
    return e.ordered(e.settled(e.spans(load(spark, d, "documents")))).select("doc_id", "entity_id", "type", "text", "start")


def overlap_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order, as intervals of days, that no returned line of the order overlaps."""
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("long")
    lines = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_returnflag", day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("end"))
    rest = e.without_overlaps(lines.where("l_returnflag != 'R'"), lines.where("l_returnflag = 'R'"))
    return rest.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("start").alias("days"))


def overlap_clusters(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = load(spark, d, "events").select(F.col("event_type").alias("doc_id"), at.alias("start"), (at + (F.col("value") * 1000000).cast("long") + 1).alias("end"))
    return e.clustered(rows).groupBy("doc_id").agg(F.max("cluster").alias("clusters"), F.count("*").alias("n")).withColumnRenamed("doc_id", "event_type")


def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return docs.select("doc_id", F.md5(e.masked_by_pattern(F.col("text")).cast("binary")).alias("md5"))


def replaced_documents(spark: SparkSession, d: str) -> DataFrame:
    docs, found = load(spark, d, "documents"), e.numbered(_spans(spark, d))
    mapping = found.select("doc_id", F.col("text").alias("original"), e.tag_label(F.col("type"), F.col("index")).alias("replacement")).distinct()
    one = mapping.groupBy("doc_id", "original").agg(F.min("replacement").alias("replacement"))
    out = e.replaced(docs, one)
    left = e.residual(one, out).groupBy("doc_id").agg(F.count("*").alias("residual"))
    return out.join(left, "doc_id", "left").select("doc_id", "replaced", F.coalesce("residual", F.lit(0)).alias("residual"), F.char_length("text").alias("n_chars"))


def structured_tags(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a segment numbered by their first order, as tags."""
    orders, customer = load(spark, d, "orders"), load(spark, d, "customer")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("c_nationkey").cast("long").alias("doc_id"), F.col("c_mktsegment").alias("type"), F.col("c_name").alias("text"), F.col("o_orderkey").alias("start")
    )
    done = e.numbered(rows).select("doc_id", "type", "text", "index").distinct()
    return done.select(F.col("doc_id").alias("nation"), "text", e.tag_label(F.col("type"), F.col("index")).alias("tag"))


def smart_numbering(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("type"), F.col("event_type").alias("text"), F.col("event_id").alias("start"))
    w = Window.partitionBy("doc_id").orderBy("first")
    first = rows.groupBy("doc_id", "type").agg(F.min("start").alias("first")).withColumn("index", F.row_number().over(w))
    return first.select(F.col("doc_id").alias("user_id"), "type", e.smart_label(F.col("type"), F.col("index")).alias("label"))


def pseudonym_pool(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("doc_id"), F.lit("ORG").alias("type"), F.col("c_name").alias("text"), F.col("c_custkey").alias("start"))
    pool = spark.range(1, 6).select(F.lit("ORG").alias("type"), F.col("id").cast("int").alias("position"), F.concat(F.lit("Firm "), F.chr(F.col("id") + 64)).alias("word"))
    return e.pool_names(rows, pool).select(F.col("doc_id").alias("nation"), "text", "replacement")


def residual_leaks(spark: SparkSession, d: str) -> DataFrame:
    products = load(spark, d, "documents").select("doc_id", e.masked_by_pattern(F.col("text")).alias("text"))
    originals = _spans(spark, d).select("doc_id", F.col("text").alias("original"), F.lit("").cast("string").alias("replacement")).distinct()
    return e.residual(originals.withColumn("replacement", F.lit("*")), products).groupBy().agg(F.count("*").alias("n"))


def benchmark_leaks(spark: SparkSession, d: str) -> DataFrame:
    return v.leaks(load(spark, d, "benchmark"), load(spark, d, "documents"))


def exact_block_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a document, each once: how many there are and how many stay, by their form without white space."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, "[ \t\r\n]+", "")), lambda x: x != "")
    return load(spark, d, "documents").select("doc_id", F.size(lines).alias("n_blocks"), F.size(F.array_distinct(lines)).alias("n_kept"))


def fragmented_text(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", F.regexp_replace("text", "[ .,]+", "\n").alias("text"))
    return docs.select("doc_id", t.fragmented(F.col("text")).alias("fragmented"))


def html_pages(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", F.md5(t.html_text(F.col("html")).cast("binary")).alias("md5"))


def page_of_spans(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages by line; the page on which each e-mail address stands."""
    docs = load(spark, d, "documents")
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    found = e.spans(docs, {"EMAIL": e.PATTERNS["EMAIL"]}).select("doc_id", "text", "start")
    return e.paged(found, pages, 1).select("doc_id", "text", "start", "page")


def conversation_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation in order, with the role before and the characters so far."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return load(spark, d, "conversations").select(
        "conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.sum(F.char_length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("chars")
    )


def _truth(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Labels as true values, a simple rule (few words, or a repeated first word) as what was found."""
    labels, docs = load(spark, d, "labels"), load(spark, d, "documents")
    truth = labels.select(F.col("doc_id").alias("page_id"), F.lit("quality").alias("type"), F.col("quality").cast("string").alias("value")).union(
        labels.select("doc_id", F.lit("toxic"), F.col("toxic").cast("string"))
    )
    rule = F.when(F.col("n_chars") < 300, "0").otherwise("1")
    found = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("page_id"), F.lit("quality").alias("type"), rule.alias("value"))
    return truth, found.union(docs.join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.lit("toxic"), F.when(F.col("n_chars") % 2 == 0, "0").otherwise("1")))


def prf_metrics(spark: SparkSession, d: str) -> DataFrame:
    return v.scores(*_truth(spark, d)).select("type", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def digit_grading(spark: SparkSession, d: str) -> DataFrame:
    cards = load(spark, d, "customer").select(F.col("c_nationkey").alias("page_id"), F.format_string("%04d-%04d", F.col("c_custkey") % 100, F.col("c_custkey")).alias("value"), "c_custkey")
    found = cards.where("c_custkey % 5 != 0").select("page_id", F.when(F.col("c_custkey") % 3 == 0, F.replace("value", F.lit("-"), F.lit(" "))).otherwise(F.col("value")).alias("value"))
    return v.graded(cards, found).groupBy("grade").agg(F.count("*").alias("n"))


def confusion_top10(spark: SparkSession, d: str) -> DataFrame:
    e0 = load(spark, d, "events")
    truth = e0.select(F.col("user_id").alias("page_id"), F.col("event_id").alias("value"), F.col("event_type").alias("type"))
    found = e0.select(F.col("user_id").alias("page_id"), F.col("event_id").alias("value"), F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("type"))
    return v.confusions(truth, found)


QUERIES = {
    f.__name__: f
    for f in (
        entity_counts_by_type, entity_spans, settled_entities, overlap_anti_join, overlap_clusters, redacted_documents, replaced_documents, structured_tags, smart_numbering,
        pseudonym_pool, residual_leaks, benchmark_leaks, exact_block_dedup, fragmented_text, html_pages, page_of_spans, conversation_turns, prf_metrics, digit_grading, confusion_top10,
    )
}

_MASK = "text"
for _kind, _pattern in e.PATTERNS.items():
    _MASK = f"regexp_replace({_MASK}, '{_pattern}', '<{_kind}>', 'gi')"
_STRONG = "upper(regexp_replace({x}, '[\\s" + t.MARKS.replace("'", "''") + "]+', '', 'g'))"
_BARE = "regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _name, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _BARE = f"replace({_BARE}, '{_name}', '{_char}')"
_NUMBERED = "row_number() OVER (PARTITION BY {by} ORDER BY first, text)"

# Spans by position: the text is cut at each match in turn, so offsets are sums of lengths.
def _spans_sql(kinds: list[str]) -> str:
    one = """
  SELECT doc_id, '{k}' AS type, m[i] AS text, (i - 1) AS nth,
    list_sum(list_transform(gaps[:i], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform(m[:i - 1], lambda g: length(g))), 0)::BIGINT AS start
  FROM (SELECT doc_id, m, gaps, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '{x}', 0, 'i') AS m, string_split_regex(text, '(?i){x}') AS gaps FROM documents) WHERE len(m) > 0)"""
    return " UNION ALL ".join(one.format(k=k, x=e.PATTERNS[k]) for k in kinds)


SQL = {
    "entity_spans": f"SELECT doc_id, type, text, start, start + length(text) AS \"end\" FROM ({_spans_sql(list(e.PATTERNS))})",
    "residual_leaks": f"""
WITH s AS ({_spans_sql(["EMAIL", "IP_ADDRESS", "BANK_CARD", "PHONE"])}), p AS (SELECT doc_id, {_MASK} AS product FROM documents)
SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, text FROM s) JOIN p USING (doc_id)
WHERE text != '*' AND (contains(product, text) OR contains(regexp_replace(product, '\\s+', '', 'g'), regexp_replace(text, '\\s+', '', 'g')))""",
    "page_of_spans": f"""
WITH s AS ({_spans_sql(["EMAIL"])}),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS page FROM documents),
ends AS (SELECT doc_id, page, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY page) AS past FROM lines)
SELECT s.doc_id, s.text, s.start, min(page)::INT AS page FROM s JOIN ends ON ends.doc_id = s.doc_id AND s.start < past GROUP BY ALL""",
    "entity_counts_by_type": " UNION ALL ".join(
        f"SELECT '{k}' AS type, sum(n)::BIGINT AS n_matches, count(*) AS n_documents FROM (SELECT len(regexp_extract_all(text, '{x}', 0, 'i')) AS n FROM documents) WHERE n > 0 HAVING count(*) > 0"
        for k, x in e.PATTERNS.items()
    ),
    "overlap_anti_join": """
WITH l AS (SELECT l_orderkey, l_returnflag, (l_shipdate::DATE - DATE '1970-01-01')::BIGINT AS s, (l_shipdate::DATE - DATE '1970-01-01')::BIGINT + l_quantity::BIGINT AS e FROM lineitem)
SELECT l_returnflag, count(*) AS n, sum(s)::BIGINT AS days FROM l a WHERE l_returnflag != 'R'
  AND NOT EXISTS (SELECT 1 FROM l b WHERE b.l_returnflag = 'R' AND a.l_orderkey = b.l_orderkey AND a.s < b.e AND a.e > b.s) GROUP BY 1""",
    "overlap_clusters": """
WITH i AS (SELECT event_type, epoch_us(ts) AS s, epoch_us(ts) + trunc(value * 1000000)::BIGINT + 1 AS e FROM events),
o AS (SELECT *, max(e) OVER (PARTITION BY event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i)
SELECT event_type, sum(CASE WHEN m IS NULL OR s >= m THEN 1 ELSE 0 END)::BIGINT AS clusters, count(*) AS n FROM o GROUP BY 1""",
    "redacted_documents": f"SELECT doc_id, md5({_MASK}) AS md5 FROM documents",
    "structured_tags": f"""
SELECT nation, text, '<' || type || '_' || lpad(i::VARCHAR, 3, '0') || '>' AS tag FROM (
  SELECT nation, type, text, {_NUMBERED.format(by='nation, type')} AS i FROM (
    SELECT c_nationkey::BIGINT AS nation, c_mktsegment AS type, c_name AS text, min(o_orderkey) AS first FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL))""",
    "smart_numbering": """
SELECT user_id, event_type AS type, '[' || event_type || coalesce(['一','二','三','四','五','六','七','八','九','十'][i], i::VARCHAR) || ']' AS label FROM (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS i FROM events GROUP BY user_id, event_type)""",
    "pseudonym_pool": """
SELECT nation, text, CASE WHEN i <= 5 THEN 'Firm ' || chr(64 + i::INT) ELSE 'Firm E' || (i - 5)::VARCHAR END AS replacement FROM (
  SELECT c_nationkey::BIGINT AS nation, c_name AS text, row_number() OVER (PARTITION BY c_nationkey ORDER BY min(c_custkey), c_name) AS i FROM customer GROUP BY c_nationkey, c_name)""",
    "benchmark_leaks": f"""
SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, {_STRONG.format(x='text')} AS p FROM documents) JOIN (SELECT item_id, {_STRONG.format(x='text')} AS o FROM benchmark) ON contains(p, o) WHERE length(o) >= 4""",
    "exact_block_dedup": """
SELECT doc_id, len(l)::INT AS n_blocks, len(list_distinct(l))::INT AS n_kept FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '[ \t\r\n]+', '', 'g')), lambda x: x != '') AS l FROM documents)""",
    "fragmented_text": """
SELECT doc_id, len(l) >= 5 AND coalesce(list_sum(l), 0) < len(l) * 12 AND len(list_filter(l, lambda x: x <= 2)) * 10 > len(l) * 3 AS fragmented FROM (
  SELECT doc_id, list_transform(list_filter(string_split(regexp_replace(text, '[ .,]+', chr(10), 'g'), chr(10)), lambda x: trim(x) != ''), lambda x: length(trim(x))) AS l FROM documents)""",
    "html_pages": f"SELECT page_id, md5(trim(regexp_replace({_BARE}, '\\s+', ' ', 'g'))) AS md5 FROM pages",
    "conversation_turns": """
SELECT conv_id, turn, role, lag(role) OVER w AS before, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS chars
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "prf_metrics": """
WITH t AS (SELECT DISTINCT doc_id, 'quality' AS type, quality::VARCHAR AS value FROM labels UNION SELECT doc_id, 'toxic', toxic::VARCHAR FROM labels),
f AS (SELECT doc_id, 'quality' AS type, CASE WHEN n_chars < 300 THEN '0' ELSE '1' END AS value FROM documents SEMI JOIN labels USING (doc_id)
  UNION SELECT doc_id, 'toxic', CASE WHEN n_chars % 2 = 0 THEN '0' ELSE '1' END FROM documents SEMI JOIN labels USING (doc_id)),
j AS (SELECT coalesce(t.type, f.type) AS type, t.value IS NOT NULL AS a, f.value IS NOT NULL AS b FROM t FULL JOIN f ON t.doc_id = f.doc_id AND t.type = f.type AND t.value = f.value),
n AS (SELECT type, count(*) FILTER (a AND b) AS tp, count(*) FILTER (NOT a) AS fp, count(*) FILTER (NOT b) AS fn FROM j GROUP BY ROLLUP (type))
SELECT type, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1 FROM n""",
    "digit_grading": """
SELECT CASE WHEN c_custkey % 5 = 0 THEN 'miss' WHEN c_custkey % 3 = 0 THEN 'near_miss' ELSE 'exact' END AS grade, count(*) AS n FROM customer GROUP BY 1""",
    "confusion_top10": """
SELECT true_type, found_type, count(*) AS n FROM (
  SELECT event_type AS true_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS found_type FROM events)
WHERE true_type != found_type GROUP BY ALL ORDER BY n DESC, true_type, found_type LIMIT 10""",
    "settled_entities": f"""
WITH s AS (SELECT doc_id, type, text, start, start + length(text) AS past FROM ({_spans_sql(list(e.PATTERNS))})),
o AS (SELECT *, CASE WHEN start >= coalesce(max(past) OVER (PARTITION BY doc_id ORDER BY start, past ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start) THEN 1 ELSE 0 END AS opens FROM s),
c AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY start, past ROWS UNBOUNDED PRECEDING) AS cluster FROM o),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, cluster ORDER BY past - start, start, type) = 1)
SELECT doc_id, 'entity_' || (row_number() OVER (PARTITION BY doc_id ORDER BY start, past, type) - 1) AS entity_id, type, text, start FROM b""",
    "replaced_documents": f"""
WITH RECURSIVE s AS ({_spans_sql(["EMAIL", "IP_ADDRESS", "BANK_CARD", "PHONE"])}),
f AS (SELECT doc_id, type, text, min(start) AS first FROM s GROUP BY ALL),
i AS (SELECT doc_id, text AS original, '<' || type || '_' || lpad((row_number() OVER (PARTITION BY doc_id, type ORDER BY first, text))::VARCHAR, 3, '0') || '>' AS tag FROM f),
one AS (SELECT doc_id, original, min(tag) AS replacement FROM i GROUP BY ALL),
g AS (SELECT doc_id, original, replacement, string_split(text, original) AS gaps FROM one JOIN documents USING (doc_id)),
m AS (SELECT doc_id, original, replacement, CAST(list_sum(list_transform(gaps[:j], lambda x: length(x))) + (j - 1) * length(original) AS BIGINT) AS start FROM (SELECT *, unnest(range(1, len(gaps))) AS j FROM g)),
n AS (SELECT doc_id, start, start + length(original) AS stop, replacement, row_number() OVER (PARTITION BY doc_id ORDER BY start, length(original) DESC) AS nth FROM m),
z AS (
  SELECT doc_id, nth, start, stop, replacement, stop AS past, TRUE AS keep FROM n WHERE nth = 1
  UNION ALL SELECT n.doc_id, n.nth, n.start, n.stop, n.replacement, CASE WHEN n.start >= z.past THEN n.stop ELSE z.past END, n.start >= z.past FROM z JOIN n ON n.doc_id = z.doc_id AND n.nth = z.nth + 1),
k AS (SELECT doc_id, start, stop, replacement, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS low FROM z WHERE keep),
t AS (SELECT doc_id, text, string_agg(substr(text, low + 1, start - low) || replacement, '' ORDER BY start) || substr(text, max(stop) + 1) AS product, count(*) AS replaced FROM k JOIN documents USING (doc_id) GROUP BY doc_id, text),
p AS (SELECT d.doc_id, coalesce(product, d.text) AS product, coalesce(replaced, 0) AS replaced FROM documents d LEFT JOIN t USING (doc_id)),
r AS (SELECT doc_id, count(*) AS residual FROM one JOIN p USING (doc_id) WHERE NOT contains(replacement, original)
  AND (contains(product, original) OR contains(regexp_replace(product, '\\s+', '', 'g'), regexp_replace(original, '\\s+', '', 'g'))) GROUP BY doc_id)
SELECT doc_id, replaced, coalesce(residual, 0) AS residual, CAST(length(product) AS INT) AS n_chars FROM p LEFT JOIN r USING (doc_id)""",
}
