"""Entities in running text: find spans, settle conflicts, number, replace, verify.

Spans are rows (doc_id, type, text, start, end, source, confidence) with
half-open offsets in code points. A document's spans fit one group; documents
are spread over the cluster.
"""

from __future__ import annotations

import functools
import re
import subprocess
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import compact

#: Built-in patterns by type, in ASCII classes that any SQL engine reads alike. All match without regard to case.
PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "IP_ADDRESS": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "URL_WEBSITE": r"https?://[^ \t\n<>\"]+",
    "BANK_CARD": r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}",
    "PHONE": r"\+[0-9]{1,3}[ -][0-9]{2,4}(?:[ -][0-9]{2,4}){1,3}",
    "AUTH_SECRET": r"(?:token|secret|api_key|password)[ =:]+[A-Za-z0-9_-]{8,}",
}
#: What a text must contain for a match of a pattern; patterns without such a cue are always tried.
CUES = {"EMAIL": "@", "URL_WEBSITE": "://", "PHONE": "+"}
# Which type and which source wins between overlapping spans.
TYPE_PRIORITY = {
    "BIRTH_DATE": 4, "GENDER": 4, "ETHNICITY": 4, "DOCUMENT_NUMBER": 4, "LICENSE_PLATE": 4, "ADDRESS": 3,
    "ORG": 2, "PERSON": 2, "LEGAL_PARTY": 2, "LAWYER": 2, "JUDGE": 2,
}
SOURCE_RANK = {"regex": 3, "model": 2, "llm": 2, "manual": 1}
SPAN = "doc_id long, type string, text string, start long, end long, source string, confidence double"


#: Texts on which a user's pattern is tried, and the seconds that all of them may take.
PROBES = ("a" * 28 + "!", "1" * 28 + "!", "ab" * 14 + "!", " " * 28 + "!", "a1-" * 10 + "!")
PROBE_SECONDS = 2.0


@functools.lru_cache(maxsize=256)
def safe_pattern(pattern: str) -> re.Pattern:
    """Compile a user's pattern after a trial in a process of its own; one that doesn't end in time is refused."""
    compiled = re.compile(pattern, re.IGNORECASE)
    trial = "import re,sys\np=re.compile(sys.argv[1],re.I)\nfor t in sys.argv[2:]: p.search(t)"
    try:
        subprocess.run([sys.executable, "-I", "-c", trial, pattern, *PROBES], timeout=PROBE_SECONDS, check=True, capture_output=True)
    except (subprocess.TimeoutExpired, subprocess.CalledProcessError) as e:
        raise ValueError(f"pattern that may run for ever: {pattern}") from e
    return compiled


def _cued(kind: str, text: Column, found: Column, otherwise: Column) -> Column:
    cue = CUES.get(kind)
    return found if cue is None else F.when(text.contains(cue), found).otherwise(otherwise)


def counts_by_type(docs: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, type, n) without any Python: matches are counted by native expressions."""
    def count(kind: str, pattern: str) -> Column:
        return _cued(kind if patterns is None else "", F.col("text"), F.regexp_count("text", F.lit(f"(?i){pattern}")), F.lit(0)).cast("long")

    found = F.array(*(F.struct(F.lit(t).alias("type"), count(t, p).alias("n")) for t, p in (patterns or PATTERNS).items()))
    return docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*").where("n > 0")


def spans(docs: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """All non-empty matches with their offsets; documents without any match are filtered natively first."""
    use = patterns or PATTERNS

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The built-in patterns' repeats are kept apart by separators; only a user's are in question.
        compiled = [(t, re.compile(p, re.IGNORECASE | re.ASCII) if PATTERNS.get(t) == p else safe_pattern(p)) for t, p in use.items()]
        for pdf in batches:
            rows = [
                (doc_id, t, m[0], m.start(), m.end(), "regex", None)
                for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True)
                for t, p in compiled
                for m in p.finditer(text)
                if m[0]
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "type", "text", "start", "end", "source", "confidence"])

    anything = "|".join(f"(?:{p})" for p in use.values())
    return docs.select("doc_id", "text").where(F.col("text").rlike(f"(?i){anything}")).mapInPandas(find, SPAN)


def without_overlaps(spans: DataFrame, taken: DataFrame) -> DataFrame:
    """Spans that overlap none of `taken` in the same document (half-open intervals)."""
    a, b = spans.alias("a"), taken.alias("b")
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.start") < F.col("b.end")) & (F.col("a.end") > F.col("b.start")), "left_anti")


def lookup(values: dict[str, int], key: Column, default: int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key), F.lit(default))


def clustered(spans: DataFrame, group: str = "doc_id") -> DataFrame:
    """Adds `cluster`: spans that overlap one another, directly or by others, share a number."""
    order = Window.partitionBy(group).orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col("start") >= F.coalesce(F.max("end").over(before), F.col("start")), 1).otherwise(0)
    return spans.withColumn("_opens", opens).withColumn("cluster", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def settled(spans: DataFrame) -> DataFrame:
    """One span for each cluster: by priority of type, rank of source, confidence, then the shorter and earlier."""
    best = Window.partitionBy("doc_id", "cluster").orderBy(
        F.desc(lookup(TYPE_PRIORITY, F.col("type"), 1)), F.desc(lookup(SOURCE_RANK, F.col("source"), 0)), F.col("confidence").desc_nulls_last(),
        F.col("end") - F.col("start"), "start", "type",
    )
    return clustered(spans).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "cluster")


def same_span(spans: DataFrame) -> DataFrame:
    """One span for each pair of offsets: a custom type beats a built-in one, then confidence, source and type."""
    best = Window.partitionBy("doc_id", "start", "end").orderBy(
        F.col("type").startswith("custom_").desc(), F.col("confidence").desc_nulls_last(),
        F.desc(lookup(SOURCE_RANK, F.col("source"), 0)), F.desc(lookup(TYPE_PRIORITY, F.col("type"), 1)), "type",
    )
    return spans.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def ordered(spans: DataFrame) -> DataFrame:
    """Final order in each document, with ids entity_0, entity_1 and so on."""
    w = Window.partitionBy("doc_id").orderBy("start", "end", "type")
    return spans.withColumn("entity_id", F.concat(F.lit("entity_"), (F.row_number().over(w) - 1).cast("string")))


def paged(spans: DataFrame, pages: DataFrame, separator: int = 2) -> DataFrame:
    """The page of each span; pages (doc_id, page, text) are joined by `separator` characters."""
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    ends = pages.select("doc_id", "page", (F.sum(F.char_length("text") + separator).over(w)).alias("until"))
    last = ends.groupBy("doc_id").agg(F.max("page").alias("last"))
    hit = spans.join(ends, "doc_id", "left").groupBy(*spans.columns).agg(F.min(F.when(F.col("until") > F.col("start"), F.col("page"))).alias("page"))
    return hit.join(last, "doc_id", "left").withColumn("page", F.coalesce("page", "last")).drop("last")


def occurrences(values: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans of every occurrence of a document's confirmed values (doc_id, type, text) of two characters or more."""
    known = values.where(F.char_length("text") >= 2).groupBy("doc_id").agg(F.collect_set(F.struct("type", "text")).alias("known"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text, known in zip(pdf["doc_id"], pdf["text"], pdf["known"], strict=True):
                for k in known:
                    at = text.find(k["text"])
                    while at >= 0:
                        rows.append((doc_id, k["type"], k["text"], at, at + len(k["text"]), "model", 0.9))
                        at = text.find(k["text"], at + len(k["text"]))
            yield pd.DataFrame(rows, columns=["doc_id", "type", "text", "start", "end", "source", "confidence"])

    return docs.select("doc_id", "text").join(known, "doc_id").mapInPandas(find, SPAN)


def propagated(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans, and all free occurrences of their values elsewhere in the document."""
    return spans.unionByName(without_overlaps(occurrences(spans, docs), spans))


def numbered(spans: DataFrame) -> DataFrame:
    """Adds `index`: per document and type, distinct values by first appearance, from 1."""
    values = spans.groupBy("doc_id", "type", "text").agg(F.min("start").alias("first"))
    w = Window.partitionBy("doc_id", "type").orderBy("first", "text")
    return spans.join(values.withColumn("index", F.row_number().over(w)).drop("first"), ["doc_id", "type", "text"])


#: Numerals of smart labels up to ten.
NUMERALS = ("一", "二", "三", "四", "五", "六", "七", "八", "九", "十")


def smart_label(label: Column, index: Column) -> Column:
    numeral = F.coalesce(F.get(F.array(*map(F.lit, NUMERALS)), index - 1), index.cast("string"))
    return F.concat(F.lit("["), label, numeral, F.lit("]"))


def tag_label(kind: Column, index: Column, template: str = "<{type}_{index}>") -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{type}"), kind), F.lit("{index}"), F.lpad(index.cast("string"), 3, "0"))


def pool_names(spans: DataFrame, pools: DataFrame, cycle: bool = False) -> DataFrame:
    """Pseudonyms from a pool (type, position, word): by first appearance; beyond the pool numbered words, or from its start."""
    n = pools.groupBy("type").agg(F.count("*").alias("size"), F.max_by("word", "position").alias("last"))
    ranked = numbered(spans).join(n, "type", "left")
    ranked = ranked.withColumn("position", F.when(F.lit(cycle), (F.col("index") - 1) % F.col("size") + 1).otherwise(F.col("index")))
    return ranked.join(pools, ["type", "position"], "left").withColumn(
        "replacement", F.coalesce("word", F.concat(F.coalesce("last", "type"), (F.col("index") - F.coalesce("size", F.lit(0))).cast("string")))
    )


def replaced(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Texts with each document's mapping (doc_id, original, replacement) applied in one pass, longest first, and the number of hits."""
    maps = mapping.groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("original", "replacement"))).alias("names"))
    joined = docs.select("doc_id", "text").join(maps, "doc_id", "left")

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text, names in zip(pdf["doc_id"], pdf["text"], pdf["names"], strict=True):
                names = dict(names) if names is not None else {}
                if not names or text is None:
                    out.append((doc_id, text, 0))
                    continue
                pattern = re.compile("|".join(map(re.escape, sorted(names, key=lambda k: (-len(k), k)))))
                out.append((doc_id, *pattern.subn(lambda m, names=names: names[m[0]], text)))
            yield pd.DataFrame(out, columns=["doc_id", "text", "replaced"])

    return joined.mapInPandas(apply, "doc_id long, text string, replaced long")


def masked_by_pattern(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """Every match as <TYPE>, without Python; types in order."""
    for kind, pattern in (patterns or PATTERNS).items():
        one = functools.partial(_masked, kind if patterns is None else "", f"(?i){pattern}", f"<{kind}>")
        text = F.get(F.transform(F.array(text), one), F.lit(0))
    return text


def _masked(kind: str, pattern: str, mark: str, x: Column) -> Column:
    return _cued(kind, x, F.regexp_replace(x, pattern, mark), x)


def residual(mapping: DataFrame, products: DataFrame) -> DataFrame:
    """Originals (doc_id, original, replacement) still in their product (doc_id, text), with or without white space."""
    free = ~F.coalesce(F.col("replacement"), F.lit("")).contains(F.col("original"))
    return mapping.join(products, "doc_id").where(free & (F.col("text").contains(F.col("original")) | compact(F.col("text")).contains(compact(F.col("original"))))).select(
        "doc_id", "original"
    )


def bmes_spans(tags: DataFrame) -> DataFrame:
    """Spans (doc_id, type, start, end) from letters with B-, M-, E- and S- tags (doc_id, pos, tag)."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    opens = F.col("tag").rlike("^[BS]-")
    inside = tags.withColumn("n", F.sum(F.when(opens, 1).otherwise(0)).over(w)).where("tag != 'O'").withColumn("type", F.substring_index("tag", "-", -1))
    return inside.groupBy("doc_id", "n", "type").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("n")


@F.pandas_udf(DoubleType())
def subsequence_share(short: pd.Series, long: pd.Series) -> pd.Series:
    """Share of the first string's letters that occur in order in the second."""

    def share(a: str, b: str) -> float:
        at, hit = 0, 0
        for c in a:
            i = b.find(c, at)
            if i >= 0:
                at, hit = i + 1, hit + 1
        return hit / len(a) if a else 0.0

    return pd.Series([share(a, b) for a, b in zip(short, long, strict=True)])
