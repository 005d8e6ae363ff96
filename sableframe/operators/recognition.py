"""The recognition of entities as one plan: chunks for a model, its spans back in the document, patterns, checks, repeats and references.

Documents are rows (doc_id, text). A model is any function from chunks
(doc_id, chunk, text) to spans in them (doc_id, chunk, type, text, start, end,
confidence), such as a `mapInPandas` over an endpoint. Every span keeps its
`source`: model, regex, or model with `propagated` for repeats. A document's
spans and lines fit one task; documents are spread over the cluster. Only what
depends on the span before (the budget of chunks, free places) is a fold over
one document in Python, all else is native.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .entities import SOURCE_RANK, TYPE_PRIORITY, lookup, settled, spans, without_overlaps
from .organisations import alias_links
from .running import kept

# Budget of a chunk, longest line and most chunks of a document; edges that are no part of an entity; what a model alone decides.
BUDGET, LONGEST_LINE, MOST_CHUNKS = 1600, 320, 12
EDGES = " \t\r\n，。；：、,.!?！？;:()（）[]【】"
SEMANTIC = ("PERSON", "ORG", "COMPANY_NAME", "INSTITUTION_NAME", "GOVERNMENT_AGENCY", "WORK_UNIT", "DEPARTMENT_NAME", "PROJECT_NAME", "ADDRESS")
ORG_LIKE = (
    "ORG", "COMPANY_NAME", "INSTITUTION_NAME", "GOVERNMENT_AGENCY", "WORK_UNIT", "DEPARTMENT_NAME", "PROJECT_NAME",
    "LEGAL_COURT", "LEGAL_SERVICE_ORG", "FIN_INSTITUTION", "MED_INSTITUTION", "BANK_NAME",
)
BRACKETED = ("DOCUMENT_NUMBER", "CASE_NUMBER")
PROPAGATED_LEAST, PROPAGATED_CONFIDENCE = 2, 0.9
CHUNK = "doc_id long, chunk int, text string, starts array<int>, offsets array<int>"
FOUND = "doc_id long, type string, text string, start long, end long, source string, confidence double"


def lines_of(text: str, longest: int | None) -> Iterator[str]:
    """Paragraphs with white space collapsed; those of twice the longest line are cut after sentences."""
    for paragraph in re.split(r"\r\n|\r|\n", text):
        paragraph = paragraph.strip()
        long = longest is not None and len(paragraph) > 2 * longest
        for part in re.split(r"(?<=[。；;])\s*", paragraph) if long else (paragraph,):
            if line := " ".join(part.split()):
                yield line


def chunked(text: str, budget: int, longest: int | None, most: int | None) -> list[tuple[str, list[int], list[int]]]:
    """Chunks of a text: their text, where their lines start in them, and where these stand in the document (-1: nowhere as they are)."""
    done: list[tuple[str, list[int], list[int]]] = []
    seen: set[str] = set()
    lines: list[str] = []
    starts: list[int] = []
    offsets: list[int] = []
    used = after = 0
    for line in lines_of(text, longest):
        if line in seen:
            continue
        line = line[:longest].rstrip() if longest is not None else line
        if (at := text.find(line, after)) < 0:
            at = text.find(line)
        after = at + len(line) if at >= 0 else after
        seen.add(line)
        if lines and used + len(line) + 1 > budget:
            done.append(("\n".join(lines), starts, offsets))
            lines, starts, offsets, used = [], [], [], 0
            if most is not None and len(done) >= most:
                break
        lines.append(line)
        starts.append(used)
        offsets.append(at)
        used += len(line) + 1
    if lines:
        done.append(("\n".join(lines), starts, offsets))
    return done


def chunks(docs: DataFrame, budget: int = BUDGET, longest: int | None = LONGEST_LINE, most: int | None = MOST_CHUNKS) -> DataFrame:
    """doc_id, chunk, text, starts, offsets: distinct lines of each document in chunks within the budget. None lifts a limit."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                rows = [(doc_id, k, *c) for k, c in enumerate(chunked(text or "", budget, longest, most))]
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "chunk", "text", "starts", "offsets"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, CHUNK)


def in_document(found: DataFrame, parts: DataFrame, docs: DataFrame, longest: int | None = LONGEST_LINE) -> DataFrame:
    """Spans of chunks with offsets in their document.

    A line's place gives the offset. If the document reads otherwise there (it
    has other white space), the span goes to its first occurrence near one of the
    chunk's lines, then anywhere; else it keeps its offsets, to be checked later.
    A line with a place reads in the document as in the chunk, so a span inside
    one needs the chunk alone; a document's text is joined once for all others.
    """
    rows = found.alias("e").join(parts.select("doc_id", "chunk", F.col("text").alias("_chunk"), "starts", "offsets"), ["doc_id", "chunk"])
    n, local = F.char_length("text"), F.col("start").cast("int")
    rows = rows.where(n > 0).withColumn("_line", F.size(F.filter("starts", lambda s: s <= local)) - 1)
    guess = F.get("offsets", F.col("_line")) + local - F.get("starts", F.col("_line"))
    until = F.coalesce(F.get("starts", F.col("_line") + 1) - 1, F.char_length("_chunk"))
    placed = (local >= 0) & (local < F.char_length("_chunk")) & (F.get("offsets", F.col("_line")) >= 0)
    sure = F.coalesce(placed & (local + n <= until) & (F.substring(F.col("_chunk"), local + 1, n) == F.col("text")), F.lit(False))
    one = F.struct(
        "type", "text", "start", "end", F.col("confidence").cast("double").alias("confidence"), F.when(sure, guess).alias("sure"), F.when(placed & (local > 0), guess).alias("guess"),
        F.when(~sure, F.col("offsets")).alias("offsets"),
    )
    both = rows.groupBy("doc_id").agg(F.collect_list(one).alias("_all")).join(docs.select("doc_id", F.col("text").alias("_full")), "doc_id")
    full = F.col("_full")

    def place(x: Column) -> Column:
        size = F.char_length(x["text"])

        def near(o: Column) -> Column:
            room = F.substring(full, o + 1, size + longest) if longest is not None else F.substring(full, o + 1, F.char_length(full))
            at = F.position(x["text"], room)
            return F.when((o >= 0) & (at > 0), o + at - 1)

        fits, anywhere = F.substring(full, x["guess"] + 1, size) == x["text"], F.position(x["text"], full)
        sought = F.coalesce(F.get(F.filter(F.transform(x["offsets"], near), lambda o: o.isNotNull()), F.lit(0)), F.when(anywhere > 0, anywhere - 1))
        return F.when(x["sure"].isNotNull(), x["sure"]).when(x["guess"].isNotNull() & fits, x["guess"]).otherwise(sought)

    # not in the row that the text is in, or it would be copied for each span
    done = both.select("doc_id", F.transform("_all", lambda x: F.struct(*(x[k].alias(k) for k in ("type", "text", "start", "end", "confidence")), place(x).alias("at"))).alias("_all"))
    rows = done.select("doc_id", F.explode("_all").alias("x")).select("doc_id", "x.*")
    start, end = F.coalesce("at", "start").cast("long"), F.when(F.col("at").isNull(), F.col("end")).otherwise(F.col("at") + n).cast("long")
    return rows.select("doc_id", "type", "text", start.alias("start"), end.alias("end"), F.lit("model").alias("source"), "confidence")


@F.pandas_udf(ArrayType(StringType()))
def pieces(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """What stands at [start, end) of a text, for arrays of offsets; null where these don't fit in it. A substring would count from the text's start each time."""
    return pd.Series([None if t is None or s is None else [t[a:b] if 0 <= a <= b <= len(t) else None for a, b in zip(s, e, strict=True)] for t, s, e in zip(text, starts, ends, strict=True)])


def _tight(kind: str, value: str, start: int, text: str) -> tuple[str, int]:
    cut = value.strip(EDGES)
    start += len(value) - len(value.lstrip(EDGES)) if cut else 0
    if cut and kind in BRACKETED and start > 0 and text[start - 1] in "（(" and re.search("[）)]", cut):
        return text[start - 1] + cut, start - 1
    return cut, start


def _places(spans: pa.Table, docs: pa.Table) -> pa.Table:
    """Spans where they stand, or at the first occurrence that no span before covers; what has none goes."""
    out: list[tuple] = []
    text = docs["text"][0].as_py() if docs.num_rows else ""
    used: list[tuple[int, int]] = []
    rows = sorted(spans.to_pylist(), key=lambda r: (r["type"] not in SEMANTIC or r["source"] != "model", r["start"], r["end"], r["type"]))
    for r in rows if text else ():
        value, at = r["text"], r["start"]
        if not (0 <= at < r["end"] <= len(text) and text[at : r["end"]] == value):
            at = text.find(value)
            while at >= 0 and any(at < e and at + len(value) > s for s, e in used):
                at = text.find(value, at + len(value))
        if at >= 0:
            value, at = _tight(r["type"], value, at, text)
            used.append((at, at + len(value)))
            out.append((r["doc_id"], r["type"], value, at, at + len(value), r["source"], r["confidence"]))
    return _arrow(out)


def _arrow(rows: list[tuple]) -> pa.Table:
    kinds = {"doc_id": pa.int64(), "type": pa.string(), "text": pa.string(), "start": pa.int64(), "end": pa.int64(), "source": pa.string(), "confidence": pa.float64()}
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.table({k: pa.array(c, t) for (k, t), c in zip(kinds.items(), columns, strict=True)})


def validated(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans whose text stands at their offsets, others at their first free occurrence; edges trimmed, a number's opening bracket kept.

    Only documents with a span out of place go through the fold.
    """
    edges, start = F.lit(EDGES), F.col("start").cast("int")
    first = start + F.char_length("text") - F.char_length(F.ltrim("text", edges))
    one = F.struct("type", "text", "source", "confidence", F.coalesce(start, F.lit(-1)).alias("start"), F.coalesce(F.col("end").cast("int"), F.lit(-1)).alias("end"), F.coalesce(first, F.lit(-1)).alias("first"))
    whole = found.groupBy("doc_id").agg(F.collect_list(one).alias("_all")).join(docs.select("doc_id", F.col("text").alias("_full")), "doc_id")
    here = pieces(F.col("_full"), F.col("_all.start"), F.col("_all.end"))
    before = pieces(F.col("_full"), F.transform("_all.first", lambda x: x - 1), F.col("_all.first"))
    both = whole.select("doc_id", F.col("_all"), here.alias("_here"), before.alias("_before"))
    good = F.zip_with("_all", "_here", lambda x, h: (x["start"] < x["end"]) & F.coalesce(h == x["text"], F.lit(False)))
    both = kept(both.select("doc_id", F.exists(good, lambda g: ~g).alias("_wrong"), F.zip_with("_all", "_before", lambda x, b: F.struct(x.alias("x"), b.alias("before"))).alias("_all")))
    rows = both.select("doc_id", "_wrong", F.explode("_all").alias("y")).select("doc_id", "_wrong", "y.x.*", "y.before")
    cut, first, before = F.btrim("text", edges), F.col("first"), F.col("before")
    wide = F.col("type").isin(*BRACKETED) & (first > 0) & before.isin("（", "(") & cut.rlike("[）)]")
    right = rows.where("NOT _wrong").select(
        "doc_id", "type", F.when(wide, F.concat(before, cut)).otherwise(cut).alias("text"), (first - wide.cast("int")).cast("long").alias("start"),
        (first + F.char_length(cut)).cast("long").alias("end"), "source", "confidence",
    )
    bad = both.where("_wrong").select(F.col("doc_id").alias("_bad"))
    wrong = rows.where("_wrong").select("doc_id", "type", "text", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "source", "confidence")
    texts = docs.select("doc_id", "text").join(bad, F.col("doc_id") == F.col("_bad"), "left_semi")
    moved = wrong.groupBy("doc_id").cogroup(texts.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).groupBy("doc_id")).applyInArrow(_places, FOUND)
    return right.unionByName(moved).where(F.char_length("text") > 0)


def one_of_span(found: DataFrame) -> DataFrame:
    """One span for each pair of offsets: custom types first; of one semantic type the model's; then confidence, source, priority and type."""
    semantic = F.col("type").isin(*SEMANTIC)
    both = Window.partitionBy("doc_id", "start", "end", "type")
    model = F.max((F.col("source") == "model").cast("int")).over(both)
    rest = found.withColumn("_model", model).where(~semantic | (F.col("source") != "regex") | (F.col("_model") == 0)).drop("_model")
    best = Window.partitionBy("doc_id", "start", "end").orderBy(
        F.lower("type").startswith("custom_").desc(), F.col("confidence").desc_nulls_last(), F.desc(lookup(SOURCE_RANK, F.col("source"), 0)), F.desc(lookup(TYPE_PRIORITY, F.col("type"), 1)), "type",
    )
    return rest.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def _repeats(spans: pa.Table, docs: pa.Table) -> pa.Table:
    out: list[tuple] = []
    text = docs["text"][0].as_py() if docs.num_rows else None
    rows = sorted(spans.to_pylist(), key=lambda r: (r["start"], r["end"]))
    taken = sorted((r["start"], r["end"]) for r in rows)
    covered = bytearray(len(text or ""))
    for s, e in taken if text else ():
        covered[s:e] = b"\1" * (e - s)
    done: set[tuple[str, str]] = set()
    for r in rows if text else ():
        value = r["text"].strip()
        asked = r["source"] == "model" and (r["type"] in SEMANTIC or r["type"].lower().startswith("custom_")) and len(value) >= PROPAGATED_LEAST
        if not asked or (r["type"], value) in done:
            continue
        done.add((r["type"], value))
        least = min(PROPAGATED_CONFIDENCE, PROPAGATED_CONFIDENCE if r["confidence"] is None else r["confidence"])
        at = text.find(value)
        while at >= 0:
            if 1 not in covered[at : at + len(value)]:
                covered[at : at + len(value)] = b"\1" * len(value)
                out.append((r["doc_id"], r["type"], value, at, at + len(value), "model", least))
            at = text.find(value, at + len(value))
    return _arrow(out)


def repeats(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Free occurrences of what a model found, in the order of the spans; none overlaps a span or another of them."""
    asked = found.where((F.col("source") == "model") & (F.col("type").isin(*SEMANTIC) | F.lower("type").startswith("custom_")))
    ids = asked.select(F.col("doc_id").alias("_asked")).distinct()
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_asked"), "left_semi").select(F.col("doc_id").alias("doc_id"), "text")
    return found.join(ids, F.col("doc_id") == F.col("_asked"), "left_semi").groupBy("doc_id").cogroup(texts.groupBy("doc_id")).applyInArrow(_repeats, FOUND)


def referred(found: DataFrame) -> DataFrame:
    """Adds coref_id: mentions of one text and type share it, an organisation's short name that of its full one; numbered as met, repeats last."""
    orgs = found.where(F.col("type").isin(*ORG_LIKE)).select("doc_id", "text").distinct()
    links = alias_links(orgs).withColumnRenamed("alias", "text")
    named = found.join(links, ["doc_id", "text"], "left").withColumn("_key", F.when(F.col("type").isin(*ORG_LIKE), F.coalesce("full", "text")).otherwise(F.col("text")))
    first = F.min(F.struct("propagated", "start", "type")).over(Window.partitionBy("doc_id", "_key", "type"))
    met = Window.partitionBy("doc_id").orderBy("_first", "_key")
    out = named.withColumn("_first", first).withColumn("coref_id", F.concat(F.lit("coref_"), F.lpad(F.dense_rank().over(met).cast("string"), 3, "0")))
    return out.drop("_key", "_first", "full")


def recognised(
    docs: DataFrame,
    model: Callable[[DataFrame], DataFrame] | None,
    patterns: dict[str, str] | None = None,
    budget: int = BUDGET,
    longest: int | None = LONGEST_LINE,
    most: int | None = MOST_CHUNKS,
    enabled: list[str] | None = None,
) -> DataFrame:
    """doc_id, entity_id, type, text, start, end, source, confidence, propagated, coref_id.

    Model spans, then pattern spans that overlap none of them; checked, one for
    each place; then repeats of what the model found, references and numbers.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    by_pattern = spans(docs, patterns)
    found = by_pattern
    if model is not None:
        # both kept, so that a text is cut once and the model called once for a chunk
        parts = kept(chunks(docs, budget, longest, most))
        by_model = kept(in_document(model(parts.select("doc_id", "chunk", "text")), parts, docs, longest))
        by_model = by_model.where(F.col("type").isin(*enabled)) if enabled is not None else by_model
        found = by_model.unionByName(without_overlaps(by_pattern, by_model))
    chosen = kept(settled(one_of_span(validated(found, docs))))
    both = chosen.withColumn("propagated", F.lit(False)).unionByName(repeats(chosen, docs).withColumn("propagated", F.lit(True)))
    order = Window.partitionBy("doc_id").orderBy("start", "end", "type")
    return referred(both).withColumn("entity_id", F.concat(F.lit("entity_"), (F.row_number().over(order) - 1).cast("string")))
