"""Replacement in styled text: a paragraph is a row of runs, each with its own style, and keeps them all.

Runs are rows (doc_id, run, text). What is replaced may cross run borders; its
replacement goes to the run that holds most of it, the first of equals. No run
is added or removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import places, quoted
from .entities import clustered


def first_fits(matches: DataFrame) -> DataFrame:
    """Of matches (doc_id, start, end, replacement) those that begin at or after the end of the last one kept, longer ones first.

    Only matches that overlap others, directly or by others, are looked at one after another.
    """
    none = F.array().cast("array<struct<start:int,size:int,end:int,replacement:string>>")

    def step(state: Column, x: Column) -> Column:
        free = x["start"] >= state["last"]
        return F.struct(F.when(free, x["end"]).otherwise(state["last"]).alias("last"), F.when(free, F.concat(state["kept"], F.array(x))).otherwise(state["kept"]).alias("kept"))

    one = F.struct("start", (F.col("start") - F.col("end")).alias("size"), "end", "replacement")
    groups = clustered(matches).groupBy("doc_id", "cluster").agg(F.sort_array(F.collect_list(one)).alias("all"))
    kept = F.aggregate("all", F.struct(F.lit(0).alias("last"), none.alias("kept")), step, lambda s: s["kept"])
    return groups.select("doc_id", F.explode(F.when(F.size("all") == 1, F.col("all")).otherwise(kept)).alias("x")).select("doc_id", "x.start", "x.end", "x.replacement")


def matches(texts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every occurrence of a document's originals (doc_id, original, replacement) in its text (doc_id, text), overlaps settled."""
    known = mapping.where(F.coalesce("original", F.lit("")) != "").select("doc_id", "original", F.coalesce("replacement", F.lit("")).alias("replacement"))
    pairs = texts.join(known, "doc_id").where(F.col("text").contains(F.col("original")))
    found = pairs.select("doc_id", "replacement", F.explode(places(F.col("text"), quoted(F.col("original")))).alias("x"))
    return first_fits(found.select("doc_id", "x.start", "x.end", "replacement"))


def measured(runs: DataFrame) -> DataFrame:
    """Runs with `start` and `end` in their document, and `nth`, their number in it."""
    order = Window.partitionBy("doc_id").orderBy("run")
    n = F.char_length("text")
    rows = runs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("end", F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return rows.withColumn("start", (F.col("end") - n).cast("int")).withColumn("nth", F.row_number().over(order))


def _asof(points: DataFrame, runs: DataFrame, at: str, name: str) -> DataFrame:
    """Adds `name`: the number of the run in which `at` lies, by one sorted pass over both."""
    marks = runs.select("doc_id", F.col("start").alias("_at"), F.lit(0).alias("_kind"), "nth").unionByName(points.withColumn("_at", F.col(at)).withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("_at", "_kind", "nth").rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn(name, F.last("nth", ignorenulls=True).over(order)).where("_kind = 1").drop("_at", "_kind", "nth")


def replaced_runs(runs: DataFrame, mapping: DataFrame) -> DataFrame:
    """doc_id, run, text: all runs, with each document's mapping applied to their text as a whole."""
    rows = measured(runs)
    texts = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "").alias("text"))
    spans = matches(texts, mapping)
    ends = spans.withColumn("last_at", F.col("end") - 1)
    touched = _asof(_asof(ends, rows, "start", "first_run"), rows, "last_at", "last_run")
    each = touched.withColumn("nth", F.explode(F.sequence("first_run", "last_run"))).select("doc_id", "nth", F.col("start").alias("s"), F.col("end").alias("e"), "replacement")
    own = rows.join(each, ["doc_id", "nth"]).withColumn("cut", F.greatest("s", "start")).withColumn("until", F.least("e", "end")).where("until > cut")
    most = Window.partitionBy("doc_id", "s").orderBy((F.col("until") - F.col("cut")).desc(), "nth")
    own = own.withColumn("here", F.row_number().over(most) == 1)
    cuts = own.groupBy("doc_id", "nth").agg(F.array_sort(F.collect_list(F.struct("cut", "until", F.when(F.col("here"), F.col("replacement")).otherwise("").alias("put")))).alias("cuts"))
    joined = rows.join(cuts, ["doc_id", "nth"], "left")

    def kept(low: Column, high: Column) -> Column:
        return F.substring(F.col("text"), low - F.col("start") + 1, high - low)

    # what stands before each cut and is put there, then the rest
    parts = F.transform("cuts", lambda c, i: F.concat(kept(F.when(i == 0, F.col("start")).otherwise(F.get("cuts", i - 1)["until"]), c["cut"]), c["put"]))
    whole = F.concat(F.array_join(parts, ""), kept(F.element_at("cuts", -1)["until"], F.col("end")))
    return joined.select("doc_id", "run", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(whole).alias("text"))


def segments(texts: DataFrame, mapping: DataFrame) -> DataFrame:
    """doc_id, nth, text, replaced, replacement: a text as pieces for a preview, changed ones apart, by the same matches."""
    spans = matches(texts, mapping)
    cuts = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("cuts"))
    rows = texts.join(cuts, "doc_id", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<struct<start:int,end:int,replacement:string>>")))
    text, no = F.col("text"), F.lit(None).cast("string")

    def around(c: Column, i: Column) -> Column:
        low = F.when(i == 0, 0).otherwise(F.get("cuts", i - 1)["end"])
        return F.array(
            F.struct(F.substring(text, low + 1, c["start"] - low).alias("text"), F.lit(False).alias("replaced"), no.alias("replacement")),
            F.struct(F.substring(text, c["start"] + 1, c["end"] - c["start"]).alias("text"), F.lit(True).alias("replaced"), c["replacement"].alias("replacement")),
        )

    last = F.coalesce(F.element_at(F.transform("cuts", lambda c: c["end"]), F.when(F.size("cuts") > 0, -1)), F.lit(0))
    tail = F.array(F.struct(F.substring(text, last + 1, F.char_length(text) - last).alias("text"), F.lit(False).alias("replaced"), no.alias("replacement")))
    pieces = F.filter(F.concat(F.flatten(F.transform("cuts", around)), tail), lambda p: p["replaced"] | (p["text"] != ""))
    return rows.select("doc_id", F.posexplode(pieces).alias("nth", "p")).select("doc_id", "nth", "p.*")
