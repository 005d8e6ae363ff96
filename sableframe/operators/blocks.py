"""Values found in a page's text blocks: inside a block, over line breaks, or over a break that was lost.

Blocks are rows (doc_id, pos, text), values rows (doc_id, type, value). A value
is first sought as a run over neighbouring blocks, where it has line breaks of
its own: a part at the end of a block, whole blocks, and a part at the start of
the next. Else inside blocks: as it stands, or with other white space. What is
found nowhere may be cut by a block's end. All is done with joins within a
page and native expressions; offsets are half-open and in code points.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import amount_signature, compact, isolated, let, trimmed, without_math_markup
from .running import kept

# Shortest value of a type that may be a part of a longer word, units that aren't money, numerals of amounts.
SHORTEST, SHORTEST_ELSE = {"PERSON": 2, "ORG": 2, "ADDRESS": 4}, 2
NOT_MONEY = "亩顷㎡平方米里人位名户岁天次件套台辆吨%％度年月日时号"
NUMERALS = "零〇一二三四五六七八九十百千万亿两壹贰叁肆伍陆柒捌玖拾佰仟萬億兆"
FUZZY_LEAST, FUZZY_TIMES, FUZZY_FLOOR, FUZZY_RATIO = 4, 3, 24, 0.9
#: Shortest value that may be cut by a block's end, and how much of it must stand before the end.
CUT_LEAST, CUT_HEAD = 4, 2


def quoted(x: Column) -> Column:
    """A pattern that matches just this text."""
    return F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def spaced(x: Column) -> Column:
    """A pattern of the text's characters with any white space between them."""
    return F.array_join(F.transform(F.regexp_extract_all(compact(x), F.lit("(?s)."), F.lit(0)), quoted), r"[\s\x{A0}\x{2000}-\x{200A}\x{3000}]*")


def places(text: Column, pattern: Column) -> Column:
    """array<struct<start, end>> of the matches, left to right."""
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.char_length(x))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(state: Column, one: Column) -> Column:
        start = state["at"] + one["gaps"]
        found = F.struct(start.alias("start"), (start + one["sizes"]).alias("end"))
        return F.struct((start + one["sizes"]).alias("at"), F.concat(state["found"], F.array(found)).alias("found"))

    pairs = F.filter(F.arrays_zip(gaps.alias("gaps"), sizes.alias("sizes")), lambda x: x["sizes"].isNotNull())
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("found")), step, lambda s: s["found"])


def searchable(values: DataFrame) -> DataFrame:
    """Distinct values without markup and white space around; numbers are what makes an amount."""
    known = values.select("doc_id", "type", trimmed(without_math_markup(F.col("value"))).alias("value")).distinct()
    amount = (F.col("type") != "AMOUNT") | F.col("value").rlike(f"[0-9０-９{NUMERALS}]")
    least = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SHORTEST.items() for x in kv)), F.col("type")), F.lit(SHORTEST_ELSE))
    return known.where((compact(F.col("value")) != "") & amount).withColumn("strict", F.char_length("value") < least)


def lined_up(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, text, `tight` (without white space) and `at`: the block's place among those that aren't tables."""
    plain = blocks.where(~F.coalesce(F.col("text"), F.lit("")).startswith("<table")).select("doc_id", "pos", F.coalesce("text", F.lit("")).alias("text")).withColumn("tight", compact(F.col("text")))
    return plain.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))


def _runs(values: DataFrame, blocks: DataFrame) -> DataFrame:
    """Parts of the values (doc_id, type, value, parts) that stand in neighbouring blocks, in order.

    Each part meets the blocks that fit it. Fits of one run lie on a diagonal:
    the block's place less the part's number is the same for all of them.
    """
    part = values.select("doc_id", "type", "value", F.size("parts").alias("of"), F.posexplode("parts").alias("k", "part"))
    first, last = F.col("k") == 0, F.col("k") == F.col("of") - 1
    fits = F.when(first, F.col("text").endswith(F.col("part"))).when(last, F.col("text").startswith(F.col("part"))).otherwise(F.col("tight") == F.col("packed"))
    found = part.withColumn("packed", compact(F.col("part"))).alias("v").join(blocks.alias("b"), "doc_id").where(fits).select("doc_id", "type", "value", "of", "k", "part", "pos", "text", (F.col("at") - F.col("k")).alias("diagonal"))
    whole = Window.partitionBy("doc_id", "type", "value", "diagonal")
    start = F.when(F.col("k") == 0, F.char_length("text") - F.char_length("part")).when(F.col("k") == F.col("of") - 1, 0).otherwise(F.greatest(F.lit(0), F.position(F.col("part"), F.col("text")) - 1))
    done = found.withColumn("n", F.count("*").over(whole)).where(F.col("n") == F.col("of")).withColumn("start", start.cast("int"))
    return done.select("doc_id", "type", "value", "pos", "start", (F.col("start") + F.char_length("part")).cast("int").alias("end"), F.col("part").alias("text"))


def over_breaks(values: DataFrame, blocks: DataFrame) -> DataFrame:
    """Values with line breaks as runs of blocks."""
    parts = F.filter(F.transform(F.split("value", "\n"), lambda x: trimmed(x)), lambda x: x != "")
    return _runs(values.withColumn("parts", parts).where(F.size("parts") >= 2), blocks).withColumn("how", F.lit("wrapped"))


def inside(values: DataFrame, blocks: DataFrame) -> DataFrame:
    """Values inside single blocks, exact or with other white space; short ones only where they stand alone."""
    pairs = values.withColumn("packed", compact(F.col("value"))).join(blocks.drop("at"), "doc_id").where(F.col("tight").contains(F.col("packed")))
    exact = F.col("text").contains(F.col("value"))
    found = F.when(exact, places(F.col("text"), quoted(F.col("value")))).when(~F.col("strict"), places(F.col("text"), spaced(F.col("value"))))
    each = pairs.withColumn("how", F.when(exact, F.lit("exact")).otherwise(F.lit("spaced"))).withColumn("x", F.explode(found)).withColumn("start", F.col("x.start")).withColumn("end", F.col("x.end"))
    alone = ~F.col("strict") | isolated(F.col("text"), F.col("start"), F.col("end"))
    unit = F.substring(F.ltrim(F.substring(F.col("text"), F.col("end") + 1, F.lit(64))), 1, 1)
    money = (F.col("type") != "AMOUNT") | (unit == "") | ~F.contains(F.lit(NOT_MONEY), unit)
    return each.where(alone & money).select("doc_id", "type", "value", "pos", "start", "end", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"), "how")


def same_amounts(values: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks whose number is that of an amount in another form."""
    sums = values.where("type = 'AMOUNT'").withColumn("sum", amount_signature(compact(F.col("value")))).where("sum != ''")
    known = blocks.drop("at").where(F.col("tight").rlike(r"\d")).withColumn("sum", amount_signature(F.col("tight"))).withColumn("unit", F.regexp_extract("tight", r"\d(\D)\D*$", 1))
    same = sums.join(known, ["doc_id", "sum"]).where(((F.col("unit") == "") | ~F.contains(F.lit(NOT_MONEY), F.col("unit"))) & ~F.col("tight").contains(compact(F.col("value"))))
    return same.select("doc_id", "type", "value", "pos", F.lit(0).alias("start"), F.char_length("text").cast("int").alias("end"), "text", F.lit("amount").alias("how"))


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def alike(values: DataFrame, blocks: DataFrame) -> DataFrame:
    """The first block that is the value but for a misread letter or so; lengths that rule it out are never compared."""
    n, m = F.char_length("value"), F.char_length("text")
    near = (n >= FUZZY_LEAST) & ~F.col("strict") & (m <= F.greatest(n * FUZZY_TIMES, F.lit(FUZZY_FLOOR))) & (2 * F.least(n, m) > FUZZY_RATIO * (n + m))
    pairs = values.join(blocks, "doc_id").where(near)
    good = pairs.where(likeness(F.col("value"), F.col("text")) > FUZZY_RATIO)
    first = good.groupBy("doc_id", "type", "value").agg(F.min(F.struct("at", "pos", "text")).alias("b"))
    return first.select("doc_id", "type", "value", "b.pos", F.lit(0).alias("start"), F.char_length("b.text").cast("int").alias("end"), "b.text", F.lit("fuzzy").alias("how"))


def over_lost_breaks(values: DataFrame, blocks: DataFrame) -> DataFrame:
    """Values without a line break that a block's end cuts in two: the first cut that fits, wherever it fits."""
    after = F.lead("text").over(Window.partitionBy("doc_id").orderBy("at"))
    ends = blocks.withColumn("after", after).where(F.col("after").isNotNull())
    n = F.char_length("value")
    sought = values.where((n >= CUT_LEAST) & ~F.col("value").contains("\n"))

    def cut(k: Column) -> Column:
        return F.col("text").endswith(F.substring(F.col("value"), F.lit(1), k)) & F.col("after").startswith(F.substring(F.col("value"), k + 1, n))

    cuts = F.filter(F.sequence(F.lit(CUT_HEAD), n - 1), cut)
    hit = sought.join(ends, "doc_id").withColumn("k", F.array_min(cuts)).where(F.col("k").isNotNull())
    first = hit.groupBy("doc_id", "type", "value").agg(F.min(F.struct("at", "k"))["k"].alias("k"))
    parts = F.array(F.substring(F.col("value"), F.lit(1), F.col("k")), F.substring(F.col("value"), F.col("k") + 1, n))
    return _runs(first.withColumn("parts", F.transform(parts, lambda x: trimmed(x))), blocks).withColumn("how", F.lit("cut"))


def located(values: DataFrame, blocks: DataFrame, fuzzy: bool = True) -> DataFrame:
    """doc_id, type, value, pos, start, end, text, how: all places of the values, by the first way that finds them.

    Values, blocks and what a way finds are kept, as each further way starts from them.
    """
    key, known, rows = ["doc_id", "type", "value"], kept(searchable(values)), kept(lined_up(blocks))
    wrapped = kept(over_breaks(known, rows))
    rest = known.join(wrapped.select(key).distinct(), key, "left_anti")
    within = kept(inside(rest, rows).unionByName(same_amounts(rest, rows)))
    rest = rest.join(within.select(key).distinct(), key, "left_anti")
    found = wrapped.unionByName(within)
    if fuzzy:
        near = kept(alike(rest, rows))
        rest, found = rest.join(near.select(key), key, "left_anti"), found.unionByName(near)
    return found.unionByName(over_lost_breaks(rest, rows))


def boxed(places: DataFrame, blocks: DataFrame) -> DataFrame:
    """Places with the box of their block (left, top, width, height), as positions inside a block aren't known."""
    return places.join(blocks.select("doc_id", "pos", "left", "top", "width", "height"), ["doc_id", "pos"])
