"""Mixing sources to target weights by Pareto order sampling.

Sources share the words of the mix by weight; a share stops at `MOST` times the
words of its source, and what is above is shared out again. Within a source the
copies expected of a text grow with the number of binary digits of its size, up
to `MOST` (so longer texts are somewhat likelier), and their words add up to the
target. The whole part of a text's copies is certain. For the rest, texts of a
source are ranked by random odds divided by inclusion odds, and the first are
taken. Sizes are words here, so the sample's fixed size is a number of words:
the longest row of ranks that stays within what is left of the target, then
twice more from the ranks of texts short enough for the remainder.

Random numbers come from a hash of the seed and the id, so reruns agree. No
source is sorted whole: sums by steps of the logarithm of the odds find the step
in which a sample ends, and only texts of that step are sorted. Sums by source
are broadcast only if there are few sources.

Null and empty texts have size 0 and aren't taken. A null source is a source,
the last one; a null id hashes as empty. Rows that repeat id, source and size
are taken one after another, each at most `MOST` times. Ranks tie by id, then
size. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sableframe.operators.running import ranked, running_sum

from .common import checkpointed, table
from .packing import token_count

#: Weights of the sources in order, repeating, and the most copies of a text.
WEIGHTS, MOST = (5, 2, 1), 3
SEED = "mix"
#: Steps for each unit of the logarithm of the odds (a step has 1/4096 of a source's texts at most), and rounds of a sample.
STEPS, ROUNDS = 1024, 3
#: Sources whose sums are broadcast (some rows of numbers each); more of them are joined by shuffles.
BROADCAST_SOURCES = 20_000


def small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """source, number, source_size and target, from `sizes` (source, size of its rows in words)."""
    whole = F.sum("size").cast("long")
    sources = sizes.groupBy("source").agg(whole.alias("source_size"))
    numbered = ranked(sources, [], [F.col("source").asc_nulls_last()], "number")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    weighed = checkpointed(numbered.withColumn("weight", weight))
    words, total = weighed.agg(F.sum("source_size").cast("long"), F.sum("weight")).first()
    # Shares stop in the order of size over weight; one stops if it would be above with all before it stopped.
    order = [(F.col("source_size") * (F.lit(math.lcm(*weights)) / F.col("weight")).cast("long")).asc(), F.col("number").asc()]
    sums = running_sum(running_sum(weighed, [], order, F.col("source_size"), "stopped"), [], order, F.col("weight"), "used")

    def big(x: Column) -> Column:
        return x.cast("decimal(19,0)")

    left = F.lit((words or 0) * share) - most * (F.col("stopped") - F.col("source_size"))
    rest = F.lit(total or 0) - (F.col("used") - F.col("weight"))
    if share == 1.0:  # whole numbers, compared exactly
        left = big(F.lit(words or 0)) - most * big(F.col("stopped") - F.col("source_size"))
        full = big(F.col("source_size")) * most * big(rest) <= big(F.col("weight")) * left
    else:
        full = F.col("source_size") * most * rest <= F.col("weight") * left
    judged = checkpointed(sums.withColumn("full", full))
    held, used = judged.where("full").agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("long"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    free = (words or 0) * share - most * held if share != 1.0 else (words or 0) - most * held
    target = F.when(F.col("full"), (F.col("source_size") * most).cast("double"))
    target = target.otherwise((F.col("weight") * F.lit(free)).cast("double") / F.lit(max(1, (total or 0) - used)).cast("double"))
    return judged.select("source", "number", "source_size", target.alias("target"))


def expected(units: DataFrame, aims: DataFrame, most: int = MOST) -> DataFrame:
    """number, digits, certain (whole copies), chance of one more, and `need`: the words of a source's sample.

    A source has few sizes by digits, so these windows are small.
    """
    classes = units.where("size > 0").groupBy("number", "digits").agg(F.sum(F.col("size") * F.col("copies")).cast("long").alias("words"))
    larger = Window.partitionBy("number").orderBy(F.col("digits").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("number")
    weighted = F.col("digits") * F.col("words")
    judged = classes.join(aims.select("number", "target"), "number")
    judged = judged.withColumn("rest", F.sum(weighted).over(every) - F.coalesce(F.sum(weighted).over(larger), F.lit(0)))
    judged = judged.withColumn("left", F.col("target") - most * F.coalesce(F.sum("words").over(larger), F.lit(0)))
    judged = judged.withColumn("full", F.col("left") * F.col("digits") >= most * F.col("rest"))
    held = F.sum(F.when(F.col("full"), F.col("words")).otherwise(0)).over(every)
    loose = F.sum(F.when(F.col("full"), 0).otherwise(weighted)).over(every)
    rate = (F.col("target") - most * held) / F.greatest(loose, F.lit(1))
    copies = F.when(F.col("full"), float(most)).otherwise(F.least(F.lit(float(most)), rate * F.col("digits")))
    judged = judged.withColumn("expected", copies).withColumn("certain", F.floor("expected"))
    need = F.col("target") - F.sum(F.col("certain") * F.col("words")).over(every)
    return judged.select("number", "digits", "certain", (F.col("expected") - F.col("certain")).alias("chance"), need.alias("need"))


def sampled(units: DataFrame, few: bool = False) -> DataFrame:
    """`extra` and `need` after one more round: the first units by odds whose words are within `need`.

    Only units with size <= need take part, with the copies that aren't taken yet.
    """
    left = F.col("copies") - F.col("extra")
    able = (F.col("chance") > 0) & (F.col("size") <= F.col("need")) & (left > 0)
    step = F.when(able, F.floor(F.log("odds") * STEPS).cast("int"))
    cut = units.withColumn("step", step)
    sums = cut.where("step IS NOT NULL").groupBy("number", "step").agg(F.sum(F.col("size") * left).alias("words"), F.max("need").alias("need"))
    sums = sums.withColumn("to", F.sum("words").over(Window.partitionBy("number").orderBy("step")))
    ends = sums.where(F.col("to") > F.col("need")).groupBy("number").agg(F.min("step").alias("end"), F.min(F.col("to") - F.col("words")).alias("before"))
    marked = cut.join(small(ends, few), "number", "left")
    inside = F.col("step").isNotNull() & (F.col("step") == F.col("end"))
    last = marked.where(inside)
    earlier = Window.partitionBy("number").orderBy("odds", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("need") - F.col("before") - F.coalesce(F.sum(F.col("size") * left).over(earlier), F.lit(0))
    last = last.withColumn("more", F.greatest(F.lit(0), F.least(left, F.floor(room / F.col("size")))))
    others = marked.where(~F.coalesce(inside, F.lit(False)))
    others = others.withColumn("more", F.when(F.col("step").isNotNull() & (F.col("end").isNull() | (F.col("step") < F.col("end"))), left).otherwise(0))
    both = others.unionByName(last).withColumn("extra", (F.col("extra") + F.col("more")).cast("long"))
    taken = both.groupBy("number").agg(F.sum(F.col("more") * F.col("size")).alias("words"))
    return both.join(small(taken, few), "number").withColumn("need", F.col("need") - F.col("words")).select(*units.columns)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, share: float = 1.0) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row of `docs` (doc_id, text, source)."""
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), token_count(F.col("text")).alias("size"))
    units = checkpointed(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")))
    aims = targets(units.select("source", (F.col("size") * F.col("copies")).alias("size")), weights, most, share)
    aims = checkpointed(aims).withColumnRenamed("source", "_source")
    few = aims.count() <= BROADCAST_SOURCES
    known = units.join(small(aims, few), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    known = checkpointed(known.withColumn("digits", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0)))

    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("long")
    u = (bits + 0.5) / float(2**52)
    chances = expected(known, aims, most)
    drawn = known.join(small(chances, few), ["number", "digits"], "left").fillna({"certain": 0, "chance": 0.0, "need": 0.0})
    odds = F.when(F.col("chance") > 0, (u / (1 - u)) / (F.col("chance") / (1 - F.col("chance"))))
    drawn = drawn.withColumn("odds", odds).withColumn("extra", F.lit(0).cast("long"))
    for _ in range(ROUNDS):
        drawn = checkpointed(sampled(drawn, few))
    each = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    taken = F.col("size") * (F.col("certain") + F.when(F.col("copy") <= F.col("extra"), 1).otherwise(0))
    return each.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


_ROUND = """
a{k} AS (
  SELECT *, size <= need AND chance > 0 AND copies > extra AS able, copies - extra AS free FROM r{j}),
b{k} AS (
  SELECT *, CASE WHEN able THEN greatest(0, least(free, CAST(floor((need - coalesce(sum(CASE WHEN able THEN size * free ELSE 0 END) OVER (
    PARTITION BY number ORDER BY odds NULLS LAST, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / size) AS BIGINT))) ELSE 0 END AS more FROM a{k}),
r{k} AS (
  SELECT b{k}.* EXCLUDE (able, free, more, extra, need), extra + more AS extra, need - sum(more * size) OVER (PARTITION BY number) AS need FROM b{k})"""

ORACLE = (
    """
WITH u AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, count(*) AS copies
  FROM documents GROUP BY ALL),
s AS (
  SELECT source, sum(size * copies) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM u GROUP BY source),
f AS (
  SELECT *, 3 * source_size * (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) <= weight * (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER w, 0)) AS stop
  FROM s WINDOW w AS (ORDER BY source_size * (10 // weight), number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, number, CAST(source_size AS BIGINT) AS source_size, CASE WHEN stop THEN CAST(3 * source_size AS DOUBLE)
    ELSE CAST(weight * (sum(source_size) OVER () - 3 * sum(CASE WHEN stop THEN source_size ELSE 0 END) OVER ()) AS DOUBLE)
       / CAST(sum(CASE WHEN stop THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target FROM f),
k AS (
  SELECT u.doc_id, u.size, u.copies, t.number, t.source_size, t.target, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS digits
  FROM u JOIN t ON u.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT number, digits, any_value(target) AS target, sum(size * copies) AS words FROM k WHERE size > 0 GROUP BY ALL),
g AS (
  SELECT *, (target - 3 * coalesce(sum(words) OVER w, 0)) * digits >= 3 * (sum(digits * words) OVER (PARTITION BY number) - coalesce(sum(digits * words) OVER w, 0)) AS stop
  FROM c WINDOW w AS (PARTITION BY number ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (
  SELECT *, CASE WHEN stop THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, (target - 3 * CAST(sum(CASE WHEN stop THEN words ELSE 0 END) OVER w AS DOUBLE))
    / CAST(greatest(sum(CASE WHEN stop THEN 0 ELSE digits * words END) OVER w, 1) AS DOUBLE) * digits) END AS expected FROM g WINDOW w AS (PARTITION BY number)),
i AS (
  SELECT number, digits, floor(expected) AS certain, expected - floor(expected) AS chance, target - sum(floor(expected) * words) OVER (PARTITION BY number) AS need FROM h),
d AS (
  SELECT k.*, (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
         coalesce(certain, 0) AS certain, coalesce(chance, 0) AS chance, coalesce(need, 0) AS need, CAST(0 AS BIGINT) AS extra
  FROM k LEFT JOIN i USING (number, digits)),
r0 AS (
  SELECT *, CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS odds FROM d),"""
    + ",".join(_ROUND.format(k=k, j=k - 1) for k in range(1, ROUNDS + 1))
    + f"""
SELECT doc_id, size, source_size, target, CAST(size * (certain + CASE WHEN copy <= extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM r{ROUNDS})
"""
)
