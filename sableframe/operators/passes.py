"""Several passes of a recogniser over documents, until one adds nothing.

A pass is a function from documents and the pass's number to what it found:
(doc_id, type, value). Values only ever add up. Each document is asked again
only if its last pass found something new; whether any is left is one row for
the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import kept


def union_of_passes(docs: DataFrame, ask: Callable[[DataFrame, int], DataFrame], most: int = 4) -> DataFrame:
    """doc_id, type, value, pass: every distinct value with the pass that found it first; empty values and types count as nothing.

    The first pass doesn't end the search of a document even if it finds
    nothing; a later one that adds nothing does. Every pass is kept in the
    shared folder, so it runs once and the plan doesn't grow.
    """
    key = ["doc_id", "type", "value"]

    def found_by(some: DataFrame, number: int) -> DataFrame:
        rows = ask(some, number).select(*key).where((F.coalesce("value", F.lit("")) != "") & F.col("type").isNotNull()).distinct()
        return rows.withColumn("pass", F.lit(number))

    union = kept(found_by(docs, 0))
    asked = docs
    for number in range(1, max(1, most)):
        new = kept(found_by(asked, number).join(union.select(*key), key, "left_anti"))
        if new.isEmpty():
            break
        union = kept(union.unionByName(new))
        again = new.select(F.col("doc_id").alias("_again")).distinct()
        asked = docs.join(again, F.col("doc_id") == F.col("_again"), "left_semi")
    return union


def ordered_values(union: DataFrame) -> DataFrame:
    """doc_id, type, values (by pass, then value) and passes."""
    rows = F.array_sort(F.collect_list(F.struct("pass", "value")))
    return union.groupBy("doc_id", "type").agg(F.transform(rows, lambda x: x["value"]).alias("values"), (F.max("pass") + 1).alias("passes"))
