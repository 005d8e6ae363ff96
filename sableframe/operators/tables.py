"""HTML tables as rows of cells on their grid, and cells as text blocks.

Cells come from one pass of a pattern over a table's markup; a fold places them,
row by row, keeping for each column the row from which it is free again. All of
it is native; only character references are resolved by a small Arrow function.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import trimmed

#: Events of a table's markup: rows that open or close, and whole cells; what isn't closed is no cell.
EVENTS = r"(?is)<tr\b[^>]*+>|</tr\s*+>|<t[dh]\b[^>]*+>(?:(?!</?t[dhr]\b).)*+</t[dh]\s*+>"
TABLES = r"(?is)<table\b.*?</table\s*>"
#: Largest span, as in the standard of HTML.
WIDEST = 1000
# Fixed value: a cell's share of its table's confidence.
CELL_CONFIDENCE = 0.9
CELL = "array<struct<text:string,col_span:int,row_span:int>>"
PLACED = "array<struct<text:string,row:int,col:int,row_span:int,col_span:int>>"


@F.pandas_udf(StringType())
def _unescaped(x: pd.Series) -> pd.Series:
    return x.map(lambda s: html.unescape(html.unescape(s)), na_action="ignore")


def unescaped(x: Column) -> Column:
    """Character references resolved, also those that were escaped themselves."""
    return F.when(x.contains("&"), _unescaped(x)).otherwise(x)


def _span(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(?:\"\s*\+?(\d{{1,9}})\s*\"|'\s*\+?(\d{{1,9}})\s*'|\+?(\d{{1,9}})(?=[\s>]))", 0)
    return F.least(F.greatest(F.coalesce(F.regexp_extract(found, r"(\d+)", 1).try_cast("int"), F.lit(1)), F.lit(1)), F.lit(WIDEST))


def table_rows(markup: Column) -> Column:
    """array<array<cell>>: rows with at least one cell, cells with their text (tags left out) and spans."""
    events = F.regexp_extract_all(F.regexp_replace(markup, r"(?s)<!--.*?-->", ""), F.lit(EVENTS), F.lit(0))
    none, no_rows = F.array().cast(CELL), F.array().cast(f"array<{CELL}>")

    def cell(x: Column) -> Column:
        tag = F.regexp_extract(x, r"(?s)^<[^>]*>", 0)
        text = F.regexp_replace(F.regexp_replace(x, r"(?s)^<[^>]*>|</t[dhTDH]\s*>$", ""), r"(?s)<[^>]*>", "")
        return F.struct(text.alias("text"), _span(tag, "colspan").alias("col_span"), _span(tag, "rowspan").alias("row_span"))

    def closed(state: Column) -> Column:
        return F.when(F.size(state["open"]) > 0, F.concat(state["rows"], F.array(state["open"]))).otherwise(state["rows"])

    def step(state: Column, x: Column) -> Column:
        opens, closes = x.rlike(r"(?i)^<tr\b"), x.startswith("</")
        rows = F.when(closes, closed(state)).otherwise(state["rows"])
        return F.struct(F.when(opens | closes, none).otherwise(F.concat(state["open"], F.array(cell(x)))).alias("open"), rows.alias("rows"))

    return F.aggregate(events, F.struct(none.alias("open"), no_rows.alias("rows")), step, closed)


def placed(rows: Column) -> Column:
    """Cells with row and column: each takes the next column that no cell from above or beside covers."""
    start = F.struct(F.lit(-1).alias("row"), F.lit(0).alias("next"), F.array().cast("array<int>").alias("free"), F.array().cast(PLACED).alias("cells"))
    cells = F.flatten(F.transform(rows, lambda row, i: F.transform(row, lambda c: F.struct(i.cast("int").alias("row"), c["text"].alias("text"), c["col_span"].alias("w"), c["row_span"].alias("h")))))

    def at(state: Column, x: Column, col: Column) -> Column:
        until = F.greatest(F.size(state["free"]), col + x["w"])
        old = F.transform(F.sequence(F.lit(0), until - 1), lambda c: F.coalesce(F.get(state["free"], c), F.lit(0)))
        free = F.transform(old, lambda f, c: F.when((c >= col) & (c < col + x["w"]), F.greatest(f, x["row"] + x["h"])).otherwise(f))
        one = F.struct(x["text"].alias("text"), x["row"].alias("row"), col.alias("col"), x["h"].alias("row_span"), x["w"].alias("col_span"))
        return F.struct(x["row"].alias("row"), (col + x["w"]).alias("next"), free.alias("free"), F.concat(state["cells"], F.array(one)).alias("cells"))

    def step(state: Column, x: Column) -> Column:
        first = F.when(state["row"] == x["row"], state["next"]).otherwise(0)
        open_ = F.filter(F.sequence(first, F.greatest(first, F.size(state["free"]))), lambda c: F.coalesce(F.get(state["free"], c), F.lit(0)) <= x["row"])
        # one column is found once and then used throughout the step
        return F.get(F.transform(F.array(F.array_min(open_)), lambda col: at(state, x, col)), F.lit(0))

    return F.aggregate(cells, start, step, lambda s: s["cells"])


def table_cells(pages: DataFrame, markup: str = "html") -> DataFrame:
    """The columns of `pages` but its markup, with table_no, text, row, col, row_span and col_span of every cell."""
    keep = [c for c in pages.columns if c != markup]
    tables = pages.select(*keep, F.posexplode(F.regexp_extract_all(markup, F.lit(TABLES), F.lit(0))).alias("table_no", "_t"))
    cells = tables.select(*keep, "table_no", F.explode(placed(table_rows(F.col("_t")))).alias("_c")).select(*keep, "table_no", "_c.*")
    return cells.withColumn("text", trimmed(unescaped(F.col("text"))))


def expanded(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, pos, text, left, top, width, height, confidence) with tables as one block for each cell that has a text.

    Cells divide the table's box evenly. A table without cells stays as plain
    text, or as it is if it has none. `cell` counts a table's cells, from 0.
    """
    is_table = F.col("text").startswith("<table") & F.col("text").contains("</table>")
    others = blocks.where(~F.coalesce(is_table, F.lit(False))).withColumn("cell", F.lit(None).cast("int"))
    tables = blocks.where(is_table).withColumn("_cells", placed(table_rows(F.col("text"))))
    n_rows, n_cols = (F.array_max(F.transform("_cells", lambda c: c[x] + c[y])) for x, y in (("row", "row_span"), ("col", "col_span")))
    tall, wide = F.greatest(F.col("height") / n_rows, F.lit(1.0)), F.greatest(F.col("width") / n_cols, F.lit(1.0))
    each = tables.where(F.size("_cells") > 0).withColumns({"_tall": tall, "_wide": wide}).select("*", F.posexplode("_cells").alias("cell", "_c"))
    each = each.withColumns({
        "text": trimmed(unescaped(F.col("_c.text"))), "left": F.col("left") + F.col("_c.col") * F.col("_wide"), "top": F.col("top") + F.col("_c.row") * F.col("_tall"),
        "width": F.col("_wide") * F.col("_c.col_span"), "height": F.col("_tall") * F.col("_c.row_span"), "confidence": F.col("confidence") * CELL_CONFIDENCE,
    }).where("text != ''")
    plain = trimmed(F.regexp_replace(unescaped(F.regexp_replace("text", r"(?s)<[^>]*>", " ")), r"\s+", " "))
    bare = tables.where(F.size("_cells") == 0).withColumn("text", F.when(plain != "", plain).otherwise(F.col("text"))).withColumn("cell", F.lit(None).cast("int"))
    columns = [*blocks.columns, "cell"]
    return others.select(columns).unionByName(each.select(columns)).unionByName(bare.select(columns))
