"""Boxes on pages: duplicates, consensus of several runs, suppression.

Boxes are rows (box_id, run, page, type, text, x, y, width, height, confidence).
All pairs are taken within one page and type; pages are the unit of work.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def _values(r) -> tuple[float, float, float, float]:
    return r.x, r.y, r.x + r.width, r.y + r.height


def _overlap(a: tuple, b: tuple, mode: str) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0.0) * max(h, 0.0)
    one, two = (a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1])
    whole = one + two - both if mode == "iou" else min(one, two)
    return both / whole if whole > 0 else 0.0


def covered(target: tuple, covers: list[tuple]) -> bool:
    """Whether a box lies in the union of others, by the cells between all their edges."""
    xs = sorted({target[0], target[2], *(x for c in covers for x in (c[0], c[2]) if target[0] < x < target[2])})
    ys = sorted({target[1], target[3], *(y for c in covers for y in (c[1], c[3]) if target[1] < y < target[3])})
    return all(
        any(c[0] <= x0 and c[2] >= x1 and c[1] <= y0 and c[3] >= y1 for c in covers)
        for x0, x1 in zip(xs, xs[1:], strict=False)
        for y0, y1 in zip(ys, ys[1:], strict=False)
    )


def overlapping_pairs(boxes: DataFrame, least: float = 0.5) -> DataFrame:
    """(page, type, a, b, iou) of boxes of one page and type; an equi-join with a condition."""
    a, b = boxes.alias("a"), boxes.alias("b")
    same = (F.col("a.page") == F.col("b.page")) & (F.col("a.type") == F.col("b.type")) & (F.col("a.box_id") < F.col("b.box_id"))
    value = g.iou("a", "b")
    return a.join(b, same).select("a.page", "a.type", F.col("a.box_id").alias("a"), F.col("b.box_id").alias("b"), value.alias("iou")).where(F.col("iou") >= least)


def deduplicated(boxes: DataFrame, least: float = 0.5, mode: str = "iou") -> DataFrame:
    """Greedy, the largest first: a box stays unless it overlaps one that stayed (iou, or share of the smaller)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_a=pdf.width * pdf.height).sort_values(["_a", "box_id"], ascending=[False, True])
        kept, stay = [], []
        for r in pdf.itertuples():
            v = _values(r)
            ok = all(_overlap(v, k, mode) < least for k in kept)
            stay.append(ok)
            if ok:
                kept.append(v)
        return pdf[stay].drop(columns="_a")

    return boxes.groupBy("page", "type").applyInPandas(run, boxes.schema)


def consensus(boxes: DataFrame, least_votes: int = 2, least: float = 0.5) -> DataFrame:
    """Clusters of boxes of several runs by single linkage: median box, or the hull if one vote is enough; `votes` are distinct runs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("box_id").itertuples())
        root = list(range(len(rows)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(len(rows)):
            for j in range(i):
                if _overlap(_values(rows[i]), _values(rows[j]), "iou") >= least:
                    root[max(find(i), find(j))] = min(find(i), find(j))
        out = []
        for k in sorted({find(i) for i in range(len(rows))}):
            some = pd.DataFrame([_values(rows[i]) for i in range(len(rows)) if find(i) == k], columns=["x0", "y0", "x1", "y1"])
            votes = len({rows[i].run for i in range(len(rows)) if find(i) == k})
            if votes < least_votes:
                continue
            x0, y0, x1, y1 = (some.x0.min(), some.y0.min(), some.x1.max(), some.y1.max()) if least_votes <= 1 else some.median()
            out.append((rows[k].page, rows[k].type, rows[k].box_id, votes, x0, y0, x1 - x0, y1 - y0))
        return pd.DataFrame(out, columns=["page", "type", "box_id", "votes", "x", "y", "width", "height"])

    return boxes.groupBy("page", "type").applyInPandas(run, "page long, type string, box_id long, votes long, x double, y double, width double, height double")


def merged_shards(boxes: DataFrame, gap: float = 0.01) -> DataFrame:
    """Boxes of one page and type that touch (within `gap`) become their hull, again until nothing touches."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        todo = [(r.box_id, *_values(r)) for r in pdf.sort_values("box_id").itertuples()]
        changed = True
        while changed:
            changed, out = False, []
            for b in todo:
                for i, o in enumerate(out):
                    if b[1] <= o[3] + gap and o[1] <= b[3] + gap and b[2] <= o[4] + gap and o[2] <= b[4] + gap:
                        out[i] = (min(b[0], o[0]), min(b[1], o[1]), min(b[2], o[2]), max(b[3], o[3]), max(b[4], o[4]))
                        changed = True
                        break
                else:
                    out.append(b)
            todo = out
        first = pdf.iloc[0]
        return pd.DataFrame([(first.page, first.type, i, x0, y0, x1 - x0, y1 - y0) for i, x0, y0, x1, y1 in todo], columns=["page", "type", "box_id", "x", "y", "width", "height"])

    return boxes.groupBy("page", "type").applyInPandas(run, "page long, type string, box_id long, x double, y double, width double, height double")


def without_full_pages(boxes: DataFrame) -> DataFrame:
    return boxes.where(~g.full_page())


def without_contained(boxes: DataFrame) -> DataFrame:
    """Boxes that lie in a larger one of the same page and type go."""
    a, b = boxes.alias("a"), boxes.alias("b")
    inner = (
        (F.col("a.page") == F.col("b.page")) & (F.col("a.type") == F.col("b.type")) & (F.col("a.box_id") != F.col("b.box_id"))
        & g.contains("a", "b") & ((g.area("a") < g.area("b")) | ((g.area("a") == g.area("b")) & (F.col("a.box_id") > F.col("b.box_id"))))
    )
    return a.join(b, inner, "left_anti")


def prefer_detector(boxes: DataFrame, best: str) -> DataFrame:
    """Boxes of other sources go where the middle of one of the `best` source lies in them, same page and type."""
    a, b = boxes.alias("a"), boxes.where(F.col("source") == best).alias("b")
    hit = (F.col("a.page") == F.col("b.page")) & (F.col("a.type") == F.col("b.type")) & (F.col("a.source") != best) & g.center_inside("b", "a")
    return a.join(b, hit, "left_anti")


def without_text_inside(text_boxes: DataFrame, visual: DataFrame) -> DataFrame:
    """Text in a signature goes; text in a seal goes only if its value isn't printed elsewhere on the page."""
    a, v = text_boxes.alias("a"), visual.alias("v")
    inside = (F.col("a.page") == F.col("v.page")) & g.contains("a", "v")
    hit = a.join(v, inside).groupBy("a.page", "a.box_id").agg(F.bool_or(F.col("v.type") == "signature").alias("in_signature"), F.first("a.text").alias("text"))
    in_seal = hit.where("NOT in_signature")
    elsewhere = text_boxes.join(hit.select("page", "box_id"), ["page", "box_id"], "left_anti").select("page", "text").distinct()
    gone = hit.where("in_signature").select("page", "box_id").union(in_seal.join(elsewhere, ["page", "text"], "left_anti").select("page", "box_id"))
    return text_boxes.join(gone, ["page", "box_id"], "left_anti")


def rows_merged(boxes: DataFrame, gap: float = 0.6) -> DataFrame:
    """Boxes of one page and row (row) whose gap is at most a share of their mean height become one."""
    w = Window.partitionBy("page", "row").orderBy("x", "box_id")
    reach = F.max(F.col("x") + F.col("width")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    mean = F.avg("height").over(Window.partitionBy("page", "row"))
    part = F.sum(F.when(F.col("x") - reach > gap * mean, 1).otherwise(0)).over(w)
    hull = boxes.withColumn("part", part).groupBy("page", "row", "part").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"), F.count("*").alias("boxes")
    )
    return hull.select("page", "row", "part", "x", "y", (F.col("x1") - F.col("x")).alias("width"), (F.col("y1") - F.col("y")).alias("height"), "boxes")


def reading_order(boxes: DataFrame) -> DataFrame:
    """Adds `row` and `place`: rows from the top by overlapping vertical middles, boxes in them from the left."""
    w = Window.partitionBy("page").orderBy(F.col("y") + F.col("height") / 2, "box_id")
    middle = F.col("y") + F.col("height") / 2
    opens = F.when(middle > F.coalesce(F.lag(F.col("y") + F.col("height")).over(w), F.lit(-1.0)), 1).otherwise(0)
    rows = boxes.withColumn("_o", opens).withColumn("row", F.sum("_o").over(w)).drop("_o")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("page", "row").orderBy("x", "box_id")))


def line_height(boxes: DataFrame) -> DataFrame:
    """(page, line_height): the median of the lower half of the heights."""
    half = F.slice(F.sort_array(F.collect_list("height")), F.lit(1), F.greatest(F.floor((F.count("*") + 1) / 2), F.lit(1)).cast("int"))
    return boxes.groupBy("page").agg(half.alias("h")).select("page", F.get("h", F.floor((F.size("h") - 1) / 2).cast("int")).alias("line_height"))


def issues(boxes: DataFrame) -> DataFrame:
    """Adds `issues`: what a reviewer should look at."""
    found = F.array(
        F.when((F.col("confidence") > 0) & (F.col("confidence") < 0.5), "low_confidence"),
        F.when(F.col("source") == "fallback", "fallback_detector"),
        F.when(g.area("") > 0.5, "large_region"),
        F.when((F.col("type") == "seal") & ((F.col("x") <= 0.001) | (F.col("x") + F.col("width") >= 0.999)), "edge_seal"),
    )
    return boxes.withColumn("issues", F.filter(found, lambda x: x.isNotNull()))
