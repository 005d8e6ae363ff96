"""Expressions over boxes (x, y, width, height as shares of the page)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(box: str, name: str) -> Column:
    return F.col(f"{box}.{name}" if box else name)


def area(a: str) -> Column:
    return field(a, "width") * field(a, "height")


def intersection(a: str, b: str) -> Column:
    def shared(start: str, size: str) -> Column:
        low = F.greatest(field(a, start), field(b, start))
        high = F.least(field(a, start) + field(a, size), field(b, start) + field(b, size))
        return F.greatest(high - low, F.lit(0.0))

    return shared("x", "width") * shared("y", "height")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def iou(a: str, b: str) -> Column:
    """Intersection over union."""
    return _ratio(intersection(a, b), area(a) + area(b) - intersection(a, b))


def smaller_overlap(a: str, b: str) -> Column:
    """Intersection over the smaller box."""
    return _ratio(intersection(a, b), F.least(area(a), area(b)))


def x_overlap(a: str, b: str) -> Column:
    low = F.greatest(field(a, "x"), field(b, "x"))
    high = F.least(field(a, "x") + field(a, "width"), field(b, "x") + field(b, "width"))
    return _ratio(F.greatest(high - low, F.lit(0.0)), F.least(field(a, "width"), field(b, "width")))


def center_inside(a: str, b: str) -> Column:
    """Whether the middle of `a` lies in `b`."""
    x, y = field(a, "x") + field(a, "width") / 2, field(a, "y") + field(a, "height") / 2
    return x.between(field(b, "x"), field(b, "x") + field(b, "width")) & y.between(field(b, "y"), field(b, "y") + field(b, "height"))


def contains(a: str, b: str, slack: float = 0.0) -> Column:
    """Whether `a` lies in `b`."""
    return (
        (field(a, "x") >= field(b, "x") - slack)
        & (field(a, "y") >= field(b, "y") - slack)
        & (field(a, "x") + field(a, "width") <= field(b, "x") + field(b, "width") + slack)
        & (field(a, "y") + field(a, "height") <= field(b, "y") + field(b, "height") + slack)
    )


def full_page(a: str = "", slack: float = 0.001) -> Column:
    return (
        (field(a, "x") <= slack)
        & (field(a, "y") <= slack)
        & (field(a, "x") + field(a, "width") >= 1 - slack)
        & (field(a, "y") + field(a, "height") >= 1 - slack)
    )


def clamped(x: Column, y: Column, width: Column, height: Column) -> Column:
    """The part of a box on the page, or null if there is none."""
    x0, y0 = (F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) for v in (x, y))
    x1, y1 = (F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) for v in (x + width, y + height))
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("width"), (y1 - y0).alias("height")))


def from_grid(x0: Column, y0: Column, x1: Column, y1: Column, grid: int = 1000) -> Column:
    """A model's corners on a fixed grid as a clamped box, corners in any order."""
    left, top = F.least(x0, x1) / grid, F.least(y0, y1) / grid
    return clamped(left, top, F.greatest(x0, x1) / grid - left, F.greatest(y0, y1) / grid - top)
