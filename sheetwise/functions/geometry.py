"""Scalar expressions over boxes and keypoints; ``p`` is a prefix of the box's column names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges(p: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(p + c) for c in ("left", "top", "right", "bottom"))


def center_x(p: str = "") -> Column:
    left, _, right, _ = edges(p)
    return left + (right - left) / 2


def center_y(p: str = "") -> Column:
    _, top, _, bottom = edges(p)
    return top + (bottom - top) / 2


def area(p: str = "") -> Column:
    left, top, right, bottom = edges(p)
    return (right - left) * (bottom - top)


def intersection_area(p: str, q: str) -> Column:
    """Area of the overlap; 0 for disjoint boxes."""
    l1, t1, r1, b1 = edges(p)
    l2, t2, r2, b2 = edges(q)
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(r1, r2) - F.greatest(l1, l2)) * F.greatest(zero, F.least(b1, b2) - F.greatest(t1, t2))


def iom(p: str, q: str) -> Column:
    """Intersection over the smaller area; null for a box without area."""
    return F.try_divide(intersection_area(p, q), F.least(area(p), area(q)))


def iou(p: str, q: str) -> Column:
    """Intersection over union; null for two boxes without area."""
    both = intersection_area(p, q)
    return F.try_divide(both, area(p) + area(q) - both)


METRICS = {"iom": iom, "iou": iou}


def box_status(p: str = "") -> Column:
    """``ok``, ``degenerate`` (equal sides) or ``invalid`` (sides in the wrong order or missing)."""
    left, top, right, bottom = edges(p)
    return F.when((left < right) & (top < bottom), "ok").when((left <= right) & (top <= bottom), "degenerate").otherwise("invalid")


def keypoint_within(p: str = "") -> Column:
    """Keypoint in its box, edges included."""
    left, top, right, bottom = edges(p)
    return F.col(p + "kp_x").between(left, right) & F.col(p + "kp_y").between(top, bottom)


def keypoint_inside(p: str = "") -> Column:
    """Keypoint in its box, edges excluded."""
    left, top, right, bottom = edges(p)
    x, y = F.col(p + "kp_x"), F.col(p + "kp_y")
    return (left < x) & (x < right) & (top < y) & (y < bottom)


def stated(value: Column, places: int = 6) -> Column:
    """A coordinate or distance at the precision at which it is compared: a millionth of a pixel, if not said otherwise."""
    return F.round(value, places)


def mean_ignoring_nulls(*values: Column) -> Column:
    """Mean of the values that are not null; null if all are."""
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    return F.try_divide(total, sum((v.isNotNull().cast("int") for v in values), F.lit(0)))


def tile_size(width: Column, height: Column, proportion: Column) -> Column:
    """Side of a square tile, cut to whole pixels."""
    return F.least(width * proportion, height * proportion).cast("int")


def raise_unless(ok: Column, message: str, value: Column) -> Column:
    """``value`` where ``ok`` holds; elsewhere the query fails with ``message``."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast("double"))
