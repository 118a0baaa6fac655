"""Column functions on boxes (structs of x1, y1, x2, y2) and intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1, y1, x2, y2) -> Column:
    c = lambda v, n: (F.col(v) if isinstance(v, str) else v).cast("double").alias(n)
    return F.struct(c(x1, "x1"), c(y1, "y1"), c(x2, "x2"), c(y2, "y2"))


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    """0 where a side is negative."""
    return F.greatest(F.lit(0.0), width(b)) * F.greatest(F.lit(0.0), height(b))


def center(b: Column) -> tuple[Column, Column]:
    return (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2


def union_box(a: Column, b: Column) -> Column:
    return box(F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]), F.greatest(a["x2"], b["x2"]), F.greatest(a["y2"], b["y2"]))


def overlap(a: Column, b: Column, pixel: float = 0.0) -> Column:
    """Area in common; pixel 1: sides count their last pixel."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]) + pixel
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]) + pixel
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def _ratio(a: Column, b: Column, eps: float, pixel: float = 0.0) -> Column:
    side = lambda x: (width(x) + pixel) * (height(x) + pixel)
    inter = overlap(a, b, pixel)
    return inter / (side(a) + side(b) - inter + eps)


def iou_eps(a: Column, b: Column) -> Column:
    return _ratio(a, b, 1e-8)


def iou_early(a: Column, b: Column) -> Column:
    """0 without an overlap, else with 1e-6 below the line."""
    return F.when(overlap(a, b) <= 0, 0.0).otherwise(_ratio(a, b, 1e-6))


def iou_exact(a: Column, b: Column) -> Column:
    inter = overlap(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def iou_pixels(a: Column, b: Column, eps: float = 0.0) -> Column:
    return _ratio(a, b, eps, 1.0)


IOU: dict[str, Callable[[Column, Column], Column]] = {"eps": iou_eps, "early": iou_early, "exact": iou_exact, "pixels": iou_pixels}


def to_deltas(roi: Column, gt: Column) -> Column:
    """Centre shifts in sides of roi, logarithms of side ratios."""
    (rx, ry), (gx, gy) = center(roi), center(gt)
    return F.struct(((gx - rx) / width(roi)).alias("tx"), ((gy - ry) / height(roi)).alias("ty"), F.log(width(gt) / width(roi)).alias("tw"), F.log(height(gt) / height(roi)).alias("th"))


def from_deltas(roi: Column, d: Column, most: float = 4.0) -> Column:
    (x, y), w, h = center(roi), width(roi), height(roi)
    cx, cy = d["tx"] * w + x, d["ty"] * h + y
    nw, nh = F.exp(F.least(d["tw"], F.lit(most))) * w, F.exp(F.least(d["th"], F.lit(most))) * h
    return box(cx - nw / 2, cy - nh / 2, cx + nw / 2, cy + nh / 2)


def clip(b: Column, w: Column | float, h: Column | float) -> Column:
    lim = lambda v, m: F.greatest(F.lit(0.0), F.least(v, F.lit(m) if isinstance(m, (int, float)) else m))
    return box(lim(b["x1"], w), lim(b["y1"], h), lim(b["x2"], w), lim(b["y2"], h))


def flip(b: Column, w: Column | float) -> Column:
    w = F.lit(w) if isinstance(w, (int, float)) else w
    return box(w - b["x2"], b["y1"], w - b["x1"], b["y2"])


def spatial_features(s: Column, o: Column, w: float, h: float) -> list[Column]:
    """Fourteen numbers of an ordered pair in an image of w by h."""
    (sx, sy), (ox, oy) = center(s), center(o)
    e = 1e-6
    norm = [F.lit(0.0) + v for b in (s, o) for v in (b["x1"] / w, b["y1"] / h, b["x2"] / w, b["y2"] / h)]
    six = [(sx - ox) / w, (sy - oy) / h, F.log((area(s) + e) / (area(o) + e)), iou_exact(s, o), width(s) / (width(o) + e), height(s) / (height(o) + e)]
    return six + norm


def resize_scale(w: Column, h: Column, least: float = 600.0, most: float = 1000.0) -> Column:
    return F.least(least / F.least(w, h), most / F.greatest(w, h))


def interval_scores(gs: Column, ge: Column, ps: Column, pe: Column, eps: float = 1e-32) -> dict[str, Column]:
    """Overlap of a true and a found interval: iou, precision, recall, f1."""
    inter = F.greatest(F.lit(0.0), F.least(ge, pe) - F.greatest(gs, ps))
    p, r = inter / (pe - ps + eps), inter / (ge - gs + eps)
    return {"iou": inter / ((ge - gs) + (pe - ps) - inter + eps), "precision": p, "recall": r, "f1": 2 * p * r / (p + r + eps)}
