"""Box arithmetic on columns; a box is a mapping of x1, y1, x2, y2 to columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = dict[str, Column]


def box(prefix: str = "") -> Box:
    return {k: F.col(f"{prefix}{k}") for k in ("x1", "y1", "x2", "y2")}


def area(b: Box) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for touching edges and for an empty union."""
    w = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, (w * h) / union).otherwise(F.lit(0.0))


def intersects(a: Box, b: Box) -> Column:
    """True also where the edges touch."""
    return (a["x1"] <= b["x2"]) & (b["x1"] <= a["x2"]) & (a["y1"] <= b["y2"]) & (b["y1"] <= a["y2"])


def inside(inner: Box, outer: Box) -> Column:
    return (inner["x1"] >= outer["x1"]) & (inner["y1"] >= outer["y1"]) & (inner["x2"] <= outer["x2"]) & (inner["y2"] <= outer["y2"])


def clip(b: Box, width: int, height: int) -> Box:
    """The part on a width x height image; all null if nothing is left."""
    c = {
        "x1": F.greatest(F.lit(0), F.floor(b["x1"])),
        "y1": F.greatest(F.lit(0), F.floor(b["y1"])),
        "x2": F.least(F.lit(width), F.ceil(b["x2"])),
        "y2": F.least(F.lit(height), F.ceil(b["y2"])),
    }
    there = (c["x2"] > c["x1"]) & (c["y2"] > c["y1"])
    return {k: F.when(there, v).cast("long") for k, v in c.items()}


def fit_scale(width: Column, height: Column, to: int) -> Column:
    """Scale that brings the longer side to `to`, never above 1."""
    return F.least(F.lit(1.0), F.lit(float(to)) / F.greatest(width, height))
