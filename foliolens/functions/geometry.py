"""Geometry of boxes (left, bottom, right, top) and affine maps as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in "lbrt"}


def area(a: dict[str, Column]) -> Column:
    return F.greatest(F.lit(0.0), a["r"] - a["l"]) * F.greatest(F.lit(0.0), a["t"] - a["b"])


def intersection(a: dict[str, Column], b: dict[str, Column]) -> Column:
    wide = F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"])
    high = F.least(a["t"], b["t"]) - F.greatest(a["b"], b["b"])
    return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    return F.when(den <= 0, F.lit(default)).otherwise(num / den)


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    both = intersection(a, b)
    return ratio(both, area(a) + area(b) - both)


def containment(inner: dict[str, Column], outer: dict[str, Column]) -> Column:
    return ratio(intersection(inner, outer), area(inner))


def expanded(a: dict[str, Column], margin: float) -> dict[str, Column]:
    return {"l": a["l"] - margin, "b": a["b"] - margin, "r": a["r"] + margin, "t": a["t"] + margin}


def centre(a: dict[str, Column]) -> tuple[Column, Column]:
    return (a["l"] + a["r"]) / 2, (a["b"] + a["t"]) / 2


def distance_score(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """1 where centres meet, 0 from twice the second box's diagonal on."""
    (ax, ay), (bx, by) = centre(a), centre(b)
    far = F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
    diagonal = F.sqrt((b["r"] - b["l"]) * (b["r"] - b["l"]) + (b["t"] - b["b"]) * (b["t"] - b["b"]))
    return F.greatest(F.lit(0.0), F.lit(1.0) - far / F.greatest(diagonal * 2, F.lit(1.0)))


def affine_product(a: list[Column], b: list[Column]) -> list[Column]:
    """Six numbers of the map that applies a, then b."""
    return [
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    ]


def affine_point(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]
