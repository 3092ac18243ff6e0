"""Boxes as structs of four numbers: (x, y, w, h) with the corner, the same with the centre, or two corners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _struct(**parts: Column) -> Column:
    return F.struct(*[v.cast("double").alias(k) for k, v in parts.items()])


def xywh_to_tlbr(b: Column) -> Column:
    return _struct(x1=b["x"], y1=b["y"], x2=b["x"] + b["w"], y2=b["y"] + b["h"])


def xywh_to_cxywh(b: Column) -> Column:
    return _struct(cx=b["x"] + b["w"] / 2, cy=b["y"] + b["h"] / 2, w=b["w"], h=b["h"])


def cxywh_to_xywh(b: Column) -> Column:
    return _struct(x=b["cx"] - b["w"] / 2, y=b["cy"] - b["h"] / 2, w=b["w"], h=b["h"])


def tlbr_to_xywh(b: Column) -> Column:
    return _struct(x=b["x1"], y=b["y1"], w=b["x2"] - b["x1"], h=b["y2"] - b["y1"])


def tlbr_to_extent(b: Column) -> Column:
    return _struct(x1=b["x1"], x2=b["x2"], y1=b["y1"], y2=b["y2"])


def scaled(b: Column, fx: float, fy: float | None = None) -> Column:
    fy = fx if fy is None else fy
    return _struct(x=b["x"] * fx, y=b["y"] * fy, w=b["w"] * fx, h=b["h"] * fy)


def shifted(b: Column, dx: float, dy: float) -> Column:
    return _struct(x=b["x"] + dx, y=b["y"] + dy, w=b["w"], h=b["h"])


def clipped(b: Column, x_min: float, y_min: float, x_max: float, y_max: float) -> Column:
    """Two corners moved inside the bounds."""
    inside = lambda v, lo, hi: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), v))
    return _struct(x1=inside(b["x1"], x_min, x_max), y1=inside(b["y1"], y_min, y_max), x2=inside(b["x2"], x_min, x_max), y2=inside(b["y2"], y_min, y_max))


def transposed(b: Column) -> Column:
    return _struct(x=b["y"], y=b["x"], w=b["h"], h=b["w"])


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def centre(b: Column) -> Column:
    return _struct(x=b["x"] + b["w"] / 2, y=b["y"] + b["h"] / 2)


def iou(a: Column, b: Column, bias: float = 1.0) -> Column:
    """Intersection over union of two (x1, y1, x2, y2); ``bias`` 1 counts both border pixels."""
    span = lambda lo, hi: F.greatest(F.lit(0.0), hi - lo + bias)
    inter = span(F.greatest(a["x1"], b["x1"]), F.least(a["x2"], b["x2"])) * span(F.greatest(a["y1"], b["y1"]), F.least(a["y2"], b["y2"]))
    size = lambda c: (c["x2"] - c["x1"] + bias) * (c["y2"] - c["y1"] + bias)
    return inter / (size(a) + size(b) - inter)
