"""Rectangle algebra on struct columns (x0, y0, x1, y1), top-left origin (GEO01-GEO10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x0, y0, x1, y1) -> Column:
    as_col = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(as_col(x0).alias("x0"), as_col(y0).alias("y0"), as_col(x1).alias("x1"), as_col(y1).alias("y1"))


def area(r: Column) -> Column:
    """GEO01: zero for an empty rectangle."""
    return F.greatest(F.lit(0.0), r["x1"] - r["x0"]) * F.greatest(F.lit(0.0), r["y1"] - r["y0"])


def intersection_area(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def union_rect(r: Column) -> Column:
    """GEO01: aggregate, the smallest rectangle around a group's."""
    return F.struct(
        F.min(r["x0"]).alias("x0"), F.min(r["y0"]).alias("y0"), F.max(r["x1"]).alias("x1"), F.max(r["y1"]).alias("y1")
    )


def center_inside(inner: Column, outer: Column, pad: float = 0.004) -> Column:
    """GEO01: the centre lies in the padded rectangle."""
    cx, cy = (inner["x0"] + inner["x1"]) / 2, (inner["y0"] + inner["y1"]) / 2
    return cx.between(outer["x0"] - pad, outer["x1"] + pad) & cy.between(outer["y0"] - pad, outer["y1"] + pad)


def overlap_ratio(a: Column, b: Column) -> Column:
    """GEO02: share of ``a`` covered by ``b``; 0 for an empty ``a``."""
    return F.when(area(a) > 0, intersection_area(a, b) / area(a)).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    """GEO03."""
    both = intersection_area(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def caption_score(kind: Column, caption: Column, candidate: Column) -> Column:
    """GEO04: how well a visual fits a caption; -1 rejects."""
    width = F.least(caption["x1"] - caption["x0"], candidate["x1"] - candidate["x0"])
    shared = F.greatest(F.lit(0.0), F.least(caption["x1"], candidate["x1"]) - F.greatest(caption["x0"], candidate["x0"]))
    overlap = shared / F.greatest(F.lit(0.02), width)
    above, below = caption["y0"] - candidate["y1"], candidate["y0"] - caption["y1"]
    first = F.when(kind == "table", below).otherwise(above)
    second = F.when(kind == "table", above).otherwise(below)
    limit = F.when(kind == "figure", 0.35).otherwise(0.22)
    gap = lambda g: F.greatest(F.lit(0.0), g) * 6
    return (
        F.when(overlap < 0.15, -1.0)
        .when(first.between(F.lit(-0.015), limit), 3.0 + overlap - gap(first))
        .when(second.between(-0.015, 0.12), 2.85 + overlap - gap(second))
        .otherwise(-1.0)
    )


def reading_key(r: Column, page_width: Column) -> Column:
    """GEO05: spanning blocks first, then the left and the right column, top to bottom."""
    spans = (r["x1"] - r["x0"]) > page_width * 0.6
    right = (r["x0"] + r["x1"]) / 2 > page_width / 2
    column = F.when(spans, 0).when(right, 2).otherwise(1)
    return F.struct(column.alias("column"), r["y0"].alias("y"), r["x0"].alias("x"))


def from_bottom_left(r: Column, page_height: Column) -> Column:
    """GEO06: flip a rectangle whose origin is bottom-left, ordering its edges."""
    y0, y1 = page_height - r["y1"], page_height - r["y0"]
    return rect(F.least(r["x0"], r["x1"]), F.least(y0, y1), F.greatest(r["x0"], r["x1"]), F.greatest(y0, y1))


def clamp(r: Column, width: Column, height: Column) -> Column:
    """GEO06: cut at the page's edges, points rounded to two places."""
    cut = lambda v, hi: F.round(F.least(F.greatest(v, F.lit(0.0)), hi), 2)
    return rect(cut(r["x0"], width), cut(r["y0"], height), cut(r["x1"], width), cut(r["y1"], height))


def is_valid(r: Column) -> Column:
    return (r["x1"] > r["x0"]) & (r["y1"] > r["y0"])


def normalized(r: Column, width: Column, height: Column) -> Column:
    """GEO07: page-relative, five places."""
    return rect(
        F.round(r["x0"] / width, 5), F.round(r["y0"] / height, 5), F.round(r["x1"] / width, 5), F.round(r["y1"] / height, 5)
    )


def padded(r: Column, pad: float, width: Column, height: Column) -> Column:
    """GEO07: grown by ``pad`` and cut at the page's edges."""
    return rect(
        F.greatest(F.lit(0.0), r["x0"] - pad), F.greatest(F.lit(0.0), r["y0"] - pad),
        F.least(width, r["x1"] + pad), F.least(height, r["y1"] + pad),
    )


def same_line(a: Column, b: Column) -> Column:
    """GEO08: vertical overlap of 35 % of the flatter one and centres within 0.012."""
    shared = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    flat = F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])
    apart = F.abs((a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2)
    return ((flat > 0) & (shared / flat >= 0.35)) & (apart <= 0.012)


def fragment_follows(a: Column, b: Column) -> Column:
    """GEO08: ``b`` goes on where ``a`` ends, at most 0.035 to its right."""
    return same_line(a, b) & (b["x0"] - a["x1"]).between(-0.012, 0.035)


def box_matches(a: Column, b: Column, tolerance: float = 0.1) -> Column:
    """GEO09: all four edges within the tolerance."""
    near = [F.abs(a[k] - b[k]) <= tolerance for k in ("x0", "y0", "x1", "y1")]
    return near[0] & near[1] & near[2] & near[3]


def side_by_side(a: Column, b: Column) -> Column:
    """GEO10: two crops of one row: similar widths, level, a narrow gap."""
    wa, wb = a["x1"] - a["x0"], b["x1"] - b["x0"]
    shared = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    flat = F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])
    apart = F.abs((a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2)
    return (
        (F.least(wa, wb) / F.greatest(wa, wb) >= 0.72) & (shared / flat >= 0.82) & (apart <= 0.08)
        & (b["x0"] - a["x1"]).between(0.0, 0.12)
    )


def vertical_distance(a: Column, b: Column) -> Column:
    """JN12: gap between two rectangles, 0 where they overlap vertically."""
    return F.greatest(F.lit(0.0), b["y0"] - a["y1"], a["y0"] - b["y1"])
