"""Boxes: struct<x,y,width,height:double>, 0..1 from the top left corner."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BOX = "struct<x:double,y:double,width:double,height:double>"
# How close two boxes must lie to count as one row, and what counts as coarse.
ROW_Y, ROW_HEIGHT, ROW_GAP = 0.02, 0.03, 0.03
MAX_PRECISE_BOXES = 12
ENVELOPE_LIMIT, TOTAL_LIMIT = 0.35, 0.45


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def box(x, y, width, height) -> Column:
    parts = [p if isinstance(p, Column) else F.lit(float(p)) for p in (x, y, width, height)]
    return F.struct(*[p.cast("double").alias(n) for p, n in zip(parts, ("x", "y", "width", "height"))])


def clamp01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def area(b: Column | str) -> Column:
    b = _c(b)
    return F.greatest(F.lit(0.0), b["width"]) * F.greatest(F.lit(0.0), b["height"])


def sanitize(b: Column | str) -> Column:
    """Clamp into the page; NULL when a value is missing or not finite, or nothing is left."""
    b = _c(b)
    usable = F.lit(True)
    for name in ("x", "y", "width", "height"):
        usable = usable & b[name].isNotNull() & ~F.isnan(b[name]) & (F.abs(b[name]) < float("inf"))
    x, y = clamp01(b["x"]), clamp01(b["y"])
    width, height = clamp01(F.least(b["width"], 1 - x)), clamp01(F.least(b["height"], 1 - y))
    return F.when(usable & (width > 0) & (height > 0), box(x, y, width, height))


def envelope(boxes: Column | str) -> Column:
    """Smallest box around an array of boxes; NULL for an empty array."""
    boxes = _c(boxes)
    left = F.array_min(F.transform(boxes, lambda b: b["x"]))
    top = F.array_min(F.transform(boxes, lambda b: b["y"]))
    return F.when(F.size(boxes) > 0, box(
        left, top,
        F.array_max(F.transform(boxes, right)) - left,
        F.array_max(F.transform(boxes, bottom)) - top))


def expand(b: Column | str, margin: float) -> Column:
    b = _c(b)
    left, top = clamp01(b["x"] - margin), clamp01(b["y"] - margin)
    far, low = clamp01(right(b) + margin), clamp01(bottom(b) + margin)
    return box(left, top, F.greatest(F.lit(0.0), far - left), F.greatest(F.lit(0.0), low - top))


def intersection_area(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    wide = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    high = F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])
    return F.when((wide > 0) & (high > 0), wide * high).otherwise(F.lit(0.0))


def overlap_ratio(a: Column | str, b: Column | str) -> Column:
    """Shared area over the smaller box."""
    a, b = _c(a), _c(b)
    size_a, size_b = a["width"] * a["height"], b["width"] * b["height"]
    return (F.when((size_a > 0) & (size_b > 0),
                   F.coalesce(F.try_divide(intersection_area(a, b), F.least(size_a, size_b)), F.lit(0.0)))
            .otherwise(F.lit(0.0)))


def total_area(boxes: Column | str) -> Column:
    return F.aggregate(F.transform(_c(boxes), area), F.lit(0.0), lambda s, v: s + v)


def _spread(boxes: Column) -> Column:
    return ((F.size(boxes) > MAX_PRECISE_BOXES)
            | (area(envelope(boxes)) > ENVELOPE_LIMIT) | (total_area(boxes) > TOTAL_LIMIT))


def is_coarse(boxes: Column | str) -> Column:
    """Viewer rule: one box has its own limits."""
    boxes = _c(boxes)
    first = F.get(boxes, F.lit(0))
    single = (area(first) > 0.2) | (first["height"] > 0.25) | (first["width"] > 0.8)
    return (F.when(F.size(boxes) == 0, F.lit(False))
            .when(F.size(boxes) == 1, single)
            .otherwise(_spread(boxes)))


def is_coarse_audit(chunk_box: Column | str, boxes: Column | str) -> Column:
    """Audit rule: the chunk box is judged first, then the box set."""
    b, boxes = _c(chunk_box), _c(boxes)
    large = (area(b) > 0.35) | (b["width"] > 0.8) | (b["height"] > 0.35)
    return F.coalesce(large, F.lit(False)) | F.coalesce((F.size(boxes) > 0) & _spread(boxes), F.lit(False))


def by_row(boxes: Column | str) -> Column:
    """Boxes in reading order."""
    keyed = F.transform(_c(boxes), lambda b: F.struct(
        b["y"].alias("y"), b["x"].alias("x"), b["width"].alias("width"), b["height"].alias("height")))
    return F.transform(F.array_sort(keyed), lambda b: box(b["x"], b["y"], b["width"], b["height"]))


def merge_row_boxes(boxes: Column | str) -> Column:
    """Left-to-right fold that joins touching boxes of one row; meant for a few dozen boxes."""
    def step(done: Column, b: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        near = ((F.abs(last["y"] - b["y"]) < ROW_Y) & (F.abs(last["height"] - b["height"]) < ROW_HEIGHT)
                & (b["x"] <= right(last) + ROW_GAP))
        left, top = F.least(last["x"], b["x"]), F.least(last["y"], b["y"])
        joined = box(left, top, F.greatest(right(last), right(b)) - left,
                     F.greatest(bottom(last), bottom(b)) - top)
        return F.when(F.coalesce(near, F.lit(False)),
                      F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))
                      ).otherwise(F.concat(done, F.array(b)))
    return F.aggregate(by_row(boxes), F.array().cast(f"array<{BOX}>"), step)
