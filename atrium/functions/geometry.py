"""Geometry of segments, boxes and polygons as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

C = F.col


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def _seg(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return C(f"{prefix}x1"), C(f"{prefix}y1"), C(f"{prefix}x2"), C(f"{prefix}y2")


def length(prefix: str = "") -> Column:
    x1, y1, x2, y2 = _seg(prefix)
    return distance(x2, y2, x1, y1)


def angle(prefix: str = "") -> Column:
    x1, y1, x2, y2 = _seg(prefix)
    return F.atan2(y2 - y1, x2 - x1)


def angle_deg(prefix: str = "") -> Column:
    """Degrees from 0 to 180, both ends included."""
    deg = F.degrees(angle(prefix))
    return F.when(deg < 0, deg + 180).otherwise(deg)


def is_horizontal(tolerance: float = 5.0, prefix: str = "") -> Column:
    a = angle_deg(prefix)
    return (a < tolerance) | (a > 180 - tolerance)


def is_vertical(tolerance: float = 5.0, prefix: str = "") -> Column:
    return F.abs(angle_deg(prefix) - 90) < tolerance


def angle_difference(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(d > 90, 180 - d).otherwise(d)


def midpoint(prefix: str = "") -> tuple[Column, Column]:
    x1, y1, x2, y2 = _seg(prefix)
    return (x1 + x2) / 2, (y1 + y2) / 2


def box_center(prefix: str = "") -> tuple[Column, Column]:
    return C(f"{prefix}x") + C(f"{prefix}w") / 2.0, C(f"{prefix}y") + C(f"{prefix}h") / 2.0


def box_area(prefix: str = "") -> Column:
    return C(f"{prefix}w") * C(f"{prefix}h")


def aspect_ratio(prefix: str = "") -> Column:
    w, h = C(f"{prefix}w"), C(f"{prefix}h")
    return F.when(h > 0, w / h.cast("double")).otherwise(F.lit(1e9))


def perpendicular_distance(px: Column, py: Column, prefix: str = "") -> Column:
    """From a point to the segment's line; to its first end if it has no length."""
    x1, y1, x2, y2 = _seg(prefix)
    n = length(prefix)
    across = F.abs((y2 - y1) * px - (x2 - x1) * py + x2 * y1 - y2 * x1)
    return F.when(n < 1e-12, distance(px, py, x1, y1)).otherwise(across / n)


def min_endpoint_distance(a: str = "a_", b: str = "b_") -> Column:
    ax1, ay1, ax2, ay2 = _seg(a)
    bx1, by1, bx2, by2 = _seg(b)
    return F.least(
        distance(ax1, ay1, bx1, by1), distance(ax1, ay1, bx2, by2),
        distance(ax2, ay2, bx1, by1), distance(ax2, ay2, bx2, by2),
    )


def merged_segment(a: str = "a_", b: str = "b_") -> Column:
    """The two ends farthest apart of two segments, as a struct; the first pair wins a tie."""
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = _seg(a), _seg(b)
    ends = [(ax1, ay1), (ax2, ay2), (bx1, by1), (bx2, by2)]
    pairs = [(p, q) for i, p in enumerate(ends) for q in ends[i + 1 :]]
    found = [
        F.struct(
            distance(p[0], p[1], q[0], q[1]).alias("d"), F.lit(-i).alias("order"),
            p[0].alias("x1"), p[1].alias("y1"), q[0].alias("x2"), q[1].alias("y2"),
        )
        for i, (p, q) in enumerate(pairs)
    ]
    best = F.array_max(F.array(*found))
    return F.struct(*[best[c].alias(c) for c in ("x1", "y1", "x2", "y2")])


def intersection(a: str = "a_", b: str = "b_") -> Column:
    """Where two segments meet, ends included, as a struct; null where they don't or are parallel."""
    (x1, y1, x2, y2), (x3, y3, x4, y4) = _seg(a), _seg(b)
    denom = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
    safe = F.when(F.abs(denom) >= 1e-10, denom)
    t = ((x1 - x3) * (y3 - y4) - (y1 - y3) * (x3 - x4)) / safe
    u = -((x1 - x2) * (y1 - y3) - (y1 - y2) * (x1 - x3)) / safe
    point = F.struct((x1 + t * (x2 - x1)).alias("x"), (y1 + t * (y2 - y1)).alias("y"))
    return F.when(t.between(0, 1) & u.between(0, 1), point)


def overlap_fraction(a: str = "a_", b: str = "b_") -> Column:
    """Common area of two boxes over the smaller area; 0 if they are apart or one has no area."""
    ax, ay, aw, ah = (C(f"{a}{c}") for c in "xywh")
    bx, by, bw, bh = (C(f"{b}{c}") for c in "xywh")
    w = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    h = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    least = F.least(aw * ah, bw * bh)
    return F.when((w > 0) & (h > 0) & (least > 0), w * h / least.cast("double")).otherwise(F.lit(0.0))


def _edges(polygon: Column, each: Callable[[Column, Column], Column]) -> Column:
    """``each(p, q)`` over the polygon's vertices and their followers, summed."""
    n = F.size(polygon)
    rows = F.transform(polygon, lambda p, i: each(p, F.element_at(polygon, (i + 1) % n + 1)))
    return F.aggregate(rows, F.lit(0.0), lambda acc, x: acc + x)


def signed_area(polygon: Column) -> Column:
    """Shoelace area of an array of (x, y) structs; 0 for fewer than 3 vertices."""
    area = _edges(polygon, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2
    return F.when(F.size(polygon) >= 3, area).otherwise(F.lit(0.0))


def area(polygon: Column) -> Column:
    return F.abs(signed_area(polygon))


def centroid(polygon: Column) -> Column:
    """Mean of the vertices; (0, 0) without any."""
    n = F.size(polygon)
    mean = lambda c: F.when(n > 0, F.aggregate(polygon, F.lit(0.0), lambda acc, p: acc + p[c]) / n).otherwise(F.lit(0.0))
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def orthogonal_path(sx: Column, sy: Column, ex: Column, ey: Column) -> Column:
    """Array of points from start to end along the axes, the longer way first; no elbow where it is an end."""
    flat = F.abs(ex - sx) > F.abs(ey - sy)
    mx, my = F.when(flat, ex).otherwise(sx), F.when(flat, sy).otherwise(ey)
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    start, elbow, end = point(sx, sy), point(mx, my), point(ex, ey)
    straight = ((mx == sx) & (my == sy)) | ((mx == ex) & (my == ey))
    return F.when(straight, F.array(start, end)).otherwise(F.array(start, elbow, end))
