"""Wall segments: filters, intersections, splitting, merging and parallel pairs.

Tables are keyed by ``plan_id, floor_id, seg_id``; ``seg_id`` is the order in which segments were drawn.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atrium.functions import geometry as g
from atrium.operators.components import connected_components
from atrium.operators.grids import BOX, FLOOR, in_cells, large_floors, met
from atrium.operators.merging import merge_batches
from atrium.operators.numbering import numbered
from atrium.storage import ship, spread, stored

XY = ["x1", "y1", "x2", "y2"]


@dataclass(frozen=True)
class MergeConfig:
    """``perpendicular`` None and one pass give the older rule. ``most_together``: segments of a floor merged in one go."""

    angle_deg: float = 5.0
    distance: float = 10.0
    perpendicular: float | None = 5.0
    until_stable: bool = True
    most_together: int = 2000


def filter_by_orientation(segments: DataFrame, horizontal: bool = True, vertical: bool = True, tolerance: float = 15.0, diagonal_if_none: bool = False) -> DataFrame:
    """Keep horizontal and vertical ones as asked; with neither, nothing, or the diagonal ones if so chosen."""
    h, v = g.is_horizontal(tolerance), g.is_vertical(tolerance)
    keep = (h & F.lit(horizontal)) | (v & F.lit(vertical))
    if diagonal_if_none and not horizontal and not vertical:
        keep = ~h & ~v
    return segments.where(keep)


def filter_by_length(segments: DataFrame, least: float = 0.0, most: float = math.inf) -> DataFrame:
    return segments.where(g.length().between(least, most))


def segment_stats(segments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Least, largest and mean length, and counts of horizontal, vertical and other segments."""
    h = g.is_horizontal()
    v = ~h & g.is_vertical()
    return segments.groupBy(*(keys or FLOOR)).agg(
        F.count("*").alias("n"), F.min(g.length()).alias("min_length"), F.max(g.length()).alias("max_length"),
        F.avg(g.length()).alias("mean_length"), F.count_if(h).alias("n_horizontal"), F.count_if(v).alias("n_vertical"),
        F.count_if(~h & ~v).alias("n_other"),
    )


def _box(p: str = "") -> tuple[Column, Column, Column, Column]:
    c = lambda k: F.col(f"{p}{k}")
    return F.least(c("x1"), c("x2")), F.least(c("y1"), c("y2")), F.greatest(c("x1"), c("x2")), F.greatest(c("y1"), c("y2"))


def _along(at: Callable[[Column, str], Column], reach: float) -> Column:
    """``(cx, cy)`` of the grid cells within ``reach`` of a segment, column by column: as many as it is long, not its box."""
    x0, y0, x1, _ = _box()
    dx, side = F.col("x2") - F.col("x1"), F.col("side")
    steep = F.when(F.abs(dx) > 1e-12, (F.col("y2") - F.col("y1")) / dx)
    y1 = F.greatest("y1", "y2")

    def column(cx: Column) -> Column:
        y = lambda x: F.col("y1") + steep * (F.least(F.greatest(x, x0), x1) - F.col("x1"))
        start = F.when(cx == 0, x0).otherwise(F.col("left") + cx * side - reach)
        end = F.when(cx == F.col("k") - 1, x1).otherwise(F.col("left") + (cx + 1) * side + reach)
        u, v = y(start), y(end)
        low, high = F.coalesce(F.least(u, v), y0), F.coalesce(F.greatest(u, v), y1)
        return F.transform(F.sequence(at(low - reach - 1e-6, "y"), at(high + reach + 1e-6, "y")), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(F.sequence(at(x0 - reach, "x"), at(x1 + reach, "x")), column))


def near_pairs(segments: DataFrame, reach: float = 0.0, crowd: int = 64, where: Column | None = None) -> DataFrame:
    """Pairs ``a_*``, ``b_*`` (a before b) on one floor that may be within ``2 * reach``, by boxes widened by ``reach``, and
    for which ``where`` holds; each pair once.

    The segments of a floor of up to ``crowd`` meet each other. Those of a larger floor meet in the grid cells that they
    pass, whose size follows the crowd, so such a floor is not compared with itself as a whole.
    """
    own, names = segments.select(*FLOOR, "seg_id", *XY), ["seg_id", *XY]
    ax0, ay0, ax1, ay1 = _box("a_")
    bx0, by0, bx1, by1 = _box("b_")
    near = (ax0 - 2 * reach <= bx1) & (bx0 - 2 * reach <= ax1) & (ay0 - 2 * reach <= by1) & (by0 - 2 * reach <= ay1)
    near = (F.col("a_seg_id") < F.col("b_seg_id")) & near
    if where is not None:
        near &= where
    large = large_floors(own, crowd)
    small = own if large is None else own.join(large, FLOOR, "left_anti")
    side = lambda p: small.select(*FLOOR, *[F.col(c).alias(f"{p}{c}") for c in names])
    pairs = side("a_").join(spread(side("b_")), FLOOR).where(near)
    if large is None:
        return pairs
    wide = dict(zip(BOX, _box(), strict=True))
    wide = {c: v + (reach + 1e-6) * (-1 if c in ("west", "north") else 1) for c, v in wide.items()}
    rows = stored(own.join(large, FLOOR, "left_semi").withColumns(wide))
    cells = in_cells(rows, crowd, 2 * reach, lambda at: _along(at, reach))
    return pairs.unionByName(met(cells, names, near).dropDuplicates([*FLOOR, "a_seg_id", "b_seg_id"]))


def find_intersections(segments: DataFrame, crowd: int = 64) -> DataFrame:
    """``(plan_id, floor_id, seg_a, seg_b, x, y)`` where two segments meet, ends included."""
    pairs = near_pairs(segments, 0.0, crowd, g.intersection().isNotNull()).withColumn("p", g.intersection())
    return pairs.select(
        *FLOOR, F.col("a_seg_id").alias("seg_a"), F.col("b_seg_id").alias("seg_b"), "p.x", "p.y"
    )


def split_at_intersections(segments: DataFrame, crossings: DataFrame | None = None, tolerance: float = 1.0) -> DataFrame:
    """Pieces between the points on each segment, ``(plan_id, floor_id, seg_id, piece, x1, y1, x2, y2)``.

    Points go by distance from the start; one within the tolerance of the last kept is dropped, be it the far end;
    pieces no longer than the tolerance are dropped. A segment that meets no other stays as it is, however short.
    """
    crossings = find_intersections(segments) if crossings is None else crossings
    ends = F.array(F.struct(F.col("seg_a").alias("seg_id")), F.struct(F.col("seg_b").alias("seg_id")))
    on = crossings.select(*FLOOR, "seg_a", "seg_b", "x", "y", F.inline(ends))
    on = on.groupBy(*FLOOR, "seg_id").agg(F.collect_list(F.struct("seg_a", "seg_b", "x", "y")).alias("met"))
    rows = segments.select(*FLOOR, "seg_id", *XY).join(spread(on), [*FLOOR, "seg_id"], "left")

    def point(order: int, a: Column, b: Column, x: Column, y: Column) -> Column:
        d = (x - F.col("x1")) * (x - F.col("x1")) + (y - F.col("y1")) * (y - F.col("y1"))
        return F.struct(d.alias("d"), F.lit(order).alias("o"), a.cast("long").alias("a"), b.cast("long").alias("b"), x.alias("x"), y.alias("y"))

    zero = F.lit(0)
    start, end = point(0, zero, zero, F.col("x1"), F.col("y1")), point(2, zero, zero, F.col("x2"), F.col("y2"))
    middle = F.transform("met", lambda m: point(1, m["seg_a"], m["seg_b"], m["x"], m["y"]))
    points = F.sort_array(F.concat(F.array(start), middle, F.array(end)))
    far = lambda p, q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]) > tolerance * tolerance
    kept = F.aggregate(F.slice(points, 2, 1 << 30), F.slice(points, 1, 1), lambda acc, p: F.when(far(p, F.element_at(acc, -1)), F.array_append(acc, p)).otherwise(acc))
    rows = rows.withColumn("kept", kept)
    piece = F.transform(
        F.slice("kept", F.lit(1), F.size("kept") - 1),
        lambda p, i: F.struct(
            i.alias("piece"), p["x"].alias("x1"), p["y"].alias("y1"),
            F.get("kept", i + 1)["x"].alias("x2"), F.get("kept", i + 1)["y"].alias("y2"),
        ),
    )
    long = lambda p: g.distance(p["x2"], p["y2"], p["x1"], p["y1"]) > tolerance
    own = F.array(F.struct(F.lit(0).alias("piece"), *[F.col(c) for c in XY]))
    pieces = F.when(F.col("met").isNull(), own).otherwise(F.filter(piece, long))
    return rows.select(*FLOOR, "seg_id", F.inline(pieces))


def merge_collinear(segments: DataFrame, cfg: MergeConfig = MergeConfig()) -> DataFrame:
    """Greedy merging of nearly collinear segments, ``(plan_id, floor_id, seg_id, x1, y1, x2, y2)``.

    Each segment takes up later ones that fit it as it grows, so order decides; the result is numbered in the order of the
    segments that grew. Repeated until nothing merges, or done once. The ends of what has grown are ends of segments, so
    nothing merges across components of segments with ends within ``distance``: a floor of more than ``most_together``
    segments is merged component by component.
    """
    ship(segments.sparkSession)
    own = segments.select(*FLOOR, "seg_id", *XY)
    kinds = dict(own.dtypes)
    schema = f"plan_id {kinds['plan_id']}, floor_id {kinds['floor_id']}, seg_id {kinds['seg_id']}, x1 double, y1 double, x2 double, y2 double"
    rows = F.sort_array(F.collect_list(F.struct("seg_id", *[F.col(c).cast("double").alias(c) for c in XY]))).alias("rows")
    merged = lambda df, *unit: df.groupBy(*FLOOR, *unit).agg(rows).select(*FLOOR, "rows").mapInArrow(lambda batches: merge_batches(batches, cfg), schema)
    number = F.row_number().over(Window.partitionBy(*FLOOR).orderBy("seg_id", *XY)).cast("long") - 1
    large = large_floors(own, cfg.most_together)
    small = own if large is None else own.join(large, FLOOR, "left_anti")
    found = merged(small).withColumn("seg_id", number)
    if large is None:
        return found
    own = stored(own.join(large, FLOOR, "left_semi").withColumn("node", F.monotonically_increasing_id()))
    close = near_pairs(own.drop("seg_id").withColumnRenamed("node", "seg_id"), cfg.distance / 2, where=g.min_endpoint_distance() <= cfg.distance)
    roots = connected_components(close, "a_seg_id", "b_seg_id")
    own = stored(own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    return found.unionByName(numbered(merged(own, "root").withColumnRenamed("seg_id", "first"), FLOOR, ["first", *XY], "seg_id").select(*found.columns))


def merge_components(segments: DataFrame, cfg: MergeConfig = MergeConfig()) -> DataFrame:
    """Merging without an order, ``(plan_id, floor_id, seg_id, x1, y1, x2, y2)``: segments that fit each other, directly or
    through others, become one, from end to end along the longest of them; ``seg_id`` is the least of theirs.

    Floors of any size are spread over tasks. Chains of segments that bend little by little become one here, where
    ``merge_collinear`` compares with what has grown and stops.
    """
    own = stored(segments.select(*FLOOR, "seg_id", *XY).withColumn("node", F.monotonically_increasing_id()))
    fit = (g.angle_difference(g.angle_deg("a_"), g.angle_deg("b_")) <= cfg.angle_deg) & (g.min_endpoint_distance() <= cfg.distance)
    if cfg.perpendicular is not None:
        fit &= g.perpendicular_distance(*g.midpoint("b_"), "a_") <= cfg.perpendicular
    pairs = near_pairs(own.drop("seg_id").withColumnRenamed("node", "seg_id"), cfg.distance / 2, where=fit)
    roots = connected_components(pairs, "a_seg_id", "b_seg_id")
    rows = stored(own.join(spread(roots), "node", "left").withColumn("root", F.coalesce("root", "node")))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    axis = rows.groupBy("root").agg(F.max_by(F.struct(dx.alias("ux"), dy.alias("uy")), F.struct(F.hypot(dx, dy), -F.col("seg_id"))).alias("u")).select("root", "u.*")
    ends = rows.join(spread(axis), "root").select("root", *FLOOR, "seg_id", "ux", "uy", F.inline(F.array(*[F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2)])))
    place, point = F.struct(F.col("x") * F.col("ux") + F.col("y") * F.col("uy"), "x", "y"), F.struct("x", "y")
    out = ends.groupBy("root").agg(*[F.first(c).alias(c) for c in FLOOR], F.min("seg_id").alias("seg_id"), F.min_by(point, place).alias("p"), F.max_by(point, place).alias("q"))
    return out.select(*FLOOR, "seg_id", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))


def parallel_walls(segments: DataFrame, least: float = 3.0, most: float = 40.0, angle: float = 5.0) -> DataFrame:
    """Pairs of nearly parallel segments that could be the two faces of one wall, with their distance."""
    pairs = near_pairs(segments, reach=most)
    turn = g.angle_difference(g.angle_deg("a_"), g.angle_deg("b_"))
    mx, my = g.midpoint("b_")
    pairs = pairs.withColumn("distance", g.perpendicular_distance(mx, my, "a_")).where(turn <= angle)
    pairs = pairs.where(F.col("distance").between(least, most))
    return pairs.select(*FLOOR, F.col("a_seg_id").alias("seg_a"), F.col("b_seg_id").alias("seg_b"), "distance")
