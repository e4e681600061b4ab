"""Which rows of a floor are near each other: floors small enough to compare whole, and cells that follow the crowd.

A large floor is cut into a grid over what is on it, about ``crowd`` rows a cell if they were spread evenly. A cell that
is still crowded is cut again over what is in it, and so on, so neither an outlier nor a dense corner makes large cells.
Where a cut gains nothing, as with many lines through the whole cell, the cell stays and its rows are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium.storage import stored

FLOOR = ["plan_id", "floor_id"]
#: Where a row's box is.
BOX = ("west", "north", "east", "south")
#: Cells to a side of a cut at most, and rows of an uncut cell that are compared with others at once.
MOST_CELLS, BLOCK = 1024, 512


def large_floors(df: DataFrame, most: int, keys: list[str] | None = None) -> DataFrame | None:
    """``(plan_id, floor_id, n)`` of floors with more than ``most`` rows, stored; None without any."""
    found = stored(df.groupBy(*(keys or FLOOR)).agg(F.count("*").alias("n")).where(F.col("n") > most))
    return None if found.isEmpty() else found


def cells_of_box(at: Callable[[Column, str], Column]) -> Column:
    """``(cx, cy)`` of all grid cells that a box touches; ``at`` gives a place's cell number along an axis."""
    xs, ys = F.sequence(at(F.col("west"), "x"), at(F.col("east"), "x")), F.sequence(at(F.col("north"), "y"), at(F.col("south"), "y"))
    return F.flatten(F.transform(xs, lambda cx: F.transform(ys, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def in_cells(rows: DataFrame, crowd: int, least: float = 0.0, cells: Callable[[Callable], Column] = cells_of_box, keys: list[str] | None = None) -> DataFrame:
    """``rows`` with boxes ``west, north, east, south`` repeated for each cell they touch, with the number ``cell`` of the cell and of
    the ``parts`` in which its rows are compared.

    Two boxes that touch are in one cell at least, and may be in several. ``least`` is the least side of a cell. Each pass
    is a grouped count and a join, kept in the shared folder; there are as many as cells lie within each other.
    """
    keys = keys or FLOOR
    node, side = [*keys, "cell"], F.col("side")
    inside = {"left": F.greatest("west", "left"), "top": F.greatest("north", "top"), "right": F.least("east", "right"), "bottom": F.least("south", "bottom")}
    names = [*rows.columns, "cell"]
    bounds = {"left": F.min("left"), "top": F.min("top"), "right": F.max("right"), "bottom": F.max("bottom")}
    open_ = rows.withColumns({"cell": F.lit(0).cast("long"), "left": F.col("west"), "top": F.col("north"), "right": F.col("east"), "bottom": F.col("south")})
    sizes = open_.groupBy(*node).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in bounds.items()])
    open_, sizes, done = rows.withColumn("cell", F.lit(0).cast("long")), stored(sizes), []

    def at(v: Column, axis: str) -> Column:
        start = "left" if axis == "x" else "top"
        return F.least(F.greatest(F.floor((v - F.col(start)) / side), F.lit(0)), F.col("k") - 1).cast("int")

    while True:
        wide = F.greatest(F.col("right") - F.col("left"), F.col("bottom") - F.col("top"))
        cut = sizes.withColumn("k", F.least(F.ceil(F.sqrt(F.col("n") / crowd)), F.lit(MOST_CELLS)).cast("int"))
        cut = cut.withColumn("side", F.greatest(wide / F.col("k") * 1.001, F.lit(least), F.lit(1e-9)))
        crowded = stored(cut.where((F.col("n") > crowd) & (wide > side)))
        if crowded.isEmpty():
            done.append(open_.join(sizes.select(*node, "n"), node).select(*names, "n"))
            break
        inner = open_.join(crowded.withColumnRenamed("n", "of"), node)
        inner = inner.withColumn("at", F.explode(cells(at))).withColumn("within", F.col("cell")).withColumn("cell", F.xxhash64("within", "at"))
        x, y = F.col("left") + F.col("at.cx") * side, F.col("top") + F.col("at.cy") * side
        # Rows outside the cut area were put into its outermost cells, which reach as far as they do.
        first, last = lambda c: F.col(f"at.{c}") == 0, lambda c: F.col(f"at.{c}") == F.col("k") - 1
        inner = inner.withColumns({
            "right": F.when(last("cx"), F.col("right")).otherwise(x + side), "bottom": F.when(last("cy"), F.col("bottom")).otherwise(y + side),
            "left": F.when(first("cx"), F.col("left")).otherwise(x), "top": F.when(first("cy"), F.col("top")).otherwise(y),
        })
        inner = stored(inner.withColumns(inside).select(*names, "within", "of", *inside))
        found = inner.groupBy(*keys, "within", "cell").agg(F.count("*").alias("n"), F.first("of").alias("of"), *[v.alias(k) for k, v in bounds.items()])
        found = stored(found)
        n = F.col("n").cast("double")
        # A cut gains if it leaves half of the pairs, or if it copies few rows: then a crowd is in a smaller cell now.
        gains = found.groupBy(*keys, F.col("within").alias("cell")).agg(F.sum(n * n).alias("pairs"), F.sum(n).alias("copies"), F.first("of").alias("of"))
        of = F.col("of").cast("double")
        gains = stored(gains.where((F.col("pairs") <= of * of / 2) | (F.col("copies") <= 1.5 * of)).select(*node))
        sizes_of = lambda f: f.select(*node, "n")
        done.append(open_.join(sizes_of(sizes.join(gains, node, "left_anti")), node).select(*names, "n"))
        inner = inner.join(gains.withColumnRenamed("cell", "within"), [*keys, "within"], "left_semi")
        open_, sizes = inner.select(*names), found.join(gains.withColumnRenamed("cell", "within"), [*keys, "within"], "left_semi").select(*node, "n", *bounds)
        small = sizes_of(sizes.where(F.col("n") <= crowd))
        done.append(open_.join(small, node).select(*names, "n"))
        sizes = stored(sizes.where(F.col("n") > crowd))
        if sizes.isEmpty():
            break
        open_ = stored(open_.join(sizes_of(sizes), node, "left_semi"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")


def met(cells: DataFrame, names: list[str], before: Column, keys: list[str] | None = None) -> DataFrame:
    """Pairs ``a_*``, ``b_*`` of the columns ``names`` whose rows share a cell and for which ``before`` holds; a pair that
    shares several cells comes several times. Rows of a cell of several parts meet part by part."""
    keys = keys or FLOOR
    own, every = F.pmod(F.xxhash64(*names), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
    placed = cells.withColumn("own", own)
    side = lambda p, i, j: placed.withColumn("other", F.explode(every)).select(*keys, "cell", F.col(i).alias("i"), F.col(j).alias("j"), *[F.col(c).alias(f"{p}{c}") for c in names])
    return side("a_", "own", "other").join(side("b_", "other", "own"), [*keys, "cell", "i", "j"]).where(before).drop("cell", "i", "j")
