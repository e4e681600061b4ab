"""Planar topology of floor plans: vertices, half-edges, faces, rooms, adjacency and walls.

The half-edge table of a floor stays together by ``plan_id, floor_id``: vertices, links and twins are windows over
one partitioning, and faces are found in arrays of many floors at once, without another exchange.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atrium.functions.geometry import distance
from atrium.operators.choices import beaten
from atrium.operators.components import connected_components
from atrium.operators.grids import BOX, in_cells, large_floors, met
from atrium.operators.numbering import numbered
from atrium.operators.segments import FLOOR, XY, find_intersections, split_at_intersections
from atrium.storage import ship, spread, stored


@dataclass(frozen=True)
class TopologyConfig:
    """snapping: grid (the first point of a grid cell) or nearest (the first vertex within the tolerance, in order).

    turn: ascending links all vertices by rising angle, descending by falling angle and only from two edges on.
    most_pieces: floors of more pieces are not gathered in a row.
    """

    snapping: str = "grid"
    snap: float = 2.0
    split: float = 1.0
    turn: str = "ascending"
    least_area: float = 1000.0
    most_area: float = math.inf
    most_pieces: int = 500_000


def _numbered(df: DataFrame, order: list[str], name: str, large: DataFrame | None) -> DataFrame:
    """``df`` with the number of each row on its floor: one window a floor, and ranges of rows for the floors in ``large``."""
    small = df if large is None else df.join(large, FLOOR, "left_anti")
    out = small.withColumn(name, (F.row_number().over(Window.partitionBy(*FLOOR).orderBy(*order)) - 1).cast("long"))
    if large is None:
        return out
    return out.unionByName(numbered(df.join(large, FLOOR, "left_semi").drop(name), FLOOR, order, name).select(*out.columns))


def _ends(pieces: DataFrame, large: DataFrame | None) -> DataFrame:
    """Two rows a piece, in the order in which vertices are made: n, end, x, y."""
    rows = _numbered(pieces.select(*FLOOR, "seg_id", "piece", *XY), ["seg_id", "piece"], "n", large)
    end = lambda k: F.struct(F.lit(k).alias("end"), F.col(f"x{k + 1}").alias("x"), F.col(f"y{k + 1}").alias("y"))
    return rows.select(*FLOOR, "n", F.inline(F.array(end(0), end(1)))).withColumn("made", F.col("n") * 2 + F.col("end"))


def _snapped(ends: DataFrame, cfg: TopologyConfig, large: DataFrame | None) -> DataFrame:
    """``vertex`` (its first end's number) and its point for each end."""
    if cfg.snapping == "grid":
        key = [F.bround(F.col(c) / cfg.snap, 0).alias(f"k{c}") for c in "xy"]
        cell = Window.partitionBy(*FLOOR, "kx", "ky").orderBy("made")
        rows = ends.select("*", *key)
        return rows.select(*FLOOR, "n", "end", F.first("made").over(cell).alias("vertex"), F.first("x").over(cell).alias("vx"), F.first("y").over(cell).alias("vy"))
    if cfg.snapping != "nearest":
        raise ValueError(f"unknown snapping {cfg.snapping}")
    if large is None:
        return _first_near(ends, cfg.snap)
    return _first_near(ends.join(large, FLOOR, "left_anti"), cfg.snap).unionByName(_first_near_of_many(ends.join(large, FLOOR, "left_semi"), cfg.snap))


def _first_near(ends: DataFrame, snap: float) -> DataFrame:
    """An end belongs to the first vertex within ``snap``, or makes one: end by end, a floor in one row."""
    ship(ends.sparkSession)
    reach = snap * snap

    def run(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            parts = []
            for plan, floor, rows in zip(frame["plan_id"], frame["floor_id"], frame["rows"], strict=True):
                vx, vy, ids = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows), dtype=np.int64)
                known = 0
                for r in rows:
                    near = np.flatnonzero((vx[:known] - r["x"]) ** 2 + (vy[:known] - r["y"]) ** 2 <= reach)
                    at = near[0] if len(near) else known
                    if at == known:
                        vx[at], vy[at], ids[at], known = r["x"], r["y"], r["made"], known + 1
                    parts.append((plan, floor, r["n"], r["end"], int(ids[at]), float(vx[at]), float(vy[at])))
            yield pd.DataFrame(parts, columns=[*FLOOR, "n", "end", "vertex", "vx", "vy"])

    kinds = dict(ends.dtypes)
    schema = f"plan_id {kinds['plan_id']}, floor_id {kinds['floor_id']}, n bigint, end int, vertex bigint, vx double, vy double"
    floors = ends.groupBy(*FLOOR).agg(F.sort_array(F.collect_list(F.struct("made", "n", "end", "x", "y"))).alias("rows"))
    return floors.mapInPandas(run, schema)


def _first_near_of_many(ends: DataFrame, snap: float) -> DataFrame:
    """What ``_first_near`` gives, for floors of any size: an end makes a vertex unless an earlier one within ``snap`` does,
    which is a greedy choice among the pairs that are that near."""
    ends = stored(ends)
    half = snap / 2 + 1e-6
    wide = dict(zip(BOX, (F.col("x") - half, F.col("y") - half, F.col("x") + half, F.col("y") + half), strict=True))
    rows = stored(ends.select(*FLOOR, "made", "x", "y").withColumns(wide))
    square = lambda c: (F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}"))
    before = (F.col("a_made") < F.col("b_made")) & (square("x") + square("y") <= snap * snap)
    pairs = met(in_cells(rows, 64, snap), ["made", "x", "y"], before).dropDuplicates([*FLOOR, "a_made", "b_made"])
    pairs = stored(pairs.select(*FLOOR, F.col("a_made").alias("a"), F.col("b_made").alias("b")))
    gone = stored(beaten(pairs.withColumn("order", F.col("b")), ["order"]))
    owner = pairs.join(gone.withColumnRenamed("node", "b"), [*FLOOR, "b"], "left_semi").join(gone.withColumnRenamed("node", "a"), [*FLOOR, "a"], "left_anti")
    owner = owner.groupBy(*FLOOR, F.col("b").alias("made")).agg(F.min("a").alias("vertex"))
    placed = stored(ends.join(owner, [*FLOOR, "made"], "left").withColumn("vertex", F.coalesce("vertex", "made")))
    points = ends.select(*FLOOR, F.col("made").alias("vertex"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    return placed.select(*FLOOR, "n", "end", "vertex").join(points, [*FLOOR, "vertex"]).select(*FLOOR, "n", "end", "vertex", "vx", "vy")


def half_edges(pieces: DataFrame, cfg: TopologyConfig = TopologyConfig(), large: DataFrame | None = None) -> DataFrame:
    """``(plan_id, floor_id, e, twin, next, origin, dest, ox, oy, dx, dy)``; twins are 2n and 2n + 1.

    Pieces whose ends fall together are dropped, repeated pieces are not. The floors in ``large`` are in no task whole.
    """
    return _linked(pieces, cfg, large).withColumn("next", _of_twin("after")).drop("after")


def _linked(pieces: DataFrame, cfg: TopologyConfig, large: DataFrame | None) -> DataFrame:
    """Half-edges with ``after``, the one that follows around the origin: the twin's is the ``next`` one."""
    points = _snapped(_ends(pieces, large), cfg, large)
    first, last = F.col("end") == 0, F.col("end") == 1
    of = lambda c, k: F.max(F.when(k, F.col(c)))
    edges = points.groupBy(*FLOOR, "n").agg(
        of("vertex", first).alias("v1"), of("vx", first).alias("x1"), of("vy", first).alias("y1"),
        of("vertex", last).alias("v2"), of("vx", last).alias("x2"), of("vy", last).alias("y2"),
    ).where("v1 <> v2")
    edges = _numbered(edges.withColumnRenamed("n", "piece_n"), ["piece_n"], "n", large)

    def half(k: int) -> Column:
        a, b = ("1", "2") if k == 0 else ("2", "1")
        c = F.col
        return F.struct(
            (c("n") * 2 + k).alias("e"), (c("n") * 2 + 1 - k).alias("twin"), c(f"v{a}").alias("origin"), c(f"v{b}").alias("dest"),
            c(f"x{a}").alias("ox"), c(f"y{a}").alias("oy"), c(f"x{b}").alias("dx"), c(f"y{b}").alias("dy"),
        )

    halves = edges.select(*FLOOR, "n", F.inline(F.array(half(0), half(1))))
    angle = F.atan2(F.col("dy") - F.col("oy"), F.col("dx") - F.col("ox"))
    falling = cfg.turn == "descending"
    around = Window.partitionBy(*FLOOR, "origin").orderBy(angle.desc() if falling else angle.asc(), "e")
    every = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("e").over(around), F.first("e").over(every))
    if falling:
        after = F.when(F.count("*").over(every) >= 2, after)
    return halves.withColumn("after", after).drop("n")


def _of_twin(name: str) -> Column:
    pair = Window.partitionBy(*FLOOR, F.floor(F.col("e") / 2)).orderBy("e")
    return F.coalesce(F.lead(name).over(pair), F.lag(name).over(pair))


def cycles(edges: DataFrame) -> DataFrame:
    """``(plan_id, floor_id, e, cycle, rank)``: the least half-edge of the cycle through ``next`` and the number of steps
    to it from there; null off cycles.

    Pointer doubling for floors too large for one row: after k rounds each edge knows the least of 2^k edges ahead, so
    the rounds are the logarithm of the longest cycle. Each round is kept in the shared folder.
    """
    state = stored(edges.select(*FLOOR, "e", F.col("next").alias("to"), F.least("e", "next").alias("least"), F.col("next").isNull().alias("open")))
    while True:
        ahead = state.select(*FLOOR, F.col("e").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"), F.col("open").alias("open2"))
        both = state.join(ahead, [*FLOOR, "to"], "left")
        new = both.select(
            *FLOOR, "e", F.coalesce("to2", "to").alias("to"), F.least("least", "least2").alias("least"),
            (F.col("open") | F.coalesce("open2", F.lit(True))).alias("open"),
            (~F.least("least", "least2").eqNullSafe(F.col("least")) | (F.coalesce("open2", F.lit(True)) & ~F.col("open"))).alias("moved"),
        )
        new = stored(new)
        state = new.drop("moved")
        if new.where("moved").limit(1).count() == 0:
            break
    found = edges.join(state.select(*FLOOR, "e", F.when(~F.col("open"), F.col("least")).alias("cycle")), [*FLOOR, "e"])
    return found.select(*FLOOR, "e", "cycle").join(_ranks(found), [*FLOOR, "e"], "left")


def _ranks(edges: DataFrame) -> DataFrame:
    """``(plan_id, floor_id, e, rank)``: list ranking by doubling along the way back, which is cut at the least edge."""
    own = edges.where("cycle IS NOT NULL")
    back = own.select(*FLOOR, F.col("next").alias("e"), F.col("e").alias("before"))
    first = F.col("e") == F.col("cycle")
    rows = own.select(*FLOOR, "e", "cycle").join(back, [*FLOOR, "e"])
    state = stored(rows.select(*FLOOR, "e", F.when(first, F.col("e")).otherwise(F.col("before")).alias("to"), F.when(first, 0).otherwise(1).cast("long").alias("rank")))
    while True:
        ahead = state.select(*FLOOR, F.col("e").alias("to"), F.col("to").alias("to2"), F.col("rank").alias("rank2"))
        new = state.join(ahead, [*FLOOR, "to"]).select(*FLOOR, "e", F.col("to2").alias("to"), (F.col("rank") + F.col("rank2")).alias("rank"), (F.col("to") != F.col("to2")).alias("moved"))
        new = stored(new)
        state = new.drop("moved")
        if new.where("moved").limit(1).count() == 0:
            return state.select(*FLOOR, "e", "rank")


def _walk(offsets, to):
    """``cycle`` (-1: none) and ``rank`` of the edges of many floors at once, numbered from 0 in each; ``to`` -1: no next.

    Doubling over arrays: the rounds are the logarithm of the longest cycle of the batch.
    """
    import numpy as np

    n = len(to)
    base = np.repeat(offsets[:-1], np.diff(offsets))
    sink = n  # edges without a next lead here for good
    at = np.concatenate([np.where(to < 0, sink, to + base), [sink]])
    least, ahead = np.minimum(np.arange(n + 1), at), at.copy()
    while True:
        low, far = np.minimum(least, least[ahead]), ahead[ahead]
        still = np.array_equal(low, least) and ((ahead == sink) == (far == sink)).all()
        least, ahead = low, far
        if still:
            break
    open_ = ahead[:n] == sink
    head = np.where(open_, np.arange(n), least[:n])
    back = np.arange(n + 1)
    back[at[:n][~open_]] = np.flatnonzero(~open_)
    back[head] = head
    steps = np.where(np.arange(n + 1) == np.concatenate([head, [sink]]), 0, 1)
    while (steps[back] > 0).any():
        steps, back = steps + steps[back], back[back]
    return np.where(open_, -1, head - base), steps[:n], base


def _faces_in_batches(batches, faces_only: bool = False):
    """For rows of one floor each, with its edges' arrays: the edges' cycle, rank and what their face is like, or the faces
    alone. Edges have ``next``, or ``after`` (see ``_linked``)."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        rows = batch.column(2)
        offsets = np.concatenate([[0], np.cumsum(rows.value_lengths().to_numpy())]).astype(np.int64)
        value = dict(zip((f.name for f in rows.type.value_type), rows.flatten().flatten(), strict=True))
        to = value["next" if "next" in value else "after"].fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if "next" not in value:
            start = np.repeat(offsets[:-1], np.diff(offsets))
            to = to[(np.arange(len(to)) - start ^ 1) + start]
            del value["after"]
            value["next"] = pa.array(to, mask=to < 0)
        ox, oy, dx, dy = (value[c].to_numpy(zero_copy_only=False) for c in ("ox", "oy", "dx", "dy"))
        cycle, rank, base = _walk(offsets, to)
        n, on = len(to), cycle >= 0
        head = np.where(on, cycle + base, n)
        size = np.bincount(head, minlength=n + 1)
        order = np.lexsort((np.arange(n), head))
        area = np.abs(np.bincount(head[order], weights=(ox * dy - dx * oy)[order], minlength=n + 1)) / 2
        floor = np.repeat(np.arange(len(rows)), np.diff(offsets))
        face = (size[:n] >= 3) & on & (head == np.arange(n))  # one mark a face, at its least edge
        number = np.cumsum(face) - 1
        before = np.concatenate([[0], np.cumsum(np.bincount(floor, weights=face, minlength=len(rows)))]).astype(np.int64)
        number = np.append(number - before[floor] if n else number, -1)
        at = np.flatnonzero(face)
        best = at[np.lexsort((at, -area[at], floor[at]))]
        largest = np.zeros(n + 1, dtype=bool)
        largest[best[np.concatenate([[True], floor[best][1:] != floor[best][:-1]])] if len(best) else best] = True
        if faces_only:
            owner = pa.array(floor[at])
            table = [pa.array(x[at]) for x in (number, size, area, largest)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), *table], names=[*FLOOR, "face", "n_edges", "area", "is_external"])
            continue
        has = on & (size[head] >= 3)
        twin = (np.arange(n) - base ^ 1) + base
        none = ~has
        made = {
            "cycle": pa.array(np.where(has, cycle, 0), mask=none), "rank": pa.array(rank, mask=none), "face": pa.array(np.where(has, number[head], 0), mask=none),
            "n_edges": pa.array(size[head], mask=none), "area": pa.array(area[head], mask=none), "is_external": pa.array(largest[head], mask=none),
            "twin_face": pa.array(np.where(has, number[head], 0)[twin], mask=none[twin]), "twin_external": pa.array(largest[head][twin], mask=none[twin]),
        }
        value = {c: value[c] for c in ("e", "twin", "next", "origin", "dest", "ox", "oy", "dx", "dy")}
        columns = {"plan_id": batch.column(0).take(pa.array(floor)), "floor_id": batch.column(1).take(pa.array(floor)), **value, **made}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


_EDGE = "e bigint, twin bigint, next bigint, origin bigint, dest bigint, ox double, oy double, dx double, dy double"
_FACE = "cycle bigint, rank bigint, face bigint, n_edges bigint, area double, is_external boolean, twin_face bigint, twin_external boolean"


def faces(edges: DataFrame, large: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Half-edges with their ``face`` (null where a cycle is open or has under 3 edges), and the face table.

    ``(plan_id, floor_id, face, n_edges, area, is_external)``: faces are numbered by their least edge; the
    largest area is external, the first of equals. A floor is a row, and cycles, ranks and areas of many floors are
    worked out on arrays; the floors in ``large`` go by joins and give the same.
    """
    found = stored(_with_faces(edges, large))
    return found.drop("cycle", "n_edges", "area"), _face_table(found)


def _gathered(edges: DataFrame, large: DataFrame | None, names: list[str]) -> DataFrame:
    small = edges if large is None else edges.join(large, FLOOR, "left_anti")
    return small.groupBy(*FLOOR).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("edges"))


def _with_next(edges: DataFrame) -> DataFrame:
    return edges if "next" in edges.columns else edges.withColumn("next", _of_twin("after")).drop("after")


def _with_faces(edges: DataFrame, large: DataFrame | None) -> DataFrame:
    ship(edges.sparkSession)
    kinds = dict(edges.dtypes)
    link = "next" if "next" in kinds else "after"
    names = [link if c.startswith("next ") else c.split()[0] for c in _EDGE.split(", ")]
    schema = f"plan_id {kinds['plan_id']}, floor_id {kinds['floor_id']}, {_EDGE}, {_FACE}"
    found = _gathered(edges, large, names).mapInArrow(_faces_in_batches, schema)
    if large is not None:
        found = found.unionByName(_joined_faces(stored(_with_next(edges.join(large, FLOOR, "left_semi")))))
    return found


def _face_table(found: DataFrame) -> DataFrame:
    return found.where("e = cycle").select(*FLOOR, "face", "n_edges", "area", "is_external")


def _faces_alone(edges: DataFrame, large: DataFrame | None) -> DataFrame:
    """The face table of ``faces``, where nothing asks for the edges: these don't come back from the arrays."""
    ship(edges.sparkSession)
    kinds = dict(edges.dtypes)
    schema = f"plan_id {kinds['plan_id']}, floor_id {kinds['floor_id']}, face bigint, n_edges bigint, area double, is_external boolean"
    link = "next" if "next" in kinds else "after"
    found = _gathered(edges, large, ["e", link, "ox", "oy", "dx", "dy"]).mapInArrow(lambda batches: _faces_in_batches(batches, True), schema)
    if large is not None:
        found = found.unionByName(_face_table(_joined_faces(stored(_with_next(edges.join(large, FLOOR, "left_semi"))))))
    return stored(found)


def _joined_faces(edges: DataFrame) -> DataFrame:
    """What ``_faces_in_batches`` gives, by joins and windows."""
    labelled = edges.join(stored(cycles(edges)), [*FLOOR, "e"])
    cross = F.col("ox") * F.col("dy") - F.col("dx") * F.col("oy")
    table = labelled.where("cycle IS NOT NULL").groupBy(*FLOOR, "cycle").agg(F.count("*").alias("n_edges"), (F.abs(F.sum(cross)) / 2).alias("area"))
    table = table.where("n_edges >= 3")
    table = stored(numbered(table, FLOOR, ["cycle"], "face"))
    largest = table.groupBy(*FLOOR).agg(F.max_by("face", F.struct("area", -F.col("face"))).alias("largest"))
    table = stored(table.join(largest, FLOOR).withColumn("is_external", F.col("face") == F.col("largest")).drop("largest"))
    found = labelled.join(table, [*FLOOR, "cycle"], "left")
    found = found.withColumns({c: F.when(F.col("face").isNotNull(), F.col(c)) for c in ("cycle", "rank")})
    return found.withColumns({"twin_face": _of_twin("face"), "twin_external": _of_twin("is_external")})


@dataclass
class Topology:
    """``edges`` and ``faces`` are worked out and stored when they are first asked for; asked for before the edges, the faces are alone."""

    pieces: DataFrame
    linked: DataFrame
    cfg: TopologyConfig
    #: Floors that were not gathered in a row, if there are any.
    large: DataFrame | None = None

    @cached_property
    def _both(self) -> tuple[DataFrame, DataFrame]:
        return faces(self.linked, self.large)

    @property
    def edges(self) -> DataFrame:
        return self._both[0]

    @cached_property
    def _alone(self) -> DataFrame:
        return _faces_alone(self.linked, self.large)

    @property
    def faces(self) -> DataFrame:
        return self._both[1] if "_both" in self.__dict__ else self._alone

    @property
    def rooms(self) -> DataFrame:
        """Faces that are not external and within the area bounds."""
        area = F.col("area").between(self.cfg.least_area, self.cfg.most_area)
        return self.faces.where(~F.col("is_external") & area)


def build_topology(segments: DataFrame, cfg: TopologyConfig = TopologyConfig(), pieces: DataFrame | None = None) -> Topology:
    """Segments to intersections, pieces, half-edges and faces. ``pieces``: those of another topology of the same segments
    and ``split``."""
    pieces = stored(split_at_intersections(segments, find_intersections(segments), cfg.split)) if pieces is None else pieces
    large = large_floors(pieces, cfg.most_pieces)
    large = None if large is None else large.select(*FLOOR)
    return Topology(pieces, _linked(pieces, cfg, large), cfg, large)


def _count_parts(batches):
    """``(plan_id, floor_id, parts)`` for rows with one floor's edges as arrays: the least vertex spreads over its part."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        rows = batch.column(2)
        floor = np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy())
        ends = rows.flatten()
        u, v = (ends.field(c).to_numpy().astype(np.int64) for c in ("origin", "dest"))
        span = int(max(u.max(), v.max())) + 1 if len(u) else 1
        known, at = np.unique(np.concatenate([floor * span + u, floor * span + v]), return_inverse=True)
        u, v = at[: len(u)], at[len(u) :]
        least = np.arange(len(known))
        while True:
            low, new = np.minimum(least[u], least[v]), least.copy()
            np.minimum.at(new, least[u], low)
            np.minimum.at(new, least[v], low)
            new = new[new]
            if np.array_equal(new, least):
                break
            least = new
        heads = np.flatnonzero(least == np.arange(len(known)))
        parts = np.bincount(known[heads] // span, minlength=len(rows))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts.astype(np.int64))], names=[*FLOOR, "parts"])


def parts(topology: Topology) -> DataFrame:
    """``(plan_id, floor_id, parts)``: connected parts of each drawing, a wall that touches nothing being one."""
    ship(topology.edges.sparkSession)
    edges = topology.edges.where("e % 2 = 0").select(*FLOOR, "origin", "dest")
    kinds = dict(edges.dtypes)
    small = edges if topology.large is None else edges.join(topology.large, FLOOR, "left_anti")
    floors = small.groupBy(*FLOOR).agg(F.collect_list(F.struct("origin", "dest")).alias("edges"))
    found = floors.mapInArrow(_count_parts, f"plan_id {kinds['plan_id']}, floor_id {kinds['floor_id']}, parts bigint")
    if topology.large is None:
        return found
    edges = stored(edges.join(topology.large, FLOOR, "left_semi"))
    nodes = edges.select(*FLOOR, "origin").unionByName(edges.select(*FLOOR, F.col("dest").alias("origin"))).distinct()
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))
    for end, name in (("origin", "src"), ("dest", "dst")):
        edges = edges.join(nodes.select(*FLOOR, F.col("origin").alias(end), F.col("node").alias(name)), [*FLOOR, end])
    roots = connected_components(edges).join(nodes, "node")
    return found.unionByName(roots.groupBy(*FLOOR).agg(F.count_distinct("root").alias("parts")))


def euler(topology: Topology) -> DataFrame:
    """Per floor V, E, F, ``parts`` and V - E + F, which is 2 for each connected part of the drawing that has a face.

    ``is_valid`` is whether it is 2, ``parts_valid`` whether it is twice the number of parts.
    """
    ends = topology.edges.groupBy(*FLOOR).agg(F.count_distinct("origin").alias("v"), (F.count("*") / 2).cast("long").alias("e"))
    n = topology.faces.groupBy(*FLOOR).agg(F.count("*").alias("f"))
    out = ends.join(spread(n), FLOOR, "left").fillna(0, ["f"]).join(spread(parts(topology)), FLOOR)
    out = out.withColumn("euler", F.col("v") - F.col("e") + F.col("f"))
    return out.withColumn("is_valid", F.col("euler") == 2).withColumn("parts_valid", F.col("euler") == 2 * F.col("parts"))


def adjacency(topology: Topology, rooms_only: bool = True) -> DataFrame:
    """Undirected pairs ``(face_a, face_b)`` of different faces that share an edge."""
    both = topology.edges.where("face < twin_face").select(*FLOOR, F.col("face").alias("face_a"), F.col("twin_face").alias("face_b")).distinct()
    if not rooms_only:
        return both
    room = topology.rooms.select(*FLOOR, "face")
    for side in ("face_a", "face_b"):
        both = both.join(spread(room.withColumnRenamed("face", side)), [*FLOOR, side], "left_semi")
    return both.select(*FLOOR, "face_a", "face_b")


def connections(topology: Topology) -> DataFrame:
    """A passage for each pair of adjacent rooms, at the mean middle of their common edges."""
    shared = topology.edges.where("face < twin_face")
    room = topology.rooms.select(*FLOOR, "face")
    for side in ("face", "twin_face"):
        shared = shared.join(spread(room.withColumnRenamed("face", side)), [*FLOOR, side], "left_semi")
    mid = lambda a, b: F.avg((F.col(a) + F.col(b)) / 2)
    return shared.groupBy(*FLOOR, F.col("face").alias("from_face"), F.col("twin_face").alias("to_face")).agg(
        mid("ox", "dx").alias("x"), mid("oy", "dy").alias("y")
    ).withColumn("connection_type", F.lit("passage"))


def topology_map(topology: Topology) -> DataFrame:
    """Per floor a map from each room's id to the sorted ids of its neighbours."""
    pairs = adjacency(topology)
    both = pairs.union(pairs.select(*FLOOR, "face_b", "face_a"))
    lists = both.groupBy(*FLOOR, "face_a").agg(F.transform(F.sort_array(F.collect_set("face_b")), lambda x: x.cast("string")).alias("near"))
    rooms = topology.rooms.select(*FLOOR, F.col("face").alias("face_a")).join(spread(lists), [*FLOOR, "face_a"], "left")
    none = F.array().cast("array<string>")
    entry = F.struct(F.col("face_a").cast("string"), F.coalesce("near", none))
    return rooms.groupBy(*FLOOR).agg(F.map_from_entries(F.collect_list(entry)).alias("topology"))


def ranked_edges(topology: Topology) -> DataFrame:
    """Half-edges of faces with ``rank``, their place on the way round from the face's least edge."""
    return topology.edges.where("face IS NOT NULL")


def polygons(topology: Topology) -> DataFrame:
    """Rooms with their polygon, an array of (x, y) in order."""
    ranked = ranked_edges(topology).join(spread(topology.rooms.select(*FLOOR, "face", "area")), [*FLOOR, "face"])
    points = F.sort_array(F.collect_list(F.struct("rank", F.col("ox").alias("x"), F.col("oy").alias("y"))))
    out = ranked.groupBy(*FLOOR, "face").agg(F.first("area").alias("area"), points.alias("p"))
    return out.select(*FLOOR, "face", "area", F.transform("p", lambda q: F.struct(q["x"], q["y"])).alias("polygon"))


def classify_walls(topology: Topology, extents: DataFrame, border: float = 15.0, ordered: bool = False) -> DataFrame:
    """Walls of rooms, external where the other side is, or where both ends are near one border of the drawing.

    ``extents``: ``(plan_id, floor_id, width, height)``.
    """
    source = ranked_edges(topology) if ordered else topology.edges
    rows = source.join(spread(topology.rooms.select(*FLOOR, "face")), [*FLOOR, "face"], "left_semi").join(spread(extents), FLOOR)
    c = F.col
    near = (
        ((c("ox") < border) & (c("dx") < border)) | ((c("oy") < border) & (c("dy") < border))
        | ((c("ox") > c("width") - border) & (c("dx") > c("width") - border))
        | ((c("oy") > c("height") - border) & (c("dy") > c("height") - border))
    )
    external = F.coalesce("twin_external", F.lit(False)) | near
    size = distance(c("dx"), c("dy"), c("ox"), c("oy"))
    rank = ["rank"] if ordered else []
    return rows.select(
        *FLOOR, "face", "e", *rank, F.when(external, "external").otherwise("internal").alias("wall_type"),
        c("ox").alias("x1"), c("oy").alias("y1"), c("dx").alias("x2"), c("dy").alias("y2"), size.alias("length_px"),
    )


def close_doors(pieces: DataFrame, most: float, cfg: TopologyConfig = TopologyConfig()) -> DataFrame:
    """Virtual pieces between loose ends (vertices of one edge) nearer than ``most``, each end with its nearest."""
    edges = half_edges(pieces, cfg)
    degree = Window.partitionBy(*FLOOR, "origin")
    loose = edges.withColumn("degree", F.count("*").over(degree)).where("degree = 1")
    loose = loose.select(*FLOOR, F.col("origin").alias("v"), F.col("dest").alias("other"), F.col("ox").alias("x"), F.col("oy").alias("y"))
    cell = lambda c, k=0: F.floor(F.col(c) / most).cast("int") + k
    a = loose.select(*FLOOR, *[F.col(c).alias(f"a_{c}") for c in ("v", "other", "x", "y")], cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.array(*[F.struct(cell("x", i).alias("cx"), cell("y", j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = loose.select(*FLOOR, *[F.col(c).alias(f"b_{c}") for c in ("v", "other", "x", "y")], F.inline(around))
    d = distance(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"))
    pairs = a.join(spread(b), [*FLOOR, "cx", "cy"]).where("a_v <> b_v AND a_v <> b_other").withColumn("d", d).where(F.col("d") < most)
    best = F.row_number().over(Window.partitionBy(*FLOOR, "a_v").orderBy("d", "b_v"))
    pairs = pairs.withColumn("k", best).where("k = 1")
    pair = pairs.select(*FLOOR, F.least("a_v", "b_v").alias("v"), F.greatest("a_v", "b_v").alias("w"), F.when(F.col("a_v") < F.col("b_v"), F.struct("a_x", "a_y", "b_x", "b_y")).otherwise(F.struct(F.col("b_x").alias("a_x"), F.col("b_y").alias("a_y"), F.col("a_x").alias("b_x"), F.col("a_y").alias("b_y"))).alias("p"))
    return pair.dropDuplicates([*FLOOR, "v", "w"]).select(*FLOOR, F.col("p.a_x").alias("x1"), F.col("p.a_y").alias("y1"), F.col("p.b_x").alias("x2"), F.col("p.b_y").alias("y2"))


__all__ = ["FLOOR", "XY", "Topology", "TopologyConfig", "adjacency", "build_topology", "classify_walls", "close_doors", "connections", "euler", "faces", "half_edges", "polygons", "ranked_edges", "topology_map"]
