"""Queries over wall segments and the topology made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atrium.functions import geometry as g
from atrium.operators import labels, questions, segments, topology
from atrium.plans.fixtures import GRID_FX, TEXT_FX, WALLS_FX, gap_fx, grid_fx, irregular_fx, strokes_fx, text_fx, walls_fx
from atrium.storage import spread


def _topology(spark: SparkSession, sf_dir: str, **options) -> topology.Topology:
    return topology.build_topology(grid_fx(spark, sf_dir), topology.TopologyConfig(**options))


def _r(c, digits: int = 6):
    return F.round(c, digits)


def segment_metrics(spark, sf_dir):
    mx, my = g.midpoint()
    origin = g.perpendicular_distance(F.lit(0.0), F.lit(0.0))
    return walls_fx(spark, sf_dir).select(
        "room_id", "wall_idx", _r(g.length()).alias("length"), _r(g.angle_deg()).alias("angle"), g.is_horizontal().alias("horizontal"),
        g.is_vertical().alias("vertical"), mx.alias("mx"), my.alias("my"), _r(origin).alias("to_origin"),
    )


def segment_stats(spark, sf_dir):
    out = segments.segment_stats(grid_fx(spark, sf_dir))
    return out.select("plan_id", "n", _r("min_length", 4).alias("min_length"), _r("max_length", 4).alias("max_length"), _r("mean_length", 4).alias("mean_length"), "n_horizontal", "n_vertical", "n_other")


def long_horizontal(spark, sf_dir):
    kept = segments.filter_by_length(segments.filter_by_orientation(grid_fx(spark, sf_dir), vertical=False), 250, 380)
    return kept.select("plan_id", "seg_id", "x1", "x2")


def intersections(spark, sf_dir):
    return segments.find_intersections(grid_fx(spark, sf_dir)).select("plan_id", "seg_a", "seg_b", _r("x").alias("x"), _r("y").alias("y"))


def split_pieces(spark, sf_dir):
    pieces = segments.split_at_intersections(grid_fx(spark, sf_dir))
    return pieces.groupBy("plan_id").agg(F.count("*").alias("n_pieces"), _r(F.sum(g.length()), 4).alias("length"))


def _merged(spark, sf_dir, merge, **options) -> DataFrame:
    pieces = segments.split_at_intersections(grid_fx(spark, sf_dir)).withColumn("seg_id", F.col("seg_id") * 100 + F.col("piece"))
    merged = merge(pieces, segments.MergeConfig(**options))
    return merged.groupBy("plan_id").agg(F.count("*").alias("n_lines"), _r(F.sum(g.length()), 4).alias("length"))


def merge_collinear(spark, sf_dir):
    return _merged(spark, sf_dir, segments.merge_collinear)


def merge_once(spark, sf_dir):
    """The older rule: one pass, whatever the distance across."""
    return _merged(spark, sf_dir, segments.merge_collinear, perpendicular=None, until_stable=False)


def merge_components(spark, sf_dir):
    return _merged(spark, sf_dir, segments.merge_components)


def adjacent_rooms(spark, sf_dir):
    """The neighbours of each plan's leftmost room."""
    found = _topology(spark, sf_dir)
    left = found.edges.where("face IS NOT NULL").groupBy("plan_id", "face").agg(F.min("ox").alias("left"))
    rooms = found.rooms.join(spread(left), ["plan_id", "face"]).select("plan_id", F.col("face").alias("room_id"), "area", "left")
    first = rooms.groupBy("plan_id").agg(F.min_by("room_id", "left").alias("first"))
    pairs = topology.adjacency(found).selectExpr("plan_id", "face_a AS room_a", "face_b AS room_b").join(spread(first), "plan_id")
    near = questions.adjacent_rooms(rooms, pairs, F.col("first"))
    return near.select("plan_id", _r("left", 3).alias("left"), _r("area", 4).alias("area"))


def room_areas(spark, sf_dir):
    return _topology(spark, sf_dir).rooms.select("plan_id", _r("area", 4).alias("area"))


def room_areas_nearest(spark, sf_dir):
    return _topology(spark, sf_dir, snapping="nearest", snap=3.0).rooms.select("plan_id", _r("area", 4).alias("area"))


def room_areas_descending(spark, sf_dir):
    return _topology(spark, sf_dir, turn="descending").rooms.select("plan_id", _r("area", 4).alias("area"))


def room_polygons(spark, sf_dir):
    c = g.centroid(F.col("polygon"))
    return topology.polygons(_topology(spark, sf_dir)).select(
        "plan_id", F.size("polygon").alias("n_vertices"), _r(g.area(F.col("polygon")), 4).alias("area"), _r(c["x"], 4).alias("cx"), _r(c["y"], 4).alias("cy")
    )


def euler(spark, sf_dir):
    return topology.euler(_topology(spark, sf_dir)).select("plan_id", "v", "e", "f", "euler", "is_valid")


def adjacency(spark, sf_dir):
    return topology.adjacency(_topology(spark, sf_dir)).groupBy("plan_id").agg(F.count("*").alias("n_pairs"))


def connections(spark, sf_dir):
    return topology.connections(_topology(spark, sf_dir)).select("plan_id", "connection_type", _r("x", 4).alias("x"), _r("y", 4).alias("y"))


def topology_map(spark, sf_dir):
    maps = topology.topology_map(_topology(spark, sf_dir))
    ends = F.aggregate(F.map_values("topology"), F.lit(0), lambda acc, x: acc + F.size(x))
    return maps.select("plan_id", F.size("topology").alias("n_rooms"), ends.alias("n_links"))


def wall_types(spark, sf_dir):
    extents = grid_fx(spark, sf_dir).groupBy("plan_id", "floor_id").agg(F.max("x2").alias("width"), F.max("y2").alias("height"))
    walls = topology.classify_walls(_topology(spark, sf_dir), extents)
    return walls.groupBy("plan_id", "wall_type").agg(F.count("*").alias("n_walls"), _r(F.sum("length_px"), 3).alias("length"))


def _labelled(spark, sf_dir, mode: str) -> DataFrame:
    edges = _topology(spark, sf_dir)
    room = edges.edges.join(spread(edges.rooms.select("plan_id", "floor_id", "face")), ["plan_id", "floor_id", "face"], "left_semi")
    found = labels.label_rooms(text_fx(spark, sf_dir), room, mode)
    left = room.groupBy("plan_id", "floor_id", "face").agg(F.min("ox").alias("left"))
    return found.join(spread(left), ["plan_id", "floor_id", "face"]).select("plan_id", _r("left", 3).alias("left"), "label")


def label_rooms(spark, sf_dir):
    return _labelled(spark, sf_dir, "best")


def label_rooms_concat(spark, sf_dir):
    return _labelled(spark, sf_dir, "concat")


def door_closing(spark, sf_dir):
    """Dividing walls with a gap of 20 in the middle: each gap is closed by one piece."""
    grid = grid_fx(spark, sf_dir)
    inner, mid = F.col("seg_id") > 3, F.col("y2") / 2
    cut = lambda a, b, k: F.struct((F.col("seg_id") * 10 + k).alias("seg_id"), F.col("x1"), a.alias("y1"), F.col("x2"), b.alias("y2"))
    whole = F.array(cut(F.col("y1"), F.col("y2"), 0))
    parts = F.array(cut(F.col("y1"), mid - 10, 0), cut(mid + 10, F.col("y2"), 1))
    gapped = grid.select("plan_id", "floor_id", F.inline(F.when(inner, parts).otherwise(whole)))
    doors = topology.close_doors(segments.split_at_intersections(gapped), most=30.0)
    return doors.select("plan_id", _r("x1", 4).alias("x"), F.abs(F.col("y2") - F.col("y1")).alias("gap"))


def parallel_walls(spark, sf_dir):
    """Dividing walls drawn as two lines 10 apart: each pair is one wall."""
    grid = grid_fx(spark, sf_dir)
    twin = grid.where("seg_id > 3").selectExpr("plan_id", "floor_id", "seg_id + 100 AS seg_id", "x1 + 10 AS x1", "y1", "x2 + 10 AS x2", "y2")
    pairs = segments.parallel_walls(grid.select(*twin.columns).unionByName(twin), least=3.0, most=20.0)
    return pairs.select("plan_id", "seg_a", "seg_b", _r("distance", 4).alias("distance"))


def pair_metrics(spark, sf_dir):
    """What merging looks at, for pairs of segments that are near each other."""
    pairs = segments.near_pairs(grid_fx(spark, sf_dir), reach=1.0).withColumn("m", g.merged_segment())
    turn = g.angle_difference(g.angle_deg("a_"), g.angle_deg("b_"))
    return pairs.select(
        "plan_id", "a_seg_id", "b_seg_id", _r(g.min_endpoint_distance(), 4).alias("gap"), _r(turn, 4).alias("turn"),
        _r(F.hypot(F.col("m.x2") - F.col("m.x1"), F.col("m.y2") - F.col("m.y1")), 4).alias("merged_length"),
    )


def irregular_rooms(spark, sf_dir):
    """Rooms of drawings with a diagonal, T-joints, holes, separate parts and walls that lead nowhere."""
    return topology.build_topology(irregular_fx(spark, sf_dir)).rooms.select("plan_id", "n_edges", _r("area", 4).alias("area"))


def irregular_parts(spark, sf_dir):
    """V - E + F of the same drawings against the number of their parts, and how many of their rooms are side by side."""
    found = topology.build_topology(irregular_fx(spark, sf_dir))
    pairs = topology.adjacency(found).groupBy("plan_id").agg(F.count("*").alias("n_pairs"))
    return topology.euler(found).join(spread(pairs), "plan_id").select("plan_id", "v", "e", "f", "parts", "euler", "is_valid", "parts_valid", "n_pairs")


def rooms_with_gaps(spark, sf_dir):
    """Rooms that close only if ends snap to the nearest vertex, with the number of rooms that grid cells find."""
    gaps = gap_fx(spark, sf_dir)
    found = topology.build_topology(gaps, topology.TopologyConfig(snapping="nearest", snap=3.0))
    near, grid = found.rooms, topology.build_topology(gaps, pieces=found.pieces).rooms.groupBy("plan_id").agg(F.count("*").alias("n_grid"))
    return near.join(spread(grid), "plan_id", "left").select("plan_id", _r("area", 4).alias("area"), F.coalesce("n_grid", F.lit(0)).cast("long").alias("n_grid"))


def merge_modes(spark, sf_dir):
    """Strokes on which greedy merging, one pass of the older rule and merging by components give different lines."""
    strokes = strokes_fx(spark, sf_dir)
    older = segments.MergeConfig(perpendicular=None, until_stable=False)
    modes = {"greedy": segments.merge_collinear(strokes), "once": segments.merge_collinear(strokes, older), "components": segments.merge_components(strokes)}
    found = [m.withColumn("mode", F.lit(k)).select("plan_id", "mode", "x1", "y1", "x2", "y2") for k, m in modes.items()]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.groupBy("plan_id", "mode").agg(F.count("*").alias("n_lines"), _r(F.sum(g.length()), 4).alias("length"), F.max(g.length()).cast("int").alias("longest"))


QUERIES = {
    f.__name__: f
    for f in (
        segment_metrics, segment_stats, long_horizontal, intersections, split_pieces, merge_collinear, merge_once, merge_components, room_areas, room_areas_nearest,
        room_areas_descending, room_polygons, euler, adjacency, connections, topology_map, wall_types, label_rooms, label_rooms_concat,
        door_closing, parallel_walls, pair_metrics, adjacent_rooms, irregular_rooms, irregular_parts, rooms_with_gaps, merge_modes,
    )
}

#: Closed forms: a plan of w by h with nd dividing walls has nd + 1 equal rooms side by side.
_P = """p AS (SELECT o_orderkey AS plan_id, CAST(200 + 10*(o_orderkey % 20) AS DOUBLE) AS w, CAST(100 + 10*(o_orderkey % 7) AS DOUBLE) AS h,
  CAST(o_orderkey % 4 AS INT) AS nd FROM orders)"""
_ROOM = f"{_P}, rooms AS (SELECT plan_id, w, h, nd, unnest(range(0, nd + 1)) AS k FROM p)"
_MEET = f"""{_ROOM}, meet AS (
  SELECT plan_id, w, h, unnest([0, 0, 1, 2]) AS seg_a, unnest([1, 3, 2, 3]) AS seg_b, unnest([w, 0, w, 0]) AS x, unnest([0, 0, h, h]) AS y FROM p
  UNION ALL SELECT plan_id, w, h, unnest([0, 2]), CAST(3 + k AS INT), w * k / (nd + 1), unnest([0, h]) FROM rooms WHERE k > 0)"""
_AREAS = f"WITH {_ROOM} SELECT plan_id, round(w * h / (nd + 1), 4) AS area FROM rooms"
_TEXT_IN = f"""WITH {_ROOM}, t AS ({TEXT_FX}),
c AS (SELECT t.*, x + w / 2.0 AS px, y + h / 2.0 AS py FROM t),
hit AS (SELECT r.plan_id, r.k, round(r.w * r.k / (r.nd + 1), 3) AS "left", c.block_id, c.text FROM rooms r JOIN c USING (plan_id)
  WHERE px >= r.w * r.k / (r.nd + 1) AND px < r.w * (r.k + 1) / (r.nd + 1) AND py >= 0 AND py < r.h)"""

ORACLES = {
    "segment_metrics": f"""WITH s AS ({WALLS_FX} ), w AS (SELECT s.* FROM s JOIN orders ON room_id = o_orderkey),
a AS (SELECT *, sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) AS n, degrees(atan2(y2 - y1, x2 - x1)) AS d FROM w),
b AS (SELECT *, CASE WHEN d < 0 THEN d + 180 ELSE d END AS deg FROM a)
SELECT room_id, wall_idx, round(n, 6) AS length, round(deg, 6) AS angle, deg < 5 OR deg > 175 AS horizontal, abs(deg - 90) < 5 AS vertical, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my,
  round(CASE WHEN n < 1e-12 THEN sqrt(x1 * x1 + y1 * y1) ELSE abs(x2 * y1 - y2 * x1) / n END, 6) AS to_origin FROM b""",
    "segment_stats": f"WITH {_P} SELECT plan_id, CAST(4 + nd AS BIGINT) AS n, round(least(w, h), 4) AS min_length, round(greatest(w, h), 4) AS max_length, round((2 * w + (2 + nd) * h) / (4 + nd), 4) AS mean_length, 2::BIGINT AS n_horizontal, CAST(2 + nd AS BIGINT) AS n_vertical, 0::BIGINT AS n_other FROM p",
    "long_horizontal": f"WITH g AS ({GRID_FX}) SELECT plan_id, seg_id, x1, x2 FROM g WHERE y1 = y2 AND abs(x2 - x1) BETWEEN 250 AND 380",
    "intersections": f"""WITH {_MEET} SELECT plan_id, seg_a, seg_b, round(x, 6) AS x, round(y, 6) AS y FROM meet""",
    "split_pieces": f"WITH {_P} SELECT plan_id, CAST(4 + 3 * nd AS BIGINT) AS n_pieces, round(2 * w + (2 + nd) * h, 4) AS length FROM p",
    "merge_collinear": f"WITH {_P} SELECT plan_id, CAST(4 + nd AS BIGINT) AS n_lines, round(2 * w + (2 + nd) * h, 4) AS length FROM p",
    "room_areas": _AREAS,
    "room_areas_nearest": _AREAS,
    "room_areas_descending": _AREAS,
    "room_polygons": f"WITH {_ROOM} SELECT plan_id, 4 AS n_vertices, round(w * h / (nd + 1), 4) AS area, round(w * (k + 0.5::DOUBLE) / (nd + 1), 4) AS cx, round(h / 2, 4) AS cy FROM rooms",
    "euler": f"WITH {_P} SELECT plan_id, CAST(4 + 2 * nd AS BIGINT) AS v, CAST(4 + 3 * nd AS BIGINT) AS e, CAST(nd + 2 AS BIGINT) AS f, 2::BIGINT AS euler, true AS is_valid FROM p",
    "adjacency": f"WITH {_P} SELECT plan_id, CAST(nd AS BIGINT) AS n_pairs FROM p WHERE nd > 0",
    "connections": f"WITH {_ROOM} SELECT plan_id, 'passage' AS connection_type, round(w * k / (nd + 1), 4) AS x, round(h / 2, 4) AS y FROM rooms WHERE k > 0",
    "topology_map": f"WITH {_P} SELECT plan_id, nd + 1 AS n_rooms, 2 * nd AS n_links FROM p",
    "wall_types": f"""WITH {_P} SELECT plan_id, 'external' AS wall_type, CAST(2 * (nd + 1) + 2 AS BIGINT) AS n_walls, round(2 * w + 2 * h, 3) AS length FROM p
UNION ALL SELECT plan_id, 'internal', CAST(2 * nd AS BIGINT), round(2 * nd * h, 3) FROM p WHERE nd > 0""",
    "label_rooms": f"""{_TEXT_IN}, o AS (SELECT *, row_number() OVER (PARTITION BY plan_id, k ORDER BY CASE WHEN text IN ('Soggiorno', 'BAGNO', 'Camera') THEN 0 ELSE 1 END, block_id) AS n FROM hit)
SELECT plan_id, "left", text AS label FROM o WHERE n = 1""",
    "label_rooms_concat": f"""{_TEXT_IN} SELECT plan_id, "left", string_agg(text, ' ' ORDER BY block_id) AS label FROM hit GROUP BY plan_id, k, "left" """,
    "door_closing": f"WITH {_ROOM} SELECT plan_id, round(w * k / (nd + 1), 4) AS x, 20.0::DOUBLE AS gap FROM rooms WHERE k > 0",
    "parallel_walls": f"WITH {_ROOM} SELECT plan_id, CAST(3 + k AS INT) AS seg_a, CAST(103 + k AS INT) AS seg_b, 10.0::DOUBLE AS distance FROM rooms WHERE k > 0",
    "pair_metrics": f"""WITH {_MEET} SELECT plan_id, seg_a AS a_seg_id, seg_b AS b_seg_id, round(CASE WHEN seg_b > 3 THEN least(x, w - x) ELSE 0 END, 4) AS gap, 90.0::DOUBLE AS turn,
  round(CASE WHEN seg_b > 3 THEN greatest(w, sqrt(x * x + h * h), sqrt((w - x) * (w - x) + h * h)) ELSE sqrt(w * w + h * h) END, 4) AS merged_length FROM meet""",
    "merge_once": f"WITH {_P} SELECT plan_id, CAST(4 + nd AS BIGINT) AS n_lines, round(2 * w + (2 + nd) * h, 4) AS length FROM p",
    "merge_components": f"WITH {_P} SELECT plan_id, CAST(4 + nd AS BIGINT) AS n_lines, round(2 * w + (2 + nd) * h, 4) AS length FROM p",
    "adjacent_rooms": f"""WITH {_P} SELECT plan_id, round(w / (nd + 1), 3) AS "left", round(w * h / (nd + 1), 4) AS area FROM p WHERE nd > 0""",
    "irregular_rooms": f"""WITH {_P}, r AS (SELECT plan_id, unnest([CASE WHEN plan_id % 5 = 0 THEN 5 ELSE 4 END, 3, 4]) AS n_edges, unnest([w * h / 2, w * h / 8, w * h * 3 / 8]) AS area FROM p
  UNION ALL SELECT plan_id, 4, unnest([1500, 1500]) FROM p WHERE plan_id % 2 = 0 UNION ALL SELECT plan_id, 4, unnest([4000, 4000]) FROM p WHERE plan_id % 3 = 0)
SELECT plan_id, CAST(n_edges AS BIGINT) AS n_edges, round(area::DOUBLE, 4) AS area FROM r""",
    "irregular_parts": f"""WITH {_P}, c AS (SELECT plan_id, CAST(plan_id % 2 = 0 AS BIGINT) AS b, CAST(plan_id % 3 = 0 AS BIGINT) AS a, CAST(plan_id % 5 = 0 AS BIGINT) AS d, CAST(plan_id % 7 = 0 AS BIGINT) AS s FROM p),
f AS (SELECT plan_id, 6 + 4 * b + 4 * a + 2 * d + 2 * s AS v, 8 + 4 * b + 4 * a + 2 * d + s AS e, 4 + 2 * b + 2 * a AS f, 1 + b + a + s AS parts, 3 + b + a AS n_pairs FROM c)
SELECT *, v - e + f AS euler, v - e + f = 2 AS is_valid, v - e + f = 2 * parts AS parts_valid FROM f""",
    "rooms_with_gaps": f"WITH {_P} SELECT plan_id, round(h * (w + 0.6::DOUBLE), 4) AS area, 0::BIGINT AS n_grid FROM p",
    "merge_modes": """WITH p AS (SELECT o_orderkey AS plan_id, CAST(o_orderkey % 5 * 10 AS DOUBLE) AS o FROM orders),
bend AS (SELECT sqrt(200.0::DOUBLE * 200 + 7 * 7) AS two, sqrt(100.0::DOUBLE * 100 + 14 * 14) AS last, sqrt(300.0::DOUBLE * 300 + 21 * 21) AS whole)
SELECT plan_id, 'greedy' AS mode, 3::BIGINT AS n_lines, round(300 + o + two + last, 4) AS length, CAST(300 + o AS INT) AS longest FROM p, bend
UNION ALL SELECT plan_id, 'once', 4, round(295 + o + two + last, 4), CAST(200 + o AS INT) FROM p, bend
UNION ALL SELECT plan_id, 'components', 2, round(300 + o + whole, 4), CAST(greatest(300 + o, floor(whole)) AS INT) FROM p, bend""",
}
