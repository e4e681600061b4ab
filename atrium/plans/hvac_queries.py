"""Queries over rooms and walls: loads, equipment, pipes and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atrium.operators import hvac, questions, thermal
from atrium.plans.fixtures import ROOMS_FX, WALLS_FX, rooms_fx, walls_fx


def _requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thermal.thermal_requirements(rooms_fx(spark, sf_dir), walls_fx(spark, sf_dir))


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


def heating_by_plan(spark, sf_dir):
    return thermal.building_loads(_requirements(spark, sf_dir)).select("plan_id", "n_rooms", "heating_w", "heating_kw")


def cooling_by_plan(spark, sf_dir):
    return thermal.building_loads(_requirements(spark, sf_dir)).select("plan_id", "n_rooms", "cooling_w", "cooling_kw")


def room_requirements(spark, sf_dir):
    out = _requirements(spark, sf_dir).select(
        *thermal.ROOM, "label", "usage", "area_m2", "volume_m3", "ext_wall_m", "heating_w", "cooling_w", "target_c"
    )
    return _rounded(out, "area_m2", "volume_m3", "ext_wall_m", digits=8)


def radiators(spark, sf_dir):
    return hvac.place_radiators(_requirements(spark, sf_dir)).select(
        "plan_id", "room_id", "id", "x", "y", "width_mm", "height_mm", "power_w", "n_elements", "wall_side"
    )


def ac_units(spark, sf_dir):
    out = hvac.place_cooling(_requirements(spark, sf_dir)).select("plan_id", "room_id", "id", "x", "y", "cooling_w", "heating_w", "wall_side")
    return _rounded(out, "heating_w", digits=3)


def boilers(spark, sf_dir):
    return _rounded(hvac.boilers(_requirements(spark, sf_dir)).select("plan_id", "room_id", "x", "y", "power_kw", "heating_kw"), "x", "y")


def _pipes(spark, sf_dir, layout: str) -> DataFrame:
    req = _requirements(spark, sf_dir)
    pipes = hvac.route_pipes(hvac.place_radiators(req), hvac.boilers(req), hvac.PipeConfig(layout=layout))
    out = pipes.select("plan_id", "id", "pipe_type", "source_id", "destination_id", F.size("path").alias("n_points"), "length_units")
    return _rounded(out, "length_units", digits=4)


def pipes_two(spark, sf_dir):
    return _pipes(spark, sf_dir, "two_pipe")


def pipes_one(spark, sf_dir):
    return _pipes(spark, sf_dir, "one_pipe")


def pipe_pieces(spark, sf_dir):
    req = _requirements(spark, sf_dir)
    pieces = hvac.pipe_segments(hvac.route_pipes(hvac.place_radiators(req), hvac.boilers(req)))
    straight = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    out = pieces.groupBy("plan_id", "id").agg(F.count("*").alias("n_segments"), F.sum(straight).alias("length_units"))
    return _rounded(out, "length_units", digits=4)


def hvac_totals(spark, sf_dir):
    out = hvac.hvac_system(_requirements(spark, sf_dir))["totals"]
    return out.withColumn("pipe_units", F.round("pipe_units", 1))


def wall_summary(spark, sf_dir):
    out = questions.building_summary(rooms_fx(spark, sf_dir), walls_fx(spark, sf_dir))
    return _rounded(out, "area_m2", digits=6)


def floor_areas(spark, sf_dir):
    return _rounded(questions.floor_areas(rooms_fx(spark, sf_dir)), "area_m2", digits=6)


def living_room_area(spark, sf_dir):
    return _rounded(questions.room_area(rooms_fx(spark, sf_dir), "soggiorno"), "area_m2")


def rooms_facing_side(spark, sf_dir):
    return questions.rooms_facing(rooms_fx(spark, sf_dir), walls_fx(spark, sf_dir), "south").select(*thermal.ROOM, "label")


def external_walls(spark, sf_dir):
    out = thermal.wall_summary(walls_fx(spark, sf_dir))
    return out.select(*thermal.ROOM, "ext_wall_m", "n_walls", "n_external", F.col("radiator_wall.wall_idx").alias("radiator_wall"), F.col("cooling_wall.wall_idx").alias("cooling_wall"))


def filtered_report(spark, sf_dir):
    keep = (F.col("area_m2") >= 10) & (thermal.room_usage(F.col("label")) == "bedroom")
    return _rounded(questions.building_summary(rooms_fx(spark, sf_dir), walls_fx(spark, sf_dir), keep), "area_m2", digits=6)


def climate_zone(spark, sf_dir):
    days = (F.col("value") * 37.0) % 3500
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", thermal.climate_zone(days).alias("zone"))


QUERIES = {
    f.__name__: f
    for f in (
        heating_by_plan, cooling_by_plan, room_requirements, radiators, ac_units, boilers, pipes_two, pipes_one, pipe_pieces,
        hvac_totals, wall_summary, floor_areas, living_room_area, rooms_facing_side, external_walls, filtered_report, climate_zone,
    )
}

_USAGE = "CASE " + " ".join(f"WHEN contains(lower(label), '{k}') THEN '{v}'" for k, v in thermal.USAGE_KEYWORDS.items()) + " ELSE 'unknown' END"
_TARGET = "CASE usage " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in thermal.TARGET_C.items()) + " END"

#: Rooms with loads: ``req``. Walls are looked up with windows here.
_REQ = f"""
rooms AS ({ROOMS_FX}), walls AS ({WALLS_FX}),
wa AS (SELECT room_id, sum(CASE WHEN wall_type = 'external' THEN length_m ELSE 0 END) AS ext, count(*) AS n_walls,
        sum(CASE WHEN wall_type = 'external' THEN 1 ELSE 0 END) AS n_external, avg(x1) AS cx, avg(y1) AS cy FROM walls GROUP BY room_id),
rw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY CASE WHEN wall_type = 'external' THEN 0 ELSE 1 END, length_m DESC, wall_idx) AS k FROM walls) WHERE k = 1),
cw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY CASE WHEN wall_type = 'internal' THEN 0 ELSE 1 END, length_m DESC, wall_idx) AS k FROM walls) WHERE k = 1),
r0 AS (SELECT r.*, coalesce(ext, 0) AS ext_wall_m, coalesce(cx, 0) AS cx, coalesce(cy, 0) AS cy, {_USAGE} AS usage,
        CASE WHEN area_m2 > 0 AND height_m > 0 THEN area_m2 * height_m ELSE area_m2 * 2.7::DOUBLE END AS volume_m3 FROM rooms r LEFT JOIN wa USING (room_id)),
r1 AS (SELECT *, {_TARGET} AS target_c FROM r0),
req AS (SELECT *, round_even((volume_m3 * 50 * 1.0::DOUBLE + CASE WHEN ext_wall_m > 0 THEN ext_wall_m * 10 ELSE 0 END) * ((target_c + 15) / 30::DOUBLE) * 1.2::DOUBLE, 0) AS heating_w,
   round_even((volume_m3 * 30 + CASE WHEN ext_wall_m > 0 THEN ext_wall_m * 2.7::DOUBLE * 0.15::DOUBLE * 250 ELSE 0 END + greatest(1.0::DOUBLE, area_m2 / 10) * 100)
     * CASE WHEN usage = 'bathroom' THEN 0.8::DOUBLE WHEN usage IN ('storage', 'garage') THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * 1.15::DOUBLE, 0) AS cooling_w FROM r1),
loads AS (SELECT plan_id, count(*) AS n_rooms, sum(heating_w) AS heating_w, sum(cooling_w) AS cooling_w, round_even(sum(heating_w) / 10.0::DOUBLE, 0) / 100 AS heating_kw,
   round_even(sum(cooling_w) / 10.0::DOUBLE, 0) / 100 AS cooling_kw FROM req GROUP BY plan_id)"""

_RAD = f"""{_REQ},
p0 AS (SELECT q.*, coalesce(w.length_m, 3.0) AS wl, (w.x1 + w.x2) / 2 AS wx, (w.y1 + w.y2) / 2 AS wy, coalesce(w.side, 'unknown') AS wall_side FROM req q LEFT JOIN rw w USING (room_id)),
p1 AS (SELECT *, least(2000.0::DOUBLE, wl * 1000 - 100) AS fit FROM p0),
p2 AS (SELECT *, CASE WHEN ceil(heating_w / 120) * 80 <= fit THEN 120 WHEN ceil(heating_w / 80) * 80 <= fit THEN 80 WHEN ceil(heating_w / 160) * 80 <= fit THEN 160 ELSE 120 END AS per FROM p1),
p3 AS (SELECT *, CAST(ceil(heating_w / per) AS INT) AS n FROM p2),
p4 AS (SELECT *, unnest(generate_series(0, CAST(ceil(n / 25.0) AS INT) - 1)) AS part FROM p3 WHERE n > 0),
rad AS (SELECT plan_id, floor_idx, room_id, part, least(25, n - 25 * part) AS ne, per, wall_side, coalesce(wx, cx) + part * 0.5::DOUBLE AS x, coalesce(wy, cy) AS y,
   row_number() OVER (PARTITION BY plan_id ORDER BY floor_idx, room_id, part) AS no FROM p4),
radi AS (SELECT *, 'RAD_' || CASE WHEN no < 1000 THEN lpad(CAST(no AS VARCHAR), 3, '0') ELSE CAST(no AS VARCHAR) END AS id FROM rad)"""

_BOIL = """,
br AS (SELECT * FROM (SELECT plan_id, room_id, cx, cy, row_number() OVER (PARTITION BY plan_id ORDER BY
   CASE WHEN regexp_matches(lower(coalesce(label, '')), 'caldaia|centrale|tecnico|garage|cantina|cucina') THEN 0 ELSE 1 END, floor_idx, room_id) AS k FROM req) WHERE k = 1),
boil AS (SELECT br.plan_id, br.room_id, br.cx AS x, br.cy AS y, heating_kw,
   coalesce((SELECT min(s) FROM (VALUES (12), (18), (24), (28), (32), (35), (40), (50), (60), (80), (100)) t(s) WHERE s >= heating_kw + heating_kw * 0.15::DOUBLE),
     CAST(ceil((heating_kw + heating_kw * 0.15::DOUBLE) / 10) * 10 AS INT)) AS power_kw FROM br JOIN loads USING (plan_id))"""

_ROUTE = f"""{_RAD}{_BOIL},
o0 AS (SELECT r.*, b.x AS bx0, b.y AS by0, row_number() OVER w AS k, lag(r.x) OVER w AS lx, lag(r.y) OVER w AS ly, lag(r.id) OVER w AS lid, lead(r.id) OVER w AS nid
   FROM radi r JOIN boil b USING (plan_id) WINDOW w AS (PARTITION BY plan_id ORDER BY sqrt((b.x - r.x) * (b.x - r.x) + (b.y - r.y) * (b.y - r.y)), no)),
o AS (SELECT *, coalesce(lx, bx0) AS px, coalesce(ly, by0) AS py, coalesce(lid, 'BOILER_001') AS pid FROM o0),
two AS (SELECT plan_id, 2 * k - 1 AS no, 'hot_water_supply' AS pipe_type, 'BOILER_001' AS source_id, id AS destination_id, px AS sx, py AS sy, x AS ex, y AS ey FROM o
   UNION ALL SELECT plan_id, 2 * k, 'hot_water_return', id, 'BOILER_001', x + 0.05::DOUBLE, y, bx0 + 0.1::DOUBLE, by0 FROM o),
one AS (SELECT plan_id, k AS no, 'hot_water_supply' AS pipe_type, pid AS source_id, id AS destination_id, px AS sx, py AS sy, x AS ex, y AS ey FROM o
   UNION ALL SELECT plan_id, k + 1, 'hot_water_return', id, 'BOILER_001', x, y, bx0, by0 FROM o WHERE nid IS NULL)"""


def _pipe_sql(name: str) -> str:
    return f"""WITH {_ROUTE}
SELECT plan_id, 'PIPE_' || CASE WHEN no < 1000 THEN lpad(CAST(no AS VARCHAR), 3, '0') ELSE CAST(no AS VARCHAR) END AS id, pipe_type, source_id, destination_id,
  CASE WHEN sx = ex OR sy = ey THEN 2 ELSE 3 END AS n_points, round(abs(ex - sx) + abs(ey - sy), 4) AS length_units FROM {name}"""


ORACLES = {
    "heating_by_plan": f"WITH {_REQ} SELECT plan_id, n_rooms, heating_w, heating_kw FROM loads",
    "cooling_by_plan": f"WITH {_REQ} SELECT plan_id, n_rooms, cooling_w, cooling_kw FROM loads",
    "room_requirements": f"WITH {_REQ} SELECT plan_id, floor_idx, room_id, label, usage, round(area_m2, 8) AS area_m2, round(volume_m3, 8) AS volume_m3, round(ext_wall_m, 8) AS ext_wall_m, heating_w, cooling_w, target_c FROM req",
    "radiators": f"WITH {_RAD} SELECT plan_id, room_id, id, x, y, CAST(ne * 80 AS INT) AS width_mm, CASE per WHEN 120 THEN 600 WHEN 80 THEN 300 ELSE 900 END AS height_mm, CAST(ne * per AS INT) AS power_w, CAST(ne AS INT) AS n_elements, wall_side FROM radi",
    "ac_units": f"""WITH {_REQ}, u AS (SELECT q.*, w.x1, w.x2, w.y1, w.y2, w.side, row_number() OVER (PARTITION BY plan_id ORDER BY floor_idx, q.room_id) AS no
   FROM req q LEFT JOIN cw w ON q.room_id = w.room_id WHERE usage NOT IN ('storage', 'garage', 'hallway'))
SELECT plan_id, room_id, 'AC_' || CASE WHEN no < 1000 THEN lpad(CAST(no AS VARCHAR), 3, '0') ELSE CAST(no AS VARCHAR) END AS id, coalesce((x1 + x2) / 2, cx) AS x, coalesce((y1 + y2) / 2, cy) AS y, cooling_w,
  round(cooling_w * 1.1::DOUBLE, 3) AS heating_w, coalesce(side, 'unknown') AS wall_side FROM u""",
    "boilers": f"WITH {_REQ}{_BOIL} SELECT plan_id, room_id, round(x, 6) AS x, round(y, 6) AS y, power_kw, heating_kw FROM boil",
    "pipes_two": _pipe_sql("two"),
    "pipes_one": _pipe_sql("one"),
    "pipe_pieces": f"""WITH {_ROUTE} SELECT plan_id, 'PIPE_' || CASE WHEN no < 1000 THEN lpad(CAST(no AS VARCHAR), 3, '0') ELSE CAST(no AS VARCHAR) END AS id,
  CAST(CASE WHEN sx = ex OR sy = ey THEN 1 ELSE 2 END AS BIGINT) AS n_segments, round(abs(ex - sx) + abs(ey - sy), 4) AS length_units FROM two""",
    "hvac_totals": f"""WITH {_ROUTE}, a AS (SELECT plan_id, count(*) AS n FROM radi GROUP BY plan_id),
 c AS (SELECT plan_id, count(*) AS n FROM req WHERE usage NOT IN ('storage', 'garage', 'hallway') GROUP BY plan_id),
 l AS (SELECT plan_id, sum(abs(ex - sx) + abs(ey - sy)) AS n FROM two GROUP BY plan_id)
SELECT plan_id, heating_kw, cooling_kw, coalesce(a.n, 0) AS n_radiators, coalesce(c.n, 0) AS n_ac_units, round(coalesce(round(l.n, 2), 0), 1) AS pipe_units
FROM loads LEFT JOIN a USING (plan_id) LEFT JOIN c USING (plan_id) LEFT JOIN l USING (plan_id)""",
    "wall_summary": f"""WITH {_REQ} SELECT plan_id, count(DISTINCT floor_idx) AS n_floors, count(*) AS n_rooms, round(sum(area_m2), 6) AS area_m2, CAST(sum(coalesce(n_walls, 0)) AS BIGINT) AS n_walls
FROM rooms LEFT JOIN wa USING (room_id) GROUP BY plan_id""",
    "floor_areas": f"WITH rooms AS ({ROOMS_FX}) SELECT plan_id, floor_idx, count(*) AS n_rooms, round(sum(area_m2), 6) AS area_m2 FROM rooms GROUP BY plan_id, floor_idx",
    "living_room_area": f"WITH rooms AS ({ROOMS_FX}) SELECT plan_id, floor_idx, room_id, label, round(area_m2, 6) AS area_m2 FROM rooms WHERE lower(label) LIKE '%soggiorno%'",
    "rooms_facing_side": f"WITH rooms AS ({ROOMS_FX}), walls AS ({WALLS_FX}) SELECT plan_id, floor_idx, room_id, label FROM rooms WHERE room_id IN (SELECT room_id FROM walls WHERE side = 'south' AND wall_type = 'external')",
    "external_walls": f"""WITH {_REQ} SELECT r.plan_id, r.floor_idx, room_id, ext AS ext_wall_m, n_walls, CAST(n_external AS BIGINT) AS n_external, rw.wall_idx AS radiator_wall, cw.wall_idx AS cooling_wall
FROM rooms r JOIN wa USING (room_id) JOIN rw USING (room_id) JOIN cw USING (room_id)""",
    "filtered_report": f"""WITH {_REQ} SELECT plan_id, count(DISTINCT floor_idx) AS n_floors, count(*) AS n_rooms, round(sum(area_m2), 6) AS area_m2, CAST(sum(coalesce(n_walls, 0)) AS BIGINT) AS n_walls
FROM req LEFT JOIN wa USING (room_id) WHERE area_m2 >= 10 AND usage = 'bedroom' GROUP BY plan_id""",
    "climate_zone": """SELECT event_id, CASE WHEN d <= 600 THEN 'A' WHEN d <= 900 THEN 'B' WHEN d <= 1400 THEN 'C' WHEN d <= 2100 THEN 'D' WHEN d <= 3000 THEN 'E' WHEN d IS NOT NULL THEN 'F' END AS zone
FROM (SELECT event_id, (value * 37.0::DOUBLE) % 3500 AS d FROM events)""",
}
