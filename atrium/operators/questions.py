"""Questions about plans: areas, neighbours, sides and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium.operators.thermal import ROOM
from atrium.storage import spread


def room_area(rooms: DataFrame, label: str) -> DataFrame:
    """Rooms whose label holds ``label``, any case, with their areas."""
    return rooms.where(F.lower("label").contains(label.lower())).select(*ROOM, "label", "area_m2")


def adjacent_rooms(rooms: DataFrame, pairs: DataFrame, room_id) -> DataFrame:
    """Neighbours of a room by a table of undirected ``(plan_id, room_a, room_b)`` pairs."""
    other = F.when(F.col("room_a") == room_id, F.col("room_b")).when(F.col("room_b") == room_id, F.col("room_a"))
    found = pairs.select("plan_id", other.alias("room_id")).where("room_id IS NOT NULL").distinct()
    return rooms.join(spread(found), ["plan_id", "room_id"])


def rooms_facing(rooms: DataFrame, walls: DataFrame, side: str) -> DataFrame:
    """Rooms with an external wall on ``side``."""
    facing = walls.where((F.col("side") == side) & (F.col("wall_type") == "external"))
    return rooms.join(facing.select(*ROOM), ROOM, "left_semi")


def floor_areas(rooms: DataFrame) -> DataFrame:
    return rooms.groupBy("plan_id", "floor_idx").agg(F.count("*").alias("n_rooms"), F.sum("area_m2").alias("area_m2"))


def building_summary(rooms: DataFrame, walls: DataFrame, where: Column | None = None) -> DataFrame:
    """Per plan: floors, rooms, area and walls of the rooms that ``where`` keeps."""
    rooms = rooms if where is None else rooms.where(where)
    n = walls.groupBy(*ROOM).agg(F.count("*").alias("n_walls"))
    joined = rooms.join(n, ROOM, "left")
    return joined.groupBy("plan_id").agg(
        F.count_distinct("floor_idx").alias("n_floors"), F.count("*").alias("n_rooms"), F.sum("area_m2").alias("area_m2"),
        F.sum(F.coalesce("n_walls", F.lit(0))).alias("n_walls"),
    )
