"""Heating and cooling requirements of rooms, and loads of buildings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The key of a room; a plan's rooms on other floors may share its room_id.
ROOM = ["plan_id", "floor_idx", "room_id"]

#: Label keywords in the order in which they are tried, with the room's usage.
USAGE_KEYWORDS = {
    "soggiorno": "living",
    "sala": "living",
    "salotto": "living",
    "living": "living",
    "camera": "bedroom",
    "stanza": "bedroom",
    "letto": "bedroom",
    "bagno": "bathroom",
    "wc": "bathroom",
    "cucina": "kitchen",
    "angolo cottura": "kitchen",
    "corridoio": "hallway",
    "ingresso": "hallway",
    "disimpegno": "hallway",
    "ripostiglio": "storage",
    "cantina": "storage",
    "garage": "garage",
    "box": "garage",
    "studio": "office",
    "ufficio": "office",
}
#: Degrees C wanted in a room of each usage.
TARGET_C = {
    "living": 20, "bedroom": 18, "bathroom": 22, "kitchen": 18, "hallway": 18,
    "storage": 14, "garage": 10, "office": 20, "unknown": 20,
}
#: Fixed values by climate zone: least degrees C outside, and watts a cubic metre.
LEAST_C = {"A": 5, "B": 0, "C": -5, "D": -10, "E": -15, "F": -20}
WATTS_M3 = {"A": 25, "B": 30, "C": 35, "D": 40, "E": 50, "F": 60}
#: Degree-days up to which each zone goes.
DEGREE_DAYS = {"A": 600, "B": 900, "C": 1400, "D": 2100, "E": 3000}


@dataclass(frozen=True)
class ThermalConfig:
    climate_zone: str = "E"
    insulation: float = 1.0
    window_ratio: float = 0.15
    ceiling_m: float = 2.7
    heating_factor: float = 1.2
    cooling_factor: float = 1.15


def lookup(key: Column, values: dict, default) -> Column:
    """A small fixed table as a CASE; ``default`` where the key is missing or null."""
    out = F.when(F.lit(False), F.lit(default))
    for k, v in values.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def room_usage(label: Column) -> Column:
    """Usage of the first keyword that the lower-cased label contains; unknown without one or for null."""
    low = F.lower(label)
    out = F.when(F.lit(False), F.lit("unknown"))
    for keyword, usage in USAGE_KEYWORDS.items():
        out = out.when(low.contains(keyword), F.lit(usage))
    return out.otherwise(F.lit("unknown"))


def climate_zone(degree_days: Column) -> Column:
    out = F.when(F.lit(False), F.lit("F"))
    for zone, upto in DEGREE_DAYS.items():
        out = out.when(degree_days <= upto, F.lit(zone))
    return F.when(degree_days.isNotNull(), out.otherwise(F.lit("F")))


def room_volume(area: Column, height: Column, ceiling_m: float) -> Column:
    """Area by height where both are above 0, else area by the usual ceiling height."""
    return F.when((area > 0) & (height > 0), area * height).otherwise(area * ceiling_m)


def wall_summary(walls: DataFrame) -> DataFrame:
    """One row a room: lengths, counts, the walls that radiators and cooling units go to, and the mean corner.

    Longest external wall (else longest of any kind) for radiators, longest internal one (else any) for cooling; the
    first in order wins ties. All from one aggregation, so walls are shuffled once and by partial results.
    """
    is_ext, is_int = F.col("wall_type") == "external", F.col("wall_type") == "internal"
    n = F.coalesce("length_m", F.lit(0.0))
    at = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("double").alias(c)  # noqa: E731  no point is (0, 0)
    rest = [(-n).alias("minus"), F.col("wall_idx"), F.col("side"), n.alias("length_m"), at("x1"), at("y1"), at("x2"), at("y2")]
    return walls.groupBy(*ROOM).agg(
        F.sum(F.when(is_ext, n).otherwise(0.0)).alias("ext_wall_m"),
        F.count("*").alias("n_walls"),
        F.count_if(is_ext).alias("n_external"),
        F.min(F.struct(F.when(is_ext, 0).otherwise(1).alias("rank"), *rest)).alias("radiator_wall"),
        F.min(F.struct(F.when(is_int, 0).otherwise(1).alias("rank"), *rest)).alias("cooling_wall"),
        F.avg("x1").alias("cx"),
        F.avg("y1").alias("cy"),
    )


def heating_watts(volume: Column, ext_m: Column, usage: Column, cfg: ThermalConfig) -> Column:
    load = volume * WATTS_M3.get(cfg.climate_zone, 40) * cfg.insulation
    load = load + F.when(ext_m > 0, ext_m * 10).otherwise(0.0)
    spread = (lookup(usage, TARGET_C, 20) - LEAST_C.get(cfg.climate_zone, -10)) / 30
    return F.bround(load * spread * cfg.heating_factor, 0)


def cooling_watts(volume: Column, area: Column, ext_m: Column, usage: Column, cfg: ThermalConfig) -> Column:
    load = volume * 30
    load = load + F.when(ext_m > 0, ext_m * cfg.ceiling_m * cfg.window_ratio * 250).otherwise(0.0)
    load = load + F.greatest(F.lit(1.0), area / 10) * 100
    share = F.when(usage == "bathroom", 0.8).when(usage.isin("storage", "garage"), 0.5).otherwise(1.0)
    return F.bround(load * share * cfg.cooling_factor, 0)


def thermal_requirements(rooms: DataFrame, walls: DataFrame, cfg: ThermalConfig = ThermalConfig()) -> DataFrame:
    """Rooms with volume, usage, loads in whole watts, target temperature and their ``wall_summary``."""
    area = F.coalesce("area_m2", F.lit(0.0))
    volume = room_volume(area, F.coalesce("height_m", F.lit(cfg.ceiling_m)), cfg.ceiling_m)
    known = rooms.withColumns({"area_m2": area, "volume_m3": volume, "usage": room_usage(F.col("label"))})
    joined = known.join(wall_summary(walls), ROOM, "left").withColumn("ext_wall_m", F.coalesce("ext_wall_m", F.lit(0.0)))
    volume, usage, ext = F.col("volume_m3"), F.col("usage"), F.col("ext_wall_m")
    return (
        joined.withColumn("heating_w", heating_watts(volume, ext, usage, cfg))
        .withColumn("cooling_w", cooling_watts(volume, F.col("area_m2"), ext, usage, cfg))
        .withColumn("target_c", lookup(usage, TARGET_C, 20))
        .withColumn("cx", F.coalesce("cx", F.lit(0.0)))
        .withColumn("cy", F.coalesce("cy", F.lit(0.0)))
    )


def kilowatts(watts: Column) -> Column:
    """Two decimals of kW from whole watts, ties to even."""
    return F.bround(watts / 10.0, 0) / 100


def building_loads(requirements: DataFrame) -> DataFrame:
    """Per plan: rooms, watts and kW of heating and cooling."""
    loads = requirements.groupBy("plan_id").agg(
        F.count("*").alias("n_rooms"), F.sum("heating_w").alias("heating_w"), F.sum("cooling_w").alias("cooling_w")
    )
    return loads.withColumn("heating_kw", kilowatts(F.col("heating_w"))).withColumn("cooling_kw", kilowatts(F.col("cooling_w")))
