"""Radiators, cooling units, boilers and pipes of buildings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atrium.functions.geometry import distance, orthogonal_path
from atrium.operators.thermal import building_loads

#: Profiles in the order in which they are tried, watts an element, height and depth in mm.
PROFILES = {"standard": (120, 600, 100), "low": (80, 300, 100), "tall": (160, 900, 100)}
ELEMENT_MM = 80
#: Boiler sizes in kW, and words of labels of rooms for a boiler.
BOILER_KW = (12, 18, 24, 28, 32, 35, 40, 50, 60, 80, 100)
BOILER_ROOMS = ("caldaia", "centrale", "tecnico", "garage", "cantina", "cucina")


@dataclass(frozen=True)
class PlacementConfig:
    max_width_mm: int = 2000
    wall_clearance_mm: int = 50
    default_wall_m: float = 3.0


@dataclass(frozen=True)
class PipeConfig:
    """layout: two_pipe, one_pipe or radial (which is routed as two_pipe)."""

    layout: str = "two_pipe"
    main_mm: int = 28
    branch_mm: int = 20


@dataclass(frozen=True)
class BoilerConfig:
    room_id: str | None = None
    fuel: str = "gas"
    hot_water: float = 0.15


def radiator_profile(watts: Column, wall_m: Column, cfg: PlacementConfig = PlacementConfig()) -> Column:
    """(profile, n_elements): the first profile whose elements fit the wall, else the first of all."""
    room = F.least(F.lit(float(cfg.max_width_mm)), wall_m * 1000 - 2 * cfg.wall_clearance_mm)
    count = lambda k: F.ceil(watts / PROFILES[k][0]).cast("int")
    choice = lambda k: F.struct(F.lit(k).alias("profile"), count(k).alias("n_elements"))
    out = F.when(F.lit(False), choice("standard"))
    for k in PROFILES:
        out = out.when(count(k) * ELEMENT_MM <= room, choice(k))
    return out.otherwise(choice("standard"))


def _numbered(df: DataFrame, prefix: str, *order: str) -> DataFrame:
    """``no`` in document order within the plan, and the id made of it."""
    df = df.withColumn("no", F.row_number().over(Window.partitionBy("plan_id").orderBy(*order)))
    digits = F.when(F.col("no") < 1000, F.lpad(F.col("no").cast("string"), 3, "0")).otherwise(F.col("no").cast("string"))
    return df.withColumn("id", F.concat(F.lit(prefix), digits))


def place_radiators(requirements: DataFrame, cfg: PlacementConfig = PlacementConfig()) -> DataFrame:
    """One row a radiator; a room's elements are split where one radiator would be too wide. No load, no radiator."""
    most, wall = cfg.max_width_mm // ELEMENT_MM, F.col("radiator_wall")
    rows = requirements.withColumn("p", radiator_profile(F.col("heating_w"), F.coalesce(wall["length_m"], F.lit(cfg.default_wall_m)), cfg))
    rows = rows.where(F.col("p.n_elements") > 0)
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("p.n_elements") / most) - 1).cast("int"))))
    n = F.least(F.lit(most), F.col("p.n_elements") - F.col("part") * most)
    value = lambda i: F.coalesce(*[F.when(F.col("p.profile") == k, F.lit(v[i])) for k, v in PROFILES.items()])
    x = F.coalesce((wall["x1"] + wall["x2"]) / 2, F.col("cx")) + F.col("part") * 0.5
    y = F.coalesce((wall["y1"] + wall["y2"]) / 2, F.col("cy"))
    rows = _numbered(rows, "RAD_", "floor_idx", "room_ord", "part")
    return rows.select(
        "plan_id", "floor_idx", "room_id", "no", "id", x.alias("x"), y.alias("y"), (n * ELEMENT_MM).alias("width_mm"),
        value(1).alias("height_mm"), value(2).alias("depth_mm"), (n * value(0)).alias("power_w"), n.alias("n_elements"),
        F.coalesce(wall["side"], F.lit("unknown")).alias("wall_side"),
    )


def place_cooling(requirements: DataFrame) -> DataFrame:
    """One split unit a room, but for store rooms, garages and hallways."""
    wall = F.col("cooling_wall")
    rows = _numbered(requirements.where(~F.col("usage").isin("storage", "garage", "hallway")), "AC_", "floor_idx", "room_ord")
    return rows.select(
        "plan_id", "floor_idx", "room_id", "no", "id", F.coalesce((wall["x1"] + wall["x2"]) / 2, F.col("cx")).alias("x"),
        F.coalesce((wall["y1"] + wall["y2"]) / 2, F.col("cy")).alias("y"), F.lit("split_ac").alias("type"),
        F.col("cooling_w"), (F.col("cooling_w") * 1.1).alias("heating_w"), F.lit(800).alias("width_mm"),
        F.lit(290).alias("height_mm"), F.lit(200).alias("depth_mm"), F.coalesce(wall["side"], F.lit("unknown")).alias("wall_side"),
    )


def boiler_size(heating_kw: Column, hot_water: float = 0.15) -> Column:
    """The least standard size with room for hot water, else the next 10 kW."""
    need = heating_kw + heating_kw * hot_water
    out = F.when(F.lit(False), F.lit(0))
    for size in BOILER_KW:
        out = out.when(need <= size, F.lit(size))
    return out.otherwise((F.ceil(need / 10) * 10).cast("int"))


def boiler_rooms(rooms: DataFrame, cfg: BoilerConfig = BoilerConfig()) -> DataFrame:
    """Per plan ``(room_id, x, y)``: the first room in document order with a fitting label, else the first of all.

    With a fixed room_id: that room, at (0, 0) where the plan lacks it.
    """
    first = F.struct("floor_idx", "room_ord", "room_id", "cx", "cy")
    if cfg.room_id is not None:
        hit = F.col("room_id").cast("string") == cfg.room_id
        found = rooms.groupBy("plan_id").agg(F.min(F.when(hit, first)).alias("r"))
        room_id = F.lit(cfg.room_id).cast(rooms.schema["room_id"].dataType)
    else:
        low = F.lower(F.coalesce("label", F.lit("")))
        fits = F.when(F.greatest(*[low.contains(k) for k in BOILER_ROOMS]), 0).otherwise(1)
        found = rooms.groupBy("plan_id").agg(F.min(F.struct(fits.alias("other"), *[F.col(c) for c in ("floor_idx", "room_ord", "room_id", "cx", "cy")])).alias("r"))
        room_id = F.col("r.room_id")
    zero = F.lit(0.0)
    return found.select("plan_id", room_id.alias("room_id"), F.coalesce("r.cx", zero).alias("x"), F.coalesce("r.cy", zero).alias("y"))


def boilers(requirements: DataFrame, cfg: BoilerConfig = BoilerConfig()) -> DataFrame:
    loads = building_loads(requirements)
    size = boiler_size(F.col("heating_kw"), cfg.hot_water)
    return boiler_rooms(requirements, cfg).join(loads, "plan_id").select(
        "plan_id", F.lit("BOILER_001").alias("id"), "room_id", "x", "y", size.alias("power_kw"), F.lit(cfg.fuel).alias("fuel"),
        "heating_kw", "cooling_kw",
    )


def route_pipes(radiators: DataFrame, plant: DataFrame, cfg: PipeConfig = PipeConfig()) -> DataFrame:
    """One row a pipe with its path and length; radiators are taken by distance from the boiler.

    Two pipes: supply from the radiator before (first from the boiler), return to the boiler, numbered in turn.
    One pipe: a chain from the boiler and back. Plans without radiators have no pipes.
    """
    b = plant.select("plan_id", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("id").alias("boiler"))
    rows = radiators.select("plan_id", "no", "id", "x", "y").join(b, "plan_id")
    near = Window.partitionBy("plan_id").orderBy(distance(F.col("bx"), F.col("by"), F.col("x"), F.col("y")), "no")
    rows = rows.select(
        "*", F.row_number().over(near).alias("k"), F.coalesce(F.lag("x").over(near), "bx").alias("px"),
        F.coalesce(F.lag("y").over(near), "by").alias("py"), F.coalesce(F.lag("id").over(near), "boiler").alias("pid"),
        F.lead("id").over(near).isNull().alias("last"),
    )

    def pipe(no, kind, source, dest, mm, sx, sy, ex, ey) -> Column:
        return F.struct(
            no.cast("long").alias("no"), F.lit(kind).alias("pipe_type"), source.alias("source_id"), dest.alias("destination_id"),
            F.lit(mm).alias("diameter_mm"), orthogonal_path(sx, sy, ex, ey).alias("path"),
            (F.abs(ex - sx) + F.abs(ey - sy)).alias("length_units"),
        )

    c = F.col
    if cfg.layout == "one_pipe":
        out = F.array(pipe(c("k"), "hot_water_supply", c("pid"), c("id"), cfg.main_mm, c("px"), c("py"), c("x"), c("y")))
        back = F.array(pipe(c("k") + 1, "hot_water_return", c("id"), c("boiler"), cfg.main_mm, c("x"), c("y"), c("bx"), c("by")))
        every = F.when(c("last"), F.concat(out, back)).otherwise(out)
    else:
        every = F.array(
            pipe(2 * c("k") - 1, "hot_water_supply", c("boiler"), c("id"), cfg.branch_mm, c("px"), c("py"), c("x"), c("y")),
            pipe(2 * c("k"), "hot_water_return", c("id"), c("boiler"), cfg.branch_mm, c("x") + 0.05, c("y"), c("bx") + 0.1, c("by")),
        )
    out = rows.select("plan_id", F.inline(every))
    digits = F.when(F.col("no") < 1000, F.lpad(F.col("no").cast("string"), 3, "0")).otherwise(F.col("no").cast("string"))
    return out.withColumn("id", F.concat(F.lit("PIPE_"), digits))


def pipe_segments(pipes: DataFrame) -> DataFrame:
    """One row a straight piece of a pipe."""
    steps = F.transform(F.slice("path", F.lit(1), F.size("path") - 1), lambda p, i: F.struct(
        i.alias("segment"), p["x"].alias("x1"), p["y"].alias("y1"),
        F.get("path", i + 1)["x"].alias("x2"), F.get("path", i + 1)["y"].alias("y2"),
    ))
    return pipes.select("plan_id", "id", "pipe_type", "diameter_mm", F.inline(steps))


def pipe_lengths(pipes: DataFrame) -> DataFrame:
    """Per plan: supply, return and all, two decimals."""
    of = lambda end: F.sum(F.when(F.col("pipe_type").endswith(end), F.col("length_units")).otherwise(0.0))
    sums = pipes.groupBy("plan_id").agg(of("supply").alias("s"), of("return").alias("r"), F.count("*").alias("n_pipes"))
    return sums.select(
        "plan_id", "n_pipes", F.round("s", 2).alias("supply_units"), F.round("r", 2).alias("return_units"),
        F.round(F.col("s") + F.col("r"), 2).alias("total_units"),
    )


def hvac_totals(requirements: DataFrame, radiators: DataFrame, units: DataFrame, pipes: DataFrame) -> DataFrame:
    """Per plan: loads and counts; 0 where a plan has none."""
    out = building_loads(requirements).select("plan_id", "heating_kw", "cooling_kw")
    out = out.join(radiators.groupBy("plan_id").agg(F.count("*").alias("n_radiators")), "plan_id", "left")
    out = out.join(units.groupBy("plan_id").agg(F.count("*").alias("n_ac_units")), "plan_id", "left")
    out = out.join(pipe_lengths(pipes).select("plan_id", F.col("total_units").alias("pipe_units")), "plan_id", "left")
    return out.fillna(0, ["n_radiators", "n_ac_units"]).fillna(0.0, ["pipe_units"])


def hvac_system(requirements: DataFrame, placement=PlacementConfig(), pipe=PipeConfig(), boiler=BoilerConfig(), heating: bool = True, cooling: bool = True) -> dict[str, DataFrame]:
    """All tables of a heating and cooling plan; a switched-off half has no rows."""
    radiators = place_radiators(requirements, placement)
    units = place_cooling(requirements)
    if not heating:
        radiators = radiators.where(F.lit(False))
    if not cooling:
        units = units.where(F.lit(False))
    plant = boilers(requirements, boiler)
    pipes = route_pipes(radiators, plant, pipe)
    totals = hvac_totals(requirements, radiators, units, pipes)
    return {"radiators": radiators, "ac_units": units, "boilers": plant, "pipes": pipes, "totals": totals}
