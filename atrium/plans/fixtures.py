"""Plan tables derived from the general test tables; the same SQL text runs in Spark and DuckDB.

A customer is a building and an order a room; line items are its walls. Events are text boxes of plan ``user_id``.
Each order also gives a floor plan of its own: an outer rectangle with up to three dividing walls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOMS_FX = """
SELECT o_custkey AS plan_id, CAST(o_orderkey % 3 AS INT) AS floor_idx, o_orderkey AS room_id,
 CASE CAST(o_orderkey % 12 AS INT) WHEN 0 THEN 'Soggiorno' WHEN 1 THEN 'Camera Letto' WHEN 2 THEN 'Bagno'
  WHEN 3 THEN 'Cucina' WHEN 4 THEN 'Corridoio' WHEN 5 THEN 'Ripostiglio' WHEN 6 THEN 'Garage' WHEN 7 THEN 'Studio'
  WHEN 8 THEN 'Camera da Bagno' WHEN 9 THEN 'Angolo Cottura' WHEN 10 THEN 'Balcone' ELSE NULL END AS label,
 CAST(o_totalprice AS DOUBLE) / 10000.0 AS area_m2,
 CASE WHEN o_orderkey % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(2.7 AS DOUBLE) END AS height_m
FROM orders
"""

WALLS_FX = """
SELECT l_orderkey AS room_id,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) - 1 AS INT) AS wall_idx,
 CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN 'north' WHEN 1 THEN 'east' WHEN 2 THEN 'south' ELSE 'west' END AS side,
 CASE l_returnflag WHEN 'A' THEN 'external' WHEN 'N' THEN 'internal' ELSE 'unknown' END AS wall_type,
 CAST(l_quantity AS DOUBLE) / 8.0 AS length_m,
 CAST(l_partkey % 400 AS DOUBLE) AS x1, CAST(l_suppkey % 300 AS DOUBLE) AS y1,
 CAST(l_partkey % 400 + l_quantity AS DOUBLE) AS x2, CAST(l_suppkey % 300 AS DOUBLE) AS y2
FROM lineitem
"""

TEXT_FX = """
SELECT user_id AS plan_id, event_id AS block_id,
 CASE event_type WHEN 'view' THEN 'Soggiorno' WHEN 'click' THEN 'BAGNO' WHEN 'purchase' THEN 'Camera'
  WHEN 'signup' THEN 'x1' ELSE 'Ripostiglio.' END AS text,
 CAST((event_id * 37) % 400 AS INT) AS x, CAST((event_id * 53) % 170 AS INT) AS y,
 CAST(20 + event_id % 60 AS INT) AS w, CAST(8 + event_id % 12 AS INT) AS h,
 CAST(event_id * 31 % 101 AS DOUBLE) AS confidence
FROM events
"""

GRID_FX = """
WITH p AS (SELECT o_orderkey AS plan_id, CAST(200 + 10*(o_orderkey % 20) AS DOUBLE) AS w,
                  CAST(100 + 10*(o_orderkey % 7) AS DOUBLE) AS h, CAST(o_orderkey % 4 AS INT) AS nd FROM orders)
SELECT plan_id, CAST(0 AS INT) AS seg_id, CAST(0 AS DOUBLE) AS x1, CAST(0 AS DOUBLE) AS y1, w AS x2, CAST(0 AS DOUBLE) AS y2 FROM p
UNION ALL SELECT plan_id, 1, w, CAST(0 AS DOUBLE), w, h FROM p
UNION ALL SELECT plan_id, 2, w, h, CAST(0 AS DOUBLE), h FROM p
UNION ALL SELECT plan_id, 3, CAST(0 AS DOUBLE), h, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM p
UNION ALL SELECT plan_id, CAST(3 + k AS INT), w*k/(nd+1), CAST(0 AS DOUBLE), w*k/(nd+1), h
  FROM p JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) q ON q.k <= p.nd
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rooms_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(plan_id, floor_idx, room_id, room_ord, label, area_m2, height_m)``; document order is that of ids."""
    sql = ROOMS_FX.replace("FROM orders", "FROM {orders}")
    return spark.sql(sql, orders=_table(spark, sf_dir, "orders")).selectExpr("*", "room_id AS room_ord")


def walls_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(plan_id, floor_idx, room_id, wall_idx, side, wall_type, length_m, x1, y1, x2, y2)``."""
    sql = WALLS_FX.replace("FROM lineitem", "FROM {lineitem}")
    walls = spark.sql(sql, lineitem=_table(spark, sf_dir, "lineitem"))
    keys = rooms_fx(spark, sf_dir).select("plan_id", "floor_idx", "room_id")
    return walls.join(keys, "room_id")


def text_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TEXT_FX.replace("FROM events", "FROM {events}"), events=_table(spark, sf_dir, "events")).selectExpr("*", "0 AS floor_id")


def grid_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``GRID_FX`` in one scan."""
    key = F.col("o_orderkey")
    plans = _table(spark, sf_dir, "orders").select(
        key.alias("plan_id"), (200 + 10 * (key % 20)).cast("double").alias("w"), (100 + 10 * (key % 7)).cast("double").alias("h"), (key % 4).cast("int").alias("nd")
    )
    zero, w, h = F.lit(0.0), F.col("w"), F.col("h")

    def wall(n: int, *xy) -> Column:
        return F.struct(F.lit(n).alias("seg_id"), *[v.alias(c) for v, c in zip(xy, ("x1", "y1", "x2", "y2"), strict=True)])

    outer = [wall(0, zero, zero, w, zero), wall(1, w, zero, w, h), wall(2, w, h, zero, h), wall(3, zero, h, zero, zero)]
    at = [w * k / (F.col("nd") + 1) for k in (1, 2, 3)]
    every = F.array(*outer, *[wall(4 + k, x, zero, x, h) for k, x in enumerate(at)])
    return plans.select("plan_id", F.inline(F.slice(every, F.lit(1), F.col("nd") + 4))).withColumn("floor_id", F.lit(0))


def _segments(plans: DataFrame, walls: list[tuple]) -> DataFrame:
    """A segment for each ``(condition, x1, y1, x2, y2)`` that holds in a plan, numbered as they stand here."""
    every = [
        F.when(F.lit(True) if where is None else where, F.struct(F.lit(n).alias("seg_id"), *[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(c) for v, c in zip(xy, ("x1", "y1", "x2", "y2"), strict=True)]))
        for n, (where, *xy) in enumerate(walls)
    ]
    return plans.select("plan_id", F.inline(F.filter(F.array(*every), lambda s: s.isNotNull()))).withColumn("floor_id", F.lit(0))


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(key.alias("plan_id"), (200 + 10 * (key % 20)).cast("double").alias("w"), (100 + 10 * (key % 7)).cast("double").alias("h"))


def _rectangle(x, y, w, h, where=None) -> list[tuple]:
    return [(where, x, y, x + w, y), (where, x + w, y, x + w, y + h), (where, x + w, y + h, x, y + h), (where, x, y + h, x, y)]


def irregular_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle with a diagonal and a wall from below up to it; in some plans a box within, a box apart, a wall that leads
    nowhere and a wall alone."""
    key, w, h = F.col("plan_id"), F.col("w"), F.col("h")
    walls = [*_rectangle(F.lit(0.0), F.lit(0.0), w, h), (None, 0, 0, w, h), (None, w / 2, 0, w / 2, h / 2)]
    walls += _rectangle(F.lit(10.0), h - 40, 50, 30, key % 2 == 0) + _rectangle(w + 50, F.lit(0.0), 100, 40, key % 3 == 0)
    walls += [(key % 5 == 0, w / 2, h, w / 2, h + 30), (key % 7 == 0, -50, 10, -50, 60)]
    return _segments(_plans(spark, sf_dir), walls)


def gap_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles whose right wall stands 1.2 further out, in another grid cell than the ends that it should meet."""
    w, h = F.col("w"), F.col("h")
    return _segments(_plans(spark, sf_dir), [(None, 0, 0, w, 0), (None, w + 1.2, 0, w + 1.2, h), (None, w, h, 0, h), (None, 0, h, 0, 0)])


def strokes_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes of two walls: a straight one drawn first, last, middle; and one that bends by 4 degrees twice."""
    out = F.col("plan_id") % 5 * 10
    walls = [(None, -out, 0, 100, 0), (None, 205, 0, 300, 0), (None, 105, 0, 200, 0), (None, 0, 500, 100, 500), (None, 100, 500, 200, 507), (None, 200, 507, 300, 521)]
    return _segments(_plans(spark, sf_dir), walls)
