"""Large and lopsided floors: the same results as loops, without comparing a floor with itself or holding it in one task."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from atrium.operators import choices, grids, labels, merging, segments, topology
from atrium.operators.numbering import numbered, running

XY = ["x1", "y1", "x2", "y2"]
SEGMENTS = "plan_id long, floor_id int, seg_id long, x1 double, y1 double, x2 double, y2 double"


def _frame(spark, rows, floor=0):
    return spark.createDataFrame([(1, floor, i, *map(float, r)) for i, r in enumerate(rows)], SEGMENTS)


def _short(spark, n, extra=None):
    """``n`` short segments at pseudo-random places, made by Spark; ``extra`` gives the columns of some more."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1_000_000)) / 1e6
    size = math.sqrt(n) * 10
    base = spark.range(n).select(F.lit(1).cast("long").alias("plan_id"), F.lit(0).alias("floor_id"), F.col("id").alias("seg_id"), (u(1) * size).alias("x1"), (u(2) * size).alias("y1"), u(3).alias("dx"), u(4).alias("dy"))
    base = base.select("plan_id", "floor_id", "seg_id", "x1", "y1", (F.col("x1") + F.col("dx") * 8 - 4).alias("x2"), (F.col("y1") + F.col("dy") * 8 - 4).alias("y2"))
    return base if extra is None else base.unionByName(extra)


def _cross(rows):
    s = np.array(rows, dtype=float)
    out = set()
    for i in range(len(s)):
        x1, y1, x2, y2 = s[i]
        x3, y3, x4, y4 = s[i + 1 :].T
        den = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
        ok = np.abs(den) >= 1e-10
        safe = np.where(ok, den, 1)
        t, u = ((x1 - x3) * (y3 - y4) - (y1 - y3) * (x3 - x4)) / safe, -((x1 - x2) * (y1 - y3) - (y1 - y2) * (x1 - x3)) / safe
        out |= {(i, i + 1 + int(j)) for j in np.flatnonzero(ok & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1))}
    return out


@pytest.mark.parametrize("crowd", [4, 32])
def test_lopsided_floor(spark, crowd):
    rng = random.Random(2)
    rows = [(x := rng.uniform(0, 300), y := rng.uniform(0, 300), x + rng.uniform(-20, 20), y + rng.uniform(-20, 20)) for _ in range(250)]
    rows += [(100 + 0.05 * i, 100, 101 + 0.05 * i, 110) for i in range(150)]  # a hatch
    rows += [(90, 100 + 0.05 * i, 112, 100.3 + 0.05 * i) for i in range(80)]  # lines across it: a cut gains little
    rows += [(1e7, 1e7, 1e7 + 5, 1e7), (0, 0, 1e7, 1e7), (-3e6, 50, 400, 50), (150, -10, 150, 320)]
    got = [(r["seg_a"], r["seg_b"]) for r in segments.find_intersections(_frame(spark, rows), crowd).collect()]
    assert len(got) == len(set(got)) and set(got) == _cross(rows)


def test_outliers_and_hatches_cost_little(spark):
    took = []
    n = 100_000
    hatch = spark.range(20_000).select(
        F.lit(1).cast("long").alias("plan_id"), F.lit(0).alias("floor_id"), (F.col("id") + 10_000_000).alias("seg_id"), (F.col("id") * 0.05).alias("x1"), F.lit(-50.0).alias("y1"),
        (F.col("id") * 0.05 + 1).alias("x2"), F.lit(-40.0).alias("y2"),
    )
    stray = hatch.where("seg_id < 10000003").selectExpr("plan_id", "floor_id", "seg_id + 20000000 AS seg_id", "x1 + 1e8 AS x1", "y1 - 1e8 AS y1", "x2 + 1e8 AS x2", "y2 - 1e8 AS y2")
    segments.find_intersections(_short(spark, 2000)).count()
    for frame in (_short(spark, n + 20_000), _short(spark, n, hatch.unionByName(stray))):
        began = time.perf_counter()
        segments.find_intersections(frame).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    assert took[1] < 2 * took[0] + 5


def test_boxes_of_a_large_floor(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.randrange(400), rng.randrange(200), rng.randrange(1, 60), rng.randrange(1, 20), float(rng.randrange(60))) for i in range(300)]
    rows.append((300, "a", 10**8, 5, 10, 10, 5.0))
    df = spark.createDataFrame([(1, 0, *r) for r in rows], "plan_id long, floor_id int, block_id long, text string, x int, y int, w int, h int, confidence double")
    pairs = lambda crowd: sorted((r["a_block_id"], r["b_block_id"]) for r in labels.overlap_pairs(df, crowd=crowd).collect())
    assert pairs(8) == pairs(10_000)


# --- numbers and choices


def test_numbers_of_a_large_group(spark):
    rows = [(1, i % 7, i, i % 3) for i in range(2000)] + [(2, 0, i, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, a int, b int, v int").repartition(6)
    got = {(r["k"], r["a"], r["b"]): (r["n"], r["s"]) for r in running(numbered(df, ["k"], ["a", "b"], "n"), ["k"], ["a", "b"], F.col("v"), "s").collect()}
    for k in (1, 2):
        total = 0
        for n, (_, a, b, v) in enumerate(sorted(r for r in rows if r[0] == k)):
            assert got[(k, a, b)] == (n, total)
            total += v


def _gone(pairs):
    out = set()
    for a, b in sorted(pairs, key=lambda p: (p[1], p[0])):
        if a not in out:
            out.add(b)
    return out


@pytest.mark.parametrize("most", [50_000, 20])
def test_choices_in_parts(spark, most):
    rng = random.Random(most)
    pairs = {(min(p), max(p)) for p in ((rng.randrange(120), rng.randrange(120)) for _ in range(150)) if p[0] != p[1]}
    pairs |= {(200 + i, 201 + i) for i in range(30)} | {(300, 301 + i) for i in range(30)}
    df = spark.createDataFrame([(1, 0, a, b) for a, b in pairs] + [(2, 0, 1, 2)], "plan_id long, floor_id int, a long, b long").withColumn("rank", F.col("b"))
    got = [(r["plan_id"], r["node"]) for r in choices.beaten(df, ["rank"], most).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(1, b) for b in _gone(pairs)} | {(2, 2)}


def test_chain_of_boxes(spark):
    """Each box overlaps the next, surest first: every second one stays, in one go."""
    n = 5000
    df = spark.range(n).select(
        F.lit(1).cast("long").alias("plan_id"), F.lit(0).alias("floor_id"), F.col("id").alias("block_id"), F.col("id").cast("string").alias("text"), (F.col("id") * 10).cast("int").alias("x"),
        F.lit(0).alias("y"), F.lit(25).alias("w"), F.lit(10).alias("h"), (100 - F.col("id") / n * 50).alias("confidence"),
    )
    assert sorted(r["block_id"] for r in labels.dedupe_text(df).select("block_id").collect()) == list(range(0, n, 2))


# --- merging


def _strokes(n, seed=8):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x, y, a = 200 * rng.randrange(12) + rng.uniform(0, 60), 200 * rng.randrange(12) + rng.uniform(0, 20), math.radians(rng.choice([0, 2, 90, 91]))
        size = rng.uniform(5, 30)
        rows.append((x, y, x + size * math.cos(a), y + size * math.sin(a)))
    return rows


def test_merging_by_parts_of_a_floor(spark):
    frame = _frame(spark, _strokes(600)).unionByName(_frame(spark, _strokes(20, 9), floor=1))
    whole, parts = segments.MergeConfig(), segments.MergeConfig(most_together=25)
    lines = lambda cfg: sorted(tuple(r) for r in segments.merge_collinear(frame, cfg).select("floor_id", "seg_id", *XY).collect())
    assert lines(whole) == lines(parts)
    assert 100 < len(lines(whole)) < 600


def test_groups_merge_in_step():
    rng = random.Random(11)
    cfg = segments.MergeConfig()
    groups = [np.array(_strokes(rng.randrange(1, 40), k)) for k in range(30)]
    together, place = merging.merge(np.concatenate(groups), np.repeat(np.arange(30), [len(g) for g in groups]), cfg)
    alone = [merging.merge(g, np.zeros(len(g), dtype=int), cfg)[0] for g in groups]
    assert np.array_equal(together, np.concatenate(alone)) and (np.diff(place) > 0).all()
    assert len(merging.merge(np.zeros((0, 4)), np.zeros(0, dtype=int), cfg)[0]) == 0


# --- texts in rooms


def _inside(px, py, edges):
    hit = False
    for _, ox, oy, dx, dy in edges:
        if (dy > py) != (oy > py) and px < (ox - dx) * (py - dy) / (oy - dy + 1e-12) + dx:
            hit = not hit
    return hit


@pytest.mark.parametrize("block", [3, 4096])
def test_texts_by_heights(spark, block):
    rng = random.Random(5)
    rooms = {}
    for f in range(40):
        points = [(rng.uniform(0, 300), rng.choice([rng.uniform(0, 300), rng.randrange(0, 300, 50)])) for _ in range(rng.randrange(3, 7))]
        rooms[f] = [(f, *p, *q) for p, q in zip(points, points[1:] + points[:1])]
    texts = [(i, rng.randrange(300), rng.randrange(0, 300, rng.choice([1, 50])), 2 * rng.randrange(10), 2 * rng.randrange(10)) for i in range(120)]
    edges = spark.createDataFrame([(1, 0, e[0], *map(float, e[1:])) for es in rooms.values() for e in es], "plan_id long, floor_id int, face long, ox double, oy double, dx double, dy double")
    blocks = spark.createDataFrame([(1, 0, *t) for t in texts], "plan_id long, floor_id int, block_id long, x int, y int, w int, h int")
    got = {r["block_id"]: r["face"] for r in labels.text_in_rooms(blocks, edges, most=0, block=block).collect()}
    want = {}
    for i, x, y, w, h in texts:
        held = [f for f, es in rooms.items() if _inside(x + w / 2, y + h / 2, es)]
        if held:
            want[i] = min(held)
    assert got == want
    assert {r["block_id"]: r["face"] for r in labels.text_in_rooms(blocks, edges).collect()} == want


# --- topology


@pytest.mark.parametrize("snapping", ["grid", "nearest"])
def test_floors_in_many_tasks(spark, snapping):
    rng = random.Random(7)
    rows = []
    for i in range(60):
        x, y = 60 * (i % 8), 60 * (i // 8)
        jig = lambda: rng.uniform(-1.2, 1.2)
        rows += [(x + jig(), y + jig(), x + 60 + jig(), y + jig()), (x + jig(), y + jig(), x + jig(), y + 60 + jig())]
    frame = _frame(spark, rows)
    options = dict(snapping=snapping, snap=3.0)
    small = topology.build_topology(frame, topology.TopologyConfig(**options))
    large = topology.build_topology(frame, topology.TopologyConfig(most_pieces=5, **options))
    names = ["e", "twin", "next", "origin", "dest", "ox", "oy", "face", "is_external"]
    rows_of = lambda t: sorted(map(str, t.edges.select(*names).collect()))
    assert large.large is not None and rows_of(small) == rows_of(large)
    assert topology.euler(small).drop("plan_id").collect() == topology.euler(large).drop("plan_id").collect()


def test_parts_of_a_drawing(spark):
    box = lambda x: [(x, 0, x + 50, 0), (x + 50, 0, x + 50, 50), (x + 50, 50, x, 50), (x, 50, x, 0)]
    found = topology.euler(topology.build_topology(_frame(spark, [*box(0), *box(100), (200, 0, 240, 0), (25, 50, 25, 80)]))).first()
    assert (found["parts"], found["euler"], found["is_valid"], found["parts_valid"]) == (3, 5, False, False)
    found = topology.euler(topology.build_topology(_frame(spark, [*box(0), *box(100)]))).first()
    assert (found["parts"], found["is_valid"], found["parts_valid"]) == (2, False, True)


def test_large_floors_are_named(spark):
    df = spark.createDataFrame([(1, 0)] * 5 + [(2, 0)] * 2, "plan_id long, floor_id int")
    assert [r["plan_id"] for r in grids.large_floors(df, 3).collect()] == [1]
    assert grids.large_floors(df, 5) is None
