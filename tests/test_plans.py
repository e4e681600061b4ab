"""Hand-worked cases and properties of the plan operators."""

import hashlib
import json
import math
import random
import time
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from atrium.functions import scale, text
from atrium.operators import hvac, labels, questions, segments, thermal, topology
from atrium.operators.components import connected_components
from atrium.plans import file_queries, fixtures, geometry_queries
from atrium.sources import candidates, models

SF = "/root/testdata/sf0.001"


def _segments(spark, rows):
    return spark.createDataFrame([(1, 0, i, *map(float, r)) for i, r in enumerate(rows)], "plan_id long, floor_id int, seg_id long, x1 double, y1 double, x2 double, y2 double")


def _room(spark, label="Soggiorno", area=12.0, walls=((0, "north", "external", 4.0, 0.0, 0.0, 0.0, 0.0),)):
    rooms = spark.createDataFrame([(1, 0, "room_1", 0, label, area, 2.7)], "plan_id long, floor_idx int, room_id string, room_ord int, label string, area_m2 double, height_m double")
    w = spark.createDataFrame([(1, 0, "room_1", *x) for x in walls], "plan_id long, floor_idx int, room_id string, wall_idx int, side string, wall_type string, length_m double, x1 double, y1 double, x2 double, y2 double")
    return rooms, w


def test_one_room(spark):
    req = thermal.thermal_requirements(*_room(spark)).withColumns({"cx": F.lit(200.0), "cy": F.lit(150.0)})
    row = req.first()
    assert (row["usage"], row["target_c"], row["heating_w"], row["cooling_w"]) == ("living", 20, 2324.0, 1722.0)
    system = hvac.hvac_system(req)
    rad = system["radiators"].collect()
    assert [(r["id"], r["n_elements"], r["width_mm"], r["power_w"], r["x"], r["y"]) for r in rad] == [("RAD_001", 20, 1600, 2400, 0.0, 0.0)]
    unit = system["ac_units"].first()
    assert unit["cooling_w"] == 1722.0 and unit["heating_w"] == pytest.approx(1894.2)
    boiler = system["boilers"].first()
    assert (boiler["power_kw"], boiler["room_id"], boiler["x"], boiler["y"]) == (12, "room_1", 200.0, 150.0)
    lengths = hvac.pipe_lengths(system["pipes"]).first()
    assert (lengths["supply_units"], lengths["return_units"], lengths["total_units"]) == (350.0, 350.05, 700.05)
    one = hvac.pipe_lengths(hvac.route_pipes(system["radiators"], system["boilers"], hvac.PipeConfig(layout="one_pipe"))).first()
    assert (one["supply_units"], one["return_units"]) == (350.0, 350.0)
    off = hvac.hvac_system(req, heating=False)
    assert off["radiators"].count() == 0 and off["totals"].first()["n_radiators"] == 0


def test_no_walls_and_null_label(spark):
    rooms, walls = _room(spark, label=None)
    req = thermal.thermal_requirements(rooms, walls.where("false"))
    row = req.first()
    assert row["usage"] == "unknown" and row["ext_wall_m"] == 0.0
    rad = hvac.place_radiators(req).first()
    assert (rad["x"], rad["y"], rad["wall_side"]) == (0.0, 0.0, "unknown")


def test_profiles(spark):
    rows = spark.createDataFrame([(2324.0, 4.0), (2324.0, 1.5), (7200.0, 5.0), (0.0, 3.0)], "w double, m double")
    found = [tuple(r["p"]) for r in rows.select(hvac.radiator_profile(F.col("w"), F.col("m")).alias("p")).collect()]
    assert found == [("standard", 20), ("tall", 15), ("standard", 60), ("standard", 0)]


def test_split_radiators(spark):
    req = thermal.thermal_requirements(*_room(spark, walls=((0, "north", "external", 5.0, 0.0, 0.0, 0.0, 0.0),))).withColumn("heating_w", F.lit(7200.0))
    assert [r["width_mm"] for r in hvac.place_radiators(req).orderBy("no").collect()] == [2000, 2000, 800]


def test_boiler_sizes(spark):
    rows = spark.createDataFrame([(10.0,), (20.87,), (100.0,)], "kw double")
    assert [r[0] for r in rows.select(hvac.boiler_size(F.col("kw"))).collect()] == [12, 28, 120]


def test_fixed_boiler_room(spark):
    req = thermal.thermal_requirements(*_room(spark)).withColumns({"cx": F.lit(3.0), "cy": F.lit(4.0)})
    here = hvac.boilers(req, hvac.BoilerConfig(room_id="room_1")).first()
    gone = hvac.boilers(req, hvac.BoilerConfig(room_id="attic")).first()
    assert (here["x"], here["y"]) == (3.0, 4.0) and (gone["room_id"], gone["x"], gone["y"]) == ("attic", 0.0, 0.0)


TWO_ROOMS = [(0, 0, 200, 0), (200, 0, 200, 100), (200, 100, 0, 100), (0, 100, 0, 0), (100, 0, 100, 100)]


@pytest.mark.parametrize("options", [{}, {"snapping": "nearest", "snap": 3.0}, {"turn": "descending"}])
def test_two_rooms(spark, options):
    found = topology.build_topology(_segments(spark, TWO_ROOMS), topology.TopologyConfig(**options))
    assert tuple(topology.euler(found).select("v", "e", "f", "euler").first()) == (6, 7, 3, 2)
    assert sorted(r["area"] for r in found.rooms.collect()) == [10000.0, 10000.0]
    assert found.faces.where("is_external").first()["area"] == 20000.0
    assert topology.adjacency(found).count() == 1 and topology.adjacency(found, rooms_only=False).count() == 3
    polygons = topology.polygons(found).collect()
    assert sorted(len(r["polygon"]) for r in polygons) == [4, 4]
    door = topology.connections(found).first()
    assert (door["x"], door["y"]) == (100.0, 50.0)


def test_square_ties(spark):
    found = topology.build_topology(_segments(spark, [(0, 0, 100, 0), (100, 0, 100, 100), (100, 100, 0, 100), (0, 100, 0, 0)]))
    assert tuple(topology.euler(found).select("v", "e", "f").first()) == (4, 4, 2)
    assert found.rooms.count() == 1


def test_order_of_rows_is_nothing(spark):
    rows = [(*r,) for r in TWO_ROOMS]
    frame = _segments(spark, rows)
    a = topology.build_topology(frame).faces.orderBy("face").collect()
    b = topology.build_topology(frame.orderBy(F.desc("seg_id")).repartition(3)).faces.orderBy("face").collect()
    assert a == b


def test_split_keeps_lone_segments(spark):
    pieces = segments.split_at_intersections(_segments(spark, [(0, 0, 0.2, 0), (50, 50, 60, 50)]))
    assert pieces.count() == 2


def _greedy(blocks):
    kept = []
    for a in sorted(blocks, key=lambda r: (-r[6], r[0])):
        clash = False
        for b in kept:
            w = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
            h = min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
            small = min(a[4] * a[5], b[4] * b[5])
            near = abs(a[2] + a[4] / 2 - b[2] - b[4] / 2) < 30 and abs(a[3] + a[5] / 2 - b[3] - b[5] / 2) < 30
            if (w > 0 and h > 0 and small and w * h / small > 0.5) or (a[1].lower() == b[1].lower() and near):
                clash = True
                break
        if not clash:
            kept.append(a)
    return {r[0] for r in kept}


def test_text_nms_is_greedy(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "B", "b"]), rng.randrange(200), rng.randrange(100), rng.randrange(1, 60), rng.randrange(1, 20), float(rng.randrange(60))) for i in range(250)]
    df = spark.createDataFrame([(1, 0, *r) for r in rows], "plan_id long, floor_id int, block_id long, text string, x int, y int, w int, h int, confidence double")
    assert {r["block_id"] for r in labels.dedupe_text(df).collect()} == _greedy(rows)


def _bands(words, height, up):
    lines = []
    for _, y, h in words:
        at = max(y - 6, 0) if up else min(y + h + 6, height - 1)
        if not any(abs(at - k) <= 3 for k in lines):
            lines.append(at)
    lines.sort()
    if up:
        out = [(a, b) for a, b in zip(lines, [*lines[1:], height]) if b - a >= 50]
    else:
        out = [(a, b) for a, b in zip([0, *lines], lines) if b > a]
    return out or [(0, height)]


@pytest.mark.parametrize("up", [True, False])
def test_floor_bands(spark, up):
    rng = random.Random(7)
    plans = {p: [(s, rng.randrange(900), rng.randrange(5, 20)) for s in range(rng.randrange(0, 8))] for p in range(30)}
    words = spark.createDataFrame([(p, s, "1° PIANO", y, h) for p, ws in plans.items() for s, y, h in ws], "plan_id long, seq long, text string, y int, h int")
    extents = spark.createDataFrame([(p, 900) for p in plans], "plan_id long, height int")
    got = {}
    for r in labels.floor_bands(words, extents, "up" if up else "down").collect():
        got.setdefault(r["plan_id"], []).append((r["floor_idx"], r["top"], r["bottom"]))
    assert {p: [b[1:] for b in sorted(v)] for p, v in got.items()} == {p: _bands(ws, 900, up) for p, ws in plans.items()}


def test_floor_names(spark):
    rows = ["PIANO TERRA", "piano_primo", "2° piano", "1º piano", "pian0 terra", "iano terra"]
    df = spark.createDataFrame(list(enumerate(rows)), "plan_id long, text string").withColumns({"seq": F.lit(0), "floor_id": F.lit(0)})
    got = {r["raw_text"]: (r["floor"], round(r["confidence"], 2)) for r in labels.floor_labels(df).collect()}
    assert got == {"PIANO TERRA": ("piano terra", 1.0), "piano_primo": ("primo piano", 0.95), "2° piano": ("secondo piano", 0.9), "1º piano": ("nono piano", 0.7)}


def test_scales(spark):
    df = spark.createDataFrame([("1:100",), ("abc",), ("1:0",)], "s string").select(scale.metres_per_pixel(F.col("s")), scale.scale_ratio(F.col("s")))
    assert [tuple(r) for r in df.collect()] == [(pytest.approx(0.008466666666666666), 0.01), (None, 1.0), (None, None)]


def test_normal_forms(spark):
    df = spark.createDataFrame([("  Dis. ", "Caffè-Bar"), ("Rip.", "È  ù")], "a string, b string")
    got = df.select(text.normalize_ocr_text(F.col("a")), text.normalize_label(F.col("b")), text.normalize_plain(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("dis", "caffe bar", "caffe-bar"), ("rip", "e u", "e u")]


def test_all_scripts_fold(spark):
    """Greek, Cyrillic, Hangul, ligatures, fractions, full width, marks that stand alone: as ``unicodedata`` has it."""
    texts = ["Άρθρο Ωΐ", "Й ё ї", "한글 각", "ﬁn ﬂ ﬃ", "½ ¾ … №", "Ｓａｌａ", "e\u0301 \u0301", "ĳ ǆ ŉ ¨", "が ぱ", "नि ख़", "שָׁלוֹם", "i̇İ", "ơ Ứ ự", "\u2011 \u212b ℃", "😀 𝒜𝓑", "plain", "1º piano", "\u0345\u05bf"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    forms = {"floor": text.normalize_floor_text(F.col("t")), "bare": text.strip_accents(F.col("t"))}
    for r in df.select("t", *[v.alias(k) for k, v in forms.items()]).collect():
        fold = lambda form, t: "".join(c for c in unicodedata.normalize(form, t) if not unicodedata.combining(c))
        assert (r["floor"], r["bare"]) == (fold("NFKD", r["t"]).lower(), fold("NFD", r["t"])), r["t"]


def test_folding_takes_little_time(spark):
    """Accented text of 6 million characters: the characters that need ``unicodedata`` are looked for in what isn't ASCII only."""
    df = spark.range(2).select(F.repeat(F.lit("Perché così È già più caffè, à la carte … "), 75_000).alias("t"))
    df = df.select(F.explode(F.array("t")).alias("t"))
    forms = [text.strip_accents(F.col("t")), text.normalize_plain(F.col("t"))]
    df.limit(1).select(F.substring("t", 1, 50).alias("t")).select(*forms).collect()
    began = time.perf_counter()
    got = df.select(*[F.substring(f, 1, 22) for f in forms]).collect()
    assert [tuple(r) for r in got] == [("Perche cosi E gia piu ", "perche cosi e gia piu ")] * 2
    assert time.perf_counter() - began < 8


@pytest.mark.parametrize("most_pieces", [0, 500_000])
def test_faces_without_edges(spark, most_pieces):
    """Rooms alone don't bring the edges back, and are those that come with the edges; pieces are cut once for two topologies."""
    frame, cfg = _segments(spark, _drawing(4)), topology.TopologyConfig(most_pieces=most_pieces)
    alone = topology.build_topology(frame, cfg)
    both = topology.build_topology(frame, cfg, alone.pieces)
    assert both.edges.count() and both.pieces is alone.pieces
    table = lambda t: sorted((r["face"], r["n_edges"], round(r["area"], 6), r["is_external"]) for r in t.faces.collect())
    assert table(alone) == table(both) and "_both" not in vars(alone)


def test_odd_characters_take_little_time(spark):
    """Four texts of 4 million characters that go through ``unicodedata``: marks are looked up once a character."""
    t = "Ｓａｌａ é ½ …" + " the quick brown fox" * 200_000
    df = spark.createDataFrame([(t,)], "t string")
    form = F.md5(text.normalize_floor_text(F.col("t")).cast("binary"))
    began = time.perf_counter()
    fold = text._by_unicodedata("NFKD").func
    got = fold(pd.Series([t] * 4))
    assert time.perf_counter() - began < 1.2 and got[0].startswith("Sala e 1⁄2 ... the quick")
    assert df.select(form).first()[0] == hashlib.md5(got[0].lower().encode()).hexdigest()


DRAWINGS = (
    "intersections", "merge_collinear", "merge_once", "pair_metrics", "door_closing", "room_areas_nearest", "room_areas_descending", "room_polygons", "euler", "connections",
    "topology_map", "label_rooms_concat", "irregular_rooms", "irregular_parts", "exported_plans", "split_pieces", "adjacency", "wall_types", "adjacent_rooms", "rooms_with_gaps",
)


@pytest.mark.parametrize("name", DRAWINGS)
def test_no_drawing_is_broadcast(spark, name):
    """Not even where Spark takes the tables for small ones, as it does with rows made from arrays."""
    store = spark._jsparkSession.sharedState().statusStore()

    def plans() -> dict[int, str]:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        every = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.executionsList())
        return {e.executionId(): e.physicalPlanDescription() for e in every}

    before = max(plans(), default=-1)
    (geometry_queries.QUERIES | file_queries.QUERIES)[name](spark, SF).write.format("noop").mode("overwrite").save()
    ran = {k: p for k, p in plans().items() if k > before}
    assert ran and not [k for k, p in ran.items() if "BroadcastExchange" in p]


def test_candidate_maps(spark, tmp_path):
    file = tmp_path / "map.txt"
    file.write_text("section_n | image_split_name | ocr | tok\n1 | 0000.png | x | \n1 | 0001.png | Camera | camera, 12\n1 | 0002.png | a/b | soggiorno, pranzo\n")
    found = candidates.read_candidates(spark, str(file))
    assert [r["tok"] for r in found.orderBy("image_split_name").collect()] == [[], ["camera", "12"], ["soggiorno", "pranzo"]]
    targets = labels.all_targets(spark, ["soggiorno pranzo"])
    assert {r["image_split_name"] for r in labels.select_labels(found, targets).collect()} == {"0001.png", "0002.png"}
    candidates.write_candidates(found, str(tmp_path / "out"))
    candidates.write_candidates(found, str(tmp_path / "out"))
    assert candidates.read_candidates(spark, str(tmp_path / "out")).count() == 6


def test_filter_stats(spark, tmp_path):
    file = tmp_path / "stats.txt"
    file.write_text("FilterName | Raw | Merged | Contours\n--------\na.png | 5 | 2 | 1\nb.png | 9 | 7 | 3\n\nnote: x\n")
    ranked = candidates.rank_filters(candidates.read_filter_stats(spark, str(file)))
    assert [r["filter_name"] for r in ranked.collect()] == ["b.png", "a.png"]


def test_both_dialects(spark, tmp_path):
    wall = {"wall_type": "external", "start_point": [0, 0], "end_point": [4, 0], "length_m": 4.0}
    old = {"meta": {"scale": "1:50"}, "rooms": [{"id": 3, "label": None, "polygon": [[0, 0], [4, 0], [4, 3]], "area_px": 6.0}], "topology": {"adjacency": {"3": [1]}}}
    new = {"meta": {"source_file": "a.pdf"}, "floors": [{"id": "floor_0", "label": "piano terra", "rooms": [{"id": "0", "label": "Bagno", "walls": [wall], "connections": [{"to_room_id": "1", "connection_type": "passage"}]}]}]}
    for name, doc in (("old", old), ("new", new)):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    got = models.read_models(spark, str(tmp_path))
    rooms = {r["plan_id"]: r for r in got["rooms"].collect()}
    assert rooms["old"]["room_id"] == "3" and rooms["old"]["label"] is None and rooms["new"]["height_m"] == 2.7
    assert got["walls"].first()["wall_type"] == "external" and got["connections"].first()["to_room_id"] == "1"
    strict = models.read_models(spark, str(tmp_path), strict_dialect=True)
    assert strict["walls"].first()["wall_type"] == "unknown" and strict["connections"].first()["connection_type"] == "door"


def test_documents_round_trip(spark, tmp_path):
    rooms, walls = fixtures.rooms_fx(spark, SF), fixtures.walls_fx(spark, SF)
    models.write_models(models.nest_models(rooms, walls), str(tmp_path / "m"), F.pmod(F.xxhash64("plan_id"), F.lit(3)))
    back = spark.read.schema("plan_id long, " + models.SCHEMA).json(str(tmp_path / "m"))
    flat = models.flatten_models(back)
    assert flat["rooms"].count() == rooms.count() and flat["walls"].count() == walls.count()


def test_flat_documents(spark):
    found = topology.build_topology(_segments(spark, TWO_ROOMS))
    rooms = topology.polygons(found).withColumn("label", F.lit(None).cast("string"))
    doc = models.nest_flat(rooms, topology.adjacency(found, rooms_only=False), F.lit("1:100"), F.lit(0.01)).first()
    assert len(doc["rooms"]) == 2 and len(doc["topology"]["adjacency"]) == 3 and doc["rooms"][0]["area_m2"] == pytest.approx(1.0)


def test_questions(spark):
    rooms, walls = _room(spark)
    assert questions.room_area(rooms, "SOGGIORNO").count() == 1
    pairs = spark.createDataFrame([(1, "room_1", "room_2")], "plan_id long, room_a string, room_b string")
    assert questions.adjacent_rooms(rooms, pairs, "room_2").first()["room_id"] == "room_1"


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5200)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {n: find(n) for p in pairs if p[0] != p[1] for n in p}


def test_older_merge_rule(spark):
    rows = [(0, 0, 10, 0), (10, 8, 30, 8)]
    assert segments.merge_collinear(_segments(spark, rows)).count() == 2
    old = segments.MergeConfig(perpendicular=None, until_stable=False)
    assert segments.merge_collinear(_segments(spark, rows), old).count() == 1


def test_metrics_of_points(spark):
    rng = random.Random(11)
    pts = [(1, i, rng.random() * 100, rng.random() * 100) for i in range(60)] + [(2, 0, 1.0, 1.0)] + [(3, i, 5.0, 5.0) for i in range(4)]
    got = {(r["plan_id"], r["a"], r["b"]) for r in labels.knn_graph(spark.createDataFrame(pts, "plan_id long, id long, x double, y double"), k=3).collect()}
    want = set()
    for p in (1, 2, 3):
        own = [q for q in pts if q[0] == p]
        diag = math.dist((min(q[2] for q in own), min(q[3] for q in own)), (max(q[2] for q in own), max(q[3] for q in own)))
        for q in own:
            near = sorted((math.dist(q[2:], o[2:]), o[1]) for o in own if o[1] != q[1])[:3]
            want |= {(p, min(q[1], i), max(q[1], i)) for d, i in near if d <= 0.66 * diag}
    assert got == want


def test_neighbours_of_points_at_one_place(spark):
    pts = [(1, i, float(i % 3), 0.0) for i in range(300)] + [(1, 900, 50.0, 0.0)]
    got = {(r["a"], r["b"]) for r in labels.knn_graph(spark.createDataFrame(pts, "plan_id long, id long, x double, y double"), k=4).collect()}
    want = set()
    for q in pts:
        near = sorted((math.dist(q[2:], o[2:]), o[1]) for o in pts if o[1] != q[1])[:4]
        want |= {(min(q[1], i), max(q[1], i)) for d, i in near if d <= 0.66 * 50}
    assert got == want


# --- irregular drawings


def _drawing(seed):
    """Diagonal walls, T-joints, a hole, parts that don't touch and walls that lead nowhere."""
    rng = random.Random(seed)
    box = lambda x, y, w, h: [(x, y, x + w, y), (x + w, y, x + w, y + h), (x + w, y + h, x, y + h), (x, y + h, x, y)]
    rows = box(0, 0, 400, 300) + [(0, 0, 400, 300), (200, 150, 200, 300), (400, 100, 250, 187.5), (50, 300, 50, 340)]
    rows += box(120, 200, 40, 40) + box(600, 50, 100, 80) + [(600, 50, 700, 130), (800, 10, 900, 10)]
    for _ in range(12):
        x, y, a = rng.uniform(0, 400), rng.uniform(0, 300), rng.uniform(0, 2 * math.pi)
        rows.append((x, y, x + 150 * math.cos(a), y + 150 * math.sin(a)))
    return rows


def _traced(pieces, snap=2.0):
    """Areas and edges of the faces of one floor's pieces, walked one by one."""
    first, points, edges = {}, [], []
    for x1, y1, x2, y2 in pieces:
        ends = []
        for x, y in ((x1, y1), (x2, y2)):
            key = round(x / snap), round(y / snap)
            if key not in first:
                first[key] = len(points)
                points.append((x, y))
            ends.append(first[key])
        if ends[0] != ends[1]:
            edges += [(ends[0], ends[1]), (ends[1], ends[0])]
    around = {}
    for e, (u, v) in enumerate(edges):
        around.setdefault(u, []).append((math.atan2(points[v][1] - points[u][1], points[v][0] - points[u][0]), e))
    after = {}
    for star in around.values():
        star.sort()
        for (_, e), (_, f) in zip(star, star[1:] + star[:1]):
            after[e ^ 1] = f
    seen, out = set(), []
    for e in range(len(edges)):
        walk = []
        while e not in seen:
            seen.add(e)
            walk.append(e)
            e = after[e]
        if len(walk) >= 3:
            area = sum(points[edges[k][0]][0] * points[edges[k][1]][1] - points[edges[k][1]][0] * points[edges[k][0]][1] for k in walk) / 2
            out.append((len(walk), round(abs(area), 6)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_irregular_drawings(spark, seed):
    frame = _segments(spark, _drawing(seed))
    found = topology.build_topology(frame)
    by_joins = topology.build_topology(frame, topology.TopologyConfig(most_pieces=0))
    pieces = [(r["x1"], r["y1"], r["x2"], r["y2"]) for r in found.pieces.orderBy("seg_id", "piece").collect()]
    assert sorted((r["n_edges"], round(r["area"], 6)) for r in found.faces.collect()) == _traced(pieces)
    names = ["e", "face", "rank", "twin_face", "twin_external", "is_external", "next"]
    assert sorted(map(str, found.edges.select(*names).collect())) == sorted(map(str, by_joins.edges.select(*names).collect()))
    table = lambda t: sorted((r["face"], r["n_edges"], round(r["area"], 6), r["is_external"]) for r in t.faces.collect())
    assert table(found) == table(by_joins)
    for r in topology.polygons(found).collect():
        p = r["polygon"]
        area = sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(p, p[1:] + p[:1])) / 2
        assert abs(area) == pytest.approx(r["area"])


@pytest.mark.parametrize("scale", [1.0, 0.01])
def test_near_pairs_meet_in_cells(spark, scale):
    rng = random.Random(4)
    rows = [tuple(scale * rng.uniform(0, 300) for _ in range(4)) for _ in range(40)] + [(0, 0, 300 * scale, 300 * scale), (0, 5 * scale, 300 * scale, 5 * scale)]
    rows += [(x := scale * rng.uniform(0, 300), y := scale * rng.uniform(0, 300), x + 3 * scale, y) for _ in range(40)]
    frame = _segments(spark, rows)
    for crowd in (1, 64):
        got = [(r["seg_a"], r["seg_b"]) for r in segments.find_intersections(frame, crowd).collect()]
        want = sorted(p for p in ((i, j) for i in range(len(rows)) for j in range(i + 1, len(rows))) if _cross(rows[p[0]], rows[p[1]]))
        assert sorted(got) == want
        near = segments.near_pairs(frame, 2.0 * scale, crowd).select("a_seg_id", "b_seg_id").collect()
        assert len(near) == len(set(near)) and {p for p in want} <= {tuple(r) for r in near}


def _cross(s, t):
    den = (s[0] - s[2]) * (t[1] - t[3]) - (s[1] - s[3]) * (t[0] - t[2])
    if abs(den) < 1e-10:
        return False
    u = ((s[0] - t[0]) * (t[1] - t[3]) - (s[1] - t[1]) * (t[0] - t[2])) / den
    v = -((s[0] - s[2]) * (s[1] - t[1]) - (s[1] - s[3]) * (s[0] - t[0])) / den
    return 0 <= u <= 1 and 0 <= v <= 1


# --- merging


def _loops(rows, cfg):
    def angle(s):
        a = math.degrees(math.atan2(s[3] - s[1], s[2] - s[0]))
        return a + 180 if a < 0 else a

    def fits(s, t):
        turn = abs(angle(s) - angle(t))
        if min(turn, 180 - turn) > cfg.angle_deg or min(math.dist(p, q) for p in (s[:2], s[2:]) for q in (t[:2], t[2:])) > cfg.distance:
            return False
        mx, my, size = (t[0] + t[2]) / 2, (t[1] + t[3]) / 2, math.dist(s[:2], s[2:])
        return cfg.perpendicular is None or abs((s[3] - s[1]) * (mx - s[0]) - (s[2] - s[0]) * (my - s[1])) / size <= cfg.perpendicular

    while True:
        out, left = [], list(rows)
        while left:
            grown, rest = left[0], []
            for t in left[1:]:
                if fits(grown, t):
                    ends = [grown[:2], grown[2:], t[:2], t[2:]]
                    p, q = max(((p, q) for i, p in enumerate(ends) for q in ends[i + 1 :]), key=lambda pq: math.dist(*pq))
                    grown = (*p, *q)
                else:
                    rest.append(t)
            out.append(grown)
            left = rest
        if not cfg.until_stable or len(out) == len(rows):
            return out
        rows = out


@pytest.mark.parametrize("cfg", [segments.MergeConfig(), segments.MergeConfig(perpendicular=None, until_stable=False)])
def test_merging_is_greedy(spark, cfg):
    rng = random.Random(6)
    rows = []
    for _ in range(150):
        x, y, a = rng.uniform(0, 120), rng.uniform(0, 60), math.radians(rng.choice([0, 2, 90, 91, 45]))
        n = rng.uniform(5, 40)
        rows.append((x, y, x + n * math.cos(a), y + n * math.sin(a)))
    got = [tuple(r) for r in segments.merge_collinear(_segments(spark, rows), cfg).orderBy("seg_id").select("x1", "y1", "x2", "y2").collect()]
    want = _loops(rows, cfg)
    assert len(got) == len(want) < len(rows)
    assert all(a == pytest.approx(b) for a, b in zip(got, want))


def test_merging_by_components(spark):
    wall = [(10.0 * i, 0.0, 10.0 * i + 8, 0.1 * (i % 2)) for i in range(30)]
    got = segments.merge_components(_segments(spark, [*wall, (0, 50, 40, 50), (44, 50.5, 90, 50), (150, 0, 150, 80)])).orderBy("seg_id").collect()
    assert [(r["seg_id"], round(r["x1"]), round(r["x2"])) for r in got] == [(0, 0, 298), (30, 0, 90), (32, 150, 150)]


# --- options


def test_diagonals_alone(spark):
    frame = _segments(spark, [(0, 0, 100, 2), (0, 0, 2, 100), (0, 0, 70, 70)])
    none = dict(horizontal=False, vertical=False)
    assert segments.filter_by_orientation(frame, **none).count() == 0
    assert [r["seg_id"] for r in segments.filter_by_orientation(frame, diagonal_if_none=True, **none).collect()] == [2]


def test_floor_names_in_both_orders(spark):
    df = spark.createDataFrame([(0, "pianoo quint")], "plan_id long, text string").withColumns({"seq": F.lit(0), "floor_id": F.lit(0)})
    assert labels.floor_labels(df).count() == 0
    assert labels.floor_labels(df, both_orders=True).first()["floor"] == "quinto piano"


def test_last_band_ends_early(spark):
    words = spark.createDataFrame([(1, 0, "PIANO", 100, 10), (1, 1, "piano", 400, 10)], "plan_id long, seq long, text string, y int, h int")
    extents = spark.createDataFrame([(1, 900)], "plan_id long, height int")
    got = [(r["top"], r["bottom"]) for r in labels.floor_bands(words, extents, last_to=100).orderBy("floor_idx").collect()]
    assert got == [(94, 394), (394, 800)]


def test_main_rectangle_without_fallback(spark):
    rows = [(1, 0, 5, True, 0, 0, 90, 90, 100, 100), (1, 1, 4, True, 0, 0, 10, 10, 100, 100), (2, 0, 4, False, 0, 0, 90, 90, 100, 100)]
    df = spark.createDataFrame(rows, "page_id long, contour_id long, n_vertices int, is_convex boolean, x int, y int, w int, h int, page_w int, page_h int")
    assert {(r["page_id"], r["contour_id"]) for r in labels.main_rectangle(df).collect()} == {(1, 0), (2, 0)}
    assert {(r["page_id"], r["contour_id"]) for r in labels.main_rectangle(df, 0.0, False).collect()} == {(1, 1)}


def test_box_bounds(spark):
    rows = [(0, 10, 5), (1, 10, 6), (2, 200, 64), (3, 230, 64), (4, 6, 6), (5, 140, 7), (6, 160, 7), (7, 10, 0)]
    df = spark.createDataFrame([(1, 0, i, 0, i, w, h) for i, w, h in rows], "plan_id long, floor_id int, block_id long, x int, y int, w int, h int")
    assert [r["block_id"] for r in labels.box_filter(df).orderBy("crop").collect()] == [1, 2, 5]
    assert [r["block_id"] for r in labels.box_filter(df, labels.OLD_BOXES).orderBy("crop").collect()] == []


def test_two_words_select_together(spark):
    df = spark.createDataFrame([("1", "a", ["soggiorno", "pranzo"]), ("1", "b", ["pranzo"])], "section_n string, image_split_name string, tok array<string>")
    own = spark.createDataFrame([("soggiorno pranzo",)], "target string")
    assert [r["image_split_name"] for r in labels.select_labels(df, own).collect()] == ["a"]
    assert labels.select_labels(df, own.where("false")).count() == 0
