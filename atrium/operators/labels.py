"""Text boxes, labels, floors and section candidates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atrium.functions import geometry as g
from atrium.functions.text import normalize_floor_text, normalize_label, normalize_ocr_text
from atrium.operators.choices import beaten
from atrium.operators.grids import BOX, FLOOR, in_cells, large_floors, met
from atrium.operators.numbering import running
from atrium.storage import spread, stored

#: Room labels with the words that mean the same.
EQUIVALENTS = {
    "sala": ("sala", "soggiorno", "soggiorno-pranzo"),
    "soggiorno": ("soggiorno", "sala", "soggiorno-pranzo"),
    "dis": ("dis", "dis.", "disimpegno", "corridoio"),
    "bagno": ("bagno", "wc"),
    "ripostiglio": ("ripostiglio", "rip.", "rip"),
    "balcone": ("balcone", "terrazzo"),
    "cucina": ("cucina", "angolo cottura", "cottura"),
    "camera": ("camera", "letto", "stanza"),
    "portico": ("portico", "veranda"),
}
KNOWN_LABELS = tuple(sorted({w for k, v in EQUIVALENTS.items() for w in (k, *v)}))
#: Tokens that are never labels.
BLACKLIST = ("arredo", "armadio", "altra", "uiu", "stessa")
#: Italian ordinals of floors.
ORDINALS = ("primo", "secondo", "terzo", "quarto", "quinto", "sesto", "settimo", "ottavo", "nono", "decimo")


@dataclass(frozen=True)
class BoxConfig:
    """Bounds of a text candidate's area, width over height, and height, all included."""

    area: tuple[float, float] = (50, 14000)
    ratio: tuple[float, float] = (1.1, 22.0)
    height: tuple[float, float] = (6, 64)


OLD_BOXES = BoxConfig((100, 6000), (1.2, 10.0), (8, 40))

# --- boxes and texts --------------------------------------------------------------------------------------------


def box_filter(boxes: DataFrame, cfg: BoxConfig = BoxConfig(), keys: list[str] | None = None) -> DataFrame:
    """Boxes that can be text, with ``crop``, their number from the top and then from the left."""
    keep = g.box_area().between(*cfg.area) & g.aspect_ratio().between(*cfg.ratio) & F.col("h").between(*cfg.height)
    order = Window.partitionBy(*(keys or FLOOR)).orderBy("y", "x", "block_id")
    return boxes.where(keep).withColumn("crop", F.row_number().over(order) - 1)


def confident_text(blocks: DataFrame, least: float = 20.0) -> DataFrame:
    """Stripped texts that are not empty and sure enough; a confidence of -1 counts as 0."""
    sure = F.when(F.col("confidence") == -1, F.lit(0.0)).otherwise(F.col("confidence"))
    out = blocks.withColumn("text", F.btrim("text")).withColumn("confidence", sure)
    return out.where((F.col("text") != "") & (F.col("confidence") >= least))


def unique_texts(texts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Stripped texts, the first of each only, in order of ``seq``."""
    rows = texts.withColumn("text", F.btrim("text")).where("text <> ''")
    return rows.groupBy(*(keys or FLOOR), "text").agg(F.min("seq").alias("seq"))


_BOX = ("block_id", "text", "x", "y", "w", "h", "confidence")


def overlap_pairs(blocks: DataFrame, overlap: float = 0.5, reach: float = 30.0, crowd: int = 64) -> DataFrame:
    """Pairs of blocks that are duplicates by place or by text and nearness, the surer (then earlier) one as ``a``."""
    surer = (F.col("a_confidence") > F.col("b_confidence")) | ((F.col("a_confidence") == F.col("b_confidence")) & (F.col("a_block_id") < F.col("b_block_id")))
    (ax, ay), (bx, by) = g.box_center("a_"), g.box_center("b_")
    same = (F.lower("a_text") == F.lower("b_text")) & (F.abs(ax - bx) < reach) & (F.abs(ay - by) < reach)
    before = surer & ((g.overlap_fraction() > overlap) | same)
    own = blocks.select(*FLOOR, *_BOX)
    large = large_floors(own, crowd)
    small = own if large is None else own.join(large, FLOOR, "left_anti")
    side = lambda p: small.select(*FLOOR, *[F.col(c).alias(f"{p}{c}") for c in _BOX])
    pairs = side("a_").join(side("b_"), FLOOR).where(before)
    if large is not None:
        cx, cy = g.box_center()
        wide = (F.least(F.col("x"), cx - reach), F.least(F.col("y"), cy - reach), F.greatest(F.col("x") + F.col("w"), cx + reach), F.greatest(F.col("y") + F.col("h"), cy + reach))
        rows = stored(own.join(large, FLOOR, "left_semi").withColumns({k: v.cast("double") for k, v in zip(BOX, wide, strict=True)}))
        pairs = pairs.unionByName(met(in_cells(rows, crowd, reach), list(_BOX), before).dropDuplicates([*FLOOR, "a_block_id", "b_block_id"]))
    return pairs.select(*FLOOR, "a_block_id", "b_block_id", g.overlap_fraction().alias("overlap"), F.col("b_confidence").alias("confidence"))


def dedupe_text(blocks: DataFrame, overlap: float = 0.5, reach: float = 30.0, most: int = 50_000) -> DataFrame:
    """Blocks that no surer kept block duplicates: the greedy choice by confidence, then by id.

    ``most``: conflicts of a floor, and of a connected part of a larger floor, that are settled in one go. Block ids are
    BIGINT and tell the blocks of a floor apart.
    """
    conflicts = overlap_pairs(blocks, overlap, reach)
    conflicts = conflicts.select(*FLOOR, F.col("a_block_id").cast("long").alias("a"), F.col("b_block_id").cast("long").alias("b"), (-F.col("confidence")).alias("surest"))
    gone = beaten(conflicts.withColumn("id", F.col("b")), ["surest", "id"], most)
    return blocks.join(gone.withColumnRenamed("node", "block_id"), [*FLOOR, "block_id"], "left_anti")


# --- texts in rooms ---------------------------------------------------------------------------------------------


def text_in_rooms(blocks: DataFrame, edges: DataFrame, most: int = 512, block: int = 4096) -> DataFrame:
    """Each text with the first room (by face) whose polygon holds its centre, by counting crossed edges.

    ``edges``: half-edges of rooms, ``(plan_id, floor_id, face, ox, oy, dx, dy)``. Edges that a polygon passes twice cancel
    out. The texts of a floor of up to ``most`` edges meet all of them. On larger floors a segment tree over the heights of
    the texts has each edge in the few nodes that make up its height and each text in the nodes above it, so they meet once
    and only at heights in common; nodes with many edges are met ``block`` edges at a time.
    """
    cx, cy = g.box_center()
    texts = blocks.select(*FLOOR, "block_id", cx.alias("px"), cy.alias("py"))
    cut = edges.where("oy <> dy").select(*FLOOR, "face", "ox", "oy", "dx", "dy")
    xi, yi, xj, yj = F.col("dx"), F.col("dy"), F.col("ox"), F.col("oy")
    crossed = ((yi > F.col("py")) != (yj > F.col("py"))) & (F.col("px") < (xj - xi) * (F.col("py") - yi) / (yj - yi + 1e-12) + xi)
    large = large_floors(cut, most)
    small = cut if large is None else cut.join(large, FLOOR, "left_anti")
    hits = texts.join(spread(small), FLOOR).where(crossed).select(*FLOOR, "block_id", "face")
    if large is not None:
        some = lambda df: stored(df.join(large, FLOOR, "left_semi"))
        hits = hits.unionByName(_at_heights(some(texts), some(cut), block).where(crossed).select(*FLOOR, "block_id", "face"))
    inside = hits.groupBy(*FLOOR, "block_id", "face").agg(F.count("*").alias("n")).where("n % 2 = 1")
    first = inside.groupBy(*FLOOR, "block_id").agg(F.min("face").alias("face"))
    return blocks.join(spread(first), [*FLOOR, "block_id"])


def _at_heights(texts: DataFrame, edges: DataFrame, block: int) -> DataFrame:
    """Each text with each edge of its floor that has points at its height, once, by a segment tree over the texts' ranks."""
    edges = stored(edges.withColumn("edge", F.monotonically_increasing_id()))
    # How many texts are lower than each text and each edge's ends; at one height ends come first.
    at = lambda df, y, kind, ident: df.select(*FLOOR, y.cast("double").alias("y"), F.lit(kind).alias("kind"), F.col(ident).cast("string").alias("id"))
    places = at(texts, F.col("py"), 2, "block_id")
    for kind, y in enumerate((F.least("oy", "dy"), F.greatest("oy", "dy"))):
        places = places.unionByName(at(edges, y, kind, "edge"))
    ranked = stored(running(places, FLOOR, ["y", F.col("kind") == 2, "id"], (F.col("kind") == 2).cast("int"), "lower"))
    of = lambda kind, ident, name: ranked.where(F.col("kind") == kind).select(*FLOOR, F.col("id").alias(ident), F.col("lower").alias(name))
    top = ranked.agg(F.max("lower")).first()[0] or 0
    levels = F.sequence(F.lit(0), F.lit(int(top).bit_length()))
    texts = texts.withColumn("key", F.col("block_id").cast("string")).join(of(2, "key", "rank"), [*FLOOR, "key"]).drop("key")
    texts = texts.select("*", F.explode(levels).alias("level")).withColumn("node", F.expr("shiftright(rank, level)"))
    edges = edges.withColumn("key", F.col("edge").cast("string")).join(of(0, "key", "lo"), [*FLOOR, "key"]).join(of(1, "key", "hi"), [*FLOOR, "key"]).drop("key")
    whole = F.expr(f"""flatten(transform(sequence(0, {int(top).bit_length()}), k -> filter(array(
        struct(k AS level, shiftright(lo + shiftleft(1L, k) - 1, k) AS node, shiftright(lo + shiftleft(1L, k) - 1, k) % 2 = 1 AS odd),
        struct(k AS level, shiftright(hi, k) - 1 AS node, shiftright(hi, k) % 2 = 1 AS odd)),
        x -> x.odd AND shiftright(lo + shiftleft(1L, k) - 1, k) < shiftright(hi, k))))""")
    edges = stored(edges.where("lo < hi").select(*FLOOR, "face", "ox", "oy", "dx", "dy", "edge", F.explode(whole).alias("at")))
    edges = edges.select(*FLOOR, "face", "ox", "oy", "dx", "dy", "edge", "at.level", "at.node")
    node = [*FLOOR, "level", "node"]
    parts = edges.groupBy(*node).agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1")
    parts = stored(parts)
    split = lambda df: df.join(parts, node, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    texts = split(texts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    edges = split(edges).withColumn("part", F.pmod(F.xxhash64("edge"), F.col("parts")).cast("int")).drop("parts", "edge")
    return texts.join(edges, [*node, "part"])


def is_known_label(text: Column) -> Column:
    return normalize_label(text).isin(*KNOWN_LABELS)


def label_rooms(blocks: DataFrame, edges: DataFrame, mode: str = "best") -> DataFrame:
    """``(plan_id, floor_id, face, label)``: the first known label in a room, else its first text (best), or all
    its texts in order (concat). Texts under two characters don't count."""
    if mode == "best":
        rows = text_in_rooms(blocks.where(F.length(normalize_label(F.col("text"))) >= 2), edges)
        order = F.struct((~is_known_label(F.col("text"))).alias("unknown"), F.col("block_id"))
        return rows.groupBy(*FLOOR, "face").agg(F.min_by("text", order).alias("label"))
    if mode != "concat":
        raise ValueError(f"unknown mode {mode}")
    rows = text_in_rooms(blocks.withColumn("text", F.btrim("text")).where(F.length("text") >= 2), edges)
    every = F.sort_array(F.collect_list(F.struct("block_id", "text")))
    return rows.groupBy(*FLOOR, "face").agg(F.array_join(F.transform(every, lambda x: x["text"]), " ").alias("label"))


# --- floors -----------------------------------------------------------------------------------------------------


def floor_rules() -> list[tuple[str, str, float]]:
    """(pattern, label, confidence) of floor names, in the order in which they are tried (fixed values)."""
    space, ring = r"[\s_.-]*", "[°º]?"
    rules = [(rf"\bpiano{space}terra\b", "piano terra", 1.0), (rf"\bp{space}?\.?{space}?terra\b", "piano terra", 0.95)]
    rules += [(rf"\b{w}{space}piano\b", f"{w} piano", 1.0) for w in ORDINALS]
    rules += [(rf"\bpiano{space}{w}\b", f"{w} piano", 0.95) for w in ORDINALS]
    rules += [(rf"\b{i}{ring}{space}piano\b", f"{w} piano", 0.9) for i, w in enumerate(ORDINALS, 1)]
    rules += [(rf"\bpiano{space}{i}{ring}\b", f"{w} piano", 0.8) for i, w in enumerate(ORDINALS, 1)]
    return rules


def floor_labels(texts: DataFrame, keys: list[str] | None = None, both_orders: bool = False, least: float = 0.6) -> DataFrame:
    """The best floor name of each floor's texts ``(..., seq, text)``: label, confidence and the text it came from.

    Patterns are tried on the folded text, then its lines are compared with the names by edit distance. The
    surest wins, the first of equals. Floors whose texts name none have no row. ``both_orders`` also compares with
    "piano primo" and the like.
    """
    keys = keys or FLOOR
    rules = floor_rules()
    names = [("piano terra", "piano terra"), *[(f"{w} piano", f"{w} piano") for w in ORDINALS]]
    if both_orders:
        names += [(f"piano {w}", f"{w} piano") for w in ORDINALS]
    # A row generator, so that a text is folded once and not in each expression that uses it.
    rows = texts.select(*keys, "seq", "text", normalize_floor_text(F.col("text")).alias("folded"))
    rows = rows.select(*keys, "seq", "text", F.explode(F.array("folded")).alias("folded"))
    said = rows.where(F.col("folded").contains("piano") | F.col("folded").contains("terra"))  # all patterns have one of these
    hit = F.array(*[F.when(F.regexp_like("folded", F.lit(p)), F.struct(F.lit(c).alias("confidence"), F.lit(-i).alias("order"), F.lit(label).alias("label"))) for i, (p, label, c) in enumerate(rules)])
    by_rule = said.select(*keys, "seq", "text", F.array_max(hit).alias("m")).where("m IS NOT NULL")
    by_rule = by_rule.select(*keys, "seq", "text", F.lit(0).alias("stage"), F.lit(0).alias("line_no"), F.col("m.order").alias("order"), "m.confidence", "m.label")

    # A name is at least (1 - least) of its length away from a line that much longer or shorter; so are all names from most lines.
    apart = {n: math.floor((1 - least) * len(n) + 1e-9) for n, _ in names}
    low, high = min(len(n) - d for n, d in apart.items()), max(len(n) + d for n, d in apart.items())
    every = F.transform(F.split("folded", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x, i: F.struct(i.alias("line_no"), F.btrim(x).alias("line")))
    lines = rows.select(*keys, "seq", "text", F.inline(F.filter(every, lambda x: F.length(x["line"]).between(low, high))))
    bare = F.replace("line", F.lit(" "), F.lit(""))
    gate = F.col("line").contains("piano") | (F.length(bare).between(4, 6) & (F.levenshtein(bare, F.lit("piano")) <= 1))

    def near(i: int, name: str, label: str) -> Column:
        away = F.levenshtein("line", F.lit(name), apart[name])
        return F.when(away >= 0, F.struct((1.0 - away / F.lit(float(len(name)))).alias("confidence"), F.lit(-i).alias("order"), F.lit(label).alias("label")))

    by_line = lines.where(gate).select(*keys, "seq", "text", F.lit(1).alias("stage"), "line_no", F.array_max(F.array(*[near(i, n, label) for i, (n, label) in enumerate(names)])).alias("m"))
    by_line = by_line.where(F.col("m.confidence") >= least).select(*keys, "seq", "text", "stage", "line_no", F.col("m.order").alias("order"), "m.confidence", "m.label")
    best = F.max(F.struct("confidence", (-F.col("seq")).alias("a"), (-F.col("stage")).alias("b"), (-F.col("line_no")).alias("c"), "order", "label", F.col("text").alias("raw_text"))).alias("m")
    found = by_rule.unionByName(by_line).groupBy(*keys).agg(best)
    return found.select(*keys, F.col("m.label").alias("floor"), F.col("m.confidence").alias("confidence"), F.col("m.raw_text").alias("raw_text"))


def floor_bands(words: DataFrame, extents: DataFrame, anchor: str = "up", least: int = 50, margin: int = 6, last_to: int = 0) -> DataFrame:
    """Bands of a page between words that contain "piano": ``(plan_id, floor_idx, top, bottom)``.

    ``words``: ``(plan_id, seq, text, y, h)``, ``extents``: ``(plan_id, height)``. A line within 3 px of one kept
    before it (in order of seq) is dropped. Anchor up: from a line above the word to the next, bands under ``least``
    dropped, the last down to ``height - last_to``; down: from the line before to one below the word. Without bands
    the page is one.
    """
    said = words.where(F.lower("text").contains("piano")).join(extents, "plan_id")
    if anchor == "up":
        line = F.greatest(F.col("y") - margin, F.lit(0))
    else:
        line = F.least(F.col("y") + F.col("h") + margin, F.col("height") - 1)
    lines = said.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("seq", line.cast("int").alias("at")))).alias("all"))
    fresh = lambda acc, x: ~F.exists(acc, lambda k: F.abs(k - x["at"]) <= 3)
    none = F.array().cast("array<int>")
    kept = F.sort_array(F.aggregate("all", none, lambda acc, x: F.when(fresh(acc, x), F.array_append(acc, x["at"])).otherwise(acc)))
    rows = extents.join(lines.select("plan_id", kept.alias("at")), "plan_id", "left").withColumn("at", F.coalesce("at", none))
    height = F.col("height").cast("int")
    if anchor == "up":
        band = lambda a, i: F.struct(a.alias("top"), F.coalesce(F.get("at", i + 1), height - last_to).alias("bottom"))
        bands = F.filter(F.transform("at", band), lambda b: b["bottom"] - b["top"] >= least)
    else:
        band = lambda a, i: F.struct(F.coalesce(F.get("at", i - 1), F.lit(0)).alias("top"), a.alias("bottom"))
        bands = F.filter(F.transform("at", band), lambda b: b["bottom"] > b["top"])
    whole = F.array(F.struct(F.lit(0).alias("top"), height.alias("bottom")))
    bands = F.when(F.size(bands) > 0, bands).otherwise(whole)
    return rows.select("plan_id", F.posexplode(bands).alias("floor_idx", "b")).select("plan_id", "floor_idx", "b.top", "b.bottom")


def named_floors(bands: DataFrame, names: DataFrame, has_lines: Column | None = None) -> DataFrame:
    """Bands with their matched label, else ``floor_i``; ``unknown`` for pages without any "piano" line."""
    default = F.concat(F.lit("floor_"), F.col("floor_idx").cast("string"))
    if has_lines is not None:
        default = F.when(has_lines, default).otherwise("unknown")
    out = bands.join(names, ["plan_id", "floor_idx"], "left")
    return out.withColumn("label", F.coalesce("floor", default)).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def into_bands(segments: DataFrame, bands: DataFrame, y: Column) -> DataFrame:
    """Rows of a page in the band that holds ``y``, as ``floor_id`` with ``top`` to take off."""
    both = segments.drop("floor_id").join(bands, "plan_id").where((y >= F.col("top")) & (y < F.col("bottom")))
    return both.withColumnRenamed("floor_idx", "floor_id")


def main_rectangle(contours: DataFrame, share: float = 0.05, fallback: bool = True) -> DataFrame:
    """The largest convex four-cornered box of each page above a share of it, else the largest box above it.

    ``share`` 0 without fallback is the older rule.
    """
    size = F.col("w").cast("long") * F.col("h")
    rows = contours.where(size > share * F.col("page_w") * F.col("page_h"))
    quad = (F.col("n_vertices") == 4) & F.col("is_convex")
    if not fallback:
        rows = rows.where(quad)
    order = F.struct(F.when(quad, 1).otherwise(0), size, -F.col("contour_id"))
    return rows.groupBy("page_id").agg(F.max_by(F.struct("contour_id", "x", "y", "w", "h"), order).alias("r")).select("page_id", "r.*")


# --- candidates of sections -------------------------------------------------------------------------------------


def crop_tokens(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted distinct phrases and words of each crop's normalised texts, without the blacklist."""
    norm = texts.withColumn("t", normalize_ocr_text(F.col("text")))
    every = F.concat(F.array("t"), F.split("t", " "))
    rows = norm.select(*keys, F.explode(every).alias("token")).where((F.col("token") != "") & ~F.col("token").isin(*BLACKLIST))
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set("token")).alias("tok"))


def all_targets(spark, targets: list[str]) -> DataFrame:
    """The user's targets with the known labels, normalised."""
    own = spark.createDataFrame([(t,) for t in targets], "target string")
    known = spark.createDataFrame([(t,) for t in KNOWN_LABELS], "target string")
    return own.union(known).select(normalize_ocr_text(F.col("target")).alias("target")).distinct()


def select_labels(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidates with a token among ``targets``, or with both words of "soggiorno pranzo" where that is one."""
    key = ["section_n", "image_split_name"]
    both = F.array_contains("tok", "soggiorno") & F.array_contains("tok", "pranzo")
    tokens = F.when(both, F.array_append("tok", F.lit("soggiorno pranzo"))).otherwise(F.col("tok"))
    rows = candidates.select(*key, F.explode(F.array_distinct(tokens)).alias("target"))
    return candidates.join(rows.join(targets, "target", "left_semi").select(*key).distinct(), key, "left_semi")


def point_extent(points: DataFrame, keys: list[str]) -> DataFrame:
    out = points.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n"))
    return out.withColumn("diagonal", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))


def knn_graph(points: DataFrame, k: int = 4, share: float = 0.66, keys: tuple[str, ...] = ("plan_id",)) -> DataFrame:
    """Undirected edges ``(..., a, b)`` from each point to its k nearest within a share of the section's diagonal.

    Ties go to the smaller id, so of points at one place only the k + 1 smallest ids can be anyone's neighbours. Points
    look only at grid cells around them; the grid is coarsened for those whose k-th neighbour may lie further out, until
    all are settled.
    """
    keys = list(keys)
    extent = point_extent(points, keys).where("n > 1")
    base = points.select(*keys, "id", "x", "y").join(extent.select(*keys, "n", "diagonal"), keys)
    step = F.greatest(F.col("diagonal") * F.sqrt(F.lit(2.0 * k) / F.col("n")) / 2, F.lit(1e-9))
    here = F.row_number().over(Window.partitionBy(*keys, "x", "y").orderBy("id"))
    base = stored(base.withColumn("reach", step).withColumn("here", here))
    open_, edges, size = base, None, 1.0
    while True:
        cell = F.col("reach") * size
        at = lambda c, i=0: (F.floor(F.col(c) / cell) + i).cast("long")  # noqa: B023, E731
        ring = F.array(*[F.struct(at("x", i).alias("cx"), at("y", j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        a = open_.select(*keys, "id", "x", "y", "n", "diagonal", cell.alias("cell"), F.inline(ring))
        b = base.where(F.col("here") <= k + 1).select(*keys, F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), at("x").alias("cx"), at("y").alias("cy"))
        met = a.join(b, [*keys, "cx", "cy"], "left").withColumn("d", F.when(F.col("id") != F.col("id2"), g.distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))))
        near = F.slice(F.sort_array(F.collect_list(F.when(F.col("d").isNotNull(), F.struct("d", "id2")))), 1, k)
        found = met.groupBy(*keys, "id", "n", "diagonal", "cell").agg(near.alias("near"))
        done = ((F.size("near") == F.least(F.lit(k), F.col("n") - 1)) & (F.element_at("near", -1)["d"] <= F.col("cell"))) | (F.col("cell") >= F.col("diagonal"))
        found = stored(found.withColumn("done", done))
        hits = found.where("done").select(*keys, "id", "diagonal", F.inline("near")).where(F.col("d") <= share * F.col("diagonal"))
        hits = hits.select(*keys, F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))
        edges = hits if edges is None else edges.unionByName(hits)
        left = found.where("NOT done").select(*keys, "id")
        if left.limit(1).count() == 0:
            return edges.distinct()
        open_, size = stored(base.join(left, [*keys, "id"], "left_semi")), size * 2
