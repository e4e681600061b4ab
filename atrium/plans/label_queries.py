"""Queries over texts, labels, scales and documents of plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atrium.functions import geometry as g
from atrium.functions import scale, text
from atrium.operators import hvac, labels, thermal
from atrium.plans.fixtures import ROOMS_FX, TEXT_FX, WALLS_FX, rooms_fx, text_fx, walls_fx
from atrium.plans.hvac_queries import ORACLES as HVAC
from atrium.sources import models

#: Floor names as they are read from drawings; each document is given one of them.
FLOOR_TEXTS = ("PIANO TERRA", "piano_primo", "2° piano", "1º piano", "pian0 terra", "iano terra", "secondo pian0", "p. terra", "Piano 3", "terzo-piano", "piamo terra", "piano decimo x", "")

#: Phrases in other scripts, and with characters that fold to several.
SCRIPTS = ("Άρθρο Ωΐ", "Ёлка й", "각 한", "ﬁne ½ …", "Ｓａｌａ", "ĳs ǆ", "がぱ", "Piano º")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _boxes(spark, sf_dir) -> DataFrame:
    return text_fx(spark, sf_dir)


def overlap_pairs(spark, sf_dir):
    found = labels.overlap_pairs(labels.confident_text(_boxes(spark, sf_dir)))
    return found.select("plan_id", "a_block_id", "b_block_id", F.round("overlap", 12).alias("overlap"))


def text_nms(spark, sf_dir):
    return labels.dedupe_text(labels.confident_text(_boxes(spark, sf_dir))).select("plan_id", "block_id", "text")


def box_filter(spark, sf_dir):
    kept = labels.box_filter(_boxes(spark, sf_dir), labels.OLD_BOXES, ["plan_id"])
    return kept.select("plan_id", "block_id", "crop", F.round(g.aspect_ratio(), 6).alias("ratio"))


def unique_texts(spark, sf_dir):
    rows = _boxes(spark, sf_dir).withColumnRenamed("block_id", "seq")
    return labels.unique_texts(rows, ["plan_id"]).select("plan_id", "text", "seq")


def normalize_docs(spark, sf_dir):
    # A row generator, so that a text is folded once for three forms.
    rows = _docs(spark, sf_dir).select("doc_id", "text", text.bare_text(F.col("text")).alias("bare"))
    rows = rows.select("doc_id", "text", F.explode(F.array("bare")).alias("bare"))
    bare = F.col("bare")
    forms = {"floor": text.normalize_floor_text(F.col("text")), "ocr": text.ocr_form(bare), "label": text.label_form(bare), "plain": text.plain_form(bare)}
    return rows.select("doc_id", *[F.md5(v.cast("binary")).alias(k) for k, v in forms.items()])


def normalize_scripts(spark, sf_dir):
    """Each document behind a phrase in another script, or with characters that fold to several."""
    t = F.concat(F.element_at(F.array(*[F.lit(x) for x in SCRIPTS]), (F.col("doc_id") % len(SCRIPTS) + 1).cast("int")), F.lit(" "), F.coalesce("text", F.lit("")))
    forms = {"floor": text.normalize_floor_text(t), "plain": text.normalize_plain(t)}
    return _docs(spark, sf_dir).select("doc_id", *[F.md5(v.cast("binary")).alias(k) for k, v in forms.items()])


def tokens(spark, sf_dir):
    found = labels.crop_tokens(_boxes(spark, sf_dir), ["plan_id"])
    return found.select("plan_id", F.array_join("tok", ",").alias("tok"), text.tokens_match(F.col("tok"), ["camera", "bagno"]).alias("hit"))


def target_texts(spark, sf_dir):
    plain = text.normalize_plain(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", text.contains_any(plain, ["camera", "bagno", "the ", "eau"]).alias("hit"))


def floor_labels(spark, sf_dir):
    """The floor that each document names: a name as read from a drawing, then the whole of its text."""
    name = F.element_at(F.array(*[F.lit(t) for t in FLOOR_TEXTS]), (F.col("doc_id") % len(FLOOR_TEXTS) + 1).cast("int"))
    texts = F.array(F.struct(F.lit(0).alias("seq"), name.alias("text")), F.struct(F.lit(1).alias("seq"), F.coalesce("text", F.lit("")).alias("text")))
    found = labels.floor_labels(_docs(spark, sf_dir).select("doc_id", F.inline(texts)), ["doc_id"])
    return found.select("doc_id", "floor", F.round("confidence", 6).alias("confidence"), F.md5(F.col("raw_text").cast("binary")).alias("raw_text"))


def knn_edges(spark, sf_dir):
    x, y = g.box_center()
    points = _boxes(spark, sf_dir).select("plan_id", F.col("block_id").alias("id"), x.alias("x"), y.alias("y"))
    return labels.knn_graph(points)


def _piano_words(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    words = _boxes(spark, sf_dir).select("plan_id", F.col("block_id").alias("seq"), F.when(F.col("block_id") % 5 == 0, "Piano").otherwise("x").alias("text"), (F.col("y") * 10).alias("y"), "h")
    return words, words.select("plan_id").distinct().withColumn("height", F.lit(1800))


def floor_bands(spark, sf_dir):
    return labels.floor_bands(*_piano_words(spark, sf_dir)).select("plan_id", "floor_idx", "top", "bottom")


def floor_bands_down(spark, sf_dir):
    return labels.floor_bands(*_piano_words(spark, sf_dir), anchor="down").select("plan_id", "floor_idx", "top", "bottom")


def named_floors(spark, sf_dir):
    words, extents = _piano_words(spark, sf_dir)
    bands = labels.floor_bands(words, extents)
    names = bands.where("floor_idx % 2 = 0").select("plan_id", "floor_idx", F.lit("piano terra").alias("floor"), F.lit(0.9).alias("confidence"))
    return labels.named_floors(bands, names).select("plan_id", "floor_idx", "label", "confidence")


def texts_in_bands(spark, sf_dir):
    words, extents = _piano_words(spark, sf_dir)
    placed = labels.into_bands(words, labels.floor_bands(words, extents), F.col("y"))
    return placed.groupBy("plan_id", "floor_id").agg(F.count("*").alias("n"), F.min(F.col("y") - F.col("top")).alias("first"))


def main_rectangle(spark, sf_dir):
    boxes = _boxes(spark, sf_dir).select(
        F.col("plan_id").alias("page_id"), F.col("block_id").alias("contour_id"), (F.col("block_id") % 3 + 3).cast("int").alias("n_vertices"),
        (F.col("block_id") % 2 == 0).alias("is_convex"), "x", "y", "w", "h", F.lit(200).alias("page_w"), F.lit(100).alias("page_h"),
    )
    return labels.main_rectangle(boxes)


def scale_factors(spark, sf_dir):
    s = F.concat(F.lit("1:"), (F.col("event_id") % 7 * 50).cast("string"))
    s = F.when(F.col("event_id") % 11 == 0, "abc").otherwise(s)
    m = scale.metres_per_pixel(F.col("s"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", s.alias("s")).select(
        "event_id", F.round(m, 9).alias("metres"), F.round(scale.scale_ratio(F.col("s")), 9).alias("ratio"), F.round(scale.to_metres(F.lit(120.0), m), 9).alias("wall_m"),
        F.round(scale.to_square_metres(F.lit(5000.0), m), 9).alias("area_m2"),
    )


def scale_texts(spark, sf_dir):
    s = F.concat(F.lit("Scala 1 : "), (F.col("event_id") % 4 * 50).cast("string"), F.lit(" m"))
    s = F.when(F.col("event_id") % 3 == 0, "no scale").otherwise(s)
    found = scale.scale_in_text(s)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", found.alias("found"), scale.chosen_scale(F.lit(None).cast("string"), found).alias("chosen"))


def section_numbers(spark, sf_dir):
    n = F.col("page_id").cast("string")
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("base_Section-"), n, F.lit("_x"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("img"), n)).otherwise(F.concat(n, F.lit("plan")))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.section_number(name).alias("section_n"))


def _nested(spark, sf_dir) -> dict[str, DataFrame]:
    docs = models.nest_models(rooms_fx(spark, sf_dir), walls_fx(spark, sf_dir))
    as_read = docs.select("plan_id", F.to_json(F.struct("meta", "floors")).alias("j"))
    parsed = as_read.select("plan_id", F.from_json("j", models.SCHEMA).alias("d")).select("plan_id", "d.*")
    return models.flatten_models(parsed)


def model_rooms(spark, sf_dir):
    found = _nested(spark, sf_dir)["rooms"]
    return found.select("plan_id", F.col("room_id").cast("long").alias("room_id"), "label", F.round("area_m2", 6).alias("area_m2"), "height_m")


def model_walls(spark, sf_dir):
    found = _nested(spark, sf_dir)["walls"]
    return found.select("plan_id", F.col("room_id").cast("long").alias("room_id"), "wall_idx", "side", "wall_type", "is_valid", "length_m", "x1", "y1", "x2", "y2")


def hvac_documents(spark, sf_dir):
    docs = models.hvac_documents(hvac.hvac_system(thermal.thermal_requirements(rooms_fx(spark, sf_dir), walls_fx(spark, sf_dir))))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return docs.select(
        "plan_id", F.col("totals.heating_power_kw").alias("heating_kw"), F.col("totals.cooling_power_kw").alias("cooling_kw"), size("radiators").alias("n_radiators"),
        size("ac_units").alias("n_ac_units"), F.round("totals.total_pipe_length_m", 1).alias("pipe_units"),
    )


def primitives_doc(spark, sf_dir):
    points = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    rows = walls_fx(spark, sf_dir).select("plan_id", F.when(F.col("wall_type") == "external", "polyline").otherwise("line").alias("kind"), (F.col("room_id") * 100 + F.col("wall_idx")).alias("seq"), F.col("side").alias("layer"), points.alias("points"))
    docs = models.primitives_documents(rows)
    n = lambda k: F.coalesce(F.size(F.get(F.map_values("geometry"), F.array_position(F.map_keys("geometry"), k).cast("int") - 1)), F.lit(0))
    return docs.select("plan_id", n("line").alias("n_lines"), n("polyline").alias("n_polylines"))


QUERIES = {
    f.__name__: f
    for f in (
        overlap_pairs, text_nms, box_filter, unique_texts, normalize_docs, normalize_scripts, tokens, target_texts, floor_labels, knn_edges, floor_bands,
        floor_bands_down, named_floors, texts_in_bands, main_rectangle, scale_factors, scale_texts, section_numbers, model_rooms, model_walls, hvac_documents, primitives_doc,
    )
}

_T = f"t AS ({TEXT_FX})"
_PLAIN = r"trim(regexp_replace(strip_accents(lower(trim(text))), '[\s\x0b]+', ' ', 'g'))"
_SCRIPT = {form: "CASE doc_id % " + str(len(SCRIPTS)) + "".join(f" WHEN {i} THEN '{text.folded(x, form).lower()}'" for i, x in enumerate(SCRIPTS)) + " END" for form in ("NFD", "NFKD")}
_OCR = r"trim(regexp_replace(regexp_replace(replace(strip_accents(lower(text)), '-', ' '), '[^\p{L}\p{N} ._/]', '', 'g'), ' +', ' ', 'g'))"
_RULES = ", ".join(f"({i}, '{p}', '{label}', {c}::DOUBLE)" for i, (p, label, c) in enumerate(labels.floor_rules()))
_NAMES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(["piano terra", *[f"{w} piano" for w in labels.ORDINALS]]))
_GIVEN = ", ".join(f"({i}, '{t}')" for i, t in enumerate(FLOOR_TEXTS))



def _bands(anchor: str) -> str:
    """Lines at words that say "piano" in order, those within 3 of one before dropped, and the bands between them."""
    at, fit = ("greatest(y - 6, 0)", "b.bottom - b.top >= 50") if anchor == "up" else ("least(y + h + 6, 1799)", "b.bottom > b.top")
    band = "{'top': l[i], 'bottom': coalesce(l[i + 1], 1800)}" if anchor == "up" else "{'top': CASE WHEN i > 1 THEN l[i - 1] ELSE 0 END, 'bottom': l[i]}"
    return f"""WITH RECURSIVE {_T}, w AS (SELECT plan_id, block_id, y * 10 AS y, h FROM t),
s AS MATERIALIZED (SELECT plan_id, CAST({at} AS INT) AS at, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY block_id) AS BIGINT) AS n FROM w WHERE block_id % 5 = 0),
r AS (SELECT DISTINCT plan_id, 0::BIGINT AS n, []::INT[] AS kept FROM w
  UNION ALL SELECT r.plan_id, s.n, CASE WHEN len(list_filter(r.kept, lambda k: abs(k - s.at) <= 3)) > 0 THEN r.kept ELSE list_append(r.kept, s.at) END FROM r JOIN s ON s.plan_id = r.plan_id AND s.n = r.n + 1),
f AS (SELECT plan_id, list_sort(arg_max(kept, n)) AS l FROM r GROUP BY plan_id),
g AS (SELECT plan_id, list_filter(list_transform(range(1, len(l) + 1), lambda i: {band}), lambda b: {fit}) AS found FROM f),
j AS (SELECT plan_id, CASE WHEN len(found) > 0 THEN found ELSE [{{'top': 0, 'bottom': 1800}}] END AS found FROM g),
u AS (SELECT plan_id, found, unnest(range(1, len(found) + 1)) AS i FROM j),
bands AS (SELECT plan_id, CAST(i - 1 AS INT) AS floor_idx, CAST(found[i].top AS INT) AS top, CAST(found[i].bottom AS INT) AS bottom FROM u)
"""


ORACLES = {
    "overlap_pairs": f"""WITH {_T}, k AS (SELECT *, x + w / 2.0 AS cx, y + h / 2.0 AS cy FROM t WHERE confidence >= 20),
p AS (SELECT a.plan_id, a.block_id AS a_block_id, b.block_id AS b_block_id, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS ow, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS oh,
   least(a.w * a.h, b.w * b.h) AS m, lower(a.text) = lower(b.text) AND abs(a.cx - b.cx) < 30 AND abs(a.cy - b.cy) < 30 AS same
   FROM k a JOIN k b ON a.plan_id = b.plan_id AND (a.confidence > b.confidence OR (a.confidence = b.confidence AND a.block_id < b.block_id))),
f AS (SELECT *, CASE WHEN ow > 0 AND oh > 0 THEN ow * oh / m::DOUBLE ELSE 0.0 END AS overlap FROM p)
SELECT plan_id, a_block_id, b_block_id, round(overlap, 12) AS overlap FROM f WHERE overlap > 0.5 OR same""",
    "text_nms": f"""WITH RECURSIVE {_T}, k AS (SELECT *, x + w / 2.0 AS cx, y + h / 2.0 AS cy, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY confidence DESC, block_id) AS BIGINT) AS n FROM t WHERE confidence >= 20),
p AS (SELECT a.plan_id, a.block_id AS surer, b.n, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS ow, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS oh,
   least(a.w * a.h, b.w * b.h) AS m, lower(a.text) = lower(b.text) AND abs(a.cx - b.cx) < 30 AND abs(a.cy - b.cy) < 30 AS same FROM k a JOIN k b ON a.plan_id = b.plan_id AND a.n < b.n),
o AS MATERIALIZED (SELECT k.plan_id, k.n, k.block_id, coalesce(c.surer, []) AS surer FROM k LEFT JOIN (SELECT plan_id, n, list(surer) AS surer FROM p WHERE (ow > 0 AND oh > 0 AND ow * oh / m::DOUBLE > 0.5) OR same GROUP BY plan_id, n) c ON k.plan_id = c.plan_id AND k.n = c.n),
r AS (SELECT plan_id, n, [block_id] AS kept FROM o WHERE n = 1
  UNION ALL SELECT r.plan_id, o.n, CASE WHEN list_has_any(r.kept, o.surer) THEN r.kept ELSE list_append(r.kept, o.block_id) END FROM r JOIN o ON o.plan_id = r.plan_id AND o.n = r.n + 1),
z AS (SELECT plan_id, unnest(arg_max(kept, n)) AS block_id FROM r GROUP BY plan_id)
SELECT z.plan_id, z.block_id, trim(text) AS text FROM z JOIN t ON z.plan_id = t.plan_id AND z.block_id = t.block_id""",
    "floor_bands": _bands("up") + "SELECT plan_id, floor_idx, top, bottom FROM bands",
    "floor_bands_down": _bands("down") + "SELECT plan_id, floor_idx, top, bottom FROM bands",
    "named_floors": _bands("up") + "SELECT plan_id, floor_idx, CASE WHEN floor_idx % 2 = 0 THEN 'piano terra' ELSE 'floor_' || floor_idx END AS label, CASE WHEN floor_idx % 2 = 0 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM bands",
    "texts_in_bands": _bands("up") + """SELECT w.plan_id, floor_idx AS floor_id, count(*) AS n, CAST(min(y - top) AS INT) AS first
FROM w JOIN bands b ON w.plan_id = b.plan_id AND y >= top AND y < bottom GROUP BY w.plan_id, floor_idx""",
    "box_filter": f"""WITH {_T} SELECT plan_id, block_id, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY y, x, block_id) - 1 AS INT) AS crop, round(w / h::DOUBLE, 6) AS ratio
FROM t WHERE w * h BETWEEN 100 AND 6000 AND w / h::DOUBLE BETWEEN 1.2 AND 10 AND h BETWEEN 8 AND 40""",
    "unique_texts": f"WITH {_T} SELECT plan_id, trim(text) AS text, min(block_id) AS seq FROM t GROUP BY plan_id, trim(text)",
    "normalize_docs": rf"""SELECT doc_id, md5(coalesce(lower(strip_accents(text)), '')) AS floor,
  md5(trim(CASE WHEN {_OCR} LIKE '%.' AND length({_OCR}) <= 5 THEN left({_OCR}, CAST(length({_OCR}) - 1 AS BIGINT)) ELSE {_OCR} END)) AS ocr,
  md5(trim(regexp_replace(replace(strip_accents(lower(trim(text))), '-', ' '), '[\s\x0b]+', ' ', 'g'))) AS label, md5({_PLAIN}) AS plain FROM documents""",
    "normalize_scripts": rf"""SELECT doc_id, md5({_SCRIPT["NFKD"]} || ' ' || lower(strip_accents(coalesce(text, '')))) AS floor,
  md5(trim(regexp_replace({_SCRIPT["NFD"]} || ' ' || strip_accents(lower(coalesce(text, ''))), '[\s\x0b]+', ' ', 'g'))) AS plain FROM documents""",
    "tokens": f"""WITH {_T}, d AS (SELECT DISTINCT plan_id, CASE text WHEN 'Ripostiglio.' THEN 'ripostiglio.' ELSE lower(text) END AS k FROM t)
SELECT plan_id, string_agg(k, ',' ORDER BY k) AS tok, max(CASE WHEN k IN ('camera', 'bagno') THEN 1 ELSE 0 END) = 1 AS hit FROM d GROUP BY plan_id""",
    "target_texts": f"SELECT doc_id, coalesce(contains(p, 'camera') OR contains(p, 'bagno') OR contains(p, 'the ') OR contains(p, 'eau'), false) AS hit FROM (SELECT doc_id, {_PLAIN} AS p FROM documents)",
    "floor_labels": f"""WITH g(i, raw) AS (VALUES {_GIVEN}), rules(o, p, label, c) AS (VALUES {_RULES}), names(o, n) AS (VALUES {_NAMES}),
f AS MATERIALIZED (SELECT i AS key, 0 AS seq, raw, lower(strip_accents(replace(raw, 'º', 'o'))) AS t FROM g
  UNION ALL SELECT doc_id, 1, coalesce(text, ''), lower(strip_accents(replace(coalesce(text, ''), 'º', 'o'))) FROM documents),
l AS (SELECT key, seq, raw, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS line_no FROM f),
x AS (SELECT key, seq, raw, 0 AS stage, 0 AS line_no, o, label, c FROM f JOIN rules ON regexp_matches(t, p)
  UNION ALL SELECT key, seq, raw, 1, line_no, o, n, 1.0::DOUBLE - levenshtein(trim(line), n) / length(n)::DOUBLE FROM l, names
  WHERE trim(line) <> '' AND (contains(line, 'piano') OR (length(line) < 60 AND levenshtein(replace(trim(line), ' ', ''), 'piano') <= 1))),
d AS (SELECT doc_id, x.* FROM documents JOIN x ON seq = 0 AND doc_id % {len(FLOOR_TEXTS)} = key UNION ALL SELECT key, x.* FROM x WHERE seq = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, seq, stage, line_no, o) AS k FROM d WHERE stage = 0 OR c >= 0.6)
SELECT doc_id, label AS floor, round(c, 6) AS confidence, md5(raw) AS raw_text FROM b WHERE k = 1""",
    "knn_edges": f"""WITH {_T}, p AS (SELECT plan_id, block_id AS id, x + w / 2.0::DOUBLE AS x, y + h / 2.0::DOUBLE AS y FROM t),
e AS (SELECT plan_id, sqrt((max(x) - min(x)) * (max(x) - min(x)) + (max(y) - min(y)) * (max(y) - min(y))) AS diag FROM p GROUP BY plan_id),
n AS (SELECT a.plan_id, a.id, b.id AS id2, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.plan_id = b.plan_id AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY plan_id, id ORDER BY d, id2) AS k FROM n)
SELECT DISTINCT plan_id, least(id, id2) AS a, greatest(id, id2) AS b FROM r JOIN e USING (plan_id) WHERE k <= 4 AND d <= 0.66::DOUBLE * diag""",
    "main_rectangle": f"""WITH {_T}, c AS (SELECT plan_id AS page_id, block_id AS contour_id, x, y, w, h, w * h AS size, CASE WHEN block_id % 3 + 3 = 4 AND block_id % 2 = 0 THEN 1 ELSE 0 END AS quad FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY quad DESC, size DESC, contour_id) AS k FROM c WHERE size > 0.05 * 200 * 100)
SELECT page_id, contour_id, x, y, w, h FROM r WHERE k = 1""",
    "scale_factors": """WITH s AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 7 * 50 END AS d FROM events),
m AS (SELECT *, CASE WHEN d > 0 THEN (0.0254::DOUBLE / 300::DOUBLE) * (d / 1.0::DOUBLE) END AS metres FROM s)
SELECT event_id, round(metres, 9) AS metres, round(CASE WHEN d IS NULL THEN 1.0::DOUBLE WHEN d = 0 THEN NULL ELSE 1.0::DOUBLE / d END, 9) AS ratio, round(120.0::DOUBLE * metres, 9) AS wall_m,
  round(5000.0::DOUBLE * (metres * metres), 9) AS area_m2 FROM m""",
    "scale_texts": """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN '1:' || (event_id % 4 * 50) END AS found, coalesce(CASE WHEN event_id % 3 <> 0 THEN '1:' || (event_id % 4 * 50) END, '1:100') AS chosen FROM events""",
    "section_numbers": "SELECT page_id, CASE WHEN page_id % 3 = 2 THEN page_id || 'plan' ELSE CAST(page_id AS VARCHAR) END AS section_n FROM pages",
    "model_rooms": f"WITH r AS ({ROOMS_FX}) SELECT plan_id, room_id, label, round(area_m2, 6) AS area_m2, height_m FROM r",
    "model_walls": f"WITH r AS ({ROOMS_FX}), w AS ({WALLS_FX}) SELECT plan_id, room_id, wall_idx, side, wall_type, true AS is_valid, length_m, x1, y1, x2, y2 FROM r JOIN w USING (room_id)",
    "hvac_documents": HVAC["hvac_totals"],
    "primitives_doc": f"""WITH r AS ({ROOMS_FX}), w AS ({WALLS_FX}) SELECT plan_id, CAST(count(*) FILTER (wall_type <> 'external') AS INT) AS n_lines,
  CAST(count(*) FILTER (wall_type = 'external') AS INT) AS n_polylines FROM r JOIN w USING (room_id) GROUP BY plan_id""",
}
