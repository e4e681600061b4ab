"""MinHash near-duplicate documents: many universal hash minima, banding, signature verification, components.

A document is its set of distinct 4-word shingles. Equal sets meet first, so a large group of copies is one set. Each set
gets the minima of 160 hash functions of the form (a x + b) mod 2^64, of which the upper 32 bits count; these are strongly
universal on 32-bit values. The minima are cut into 32 bands of 5: two sets at 0.8 share a band but for 3 in a million.
Sets that share one are compared by their signatures, one byte of each minimum; a pair stays unless it agrees in fewer
places than a pair at 0.8 would in one of a billion cases. What stays is confirmed on the full sets, the links of each
bucket's least member first, then those between the components that this leaves. Buckets too large to compare all pairs
of are settled by finer bands and by prefixes of rare shingles, as ``set_links`` has it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atrium.llm.set_links import TWO, Hashes, crowded, finer, mix, own, parities, several
from atrium.llm.sieve import sieve
from atrium.llm.tables import table
from atrium.operators.components import connected_components
from atrium.storage import ship, stored

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


@dataclass(frozen=True)
class MinHashConfig:
    shingle: int = 4
    #: Per cent of the union that two linked sets have in common at least.
    percent: int = 80
    bands: int = 32
    rows: int = 5
    seed: int = 12
    #: Largest bucket in which all pairs are compared; larger ones are settled without that.
    paired: int = 12
    block: int = 256
    fine_bands: int = 16
    fine_rows: int = 6
    remembered: int = 100_000
    #: Rows whose texts and sets a task holds at once.
    rows_at_once: int = 256
    #: Bytes of text that are split at once, and shingles that are hashed at once.
    text_bytes: int = 4 << 20
    block_tokens: int = 1 << 15

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def similarity(self) -> float:
        return self.percent / 100

    @property
    def agreement(self) -> int:
        """Equal places of two signatures below which a pair is no candidate: six standard deviations under the mean."""
        s = self.similarity
        return math.floor(self.hashes * s - 6 * math.sqrt(self.hashes * s * (1 - s)))


class Sketches:
    """Shingle sets of texts, and minima of many sets at once."""

    def __init__(self, cfg: MinHashConfig):
        self.cfg, self.known = cfg, Hashes(cfg.remembered)
        random = np.random.default_rng(cfg.seed)
        self.a = random.integers(0, 1 << 64, cfg.hashes, dtype=np.uint64) | np.uint64(1)
        self.b = random.integers(0, 1 << 64, cfg.hashes, dtype=np.uint64)

    def words(self, text: bytes) -> np.ndarray:
        """Hashes of the words of a text, split a piece at a time."""
        parts, at = [], 0
        while at < len(text):
            end = at + self.cfg.text_bytes
            end = m.start() if end < len(text) and (m := _SPACE.search(text, end)) else len(text)
            words = text[at:end].lower().split()  # bytes: exactly these letters and this white space
            parts.append(np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words)))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)

    def shingles(self, text: bytes) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles; all words are one where there are fewer."""
        w = self.words(text)
        size = min(self.cfg.shingle, len(w))
        n = len(w) - size + 1 if size else 0
        x = np.full(n, size, dtype=np.uint64)
        for k in range(size):
            x = mix((x ^ w[k : k + n]) + TWO)
        return np.unique(x)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row for each set (none empty) with the minimum of each hash function."""
        out = np.empty((self.cfg.hashes, len(sets)), dtype=np.uint32)
        at = 0
        while at < len(sets):
            end, size = at, 0
            while end < len(sets) and (end == at or size + len(sets[end]) <= self.cfg.block_tokens):
                size += len(sets[end])
                end += 1
            x = np.concatenate(sets[at:end]) >> np.uint64(32)
            edges = np.cumsum([0, *map(len, sets[at : end - 1])])
            value = np.empty_like(x)
            for i in range(self.cfg.hashes):
                np.multiply(x, self.a[i], out=value)
                np.add(value, self.b[i], out=value)
                out[i, at:end] = np.minimum.reduceat(value, edges) >> np.uint64(32)
            at = end
        return out.T

    def bands(self, minima: np.ndarray) -> np.ndarray:
        """A row for each set with the key of each band."""
        by_band = minima.reshape(len(minima), self.cfg.bands, self.cfg.rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, self.cfg.bands + 1, dtype=np.uint64) * TWO, by_band.shape[:2])
        for r in range(self.cfg.rows):
            key = mix(key ^ by_band[:, :, r])
        return key.view(np.int64)


def digests(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, the same for equal sets whatever their order."""
    return tuple(int(mix(found ^ np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (1, 2))


_ROWS = "doc_id bigint, r bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>, bits binary"


def _rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, r, text)``; ``r`` tells rows apart that differ in id or text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("r"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def sketches(docs: DataFrame, cfg: MinHashConfig = MinHashConfig()) -> DataFrame:
    """``(doc_id, r, n, d1, d2, bands, bits)`` for each row: size and digest of its set, band keys and signature bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Sketches(cfg)
        for whole in batches:
            for at in range(0, whole.num_rows, cfg.rows_at_once):
                batch = whole.slice(at, cfg.rows_at_once)
                sets = [make.shingles(t.as_py()) for t in batch.column(2)]
                n = np.array([len(s) for s in sets], dtype=np.int64)
                full = [s for s in sets if len(s)]
                minima = make.minima(full) if full else np.zeros((0, cfg.hashes), dtype=np.uint32)
                low, keys = np.ascontiguousarray(minima.astype(np.uint8)), make.bands(minima)
                sums, place = [digests(s) for s in full], np.cumsum(n > 0) - 1
                of = lambda values, n=n, place=place: [values[p] if k else None for k, p in zip(n, place, strict=True)]
                columns = [
                    batch.column(0), batch.column(1), pa.array(n), pa.array(of([s[0] for s in sums]), pa.int64()), pa.array(of([s[1] for s in sums]), pa.int64()),
                    pa.array(of(list(keys)), pa.list_(pa.int64())), pa.array(of([r.tobytes() for r in low]), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "r", "n", "d1", "d2", "bands", "bits"])

    return _rows(docs).mapInArrow(run, _ROWS)


def _close(pairs: DataFrame, classes: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """The pairs ``(a, b)`` whose signatures agree in enough places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, cfg.hashes) for i in (2, 3))
            enough = pa.array((x == y).sum(axis=1) >= cfg.agreement)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(enough) for i in (0, 1)], names=["a", "b"])

    for side in "ab":
        pairs = pairs.join(classes.select(own("h").alias(side), F.col("bits").alias(f"bits_{side}")), side)
    return stored(pairs.select("a", "b", "bits_a", "bits_b").mapInArrow(run, "a bigint, b bigint"))


def _sets(docs: DataFrame, wanted: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """``(h, shingles, p0 .. p3)`` of the wanted sets ``(h, r, d1, d2)``, each read from one row that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Sketches(cfg)
        for whole in batches:
            for at in range(0, whole.num_rows, cfg.rows_at_once):
                ids, found = [], []
                for h, text, d1, d2 in zip(*(c.to_pylist() for c in whole.slice(at, cfg.rows_at_once).columns), strict=True):
                    if digests(one := make.shingles(text)) == (d1, d2):
                        ids.append(h)
                        found.append(one)
                odd = np.array([parities(s) for s in found], dtype=np.int64).reshape(len(found), 4)
                columns = [pa.array(ids, pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())), *[pa.array(odd[:, i]) for i in range(4)]]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "shingles", "p0", "p1", "p2", "p3"])

    rows = sieve(_rows(docs).select("r", "text"), "r", wanted).join(wanted, "r").select("h", "text", "d1", "d2")
    return stored(rows.mapInArrow(run, "h bigint, shingles array<bigint>, p0 bigint, p1 bigint, p2 bigint, p3 bigint").dropDuplicates(["h"]))


def _confirmed(pairs: DataFrame, sets: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """``(src, dst)`` of the pairs whose full sets have enough in common."""
    both = pairs.join(sets.selectExpr("h AS a", "shingles AS sa"), "a").join(sets.selectExpr("h AS b", "shingles AS sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    linked = both.withColumn("common", common).where(100 * F.col("common") >= cfg.percent * (F.size("sa") + F.size("sb") - F.col("common")))
    return stored(linked.selectExpr("a AS src", "b AS dst"))


def _grown(roots: DataFrame, links: DataFrame) -> DataFrame:
    return connected_components(roots.selectExpr("h AS src", "root AS dst").unionByName(links)).withColumnRenamed("node", "h")


def links(docs: DataFrame, classes: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """``(h, root)`` for the classes of equal sets ``(h, r, d1, d2, bands, bits)`` that have others linked to them."""
    posts = classes.select("h", F.explode("bands").alias("key"))
    sizes = stored(posts.groupBy("key").agg(F.count("*").alias("size"), F.min("h").alias("lead")).where("size > 1"))
    met = stored(sieve(posts, "key", sizes).join(sizes, "key"))
    small, large = met.where(F.col("size") <= cfg.paired), met.where(F.col("size") > cfg.paired)
    stars = met.where("h <> lead").selectExpr("lead AS a", "h AS b", "true AS star")
    inner = small.where("h <> lead")
    inner = inner.selectExpr("key", "h AS a").join(inner.selectExpr("key", "h AS b"), "key").where("a < b").selectExpr("a", "b", "false AS star")
    pairs = stored(stars.unionByName(inner).groupBy("a", "b").agg(F.max("star").alias("star")))
    close = _close(pairs.select("a", "b"), classes, cfg)
    nodes = close.selectExpr("a AS h").unionByName(close.selectExpr("b AS h")).unionByName(large.select("h")).distinct()
    wanted = stored(classes.select("h", "r", "d1", "d2").join(nodes, "h"))
    sets = _sets(docs, wanted, cfg)
    first = _confirmed(close.join(pairs.where("star"), ["a", "b"], "left_semi"), sets, cfg)
    roots = connected_components(first).withColumnRenamed("node", "h")
    named = close
    for side in "ab":
        named = named.join(roots.select(own("h").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    apart = named.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).join(pairs.where("star"), ["a", "b"], "left_anti")
    roots = _grown(roots, _confirmed(stored(apart.select("a", "b")), sets, cfg))
    for more in (finer, crowded):
        members = several(large.select("key", "h"), roots)
        if members.isEmpty():
            break
        roots = _grown(roots, _confirmed(more(members, sets, cfg), sets, cfg))
    return roots


def near_duplicates(docs: DataFrame, cfg: MinHashConfig = MinHashConfig()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row for each row of ``docs``.

    ``component_id`` is the smallest doc_id that is reachable over links, the row's own included; ``kept`` is whether that
    is the row's id. Texts without words, null ones too, have no set and are linked with nothing. Rows are told apart by id
    and text, so texts that share a doc_id are different documents; repeated rows all stay. A null id counts as none: it is
    named after its component, and kept only where no id is known there. Empty tables give no rows; other columns are left
    behind.
    """
    rows = stored(sketches(docs, cfg))
    full = rows.where("n > 0")
    first = [F.first(c).alias(c) for c in ("bands", "bits")]
    classes = full.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("first_id"), F.min("r").alias("r"), *first)
    classes = stored(classes.withColumn("h", F.monotonically_increasing_id()))
    roots = links(docs, classes, cfg)
    named = classes.select("d1", "d2", "n", "h", "first_id").join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    named = stored(named.select("d1", "d2", "n", "root", "first_id"))
    least = named.groupBy(own("root")).agg(F.min("first_id").alias("component_id"))
    named = stored(named.join(least, "root").select("d1", "d2", "n", "component_id"))
    out = full.join(named, ["d1", "d2", "n"]).select("doc_id", "n", "component_id")
    out = out.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS w1, generate_subscripts(w, 1) AS i, len(w) AS n FROM words),
ahead AS (SELECT doc_id, n, w1, lead(w1) OVER doc AS w2, lead(w1, 2) OVER doc AS w3, lead(w1, 3) OVER doc AS w4 FROM word WINDOW doc AS (PARTITION BY doc_id ORDER BY i)),
each AS (SELECT DISTINCT doc_id, concat_ws(' ', w1, w2, w3, w4) AS g FROM ahead WHERE n >= 4 AND w4 IS NOT NULL
 UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 3),
size AS (SELECT d.doc_id, count(g) AS n FROM documents d LEFT JOIN each USING (doc_id) GROUP BY d.doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach(a, b) AS (SELECT doc_id, doc_id FROM size UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b)
SELECT doc_id, n AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept FROM size JOIN reach ON a = doc_id GROUP BY doc_id, n
"""
