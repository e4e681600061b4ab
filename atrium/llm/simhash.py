"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 2 bits share at least 6 of their 8 positional bytes. The index posts each
distinct fingerprint under 14 sets of 4 byte positions with the bytes there: the sets whose positions, as three binary
digits, cancel out. Two fingerprints that share 6 positions meet in exactly 3 of these lists, and the 3 together prove
all 6 positions; two that share 5 meet in one list only. So the lists in which a pair meets are tallied into the byte
positions that they prove equal, pairs with fewer than 6 are dropped by that count, and the bit count verifies the rest.

Lists longer than a limit are not paired. Two members are within 2 bits if and only if some value is within 1 bit of
both, so each member posts itself and its neighbours in the bytes that its long lists leave free, 64 at most, and all
that share such a value are linked to the smallest there. A pair that meets in a long list is found that way, and a pair
that meets in short lists only has its whole tally there, so no link is lost and no list is compared with itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atrium.llm.tables import table, texts, unused
from atrium.operators.components import connected_components
from atrium.storage import stored


#: The sets of byte positions that the index is posted under: each 6 positions hold 3 of them, each 5 hold 1.
SETS = tuple(at for at in combinations(range(8), 4) if at[0] ^ at[1] ^ at[2] ^ at[3] == 0)


@dataclass(frozen=True)
class SimHashConfig:
    shingle: int = 3
    seed: int = 42
    max_bits: int = 2
    #: Longest posting list that is paired; longer ones go the other exact way.
    paired: int = 24


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of UTF-8 bytes; 0 for no words. A-Z count as a-z, words end at ASCII white space."""
    words = (text or b"").lower().split()  # bytes: exactly these letters and this white space
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    parts = zip(*[words[i:] for i in range(shingle)], strict=False) if len(words) >= shingle else [words]
    digest, seen = xxhash.xxh64_intdigest, 0
    ones = np.zeros(64, dtype=np.int64)
    joined = map(b" ".join, parts)
    while seen < n:  # in blocks, so that a very long text needs no more memory
        block = min(n - seen, 1 << 14)
        h = np.fromiter((digest(next(joined), seed) for _ in range(block)), dtype="<u8", count=block)
        bits = np.unpackbits(h.view(np.uint8).reshape(block, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        seen += block
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprinted(docs: DataFrame, cfg: SimHashConfig) -> DataFrame:
    """``(doc_id, text_hash, fp)`` for each row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = [fingerprint(t, cfg.shingle, cfg.seed) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "text_hash": frame["text_hash"], "fp": np.array(fps, dtype=np.int64)})

    rows = texts(docs).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(run, "doc_id bigint, text_hash bigint, fp bigint")


def fingerprints(docs: DataFrame, cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """``(doc_id, fp)`` for each row."""
    return _fingerprinted(docs, cfg).select("doc_id", "fp")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _long(x: int) -> Column:
    return F.lit(_signed(x)).cast("long")


def postings(fps: DataFrame) -> DataFrame:
    """``(fp, s, bytes)``: a row for each of the ``SETS`` of byte positions with the fingerprint's bytes there."""
    masks = [sum(0xFF << 8 * p for p in positions) for positions in SETS]
    each = [F.struct(F.lit(s).cast("byte").alias("s"), F.col("fp").bitwiseAND(_long(m)).alias("bytes")) for s, m in enumerate(masks)]
    return fps.select("fp", F.inline(F.array(*each)))


def tallied(met: DataFrame) -> DataFrame:
    """``(src, dst, shared)``: pairs in the same posting lists with the number of byte positions these prove equal.

    ``shared`` is exact from 6 on; pairs that share 4 or 5 bytes have 4 here, if they meet at all.
    """
    positions = F.array(*[F.lit(sum(1 << p for p in at)) for at in SETS])
    a, b = met.selectExpr("s", "bytes", "fp AS src"), met.selectExpr("s", "bytes", "fp AS dst")
    pairs = a.join(b, ["s", "bytes"]).where("src < dst").select("src", "dst", F.get(positions, F.col("s").cast("int")).alias("at"))
    return pairs.groupBy("src", "dst").agg(F.bit_count(F.bit_or("at")).alias("shared"))


def _neighbours(met: DataFrame) -> DataFrame:
    """Links between members of long lists, through the values that are within 1 bit of two of them."""
    free = F.array(*[_long(sum(0xFF << 8 * p for p in range(8) if p not in at)) for at in SETS])
    members = met.groupBy("fp").agg(F.bit_or(F.get(free, F.col("s").cast("int"))).alias("free"))
    flips = F.filter(F.array(*[_long(1 << k) for k in range(64)]), lambda flip: F.col("free").bitwiseAND(flip) != 0)
    near = F.concat(F.array("fp"), F.transform(flips, lambda flip: F.col("fp").bitwiseXOR(flip)))
    hubs = members.select("fp", F.explode(near).alias("hub"))
    lists = hubs.groupBy("hub").agg(F.sort_array(F.collect_list("fp")).alias("all")).where(F.size("all") > 1)  # 65 at most
    return lists.select(F.get("all", F.lit(0)).alias("src"), F.explode(F.slice("all", 2, 64)).alias("dst")).distinct()


def links(fps: DataFrame, cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """``(src, dst)`` links between distinct fingerprints ``fp`` that connect all pairs within ``max_bits`` (2)."""
    if cfg.max_bits != 2:
        raise ValueError("the index is laid out for 2 bits")
    posts = postings(fps)
    lists = stored(posts.groupBy("s", "bytes").agg(F.count("*").alias("n")).where("n > 1"))
    met = stored(posts.join(lists, ["s", "bytes"]))
    differ = F.bit_count(F.col("src").bitwiseXOR(F.col("dst")))
    pairs = tallied(met.where(F.col("n") <= cfg.paired)).where(F.col("shared") >= 8 - cfg.max_bits)
    pairs = pairs.where(differ <= cfg.max_bits).select("src", "dst")
    return pairs.unionByName(_neighbours(met.where(F.col("n") > cfg.paired)))


def _rooted(fps: DataFrame, cfg: SimHashConfig) -> DataFrame:
    """``(fp, root)`` for each distinct fingerprint: the smallest one of its component."""
    nodes = stored(fps.select("fp").distinct())
    roots = connected_components(stored(links(nodes, cfg))).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """``(doc_id, fp, component_id)``, a row for each row of ``docs``; no link between fingerprints is lost.

    Null and blank texts have fingerprint 0. ``component_id`` is the smallest doc_id reachable; null only where
    no id is known there. Repeated rows stay. Copies share a fingerprint and meet in one node before any link is
    sought, so a large group of copies costs one row there. Other columns are left behind.
    """
    fps = stored(fingerprints(docs, cfg))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    rooted = stored(nodes.join(_rooted(fps, cfg), "fp"))
    first = rooted.groupBy(F.col("root").bitwiseXOR(_long(0)).alias("root")).agg(F.min("first_id").alias("component_id"))
    named = stored(rooted.join(first, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, cfg: SimHashConfig = SimHashConfig()) -> DataFrame:
    """``docs`` with one row of each component: the smallest by doc_id (null is largest), then by the text's hash.

    Rows are judged by doc_id and text, so texts that share a doc_id are different rows. Of rows that are equal in both
    any one stays. Null and blank texts have fingerprint 0 and are a component like any other. Columns stay as they are.
    """
    ident = [F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))]
    found = stored(_fingerprinted(docs, cfg))
    named = stored(_rooted(found, cfg))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    rows = found.groupBy("fp", "doc_id", "text_hash").agg(F.count("*").alias("n")).join(named, "fp")
    rows = stored(rows.select("root", "doc_id", "text_hash", "n"))
    first = rows.groupBy(F.col("root").bitwiseXOR(_long(0)).alias("root")).agg(F.min(order).alias("first"))
    judged = rows.join(first, "root").withColumn("stays", order.eqNullSafe(F.col("first")))
    judged = stored(judged.where("NOT stays OR n > 1").select("doc_id", "text_hash", "stays"))

    def among(rows: DataFrame) -> tuple[DataFrame, Column]:
        a, b = unused(docs, "doc_id", 2)
        return rows.select(F.col("doc_id").alias(a), F.col("text_hash").alias(b)), ident[0].eqNullSafe(F.col(a)) & (ident[1] == F.col(b))

    left = docs.join(*among(judged.where("NOT stays")), "left_anti")
    twice = judged.where("stays")
    if twice.isEmpty():
        return left
    a, b = unused(docs, "row", 2)
    again = left.join(*among(twice), "left_semi").withColumns({a: ident[0], b: ident[1]})
    again = again.dropDuplicates([a, b]).drop(a, b)
    return left.join(*among(twice), "left_anti").unionByName(again)
