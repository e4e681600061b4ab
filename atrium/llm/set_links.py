"""Links between sets by MinHash: hashes, band keys, and what settles crowded buckets without comparing all pairs.

Sets are tables ``(h, shingles, p0 .. p3)`` with ``h`` their number and ``p0 .. p3`` the parities of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atrium.llm.sieve import sieve
from atrium.storage import stored

ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * ONE
    x = (x ^ (x >> np.uint64(29))) * TWO
    return x ^ (x >> np.uint64(32))


class Hashes(dict):
    """64-bit hashes of words, remembered up to a fixed number."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


def word_hashes(words: list[str]) -> np.ndarray:
    """What ``Hashes`` gives, for many words at once; where a good part of them is rare, remembering takes longer."""
    digests = b"".join(map(xxhash.xxh64_digest, words, repeat(7)))
    return np.frombuffer(digests, dtype=">u8").astype(np.uint64)


def band_keys(shingles: np.ndarray, edges: np.ndarray, bands: int, rows: int, first: int = 0) -> np.ndarray:
    """Keys of ``bands`` bands for the ranges of ``shingles`` that begin at ``edges``."""
    out = np.zeros((bands, len(edges)), dtype=np.int64)
    for b in range(bands):
        key = np.full(len(edges), b + 1 + first, dtype=np.uint64) * TWO
        for r in range(rows):
            seed = np.uint64((first + b * rows + r + 1) * 0x632BE59BD9B4E019 % (1 << 64))
            key = mix(key ^ np.minimum.reduceat(mix(shingles ^ seed), edges))
        out[b] = key.view(np.int64)
    return out


def own(key: str) -> Column:
    """``key`` without what Spark knows of its partitioning, so that a join on it gets an exchange, where a hot key is split."""
    return F.col(key).bitwiseXOR(F.lit(0).cast("long")).alias(key)


def parities(tokens: np.ndarray) -> np.ndarray:
    """256 bits: which of 256 places get an odd number of the tokens."""
    odd = np.bincount((tokens & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def several(large: DataFrame, roots: DataFrame) -> DataFrame:
    """``(h, root)`` of the members of large buckets ``(key, h)`` that hold more than one component."""
    named = stored(large.join(roots, "h", "left").select("key", "h", F.coalesce("root", "h").alias("root")))
    several = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return stored(named.join(stored(several), "key").select("h", "root").distinct())


def finer(members: DataFrame, sets: DataFrame, cfg, batch_bytes: int | None = None) -> DataFrame:
    """Pairs ``(a, b)`` of members that share a bucket of finer bands, each with the least of it.

    Paragraphs under one passage that many hold have unlike finer signatures, near copies like ones; so this joins
    nearly all that are alike at the cost of a few rows a member, however large the group is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            tokens = lists.flatten().to_numpy().view(np.uint64)
            edges = np.cumsum(np.concatenate([[0], lists.value_lengths().to_numpy()[:-1]])).astype(np.int64)
            keys = band_keys(tokens, edges, cfg.fine_bands, cfg.fine_rows, first=1000)
            h = np.tile(batch.column(0).to_numpy(), cfg.fine_bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(h)], names=["key", "h"])

    posts = stored(members.select("h").join(sets, "h").select("h", "shingles").mapInArrow(run, "key bigint, h bigint"), batch_bytes)
    leads = posts.groupBy("key").agg(F.min("h").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    return stored(posts.join(leads, "key").where("a <> h").select("a", F.col("h").alias("b")).distinct())


def crowded(members: DataFrame, sets: DataFrame, cfg) -> DataFrame:
    """Pairs ``(a, b)`` left to compare among members ``(h, root)``, none that can be alike left out.

    Members of one component need no link. Sets are put in order of how many members hold a shingle, rarest first: two
    sets at the similarity share one of the first |x| - ceil(similarity |x|) + 1, and at the first they share, what
    follows must still be enough. So members meet by their rare shingles, not by a passage that many hold. Parities of
    hashed shingles differ in no more places than the sets do, which proves most that meet unlike. In each list those
    outside its largest component are compared with all, block by block.
    """
    own = stored(sets.join(members, "h"))
    tokens = own.select("h", F.explode("shingles").alias("token"))
    held = stored(tokens.groupBy("token").agg(F.count("*").alias("held")).where("held > 1"))
    shared = stored(sieve(tokens, "token", held).join(held, "token"))
    shared = shared.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("shared"))
    # Shingles that one member alone holds come first and meet nothing.
    n = F.size("shingles")
    alone = n - F.size("shared")
    reach = n - F.ceil(n * cfg.similarity - 1e-6).cast("int") + 1 - alone
    odd = [f"p{i}" for i in range(4)]
    posts = shared.join(own, "h").select("h", "root", *odd, n.alias("n"), alone.alias("alone"), F.slice("shared", 1, F.greatest(reach, F.lit(0))).alias("shared"))
    posts = posts.select("h", "root", *odd, "n", "alone", F.posexplode("shared").alias("i", "x"))
    posts = stored(posts.selectExpr("x.token AS token", "h", "root", *odd, "n", "n - alone - i AS rest"))
    lists = posts.groupBy("token", "root").agg(F.count("*").alias("m")).groupBy("token")
    lists = lists.agg(F.sum("m").alias("many"), F.max(F.struct("m", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
    lists = stored(lists.select("token", F.ceil(F.col("many") / cfg.block).alias("parts"), F.col("top.root").alias("top")))
    met = stored(sieve(posts, "token", lists).join(lists, "token"))
    left = met.where("root <> top").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    left = left.selectExpr("token", "part", "h AS a", "root AS ra", "n AS na", "rest AS ta", *[f"{p} AS a{p}" for p in odd])
    right = met.selectExpr("token", "pmod(h, parts) AS part", "h AS b", "root AS rb", "n AS nb", "rest AS tb", "root = top AS in_top", *[f"{p} AS b{p}" for p in odd])
    both, s = F.col("na") + F.col("nb"), cfg.similarity
    enough = F.least("ta", "tb") >= both * (s / (1 + s)) - 1e-6
    near = F.least("na", "nb") >= F.greatest("na", "nb") * s - 1e-6
    apart = sum((F.bit_count(F.col(f"a{p}").bitwiseXOR(F.col(f"b{p}"))) for p in odd), start=F.lit(0))
    close = apart <= both * ((1 - s) / (1 + s)) + 1e-6
    pairs = left.join(right, ["token", "part"]).where("ra <> rb AND (in_top OR a < b)").where(enough & near & close)
    return stored(pairs.selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct())
