"""Best-fit packing by patterns fitted with non-negative least squares.

A pattern is a few document lengths that fill a sequence. Repeat counts of many patterns are fitted to the
histogram of lengths (which has as many bins as a sequence has tokens, whatever the corpus size), rounded down
so that no length is used more often than it occurs, and what is left is packed best fit first. The plan then
gives each document, by its rank among those of its length, a sequence and a place there.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from atrium.llm.tables import table, texts
from atrium.storage import stored

SPECIAL = "<|endoftext|>"


@dataclass(frozen=True)
class PackingConfig:
    tokenizer: str = "byte_bpe_50k.json"
    ranks: str = "byte_bpe_50k.tiktoken"
    end_id: int = 2
    tokens: int = 1024
    #: Patterns have up to so many lengths; the second length of longer ones is tried at so many places.
    parts: int = 4
    tried: int = 24
    iterations: int = 400
    #: Strings on which the two encoders are compared in each worker.
    probes: int = 300
    #: Rows of a window when ranks are counted.
    rank_block: int = 256


# --- the plan ---------------------------------------------------------------------------------------------------


def patterns(counts: np.ndarray, cfg: PackingConfig) -> np.ndarray:
    """Rows of ``parts`` lengths (0: none) that sum to ``tokens`` and use lengths that occur only."""
    size, has = cfg.tokens, counts > 0
    there = np.flatnonzero(has)
    there = there[(there > 0) & (there < size)]
    rows: set[tuple[int, ...]] = set()
    for a in there.tolist():
        if has[size - a]:
            rows.add((a, size - a) if a >= size - a else (size - a, a))
    heavy = there[np.argsort(-counts[there], kind="stable")][: cfg.tried].tolist()
    spread = there[np.linspace(0, len(there) - 1, min(cfg.tried, len(there))).astype(int)].tolist() if len(there) else []
    seconds = sorted(set(heavy + spread))
    for a in there.tolist():
        for b in seconds:
            rest = size - a - b
            if rest <= 0:
                continue
            if has[rest]:
                rows.add(tuple(sorted((a, b, rest), reverse=True)))
            for c in heavy[: cfg.tried // 3] if cfg.parts > 3 else ():
                if rest - c > 0 and has[rest - c]:
                    rows.add(tuple(sorted((a, b, c, rest - c), reverse=True)))
    out = np.zeros((len(rows), cfg.parts), dtype=np.int64)
    for i, row in enumerate(sorted(rows)):
        out[i, : len(row)] = row
    return out


def fit_repeats(rows: np.ndarray, counts: np.ndarray, cfg: PackingConfig) -> np.ndarray:
    """Non-negative least squares of pattern repeats to the histogram, by projected gradient with momentum."""
    if not len(rows):
        return np.zeros(0)
    target = counts.astype(np.float64).copy()
    target[0] = 0
    used, size = rows > 0, len(counts)
    #: The largest eigenvalue of A A' is at most the largest row sum.
    times = np.bincount(rows[used], minlength=size).astype(np.float64)
    bound = float(times.max()) * cfg.parts
    x = np.zeros(len(rows))
    y, t = x.copy(), 1.0
    for _ in range(cfg.iterations):
        got = np.bincount(rows[used], weights=np.repeat(y, used.sum(axis=1)), minlength=size)
        gap = np.where(np.arange(size) > 0, got - target, 0.0)
        new = np.maximum(0.0, y - (gap[rows] * used).sum(axis=1) / bound)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(counts: np.ndarray, cfg: PackingConfig = PackingConfig()) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeat counts that use up ``counts`` (index: length, up to ``tokens``) exactly."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []

    def take(row: tuple[int, ...], times: int) -> None:
        for n in row:
            left[n] -= times
        out.append((row, times))

    if left[cfg.tokens]:
        take((cfg.tokens,), int(left[cfg.tokens]))
    rows = patterns(left, cfg)
    repeats = np.floor(fit_repeats(rows, left, cfg) + 1e-9).astype(np.int64)
    for i in np.argsort(-repeats, kind="stable").tolist():
        row = tuple(int(n) for n in rows[i] if n)
        if times := min([int(repeats[i]), *(int(left[n]) // row.count(n) for n in set(row))]):
            take(row, times)
    while (there := np.flatnonzero(left)).size:  # the largest first, then always the largest that still fits
        row, gap, spare = [], cfg.tokens, left.copy()
        while gap > 0 and (fit := there[(there <= gap) & (spare[there] > 0)]).size:
            row.append(int(fit[-1]))
            spare[row[-1]] -= 1
            gap -= row[-1]
        take(tuple(row), min(int(left[n]) // row.count(n) for n in set(row)))
    return out


def slots(made: list[tuple[tuple[int, ...], int]], tokens: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank of each slot, the first sequence and the place in it."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    next_rank, sequence = [0] * (tokens + 1), 0
    for row, times in made:
        place = 0
        for n in row:
            found.setdefault(n, []).append((next_rank[n], sequence, place))
            next_rank[n] += times
            place += n
        sequence += times
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for n, rows in found.items()}


# --- tokens -----------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def encoder(cfg: PackingConfig):
    """Two functions from text to ids: the fast one that is used, and the tokenizers file ``cfg.tokenizer`` it must equal.

    The same vocabulary as byte ranks encodes several times faster. Both are compared here on ``probes`` strings made of
    the vocabulary's own pieces, and in ``pieces`` on a text of each batch.
    """
    import base64

    with open(public_tokenizers.path(cfg.ranks), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    full = Tokenizer.from_file(public_tokenizers.path(cfg.tokenizer))
    special = {SPECIAL: full.token_to_id(SPECIAL)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        return fast.encode(text, allowed_special="all") if SPECIAL in text else fast.encode_ordinary(text)

    def by_library(text: str) -> list[int]:
        return full.encode(text, add_special_tokens=False).ids

    rng, known = random.Random(0), [b.decode("utf-8", "replace") for b in ranks]
    made = ["".join(rng.choices(known, k=rng.randrange(30))) for _ in range(cfg.probes)]
    for probe in ("", " a  b\n\n c\t", "L'été 你好 \U0001f600 don't 12345", f"a{SPECIAL} b", *made):
        if encode(probe) != by_library(probe):
            raise ValueError("the two vocabularies differ")
    return encode, by_library


def pieces(docs: DataFrame, cfg: PackingConfig = PackingConfig()) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each document's ids and the end id, cut where longer than a sequence."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, by_library = encoder(cfg)
        for frame in frames:
            rows: list[tuple] = []
            shortest = min((t or "" for t in frame["text"]), key=len, default="")
            if encode(shortest) != by_library(shortest):
                raise ValueError("the two vocabularies differ")
            for doc_id, text in zip(frame["doc_id"].astype("Int64"), frame["text"], strict=True):
                ids = np.array([*encode(text or ""), cfg.end_id], dtype="<u4")
                first = (len(ids) - 1) % cfg.tokens + 1
                cuts = [0, *range(first, len(ids) + 1, cfg.tokens)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return texts(docs).mapInPandas(run, schema)


# --- places -----------------------------------------------------------------------------------------------------


def _ranked(rows: DataFrame, n: int, cfg: PackingConfig) -> DataFrame:
    """``rows`` with ``rank``, 0, 1, ... within each length, counted over small blocks and sums of blocks.

    A length that holds most rows is spread over many blocks, so no window is large: blocks of about
    ``rank_block`` rows, sums over 1024 blocks at a time, and sums over those.
    """
    blocks = max(1, -(-n // cfg.rank_block))
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks))
    rows = rows.withColumn("block", block)
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    rows = rows.withColumn("r", F.row_number().over(inside) - 1)
    sums = rows.groupBy("length", "block").agg(F.count("*").alias("c")).withColumn("group", F.floor(F.col("block") / 1024))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    near = F.coalesce(F.sum("c").over(before("length", "group").orderBy("block")), F.lit(0))
    groups = sums.groupBy("length", "group").agg(F.sum("c").alias("c"))
    far = groups.select("length", "group", F.coalesce(F.sum("c").over(before("length").orderBy("group")), F.lit(0)).alias("far"))
    starts = sums.withColumn("near", near).join(far, ["length", "group"])
    starts = stored(starts.select("length", "block", (F.col("near") + F.col("far")).alias("first")))
    return rows.join(starts, ["length", "block"]).withColumn("rank", F.col("first") + F.col("r")).drop("block", "r", "first")


def pack(docs: DataFrame, cfg: PackingConfig = PackingConfig()) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty and still have the end id. Null doc_ids and repeated rows are packed like others; an empty
    table packs into nothing; other columns are left behind. Texts are tokenised once, and what goes to the driver
    is the histogram of at most ``tokens`` lengths.
    """
    rows = stored(pieces(docs, cfg))
    counts = np.zeros(cfg.tokens + 1, dtype=np.int64)
    for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r["length"]] = r["n"]
    of_length = slots(plan(counts, cfg), cfg.tokens)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, offset = np.zeros(len(frame), dtype=np.int64), np.zeros(len(frame), dtype=np.int64)
            length, rank = frame["length"].to_numpy(), frame["rank"].to_numpy()
            for n in np.unique(length):
                first, start, at = of_length[int(n)]
                mine = length == n
                slot = np.searchsorted(first, rank[mine], side="right") - 1
                sequence[mine], offset[mine] = start[slot] + rank[mine] - first[slot], at[slot]
            out = frame.drop(columns="rank")
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out.assign(sequence_id=sequence, offset=offset)

    ranked = _ranked(rows, int(counts.sum()), cfg).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.mapInPandas(place, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
