"""Benchmark decontamination by an FM-index per training shard.

Each task cuts its documents into shards, indexes a shard's words, searches all benchmark windows backwards in
the index, locates their occurrences by sampled suffix positions, and merges the spans they cover.

Only runs of benchmark words, and of pairs of them that items have, as long as the shortest window can hold an
occurrence, so the index is built over those runs; and only windows of words that the shard has are searched in it.
Both lose nothing. The benchmark goes to the tasks as word numbers, in blocks of a fixed number of words: however large
it is, no more than one block is held at a time.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atrium.llm.fm_index import FMIndex
from atrium.llm.tables import table, texts, unused
from atrium.storage import ship, stored

#: Words of lower-cased text: not ASCII, or a-z and 0-9 (fixed values).
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@dataclass(frozen=True)
class DecontaminationConfig:
    window: int = 13
    #: A document with hits is contaminated if at least one word in so many is hit.
    one_in: int = 20
    #: Words of benchmark items that go to the tasks at once, as numbers: 8 MB and their vocabulary.
    block_words: int = 2_000_000
    #: Indexed words of a shard, unless one document alone has more, and its documents, at most.
    shard_words: int = 1_000_000
    shard_rows: int = 50_000
    #: Characters of documents that are held back until their shard is searched.
    held_chars: int = 32_000_000


def words(text: str | None) -> list[str]:
    """A-Z lower-cased, then maximal runs of word characters."""
    if not text:
        return []
    return _WORD.findall(text.lower() if text.isascii() else text.translate(_LOWER))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)


@dataclass(frozen=True)
class Block:
    """Benchmark items as word numbers (from 2; 1 is any other word), end to end."""

    items: list[str]
    vocabulary: list[str]
    words: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(items: list[tuple[str, str]]) -> Block:
        number: dict[str, int] = {}
        rows = [[number.setdefault(w, len(number) + 2) for w in words(t)] for _, t in items]
        flat = np.fromiter((i for r in rows for i in r), dtype=np.int32, count=sum(map(len, rows)))
        return Block([i for i, _ in items], list(number), flat, np.array([len(r) for r in rows], dtype=np.int64))


class Phrases:
    """The windows of one block of benchmark items: where they begin, by length, each distinct one once, and its items."""

    _BITS = 25

    def __init__(self, block: Block, window: int):
        self.number = {w: i + 2 for i, w in enumerate(block.vocabulary)}
        self.words, self.items = block.words, block.items
        start = np.cumsum(block.sizes) - block.sizes
        owner = np.repeat(np.arange(len(block.sizes)), block.sizes)
        left = np.repeat(start + block.sizes, block.sizes) - np.arange(len(self.words))  # words of the item from here on
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(np.minimum(block.sizes[block.sizes > 0], window)).tolist():
            at = np.flatnonzero(left >= window) if n == window else start[block.sizes == n]
            self.by_length[n] = self._distinct(at, n, owner)
        self.shortest = min(self.by_length, default=0)
        pair = _mixed(self.words[:-1], self.words[1:])[left[:-1] > 1] if len(self.words) else np.zeros(0, dtype=np.uint64)
        self.pairs = np.zeros(1 << (self._BITS - 3), dtype=np.uint8)
        place = (pair >> np.uint64(64 - self._BITS)).astype(np.int64)
        np.bitwise_or.at(self.pairs, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))

    def rows(self, at: np.ndarray, n: int) -> np.ndarray:
        return self.words[at[:, None] + np.arange(n)]

    def _distinct(self, at: np.ndarray, n: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins of distinct windows, and for each the range of its items in an array of item numbers."""
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(n):
            h = _mixed(h, self.words[at + k])
        order = np.lexsort((owner[at], h))
        at = at[order]
        new = np.ones(len(at), dtype=bool)
        for low in range(1, len(at), 1 << 16):
            part = slice(low, min(len(at), low + (1 << 16)))
            new[part] = (self.rows(at[part], n) != self.rows(at[low - 1 : part.stop - 1], n)).any(axis=1)
        first = np.flatnonzero(new)
        return at[first], np.append(first, len(at)), owner[at]

    def known(self, ids: np.ndarray) -> np.ndarray:
        """Which of a document's words (0: unknown) can be in an occurrence: in runs of words and of pairs that items have."""
        if self.shortest < 2:
            return _runs(ids > 0, self.shortest)
        pair = (_mixed(ids[:-1], ids[1:]) >> np.uint64(64 - self._BITS)).astype(np.int64)
        has = ((self.pairs[pair >> 3] >> (pair & 7).astype(np.uint8)) & 1 == 1) & (ids[:-1] > 0) & (ids[1:] > 0)
        run = _runs(has, self.shortest - 1)
        return np.append(run, False) | np.insert(run, 0, False)


def _runs(known: np.ndarray, least: int) -> np.ndarray:
    """Where ``known`` has runs of at least ``least``."""
    padded = np.concatenate([[False], known, [False]])
    edge = np.flatnonzero(padded[1:] != padded[:-1])
    starts, ends = edge[::2], edge[1::2]
    keep = ends - starts >= least
    mark = np.zeros(len(known) + 1, dtype=np.int64)
    mark[starts[keep]] += 1
    mark[ends[keep]] -= 1
    return np.cumsum(mark[:-1]) > 0


def _search_shard(shard: list[tuple[int, np.ndarray, np.ndarray]], phrases: Phrases) -> dict[int, tuple[list, set]]:
    """``shard``: (row, positions of its indexed words, their numbers). Hit spans and items by row."""
    pieces, owners, places = [], [], []
    for row, at, ids in shard:
        gap = np.flatnonzero(np.diff(at) > 1) + 1  # runs must not touch: another word between
        pieces += [np.insert(ids, gap, 1), [1]]
        places += [np.insert(at, gap, -1), [-1]]
        owners.append(np.full(len(ids) + len(gap) + 1, row))
    text, place, owner = np.concatenate(pieces), np.concatenate(places), np.concatenate(owners)
    index, hits = FMIndex(text), {}
    there = np.zeros(len(phrases.number) + 2, dtype=bool)
    there[text] = True
    absent = np.concatenate([[0], np.cumsum(~there[phrases.words])])
    for n, (begins, ranges, items) in phrases.by_length.items():
        chosen = np.flatnonzero(absent[begins + n] == absent[begins])  # all words are in this shard
        for part in np.array_split(chosen, len(chosen) // 100_000 + 1):
            low, high = index.search(phrases.rows(begins[part], n))
            count = high - low
            which = np.repeat(part, count)
            ranks = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            for k, pos in zip(which.tolist(), index.locate(ranks).tolist(), strict=True):
                spans, of = hits.setdefault(int(owner[pos]), ([], set()))
                spans.append((int(place[pos]), int(place[pos]) + n))
                of.update(items[ranges[k] : ranges[k + 1]].tolist())
    return {row: (merged(spans), of) for row, (spans, of) in hits.items()}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


#: The block that this worker has met last, and its phrases.
_MET: list[tuple[Block, int, Phrases]] = []


def _phrases(block: Block, window: int) -> Phrases:
    if not _MET or _MET[0][0] is not block or _MET[0][1] != window:
        _MET[:] = [(block, window, Phrases(block, window))]
    return _MET[0][2]


def _sharded(batches: Iterator, text_of, held_of, block: Broadcast, cfg: DecontaminationConfig) -> Iterator[tuple[list, list[int], dict]]:
    """Batches put together to shards: what is held of the batches, words by row, and (spans, item numbers) of the rows with hits.

    Where texts are held, so many characters of them end a shard as well.
    """
    phrases = _phrases(block.value, cfg.window)
    get = phrases.number.get
    held, n_words, shard, size, hits, chars = [], [], [], 0, {}, 0
    for batch in batches:
        held.append(held_of(batch))
        for text in text_of(batch):
            found = words(text)
            chars += len(text or "") if held[-1] is batch else 0
            row = len(n_words)
            n_words.append(len(found))
            if not phrases.shortest or len(found) < phrases.shortest:
                continue
            ids = np.fromiter((get(w, 0) for w in found), dtype=np.int64, count=len(found))
            at = np.flatnonzero(phrases.known(ids))
            if len(at):
                shard.append((row, at, ids[at]))
                size += len(at)
                if size >= cfg.shard_words:
                    hits |= _search_shard(shard, phrases)
                    shard, size = [], 0
        if size >= cfg.shard_words // 2 or len(n_words) >= cfg.shard_rows or chars >= cfg.held_chars:
            if shard:
                hits |= _search_shard(shard, phrases)
            yield held, n_words, hits
            held, n_words, shard, size, hits, chars = [], [], [], 0, {}, 0
    if shard:
        hits |= _search_shard(shard, phrases)
    if held:
        yield held, n_words, hits


def _scanner(block: Broadcast, cfg: DecontaminationConfig):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held, n_words, hits in _sharded(frames, lambda f: f["text"], lambda f: f.drop(columns="text"), block, cfg):
            ids = pd.concat([f["doc_id"].astype("Int64") for f in held], ignore_index=True)
            rows = pd.concat([f["row_id"] for f in held], ignore_index=True)
            none: tuple[list, set] = ([], set())
            found = [hits.get(r, none) for r in range(len(n_words))]
            names = block.value.items
            yield pd.DataFrame(
                {
                    "doc_id": ids, "row_id": rows, "n_words": n_words, "starts": [[a for a, _ in s] for s, _ in found],
                    "ends": [[b for _, b in s] for s, _ in found], "items": [sorted({names[i] for i in of}) for _, of in found],
                }
            )

    return run


def _cleaner(block: Broadcast, text_at: int, cfg: DecontaminationConfig):
    """Batches of documents without the contaminated rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, n_words, hits in _sharded(batches, lambda b: b.column(text_at).to_pylist(), lambda b: b, block, cfg):
            keep = np.ones(len(n_words), dtype=bool)
            for row, (spans, _) in hits.items():
                keep[row] = cfg.one_in * sum(b - a for a, b in spans) < n_words[row]
            at = 0
            for batch in held:
                yield batch.filter(pa.array(keep[at : at + batch.num_rows]))
                at += batch.num_rows

    return run


def item_blocks(benchmark: DataFrame, cfg: DecontaminationConfig) -> Iterator[list[tuple[str, str]]]:
    """Benchmark items in blocks of about ``block_words`` words (by bytes, at 6 a word), one held at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("item_id IS NOT NULL AND text IS NOT NULL")
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += 1 + len(r["text"]) // 6
        if size >= cfg.block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def _sent(docs: DataFrame, block: list[tuple[str, str]]) -> Broadcast:
    return docs.sparkSession.sparkContext.broadcast(Block.of(block))


def contamination(docs: DataFrame, benchmark: DataFrame, cfg: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_hit, items (sorted), spans (merged word ranges), contaminated.

    Null and blank texts have no words and no hits; items without words, id or text have no windows. Null doc_ids and
    repeated rows keep a row each. An empty benchmark hits nothing. Other columns are left behind. No shuffle is
    needed while the benchmark fits one block; else the passes over the documents are put together by row.
    """
    base = texts(docs).select("doc_id", F.lit(0).cast("long").alias("row_id"), "text")
    schema = "doc_id bigint, row_id bigint, n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>"
    blocks = item_blocks(benchmark, cfg)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        out = base.mapInPandas(_scanner(_sent(docs, first), cfg), schema)
    else:
        base = stored(base.withColumn("row_id", F.monotonically_increasing_id()))
        parts = []
        for block in itertools.chain([first, second], blocks):
            sent = _sent(docs, block)
            parts.append(stored(base.mapInPandas(_scanner(sent, cfg), schema)))
            sent.destroy()
        every = reduce(DataFrame.unionByName, parts)
        out = every.groupBy("row_id").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    pair = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["upto"], x["end"]).alias("upto"),
        (acc["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(acc["upto"], x["start"]))).alias("n"),
    )
    out = out.withColumn("spans", F.sort_array(pair))
    out = out.withColumn("n_hit", F.aggregate("spans", zero, step, lambda acc: acc["n"]))
    dirty = (F.col("n_hit") > 0) & (cfg.one_in * F.col("n_hit") >= F.col("n_words"))
    return out.select("doc_id", "n_words", "n_hit", "items", "spans", dirty.alias("contaminated"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, cfg: DecontaminationConfig = DecontaminationConfig()) -> DataFrame:
    """``docs`` without the contaminated rows, each judged by its own text; columns stay as they are.

    Rows are judged where they stand. Rows with null or blank text have no hits and stay. Only a benchmark of more
    than one block needs the rows numbered, as the hits of all blocks count together.
    """
    ship(docs.sparkSession)
    blocks = item_blocks(benchmark, cfg)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        text_at = [c.lower() for c in docs.columns].index("text")
        return docs.mapInArrow(_cleaner(_sent(docs, first), text_at, cfg), docs.schema)
    [key] = unused(docs, "row")
    numbered = stored(docs.withColumn(key, F.monotonically_increasing_id()))
    judged = contamination(numbered.select(F.col(key).alias("doc_id"), "text"), benchmark, cfg)
    dirty = stored(judged.where("contaminated").select(F.col("doc_id").alias(key)))
    return numbered.join(dirty, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bp AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i+12], ' ') AS g FROM bp),
lens AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, lens WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS g FROM dp),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT doc_id, i, n, unnest(range(i, i + n)) AS p FROM m),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
