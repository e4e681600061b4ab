"""Repeated passages across documents by paragraph MinHash banding.

Paragraphs (lines) of 8 words and more get MinHash signatures of their 5-word shingles. Signatures are cut into as
many bands as the wanted recall at the similarity asks for; distinct paragraphs that share a band are compared by
exact Jaccard similarity, and those at or above it form components. Paragraphs also stand for parts of themselves:
each text is cut at points that its own words choose, so a passage copied into the middle of other text gives the
same inner parts there. Parts are short; at 5-word shingles two of them are alike when they are equal.

Of a class of paragraphs or parts that occurs in two or more documents, the first place (by doc_id, then position) is
the source. Neighbouring places with one source and one shift against it are a run; its words are compared with the
source's and it grows to both sides as far as they agree, also where the next classes have other sources. Sources are
kept and the others removed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atrium.llm.set_links import ONE, TWO, band_keys, crowded, finer, mix, own, parities, several, word_hashes
from atrium.llm.sieve import sieve
from atrium.llm.tables import table, texts
from atrium.operators.components import connected_components
from atrium.storage import passing, stored

_BASE = 0x9FB21C651E98DF25  # odd, so that powers have inverses modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


@dataclass(frozen=True)
class SubstringConfig:
    shingle: int = 5
    similarity: float = 0.8
    rows: int = 3
    recall: float = 0.985
    #: Shorter paragraphs can only be alike when equal.
    least_paragraph: int = 8
    #: A cut stands where the hash of two neighbouring words is the least among so many places to each side.
    reach: int = 4
    #: Repeated spans of fewer words are not reported. 50 is what passages are in the contract of the query; 8 also gives
    #: short paragraphs.
    least_words: int = 50
    #: Words to each side of a run that are compared at once; where all agree, eight times as many are next.
    context: int = 32
    most_context: int = 4096
    #: Runs of fewer words are not compared with their source. A passage of which other documents hold pieces may have no
    #: longer run with the document that holds all of it.
    least_run: int = 5
    #: Largest band bucket in which all pairs are compared at once; in larger ones see ``crowded``.
    paired: int = 12
    #: Members of a crowded list that one task compares with others.
    block: int = 256
    words_at_once: int = 200_000
    #: Hashes of words around runs that a task holds before it sends them on.
    held_words: int = 250_000
    #: Bytes of texts, shingles or hashes that a task's Python process gets at once.
    batch_bytes: int = 4 << 20

    #: Bands of the finer signatures of members of crowded lists, and their rows.
    fine_bands: int = 16
    fine_rows: int = 6

    @property
    def bands(self) -> int:
        """Bands needed so that two paragraphs at the similarity share one with probability ``recall``."""
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.similarity**self.rows))


class Units:
    """Paragraphs and parts of a batch of texts."""

    def __init__(self, cfg: SubstringConfig):
        self.cfg = cfg

    def __call__(self, batch: list[str]) -> dict[str, np.ndarray]:
        """Arrays over units: row (in the batch), part (0 paragraph, 1 part), start, n_words, h, and bands."""
        cfg = self.cfg
        words: list[str] = []
        line_row, line_len, row_len = [], [], []
        for row, text in enumerate(batch):
            before = len(words)
            for line in text.split("\n"):
                if found := line.split():
                    words += found
                    line_row.append(row)
                    line_len.append(len(found))
            row_len.append(len(words) - before)
        w = word_hashes(words)
        row_len = np.array(row_len, dtype=np.int64)
        row_start = np.cumsum(row_len) - row_len
        n = len(w)
        power = self._powers(n + 1)
        prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(w * power[:n], dtype=np.uint64)])

        def content(start: np.ndarray, size: np.ndarray) -> np.ndarray:
            value = (prefix[start + size] - prefix[start]) * self._inverses(n + 1)[start]
            return mix(value + size.astype(np.uint64) * TWO)

        line_len = np.array(line_len, dtype=np.int64)
        line_start = np.cumsum(line_len) - line_len
        line_row = np.array(line_row, dtype=np.int64)
        cut = self._cuts(w, row_start, row_len)
        part_start = np.flatnonzero(cut)
        part_len = np.diff(np.concatenate([part_start, [n]]))
        part_row = np.repeat(np.arange(len(batch)), row_len)[part_start] if n else part_start
        start, size = np.concatenate([line_start, part_start]), np.concatenate([line_len, part_len])
        row = np.concatenate([line_row, part_row])
        part = np.concatenate([np.zeros(len(line_start), dtype=np.int32), np.ones(len(part_start), dtype=np.int32)])
        h = content(start, size) ^ np.where(part == 1, ONE, np.uint64(0))
        long = line_len >= cfg.least_paragraph
        bands = self._bands(prefix, n, line_start[long], line_len[long])
        return {"row": row, "part": part, "start": start - row_start[row] if n else start, "n_words": size, "h": h, "long": np.flatnonzero(long), "bands": bands}

    def _powers(self, n: int) -> np.ndarray:
        if len(getattr(self, "_p", ())) < n:
            m = max(n, 1 << 18)
            one = np.ones(1, dtype=np.uint64)
            self._p = np.cumprod(np.concatenate([one, np.full(m, _BASE, dtype=np.uint64)]), dtype=np.uint64)
            self._i = np.cumprod(np.concatenate([one, np.full(m, _INVERSE, dtype=np.uint64)]), dtype=np.uint64)
        return self._p

    def _inverses(self, n: int) -> np.ndarray:
        self._powers(n)
        return self._i

    def _cuts(self, w: np.ndarray, row_start: np.ndarray, row_len: np.ndarray) -> np.ndarray:
        """Where a part begins: at the start of a text and at strict local minima of the hash of two words."""
        n, reach = len(w), self.cfg.reach
        cut = np.zeros(n, dtype=bool)
        if not n:
            return cut
        pair = mix(w[1:] * ONE + (w[:-1] ^ TWO))
        score = np.concatenate([np.full(1, np.iinfo(np.uint64).max, dtype=np.uint64), pair])
        first = row_start[row_len > 0]
        score[first] = np.iinfo(np.uint64).max
        pad = np.full(n + reach * (len(row_len) + 1), np.iinfo(np.uint64).max, dtype=np.uint64)
        place = np.arange(n) + reach * (np.repeat(np.arange(len(row_len)), row_len) + 1)
        pad[place] = score
        is_cut = np.ones(n, dtype=bool)
        for k in range(1, reach + 1):
            is_cut &= (score < pad[place - k]) & (score < pad[np.minimum(place + k, len(pad) - 1)])
        cut |= is_cut
        cut[first] = True
        return cut

    def shingles(self, words: list[str]) -> np.ndarray:
        """Distinct shingle hashes of one paragraph, the whole of it where it is shorter than a shingle."""
        w = word_hashes(words)
        power = self._powers(len(w) + 1)
        prefix = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(w * power[: len(w)], dtype=np.uint64)])
        return np.unique(self._shingles(prefix, len(w)))

    def _shingles(self, prefix: np.ndarray, n: int) -> np.ndarray:
        k = min(self.cfg.shingle, n)
        at = np.arange(n - k + 1)
        return mix((prefix[at + k] - prefix[at]) * self._inverses(n + 1)[at])

    def _bands(self, prefix: np.ndarray, n: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        cfg = self.cfg
        if not len(start):
            return np.zeros((0, cfg.bands), dtype=np.int64)
        shingles = np.concatenate([self._shingles(prefix, n), np.zeros(1, dtype=np.uint64)])
        edges = np.stack([start, start + size - cfg.shingle + 1], axis=1).ravel()
        return band_keys(shingles, edges, cfg.bands, cfg.rows)[:, ::2].T


def units(docs: DataFrame, cfg: SubstringConfig = SubstringConfig()) -> DataFrame:
    """``(doc_id, v, part, start, n_words, h, b0, b1, ...)``; bands are null for parts and short paragraphs.

    ``v`` is a hash of the text, so that texts that share a doc_id are told apart. Null texts and ids have no units.
    """
    names = [f"b{i}" for i in range(cfg.bands)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Units(cfg)
        for batch in batches:
            ids, vs, texts_ = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            at = 0
            while at < len(texts_):
                end, size = at, 0
                while end < len(texts_) and (end == at or size < cfg.words_at_once * 6):
                    size += len(texts_[end])
                    end += 1
                u = make(texts_[at:end])
                bands = np.zeros((len(u["h"]), cfg.bands), dtype=np.int64)
                none = np.ones(len(u["h"]), dtype=bool)
                bands[u["long"]], none[u["long"]] = u["bands"], False
                columns = [
                    pa.array(ids[at:end][u["row"]]), pa.array(vs[at:end][u["row"]]), pa.array(u["part"], pa.int32()), pa.array(u["start"].astype(np.int32)),
                    pa.array(u["n_words"].astype(np.int32)), pa.array(u["h"].view(np.int64)),
                    *[pa.array(bands[:, i], mask=none) for i in range(cfg.bands)],
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "v", "part", "start", "n_words", "h", *names])
                at = end

    schema = "doc_id bigint, v bigint, part int, start int, n_words int, h bigint, " + ", ".join(f"{b} bigint" for b in names)
    return _known(docs).mapInArrow(run, schema)


def _known(docs: DataFrame) -> DataFrame:
    return texts(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("v"), "text")


def _candidates(posts: DataFrame, cfg: SubstringConfig) -> tuple[DataFrame, DataFrame]:
    """Pairs to compare first in the buckets of ``posts(key, h)``, and the posts of large buckets.

    In a small bucket all pairs are compared. In a large one all are compared with the least of them; what that
    leaves open is left to ``crowded``.
    """
    sizes = stored(posts.groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("lead")).where("n > 1"))
    met = stored(sieve(posts, "key", sizes).join(sizes, "key"))
    short, large = met.where(F.col("n") <= cfg.paired), met.where(F.col("n") > cfg.paired)
    pairs = short.selectExpr("key", "h AS a").join(short.selectExpr("key", "h AS b"), "key").where("a < b").select("a", "b")
    stars = large.where("h <> lead").selectExpr("lead AS a", "h AS b")
    return pairs.unionByName(stars).distinct(), large.select("key", "h")


def _alike(pairs: DataFrame, sets: DataFrame, cfg: SubstringConfig) -> DataFrame:
    """``(src, dst)`` of the pairs at ``similarity`` or above, by exact Jaccard."""
    both = pairs.join(sets.selectExpr("h AS a", "shingles AS sa"), "a").join(sets.selectExpr("h AS b", "shingles AS sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    alike = common >= cfg.similarity * (F.size("sa") + F.size("sb") - common)
    return stored(both.where(alike).selectExpr("a AS src", "b AS dst"))


def _looked_up(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``(doc_id, v, text, places)`` for distinct ``places(doc_id, v, ...)``, one row for each document with any."""
    rest = [c for c in places.columns if c not in ("doc_id", "v")]
    per_doc = stored(places.groupBy("doc_id", "v").agg(F.collect_list(F.struct(*rest)).alias("places")))
    return sieve(_known(docs), "v", per_doc).join(per_doc, ["doc_id", "v"])


def _shingle_sets(docs: DataFrame, wanted: DataFrame, cfg: SubstringConfig) -> DataFrame:
    """``(h, shingles, p0 .. p3)`` of the wanted paragraphs, read from one document that holds each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Units(cfg)
        for batch in batches:
            hs, sets, odd = [], [], []
            for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.split()
                for p in places:
                    found = make.shingles(words[p["start"] : p["start"] + p["n_words"]])
                    hs.append(p["h"])
                    sets.append(found.view(np.int64))
                    odd.append(parities(found))
            bits = np.array(odd, dtype=np.int64).reshape(len(odd), 4)
            columns = [pa.array(hs, pa.int64()), pa.array(sets, pa.list_(pa.int64())), *[pa.array(bits[:, i]) for i in range(4)]]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "shingles", "p0", "p1", "p2", "p3"])

    schema = "h bigint, shingles array<bigint>, p0 bigint, p1 bigint, p2 bigint, p3 bigint"
    return _looked_up(docs, wanted).select("text", "places").mapInArrow(run, schema).dropDuplicates(["h"])


def similar(docs: DataFrame, found: DataFrame, cfg: SubstringConfig = SubstringConfig()) -> DataFrame:
    """``(h, root)`` for paragraphs that have others at ``similarity`` or above, by exact Jaccard.

    Every pair that shares a band is in one component or was compared, or proved below the similarity.
    """
    with passing(docs.sparkSession) as keep:
        names = [f"b{i}" for i in range(cfg.bands)]
        longs = found.where(F.col("b0").isNotNull())
        distinct = stored(longs.groupBy("h").agg(*[F.min(b).alias(b) for b in names]))
        pairs, large = _candidates(distinct.select("h", F.explode(F.array(*names)).alias("key")), cfg)
        pairs = stored(pairs)
        wanted = stored(pairs.selectExpr("a AS h").unionByName(pairs.selectExpr("b AS h")).distinct())
        places = sieve(longs.select("h", "doc_id", "v", "start", "n_words"), "h", wanted).join(wanted, "h")
        places = places.groupBy("h").agg(F.min(F.struct("doc_id", "v", "start", "n_words")).alias("at")).select("h", "at.*")
        sets = stored(_shingle_sets(docs, places, cfg), cfg.batch_bytes)
        roots = connected_components(_alike(pairs, sets, cfg)).withColumnRenamed("node", "h")
        for more in (lambda m: finer(m, sets, cfg, cfg.batch_bytes), lambda m: crowded(m, sets, cfg)):
            members = several(large, roots)
            if members.isEmpty():
                break
            links = roots.selectExpr("h AS src", "root AS dst").unionByName(_alike(more(members), sets, cfg))
            roots = connected_components(links).withColumnRenamed("node", "h")
        return keep(stored(roots))


# --- spans ------------------------------------------------------------------------------------------------------

_PLACE = ("doc_id", "v", "start", "n_words")


def _hits(found: DataFrame, roots: DataFrame) -> DataFrame:
    """Places of paragraphs and parts of classes that occur in two documents or more, with their class's first place.

    Repeated rows of ``docs`` have their places several times."""
    every = found.selectExpr("h", "doc_id", "CAST(NULL AS BIGINT) AS root").unionByName(roots.selectExpr("h", "CAST(NULL AS BIGINT) AS doc_id", "root"))
    seen = every.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.max("root").alias("root"))
    seen = stored(seen.where("root IS NOT NULL OR first_id <> last_id").withColumn("root", F.coalesce("root", "h")))
    classes = seen.groupBy("root").agg(F.min("first_id").alias("lo"), F.max("last_id").alias("hi")).where("lo <> hi")
    named = stored(seen.join(classes.select(own("root"), "lo"), "root").select("h", "root", "lo"))
    hits = sieve(found.select(*_PLACE, "part", "h"), "h", named).join(named, "h")
    hits = stored(hits)
    sources = hits.where("doc_id = lo").groupBy("root").agg(F.min(F.struct(*_PLACE, "h")).alias("s"))
    hits = hits.drop("lo").join(sources.select(own("root"), "s"), "root")
    return hits.select(*_PLACE, "part", (F.col("s.h") == F.col("h")).alias("equal"), *[F.col(f"s.{c}").alias(f"s_{c}") for c in _PLACE])


def _runs(hits: DataFrame) -> DataFrame:
    """Equal places that meet or overlap and have one source and one shift against it, paragraphs and parts alike, as
    ``(doc_id, v, start, end, s_doc_id, s_v, s_start)``."""
    rows = hits.where("equal AND (doc_id <> s_doc_id OR v <> s_v OR start <> s_start)")
    rows = rows.select("doc_id", "v", "start", (F.col("start") + F.col("n_words")).alias("end"), "s_doc_id", "s_v", (F.col("s_start") - F.col("start")).alias("shift"))
    one = ["doc_id", "v", "s_doc_id", "s_v", "shift"]
    order = Window.partitionBy(*one).orderBy("start", "end")
    apart = F.coalesce(F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    rows = rows.withColumn("new", apart.cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy(*one, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return rows.select("doc_id", "v", "start", "end", "s_doc_id", "s_v", (F.col("start") + F.col("shift")).alias("s_start"))


_NONE = np.zeros(0, dtype=np.uint64)


def _hashes_around(words: list[str], places: list[tuple[int, int]], context: int) -> Callable[[int, int], tuple[np.ndarray, np.ndarray]]:
    """What gives the hashes of up to ``context`` words before and after a place, nearest first. A word that many places
    have around them is hashed once."""
    low = max(0, min((a for a, _ in places), default=0) - context)
    high = min(len(words), max((b for _, b in places), default=0) + context)
    if context and high - low <= 2 * context * len(places):
        h = word_hashes(words[low:high])
        return lambda a, b: (h[max(0, a - context - low) : a - low][::-1], h[b - low : b - low + context])
    return lambda a, b: (word_hashes(words[max(0, a - context) : a][::-1]), word_hashes(words[b : b + context])) if context else (_NONE, _NONE)


def _surroundings(docs: DataFrame, places: DataFrame, cfg: SubstringConfig, context: int) -> DataFrame:
    """``places(doc_id, v, start, end, ...)`` with a digest of the words there, and hashes of those around, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: pa.RecordBatch, begins: int, taken: list, digests: list, around: list) -> pa.RecordBatch:
            at, own = pa.array(taken, pa.int64()), rows.column(3).flatten().slice(begins, len(taken))
            columns = [rows.column(i).take(at) for i in (0, 1)] + own.flatten() + [pa.array(digests, pa.binary())]
            for hashes in around:
                ends = np.cumsum([0, *map(len, hashes)], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([_NONE, *hashes]).view(np.int64))))
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "v", *(f.name for f in own.type), "digest", "before", "after"])

        for batch in batches:
            places = batch.column(3).flatten()
            starts, ends = places.field("start").to_pylist(), places.field("end").to_pylist()
            done, at, held, taken, digests, before, after = 0, 0, 0, [], [], [], []
            for k, (text, n) in enumerate(zip(batch.column(2), batch.column(3).value_lengths().to_pylist(), strict=True)):
                words = text.as_py().split()
                own = list(zip(starts[at : at + n], ends[at : at + n], strict=True))
                around = _hashes_around(words, own, context)
                for i, (a, b) in enumerate(own):
                    digests.append(hashlib.sha256(" ".join(words[a:b]).encode("utf-8", "surrogatepass")).digest())
                    taken.append(k)
                    left, right = around(a, b)
                    before.append(left)
                    after.append(right)
                    held += len(left) + len(right)
                    if held > cfg.held_words:
                        yield packed(batch, done, taken, digests, [before, after])
                        done, held = at + i + 1, 0
                        taken, digests, before, after = [], [], [], []
                at += n
            yield packed(batch, done, taken, digests, [before, after])

    kinds = dict(places.dtypes)
    rest = ", ".join(f"{c} {kinds[c]}" for c in places.columns if c not in ("doc_id", "v"))
    schema = f"doc_id bigint, v bigint, {rest}, digest binary, before array<bigint>, after array<bigint>"
    return _looked_up(docs, places).select("doc_id", "v", "text", "places").mapInArrow(run, schema)


_SPAN = ("doc_id", "v", "start", "end", "s_doc_id", "s_v", "s_start", "s_end")


def _compared(docs: DataFrame, spans: DataFrame, cfg: SubstringConfig, context: int) -> DataFrame:
    """The spans whose words are their source's, by digest, with ``left`` and ``right``: up to ``context`` words around that
    agree as well, by 64 bits of their hashes."""
    source = ["s_doc_id", "s_v", "s_start", "s_end"]
    own = spans.select(*_SPAN)
    wanted = spans.select(*[F.col(s).alias(s[2:]) for s in source]).distinct().selectExpr("*", *[f"CAST(NULL AS {t}) AS {s}" for s, t in spans.select(*source).dtypes])
    around = stored(_surroundings(docs, own.unionByName(wanted), cfg, context), cfg.batch_bytes)
    of_source = around.where("s_doc_id IS NULL").select(*[F.col(c).alias(f"s_{c}") for c in ("doc_id", "v", "start", "end", "digest", "before", "after")])
    both = around.where("s_doc_id IS NOT NULL").join(of_source, source).where("digest = s_digest")

    if not context:
        return both.select(*_SPAN, F.lit(0).alias("left"), F.lit(0).alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = [pa.array(_agreeing(batch.column(c), batch.column(f"s_{c}"))) for c in ("before", "after")]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(_SPAN)], *alike], names=[*_SPAN, "left", "right"])

    kinds = dict(both.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in _SPAN) + ", left int, right int"
    return both.select(*_SPAN, "before", "after", "s_before", "s_after").mapInArrow(run, schema)


def _agreeing(one: pa.ListArray, other: pa.ListArray) -> np.ndarray:
    """How many of the first members of two lists are equal, row by row."""
    sizes = [x.value_lengths().to_numpy() for x in (one, other)]
    size = np.minimum(*sizes).astype(np.int64)
    begins = np.cumsum(size) - size
    at = np.arange(int(size.sum()))
    values = [x.flatten().to_numpy()[at + np.repeat(np.cumsum(n, dtype=np.int64) - n - begins, size)] for x, n in zip((one, other), sizes, strict=True)]
    # The first place that differs: of those in order, the first that is not before the row's begin; its end where none is left.
    differs = np.append(np.flatnonzero(values[0] != values[1]), len(at))
    return np.minimum(differs[np.searchsorted(differs, begins)] - begins, size).astype(np.int32)


def _grown(docs: DataFrame, runs: DataFrame, cfg: SubstringConfig) -> DataFrame:
    """Runs whose words are the source's, with all words around them that agree as well; those of ``least_words`` and more.

    A run of which a whole side agrees is looked at again with a wider one, so a run ends where its words differ from the
    source's, whatever other documents hold pieces of it. What has grown in its last round is compared by digest once more.
    """
    now = runs.withColumn("s_end", (F.col("s_start") + F.col("end") - F.col("start")).cast("int")).select(*_SPAN).distinct()
    context, sure, grown = cfg.context, [], []
    while True:
        with passing(docs.sparkSession) as keep:
            found = _compared(docs, now, cfg, context)
            wider = found.select(
                "doc_id", "v", (F.col("start") - F.col("left")).alias("start"), (F.col("end") + F.col("right")).alias("end"),
                "s_doc_id", "s_v", (F.col("s_start") - F.col("left")).alias("s_start"), (F.col("s_end") + F.col("right")).alias("s_end"),
                (F.greatest("left", "right") >= context).alias("open"), (F.greatest("left", "right") == 0).alias("same"),
            )
            wider = keep(stored(wider.distinct(), cfg.batch_bytes))
        done = wider.where("NOT open AND end - start >= " + str(cfg.least_words))
        sure.append(done.where("same").select(*_SPAN))
        grown.append(done.where("NOT same").select(*_SPAN))
        now = wider.where("open").select(*_SPAN)
        if now.isEmpty():
            break
        context = min(8 * context, cfg.most_context)
    checked = _compared(docs, stored(reduce(DataFrame.unionByName, grown).distinct()), cfg, 0).select(*_SPAN)
    return reduce(DataFrame.unionByName, sure, checked)


def _outermost(spans: DataFrame) -> DataFrame:
    """Spans without those that lie inside another of their document."""
    order = Window.partitionBy("doc_id", "v").orderBy("start", F.desc("end"), "first_doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("upto", F.max("end").over(order)).where("upto IS NULL OR end > upto").drop("upto")


def repeated(docs: DataFrame, cfg: SubstringConfig = SubstringConfig()) -> DataFrame:
    """``(doc_id, start, end, first_doc_id, removed)``: spans of ``least_words`` words or more that also stand in another
    document, or whose paragraph has one alike there.

    ``start`` and ``end`` count the text's white-space separated words, end exclusive. A removed span's words are those of
    its source in ``first_doc_id`` one by one, or it is a paragraph whose component has its first place there. Where the
    source changes a new span begins; spans may overlap, but none lies inside another. ``removed`` is false for sources,
    whose spans are put together where they meet. A span within the first document's own text may be a repeat of another
    place there. Null texts and null ids have no spans, nor have texts that share nothing; an empty table gives no rows.
    Repeated rows count as one document, texts that share a doc_id as one document with several texts. Other columns are
    left behind.
    """
    found = stored(units(docs, cfg), cfg.batch_bytes)
    hits = _hits(found, similar(docs, found, cfg))
    runs = stored(_runs(hits).where(F.col("end") - F.col("start") >= cfg.least_run))
    near = hits.where("NOT equal").selectExpr("doc_id", "v", "start", "start + n_words AS end", "s_doc_id", "s_v", "s_start", "s_start + s_n_words AS s_end")
    spans = _grown(docs, runs, cfg).unionByName(near)
    spans = stored(spans.where((F.col("end") - F.col("start") >= cfg.least_words)))
    removed = _outermost(spans.select("doc_id", "v", "start", "end", F.col("s_doc_id").alias("first_doc_id")).distinct())
    kept = spans.selectExpr("s_doc_id AS doc_id", "s_v AS v", "s_start AS start", "s_end AS end").distinct()
    order = Window.partitionBy("doc_id", "v").orderBy("start", "end")
    apart = F.coalesce(F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    kept = kept.withColumn("new", apart.cast("int")).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = kept.groupBy("doc_id", "v", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    out = removed.select("doc_id", "start", "end", "first_doc_id", F.lit(True).alias("removed"))
    out = out.unionByName(kept.select("doc_id", "start", "end", F.col("doc_id").alias("first_doc_id"), F.lit(False).alias("removed")))
    return out.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "first_doc_id", "removed")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents"))
