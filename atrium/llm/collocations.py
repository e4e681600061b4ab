"""Phrase collocations by top-order marginalisation.

Every word of a piece of text begins one window: itself and the next two words, padded where the piece ends. Only these
longest windows are counted, on arrays of word codes, a task at a time; one shuffle by their first two words adds the
counts up. There windows under the threshold give up their last word and, where even two words stay under it, the
second. Spark's ROLLUP over what is left sums the windows of each shorter prefix: counts of two words, of one, and of all.
So no shorter phrase is ever counted on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atrium.llm.divergence import slices
from atrium.llm.tables import table
from atrium.storage import ship, stored

#: What ends a piece, as a class of a regular expression.
ENDS = r"[.,;:!?\x0A-\x0D]"


@dataclass(frozen=True)
class CollocationConfig:
    #: Occurrences that a candidate has at least.
    least: int = 10
    #: Per cent of a candidate's occurrences inside one longer candidate that drop it.
    inside: int = 50
    #: Phrases of a language in the report; this is the feature's limit.
    top: int = 2000
    #: Bytes of text whose windows are counted at once in a task.
    text_bytes: int = 16 << 20
    #: Bytes of text that are split into words at once.
    split_bytes: int = 1 << 20


def _coded(part: pa.RecordBatch, langs: np.ndarray, most: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some rows ``(lang, text)`` in order, each place's word by its number there from 1, and its language.

    Where a piece or a text ends the number is 0. ``most`` bytes of text are split at once, so that only numbers are held
    of the others.
    """
    found, lang, at = [], [], 0
    for few in slices(part, 1, most):
        marked = pc.replace_substring_regex(pc.ascii_lower(few.column(1)), pattern=ENDS + "+", replacement=" \n ")
        lists = pc.split_pattern_regex(pc.binary_join_element_wise(marked, "\n", " "), pattern="[ \t]+")
        words = lists.flatten()
        full = pc.not_equal(words, "")
        lang.append(langs[at + pc.list_parent_indices(lists).filter(full).to_numpy()])
        found.append(words.filter(full).dictionary_encode())
        at += few.num_rows
    coded = pa.chunked_array(found, pa.dictionary(pa.int32(), pa.string())).unify_dictionaries()
    words = coded.chunk(0).dictionary if found else pa.array([], pa.string())
    order = pc.array_sort_indices(words)
    place = np.zeros(len(order), dtype=np.int32)
    place[order.to_numpy()] = np.arange(1, len(order) + 1)
    if (end := pc.index(words, "\n").as_py()) >= 0:
        place[end] = 0
    none = [np.zeros(0, dtype=np.int32)]
    return words.take(order), np.concatenate([*(place[c.indices.to_numpy()] for c in coded.chunks), *none]), np.concatenate([*lang, *none])


def _joined(columns: list[np.ndarray], size: int, most: int = 1 << 62) -> tuple[np.ndarray, list]:
    """A number under ``most`` for each place of some columns, in their order, and what ``_parted`` needs. All but the first are under ``size``."""
    key, known = columns[0].astype(np.int64), []
    bound = int(key.max(initial=0)) + 1
    for c in columns[1:]:
        known.append(None)
        if bound > most // size:
            known[-1], key = np.unique(key, return_inverse=True)
            bound = len(known[-1])
        key *= size
        key += c
        bound *= size
    return key, known


def _parted(key: np.ndarray, known: list, size: int) -> list[np.ndarray]:
    columns = []
    for values in reversed(known):
        key, last = np.divmod(key, size)
        columns.append(last)
        key = key if values is None else values[key]
    return [key, *reversed(columns)]


def _windows(part: pa.RecordBatch, most: int, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """``(head, w3, n)``, the distinct windows of some rows ``(lang, text)`` in their order; what is padding is left out.

    ``head`` is the first two words and the language in one string, which makes shorter rows to shuffle. Windows are sorted
    and counted as numbers; ``rows`` of them at a time get their words.
    """
    langs = part.column(0).dictionary_encode()
    words, w1, lang = _coded(part, langs.indices.to_numpy(), most)
    size, begins = len(words) + 1, np.flatnonzero(w1)
    ahead = np.concatenate([w1, np.zeros(2, dtype=np.int32)])
    w2, w3 = ahead[begins + 1], ahead[begins + 2]
    w3[w2 == 0] = 0
    columns = [lang[begins], w1[begins], w2, w3]
    del w1, lang, ahead, begins
    key, known = _joined(columns, size)
    del columns, w2, w3
    key.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1]]))
    ends = np.append(first[1:], len(key))
    for at in range(0, len(first), rows):
        own = first[at : at + rows]
        lang, *codes = _parted(key[own], known, size)
        named = [words.take(pa.array(c - 1, mask=c == 0)) for c in codes]
        head = pc.binary_join_element_wise(*named[:2], " ", null_handling="skip")
        head = pc.binary_join_element_wise(head, langs.dictionary.take(pa.array(lang)), "\t")
        yield pa.RecordBatch.from_arrays([head, named[2], pa.array(ends[at : at + rows] - own)], names=["head", "w3", "n"])


def windows(docs: DataFrame, cfg: CollocationConfig = CollocationConfig()) -> DataFrame:
    """``(head, w3, n)``: longest windows with their number among the texts that a task counted together.

    They come in order, so that neighbours in a shuffle block share their first words and compress well.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, cfg.text_bytes):
                yield from _windows(part, cfg.split_bytes)
                pa.default_memory_pool().release_unused()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "head string, w3 string, n bigint")


def counts(docs: DataFrame, cfg: CollocationConfig = CollocationConfig()) -> DataFrame:
    """``(lang, w1, w2, w3, f)``: occurrences of phrases of up to three words, those of at least ``least`` only.

    ``w2`` and ``w3`` are null in shorter phrases; a row without words has the number of all words of the language.
    """
    longest = windows(docs, cfg).repartition("head").groupBy("head", "w3").agg(F.sum("n").alias("n"))
    longest = longest.withColumn("both", F.sum("n").over(Window.partitionBy("head"))).withColumn("words", F.substring_index("head", "\t", 1))
    second = F.when(F.col("words").contains(" "), F.substring_index("words", " ", -1))
    # A last word that is too rare goes, then the second: the shorter prefix keeps the occurrences.
    cut = longest.select(
        F.expr("substring(head, length(words) + 2)").alias("lang"), F.substring_index("words", " ", 1).alias("w1"),
        F.when(F.col("both") >= cfg.least, second).alias("w2"), F.when(F.col("n") >= cfg.least, F.col("w3")).alias("w3"), "n",
    )
    folded = stored(cut.groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n")))
    level = F.grouping_id().alias("level")
    rolled = folded.rollup("lang", "w1", "w2", "w3").agg(F.sum("n").alias("f"), level)
    # Level 0: three words, 1: two, 3: one, 7: all of a language. A padded prefix is no phrase of that length.
    phrase = F.col("level").isin(0, 1, 3) & F.when(F.col("level") == 0, F.col("w3").isNotNull()).when(F.col("level") == 1, F.col("w2").isNotNull()).otherwise(True)
    return rolled.where((phrase & (F.col("f") >= cfg.least)) | (F.col("level") == 7)).select("lang", "w1", "w2", "w3", "f")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a^2 / (left right)) in decimals."""
    exact = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (exact(a) * exact(a)).cast("decimal(31,0)"), exact(left) * exact(right))


def collocations(docs: DataFrame, cfg: CollocationConfig = CollocationConfig()) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of two and three words of each language.

    A candidate has ``least`` occurrences ``a`` or more. Each cut of it has the occurrences ``l`` and ``r`` of its two
    parts and a score of floor(1000000 a^2 / (l r)); the cut with the least score counts, the earliest of equals. A
    candidate goes if a longer one that holds it has ``inside`` per cent of its occurrences. The order is by score, then
    by ``a``, then by the phrase's bytes.

    Null texts are empty, a null language is ``und``. Repeated rows count each time. Texts without words and empty tables
    give no rows; other columns are left behind. Scores are exact up to 10^15 occurrences of a phrase.
    """
    found = stored(counts(docs, cfg))
    one = found.where("w1 IS NOT NULL AND w2 IS NULL").select("lang", "w1", "f")
    two = found.where("w2 IS NOT NULL AND w3 IS NULL").select("lang", "w1", "w2", "f")
    three = found.where("w3 IS NOT NULL").select("lang", "w1", "w2", "w3", F.col("f").alias("a"))
    total = found.where("w1 IS NULL").select("lang", F.col("f").alias("n"))
    word = lambda at, as_: one.select("lang", F.col("w1").alias(at), F.col("f").alias(as_))
    held = three.select("lang", "a", F.inline(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))))
    held = held.groupBy("lang", "w1", "w2").agg(F.max("a").alias("most"))
    pairs = two.withColumnRenamed("f", "a").join(held, ["lang", "w1", "w2"], "left").where(f"coalesce(100 * most, 0) < {cfg.inside} * a")
    pairs = pairs.join(word("w1", "l"), ["lang", "w1"]).join(word("w2", "r"), ["lang", "w2"])
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    rows = three.join(two.withColumnRenamed("f", "l2"), ["lang", "w1", "w2"])
    rows = rows.join(two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("r1")), ["lang", "w2", "w3"])
    rows = rows.join(word("w1", "l1"), ["lang", "w1"]).join(word("w3", "r2"), ["lang", "w3"])
    cut = lambda left, right: F.struct(_score(F.col("a"), F.col(left), F.col(right)).alias("score"), F.col(left).alias("l"), F.col(right).alias("r"))
    rows = rows.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", cut("l1", "r1").alias("x"), cut("l2", "r2").alias("y"))
    rows = rows.withColumn("x", F.when(F.col("x.score") <= F.col("y.score"), F.col("x")).otherwise(F.col("y")))
    every = pairs.unionByName(rows.select("lang", "phrase", "a", "x.l", "x.r", "x.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH pieces AS (SELECT row_number() OVER () AS id, lang, piece FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '{ENDS}')) AS piece FROM documents)),
words AS (SELECT id, lang, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM (SELECT id, lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces)),
ahead AS (SELECT lang, w1, lead(w1) OVER piece AS w2, lead(w1, 2) OVER piece AS w3 FROM words WINDOW piece AS (PARTITION BY id ORDER BY i)),
grams AS (SELECT lang, 1 AS k, [w1] AS g FROM ahead UNION ALL SELECT lang, 2, [w1, w2] FROM ahead WHERE w2 IS NOT NULL
 UNION ALL SELECT lang, 3, [w1, w2, w3] FROM ahead WHERE w3 IS NOT NULL),
f AS (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY lang, k, g),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, g, f AS a FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.lang, c.k, c.g, c.a, s.k AS cut, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
 FROM cand c JOIN (VALUES (1), (2)) AS s(k) ON s.k < c.k
 JOIN f l ON l.lang = c.lang AND l.g = c.g[1:s.k] JOIN f r ON r.lang = c.lang AND r.g = c.g[s.k + 1:c.k]),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS first FROM cuts),
longer AS (SELECT lang, part, max(a) AS most FROM (SELECT lang, a, unnest([g[1:2], g[2:3]]) AS part FROM cand WHERE k = 3) GROUP BY lang, part),
kept AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, b.score
 FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.part = b.g WHERE b.first = 1 AND 100 * coalesce(o.most, 0) < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
