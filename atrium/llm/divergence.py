"""Source divergence audit: how far the word use of each source is from that of the others in its language.

Arrow's compute functions count terms inside ``mapInArrow``: texts are lower-cased and split there, terms become codes of
a dictionary, and two hashed groupings give occurrences and documents of each (language, source, term) of a batch. Spark
adds these partial counts up. The terms that are kept are dealt to shards by their hash; a shard is one matrix of
sources by terms, which gives partial sums for each pair of sources and the terms that stand out most there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atrium.llm.tables import table
from atrium.storage import ship, stored

#: What stands between terms: ASCII other than letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class DivergenceConfig:
    #: Documents of a language in which a term must be to be kept.
    least_docs: int = 3
    #: Probabilities are whole numbers of this part.
    scale: int = 1_000_000_000
    #: Terms reported for a source; this is the feature's limit.
    top: int = 200
    #: Bytes of text that are split at once, and counted rows that are held before they are sent on.
    text_bytes: int = 4 << 20
    held_rows: int = 250_000
    #: Cells of one shard's matrix of sources by terms, where there are not too many sources for that.
    cells: int = 1 << 20


_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with up to ``most`` bytes in a text column; a longer text is a slice of its own."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, end - at)
        at, done = end, int(ends[end - 1])


def _count(part: pa.RecordBatch) -> pa.Table:
    """``(lang, source, term, n, docs)`` of a few rows ``(lang, source, text)``."""
    lists = pc.split_pattern_regex(pc.ascii_lower(part.column(2)), pattern=BETWEEN)
    terms, rows = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.not_equal(terms, "")
    terms, rows = terms.filter(full).dictionary_encode(), rows.filter(full)
    in_doc = pa.table({"row": rows, "code": terms.indices}).group_by(["row", "code"]).aggregate([([], "count_all")])
    codes = [part.column(i).dictionary_encode() for i in (0, 1)]
    rows = in_doc.column("row")
    keyed = {"lang": codes[0].indices.take(rows), "source": codes[1].indices.take(rows), "code": in_doc.column("code"), "n": in_doc.column("count_all")}
    found = pa.table(keyed).group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ("n", "count")])
    named = [c.dictionary.take(found.column(k).combine_chunks()) for k, c in (("lang", codes[0]), ("source", codes[1]), ("code", terms))]
    return pa.table([*named, found.column("n_sum"), found.column("n_count")], names=["lang", "source", "term", "n", "docs"])


def _merged(held: list[pa.Table]) -> pa.Table:
    """The sums of some tables, in order of terms, so that rows of one term go to a shuffle side by side and compress well."""
    found = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    found = found.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])
    return found.sort_by([("lang", "ascending"), ("term", "ascending")])


def partial_counts(docs: DataFrame, cfg: DivergenceConfig = DivergenceConfig()) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents as each task counts them, to be added up."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for part in slices(batch, 2, cfg.text_bytes):
                held.append(_count(part))
                if sum(t.num_rows for t in held) > cfg.held_rows:
                    held = [_merged(held)]
                    if held[0].num_rows > cfg.held_rows // 2:
                        yield from held.pop().combine_chunks().to_batches()
                    pa.default_memory_pool().release_unused()
        if held:
            yield from _merged(held).combine_chunks().to_batches()

    return _named(docs, "lang", "source", "text").mapInArrow(run, _COUNTS)


def _named(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns as strings, empty for null."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names])


def kept_terms(partial: DataFrame, cfg: DivergenceConfig = DivergenceConfig()) -> DataFrame:
    """``(lang, term, held)`` for each term of enough documents, with the count of each source that has it."""
    each = partial.repartition("lang", "term").groupBy("lang", "source", "term")
    each = each.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("held"))
    return terms.where(F.col("docs") >= cfg.least_docs).select("lang", "term", "held")


def probabilities(counts: np.ndarray, total: np.ndarray, n_terms: int, scale: int) -> np.ndarray:
    """1 + floor(scale * (count + 1) / (total + n_terms)), exact also where the products pass 64 bits."""
    if counts.size and int(counts.max()) >= (1 << 62) // scale:
        counts, total = counts.astype(object), total.astype(object)
    return (1 + scale * (counts + 1) // (total + n_terms)).astype(np.int64)


def _shard(batches: Iterator[pa.RecordBatch], cfg: DivergenceConfig) -> Iterator[pa.RecordBatch]:
    """Rows ``(lang, source, part, item, value)`` of shards ``(lang, v, sources, terms)``: sums over the shard's terms for
    pairs of sources, and of its terms the first that stand out for a source."""
    for batch in batches:
        for k in range(batch.num_rows):
            lang, v = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            sources = batch.column(2)[k].values
            names, totals = sources.field("source"), sources.field("total").to_numpy().astype(np.int64)
            n = len(names)
            rows: list[tuple] = []
            pair = np.zeros((n, n), dtype=np.int64)
            terms = batch.column(3)[k].values
            if terms is not None and len(terms):
                lists = terms.field("held")
                at = np.repeat(np.arange(len(terms)), lists.value_lengths().to_numpy())
                held = lists.flatten()
                counts = np.zeros((n, len(terms)), dtype=np.int64)
                counts[pc.index_in(held.field("source"), value_set=names).to_numpy(), at] = held.field("n").to_numpy()
                p = probabilities(counts, totals[:, None], v, cfg.scale)
                q = probabilities(counts.sum(axis=0), totals.sum(), v, cfg.scale)
                words = terms.field("term")
                order = np.argsort(pc.array_sort_indices(words).to_numpy())  # place of each term in the order of its bytes
                for a in range(n):
                    apart = p[a] - p
                    pair[a] = (apart * apart // p).sum(axis=1)
                    out = np.flatnonzero((counts[a] > 0) & (p[a] > q))
                    value = (p[a, out] - q[out]) ** 2 // q[out]
                    first = np.lexsort((order[out], -value))[: cfg.top]
                    rows += zip([a] * len(first), words.take(pa.array(out[first])).to_pylist(), value[first].tolist(), strict=True)
            a, b = np.nonzero(~np.eye(n, dtype=bool))
            source = np.concatenate([a, np.array([r[0] for r in rows], dtype=np.int64)])
            item = pa.concat_arrays([names.take(pa.array(b)).cast(pa.string()), pa.array([r[1] for r in rows], pa.string())])
            value = np.concatenate([pair[a, b], np.array([r[2] for r in rows], dtype=np.int64)])
            part = pa.array(["pair"] * len(a) + ["term"] * len(rows), pa.string())
            columns = [pa.array([lang] * len(source), pa.string()), names.take(pa.array(source)).cast(pa.string()), part, item, pa.array(value)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "part", "item", "value"])


def divergences(docs: DataFrame, cfg: DivergenceConfig = DivergenceConfig()) -> DataFrame:
    """``(lang, source, part, item, value, rank)``.

    Part ``pair``: for each two sources of a language the sum of floor((p - q)^2 / q) over the language's kept terms, p and
    q being smoothed probabilities of the term in the one and in the other. Part ``term``: the ``top`` terms of a source
    that are likelier there than in the whole language, q then being the language's. Ranks go by value and, among equals,
    by the bytes of the item.

    Null text, language and source are empty strings; a repeated row counts again, as a document of its own. A language
    without kept terms has pairs of value 0; a language of one source has no pairs. An empty table gives no rows. Other
    columns are left behind. The result has a row for each two sources of a language, so their number is what bounds it;
    a shard holds as many terms as a language has sources or more, so the partial sums are no more than the counts.
    """
    kept = stored(kept_terms(partial_counts(docs, cfg), cfg))
    n_terms = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = kept.select("lang", F.inline("held")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = _named(docs, "lang", "source").distinct().join(totals, ["lang", "source"], "left")
    order = F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).cast("long").alias("total"))))
    langs = groups.groupBy("lang").agg(order.alias("sources")).join(n_terms, "lang", "left")
    langs = stored(langs.select("lang", F.coalesce("v", F.lit(0)).cast("long").alias("v"), "sources"))
    size = F.greatest(F.lit(cfg.cells), F.size("sources") * F.size("sources"))
    shards = langs.agg(F.max(F.ceil(F.col("v") * F.size("sources") / size))).first()[0] or 1
    dealt = kept.groupBy("lang", F.pmod(F.xxhash64("term"), F.lit(shards)).alias("shard")).agg(F.collect_list(F.struct("term", "held")).alias("terms"))
    spread = langs.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    rows = spread.join(dealt, ["lang", "shard"], "left").select("lang", "v", "sources", "terms")
    found = stored(rows.mapInArrow(lambda batches: _shard(batches, cfg), "lang string, source string, part string, item string, value bigint"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= cfg.top)
    return pairs.withColumn("rank", rank).unionByName(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT s.lang, s.source, kept.term, coalesce(c.n, 0) AS n,
  CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + v.v) AS HUGEINT) AS p
 FROM s JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = kept.term),
q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(total) + any_value(v)) AS HUGEINT) AS q
 FROM c JOIN (SELECT lang, sum(total) AS total FROM s GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
 FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value
 FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
 FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
