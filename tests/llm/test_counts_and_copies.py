"""Collocations, MinHash near-duplicates and source divergence against brute force, and on odd input."""

import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from atrium.llm import collocations, divergence, minhash_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("n", "w1", "w2", "f", "score", "rank", "phrase", "term", "held", "h", "r", "n", "d1", "bands", "bits", "root", "key", "component_id", "kept", "part", "item", "value", "level", "shard")
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t..", None, None), (4, "one", "en", None), (5, "one two", "en", "b"), (5, "one two", "en", "b"), (5, "other text", "en", "b"),
    (6, "Ünï cödé ÜNÏ 你好 \U0001f600 x\x00y", None, "a"), (None, "No id, here at all: no id", "en", "b"), (None, None, None, None), (7, "aa " * 5000, "fr", "a"), (8, "x" * 30000, "fr", "b"),
    (9, "a b a b a b; a b\x0ba b!a b?a\tb", "en", "c"), (10, "no kept terms", "zz", "a"), (11, "but two sources", "zz", "b"), (12, "a  b c d", "en", "c"), (13, "\x1f\x00 q", "en", "c"),
]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return _docs(spark, ODD).withColumns({c: F.lit(1) for c in CLASH})


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- collocations


def _phrases(rows, cfg):
    out = []
    for lang in {r[2] if r[2] is not None else "und" for r in rows}:
        f = collections.Counter()
        for _, text, own, _ in rows:
            if (own if own is not None else "und") == lang:
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", _lower(text)):
                    w = re.findall(r"[^\x20\x09]+", piece)
                    f.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
        n = sum(v for g, v in f.items() if len(g) == 1)
        found = []
        for g, a in f.items():
            if len(g) > 1 and a >= cfg.least:
                score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                held = [v for t, v in f.items() if len(t) == 3 and len(g) == 2 and v >= cfg.least and g in (t[:2], t[1:])]
                if not any(100 * v >= cfg.inside * a for v in held):
                    found.append((score, a, " ".join(g), f[g[:k]], f[g[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, rank, p, a, left, right, n, score) for rank, (score, a, p, left, right) in enumerate(found[: cfg.top], 1)]
    return sorted(out)


def _rows(df, *names):
    return sorted(tuple(r[c] for c in names) for r in df.select(*names).collect())


PHRASE = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("text_bytes", [32 << 20, 40])
def test_collocations(spark, odd, text_bytes):
    rng = random.Random(1)
    words = ["the", "of", "in", "new", "york", "city", "san", "jose", "Big", "é", "the,", "of.", "new\nyork", "a"]
    rows = [(i, " ".join(rng.choices(words, [9, 8, 7, 3, 3, 2, 2, 2, 1, 1, 1, 1, 1, 1], k=rng.randrange(60))), rng.choice(["en", "de", None]), "s") for i in range(120)]
    rows += [(i, "rare but fixed phrase", "en", "s") for i in range(12)]
    cfg = collocations.CollocationConfig(top=40, text_bytes=text_bytes)
    assert _rows(collocations.collocations(_docs(spark, rows), cfg), *PHRASE) == _phrases(rows, cfg)
    cfg = collocations.CollocationConfig(least=2, text_bytes=text_bytes)
    assert _rows(collocations.collocations(odd, cfg), *PHRASE) == _phrases(ODD, cfg)
    assert collocations.collocations(odd.where("false")).count() == 0


def test_windows_hold_few_bytes():
    """A task holds numbers of its words, and strings of a small part of them only."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(3000)], k=300)) + "." for _ in range(2000)]
    part = pa.RecordBatch.from_arrays([pa.array(["en", "de"] * 1000), pa.array(texts)], names=["lang", "text"])
    usual, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        n = sum(pc.sum(found.column(2)).as_py() for found in collocations._windows(part, 1 << 18))
        of_numpy = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(usual)
    words = 300 * 2000
    assert n == words
    assert pool.max_memory() + of_numpy < 60 * words


@pytest.mark.parametrize("most", [1 << 62, 9000, 2000])
def test_numbers_of_windows(most):
    rng = np.random.default_rng(5)
    columns = [rng.integers(0, 3, 200), *(rng.integers(0, 20, 200) for _ in range(3))]
    key, known = collocations._joined(columns, 20, most)
    assert all((a == b).all() for a, b in zip(columns, collocations._parted(key, known, 20), strict=True))
    assert (np.lexsort(columns[::-1]) == np.argsort(key, kind="stable")).all()


def test_scores_are_exact(spark):
    rows = [(10**12 + 7, 10**12 + 9, 10**12 + 11), (10**15, 10**15, 10**15), (10**15 - 1, 10**15, 10**15), (10, 1000, 10)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    got = [r[0] for r in df.select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [1_000_000 * a * a // (left * right) for a, left, right in rows]


# --- MinHash


def _sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", _lower(text))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def _components(rows):
    """(doc_id, size, component, kept) by comparing all pairs."""
    sets = [_sets(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((doc, len(sets[i]), least, doc == least))
    return sorted(out, key=str)


COPY = ("doc_id", "n_shingles", "component_id", "kept")


def _copies(rng, n):
    rows = []
    for g in range(n):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 120))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(0, 5)):
            new = list(base)
            for _ in range(rng.randrange(0, 4)):
                new[rng.randrange(len(new))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(new[rng.randrange(0, 2) :]))
    rng.shuffle(rows)
    return [(i * 3 % 1009, t, "en", "s") for i, t in enumerate(rows)]


def test_near_duplicates(spark, odd):
    rows = _copies(random.Random(3), 60)
    got = [tuple(r) for r in minhash_dedup.near_duplicates(_docs(spark, rows)).select(*COPY).collect()]
    assert sorted(got, key=str) == _components(rows)
    assert 10 < sum(r[2] != r[0] for r in got) < len(rows) - 10
    got = [tuple(r) for r in minhash_dedup.near_duplicates(odd).select(*COPY).collect()]
    assert sorted(got, key=str) == _components(ODD)
    assert minhash_dedup.near_duplicates(odd.where("false")).count() == 0


def test_links_at_the_bound(spark):
    """40 of 50 shingles in common link, 39 of 50 don't."""
    chain = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    rows = []
    for k, common in enumerate((40, 39)):
        base = chain(f"c{k}_", common + 3)
        rows += [(10 * k + 1, " ".join(base + chain(f"a{k}_", 5)), "en", "s"), (10 * k + 2, " ".join(base + chain(f"b{k}_", 50 - common - 5)), "en", "s")]
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(_docs(spark, rows)).collect()} == {1: 1, 2: 1, 11: 11, 12: 12}


def test_crowded_buckets(spark):
    """Documents under one long passage fill their buckets; near copies among them are found, others are not linked."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(90)]
    rows = []
    for i in range(40):
        tail = [f"t{i}_{j}" for j in range(40)]
        rows.append((2 * i, " ".join(passage + tail), "en", "s"))
        if i % 2:
            tail[rng.randrange(40)] = "changed"
            rows.append((2 * i + 1, " ".join(passage + tail), "en", "s"))
    cfg = minhash_dedup.MinHashConfig(paired=3, block=8)
    got = [tuple(r) for r in minhash_dedup.near_duplicates(_docs(spark, rows), cfg).select(*COPY).collect()]
    assert sorted(got, key=str) == _components(rows)


def test_minima_estimate_similarity():
    make = minhash_dedup.Sketches(minhash_dedup.MinHashConfig())
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (8000, 1000, 1000))
    x, y = (np.unique(np.concatenate([common, t])) for t in (a, b))
    minima = make.minima([x, y, x[:1]])
    assert abs((minima[0] == minima[1]).mean() - 0.8) < 0.12
    assert (make.bands(minima)[0] == make.bands(minima)[1]).sum() > 3
    assert np.array_equal(make.minima([x])[0], minima[0])
    assert len(make.shingles(b"a b c " * 3)) == 3 and len(make.shingles(b"")) == 0
    pieces = minhash_dedup.Sketches(minhash_dedup.MinHashConfig(text_bytes=7))
    text = " ".join(f"Word{i % 50}" for i in range(300)).encode()
    assert np.array_equal(pieces.shingles(text), make.shingles(text))


# --- divergence


def _divergences(rows, cfg):
    find = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", _lower(t))
    rows = [(t, lang or "", s or "") for _, t, lang, s in rows]
    out = []
    for lang in {r[1] for r in rows}:
        df = collections.Counter(w for t, own, _ in rows if own == lang for w in set(find(t)))
        kept = [w for w, n in df.items() if n >= cfg.least_docs]
        counts = {s: collections.Counter() for _, own, s in rows if own == lang}
        for t, own, s in rows:
            if own == lang:
                counts[s].update(w for w in find(t) if df[w] >= cfg.least_docs)
        whole = sum(counts.values(), collections.Counter())
        p = lambda c, w: 1 + cfg.scale * (c[w] + 1) // (sum(c.values()) + len(kept))  # noqa: B023, E731
        for s, c in counts.items():
            pairs = [(o, sum((p(c, w) - p(d, w)) ** 2 // p(d, w) for w in kept)) for o, d in counts.items() if o != s]
            terms = [(w, (p(c, w) - p(whole, w)) ** 2 // p(whole, w)) for w in kept if c[w] > 0 and p(c, w) > p(whole, w)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, cfg.top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(found[:most], 1)]
    return sorted(out)


AUDIT = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("cells, held", [(1 << 20, 250_000), (8, 4)])
def test_divergences(spark, odd, cells, held):
    rng = random.Random(4)
    words = ["the", "Of", "in2new", "york", "ÜBER", "über", "naïve", "a-b", "x", "yy"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for i in range(80)]
    cfg = divergence.DivergenceConfig(cells=cells, held_rows=held, text_bytes=100, top=5)
    assert _rows(divergence.divergences(_docs(spark, rows), cfg), *AUDIT) == _divergences(rows, cfg)
    assert _rows(divergence.divergences(odd, cfg), *AUDIT) == _divergences(ODD, cfg)
    assert divergence.divergences(odd.where("false")).count() == 0


def test_probabilities_pass_64_bits():
    counts = np.array([[10**13, 5, 0]])
    got = divergence.probabilities(counts, counts.sum(axis=1)[:, None], 3, 10**9)
    total = 10**13 + 5 + 3
    assert got.tolist() == [[1 + 10**9 * (c + 1) // total for c in (10**13, 5, 0)]]


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["aaaa", None, "bb", "c" * 50, "", "d"])], names=["t"])
    parts = list(divergence.slices(batch, 0, 6))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(0).to_pylist()) <= 6 for p in parts)
