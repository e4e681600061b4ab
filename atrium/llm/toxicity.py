"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade > k | x) = sigmoid(w.x - b_k) with one weight vector for all thresholds b_0 < b_1 < ... The result is
the expected severity, the sum of these probabilities.

Where labels have grades (0, 1, 2, ...) these are what is fitted. Labels of 0 and 1 only say where grade 0 ends; the
grades above are then made from how dense a toxic document is in words that go with the label, so severities order
documents by that density and are not learnt from graded judgements.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atrium.llm.tables import table, texts
from atrium.storage import ship, stored

_WORD = re.compile(r"[^\W\d_]+")
#: A word gives itself and its beginnings of these lengths, so that inflected forms share evidence.
PREFIXES = (4, 5, 6, 7)


def features(text: str | None) -> tuple[dict[str, int], int]:
    """Counts of words and of word beginnings (written ``xyz*``) in the whole text, and its number of words."""
    words = Counter(_WORD.findall((text or "").lower()))
    found: dict[str, int] = {}
    for word, n in words.items():
        for f in _of_word(word):
            found[f] = found.get(f, 0) + n
    return found, words.total()


def _of_word(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


@dataclass(frozen=True)
class ToxicityConfig:
    #: At most so many labelled documents are fitted on, the same ones for the same labels, and of rows with one text one.
    max_labelled: int = 10_000
    #: A feature is in at least this share of the toxic documents of the sample, so there are at most 1 / least_share
    #: times as many features as a toxic document has on average.
    least_share: float = 0.02
    #: Features are log(1 + scale * occurrences / words).
    scale: float = 500.0
    #: A feature's share of toxic documents is above that of the others by so many standard errors, and so many times it.
    least_z: float = 4.0
    least_lift: float = 8.0
    grades: int = 4
    l2: float = 1e-5
    iterations: int = 1500
    #: Expected severity from which a document is toxic.
    reject_at: float = 0.25


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    thresholds: tuple[float, ...]
    scale: float


def training_rows(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig) -> DataFrame:
    """``(doc_id, text, toxic)`` of a bounded, repeatable choice of labelled documents.

    Labels that are null are left out; of several for a document the highest counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.max_labelled)
    rows = texts(docs).where("doc_id IS NOT NULL")
    rows = rows.join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.dropDuplicates(["h", "toxic"]).drop("h")


def fit(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Choose features and fit weights and thresholds on the labelled sample.

    Labels above 1 are grades as they are, the highest of them ``grades - 1``. Where labels only say toxic or not, grades
    above 0 come from how dense a toxic document is in words that go with the label: its share of them against the
    quantiles over toxic documents. Without labels of both kinds there is nothing to learn, and the model gives every
    text the severity 0. Null labels and ids are left out; an empty table is one without labels.
    """
    rows = stored(_featured(training_rows(docs, labels, cfg)))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sum(v for k, v in n.items() if k > 0), sum(v for k, v in n.items() if k <= 0)
    if not n1 or not n0:
        return ToxicityModel({}, (50.0,) * (cfg.grades - 1), cfg.scale)
    seen = rows.select("toxic", F.explode(F.map_keys("features")).alias("feature")).groupBy("feature")
    seen = seen.agg(F.sum((F.col("toxic") > 0).cast("long")).alias("d1"), F.count("*").alias("d"))
    share, d0 = F.col("d") / (n1 + n0), F.col("d") - F.col("d1")
    z = (F.col("d1") / n1 - d0 / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    lift = ((F.col("d1") + 0.5) / (n1 + 1)) / ((d0 + 0.5) / (n0 + 1))
    chosen = seen.where(F.col("d1") >= max(2.0, cfg.least_share * n1)).select("feature", z.alias("z"), lift.alias("lift"))
    chosen = chosen.where((F.col("z") >= cfg.least_z) & (F.col("lift") >= cfg.least_lift))
    names = [r["feature"] for r in chosen.orderBy(F.desc("z"), "feature").collect()]
    kept = F.map_filter("features", lambda k, _: k.isin(*names)) if names else F.map_filter("features", lambda k, _: F.lit(False))
    return _fit(rows.select("toxic", "n_words", kept.alias("features")).collect(), names, cfg)  # max_labelled rows


def _featured(rows: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 100):  # a text has thousands of features: few texts at once
                part = frame.iloc[at : at + 100]
                found = [features(t) for t in part["text"]]
                yield pd.DataFrame({"toxic": part["toxic"], "n_words": [n for _, n in found], "features": [f for f, _ in found]})

    return rows.mapInPandas(run, "toxic int, n_words bigint, features map<string,int>")


def _fit(rows: list, names: list[str], cfg: ToxicityConfig) -> ToxicityModel:
    """Full-batch Adam on the ordinal log-likelihood; rows are put in a fixed order first."""
    rows = sorted(((r["toxic"], r["n_words"], sorted(r["features"].items())) for r in rows))
    number = {f: i for i, f in enumerate(names)}
    label = np.clip(np.array([t for t, _, _ in rows]), 0, cfg.grades - 1)
    toxic = label > 0
    dense = np.array([sum(c for _, c in found) / max(1, n) for _, n, found in rows])
    cuts = np.quantile(dense[toxic], [k / (cfg.grades - 1) for k in range(1, cfg.grades - 1)])
    grade = label if label.max() > 1 else np.where(toxic, 1 + np.searchsorted(cuts, dense, side="right"), 0)
    at = np.repeat(np.arange(len(rows)), [len(found) for _, _, found in rows])
    ids = np.array([number[f] for _, _, found in rows for f, _ in found], dtype=np.int64)
    x = np.log1p(cfg.scale * np.array([c / n for _, n, found in rows for _, c in found], dtype=np.float64))
    above = grade[:, None] > np.arange(cfg.grades - 1)[None, :]
    share = np.clip(above.mean(axis=0), 1e-4, 1 - 1e-4)
    w, b = np.zeros(max(1, len(names))), -np.log(share / (1 - share))
    m, v = np.zeros(len(w) + len(b)), np.zeros(len(w) + len(b))
    for t in range(1, cfg.iterations + 1):
        score = np.bincount(at, weights=x * w[ids], minlength=len(rows)) if len(ids) else np.zeros(len(rows))
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - b[None, :], -50, 50)))
        gap = (p - above) / len(rows)
        g_w = (np.bincount(ids, weights=x * gap.sum(axis=1)[at], minlength=len(w)) if len(ids) else 0 * w) + cfg.l2 * w
        g = np.concatenate([g_w, -gap.sum(axis=0)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[: len(w)], np.sort(b - step[len(w) :])
    return ToxicityModel({k: float(w[i]) for i, k in enumerate(names)}, tuple(map(float, b)), cfg.scale)


def _severities(model: ToxicityModel):
    weights, thresholds = model.weights, np.array(model.thresholds)

    class Known(dict):
        """The features of each word met so far; started anew at a fixed size."""

        def __missing__(self, word: str) -> tuple:
            if len(self) >= 300_000:
                self.clear()
            self[word] = found = tuple(f for f in _of_word(word) if f in weights)
            return found

    known = Known()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = np.zeros(len(frame))
            for k, text in enumerate(frame["text"]):
                if text:
                    found: dict[str, int] = {}
                    words = Counter(_WORD.findall(text.lower()))
                    for word, n in words.items():
                        for f in known[word]:
                            found[f] = found.get(f, 0) + n
                    per = model.scale / max(1, words.total())
                    scores[k] = sum(weights[f] * math.log1p(per * c) for f, c in sorted(found.items()))
            p = 1 / (1 + np.exp(-np.clip(scores[:, None] - thresholds[None, :], -50, 50)))
            out = frame.drop(columns="text")
            out["severity"] = np.round(p.sum(axis=1), 6)
            out["grade"] = (p > 0.5).sum(axis=1).astype("int32")
            yield out

    return run


def score(docs: DataFrame, model: ToxicityModel, cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """``(doc_id, severity, grade, toxic)`` for each row: expected severity from 0 to grades - 1.

    Whole texts are read; null and empty texts have no features. ``toxic`` is severity >= reject_at. Null ids and
    repeated rows keep their rows; other columns are left behind.
    """
    out = texts(docs).mapInPandas(_severities(model), "doc_id bigint, severity double, grade int")
    return out.withColumn("toxic", F.col("severity") >= cfg.reject_at)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def drop_toxic(docs: DataFrame, model: ToxicityModel, cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """``docs`` without the rows whose severity is ``reject_at`` or more; rows are judged where they stand."""
    ship(docs.sparkSession)
    severity = _severities(model)

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield next(severity(iter([pd.DataFrame({"text": part})])))["severity"]

    return docs.where(of(F.col("text").cast("string")) < cfg.reject_at)
