"""Quality rules under weak supervision, in DataFrame functions only.

Rules vote good (1), bad (0) or abstain (null). Documents are counted by their vote pattern, which
gives at most 3^rules rows whatever the corpus size; expectation-maximisation on those counts
estimates how often each rule is right on good and on bad documents, and each pattern's posterior
probability of being good replaces "all rules must pass".
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atrium.llm.tables import SPACES, let, table
from atrium.storage import stored

SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of English, German, French and Spanish (fixed values).
FUNCTION_WORDS = (
    "the of and to in a is that for it with as was on be by this are from or "
    "der die das und ist nicht ein eine zu den mit von sich auf für im dem auch als "
    "de la le et les des en un une du est que pour dans qui sur pas par avec au "
    "el los las que y por con para una su del se no lo como más"
).split()


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 50
    max_repeat_percent: int = 50
    keep_at: float = 0.5
    iterations: int = 100
    #: Where EM starts, and what it holds of a rule before any vote (with the weight of one vote).
    prior_good: float = 0.85
    right_on_good: float = 0.9
    right_on_bad: float = 0.6


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Texts whose windows all hash apart have none; the others' windows are sorted and equal neighbours marked.
    """
    at = lambda w, i: (F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def marked(s: Column) -> Column:
        same = lambda x, i: (x["g"] == F.get(s, i - 1)["g"]) | (x["g"] == F.get(s, i + 1)["g"])
        return F.filter(
            F.transform(s, lambda x, i: F.when(F.coalesce(same(x, i), F.lit(False)), x["p"])), lambda p: p.isNotNull()
        )

    def count(w: Column) -> Column:
        starts = F.slice(w, F.lit(1), F.size(w) - 2)
        hashes = F.transform(starts, lambda _, i: F.xxhash64(*at(w, i)))
        windows = F.transform(starts, lambda _, i: F.struct(F.concat_ws(" ", *at(w, i)).alias("g"), i.alias("p")))
        found = let(F.sort_array(windows), marked)
        covered = F.flatten(F.transform(found, lambda p: F.array(p, p + 1, p + 2)))
        apart = F.size(F.array_distinct(hashes)) == F.size(w) - 2
        return F.when((F.size(w) < 3) | apart, F.lit(0)).otherwise(F.size(F.array_distinct(covered)))

    return let(words, count).cast("long")


def text_stats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id and the counts the rules look at. A null or blank text has zero words.

    Works a row at a time, without a shuffle; repeated rows give repeated results.
    """
    t = F.col("text")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(t.cast("string"), F.lit("")).alias("text")
    )
    split = base.select(
        "doc_id",
        "text",
        F.array_remove(F.split(t, SPACES), "").alias("words"),
        F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\r\x0b\f"))) > 0).alias("lines"),
    )
    words, lines = F.col("words"), F.col("lines")
    return split.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count(t, F.lit("[.!?]")).cast("long").alias("n_stops"),
        F.size(F.array_intersect(words, F.array(*map(F.lit, FUNCTION_WORDS)))).cast("long").alias("n_function"),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1))


def rules() -> dict[str, Column]:
    """The votes as Columns over ``text_stats``. A vote is evidence, not a verdict: each is wrong on some documents."""
    c = F.col
    return {
        "length": _vote(c("n_words") >= 100, c("n_words") < 50),
        "word_size": _vote(
            (c("word_chars") >= 4 * c("n_words")) & (2 * c("word_chars") <= 11 * c("n_words")),
            (c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 7 * c("n_words")),
        ),
        "symbols": _vote(100 * c("n_symbols") <= c("word_chars"), 20 * c("n_symbols") > c("word_chars")),
        "lines": _vote(c("n_dup_lines") == 0, 10 * c("n_dup_lines") > c("n_lines")),
        "repeats": _vote(50 * c("n_repeat_words") <= c("n_words"), 10 * c("n_repeat_words") > c("n_words")),
        "capitals": _vote(
            (100 * c("n_upper") >= c("word_chars")) & (100 * c("n_upper") <= 3 * c("word_chars")),
            (200 * c("n_upper") < c("word_chars")) | (20 * c("n_upper") > c("word_chars")),
        ),
        "sentences": _vote(
            (20 * c("n_stops") >= c("n_words")) & (8 * c("n_stops") <= c("n_words")),
            (33 * c("n_stops") < c("n_words")) | (5 * c("n_stops") > c("n_words")),
        ),
        "function_words": _vote(c("n_function") >= 8, c("n_function") < 4),
    }


def fit(counts: list[tuple[tuple, int]], cfg: QualityConfig) -> tuple[float, list[tuple[float, float]]]:
    """EM over (vote pattern, count): the share of good documents and each rule's accuracies on good and on bad ones.

    Nothing holds a rule to an accuracy: one whose votes the others don't bear out ends with little weight either way.
    """
    if not counts:
        return cfg.prior_good, []
    n_rules = len(counts[0][0])
    share, right = cfg.prior_good, [(cfg.right_on_good, cfg.right_on_bad)] * n_rules
    for _ in range(cfg.iterations):
        post = [posterior(votes, share, right) for votes, _ in counts]
        total = sum(n for _, n in counts)
        new_share = (sum(p * n for p, (_, n) in zip(post, counts, strict=True)) + 1) / (total + 2)
        new = []
        for j in range(n_rules):
            sums = [0.0] * 4  # good class: votes good, votes; bad class: votes bad, votes
            for p, (votes, n) in zip(post, counts, strict=True):
                if (v := votes[j]) is not None:
                    sums[0] += p * n * v
                    sums[1] += p * n
                    sums[2] += (1 - p) * n * (1 - v)
                    sums[3] += (1 - p) * n
            on_good, on_bad = (sums[0] + cfg.right_on_good) / (sums[1] + 1), (sums[2] + cfg.right_on_bad) / (sums[3] + 1)
            new.append((min(max(on_good, 1e-4), 1 - 1e-4), min(max(on_bad, 1e-4), 1 - 1e-4)))
        moved = max(abs(a - b) for x, y in zip(new, right, strict=True) for a, b in zip(x, y, strict=True))
        share, right = new_share, new
        if moved < 1e-7:
            break
    return share, right


def posterior(votes: tuple, share: float, right: list[tuple[float, float]]) -> float:
    """P(good | votes); abstentions say nothing."""
    odds = math.log(share / (1 - share))
    for v, (on_good, on_bad) in zip(votes, right, strict=True):
        if v is not None:
            odds += math.log(on_good / (1 - on_bad)) if v else math.log((1 - on_good) / on_bad)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def quality(docs: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """One row per row of ``docs`` with counts, votes, ``p_good``, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rule. Rows with a null doc_id are judged like
    any other. An empty table gives an empty result. All counts are over whole texts; the model is
    fitted on every document through the pattern counts, which no single pattern can skew.
    """
    votes = rules()
    stats = text_stats(docs)
    judged = stored(stats.select("*", *[v.alias(f"vote_{k}") for k, v in votes.items()]))
    names = [f"vote_{k}" for k in votes]
    found = judged.groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most 3^rules rows
    counts = sorted(((tuple(r[k] for k in names), r["n"]) for r in found), key=repr)
    share, right = fit(counts, cfg)
    right = right or [(cfg.right_on_good, cfg.right_on_bad)] * len(names)
    odds = F.lit(math.log(share / (1 - share)))
    for k, (on_good, on_bad) in zip(names, right, strict=True):
        up, down = math.log(on_good / (1 - on_bad)), math.log((1 - on_good) / on_bad)
        odds = odds + F.when(F.col(k) == 1, F.lit(up)).when(F.col(k) == 0, F.lit(down)).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < cfg.min_words) | (
        100 * F.col("n_repeat_words") > cfg.max_repeat_percent * F.col("n_words")
    )
    out = judged.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= cfg.keep_at))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("p_good", 6).alias("p_good"),
    )

