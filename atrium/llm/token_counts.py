"""Token counts by rank-synchronous merging of ragged numpy arrays.

Texts are cut into pre-tokens that no merge can cross; the distinct ones of a batch stand side by side in one
ragged array of symbols. In each round every pre-token's lowest-rank pair is merged at all its places at once,
until no pair is left; what survives is counted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atrium.llm.tables import table, texts

_NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class TokenCountConfig:
    model: str = "piece_bpe_32k.model"
    limit: int = 4096
    #: Distinct pre-tokens whose counts a task remembers, and symbols it merges at once.
    remembered: int = 1_000_000
    symbols: int = 4_000_000


class MergeTable:
    """Symbols and pair ranks of a SentencePiece BPE model with byte fallback and no text normalisation.

    A symbol is a character or a piece. A pair may merge if its joined text is a piece; its rank is the piece's
    place by falling score. Characters that are no piece count as their UTF-8 bytes.
    """

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [
            i for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        ]
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece goes on into another word: pre-tokens can't be cut before spaces")
        if sp.encode("Ａ ½  a", out_type=str)[-1] != "▁a" or sp.encode(" a", out_type=str)[0] == "▁a":
            raise ValueError("the model changes white space in texts")
        self.single = {p for p in pieces if len(p) == 1}
        chars = sorted({c for p in pieces for c in p})
        self.symbol: dict[str, int] = {c: i for i, c in enumerate(chars)}
        for p in pieces:
            self.symbol.setdefault(p, len(self.symbol))
        self.size = len(self.symbol) + 1  # the last number: any character in no piece
        scores = sorted(set(pieces.values()), reverse=True)
        rank = {s: i for i, s in enumerate(scores)}
        keys, ranks, made = [], [], []
        for p, score in pieces.items():
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    ranks.append(rank[score])
                    made.append(self.symbol[p])
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.ranks = np.array(ranks, dtype=np.int64)[order]
        self.made = np.array(made, dtype=np.int64)[order]
        self.first = {int(k): (int(r), int(m)) for k, r, m in zip(self.keys, self.ranks, self.made, strict=True)}

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NONE) and merged symbol of each pair."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.made[at]


_TABLES: dict[str, MergeTable] = {}


def merge_table(model: str) -> MergeTable:
    """The table of a model file, read once in a worker."""
    if model not in _TABLES:
        _TABLES[model] = MergeTable(public_tokenizers.path(model))
    return _TABLES[model]


def _one_by_one(symbols: list[int], t: MergeTable) -> int:
    """Symbols left after merging the best pair, leftmost first, one at a time."""
    import heapq

    n = len(symbols)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        if i >= 0 and after[i] < n and (found := t.first.get(symbols[i] * t.size + symbols[after[i]])):
            heapq.heappush(heap, (found[0], i, symbols[i], symbols[after[i]]))

    for i in range(n - 1):
        push(i)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        if not alive[i] or symbols[i] != a or after[i] >= n or symbols[after[i]] != b:
            continue
        j = after[i]
        symbols[i], alive[j], after[i] = t.first[a * t.size + b][1], False, after[j]
        if after[i] < n:
            before[after[i]] = i
        left -= 1
        push(before[i])
        push(i)
    return left


def merged_sizes(sym: np.ndarray, seq: np.ndarray, n_seq: int, t: MergeTable) -> np.ndarray:
    """Symbols left in each of ``n_seq`` sequences; ``seq`` is each symbol's sequence, in order.

    A round merges the lowest rank of each sequence at all its places, from left to right. That equals merging
    one pair at a time while no merge makes a pair of lower rank; a sequence where one does is done again
    pair by pair.
    """
    start_sym = sym
    size, done = np.bincount(seq, minlength=n_seq), np.zeros(n_seq, dtype=np.int64)
    odd = np.zeros(n_seq, dtype=bool)
    last = np.full(n_seq, -1, dtype=np.int64)
    while len(sym) > 1:
        rank, made = t.find(sym[:-1], sym[1:])
        rank = np.where(seq[:-1] == seq[1:], rank, _NONE)
        best = np.full(n_seq, _NONE, dtype=np.int64)
        begins = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
        best[seq[begins]] = np.minimum.reduceat(np.concatenate([rank, [_NONE]]), begins)
        odd |= best < last
        last = np.where(best < _NONE, best, last)
        more = (best < _NONE) & ~odd
        now = more[seq[:-1]] & (rank == best[seq[:-1]])
        # Of pairs that overlap in a row (a a a a), every second is merged, from the left.
        at = np.flatnonzero(now)
        if len(at):
            new_row = np.concatenate([[True], np.diff(at) > 1])
            first = np.maximum.accumulate(np.where(new_row, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            # A pair made on the way, with the next place's left half, could have gone first.
            near = at[:-1][np.diff(at) == 2]
            if len(near):
                between, _ = t.find(made[near], sym[near + 2])
                odd[seq[near[between < best[seq[near]]]]] = True
            sym = sym.copy()
            sym[at] = made[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
        else:
            keep = np.ones(len(sym), dtype=bool)
        keep &= more[seq]
        ended = ~more
        count = np.bincount(seq, minlength=n_seq)
        done = np.where(ended & (count > 0), count, done)
        sym, seq = sym[keep], seq[keep]
    if len(sym):
        done = np.where(np.bincount(seq, minlength=n_seq) > 0, np.bincount(seq, minlength=n_seq), done)
    ends = np.cumsum(size)
    for i in np.flatnonzero(odd):
        done[i] = _one_by_one(start_sym[ends[i] - size[i] : ends[i]].tolist(), t)
    return done


_PRE = re.compile("▁*[^▁]+|▁+")


class Counts:
    """Token counts of texts; the counts of pre-tokens met before are remembered up to a fixed number."""

    def __init__(self, cfg: TokenCountConfig):
        self.t, self.cfg, self.known = merge_table(cfg.model), cfg, {}

    def _learn(self, new: list[str]) -> None:
        """Merge new pre-tokens in batches of a bounded number of symbols."""
        batch: list[str] = []
        size = 0
        for p in new:
            batch.append(p)
            size += len(p)
            if size >= self.cfg.symbols:
                self._merge(batch)
                batch, size = [], 0
        if batch:
            self._merge(batch)

    def _merge(self, batch: list[str]) -> None:
        t = self.t
        chars = np.frombuffer("".join(batch).encode("utf-32-le"), dtype="<u4")
        distinct, at = np.unique(chars, return_inverse=True)
        named = [chr(c) for c in distinct.tolist()]
        number = np.array([t.symbol.get(c, t.size - 1) for c in named], dtype=np.int64)
        extra = np.array([0 if c in t.single else len(c.encode()) - 1 for c in named], dtype=np.int64)
        seq = np.repeat(np.arange(len(batch)), [len(p) for p in batch])
        fallback = np.bincount(seq, weights=extra[at], minlength=len(batch)).astype(np.int64)
        sizes = merged_sizes(number[at], seq, len(batch), t) + fallback
        self.known.update(zip(batch, sizes.tolist(), strict=True))

    def __call__(self, batch: list[str]) -> list[int]:
        cut = [self._cut(text) for text in batch]
        new = {p for c in cut for p in c if p not in self.known}
        if len(self.known) + len(new) > self.cfg.remembered:
            self.known.clear()
            new = {p for c in cut for p in c}
        self._learn(sorted(new))
        known = self.known
        return [sum(known[p] * n for p, n in c.items()) for c in cut]

    @staticmethod
    def _cut(text: str) -> dict[str, int]:
        """Pre-tokens of a text: white space escaped and one space put first, as the model does."""
        if not text:
            return {}
        if "▁" in text or "  " in text or text[0] == " " or text[-1] == " ":
            return Counter(_PRE.findall("▁" + text.replace(" ", "▁")))
        return {"▁" + w: n for w, n in Counter(text.split(" ")).items()}


def token_counts(docs: DataFrame, cfg: TokenCountConfig = TokenCountConfig()) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Null texts are empty: no bytes, no tokens. Whole texts are counted, of any length. Null doc_ids and repeated
    rows keep a row each; other columns are left behind. No shuffle.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts(cfg)
        for frame in frames:
            batch, size, out = [], 0, []
            for text in frame["text"]:
                batch.append(text)
                size += len(text)
                if size >= cfg.symbols:
                    out += counts(batch)
                    batch, size = [], 0
            out += counts(batch)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_bytes": frame["n_bytes"], "n_tokens": out})

    text = F.coalesce("text", F.lit(""))
    rows = texts(docs).select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInPandas(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > cfg.limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
